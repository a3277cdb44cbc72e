import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tecflow.llm import toxicity


def rows(n, rng, bad=("stupid", "moron", "pathetic", "worthless")):
    plain = ["".join(rng.choice(list("aeionrtsld"), rng.integers(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        toxic = int(rng.random() < 0.2)
        if toxic:
            for k in rng.choice(len(words), max(1, len(words) // 15), replace=False):
                words[k] = str(rng.choice(bad))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    data = rows(1200, np.random.default_rng(1))
    return toxicity.fitted([t for _, t, _ in data], np.array([y for *_, y in data]))


def test_separates_texts_not_seen(model):
    data = rows(300, np.random.default_rng(9))
    p = toxicity.scores(pa.array([t for _, t, _ in data]), model)
    y = np.array([y for *_, y in data])
    assert ((p >= toxicity.THRESHOLD) == y).mean() > 0.97


def test_misspellings_score_near_the_words_they_mean(model):
    odd, plain = toxicity.scores(pa.array(["moronn stupidd patheticc", "lane dorset antler"]), model)
    assert odd > 0.5 > plain


def test_folded_score_equals_the_plain_mean(model):
    text = "Some stupid wörds here"
    total = []
    for w in text.lower().split():
        piece = next(iter(toxicity.tn.pieces(pa.array([w]))))
        ids, _ = toxicity.subwords(toxicity.tn.LOWER[piece.data], toxicity.tn.words(piece, lower=True), np.array([0]))
        assert len(ids) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5))
        total.append(model.weight[ids].astype(float).mean())
    want = 1 / (1 + np.exp(-(np.mean(total) + model.bias)))
    assert abs(toxicity.scores(pa.array([text]), model)[0] - want) < 1e-9


def test_operator_learns_only_from_rows_not_held_out(spark):
    data = rows(400, np.random.default_rng(3)) + [(5000, None, 0), (5001, "", None), (5002, " ", 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, "stupid moron", "x"), (1, data[1][1], "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (99999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(data) + 2
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r.doc_id, r.score) for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).first().score == 0.5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
