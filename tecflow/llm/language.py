"""Language ID: the nearest of several centroids per language, in normalised TF-IDF space.

A text is the vector of its letter 1- to 3-grams, hashed to a fixed size, with
logarithmic term counts times inverse document frequency, at length one. Each
language has CLUSTERS centroids, found by spherical k-means on a bounded sample
of its texts; document frequencies are counted over all texts to learn from. The
language of the centroid with the greatest cosine wins. A text that lies far
farther from its centroid than other texts of the language is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import textnum as tn
from .common import bounded, drop_staged, lean, rows_where, staged
from .toxicity import held_out

SIZE, LONGEST, CLUSTERS, ROUNDS, LEAST_SHARE = 4096, 3, 4, 12, 0.1
#: Texts of each language that its centroids are fitted on at most: those with the smallest hash, of this many bytes at most. Languages learned at most; more are an error.
FITTED_ROWS, FITTED_BYTES, LANGUAGES = 512, 1 << 16, 1_000
#: Every so many-th text of the sample is kept from the centroids and tells how near the language's texts come.
CALIBRATED = 4
#: A text is rejected below this part of the cosine that half of these texts reach, for its length: see reach.
SLACK = 0.68
#: Letters at which a text's cosine with its centroid is 0.7 of that of a very long one.
HALF = 120
UNDETERMINED = "und"
#: Bytes and rows of texts whose dense vectors are held at a time.
PIECE_BYTES, PIECE_ROWS = 1 << 19, 128


@cache
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other code points."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: tn.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram with a letter, and the number of letters by row. Runs of other characters count as one mark."""
    codes = letters()[np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    row = tn.row_of_bytes(texts)[tn.char_starts(texts.data)]
    n_letters = np.bincount(row[codes > 0], minlength=len(texts))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (row[1:] != row[:-1])
    codes, row = codes[keep].astype(np.uint64), row[keep]
    rows, buckets, value = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        k = len(codes) - n + 1
        if k <= 0:
            break
        value = tn.mixed(value[:k] + codes[n - 1 :] + np.uint64(1))
        whole = (row[:k] == row[n - 1 :]) if n > 1 else codes > 0
        rows.append(row[:k][whole])
        buckets.append((value[whole] % np.uint64(SIZE)).astype(np.int64))
    empty = np.zeros(0, np.int64)
    return np.concatenate(rows) if rows else empty, np.concatenate(buckets) if buckets else empty, n_letters


def counts(texts: tn.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SIZE) n-gram counts and letters by row."""
    row, bucket, n_letters = grams(texts)
    return np.bincount(row * SIZE + bucket, minlength=len(texts) * SIZE).reshape(-1, SIZE).astype(np.float32), n_letters


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Unit centroids of at most k clusters of unit vectors.

    Starts lie at even ranks of nearness to the mean of all; then mean and
    reassign. A cluster of less than LEAST_SHARE of the vectors is given up, its
    members go to the others: a few odd texts are no way to write a language.
    """
    k = min(k, len(x))
    c = x[np.argsort(x @ x.mean(axis=0), kind="stable")[(2 * np.arange(k) + 1) * len(x) // (2 * k)]]
    for step in range(2 * ROUNDS):
        at = np.argmax(x @ c.T, axis=1)
        if step == ROUNDS:
            n = np.bincount(at, minlength=len(c))
            c = c[(n >= LEAST_SHARE * len(x)) | (n == n.max())]
            at = np.argmax(x @ c.T, axis=1)
        c = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def reach(n_letters: np.ndarray) -> np.ndarray:
    """Part of a very long text's cosine that texts of so many letters come to: few n-grams cover little of a centroid."""
    return np.sqrt(n_letters / (n_letters + HALF))


@dataclass
class Model:
    """languages[j] is the language of centroids[j]; floors[j] the least cosine of a very long text that is not rejected."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all texts have each n-gram bucket, and how many texts there are."""

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in found:
            for piece in tn.pieces(batch.column(0), PIECE_BYTES, PIECE_ROWS):
                total += (counts(piece)[0] > 0).sum(axis=0)
                n += len(piece)
        keys = np.append(np.flatnonzero(total), SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.append(total, n)[keys])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE + 1, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out[:SIZE], int(out[SIZE])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and language of the rows that are not held out; a text without letters or language teaches nothing."""
    source = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    source = source.where("lang is not null and text rlike '\\\\p{L}'")
    seen, n = document_frequencies(source)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    source = source.withColumn("th", F.xxhash64("text")).withColumn("h", F.xxhash64("id", "th").bitwiseAND(F.lit((1 << 62) - 1)))
    sizes = staged(source.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    if sizes.count() > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    # So many small hashes are kept that a language has enough, and no task sees more than a few times as many.
    share = F.least(F.lit(1.0), 8.0 * FITTED_ROWS / F.col("n"))
    few = source.join(F.broadcast(sizes), "lang").where((F.col("h") <= share * float(1 << 62)) & (F.octet_length("text") <= FITTED_BYTES))
    rows = few.select("lang", "h", "id", "th").distinct()
    picked = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "th"))).where(F.col("at") <= FITTED_ROWS)
    chosen = staged(picked.select("lang", "id", "th"), "chosen")
    sample = source.join(bounded(chosen, 32 + F.octet_length("lang")), ["lang", "id", "th"]).dropDuplicates(["lang", "id", "th"])

    def centers(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        counted = [counts(p) for p in tn.pieces(pa.array(sorted(found["text"]), pa.string()), PIECE_BYTES, PIECE_ROWS)]
        x, n_letters = vectors(np.concatenate([c for c, _ in counted]), idf), np.concatenate([k for _, k in counted])
        apart = np.arange(len(x)) % CALIBRATED == CALIBRATED - 1 if len(x) >= 4 * CALIBRATED else np.ones(len(x), bool)
        c = clustered(x[~apart] if not apart.all() else x)
        floor = SLACK * float(np.median((x[apart] @ c.T).max(axis=1) / reach(np.maximum(n_letters[apart], 1))))
        return pd.DataFrame({"lang": [key[0]] * len(c), "center": [row.tolist() for row in c], "floor": floor})

    rows = sample.groupBy("lang").applyInPandas(centers, "lang string, center array<float>, floor double").collect()
    drop_staged(sizes, chosen)
    rows = sorted(rows, key=lambda r: (r.lang, r.center))
    return Model(idf, [r.lang for r in rows], np.array([r.center for r in rows], np.float32).reshape(-1, SIZE), np.array([r.floor for r in rows]))


def judged(column: pa.Array, m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of every text of a column."""
    names, scores, rejects = [], [np.zeros(0)], [np.zeros(0, bool)]
    for texts in tn.pieces(column, PIECE_BYTES, PIECE_ROWS):
        c, n_letters = counts(texts)
        near = vectors(c, m.idf) @ m.centroids.T if len(m.languages) else np.zeros((len(texts), 1), np.float32)
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        known = (n_letters > 0) & bool(m.languages)
        floor = (m.floors[best] if len(m.languages) else 0) * reach(n_letters)
        names += [m.languages[j] if ok else UNDETERMINED for j, ok in zip(best, known, strict=True)]
        scores.append(np.where(known, score, 0.0))
        rejects.append(~known | (score < floor))
    return names, np.concatenate(scores), np.concatenate(rejects)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row's whole text.

    score is the cosine with the nearest centroid; of equal ones the language that
    comes first in order. A null text, one without a
    letter, and any text under a model without languages is und, with score 0,
    and rejected. Rows are judged one by one; repeated and null ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            names, score, rejected = judged(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields]))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected): fits on the rows not held out, then predicts all rows."""
    found = predicted(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, by a model fitted on docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    return rows_where(docs, text_col, lambda column: ~judged(column, shared.value)[2])
