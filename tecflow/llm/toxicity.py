"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in NumPy.

A word is the mean of the vectors of its character n-grams and of itself, a text
the mean of its words, and a softmax over two classes reads the text's vector.
A misspelling unseen in training still shares most n-grams with the word meant.
N-grams are hashed to a fixed number of vectors. For scoring, vectors and softmax
fold into one number for each n-gram, as everything between is a mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textnum as tn
from .common import lean

BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 16, 8, 3, 5
#: Labelled rows the model is fitted on at most: those with the smallest hash of their id.
FITTED_ROWS = 6_000
#: Bytes of text that it is fitted on at most.
FITTED_BYTES = 64 << 20
EPOCHS, BATCH, RATE, SHRINK, SPREAD = 10, 32, 1.0, 1e-6, 0.01
#: From this score on a text counts as toxic.
THRESHOLD = 0.3
MARKS = (np.uint64(2), np.uint64(3))


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[start:end] of all words, one after the other, and where each begins (one more entry)."""
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start - first[:-1], size) + np.arange(first[-1])], first


def subwords(data: np.ndarray, found: tn.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): buckets of the n-grams of each chosen word, its own included, first[i] being where word i's begin."""
    raw, first = gathered(data, found.start[chosen], found.end[chosen])
    head = tn.char_starts(raw)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n_chars = np.add.reduceat(head, first[:-1]) if len(chosen) else np.zeros(0, np.int64)
    n_chars = n_chars.astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n_chars + 2)))
    marked = np.empty(begin[-1], np.uint64)
    word = np.repeat(np.arange(len(chosen)), n_chars + 2)
    inner = np.ones(len(marked), bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    marked[inner] = codes
    marked[begin[:-1]], marked[begin[1:] - 1] = MARKS
    words, ids = [np.arange(len(chosen))], [found.hash[chosen]]
    for n in range(SHORTEST, LONGEST + 1):
        k = len(marked) - n + 1
        if k <= 0:
            continue
        whole = np.flatnonzero(word[:k] == word[n - 1 :])
        h = np.full(len(whole), np.uint64(n))
        for i in range(n):
            h = tn.mixed(h + marked[whole + i])
        words.append(word[whole])
        ids.append(h)
    words, ids = np.concatenate(words), np.concatenate(ids)
    order = np.argsort(words, kind="stable")
    counts = np.bincount(words, minlength=len(chosen))
    return (ids[order] % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(([0], np.cumsum(counts)))


@dataclass
class Bags:
    """Texts as bags of distinct words: text i has words word[first[i]:first[i + 1]] with these shares; subwords of word j alike."""

    word: np.ndarray
    share: np.ndarray
    first: np.ndarray
    sub: np.ndarray
    sub_first: np.ndarray


def bags(texts: list[str | None]) -> Bags:
    known: dict[int, int] = {}
    word, share, first, sub, sizes = [], [], [0], [], []
    for piece in tn.pieces(pa.array(texts, pa.string())):
        w = tn.words(piece, lower=True)
        total = w.per_row()
        keys, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        fresh = np.array([int(k) not in known for k in keys], bool)
        for k in keys[fresh].tolist():
            known[k] = len(known)
        place = np.array([known[int(k)] for k in keys], np.int64)
        ids, begin = subwords(tn.LOWER[piece.data], w, at[fresh])
        sub.append(ids)
        sizes.append(np.diff(begin))
        pair, n = np.unique(w.row * len(keys) + back if len(keys) else w.row, return_counts=True)
        row, k = (pair // len(keys), pair % len(keys)) if len(keys) else (pair, pair)
        word.append(place[k] if len(keys) else k)
        share.append(n / np.maximum(total[row], 1))
        first += (first[-1] + np.cumsum(np.bincount(row.astype(int), minlength=len(piece)))).tolist()
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Bags(join(word, np.int64), join(share, np.float32), np.array(first), join(sub, np.int64), np.concatenate(([0], np.cumsum(join(sizes, np.int64)))))


@dataclass
class Model:
    """weight[b]: what n-gram bucket b adds to the log odds where it is all of a text; bias: log odds of an empty text."""

    weight: np.ndarray
    bias: float


def spans(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[i] to first[i + 1] of all chosen i in turn, and how many of each."""
    size = first[chosen + 1] - first[chosen]
    begin = np.cumsum(size) - size
    return np.repeat(first[chosen] - begin, size) + np.arange(size.sum()), size


def fitted(texts: list[str | None], labels: np.ndarray, seed: int = 7) -> Model:
    """Trains vectors and softmax by adaptive gradient steps on the cross-entropy; without both classes the bias alone is fitted."""
    labels = np.asarray(labels, np.float32)
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    b = bags(texts)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, SPREAD, (BUCKETS, DIMENSIONS))
    soft = rng.normal(0, 0.5, (DIMENSIONS, 2))
    offset = np.log(np.array([1 - prior, prior]))
    v2, s2, o2 = np.full(BUCKETS, 1e-9), np.full(soft.shape, 1e-9), 1e-9
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            entries, n_words = spans(b.first, rows)
            text_of, words = np.repeat(np.arange(len(rows)), n_words), b.word[entries]
            subs, n_subs = spans(b.sub_first, words)
            ids, part = b.sub[subs], np.repeat(b.share[entries] / n_subs, n_subs)
            # Both classes see the text's mean vector; only the difference of their logits matters to the softmax.
            axis = soft[:, 1] - soft[:, 0]
            value = (vectors @ axis)[ids] * part
            row_of = np.repeat(text_of, n_subs)
            logit = np.bincount(row_of, value, len(rows)) + offset[1] - offset[0]
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[rows]) / len(rows)
            pull = np.bincount(ids, error[row_of] * part, BUCKETS)
            seen = pull != 0
            g_soft = (pull[:, None] * vectors).sum(axis=0)[:, None] * np.array([-1.0, 1.0])
            g_vectors = pull[seen, None] * axis + SHRINK * vectors[seen]
            v2[seen] += (g_vectors**2).mean(axis=1)
            vectors[seen] -= rate * g_vectors / np.sqrt(v2[seen])[:, None]
            s2 += g_soft**2
            soft -= rate * g_soft / np.sqrt(s2)
            o2 += error.sum() ** 2
            offset += np.array([0.5, -0.5]) * rate * error.sum() / np.sqrt(o2)
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(offset[1] - offset[0]))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of the toxic class for every text of a column."""
    out = []
    for piece in tn.pieces(column):
        w = tn.words(piece, lower=True)
        logit = np.full(len(piece), model.bias)
        if len(w.hash):
            _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            ids, first = subwords(tn.LOWER[piece.data], w, at)
            value = np.add.reduceat(model.weight[ids].astype(np.float64), first[:-1]) / np.diff(first)
            logit += w.per_row(value[back]) / np.maximum(w.per_row(), 1)
        out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from all fitting: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = FITTED_ROWS) -> Model:
    """Fits on at most limit labelled rows that are not held out, and at most FITTED_BYTES of text; rows without id or label are left out.

    Rows of docs that are equal in id and text count once, however many there are.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    rows = rows.where(~held_out("id")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(limit)
    # At most limit rows of two numbers, so the broadcast is bounded.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = texts.join(F.broadcast(rows), "id").withColumn("th", F.xxhash64("text"))
    sizes = named.groupBy("id", "th", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    picked = sizes.orderBy(F.xxhash64("id"), "id", "label", "th").limit(limit).toArrow()
    fits = np.cumsum(picked["size"].to_numpy()) <= FITTED_BYTES
    chosen = docs.sparkSession.createDataFrame(picked.filter(pa.array(fits)), sizes.schema).drop("size")
    table = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th", "label"]).toArrow()
    keys = [table["label"].to_numpy(), table["th"].to_numpy(), table["id"].to_numpy(zero_copy_only=False)]
    table = table.take(pa.array(np.lexsort(keys)))
    return fitted(table["text"].to_pylist(), table["label"].to_numpy())


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row's whole text; null and empty texts get the score of no words at all."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            p = scores(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): fits on the labelled rows that are not held out, then scores all rows."""
    found = scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
