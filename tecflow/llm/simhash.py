"""Near-duplicate documents by SimHash: positional byte index, count filter, components.

Two 64-bit fingerprints that differ in at most RADIUS = 3 bits differ in at most
3 of their 8 bytes, so they share at least 5 positional bytes. The inverted index
has a posting for (positions, bytes at these positions). Posting lists of single
bytes would hold 1/256 of all fingerprints each, so a posting covers three
positions: among any 5 of 8 positions, three lie in the same half, so the 8
triples within the halves (0-3 and 4-7) make every such pair meet. For a pair
that meets, the shared positional bytes are tallied; pairs with fewer than 5 are
dropped and the rest is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import connected_components, drop_staged, lean, staged

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Shingles hashed at a time: bounds a worker's memory for very long texts.
PIECE = 1 << 16
#: Posting lists up to this many fingerprints are paired by the join; longer ones go through blocks of this size.
BLOCK = 256

TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
MASKS = [sum(0xFF << (8 * p) for p in t) for t in TRIPLES]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), PIECE):
        part = shingles[i : i + PIECE]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text; null and empty texts have 0."""

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(1).cast(pa.binary())
            fps = [signed(fingerprint(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, schema)


def tallied(x: F.Column) -> F.Column:
    """How many of the 8 positional bytes are shared, given the exclusive or."""
    shared = [F.when(x.bitwiseAND(F.lit(signed(0xFF << (8 * p)))) == 0, 1).otherwise(0) for p in range(8)]
    return sum(shared[1:], shared[0])


def first_triple(x: F.Column) -> F.Column:
    """The first triple on which a pair agrees: a pair counts in that posting list alone."""
    first = F.lit(len(MASKS))
    for k in reversed(range(len(MASKS))):
        first = F.when(x.bitwiseAND(F.lit(signed(MASKS[k]))) == 0, k).otherwise(first)
    return first


@lean
def block_edges(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside one bounded pair of blocks: for each fingerprint its linked partner with the smallest value.

    A row is (left list, right list) of at most BLOCK fingerprints each.
    """
    for batch in found:
        u, v = [], []
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            a, b = (np.sort(np.asarray(x.values)) for x in (a, b))
            x = (a[:, None] ^ b[None, :]).view(np.uint64)
            shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
            near = (shared >= 8 - RADIUS) & (np.bitwise_count(x) <= RADIUS) & (x != 0)
            u, v = grown_forest(a, b, near, u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def grown_forest(a: np.ndarray, b: np.ndarray, near: np.ndarray, u: list, v: list) -> tuple[list, list]:
    """Appends a spanning forest of the links in near: at most len(a) + len(b) edges, the same components."""
    left, right = np.ones(len(a), bool), np.ones(len(b), bool)
    todo = np.flatnonzero(near.any(axis=1))
    for i in todo:
        if not left[i]:
            continue
        left[i] = False
        front = [(0, i)]
        while front:
            side, k = front.pop()
            links = np.flatnonzero(near[k] & right) if side == 0 else np.flatnonzero(near[:, k] & left)
            (right if side == 0 else left)[links] = False
            for j in links:
                u.append(int(a[k] if side == 0 else a[j]))
                v.append(int(b[j] if side == 0 else b[k]))
            front += [(1 - side, j) for j in links]
    return u, v


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints fp, enough of them to have all components.

    Short posting lists are joined with themselves and give every link. A long
    list is dealt out in blocks; each pair of blocks is compared by one task and
    gives a spanning forest of its links, so that a group of n near copies gives
    no n * n rows and no task holds more than two blocks.
    """
    spark = distinct.sparkSession
    posted = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in MASKS])).alias("k", "bytes"))
    sizes = posted.groupBy("k", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    posted = staged(posted.join(sizes, ["k", "bytes"]), "postings")
    short = posted.where(F.col("n") <= BLOCK).select("k", "bytes", "fp")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= RADIUS) & (tallied(x) >= 8 - RADIUS) & (first_triple(x) == F.col("a.k"))
    paired = short.alias("a").join(short.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.bytes") == F.col("b.bytes")) & near)
    few = paired.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    long = posted.where(F.col("n") > BLOCK)
    half = F.greatest(F.lit(1), F.ceil(F.col("n") / (BLOCK / 2)).cast("int"))
    blocks = long.withColumn("blocks", half).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Every unordered pair of blocks, a block with itself included; a fingerprint goes to all pairs that hold its block.
    sent = blocks.select("k", "bytes", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("k", "bytes", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("is_left"), (F.col("block") >= F.col("other")).alias("is_right"), "fp")
    grid = sent.groupBy("k", "bytes", "i", "j").agg(F.collect_list(F.when(F.col("is_left"), F.col("fp"))).alias("l"), F.collect_list(F.when(F.col("is_right"), F.col("fp"))).alias("r"))
    many = grid.select("l", "r").mapInArrow(block_edges, "u long, v long")
    return few.union(many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Rows with equal or linked fingerprints share component_id, the smallest id
    among all rows reachable. Rows without words link with each other at
    fingerprint zero. Rows with a null id stay in the result and may link others;
    component_id is null where no row reachable has an id. Other columns of docs
    are ignored, whatever their names. An empty table gives an empty table.
    """
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp")))
    grouped = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = grouped.where(F.col("least").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root", "left").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id.

    Rows that repeat this id all stay, as ids are taken to name documents. Rows
    with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    return docs.join(found, docs[id_col] == found["gone"], "left_anti")
