"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification.

A benchmark item of n words is compared with windows of n words of a document.
Item and window are bags of five-word shingles, each weighing as often as it
stands there. A fingerprint has BITS bits; a bit is the sign of the sum of plus
or minus one for every shingle, so sums over windows roll along a text. Two bags
of weighted Jaccard similarity SIMILAR share 8 of 9 shingles, and their
fingerprints differ in 15 % of the bits on average (19 of 128, deviation 4).

The index cuts fingerprints into BLOCKS blocks. Fingerprints at most RADIUS bits
apart are in some block at most as many bits apart as allowed() tells, as
otherwise they would differ in more than RADIUS bits in all. For each block and
each of its values the index lists the items so near to it: looking up a
window's blocks finds all items within RADIUS, besides few others. Every such
pair is then verified by its exact similarity.

Only windows of which enough shingles are in any item at all can be similar to
one, so only these are fingerprinted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from . import textnum as tn
from .common import lean, rows_where

SHINGLE, SIMILAR = 5, 0.8
#: Bits of a fingerprint, blocks they are looked up by, and bits in which a window and an item differ at most.
BITS, BLOCKS, RADIUS = 128, 8, 30
WIDTH = BITS // BLOCKS
#: Items indexed at a time; the documents are scanned once for each such part of the benchmark.
ITEMS = 4_000
#: Entries of the quick table that tells most shingles are in no item; shingles whose bits are summed and pairs that are compared at a time.
QUICK, HELD, PAIRS = 1 << 22, 1 << 14, 1 << 20

#: Words here are runs of ASCII letters, digits and non-ASCII characters, in lower case: punctuation doesn't hide a copy.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def shingles(texts: tn.Texts) -> tuple[tn.Words, np.ndarray, np.ndarray]:
    found = tn.words(texts, lower=True, apart=APART)
    return found, *tn.windows(found, SHINGLE)


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Shingles that bags of a and b shingles at least share if they are similar."""
    return np.ceil(SIMILAR / (1 + SIMILAR) * (a + b) - 1e-9).astype(np.int64)


def signs(h: np.ndarray) -> np.ndarray:
    """(shingles, BITS): plus or minus one by the bits of a shingle's hash."""
    words = np.stack([h if k == 0 else tn.mixed(h + np.uint64(k)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(runs, BITS // 64): fingerprints of the runs h[start:end], start in order: a bit is set if more shingles have it than not."""
    out, at = np.zeros((len(start), BITS // 64), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + HELD)))
        low, high = start[at], end[at:to].max()
        total = np.zeros((high - low + 1, BITS), np.int32)
        np.cumsum(signs(h[low:high]), axis=0, out=total[1:])
        for i in range(at, to, HELD):
            j = min(to, i + HELD)
            sums = total[end[i:j] - low] - total[start[i:j] - low]
            out[i:j] = np.packbits(sums > 0, axis=1).view(np.uint64)
        at = to
    return out


def block_values(prints: np.ndarray) -> np.ndarray:
    """(prints, BLOCKS): the values of each fingerprint's blocks."""
    return prints.view(np.uint16).astype(np.int64)


def allowed() -> list[int]:
    """Bits in which each block may differ: one more in every block would be more than RADIUS in all."""
    spare = RADIUS - BLOCKS + 1
    return [spare // BLOCKS + (b < spare % BLOCKS) for b in range(BLOCKS)]


def near_values(bits: int) -> np.ndarray:
    """What a block's value is combined with to give all values at most bits away."""
    return np.array([sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(WIDTH), n)], np.int64)


@dataclass
class Index:
    """Items with at least SHINGLE words; grows with the part of the benchmark alone.

    sizes: shingles of each item; keys: distinct shingles of all items, in order;
    prints: fingerprints; lists: for each block, items near to each value, built
    where they are first used: first[v] <= p < first[v + 1] are the places of value v.
    """

    ids: list
    sizes: np.ndarray
    bags: list[Counter]
    keys: np.ndarray
    quick: np.ndarray
    prints: np.ndarray
    lists: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def build(cls, ids: list, texts: list[str]) -> Index:
        kept, runs = [], []
        for piece in tn.pieces(pa.array(texts, pa.string())):
            found, at, h = shingles(piece)
            row = found.row[at]
            for r, n in enumerate(found.per_row()):
                if n >= SHINGLE:
                    kept.append(ids[piece.first + r])
                    runs.append(h[row == r])
        sizes = np.array([len(r) for r in runs], np.int64)
        h = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        end = np.cumsum(sizes)
        quick = np.zeros(QUICK, bool)
        quick[(h % np.uint64(QUICK)).astype(np.int64)] = True
        return cls(kept, sizes, [Counter(r.tolist()) for r in runs], np.unique(h), quick, fingerprints(h, end - sizes, end))

    def known(self, h: np.ndarray) -> np.ndarray:
        """Whether each shingle is in any item."""
        out = self.quick[(h % np.uint64(QUICK)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            out[maybe] = self.keys[np.searchsorted(self.keys, h[maybe]).clip(max=len(self.keys) - 1)] == h[maybe]
        return out

    def looked_up(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.lists:
            item = np.arange(len(self.prints))
            for value, bits in zip(block_values(self.prints).T, allowed(), strict=True):
                flips = near_values(bits)
                values = (value[:, None] ^ flips).ravel()
                order = np.argsort(values, kind="stable")
                first = np.searchsorted(values[order], np.arange((1 << WIDTH) + 1))
                self.lists.append((first, np.repeat(item, len(flips))[order].astype(np.int32)))
        return self.lists

    def met(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (print, item) that the blocks bring together: all within RADIUS, and few others."""
        pairs = []
        for (first, items), value in zip(self.looked_up(), block_values(prints).T, strict=True):
            n = first[value + 1] - first[value]
            place = np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.repeat(np.arange(len(prints)), n) * len(self.ids) + items[place])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids), both % len(self.ids)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (print, item) at most RADIUS bits apart."""
        window, item = self.met(prints)
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return window[near], item[near]


def windows(index: Index, found: tn.Words, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(first shingle, shingles, item's shingles) of the windows of item size with enough known shingles to be similar to an item; a shorter text is one window."""
    total = np.concatenate(([0], np.cumsum(index.known(h))))
    hits = np.flatnonzero(np.diff(total))
    if not len(hits):
        return np.zeros((0, 3), np.int64)
    row = found.row[at]
    head, tail = np.searchsorted(row, row[hits]), np.searchsorted(row, row[hits], "right")
    out = []
    for size in np.unique(index.sizes).tolist():
        # A similar window lacks few shingles, so its first known one comes early.
        early = size - int(needed(size, size))
        whole = tail - head < size
        places = (hits[~whole, None] - np.arange(early + 1)).ravel()
        first = np.repeat(head[~whole], early + 1)
        last = np.repeat(tail[~whole], early + 1) - size
        start = np.unique(places[(places >= first) & (places <= last)])
        start = start[total[start + size] - total[start] >= needed(size, size)]
        out.append(np.stack([start, np.full(len(start), size), np.full(len(start), size)], axis=1))
        short, one = np.unique(head[whole], return_index=True)
        n = tail[whole][one] - short
        able = total[short + n] - total[short] >= needed(n, size)
        out.append(np.stack([short[able], n[able], np.full(able.sum(), size)], axis=1))
    every = np.concatenate(out)
    return every[np.argsort(every[:, 0], kind="stable")]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return both / (a.total() + b.total() - both)


def matches(index: Index, texts: tn.Texts) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(row, item) to (similarity, first word in the text, words) of the best window, the first one of several."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(index.ids):
        return best
    found, at, h = shingles(texts)
    every = windows(index, found, at, h)
    prints = fingerprints(h, every[:, 0], every[:, 0] + every[:, 1])
    step = max(1, PAIRS // len(index.ids))
    for low in range(0, len(every), step):
        window, item = index.within(prints[low : low + step])
        window += low
        fits = index.sizes[item] == every[window, 2]
        for w, k in zip(window[fits].tolist(), item[fits].tolist(), strict=True):
            first, n, _ = every[w].tolist()
            s = similarity(Counter(h[first : first + n].tolist()), index.bags[k])
            row = int(found.row[at[first]])
            if s >= SIMILAR - 1e-9 and s > best.get((row, k), (0,))[0]:
                best[row, k] = (s, int(at[first] - found.first[row]), n + SHINGLE - 1)
    return best


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """The benchmark's parts of about ITEMS items, indexed and broadcast one after the other."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    parts = max(1, -(-items.count() // ITEMS))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index.build([r.item for r in rows], [r.text for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, similarity, first_word, n_words): the best window of every document for every item it holds.

    A row says that n_words words of the document from word first_word on are at
    least SIMILAR to the item. Null texts match nothing, and neither do items with
    fewer than SHINGLE words. Equal items all match; equal rows of docs all give
    their rows; ids may be null. Texts are searched whole.
    """
    item_type = benchmark.schema[item_col].dataType
    kinds = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, item_type), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    source, out = docs.select(id_col, F.col(text_col).cast("string")), None
    for shared in indexes(benchmark, item_col, item_text_col):

        @lean
        def batches(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in found:
                for texts in tn.pieces(batch.column(1)):
                    if best := matches(index, texts):
                        rows = pa.array([texts.first + r for r, _ in best])
                        columns = [pa.array(c) for c in zip(*best.values(), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([index.ids[i] for _, i in best]), *columns], kinds.names)

        found = source.mapInArrow(batches, kinds)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item; all other rows stay as they are, whatever their ids."""
    for shared in indexes(benchmark, item_col, item_text_col):

        def clean(column: pa.Array, shared=shared) -> np.ndarray:
            out = np.ones(len(column), bool)
            for texts in tn.pieces(column):
                out[[texts.first + r for r, _ in matches(shared.value, texts)]] = False
            return out

        docs = rows_where(docs, text_col, clean)
    return docs
