"""LM scoring by cross-entropy difference of two matched bigram models.

Target and background models know every word of all documents, whatever its
count, and have one smoothing. A token costs -ln p(word | word before); a
document's score is the mean over its tokens of target cost less background
cost, so lower means nearer to the target. What a document adds to a model is
taken off before that model judges it, so that neither knows it by heart: its
own bigrams, contexts, words and length.

Every document's distinct bigrams are dealt out by their second word, so that the
counts of bigrams and words add up in one group of rows; those that need it then
meet the count of their first word, and costs go back to their documents. Rows
travel as columns of many rows of one group, which NumPy takes a group at a time.
Words and bigrams that make up a part of all tokens of one in SHARE or more are
few, whatever the size of the corpus: every task has their counts. Such bigrams
are scored where they are read, and others of such words are dealt out by bigram,
so that no group holds all rows of a frequent word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnum as tn
from .common import bounded, drop_staged, lean, staged

#: Parts, by the second word, in which bigrams are counted: the shuffles of one part are on disk at a time.
PASSES = 5
#: Stands before a text's first word.
START = np.uint64(0x5851F42D4C957F2D)
#: Weight of the bigram estimate, and what is added to every word count.
BIGRAM, ADDED = 0.6, 0.5
#: Counted keys a worker holds before it hands them on, and rows in a batch that it hands on.
HELD, ROWS = 1 << 19, 1 << 16
#: A bigram that occurs once in SHARE tokens, and FEW times at least, is frequent, a word if it does so one time in NEAR as often: at most SHARE bigrams, and NEAR * SHARE words.
SHARE, FEW, NEAR = 1 << 16, 1_000, 8
#: Groups at least, tokens a group of one part has otherwise, and entries in a batch that is handed on.
GROUPS, GROUP_TOKENS, ENTRIES = 512, 200_000, 256


class Tally:
    """Sums of values by key, handed on in batches of bounded size."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.parts, self.held = names, kinds, [], 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((keys, *values))
        self.held += len(keys)

    def summed(self) -> tuple[np.ndarray, ...]:
        keys, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([p[i] for p in self.parts]), len(keys)).astype(np.int64) for i in range(1, len(self.names))]
        self.parts, self.held = [(keys, *sums)], len(keys)
        return keys, *sums

    def full(self) -> bool:
        if self.held > 2 * HELD:
            self.summed()
        return self.held > HELD

    def batches(self) -> Iterator[pa.RecordBatch]:
        arrays = self.summed() if self.parts else tuple(np.zeros(0, np.int64) for _ in self.names)
        self.parts, self.held = [], 0
        whole = pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, k) for a, k in zip(arrays, self.kinds, strict=True)], self.names)
        for at in range(0, max(1, whole.num_rows), ROWS):
            yield whole.slice(at, ROWS)


def befores(found: tn.Words) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the word before every token, START for a text's first, and whether a token is its text's last."""
    before, last = np.empty_like(found.hash), np.zeros(len(found.hash), bool)
    before[1:] = found.hash[:-1]
    full = found.first[1:] > found.first[:-1]
    before[found.first[:-1][full]] = START
    last[found.first[1:][full] - 1] = True
    return before, last


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, wn, wt, cn, ct): count of every lower-cased word in texts (text, target), its count in the target's, and how often another word follows it in both; START is followed by each text's first word."""
    names = ["word", "wn", "wt", "cn", "ct"]

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(names, [pa.int64()] * 5)
        for batch in found:
            flags = batch.column(1).to_numpy()
            for piece in tn.pieces(batch.column(0)):
                w = tn.words(piece, lower=True)
                inside, (_, last) = flags[piece.first : piece.first + len(piece)], befores(w)
                seen, back = np.unique(w.hash, return_inverse=True)
                of = inside[w.row]
                counted = [np.bincount(back, x, len(seen)).astype(np.int64) for x in (np.ones(len(of)), of, ~last, of * ~last)]
                tally.add(seen, *counted)
                full = w.per_row() > 0
                tally.add(np.array([START]), *(np.array([x]) for x in (0, 0, full.sum(), inside[full].sum())))
                if tally.full():
                    yield from tally.batches()
        yield from tally.batches()

    summed = texts.mapInArrow(batches, ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names[1:]])
    return summed.where("wn > 0 or cn > 0")


def frequent_pairs(texts: DataFrame, heads: np.ndarray, words: np.ndarray, least: int) -> DataFrame:
    """(before, word, pn, pt): the bigrams of frequent words that occur least times or more; both lists have at most SHARE entries."""
    first, second = (np.sort(x.view(np.uint64)) for x in (heads, words))

    def held(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.searchsorted(known, keys).clip(max=len(known) - 1)] == keys

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            flags = batch.column(1).to_numpy()
            for piece in tn.pieces(batch.column(0)):
                w = tn.words(piece, lower=True)
                before, _ = befores(w)
                both = np.flatnonzero(held(before, first) & held(w.hash, second))
                keys, at, back = np.unique(tn.mixed(before[both]) + w.hash[both], return_index=True, return_inverse=True)
                inside = flags[piece.first : piece.first + len(piece)][w.row[both]]
                n, t = (np.bincount(back, x, len(keys)).astype(np.int64) for x in (np.ones(len(both)), inside))
                yield pa.RecordBatch.from_arrays([signed(before[both][at]), signed(w.hash[both][at]), pa.array(n), pa.array(t)], ["before", "word", "n", "t"])

    counted = texts.mapInArrow(batches, "before long, word long, n long, t long").groupBy("before", "word")
    return counted.agg(F.sum("n").alias("pn"), F.sum("t").alias("pt")).where(F.col("pn") >= least)


@dataclass
class Facts:
    """What every task knows: words, first words and bigrams that are frequent, in order, each with its counts in both models; tokens of both models plus what is added; number of groups."""

    words: tuple[np.ndarray, np.ndarray, np.ndarray]
    heads: tuple[np.ndarray, np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]
    whole: list[float]
    groups: int


def looked_up(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether known, in order, has each key, and both counts of it: 0 for others."""
    if not len(known[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(len(keys))
    at = np.searchsorted(known[0], keys).clip(max=len(known[0]) - 1)
    there = known[0][at] == keys
    return there, known[1][at] * there, known[2][at] * there


def in_order(keys: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], n[order].astype(float), t[order].astype(float)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tn.mixed(before) + word


#: Kinds of rows that are dealt out, and their columns. ASKED: a row's bigram, how often it occurs there, how often a word follows the first one, how often the second one occurs, the row's tokens, its target flag.
#: COLD: one whose others' counts (n, t) and shares of the second word (p0, p1) are known, but not its first word's count. COUNTS: a word and how often another follows it. DONE: costs of a row's text by key. SIZES: its tokens, and rows that have it.
ASKED, COLD, COUNTS, DONE, SIZES = range(5)
COLUMNS = {
    ASKED: {"key": "i8", "before": "u8", "word": "u8", "k": "u4", "kc": "u4", "kw": "u4", "size": "u4", "target": "u1"},
    COLD: {"key": "i8", "before": "u8", "k": "u4", "kc": "u4", "target": "u1", "n": "u4", "t": "u4", "p0": "f8", "p1": "f8"},
    COUNTS: {"before": "u8", "cn": "f8", "ct": "f8"},
    DONE: {"key": "i8", "a": "f8", "b": "f8"},
    SIZES: {"key": "i8", "a": "f8", "b": "f8"},
}
Rows = dict[str, np.ndarray]


class Dealt:
    """Rows held until they are handed on as (group, kind, data): one entry holds the columns of all rows of a kind and group, one after the other."""

    def __init__(self, groups: int):
        self.groups, self.parts, self.held = groups, {kind: [] for kind in COLUMNS}, 0

    def add(self, kind: int, by: np.ndarray, rows: Rows) -> None:
        """by: hashes that say in which group a row falls."""
        if len(by):
            self.parts[kind].append((by.view(np.uint64) % np.uint64(self.groups), rows))
            self.held += len(by)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for kind, columns in COLUMNS.items():
            if not (parts := self.parts[kind]):
                continue
            self.parts[kind] = []
            group = np.concatenate([p[0] for p in parts]).astype(np.uint16 if self.groups <= 1 << 16 else np.uint32)
            order = np.argsort(group, kind="stable")
            group = group[order]
            arrays = [np.concatenate([p[1][c] for p in parts]).astype(t, copy=False)[order] for c, t in columns.items()]
            cuts = np.flatnonzero(np.diff(group)) + 1
            ends = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True))
            for at in range(0, len(ends), ENTRIES):
                some = ends[at : at + ENTRIES]
                data = [b"".join(x[i:j].tobytes() for x in arrays) for i, j in some]
                yield pa.RecordBatch.from_arrays([pa.array(group[[i for i, _ in some]].astype(np.int32)), pa.array([kind] * len(some), pa.int32()), pa.array(data, pa.binary())], ["group", "kind", "data"])
        self.held = 0


DEALT = "group int, kind int, data binary"


def rows_of(kind: int, data: list[bytes]) -> Rows:
    columns, sizes = COLUMNS[kind], [np.dtype(t).itemsize for t in COLUMNS[kind].values()]
    found = {c: [] for c in columns}
    for entry in data:
        n, at = len(entry) // sum(sizes), 0
        for (c, t), size in zip(columns.items(), sizes, strict=True):
            found[c].append(np.frombuffer(entry, t, n, at))
            at += n * size
    return {c: np.concatenate(x) if x else np.zeros(0, columns[c]) for c, x in found.items()}


def group_runs(found: Iterator[pa.RecordBatch]) -> Iterator[dict[int, Rows]]:
    """Of a partition ordered by group, each group's rows by kind."""
    now, held = None, {}
    for batch in found:
        for group, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if group != now:
                if held:
                    yield {k: rows_of(k, held.get(k, [])) for k in COLUMNS}
                now, held = group, {}
            held.setdefault(kind, []).append(data)
    if held:
        yield {k: rows_of(k, held.get(k, [])) for k in COLUMNS}


def cost(pair: np.ndarray, context: np.ndarray, share: np.ndarray) -> np.ndarray:
    return -np.log(BIGRAM * pair / np.maximum(context, 1) + (1 - BIGRAM) * share)


def shares(rows: Rows, wn: np.ndarray, wt: np.ndarray, whole: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the second words, with counts wn and wt, among all other rows' tokens."""
    inside = rows["target"].astype(float)
    return (wn - rows["kw"] + ADDED) / (whole[0] - rows["size"]), (wt - rows["kw"] * inside + ADDED) / (whole[1] - rows["size"] * inside)


def costed(rows: Rows, cn: np.ndarray, ct: np.ndarray) -> Rows:
    """Costs of rows with n, t, p0, p1, whose first words have counts cn and ct."""
    k = rows["k"].astype(float)
    c0, c1 = cost(rows["n"], cn - rows["kc"], rows["p0"]), cost(rows["t"], ct - rows["kc"] * rows["target"].astype(float), rows["p1"])
    return {"key": rows["key"], "a": k * c0, "b": k * c1}


def summed(rows: Rows) -> Rows:
    keys, back = np.unique(rows["key"], return_inverse=True)
    return {"key": keys, **{c: np.bincount(back, rows[c], len(keys)) for c in "ab"}}


def asked(texts: DataFrame, facts: Facts, part: int) -> DataFrame:
    """ASKED rows of every row's distinct bigrams with a second word of one part; frequent bigrams are DONE here. With part 0, SIZES too."""

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealt(facts.groups)
        for batch in found:
            keys, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for piece in tn.pieces(batch.column(2)):
                w = tn.words(piece, lower=True)
                here = slice(piece.first, piece.first + len(piece))
                key, flag, size = keys[here], flags[here], w.per_row()
                if part == 0:
                    full = size > 0
                    out.add(SIZES, key[full], {"key": key[full], "a": size[full], "b": np.ones(full.sum())})
                before, last = befores(w)
                salted = tn.mixed(w.row.astype(np.uint64) + np.uint64(1))
                _, back, n = np.unique(tn.mixed(w.hash + salted), return_inverse=True, return_counts=True)
                follow = np.bincount(back, ~last, len(n)).astype(np.int64)
                kw, kc = n[back], np.ones(len(w.hash), np.int64)
                kc[1:] = np.where(before[1:] == START, 1, follow[back[:-1]])
                mine = np.flatnonzero(w.hash % np.uint64(PASSES) == part)
                pair = pair_hash(before[mine], w.hash[mine])
                _, at, k = np.unique(tn.mixed(pair + salted[mine]), return_index=True, return_counts=True)
                mine, pair = mine[at], pair[at]
                of = w.row[mine]
                rows = {"key": key[of], "before": before[mine], "word": w.hash[mine], "k": k, "kc": kc[mine], "kw": kw[mine], "size": size[of], "target": flag[of]}
                there, pn, pt = looked_up(pair, facts.pairs)
                known, wn, wt = looked_up(rows["word"], facts.words)
                some = {c: x[there] for c, x in rows.items()}
                p0, p1 = shares(some, wn[there], wt[there], facts.whole)
                _, cn, ct = looked_up(some["before"], facts.heads)
                some |= {"n": pn[there] - some["k"], "t": pt[there] - some["k"] * some["target"], "p0": p0, "p1": p1}
                done = summed(costed(some, cn, ct))
                out.add(DONE, done["key"], done)
                # By word, so that its counts add up; where they are known, by bigram.
                by = np.where(known, pair, tn.mixed(rows["word"]))
                out.add(ASKED, by[~there], {c: x[~there] for c, x in rows.items()})
                if out.held > HELD:
                    yield from out.batches()
        yield from out.batches()

    return texts.mapInArrow(batches, DEALT)


def counts_dealt(words: DataFrame, facts: Facts) -> DataFrame:
    """COUNTS of words (word, cn, ct)."""

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealt(facts.groups)
        for batch in found:
            before, cn, ct = (batch.column(i).to_numpy() for i in range(3))
            out.add(COUNTS, tn.mixed(before.view(np.uint64)), {"before": before.view(np.uint64), "cn": cn, "ct": ct})
            if out.held > HELD:
                yield from out.batches()
        yield from out.batches()

    return words.mapInArrow(batches, DEALT)


def judged(rows: Rows, facts: Facts) -> tuple[Rows, Rows]:
    """Of ASKED rows, which have all rows of their bigrams and of words that aren't frequent: DONE ones, and COLD ones that need the count of their first word."""
    _, at, back = np.unique(pair_hash(rows["before"], rows["word"]), return_index=True, return_inverse=True)
    inside = rows["k"] * rows["target"].astype(float)
    n, t = np.bincount(back, rows["k"]), np.bincount(back, inside)
    words, of = np.unique(rows["word"][at], return_inverse=True)
    known, wn, wt = looked_up(words, facts.words)
    wn, wt = np.where(known, wn, np.bincount(of, n)), np.where(known, wt, np.bincount(of, t))
    there, cn, ct = looked_up(rows["before"][at], facts.heads)
    p0, p1 = shares(rows, wn[of][back], wt[of][back], facts.whole)
    rows = rows | {"n": n[back] - rows["k"], "t": t[back] - inside, "p0": p0, "p1": p1}
    # The others' bigram is no other row's, or the count of its first word is known: without one it doesn't matter.
    cold = (rows["n"] > 0) & ~there[back]
    warm = ~cold
    return costed({c: x[warm] for c, x in rows.items()}, cn[back][warm], ct[back][warm]), {c: rows[c][cold] for c in COLUMNS[COLD]}


def settled(dealt: DataFrame, facts: Facts) -> DataFrame:
    """One step, by group: ASKED rows become DONE or COLD, COLD ones meet COUNTS and become DONE, what was DONE is summed by key."""

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealt(facts.groups)
        for rows in group_runs(found):
            if len(rows[ASKED]["key"]):
                done, cold = judged(rows[ASKED], facts)
                out.add(DONE, done["key"], done)
                out.add(COLD, tn.mixed(cold["before"]), cold)
            if len(rows[COLD]["key"]):
                _, cn, ct = looked_up(rows[COLD]["before"], in_order(*rows[COUNTS].values()))
                done = costed(rows[COLD], cn, ct)
                out.add(DONE, done["key"], done)
            for kind in (DONE, SIZES):
                whole = summed(rows[kind])
                out.add(kind, whole["key"], whole)
            if out.held > HELD:
                yield from out.batches()
        yield from out.batches()

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(batches, DEALT)


def totalled(dealt: DataFrame) -> DataFrame:
    """(key, c0, c1, n, rows) of DONE and SIZES: costs of a text's rows, their tokens, and how many there are."""
    names = ["key", "c0", "c1", "n", "rows"]

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in group_runs(found):
            both = [rows[k]["key"] for k in (DONE, SIZES)]
            keys, back = np.unique(np.concatenate(both), return_inverse=True)
            sums = [np.bincount(x, rows[k][c], len(keys)) for k, x in zip((DONE, SIZES), np.split(back, [len(both[0])]), strict=True) for c in "ab"]
            whole = pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x.astype(float)) for x in sums[:2]), *(pa.array(x.astype(np.int64)) for x in sums[2:])], names)
            for at in range(0, whole.num_rows, ROWS):
                yield whole.slice(at, ROWS)

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(batches, "key long, c0 double, c1 double, n long, rows long")


def costs(texts: DataFrame, rare: DataFrame, facts: Facts, part: int) -> DataFrame:
    """(key, c0, c1, n, rows): sums over one part of the bigrams of texts (key, target, text). rare: (word, cn, ct) of first words that aren't frequent.

    Only bigrams that another row has, after a word that isn't frequent, are
    shuffled again, to meet the count of that word.
    """
    return totalled(settled(settled(asked(texts, facts, part), facts).unionByName(counts_dealt(rare, facts)), facts))


def collected(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_cost, background_cost, score) of every row of docs; both models are fitted on docs.

    Costs are means over a row's tokens, null for texts without words. Without
    other target documents the target model is uniform. Ids in target_ids that are
    null or not in docs change nothing; repeated ones count once. Rows that repeat
    count as often as they stand there; each is judged without itself alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    wanted = target_ids.toDF("wanted").where("wanted is not null").distinct().withColumn("target", F.lit(1))
    flagged = rows.join(bounded(wanted, 24), rows[id_col] == wanted["wanted"], "left").withColumn("target", F.coalesce("target", F.lit(0)))
    flagged = flagged.withColumn("key", F.xxhash64("target", "_text"))
    texts = flagged.select("_text", "target")
    words = staged(word_counts(texts), "words")
    known, *totals = words.agg(F.count_if(F.col("wn") > 0), F.coalesce(F.sum("wn"), F.lit(0)), F.coalesce(F.sum("wt"), F.lit(0))).first()
    least = totals[0] // SHARE + FEW
    word, wn, wt = collected(words.where(F.col("wn") >= least // NEAR).select("word", "wn", "wt"))
    head, cn, ct = collected(words.where(F.col("cn") >= least // NEAR).select("word", "cn", "ct"))
    firsts, seconds = head[cn >= least], word[wn >= least]
    before, second, pn, pt = collected(frequent_pairs(texts, firsts, seconds, least)) if len(firsts) and len(seconds) else [np.zeros(0, np.int64)] * 4
    unsigned = lambda x: x.view(np.uint64)
    whole = [float(t) + ADDED * (known + 1) for t in totals]  # one more word than known has a share
    pairs = in_order(pair_hash(unsigned(before), unsigned(second)), pn, pt)
    facts = Facts(in_order(unsigned(word), wn, wt), in_order(unsigned(head), cn, ct), pairs, whole, max(GROUPS, totals[0] // (PASSES * GROUP_TOKENS)))
    rare = words.where((F.col("cn") > 0) & (F.col("cn") < least // NEAR)).select("word", "cn", "ct")
    parts = [staged(costs(flagged.select("key", "target", "_text"), rare, facts, part), "sums") for part in range(PASSES)]
    drop_staged(words)
    # Rows of equal text and target are one group; their mean is that of each.
    mean = lambda c: (F.sum(c) / F.sum("n")).alias(c)
    scores = reduce(DataFrame.union, parts).groupBy("key").agg(F.expr("sum(n) div sum(rows)").alias("n_tokens"), mean("c0"), mean("c1"))
    out = flagged.select(id_col, "key").join(scores, "key", "left")
    return out.select(id_col, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.col("c1").alias("target_cost"), F.col("c0").alias("background_cost"), (F.col("c1") - F.col("c0")).alias("score"))
