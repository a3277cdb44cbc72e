import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tecflow.llm import common, lines, queries


def plain(rows, similar=0.8):
    """Brute force over all pairs of lines. rows: (id, text) in order of place."""
    sets, where = [], []
    for d, (_, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            words = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                sets.append(words)
                where.append((d, k))
    gone = set()
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= similar * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                gone.add(where[b])
                break
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone), sum(1 for g in gone if g[0] == d)) for d, (i, t) in enumerate(rows)]


def corpus(n=80, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "ß!"]
    pool = [list(rng.choice(words, int(k))) for k in rng.integers(3, 140, 60)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(int(rng.integers(0, 8))):
            line = list(pool[int(rng.integers(0, len(pool)))]) if rng.random() < 0.6 else list(rng.choice(words, int(rng.integers(1, 60))))
            for _ in range(int(rng.integers(0, 5))):
                line[int(rng.integers(0, len(line)))] = str(rng.choice(words))
            text.append((" " if rng.random() < 0.9 else "\t ").join(line) + (" " if rng.random() < 0.1 else ""))
        rows.append((i, "\n".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "\n\n \n"), (903, "same five words in here\nsame five words in here")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, key string, n_lines int")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicated(docs).collect())
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 50


def test_large_group_of_similar_lines(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(30)]
    rows = []
    for i in range(150):
        line = list(base)
        for _ in range(int(rng.integers(0, 4))):
            line[int(rng.integers(0, 30))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(line)))
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (None, line + " seven"), (2, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in lines.deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, line), (1, line), (None, ""), (None, ""), (2, "short")], key=str)
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_texts_are_joined_by_a_shuffle_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = corpus(30, 3)
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)


def test_short_lines_take_part(spark):
    rows = [*corpus(40, 6), (900, "Les.\nAnd ornd.\nunique here\n\n"), (901, "Les.\n \nornd. And\na a a a\na"), (902, "one two three four\n" + "four three two one " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert sorted((r.doc_id, r.n_removed) for r in lines.digest(docs).collect()) == [(i, n) for i, _, n in want]
    assert sorted((r.doc_id, r.text) for r in lines.deduplicated(docs).collect()) == [(i, t) for i, t, _ in want]
    assert dict((i, n) for i, _, n in want)[901] == 3


def test_crowded_and_hot_words(spark, monkeypatch):
    """Every path of the join gives the same lines: all words crowded and hot, or none."""
    rng = np.random.default_rng(8)
    few = [f"v{i}" for i in range(14)]
    rows = [(i, "\n".join(" ".join(rng.choice(few, int(rng.integers(3, 12)), replace=False)) for _ in range(4))) for i in range(60)] + [(100 + i, t) for i, t in corpus(30, 9)]
    want = plain(rows)
    for crowd, sampled, hot in ((1, 1, 1 << 30), (1 << 30, 8, 1 << 30), (2, 1, 1 << 14)):
        monkeypatch.setattr(lines, "CROWD", crowd)
        monkeypatch.setattr(lines, "SAMPLED", sampled)
        monkeypatch.setattr(lines, "HOT", hot)
        monkeypatch.setattr(lines, "count_class", (lambda n: F.lit(0).cast("smallint")) if hot > 1 << 20 else lines.count_class)
        assert sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_odd_texts_and_ids(spark):
    """Very many lines, other blanks and separators, text ids and ids of several texts."""
    long = "\n".join(f"line {i % 700} of some" for i in range(20_000))
    rows = [("a", long), ("a", "tab\there  now"), ("b", "here\x0b tab now\r"), ("c", long + "\nnew words only here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.n_lines): r.n_removed for r in lines.deduplicated(docs).collect()}
    assert got == {("a", 20_000): 19_300, ("a", 1): 0, ("b", 1): 1, ("c", 20_001): 20_000}


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = sorted(con.execute(lines.SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text_md5) for r in queries.op2_line_dedup(spark, folder).collect())
    assert got == want and sum(r[2] for r in want) > 100


def test_crowded_words_are_listed_once(spark, monkeypatch):
    """Both joins by crowded words read one staged table; the passes list the other words."""
    calls, listed = [], lines.postings

    def counted(*args):
        calls.append(args)
        return listed(*args)

    monkeypatch.setattr(lines, "postings", counted)
    monkeypatch.setattr(lines, "CROWD", 1)
    monkeypatch.setattr(lines, "SAMPLED", 1)
    rows = corpus(20, 5)
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)
    assert len(calls) == 1 + lines.PASSES


def test_words_are_cut_once_and_sorted_without_nulls(spark, monkeypatch):
    """Counts, order and verification read the hashes of one staged table; the array that is sorted can hold no null."""
    calls, cut, classed, prefixes = [], lines.split, lines.classes, []

    def counted(line):
        calls.append(line)
        return cut(line)

    def seen(*args):
        prefixes.append(classed(*args))
        return prefixes[-1]

    monkeypatch.setattr(lines, "split", counted)
    monkeypatch.setattr(lines, "classes", seen)
    rows = [*corpus(20, 5), (900, "  two  blanks here \n\u00e9\n\x01\n \t \n\ttab first")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)
    assert len(calls) == 1
    assert not prefixes[0].schema["prefix"].dataType.containsNull
