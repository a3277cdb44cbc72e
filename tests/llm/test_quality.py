import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tecflow.llm import quality, textnum as tn

TEXTS = [
    None,
    "",
    " \n\t\n",
    "a\na\nb \na\n\n \n\n",
    "one two three four five six seven eight nine " * 3,
    "x\x1cy nbsp word <tag> & 50% #hash *** $5 | pipe",
    "é ß 日本 😀\r\nline\r\nline\r\nlast",
    "the same line\nthe same line\nother",
    "w " * 40,
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_base_counts_equal_brute_force(limit):
    rng = np.random.default_rng(2)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "cé"], 30)) + "\n" for _ in range(50)]
    got = []
    for t in tn.pieces(pa.array(texts), limit):
        c = quality.base_counts(t, tn.words(t))
        got += list(zip(*(c[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [plain(t)[:5] for t in texts]


def test_distance_is_zero_for_equal_and_one_for_disjoint():
    counts, refs = np.array([[2, 2, 0], [0, 0, 5], [0, 0, 0]]), np.array([[0.5, 0.5, 0.0]])
    assert quality.js_distance(counts, refs)[:, 0].round(9).tolist() == [0, 1, 1]


def test_odd_documents_are_dropped_and_clean_ones_kept(spark):
    rng = np.random.default_rng(4)
    words = ["the", "of", "and", "house", "river", "stone", "walks", "slowly", "green", "under"]
    share = np.array([30, 20, 15, 5, 5, 5, 5, 5, 5, 5]) / 100
    clean = [(i, " ".join(rng.choice(words, 150, p=share)), "en", True) for i in range(60)]
    odd = [(100 + i, " ".join("|#%" + w[::-1] + "zq9" for w in rng.choice(words, 150)), "en", False) for i in range(2)]
    rows = clean + odd + [(200, None, None, False), (201, "short", "en", False), (None, clean[0][1], None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    got = quality.quality_rules(docs).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(r[0], r[3]) for r in rows}
    assert all(not r.kept for r in got if r.base_failed)


def test_no_languages_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b " * 100, None)], "doc_id long, text string, lang string")
    assert quality.quality_rules(docs).first().char_distance is None
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_words_spread_thinly_over_partitions_are_counted_whole(spark):
    """In each of 8 partitions 3,000 words stand twice and 100 words, the same in all, once."""
    rows = [(p, " ".join([f"p{p}w{k}" for k in range(3000)] * 2 + [f"all{k}" for k in range(100)]), "en") for p in range(8)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string, lang string")
    want = tn.words(next(tn.pieces(pa.array([" ".join(f"all{k}" for k in range(100))])))).hash
    assert quality.references(docs).words.tolist() == sorted(want.tolist())


def plain_class(c):
    if ord(c) >= 128:
        return ("lead", c.encode()[0])
    for kind, some in (("digit", "0123456789"), ("blank", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"), ("stop", ".,;:'\"!?-()")):
        if c in some:
            return kind
    return c.lower() if c.isalpha() else "sign" if 32 <= ord(c) < 127 else "control"


def plain_distance(a, b):
    p, q = ({k: n / sum(x.values()) for k, n in x.items()} for x in (a, b))
    keys = p.keys() | q.keys()
    mid = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    part = lambda x: sum(v * math.log2(v / mid[k]) for k, v in x.items() if v)
    return math.sqrt(min(1, max(0, (part(p) + part(q)) / 2)))


def test_verdicts_equal_brute_force_in_any_partitioning(spark):
    """All documents of a table, distances and verdict, from plain counters; the same in 1 and in 40 partitions."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r.doc_id, r.text, r.lang) for r in source.collect()] + [(9001, "¡" * 300 + " ¿qué? " * 60, None), (9002, "zz yy xx " * 60, "en")]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda w: int(tn.words(next(tn.pieces(pa.array([w])))).hash.view(np.int64)[0])
    chars, common = {}, {}
    for _, t, lang in rows:
        if lang:
            chars.setdefault(lang, Counter()).update(map(plain_class, t or ""))
            common.setdefault(lang, Counter()).update(words(t))
    known = set()
    for n in common.values():
        least = sorted(n.values(), reverse=True)[: quality.COMMON][-1]
        known |= set(sorted((w for w, k in n.items() if k >= least), key=lambda w: (-n[w], key(w)))[: quality.COMMON])
    kept = lambda n: Counter({w if w in known else None: 0 for w in n}) + Counter({}) if not n else sum((Counter({w if w in known else None: k}) for w, k in n.items()), Counter())
    references = {lang: (chars[lang], kept(common[lang])) for lang in sorted(chars)}
    want = {}
    for i, t, _ in rows:
        c, n = Counter(map(plain_class, t or "")), Counter(words(t))
        by = {lang: (plain_distance(c, a) if c else 1, plain_distance(kept(n), b) if n else 1) for lang, (a, b) in references.items()}
        enough = (c.total() >= quality.MIN_CHARS, n.total() >= quality.MIN_WORDS)
        excess = {lang: max(d / far if e else 0 for d, far, e in zip(ds, (quality.FAR_CHARS, quality.FAR_WORDS), enough)) for lang, ds in by.items()}
        best = min(excess, key=excess.get)
        want[i] = (by[best][0] if enough[0] else None, by[best][1] if enough[1] else None, not plain(t)[5] and excess[best] <= 1)
    for parts in (1, 40):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
        assert len(got) == len(rows)
        for i, (a, b, ok) in want.items():
            r = got[i]
            assert r.kept == ok and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in ((r.char_distance, a), (r.word_distance, b))), (i, r, want[i])
    assert {ok for *_, ok in want.values()} == {True, False}
