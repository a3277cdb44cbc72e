import re

import numpy as np
import xxhash

from tecflow.llm import simhash
from tecflow.llm.common import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def corpus():
    rng = np.random.default_rng(3)
    words = [f"W{i}é" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 120)))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(60)] + [(2000 + i, rows[5][1]) for i in range(20)]
    return rows + [(3000, None), (3001, ""), (3002, " \n\t"), (3003, " "), (3004, "x " * 200_000)]


def test_components_and_fingerprints_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = list(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == components(ids, near)


def test_long_posting_lists_keep_all_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 700:
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    found = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"))
    pairs = [(r.u, r.v) for r in found.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs)
    linked = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    want = components(fps, linked)
    got = components(fps, [(a % 2**64, b % 2**64) for a, b in pairs])
    same = lambda c: {frozenset(n for n in fps if c[n] == r) for r in set(c.values())}
    assert same(got) == same(want)


def test_components_of_chains_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (None, 5), (100, 99)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "lonely one here now")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}
    assert simhash.deduplicated(docs).count() == 3
