import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tecflow.llm import decontaminate as dc, textnum as tn


def grams(text):
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_matches(docs, items):
    """Best weighted Jaccard similarity over all windows of an item's size."""
    bags = {i: grams(t) for i, t in items if grams(t)}
    holders = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    out = {}
    for d, t in docs:
        run = grams(t)
        for i in {i for s in run for i in holders[s]}:
            n, want = len(bags[i]), Counter(bags[i])
            for j in range(max(1, len(run) - n + 1)):
                have = Counter(run[j : j + n])
                value = (have & want).total() / (have | want).total()
                if value >= 0.8 - 1e-9 and value > out.get((d, i), 0):
                    out[d, i] = value
    return out


def corpus():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    draw = lambda n: list(rng.choice(words, n))
    items = [(100 + i, " ".join(draw(int(n)))) for i, n in enumerate(rng.integers(6, 60, 40))]
    items += [(200, items[0][1]), (201, None), (202, "too short"), (203, " ".join(["echo"] * 12)), (204, items[3][1] + " " + " ".join(draw(30)))]
    docs = []
    for i in range(120):
        t = draw(int(rng.integers(0, 150)))
        if i % 3:
            own = items[int(rng.integers(0, 40))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(own)))
                own[k : k + int(rng.integers(0, 2))] = draw(int(rng.integers(0, 3)))
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = own
        docs.append((i, ("  " if i % 2 else ", ").join(t).upper() + "."))
    return docs + [(1000, None), (1001, ""), (1002, "Echo " * 50), (1003, items[5][1][:20])], items


def test_all_and_only_similar_items_are_found():
    docs, items = corpus()
    index = dc.Index.build([i for i, t in items if t], [t for _, t in items if t])
    want = plain_matches(docs, [x for x in items if x[1]])
    for limit in (300, 1 << 20):
        got = {}
        for p in tn.pieces(pa.array([t for _, t in docs]), limit):
            got |= {(docs[p.first + r][0], index.ids[i]): s for (r, i), (s, *_) in dc.matches(index, p).items()}
        assert got.keys() == want.keys() and len(got) > 40
        assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_blocks_find_every_fingerprint_within_the_radius_and_few_others():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, (300, 2), np.uint64)
    index = dc.Index(list(range(300)), np.ones(300, np.int64), [], np.zeros(0, np.uint64), np.zeros(1, bool), prints)
    whole = [int.from_bytes(p.tobytes(), "little") for p in prints]
    asked = []
    for p in whole[:60]:
        asked.append(p ^ sum(1 << int(b) for b in rng.choice(128, int(rng.integers(0, 35)), replace=False)))
    got = index.within(np.array([np.frombuffer(q.to_bytes(16, "little"), np.uint64) for q in asked]))
    want = {(k, i) for k, q in enumerate(asked) for i, x in enumerate(whole) if (x ^ q).bit_count() <= dc.RADIUS}
    assert set(zip(*(x.tolist() for x in got))) == want and len(want) > 40
    # Of fingerprints that have nothing to do with each other the blocks bring few together.
    other = rng.integers(0, 2**64, (400, 2), np.uint64)
    assert len(index.met(other)[0]) < 0.1 * len(other) * len(prints)


def test_recall_of_the_radius():
    """How many of the pairs at a similarity the radius keeps: the figures in the README."""
    rng = np.random.default_rng(3)
    for similar, least in ((0.80, 0.985), (0.85, 0.998), (0.90, 0.999)):
        both, found = 0, 0
        for n in (9, 18, 36, 90):
            shared = int(np.ceil(similar / (1 + similar) * 2 * n - 1e-9))
            for _ in range(500):
                core = rng.integers(0, 2**64, shared, np.uint64)
                a, b = (np.concatenate((core, rng.integers(0, 2**64, n - shared, np.uint64))) for _ in range(2))
                prints = dc.fingerprints(np.concatenate((a, b)), np.array([0, n]), np.array([n, 2 * n]))
                both += 1
                found += np.bitwise_count(prints[0] ^ prints[1]).sum() <= dc.RADIUS
        print(similar, found / both)
        assert found >= least * both


def test_rolling_sums_equal_plain_fingerprints(monkeypatch):
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**64, 400, np.uint64)
    start = np.sort(rng.integers(0, 380, 200))
    end = np.minimum(400, start + rng.integers(1, 60, 200))
    bits = dc.signs(h).astype(int)
    want = [np.packbits(bits[i:j].sum(axis=0) > 0).view(np.uint64).tolist() for i, j in zip(start, end)]
    for held in (1, 50, 1 << 14):
        monkeypatch.setattr(dc, "HELD", held)
        assert dc.fingerprints(h, start, end).tolist() == want


def test_an_item_that_stands_ten_times_and_very_long_texts():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 60)]
    items = [(i, " ".join(words)) for i in range(10)]
    index = dc.Index.build([i for i, _ in items], [t for _, t in items])
    copy = list(words)
    copy[55] = "changed"
    long = [f"x{k}" for k in rng.integers(0, 10**6, 300_000)]
    text = " ".join(long[:250_000] + copy + long[250_000:])
    got = dc.matches(index, next(iter(tn.pieces(pa.array([text, "", None])))))
    assert {i for _, i in got} == set(range(10)) and {w for _, w, _ in got.values()} <= set(range(249_994, 250_001))


def test_operator_on_tables(spark):
    docs, items = corpus()
    rows = [(*d, "x", 1) for d in docs] + [(None, items[4][1], None, None), (1, docs[1][1], "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id string, similarity int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(table, bench).collect()
    want = plain_matches(docs, [x for x in items if x[1]])
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want.keys()
    assert (None, items[4][0]) in {(r.doc_id, r.item_id) for r in got}
    clean = dc.decontaminated(table, bench)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    unnamed = spark.createDataFrame([(None, items[4][1]), (None, "clean")], "doc_id long, text string")
    assert [r.text for r in dc.decontaminated(unnamed, bench).collect()] == ["clean"]
    assert dc.contaminated(table, bench.limit(0)).count() == 0 and dc.contaminated(table.limit(0), bench).count() == 0


def templated():
    """Ten items that share a template, and copies with changed words in items and template alike."""
    rng = np.random.default_rng(7)
    draw = lambda n, of: [f"{of}{k}" for k in rng.integers(0, 10**6, n)]
    template = draw(80, "t")
    items = [(i, " ".join(template + draw(int(rng.integers(6, 20)), "own"))) for i in range(10)]
    docs = []
    for i in range(60):
        words = items[i % 10][1].split()
        words[-int(rng.integers(1, 6))] = "changed"
        docs.append((i, " ".join(draw(20, "x") + words + draw(20, "y"))))
    return docs, items


def test_items_that_share_a_template_lose_no_pair():
    docs, items = templated()
    index = dc.Index.build([i for i, _ in items], [t for _, t in items])
    want = plain_matches(docs, items)
    got = {(docs[p.first + r][0], index.ids[i]): s for p in tn.pieces(pa.array([t for _, t in docs])) for (r, i), (s, *_) in dc.matches(index, p).items()}
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_parts_of_the_benchmark_give_what_one_part_gives(spark, monkeypatch):
    docs, items = templated()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in dc.contaminated(table, bench).collect()}
    monkeypatch.setattr(dc, "ITEMS", 4)
    assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in dc.contaminated(table, bench).collect()} == want and len(want) > 10
