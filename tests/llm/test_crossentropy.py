import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tecflow.llm import crossentropy as ce, textnum as tn


def corpus():
    rng = np.random.default_rng(1)
    a, b = [f"A{i}" for i in range(8)], [f"b{i}é" for i in range(10)]
    rows = [(i, " ".join(rng.choice(a if i % 3 == 0 else b, rng.integers(1, 60)))) for i in range(90)]
    return rows + [(200, None), (201, ""), (202, " \n"), (None, "A1 a2"), (0, rows[0][1])]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scores(rows, target):
    """Exact bigram models with all words known; each row is judged by what all other rows add to a model."""
    vocab = {w for _, t in rows for w in tokens(t)}

    def counted(words):
        return Counter(words), Counter(zip([None, *words], words)), Counter([None, *words[:-1]] if words else [])

    models = []
    for inside in (lambda i: True, lambda i: i in target):
        model = (Counter(), Counter(), Counter())
        for i, t in rows:
            if inside(i):
                for whole, own in zip(model, counted(tokens(t))):
                    whole.update(own)
        models.append((inside, model))
    out = []
    for i, t in rows:
        words, cost = tokens(t), [0, 0]
        for k, (inside, model) in enumerate(models):
            single, pair, context = (Counter(whole) for whole in model)
            if inside(i):
                for whole, own in zip((single, pair, context), counted(words)):
                    whole.subtract(own)
            for h, w in zip([None, *words], words):
                p1 = (single[w] + ce.ADDED) / (single.total() + ce.ADDED * (len(vocab) + 1))
                cost[k] -= math.log(ce.BIGRAM * pair[h, w] / max(1, context[h]) + (1 - ce.BIGRAM) * p1)
        out.append((i, len(words), *((cost[1] / len(words), cost[0] / len(words)) if words else (None, None))))
    return out


def test_scores_equal_exact_models(spark, monkeypatch):
    rows, target = corpus(), set(range(0, 90, 6))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    ids = spark.createDataFrame([(i,) for i in [*target, 0, None, 12345]], "doc_id long")
    near = lambda x: None if x is None else round(x, 9)
    want = sorted([(i, n, near(a), near(b)) for i, n, a, b in plain_scores(rows, target)], key=str)
    # Without frequent words, with some, and with all words and bigrams frequent.
    for few, share in ((1000, 1 << 16), (20, 100), (0, 1 << 30)):
        monkeypatch.setattr(ce, "FEW", few)
        monkeypatch.setattr(ce, "SHARE", share)
        got = ce.cross_entropy_difference(docs, ids).collect()
        assert sorted([(r.doc_id, r.n_tokens, near(r.target_cost), near(r.background_cost)) for r in got], key=str) == want
    by_id = {r.doc_id: r.score for r in got}
    assert np.mean([by_id[i] for i in range(0, 90, 3)]) < np.mean([by_id[i] for i in range(1, 90, 3)])


def test_first_and_last_tokens():
    piece = next(iter(tn.pieces(pa.array(["", "a b", None, "b"]))))
    w = tn.words(piece, lower=True)
    before, last = ce.befores(w)
    assert before.tolist() == [ce.START, w.hash[0], ce.START] and last.tolist() == [False, True, True]


def test_long_text_and_ties(spark):
    """A long text beside short ones, and rows that differ in their target flag alone."""
    long = " ".join(f"l{i % 977}" for i in range(50_000))
    rows = [(1, long), (2, "l1 l2 l3"), (3, "l1 l2 l3"), (4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ce.cross_entropy_difference(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    for i, n, a, b in plain_scores(rows, {2}):
        assert got[i].n_tokens == n and abs(got[i].target_cost - a) < 1e-9 and abs(got[i].background_cost - b) < 1e-9


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ids = spark.createDataFrame([], "doc_id long")
    assert ce.cross_entropy_difference(docs, ids).first().score is not None
    assert ce.cross_entropy_difference(docs.limit(0), ids).count() == 0


def test_rare_words_and_all_bigrams_count(spark):
    """More words than 32,768, most of them rare, leave every count exact."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60_000, 2_000))) for i in range(60)]
    target = set(range(0, 60, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ce.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    assert len({w for _, t in rows for w in t.split()}) > 1 << 15
    for i, _, a, b in plain_scores(rows, target):
        assert abs(got[i].target_cost - a) < 1e-9 and abs(got[i].background_cost - b) < 1e-9


def test_bigrams_travel_in_groups(spark, monkeypatch):
    """Bigrams are not shuffled and sorted row by row, and scores are exact whatever the groups are and however often rows are handed on."""
    plans, staged = [], ce.staged

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return staged(df, name)

    monkeypatch.setattr(ce, "staged", seen)
    for name, value in (("FEW", 160), ("HELD", 40), ("GROUPS", 3), ("PASSES", 2)):
        monkeypatch.setattr(ce, name, value)
    rows, target = corpus(), set(range(0, 90, 6))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ce.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    near = lambda x: None if x is None else round(x, 9)
    want = sorted([(i, n, near(a), near(b)) for i, n, a, b in plain_scores(rows, target)], key=str)
    assert sorted([(r.doc_id, r.n_tokens, near(r.target_cost), near(r.background_cost)) for r in got], key=str) == want
    sums = [plan for name, plan in plans if name == "sums"]
    assert len(sums) == 2 and not any("Window" in plan for plan in sums)
