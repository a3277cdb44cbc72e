import random

from tecflow.operators import joins as J


def test_spans_equal_windows(spark):
    rng = random.Random(4)
    anchors, targets = [], []
    for key in ("a", "b", "c", None):
        times = sorted(rng.sample(range(-500, 5000), 40)) if key != "c" else [77]
        anchors += [(key, float(t), None if rng.random() < 0.1 else rng.uniform(-5, 5)) for t in times]
        targets += [(key, i, float(rng.choice(times)) if rng.random() < 0.2 else rng.uniform(-800, 6000)) for i in range(200)]
    targets += [("d", 0, 5.0), ("a", 900, None)]
    a = spark.createDataFrame(anchors, "k string, t double, v double")
    t = spark.createDataFrame(targets, "k string, n int, t double").where("k is not null")
    rows = lambda df: sorted(((r.k, r.n, r.t, None if r.v is None else round(r.v, 9)) for r in df.collect()), key=str)
    want = rows(J.bracketed(t, a.where("k is not null"), ["k"], "t", "v"))
    assert sum(r[3] is not None for r in want) > 200
    for step in (7.0, 100.0, 10000.0):
        assert rows(J.bracketed(t, a, ["k"], "t", "v", step)) == want
