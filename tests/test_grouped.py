import numpy as np

from tecflow.operators import grouped as P, joins as J


def response(b, a, frequency, step=30.0):
    z = np.exp(-2j * np.pi * frequency * step)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


def test_bandpass_response():
    nyquist = 0.5 / 30
    b, a = P.bandpass(6, 0.001 / nyquist, 0.015 / nyquist)
    assert len(b) == len(a) == 13
    assert response(b, a, 0.0) < 1e-9 and response(b, a, nyquist) < 1e-9
    assert abs(response(b, a, 0.001) - 2**-0.5) < 1e-6 and abs(response(b, a, 0.015) - 2**-0.5) < 1e-6
    assert abs(response(b, a, 0.005) - 1) < 1e-3
    assert (abs(np.roots(a)) < 1).all()


def test_zero_phase_keeps_a_sine_in_the_band_and_drops_slow_drift():
    b, a = P.bandpass(6, 0.001 * 60, 0.015 * 60)
    t = np.arange(2000) * 30.0
    x = np.sin(2 * np.pi * 0.005 * t)
    (y,) = P.zero_phase(b, a, [P.without_trend(x + 1e-9 * t**2 + 5, 3)], [39])
    assert np.abs(y - x)[200:-200].max() < 0.02
    assert np.abs(P.without_trend(3 + 2 * t - 1e-6 * t**3, 3)).max() < 1e-3 * np.abs(1e-6 * t[-1] ** 3)


def test_filter_equals_the_difference_equation():
    b, a = P.bandpass(2, 0.1, 0.4)
    x = np.random.default_rng(1).normal(size=50)
    want = np.zeros(50)
    for n in range(50):
        want[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * want[n - k] for k in range(1, len(a)) if n >= k)
    assert np.allclose(P.filtered(b, a, np.stack((x, 2 * x)), np.zeros((2, len(a) - 1))), np.stack((want, 2 * want)), atol=1e-12)
    assert np.allclose(P.filtered(b, a, np.ones((1, 200)), P.steady_state(b, a)[None]), b.sum() / a.sum())


def test_many_series_filter_as_each_alone():
    b, a = P.bandpass(6, 0.06, 0.9)
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=n) for n in (60, 41, 300, 60, 38)]
    pads = [min(39, len(r) - 1) for r in rows]
    together = P.zero_phase(b, a, rows, pads)
    for r, p, y in zip(rows, pads, together):
        assert len(y) == len(r) and np.allclose(P.zero_phase(b, a, [r], [p])[0], y, atol=1e-12)


def test_arcs_split_at_slips():
    lane = np.r_[np.tile([0.0, 0.1], 20), np.tile([7.0, 7.1], 20)]
    assert P.split_arcs(lane, np.zeros(80), 10).tolist() == [0] * 40 + [1] * 40
    one_off = np.tile([0.0, 0.1], 30)
    one_off[30] = 50
    found = P.split_arcs(one_off, np.zeros(60), 5)
    assert found[30] == -1 and found[29] == 0 and found[31] == 1
    assert (P.split_arcs(np.tile([0.0, 0.1], 3), np.zeros(6), 10) == -1).all()


def test_many_short_series_are_split_together(spark):
    rng = np.random.default_rng(8)
    rows = [(k if k % 9 else None, i, float(rng.normal(0, 0.3) + 7 * (i > 6) * (k % 2)), float(rng.normal(0, 0.3)) if rng.random() > 0.02 else None) for k in range(300) for i in range(k % 14 + 1) if k % 9 or k == 9]
    df = spark.createDataFrame(rows, "k long, i long, lane double, geometry double").repartition(5)
    found = P.arcs_by_feedback(df, ["k"], ["i"], "lane", "geometry", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan  # a call for each series took most of the time
    got = {(r.k, r.i): r.arc for r in found.collect()}
    assert len(got) == len(rows) and found.schema["arc"].dataType.typeName() == "long"
    for k in {r[0] for r in rows}:
        x = np.array([r[2:] for r in rows if r[0] == k], float)
        assert [got[k, i] for i in range(len(x))] == P.split_arcs(x[:, 0], x[:, 1], 3).tolist()
    assert {-1, 0, 1} <= set(got.values())


def test_kalman_settles_and_bridges_gaps():
    x = np.full(200, 5.0)
    x[50:60] = np.nan
    level, spread = P.kalman_levels([x[:, None], x[:90, None]], 0.01, 1.0)[0].T
    assert np.allclose(level, 5) and spread[59] > spread[49]
    p = spread[-1]
    assert abs(p - (p + 0.01) / (p + 0.01 + 1)) < 1e-6


def test_spline_is_exact_for_cubics(spark):
    t = np.array([0, 1, 2.5, 4, 5, 7.0])
    f = lambda x: 1 + 2 * x - x**2 + 0.3 * x**3
    at = [-1, 0, 0.3, 3.3, 6.9, 7, 8, 0.3]
    anchors = spark.createDataFrame([("a", float(x), float(f(x))) for x in t] + [("a", 1.0, float(f(1.0))), ("b", 0.0, 1.0), ("b", 1.0, 2.0), ("a", None, 1.0)], "sat string, t double, y double")
    targets = spark.createDataFrame([("a", float(x), k) for k, x in enumerate(at)] + [("b", 0.5, 100), ("c", 0.5, 101)], "sat string, t double, id long")
    got = {r.id: r for r in P.splined(targets, anchors, ["sat"], "t", ["y"], 1.5).collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r.y is None} == {0, 6, 100, 101}
    for k in (1, 2, 3, 4, 5, 7):
        assert abs(got[k].y - f(at[k])) < 1e-9 and abs(got[k].y_rate - (2 - 2 * at[k] + 0.9 * at[k] ** 2)) < 1e-9


def test_series_are_whole_whatever_the_batches(spark, monkeypatch):
    rows = [(k, i, float((i * 7 + (k or 5)) % 11)) for k in (1, 2, 3, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(5)
    want = None
    for held in (1, 60, 1 << 16):
        monkeypatch.setattr(P, "HELD", held)
        got = sorted(((r.k, r.i, r.n, r.s) for r in P.by_series(df, ["k"], ["i"], ["v"], ["n", "s"], lambda series: [np.stack((np.full(len(x), len(x)), np.where(x[:, 0] > 3, np.cumsum(x[:, 0]), np.nan)), axis=1) for x in series]).collect()), key=str)
        assert len(got) == 200 and all(r[2] == 50 for r in got) and any(r[3] is None for r in got)
        want = want or got
        assert got == want


def test_equal_targets_each_get_their_value(spark):
    anchors = spark.createDataFrame([("G01", 900.0 * k, float(k * k)) for k in range(20) if k != 15], "sat string, s double, x double")
    targets = spark.createDataFrame([("G01", 5000.0, 1), ("G01", 5000.0, 1), ("G01", 9000.0, 2), ("G01", 100.0, 3), ("G02", 5000.0, 4)], "sat string, s double, id long")
    got = sorted(((r.id, r.x) for r in J.interpolated(targets, anchors, ["sat"], "s", 900.0, ["x"]).collect()), key=str)
    assert [i for i, _ in got] == [1, 1, 2, 3, 4] and [x for _, x in got[2:]] == [None] * 3
    assert all(abs(x - (5000 / 900) ** 2) < 1e-9 for _, x in got[:2])


def test_outliers_leave_the_fit():
    x = np.linspace(-1, 1, 60)
    y = 1 + x + x**2
    y[[5, 40]] += 50
    keep = P.trimmed_fit(x, y)
    assert not keep[5] and not keep[40] and keep.sum() == 58


def test_one_long_and_many_short_series_need_no_more_room():
    import tracemalloc

    rng = np.random.default_rng(5)
    series = [rng.normal(size=(n, 1)) for n in [1] * 8000 + [8000] + [3] * 50]
    program = lambda band: P.kalman_levels(band, 1.0, 4.0)
    tracemalloc.start()
    got = P.by_length(series, program)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    for k in (0, 7999, 8000, 8001, 8050):
        assert np.array_equal(got[k], program([series[k]])[0])
    assert P.by_length([], program) == []


def plain_restart(lane, free, elevation, w1, w2, back=30, drift=5 * 30 / 3600):
    """One arc, row after row, with means and deviations taken anew each time."""
    n, start, slips, n1, n2 = len(lane), 0, [False], [0], [0]
    noise = np.sqrt(2 * (0.0027**2 + 0.0017**2))
    for i in range(1, n):
        first = start if i - 30 < start else i - back
        mean = np.mean(lane[first:i])
        spread = np.std(lane[start : i + 1], ddof=1) if i - 2 < start else np.std(lane[first:i], ddof=1)
        off = max(abs(mean - lane[i]), 1) > 5 * spread
        leap = abs(free[i - 1] - free[i]) > 4 * max(noise * (1 + 10 * np.exp(-elevation[i] / 10)), 0.15) + drift
        rest = lane[start:]
        slip = bool((off and len(rest) > 1 and np.std(rest, ddof=1) > 0.6) or leap)
        a, b = lane[i - 1] - lane[i], free[i - 1] - free[i]
        one, two = np.rint(np.linalg.solve([[1, -1], [w1, -w2]], [a, b]))
        fix = slip and one != 0 and two != 0
        slips.append(slip)
        n1.append(n1[-1] + (one if fix else 0))
        n2.append(n2[-1] + (two if fix else 0))
        start = i if slip else start
    return slips, n1, n2


def test_slips_with_restart_equal_plain_loops(spark):
    rng, rows, want, w1, w2 = np.random.default_rng(9), [], {}, 0.19029, 0.24421
    for k, n in enumerate([1, 2, 3, 40, 40, 90, 200]):
        slip = rng.random(n) < 0.05
        c1, c2 = np.cumsum(slip * rng.integers(-6, 7, n)), np.cumsum(slip * rng.integers(-6, 7, n))
        l1, l2 = w1 * c1 + rng.normal(0, 0.002, n), w2 * c2 + rng.normal(0, 0.002, n)
        lane, el = c1 - c2 + rng.normal(0, 0.2, n), rng.uniform(5, 85, n)
        want[k] = (*plain_restart(lane, l1 - l2, el, w1, w2), l1, l2)
        rows += [(k, i, *map(float, (lane[i], l1[i] - l2[i], el[i], l1[i], l2[i]))) for i in range(n)]
    rows += [(50, 0, 1.0, None, 9.0, 1.0, 2.0), (50, 1, 99.0, 5.0, 9.0, 1.5, 2.5)]
    df = spark.createDataFrame(rows, "arc int, t int, lane double, free double, elevation double, l1 double, l2 double").repartition(5)
    found = 0
    for r in P.slips_with_restart(df, ["arc"], ["t"], "lane", "free", "elevation", ["l1", "l2"], (w1, w2)).collect():
        if r.arc == 50:
            assert not r.slip and (r.fixed1, r.fixed2) == (r.l1, r.l2)
            continue
        slips, n1, n2, l1, l2 = want[r.arc]
        found += r.slip
        assert r.slip == slips[r.t]
        assert abs(r.fixed1 - l1[r.t] - n1[r.t] * w1) < 1e-9 and abs(r.fixed2 - l2[r.t] - n2[r.t] * w2) < 1e-9
    assert found > 8


def test_slips_of_three_carriers_are_found_and_mended(spark):
    from tecflow.operators import series as S

    rng, f = np.random.default_rng(10), (1575.42e6, 1227.60e6, 1176.45e6)
    wave, rows, truth = [299792458.0 / x for x in f], [], {}
    for arc in range(6):
        total = np.zeros(3, int)
        for t in range(60):
            step = rng.integers(-9, 10, 3) if t and rng.random() < 0.1 else np.zeros(3, int)
            if t == 30 and arc == 2:
                step = np.array([50, -40, 7])
            total = total + step
            base, iono = 2e7 + 300 * t, 3 + 0.002 * t
            phase = [base - iono * (f[0] / x) ** 2 + w * n + rng.normal(0, 0.002) for x, w, n in zip(f, wave, total, strict=True)]
            code = [base + iono * (f[0] / x) ** 2 + rng.normal(0, 0.05) for x in f]
            truth[arc, t] = tuple(int(x) for x in step)
            rows.append((arc, t, *map(float, phase), *map(float, code)))
    rows += [(9, 0, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0), (9, 1, None, 2.0, 3.0, 1.0, 2.0, 3.0), (9, 2, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0), (10, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (10, 1, 0.1, 0.05, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "arc int, t int, l1 double, l2 double, l3 double, c1 double, c2 double, c3 double")
    got = {(r.arc, r.t): r for r in S.slips_of_three(df, ["arc"], ["t"], ["l1", "l2", "l3"], ["c1", "c2", "c3"], f, limit=12.0).collect()}
    for key, step in truth.items():
        r = got[key]
        assert not r.cut and (r.slip1, r.slip2, r.slip3) == step, key
        assert (r.cost is None) == (key[1] == 0)
    for arc in range(6):
        first = got[arc, 0]
        for t in range(60):
            free = lambda r: (r.fixed1 - r.fixed2, r.fixed1 - r.fixed3)
            assert all(abs(x - y) < 0.15 for x, y in zip(free(got[arc, t]), free(first), strict=True))
    assert all(got[9, t].cost is None and got[9, t].slip1 == 0 and not got[9, t].cut for t in range(3))
    assert got[10, 1].cut and got[10, 1].slip1 == 0 and got[10, 1].fixed1 == 0.1
