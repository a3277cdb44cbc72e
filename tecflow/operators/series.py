"""Operators on ordered series: one row per (keys, order), any number of series.

All of them are window expressions over the same partitioning and order, so a
chain of them needs one shuffle and one sort. Missing values are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

Names = Sequence[str]

#: Phase noise of the geometry-free combination (m), ionospheric drift in 30 s at 4 m per hour.
SLIP_NOISE, SLIP_DRIFT = (2 * (0.0027**2 + 0.0017**2)) ** 0.5, 4.0 * 30 / 3600


def along(keys: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys: Names, order: Names) -> WindowSpec:
    return along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def forward_difference(df: DataFrame, keys: Names, order: Names, value: str, out: str = "diff") -> DataFrame:
    """Next value less this one; null at the end of a series."""
    return df.withColumn(out, F.lead(value).over(along(keys, order)) - F.col(value))


def backward_difference(df: DataFrame, keys: Names, order: Names, value: str, out: str = "diff") -> DataFrame:
    """This value less the one before; null where either is null or zero, as zero stands for a missing measurement."""
    before = F.lag(value).over(along(keys, order))
    return df.withColumn(out, F.when((F.col(value) != 0) & (before != 0), F.col(value) - before))


def sliding_deviation(df: DataFrame, keys: Names, order: Names, value: str, size: int = 10, ddof: int = 1, least: int = 2, shift: int = 5, out: str = "deviation") -> DataFrame:
    """Standard deviation over size rows, of at least least values, stamped shift rows before the window's end.

    Only full windows count. With least = size, ddof = 0 and shift = 0 it is the
    strict form: every row present, population deviation, stamped at the end.
    """
    frame = along(keys, order).rowsBetween(1 - size, 0)
    spread = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    full = F.count(F.lit(1)).over(frame) == size
    found = df.withColumn(out, F.when(full & (F.count(value).over(frame) >= least), spread.over(frame)))
    return found.withColumn(out, F.lead(out, shift).over(along(keys, order))) if shift else found


def relative_to_mean_before(df: DataFrame, keys: Names, order: Names, value: str, size: int, out: str = "detrended") -> DataFrame:
    """Value over the mean of the size values before it; null unless all of them are present and sum to more than zero."""
    frame = along(keys, order).rowsBetween(-size, -1)
    ok = (F.count(value).over(frame) == size) & (F.sum(value).over(frame) > 0)
    return df.withColumn(out, F.when(ok, F.col(value) / F.avg(value).over(frame)))


def variation_index(df: DataFrame, keys: Names, order: Names, value: str, detrend: int = 10, size: int = 10, out: str = "s4c") -> DataFrame:
    """Relative deviation sqrt(E[x2] - E[x]2) / E[x] of the detrended value over size rows, all of which must be present."""
    frame = along(keys, order).rowsBetween(1 - size, 0)
    x = relative_to_mean_before(df, keys, order, value, detrend, "_x")
    mean, square = F.avg("_x").over(frame), F.avg(F.col("_x") * F.col("_x")).over(frame)
    value = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / mean
    return x.withColumn(out, F.when(F.count("_x").over(frame) == size, value)).drop("_x")


def arcs(df: DataFrame, keys: Names, order: Names, valid: Column, out: str = "arc") -> DataFrame:
    """Number of the unbroken run of valid rows a row is in, from 1; null on other rows."""
    w = along(keys, order)
    flagged = df.withColumn("_v", F.coalesce(valid, F.lit(False)))
    starts = F.when(F.col("_v") & ~F.coalesce(F.lag("_v").over(w), F.lit(False)), 1).otherwise(0)
    counted = flagged.withColumn("_s", starts).withColumn("_a", F.sum("_s").over(running(keys, order)))
    return counted.withColumn(out, F.when(F.col("_v"), F.col("_a"))).drop("_v", "_s", "_a")


def without_short_arcs(df: DataFrame, keys: Names, value: str, least: int, arc: str = "arc") -> DataFrame:
    """Value, null in arcs of fewer than least rows and outside arcs."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, arc))
    return df.withColumn(value, F.when(F.col(arc).isNotNull() & (size >= least), F.col(value)))


def without_arc_ends(df: DataFrame, keys: Names, order: Names, value: str, trim: int, arc: str = "arc") -> DataFrame:
    """Value, null on the first and last trim rows of each arc and outside arcs."""
    by = [*keys, arc]
    place = F.row_number().over(along(by, order))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(value, F.when(F.col(arc).isNotNull() & (place > trim) & (place <= size - trim), F.col(value)))


def without_anomalies(df: DataFrame, keys: Names, order: Names, value: str, jump: float, least: int, arc: str = "arc") -> DataFrame:
    """Value, null from the first jump in an arc to its end, then null in arcs left with fewer than least values."""
    by = [*keys, arc]
    leap = F.abs(F.col(value) - F.lag(value).over(along(by, order))) > jump
    bad = df.withColumn("_j", F.when(leap, 1).otherwise(0)).withColumn("_b", F.max("_j").over(running(by, order)))
    kept = F.col(arc).isNotNull() & (F.col("_b") == 0)
    left = F.sum(F.when(kept & F.col(value).isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*by))
    return bad.withColumn("_n", left).withColumn(value, F.when(kept & (F.col("_n") >= least), F.col(value))).drop("_j", "_b", "_n")


def slips(df: DataFrame, keys: Names, order: Names, geometry: str, widelane: str, elevation: Column, arc: str = "arc", back: int = 30, sigma: float = SLIP_NOISE, drift: float = SLIP_DRIFT, out: str = "slip") -> DataFrame:
    """Whether a cycle slip starts at a row.

    The geometry-free combination jumps by more than four deviations of an
    elevation-dependent noise plus drift; or the wide lane leaves five deviations
    of its mean over up to back rows before, in an arc that scatters over 0.6.
    """
    by = [*keys, arc]
    w = along(by, order)
    frame = w.rowsBetween(-back, -1)
    noise = sigma * (1 + 10 * F.exp(-elevation / 10))
    leap = F.abs(F.col(geometry) - F.lag(geometry).over(w)) > 4 * noise + drift
    mean, spread = F.avg(widelane).over(frame), F.greatest(F.coalesce(F.stddev_samp(widelane).over(frame), F.lit(0.0)), F.lit(0.01))
    off = (F.count(widelane).over(frame) >= 3) & (F.abs(F.col(widelane) - mean) > 5 * spread) & (F.stddev_samp(widelane).over(Window.partitionBy(*by)) > 0.6)
    return df.withColumn(out, F.col(arc).isNotNull() & (F.coalesce(leap, F.lit(False)) | F.coalesce(off, F.lit(False))))


def repaired(df: DataFrame, keys: Names, order: Names, geometry: str, widelane: str | None, slip: str, waves: tuple[float, float], arc: str = "arc", out: str = "repaired") -> DataFrame:
    """Geometry-free combination less the whole cycles of all slips so far in its arc; without a wide lane, less the jumps themselves.

    The waves' difference is that of the numbers as written, as a jump of half a
    cycle is rounded by its last bit.
    """
    by = [*keys, arc]
    w, (first, second) = along(by, order), waves
    apart = float(Decimal(repr(first)) - Decimal(repr(second)))
    jump = F.col(geometry) - F.lag(geometry).over(w)
    if widelane is None:
        step = jump
    else:
        lane = F.rint(F.col(widelane) - F.lag(widelane).over(w))
        cycles = F.rint((jump - second * lane) / apart)
        step = cycles * first - (cycles - lane) * second
    marked = df.withColumn("_c", F.when(F.col(slip), F.coalesce(step, F.lit(0.0))).otherwise(0.0))
    return marked.withColumn(out, F.col(geometry) - F.sum("_c").over(running(by, order))).drop("_c")


def without_jumps(df: DataFrame, keys: Names, order: Names, value: str, jump: float = 2.0) -> DataFrame:
    """Value, null where it differs from the one before by more than jump."""
    before = F.lag(value).over(along(keys, order))
    return df.withColumn(value, F.when(F.coalesce(F.abs(F.col(value) - before) > jump, F.lit(False)), None).otherwise(F.col(value)))


def smoothed(df: DataFrame, keys: Names, order: Names, code: str, phase: str, arc: str = "arc", warm: int = 10, out: str = "smoothed") -> DataFrame:
    """Carrier-smoothed code: running mean of code plus phase in the arc, less phase; null on an arc's first warm rows.

    The usual recursion over the rows of an arc has this closed form.
    """
    by = [*keys, arc]
    mean = F.avg(F.col(code) + F.col(phase)).over(running(by, order))
    return df.withColumn(out, F.when(F.col(arc).isNotNull() & (F.row_number().over(along(by, order)) > warm), mean - F.col(phase)))


def levelled(df: DataFrame, keys: Names, code: str, phase: str, arc: str = "arc", out: str = "levelled") -> DataFrame:
    """Arc mean of code plus phase, less phase."""
    mean = F.avg(F.col(code) + F.col(phase)).over(Window.partitionBy(*keys, arc))
    return df.withColumn(out, F.when(F.col(arc).isNotNull(), mean - F.col(phase)))


def unwrapped(df: DataFrame, keys: Names, order: Names, angle: str, out: str = "unwrapped") -> DataFrame:
    """Angle in radians plus the whole turns that keep it within half a turn of the row before; the first row starts from zero."""
    turn = 2 * 3.141592653589793
    before = F.lag(angle, 1, 0.0).over(along(keys, order))
    steps = df.withColumn("_t", F.floor((before - F.col(angle)) / turn + 0.5))
    return steps.withColumn(out, F.col(angle) + turn * F.sum("_t").over(running(keys, order))).drop("_t")


def clock_repaired(df: DataFrame, keys: Names, epoch: str, sats: Names, value: str, unit: float, tolerance: float = 0.1, out: str = "repaired") -> DataFrame:
    """Value less the receiver clock's jumps: steps common to all satellites of an epoch that are near a whole number of units, summed up."""
    jump = F.col(value) - F.lag(value).over(along([*keys, *sats], [epoch]))
    stepped = df.withColumn("_d", jump)
    common = stepped.groupBy(*keys, epoch).agg(F.avg("_d").alias("_m"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    whole = F.rint(F.col("_m") / unit)
    near = (whole != 0) & (F.abs(F.col("_lo") / unit - whole) <= tolerance) & (F.abs(F.col("_hi") / unit - whole) <= tolerance)
    steps = common.withColumn("_c", F.when(near, whole * unit).otherwise(0.0)).withColumn("_s", F.sum("_c").over(running(keys, [epoch])))
    return stepped.join(steps.select(*keys, epoch, "_s"), [*keys, epoch]).withColumn(out, F.col(value) - F.col("_s")).drop("_d", "_s")


def spaced(df: DataFrame, keys: Names, order: Names, seconds: Column, least: float) -> DataFrame:
    """Rows that come more than least seconds after the row before them."""
    gap = df.withColumn("_x", seconds).withColumn("_g", F.col("_x") - F.lag("_x").over(along(keys, order)))
    return gap.where(F.col("_g").isNull() | (F.col("_g") > least)).drop("_x", "_g")


def first_written(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(along(keys, order))).where("_n = 1").drop("_n")


def detrended(df: DataFrame, keys: Names, order: Names, value: str, out: str = "detrended") -> DataFrame:
    """Value less its least-squares line over the row numbers of the series, from 0."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", (F.row_number().over(along(keys, order)) - 1).cast("double"))
    x = F.when(F.col(value).isNotNull(), F.col("_i"))
    slope = F.covar_pop(x, value).over(w) / F.var_pop(x).over(w)
    return rows.withColumn(out, F.col(value) - (F.avg(value).over(w) + slope * (F.col("_i") - F.avg(x).over(w)))).drop("_i")


def split_at_jumps(df: DataFrame, keys: Names, order: Names, coordinates: Names, far: float, out: str = "track") -> DataFrame:
    """Number of the track a point belongs to, from 0: a new one starts after a step longer than far."""
    w = along(keys, order)
    square = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lag(c).over(w), 2) for c in coordinates])
    marked = df.withColumn("_n", F.when(F.sqrt(square) > far, 1).otherwise(0))
    return marked.withColumn(out, F.sum("_n").over(running(keys, order))).drop("_n")


def capped(df: DataFrame, value: str, most: float) -> DataFrame:
    """Value, null where its size exceeds most."""
    return df.withColumn(value, F.when(F.abs(F.col(value)) <= most, F.col(value)))


def dense(df: DataFrame, keys: Names, epoch: str, first: int, last: int) -> DataFrame:
    """df with a row for every epoch from first to last of every key, so that row frames span equal times."""
    axis = df.select(*keys).distinct().withColumn(epoch, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return axis.join(df, [*keys, epoch], "left")


def slips_of_three(df: DataFrame, keys: Names, order: Names, phases: Names, codes: Names, carriers: tuple[float, float, float], lane_noise: float = 0.25, phase_noise: float = 0.01, limit: float = 16.0) -> DataFrame:
    """Cycle slips on three carriers against the row before: slip1, slip2, slip3 (whole cycles) and cost, and of phases fixed1, fixed2, fixed3 (m), freed of all slips so far.

    Both wide lanes of phases less codes give the differences of the slips, the
    differences of phases their sizes. Around the rounded lanes all nine pairs of
    whole numbers are tried, and the one is taken whose four jumps lie nearest, in
    squares of lane_noise (cycles) and phase_noise (m). cut says that none lies
    within limit: no slip is repaired there, and the arc ends. Keys include the arc;
    without a row before, or with a null, slips are zero and cost is null.
    """
    light = 299792458.0
    f, wave = carriers, [light / c for c in carriers]
    w = along(keys, order)

    def lane(i: int, j: int) -> Column:
        phase = (f[i] * F.col(phases[i]) - f[j] * F.col(phases[j])) / (f[i] - f[j])
        code = (f[i] * F.col(codes[i]) + f[j] * F.col(codes[j])) / (f[i] + f[j])
        return (phase - code) * ((f[i] - f[j]) / light)

    combined = {"_a": lane(0, 1), "_b": lane(1, 2), "_g": F.col(phases[0]) - F.col(phases[1]), "_h": F.col(phases[0]) - F.col(phases[2])}
    rows = df.withColumns(combined)
    rows = rows.withColumns({n: F.col(n) - F.lag(n).over(w) for n in combined})
    a, b, g, h = (F.col(n) for n in combined)

    def tried(da: int, db: int) -> Column:
        one, two = F.rint(a) + da, F.rint(b) + db
        n1 = F.rint((g - wave[1] * one) / (wave[0] - wave[1]))
        n2, n3 = n1 - one, n1 - one - two
        square = lambda x, noise: (x / noise) * (x / noise)
        off = square(a - one, lane_noise) + square(b - two, lane_noise) + square(g - wave[0] * n1 + wave[1] * n2, phase_noise) + square(h - wave[0] * n1 + wave[2] * n3, phase_noise)
        return F.struct(off.alias("cost"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), n3.cast("long").alias("n3"))

    whole = a.isNotNull() & b.isNotNull() & g.isNotNull() & h.isNotNull()
    rows = rows.withColumn("_best", F.when(whole, F.array_min(F.array(*[tried(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))))
    rows = rows.withColumn("cost", F.col("_best.cost")).withColumn("cut", F.coalesce(F.col("cost") > limit, F.lit(False)))
    rows = rows.withColumns({f"slip{k}": F.when(F.col("cut") | F.col("cost").isNull(), 0).otherwise(F.col(f"_best.n{k}")).cast("long") for k in (1, 2, 3)})
    so_far = running(keys, order)
    rows = rows.withColumns({f"fixed{k + 1}": F.col(phases[k]) - F.sum(f"slip{k + 1}").over(so_far) * wave[k] for k in range(3)})
    return rows.drop(*combined, "_best")
