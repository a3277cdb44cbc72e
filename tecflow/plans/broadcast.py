"""Satellite places, speeds and clocks from broadcast records; times are GPS seconds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import geometry as G

#: Gravity of Earth (m3/s2) and its rotation (rad/s), by system.
GRAVITY = {"G": 3.986005e14, "J": 3.986005e14, "E": 3.986004418e14, "C": 3.986004418e14}
TURN = {"G": 7.2921151467e-5, "J": 7.2921151467e-5, "E": 7.2921151467e-5, "C": 7.292115e-5}
#: Seconds that a record may be used before and after its reference, by system.
VALID = {"G": 7200.0, "E": 10800.0, "C": 3600.0, "J": 3600.0, "R": 1020.0}
#: Satellites of C that stand still, by number, and the tilt of the frame that their elements are in.
STILL, TILT = (1, 2, 3, 4, 5, 59, 60, 61, 62, 63), math.radians(-5)
#: Rounds of Kepler's equation; with an eccentricity of 0.17 they leave 1e-15.
ROUNDS = 20
#: Gravity, radius (m), second zonal and rotation of the frame of R.
STATE_GRAVITY, STATE_RADIUS, STATE_ZONAL, STATE_TURN = 3.9860044e14, 6378136.0, 1082625.7e-9, 7.292115e-5
#: Seconds between tabulated states of R, and steps from one to the next.
NODE, STEPS = 30.0, 3


def by_system(values: dict[str, float]) -> Column:
    system, out = F.substring("sat", 1, 1), F.lit(None).cast("double")
    for s, v in values.items():
        out = F.when(system == s, v).otherwise(out)
    return out


def chosen(targets: DataFrame, records: DataFrame, time: str = "t", healthy: bool = True, stretch: float = 3600.0) -> DataFrame:
    """targets with the columns of the record of their sat whose reference toe_s is nearest (of two the earlier), within its time of validity; null without one.

    Records with a health other than 0 are left out. Each record is used for one
    unbroken time, which is listed under the stretches it reaches, so that targets
    meet it by equality, however many a satellite has.
    """
    r = records.where("health = 0") if healthy else records
    valid, w = by_system(VALID), Window.partitionBy("sat").orderBy("toe_s")
    middle = lambda other: (F.col("toe_s") + other) / 2
    r = r.withColumns({"_from": F.greatest(F.col("toe_s") - valid, middle(F.lag("toe_s").over(w))), "_to": F.least(F.col("toe_s") + valid, middle(F.lead("toe_s").over(w))), "_after": F.coalesce(middle(F.lag("toe_s").over(w)) >= F.col("toe_s") - valid, F.lit(False))})
    k = lambda c: F.floor(F.col(c) / stretch).cast("long")
    r = r.withColumn("_k", F.explode(F.sequence(k("_from"), k("_to")))).withColumnRenamed("sat", "_sat")
    at = targets.withColumn("_at", k(time))
    inside = ((F.col(time) > F.col("_from")) | (~F.col("_after") & (F.col(time) == F.col("_from")))) & (F.col(time) <= F.col("_to"))
    kept = [c for c in r.columns if c not in ("_sat", "_from", "_to", "_after", "_k")]
    clash = set(kept) & set(targets.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    return at.join(r, (at["sat"] == r["_sat"]) & (at["_at"] == r["_k"]) & inside, "left").select(*targets.columns, *kept)


def propagated(rows: DataFrame, time: str = "t") -> DataFrame:
    """rows of targets with their orbital elements, with x, y, z (m), vx, vy, vz (m/s), Earth-fixed, and clock_s without the periodic relativistic part.

    Null where there is no record or its clock is absurd (above one second).
    """
    col, e, tk = F.col, F.col("ecc"), F.col("_tk")
    df = rows.withColumns({"_tk": F.col(time) - col("toe_s"), "_a": col("root_a") * col("root_a"), "_we": by_system(TURN)})
    df = df.withColumn("_n", F.sqrt(by_system(GRAVITY) / (col("_a") * col("_a") * col("_a"))) + col("dn")).withColumn("_m", col("m0") + col("_n") * tk)
    anomaly = col("_m")
    for _ in range(ROUNDS):
        anomaly = col("_m") + e * F.sin(anomaly)
    df = df.withColumn("_ea", anomaly)
    df = df.withColumns({"_1": 1 - e * F.cos("_ea"), "_u": F.atan2(F.sqrt(1 - e * e) * F.sin("_ea"), F.cos("_ea") - e) + col("perigee")})
    df = df.withColumns({"_rate": col("_n") / col("_1"), "_s2": F.sin(2 * col("_u")), "_c2": F.cos(2 * col("_u"))})
    df = df.withColumn("_ud", F.sqrt(1 - e * e) * col("_rate") / col("_1"))
    swing = lambda s, c: col(s) * col("_s2") + col(c) * col("_c2")
    swung = lambda s, c: 2 * col("_ud") * (col(s) * col("_c2") - col(c) * col("_s2"))
    still = F.coalesce((F.substring("sat", 1, 1) == "C") & F.substring("sat", 2, 2).try_cast("int").isin(*STILL), F.lit(False))
    turn = F.when(still, 0.0).otherwise(col("_we"))
    df = df.withColumns({
        "_r": col("_a") * col("_1") + swing("crs", "crc"), "_rd": col("_a") * e * F.sin("_ea") * col("_rate") + swung("crs", "crc"),
        "_w": col("_u") + swing("cus", "cuc"), "_wd": col("_ud") + swung("cus", "cuc"),
        "_i": col("incl") + col("incl_rate") * tk + swing("cis", "cic"), "_id": col("incl_rate") + swung("cis", "cic"),
        "_o": col("node") + (col("node_rate") - turn) * tk - col("_we") * col("toe_own_s"), "_od": col("node_rate") - turn,
    })
    df = df.withColumns({"_p": col("_r") * F.cos("_w"), "_q": col("_r") * F.sin("_w"), "_pd": col("_rd") * F.cos("_w") - col("_r") * F.sin("_w") * col("_wd"), "_qd": col("_rd") * F.sin("_w") + col("_r") * F.cos("_w") * col("_wd")})
    df = df.withColumns({"_h": col("_q") * F.cos("_i"), "_hd": col("_qd") * F.cos("_i") - col("_q") * F.sin("_i") * col("_id")})
    co, so = F.cos("_o"), F.sin("_o")
    df = df.withColumns({"_x": col("_p") * co - col("_h") * so, "_y": col("_p") * so + col("_h") * co, "_z": col("_q") * F.sin("_i")})
    df = df.withColumns({
        "_vx": col("_pd") * co - col("_hd") * so - col("_y") * col("_od"), "_vy": col("_pd") * so + col("_hd") * co + col("_x") * col("_od"),
        "_vz": col("_qd") * F.sin("_i") + col("_q") * F.cos("_i") * col("_id"),
    })
    # Still satellites: elements in a tilted frame that does not turn.
    angle = col("_we") * tk
    turned = lambda v: G.rotated(*G.rotated(*v, 1, F.lit(TILT)), 3, angle)
    place, speed = turned((col("_x"), col("_y"), col("_z"))), turned((col("_vx"), col("_vy"), col("_vz")))
    extra = (col("_we") * place[1], -col("_we") * place[0], F.lit(0.0))
    dt = F.col(time) - col("toc_s")
    clock = col("af0") + col("af1") * dt + col("af2") * dt * dt
    known = F.abs(clock) <= 1.0
    out = {n: F.when(known, F.when(still, p).otherwise(col(f"_{n}"))) for n, p in zip("xyz", place, strict=True)}
    out |= {f"v{n}": F.when(known, F.when(still, s + x).otherwise(col(f"_v{n}"))) for n, s, x in zip("xyz", speed, extra, strict=True)}
    return df.select(*rows.columns, *[c.alias(n) for n, c in out.items()], F.when(known, clock).alias("clock_s"))


def pull(s: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Rates of states (rows: x, y, z, vx, vy, vz) in the turning frame of R, with what Sun and Moon add."""
    r2 = (s[:, :3] ** 2).sum(axis=1)
    r = np.sqrt(r2)
    near, flat = STATE_GRAVITY / (r2 * r), 1.5 * STATE_ZONAL * STATE_GRAVITY * STATE_RADIUS**2 / (r2 * r2 * r)
    tilt = 5 * s[:, 2] ** 2 / r2
    out = np.empty_like(s)
    out[:, :3] = s[:, 3:]
    out[:, 3] = (-near - flat * (1 - tilt) + STATE_TURN**2) * s[:, 0] + 2 * STATE_TURN * s[:, 4] + fixed[:, 0]
    out[:, 4] = (-near - flat * (1 - tilt) + STATE_TURN**2) * s[:, 1] - 2 * STATE_TURN * s[:, 3] + fixed[:, 1]
    out[:, 5] = (-near - flat * (3 - tilt)) * s[:, 2] + fixed[:, 2]
    return out


def stepped(s: np.ndarray, fixed: np.ndarray, h: float) -> np.ndarray:
    """States after h seconds, by the classical fourth-order rule, all records at once."""
    a = pull(s, fixed)
    b = pull(s + h / 2 * a, fixed)
    c = pull(s + h / 2 * b, fixed)
    d = pull(s + h * c, fixed)
    return s + h / 6 * (a + 2 * b + 2 * c + d)


STATE = ("x", "y", "z", "vx", "vy", "vz")


def tabulated(records: DataFrame) -> DataFrame:
    """(sat, toe_s, k, state, next state): states of R every NODE seconds around each record's reference, as far as it is valid; _n_ names are those at the next node."""
    reach = math.ceil(VALID["R"] / NODE)

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            start, fixed = pdf[list(STATE)].to_numpy(float), pdf[["ax", "ay", "az"]].to_numpy(float)
            at = {0: start}
            for way in (1, -1):
                for k in range(reach):
                    s = at[way * k]
                    for _ in range(STEPS):
                        s = stepped(s, fixed, way * NODE / STEPS)
                    at[way * (k + 1)] = s
            for k in range(-reach, reach):
                yield pdf[["sat", "toe_s"]].assign(k=k, **{f"_{c}": at[k][:, i] for i, c in enumerate(STATE)}, **{f"_n_{c}": at[k + 1][:, i] for i, c in enumerate(STATE)})

    fields = [T.StructField("sat", records.schema["sat"].dataType), T.StructField("toe_s", T.DoubleType()), T.StructField("k", T.LongType())]
    fields += [T.StructField(f"{p}{c}", T.DoubleType()) for p in ("_", "_n_") for c in STATE]
    return records.select("sat", "toe_s", *STATE, "ax", "ay", "az").mapInPandas(batches, T.StructType(fields))


def from_states(targets: DataFrame, records: DataFrame, time: str = "t") -> DataFrame:
    """targets with x, y, z, vx, vy, vz and clock_s of R: the record chosen, its orbit tabulated once, and a curve through the two nearest nodes; null without a record."""
    picked = chosen(targets, records.select("sat", "toe_s", "health", "af0", "af1"), time)
    nodes = tabulated(records.where("health = 0")).withColumnsRenamed({"sat": "_sat", "toe_s": "_toe", "k": "_k"})
    rows = picked.withColumn("_dt", F.col(time) - F.col("toe_s"))
    last = math.ceil(VALID["R"] / NODE) - 1
    rows = rows.withColumn("_of", F.least(F.floor(F.col("_dt") / NODE), F.lit(last)).cast("long"))
    rows = rows.join(nodes, (rows["sat"] == nodes["_sat"]) & (rows["toe_s"] == nodes["_toe"]) & (rows["_of"] == nodes["_k"]), "left")
    u = F.col("_dt") / NODE - F.col("_of")
    out = []
    for c in "xyz":
        p0, p1, m0, m1 = F.col(f"_{c}"), F.col(f"_n_{c}"), F.col(f"_v{c}") * NODE, F.col(f"_n_v{c}") * NODE
        c2, c3 = 3 * (p1 - p0) - 2 * m0 - m1, 2 * (p0 - p1) + m0 + m1
        out += [(p0 + u * (m0 + u * (c2 + u * c3))).alias(c), ((m0 + u * (2 * c2 + 3 * u * c3)) / NODE).alias(f"v{c}")]
    return rows.select(*targets.columns, *out, (F.col("af0") + F.col("af1") * F.col("_dt")).alias("clock_s"))
