"""Queries against their SQL on events made for one case each: zero values, ties."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tecflow.plans import registry


def both(spark, folder, name, rows):
    """Rows of a query and of its SQL on events (event_id, user_id, event_type, value), a minute apart."""
    df = spark.createDataFrame([(e, datetime(2024, 1, 1) + timedelta(minutes=k), u, t, v, "{}") for k, (e, u, t, v) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    return sorted(map(tuple, got.collect())), sorted(con.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall())


def test_zero_is_a_value_of_the_mask(spark, tmp_path):
    got, want = both(spark, tmp_path, "validity_masks", [(k, 1, "view", 0.0 if k % 2 else 5.0) for k in range(1, 100)])
    assert got == want and (1, 0.0, None, None) in got and (11, None, None, None) in got and (13, None, None, None) in got


def test_mean_halfway_goes_up(spark, tmp_path):
    rows, want, e = [], {}, 0
    for u in range(40):
        values = [(k * k * (u + 7) + 31 * k) % 20011 for k in range(127)]  # hundredths; of 128 with a sum of 4 modulo 8 the mean is halfway at six digits
        values.append((4 - sum(values)) % 8)
        want[u] = (2 * sum(values) * 10**4 + 128) // 256 / 1e6
        for v in values:
            e += 1 + ((e + 1) % 7 == 0)
            rows.append((e, u, "view", v / 100))
    got, _ = both(spark, tmp_path, "result_stats", rows)
    assert {g[0]: g[4] for g in got} == want


@pytest.mark.parametrize("name", ["slip_repair", "slip_repair_simple"])
def test_jumps_of_half_a_cycle(spark, tmp_path, name):
    jumps = [d for d in range(5400, 50000) if (d - 24421 * round(d / 5000)) % 5392 == 2696]  # hundredths
    rows, u = [], 0
    for d in jumps:
        for first in range(1, 2000, 37):
            rows += [(2 * u, u, "view", first / 100), (2 * u + 1, u, "view", (first + d) / 100)]
            u += 1
    got, want = both(spark, tmp_path, name, rows)
    assert jumps and len(got) == 2 * u and got == want
