"""Time-series goldens (FIXTURES E01, E07, E08) and properties."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import timeseries as ts
from tests.conftest import SF01


def test_exponential_decay_golden(spark):
    vals = [5, 1, 4, 2, 8, 3]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, a double")
    out = ts.exponential_decay(df, "a", "i", window=4, alpha=0.5).orderBy("i")
    got = [round(r["smoothed"], 4) for r in out.collect()]
    assert got == [5.0, 2.8667, 3.4, 2.6, 5.4, 4.2667]


def _numpy_decay(a, window, alpha):
    d = alpha ** np.arange(window)
    d = (d / d.sum())[::-1]
    idx = np.array([list(range(i - window, i)) for i in range(1, a.size + 1)]).clip(0)
    return (a[idx] * d).sum(axis=1)


def test_exponential_decay_matches_numpy_formula(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, 40).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "i long, a double")
    got = [r["smoothed"] for r in ts.exponential_decay(df, "a", "i", window=7, alpha=0.3).orderBy("i").collect()]
    assert np.allclose(got, _numpy_decay(a, 7, 0.3))


def test_binned_counts_7d_events(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    b = ts.binned_statistic(ev, "ts", None, None, 7, "D", stats=("count",))
    assert [r["count"] for r in b.orderBy("bin_idx").collect()] == [2348, 2320, 2328, 2330, 674]


def test_datespace_edges_and_lost_rows(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    total = ev.count()
    expect = {(1, "D"): (29, 329), (1, "h"): (719, 14), (7, "D"): (5, 0), (1, "M"): (0, total)}
    for (num, unit), (bins, lost) in expect.items():
        p = ts.grid_params(ev, "ts", num, unit, include_tail=False).first()
        assert p["n_bins"] == bins
        b = ts.binned_statistic(ev, "ts", None, None, num, unit, stats=("count",), include_tail=False, dense=False)
        kept = b.agg(F.sum("count")).first()[0] or 0
        assert total - kept == lost


def test_default_bins_keep_every_row(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    for num, unit in ((1, "D"), (1, "h"), (7, "D"), (1, "M"), (1, "Y")):
        b = ts.binned_statistic(ev, "ts", None, None, num, unit, stats=("count",))
        assert b.agg(F.sum("count")).first()[0] == ev.count()


def test_row_on_the_last_edge_and_empty_table(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 00:00:00",)], "t string") \
        .select(F.col("t").cast("timestamp_ntz").alias("ts"))
    b = ts.binned_statistic(df, "ts", None, None, 1, "D", stats=("count",))
    assert [(r["bin_idx"], r["count"]) for r in b.orderBy("bin_idx").collect()] == [(0, 1), (1, 1)]
    b = ts.binned_statistic(df, "ts", None, None, 1, "D", stats=("count",), include_tail=False)
    assert [(r["bin_idx"], r["count"]) for r in b.collect()] == [(0, 2)]     # closed right end
    assert ts.binned_statistic(df.where("false"), "ts", None, None, 1, "D", stats=("count",)).collect() == []


def test_bounds_are_read_once(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    b = ts.binned_statistic(ev, "ts", "event_type", "value", 7, "D", stats=("count", "sum", "mean"))
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2 and "scalar-subquery" not in plan


def test_running_variance_property(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=30)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "i long, x double")
    rows = ts.running_stats(df, "x", "i").orderBy("i").collect()
    assert abs(rows[-1]["running_var"] - np.var(a)) < 1e-9
    assert abs(rows[-2]["running_var"] - np.var(a[:-1])) < 1e-9
    assert abs(rows[-1]["running_mean"] - np.mean(a)) < 1e-12


def test_share_per_bin(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", 0.0), (1, "b", 0.0)], "b long, t string, x double")
    out = {(r["b"], r["t"]): r["share"] for r in ts.share_per_bin(df, "b", "x").collect()}
    assert out[(0, "a")] == 0.25 and out[(1, "a")] is None


def test_bins_ignore_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.range(0, 24 * 20).select(F.timestamp_add(
            "HOUR", F.col("id"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("ts"))
        b = ts.binned_statistic(df, "ts", None, None, 1, "D", stats=("count",), include_tail=True)
        assert {r["count"] for r in b.collect()} == {24}      # across the DST change
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
