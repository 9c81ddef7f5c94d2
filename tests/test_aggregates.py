"""Aggregate goldens (FIXTURES D01, D07, D09, D11, D15, D24)."""

import math

from pyspark.sql import functions as F

from corpusflow.operators import aggregate as ag
from corpusflow.operators import corpus as cp


def test_label_table_golden(spark):
    y = spark.createDataFrame([(i,) for i in [0, 1, 0, 1, 2, 0]], "label_id long")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "label_id long, label string")
    got = [(r["label"], r["n"]) for r in cp.label_table(y, names).orderBy("label_id").collect()]
    assert got == [("a", 3), ("b", 2), ("c", 1)]


def test_label_table_keeps_zero_counts(spark):
    y = spark.createDataFrame([(0,), (2,)], "label_id long")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label_id long, label string")
    got = [(r["label"], r["n"]) for r in cp.label_table(y, names).orderBy("label_id").collect()]
    assert got == [("a", 1), ("b", 0), ("c", 1)]


def test_hmean_golden(spark):
    df = spark.createDataFrame([(0, .5), (0, .5), (1, .1), (1, .9), (2, 0.0), (2, 1.0)], "g int, x double")
    got = {r["g"]: r["h"] for r in df.groupBy("g").agg(ag.hmean("x").alias("h")).collect()}
    assert abs(got[0] - .5) < 1e-12 and abs(got[1] - .18) < 1e-12 and got[2] is None


def test_certainty_golden(spark):
    df = spark.createDataFrame([(.5,), (.1,)], "p double")
    got = [r[0] for r in df.select(ag.certainty(F.col("p"))).collect()]
    assert abs(got[0]) < 1e-12 and abs(got[1] - .64) < 1e-12


def test_baseline_improvement_golden(spark):
    counts = spark.createDataFrame([("x", 6), ("y", 4)], "c string, n long")
    r = ag.baseline_improvement(counts, F.lit(0.8)).first()
    assert abs(r["baseline"] - .6) < 1e-12 and abs(r["improvement"] - .5) < 1e-12


def test_binned_accuracy_floor_rule(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(23)], "doc_id long, score double")
    b = ag.binned_accuracy(df, "score", F.lit(True), "doc_id", 10).orderBy("bin")
    assert [r["n"] for r in b.collect()] == [3, 2, 2, 3, 2, 2, 3, 2, 2, 2]


def test_upper_median(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "len long")
    r = ag.upper_median_and_mean(df, "len").first()
    assert r["mean"] == 2.5 and r["median"] == 3


def test_class_metrics_zero_denominators(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "gold string, pred string")
    m = {r["cls"]: r for r in ag.class_metrics(df, "gold", "pred").collect()}
    assert m["b"]["precision"] == 0.0 and m["b"]["recall"] == 0.0 and m["b"]["f1"] == 0.0
    assert abs(m["a"]["precision"] - 2 / 3) < 1e-12 and m["a"]["recall"] == 1.0
    assert abs(m["a"]["accuracy"] - 2 / 3) < 1e-12


def test_log_loss(spark):
    df = spark.createDataFrame([(0.9,), (0.5,)], "p double")
    v = df.select(ag.log_loss(F.col("p"))).first()[0]
    assert abs(v - (-(math.log(.9) + math.log(.5)) / 2)) < 1e-12


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = {r["bin"]: r["n"] for r in ag.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
