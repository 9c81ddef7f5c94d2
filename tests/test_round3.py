"""Medians by rank, markers on odd dates, the token stream and the covariance order against plain versions."""

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.timeseries import event_markers, group_medians
from corpusflow.plans import registry
from tests.conftest import SF001


def test_group_medians(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", None]), random.choice([None, random.randint(0, 5) / 2])) for _ in range(200)] + [("c", None), ("d", 4.0)]
    got = {r.k: r.median for r in group_medians(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v").collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_markers_at_the_edges_of_bins(spark):
    start = datetime(2024, 3, 29, 13, 30)
    bins = [(i, start + timedelta(days=7 * i)) for i in range(8)]
    dates = [start, start - timedelta(microseconds=1), start + timedelta(days=7), start + timedelta(days=7) - timedelta(microseconds=1), datetime(2024, 3, 31, 2, 30),
             start + timedelta(days=55, hours=23), start + timedelta(days=56), datetime(1969, 1, 1)]
    a = spark.createDataFrame(bins, "bin_idx int, bin_start timestamp_ntz")
    b = spark.createDataFrame([(f"m{i}", d) for i, d in enumerate(dates)], "marker string, date timestamp_ntz")
    found = event_markers(a, b)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(i, m) for i, s in bins for m in [f"m{j}" for j, d in enumerate(dates) if s <= d < s + timedelta(days=7)] or [None]]
    assert sorted(map(str, [(r.bin_idx, r.marker) for r in found.collect()])) == sorted(map(str, want))


def test_token_stream_equals_the_batch(spark):
    registry.load_all()
    got = registry.QUERIES["J03_tokens"](spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = docs.select("doc_id", F.posexplode(tx.social_tokens("text")).alias("pos", "token"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_covariance_order(spark):
    registry.load_all()
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()], float)
    sums = np.cov(x, rowvar=False).sum(0)
    got = [r.i for r in sorted(registry.QUERIES["D19_order"](spark, SF001).collect(), key=lambda r: r.position)]
    assert got == np.argsort(sums).tolist()
