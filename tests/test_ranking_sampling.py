"""Distributed ranks equal a global window (split-and-merge: 1 and 8
partitions); sampler properties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.operators import ranking as rk
from corpusflow.operators import sampling as sp


def _data(spark, parts):
    return spark.range(0, 5000).select(F.col("id"), (F.col("id") * 7919 % 97).alias("v")).repartition(parts)


def test_global_rank_matches_window(spark):
    for parts in (1, 8):
        df = _data(spark, parts)
        got = {r["id"]: r["rank"] for r in rk.global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
        want = {r["id"]: r["rn"] for r in df.withColumn(
            "rn", F.row_number().over(Window.orderBy(F.desc("v"), F.asc("id")))).collect()}
        assert got == want


def test_group_rank_matches_window(spark):
    df = _data(spark, 8).withColumn("g", F.col("id") % 3)
    got = {r["id"]: r["rn"] for r in rk.group_rank(df, ["g"], ["v", "id"]).collect()}
    want = {r["id"]: r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).collect()}
    assert got == want


def test_top_k_per_group(spark):
    df = _data(spark, 4).withColumn("g", F.col("id") % 5)
    out = rk.top_k_per_group(df, ["g"], [F.desc("v"), "id"], 3)
    assert out.groupBy("g").count().where("count != 3").count() == 0


def test_bootstrap_exact_size(spark):
    df = spark.range(0, 399).withColumnRenamed("id", "doc_id")
    w = sp.bootstrap_weights(df, "doc_id", n_iter=5, proportion=0.5, seed=1)
    sizes = {r["replicate"]: r["s"] for r in w.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()}
    assert sizes == {i: 199 for i in range(5)}


def test_balance_equal_classes(spark):
    df = spark.range(0, 300).select(F.col("id").alias("doc_id"),
                                    F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("label"))
    b = sp.balance(df, "label", "doc_id", seed=2)
    counts = {r["label"]: r["count"] for r in b.groupBy("label").count().collect()}
    assert counts == {"a": 75, "b": 75}


def test_stratified_split_sizes(spark):
    df = spark.range(0, 100).select(F.col("id").alias("doc_id"),
                                    F.when(F.col("id") < 30, "a").otherwise("b").alias("label"))
    s = sp.stratified_split(df, "label", "doc_id", test_size=0.1, n_iter=2, seed=3)
    c = {(r["split"], r["label"]): r["n"] for r in s.where("is_test").groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert c == {(0, "a"): 3, (0, "b"): 7, (1, "a"): 3, (1, "b"): 7}


def test_quota_per_key(spark):
    df = spark.range(0, 50).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("k"))
    q = sp.quota(df, "k", ["seq"], {"x": 3, "y": 1})
    assert sorted((r["k"], r["seq"]) for r in q.collect()) == [("x", 0), ("x", 2), ("x", 4), ("y", 1)]


def test_kfold_range(spark):
    f = sp.kfold(spark.range(0, 1000).withColumnRenamed("id", "doc_id"), "doc_id", 10, seed=1)
    assert {r["fold"] for r in f.select("fold").distinct().collect()} == set(range(10))


def _rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_registered_queries_split_and_merge(spark):
    """Same results with 1 and 8 shuffle partitions (AQE off so the counts hold)."""
    import __spark_entry__ as E
    from tests.conftest import SF001
    q = E.queries()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        results = {}
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            results[parts] = {qid: _rows(q[qid](spark, SF001)) for qid in ("F03", "D15", "E05", "I22", "I25", "C02")}
        assert results["1"] == results["8"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bootstrap_draws_with_replacement_from_all_rows(spark):
    from corpusflow.operators.sampling import bootstrap_weights, portable_hash

    w = bootstrap_weights(spark.range(199).withColumnRenamed("id", "doc_id"), "doc_id", n_iter=4)
    per = [r.n for r in w.groupBy("replicate").agg(F.count("*").alias("n")).collect()]
    assert w.agg(F.max("weight")).first()[0] > 1 and all(100 < n < 150 for n in per)
    # indices past any fixed period are drawn, and seeds give other orders
    drawn = spark.range(20000).select(F.pmod(portable_hash(F.lit(0), F.col("id")), F.lit(5_000_000)).alias("i"))
    assert drawn.where("i > 1000003").count() > 12000


def test_global_rank_survives_cache_release(spark):
    from corpusflow.operators.ranking import global_rank

    wide = spark.range(60000, numPartitions=7).select("id", F.xxhash64("id").alias("v"), F.lit("x" * 50).alias("text"))
    r = global_rank(wide, ["v", "id"])
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = r.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert tuple(got) == (60000, 60000, 1, 60000)


def test_event_markers(spark):
    from corpusflow.operators.timeseries import event_markers

    bins = spark.sql("SELECT timestamp_ntz'2024-01-01' AS bin_start UNION ALL SELECT timestamp_ntz'2024-01-08'")
    marks = spark.sql("SELECT 'm' AS marker, timestamp_ntz'2024-01-09' AS date")
    assert [(r.bin_start.day, r.marker) for r in event_markers(bins, marks).orderBy("bin_start").collect()] == [(1, None), (8, "m")]
