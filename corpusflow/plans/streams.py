"""Streaming twins (J01-J05): file streams over the driver tables, run
with an available-now trigger into checkpointed sinks in the shared folder,
then read back.  Oracles are the batch twins' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import landing_dir
from ..sources.tables import table
from ..streaming import streams as st
from .registry import ORACLE, query


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return st.stream_table(spark, f"{sf.rstrip('/')}/{name}*.parquet", schema)


def _run(spark, df, name, mode="append"):
    base = landing_dir(spark, name)
    return spark.read.parquet(st.run_to_table(df, f"{base}/out", f"{base}/chk", mode))


@query("J01")
def j01_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    d = _stream(spark, sf, "documents")
    t = d.select("doc_id", F.concat(F.col("text"), F.lit(" #"), F.col("source"),
                                    F.lit(" #Lang_"), F.col("lang")).alias("text"))
    return _run(spark, st.hashtag_stream(t), "J01").select("doc_id", "tag")


@query("J02")
def j02_urls(spark: SparkSession, sf: str) -> DataFrame:
    p = _stream(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return _run(spark, st.url_stream(p), "J02").select("page_id", "url")


@query("J03")
def j03_emoticons(spark: SparkSession, sf: str) -> DataFrame:
    d = _stream(spark, sf, "documents")
    t = d.select("doc_id", F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, " :)").otherwise(""),
                                    F.when(F.col("doc_id") % 7 == 0, " :(").otherwise("")).alias("text"))
    e = _run(spark, st.emoticon_stream(t), "J03")
    return e.groupBy("emoticon").agg(F.count(F.lit(1)).alias("n"))


@query("J03_tokens")
def j03_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of every document, from a stream."""
    d = _stream(spark, sf, "documents").select("doc_id", "text")
    return _run(spark, st.token_stream(d), "J03_tokens").select("doc_id", "pos", "token")


@query("J04")
def j04_frontier(spark: SparkSession, sf: str) -> DataFrame:
    base = landing_dir(spark, "J04")
    p = _stream(spark, sf, "pages")
    out = st.frontier_batches(p, f"{sf.rstrip('/')}/pages.parquet", f"{base}/frontier", f"{base}/chk")
    # a retried micro-batch may append the same url again: read back distinct
    return spark.read.parquet(out).select("url").distinct()


@query("J05", sql="""
WITH p AS (SELECT date_trunc('day', min(ts)) AS start FROM events),
b AS (SELECT CAST(floor((epoch_us(e.ts) - epoch_us(p.start)) / 604800000000.0) AS BIGINT) AS k, e.event_type AS term
      FROM events e, p)
SELECT strftime((SELECT start FROM p) + k * INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_start, term, count(*) AS count
FROM b GROUP BY k, term
""")
def j05_windowed(spark: SparkSession, sf: str) -> DataFrame:
    # windows anchored at the day-floor of the first event, as the batch twin
    start = table(spark, sf, "events").select(F.unix_seconds(F.date_trunc("DAY", F.min("ts")).cast("timestamp"))).first()[0]
    offset = f"{int(start) % (7 * 86400)} seconds"
    ev = _stream(spark, sf, "events")
    w = st.windowed_counts(ev, "ts", "event_type", 7, offset)
    base = landing_dir(spark, "J05")
    w = w.select(F.col("w.start").alias("window_start"), "term", "count")
    st.run_to_table(w, f"{base}/out", f"{base}/chk", mode="update")
    r = st.latest(spark, f"{base}/out", ["window_start", "term"])
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "term", "count")


def _alias_oracles() -> None:
    from . import text, links  # noqa: F401  (their SQL registers first)
    ORACLE.setdefault("J01", ORACLE["H02"])
    ORACLE.setdefault("J02", ORACLE["H12"])
    ORACLE.setdefault("J03", ORACLE["H07"])
    ORACLE.setdefault("J04", ORACLE["C06"])


_alias_oracles()
