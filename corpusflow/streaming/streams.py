"""Structured Streaming operators.

The reference's unbounded inputs are line filters on stdin and a polled
frontier queue.  Here they are file streams: ``readStream`` over a folder or
glob, the same column functions as the batch twins, and checkpointed sinks
in the shared folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import links as lk
from ..sources.sinks import path_exists


def stream_table(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def hashtag_stream(lines: DataFrame, text_col: str = "text", keys=("doc_id",)) -> DataFrame:
    """One output row per hashtag per line (append mode)."""
    return lines.select(*keys, F.explode(tx.hashtags(F.col(text_col))).alias("tag"))


def url_stream(lines: DataFrame, text_col: str = "text", keys=("page_id",)) -> DataFrame:
    """One output row per extracted URL."""
    return lines.select(*keys, F.explode(tx.extract_urls(F.col(text_col))).alias("url"))


def token_stream(lines: DataFrame, text_col: str = "text", keys=("doc_id",)) -> DataFrame:
    """Social tokens per line."""
    return lines.select(*keys, F.posexplode(tx.social_tokens(F.col(text_col))).alias("pos", "token"))


def emoticon_stream(lines: DataFrame, text_col: str = "text", keys=("doc_id",)) -> DataFrame:
    """Emoticons per line."""
    return lines.select(*keys, F.explode(tx.emoticons(F.col(text_col))).alias("emoticon"))


def windowed_counts(events: DataFrame, ts_col: str, term_col: str, days: int = 7,
                    start_offset: str = "0 seconds", watermark: str = "1 day") -> DataFrame:
    """Tumbling counts per term with a watermark; rows later than the
    watermark are dropped.  The event time is cast to TIMESTAMP first
    (watermarks refuse TIMESTAMP_NTZ)."""
    ev = events.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
    w = F.window("_ts", f"{days} days", f"{days} days", start_offset)
    return ev.groupBy(w.alias("w"), F.col(term_col).alias("term")).agg(F.count(F.lit(1)).alias("count"))


def run_to_table(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> str:
    """Run a streaming query over everything available now into parquet.

    ``append``: rows are final when emitted.  ``update`` (aggregations):
    every micro-batch appends only the groups it changed, tagged with its
    batch id; ``latest`` reads back the last version of each group, so no
    batch rewrites the whole result."""
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    else:
        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_batch", F.lit(epoch)).write.mode("append").parquet(out_path)
        q = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def latest(spark: SparkSession, path: str, keys) -> DataFrame:
    """Last version of each group written by ``run_to_table(mode='update')``."""
    df = spark.read.parquet(path)
    vals = [c for c in df.columns if c not in set(keys) | {"_batch"}]
    agg = [F.max_by(F.col(c), F.col("_batch")).alias(c) for c in vals]
    return df.groupBy(*keys).agg(*agg)


def frontier_batches(pages_stream: DataFrame, known_path: str, out_path: str, checkpoint: str) -> str:
    """Each micro-batch of fetched pages discovers links (H12-style
    hrefs), drops those already known (A15: anti-join on url, dedupe), and
    appends the new frontier rows; the known set grows with every batch."""
    spark = pages_stream.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        cand = lk.discovered_links(batch)
        known = spark.read.parquet(known_path).select("url")
        if path_exists(spark, f"{out_path}/_SUCCESS"):     # not before the first batch
            known = known.unionByName(spark.read.parquet(out_path).select("url"))
        new = cand.groupBy("url").agg(F.min("page_id").alias("parent_id")) \
            .join(known, "url", "left_anti").withColumn("batch", F.lit(epoch))
        new.write.mode("append").parquet(out_path)

    q = (pages_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
