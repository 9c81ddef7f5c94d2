"""Derived inputs shared by the registered queries (same expressions as
the oracle SQL fragments below)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def labelled_documents(spark: SparkSession, sf: str, inner: bool = False) -> DataFrame:
    """documents left-joined to labels; label 'high'/'low' from quality,
    NULL where no label row exists.  Publish time = 2024-01-01 + doc_id hours."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "inner" if inner else "left")
    return (j.withColumn("label", F.when(F.col("quality") == 1, "high")
                         .when(F.col("quality") == 0, "low"))
            .withColumn("published", F.timestamp_add("HOUR", F.col("doc_id"),
                                                     F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))))


def timed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents with the derived publish time, without the labels join
    (for queries that never read a label)."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return d.withColumn("published", F.timestamp_add("HOUR", F.col("doc_id"),
                                                     F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))


# SQL fragments (DuckDB dialect) mirroring the builders above.
LABELLED_SQL = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
       CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' END AS label,
       TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS published
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

def key_sql(id_col: str, seed: int | str, salt: int | str = 0) -> str:
    """DuckDB form of ``operators.sampling.portable_hash``."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {id_col}, {seed}, {salt})), 1, 15) AS BIGINT)"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic stand-in classifier output over labelled documents:
    score = (doc_id * 37 mod 101) / 101, p_high = logistic(6 * score - 3),
    pred = 'high' when p_high >= 0.5; gold from labels.quality."""
    lab = labelled_documents(spark, sf, inner=True)
    score = (F.col("doc_id") * 37 % 101) / 101.0
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(score * 6 - 3)))
    return lab.select("doc_id", "source", "lang", F.col("label").alias("gold"), score.alias("score"),
                      p.alias("p_high"), F.when(score >= 0.5, "high").otherwise("low").alias("pred"))


PRED_SQL = """
SELECT d.doc_id, d.source, d.lang, CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS gold,
       (d.doc_id * 37 % 101) / 101.0 AS score,
       1.0 / (1.0 + exp(-(((d.doc_id * 37 % 101) / 101.0) * 6 - 3))) AS p_high,
       CASE WHEN (d.doc_id * 37 % 101) / 101.0 >= 0.5 THEN 'high' ELSE 'low' END AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
