"""Sinks and the parameter-keyed result cache.

All writes go under a folder the caller names; on a cluster that is the
shared folder from ``spark.checkpoint.dir`` (see ``landing_dir``), never a
machine-local temp folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


MOST_SOURCES = 1 << 18  # names up to which they are broadcast


def landing_dir(spark: SparkSession, name: str, fresh: bool = True) -> str:
    """A folder below the shared checkpoint folder; a new one per call
    unless ``fresh`` is False."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/landing/{name}/{uuid.uuid4().hex}" if fresh else f"{base}/landing/{name}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: its lineage
    ends there, and all its readings see the same rows, also after an executor
    is lost."""
    path = landing_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def register_documents(docs: DataFrame, root: str, source: str, source_col: str = "source") -> str:
    """Register a source (unique: a second registration fails) and
    append its documents, partitioned by source.  Dynamic partition
    overwrite keeps a retried job idempotent."""
    spark = docs.sparkSession
    target = f"{root.rstrip('/')}/{source_col}={source}"
    if path_exists(spark, target):
        raise ValueError(f"source {source!r} is already registered")
    (docs.withColumn(source_col, F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(source_col).parquet(root))
    return target


def register_sources(docs: DataFrame, root: str, source_col: str = "source") -> DataFrame:
    """A14 for every source of ``docs`` at once, null included: the documents of all sources
    that are not registered yet are written by one job, partitioned by source.  Returns
    (source, registered); False where the source was there before and nothing was written.
    Partition folders have no empty names: an empty source counts as null."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    docs = docs.withColumn(source_col, F.when(F.col(source_col) != "", F.col(source_col)))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != source_col], source_col)
    known = (spark.read.schema(docs.schema).parquet(root) if path_exists(spark, root) else docs.where("false")).select(F.col(source_col).alias("_known")).distinct()
    found = docs.select(source_col).distinct()
    match = F.col(source_col).eqNullSafe(F.col("_known"))
    new = found.join(known, match, "left_anti").withColumn("registered", F.lit(True))
    status = new.unionByName(found.join(known, match, "left_semi").withColumn("registered", F.lit(False))).checkpoint()  # as it was before the write
    chosen = status.where("registered").select(F.col(source_col).alias("_new"))
    chosen = F.broadcast(chosen) if chosen.count() <= MOST_SOURCES else chosen  # the texts need no shuffle then
    (docs.join(chosen, F.col(source_col).eqNullSafe(F.col("_new")), "left_semi")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source_col).parquet(root))
    return status


def write_delimited(rows: list[DataFrame], path: str, sep: str = "\t") -> DataFrame:
    """Stack result rows whose columns may grow (missing -> empty), then
    write one delimited file set with a header; returns the stacked frame."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    cols = []
    for f in out.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if t in ("integer", "long", "short", "byte"):
            c = F.when(c.isNotNull(), F.format_string("%d", c))
        elif t in ("double", "float", "decimal"):
            c = F.when(c.isNotNull(), F.format_string("%.3f", c))
        else:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    s = out.select(*cols)
    s.write.option("sep", sep).option("header", True).mode("overwrite").csv(path)
    return s


def cache_key(name: str, **params) -> str:
    """A stable key from the call arguments."""
    blob = json.dumps(params, sort_keys=True, default=str)
    return f"{name}-{hashlib.sha1(blob.encode()).hexdigest()[:16]}"


def cached(spark: SparkSession, name: str, compute, **params) -> DataFrame:
    """Read the stored result for these parameters if present, else
    compute it, store it as parquet in the shared folder, and read it back."""
    path = landing_dir(spark, "cache", fresh=False) + "/" + cache_key(name, **params)
    if not path_exists(spark, path + "/_SUCCESS"):
        compute(**params).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def row_json(df: DataFrame, cols, ts_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> F.Column:
    """A row as JSON with datetimes formatted like the reference."""
    return F.to_json(F.struct(*cols), {"timestampFormat": ts_format, "timestampNTZFormat": ts_format})


def row_csv(*cols) -> F.Column:
    """A row as a comma-joined line of its string values."""
    return F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
