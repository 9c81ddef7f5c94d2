"""Seeded samplers and splits.

Every sampler orders rows by a hash of (id, seed), so results are
reproducible and independent of partitioning.  ``portable_hash`` is an md5
prefix that DuckDB evaluates identically, so seeds and splits give
independent orders for any number of rows; ``portable=False`` takes the
cheaper ``xxhash64``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank, group_rank


def portable_hash(id_: Column, seed: Column | int, salt: Column | int = 0) -> Column:
    """First 60 bits of md5('id|seed|salt') as a long."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in (id_, seed, salt)]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample_key(id_col: str, seed: int, portable: bool = True, salt: int = 0) -> Column:
    if portable:
        return portable_hash(F.col(id_col), seed, salt)
    return F.xxhash64(F.col(id_col), F.lit(seed), F.lit(salt))


def quota(df: DataFrame, key_col: str, seq_cols, needed: dict[str, int]) -> DataFrame:
    """The first ``needed[key]`` rows per key in arrival order; keys not
    listed get none.  Output adds ``rn`` (position inside the key)."""
    q = df.sparkSession.createDataFrame(list(needed.items()), f"{key_col} string, _needed long")
    kept = df.join(F.broadcast(q), key_col)          # quota table: one row per listed key
    r = group_rank(kept, [key_col], list(seq_cols))
    return r.where(F.col("rn") <= F.col("_needed")).drop("_needed")


def kfold(df: DataFrame, id_col: str, k: int = 10, seed: int = 0, portable: bool = True) -> DataFrame:
    """Shuffled k-fold assignment."""
    return df.withColumn("fold", F.pmod(sample_key(id_col, seed, portable), F.lit(k)).cast("int"))


def balance(df: DataFrame, label_col: str, id_col: str, seed: int = 0, per_class: int | None = None,
            portable: bool = True) -> DataFrame:
    """Down-sample every class without replacement to the
    smallest class size (or to ``per_class``), in hash order."""
    keyed = df.withColumn("_h", sample_key(id_col, seed, portable))
    r = group_rank(keyed, [label_col], ["_h", id_col])
    if per_class is None:
        smallest = df.groupBy(label_col).count().select(F.min("count")).scalar()
        limit = smallest
    else:
        limit = F.lit(per_class)
    return r.where(F.col("rn") <= limit).drop("_h")


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_size: float = 0.1,
                     n_iter: int = 1, seed: int = 0, portable: bool = True) -> DataFrame:
    """Per split and class, ceil(test_size * n_class) rows (or
    ``test_size`` rows when an int) go to test, the rest to train, chosen in
    hash order of (id, seed, split).  Output: split, id, label, is_test."""
    # every row appears once per split (n_iter is a small parameter)
    rows = df.select(id_col, label_col, F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(n_iter - 1).cast("long"))).alias("split"))
    rows = rows.withColumn("_h", portable_hash(F.col(id_col), seed, F.col("split"))
                           if portable else F.xxhash64(id_col, F.lit(seed), "split"))
    r = group_rank(rows, ["split", label_col], ["_h", id_col])
    sizes = rows.groupBy("split", label_col).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(sizes, ["split", label_col])
    n_test = (F.ceil(F.lit(float(test_size)) * F.col("_n")) if isinstance(test_size, float)
              else F.least(F.lit(test_size), F.col("_n")))
    return r.withColumn("is_test", F.col("rn") <= n_test).drop("_h", "_n", "rn")


def bootstrap_weights(df: DataFrame, id_col: str, n_iter: int = 100, proportion: float = 1.0,
                      seed: int = 0, portable: bool = True) -> DataFrame:
    """Per replicate, int(n * proportion) draws with replacement; the
    result is (replicate, id, weight = times drawn).  Draws come from a
    distributed ``range`` over n_iter * size (replicate = id div size) and
    are matched to rows by a 0-based rank, so every replicate has exactly
    the stated size and no task generates more than its range slice."""
    spark = df.sparkSession
    n = df.count()                                   # scalar on the driver
    size = int(n * proportion)
    ranked = global_rank(df.select(id_col), [id_col], out="_idx", start=0)
    draws = spark.range(0, n_iter * size).select(
        (F.col("id") / F.lit(max(size, 1))).cast("long").alias("replicate"),
        (F.col("id") % F.lit(max(size, 1))).alias("draw"))
    h = (portable_hash(F.col("replicate"), F.col("draw"), seed) if portable
         else F.xxhash64("replicate", "draw", F.lit(seed)))
    draws = draws.withColumn("_idx", F.pmod(h, F.lit(max(n, 1))))
    # partial count per (replicate, row index) before the join: the join then
    # carries at most one row per drawn (replicate, row)
    w = draws.groupBy("replicate", "_idx").agg(F.count(F.lit(1)).alias("weight"))
    return w.join(ranked, "_idx").select("replicate", id_col, "weight")
