"""Sorts, ranks and top-k (E06, F01-F08, D15 ranks).

A global ``row_number()`` without ``partitionBy`` moves every row into one
task.  ``global_rank`` instead range-partitions and sorts (``orderBy``), reads
each row's position inside its partition from
``monotonically_increasing_id`` (partition index in the upper bits, position
in the lower 33), and adds the row count of all earlier partitions.  Only the
per-partition counts (one row per partition) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage

_POS_BITS = 33


def _order(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_rank(df: DataFrame, order_cols, out: str = "rank", start: int = 1) -> DataFrame:
    """Consecutive ranks in the given total order (include a unique key so
    that ties, and therefore recomputation after a lost executor, are
    deterministic).

    The sorted rows are checkpointed: positions and partition counts are two
    readings of them, and only a reliable copy makes both see the same
    partitions, whatever caches are released in between."""
    s = cut_lineage(df.orderBy(*_order(order_cols))
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, ordered in a single task
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _POS_BITS)
    return (s.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(out, F.col("_off") + local + F.lit(start))
            .drop("_pid", "_mid", "_off"))


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, out: str = "rank") -> DataFrame:
    """first k rows per group.  ``row_number() <= k`` is planned as a
    partial window group limit before the shuffle, so a hot group sends at
    most k rows per input partition."""
    w = Window.partitionBy(*group_cols).orderBy(*_order(order_cols))
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def margins(ranked: DataFrame, n: int, rank_col: str = "rank", total: Column | None = None,
            which: str = "edges") -> DataFrame:
    """head / tail / median / edges / edges+median selections over a
    1-based rank column; ``total`` is the row count (scalar subquery)."""
    r = F.col(rank_col) - 1  # 0-based index as in the reference
    if total is None:
        total = ranked.select(F.count(F.lit(1))).scalar()
    head = r < n
    tail = r >= total - n
    mid = F.floor(total / 2)
    med = (r >= mid - n // 2) & (r <= mid + n // 2)
    cond = {"head": head, "tail": tail, "median": med, "edges": head | tail,
            "edges_median": head | tail | med}[which]
    return ranked.where(cond)


def which_min(df: DataFrame, value: str, pos: str, keys=()) -> DataFrame:
    """position of the smallest value, first position on ties."""
    agg = F.min_by(F.col(pos), F.struct(F.col(value), F.col(pos))).alias("which_min")
    return df.groupBy(*keys).agg(agg)


def which_max(df: DataFrame, value: str, pos: str, keys=()) -> DataFrame:
    """position of the largest value, first position on ties."""
    agg = F.max_by(F.col(pos), F.struct(F.col(value), -F.col(pos))).alias("which_max")
    return df.groupBy(*keys).agg(agg)


def offset_limit(df: DataFrame, order_cols, offset: int, limit: int) -> DataFrame:
    """skip ``offset`` rows of the order, take ``limit``."""
    return df.orderBy(*_order(order_cols)).offset(offset).limit(limit)


def group_rank(df: DataFrame, group_cols, order_cols, out: str = "rn") -> DataFrame:
    """1-based rank inside each group for limits that are not one literal
    (per-key quotas, class-size-dependent samples).

    ``orderBy(group..., order...)`` range-partitions the rows, so a group
    holding a third of the data is spread over many tasks; the rank inside
    the group is the global rank minus the group's first global rank (one
    partial-aggregated row per group, joined back)."""
    group_cols = list(group_cols)
    r = global_rank(df, [*group_cols, *order_cols], out="_g")
    first = r.groupBy(*group_cols).agg(F.min("_g").alias("_g0"))
    first = first.select(*[F.col(c).alias(f"_k_{c}") for c in group_cols], "_g0")
    cond = [r[c].eqNullSafe(first[f"_k_{c}"]) for c in group_cols]
    j = r.join(first, cond)
    return (j.withColumn(out, F.col("_g") - F.col("_g0") + 1)
            .drop("_g", "_g0", *[f"_k_{c}" for c in group_cols]))
