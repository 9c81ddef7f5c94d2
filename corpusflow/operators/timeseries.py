"""Binning, smoothing and running statistics.

Time bins are computed arithmetically from the data's bounds, which one small
aggregate reads beforehand and which enter the plan as two literals, so
binning is a narrow projection followed by one
``groupBy(bin, term)`` with map-side partial aggregation.  Per-term windows
(smoothing, running statistics) run over the *binned* series, whose length
is the number of bins, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranking import group_rank

# unit -> (date_trunc field, microseconds per unit or None for calendar units)
_UNITS = {
    "s": ("SECOND", 1_000_000),
    "m": ("MINUTE", 60_000_000),
    "h": ("HOUR", 3_600_000_000),
    "D": ("DAY", 86_400_000_000),
    "M": ("MONTH", None),
    "Y": ("YEAR", None),
}


def _floor(ts: Column, unit: str) -> Column:
    return F.date_trunc(_UNITS[unit][0], ts).cast("timestamp_ntz")


def _diff_us(start: Column, ts: Column) -> Column:
    """Microseconds from start to ts on the wall clock (TIMESTAMP_NTZ
    arithmetic: no session time zone, no DST shifts)."""
    return F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _months(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def grid_params(df: DataFrame, ts_col: str, num: int = 1, unit: str = "D",
                include_tail: bool = True) -> DataFrame:
    """E08 as one row: start, number of edges, number of bins.

    start = unit-floor(min); end = unit-floor(max) + step, plus one more step
    when max lies beyond it; edges run from start to end, end excluded.
    ``include_tail`` adds an edge where the last one does not lie behind
    every row, so that the bins cover them all.  An empty table gives NULLs."""
    ts = F.col(ts_col).cast("timestamp_ntz")
    b = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    start, fmax = _floor(F.col("lo"), unit), _floor(F.col("hi"), unit)
    step = _UNITS[unit][1]
    if step is not None:
        width = step * num
        span = _diff_us(start, fmax) + F.lit(width)
        beyond = _diff_us(fmax, F.col("hi")) > F.lit(width)
        last = F.floor(_diff_us(start, F.col("hi")) / F.lit(width))
    else:
        width = num * (12 if unit == "Y" else 1)
        span = _months(fmax) + F.lit(width) - _months(start)
        beyond = F.col("hi") > F.add_months(fmax, width).cast("timestamp_ntz")
        last = F.floor((_months(F.col("hi")) - _months(start)) / F.lit(width))
    n_edges = (F.ceil(span / F.lit(width)) + F.when(beyond, 1).otherwise(0)).cast("long")
    if include_tail:
        n_edges = F.greatest(n_edges, last.cast("long") + 2)
    return b.select(start.alias("start"), n_edges.alias("n_edges"),
                    F.greatest(n_edges - 1, F.lit(0)).alias("n_bins"))


def grid(df: DataFrame, ts_col: str, num: int = 1, unit: str = "D",
         include_tail: bool = True) -> tuple[Column, Column]:
    """Start and number of edges as literals, read by one aggregate: scalar
    subqueries would be repeated in every expression that uses them."""
    p = grid_params(df, ts_col, num, unit, include_tail).select(F.col("start").cast("string"), "n_edges").first()
    return F.lit(p["start"]).cast("timestamp_ntz"), F.lit(p["n_edges"]).cast("long")


def bin_index(ts: Column, start: Column, n_edges: Column, num: int, unit: str) -> Column:
    """Index of the half-open bin holding ts; a row exactly on the last edge
    joins the last bin (closed right end); later rows get NULL (dropped)."""
    step = _UNITS[unit][1]
    if step is not None:
        width = step * num
        pos = _diff_us(start, ts)
        idx = F.floor(pos / F.lit(width))
        on_last = pos == (n_edges - 1) * F.lit(width)
    else:
        width = num * (12 if unit == "Y" else 1)
        m = _months(ts) - _months(start)
        idx = F.floor(m / F.lit(width))
        edge_ts = F.add_months(start, ((n_edges - 1) * width).cast("int")).cast("timestamp_ntz")
        on_last = ts == edge_ts
    idx = F.when(on_last, n_edges - 2).otherwise(idx).cast("long")
    return F.when((idx >= 0) & (idx <= n_edges - 2), idx)


def edge_at(start: Column, idx: Column, num: int, unit: str) -> Column:
    step = _UNITS[unit][1]
    if step is not None:
        return F.timestamp_add("MICROSECOND", idx * F.lit(step * num), start)
    width = num * (12 if unit == "Y" else 1)
    return F.add_months(start, (idx * width).cast("int")).cast("timestamp_ntz")


def datespace(df: DataFrame, ts_col: str, num: int = 1, unit: str = "D") -> DataFrame:
    """The edge grid as rows (edge_idx, edge)."""
    p = grid_params(df, ts_col, num, unit, include_tail=False)
    return (p.select("start", F.explode(F.sequence(F.lit(0).cast("long"),
                                                    F.col("n_edges") - 1)).alias("edge_idx"))
            .select("edge_idx", edge_at(F.col("start"), F.col("edge_idx"), num, unit).alias("edge")))


DAY_US = 24 * 3600 * 1_000_000

_STATS = {
    "mean": lambda v: F.avg(v),
    "sum": lambda v: F.sum(v),
    "count": lambda v: F.count(v),
}


def group_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., median): the mean of the one or two middle values of each
    group, picked by a distributed rank, so a group of any size spreads over
    tasks.  Nulls are left out."""
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = group_rank(known, keys, [value], out="_rn")
    cond = [ranked[k].eqNullSafe(sizes[k]) for k in keys]
    middle = (F.col("_rn") >= F.floor((F.col("_n") + 1) / 2)) & (F.col("_rn") <= F.floor(F.col("_n") / 2) + 1)
    return ranked.join(sizes, cond).where(middle).select(*[ranked[k] for k in keys], value).groupBy(*keys).agg(F.avg(value).alias("median"))


def binned_statistic(df: DataFrame, ts_col: str, term_col: str | None, value_col: str | None,
                     num: int = 1, unit: str = "D", stats=("mean",),
                     include_tail: bool = True, dense: bool = True) -> DataFrame:
    """Statistic per (bin, term) over bins of ``num`` x ``unit``.

    Returns (bin_idx, bin_start, term, <stat>...).  With ``dense`` every
    (bin, term) pair appears; empty bins give sum 0, count 0 and NULL
    mean/median.  Bins are anchored at the unit-floor of the minimum and cover
    every row; ``include_tail=False`` drops rows behind the last edge of E08."""
    start, n_edges = grid(df, ts_col, num, unit, include_tail)
    ts = F.col(ts_col).cast("timestamp_ntz")
    term = F.col(term_col) if term_col else F.lit("*")
    val = F.col(value_col).cast("double") if value_col else F.lit(1.0)
    rows = df.select(bin_index(ts, start, n_edges, num, unit).alias("bin_idx"),
                     term.alias("term"), val.alias("v")).where(F.col("bin_idx").isNotNull())
    aggs = [_STATS[s](F.col("v")).alias(s) if s in _STATS else s(F.col("v"))
            for s in stats if s != "median"]
    g = rows.groupBy("bin_idx", "term").agg(*aggs) if aggs else rows.select("bin_idx", "term").distinct()
    if "median" in stats:
        m = group_medians(rows, ["bin_idx", "term"], "v").select(F.col("bin_idx").alias("_bin"), F.col("term").alias("_term"), "median")
        g = g.join(m, (g["bin_idx"] == m["_bin"]) & g["term"].eqNullSafe(m["_term"]), "left").drop("_bin", "_term")
    if dense:
        # distinct terms x bin indices, generated by explode (bins are
        # bounded by the time span, not by the data volume)
        terms = rows.select("term").distinct()
        cells = terms.select("term", F.explode(F.sequence(
            F.lit(0).cast("long"), (n_edges - 2).cast("long"))).alias("bin_idx"))
        g = cells.join(g, ["bin_idx", "term"], "left")
        for s in stats:
            if s in ("sum", "count"):
                g = g.withColumn(s, F.coalesce(F.col(s), F.lit(0)))
    return g.withColumn("bin_start", edge_at(start, F.col("bin_idx"), num, unit))


def exponential_decay(df: DataFrame, value_col: str, order_col: str, part_cols=(),
                      window: int = 10, alpha: float = 0.5, out: str = "smoothed") -> Column:
    """sum_k w_k * a[max(i-k, 0)] with w_k = alpha^k / sum(alpha^j),
    k < window: newest heaviest, left edge padded with the first value."""
    w = Window.partitionBy(*part_cols).orderBy(order_col)
    z = sum(alpha ** k for k in range(window))
    first = F.first(F.col(value_col)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    terms = [F.lit(alpha ** k / z) * F.coalesce(F.lag(value_col, k).over(w), first)
             for k in range(window)]
    expr = terms[0]
    for t in terms[1:]:
        expr = expr + t
    return df.withColumn(out, expr)


def running_stats(df: DataFrame, value_col: str, order_col: str, part_cols=()) -> DataFrame:
    """Running mean and running population variance."""
    w = Window.partitionBy(*part_cols).orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value_col).cast("double")
    return (df.withColumn("running_mean", F.avg(v).over(w))
            .withColumn("running_var", F.var_pop(v).over(w)))


def share_per_bin(df: DataFrame, bin_col: str, value_col: str, out: str = "share") -> DataFrame:
    """Value / bin total.  Totals are one partial-aggregated row per bin
    joined back (a bin holding many terms never becomes one window task)."""
    tot = df.groupBy(bin_col).agg(F.sum(value_col).alias("_tot"))
    return (df.join(tot, bin_col)
            .withColumn(out, F.try_divide(F.col(value_col).cast("double"), F.col("_tot")))
            .drop("_tot"))


def event_markers(bins: DataFrame, markers: DataFrame, start_col: str = "bin_start",
                  width_days: int = 7) -> DataFrame:
    """E12 markers: the bins with the markers (marker, date) that fall in them.

    An interval join by equal keys: a bin of ``width_days`` days begins in one
    of the two cells of that width, counted from the epoch, that a marker of
    it can lie in, so each marker is looked up in its own cell and the one
    before, and the bounds are checked there."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    cell = lambda t: F.floor(F.timestamp_diff("MICROSECOND", epoch, t.cast("timestamp_ntz")) / (width_days * DAY_US)).cast("long")
    left = bins.withColumn("_cell", cell(F.col(start_col)))
    right = markers.select("marker", "date", F.explode(F.array(cell(F.col("date")), cell(F.col("date")) - 1)).alias("_cell"))
    inside = (right["date"] >= left[start_col]) & (right["date"] < F.timestamp_add("DAY", F.lit(width_days), left[start_col]))
    return left.join(right, (left["_cell"] == right["_cell"]) & inside, "left").drop("_cell")
