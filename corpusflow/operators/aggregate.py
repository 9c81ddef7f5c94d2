"""Grouped summaries and evaluation metrics.

Everything here is a grouped aggregate with map-side partial aggregation,
plus scalar subqueries for corpus-wide constants.  Exact percentiles use
``percentile`` (linear interpolation, parity with the reference); above
~10^8 values per group, ``percentile_approx`` is the scalable choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranking import global_rank

EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hmean(x) -> Column:
    """D09 aggregate: harmonic mean, NULL (NaN in the reference) when any
    value is <= 0."""
    v = _c(x).cast("double")
    return F.when(F.min(v) > 0, F.count(v) / F.sum(F.try_divide(F.lit(1.0), v)))


def hmean_row(*xs) -> Column:
    """D09 over the columns of one row (e.g. class probabilities)."""
    cols = [_c(x).cast("double") for x in xs]
    pos = cols[0] > 0
    for c in cols[1:]:
        pos = pos & (c > 0)
    inv = cols[0] ** -1
    for c in cols[1:]:
        inv = inv + c ** -1
    return F.when(pos, F.lit(float(len(cols))) / inv)


def normalise(df: DataFrame, value_col: str, out: str = "dist") -> DataFrame:
    """Value / total (total as a scalar subquery)."""
    tot = df.select(F.sum(value_col)).scalar()
    return df.withColumn(out, F.col(value_col) / tot)


def exact_quantiles(df: DataFrame, value_col: str, qs) -> DataFrame:
    """Exact quantiles with linear interpolation (as ``percentile``) from
    order statistics: a distributed rank picks the rows at floor and ceil of
    (n - 1) q, so no task holds more than its range partition.  Returns one
    row with an array ``v`` aligned with ``qs``."""
    v = df.select(F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n = v.select(F.count(F.lit(1))).scalar()
    r = global_rank(v, ["_v"], out="_r", start=0)
    hs = [(n - 1) * F.lit(float(q)) for q in qs]
    wanted = None
    for h in hs:
        c = (F.col("_r") == F.floor(h)) | (F.col("_r") == F.ceil(h))
        wanted = c if wanted is None else wanted | c
    picked = r.where(wanted)
    vals = []
    for h in hs:
        lo = F.max(F.when(F.col("_r") == F.floor(h), F.col("_v")))
        hi = F.max(F.when(F.col("_r") == F.ceil(h), F.col("_v")))
        vals.append(lo + (h - F.floor(h)) * (hi - lo))
    return picked.agg(F.array(*vals).alias("v"))


def per_author(df: DataFrame, author: Column, q: float = 0.99) -> DataFrame:
    """Documents per author; mean; exact q-percentile (linear);
    mean over authors strictly below it; number of authors excluded."""
    per = df.groupBy(author.alias("author")).agg(F.count(F.lit(1)).alias("n"))
    # the rank uses partition positions (non-deterministic for the analyser),
    # so the single number comes back as a literal
    p = F.lit(exact_quantiles(per, "n", [q]).first()["v"][0])
    return per.agg(F.avg("n").alias("mean_docs"), F.first(p).alias("p99"),
                   F.avg(F.when(F.col("n") < p, F.col("n"))).alias("mean_below"),
                   F.count_if(F.col("n") >= p).alias("n_excluded"),
                   F.count(F.lit(1)).alias("n_authors"))


def upper_median_and_mean(df: DataFrame, value_col: str) -> DataFrame:
    """Mean and the element at index n // 2 of the sorted values (not
    interpolated).  The sorted position comes from a distributed rank."""
    n = df.select(F.count(F.lit(1))).scalar()
    r = global_rank(df.select(value_col), [value_col], out="_r", start=0)
    med = r.where(F.col("_r") == F.floor(n / 2)).select(F.max(value_col)).scalar()
    return df.agg(F.avg(value_col).alias("mean")).select("mean", med.alias("median"))


def baseline_improvement(counts: DataFrame, accuracy: Column) -> DataFrame:
    """Majority baseline = max count / total; improvement =
    1 - (1 - acc) / (1 - baseline)."""
    b = counts.agg((F.max("n") / F.sum("n")).alias("baseline"))
    return b.select("baseline", accuracy.alias("accuracy"),
                    (F.lit(1.0) - (F.lit(1.0) - accuracy) / (F.lit(1.0) - F.col("baseline"))).alias("improvement"))


def confusion(df: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """True classes as rows, predicted classes as columns."""
    return df.groupBy(gold).pivot(pred, classes).count().na.fill(0, subset=classes)


def class_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class plus overall
    accuracy; 0 where a denominator is 0.  One (gold, pred) aggregate; the
    per-class step reads that small table."""
    cells = df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))
    g = cells.select(F.col(gold).alias("cls"), F.col("n").alias("support_part"),
                     (F.col(gold) == F.col(pred)).alias("hit"), F.lit("g").alias("side"))
    p = cells.select(F.col(pred).alias("cls"), F.col("n").alias("support_part"),
                     (F.col(gold) == F.col(pred)).alias("hit"), F.lit("p").alias("side"))
    u = g.unionByName(p)
    per = u.groupBy("cls").agg(
        F.sum(F.when((F.col("side") == "g") & F.col("hit"), F.col("support_part")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "g", F.col("support_part")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("support_part")).otherwise(0)).alias("predicted"))
    acc = cells.select((F.sum(F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0))
                        / F.sum("n")).alias("a")).scalar()
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return (per.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)
            .withColumn("accuracy", acc).select("cls", "precision", "recall", "f1", "support", "accuracy"))


def log_loss(p_true: Column) -> Column:
    """Mean of -ln(p of the true class), probabilities clipped to
    [eps, 1 - eps]."""
    p = F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-F.log(p))


def binned_accuracy(df: DataFrame, score: str, correct: Column, key: str, n_bins: int = 10) -> DataFrame:
    """Rank rows by score; bin = floor(n_bins * (rank - 1) / n)
    (not ntile); per bin N, mean score and accuracy."""
    n = df.select(F.count(F.lit(1))).scalar()
    r = global_rank(df.withColumn("_ok", correct.cast("double")), [score, key], out="_r")
    b = r.withColumn("bin", F.floor(F.lit(n_bins) * (F.col("_r") - 1) / n).cast("long"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                                F.avg("_ok").alias("accuracy"))


def quartile_accuracy(df: DataFrame, score: str, correct: Column) -> DataFrame:
    """Quartile bin = number of edges (0, .25, .5, .75 percentiles)
    <= score; accuracy per bin and for extreme (1, 4) vs middle (2, 3)."""
    edges = exact_quantiles(df, score, [0.0, 0.25, 0.5, 0.75]).first()["v"]   # four numbers
    below = [F.when(F.lit(edges[i]) <= F.col(score), 1).otherwise(0) for i in range(4)]
    q = df.withColumn("_ok", correct.cast("double")).withColumn(
        "quartile", (below[0] + below[1] + below[2] + below[3]).cast("long"))
    per = q.groupBy(F.concat(F.lit("q"), F.col("quartile")).alias("grp")) \
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("accuracy"))
    side = q.groupBy(F.when(F.col("quartile").isin(1, 4), "extreme").otherwise("middle").alias("grp")) \
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("accuracy"))
    return per.unionByName(side)


def histogram(df: DataFrame, value_col: str, bins: int = 10, lo=None, hi=None) -> DataFrame:
    """Equal-width histogram over [lo, hi] (data range by default); the
    last bin is closed; values outside a fixed range are not counted."""
    v = F.col(value_col).cast("double")
    if lo is None or hi is None:
        lo, hi = df.agg(F.min(v), F.max(v)).first()   # two numbers, NULL on an empty table
    lo_c, hi_c = F.lit(lo).cast("double"), F.lit(hi).cast("double")
    width = (hi_c - lo_c) / F.lit(bins)
    idx = F.when(v == hi_c, F.lit(bins - 1)).otherwise(F.floor((v - lo_c) / width)).cast("long")
    h = df.select(idx.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < bins)) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("left", lo_c + F.col("bin") * width)


def quantiles(df: DataFrame, value_col: str, qs=(0, .05, .10, .50, .90, .95, 1.0)) -> DataFrame:
    """Exact quantiles (linear interpolation) as rows (q, value)."""
    arr = exact_quantiles(df, value_col, list(qs))
    return arr.select(F.posexplode("v").alias("i", "value")) \
        .withColumn("q", F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1)) \
        .select("q", "value")


def coef_summary(coefs: DataFrame, term: str = "term", coef: str = "coef") -> DataFrame:
    """Per term mean, population variance, share exactly 0."""
    c = F.col(coef).cast("double")
    return coefs.groupBy(term).agg(F.avg(c).alias("mean"), F.var_pop(c).alias("var"),
                                   F.avg((c == 0).cast("double")).alias("zero_share"))


def certainty(p: Column) -> Column:
    """1 - 2 * hmean(p, 1 - p); equals (2p - 1)^2 for two classes."""
    return F.lit(1.0) - F.lit(2.0) * F.coalesce(hmean_row(p, F.lit(1.0) - p), F.lit(0.0))


def topic_totals(dist: DataFrame, doc: str, topic: str, ratio: str) -> DataFrame:
    """Per topic the sum of ratios and how often it ranks first and
    second inside a document (a document holds a bounded number of topics)."""
    w = Window.partitionBy(doc).orderBy(F.desc(ratio), F.asc(topic))
    r = dist.withColumn("_rn", F.row_number().over(w))
    return r.groupBy(topic).agg(F.sum(ratio).alias("total"),
                                F.count_if(F.col("_rn") == 1).alias("first"),
                                F.count_if(F.col("_rn") == 2).alias("second"))


def opinion_index(df: DataFrame, region: str, for_: Column, against: Column) -> DataFrame:
    """(For - Against) / Total per region (NULL when Total = 0) with
    linear and log size weights mapping [0.5, max] -> [0, 1]."""
    g = df.groupBy(region).agg(F.count_if(for_).alias("n_for"), F.count_if(against).alias("n_against"),
                               F.count(F.lit(1)).alias("total"))
    mx = g.select(F.max("total")).scalar()
    return (g.withColumn("opinion", F.when(F.col("total") > 0,
                                           (F.col("n_for") - F.col("n_against")) / F.col("total")))
            .withColumn("linear_weight", (F.col("total") - 0.5) / (mx - 0.5))
            .withColumn("log_weight", F.log(F.col("total") / 0.5) / F.log(mx / 0.5)))
