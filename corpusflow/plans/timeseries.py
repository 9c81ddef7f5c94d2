"""Time-series queries on ``events`` and time-stamped documents (E*, D02, D21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import timeseries as ts
from ..operators.ranking import global_rank
from ..sources.tables import table
from .common import labelled_documents, timed_documents
from .registry import query

WEEK_US = 7 * 86_400_000_000
DAY_US = 86_400_000_000


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _r(c, n=6):
    return F.round(c, n)


# Oracle fragment: bin parameters and bin index for fixed-width bins.
def grid_sql(src: str, tscol: str, width_us: int, trunc: str = "day", tail: bool = True) -> str:
    edges = (f"CAST(ceil((epoch_us(date_trunc('{trunc}', max({tscol}))) + {width_us}"
             f" - epoch_us(date_trunc('{trunc}', min({tscol})))) / {width_us}.0) AS BIGINT)")
    if tail:
        edges = (f"greatest({edges}, CAST(floor((epoch_us(max({tscol}))"
                 f" - epoch_us(date_trunc('{trunc}', min({tscol})))) / {width_us}.0) AS BIGINT) + 2)")
    return f"""
p AS (SELECT date_trunc('{trunc}', min({tscol})) AS start, {edges} AS n_edges
      FROM {src})"""


def bin_sql(tscol: str, width_us: int) -> str:
    pos = f"(epoch_us({tscol}) - epoch_us(p.start))"
    return (f"CASE WHEN {pos} = (p.n_edges - 1) * {width_us} THEN p.n_edges - 2 "
            f"WHEN floor({pos} / {width_us}.0) <= p.n_edges - 2 "
            f"THEN CAST(floor({pos} / {width_us}.0) AS BIGINT) END")


# E08 -------------------------------------------------------------------------
@query("E08", sql=f"""
WITH {grid_sql('events', 'ts', DAY_US, tail=False)}
SELECT CAST(i AS BIGINT) AS edge_idx,
       strftime(p.start + i * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS edge
FROM p, range(0, p.n_edges) t(i)
""")
def e08_datespace(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    d = ts.datespace(ev, "ts", 1, "D")
    return d.select("edge_idx", _fmt(F.col("edge")).alias("edge"))


# E07 -------------------------------------------------------------------------
@query("E07_median", sql=f"""
WITH {grid_sql('events', 'ts', WEEK_US)},
r AS (SELECT {bin_sql('e.ts', WEEK_US)} AS bin_idx, e.event_type AS term, e.value AS v FROM events e, p)
SELECT bin_idx, term, round(quantile_cont(v, 0.5), 6) AS median, count(v) AS count FROM r WHERE bin_idx IS NOT NULL GROUP BY bin_idx, term
""")
def e07_median(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly medians by event type."""
    b = ts.binned_statistic(table(spark, sf, "events"), "ts", "event_type", "value", 7, "D", stats=("median", "count"), dense=False)
    return b.select("bin_idx", "term", _r(F.col("median")).alias("median"), "count")


@query("E07", sql=f"""
WITH {grid_sql('events', 'ts', WEEK_US)},
r AS (SELECT {bin_sql('e.ts', WEEK_US)} AS bin_idx, e.event_type AS term, e.value AS v
      FROM events e, p),
g AS (SELECT bin_idx, term, count(v) AS n, sum(v) AS s, avg(v) AS m
      FROM r WHERE bin_idx IS NOT NULL GROUP BY bin_idx, term),
grid AS (SELECT t.term, CAST(i AS BIGINT) AS bin_idx
         FROM (SELECT DISTINCT term FROM r WHERE bin_idx IS NOT NULL) t, p, range(0, p.n_edges - 1) s(i))
SELECT grid.bin_idx,
       strftime(p.start + grid.bin_idx * INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS bin_start,
       grid.term, CAST(coalesce(g.n, 0) AS BIGINT) AS count,
       round(coalesce(g.s, 0), 6) AS sum, round(g.m, 6) AS mean
FROM grid CROSS JOIN p LEFT JOIN g ON grid.bin_idx = g.bin_idx AND grid.term = g.term
""")
def e07_binned(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    b = ts.binned_statistic(ev, "ts", "event_type", "value", 7, "D",
                            stats=("count", "sum", "mean"))
    return b.select("bin_idx", _fmt(F.col("bin_start")).alias("bin_start"), "term",
                    F.col("count").cast("long").alias("count"),
                    _r(F.col("sum")).alias("sum"), _r(F.col("mean")).alias("mean"))


# E01 / E10 -------------------------------------------------------------------
def _daily_counts(spark, sf):
    ev = table(spark, sf, "events")
    return ts.binned_statistic(ev, "ts", "event_type", None, 1, "D", stats=("count",))


_DAILY_SQL = f"""
{grid_sql('events', 'ts', DAY_US)},
r AS (SELECT {bin_sql('e.ts', DAY_US)} AS bin_idx, e.event_type AS term FROM events e, p),
g AS (SELECT bin_idx, term, count(*) AS n FROM r WHERE bin_idx IS NOT NULL GROUP BY bin_idx, term),
grid AS (SELECT t.term, CAST(i AS BIGINT) AS bin_idx
         FROM (SELECT DISTINCT term FROM r WHERE bin_idx IS NOT NULL) t, p, range(0, p.n_edges - 1) s(i)),
d AS (SELECT grid.bin_idx, grid.term, CAST(coalesce(g.n, 0) AS DOUBLE) AS x
      FROM grid LEFT JOIN g ON grid.bin_idx = g.bin_idx AND grid.term = g.term)"""


def _decay_sql(window: int, alpha: float) -> str:
    z = sum(alpha ** k for k in range(window))
    parts = [f"{alpha ** k / z!r} * coalesce(lag(x, {k}) OVER w, first(x) OVER w)" for k in range(window)]
    return " + ".join(parts)


@query("E10", sql=f"""
WITH {_DAILY_SQL}
SELECT bin_idx, term, x AS count, round({_decay_sql(7, 0.5)}, 6) AS smoothed
FROM d WINDOW w AS (PARTITION BY term ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def e10_smooth_days(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily_counts(spark, sf).select("bin_idx", "term", F.col("count").cast("double").alias("count"))
    s = ts.exponential_decay(d, "count", "bin_idx", ["term"], window=7, alpha=0.5)
    return s.select("bin_idx", "term", "count", _r(F.col("smoothed")).alias("smoothed"))


@query("E01", sql=f"""
WITH {_DAILY_SQL}
SELECT bin_idx, term, round({_decay_sql(10, 0.5)}, 6) AS smoothed
FROM d WINDOW w AS (PARTITION BY term ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def e01_decay(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily_counts(spark, sf).select("bin_idx", "term", F.col("count").cast("double").alias("x"))
    s = ts.exponential_decay(d, "x", "bin_idx", ["term"], window=10, alpha=0.5)
    return s.select("bin_idx", "term", _r(F.col("smoothed")).alias("smoothed"))


# E02 / E03 -------------------------------------------------------------------
@query("E02", sql=f"""
WITH {_DAILY_SQL}
SELECT bin_idx, term, round(avg(x) OVER w, 6) AS running_mean
FROM d WINDOW w AS (PARTITION BY term ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def e02_running_mean(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily_counts(spark, sf).select("bin_idx", "term", F.col("count").cast("double").alias("x"))
    s = ts.running_stats(d, "x", "bin_idx", ["term"])
    return s.select("bin_idx", "term", _r(F.col("running_mean")).alias("running_mean"))


@query("E03", sql=f"""
WITH {_DAILY_SQL}
SELECT bin_idx, term, round(var_pop(x) OVER w, 4) AS running_var
FROM d WINDOW w AS (PARTITION BY term ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def e03_running_var(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily_counts(spark, sf).select("bin_idx", "term", F.col("count").cast("double").alias("x"))
    s = ts.running_stats(d, "x", "bin_idx", ["term"])
    return s.select("bin_idx", "term", _r(F.col("running_var"), 4).alias("running_var"))


# E04 -------------------------------------------------------------------------
@query("E04", sql=f"""
WITH {_DAILY_SQL}
SELECT bin_idx, term, round(x / sum(x) OVER (PARTITION BY bin_idx), 6) AS share FROM d
""")
def e04_share(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily_counts(spark, sf).select("bin_idx", "term", F.col("count").cast("double").alias("x"))
    s = ts.share_per_bin(d, "bin_idx", "x")
    return s.select("bin_idx", "term", _r(F.col("share")).alias("share"))


# E11 -------------------------------------------------------------------------
_DOC_TOKENS_SQL = r"""
toks AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS published,
                unnest(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}')) AS term
         FROM documents d)"""


@query("E11", sql=f"""
WITH {_DOC_TOKENS_SQL},
tot AS (SELECT term, count(*) AS n FROM toks GROUP BY term),
sel AS (SELECT term FROM tot ORDER BY n DESC, term LIMIT 10 OFFSET 5),
{grid_sql('toks', 'published', WEEK_US)},
r AS (SELECT {bin_sql('t.published', WEEK_US)} AS bin_idx, t.term FROM toks t JOIN sel ON t.term = sel.term, p),
g AS (SELECT bin_idx, term, count(*) AS n FROM r WHERE bin_idx IS NOT NULL GROUP BY bin_idx, term),
grid AS (SELECT t.term, CAST(i AS BIGINT) AS bin_idx
         FROM (SELECT DISTINCT term FROM r WHERE bin_idx IS NOT NULL) t, p, range(0, p.n_edges - 1) s(i)),
d AS (SELECT grid.bin_idx, grid.term, coalesce(g.n, 0) AS volume
      FROM grid LEFT JOIN g ON grid.bin_idx = g.bin_idx AND grid.term = g.term)
SELECT bin_idx, term, CAST(volume AS BIGINT) AS volume,
       round(volume / sum(volume) OVER (PARTITION BY bin_idx), 6) AS share FROM d
""")
def e11_volume_share(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens are binned and counted per (bin, term) in one pass; the term
    ranking (6th..15th by total, all rows counted) reads that aggregate, so
    the text is tokenized once."""
    from pyspark import StorageLevel
    docs = timed_documents(spark, sf)
    start, n_edges = ts.grid(docs, "published", 7, "D")
    rows = docs.select(ts.bin_index(F.col("published"), start, n_edges, 7, "D").alias("bin_idx"),
                       F.explode(tx.regex_tokens(F.lower("text"), "word2")).alias("term"))
    agg = rows.groupBy("bin_idx", "term").agg(F.count(F.lit(1)).alias("n")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    tot = agg.groupBy("term").agg(F.sum("n").alias("n"))
    # ranks 6..15: distributed top-k (each partition keeps 15 rows)
    sel = tot.orderBy(F.desc("n"), F.asc("term")).offset(5).limit(10).select("term")
    picked = agg.where(F.col("bin_idx").isNotNull()).join(F.broadcast(sel), "term")   # sel: 10 rows
    grid = sel.select("term", F.explode(F.sequence(F.lit(0).cast("long"), (n_edges - 2).cast("long"))).alias("bin_idx"))
    d = grid.join(picked, ["bin_idx", "term"], "left").select(
        "bin_idx", "term", F.coalesce(F.col("n"), F.lit(0)).alias("volume"))
    s = ts.share_per_bin(d, "bin_idx", "volume")
    return s.select("bin_idx", "term", F.col("volume").cast("long").alias("volume"),
                    _r(F.col("share")).alias("share"))


# E05 -------------------------------------------------------------------------
QUOTA = {"user": 150, "assistant": 100}


@query("E05", sql="""
WITH q AS (SELECT * FROM (VALUES ('user', 150), ('assistant', 100)) t(role, needed)),
r AS (SELECT c.conv_id, c.turn, c.role, q.needed,
             row_number() OVER (PARTITION BY c.role ORDER BY c.conv_id, c.turn) AS rn
      FROM conversations c JOIN q ON c.role = q.role)
SELECT conv_id, turn, role, rn FROM r WHERE rn <= needed
""")
def e05_quota(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.sampling import quota
    conv = table(spark, sf, "conversations")
    q = quota(conv, "role", ["conv_id", "turn"], QUOTA)
    return q.select("conv_id", "turn", "role", F.col("rn").cast("long").alias("rn"))


# E06 -------------------------------------------------------------------------
@query("E06", sql="""
SELECT event_id, row_number() OVER (ORDER BY abs(value) DESC, event_id) AS rank FROM events
""")
def e06_argsort(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "value")
    r = global_rank(ev, [F.desc(F.abs(F.col("value"))), F.asc("event_id")])
    return r.select("event_id", F.col("rank").cast("long").alias("rank"))


# E12 -------------------------------------------------------------------------

@query("E12", sql="""
WITH lab AS (SELECT d.doc_id, TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS published
             FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT strftime(min(published), '%Y-%m-%d %H:%M:%S') AS first_labelled,
       strftime(max(published), '%Y-%m-%d %H:%M:%S') AS last_labelled,
       count(*) AS n_labelled FROM lab
""")
def e12_bounds(spark: SparkSession, sf: str) -> DataFrame:
    lab = labelled_documents(spark, sf, inner=True)
    return lab.agg(_fmt(F.min("published")).alias("first_labelled"),
                   _fmt(F.max("published")).alias("last_labelled"),
                   F.count(F.lit(1)).alias("n_labelled"))


#: Dated events to mark on a time axis.
EVENTS = (("opening", "2024-01-03 12:00:00"), ("review", "2024-01-15 00:00:00"), ("second review", "2024-01-17 09:30:00"), ("closing", "2024-02-26 00:00:00"))
_EVENTS_SQL = ", ".join(f"('{m}', TIMESTAMP '{d}')" for m, d in EVENTS)


@query("E12_markers", sql=f"""
WITH lab AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS published FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
{grid_sql('lab', 'published', WEEK_US)},
r AS (SELECT {bin_sql('lab.published', WEEK_US)} AS bin_idx FROM lab, p),
b AS (SELECT CAST(i AS BIGINT) AS bin_idx, p.start + i * INTERVAL 7 DAY AS bin_start,
        (SELECT count(*) FROM r WHERE r.bin_idx = i) AS count FROM p, range(0, p.n_edges - 1) t(i)),
m(marker, date) AS (VALUES {_EVENTS_SQL})
SELECT bin_idx, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start, count, marker, strftime(date, '%Y-%m-%d %H:%M:%S') AS date
FROM b LEFT JOIN m ON m.date >= b.bin_start AND m.date < b.bin_start + INTERVAL 7 DAY
""")
def e12_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents a week, with the events that fall in each week."""
    lab = labelled_documents(spark, sf, inner=True)
    bins = ts.binned_statistic(lab, "published", None, None, 7, "D", stats=("count",)).select("bin_idx", "bin_start", "count")
    marks = spark.createDataFrame(list(EVENTS), "marker string, date string").select("marker", F.col("date").cast("timestamp_ntz").alias("date"))
    found = ts.event_markers(bins, marks, "bin_start", 7)
    return found.select("bin_idx", _fmt(F.col("bin_start")).alias("bin_start"), "count", "marker", _fmt(F.col("date")).alias("date"))


# E13 -------------------------------------------------------------------------
@query("E13", sql=f"""
WITH base AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS published,
         CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' END AS label,
         CASE WHEN (d.doc_id * 37 % 101) / 101.0 >= 0.5 THEN 'high' ELSE 'low' END AS pred
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT published, 'labelled:' || label AS term FROM base WHERE label IS NOT NULL
      UNION ALL SELECT published, 'predicted:' || pred FROM base),
{grid_sql('k', 'published', WEEK_US)},
r AS (SELECT {bin_sql('k.published', WEEK_US)} AS bin_idx, k.term FROM k, p)
SELECT bin_idx, term, count(*) AS count FROM r WHERE bin_idx IS NOT NULL GROUP BY bin_idx, term
""")
def e13_weekly_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled_documents(spark, sf)
    pred = F.when((F.col("doc_id") * 37 % 101) / 101.0 >= 0.5, "high").otherwise("low")
    k = (d.where(F.col("label").isNotNull())
         .select("published", F.concat(F.lit("labelled:"), F.col("label")).alias("term"))
         .unionByName(d.select("published", F.concat(F.lit("predicted:"), pred).alias("term"))))
    b = ts.binned_statistic(k, "published", "term", None, 7, "D", stats=("count",), dense=False)
    return b.select("bin_idx", "term", F.col("count").cast("long").alias("count"))


# D02 -------------------------------------------------------------------------
@query("D02", sql="""
SELECT event_type, min(value) AS min_value, max(value) AS max_value,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS min_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS max_ts
FROM events GROUP BY event_type
""")
def d02_bounds(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("min_ts"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("max_ts"))


# D21 -------------------------------------------------------------------------
@query("D21", sql=f"""
WITH {grid_sql('events', 'ts', WEEK_US)},
r AS (SELECT {bin_sql('e.ts', WEEK_US)} AS bin_idx, e.event_type AS term, e.value AS v FROM events e, p),
g AS (SELECT bin_idx, term, avg(v) AS m FROM r WHERE bin_idx IS NOT NULL GROUP BY bin_idx, term)
SELECT term, round(var_pop(m), 6) AS bin_variance, count(m) AS n_bins FROM g GROUP BY term
""")
def d21_bin_variance(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    b = ts.binned_statistic(ev, "ts", "event_type", "value", 7, "D", stats=("mean",))
    return b.groupBy("term").agg(_r(F.var_pop("mean")).alias("bin_variance"),
                                 F.count("mean").alias("n_bins"))
