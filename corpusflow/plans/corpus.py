"""Corpus scans, filters, joins, set operations and sorts (A01/A02/A22,
B*, C01/C04/C07/C08, D01/D03/D27, F01/F02/F04-F08, G*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as cp
from ..operators.ranking import global_rank, margins, which_max, which_min, offset_limit
from ..sources.tables import table
from .common import labelled_documents, timed_documents, LABELLED_SQL
from .registry import query

W2 = r"'[\p{L}\p{N}_]{2,}'"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# A01 ---------------------------------------------------------------------------
@query("A01", sql=f"""
WITH c AS ({LABELLED_SQL})
SELECT doc_id, label, source, strftime(published, '%Y-%m-%d %H:%M:%S') AS published
FROM c WHERE source = 'src3' AND label IS NOT NULL
""")
def a01_named_scan(spark: SparkSession, sf: str) -> DataFrame:
    c = cp.named_corpus(labelled_documents(spark, sf), "src3", labeled_only=True, sort=True)
    return c.select("doc_id", "label", "source", _ts(F.col("published")).alias("published"))


# A02 ---------------------------------------------------------------------------
@query("A02", sql=f"""
WITH c AS ({LABELLED_SQL})
SELECT doc_id, label, strftime(published, '%Y-%m-%d %H:%M:%S') AS published
FROM c WHERE label IN ('high', 'low') AND lang IN ('en', 'de')
""")
def a02_label_in(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf)
    c = cp.label_in(c.where(F.col("lang").isin("en", "de")), ["high", "low"])
    return c.select("doc_id", "label", _ts(F.col("published")).alias("published"))


# A22 ---------------------------------------------------------------------------
@query("A22", sql=f"""
WITH c AS ({LABELLED_SQL})
SELECT doc_id, coalesce(label, 'NA') AS label, strftime(published, '%Y-%m-%d %H:%M:%S') AS published
FROM c WHERE coalesce(label, 'NA') <> 'NA'
""")
def a22_sorted_labelled(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf).withColumn("label", F.coalesce("label", F.lit("NA")))
    c = c.where(F.col("label") != "NA").orderBy("published")
    return c.select("doc_id", "label", _ts(F.col("published")).alias("published"))


# B01 / C08 -----------------------------------------------------------------------
@query("B01", sql=f"""
WITH c AS ({LABELLED_SQL}) SELECT doc_id, label FROM c WHERE label IS NOT NULL
""")
def b01_labelled_only(spark: SparkSession, sf: str) -> DataFrame:
    return cp.labelled_only(labelled_documents(spark, sf)).select("doc_id", "label")


@query("C08", sql="""
SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def c08_semi(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


# B02 ---------------------------------------------------------------------------
@query("B02", sql="""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'Against' ELSE 'For' END AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE (CASE WHEN l.toxic = 1 THEN 'Against' ELSE 'For' END) IN ('For', 'Against')
""")
def b02_polar(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf, inner=True)
    c = c.withColumn("label", F.when(F.col("toxic") == 1, "Against").otherwise("For"))
    return cp.label_in(c, ["For", "Against"]).select("doc_id", "label")


# B03 ---------------------------------------------------------------------------
KEYWORDS = ["the", "und", "les", "que"]


@query("B03", sql="""
SELECT doc_id,
       (contains(text, 'the') OR contains(text, 'und') OR contains(text, 'les') OR contains(text, 'que')) AS found,
       NOT (contains(text, 'the') OR contains(text, 'und') OR contains(text, 'les') OR contains(text, 'que')) AS skipped,
       CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'und') AS INT)
         + CAST(contains(text, 'les') AS INT) + CAST(contains(text, 'que') AS INT) AS n_contained
FROM documents
""")
def b03_keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", cp.contains_any("text", KEYWORDS).alias("found"),
                    (~cp.contains_any("text", KEYWORDS)).alias("skipped"),
                    cp.count_containing("text", KEYWORDS).alias("n_contained"))


# B04 ---------------------------------------------------------------------------
@query("B04", sql=f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {W2})) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS value FROM t GROUP BY doc_id, term),
feat AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 50)
SELECT doc_id, term, value FROM c
WHERE doc_id IN (SELECT doc_id FROM labels) AND term IN (SELECT term FROM feat)
""")
def b04_subset(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import term_counts, doc_freq
    d = table(spark, sf, "documents")
    long = term_counts(d, tx.regex_tokens(F.lower("text"), "word2"))
    feats = doc_freq(long).where(F.col("df") >= 50).select("term")
    rows = table(spark, sf, "labels").select("doc_id")
    return cp.subset(long, rows=rows, features=feats).select("doc_id", "term", "value")


# B05 ---------------------------------------------------------------------------
@query("B05", sql="""
WITH idx AS (SELECT event_id FROM events WHERE value > 50)
SELECT e.event_id, idx.event_id IS NOT NULL AS mask FROM events e LEFT JOIN idx ON e.event_id = idx.event_id
""")
def b05_mask_indices(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    idx = cp.mask_to_indices(ev, F.col("value") > 50, "event_id")
    return cp.indices_to_mask(ev.select("event_id"), idx, "event_id")


# B06 ---------------------------------------------------------------------------
@query("B06", sql="SELECT doc_id, substr(text, 1, 200) AS snippet FROM documents")
def b06_truncate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.substring("text", 1, 200).alias("snippet"))


# B07 ---------------------------------------------------------------------------
@query("B07", sql=f"""
WITH c AS ({LABELLED_SQL})
SELECT coalesce(nullif(label, ''), 'Unlabeled') AS label, count(*) AS n FROM c GROUP BY 1
""")
def b07_default_label(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf).withColumn("label", cp.default_label("label"))
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# B08 ---------------------------------------------------------------------------
@query("B08", sql="""
SELECT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS label_id
FROM (SELECT DISTINCT source FROM documents)
""")
def b08_label_encoding(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return cp.encode_labels(d, "source").withColumnRenamed("source", "label")


# B09 ---------------------------------------------------------------------------
@query("B09", sql=f"""
WITH c AS ({LABELLED_SQL}),
t AS (SELECT label, unnest(regexp_extract_all(lower(text), {W2})) AS term FROM c WHERE label IS NOT NULL)
SELECT label, term, count(*) AS total FROM t GROUP BY label, term HAVING count(*) > 0
""")
def b09_nonzero_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf, inner=True)
    t = c.select("label", F.explode(tx.regex_tokens(F.lower("text"), "word2")).alias("term"))
    return t.groupBy("label", "term").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > 0)


# B10 ---------------------------------------------------------------------------
@query("B10", sql=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {W2}) AS toks FROM documents),
i AS (SELECT doc_id, toks, unnest([0, 2, 4]) AS idx FROM t)
SELECT doc_id, CAST(idx AS INT) AS idx, toks[idx + 1] AS token FROM i WHERE idx < len(toks)
""")
def b10_token_subset(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    t = d.select("doc_id", tx.regex_tokens("text", "word2").alias("toks"))
    return cp.token_subset(t, "toks", [0, 2, 4]).select("doc_id", "idx", "token")


# C01 ---------------------------------------------------------------------------
@query("C01", sql="""
SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def c01_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    lab = table(spark, sf, "labels")
    # labels is a fraction of documents: sort-merge by default, AQE turns it
    # into a broadcast from the runtime size when it is small
    return d.join(lab, "doc_id").select("doc_id", "source", "quality", "toxic")


# C04 ---------------------------------------------------------------------------
@query("C04", sql="""
WITH p AS (SELECT d.doc_id, d.text AS document,
                  CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS gold,
                  CASE WHEN (d.doc_id * 37 % 101) / 101.0 >= 0.5 THEN 'high' ELSE 'low' END AS pred
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, gold, pred, document FROM p WHERE gold <> pred
""")
def c04_mispredictions(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf, inner=True)
    p = c.select("doc_id", F.col("text").alias("document"), F.col("label").alias("gold"),
                 F.when((F.col("doc_id") * 37 % 101) / 101.0 >= 0.5, "high").otherwise("low").alias("pred"))
    return cp.mispredictions(p, "gold", "pred").select("doc_id", "gold", "pred", "document")


# C07 / D01 ---------------------------------------------------------------------
@query("C07", sql="""
WITH names AS (SELECT DISTINCT source FROM documents),
n AS (SELECT d.source, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id
      WHERE l.toxic = 1 GROUP BY d.source)
SELECT names.source, CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM names LEFT JOIN n ON names.source = n.source
""")
def c07_names_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    names = d.select("source").distinct()
    tox = d.join(table(spark, sf, "labels").where(F.col("toxic") == 1), "doc_id")
    counts = tox.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return cp.names_with_counts(names, counts, "source")


@query("D01", sql="""
WITH ids AS (SELECT source AS label, dense_rank() OVER (ORDER BY source) - 1 AS label_id
             FROM (SELECT DISTINCT source FROM documents)),
y AS (SELECT ids.label_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id
      JOIN ids ON d.source = ids.label WHERE l.toxic = 1),
m AS (SELECT max(label_id) AS mx FROM y)
SELECT CAST(ids.label_id AS BIGINT) AS label_id, ids.label,
       CAST((SELECT count(*) FROM y WHERE y.label_id = ids.label_id) AS BIGINT) AS n
FROM ids, m WHERE ids.label_id <= m.mx
""")
def d01_table(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ids = cp.encode_labels(d, "source").withColumnRenamed("source", "label")
    y = d.join(table(spark, sf, "labels").where(F.col("toxic") == 1), "doc_id") \
        .join(ids, d["source"] == ids["label"]).select("label_id")
    return cp.label_table(y, ids)


# D03 ---------------------------------------------------------------------------
@query("D03", sql=f"""
WITH c AS ({LABELLED_SQL})
SELECT label, lang, source, CAST(GROUPING_ID(label, lang, source) AS BIGINT) AS gid, count(*) AS n
FROM c GROUP BY GROUPING SETS ((label, lang), (label, source), (source))
""")
def d03_crosstabs(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf)
    return cp.crosstabs(c, [["label", "lang"], ["label", "source"], ["source"]],
                        ["label", "lang", "source"])


# D27 ---------------------------------------------------------------------------
@query("D27", sql="SELECT DISTINCT lang FROM documents")
def d27_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang").distinct()


# F01 / F02 ---------------------------------------------------------------------
@query("F01", sql=f"""
WITH c AS ({LABELLED_SQL})
SELECT doc_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM c ORDER BY published, doc_id
""")
def f01_sort(spark: SparkSession, sf: str) -> DataFrame:
    c = timed_documents(spark, sf).orderBy("published", "doc_id")
    return c.select("doc_id", _ts(F.col("published")).alias("published"))


@query("F02", sql="SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def f02_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(10)


# F04 ---------------------------------------------------------------------------
@query("F04", sql="""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events),
n AS (SELECT count(*) AS total FROM events)
SELECT event_id, rank FROM r, n
WHERE rank - 1 < 5 OR rank - 1 >= total - 5
   OR (rank - 1 >= floor(total / 2) - 2 AND rank - 1 <= floor(total / 2) + 2)
""")
def f04_margins(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts")
    r = global_rank(ev, ["ts", "event_id"])
    return margins(r, 5, which="edges_median").select("event_id", F.col("rank").cast("long").alias("rank"))


# F05 ---------------------------------------------------------------------------
@query("F05", sql=f"""
WITH c AS ({LABELLED_SQL}),
t AS (SELECT label, unnest(regexp_extract_all(lower(text), {W2})) AS term FROM c WHERE label IS NOT NULL),
s AS (SELECT label, term, count(*) AS n FROM t GROUP BY label, term),
tot AS (SELECT term, sum(n) AS total FROM s GROUP BY term HAVING sum(n) >= 20),
coef AS (SELECT s.label, s.term, round(ln(s.n / tot.total), 6) AS coef FROM s JOIN tot ON s.term = tot.term),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coef, term) AS lo,
               row_number() OVER (PARTITION BY label ORDER BY coef DESC, term) AS hi FROM coef)
SELECT label, term, coef, CASE WHEN lo <= 5 THEN 'lowest' ELSE 'highest' END AS side
FROM r WHERE lo <= 5 OR hi <= 5
""")
def f05_extremes(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf, inner=True)
    t = c.select("label", F.explode(tx.regex_tokens(F.lower("text"), "word2")).alias("term"))
    s = t.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    tot = s.groupBy("term").agg(F.sum("n").alias("total")).where(F.col("total") >= 20)
    coef = s.join(tot, "term").select("label", "term", F.round(F.log(F.col("n") / F.col("total")), 6).alias("coef"))
    return cp.extreme_features(coef, "label", "coef", "term", 5)


# F06 ---------------------------------------------------------------------------
@query("F06", sql="""
WITH a AS (SELECT d.source, avg(l.quality) AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id
           GROUP BY d.source)
SELECT arg_max(source, (accuracy, source)) AS best_source, round(max(accuracy), 6) AS best_accuracy FROM a
""")
def f06_argmax(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf, inner=True)
    a = c.groupBy("source").agg(F.avg("quality").alias("accuracy"))
    return a.agg(F.max_by("source", F.struct("accuracy", "source")).alias("best_source"),
                 F.round(F.max("accuracy"), 6).alias("best_accuracy"))


# F07 ---------------------------------------------------------------------------
@query("F07", sql="""
SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
ORDER BY n DESC, source LIMIT 10 OFFSET 5
""")
def f07_offset(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return offset_limit(s, [F.desc("n"), F.asc("source")], 5, 10)


# F08 ---------------------------------------------------------------------------
@query("F08", sql="""
SELECT a.event_type, a.which_min, b.which_max FROM
 (SELECT event_type, arg_min(event_id, (value, event_id)) AS which_min FROM events GROUP BY event_type) a
 JOIN (SELECT event_type, arg_max(event_id, (value, -event_id)) AS which_max FROM events GROUP BY event_type) b
 ON a.event_type = b.event_type
""")
def f08_which(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    a = which_min(ev, "value", "event_id", ["event_type"])
    b = which_max(ev, "value", "event_id", ["event_type"])
    return a.join(b, "event_type")


# G01 ---------------------------------------------------------------------------
@query("G01", sql="""
SELECT label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
  SELECT source AS label, n_chars FROM documents WHERE source = 'src0'
  UNION ALL SELECT source AS label, n_chars FROM documents WHERE source = 'src1') GROUP BY label
""")
def g01_union(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    u = cp.union_corpora(d.where(F.col("source") == "src0"), d.where(F.col("source") == "src1"), "source")
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# G02 ---------------------------------------------------------------------------
@query("G02", sql="""
SELECT DISTINCT lang AS label FROM documents EXCEPT SELECT * FROM (VALUES ('en'), ('fr')) t(label)
""")
def g02_new_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return cp.new_labels(d, ["en", "fr"])


# G03 ---------------------------------------------------------------------------
@query("G03", sql="""
SELECT DISTINCT k AS new_key FROM (SELECT unnest(json_keys(props)) AS k FROM events)
WHERE k NOT IN ('a', 'b')
""")
def g03_new_keys(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    keys = ev.select(F.explode(F.json_object_keys("props")).alias("new_key"))
    return cp.new_labels(keys.withColumnRenamed("new_key", "label"), ["a", "b"]) \
        .withColumnRenamed("label", "new_key")


# G04 ---------------------------------------------------------------------------
@query("G04", sql=r"""
WITH stop AS (SELECT DISTINCT s FROM (SELECT unnest(['a','an','the','and','or','but','for','to','in','at','as',
      'you','this','it','your','-','http','>>','be','http','https','t','co','bit','ly']) AS s)),
t AS (SELECT unnest(string_split_regex(trim(lower(text)), '\s+')) AS tok FROM documents)
SELECT tok AS term, count(*) AS n FROM t WHERE tok IN (SELECT s FROM stop) GROUP BY tok
""")
def g04_stop_union(spark: SparkSession, sf: str) -> DataFrame:
    stop = sorted(set(tx.NAIVE_STOPWORDS) | set(tx.TOPIC_EXTRA_STOPWORDS))
    d = table(spark, sf, "documents")
    t = d.select(F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("term"))
    return t.where(F.col("term").isin(stop)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# G05 ---------------------------------------------------------------------------
@query("G05", sql="""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def g05_complement(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
