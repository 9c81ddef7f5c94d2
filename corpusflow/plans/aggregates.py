"""Aggregates and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregate as ag
from ..sources.tables import table
from .common import PRED_SQL, key_sql, labelled_documents, predictions
from .registry import query

W2 = r"'[\p{L}\p{N}_]{2,}'"


def _r(c, n=6):
    return F.round(c, n)


# D04 ---------------------------------------------------------------------------
@query("D04", sql="""
SELECT l_returnflag AS model,
       round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END), 6) AS "F",
       round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 6) AS "O"
FROM lineitem GROUP BY l_returnflag
""")
def d04_mean_by_model(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"),
                                              F.col("l_linestatus").alias("train"), "l_discount")
    p = li.groupBy("model").pivot("train", ["F", "O"]).avg("l_discount")
    return p.select("model", _r(F.col("F")).alias("F"), _r(F.col("O")).alias("O"))


# D05 ---------------------------------------------------------------------------
@query("D05", sql=r"""
WITH per AS (SELECT lower(string_split_regex(trim(text), '\s+')[1]) AS author, count(*) AS n
             FROM conversations GROUP BY 1),
p AS (SELECT quantile_cont(n, 0.99) AS p FROM per)
SELECT round(avg(n), 6) AS mean_docs, round(max(p.p), 6) AS p99,
       round(avg(CASE WHEN n < p.p THEN n END), 6) AS mean_below,
       count(CASE WHEN n >= p.p THEN 1 END) AS n_excluded, count(*) AS n_authors
FROM per, p
""")
def d05_per_author(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    author = F.lower(F.element_at(F.split(F.trim("text"), r"\s+"), 1))
    s = ag.per_author(conv, author)
    return s.select(_r(F.col("mean_docs")).alias("mean_docs"), _r(F.col("p99")).alias("p99"),
                    _r(F.col("mean_below")).alias("mean_below"), "n_excluded", "n_authors")


# D06 ---------------------------------------------------------------------------
_TAGGED = "concat(text, ' #', source, ' #Lang_', lang)"


@query("D06", sql=rf"""
WITH t AS (SELECT unnest(regexp_extract_all(lower({_TAGGED}), '#[\p{{L}}\p{{N}}_]+')) AS tag FROM documents)
SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 10
""")
def d06_top_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    tagged = F.concat(F.col("text"), F.lit(" #"), F.col("source"), F.lit(" #Lang_"), F.col("lang"))
    t = d.select(F.explode(tx.hashtags(tagged)).alias("tag"))
    c = t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), F.asc("tag")).limit(10)


# D07 ---------------------------------------------------------------------------
@query("D07", sql="""
WITH l AS (SELECT length(html) AS len FROM pages),
r AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS i FROM l)
SELECT round((SELECT avg(len) FROM l), 6) AS mean,
       (SELECT max(len) FROM r WHERE i = (SELECT count(*) FROM l) // 2) AS median
""")
def d07_content_length(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.length("html").alias("len"))
    s = ag.upper_median_and_mean(p, "len")
    return s.select(_r(F.col("mean")).alias("mean"), F.col("median").cast("long").alias("median"))


# D08 ---------------------------------------------------------------------------
@query("D08", sql="""
SELECT lang, round(count(*) / sum(count(*)) OVER (), 6) AS dist FROM documents GROUP BY lang
""")
def d08_dist(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return ag.normalise(c, "n").select("lang", _r(F.col("dist")).alias("dist"))


# D09 ---------------------------------------------------------------------------
@query("D09", sql="""
SELECT event_type, round(CASE WHEN min(value) > 0 THEN count(value) / sum(1.0 / value) END, 6) AS hmean
FROM events GROUP BY event_type
""")
def d09_hmean(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type").agg(_r(ag.hmean("value")).alias("hmean"))


# D10 ---------------------------------------------------------------------------
@query("D10", sql=f"""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), {W2})) AS term FROM documents),
s AS (SELECT term, count(*) AS total FROM t GROUP BY term)
SELECT term, total, row_number() OVER (ORDER BY total DESC, term) AS rank FROM s
""")
def d10_term_totals(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ranking import global_rank
    d = table(spark, sf, "documents")
    t = d.select(F.explode(tx.regex_tokens(F.lower("text"), "word2")).alias("term"))
    s = t.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    r = global_rank(s, [F.desc("total"), F.asc("term")])
    return r.select("term", "total", F.col("rank").cast("long").alias("rank"))


# D11 ---------------------------------------------------------------------------
@query("D11", sql=f"""
WITH p AS ({PRED_SQL}), c AS (SELECT gold, count(*) AS n FROM p GROUP BY gold),
b AS (SELECT max(n) / sum(n) AS baseline FROM c), a AS (SELECT avg(CAST(gold = pred AS DOUBLE)) AS accuracy FROM p)
SELECT round(baseline, 6) AS baseline, round(accuracy, 6) AS accuracy,
       round(1 - (1 - accuracy) / (1 - baseline), 6) AS improvement FROM b, a
""")
def d11_baseline(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    counts = p.groupBy("gold").agg(F.count(F.lit(1)).alias("n"))
    acc = p.select(F.avg((F.col("gold") == F.col("pred")).cast("double"))).scalar()
    s = ag.baseline_improvement(counts, acc)
    return s.select(*[_r(F.col(c)).alias(c) for c in ("baseline", "accuracy", "improvement")])


# D12 ---------------------------------------------------------------------------
@query("D12", sql=f"""
WITH p AS ({PRED_SQL})
SELECT gold, count(CASE WHEN pred = 'high' THEN 1 END) AS high, count(CASE WHEN pred = 'low' THEN 1 END) AS low
FROM p GROUP BY gold
""")
def d12_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ag.confusion(predictions(spark, sf), "gold", "pred", ["high", "low"])


# D13 ---------------------------------------------------------------------------
@query("D13", sql=f"""
WITH p AS ({PRED_SQL}),
c AS (SELECT cls, sum(tp) AS tp, sum(sup) AS support, sum(prd) AS predicted FROM (
        SELECT gold AS cls, CAST(gold = pred AS INT) AS tp, 1 AS sup, 0 AS prd FROM p
        UNION ALL SELECT pred, 0, 0, 1 FROM p) GROUP BY cls),
m AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM c)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
       CAST(support AS BIGINT) AS support,
       round((SELECT avg(CAST(gold = pred AS DOUBLE)) FROM p), 6) AS accuracy
FROM m
""")
def d13_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = ag.class_metrics(predictions(spark, sf), "gold", "pred")
    return m.select("cls", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"), _r(F.col("accuracy")).alias("accuracy"))


# D14 ---------------------------------------------------------------------------
@query("D14", sql=f"""
WITH p AS ({PRED_SQL})
SELECT round(avg(-ln(least(greatest(CASE WHEN gold = 'high' THEN p_high ELSE 1 - p_high END, 1e-15), 1 - 1e-15))), 6)
       AS log_loss FROM p
""")
def d14_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    pt = F.when(F.col("gold") == "high", F.col("p_high")).otherwise(1 - F.col("p_high"))
    return p.agg(_r(ag.log_loss(pt)).alias("log_loss"))


# D15 ---------------------------------------------------------------------------
@query("D15", sql=f"""
WITH p AS ({PRED_SQL}),
r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS rk, count(*) OVER () AS n FROM p)
SELECT CAST(floor(10 * (rk - 1) / n) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score,
       round(avg(CAST(gold = pred AS DOUBLE)), 6) AS accuracy FROM r GROUP BY 1
""")
def d15_binned_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    b = ag.binned_accuracy(p, "score", F.col("gold") == F.col("pred"), "doc_id", 10)
    return b.select("bin", "n", _r(F.col("mean_score")).alias("mean_score"), _r(F.col("accuracy")).alias("accuracy"))


# D16 ---------------------------------------------------------------------------
@query("D16", sql=f"""
WITH p AS ({PRED_SQL}),
e AS (SELECT quantile_cont(score, [0.0, 0.25, 0.5, 0.75]) AS q FROM p),
b AS (SELECT p.*, (CAST(q[1] <= score AS INT) + CAST(q[2] <= score AS INT) + CAST(q[3] <= score AS INT)
                   + CAST(q[4] <= score AS INT)) AS quartile FROM p, e)
SELECT 'q' || quartile AS grp, count(*) AS n, round(avg(CAST(gold = pred AS DOUBLE)), 6) AS accuracy FROM b GROUP BY 1
UNION ALL
SELECT CASE WHEN quartile IN (1, 4) THEN 'extreme' ELSE 'middle' END, count(*),
       round(avg(CAST(gold = pred AS DOUBLE)), 6) FROM b GROUP BY 1
""")
def d16_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    q = ag.quartile_accuracy(p, "score", F.col("gold") == F.col("pred"))
    return q.select("grp", "n", _r(F.col("accuracy")).alias("accuracy"))


# D17 ---------------------------------------------------------------------------
@query("D17", sql="""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
i AS (SELECT CASE WHEN l_extendedprice = hi THEN 19 ELSE CAST(floor((l_extendedprice - lo) / ((hi - lo) / 20)) AS BIGINT) END AS bin
      FROM lineitem, b)
SELECT bin, count(*) AS n, round((SELECT lo FROM b) + bin * (((SELECT hi FROM b) - (SELECT lo FROM b)) / 20), 4) AS "left"
FROM i GROUP BY bin
""")
def d17_histogram(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    h = ag.histogram(li, "l_extendedprice", 20)
    return h.select("bin", "n", _r(F.col("left"), 4).alias("left"))


@query("D17_quantiles", sql="""
SELECT unnest([0.0, 0.05, 0.10, 0.50, 0.90, 0.95, 1.0]::DOUBLE[]) AS q,
       round(unnest(quantile_cont(l_extendedprice, [0.0, 0.05, 0.10, 0.50, 0.90, 0.95, 1.0])), 4) AS value
FROM lineitem
""")
def d17_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = ag.quantiles(table(spark, sf, "lineitem"), "l_extendedprice")
    return q.select("q", _r(F.col("value"), 4).alias("value"))


# D18 ---------------------------------------------------------------------------
@query("D18", sql="""
WITH c AS (SELECT vec_id AS replicate, CAST(i AS BIGINT) AS term, CAST(embedding[i + 1] AS DOUBLE) AS coef
           FROM embeddings, range(0, 64) t(i))
SELECT term, round(avg(coef), 6) AS mean, round(var_pop(coef), 6) AS var,
       round(avg(CAST(coef = 0 AS DOUBLE)), 6) AS zero_share,
       round(avg(CAST(abs(avg(coef)) > 0.1 AS DOUBLE)) OVER (), 6) AS big_share
FROM c GROUP BY term
""")
def d18_coef_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    c = e.select(F.col("vec_id").alias("replicate"),
                 F.posexplode("embedding").alias("term", "coef")) \
        .select("replicate", F.col("term").cast("long").alias("term"), F.col("coef").cast("double").alias("coef"))
    s = ag.coef_summary(c)
    big = s.select(F.avg((F.abs("mean") > 0.1).cast("double"))).scalar()
    return s.select("term", _r(F.col("mean")).alias("mean"), _r(F.col("var")).alias("var"),
                    _r(F.col("zero_share")).alias("zero_share"), _r(big).alias("big_share"))


# D20 ---------------------------------------------------------------------------
@query("D20", sql=f"""
WITH p AS ({PRED_SQL}),
allp AS (SELECT d.doc_id, CASE WHEN (d.doc_id * 37 % 101) / 101.0 >= 0.5 THEN 'high' ELSE 'low' END AS pred
         FROM documents d),
g AS (SELECT p.*, row_number() OVER (PARTITION BY gold ORDER BY {key_sql('doc_id', 1)}, doc_id) AS rn FROM p),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM p GROUP BY gold)),
u AS (SELECT 'balanced' AS subset, pred FROM g, m WHERE rn <= m.m
      UNION ALL SELECT 'labelled', pred FROM p
      UNION ALL SELECT 'everything', pred FROM allp)
SELECT subset, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY subset), 6) AS share
FROM u GROUP BY subset, pred
""")
def d20_pred_shares(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.sampling import balance
    p = predictions(spark, sf)
    bal = balance(p, "gold", "doc_id", seed=1)
    allp = table(spark, sf, "documents").select(
        F.when((F.col("doc_id") * 37 % 101) / 101.0 >= 0.5, "high").otherwise("low").alias("pred"))
    u = (bal.select(F.lit("balanced").alias("subset"), "pred")
         .unionByName(p.select(F.lit("labelled").alias("subset"), "pred"))
         .unionByName(allp.select(F.lit("everything").alias("subset"), "pred")))
    c = u.groupBy("subset", "pred").agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("subset").agg(F.sum("n").alias("_t"))
    return c.join(tot, "subset").select("subset", "pred", "n", _r(F.col("n") / F.col("_t")).alias("share"))


# D22 ---------------------------------------------------------------------------
@query("D22", sql="""
WITH x AS (SELECT vec_id, CAST(i AS BIGINT) AS topic, abs(CAST(embedding[i + 1] AS DOUBLE)) AS a
           FROM embeddings, range(0, 64) t(i)),
d AS (SELECT vec_id, topic, a / sum(a) OVER (PARTITION BY vec_id) AS ratio FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ratio DESC, topic) AS rn FROM d)
SELECT topic, round(sum(ratio), 5) AS total, count(CASE WHEN rn = 1 THEN 1 END) AS first,
       count(CASE WHEN rn = 2 THEN 1 END) AS second FROM r GROUP BY topic
""")
def d22_topic_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    z = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    dist = e.select("vec_id", F.posexplode(F.transform(a, lambda x: x / z)).alias("topic", "ratio")) \
        .withColumn("topic", F.col("topic").cast("long"))
    t = ag.topic_totals(dist, "vec_id", "topic", "ratio")
    return t.select("topic", _r(F.col("total"), 5).alias("total"), "first", "second")


# D23 ---------------------------------------------------------------------------
@query("D23", sql="""
WITH g AS (SELECT n.n_name, count(CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1 END) AS n_for,
                  count(CASE WHEN c.c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 1 END) AS n_against,
                  count(*) AS total
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name),
m AS (SELECT max(total) AS mx FROM g)
SELECT n_name, n_for, n_against, total,
       round(CASE WHEN total > 0 THEN (n_for - n_against) / total END, 6) AS opinion,
       round((total - 0.5) / (mx - 0.5), 6) AS linear_weight,
       round(ln(total / 0.5) / ln(mx / 0.5), 6) AS log_weight,
       round(avg(CASE WHEN total > 0 THEN (n_for - n_against) / total END) OVER (), 6) AS mean_opinion
FROM g, m
""")
def d23_opinion(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    # nation is a 25-row dimension: broadcast
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    seg = F.col("c_mktsegment")
    o = ag.opinion_index(j, "n_name", seg.isin("BUILDING", "AUTOMOBILE"), seg.isin("MACHINERY", "HOUSEHOLD"))
    mean = o.select(F.avg("opinion")).scalar()
    return o.select("n_name", "n_for", "n_against", "total", _r(F.col("opinion")).alias("opinion"),
                    _r(F.col("linear_weight")).alias("linear_weight"),
                    _r(F.col("log_weight")).alias("log_weight"), _r(mean).alias("mean_opinion"))


# D24 ---------------------------------------------------------------------------
@query("D24", sql=f"""
WITH p AS ({PRED_SQL}),
c AS (SELECT *, 1 - 2 * (CASE WHEN p_high > 0 AND 1 - p_high > 0 THEN 2 / (1 / p_high + 1 / (1 - p_high)) ELSE 0 END)
        AS certainty FROM p)
SELECT 'all' AS grp, round(avg(certainty), 6) AS mean_certainty FROM c
UNION ALL SELECT CASE WHEN gold = pred THEN 'correct' ELSE 'incorrect' END, round(avg(certainty), 6) FROM c GROUP BY 1
""")
def d24_certainty(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).withColumn("certainty", ag.certainty(F.col("p_high")))
    a = p.agg(F.lit("all").alias("grp"), _r(F.avg("certainty")).alias("mean_certainty"))
    b = p.groupBy(F.when(F.col("gold") == F.col("pred"), "correct").otherwise("incorrect").alias("grp")) \
        .agg(_r(F.avg("certainty")).alias("mean_certainty"))
    return a.unionByName(b)


# D28 ---------------------------------------------------------------------------
@query("D28", sql=f"""
WITH p AS ({PRED_SQL})
SELECT round(avg(greatest(p_high, 1 - p_high)), 6) AS mean_best_proba,
       round(avg(CASE WHEN gold <> pred THEN 2 / (1 / p_high + 1 / (1 - p_high)) END), 6) AS error_hmean
FROM p
""")
def d28_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    hm = ag.hmean_row(F.col("p_high"), 1 - F.col("p_high"))
    return p.agg(_r(F.avg(F.greatest("p_high", 1 - F.col("p_high")))).alias("mean_best_proba"),
                 _r(F.avg(F.when(F.col("gold") != F.col("pred"), hm))).alias("error_hmean"))


# H16 ---------------------------------------------------------------------------
@query("H16", sql=f"""
WITH p AS ({PRED_SQL})
SELECT doc_id, round(p_high, 6) AS p, round(ln(p_high / (1 - p_high)), 6) AS logit FROM p
""")
def h16_logistic(spark: SparkSession, sf: str) -> DataFrame:
    score = (F.col("doc_id") * 37 % 101) / 101.0
    d = labelled_documents(spark, sf, inner=True)
    p = tx.logistic(score * 6 - 3)
    return d.select("doc_id", _r(p).alias("p"), _r(tx.logit(p)).alias("logit"))


# H21 ---------------------------------------------------------------------------
@query("H21", sql=f"""
WITH c AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' END AS label
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT doc_id, label, unnest(regexp_extract_all(lower(text), {W2})) AS term FROM c),
coef AS (SELECT term, ln((count(CASE WHEN label = 'high' THEN 1 END) + 1.0)
                        / (count(CASE WHEN label = 'low' THEN 1 END) + 1.0)) AS coef
         FROM t WHERE label IS NOT NULL GROUP BY term),
v AS (SELECT doc_id, term, count(*) AS value FROM t GROUP BY doc_id, term),
x AS (SELECT v.doc_id, v.term, v.value * coef.coef AS contribution FROM v JOIN coef ON v.term = coef.term)
SELECT doc_id, round(sum(contribution), 6) AS total, count(*) AS n_terms,
       arg_min(term, (contribution, term)) AS most_negative
FROM x GROUP BY doc_id
""")
def h21_contributions(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.models import feature_contributions
    c = labelled_documents(spark, sf)
    t = c.select("doc_id", "label", F.explode(tx.regex_tokens(F.lower("text"), "word2")).alias("term"))
    coef = t.where(F.col("label").isNotNull()).groupBy("term").agg(
        F.log((F.count_if(F.col("label") == "high") + 1.0) / (F.count_if(F.col("label") == "low") + 1.0)).alias("coef"))
    v = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("value"))
    x = feature_contributions(v, coef)
    return x.select("doc_id", _r(F.col("total")).alias("total"), "n_terms",
                    F.col("contributions")[0]["term"].alias("most_negative"))
