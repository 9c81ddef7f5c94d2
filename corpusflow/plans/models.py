"""Model, sampling and study queries.

Sampling queries use the portable hash so DuckDB can check them exactly.
Model fits are distributed, by Spark ML or over document shares
(``operators/logistic.py``); their outputs depend on the optimiser, so they
are registered without SQL (rows-only) except for naive Bayes and
chi-squared, which are computed exactly in the long form.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import logistic as lg
from ..operators import models as md
from ..operators import sampling as sp
from ..operators.aggregate import histogram, quantiles, log_loss, hmean_row, binned_accuracy, quartile_accuracy
from ..operators.components import principal_components
from ..operators.features import df_cut, ngram_array, term_counts, tfidf_join
from ..operators.linkage import cut_tree, single_linkage
from ..operators.links import ENGLISH_STOPWORDS
from ..operators.timeseries import exponential_decay, running_stats
from ..operators.perceptron import perceptron_folds
from ..operators.ranking import global_rank
from ..session import cut_lineage
from ..sources.sinks import landed
from ..sources.tables import table
from .common import key_sql, labelled_documents
from .registry import query

W2 = r"'[\p{L}\p{N}_]{2,}'"
LAB_SQL = """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def _r(c, n=6):
    return F.round(c, n)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with word tokens and a 0/1 label id (high = 1)."""
    c = labelled_documents(spark, sf, inner=True)
    return c.select("doc_id", "label", (F.col("label") == "high").cast("double").alias("label_id"),
                    tx.regex_tokens(F.lower("text"), "word2").alias("tokens"), "source")


def _vectors(spark, sf, min_df=2, ngram_max=2):
    """Vectors of the labelled documents' 1-2-grams and their vocabulary."""
    return md.term_vectors(corpus(spark, sf), "tokens", min_df=min_df, ngram_max=ngram_max)


def _bigrams(spark, sf, min_df=2, ngram_max=2):
    """The counts that ``_vectors`` holds, in the long form."""
    c = corpus(spark, sf).select("doc_id", "tokens")
    return landed(df_cut(term_counts(c, ngram_array(F.col("tokens"), ngram_max)), F.lit(c.count()), min_df), "bigrams")


# Sampling -------------------------------------------------------------------------
@query("I22", sql=f"""
WITH c AS ({LAB_SQL}), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM c),
n AS (SELECT count(*) AS n FROM c),
dr AS (SELECT rep, j FROM range(0, 20) a(rep), range(0, (SELECT CAST(floor(n * 0.5) AS BIGINT) FROM n)) b(j)),
h AS (SELECT rep, {key_sql('rep', 'j', 0)} % (SELECT n FROM n) AS idx FROM dr)
SELECT CAST(h.rep AS BIGINT) AS replicate, r.doc_id, count(*) AS weight FROM h JOIN r ON h.idx = r.idx GROUP BY 1, 2
""")
def i22_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf).select("doc_id")
    return sp.bootstrap_weights(c, "doc_id", n_iter=20, proportion=0.5, seed=0)


@query("I23", sql=f"""
WITH c AS ({LAB_SQL}),
g AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {key_sql('doc_id', 3)}, doc_id) AS rn FROM c),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM c GROUP BY label))
SELECT doc_id, label FROM g, m WHERE rn <= m.m
""")
def i23_balance(spark: SparkSession, sf: str) -> DataFrame:
    return sp.balance(corpus(spark, sf).select("doc_id", "label"), "label", "doc_id", seed=3).select("doc_id", "label")


@query("I24", sql=f"""
WITH c AS ({LAB_SQL}),
g AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {key_sql('doc_id', 5)}, doc_id) AS rn FROM c)
SELECT doc_id, label FROM g WHERE rn <= 50
""")
def i24_fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sp.balance(corpus(spark, sf).select("doc_id", "label"), "label", "doc_id", seed=5, per_class=50).select("doc_id", "label")


@query("I25", sql=f"""
WITH c AS ({LAB_SQL}), s AS (SELECT c.*, CAST(split AS BIGINT) AS split FROM c, range(0, 3) t(split)),
g AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {key_sql('doc_id', 7, 'split')}, doc_id) AS rn,
             count(*) OVER (PARTITION BY split, label) AS n FROM s)
SELECT split, doc_id, label, rn <= ceil(0.25 * n) AS is_test FROM g
""")
def i25_stratified(spark: SparkSession, sf: str) -> DataFrame:
    s = sp.stratified_split(corpus(spark, sf).select("doc_id", "label"), "label", "doc_id", test_size=0.25, n_iter=3, seed=7)
    return s.select("split", "doc_id", "label", "is_test")


@query("I26", sql=f"SELECT doc_id, CAST({key_sql('doc_id', 11)} % 10 AS INT) AS fold FROM documents")
def i26_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return sp.kfold(table(spark, sf, "documents").select("doc_id"), "doc_id", 10, seed=11)


# I20 / I29 (exact, long form) ------------------------------------------------------
@query("I20", sql=rf"""
WITH c AS ({LAB_SQL}),
d AS (SELECT doc_id, label, {key_sql('doc_id', 0)} % 10 AS fold FROM c),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {W2})) AS term FROM documents WHERE doc_id IN (SELECT doc_id FROM c)),
L0 AS (SELECT doc_id, term, count(*) AS value FROM t GROUP BY doc_id, term),
L AS (SELECT L0.*, d.label, d.fold FROM L0 JOIN d ON L0.doc_id = d.doc_id),
V AS (SELECT count(DISTINCT term) AS V FROM L0),
N AS (SELECT count(*) AS n FROM d),
grid AS (SELECT DISTINCT d1.fold, d2.label AS c FROM d d1, d d2),
fc AS (SELECT g.fold, g.c,
         ln(((SELECT count(*) FROM d WHERE label = g.c) - (SELECT count(*) FROM d WHERE label = g.c AND fold = g.fold))
            / ((SELECT n FROM N) - (SELECT count(*) FROM d WHERE fold = g.fold))) AS log_prior,
         (SELECT coalesce(sum(value), 0) FROM L WHERE label = g.c)
           - (SELECT coalesce(sum(value), 0) FROM L WHERE label = g.c AND fold = g.fold) + (SELECT V FROM V) AS denom
       FROM grid g),
ct AS (SELECT label AS c, term, sum(value) AS n_ct FROM L GROUP BY 1, 2),
ctf AS (SELECT fold, label AS c, term, sum(value) AS n_fct FROM L GROUP BY 1, 2, 3),
test AS (SELECT L.doc_id, L.fold, L.term, L.value, cl.c FROM L, (SELECT DISTINCT label AS c FROM d) cl),
s AS (SELECT test.doc_id, test.fold, test.c, fc.log_prior,
             sum(test.value * ln((coalesce(ct.n_ct, 0) - coalesce(ctf.n_fct, 0) + 1) / fc.denom)) AS ll
      FROM test LEFT JOIN ct ON test.c = ct.c AND test.term = ct.term
      LEFT JOIN ctf ON test.fold = ctf.fold AND test.c = ctf.c AND test.term = ctf.term
      JOIN fc ON test.fold = fc.fold AND test.c = fc.c GROUP BY 1, 2, 3, 4),
p AS (SELECT doc_id, fold, arg_max(c, (ll + log_prior, c)) AS pred FROM s GROUP BY 1, 2)
SELECT CAST(p.fold AS INT) AS fold, count(*) AS n, CAST(sum(CAST(p.pred = d.label AS BIGINT)) AS BIGINT) AS correct,
       round(avg(CAST(p.pred = d.label AS DOUBLE)), 6) AS accuracy
FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY 1
""")
def i20_naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    long = term_counts(c.select("doc_id", "tokens"), F.col("tokens"))
    r = md.naive_bayes_cv(long, c.select("doc_id", "label"), k=10, seed=0)
    return r.select("fold", "n", "correct", _r(F.col("accuracy")).alias("accuracy"))


@query("I29", sql=rf"""
WITH c AS ({LAB_SQL}),
t AS (SELECT c.doc_id, c.label, unnest(regexp_extract_all(lower(d.text), {W2})) AS term FROM c JOIN documents d ON c.doc_id = d.doc_id),
sh AS (SELECT label AS c, count(*) / (SELECT count(*) FROM c) AS p FROM c GROUP BY label),
obs AS (SELECT label AS c, term, count(*) AS o FROM t GROUP BY 1, 2),
tot AS (SELECT term, count(*) AS t FROM t GROUP BY term),
x AS (SELECT tot.term, sum(power(coalesce(obs.o, 0) - sh.p * tot.t, 2) / (sh.p * tot.t)) AS chi2
      FROM tot, sh LEFT JOIN obs ON obs.c = sh.c AND obs.term = tot.term GROUP BY tot.term)
SELECT term, round(chi2, 6) AS chi2 FROM x ORDER BY chi2 DESC, term LIMIT 20
""")
def i29_chi2(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    long = term_counts(c.select("doc_id", "tokens"), F.col("tokens"))
    s = md.chi2_scores(long, c.select("doc_id", "label"))
    return s.select("term", _r(F.col("chi2")).alias("chi2")).orderBy(F.desc("chi2"), "term").limit(20)


# I28 ---------------------------------------------------------------------------
@query("I28", sql="""
SELECT d.source AS name, 'Corpus ' || d.source AS title, count(*) AS n_docs, count(l.doc_id) AS n_labelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source
""")
def i28_corpora(spark: SparkSession, sf: str) -> DataFrame:
    c = labelled_documents(spark, sf)
    return c.groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled")) \
        .withColumn("title", F.concat(F.lit("Corpus "), F.col("name")))


# D19 ---------------------------------------------------------------------------
@query("D19", sql="""
WITH x AS (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(i))
SELECT a.i, b.i AS j, round(covar_samp(a.v, b.v), 5) AS cov, round(corr(a.v, b.v), 5) AS corr
FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i
""")
def d19_covariance(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select(array_to_vector(
        F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    m = md.correlation_matrix(e)
    return m.select("i", "j", _r(F.col("cov"), 5).alias("cov"), _r(F.col("corr"), 5).alias("corr"))


@query("D19_order", sql="""
WITH x AS (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(i)),
c AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
s AS (SELECT i, sum(cov) AS row_sum FROM c GROUP BY i)
SELECT i, round(row_sum, 5) AS row_sum, row_number() OVER (ORDER BY row_sum, i) - 1 AS position FROM s
""")
def d19_order(spark: SparkSession, sf: str) -> DataFrame:
    """The dimensions in the order of their covariances' row sums, least first."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select(array_to_vector(
        F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    sums = md.correlation_matrix(e).groupBy("i").agg(F.sum("cov").alias("row_sum"))
    return global_rank(sums, ["row_sum", "i"], out="position", start=0).select("i", _r(F.col("row_sum"), 5).alias("row_sum"), "position")


# Logistic models ---------------------------------------------------------------------
@query("I17")
def i17_logistic(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _vectors(spark, sf)
    split = sp.stratified_split(v, "label", "doc_id", test_size=0.2, seed=1).select("doc_id", "is_test")
    v = v.join(split, "doc_id")
    train, test = v.where(~F.col("is_test")), v.where(F.col("is_test"))
    n = train.count()
    rows = []
    for pen in ("l2", "l1"):
        m = md.logistic(pen, 1.0, n).fit(train)
        acc = m.transform(test).select(md.accuracy(test)).first()[0]
        nz = int(sum(1 for x in m.coefficients.toArray() if x != 0))
        rows.append((pen, n, float(acc), nz))
    return spark.createDataFrame(rows, "penalty string, n_train long, accuracy double, n_nonzero long")


@query("I18")
def i18_accuracy_on_rows(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = _vectors(spark, sf)
    chosen = sp.balance(v.select("doc_id", "label"), "label", "doc_id", seed=2, per_class=20).select("doc_id")
    train, v = md.narrowed(v.join(chosen, "doc_id"), v)     # 40 rows
    acc = md.fit_accuracy(train, v, md.logistic("l2", 1.0, 40))
    return spark.createDataFrame([(40, float(acc))], "n_train long, accuracy double")


@query("I19")
def i19_perceptron_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Perceptrons with truncated L1 of 10 folds: accuracy, share of coefficients
    that are 0 (kind fold), and the histogram of all coefficients (kind
    histogram: x is a bin's left edge, n its coefficients)."""
    c = corpus(spark, sf)
    docs = c.select("doc_id", "label_id")
    long = df_cut(term_counts(c.select("doc_id", "tokens"), ngram_array(F.col("tokens"), 2)), F.lit(docs.count()), 2)
    coefs, predictions = perceptron_folds(long, docs, k=10, seed=4)
    coefs = landed(coefs, "perceptron-coefs")
    accuracy = predictions.groupBy("fold").agg(md.accuracy(predictions).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    sparsity = coefs.groupBy("fold").agg(F.avg((F.col("coef") == 0).cast("double")).alias("sparsity"))
    folds = accuracy.join(sparsity, "fold").select(F.lit("fold").alias("kind"), F.col("fold").cast("int").alias("fold"), F.lit(None).cast("double").alias("x"),
                                                   "n", "accuracy", "sparsity")
    bins = histogram(coefs, "coef", 20).select(F.lit("histogram").alias("kind"), F.col("left").alias("x"), "n")
    return folds.unionByName(bins, allowMissingColumns=True)


#: Replicates of the bootstrap, of the one in the confidence study, and that study's splits, as in the reference.
REPLICATES, STUDY_REPLICATES, STUDY_SPLITS = 100, 200, 20


def _counted(docs: DataFrame) -> lg.Counts:
    """Blocks of the counts of 1-2-grams in two documents and more."""
    return lg.Counts(docs, "tokens", min_df=2, ngram_max=2)


def _bootstrap(spark, sf, n_iter=10, proportion=0.5, penalty="l2"):
    v, m = _vectors(spark, sf)
    coefs = md.bootstrap_coefs(v, n_iter=n_iter, proportion=proportion, penalty=penalty, seed=0)
    return v, m, coefs


@query("I21")
def i21_bootstrap_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    k = _counted(c)
    margin = lg.mean_margin(k, lg.bootstrap(k, c, REPLICATES), REPLICATES)
    margin[k.sizes == 0] = float("nan")     # documents without terms are left out
    p = lg.scored(k, margin, "margin").where(~F.isnan("margin")).select("doc_id", lg.probability(F.col("margin")).alias("p1"))
    return p.join(c.select("doc_id", "label"), "doc_id").select(
        "doc_id", "label", (1 - F.col("p1")).alias("p0"), "p1", F.when(F.col("p1") >= 0.5, "high").otherwise("low").alias("pred"))


@query("E09")
def e09_convergence(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    k = _counted(c)
    chunks, shares = [], None
    for numbers, a, *rest in lg.bootstrap(k, c, n_iter=10):
        chunks.append((numbers, k.moments(a)))
        part = landed(lg.numbered(k, a), "shares").select("row", F.posexplode("a").alias("at", "share")).withColumn("replicate", (F.col("at") + numbers.start).cast("long"))
        shares = part if shares is None else shares.unionByName(part)
    moments = landed(lg.combined([m for _, m in chunks], 10), "moments")
    ids = landed(global_rank(moments.select("term", F.col("mean").alias("m")), ["term"], out="term_id", start=0), "term-ids")
    top = (ids.orderBy(F.desc("m"), "term_id").limit(25)
           .unionByName(ids.orderBy("m", "term_id").limit(25)).select("term_id", "term").distinct())   # at most 50 terms
    x = k.entries(top).join(F.broadcast(top), "term").select("term_id", "row", "value")
    coefs = x.join(shares, "row").groupBy("term_id", "replicate").agg(F.sum(F.col("value") * F.col("share")).alias("coef"))
    # a replicate that has drawn none of a term's documents gives it 0
    every = F.broadcast(top.select("term_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("replicate")))
    sel = every.join(coefs, ["term_id", "replicate"], "left").na.fill(0.0, ["coef"])
    return running_stats(sel, "coef", "replicate", ["term_id"]).select(
        "term_id", "replicate", "running_mean", "running_var")


@query("I31")
def i31_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Plain fits and bootstraps of the same splits: accuracy, mean of the larger probability, and the harmonic
    mean of the probabilities where the prediction is wrong."""
    c = corpus(spark, sf)
    k = _counted(c)
    rows = c.select("doc_id", "label", "label_id")
    split = sp.stratified_split(rows, "label", "doc_id", test_size=0.2, n_iter=STUDY_SPLITS, seed=9)
    rows = landed(rows.select("doc_id", "label_id").join(split.select("split", "doc_id", "is_test"), "doc_id"), "study-rows")
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    margins = np.zeros((k.n, 2 * STUDY_SPLITS))     # of the plain fits, then of the bootstraps
    for numbers, _, margin, _, _ in lg.fits(k, lg.train_members(train, F.col("split")), STUDY_SPLITS, lambda s, _: np.ones(len(s))):
        margins[:, numbers] = margin
    of, sizes, drawn = train.groupBy("split").count(), np.ones(STUDY_SPLITS), None
    for r in of.collect():      # a row a split
        sizes[r["split"]] = max(r["count"] // 2, 1)
    for s in range(STUDY_SPLITS):
        d = landed(lg.draws(train.where(F.col("split") == s), STUDY_REPLICATES, 0.5, seed=s).withColumn("fit", F.col("fit") + s * STUDY_REPLICATES), "draws")
        drawn = d if drawn is None else drawn.unionByName(d)
    for numbers, _, margin, _, _ in lg.fits(k, drawn, STUDY_SPLITS * STUDY_REPLICATES, lambda s, i: s / sizes[np.array(i) // STUDY_REPLICATES], intercept=False):
        for at, r in enumerate(numbers):
            margins[:, STUDY_SPLITS + r // STUDY_REPLICATES] += margin[:, at] / STUDY_REPLICATES
    models = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.get("z", F.col("split").cast("int") + first).alias("margin"))
                                 for name, first in (("logistic", 0), ("bootstrap", STUDY_SPLITS))])).alias("m")
    pr = test.join(lg.scored(k, margins, "z"), "doc_id").select("split", "label_id", models).select(
        F.col("split").cast("int").alias("split"), "m.model", "label_id", (F.col("m.margin") > 0).cast("double").alias("prediction"), lg.probability(F.col("m.margin")).alias("p1"))
    return pr.groupBy("split", "model").agg(
        md.accuracy(pr).alias("accuracy"), F.avg(F.greatest("p1", 1 - F.col("p1"))).alias("mean_best_proba"),
        F.avg(F.when(F.col("label_id") != F.col("prediction"), hmean_row("p1", 1 - F.col("p1")))).alias("error_hmean"))


@query("I32")
def i32_score_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The plain fit and the bootstrap by the plain fit's scores: accuracy of ten bins of ranks (``bin``), of
    quartiles, their middle and their extremes (``grp``), and each model's log loss."""
    c = corpus(spark, sf)
    k = _counted(c)
    rows = c.select("doc_id", "label", "label_id")
    split = sp.stratified_split(rows, "label", "doc_id", test_size=0.3, seed=12).select("doc_id", "is_test")
    rows = landed(rows.select("doc_id", "label_id").join(split, "doc_id"), "study-rows")
    train = rows.where(~F.col("is_test"))
    _, single, _ = lg.plain(k, train)
    mean = lg.mean_margin(k, lg.bootstrap(k, train, REPLICATES), REPLICATES)
    z = lg.scored(k, np.column_stack([single, mean]), "z")
    pr = landed(rows.where("is_test").join(z, "doc_id").select("doc_id", "label_id", *[
        x for i, name in enumerate(("logistic", "bootstrap")) for x in (lg.probability(F.get("z", F.lit(i))).alias(name), (F.get("z", F.lit(i)) > 0).cast("double").alias(f"{name}_says"))]), "study-scores")
    out = None
    for name in ("logistic", "bootstrap"):
        right = F.col("label_id") == F.col(f"{name}_says")
        ll = pr.select(log_loss(F.when(F.col("label_id") == 1, F.col(name)).otherwise(1 - F.col(name)))).scalar()
        bins = binned_accuracy(pr, "logistic", right, "doc_id", 10)
        found = bins.unionByName(quartile_accuracy(pr, "logistic", right), allowMissingColumns=True).withColumns({"log_loss": ll, "model": F.lit(name)})
        out = found if out is None else out.unionByName(found)
    return out


@query("I33")
def i33_coef_study(spark: SparkSession, sf: str) -> DataFrame:
    """The study of a bootstrap's coefficients as rows (kind, term, x, y):

    hist, var_hist (bin, n), quantile, var_quantile (q, value) of the means and of the variances over the
    replicates; total: the 10 terms with the largest counts (total, mean); extreme: the 12 with the largest
    absolute means (mean, variance); binned_hist (bin, n): variances of the terms' mean counts over bins of 7
    days; daily, weekly (bin, value): the extreme terms' mean counts a day, smoothed, and a week."""
    c = labelled_documents(spark, sf, inner=True).select(
        "doc_id", "published", (F.col("label") == "high").cast("double").alias("label_id"), tx.regex_tokens(F.lower("text"), "word2").alias("tokens"))
    k = _counted(c)
    moments = landed(lg.coefficient_moments(k, lg.bootstrap(k, c, REPLICATES), REPLICATES), "moments")
    day, week = (lg.document_bins(k, c, "published", n) for n in (1, 7))
    binned = k.per_term(week, lg.binned_variance, "total double, variance double")
    x = moments.join(binned.drop("df"), "term").cache()

    def rows(kind: str, df: DataFrame, of: str, to: str, term: str | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), (F.col(term) if term else F.lit(None).cast("string")).alias("term"), F.col(of).cast("double").alias("x"), F.col(to).cast("double").alias("y"))

    top = x.orderBy(F.desc("total"), "term").limit(10)
    extreme = landed(x.orderBy(F.desc(F.abs("mean")), "term").limit(12), "extreme")
    found = [rows("hist", histogram(moments, "mean", 20), "bin", "n"), rows("quantile", quantiles(moments, "mean"), "q", "value"),
             rows("var_hist", histogram(moments, "var", 20), "bin", "n"), rows("var_quantile", quantiles(moments, "var"), "q", "value"),
             rows("total", top, "total", "mean", "term"), rows("extreme", extreme, "mean", "var", "term"),
             rows("binned_hist", histogram(binned, "variance", 20), "bin", "n")]
    for kind, bins, window, alpha in (("daily", day, 7, 0.5), ("weekly", week, 1, 1.0)):
        series = lg.term_series(k, extreme, bins)
        found.append(rows(kind, exponential_decay(series, "mean", "bin", ["term"], window=window, alpha=alpha), "bin", "smoothed", "term"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("I37")
def i37_l1_bootstrap_hist(spark: SparkSession, sf: str) -> DataFrame:
    v, m, coefs = _bootstrap(spark, sf, n_iter=5, proportion=1.0, penalty="l1")
    mean = coefs.groupBy("term_id").agg(F.avg("coef").alias("mean"))
    return histogram(mean, "mean", 20)


@query("I30")
def i30_self_train(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy on the labelled documents of a fit on them, of one on the predictions for the others, and of the
    labelled documents' bootstrap, with the share of terms whose mean coefficient is 0 (sparsity)."""
    c = labelled_documents(spark, sf).select(
        "doc_id", "label", (F.col("label") == "high").cast("double").alias("label_id"),
        tx.regex_tokens(F.lower("text"), "word2").alias("tokens"))
    k = _counted(c)
    rows = c.select("doc_id", "label_id")
    lab, unl = rows.where(F.col("label_id").isNotNull()), rows.where(F.col("label_id").isNull())
    _, first, _ = lg.plain(k, lab)
    says = lg.scored(k, first, "margin").select("doc_id", (F.col("margin") > 0).cast("double").alias("says"))
    _, second, _ = lg.plain(k, landed(unl.join(says, "doc_id").select("doc_id", F.col("says").alias("label_id")), "pseudo"))
    mean, parts = np.zeros(k.n), []
    for _, a, margin, _, _ in lg.bootstrap(k, lab, REPLICATES, proportion=1.0):
        mean += margin.sum(1)
        parts.append(k.moments(a))
    sparsity = lg.combined(parts, REPLICATES).agg(F.avg((F.col("mean") == 0).cast("double")))
    z = lab.join(lg.scored(k, np.column_stack([first, second, mean]), "z"), "doc_id")
    names = ("supervised", "self_trained", "bootstrap")
    accs = z.agg(*[F.avg(((F.get("z", F.lit(i)) > 0).cast("double") == F.col("label_id")).cast("double")).alias(name) for i, name in enumerate(names)])   # one row
    return accs.select(F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).alias("accuracy")) for x in names])).alias("m")) \
        .select("m.model", "m.accuracy").withColumn("sparsity", F.when(F.col("model") == "bootstrap", sparsity.scalar()))


def _curve_sql(n_iter: int = 20) -> str:
    """The learning curve in SQL, for the two classes and at most 14 sizes; sizes that the table is too small for drop out at the end."""
    sizes = ", ".join(f"CAST({s} AS BIGINT)" if s >= 1 else f"CAST(floor({s} * n) AS BIGINT)" for s in md.TRAIN_SIZES)
    cells = [(c, z) for c in ("high", "low") for z in range(1, len(md.TRAIN_SIZES) + 1)]
    trains = "label = '{c}' AND rank < s[{z}]"
    logs = ",\n  ".join(f"ln(coalesce(sum(value) FILTER ({trains.format(c=c, z=z)}), 0) + 1) AS l_{c}_{z}" for c, z in cells)
    words = ",\n  ".join(f"ln(coalesce(sum(value) FILTER ({trains.format(c=c, z=z)}), 0) + (SELECT V FROM V)) AS w_{c}_{z}" for c, z in cells)
    priors = ",\n  ".join(f"CASE WHEN count(*) FILTER ({trains.format(c=c, z=z)}) > 0 THEN ln(count(*) FILTER ({trains.format(c=c, z=z)}) / CAST(any_value(s)[{z}] AS DOUBLE)) ELSE -1e300 END AS p_{c}_{z}"
                          for c, z in cells)
    sums = ",\n  ".join(f"sum(value * l_{c}_{z}) AS s_{c}_{z}" for c, z in cells)
    score = "coalesce(s_{c}_{z} - total * w_{c}_{z}, 0) + p_{c}_{z}"
    best = ",\n  ".join(f"CASE WHEN {score.format(c='low', z=z)} >= {score.format(c='high', z=z)} THEN 'low' ELSE 'high' END" for z in range(1, len(md.TRAIN_SIZES) + 1))
    return rf"""
WITH c AS ({LAB_SQL}), n AS (SELECT count(*) AS n FROM c), z AS (SELECT list_sort(list_distinct([{sizes}])) AS s FROM n),
p AS (SELECT c.doc_id, label, CAST(split AS BIGINT) AS split, row_number() OVER (PARTITION BY split, label ORDER BY {key_sql('doc_id', 40, 'split')}, doc_id) AS rn,
        count(*) OVER (PARTITION BY split, label) AS k FROM c, range(0, {n_iter}) t(split)),
o AS (SELECT split, doc_id, label, row_number() OVER (PARTITION BY split ORDER BY (rn - 0.5) / k, label, doc_id) - 1 AS rank, s FROM p, z),
t AS (SELECT c.doc_id, unnest(regexp_extract_all(lower(text), {W2})) AS term FROM c JOIN documents d ON c.doc_id = d.doc_id),
L AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS value FROM t GROUP BY 1, 2),
V AS (SELECT count(DISTINCT term) AS V FROM L),
x AS (SELECT o.*, term, value FROM L JOIN o ON L.doc_id = o.doc_id),
terms AS (SELECT split, term, {logs} FROM x GROUP BY split, term),
words AS (SELECT split, {words} FROM x GROUP BY split),
priors AS (SELECT split, {priors} FROM o GROUP BY split),
per AS (SELECT x.split, doc_id, sum(value) AS total, {sums} FROM x JOIN terms ON x.split = terms.split AND x.term = terms.term GROUP BY 1, 2),
b AS (SELECT o.split, o.label, o.rank, o.s, unnest([{best}]) AS pred, unnest(range(1, {len(md.TRAIN_SIZES) + 1})) AS z
  FROM o LEFT JOIN per ON o.split = per.split AND o.doc_id = per.doc_id JOIN words ON o.split = words.split JOIN priors ON o.split = priors.split),
r AS (SELECT s[z] AS train, split, count(*) AS n_test, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM b WHERE z <= len(s) AND rank >= s[z] AND s[z] < (SELECT n FROM n) AND s[z] > 0 GROUP BY 1, 2),
base AS (SELECT max(k) / CAST(sum(k) AS DOUBLE) AS baseline FROM (SELECT count(*) AS k FROM c GROUP BY label))
SELECT 'naive_bayes' AS model, train, count(*) AS splits, CAST(min(n_test) AS BIGINT) AS test, round(avg(accuracy), 6) AS accuracy, round(any_value(baseline), 6) AS baseline,
       round(1 - (1 - avg(accuracy)) / (1 - any_value(baseline)), 6) AS improvement
FROM r, base GROUP BY train"""


@query("I27", sql=_curve_sql())
def i27_learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Naive Bayes over all training sizes and 20 splits, in one job."""
    c = corpus(spark, sf)
    long = term_counts(c.select("doc_id", "tokens"), F.col("tokens"))
    docs = c.select("doc_id", "label")
    r = md.naive_bayes_curve(long, docs, seed=40)
    base = docs.groupBy("label").count().select((F.max("count") / F.sum("count"))).scalar()
    a = F.avg("accuracy")
    return (r.groupBy(F.lit("naive_bayes").alias("model"), "train").agg(F.count(F.lit(1)).alias("splits"), F.min("n_test").alias("test"), a.alias("a"))
            .select("model", "train", "splits", "test", _r(F.col("a")).alias("accuracy"), _r(base).alias("baseline"),
                    _r(1 - (1 - F.col("a")) / (1 - base)).alias("improvement")))


@query("I27_fits")
def i27_fitted_curve(spark: SparkSession, sf: str) -> DataFrame:
    v, vocab = _vectors(spark, sf)
    long, size = _bigrams(spark, sf), vocab.count()
    rows = []
    for train_n in (100, 200):
        for s in range(2):
            split = sp.stratified_split(v, "label", "doc_id", test_size=0.25, seed=20 + s).select("doc_id", "is_test")
            vv = v.join(split, "doc_id")
            tr = landed(sp.balance(vv.where(~F.col("is_test")), "label", "doc_id", seed=s, per_class=train_n // 2), "curve-train")
            te = vv.where(F.col("is_test"))
            t0 = time.time()
            few, test = md.narrowed(tr, te)
            acc = md.logistic("l2", 1.0, train_n).fit(few).transform(test).select(md.accuracy(test)).first()[0]
            rows.append(("logistic", train_n, s, float(acc), round(time.time() - t0, 3)))
            t0 = time.time()
            sets = [x.groupBy("doc_id", "label_id").agg(F.count(F.lit(1)).alias("weight")).withColumns({"split": F.lit(s), "is_test": F.lit(i == 1)}) for i, x in enumerate((tr, te))]
            acc = md.naive_bayes_holdout(long, sets[0].unionByName(sets[1]), size).first().accuracy
            rows.append(("naive_bayes", train_n, s, float(acc), round(time.time() - t0, 3)))
    r = spark.createDataFrame(rows, "model string, train long, split int, accuracy double, elapsed double")
    base = corpus(spark, sf).groupBy("label").count().select((F.max("count") / F.sum("count"))).scalar()
    return r.groupBy("model", "train").agg(F.avg("accuracy").alias("accuracy"), F.avg("elapsed").alias("elapsed")) \
        .withColumn("baseline", base) \
        .withColumn("improvement", 1 - (1 - F.col("accuracy")) / (1 - F.col("baseline")))


@query("D26")
def d26_holdout(spark: SparkSession, sf: str) -> DataFrame:
    long = _bigrams(spark, sf)
    docs = corpus(spark, sf).select("doc_id", "label", "label_id")
    split = sp.stratified_split(docs, "label", "doc_id", test_size=0.1, n_iter=10, seed=30)
    accs = [r.accuracy for r in md.naive_bayes_holdout(long, md.split_members(docs, split), long.select("term").distinct().count()).orderBy("split").collect()]    # 10 rows
    return spark.createDataFrame([(10, float(sum(accs) / len(accs)))], "n_iter long, mean_accuracy double")


# Topic models ----------------------------------------------------------------------
def _log_weights(long: DataFrame, n: int) -> DataFrame:
    """I08's weights of counts that hold their term's df."""
    return long.withColumn("value", F.col("value") * F.log(F.lit(n) / F.col("df")))


def _topic_vectors(spark, sf):
    toks = tx.regex_tokens("text", "alpha", lower=True, min_len=2, max_len=15)
    c = table(spark, sf, "documents").select("doc_id", tx.drop_stopwords(toks, tx.TOPIC_EXTRA_STOPWORDS).alias("tokens"))
    return md.term_vectors(c, "tokens", weight=_log_weights)


@query("I12")
def i12_lda(spark: SparkSession, sf: str) -> DataFrame:
    v, vocab = _topic_vectors(spark, sf)
    _, topics = md.lda_topics(v, vocab, k=5)
    return topics


@query("I13")
def i13_lda_hashwords(spark: SparkSession, sf: str) -> DataFrame:
    """Topic keys (kind topic: topic, rank, term, weight) and the top topic of
    every document (kind document: doc_id, topic, weight)."""
    stop = [*ENGLISH_STOPWORDS, *tx.TOPIC_EXTRA_STOPWORDS]
    c = table(spark, sf, "documents").select("doc_id", tx.drop_stopwords(
        tx.regex_tokens("text", "hashword", lower=True), stop).alias("tokens"))
    v, vocab = md.term_vectors(c, "tokens")
    model, topics = md.lda_topics(v, vocab, k=4, optimize_doc_concentration=True)
    docs = md.document_topics(model, v).select(F.lit("document").alias("kind"), "doc_id", F.col("top_topic").cast("int").alias("topic"),
                                               F.col("top_weight").alias("weight"))
    return topics.withColumn("kind", F.lit("topic")).unionByName(docs, allowMissingColumns=True)


@query("I14")
def i14_lda_per_label(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    out = None
    for lab in sorted(r[0] for r in c.select("label").distinct().collect()):     # class names: bounded
        v, vocab = md.term_vectors(c.where(F.col("label") == lab), "tokens", weight=_log_weights)
        _, t = md.lda_topics(v, vocab, k=5)
        t = t.withColumn("label", F.lit(lab))
        out = t if out is None else out.unionByName(t)
    return out


@query("I16")
def i16_doc_topics(spark: SparkSession, sf: str) -> DataFrame:
    v, vocab = _topic_vectors(spark, sf)
    model, _ = md.lda_topics(v, vocab, k=5)
    return md.document_topics(model, v)


@query("D22_topics")
def d22_document_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic totals over the documents' own topic shares."""
    from ..operators.aggregate import topic_totals
    v, vocab = _topic_vectors(spark, sf)
    model, _ = md.lda_topics(v, vocab, k=5)
    shares = model.transform(v).select("doc_id", F.posexplode(md.vector_to_array("topicDistribution")).alias("topic", "ratio"))
    return topic_totals(shares, "doc_id", "topic", "ratio").select(F.col("topic").cast("long").alias("topic"), _r(F.col("total"), 5).alias("total"), "first", "second")


@query("I15")
def i15_pca(spark: SparkSession, sf: str) -> DataFrame:
    """The centred scores of two components of the smoothed, normalised weights."""
    from ..operators.links import boilerplate_free
    c = boilerplate_free(table(spark, sf, "pages")).select(
        F.col("page_id").alias("doc_id"), tx.regex_tokens("content", "word2", lower=True).alias("tokens"))
    long = cut_lineage(term_counts(c, F.col("tokens")))
    docs = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    n = F.lit(docs.count())
    scores, _, _ = principal_components(tfidf_join(df_cut(long, n, 2, 0.95), n), docs)
    return scores.select(F.col("doc_id").alias("page_id"), F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


# Hashtags as labels / out-of-corpus errors ---------------------------------------------
@query("I35")
def i35_hashtag_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Top-20 source tags as labels, at most 1000 texts per tag in arrival
    order, the tag removed from its text, 10 folds of L2 logistic fits.
    Confusion counts (label, predicted, n) per fold beside the fold's
    accuracy and log loss."""
    from pyspark.ml.feature import StringIndexer
    from ..operators.ranking import top_k_per_group
    d = table(spark, sf, "documents")
    txt = F.concat(F.col("text"), F.lit(" #"), F.col("source"))
    tagged = d.select("doc_id", txt.alias("t")).select("doc_id", "t", F.explode(F.array_distinct(tx.hashtags("t"))).alias("tag"))
    top = tagged.groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(20).select("tag")
    sel = tagged.join(F.broadcast(top), "tag")    # 20 rows
    sel = top_k_per_group(sel, ["tag"], ["doc_id"], 1000, out="rn")
    # a document stands once under each of its tags
    sel = sel.select(F.concat_ws("|", "doc_id", "tag").alias("doc_id"), "tag", F.regexp_extract_all(
        F.lower(tx.remove_tag("t", "tag")), F.lit(r"(?U)\b\S+\b"), 0).alias("tokens"))
    index = StringIndexer(inputCol="tag", outputCol="label_id").fit(sel)
    v, _ = md.term_vectors(index.transform(sel), "tokens", min_df=2, max_df=0.99)
    v = sp.kfold(v, "doc_id", 10, seed=6)
    names = F.array(*[F.lit(x) for x in index.labels])
    out = None
    for f in range(10):
        tr, te = v.where(F.col("fold") != f), v.where(F.col("fold") == f)
        pr = md.logistic("l2", 1.0, tr.count(), max_iter=20).fit(tr).transform(te)
        p_true = F.get(md.vector_to_array("probability"), F.col("label_id").cast("int"))
        total = pr.agg(md.accuracy(pr).alias("accuracy"), log_loss(p_true).alias("log_loss"))    # one row
        cells = pr.groupBy(F.lit(f).alias("fold"), F.col("tag").alias("label"), F.get(names, F.col("prediction").cast("int")).alias("predicted")) \
            .agg(F.count(F.lit(1)).alias("n"))
        cells = cells.crossJoin(F.broadcast(total))
        out = cells if out is None else out.unionByName(cells)
    return out


@query("I36")
def i36_out_of_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The wrongly classified held-out documents of two sources: text, class
    probabilities and the ascending contributions of their terms."""
    d = table(spark, sf, "documents")
    u = d.where(F.col("source").isin("src0", "src1")).select(
        "doc_id", "text", F.col("source").alias("label"),
        (F.col("source") == "src1").cast("double").alias("label_id"),
        tx.regex_tokens(F.lower("text"), "word2").alias("tokens"))
    k = _counted(u)
    split = sp.stratified_split(u.select("doc_id", "label"), "label", "doc_id", test_size=0.3, seed=8).select("doc_id", "is_test")
    v = u.drop("tokens").join(split, "doc_id")
    shares, margin, _ = lg.plain(k, v.where(~F.col("is_test")))
    p1 = lg.probability(F.col("margin"))
    wrong = landed(v.where("is_test").join(lg.scored(k, margin, "margin"), "doc_id").withColumn("prediction", (F.col("margin") > 0).cast("double"))
                   .where(F.col("prediction") != F.col("label_id")).select("doc_id", "label", "prediction", "text", F.array(1 - p1, p1).alias("probabilities")), "wrong")
    coefs = k.moments(shares).select("term", F.col("s").alias("coef"))
    long = term_counts(u.join(wrong.select("doc_id"), "doc_id", "left_semi"), ngram_array(F.col("tokens"), 2))
    return wrong.join(md.feature_contributions(long, coefs), "doc_id")


# Single linkage -----------------------------------------------------------------------
_CORR_SQL = """
x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS c FROM x),
n AS (SELECT vec_id, list_transform(c, lambda v: v / sqrt(list_inner_product(c, c))) AS u FROM c WHERE list_inner_product(c, c) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, greatest(0, 1 - list_inner_product(a.u, b.u)) AS h FROM n a JOIN n b ON a.vec_id <> b.vec_id)"""


@query("I38", sql=f"""
WITH RECURSIVE {_CORR_SQL},
t AS (SELECT 0 AS step, b AS v, h, a AS up FROM p WHERE a = (SELECT min(vec_id) FROM n)
  UNION ALL
  SELECT t.step + 1, t.v, least({{'h': t.h, 'a': least(t.v, t.up), 'b': greatest(t.v, t.up)}}, {{'h': p.h, 'a': least(p.a, p.b), 'b': greatest(p.a, p.b)}}).h,
         CASE WHEN {{'h': t.h, 'a': least(t.v, t.up), 'b': greatest(t.v, t.up)}} <= {{'h': p.h, 'a': least(p.a, p.b), 'b': greatest(p.a, p.b)}} THEN t.up ELSE p.a END
  FROM t, (SELECT arg_min(v, {{'h': h, 'a': least(v, up), 'b': greatest(v, up)}}) AS m FROM t) m, p WHERE p.a = m.m AND p.b = t.v AND t.v <> m.m),
e AS (SELECT step, min({{'h': h, 'a': least(v, up), 'b': greatest(v, up)}}) AS e FROM t GROUP BY step)
SELECT e.a AS a, e.b AS b, round(e.h, 6) AS height FROM e
""")
def i38_single_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the single-linkage tree of all embeddings by correlation distance."""
    tree, _ = single_linkage(table(spark, sf, "embeddings"))
    return tree.select("a", "b", _r(F.col("height")).alias("height"))


@query("I38_cut", sql=f"""
WITH RECURSIVE {_CORR_SQL},
k AS (SELECT a, b FROM p WHERE h <= 0.55),
r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, k.b FROM r JOIN k ON r.other = k.a)
SELECT id, min(other) AS cluster FROM r GROUP BY id
""")
def i38_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters of the tree cut at a height of 0.55, each named by its smallest id."""
    e = table(spark, sf, "embeddings")
    tree, _ = single_linkage(e)
    return cut_tree(tree, e.select(F.col("vec_id").alias("id")), 0.55)
