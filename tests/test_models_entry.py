"""Naive Bayes and chi-squared against brute-force NumPy twins; the entry
contract; a sample of registered queries against their DuckDB oracles."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import models as md
from corpusflow.operators.sampling import kfold
from tests.conftest import SF001

DOCS = [(0, "a", ["x", "y", "x"]), (1, "a", ["x", "z"]), (2, "b", ["y", "y", "w"]), (3, "b", ["w", "z"]),
        (4, "a", ["x", "x", "x"]), (5, "b", ["w", "y"]), (6, "a", ["z", "x"]), (7, "b", ["y", "w", "w"])]


def _long(spark):
    rows = []
    for d, _, toks in DOCS:
        for t in set(toks):
            rows.append((d, t, toks.count(t)))
    return spark.createDataFrame(rows, "doc_id long, term string, value long")


def test_naive_bayes_cv_matches_numpy(spark):
    long = _long(spark)
    docs = spark.createDataFrame([(d, l) for d, l, _ in DOCS], "doc_id long, label string")
    k = 3
    got = {r["fold"]: r["correct"] for r in md.naive_bayes_cv(long, docs, k=k, seed=0).collect()}
    folds = {r["doc_id"]: r["fold"] for r in kfold(docs, "doc_id", k, 0).collect()}
    vocab = sorted({t for _, _, ts in DOCS for t in ts})
    X = np.array([[ts.count(t) for t in vocab] for _, _, ts in DOCS], dtype=float)
    y = np.array([l for _, l, _ in DOCS])
    want = {}
    for f in set(folds.values()):
        te = np.array([folds[d] == f for d, _, _ in DOCS])
        tr = ~te
        scores = {}
        for c in ("a", "b"):
            m = tr & (y == c)
            prior = m.sum() / tr.sum()
            theta = (X[m].sum(0) + 1) / (X[m].sum() + len(vocab))
            with np.errstate(divide="ignore"):  # a class without training documents has no chance
                scores[c] = np.log(prior) + X[te] @ np.log(theta)
        pred = np.where(scores["a"] >= scores["b"], "a", "b")
        # ties go to the larger class name, as the Spark max_by over (score, class)
        pred = np.where(scores["a"] == scores["b"], "b", pred)
        want[f] = int((pred == y[te]).sum())
    assert got == want


def test_chi2_matches_numpy(spark):
    long = _long(spark)
    docs = spark.createDataFrame([(d, l) for d, l, _ in DOCS], "doc_id long, label string")
    got = {r["term"]: r["chi2"] for r in md.chi2_scores(long, docs).collect()}
    vocab = sorted({t for _, _, ts in DOCS for t in ts})
    X = np.array([[ts.count(t) for t in vocab] for _, _, ts in DOCS], dtype=float)
    Y = np.array([[l == "a", l == "b"] for _, l, _ in DOCS], dtype=float)
    obs = Y.T @ X
    exp = np.outer(Y.mean(0), X.sum(0))
    want = ((obs - exp) ** 2 / exp).sum(0)
    for t, w in zip(vocab, want):
        assert abs(got[t] - w) < 1e-9


def test_bootstrap_probabilities_sum_to_one(spark):
    long = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0)], "doc_id long, term_id long, value double")
    coefs = spark.createDataFrame([(0, 0, 0.5), (0, 1, -0.2), (1, 0, 0.1), (1, 1, 0.3)], "replicate long, term_id long, coef double")
    for r in md.predict_mean_coef(long, coefs).collect():
        assert abs(r["p0"] + r["p1"] - 1) < 1e-12


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["label", "rank", "term", "score", "df"]


def test_contract_keys():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150


SAMPLE = ["F03", "E07", "E01", "D15", "I08", "I20", "C02", "H06", "D13", "A03", "J05", "I22", "D03", "E11"]


@pytest.fixture(scope="module")
def duck():
    from corpusflow.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if v is not None and hasattr(v, "isoformat"):
        return str(v)
    return v


@pytest.mark.parametrize("qid", SAMPLE)
def test_query_matches_oracle(spark, duck, qid):
    import __spark_entry__ as E
    sdf = E.queries()[qid](spark, SF001)
    cols = sdf.columns
    a = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    res = duck.execute(E.oracle_sql()[qid])
    dcols = [d[0] for d in res.description]
    idx = [dcols.index(c) for c in cols]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert a == b


def test_term_vectors_match_numpy(spark):
    c = spark.createDataFrame([(d, l, t) for d, l, t in DOCS] + [(8, "a", []), (9, "b", None)], "doc_id long, label string, tokens array<string>")
    v, vocab = md.term_vectors(c, min_df=2, max_df=0.9, ngram_max=2)
    grams = {d: t + [f"{a} {b}" for a, b in zip(t, t[1:])] for d, _, t in DOCS}
    df = {}
    for g in grams.values():
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    kept = sorted(t for t, n in df.items() if 2 <= n <= 0.9 * 10)
    assert [(r["term_id"], r["term"], r["df"]) for r in vocab.orderBy("term_id").collect()] == [(i, t, df[t]) for i, t in enumerate(kept)]
    got = {r["doc_id"]: r["features"].toArray().tolist() for r in v.collect()}
    assert got == {**{d: [float(g.count(t)) for t in kept] for d, g in grams.items()}, 8: [0.0] * len(kept), 9: [0.0] * len(kept)}
    assert v.columns == ["doc_id", "label", "features"]


def test_vocabulary_has_no_cap(spark):
    c = spark.range(3000).select(F.col("id").alias("doc_id"), F.transform(
        F.sequence(F.col("id") * 100, F.col("id") * 100 + 99), lambda x: F.concat(F.lit("t"), x.cast("string"))).alias("tokens"))
    v, vocab = md.term_vectors(c)
    assert vocab.count() == 300_000 and vocab.select("term_id").distinct().count() == 300_000
    r = v.where("doc_id = 17").first()["features"]
    assert r.size == 300_000 and len(r.indices) == 100 and set(r.values) == {1.0}


def test_bootstrap_coefs_of_every_replicate(spark):
    c = spark.createDataFrame([(d, float(l == "a"), t) for d, l, t in DOCS], "doc_id long, label_id double, tokens array<string>")
    v, vocab = md.term_vectors(c)
    coefs = md.bootstrap_coefs(v, n_iter=3, proportion=1.0)
    assert {(r["replicate"], r["n"]) for r in coefs.groupBy("replicate").agg(F.count("*").alias("n")).collect()} == {(i, vocab.count()) for i in range(3)}
    mean = {r["term"]: r["c"] for r in coefs.join(vocab, "term_id").groupBy("term").agg(F.avg("coef").alias("c")).collect()}
    assert mean["x"] > 0 > mean["w"]


def _labelled(spark):
    rng = np.random.default_rng(5)
    rows = [(d, "high" if d % 3 else "low", float(d % 3 > 0), [f"w{i}" for i in rng.integers(0, 25 if d % 3 else 18, 12)]) for d in range(40)]
    rows[7] = (7, "high", 1.0, [])
    return spark.createDataFrame(rows, "doc_id long, label string, label_id double, tokens array<string>")


def test_holdout_matches_spark_naive_bayes(spark):
    from pyspark.ml.classification import NaiveBayes
    from corpusflow.operators import sampling as sp
    from corpusflow.operators.features import term_counts
    c = _labelled(spark)
    v, vocab = md.term_vectors(c, "tokens")
    split = sp.stratified_split(v, "label", "doc_id", test_size=0.3, n_iter=3, seed=2)
    want = {}
    for s in range(3):
        vv = v.join(split.where(F.col("split") == s).select("doc_id", "is_test"), "doc_id")
        te = vv.where("is_test")
        want[s] = NaiveBayes(featuresCol="features", labelCol="label_id").fit(vv.where("not is_test")).transform(te).select(md.accuracy(te)).first()[0]
    long = term_counts(c.select("doc_id", "tokens"), F.col("tokens"))
    got = {r.split: r.accuracy for r in md.naive_bayes_holdout(long, md.split_members(c, split), vocab.count()).collect()}
    assert got == pytest.approx(want)


def test_narrowed_fit_is_the_fit_of_the_whole_vocabulary(spark):
    v, vocab = md.term_vectors(_labelled(spark), "tokens")
    train = v.where("doc_id < 6")
    few, every = md.narrowed(train, v)
    whole, small = md.logistic("l2", 1.0, 6).fit(train), md.logistic("l2", 1.0, 6).fit(few)
    assert small.numFeatures < whole.numFeatures == vocab.count()
    p = lambda m, x: [r[0] for r in m.transform(x).orderBy("doc_id").select(F.get(md.vector_to_array("probability"), 1)).collect()]
    assert p(small, every) == pytest.approx(p(whole, v), abs=1e-9)


def test_weighted_vectors_make_their_tokens_once(spark):
    from corpusflow.plans.models import _log_weights
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(d, t) for d, _, t in DOCS], "doc_id long, tokens array<string>")
    v, vocab = md.term_vectors(rows.mapInArrow(counted, rows.schema), weight=_log_weights)
    assert read.value == 3 * len(DOCS)      # for their number, for the counts, and for the documents themselves
    df = {r["term"]: (r["term_id"], r["df"]) for r in vocab.collect()}
    for r in v.collect():
        toks = DOCS[r["doc_id"]][2]
        want = {df[t][0]: toks.count(t) * math.log(len(DOCS) / df[t][1]) for t in set(toks)}
        assert dict(zip(r["features"].indices.tolist(), r["features"].values.tolist())) == pytest.approx(want)
