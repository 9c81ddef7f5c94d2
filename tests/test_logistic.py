"""Fits in lockstep over document shares against Spark ML's, and the studies built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import logistic as lg
from corpusflow.operators import models as md


def _rows(n=40, seed=5):
    rng = np.random.default_rng(seed)
    return [(d, "high" if d % 3 else "low", float(d % 3 > 0), [f"w{i}" for i in rng.integers(0, 25 if d % 3 else 18, 12)] if d != 7 else []) for d in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), "doc_id long, label string, label_id double, tokens array<string>").repartition(3)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of which some are labelled, and labels."""
    d = tmp_path_factory.mktemp("study")
    rows = [(i, " ".join(t) or "w1 w2", "en", f"src{i % 2}", 10, int(label == "high")) for i, label, _, t in _rows(60)]
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] % 4], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def _query(spark, name, tables):
    import __spark_entry__ as E
    return E.queries()[name](spark, tables).collect()


def test_plain_fit_is_spark_mls(spark, docs):
    v, vocab = md.term_vectors(docs, "tokens", min_df=2, ngram_max=2)
    m = md.logistic("l2", 1.0, 40, max_iter=500).setTol(1e-10).fit(v)
    k = lg.Counts(docs, "tokens", min_df=2, ngram_max=2)
    assert k.n == 40 and k.sizes.sum() == sum(len(r["features"].indices) for r in v.collect())
    a, margin, b = lg.plain(k, docs)
    want = {r[0]: r[1] for r in m.transform(v).select("doc_id", F.get(md.vector_to_array("rawPrediction"), 1)).collect()}
    got = {r[0]: r[1] for r in lg.scored(k, margin, "z").collect()}
    assert got == pytest.approx(want, abs=1e-2) and b[0] == pytest.approx(m.intercept, abs=1e-2)
    coefs = {r.term: r.coef for r in vocab.join(md.coefficients(spark, m), "term_id").collect()}
    found = {r.term: (r.df, r.s) for r in k.moments(a).collect()}
    assert {t: s for t, (_, s) in found.items()} == pytest.approx(coefs, abs=1e-2)
    assert {t: n for t, (n, _) in found.items()} == {r.term: r.df for r in vocab.collect()}


def test_bootstrap_is_spark_mls_in_any_number_of_steps(spark, docs, monkeypatch):
    v, vocab = md.term_vectors(docs, "tokens", min_df=2, ngram_max=2)
    want = {r.term: (r.m, r.v) for r in md.bootstrap_coefs(v, n_iter=4, proportion=0.5).join(vocab, "term_id").groupBy("term").agg(F.avg("coef").alias("m"), F.var_pop("coef").alias("v")).collect()}
    k = lg.Counts(docs, "tokens", min_df=2, ngram_max=2)
    monkeypatch.setattr(lg, "MOST_CELLS", 80)   # two fits at a time
    got = {r.term: (r.mean, r.var) for r in lg.coefficient_moments(k, lg.bootstrap(k, docs, 4), 4).collect()}
    assert set(got) == set(want)
    for t in want:
        assert got[t] == pytest.approx(want[t], abs=1e-2)


def test_nothing_as_long_as_the_vocabulary_is_on_the_driver(spark, monkeypatch):
    c = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("double").alias("label_id"), F.transform(
        F.sequence(F.lit(0), F.lit(2999)), lambda x: F.concat(F.lit("t"), (x + 1000 * (F.col("id") % 4)).cast("string"))).alias("tokens"))
    k = lg.Counts(c, "tokens", min_df=2)
    seen, multiply = [], k.multiply
    monkeypatch.setattr(k, "multiply", lambda x: seen.append(x.shape) or multiply(x))
    _, margin, _ = lg.plain(k, c)
    assert set(seen) == {(30, 1)} and ((margin > 0) == (np.arange(30) % 2 > 0)).all()


def test_odd_rows(spark):
    """Rows of one document count together; rows without a class or an id train nothing; no term at all is a fit of the intercept."""
    rows = [(0, 1.0, ["x", "y"]), (0, 1.0, ["x", "y"]), (1, 0.0, ["y"]), (2, None, ["x"]), (3, 0.0, None), (None, 1.0, ["x"])]
    c = spark.createDataFrame(rows, "doc_id long, label_id double, tokens array<string>")
    k = lg.Counts(c)
    assert k.n == 4
    positive, every = lg.weights(k, lg.train_members(c), 1)
    assert positive[:, 0].tolist() == [2, 0, 0, 0] and every[:, 0].tolist() == [2, 1, 0, 1]
    none = lg.Counts(c, min_df=9)
    _, margin, b = lg.plain(none, c)
    assert margin == pytest.approx([0.0] * 4, abs=1e-6) and none.sizes.sum() == 0 and none.moments(np.zeros((4, 1))).count() == 0


def test_ensemble_has_all_replicates(spark, tables, monkeypatch):
    from corpusflow.plans import models as pm
    seen, fit = [], lg.fit
    monkeypatch.setattr(lg, "fit", lambda m, positive, *a, **b: seen.append(positive.shape[1]) or fit(m, positive, *a, **b))
    r = _query(spark, "I21", tables)
    assert sum(seen) == pm.REPLICATES == 100 and len(r) == 45
    assert all(abs(x.p0 + x.p1 - 1) < 1e-12 and (x.pred == "high") == (x.p1 >= 0.5) for x in r)


def test_self_training_has_the_bootstraps_sparsity(spark, tables):
    r = {x.model: x for x in _query(spark, "I30", tables)}
    assert set(r) == {"supervised", "self_trained", "bootstrap"}
    assert 0 <= r["bootstrap"].sparsity < 1 and r["bootstrap"].accuracy > 0.6 and r["supervised"].sparsity is None


def test_confidence_compares_both_models_on_every_split(spark, tables, monkeypatch):
    from corpusflow.plans import models as pm
    assert pm.STUDY_REPLICATES == 200
    monkeypatch.setattr(pm, "STUDY_REPLICATES", 5)  # a shorter test
    r = _query(spark, "I31", tables)
    assert {(x.split, x.model) for x in r} == {(s, m) for s in range(20) for m in ("logistic", "bootstrap")} and len(r) == 40
    mean = {m: np.mean([x.mean_best_proba for x in r if x.model == m]) for m in ("logistic", "bootstrap")}
    assert 0.5 < mean["bootstrap"] and mean["bootstrap"] != mean["logistic"]


def test_score_bins_hold_both_models(spark, tables):
    r = _query(spark, "I32", tables)
    for model in ("logistic", "bootstrap"):
        mine = [x for x in r if x.model == model]
        tested = sum(x.n for x in mine if x.bin is not None)
        assert sum(x.n for x in mine if x.grp in ("middle", "extreme")) == sum(x.n for x in mine if x.grp and x.grp[0] == "q") == tested == 14
        assert len({x.log_loss for x in mine}) == 1
    assert len({x.log_loss for x in r}) == 2


def test_coefficient_study_has_all_parts(spark, tables):
    r = _query(spark, "I33", tables)
    by = {}
    for x in r:
        by.setdefault(x.kind, []).append(x)
    assert set(by) == {"hist", "quantile", "var_hist", "var_quantile", "total", "extreme", "binned_hist", "daily", "weekly"}
    assert len(by["total"]) == 10 and len(by["extreme"]) == 12 and len({x.term for x in by["daily"]}) == 12
    n = {kind: sum(x.y for x in by[kind]) for kind in ("hist", "var_hist", "binned_hist")}
    assert len(set(n.values())) == 1
    counts = {}
    for d, _, _, t in _rows(60):
        t = t or ["w1", "w2"]
        if d % 4:
            for g in t + [f"{a} {b}" for a, b in zip(t, t[1:])]:
                counts[g] = counts.get(g, 0) + 1
    assert sorted((x.x for x in by["total"]), reverse=True) == sorted(counts.values(), reverse=True)[:10]
    assert all(counts[x.term] == x.x for x in by["total"])


def test_binned_variance_matches_numpy():
    x = np.array([[1, 0, 2, 0, 0, 3], [0, 1, 1, 0, 4, 0]])    # terms, documents
    bins = np.array([0, 0, 2, 2, 3, -1])
    at, rows = np.nonzero(x)
    got = lg.binned_variance((bins, np.bincount(bins[bins >= 0])), rows, at, x[at, rows].astype(float), np.searchsorted(at, [0, 1]))
    means = [[t[bins == b].mean() for b in (0, 2, 3)] for t in x]
    assert got["variance"] == pytest.approx(np.var(means, axis=1)) and got["total"].tolist() == [6, 6]


def test_convergence_over_replicates(spark, tables):
    r = _query(spark, "E09", tables)
    assert len({x.term_id for x in r}) <= 50 and {x.replicate for x in r} == set(range(10)) and len(r) == 10 * len({x.term_id for x in r})
    one = sorted((x for x in r if x.term_id == r[0].term_id), key=lambda x: x.replicate)
    coefs = np.diff([0] + [x.running_mean * (i + 1) for i, x in enumerate(one)])
    assert one[-1].running_var == pytest.approx(np.var(coefs), abs=1e-9)
