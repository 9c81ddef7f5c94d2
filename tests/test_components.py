"""Principal components against NumPy's SVD."""

import numpy as np
import pyarrow as pa

from corpusflow.operators import components
from corpusflow.operators.components import principal_components


def test_components_equal_svd(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((60, 40)) < 0.3, rng.random((60, 40)), 0.0) + np.outer(rng.random(60), rng.random(40) < 0.2)
    x[7] = 0  # a document without terms
    rows = [(d, f"t{t:02d}", float(x[d, t])) for d in range(60) for t in range(40) if x[d, t]]
    long = spark.createDataFrame(rows, "doc_id long, term string, value double").repartition(3)
    docs = spark.range(60).withColumnRenamed("id", "doc_id")
    scores, loadings, variances = principal_components(long, docs, k=2)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(variances, s[:2] ** 2 / 59, rtol=1e-9)
    got = np.array([r.pc for r in sorted(scores.collect(), key=lambda r: r.doc_id)])
    load = np.array([r.loadings for r in sorted(loadings.collect(), key=lambda r: r.term)])
    for i in range(2):
        sign = np.sign(v[i][np.abs(v[i]).argmax()])
        assert np.allclose(load[:, i], sign * v[i], atol=1e-6) and np.allclose(got[:, i], sign * u[:, i] * s[i], atol=1e-6)


def test_few_rows(spark):
    docs = spark.range(3).withColumnRenamed("id", "doc_id")
    long = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "a", 5.0)], "doc_id long, term string, value double")
    scores, loadings, variances = principal_components(long, docs)
    assert len(variances) == 1 and abs(variances[0] - 4.0) < 1e-9  # rank 1
    assert sorted(round(r.pc[0], 6) for r in scores.collect()) == [-2.0, 0.0, 2.0]
    scores, _, variances = principal_components(long.where("false"), docs)
    assert variances == [] and [r.pc for r in scores.collect()] == [[], [], []]


def test_blocks(spark):
    """A block's scores and its share of X' s are those of the dense matrix, whatever the block; the sums are made in steps."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((30, 12)) < 0.4, rng.random((30, 12)), 0.0)
    x[:, 0] = 1.0   # every document has a term
    q, mean = rng.random((12, 3)), rng.random(3)
    held = pa.table({"doc_id": range(30), "ids": [[10 + int(t) for t in np.flatnonzero(r)] for r in x], "values": [r[r > 0].tolist() for r in x]})
    order = rng.permutation(12)
    given = pa.table({"term_id": 10 + order, "q": pa.array(list(q[order]), pa.list_(pa.float64()))})
    block = components.Block(held, given)
    s = block.scores(mean)
    assert np.allclose(s, x @ q - mean)
    terms, z = block.back(s)
    assert terms.tolist() == list(range(10, 22)) and np.allclose(z, x.T @ s)
    step, components.STEP = components.STEP, 7
    try:
        assert np.allclose(block.scores(mean), s) and np.allclose(block.back(s)[1], z)
    finally:
        components.STEP = step


def test_many_blocks(spark):
    """Documents without an id or terms, ids that come twice, blocks of few rows."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random((13, 4)) < 0.7, rng.random((13, 4)), 0.0)
    x[12] = [0, 0.7, 0, 0]      # the entries without an id
    long = spark.createDataFrame([(d if d < 12 else None, f"t{t}", float(x[d, t])) for d in range(13) for t in range(4) if x[d, t]], "doc_id long, term string, value double")
    docs = spark.createDataFrame([(d,) for d in [*range(14), 3, None]], "doc_id long")
    scores, loadings, _ = principal_components(long, docs, columns=4, block_rows=4, rounds=3, tolerance=1.0)
    load = np.array([r.loadings for r in sorted(loadings.collect(), key=lambda r: r.term)])
    mean = x.sum(0) / 16    # all rows of docs count, and so do the entries without an id
    got = [(r.doc_id, r.pc) for r in scores.collect()]
    assert sorted(d is None or d for d, _ in got) == sorted([*range(14), 3, True])
    for d, pc in got:
        row = x[d] if d is not None and d < 12 else np.zeros(4)
        assert np.allclose(pc, (row - mean) @ load, atol=1e-9), d
