"""The stages one by one against brute-force versions of their steps, on the smallest tables, and the entry's queries."""

from collections import Counter

import corpus_pipeline
import numpy as np
from corpusflow.llm import queries, toxicity

from .test_operators import brute_components, brute_lines, split

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, labels)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text.encode()) < 0.7}
    lines = stage["line_dedup"](spark, clean, SF)
    data = [(r.doc_id, r.text) for r in clean.collect()]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in lines.collect()) == Counter((i, t, len(t)) for i, t, _, _ in brute_lines(data))
    one = stage["near_dedup"](spark, lines, SF)
    data = [(r.doc_id, r.text) for r in lines.collect()]
    assert {r.doc_id for r in one.collect()} == {c if n else d for d, n, c in brute_components(data, 5, 80)}
    mixed = stage["mixing"](spark, one, SF)
    left = {r.doc_id: r for r in one.collect()}
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= set(left) and max(taken.values()) <= 2 and all(tuple(r) == tuple(left[r.doc_id]) for r in mixed.collect())
    for df in (clean, lines, one, mixed):
        assert df.columns == docs.columns and df.schema.simpleString() == docs.schema.simpleString()
    packed = stage["packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken
    words = sum(len(split(left[d].text)) * n for d, n in taken.items())
    assert sum(r.length for r in packed) > words


def test_empty_pipeline(spark, none, odd):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, SF).collect() == []
        f(spark, odd, SF).collect()


def test_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(queries.QUERIES) <= set(found) and set(queries.ORACLE) <= set(entry.oracle_sql())
    assert len([k for k in found if k.startswith("op")]) == 13
    r = found["op6_lattice_lm"](spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert np.mean(r.score / r.n_tokens) > np.mean(r.base_score / r.n_tokens)
