"""Feature goldens (I03, I06/I07, I08), n-grams and df cuts."""

import math

from pyspark.sql import functions as F

from corpusflow.operators import features as ft


def test_tfidf_golden(spark):
    long = spark.createDataFrame([(0, "both", 3), (1, "both", 1), (0, "one", 1)], "doc_id long, term string, value long")
    got = {(r["doc_id"], r["term"]): r["value"] for r in ft.tfidf_log(long, F.lit(2)).collect()}
    assert got[(0, "both")] == 0.0 and got[(1, "both")] == 0.0
    assert abs(got[(0, "one")] - math.log(2)) < 1e-12


def test_cooccurrence_golden(spark):
    docs = spark.createDataFrame([(0, "ab cd ab")], "doc_id long, text string")
    got = {r["term"]: r["value"] for r in ft.cooccurrences(docs, "text", min_df=1, max_df=1.0).collect()}
    assert got == {"ab-cd": 1, "ab-ab": 1, "cd-ab": 1}


def _brute_pairs(tokens):
    out = {}
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens)):
            k = tokens[i] + "-" + tokens[j]
            out[k] = out.get(k, 0) + 1
    return out


def test_cooccurrence_matches_brute_force(spark):
    texts = ["a b a c b a", "c c a", "b a b b"]
    docs = spark.createDataFrame([(i, " ".join(w + w for w in t.split())) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in ft.cooccurrences(docs, "text", min_df=1, max_df=1.0).collect():
        got[(r["doc_id"], r["term"])] = r["value"]
    want = {}
    for i, t in enumerate(texts):
        for k, v in _brute_pairs([w + w for w in t.split()]).items():
            want[(i, k)] = v
    assert got == want


def test_ngram_array(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(ft.ngram_array(F.col("t"), 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["x"], []]


def test_df_cut_int_and_share(spark):
    long = spark.createDataFrame([(d, t, 1) for d, t in [(0, "a"), (1, "a"), (2, "a"), (0, "b"), (1, "b"), (0, "c")]],
                                 "doc_id long, term string, value long")
    terms = lambda df: sorted({r["term"] for r in df.collect()})
    assert terms(ft.df_cut(long, F.lit(3), min_df=2)) == ["a", "b"]
    assert terms(ft.df_cut(long, F.lit(3), min_df=1, max_df=0.7)) == ["b", "c"]


def test_lexicon_empty_is_null_and_zero(spark):
    from corpusflow.plans.text import lexicon_df
    toks = spark.createDataFrame([(0, "zzz"), (1, "the")], "doc_id long, token string")
    m = ft.lexicon_matches(toks, lexicon_df(spark))
    docs = spark.createDataFrame([(0,), (1,)], "doc_id long")
    a = docs.join(m.groupBy("doc_id").agg(F.avg("pleasure").alias("p"), F.sum("score").alias("s")), "doc_id", "left")
    r = {x["doc_id"]: x for x in a.collect()}
    assert r[0]["p"] is None and (r[0]["s"] or 0) == 0
    # "the" matches both the exact entry and the "th*" prefix entry
    assert r[1]["s"] == -1


def test_smoothed_tfidf_l2(spark):
    long = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1)], "doc_id long, term string, value long")
    rows = ft.tfidf_join(long, F.lit(2), smooth=True, l2=True).collect()
    norms = {}
    for r in rows:
        norms[r["doc_id"]] = norms.get(r["doc_id"], 0) + r["value"] ** 2
    assert all(abs(v - 1) < 1e-12 for v in norms.values())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_grouped_where_the_documents_were_dealt(spark):
    docs = spark.createDataFrame([(1, "a b a"), (None, "b"), (1, "a"), (None, "b c")], "doc_id long, text string")
    long = ft.term_counts(docs, F.split("text", " "))
    assert _plan(long).count("Exchange") == 1      # the texts; not the long rows, too
    got = sorted(((r.doc_id, r.term, r.value) for r in long.collect()), key=str)
    assert got == sorted([(1, "a", 3), (1, "b", 1), (None, "b", 2), (None, "c", 1)], key=str)


def test_common_and_rare_terms_have_their_df(spark, monkeypatch):
    monkeypatch.setattr(ft, "SAMPLED", 1)
    monkeypatch.setattr(ft, "COMMON", 4)
    monkeypatch.setattr(ft, "LEAST", 1)
    rows = [(d, t, 1) for d in range(40) for t in ["every", f"half{d % 2}", f"some{d % 8}", f"one{d}"]]
    long = spark.createDataFrame(rows, "doc_id long, term string, value long")
    common = {r.term for r in ft.common_terms(long, F.lit(40)).collect()}
    assert common == {"every", "half0", "half1"}
    want = {}
    for _, t, _ in rows:
        want[t] = want.get(t, 0) + 1
    got = ft.with_df(long, F.lit(40)).collect()
    assert len(got) == len(rows) and all(r.df == want[r.term] for r in got)
    assert {r.term for r in ft.df_cut(long, F.lit(40), 5, 0.5).collect()} == {"half0", "half1"} | {f"some{i}" for i in range(8)}


def test_only_hot_terms_are_spread(spark):
    rows = [(d, t, 1) for d in range(20) for t in ["hot", f"cold{d}"]]
    long = spark.createDataFrame(rows, "doc_id long, term string, value long")
    vocab = ft.vocabulary_ids(long)
    joined = ft.join_by_term(long, vocab, hot=20)
    ids = {r.term: r.term_id for r in vocab.collect()}
    assert sorted((r.doc_id, r.term_id) for r in joined.collect()) == sorted((d, ids[t]) for d, t, _ in rows)


def test_pairs_of_a_document_in_parts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ft, "PAIR_CELLS", 7)      # several parts a document
    tokens = "aa bb aa cc bb bb dd aa ee".split()
    ids = {t: i for i, t in enumerate(sorted(set(tokens)))}
    places = [[p for p, x in enumerate(tokens) if x == t] for t in ids]
    names = {i: t for t, i in ids.items()}
    got = {}
    for keys, values in ft.document_pairs(list(ids.values()), places, len(ids)):
        for k, v in zip(keys.tolist(), values.tolist()):
            pair = f"{names[k // len(ids)]}-{names[k % len(ids)]}"
            assert pair not in got
            got[pair] = v
    assert got == _brute_pairs(tokens)


def test_no_pair_of_a_document_is_shuffled(spark):
    docs = spark.createDataFrame([(0, "ab cd ab"), (0, "cd"), (1, "ab cd"), (None, "ab ab")], "doc_id long, text string")
    out = ft.cooccurrences(docs, "text", min_df=1, max_df=1.0)
    assert "SortMergeJoin" not in _plan(out) and "hashpartitioning(doc_id" not in _plan(out)
    # rows of one doc_id are one document: its places are those of both rows
    assert sorted((r.doc_id, r.term, r.value) for r in out.collect()) == [(0, "ab-ab", 1), (0, "ab-cd", 1), (0, "cd-ab", 2), (0, "cd-cd", 1), (1, "ab-cd", 1)]


def test_texts_are_tokenized_once(spark):
    rows = [(0, "ab cd ab"), (1, ""), (2, None), (None, "ab"), (0, "cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.regexp_extract_all("text", F.lit(r"\w{2}"), 0).alias("tokens"))
    long = ft.term_counts(docs, F.col("tokens"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.term, r.value) for r in long.collect()) == [(False, 0, "ab", 2), (False, 0, "cd", 2), (True, 0, "ab", 1)]
    assert long._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    # null elements are terms, as of a plain explode
    arrays = spark.createDataFrame([(0, ["x", None]), (1, [])], "doc_id long, a array<string>")
    assert sorted((r.doc_id, r.term or "") for r in ft.exploded(arrays, F.col("a"), "doc_id").collect()) == [(0, ""), (0, "x")]
