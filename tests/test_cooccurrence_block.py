"""I03 returns the pairs themselves."""

import itertools
from collections import Counter

import duckdb


def test_query_returns_every_pair_of_every_document(spark, tmp_path):
    import __spark_entry__ as E
    texts = ["aa bb aa cc", "bb aa", "cc cc dd", "x aa", "", None, "aa bb cc dd ee ff"] + ["zz aa bb"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: Counter(f"{a}-{b}" for a, b in itertools.combinations([w for w in (t or "").split() if len(w) > 1], 2)) for d, t in enumerate(texts)}
    df = Counter(t for c in want.values() for t in c)
    want = {(d, t, n) for d, c in want.items() for t, n in c.items() if 0.1 <= df[t] <= 9.9}
    got = E.queries()["I03"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "term", "value"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(con.execute(E.oracle_sql()["I03"]).fetchall()) == want
