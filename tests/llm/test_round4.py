"""op2 matches texts by a shuffle at every size."""

from corpusflow.llm import near_dups


def test_few_pairs_are_not_broadcast(spark):
    texts = spark.createDataFrame([(b"a", b"x y z w"), (b"b", b"X y z w"), (b"c", b"p q r s")], "node binary, text binary")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"a", b"c")], "a binary, b binary")
    found = near_dups.verified(pairs, texts, 3, 85)
    assert [(bytes(r.a), bytes(r.b)) for r in found.collect()] == [(b"a", b"b")]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
