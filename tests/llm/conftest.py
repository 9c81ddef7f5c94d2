import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LINES = ["the same line is in many of the documents", "Another Line that is repeated everywhere ", "short"]


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = ["", None, "a", "a b", base, base + " end", base.replace("w30 ", "x "), "\n".join(LINES), LINES[0] + "\nown line of this one document",
             LINES[0].upper() + " \n\n" + LINES[1], "\n".join(LINES[:2]), LINES[1], "é" * 30 + "\n" + "x" * 19, "y" * 30_000, "word " * 20_000,
             "<|endoftext|> and <|im_end|>", "\t \x0b", "Ünïcode space   here"]
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, base, "en", "s1", 1), (None, None, None, None, None), (100, base, "de", "s2", None), (101, LINES[0], None, "s0", 3)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use inside or return."""
    from pyspark.sql import functions as F

    names = ["row", "block", "node", "size", "kept", "text_sha256", "component_id", "rest", "_doc", "score", "held_out", "n_dropped", "copies", "c0", "token", "key"]
    return odd.withColumns({n: F.lit("x") for n in names})
