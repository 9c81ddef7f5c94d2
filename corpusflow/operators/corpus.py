"""Corpus-level operators: scans, filters, label handling, joins and set
operations (A01/A02/A22, B*, C04/C07, D01/D03, F05, G01/G02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranking import global_rank, top_k_per_group


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def named_corpus(docs: DataFrame, source: str, labeled_only: bool = False, sort: bool = True,
                 source_col: str = "source", time_col: str = "published") -> DataFrame:
    """Documents of one source, optionally labelled only, by time.
    The source filter is pushed into the parquet scan."""
    out = docs.where(F.col(source_col) == source)
    if labeled_only:
        out = labelled_only(out)
    return out.orderBy(time_col) if sort else out


def labelled_only(docs: DataFrame, label_col: str = "label") -> DataFrame:
    """B01."""
    return docs.where(F.col(label_col).isNotNull())


def label_in(docs: DataFrame, labels, label_col: str = "label") -> DataFrame:
    """Label in a list."""
    return docs.where(F.col(label_col).isin(list(labels)))


def contains_any(text, keywords) -> Column:
    """B03 find: any keyword contained (``skip`` is its negation)."""
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(_c(text), k))


def count_containing(text, keywords) -> Column:
    """Number of keywords contained in the text."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(_c(text), k)))


def subset(long: DataFrame, rows: DataFrame | None = None, features: DataFrame | None = None,
           doc_col: str = "doc_id", term_col: str = "term") -> DataFrame:
    """Long matrix restricted to a row set and/or a feature set."""
    out = long
    if rows is not None:
        out = out.join(rows.select(doc_col), doc_col, "left_semi")
    if features is not None:
        out = out.join(features.select(term_col), term_col, "left_semi")
    return out


def mask_to_indices(df: DataFrame, mask: Column, id_col: str) -> DataFrame:
    """Boolean mask -> key set."""
    return df.where(mask).select(id_col)


def indices_to_mask(df: DataFrame, idx: DataFrame, id_col: str) -> DataFrame:
    """Key set -> boolean mask over all rows."""
    m = idx.select(F.col(id_col).alias("_k")).distinct()
    j = df.join(m, df[id_col] == m["_k"], "left")
    return j.select(df[id_col], F.col("_k").isNotNull().alias("mask"))


def default_label(label) -> Column:
    """Empty or missing label -> 'Unlabeled'."""
    return F.coalesce(F.nullif(_c(label), F.lit("")), F.lit("Unlabeled"))


def encode_labels(df: DataFrame, label_col: str, known: DataFrame | None = None) -> DataFrame:
    """Distinct labels -> consecutive ids in alphabetical order.  With
    ``known`` (label, label_id), existing ids are kept and new labels extend
    the range after the largest id.  Distinct first (partial aggregate), then
    a distributed rank over the distinct set."""
    labels = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    if known is None:
        return global_rank(labels, [label_col], out="label_id", start=0) \
            .select(label_col, F.col("label_id").cast("long").alias("label_id"))
    new = labels.join(known.select(label_col), label_col, "left_anti")
    top = known.select(F.coalesce(F.max("label_id") + 1, F.lit(0))).scalar()
    ranked = global_rank(new, [label_col], out="_r", start=0)
    ext = ranked.select(label_col, (F.col("_r") + top).cast("long").alias("label_id"))
    return known.select(label_col, F.col("label_id").cast("long")).unionByName(ext)


def token_subset(df: DataFrame, tokens_col: str, idx: list[int]) -> DataFrame:
    """Tokens at the given 0-based positions (positions past the end
    are skipped)."""
    ix = F.array(*[F.lit(i) for i in idx])
    out = df.select("*", F.explode(ix).alias("idx")) \
        .where(F.col("idx") < F.size(tokens_col))
    return out.withColumn("token", F.element_at(F.col(tokens_col), F.col("idx") + 1))


def mispredictions(pred: DataFrame, gold_col: str, pred_col: str) -> DataFrame:
    """Rows where gold and predicted labels differ."""
    return pred.where(F.col(gold_col) != F.col(pred_col))


def names_with_counts(names: DataFrame, counts: DataFrame, key: str, n_col: str = "n") -> DataFrame:
    """Every name with its count, 0 where absent."""
    return names.join(counts, key, "left").select(key, F.coalesce(F.col(n_col), F.lit(0)).cast("long").alias(n_col))


def label_table(y: DataFrame, names: DataFrame, id_col: str = "label_id") -> DataFrame:
    """Count per class id including zero counts for ids up to the
    largest observed id, names attached."""
    counts = y.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    mx = y.select(F.max(id_col)).scalar()
    grid = names.where(F.col(id_col) <= mx)
    return grid.join(counts, id_col, "left").select(
        F.col(id_col).cast("long").alias(id_col), "label",
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def crosstabs(df: DataFrame, sets: list[list[str]], cols: list[str]) -> DataFrame:
    """Counts for several grouping sets in one aggregation."""
    return df.groupingSets(sets, *cols).agg(
        F.grouping_id(*cols).cast("long").alias("gid"), F.count(F.lit(1)).alias("n"))


def extreme_features(coef: DataFrame, class_col: str, value_col: str, term_col: str, n: int = 5) -> DataFrame:
    """the n lowest and n highest coefficients per class (two window
    group limits, each applied before its shuffle)."""
    lo = top_k_per_group(coef, [class_col], [F.asc(value_col), F.asc(term_col)], n, out="_r") \
        .withColumn("side", F.lit("lowest"))
    hi = top_k_per_group(coef, [class_col], [F.desc(value_col), F.asc(term_col)], n, out="_r") \
        .withColumn("side", F.lit("highest"))
    both = lo.unionByName(hi).drop("_r")
    # a term among both the lowest and the highest keeps the 'lowest' tag
    w = Window.partitionBy(class_col, term_col).orderBy(F.desc("side"))
    return both.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1) \
        .select(class_col, term_col, value_col, "side")


def union_corpora(a: DataFrame, b: DataFrame, label_from: str) -> DataFrame:
    """UNION ALL of two corpora, label = source name."""
    return a.unionByName(b).withColumn("label", F.col(label_from))


def new_labels(seen: DataFrame, known: list[str], label_col: str = "label") -> DataFrame:
    """Labels seen minus labels known."""
    k = seen.sparkSession.createDataFrame([(x,) for x in known], f"{label_col} string")
    return seen.select(label_col).distinct().exceptAll(k.distinct())
