"""Principal components of sparse rows by block power iteration.

The matrix stays in the long form (doc_id, term, value) and is centred
implicitly: with s = X q - mean, the next block is X' s, since the centred
scores of a component sum to 0.  Documents lie in blocks of bounded size.  In
a round a block is given the rows of q of its own terms and returns its share
of X' s, so that what is shuffled are a block's terms and not its entries; the
driver holds matrices of ``columns`` rows and columns only.  No limit on terms
or documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import landed
from .features import vocabulary_ids

COLUMNS, ROUNDS, TOLERANCE = 24, 40, 1e-7
BLOCK_ROWS = 8192   # documents of a block, about
STEP = 1 << 16      # entries that are multiplied at a time


def _kept(df: DataFrame) -> DataFrame:
    return landed(df, "components")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums_of(values: np.ndarray, at: np.ndarray, starts: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Row i: the sum of values x matrix[at] over the entries from ``starts[i]`` up to the next start; no row is without entries."""
    out = np.empty((len(starts), matrix.shape[1]))
    ends = np.append(starts[1:], len(values))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + STEP, "right")))
        part = slice(starts[low], ends[high - 1])
        out[low:high] = np.add.reduceat(values[part, None] * matrix[at[part]], starts[low:high] - starts[low], axis=0)
        low = high
    return out


class Block:
    """A block's documents and the rows of q of its terms."""

    def __init__(self, held: pa.Table, given: pa.Table):
        names = given.column("term_id").to_numpy()
        order = np.argsort(names)
        lists = held.column("ids").combine_chunks()
        self.names, self.q = names[order], _matrix(given.column("q"))[order]
        self.at = np.searchsorted(self.names, lists.flatten().to_numpy())
        self.values = held.column("values").combine_chunks().flatten().to_numpy()
        lengths = lists.value_lengths().to_numpy()
        self.docs, self.starts = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths

    def scores(self, mean: np.ndarray) -> np.ndarray:
        return sums_of(self.values, self.at, self.starts, self.q) - mean

    def back(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's terms and its share of X' s."""
        order = np.argsort(self.at, kind="stable")
        terms, starts = np.unique(self.at[order], return_index=True)
        return self.names[terms], sums_of(self.values[order], self.docs[order], starts, s)


def _products(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The Gram matrix of the array columns side by side: one small matrix a
    task, added up on the driver."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in columns], 1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    parts = df.select(*columns).mapInArrow(run, "g array<double>").collect()
    g = sum(np.array(r.g) for r in parts)
    return g.reshape(int(len(g) ** 0.5), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def _times(df: DataFrame, key: str, column: str, by: np.ndarray, out: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, out, *keep): the rows of an array column times a small matrix; ``keep``: array columns that stay."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column(column)) if b.num_rows else np.zeros((0, len(by)))
            yield pa.RecordBatch.from_arrays([b.column(key), _lists(x @ by), *[b.column(c) for c in keep]], names=[key, out, *keep])

    return df.select(key, column, *keep).mapInArrow(run, ", ".join([f"{key} long", *[f"{c} array<double>" for c in (out, *keep)]]))


def principal_components(long: DataFrame, docs: DataFrame, k: int = 2, columns: int = COLUMNS, rounds: int = ROUNDS,
                         tolerance: float = TOLERANCE, seed: int = 0, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, list[float]]:
    """(scores, loadings, variances): doc_id and its centred scores ``pc`` for
    every row of ``docs``, term and its loadings, and the variance (n - 1) of
    each component, largest first.  The loading of largest size (ties: the
    first term) is positive.  Fewer than k components where the rank is less."""
    vocab = _kept(vocabulary_ids(long).select("term", "term_id"))
    x = _kept(long.join(vocab, "term").groupBy("doc_id", "term_id").agg(F.sum(F.col("value").cast("double")).alias("value")))
    ids = docs.select("doc_id")
    n = ids.count()
    start = vocab.select("term_id", F.array(*[F.randn(seed + i) for i in range(columns)]).alias("z"))
    # random numbers are drawn once: the copy is what both readings see
    z = _kept(start)
    if n < 2 or not z.head(1):
        return ids.select("doc_id", F.array().cast("array<double>").alias("pc")), vocab.select("term", F.array().cast("array<double>").alias("loadings")), []
    value = F.coalesce("value", F.lit(0.0))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // block_rows)))
    known = x.where(F.col("doc_id").isNotNull())
    entries = F.sort_array(F.collect_list(F.struct("term_id", value.alias("value"))))
    rows = _kept(known.groupBy("doc_id").agg(entries.alias("e")).select("doc_id", block.alias("block"), F.col("e.term_id").alias("ids"), F.col("e.value").alias("values")))
    needs = _kept(known.select(block.alias("block"), "term_id").distinct())
    # a term's sum over all documents; with q, the means of the scores
    totals = x.groupBy("term_id").agg(F.array(F.sum(value)).alias("t"))

    def blocks(q: DataFrame, run, schema: str) -> DataFrame:
        given = needs.join(q.select("term_id", "q"), "term_id").select(F.col("block").alias("to"), "term_id", "q")
        return rows.groupBy("block").cogroup(given.groupBy("to")).applyInArrow(run, schema)

    def round_of(q: DataFrame, width: int, mean: np.ndarray) -> DataFrame:
        """(term_id, z): X' s of the centred scores s of q."""
        def share(held: pa.Table, given: pa.Table) -> pa.Table:
            here = Block(held, given)
            terms, z = here.back(here.scores(mean))
            return pa.Table.from_arrays([pa.array(terms, pa.int64()), _lists(z)], names=["term_id", "z"])

        sums = blocks(q, share, "term_id long, z array<double>").groupBy("term_id").agg(*[F.sum(F.get("z", F.lit(i))).alias(f"s{i}") for i in range(width)])
        return sums.select("term_id", F.array(*[f"s{i}" for i in range(width)]).alias("z"))

    def scored(q: DataFrame, mean: np.ndarray) -> DataFrame:
        """(doc_id, pc): the centred scores of the rows that have terms."""
        def run(held: pa.Table, given: pa.Table) -> pa.Table:
            return pa.Table.from_arrays([held.column("doc_id"), _lists(Block(held, given).scores(mean))], names=["doc_id", "pc"])

        return blocks(q, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pc array<double>")

    def orthonormal(z: DataFrame, gram: np.ndarray, sums: np.ndarray) -> tuple[DataFrame, int, np.ndarray]:
        """The orthonormal q of z, its width and the means of its scores; ``sums``: those of z's scores."""
        values, vectors = np.linalg.eigh(gram)
        keep = values > max(values.max(initial=0.0), 0.0) * 1e-13
        by = vectors[:, keep] / np.sqrt(values[keep])
        return _kept(_times(z, "term_id", "z", by, "q", ("t",))), int(keep.sum()), sums @ by / n

    both = _kept(z.join(totals, "term_id"))
    gram = _products(both, ["z", "t"])
    q, width, mean = orthonormal(both, gram[:-1, :-1], gram[-1, :-1])
    for _ in range(rounds):
        both = _kept(q.join(round_of(q, width, mean), "term_id"))
        gram = _products(both, ["q", "z", "t"])
        inner, square, sums = gram[:width, width:-1], gram[width:-1, width:-1], gram[-1, width:-1]
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:k]
        values, vectors = values[order], vectors[:, order]
        # |A v - value v| of the wanted ones, from the products alone
        rest = np.sqrt(np.maximum(0.0, np.einsum("ij,ik,kj->j", vectors, square, vectors) - values ** 2))
        if values.max(initial=0.0) <= 0 or (rest <= tolerance * values.max()).all():
            break
        q, width, mean = orthonormal(both, square, sums)
    real = values > values.max(initial=0.0) * 1e-12
    values, vectors = values[real], vectors[:, real]
    loadings = _kept(_times(q, "term_id", "q", vectors, "v"))
    k = len(values)
    first = loadings.agg(*[F.max_by(F.get("v", F.lit(i)), F.struct(F.abs(F.get("v", F.lit(i))), -F.col("term_id"))) for i in range(k)]).first() if k else []
    sign = np.diag([1.0 if v >= 0 else -1.0 for v in first]) if k else np.zeros((0, 0))
    loadings = _kept(_times(loadings, "term_id", "v", sign, "q"))
    mean = mean @ vectors @ sign
    nothing = F.array(*[F.lit(float(-m)) for m in mean]).cast("array<double>")     # documents without terms
    scores = ids.join(scored(loadings, mean), "doc_id", "left") if k else ids.withColumn("pc", F.lit(None))
    scores = scores.select("doc_id", F.coalesce(F.col("pc").cast("array<double>"), nothing).alias("pc"))
    return scores, loadings.join(vocab, "term_id").select("term", F.col("q").alias("loadings")), [float(v) / (n - 1) for v in values]
