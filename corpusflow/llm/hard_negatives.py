"""Hard negatives by rotated one-bit codes with stored code-vector alignment.

Every vector, scaled to length 1 and rotated, is coded by its signs; what the code leaves over is coded by its signs in turn,
``LEVELS`` times.  Stored beside the codes are the alignment of each with what it codes and the length of the last rest.
An anchor's inner product with a code comes from popcounts over the bit planes of the anchor's quantised coordinates.  The
products weighted by the alignments estimate the score; the rest is orthogonal to the last code, so Cauchy-Schwarz bounds
what is missing.  The interval is certain: a row whose interval can't reach the answer is dropped, all others are scored
as integers, and the answers are exact.

Anchors are compared with all rows in blocks: tasks of one slice of rows and one block of anchors, both of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS, PLANES = 3, 5
SCALE = 256
MOST_COMPONENT = 1 << 26  # of scaled components: larger ones could overflow the integer scores
ANCHOR_BLOCK = 8192
LEAST_SLICE, MOST_SLICE, SLICES = 2048, 32768, 64
TILE = 1 << 20  # anchor-row pairs estimated at once

_CODED = ("row long, vec_id long, label long, vector binary, norm double, codes binary, alignments binary, rest double")


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, with floor(256 * component) as integers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < MOST_COMPONENT))
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
            .where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
            .select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("vector")))


def rotation(n: int, seed: int = 29) -> np.ndarray:
    """An orthogonal matrix, the same for every task."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0] if n else np.zeros((0, 0))


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the last one filled up with zeros."""
    words = -(-bits.shape[-1] // 64)
    full = np.zeros((*bits.shape[:-1], words * 64), bool)
    full[..., :bits.shape[-1]] = bits
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(norms, codes of (row, level, word), alignments of (row, level), lengths of the rests) of integer vectors."""
    n, d = vectors.shape
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    left = (vectors / np.where(norms > 0, norms, 1.0)[:, None]) @ turn.T
    codes, alignments = np.zeros((n, levels, -(-d // 64)), np.uint64), np.zeros((n, levels))
    for k in range(levels if d else 0):
        up = left >= 0
        codes[:, k] = packed_bits(up)
        alignments[:, k] = np.abs(left).sum(1) / math.sqrt(d)
        left = left - np.where(up, 1.0, -1.0) * (alignments[:, k] / math.sqrt(d))[:, None]
    return norms, codes, alignments, np.sqrt((left ** 2).sum(1))


class Anchors:
    """The quantised, rotated anchors of one task."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        n, d = vectors.shape
        self.d, self.planes = d, planes
        self.norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
        q = (vectors / np.where(self.norms > 0, self.norms, 1.0)[:, None]) @ turn.T
        self.low = q.min(1, initial=0)
        self.step = np.maximum((q.max(1, initial=0) - self.low) / ((1 << planes) - 1), 1e-300)
        units = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + units * self.step[:, None]
        self.missed = np.sqrt(((q - near) ** 2).sum(1))  # what quantising moved the anchor by
        self.sum, self.square = near.sum(1), (near ** 2).sum(1)
        self.bits = np.stack([packed_bits((units >> b) & 1 == 1) for b in range(planes)], 1) if n else np.zeros((0, planes, 0), np.uint64)

    def intervals(self, which: slice, codes, alignments, rests, norms) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) integer score of each anchor of ``which`` with each coded row."""
        low, step, total = self.low[which, None], self.step[which, None], self.sum[which, None]
        middle = product = np.zeros((len(low), len(norms)))
        for k in range(codes.shape[1] if self.d else 0):
            ones = np.bitwise_count(codes[:, k]).sum(1, dtype=np.int64)
            units = np.zeros(middle.shape, np.int64)
            for b in range(self.planes):
                for w in range(codes.shape[2]):
                    units += np.bitwise_count(self.bits[which, b, w][:, None] & codes[None, :, k, w]).astype(np.int64) << b
            product = (2 * (low * ones + step * units) - total) / math.sqrt(self.d)
            middle = middle + alignments[:, k] * product
        spread = rests * np.sqrt(np.maximum(self.square[which, None] - product ** 2, 0)) + self.missed[which, None] + 1e-9
        scale = self.norms[which, None] * norms
        slack = 1e-6 + 1e-9 * scale
        return np.ceil((middle - spread) * scale - slack), np.floor((middle + spread) * scale + slack)


def coded(embeddings: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, int, int]:
    """The coded rows, written, with the number of components of the longest vector and of rows."""
    base = scaled(embeddings)
    longest = base.agg(F.max(F.size("vector"))).first()[0] or 0

    def run(batches):
        turn = rotation(longest)
        for b in batches:
            vectors = np.zeros((b.num_rows, longest), np.int64)
            for i, v in enumerate(b.column("vector").to_pylist()):
                vectors[i, :len(v)] = v
            norms, codes, alignments, rests = encode(vectors, turn, levels)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("vec_id"), b.column("label"), pa.array([v.astype("<i4").tobytes() for v in vectors], pa.binary()), pa.array(norms),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([a.tobytes() for a in alignments], pa.binary()), pa.array(rests)],
                names=["row", "vec_id", "label", "vector", "norm", "codes", "alignments", "rest"])

    rows = base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")
    done = written(rows.mapInArrow(run, _CODED), "coded-vectors")
    return done, longest, done.count()


class Slice:
    """The rows or anchors of one task as arrays, ordered by vec_id (null last), so that a stable sort by score breaks ties."""

    def __init__(self, table: pa.Table, longest: int, levels: int):
        ids = table.column("vec_id").to_pylist()
        table = table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), pa.int64()))
        n = table.num_rows
        self.ids = table.column("vec_id").to_pylist()
        self.row, self.label, self.norm, self.rest = (table.column(c).to_numpy() for c in ("row", "label", "norm", "rest"))

        def matrix(name, kind, *shape):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(n, *shape)

        self.vector = matrix("vector", "<i4", longest).astype(np.int64)
        self.codes = matrix("codes", np.uint64, levels, -(-longest // 64))
        self.alignments = matrix("alignments", float, levels)

    def scores(self, which: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vector[which] @ anchor


def kth_largest(x: np.ndarray, k: int) -> float:
    return np.partition(x, len(x) - k)[len(x) - k]


def best(rows: Slice, which: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(place, score) of the k best of the places ``which`` (in the order of vec_id)."""
    return [(which[i], int(scores[i])) for i in np.argsort(-scores, kind="stable")[:k]]


def in_blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run, schema: str) -> DataFrame:
    """``run(rows, anchors)`` for every slice of rows with every block of anchors, each in a task's group of bounded size."""
    slices = max(1, -(-n_rows // min(MOST_SLICE, max(LEAST_SLICE, n_rows // SLICES))))
    blocks = max(1, -(-n_anchors // ANCHOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("slice", F.pmod(F.hash("row"), F.lit(slices))).withColumn("block", every(blocks))
    right = anchors.withColumn("block", F.pmod(F.hash("row"), F.lit(blocks))).withColumn("slice", every(slices))
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(run, schema)


def tiles(n_anchors: int, n_rows: int):
    step = max(1, TILE // max(1, n_rows))
    for a in range(0, n_anchors, step):
        yield slice(a, min(a + step, n_anchors))


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, least: int = 30, most: int = 90,
         levels: int = LEVELS, planes: int = PLANES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are the ``positives`` best other
    rows of its label, and each gets the ``negatives`` best rows of other labels whose score lies between ``least`` and ``most``
    percent of the positive's.  Higher scores come first, then smaller vec_ids, a null one last.

    Rows with a null label, a null vector, or a null, non-finite or (scaled) 2^26 or larger component take no part; a null
    vec_id is no anchor.  Shorter vectors count as followed by zeros, so an empty one scores 0.  Rows that repeat are rows of their own, and each
    of two anchors with one vec_id has its own result.  An anchor without positives, or a positive without
    negatives in its range, gives no row; an empty table gives an empty result.  Other columns are not read.
    """
    rows, longest, n_rows = coded(embeddings, levels)
    chosen = written(rows.where(F.col("vec_id") % every == 0), "anchors")
    n_anchors = chosen.count()

    def nearest(row_table, anchor_table):
        """The best rows of each anchor's label in the slice."""
        found = []
        if row_table.num_rows and anchor_table.num_rows:
            rows, anchors = Slice(row_table, longest, levels), Slice(anchor_table, longest, levels)
            turn = rotation(longest)
            for label in np.unique(anchors.label):
                same, ours = np.flatnonzero(rows.label == label), np.flatnonzero(anchors.label == label)
                if not len(same):
                    continue
                quantised = Anchors(anchors.vector[ours], turn, planes)
                for part in tiles(len(ours), len(same)):
                    low, high = quantised.intervals(part, rows.codes[same], rows.alignments[same], rows.rest[same], rows.norm[same])
                    for i, at in enumerate(ours[part]):
                        others = rows.row[same] != anchors.row[at]
                        least_of = low[i][others]
                        if len(least_of) > positives:
                            others &= high[i] >= kth_largest(least_of, positives)
                        which = same[others]
                        for j, score in best(rows, which, rows.scores(which, anchors.vector[at]), positives):
                            found.append((int(anchors.row[at]), anchors.ids[at], rows.ids[j], score))
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["anchor", "anchor_id", "positive_id", "positive_score"])

    first = lambda of, score, other, k: F.row_number().over(
        Window.partitionBy(*of).orderBy(F.desc(score), F.col(other).asc_nulls_last()))
    near = in_blocks(rows, chosen, n_rows, n_anchors, nearest, "anchor long, anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("place", first(["anchor"], "positive_score", "positive_id", positives)).where(F.col("place") <= positives)
    near = written(near.select("anchor", "anchor_id", "positive_id", "positive_score"), "positives")
    wanted = near.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))  # at most ``positives`` numbers each
    asking = chosen.join(wanted, F.col("row") == F.col("anchor")).drop("anchor")

    def hard(row_table, anchor_table):
        """The best rows of other labels in the slice within each positive's range."""
        found = []
        if row_table.num_rows and anchor_table.num_rows:
            rows, anchors = Slice(row_table, longest, levels), Slice(anchor_table, longest, levels)
            wanted = dict(zip(anchor_table.column("row").to_pylist(), anchor_table.column("wanted").to_pylist()))
            quantised = Anchors(anchors.vector, rotation(longest), planes)
            for part in tiles(len(anchors.row), len(rows.row)):
                low, high = quantised.intervals(part, rows.codes, rows.alignments, rows.rest, rows.norm)
                for i, at in enumerate(range(part.start, part.stop)):
                    other = rows.label != anchors.label[at]
                    for target in wanted[int(anchors.row[at])]:
                        bottom, top = -(-least * target // 100), most * target // 100
                        if bottom > top:
                            continue
                        can = other & (high[i] >= bottom) & (low[i] <= top)
                        certain = low[i][can & (low[i] >= bottom) & (high[i] <= top)]
                        if len(certain) >= negatives:
                            can &= high[i] >= kth_largest(certain, negatives)
                        which = np.flatnonzero(can)
                        scores = rows.scores(which, anchors.vector[at])
                        within = (scores >= bottom) & (scores <= top)
                        for j, score in best(rows, which[within], scores[within], negatives):
                            found.append((int(anchors.row[at]), target, rows.ids[j], score))
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["anchor", "positive_score", "negative_id", "negative_score"])

    far = in_blocks(rows, asking, n_rows, n_anchors, hard, "anchor long, positive_score long, negative_id long, negative_score long")
    far = (far.withColumn("rank", first(["anchor", "positive_score"], "negative_score", "negative_id", negatives).cast("int"))
           .where(F.col("rank") <= negatives))
    return near.join(far, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
