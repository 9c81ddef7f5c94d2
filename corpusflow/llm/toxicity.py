"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; the others of the learning rows are unlabelled text, in which toxic documents
occur with the class prior.  A linear classifier on byte n-grams is trained in numpy on the risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

whose second term, the corrected risk of the negatives, is kept from falling below 0 (where it does, that step climbs
back instead).  The prior is the share of toxic documents among the labelled learning rows.

The learning sample is bounded (``most_learned`` positives and as many unlabelled rows); scoring reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, id_and_text, learn_remainder, written

GRAMS = (4, 5, 6)
BITS = 22
MOST_LEARNED, MOST_FEATURES = 8000, 16384
#: Of a feature's share among positives over that among unlabelled rows, and over that among the others; the same at every sample size.
#: Of 2^22 bins about one passes MIN_Z by chance.
MIN_Z, MIN_RATIO = 5.0, 2.0
PARTS, HELD_OUT, THRESHOLD = 3, 1, 0.7

_CLEAN = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _CLEAN[_c] = _c
for _c in range(65, 91):
    _CLEAN[_c] = _c + 32


def gram_bins(text: bytes) -> np.ndarray:
    """Bins of all byte n-grams of the text, with repeats: letters and digits, A-Z in lower case, all else a space."""
    x = _CLEAN[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint64)
    x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
    found, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(x) < n:
            break
        h = h[:len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1:]
        if n in GRAMS:
            found.append(((h * GOLDEN + np.uint64(n)) * MIXER) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


MIXER = np.uint64(0xD6E8FEB86659FD93)


def nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, n_features: int, steps: int = 300, rate: float = 0.1,
         decay: float = 4e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic classifier that minimises the non-negative risk (Adam, full batches, a rate that falls to 0)."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows)) + b
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        down = np.logaddexp(0, z)  # logistic loss of calling a row negative
        negative_risk = down[u].sum() / n_u - prior * down[p].sum() / n_p
        slope = np.zeros(len(rows))
        if negative_risk >= 0:
            slope[p] = prior * (q[p] - 1) / n_p - prior * q[p] / n_p
            slope[u] = q[u] / n_u
        else:  # climb back
            slope[p] = prior * q[p] / n_p
            slope[u] = -q[u] / n_u
        grad = np.append(np.bincount(flat, weights=slope[owner], minlength=n_features) + decay * prior * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (1 - (step - 1) / steps) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


class Model:
    """bins: the features' bins, ascending; weights, bias: of the classifier."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray, bias: float):
        self.bins, self.weights, self.bias, self._table = bins, weights, bias, None

    def __getstate__(self):
        return self.bins, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: bytes) -> np.ndarray:
        if self._table is None:
            self._table = np.full(1 << BITS, -1, np.int16)
            self._table[self.bins] = np.arange(len(self.bins))
        found = self._table[gram_bins(text)]
        return np.unique(found[found >= 0])

    def score(self, text: bytes) -> float:
        z = float(self.weights[self.features(text)].sum()) + self.bias
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def fit(docs: DataFrame, labels: DataFrame, parts: int = PARTS, held_out: int = HELD_OUT, most_learned: int = MOST_LEARNED,
        most_features: int = MOST_FEATURES) -> Model:
    """Train on rows whose crc32(doc_id) mod ``parts`` is not ``held_out``.

    Without a confirmed toxic document the model scores every text by its prior alone.  Null ids and null labels are not learned from.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (rest != held_out))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id")
    some = lambda df: df.orderBy(order, "doc_id").limit(most_learned)  # noqa: E731  the bound of the sample
    positives = some(known.where("toxic = 1").select("doc_id")).withColumn("positive", F.lit(True))
    learnable = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (rest != held_out)).distinct()
    unlabelled = some(learnable).withColumn("positive", F.lit(False))
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.9, max(1e-4, (toxic or 0) / total)) if total else 1e-4
    picked = positives.unionByName(unlabelled)
    # at most 2 * most_learned ids are broadcast
    sample = written(id_and_text(docs).join(F.broadcast(picked), "doc_id").repartition(8), "toxic-sample")
    if not toxic or not sample.where("positive").head(1):
        return Model(np.empty(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))

    def count(batches):
        held = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for text, positive in zip(b.column("text").to_pylist(), b.column("positive").to_pylist()):
                held[int(positive), np.unique(gram_bins(text))] += 1
        at = np.flatnonzero(held.any(0))
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(held[1, at[i:i + 100_000]].astype(np.int64)),
                                              pa.array(held[0, at[i:i + 100_000]].astype(np.int64))], names=["bin", "p", "u"])

    n_p, n_u = (int(sample.where(c).count()) or 1 for c in ("positive", "not positive"))
    share = (F.col("p") + F.col("u") + 1.0) / (n_p + n_u + 2.0)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1.0 / n_p + 1.0 / n_u))
    # unlabelled rows are toxic by the prior: share_u = prior * share_p + (1 - prior) * share_n, and share_p >= MIN_RATIO * share_n
    speaks = F.col("p") / n_p * (1 - prior + MIN_RATIO * prior) >= MIN_RATIO * F.col("u") / n_u
    chosen = (sample.mapInArrow(count, "bin long, p long, u long").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
              .withColumn("z", z).where(speaks & (F.col("z") > MIN_Z)).orderBy(F.desc("z"), "bin").limit(most_features))  # features that speak for toxicity
    model = Model(np.array(sorted(r.bin for r in chosen.collect()), np.int64), np.empty(0), 0.0)

    def design(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([model.features(t).tolist() for t in b.column("text").to_pylist()],
                                                                           pa.list_(pa.int64()))], names=["positive", "features"])

    rows = sample.mapInArrow(design, "positive boolean, features array<long>").collect()  # bounded by the sample and the features
    rows.sort(key=lambda r: (r.positive, r.features))
    model.weights, model.bias = nnpu([np.array(r.features, np.int64) for r in rows], np.array([r.positive for r in rows], bool),
                                     prior, len(model.bins))
    return model


def scores(docs: DataFrame, model: Model, parts: int = PARTS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score of every row of ``docs`` (null text: empty); nothing but the text enters a score."""
    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([learn_remainder(i, parts) == held_out for i in ids.to_pylist()], pa.bool_()),
                 pa.array([model.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double")


def clean_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``."""
    names = docs.columns
    texts = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    @F.pandas_udf("double")
    def score(col):
        return col.map(lambda t: model.score(bytes(t)))

    # the score column's name clashes with no column of the table
    own = "_score" + "_" * max((len(n) for n in names), default=0)
    return docs.withColumn(own, score(texts)).where(F.col(own) < threshold).select(*[f"`{n}`" for n in names])
