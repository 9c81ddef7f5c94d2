"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two.  The sum knows no order, and a paragraph is inserted or deleted by
adding or subtracting its vector, without reading the others.

The vector has two parts: EXACT lanes of 64 bits from the paragraph's BLAKE2b digest, for equality, and NEAR lanes of
32 bits, in which each pair of neighbouring words of the paragraph adds +1 or -1 to one lane.  So does each run of GRAM code
points of a word of LONG bytes and more, as scripts without blanks have them.  Products of the NEAR parts estimate how
many of these features two documents share.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, batches_of, hashed_words, id_and_text, mix64, rows_of

EXACT, NEAR = 4, 128
GRAM, LONG = 3, 25
_LONG_WORD = re.compile(rb"[^\x20\x09-\x0d]{%d,}" % LONG)
BUCKET_ROWS, MOST_BUCKETS = 2048, 20_000
NO_ID = -(1 << 63)


def fingerprint(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(EXACT uint64 lanes, NEAR uint32 lanes) of all paragraphs of a text."""
    lines = text.split(b"\n")
    digests = b"".join(hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in lines)
    exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    ends = np.cumsum([0] + [len(x) for x in lines])
    words, counts, _ = hashed_words(np.frombuffer(b"".join(lines), np.uint8), ends, lower=False)
    if not len(words):
        return exact, np.zeros(NEAR, np.uint32)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0  # a paragraph's first word has no word before it
    pairs = mix64(words + before * GOLDEN)
    grams = [code_grams(m[0]) for m in _LONG_WORD.finditer(text)]
    if grams:
        pairs = np.concatenate([pairs, *grams])
    signs = 1.0 - 2.0 * (pairs & np.uint64(1)).astype(float)
    lanes = np.bincount((pairs >> np.uint64(57)).astype(np.int64), weights=signs, minlength=NEAR)
    return exact, lanes.astype(np.int64).astype(np.uint32)


def code_grams(word: bytes) -> np.ndarray:
    """Hashes of all runs of GRAM code points of a word."""
    points = np.frombuffer(word.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    total = np.full(max(0, len(points) - GRAM + 1), GRAM, np.uint64)
    for k in range(GRAM):
        total = total * GOLDEN + points[k:k + len(total)]
    return mix64(total)


def insert(a: tuple, b: tuple) -> tuple:
    """The fingerprint of the paragraphs of both."""
    return a[0] + b[0], a[1] + b[1]


def delete(a: tuple, b: tuple) -> tuple:
    """The fingerprint of a's paragraphs without b's, which must be among them."""
    return a[0] - b[0], a[1] - b[1]


def as_hex(f: tuple) -> str:
    return (f[0].astype("<u8").tobytes() + f[1].astype("<u4").tobytes()).hex()


def likeness(a: tuple, b: tuple) -> float:
    """Estimated share of the features of either that both have, 0 to 1; 1 for equal fingerprints."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.int32).astype(float), b[1].astype(np.int32).astype(float)
    both = float(x @ y)
    union = float(x @ x) + float(y @ y) - both
    return min(1.0, max(0.0, both / union)) if union > 0 else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many code points of the following one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, after, key, doc_id, text): the rows in buckets of neighbouring doc_ids, each bucket followed by a copy of
    the first row of the next one (``after``; behind the last bucket comes the first).

    Rows with the same doc_id are ordered by their text; null ids come first.
    """
    spark = docs.sparkSession
    base = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    n = base.count()
    parts = min(MOST_BUCKETS, max(1, n // bucket_rows))
    shares = [i / parts for i in range(1, parts)]
    edges = sorted(set(base.select("key").agg(F.percentile_approx("key", shares, 20 * parts)).first()[0] or [])) if shares else []
    bounds = np.array(edges, np.int64)

    def bucket_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, b.column("key").to_numpy(), "right")), b.column("key")],
                                             names=["bucket", "key"])

    # the first key of each bucket: at most one row a bucket
    firsts = {r.bucket: r.key for r in base.select("key").mapInArrow(bucket_of, "bucket long, key long")
              .groupBy("bucket").agg(F.min("key").alias("key")).collect()}
    order = sorted(firsts)
    previous = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    first_keys = np.array(sorted(previous), np.int64)
    behind = np.array([previous[k] for k in sorted(previous)], np.int64)

    def deal(batches):
        for b in batches:
            keys = b.column("key").to_numpy()
            bucket = np.searchsorted(bounds, keys, "right")
            own = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(keys), bool)), *(b.column(c) for c in ("key", "doc_id", "text"))],
                                             names=["bucket", "after", "key", "doc_id", "text"])
            yield own
            at = np.minimum(np.searchsorted(first_keys, keys), max(0, len(first_keys) - 1))
            copied = np.flatnonzero(first_keys[at] == keys) if len(first_keys) else np.empty(0, int)
            if len(copied):
                some = b.take(pa.array(copied))
                yield pa.RecordBatch.from_arrays([pa.array(behind[at[copied]]), pa.array(np.ones(len(copied), bool)),
                                                  *(some.column(c) for c in ("key", "doc_id", "text"))],
                                                 names=["bucket", "after", "key", "doc_id", "text"])

    dealt = base.select("key", "doc_id", "text").mapInArrow(deal, "bucket long, after boolean, key long, doc_id long, text binary")
    return dealt.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket") \
        .sortWithinPartitions("bucket", "after", "key", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every row's text and of its edited text (see ``edited``), and their likeness.

    A null text counts as empty; a single document follows itself; an empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    def run(batches):
        def out():
            held = None  # bucket, doc_id, text, its fingerprint
            for bucket, after, doc_id, data in rows_of(batches, "bucket", "after", "doc_id", "text"):
                if held is not None and held[0] == bucket or held is None and not after:
                    text, own = data.decode("utf-8", "replace"), fingerprint(data)
                    if held is not None:
                        _, id_, before, mark = held
                        changed = edited(before, text).encode("utf-8", "replace")
                        other = fingerprint(changed)
                        yield (id_, len(before), hashlib.sha256(changed).hexdigest(), as_hex(mark), as_hex(other),
                               likeness(mark, other), likeness(mark, own))
                    held = None if after else (bucket, doc_id, text, own)

        return batches_of(out(), _OUT, 2000)

    return with_next(docs, bucket_rows).mapInArrow(run, OUT_DDL)
