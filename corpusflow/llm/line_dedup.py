"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

State, all of it Spark tables:

* ``refs`` (shard, key, refs, owner): for each line key the exact number of documents that hold it and the largest
  doc_id among them;
* ``filters`` (shard, filter): a cuckoo filter of the shard's repeated keys, those held by ``min_docs`` documents.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys shorter than
``min_chars`` code points are never counted.  Keys are kept as their 128-bit BLAKE2b digest.

``insert`` and ``delete`` change the counts by those of some documents and put keys into the filters, or take them
out, where a count crosses ``min_docs``; what ``apply`` drops follows the counts, so deleting a document gives back
the lines that are no longer repeated.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import batches_of, blocks, by_block, others, restored, written

MIN_DOCS, MIN_CHARS = 3, 20
SHARD_BYTES = 8 << 20  # of text for one shard
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a null doc_id, below every id


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of the line's key; None for keys under ``min_chars`` code points."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


class CuckooFilter:
    """Approximate set of 128-bit digests with deletion: buckets of four 16-bit fingerprints."""

    SLOTS, KICKS = 4, 500

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS) uint16, 0: free; the number of buckets is a power of two

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(digests)) / cls.SLOTS / 0.85))))
        while True:
            made = cls(np.zeros((buckets, cls.SLOTS), np.uint16))
            if all(made.insert(d) for d in digests):
                return made
            buckets *= 2

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        mark = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = words[:, 0] & np.uint64(len(self.slots) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place, mark):
        """The second bucket of a fingerprint; applied twice it gives the first again."""
        spread = (np.asarray(mark, np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)
        return (np.asarray(place, np.uint64) ^ spread) & np.uint64(len(self.slots) - 1)

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        mark, a, b = self._places(digests)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(1)

    def insert(self, digest: bytes) -> bool:
        """False if no place was found; the filter must then be built anew, with more buckets."""
        mark, a, b = (int(x[0]) for x in self._places([digest]))
        for place in (a, b):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = a
        for kick in range(self.KICKS):
            slot = (kick * 7 + mark) % self.SLOTS
            mark, self.slots[place, slot] = int(self.slots[place, slot]), mark
            place = int(self._other(place, mark))
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Takes out one copy; call it only for digests that were inserted."""
        mark, a, b = (int(x[0]) for x in self._places([digest]))
        for place in (a, b):
            held = np.flatnonzero(self.slots[place] == mark)
            if len(held):
                self.slots[place, held[0]] = 0
                return True
        return False


_POSTING = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("block", pa.int64()), ("refs", pa.int64()), ("owner", pa.int64())])
_POSTING_DDL = "shard int, key binary, block long, refs long, owner long"


def block_lines(held: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """(shard, key, block, refs, owner): each block's keys with their number of documents and largest doc_id."""
    def run(batches):
        def out():
            for block, ids, texts in by_block(batches):
                found: dict[bytes, list[int]] = {}
                for doc_id, text in zip(ids, texts):
                    own = NO_ID if doc_id is None else doc_id
                    for key in {line_key(x, min_chars) for x in text.split(b"\n")} - {None}:
                        if (x := found.get(key)) is None:
                            found[key] = [1, own]
                        else:
                            x[0] += 1
                            x[1] = max(x[1], own)
                for key, (n, own) in found.items():
                    yield int.from_bytes(key[8:12], "big") % shards, key, block, n, own

        return batches_of(out(), _POSTING, 20_000)

    return held.mapInArrow(run, _POSTING_DDL)


@dataclass
class LineIndex:
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_bytes: int = SHARD_BYTES) -> LineIndex:
        """The index of the rows of ``docs``; each row counts as one document."""
        return cls._of(blocks(docs), min_docs, min_chars, shard_bytes)[0]

    @classmethod
    def _of(cls, held: DataFrame, min_docs: int, min_chars: int, shard_bytes: int) -> tuple[LineIndex, DataFrame]:
        shards = max(1, -(-(held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
        postings = written(block_lines(held, shards, min_chars), "line-postings")
        refs = written(postings.groupBy("shard", "key").agg(F.sum("refs").alias("refs"), F.max("owner").alias("owner")), "line-refs")
        return cls(refs, cls._filters(refs, min_docs), shards, min_docs, min_chars), postings

    @staticmethod
    def _filters(refs: DataFrame, min_docs: int) -> DataFrame:
        def build(key, table):
            return pa.table({"shard": [key[0].as_py()], "filter": [CuckooFilter.of(table.column("key").to_pylist()).dump()]},
                            schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary())]))

        repeated = refs.where(F.col("refs") >= min_docs).select("shard", "key")
        return written(repeated.groupBy("shard").applyInArrow(build, "shard int, filter binary"), "line-filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with some more documents."""
        more = block_lines(blocks(docs), self.shards, self.min_chars).select("shard", "key", "refs", "owner")
        refs = written(self.refs.unionByName(more).groupBy("shard", "key").agg(F.sum("refs").alias("refs"), F.max("owner").alias("owner")), "line-refs")
        return self._changed(refs)

    def delete(self, gone: DataFrame, remaining: DataFrame) -> LineIndex:
        """The index without the documents ``gone``; ``remaining`` are those that stay, of which only such lines
        are counted again as lost their owner."""
        less = (block_lines(blocks(gone), self.shards, self.min_chars).groupBy("shard", "key")
                .agg(F.sum("refs").alias("less"), F.max("owner").alias("gone_owner")))
        left = written(self.refs.join(less, ["shard", "key"], "left")
                       .select("shard", "key", (F.col("refs") - F.coalesce("less", F.lit(0))).alias("refs"), "owner",
                               (F.col("gone_owner") == F.col("owner")).alias("lost")).where("refs > 0"), "line-refs")
        lost = left.where("lost").select("shard", "key")
        owners = (block_lines(blocks(remaining), self.shards, self.min_chars).join(lost, ["shard", "key"], "left_semi")
                  .groupBy("shard", "key").agg(F.max("owner").alias("new_owner")))
        refs = left.join(owners, ["shard", "key"], "left").select("shard", "key", "refs", F.coalesce("new_owner", "owner").alias("owner"))
        return self._changed(written(refs, "line-refs"))

    def _changed(self, refs: DataFrame) -> LineIndex:
        """Moves the keys whose count crossed ``min_docs`` into and out of the filters."""
        n, shards = self.min_docs, self.shards
        was = self.refs.select("shard", "key", F.col("refs").alias("was"))
        crossed = (refs.select("shard", "key", F.col("refs").alias("now")).join(was, ["shard", "key"], "full")
                   .select("shard", "key", (F.coalesce("was", F.lit(0)) >= n).alias("was"), (F.coalesce("now", F.lit(0)) >= n).alias("now"))
                   .where("was <> now").select("shard", "key", F.col("now").alias("add")))

        def change(key, filters, crossed):
            held = CuckooFilter.load(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter.of([])
            for digest in [k for k, add in zip(crossed.column("key").to_pylist(), crossed.column("add").to_pylist()) if not add]:
                held.delete(digest)
            fits = all(held.insert(k) for k, add in zip(crossed.column("key").to_pylist(), crossed.column("add").to_pylist()) if add)
            return pa.table({"shard": [key[0].as_py()], "filter": [held.dump()], "full": [not fits]},
                            schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("full", pa.bool_())]))

        changed = written(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
                          .applyInArrow(change, "shard int, filter binary, full boolean"), "line-filters")
        full = [r.shard for r in changed.where("full").select("shard").collect()]  # one number a shard at most
        filters = changed.where("not full").select("shard", "filter")
        if full:
            filters = filters.unionByName(self._filters(refs.where(F.col("shard").isin(full)), n))
        return LineIndex(refs, filters, shards, n, self.min_chars)

    def apply(self, docs: DataFrame) -> DataFrame:
        """row, doc_id, text (kept lines joined by newlines), n_lines, n_dropped of each row of ``docs``."""
        held = blocks(docs)
        return self._applied(held, block_lines(held, self.shards, self.min_chars))

    def _applied(self, held: DataFrame, postings: DataFrame) -> DataFrame:
        min_docs, min_chars = self.min_docs, self.min_chars
        repeated = self.refs.where(F.col("refs") >= min_docs).select("shard", "key", "owner")

        def hits(key, left, right):
            # left: filter or exact rows of the shard (both bounded by the shard's keys), right: keys of blocks
            blob = next((x for x in left.column("filter").to_pylist() if x is not None), None)
            digests = right.column("key").to_pylist()
            maybe = np.flatnonzero(CuckooFilter.load(blob).contains(digests)) if blob else []
            exact = dict(zip(left.column("key").to_pylist(), left.column("owner").to_pylist())) if len(maybe) else {}
            block = right.column("block").to_numpy()
            found = [(int(block[i]), digests[i], exact[digests[i]]) for i in maybe if digests[i] in exact]
            return pa.table([list(x) for x in zip(*found)] or [[], [], []],
                            schema=pa.schema([("block", pa.int64()), ("key", pa.binary()), ("owner", pa.int64())]))

        state = (self.filters.select("shard", "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("owner"))
                 .unionByName(repeated.select("shard", F.lit(None).cast("binary").alias("filter"), "key", "owner")))
        found = (state.groupBy("shard").cogroup(postings.select("shard", "key", "block").groupBy("shard"))
                 .applyInArrow(hits, "block long, key binary, owner long"))

        names = [c for c in held.columns if c not in ("block", "text")]

        def clean(key, rows, owned):
            owner = dict(zip(owned.column("key").to_pylist(), owned.column("owner").to_pylist()))
            out: list[tuple] = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                lines, own = text.split(b"\n"), NO_ID if doc_id is None else doc_id
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or owner.get(k, own) == own] if owner else lines
                out.append((b"\n".join(kept).decode("utf-8", "replace"), len(lines), len(lines) - len(kept)))
            made = [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))] or [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())]
            return pa.table([*(rows.column(c) for c in names), *made], names=[*names, "text", "n_lines", "n_dropped"])

        schema = StructType([*(held.schema[c] for c in names), StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
        return held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(clean, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """row, doc_id, text, n_lines, n_dropped of each row of ``docs`` with the lines dropped that its own rows repeat.

    A key that at least ``min_docs`` rows hold loses its lines except in rows with the largest doc_id holding it
    (a null id is below all others).  A null or empty text is one empty line; an empty table gives an empty result;
    other columns are not read.
    """
    return _dedup(blocks(docs), min_docs, min_chars, shard_bytes)


def _dedup(held: DataFrame, min_docs: int, min_chars: int, shard_bytes: int) -> DataFrame:
    index, postings = LineIndex._of(held, min_docs, min_chars, shard_bytes)
    return index._applied(held, postings)


def clean_rows(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated lines taken out of their texts, and n_chars (where there is
    one) as the length of what is left.  Rows are told apart by their place, not by their ids; a null text stays null."""
    cleaned = _dedup(blocks(docs, others(docs)), min_docs, min_chars, shard_bytes)
    out = cleaned.select(*restored(docs.columns), F.col("n_dropped").alias("_dropped" + "_" * max(map(len, docs.columns))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(out.columns[-1])
