"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ensure_checkpoint_dir


#: Rows of whole texts that a Python task takes at once; Spark's default of 10,000 holds several copies of 30 MB and more in each task.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for the jobs run inside; the session's own setting comes back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder of ``spark.checkpoint.dir`` and reread it.

    This cuts the lineage: whatever is derived from the result twice reads the same rows, also after an
    executor is lost.  The folder is left to whoever cleans the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with short_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and the UTF-8 bytes of the text (null: empty); nothing else of ``docs`` is read."""
    return docs.select(*id_and_text_columns())


def id_and_text_columns() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")]


def learn_remainder(doc_id: int | None, parts: int) -> int:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def split_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes.split and bytes.lower know ASCII only)."""
    return text.lower().split()


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of every row as Python values."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 5000,
               weigh: Callable[[tuple], int] | None = None, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``most_rows`` rows (and about ``most_bytes`` by ``weigh``)."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r) if weigh else 0
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def others(docs: DataFrame):
    """All columns of ``docs`` but the text, and whether that is null, as one struct; see ``restored``."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("no_text"))


def restored(columns: list[str], text=None) -> list:
    """The columns of ``docs`` from ``rest`` (made by ``others``) and the bytes ``text``, in their order and with their names."""
    text = F.col("text").cast("string") if text is None else text
    return [(F.when(F.col("rest.no_text"), F.lit(None)).otherwise(text) if c == "text" else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(columns)]


def blocks(docs: DataFrame, rest=None, block_bytes: int = 6 << 20, block_rows: int = 4096) -> DataFrame:
    """``(block, row, doc_id, text)`` and ``rest`` if given, written: every row of ``docs`` in a block of bounded bytes and rows.

    ``row`` tells rows with the same doc_id apart.  A block is a run of neighbouring rows of one input task, so no row is
    moved; a value that many documents share is looked up once a block instead of once a document.  One longer text is a
    block of its own.
    """
    def cut(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        block, size, rows, at = task << 32, 0, 0, task << 40
        for b in batches:
            lengths = pa.compute.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
            ids = np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths.tolist()):
                if rows and (size + n > block_bytes or rows >= block_rows):
                    block, size, rows = block + 1, 0, 0
                ids[i], size, rows = block, size + n, rows + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(at, at + len(ids))), *b.columns],
                                             names=["block", "row", *b.schema.names])
            at += len(ids)

    rows = docs.select(*id_and_text_columns(), *([] if rest is None else [rest.alias("rest")]))
    schema = StructType([StructField("block", LongType()), StructField("row", LongType()), *rows.schema.fields])
    return written(rows.mapInArrow(cut, schema), "blocks")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Runs of rows with the same block: (block, ids, texts).  A block that lies in two tasks gives two runs."""
    block, ids, texts = None, [], []
    for b, i, t in rows_of(batches, "block", "doc_id", "text"):
        if b != block and ids:
            yield block, ids, texts
            ids, texts = [], []
        block = b
        ids.append(i)
        texts.append(t)
    if ids:
        yield block, ids, texts


#: Multipliers of the 64-bit hashes below (odd, from the golden ratio and the SplitMix finaliser).
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_POWERS = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix's finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts: (hash, number of words of each text, position of each word's start).

    ``data`` holds the texts' bytes one after the other, text i at ``offsets[i]`` to ``offsets[i + 1]``.
    """
    global _POWERS
    data = data[offsets[0]:offsets[-1]]
    at = offsets - offsets[0]
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    first[inner] = solid[inner]
    places = np.flatnonzero(solid)
    starts = np.flatnonzero(first[places])
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(at) - 1, np.int64), np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(places)))
    while len(_POWERS) < lengths.max():
        _POWERS = np.concatenate([_POWERS, _POWERS * (GOLDEN ** np.uint64(len(_POWERS)))])
    letters = data[places]
    if lower:
        letters = _LOWER[letters]
    within = np.arange(len(places)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _POWERS[within], starts)
    begins = places[starts]
    counts = np.searchsorted(begins, at[1:]) - np.searchsorted(begins, at[:-1])
    return mix64(sums), counts, begins + offsets[0]


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20):
    """(first row, bytes, offsets) of runs of a binary column's rows, of about ``most_bytes`` each."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        j = min(j, len(column))
        yield i, data, offsets[i:j + 1]
        i = j
