"""Best-fit packing by sum of squares.

Documents are tokenised, closed by an end id and, where longer than a sequence, cut into whole sequences with the
short piece in front.  Whole pieces are sequences of their own.  All other pieces are dealt to shards of a bounded
number of pieces; in a shard each piece goes where the sum of the squared numbers of open bins per residual gap
becomes smallest (the sum-of-squares rule), larger pieces first.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_and_text, rows_of, written

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 65536

_PIECE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids (uint32) of the byte-level BPE vocabulary.

    The vocabulary's ranks give the same ids as its ``tokenizers`` file, several times as fast; the file itself is
    used for texts that name a special token and where the faster library gives up.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" not in text:
            try:
                return np.asarray(fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # the regex engine's panics don't derive from Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than a sequence."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) of every document; ``row`` tells rows with the same id apart."""
    def run(batches):
        from pyspark import TaskContext

        encode, base = encoder(), TaskContext.get().partitionId() << 40

        def out():
            for row, (doc_id, text) in enumerate(rows_of(batches, "doc_id", "text"), base):
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    yield doc_id, row, k, start, n, zlib.crc32(ids[start:start + n].tobytes())

        return batches_of(out(), _PIECE)

    return id_and_text(docs).mapInArrow(run, _PIECE_DDL)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each of ``sizes``, placed in the given order.

    With N(g) open bins of gap g, putting a piece of size s into a bin of gap g changes the sum of N(g)^2 by
    -(2 N(g) - 1), and by 2 N(g - s) + 1 where the bin stays open; a new bin changes it by 2 N(capacity - s) + 1.
    The piece goes where the change is smallest, to the smaller gap on ties and to a new bin last.
    """
    counts = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]  # gap -> its open bins
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        after = 2 * counts[:capacity - s + 1] + 1
        after[0] = 0
        change = np.where(counts[s:] > 0, after - 2 * counts[s:] + 1, far)
        # an unopened sequence has the whole capacity as its gap
        change[-1] = after[-1]
        gap = int(change.argmin()) + s
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = opened[gap].pop()
            counts[gap] -= 1
        if gap > s:
            opened[gap - s].append(b)
            counts[gap - s] += 1
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Rows with the same doc_id are packed one by one.  An empty table
    gives an empty result.  A shard holds about ``shard_pieces`` pieces whatever the number of documents.
    """
    cutted = written(pieces(docs, capacity, end_id), "pieces")
    short = cutted.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_pieces))
    whole = cutted.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def fill(key, table):
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        ids = (key[0].as_py() * (1 << 32) + bins) * 2 + 1
        return (table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
                .append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())))

    shared = (short.withColumn("shard", F.pmod(F.xxhash64("row", "doc_id"), F.lit(shards)))
              .groupBy("shard").applyInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    return whole.unionByName(shared)
