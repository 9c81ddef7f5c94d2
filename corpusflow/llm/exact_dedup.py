"""Exact dedup: owners of equal texts, found by Patricia tries.

A text goes to the shuffle partition of its content hash and length.  There the full byte string, behind its
hash and length, is inserted into a compressed radix trie: two texts meet in one terminal node only if every
byte is the same, whatever their hashes.  A terminal node keeps the owner so far and the number of rows.

* Before the shuffle every input task runs its rows through a trie of its own, so a group of copies that holds a
  third of all rows reaches the shuffle as one text a task.
* Rows arrive at the second trie sorted by hash and length: a subtree below a finished hash and length is final
  and is spilled as output rows as soon as the trie is over its budget.
* Documents keep the (task, text) token of their first trie; the owners go back to them by a join on the token,
  of which one task's rows at most share a value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_and_text, rows_of, written

TRIE_BYTES = 48 << 20


class PatriciaTrie:
    """Compressed radix trie over byte strings; every edge carries a run of bytes."""

    __slots__ = ("root", "size", "sizes")

    def __init__(self):
        self.root: list = [{}, None]  # a node: [first byte -> [label, node], value of the string that ends here]
        self.size = 0
        self.sizes: dict[int, int] = {}  # bytes of the root's subtrees, about, by their first byte

    def _grown(self, key: bytes, by: int) -> None:
        self.size += by
        self.sizes[key[0]] = self.sizes.get(key[0], 0) + by

    def terminal(self, key: bytes) -> list:
        """The node at which ``key`` ends; made where it's missing, with the value None."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, None]
                node[0][key[at]] = [key[at:], leaf]
                self._grown(key, end - at + 200)
                return leaf
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            low, high = 1, min(len(label), end - at)  # label[:low] is shared
            while low < high:
                mid = (low + high + 1) // 2
                if key.startswith(label[:mid], at):
                    low = mid
                else:
                    high = mid - 1
            fork = [{label[low]: [label[low:], edge[1]]}, None]
            edge[0], edge[1] = label[:low], fork
            self._grown(key, 200)
            node, at = fork, at + low
        return node

    def strings(self, first: int | None = None) -> Iterator[tuple[bytes, object]]:
        """(string, value) of every terminal node, or of those in the root's subtree of a first byte."""
        stack = [(b"", self.root)] if first is None else [(self.root[0][first][0], self.root[0][first][1])]
        while stack:
            prefix, node = stack.pop()
            if node[1] is not None:
                yield prefix, node[1]
            stack.extend((prefix + label, child) for label, child in node[0].values())

    def largest_subtree(self) -> int:
        """First byte of the root's subtree that holds the most bytes."""
        return max(self.sizes, key=self.sizes.get)

    def drop(self, first: int) -> None:
        """Forget a subtree of the root."""
        self.size -= self.sizes.pop(first)
        del self.root[0][first]


def content_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _key(text: bytes, h: int) -> bytes:
    return h.to_bytes(8, "big") + len(text).to_bytes(8, "big") + text


def _better(a: tuple, b: tuple, largest: bool) -> tuple:
    """Of two (doc_id, row): the larger or smaller id, null ids last, ties to the smaller row."""
    rank = lambda x: (x[0] is not None, (x[0] or 0) * (1 if largest else -1), -x[1])
    return a if rank(a) >= rank(b) else b


_LOCAL = pa.schema([("is_text", pa.bool_()), ("token", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()),
                    ("n", pa.int64()), ("sha256", pa.string()), ("hash", pa.int64()), ("size", pa.int64()),
                    ("text", pa.binary())])
_LOCAL_DDL = "is_text boolean, token long, doc_id long, row long, n long, sha256 string, hash long, size long, text binary"
_OWNED = pa.schema([("token", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("class", pa.int64()), ("n", pa.int64())])
_OWNED_DDL = "token long, keep_id long, keep_row long, class long, n long"


def exact_owners(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; a null text counts as empty.  Of equal texts the row with the
    largest (``keep="smallest"``: smallest) doc_id stays; null ids lose against all others, and of rows with the
    same doc_id and text exactly one is kept.  Other columns of ``docs`` are not read.  An empty table gives an
    empty result.
    """
    largest = keep == "largest"

    def local(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def out():
            trie, row, tokens = PatriciaTrie(), base, base

            def spilled(first=None):
                for s, (token, best, n) in trie.strings(first):
                    yield (True, token, *best, n, None, int.from_bytes(s[:8], "big", signed=True), len(s) - 16, s[16:])

            for doc_id, text in rows_of(batches, "doc_id", "text"):
                end = trie.terminal(_key(text, content_hash(text)))
                if end[1] is None:
                    end[1] = (tokens, (doc_id, row), 1)
                    tokens += 1
                else:
                    end[1] = (end[1][0], _better(end[1][1], (doc_id, row), largest), end[1][2] + 1)
                yield (False, end[1][0], doc_id, row, 1, hashlib.sha256(text).hexdigest(), None, None, None)
                row += 1
                if trie.size > trie_bytes:
                    while trie.size > trie_bytes // 2:  # several subtrees at once, so that spills are rare
                        first = trie.largest_subtree()
                        yield from spilled(first)
                        trie.drop(first)
            yield from spilled()

        return batches_of(out(), _LOCAL, weigh=lambda r: len(r[8] or b"") + 100)

    def owners(batches):
        """Rows sorted by hash and size."""
        def flush(trie):
            for _, found in trie.strings():
                best, total, first = None, 0, None
                for token, own, n in found:
                    best, total = own if best is None else _better(best, own, largest), total + n
                    first = token if first is None else min(first, token)
                for token, _, _ in found:
                    yield (token, *best, first, total)

        def out():
            trie, group = PatriciaTrie(), None
            for token, doc_id, row, n, h, size, text in rows_of(batches, "token", "doc_id", "row", "n", "hash", "size", "text"):
                if (h, size) != group and trie.size > trie_bytes:
                    yield from flush(trie)
                    trie = PatriciaTrie()
                group = (h, size)
                end = trie.terminal(_key(text, h & (2**64 - 1)))
                if end[1] is None:
                    end[1] = []
                end[1].append((token, (doc_id, row), n))
            yield from flush(trie)

        return batches_of(out(), _OWNED)

    rows = written(id_and_text(docs).mapInArrow(local, _LOCAL_DDL), "exact")
    texts = rows.where("is_text").select("token", "doc_id", "row", "n", "hash", "size", "text")
    found = (texts.repartition("hash", "size").sortWithinPartitions("hash", "size")
             .mapInArrow(owners, _OWNED_DDL))
    members = rows.where("not is_text").select("token", "doc_id", "row", "sha256")
    return (members.join(found, "token")
            .select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.col("sha256").alias("text_sha256")))
