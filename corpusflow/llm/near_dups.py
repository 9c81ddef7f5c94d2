"""MinHash near-dedup by fast similarity sketching.

A document's set of word shingles is sketched in rounds: round i throws every shingle into one of SIZE bins by a hash
of its own; rounds SIZE to 2 * SIZE - 1 throw all shingles into bin i - SIZE, so that every bin is filled whatever the
size of the set.  A bin keeps the smallest (round, hash).  Two sets agree in a bin with a probability of their Jaccard
similarity, and the number of agreements is concentrated about its mean as if the bins were independent.

Documents with equal sets are one node from then on.  Nodes that agree in all rows of a band fall in one bucket, and
each bucket is searched without listing its pairs:

1. every member is paired with one leader and compared with it on the full sets; linked nodes are gathered in
   components.  A bucket's leader is the member with the most fellow members in all its buckets, thus one near the
   middle of its group;
2. members still apart from a leader of one of their buckets are compared with that leader;
3. where buckets still span components, their nodes are searched by the exact prefix filter: in any common order of
   the shingles, two sets that must share o of them share one of the first |x| - o + 1 of x and |y| - o + 1 of y.  Rare
   shingles come first, so two nodes meet only if they share a rare one.

A pair of one bucket is thus compared, or its ends are connected already, or it can't be alike.  With 24 bands of 5 bins
a pair at 0.85 shares no bucket with a probability of 8e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, MIX_A, MIX_B, batches_of, blocks, hashed_words, mix64, others, restored, text_chunks, written

BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
BIN_BITS = 19
_SEEDS = mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * GOLDEN)


def shingle_sets(column: pa.Array, words: int):
    """(row, sorted distinct 64-bit hashes of the word shingles) of each text; a text of fewer words is one shingle."""
    for first, data, offsets in text_chunks(column):
        hashes, counts, _ = hashed_words(data, offsets)
        ends = np.cumsum(counts)
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
            own = hashes[end - n:end]
            if n > words:
                total = np.zeros(n - words + 1, np.uint64)
                for k in range(words):
                    total = total * MIX_A + own[k:n - words + 1 + k]
                yield first + i, np.unique(mix64(total + MIX_B))
            elif n:
                total = np.zeros(1, np.uint64)
                for k in range(n):
                    total = total * MIX_A + own[k:k + 1]
                # a whole short text is the shingle itself: its number of words enters unless it is a full shingle
                yield first + i, mix64(total + MIX_B + np.uint64((words - n) << 32))
            else:
                yield first + i, own


def sketch(shingles: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest (round << 32 | hash) of each bin."""
    bins = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    n, i = len(shingles), 0
    low = np.uint64(0xFFFFFFFF)
    while i < 2 * size:
        # several rounds at once for small sets; later rounds never replace what an earlier one has filled
        rounds = np.arange(i, min(2 * size, i + max(1, int(3 * size / n))))
        y = mix64(shingles[None, :] ^ _SEEDS[rounds][:, None])
        value = (y & low) | (rounds.astype(np.uint64) << np.uint64(32))[:, None]
        place = ((y >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        late = rounds >= size
        place[late] = (rounds[late] - size)[:, None]
        np.minimum.at(bins, place.ravel(), value.ravel())
        i = int(rounds[-1]) + 1
        if (bins >> np.uint64(32) < np.uint64(i)).all():
            break
    return bins


def bands(bins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different from band to band."""
    rows = bins.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        total = mix64(total * MIX_A + rows[:, k])
    return total.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets (sorted, distinct)."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketched(held: DataFrame, words: int) -> DataFrame:
    """(row, doc_id, n, node, bands) of each row: the size of its set, a digest of the set, its bands.  No bands without words."""
    def run(batches):
        for b in batches:
            sizes, nodes, keys = [], [], []
            for _, s in shingle_sets(b.column("text"), words):
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(sketch(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["row", "doc_id", "n", "node", "bands"])

    return held.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, node binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; texts: (node, text)."""
    def run(batches):
        last, own = None, None
        for b in batches:
            keep, leaders = [], b.column("a").to_pylist()
            sets = [s for _, s in shingle_sets(b.column("text_b"), words)]
            some = b.column("text_a")
            for i, a in enumerate(leaders):
                if a != last:
                    last, own = a, next(shingle_sets(some.slice(i, 1), words))[1]
                if alike(own, sets[i], percent):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    # by a shuffle at every size: few pairs would be broadcast, and the figures of small inputs would not tell those of large ones
    full = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a"))
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node on a link (a, b), by large and small stars.

    The large star links each node's larger neighbours to its smallest one, the small star its smaller ones; both keep
    components whole, and in the end each node is linked to its root alone.  Every round is written to the shared folder.
    """
    edges = written(links.where("a <> b").distinct(), "links")
    if not edges.head(1):
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(written(least, "least"), "u").select("v", "m").distinct().toDF("u", "v"), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(written(least, "least"), "u")
        small = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .union(small.select("u", F.col("m").alias("v"))).distinct(), "small")
        roots = small.toDF("a", "b")
        # finished once every node has one root, and no root has another
        more = roots.groupBy("a").count().where("count > 1").select("a").union(
            roots.join(roots.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
        if not more.head(1):
            return roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = roots


def prefix_pairs(nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different roots, at least one of them ``out``, that can be alike; nodes: (node, text, root, out).

    The order of the shingles is by how often their hash bin occurs, one of 2^BIN_BITS.  Any order gives all pairs.
    """
    def count(batches):
        total = np.zeros(1 << BIN_BITS, np.int64)
        for b in batches:
            for _, s in shingle_sets(b.column("text"), words):
                total += np.bincount((s >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    found = nodes.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most 2^BIN_BITS rows
    often = np.zeros(1 << BIN_BITS, np.int64)
    often[found.column("bin").to_numpy()] = found.column("n").to_numpy()

    def prefixes(batches):
        def out():
            for b in batches:
                kept = [b.column(c).to_pylist() for c in ("node", "root", "out")]
                for (_, s), node, root, outside in zip(shingle_sets(b.column("text"), words), *kept):
                    n = len(s)
                    order = np.lexsort((s, often[(s >> np.uint64(64 - BIN_BITS)).astype(np.int64)]))
                    # two sets of n and m elements share at least percent / (100 + percent) * (n + m), and m >= n * percent / 100
                    for place, shingle in enumerate(s[order[:n - -(-n * percent // 100) + 1]].view(np.int64).tolist()):
                        yield shingle, node, root, outside, n, place

        return batches_of(out(), pa.schema([("shingle", pa.int64()), ("node", pa.binary()), ("root", pa.binary()), ("out", pa.bool_()), ("n", pa.int64()),
                                            ("place", pa.int64())]), 20_000)

    rows = written(nodes.mapInArrow(prefixes, "shingle long, node binary, root binary, out boolean, n long, place long"), "prefixes")
    x, y = (rows.select("shingle", *(F.col(c).alias(f"{c}_{v}") for c in ("node", "root", "out", "n", "place"))) for v in "xy")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100.0 + percent) - 1e-6)
    return (x.where("out_x").join(y, "shingle")
            .where((F.col("root_x") != F.col("root_y")) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
                   & (F.col("place_x") <= F.col("n_x") - need) & (F.col("place_y") <= F.col("n_y") - need))
            .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, node, component_id (smallest doc_id reachable), group_size of every row of ``docs``.

    ``words``: words of a shingle; ``percent``: least similarity of a link.  A text of fewer words is one shingle; texts
    without words (null, empty) have none and are linked with nothing, a row each.  Of null ids the component has none
    unless other rows give one.  An empty table gives an empty result; other columns are not read.
    """
    return _components(blocks(docs), words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _components(held: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, doc_id, n, root, component_id) of each row of the blocks; rows without words have no root.

    The texts of bucket members are fetched by a shuffle at every size."""
    rows = written(sketched(held, words), "sketches")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.max("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    # buckets with several nodes, and their leaders
    crowds = written(members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "crowds")
    shared = written(members.join(crowds, "key"), "buckets")
    fellows = written(shared.groupBy("node").agg(F.sum("c").alias("fellows")), "fellows")
    leaders = written(shared.join(fellows, "node").groupBy("key").agg(F.max(F.struct("fellows", "node", "n")).alias("first"))
                      .select("key", F.col("first.node").alias("a"), F.col("first.n").alias("n_a")), "leaders")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    pairs = written(shared.select("key", F.col("node").alias("b"), F.col("n").alias("n_b")).join(leaders, "key")
                    .where((F.col("a") != F.col("b")) & fits(F.col("n_a"), F.col("n_b")))
                    .groupBy("a", "b").agg(F.count("*").alias("c")), "pairs")
    first = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).where("rank = 1").select("a", "b")
    first = written(first, "first-pairs")
    inside = fellows.select("node")
    # one text for each node that is in a bucket with others
    wanted = nodes.select("node", "row").join(inside, "node", "left_semi")
    wanted = written(wanted, "wanted").hint("merge")
    texts = written(held.select("row", "text").join(wanted, "row").select("node", "text"), "candidate-texts")
    links = written(verified(first, texts, words, percent), "links-1")
    roots = components(links)

    def rooted(df: DataFrame, name: str, roots: DataFrame) -> DataFrame:
        found = roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        return df.join(found, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))

    apart = written(rooted(rooted(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), "a", roots), "b", roots)
                    .where("root_a <> root_b").select("a", "b"), "second-pairs")
    if apart.head(1):
        links = written(links.unionByName(verified(apart, texts, words, percent)), "links-2")
        roots = components(links)
    # what is left: nodes of buckets that span components; out: not of the largest one of some bucket
    placed = written(rooted(shared.select("key", F.col("node").alias("b")), "b", roots).select("key", F.col("b").alias("node"), F.col("root_b").alias("root")), "placed")
    spans = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max(F.struct("c", "root"))["root"].alias("largest"), F.count("*").alias("roots")).where("roots > 1").select("key", "largest")
    left = written(placed.join(written(spans, "spans"), "key").groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("largest")).alias("out")), "left")
    rest = written(prefix_pairs(written(texts.join(left, "node"), "left-texts"), words, percent), "rest-pairs")
    if rest.head(1):
        links = written(links.unionByName(verified(rest, texts, words, percent)), "links-3")
        roots = components(links)
    named = written(rooted(nodes.select("node", "id"), "node", roots.select("node", "root")).select("node", "id", F.col("root_node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = written(named.join(written(least, "least-ids"), "root").select("node", "root", "component_id"), "node-components")
    some = rows.select("row", "doc_id", "n", "node")
    return (some.where("node is not null").join(ids, "node").select("row", "doc_id", "n", "root", "component_id")
            .unionByName(some.where("node is null").select("row", "doc_id", "n", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"))))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: the first row with the group's smallest doc_id.

    Rows without words are linked with nothing and all stay.
    """
    held = blocks(docs, others(docs))
    found = written(_components(held, words, percent).where("root is not null").select("row", "doc_id", "root"), "near-rows")
    best = written(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("best")), "near-best")
    gone = written(found.join(best, "root").where("row <> best").select("row"), "near-gone")
    return held.join(gone.hint("merge"), "row", "left_anti").select(*restored(docs.columns))
