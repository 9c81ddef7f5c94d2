"""Mixing sources to target weights by the cube method.

Each source's words are to be taken ``ratio`` times (0 to ``most``).  Every document is taken floor(ratio) times,
and once more with the probability of the rest.  Which documents get the extra copy is drawn by the cube method:
the vector of probabilities of a shard's documents moves, a few documents at a time, along directions that change
neither the expected number of documents nor the expected number of words, until each is 0 or 1 but for at most
two; these go on to the next flight, over the shards of their source.  Of the documents a small landing set is held
back; there, all outcomes are weighed and the one nearest to the source's target is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from .common import written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE, MOST = 1.5, 2.0
SHARD_DOCS = 2048
LANDING = 12


def n_words(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    In code point order, nulls last, sources weigh ``weights``, repeating, and share ``share`` times all words.
    Targets stop at ``most`` times the source's size; what is above goes to the others by weight until none is
    above.  That ends where target = min(most * size, weight * level): sources fill up in the order of
    most * size / weight, so the level follows from running sums over the table of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    w = (sizes.withColumn("weight", F.get(kinds, (F.row_number().over(order) - 1) % len(weights)))
         .withColumn("most", F.col("source_size") * float(most)).withColumn("full_at", F.col("most") / F.col("weight")))
    up = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (w.withColumn("left", F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.col("open")))
    # the first source in this order that its share doesn't fill sets the level of all that follow
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return w.select("source", "source_size", F.when(F.col("full_at") <= level, F.col("most"))
                    .otherwise(F.least(F.col("most"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for at most two, with their sum and their size-weighted sum unchanged.

    Of three open documents, the direction in the null space of (1, 1, 1) and (size) is followed one way or the
    other, at random so that no expectation changes, until one of them is decided; the next takes its place.
    """
    p = p.astype(float).copy()
    scale = max(1.0, float(size.max(initial=1)))
    x, held, eps = size / scale, [], 1e-9
    x, q, draw = x.tolist(), p.tolist(), draws.tolist()
    for i in range(len(q)):
        if q[i] <= eps or q[i] >= 1 - eps:
            q[i] = float(q[i] > 0.5)
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # sums to 0, and so does its product with the sizes
            if not any(u):
                u = (1.0, -1.0, 0.0)  # equal sizes
            up = min((1 - q[k]) / v if v > 0 else q[k] / -v for k, v in zip(held, u) if v)
            down = min(q[k] / v if v > 0 else (1 - q[k]) / -v for k, v in zip(held, u) if v)
            step = up if draw[i] * (up + down) < down else -down
            for k, v in zip(held, u):
                q[k] += step * v
            decided = [k for k in held if q[k] <= eps or q[k] >= 1 - eps]
            if not decided:  # rounding: the nearest one is decided
                decided = [min(held, key=lambda k: min(q[k], 1 - q[k]))]
            for k in decided:
                q[k] = float(q[k] > 0.5)
            held = [k for k in held if k not in decided]
            draw[i] = (draw[i] * 7919.0 + 0.5) % 1.0
    return np.array(q)


def landing(p: np.ndarray, size: np.ndarray, want_size: float, want_docs: float) -> np.ndarray:
    """The 0/1 outcome of a few documents nearest to the wanted words, on near ties to the wanted number."""
    n = len(p)
    if not n:
        return p
    outcomes = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)
    words = np.abs(outcomes @ size - want_size)
    docs = np.abs(outcomes.sum(1) - want_docs)
    return outcomes[np.lexsort((np.arange(1 << n), docs, words))[0]]


def _narrow(docs: DataFrame) -> list:
    """id, source, size and a hash of all columns: rows equal in these are equal, and any of them may be taken for another."""
    kinds = dict(docs.dtypes)
    columns = [F.col(f"`{c}`") for c in docs.columns if "map<" not in kinds[c]]
    return [F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
            F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("hash")]


def _units(rows: DataFrame) -> DataFrame:
    """(id, source, size, hash, nth) of rows: equal rows are numbered by their count alone, whatever task they come from."""
    equal = rows.groupBy("id", "source", "size", "hash").agg(F.count("*").alias("n"))
    return written(equal.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n"), "mix-units")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST, seed: int = 17,
        shard_docs: int = SHARD_DOCS, landing_docs: int = LANDING) -> DataFrame:
    """id, source, size, source_size, target, copies (how often the mix takes the row) of each row of ``docs``.

    Rows with the same doc_id are drawn one by one.  A document without words is taken floor(ratio) times.  A null
    source is a source of its own; a null doc_id is an id like any other.  An empty table gives an empty result.  The same rows
    give the same mix, however they are split into files and tasks: draws come from hashes of the rows and the seed.
    """
    return drawn_copies(_units(docs.select(*_narrow(docs))), weights, share, most, seed, shard_docs, landing_docs).select(
        "id", "source", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken; ``how``: the parameters of ``mix``.

    Equal rows can't be told apart: the first of them stands for all copies that they are taken.  Nulls, repeated rows and
    empty tables are as in ``mix``; other columns keep their names and values.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = written(docs.select(row.alias("_doc"), F.monotonically_increasing_id().alias("row"), *_narrow(docs)), "mix")
    key = ["id", "source", "size", "hash"]
    taken = drawn_copies(_units(kept.select(*key)), **how).groupBy(*key).agg(F.sum("copies").alias("copies")).where("copies > 0")
    first = kept.groupBy(*key).agg(F.min("row").alias("row"))
    same = [first[c].eqNullSafe(taken[c]) for c in ("id", "source")] + [first[c] == taken[c] for c in ("size", "hash")]
    chosen = written(first.join(taken, same).select("row", taken["copies"]), "mix-taken")
    # one plan at every size: the rows are matched by a shuffle
    full = kept.select("_doc", "row").join(chosen.hint("merge"), "row")
    return full.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("_doc.*")


def drawn_copies(rows: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST, seed: int = 17,
                 shard_docs: int = SHARD_DOCS, landing_docs: int = LANDING) -> DataFrame:
    """``rows`` (id, source, size, hash, nth, unique) with source_size, target and copies."""
    per_source = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    want = written(targets(per_source.select("source", "source_size"), weights, share, most), "mix-targets").alias("t")
    plan = (want.join(per_source.select("source", "n"), want["source"].eqNullSafe(per_source["source"]))
            .select(want["source"], "source_size", "target", "n",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"),
                    F.ceil(F.col("n") / shard_docs).cast("int").alias("shards")))
    plan = written(plan, "mix-plan")  # one row a source
    u = F.pmod(F.xxhash64(F.lit(seed), "id", "hash", "nth"), F.lit(1 << 40)) / float(1 << 40)
    p = F.col("ratio") - F.floor("ratio")
    dealt = (rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
             .join(plan.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "source_size", "target", "ratio", "shards"), "key")
             .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "hash", "nth"), F.col("shards").cast("long")))
             .select("id", "hash", "nth", "source", "key", "size", "source_size", "target", F.floor("ratio").cast("int").alias("base"), p.alias("p"), u.alias("u"), "shard"))

    keep = max(2, landing_docs - 2)
    order = [(c, "ascending") for c in ("u", "id", "hash", "nth")]
    unit = ["id", "hash", "nth", "source"]

    def fly(key, table):
        """One shard: the flight, with a few documents of spread sizes held back."""
        table = table.sort_by(order)
        size, p, u = (table.column(c).to_numpy() for c in ("size", "p", "u"))
        moving = np.ones(len(p), bool)
        some = np.flatnonzero((p > 0) & (size > 0))
        if len(some):  # held back: documents whose sizes halve from the middle one down, so that small gaps can be closed
            by_size = some[np.argsort(size[some], kind="stable")]
            at = np.unique(np.linspace(0, len(by_size) - 1, keep).astype(int) if len(by_size) <= 4 * keep else
                           (len(by_size) * np.linspace(0, 0.75, keep)).astype(int))
            moving[by_size[at]] = False
        out = p.copy()
        out[moving] = flight(p[moving], size[moving].astype(float), u[moving])
        fixed = moving & ((out <= 0) | (out >= 1))
        return (table.select([*unit, "key", "size", "source_size", "target", "base"])
                .append_column("p", pa.array(p)).append_column("u", pa.array(u)).append_column("q", pa.array(out))
                .append_column("fixed", pa.array(fixed)))

    schema = "id long, hash long, nth long, source string, key string, size long, source_size long, target double, base int, p double, u double, q double, fixed boolean"
    flown = written(dealt.groupBy("key", "shard").applyInArrow(fly, schema), "mix-flown")
    # a shard leaves at most landing_docs undecided: they fly again, in fewer shards, until a source's fit in one
    decided_rows, undecided = flown.where("fixed"), flown.where("not fixed")
    shards = plan.agg(F.max("shards")).first()[0] or 0
    while shards > 1 and shards * landing_docs > shard_docs:
        shards = min(shards - 1, -(-shards * landing_docs // shard_docs))
        again = (undecided.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 2 + shards), "id", "hash", "nth"), F.lit(shards)))
                 .withColumn("p", F.col("q")).drop("q", "fixed"))
        flown = written(again.groupBy("key", "shard").applyInArrow(fly, schema), "mix-flown")
        decided_rows, undecided = decided_rows.unionByName(flown.where("fixed")), flown.where("not fixed")

    # what the decided documents of a source miss of its words and documents
    wanted = dealt.groupBy("key").agg(F.max("target").alias("wanted"), F.sum(F.col("size") * F.col("base")).alias("base_words"), (F.count("*") * F.max("p")).alias("p"))
    done = decided_rows.groupBy("key").agg(F.sum(F.col("q") * F.col("size")).alias("words"), F.sum("q").alias("docs"))
    decided = (wanted.join(done, "key", "left")
               .select("key", "wanted", (F.col("base_words") + F.coalesce("words", F.lit(0.0))).alias("words"),
                       (F.col("p") - F.coalesce("docs", F.lit(0.0))).alias("docs")))
    most_open = landing_docs

    def land(key, table):
        """The undecided documents of one source: at most ``landing_docs`` of each of its shards."""
        table = table.sort_by(order)
        size, q, u = (table.column(c).to_numpy() for c in ("size", "q", "u"))
        out, open_ = q.copy(), np.arange(len(q))
        if len(q) > most_open:  # a last flight over all but the landing set
            by_size = np.argsort(size, kind="stable")
            at = by_size[np.unique((len(by_size) * np.linspace(0, 0.75, keep)).astype(int))]
            moving = np.ones(len(q), bool)
            moving[at] = False
            out[moving] = flight(q[moving], size[moving].astype(float), u[moving])
            open_ = np.flatnonzero(~moving | ((out > 0) & (out < 1)))
        done = np.ones(len(q), bool)
        done[open_] = False
        if len(q):
            out[open_] = landing(q[open_], size[open_].astype(float),
                                 table.column("wanted")[0].as_py() - table.column("words")[0].as_py() - float(out[done] @ size[done]),
                                 table.column("docs")[0].as_py() - float(out[done].sum()))
        return table.select([*unit, "size", "source_size", "target", "base"]).append_column("q", pa.array(out))

    landed = (undecided.join(decided, "key").groupBy("key")
              .applyInArrow(land, "id long, hash long, nth long, source string, size long, source_size long, target double, base int, q double"))
    every = decided_rows.select(*unit, "size", "source_size", "target", "base", "q").unionByName(landed)
    return every.select("id", "source", "size", "hash", "nth", "source_size", "target", (F.col("base") + F.round("q").cast("int")).alias("copies"))

