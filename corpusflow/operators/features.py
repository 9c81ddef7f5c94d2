"""Long-form feature blocks.

The canonical matrix form is a long DataFrame ``(doc_id, term, value)``; a
``VectorUDT`` column is built only at the ML boundary (see ``models.py``).
Every block is one shuffle of the documents by their keys, then an explode and
a grouped count in place: the long rows are several times the text they come from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..sources.sinks import landed

#: rows of a list that is broadcast; pairs that a task adds up before it sends them; counts held for a document
MOST_BROADCAST, MOST_HELD, PAIR_CELLS = 1 << 20, 1 << 23, 1 << 22

_SEP = "\u0001"


def ngram_array(tokens, n_max: int = 2, n_min: int = 1) -> Column:
    """All n-grams (space-joined) for n_min <= n <= n_max.

    The token array is referenced only at the top level: a reference inside
    a lambda would be inlined by the optimizer and re-run the tokenizer once
    per array element.  Longer n-grams come from one regex pass over the
    tokens joined by U+0001 (a look-ahead captures each window of n
    tokens)."""
    toks = tokens if isinstance(tokens, Column) else F.col(tokens)
    parts = []
    joined = F.array_join(toks, _SEP)
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(toks)
        else:
            pat = "(?:^|" + _SEP + ")(?=((?:[^" + _SEP + "]+" + _SEP + "){" + str(n - 1) + "}[^" + _SEP + "]+))"
            grams = F.regexp_extract_all(joined, F.lit(pat), 1)
            parts.append(F.transform(grams, lambda g: F.translate(g, _SEP, " ")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def reused(df: DataFrame) -> DataFrame:
    """Persist (recomputable, memory then disk) a long table that feeds two
    branches: column pruning makes the branches' aggregates differ, so the
    optimizer would otherwise re-run the tokenizer for each."""
    return df if df.is_cached else df.persist(StorageLevel.MEMORY_AND_DISK)


def deal(docs: DataFrame, *keys: str) -> DataFrame:
    """``docs`` by their keys in as many parts as the session has for a
    shuffle: parts of text that AQE merged would be large once exploded."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def exploded(docs: DataFrame, terms: Column, *keys: str) -> DataFrame:
    """(*keys, term): a row for each term of an array.

    Of a plain explode Spark infers a filter on the array's size and pushes it
    below the projections that make the array, so that a text is tokenized
    twice, and a chain of projections evaluated many times over.  The outer
    form has no such filter; its row of an empty array has no position."""
    return docs.select(*keys, F.posexplode_outer(terms).alias("_at", "term")).where(F.col("_at").isNotNull()).drop("_at")


def term_counts(docs: DataFrame, terms: Column, keys=("doc_id",), dealt: bool = False) -> DataFrame:
    """Explode an array of terms and count per (keys..., term).

    The documents are dealt by their keys (unless ``dealt``: they are already)
    before they are exploded, and the grouping by (keys..., term) needs no
    other shuffle."""
    keys = list(keys)
    docs = docs if dealt else deal(docs, *keys)
    return exploded(docs, terms, *keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("value"))


def doc_freq(long: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(term, df): rows of the long form are unique per (doc, term)."""
    return long.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def df_bounds(n_docs: Column, min_df=1, max_df=1.0):
    """Resolve min_df / max_df (int = count, float = share of documents) to
    count columns, as the vectorizer arguments do."""
    lo = F.lit(min_df) if isinstance(min_df, int) else F.lit(float(min_df)) * n_docs
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(float(max_df)) * n_docs
    return lo, hi


SALTS = 8
HOT = 1 << 16    # documents from which on a term is spread over ``salts`` tasks


def join_by_term(long: DataFrame, per_term: DataFrame, how: str = "inner", hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """Join per-term rows, with the term's number of long rows as ``df``, back
    to the long table.

    A term that every document holds would meet its one row in one task,
    which AQE can't split because that side is an aggregate: such terms are
    spread over ``salts`` tasks by their documents.  There are at most
    (long rows / hot) of them, a list that is broadcast; all other per-term
    rows are joined once and not copied."""
    often = per_term.where(F.col("df") >= hot).select("term", F.lit(True).alias("_hot"))
    a = (long.join(F.broadcast(often), "term", "left")
         .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot"))
    last = F.when(F.col("df") >= hot, F.lit(salts - 1)).otherwise(0).cast("long")
    b = per_term.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return a.join(b, ["term", "_salt"], how).drop("_salt")


SAMPLED, COMMON, LEAST = 16, 256, 64


def common_terms(long: DataFrame, n_docs: Column) -> DataFrame:
    """(term,) of terms found in about 1 of ``COMMON`` documents and more, by
    every ``SAMPLED``-th document's hash: at most COMMON x (terms of a mean
    document) rows.  They decide how a term is counted only, so that a wrong
    guess costs time and changes no result."""
    some = doc_freq(long.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0))
    return some.where((F.col("df") >= LEAST) & (F.col("df") * (SAMPLED * COMMON) >= n_docs)).select("term")


def with_df(long: DataFrame, n_docs: Column) -> DataFrame:
    """The long table with each term's document frequency ``df``.

    Common terms, most of the rows, are counted by a partial aggregate and
    get their df by a broadcast; the others meet in one shuffle by term,
    where a window counts them: no term's row is copied, no hot term lands
    in one task."""
    long = reused(long)
    common = common_terms(long, n_docs)
    known = doc_freq(long.join(F.broadcast(common), "term", "left_semi"))
    rare = long.where(F.col("term").isNotNull()).join(F.broadcast(common), "term", "left_anti")
    rare = rare.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    return long.join(F.broadcast(known), "term").unionByName(rare)


def df_cut(long: DataFrame, n_docs: Column, min_df=1, max_df=1.0) -> DataFrame:
    """Keep terms whose document frequency lies within the bounds."""
    lo, hi = df_bounds(n_docs, min_df, max_df)
    return with_df(long, n_docs).where((F.col("df") >= lo) & (F.col("df") <= hi)).drop("df")


def intercept(docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """One column of ones named ``#intercept#``."""
    return docs.select(F.col(doc_col).alias("doc_id"), F.lit("#intercept#").alias("term"),
                       F.lit(1.0).alias("value"))


def ngrams(docs: DataFrame, text_col: str = "text", ngram_max: int = 2, min_df=2,
           max_df=1.0, doc_col: str = "doc_id") -> DataFrame:
    """N-gram counts over lower-cased social tokens, df-cut."""
    # the text is dealt out, the tokens are made where it arrives
    dealt = deal(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id")
    long = term_counts(dealt.select("doc_id", tx.social_tokens(F.lower(F.col("_text"))).alias("t")),
                       ngram_array(F.col("t"), ngram_max), dealt=True)
    # read twice (df and the cut): keep the aggregated counts instead of
    # tokenizing twice; lost blocks are recomputed from lineage
    long = long.persist(StorageLevel.MEMORY_AND_DISK)
    n = docs.select(F.count(F.lit(1))).scalar()
    return df_cut(long, n, min_df, max_df)


def hashtag_counts(docs: DataFrame, text_col: str = "text", min_df=1,
                   doc_col: str = "doc_id") -> DataFrame:
    """Hashtag counts (lower-cased)."""
    long = term_counts(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col)),
                       tx.hashtags(F.col(text_col)))
    n = docs.select(F.count(F.lit(1))).scalar()
    return df_cut(long, n, min_df, 1.0)


def tfidf_log(long: DataFrame, n_docs: Column) -> DataFrame:
    """Count x ln(N / df).  A term in every document scores 0."""
    j = with_df(long, n_docs)
    return j.withColumn("value", F.col("value") * F.log(n_docs / F.col("df"))).drop("df")


def tfidf_join(long: DataFrame, n_docs: Column, smooth: bool = True, base=None,
               l2: bool = True) -> DataFrame:
    """Smoothed ``ln((1+N)/(1+df))+1`` (or ``log_base(N/df)``)
    weights, then L2-normalised per document.

    The norm is a per-document window, and a document is one bounded group.
    """
    j = with_df(long, n_docs)
    if smooth:
        idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    else:
        idf = F.log(n_docs / F.col("df"))
        if base:
            idf = idf / F.log(F.lit(float(base)))
    j = j.withColumn("value", F.col("value") * idf).drop("df")
    if l2:
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))
        j = j.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.lit(0.0)))
    return j


def vocabulary_ids(long: DataFrame) -> DataFrame:
    """(term_id, term, df) with ids in term order.

    The vocabulary is first reduced to one row per term (partial aggregate),
    then ranked by range-partitioned sort (see ``ranking.global_rank``)."""
    from .ranking import global_rank
    voc = doc_freq(long)
    return global_rank(voc, ["term"], out="term_id", start=0)


def concat_blocks(*blocks: tuple[str, DataFrame]) -> DataFrame:
    """Stack feature blocks for the same documents, tagged by block."""
    out = None
    for name, b in blocks:
        b = b.select("doc_id", "term", F.col("value").cast("double").alias("value"))
        b = b.withColumn("block", F.lit(name))
        out = b if out is None else out.unionByName(b)
    return out


def lexicon_matches(tokens_df: DataFrame, lexicon: DataFrame, token_col: str = "token") -> DataFrame:
    """Tokens joined to a lexicon table ``(entry, ...)``.

    Entries ending in ``*`` match by prefix.  Each token is exploded into
    itself and its prefixes of the lengths that such entries have, so all
    entries meet their tokens in one equi-join on (key, prefix or not)."""
    lex = lexicon.withColumn("_prefix", F.col("entry").endswith("*")).withColumn(
        "_key", F.when(F.col("_prefix"), F.expr("substring(entry, 1, length(entry) - 1)")).otherwise(F.col("entry")))
    # the distinct lengths: at most as many as the longest entry has characters
    lengths = lex.where("_prefix").agg(F.sort_array(F.collect_set(F.length("_key")))).first()[0]
    t = F.col(token_col)
    keys = [F.struct(F.lit(False).alias("p"), t.alias("k"))] + [
        F.when(F.length(t) >= n, F.struct(F.lit(True).alias("p"), F.substring(t, 1, n).alias("k"))) for n in lengths]
    found = (tokens_df.withColumn("_at", F.explode(F.array_compact(F.array(*keys))))
             .withColumns({"_prefix": F.col("_at.p"), "_key": F.col("_at.k")}).drop("_at"))
    return found.join(lex, ["_key", "_prefix"]).drop("_key", "_prefix")


def cooccurrences(docs: DataFrame, text_col: str = "text", min_df=0.01, max_df=0.99,
                  doc_col: str = "doc_id") -> DataFrame:
    """Ordered token pairs ``a-b`` (a before b, repeats counted) of
    lower-cased ``\\w\\w+`` tokens, df-cut.

    The pair table *is* the feature matrix, so distinct pairs per document
    are produced; occurrence pairs are not.  Reductions, all exact: a
    pair's df never exceeds its tokens' df, so tokens below min_df are
    dropped before pairing; each document's occurrences are folded into one
    sorted position list per distinct token, so the pair count is computed
    inside the row; and pairs are keyed by a long built from token ids (a
    distributed rank of the pruned vocabulary).  A document's pairs are made
    from its row twice, for the pairs' df, of which a task sends sums, and for
    the kept pairs: no pair of a document is shuffled.  Of pairs in a share of
    all documents there are at most (pairs of a mean document) / share, a
    list that is broadcast; a longer list is joined.  Strings are rebuilt
    only for kept pairs."""
    from .ranking import global_rank
    n = docs.select(F.count(F.lit(1))).scalar()
    lo, hi = df_bounds(n, min_df, max_df)
    texts = deal(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id")
    toks = texts.select("doc_id", F.posexplode(tx.regex_tokens(F.lower("_text"), "word2")).alias("pos", "tok"))
    # a token's places; of rows with one doc_id, each place counts by itself
    per = reused(toks.groupBy("doc_id", "tok").agg(F.collect_list("pos").alias("ps")))
    keep = per.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= lo).select("tok")
    vocab = global_rank(keep, ["tok"], out="tid", start=0).persist(StorageLevel.MEMORY_AND_DISK)
    V = vocab.count()
    # tokens of a share of all documents are few; of an absolute number, they may be many
    small = F.broadcast(vocab) if V <= MOST_BROADCAST else vocab
    rows = landed(per.where(F.col("doc_id").isNotNull()).join(small, "tok").groupBy("doc_id").agg(F.collect_list("tid").alias("ids"), F.collect_list("ps").alias("ps")), "cooccurrences")
    step = max(V, 1)

    def pairs(batches):
        for b in batches:
            for doc, ids, ps in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("ps").to_pylist()):
                for keys, values in document_pairs(ids, ps, step):
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(keys), doc_type), pa.array(keys), pa.array(values)], names=["doc_id", "key", "value"])

    def frequencies(batches):
        held = []
        for b in batches:
            for ids, ps in zip(b.column("ids").to_pylist(), b.column("ps").to_pylist()):
                held += [(keys, np.ones(len(keys), np.int64)) for keys, _ in document_pairs(ids, ps, step)]
                if sum(len(k) for k, _ in held) > MOST_HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > MOST_HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(held)], names=["key", "n"])

    from pyspark.sql.pandas.types import to_arrow_type
    doc_field = rows.schema["doc_id"].dataType
    doc_type = to_arrow_type(doc_field)
    df = rows.select("ids", "ps").mapInArrow(frequencies, "key long, n long").groupBy("key").agg(F.sum("n").alias("df"))
    va = vocab.select(F.col("tid").alias("ta"), F.col("tok").alias("a"))
    vb = vocab.select(F.col("tid").alias("tb"), F.col("tok").alias("b"))
    if V <= MOST_BROADCAST:
        va, vb = F.broadcast(va), F.broadcast(vb)
    kept = df.where((F.col("df") >= lo) & (F.col("df") <= hi)).select(
        "key", F.floor(F.col("key") / step).cast("long").alias("ta"), (F.col("key") % step).cast("long").alias("tb"))
    kept = landed(kept.join(va, "ta").join(vb, "tb").select("key", F.concat_ws("-", "a", "b").alias("term")), "pairs")
    block = rows.mapInArrow(pairs, f"doc_id {doc_field.simpleString()}, key long, value long")
    return block.join(F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept, "key").select("doc_id", "term", "value")


def document_pairs(ids: list[int], places: list[list[int]], step: int):
    """Keys (first id * step + second id) of a document's ordered token pairs
    and how often each has its first token before its second; in parts of
    second tokens, so that memory stays bounded whatever the document's length."""
    ids = np.array(ids, np.int64)
    sizes = np.array([len(p) for p in places])
    pos = np.concatenate([np.array(p, np.int64) for p in places]) if len(places) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(pos, kind="stable")
    before = np.zeros(len(ids), np.int64)
    last = len(order)
    width = max(1, PAIR_CELLS // max(len(ids), 1))
    # tokens in the order of their places: what came before a token is known when it is met
    for start in range(0, len(ids), width):
        held = np.zeros((min(width, len(ids) - start), len(ids)), np.int64)
        before[:] = 0
        at = 0
        while at < last:
            p, end = pos[order[at]], at
            while end < last and pos[order[end]] == p:
                end += 1
            met = owner[order[at:end]]
            for m in met:
                if start <= m < start + len(held):
                    held[m - start] += before
            np.add.at(before, met, 1)
            at = end
        second, first = np.nonzero(held)
        if len(first):
            yield ids[first] * step + ids[second + start], held[second, first]


def _added(parts):
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
