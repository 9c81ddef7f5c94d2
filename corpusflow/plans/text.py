"""Text and feature queries (H*, I01-I11, D25, F03 flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators.ranking import top_k_per_group
from .common import labelled_documents
from .registry import query

WORD2_SQL = r"'[\p{L}\p{N}_]{2,}'"


def top_terms_per_label(spark: SparkSession, sf: str, k: int = 20, min_df: int = 2) -> DataFrame:
    """Flagship: labelled documents -> word tokens -> unigram counts with a
    df cut -> TF-IDF count x ln(N/df) summed per label -> top k per label.

    Plan: one explode; (label, term) counts and distinct-document counts are
    partial-aggregated before the only large shuffle; df is a window over
    the (label, term) rows of one term (at most #labels rows per group); the
    top-k is a window group limit applied before its shuffle."""
    docs = labelled_documents(spark, sf, inner=True).select("doc_id", "label", "text")
    ex = docs.select("label", "doc_id",
                     F.explode(tx.regex_tokens(F.lower(F.col("text")), "word2")).alias("term"))
    lt = ex.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"),
                                         F.count_distinct("doc_id").alias("ndocs"))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    lt = lt.withColumn("df", F.sum("ndocs").over(Window.partitionBy("term")).cast("long"))
    sc = (lt.where(F.col("df") >= min_df)
          .withColumn("score", F.round(F.col("n") * F.log(n_docs / F.col("df")), 6)))
    top = top_k_per_group(sc, ["label"], [F.desc("score"), F.asc("term")], k)
    return top.select("label", F.col("rank").cast("long").alias("rank"), "term", "score", "df")


query("F03", sql=rf"""
WITH docs AS (
  SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
ex AS (SELECT label, doc_id, unnest(regexp_extract_all(lower(text), {WORD2_SQL})) AS term FROM docs),
lt AS (SELECT label, term, count(*) AS n, count(DISTINCT doc_id) AS ndocs FROM ex GROUP BY label, term),
dfs AS (SELECT term, sum(ndocs) AS df FROM lt GROUP BY term),
sc AS (SELECT lt.label, lt.term, CAST(dfs.df AS BIGINT) AS df,
              round(lt.n * ln((SELECT count(*) FROM docs) / dfs.df), 6) AS score
       FROM lt JOIN dfs ON lt.term = dfs.term WHERE dfs.df >= 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS rank FROM sc)
SELECT label, rank, term, score, df FROM rk WHERE rank <= 20
""")(top_terms_per_label)


# ----------------------------------------------------------------------------
# Shared derived inputs (FIXTURES section 4) and their SQL twins.
# ----------------------------------------------------------------------------
TAGGED_SQL = "concat(text, ' #', source, ' #Lang_', lang)"
EMO_SQL = ("concat(text, CASE WHEN doc_id % 5 = 0 THEN ' :)' ELSE '' END, "
           "CASE WHEN doc_id % 7 = 0 THEN ' :(' ELSE '' END)")
# Java (?U)\s as an explicit class for RE2
USPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tagged(c=None):
    return F.concat(F.col("text"), F.lit(" #"), F.col("source"), F.lit(" #Lang_"), F.col("lang"))


def with_emoticons():
    return F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, " :)").otherwise(""),
                    F.when(F.col("doc_id") % 7 == 0, " :(").otherwise(""))


def _docs(spark, sf):
    from ..sources.tables import table
    return table(spark, sf, "documents")


def _pages(spark, sf):
    from ..sources.tables import table
    return table(spark, sf, "pages")


# A ten-entry lexicon (user-supplied in real use; the reference
# ships none).  Columns: entry, category, pleasure, arousal, dominance, score.
LEXICON = [
    ("the", "article", 5.0, 4.0, 5.5, 0),
    ("and", "conj", 6.0, 3.5, 5.0, 1),
    ("of", "prep", 5.0, 3.0, 5.0, 0),
    ("le", "article", 5.5, 4.5, 5.0, 1),
    ("la", "article", 5.5, 4.0, 6.0, 2),
    ("der", "article", 4.5, 5.0, 5.0, -1),
    ("und", "conj", 6.5, 4.0, 5.5, 2),
    ("el", "article", 5.0, 5.5, 4.5, -2),
    ("th*", "th_words", 4.0, 6.0, 4.0, -1),
    ("en*", "en_words", 7.0, 3.0, 6.5, 3),
]
LEXICON_SQL = "(VALUES " + ", ".join(
    f"('{e}', '{c}', {p}, {a}, {d}, {s})" for e, c, p, a, d, s in LEXICON) + \
    ") lx(entry, category, pleasure, arousal, dominance, score)"
LEX_MATCH_SQL = rf"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD2_SQL})) AS token FROM documents),
lex AS (SELECT * FROM {LEXICON_SQL}),
m AS (SELECT tok.doc_id, tok.token, lex.* FROM tok JOIN lex
      ON (NOT ends_with(lex.entry, '*') AND tok.token = lex.entry)
      OR (ends_with(lex.entry, '*') AND starts_with(tok.token, rtrim(lex.entry, '*'))))"""


def lexicon_df(spark):
    return spark.createDataFrame(LEXICON, "entry string, category string, pleasure double, "
                                          "arousal double, dominance double, score long")


def _lex_matches(spark, sf):
    from ..operators.features import lexicon_matches
    d = _docs(spark, sf)
    tok = d.select("doc_id", F.explode(tx.regex_tokens(F.lower("text"), "word2")).alias("token"))
    return lexicon_matches(tok, lexicon_df(spark))


def _r(c, n=6):
    return F.round(c, n)


# H01 ---------------------------------------------------------------------------
@query("H01", sql=r"""
WITH t AS (SELECT unnest(string_split_regex(trim(translate(lower(text), '".,;:!?''/()[]', '             ')), '\s+')) AS term
           FROM documents)
SELECT term, count(*) AS n FROM t
WHERE term <> '' AND term NOT IN ('a','an','the','and','or','but','for','to','in','at','as','you','this','it','your','-','http','>>','be')
GROUP BY term
""")
def h01_naive(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select(F.explode(tx.naive_tokens("text")).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# H02 ---------------------------------------------------------------------------
@query("H02", sql=rf"""
SELECT doc_id, unnest(regexp_extract_all(lower({TAGGED_SQL}), '#[\p{{L}}\p{{N}}_]+')) AS tag FROM documents
""")
def h02_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(tx.hashtags(tagged())).alias("tag"))


# H03 / H04 (no SQL twin: the tokenizer needs look-ahead) -------------------------
@query("H03")
def h03_social_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", with_emoticons().alias("text"))
    return d.select("doc_id", F.posexplode(tx.social_tokens("text")).alias("pos", "token"))


@query("H04")
def h04_offsets(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", tx.squeeze_whitespace(with_emoticons()).alias("s"))
    d = d.withColumn("toks", tx.social_tokens("s"))
    d = d.withColumn("starts", tx.token_offsets("toks", "s"))
    return d.select("doc_id", F.posexplode(F.arrays_zip("toks", "starts")).alias("pos", "z")) \
        .select("doc_id", "pos", F.col("z.toks").alias("token"), F.col("z.starts").alias("start"))


# H05 ---------------------------------------------------------------------------
@query("H05", sql=rf"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '{USPACE}+', ' ', 'g')) AS sq FROM documents),
l AS (SELECT doc_id, sq, regexp_replace(sq, '({USPACE}|^)([''"“”‘’<>«»{{}}()\[\]]+)([a-zA-Z0-9])', '\1\2 \3', 'g') AS m1 FROM s),
r AS (SELECT doc_id, sq, regexp_replace(m1, '([a-zA-Z0-9])([''"“”‘’<>«»{{}}()\[\]]+)({USPACE}|$)', '\1 \2\3', 'g') AS m2 FROM l)
SELECT doc_id, length(sq) AS squeezed_len, md5(sq) AS squeezed_md5, length(m2) AS munged_len, md5(m2) AS munged_md5 FROM r
""")
def h05_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", tx.squeeze_whitespace("text").alias("sq"))
    d = d.withColumn("m", tx.edge_punct_munge("sq"))
    return d.select("doc_id", F.length("sq").cast("long").alias("squeezed_len"), F.md5("sq").alias("squeezed_md5"),
                    F.length("m").cast("long").alias("munged_len"), F.md5("m").alias("munged_md5"))


# H06 ---------------------------------------------------------------------------
@query("H06", sql=rf"""
WITH e AS (SELECT lang, {EMO_SQL} AS t FROM documents),
p AS (SELECT lang, regexp_matches(t, '(\^_\^|[:=](|o|O|-)[D\)\]])') AS h,
             regexp_matches(t, '[:=](|o|O|-)[\(\[]') AS s FROM e)
SELECT lang, CASE WHEN h AND s THEN 'BOTH_HS' WHEN h THEN 'HAPPY' WHEN s THEN 'SAD' ELSE 'NA' END AS polarity,
       count(*) AS n FROM p GROUP BY 1, 2
""")
def h06_polarity(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("lang", tx.emoticon_polarity(with_emoticons()).alias("polarity"))
    return d.groupBy("lang", "polarity").agg(F.count(F.lit(1)).alias("n"))


# H07 ---------------------------------------------------------------------------
@query("H07", sql=rf"""
WITH e AS (SELECT unnest(regexp_extract_all({EMO_SQL}, '([:=]|[;])(|o|O|-)([pP]|[doO/\\]|[\(\[]|[D\)\]])')) AS emoticon
           FROM documents)
SELECT emoticon, count(*) AS n FROM e GROUP BY emoticon
""")
def h07_emoticons(spark: SparkSession, sf: str) -> DataFrame:
    e = _docs(spark, sf).select(F.explode(tx.emoticons(with_emoticons())).alias("emoticon"))
    return e.groupBy("emoticon").agg(F.count(F.lit(1)).alias("n"))


# H08 ---------------------------------------------------------------------------
@query("H08", sql=rf"""
SELECT doc_id,
       len(regexp_extract_all(text, {WORD2_SQL})) AS n_word2,
       len(regexp_extract_all(text, '\S+')) AS n_nonspace,
       len(regexp_extract_all(text, '#?[\p{{L}}\p{{N}}_]+')) AS n_hashword,
       len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: length(x) BETWEEN 2 AND 15)) AS n_alpha
FROM documents
""")
def h08_token_families(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id",
                    F.size(tx.regex_tokens("text", "word2")).cast("long").alias("n_word2"),
                    F.size(tx.regex_tokens("text", "nonspace")).cast("long").alias("n_nonspace"),
                    F.size(tx.regex_tokens("text", "hashword")).cast("long").alias("n_hashword"),
                    F.size(tx.regex_tokens("text", "alpha", lower=True, min_len=2, max_len=15)).cast("long").alias("n_alpha"))


# H09 ---------------------------------------------------------------------------
@query("H09", sql=rf"""
WITH t AS (SELECT doc_id, {TAGGED_SQL} AS txt FROM documents),
g AS (SELECT doc_id, txt, unnest(regexp_extract_all(lower(txt), '#[\p{{L}}\p{{N}}_]+')) AS tag FROM t)
SELECT doc_id, tag, length(replace(txt, tag, '')) AS new_len, md5(replace(txt, tag, '')) AS new_md5 FROM g
""")
def h09_remove_tag(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", tagged().alias("txt"))
    g = d.select("doc_id", "txt", F.explode(tx.hashtags("txt")).alias("tag"))
    r = tx.remove_tag("txt", "tag")
    return g.select("doc_id", "tag", F.length(r).cast("long").alias("new_len"), F.md5(r).alias("new_md5"))


# H10 ---------------------------------------------------------------------------
@query("H10", sql=r"""
SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '\p{L}+'),
       lambda x: length(x) BETWEEN 2 AND 15 AND x NOT IN ('http', 'https', 't', 'co', 'bit', 'ly'))) AS n_tokens
FROM documents
""")
def h10_topic_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    toks = tx.regex_tokens("text", "alpha", lower=True, min_len=2, max_len=15)
    return _docs(spark, sf).select("doc_id", F.size(tx.drop_stopwords(toks, tx.TOPIC_EXTRA_STOPWORDS)).cast("long").alias("n_tokens"))


# H11 (goldens only: the full entity table has no SQL twin) ------------------------
@query("H11")
def h11_unescape(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return p.select("page_id", tx.html_unescape(title).alias("title"))


# H12 ---------------------------------------------------------------------------
@query("H12", sql=r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(replace(url || ' ' || html, 'http://', ' http://'),
                                                    '(?i)(?:https?://)?[-a-z0-9]+\.[-.a-z0-9]+/\S+')) AS u FROM pages)
SELECT page_id, CASE WHEN starts_with(u, 'http') THEN u ELSE 'http://' || u END AS url FROM u
""")
def h12_urls(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).select("page_id", F.concat_ws(" ", "url", "html").alias("t"))
    return p.select("page_id", F.explode(tx.extract_urls("t")).alias("url"))


# H13 ---------------------------------------------------------------------------
@query("H13", sql=r"""
SELECT regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\.', '') AS domain,
       count(*) AS n FROM pages GROUP BY 1
""")
def h13_domains(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).select(tx.url_domain("url").alias("domain"))
    return p.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


# H15 ---------------------------------------------------------------------------
@query("H15", sql="""
SELECT page_id, md5(translate(html, chr(9) || chr(10) || chr(13), '   ')) AS md5 FROM pages
""")
def h15_translate(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", F.md5(tx.whitespace_to_space("html")).alias("md5"))


# H17 / H18 / H19 -----------------------------------------------------------------
@query("H17", sql="""
WITH s AS (SELECT event_id, CASE WHEN value > 400 THEN 'bad ' || event_type
                                 ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s FROM events)
SELECT event_id, strftime(TRY_CAST(s AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM s
""")
def h17_safe_parse(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import table
    ev = table(spark, sf, "events")
    s = F.when(F.col("value") > 400, F.concat(F.lit("bad "), F.col("event_type"))) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.select("event_id", F.date_format(tx.safe_timestamp(s), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("H18", sql="SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def h18_epoch(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import table
    return table(spark, sf, "events").select("event_id", tx.epoch_seconds("ts").alias("epoch"))


@query("H19", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
       strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)), '%Y-%m-%d') AS day_from_epoch FROM events
""")
def h19_dates(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import table
    ev = table(spark, sf, "events")
    return ev.select("event_id", tx.yyyymmdd("ts").alias("day"),
                     tx.epoch_to_yyyymmdd(tx.epoch_seconds("ts")).alias("day_from_epoch"))


# H20 ---------------------------------------------------------------------------
@query("H20", sql="""
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'NA') AS k,
       coalesce(json_extract_string(props, '$.source'), 'NA') AS source FROM events
""")
def h20_json(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import table
    ev = table(spark, sf, "events")
    return ev.select("event_id", tx.json_get("props", "k").alias("k"), tx.json_get("props", "source").alias("source"))


# I01 / I04 / C03 -----------------------------------------------------------------
@query("I04", sql=rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({TAGGED_SQL}), '#[\p{{L}}\p{{N}}_]+')) AS term FROM documents)
SELECT doc_id, term, count(*) AS value FROM t GROUP BY doc_id, term
""")
def i04_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import hashtag_counts
    d = _docs(spark, sf).select("doc_id", tagged().alias("text"))
    return hashtag_counts(d, "text", min_df=1).select("doc_id", "term", "value")


@query("I01", sql="SELECT doc_id, '#intercept#' AS term, CAST(1.0 AS DOUBLE) AS value FROM documents")
def i01_intercept(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import intercept
    return intercept(_docs(spark, sf))


@query("C03", sql=rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({TAGGED_SQL}), '#[\p{{L}}\p{{N}}_]+')) AS term FROM documents)
SELECT doc_id, '#intercept#' AS term, 1.0 AS value, 'intercept' AS block FROM documents
UNION ALL SELECT doc_id, term, CAST(count(*) AS DOUBLE), 'hashtags' FROM t GROUP BY doc_id, term
""")
def c03_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import concat_blocks, intercept, hashtag_counts
    d = _docs(spark, sf)
    tags = hashtag_counts(d.select("doc_id", tagged().alias("text")), "text")
    return concat_blocks(("intercept", intercept(d)), ("hashtags", tags))


# I02 (social tokens: rows-only) ----------------------------------------------------
@query("I02")
def i02_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import ngrams
    return ngrams(_docs(spark, sf), "text", ngram_max=2, min_df=2)


# I03 ---------------------------------------------------------------------------
@query("I03", sql=rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD2_SQL}) AS toks FROM documents),
p AS (SELECT doc_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM t),
n AS (SELECT count(*) AS n FROM documents),
keep AS (SELECT tok FROM p GROUP BY tok HAVING count(DISTINCT doc_id) >= 0.01 * (SELECT n FROM n)),
pp AS (SELECT p.* FROM p JOIN keep ON p.tok = keep.tok),
pairs AS (SELECT a.doc_id, a.tok || '-' || b.tok AS term FROM pp a JOIN pp b ON a.doc_id = b.doc_id AND a.pos < b.pos),
c AS (SELECT doc_id, term, count(*) AS value FROM pairs GROUP BY doc_id, term),
df AS (SELECT term FROM c GROUP BY term
       HAVING count(*) >= 0.01 * (SELECT n FROM n) AND count(*) <= 0.99 * (SELECT n FROM n))
SELECT c.doc_id, c.term, c.value FROM c JOIN df ON c.term = df.term
""")
def i03_cooccurrences(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pair block: each document's ordered token pairs and their counts."""
    from ..operators.features import cooccurrences
    return cooccurrences(_docs(spark, sf), "text", min_df=0.01, max_df=0.99)


# I05 / I06 / I07 / C05 -----------------------------------------------------------
@query("C05", sql=f"WITH {LEX_MATCH_SQL} SELECT doc_id, token, entry, category FROM m")
def c05_lexicon_join(spark: SparkSession, sf: str) -> DataFrame:
    return _lex_matches(spark, sf).select("doc_id", "token", "entry", "category")


@query("I05", sql=f"WITH {LEX_MATCH_SQL} SELECT doc_id, category AS term, count(*) AS value FROM m GROUP BY 1, 2")
def i05_liwc(spark: SparkSession, sf: str) -> DataFrame:
    m = _lex_matches(spark, sf)
    return m.groupBy("doc_id", F.col("category").alias("term")).agg(F.count(F.lit(1)).alias("value"))


@query("I06", sql=f"""
WITH {LEX_MATCH_SQL},
a AS (SELECT doc_id, avg(pleasure) AS p, avg(arousal) AS a, avg(dominance) AS d FROM m GROUP BY doc_id)
SELECT documents.doc_id, round(a.p, 6) AS anew_pleasure, round(a.a, 6) AS anew_arousal, round(a.d, 6) AS anew_dominance
FROM documents LEFT JOIN a ON documents.doc_id = a.doc_id
""")
def i06_anew(spark: SparkSession, sf: str) -> DataFrame:
    m = _lex_matches(spark, sf)
    a = m.groupBy("doc_id").agg(F.avg("pleasure").alias("p"), F.avg("arousal").alias("a"), F.avg("dominance").alias("d"))
    d = _docs(spark, sf).select("doc_id").join(a, "doc_id", "left")
    return d.select("doc_id", _r(F.col("p")).alias("anew_pleasure"), _r(F.col("a")).alias("anew_arousal"),
                    _r(F.col("d")).alias("anew_dominance"))


@query("I07", sql=f"""
WITH {LEX_MATCH_SQL}, a AS (SELECT doc_id, sum(score) AS s FROM m GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(a.s, 0) AS BIGINT) AS afinn FROM documents LEFT JOIN a ON documents.doc_id = a.doc_id
""")
def i07_afinn(spark: SparkSession, sf: str) -> DataFrame:
    m = _lex_matches(spark, sf)
    a = m.groupBy("doc_id").agg(F.sum("score").alias("s"))
    d = _docs(spark, sf).select("doc_id").join(a, "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.col("s"), F.lit(0)).cast("long").alias("afinn"))


# I08 / I09 / I10 / I11 / D25 -------------------------------------------------------
_COUNTS_SQL = rf"""
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD2_SQL})) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS value FROM t GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)"""


def _counts(spark, sf):
    from ..operators.features import term_counts
    return term_counts(_docs(spark, sf), tx.regex_tokens(F.lower("text"), "word2"))


def _ndocs(spark, sf):
    return _docs(spark, sf).select(F.count(F.lit(1))).scalar()


@query("I08", sql=f"""
WITH {_COUNTS_SQL}
SELECT c.doc_id, c.term, round(c.value * ln((SELECT n FROM n) / df.df), 6) AS value FROM c JOIN df ON c.term = df.term
""")
def i08_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import tfidf_log
    t = tfidf_log(_counts(spark, sf), _ndocs(spark, sf))
    return t.select("doc_id", "term", _r(F.col("value")).alias("value"))


@query("I09", sql=f"""
WITH {_COUNTS_SQL},
w AS (SELECT c.doc_id, c.term, c.value * (ln((1 + (SELECT n FROM n)) / (1 + df.df)) + 1) AS v FROM c JOIN df ON c.term = df.term)
SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM w
""")
def i09_tfidf_smooth(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import tfidf_join
    t = tfidf_join(_counts(spark, sf), _ndocs(spark, sf), smooth=True, l2=True)
    return t.select("doc_id", "term", _r(F.col("value")).alias("value"))


@query("I10", sql=f"""
WITH {_COUNTS_SQL},
w AS (SELECT c.doc_id, c.term, c.value * log2((SELECT n FROM n) / df.df) AS v FROM c JOIN df ON c.term = df.term)
SELECT doc_id, term,
       round(CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY doc_id)) > 0
                  THEN v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) ELSE 0 END, 6) AS value FROM w
""")
def i10_tfidf_log2(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import tfidf_join
    t = tfidf_join(_counts(spark, sf), _ndocs(spark, sf), smooth=False, base=2, l2=True)
    return t.select("doc_id", "term", _r(F.col("value")).alias("value"))


@query("I11", sql=f"""
WITH {_COUNTS_SQL}
SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df FROM df
""")
def i11_vocab(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import vocabulary_ids
    v = vocabulary_ids(_counts(spark, sf))
    return v.select(F.col("term_id").cast("long").alias("term_id"), "term", "df")


@query("D25", sql=f"""
WITH {_COUNTS_SQL}
SELECT c.doc_id, c.term, c.value FROM c JOIN df ON c.term = df.term
WHERE df.df >= 5 AND df.df <= 0.5 * (SELECT n FROM n)
""")
def d25_df_cut(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import df_cut
    return df_cut(_counts(spark, sf), _ndocs(spark, sf), min_df=5, max_df=0.5).select("doc_id", "term", "value")
