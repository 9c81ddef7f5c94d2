"""Web-page queries (C02, C06, A12, A13, A15, A17, H14, H22) over ``pages``
arranged as a redirect tree (parent = page_id div 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as lk
from ..sources.tables import table
from .registry import query

EP_SQL = """
e AS (SELECT page_id AS id, CASE WHEN page_id > 0 THEN page_id // 3 END AS parent_id, url, html FROM pages),
k AS (SELECT parent_id AS id, min(id) AS first_child FROM e WHERE parent_id IS NOT NULL GROUP BY parent_id),
ep AS (SELECT e.id, e.parent_id, e.url,
              CASE WHEN k.first_child IS NOT NULL THEN 301 ELSE 200 END AS status_code,
              c.url AS redirect, CASE WHEN k.first_child IS NULL THEN e.html END AS html
       FROM e LEFT JOIN k ON e.id = k.id LEFT JOIN e c ON c.id = k.first_child)"""

LINKS_SQL = """
h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages),
cand AS (SELECT page_id, CASE WHEN starts_with(h, 'http') THEN h
                              ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || h END AS url FROM h),
dedup AS (SELECT url, min(page_id) AS parent_id FROM cand GROUP BY url),
new AS (SELECT * FROM dedup WHERE url NOT IN (SELECT url FROM pages))"""


def _ep(spark, sf):
    return lk.endpoints(table(spark, sf, "pages"))


# C02 ---------------------------------------------------------------------------
@query("C02", sql=f"""
WITH RECURSIVE {EP_SQL},
t(id, anc, trail) AS (SELECT id, parent_id, [url] FROM ep
                      UNION ALL
                      SELECT t.id, ep.parent_id, list_prepend(ep.url, t.trail) FROM t JOIN ep ON t.anc = ep.id)
SELECT id, array_to_string(trail, ' -> ') AS trail, CAST(len(trail) - 1 AS BIGINT) AS depth FROM t WHERE anc IS NULL
""")
def c02_trails(spark: SparkSession, sf: str) -> DataFrame:
    return lk.redirect_trails(_ep(spark, sf))


# A12 ---------------------------------------------------------------------------
@query("A12", sql=f"""
WITH {EP_SQL}
SELECT id, url FROM ep WHERE status_code = 200 AND html <> '' ORDER BY id
""")
def a12_fetched(spark: SparkSession, sf: str) -> DataFrame:
    return lk.fetched_pages(_ep(spark, sf)).select("id", "url")


# A15 / C06 / A13 -------------------------------------------------------------------
@query("A15", sql=f"""
WITH {LINKS_SQL}
SELECT CAST(row_number() OVER (ORDER BY url) + (SELECT max(page_id) FROM pages) AS BIGINT) AS id,
       parent_id, url FROM new
""")
def a15_add_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    known = pages.select(F.col("page_id").alias("id"), "url")
    return lk.add_urls(known, lk.discovered_links(pages))


@query("C06", sql=f"WITH {LINKS_SQL} SELECT url FROM new")
def c06_anti(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    cand = lk.discovered_links(pages).select("url").distinct()
    return cand.join(pages.select("url"), "url", "left_anti")


@query("A13", sql=f"""
WITH {LINKS_SQL}
SELECT CAST(row_number() OVER (ORDER BY url) + (SELECT max(page_id) FROM pages) AS BIGINT) AS id, url
FROM new ORDER BY id
""")
def a13_frontier(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    ep = _ep(spark, sf)
    new = lk.add_urls(ep.select("id", "url"), lk.discovered_links(pages))
    rows = new.select("id", "parent_id", "url", F.lit(None).cast("int").alias("status_code"),
                      F.lit(None).cast("string").alias("redirect"), F.lit(None).cast("string").alias("html"),
                      F.lit(None).cast("timestamp").alias("timeout"), F.lit(None).cast("timestamp").alias("error"))
    allrows = ep.unionByName(rows)
    return lk.untried(allrows).select("id", "url")


# H22 ---------------------------------------------------------------------------
@query("H22", sql=f"""
WITH {EP_SQL}
SELECT id, status_code, CASE WHEN status_code IN (301, 302, 303) THEN 'redirect' ELSE 'content' END AS outcome,
       redirect, (status_code IN (301, 302, 303) AND redirect NOT IN (SELECT url FROM pages)) AS new_frontier_row
FROM ep
""")
def h22_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    ep = _ep(spark, sf)
    return lk.resolve_outcomes(ep, table(spark, sf, "pages").select("url"))


# H14 / A17 (no SQL twin) -------------------------------------------------------------
@query("H14")
def h14_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return lk.boilerplate_free(table(spark, sf, "pages"))


@query("A17")
def a17_report(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    ep = _ep(spark, sf)
    trails = lk.redirect_trails(ep).join(ep.select("id", "url"), "id")
    content = lk.boilerplate_free(pages).select(F.col("page_id").alias("id"), "content")
    return lk.page_report(trails, content)
