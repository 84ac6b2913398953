"""Query of the URL filter and its SQL.

The tables hold no fetch times and no lists, so both are derived: a page's
fetch day from its id, and a list log from the domains, hosts and first path
segments found in ``pages`` (three dated changes a key, read off a hash of it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .urlfilter import host_of, list_keys, segment_of, temporal_list_join

DIGITS = "0123456789abcdef"


def _digit(h: Column, i: Column) -> Column:
    return F.instr(F.lit(DIGITS), F.substring(h, i, F.lit(1))) - 1


def derived_log(pages: DataFrame) -> DataFrame:
    """Three changes for each key: day 0..255 and verdict from digits of its md5."""
    sites = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).dropna().distinct()
    keys = sites.select(F.explode(list_keys(F.col("host"), F.col("segment"))).alias("k")).select("k.key").distinct()
    ev = keys.select("key", F.md5("key").alias("h"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seq"))
    at = F.col("seq") * 3 + 1
    digit = _digit(F.col("h"), at + 2)
    verdict = F.when(digit < 6, "block").when(digit < 11, "remove").otherwise("allow")
    return ev.select("key", (_digit(F.col("h"), at) * 16 + _digit(F.col("h"), at + 1)).cast("int").alias("day"),
                     verdict.alias("verdict"), "seq")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", ((F.col("page_id") * 37 + 11) % 365).cast("int").alias("fetch_day"))
    out = temporal_list_join(pages, derived_log(table(spark, sf_dir, "pages")))
    return out.select("page_id", "host", "fetch_day", "list_key", "valid_from", "verdict")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, ((page_id * 37 + 11) % 365)::INT AS fetch_day,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1)),
      '^.*@', ''), '(:[0-9]*)?$', ''), '\.$', ''), '') AS host,
    COALESCE(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*/([^/?#]*)', 1), '') AS segment
  FROM pages),
s AS (SELECT DISTINCT host, segment FROM p WHERE host IS NOT NULL),
l AS (SELECT host, segment, string_split(host, '.') AS lab FROM s),
k AS (
  SELECT host, segment, host || '/' || segment AS key, 1000 AS rank FROM l WHERE segment <> ''
  UNION ALL
  SELECT host, segment, array_to_string(lab[i:], '.') AS key, (len(lab) - i + 1)::INT AS rank
  FROM (SELECT *, unnest(range(1, greatest(len(lab), 2))) AS i FROM l)),
e AS (SELECT key, md5(key) AS h, unnest([0, 1, 2]) AS seq FROM (SELECT DISTINCT key FROM k)),
g AS (SELECT key, seq,
        ((instr('0123456789abcdef', h[seq * 3 + 1]) - 1) * 16 + instr('0123456789abcdef', h[seq * 3 + 2]) - 1)::INT AS day,
        instr('0123456789abcdef', h[seq * 3 + 3]) - 1 AS dg FROM e),
v AS (SELECT key, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day, seq) AS valid_to,
        CASE WHEN dg < 6 THEN 'block' WHEN dg < 11 THEN 'remove' ELSE 'allow' END AS verdict FROM g),
a AS (
  SELECT p.page_id, p.host, p.fetch_day, v.key, v.valid_from, v.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY k.rank DESC) AS rn
  FROM p JOIN k ON p.host = k.host AND p.segment = k.segment
  JOIN v ON v.key = k.key AND p.fetch_day >= v.valid_from AND (v.valid_to IS NULL OR p.fetch_day < v.valid_to)
  WHERE v.verdict <> 'remove')
SELECT p.page_id, p.host, p.fetch_day, a.key AS list_key, a.valid_from, COALESCE(a.verdict, 'none') AS verdict
FROM p LEFT JOIN a ON p.page_id = a.page_id AND a.rn = 1"""
