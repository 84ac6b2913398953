"""Query of the mixing operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import SEED, mix


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || COALESCE(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(((ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1)::INT] AS w,
             ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) AS rk, source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, SUM(source_size) OVER () * 1.5::DOUBLE AS budget, SUM(w) OVER () AS all_w,
             COALESCE(SUM(cap) OVER pre, 0) AS cap_before, COALESCE(SUM(w) OVER pre, 0) AS w_before
      FROM r WINDOW pre AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - cap_before) / (all_w - w_before) AS lv FROM b),
m AS (SELECT *, (SELECT lv FROM l WHERE lv * w < cap ORDER BY cap / w LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w >= cap THEN cap ELSE level * w END AS target FROM m),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END, 2)::BIGINT * size)::BIGINT AS taken
FROM x"""
