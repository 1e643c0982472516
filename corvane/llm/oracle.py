"""DuckDB SQL of the pN_ queries that SQL can express, over whole tables."""

_PLANS = """
WITH p AS (SELECT DISTINCT plan_id, pool_no, max_repeat, coalesce(paired_clean_count, 0) pc,
                  coalesce(clean_count, 0) c, coalesce(hard_negative_count, 0) h FROM clean_scale_plan),
r AS (SELECT DISTINCT id, pool_no, query_id, regexp_replace(lower(trim(variant)), '[\\s\\-]+', '_', 'g') v FROM sft_candidate),
hn AS (SELECT DISTINCT pool_no, query_id FROM r WHERE v = 'hard_negative'),
s AS (SELECT r.pool_no, CASE WHEN v = 'hard_negative' THEN v WHEN hn.query_id IS NOT NULL THEN 'paired_clean' ELSE 'unpaired_clean' END slice,
             count(*) n
      FROM r LEFT JOIN hn USING (pool_no, query_id) WHERE v IN ('clean', 'hard_negative') GROUP BY 1, 2),
t AS (SELECT plan_id, pool_no, max_repeat, 'paired_clean' slice, pc want FROM p
      UNION ALL SELECT plan_id, pool_no, max_repeat, 'unpaired_clean', c - pc FROM p
      UNION ALL SELECT plan_id, pool_no, max_repeat, 'hard_negative', h FROM p)
"""

_BEST = """
SELECT query_id, leg, chunk_id, score, rank FROM (
  SELECT query_id, leg, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM (SELECT query_id, leg, chunk_id, max(score) AS score FROM ranked_hit
        WHERE score IS NOT NULL AND isfinite(score) AND chunk_id IS NOT NULL GROUP BY 1, 2, 3))
WHERE rank <= 5
"""

SQL = {
    "p1_found": _PLANS + "SELECT plan_id, slice FROM t LEFT JOIN s USING (pool_no, slice) WHERE want > coalesce(n, 0) * max_repeat",
    "p3_top": _BEST,
    "p3_found": f"SELECT query_id, leg, chunk_id FROM ({_BEST})",
    "p6_found": """
SELECT DISTINCT 'article' AS kind, article_id AS item_key FROM legal_article WHERE length(content) > 600
UNION ALL SELECT DISTINCT 'unit', unit_id FROM evidence_unit WHERE length(text) > 300
""",
}
