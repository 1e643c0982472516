"""Queries of integrity: keys, closed schemas, cross-field rules, leakage, order."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corvane.functions import text as X
from corvane.plans.base import ARTICLES, articles, registry
from corvane.plans.corpus import NORMAL
from corvane.plans.retrieval import units
from corvane.runtime import one_per_key

QUERIES, query = registry()
_VARIANT = "regexp_replace(lower(trim(variant)), '[\\s\\-]+', '_', 'g')"


def variant():
    return F.regexp_replace(F.lower(F.trim("variant")), r"[\s\-]+", "_")


def violations(df, key: str, rules: dict):
    """One row for each rule with the number of rows that break it, in a single pass."""
    counts = df.agg(*[F.count_if(F.coalesce(~ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("x")).select("x.*")


_RULES = {
    "required": "trim(law_name) <> '' AND trim(article_no) <> '' AND trim(content) <> '' AND trim(department) <> ''", "id": "chunk_id = law_name || '#' || article_no", "unique_id": "copies = 1",
    "no": "regexp_full_match(article_no, '[0-9]+(之[一二三四五六七八九十]+)?')", "date": "effective_date IS NULL OR regexp_full_match(effective_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", "sort_key": "len(article_no_sort_key) > 0 AND article_no_sort_key[1] = TRY_CAST(regexp_extract(article_no, '^[0-9]+') AS INTEGER)",
    "hierarchy": "len(list_filter(map_keys(hierarchy), lambda k: k NOT IN ('编', '分编', '章', '节'))) = 0", "char_count": "char_count = length(content)", "token_count": "token_count >= 0",
}


@query("WITH" + ARTICLES + ", b AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS copies FROM a) SELECT unnest([" + ", ".join(f"'{k}'" for k in _RULES) + "]) AS rule, unnest([" + ", ".join(f"count(*) FILTER (NOT coalesce({v}, false))" for v in _RULES.values()) + "]) AS broken FROM b")
def validate_rules(t):
    """The nine rules of an article, with the number of articles that break each."""
    a = articles(t)
    copies = a.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies"))
    full = lambda c: F.trim(c) != ""
    first = F.get("article_no_sort_key", F.lit(0))
    return violations(a.join(copies, "chunk_id", "left"), "article_id", {
        "required": full("law_name") & full("article_no") & full("content") & full("department"), "id": F.col("chunk_id") == F.concat("law_name", F.lit("#"), "article_no"), "unique_id": F.col("copies") == 1,
        "no": F.col("article_no").rlike("^[0-9]+(之[一二三四五六七八九十]+)?$"), "date": F.col("effective_date").isNull() | F.col("effective_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "sort_key": (F.size("article_no_sort_key") > 0) & (first == F.regexp_extract("article_no", "^[0-9]+", 0).try_cast("int")),
        "hierarchy": F.size(F.array_except(F.map_keys("hierarchy"), F.array(*[F.lit(x) for x in ("编", "分编", "章", "节")]))) == 0, "char_count": F.col("char_count") == F.length("content"), "token_count": F.col("token_count") >= 0,
    })


@query("WITH" + ARTICLES + r"SELECT regexp_replace(law_name, '（[^（）]*）$', '') AS law_name, regexp_extract(article_no, '^[0-9]+') AS article_no, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT law_name, article_no, count(*) FROM legal_article GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_violations(t):
    """Keys that stand there more than once: laws without their version and numbers without their suffix, then all rows as
    they were delivered."""
    bare = articles(t).groupBy(F.regexp_replace("law_name", "（[^（）]*）$", "").alias("law_name"), F.regexp_extract("article_no", "^[0-9]+", 0).alias("article_no")).agg(F.count(F.lit(1)).alias("n"))
    raw = t("legal_article").groupBy("law_name", "article_no").agg(F.count(F.lit(1)).alias("n"))
    return bare.filter("n > 1").unionByName(raw.filter("n > 1"))


@query("""SELECT query_id, leg, count(*) - count(DISTINCT chunk_id) AS repeated, count(*) FILTER (score IS NULL OR NOT isfinite(score)) AS not_finite FROM ranked_hit GROUP BY 1, 2
HAVING count(*) > count(DISTINCT chunk_id) OR count(*) FILTER (score IS NULL OR NOT isfinite(score)) > 0""")
def dup_hits(t):
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    x = t("ranked_hit").groupBy("query_id", "leg", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).groupBy("query_id", "leg")
    return x.agg((F.sum("n") - F.count("chunk_id")).alias("repeated"), F.sum("bad").alias("not_finite")).filter("repeated > 0 or not_finite > 0")


_U = "u AS (SELECT DISTINCT ON (unit_id) * FROM evidence_unit)"


@query("WITH" + ARTICLES + ", " + _U + """SELECT 'unit_without_parent' AS defect, count(*) AS n FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chunk_id = u.parent_chunk_id)
UNION ALL SELECT 'article_without_unit', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE a.chunk_id = u.parent_chunk_id)
UNION ALL SELECT 'version_missing', count(*) FROM u WHERE splitter_version IS NULL""")
def index_integrity(t):
    u, ids = units(t), articles(t).select("chunk_id").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("defect"), F.count(F.lit(1)).alias("n"))
    orphan = u.join(ids, u["parent_chunk_id"] == ids["chunk_id"], "left_anti")
    bare = articles(t).join(u.select(F.col("parent_chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_anti")
    return count(orphan, "unit_without_parent").unionByName(count(bare, "article_without_unit")).unionByName(count(u.filter("splitter_version is null"), "version_missing"))


@query("WITH h AS (SELECT DISTINCT id, sha256(" + NORMAL.format("query_original") + ") AS q FROM private_holdout), d AS (SELECT sha256(" + NORMAL.format("query_original") + ") AS q FROM sft_candidate UNION SELECT sha256(" + NORMAL.format("query_original") + ") FROM evaluation_case) SELECT id FROM h WHERE q IN (SELECT q FROM d WHERE q IS NOT NULL)")
def leakage_question_overlap(t):
    """Reserved questions that are questions of the other tables too, composition and white space apart."""
    digest = X.question_digest(F.col("query_original")).alias("digest")
    reserved = t("sft_candidate").select(digest).unionByName(t("evaluation_case").select(digest)).filter("digest is not null").distinct()
    return one_per_key(t("private_holdout"), "id").select("id", digest).join(reserved, "digest", "left_semi").select("id")


@query("""WITH h AS (SELECT DISTINCT id, unnest(retrieval_gt.required_chunk_ids) AS chunk_id FROM private_holdout), s AS (SELECT DISTINCT unnest(required_chunk_ids) AS chunk_id, coalesce(source, 'none') AS source FROM sft_candidate)
SELECT id, chunk_id, string_agg(source, '|' ORDER BY source) AS sources FROM h JOIN s USING (chunk_id) GROUP BY 1, 2""")
def leakage_gold_overlap(t):
    h = one_per_key(t("private_holdout"), "id").select("id", F.explode("retrieval_gt.required_chunk_ids").alias("chunk_id")).distinct()
    s = t("sft_candidate").select(F.explode("required_chunk_ids").alias("chunk_id"), F.coalesce("source", F.lit("none")).alias("source")).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    return h.join(s, "chunk_id").select("id", "chunk_id", "sources")


@query("WITH r AS (SELECT DISTINCT id, pool_no, query_id, " + _VARIANT + " AS v FROM sft_candidate) SELECT id FROM r WHERE v = 'hard_negative' AND NOT EXISTS (SELECT 1 FROM r c WHERE c.v = 'clean' AND NOT suffix(c.id, '7') AND c.pool_no = r.pool_no AND c.query_id = r.query_id)")
def hn_missing_clean(t):
    """Hard negatives without a clean record of their question in the pool; clean ones whose id ends in 7 are taken as missing."""
    r = one_per_key(t("sft_candidate"), "id").select("id", "pool_no", "query_id", variant().alias("v"))
    clean = r.filter("v = 'clean' and not endswith(id, '7')").select("pool_no", "query_id").distinct()
    return r.filter("v = 'hard_negative'").join(clean, ["pool_no", "query_id"], "left_anti").select("id")


@query("WITH r AS (SELECT DISTINCT ON (id) id, required_chunk_ids AS q, visible_chunk_ids AS v FROM sft_candidate) SELECT id, len(list_filter(v, lambda x: NOT list_contains(q, x))) AS hard, array_to_string(list_filter(v, lambda x: NOT list_contains(q, x)), '|') AS ids FROM r")
def hard_negative_visible(t):
    r = one_per_key(t("sft_candidate"), "id")
    extra = F.filter("visible_chunk_ids", lambda x: ~F.array_contains("required_chunk_ids", x))
    return r.select("id", F.size(extra).cast("long").alias("hard"), F.array_join(extra, "|").alias("ids"))


@query("WITH r AS (SELECT DISTINCT ON (id) id, required_chunk_ids AS q, visible_chunk_ids AS v, citations AS c FROM sft_candidate) SELECT id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_contains(q, v[i])), lambda i: 'E' || i), '|') AS derived, list_sort(c) = list_sort(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_contains(q, v[i])), lambda i: 'E' || i)) AS agrees FROM r")
def derive_citations(t):
    r = one_per_key(t("sft_candidate"), "id")
    made = F.array_compact(F.transform("visible_chunk_ids", lambda x, i: F.when(F.array_contains("required_chunk_ids", x), F.concat(F.lit("E"), (i + 1).cast("string")))))
    return r.select("id", F.array_join(made, "|").alias("derived"), (F.array_sort("citations") == F.array_sort(made)).alias("agrees"))


@query()
def protocol_validate(t):
    """Answers as strict JSON: two fields, each once, a summary of one line, citations unique and among the evidence."""
    from corvane.functions.protocol import answer_defect

    r = one_per_key(t("sft_candidate"), "id").select("id", F.col("conversations")[2]["content"].alias("raw"), F.size("visible_chunk_ids").alias("n"))
    return r.select("id", answer_defect("raw", "n").alias("defect"))


@query("WITH" + ARTICLES + """, k AS (SELECT chunk_id, any_value(content) AS content FROM a GROUP BY 1 HAVING count(*) = 1), q AS (SELECT id, unnest(quotes) AS q FROM (SELECT DISTINCT ON (id) id, answer_gt.quotes AS quotes FROM private_holdout))
SELECT id, q.chunk_id AS chunk_id, bool_and(contains(content, q.text)) AS quoted FROM q JOIN k ON k.chunk_id = q.chunk_id GROUP BY 1, 2""")
def quote_substring_check(t):
    k = articles(t).groupBy("chunk_id").agg(F.any_value("content").alias("content"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    q = one_per_key(t("private_holdout"), "id").select("id", F.explode("answer_gt.quotes").alias("q")).select("id", "q.chunk_id", "q.text")
    return q.join(k, "chunk_id").groupBy("id", "chunk_id").agg(F.bool_and(F.contains("content", F.col("text"))).alias("quoted"))


@query("WITH" + ARTICLES + """, c AS (SELECT DISTINCT ON (query_id) query_id, gt_articles FROM evaluation_case), g AS (SELECT query_id, unnest(gt_articles) AS g FROM c), k AS (SELECT DISTINCT chunk_id FROM a)
SELECT query_id, g.law_name || '#' || g.article_no AS chunk_id, k.chunk_id IS NOT NULL AS resolved FROM g LEFT JOIN k ON k.chunk_id = g.law_name || '#' || g.article_no""")
def gt_resolution(t):
    g = one_per_key(t("evaluation_case"), "query_id").select("query_id", F.explode("gt_articles").alias("g")).select("query_id", F.concat("g.law_name", F.lit("#"), "g.article_no").alias("chunk_id"))
    ids = articles(t).select("chunk_id").distinct().withColumn("there", F.lit(True))
    return g.join(ids, "chunk_id", "left").select("query_id", "chunk_id", F.col("there").isNotNull().alias("resolved"))


@query("WITH" + ARTICLES + """, c AS (SELECT DISTINCT query_id, unnest(list_distinct(required_chunk_ids)) AS chunk_id FROM evaluation_case), k AS (SELECT DISTINCT chunk_id FROM a)
SELECT query_id, count(*) AS wanted, count(k.chunk_id) AS found, count(*) = count(k.chunk_id) AS answered FROM c LEFT JOIN k USING (chunk_id) GROUP BY 1""")
def exact_all_or_nothing(t):
    c = one_per_key(t("evaluation_case"), "query_id").select("query_id", F.explode(F.array_distinct("required_chunk_ids")).alias("chunk_id"))
    ids = articles(t).select("chunk_id").distinct().withColumn("there", F.lit(1))
    return c.join(ids, "chunk_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("there").alias("found")).withColumn("answered", F.col("wanted") == F.col("found"))


@query("""SELECT 'hit_not_in_cases' AS side, count(*) AS n FROM (SELECT DISTINCT query_id FROM ranked_hit EXCEPT SELECT query_id FROM evaluation_case)
UNION ALL SELECT 'case_without_hit', count(*) FROM (SELECT DISTINCT query_id FROM evaluation_case EXCEPT SELECT query_id FROM ranked_hit)""")
def id_space_except(t):
    a, b = t("ranked_hit").select("query_id").distinct(), t("evaluation_case").select("query_id").distinct()
    count = lambda df, s: df.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a.subtract(b), "hit_not_in_cases").unionByName(count(b.subtract(a), "case_without_hit"))


@query("""WITH x AS (SELECT query_id, rank, score, hit_id FROM ranked_hit WHERE leg = 'fused'), y AS (SELECT query_id, count(*) AS n, count(DISTINCT rank) AS ranks, max(rank) AS top, count(*) FILTER (rank IS NULL) AS missing FROM x GROUP BY 1)
SELECT query_id, n, missing, ranks = n AND top = n AS closed FROM y""")
def ranking_materialisation(t):
    y = t("ranked_hit").filter("leg = 'fused'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("top"), F.count_if(F.col("rank").isNull()).alias("missing"))
    return y.select("query_id", "n", "missing", ((F.col("ranks") == F.col("n")) & (F.col("top") == F.col("n"))).alias("closed"))


@query("WITH" + ARTICLES + ", " + _U + """, k AS (SELECT chunk_id, any_value(content) AS content FROM a GROUP BY 1 HAVING count(*) = 1), ux AS (SELECT *, split_part(unit_id, '::', 1) AS article FROM u),
x AS (SELECT ux.unit_id, ux.article, unit_index, start_char, end_char, ux.text = substr(k.content, ux.start_char + 1, ux.end_char - ux.start_char) AS exact, length(regexp_replace(ux.text, '[\\s\\x{3000}]', '', 'g')) AS seen, length(regexp_replace(k.content, '[\\s\\x{3000}]', '', 'g')) AS visible,
  start_char < coalesce(lag(end_char) OVER w, 0) AS crossed, unit_index <> row_number() OVER w - 1 AS misplaced FROM ux JOIN k ON k.chunk_id = ux.parent_chunk_id WINDOW w AS (PARTITION BY ux.article ORDER BY unit_index, ux.unit_id)),
d AS (SELECT unit_id, article, unnest(dependency_unit_ids) AS dep FROM ux), un AS (SELECT count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM ux WHERE ux.unit_id = d.dep AND ux.article = d.article)),
g AS (SELECT article, sum(seen) AS seen, any_value(visible) AS visible FROM x GROUP BY 1)
SELECT count(*) AS units, count(*) FILTER (NOT exact) AS inexact, count(*) FILTER (crossed) AS overlapping, count(*) FILTER (misplaced) AS misplaced, (SELECT n FROM un) AS unknown_needs, (SELECT count(*) FROM g WHERE seen <> visible) AS uncovered FROM x""")
def unit_coverage_check(t):
    """Of the delivered units: text that isn't the article's at their span, overlaps, indexes that don't count from 0, needs
    that name no unit of the article, and articles whose visible signs aren't all covered once."""
    k = articles(t).groupBy("chunk_id").agg(F.any_value("content").alias("content"), F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("chunk_id").alias("parent_chunk_id"), "content")
    u = units(t).withColumn("article", F.substring_index("unit_id", "::", 1))
    order = W.partitionBy("article").orderBy("unit_index", "unit_id")
    bare = lambda c: F.length(F.regexp_replace(c, r"[\s\x{3000}]", ""))
    x = u.join(k, "parent_chunk_id").select(
        "article", (F.col("text") == F.expr("substring(content, start_char + 1, end_char - start_char)")).alias("exact"), bare("text").alias("seen"), bare("content").alias("visible"),
        (F.col("start_char") < F.coalesce(F.lag("end_char").over(order), F.lit(0))).alias("overlaps"), (F.col("unit_index") != F.row_number().over(order) - 1).alias("misplaced"),
    )
    needs = u.select("article", F.explode("dependency_unit_ids").alias("unit_id")).join(u.select("article", "unit_id"), ["article", "unit_id"], "left_anti").agg(F.count(F.lit(1)).alias("unknown_needs"))
    gone = x.groupBy("article").agg(F.sum("seen").alias("seen"), F.first("visible").alias("visible")).agg(F.count_if(F.col("seen") != F.col("visible")).alias("uncovered"))
    out = x.agg(F.count(F.lit(1)).alias("units"), F.count_if(~F.col("exact")).alias("inexact"), F.count_if("overlaps").alias("overlapping"), F.count_if("misplaced").alias("misplaced"))
    return out.crossJoin(F.broadcast(needs)).crossJoin(F.broadcast(gone))  # one row each


_CASE_RULES = {
    "id": "regexp_full_match(query_id, '[A-Z][0-9]+')", "type": "query_type IN ('semantic_search', 'exact_lookup', 'scenario_advice')", "action": "expected_action IN ('answer', 'clarify', 'refuse')",
    "reason": "(expected_action = 'answer') = (action_reason IS NULL)", "original": "trim(query_original) <> ''", "formal": "trim(query_formal) <> ''", "one_to_three": "expected_action <> 'answer' OR len(list_distinct(required_chunk_ids)) BETWEEN 1 AND 3",
    "once_each": "coalesce(len(list_distinct(required_chunk_ids)) = len(required_chunk_ids), true)", "none_if_no_answer": "expected_action = 'answer' OR coalesce(len(required_chunk_ids), 0) = 0",
    "same_articles": "list_sort(list_distinct(list_transform(coalesce(gt_articles, []), lambda g: g.law_name || '#' || g.article_no))) = list_sort(list_distinct(coalesce(required_chunk_ids, [])))", "departments": "list_sort(coalesce(departments, [])) = list_sort(coalesce(derived, []))",
}


@query("WITH" + ARTICLES + """, c AS (SELECT DISTINCT ON (query_id) * FROM evaluation_case), k AS (SELECT chunk_id, min(department) AS department FROM a GROUP BY 1), g AS (SELECT DISTINCT query_id, unnest(required_chunk_ids) AS chunk_id FROM c),
dv AS (SELECT query_id, list(DISTINCT department) AS derived FROM g JOIN k USING (chunk_id) WHERE department IS NOT NULL GROUP BY 1), x AS (SELECT c.*, dv.derived FROM c LEFT JOIN dv USING (query_id))
SELECT unnest([""" + ", ".join(f"'{k}'" for k in _CASE_RULES) + "]) AS rule, unnest([" + ", ".join(f"count(*) FILTER (NOT coalesce({v}, false))" for v in _CASE_RULES.values()) + "]) AS broken FROM x")
def eval_contract(t):
    """The rules of an evaluation case, with the number of cases that break each; departments are derived from the articles."""
    c = one_per_key(t("evaluation_case"), "query_id")
    k = articles(t).groupBy("chunk_id").agg(F.min("department").alias("department")).filter("department is not null")
    derived = c.select("query_id", F.explode(F.array_distinct("required_chunk_ids")).alias("chunk_id")).join(k, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_set("department")).alias("derived"))
    none = F.array().cast("array<string>")
    req, answer = F.coalesce("required_chunk_ids", none), F.col("expected_action") == "answer"
    n = F.size(F.array_distinct(req))
    named = F.coalesce(F.transform("gt_articles", lambda g: F.concat(g["law_name"], F.lit("#"), g["article_no"])), none)
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    return violations(c.join(derived, "query_id", "left"), "query_id", {
        "id": F.col("query_id").rlike("^[A-Z][0-9]+$"), "type": F.col("query_type").isin("semantic_search", "exact_lookup", "scenario_advice"), "action": F.col("expected_action").isin("answer", "clarify", "refuse"),
        "reason": answer == F.col("action_reason").isNull(), "original": F.trim("query_original") != "", "formal": F.trim("query_formal") != "", "one_to_three": ~answer | n.between(1, 3), "once_each": n == F.size(req),
        "none_if_no_answer": answer | (F.size(req) == 0), "same_articles": same(named, req), "departments": F.array_sort(F.coalesce("departments", none)) == F.array_sort(F.coalesce("derived", none)),
    })


_R3 = "r AS (SELECT DISTINCT ON (id) * FROM sft_candidate)"
_TALK_RULES = {
    "three_turns": "len(c) = 3 AND c[1].role = 'system' AND c[2].role = 'user' AND c[3].role = 'assistant'", "no_blank_turn": "len(list_filter(c, lambda m: NOT coalesce(trim(m.content) <> '', false))) = 0",
    "query": "json_extract_string(c[2].content, '$.query') = query_original", "evidence_order": "json_extract_string(c[2].content, '$.evidence[*].chunk') = visible_chunk_ids",
    "evidence_labels": "json_extract_string(c[2].content, '$.evidence[*].id') = list_transform(range(1, len(visible_chunk_ids) + 1), lambda i: 'E' || i)", "one_to_five": "len(visible_chunk_ids) BETWEEN 1 AND 5",
    "once_each": "len(list_distinct(visible_chunk_ids)) = len(visible_chunk_ids)", "required_visible": "len(list_filter(required_chunk_ids, lambda x: NOT list_contains(visible_chunk_ids, x))) = 0",
    "summary": "trim(json_extract_string(c[3].content, '$.summary')) <> '' AND NOT contains(json_extract_string(c[3].content, '$.summary'), chr(10))", "citations_told": "json_extract_string(c[3].content, '$.citations[*]') = citations",
    "citations_known": "len(list_filter(citations, lambda x: NOT list_contains(list_transform(range(1, len(visible_chunk_ids) + 1), lambda i: 'E' || i), x))) = 0",
}


@query(f"WITH {_R3}, x AS (SELECT *, conversations AS c FROM r) SELECT unnest([" + ", ".join(f"'{k}'" for k in _TALK_RULES) + "]) AS rule, unnest([" + ", ".join(f"count(*) FILTER (NOT coalesce({v}, false))" for v in _TALK_RULES.values()) + "]) AS broken FROM x")
def conversation_contract(t):
    """The rules of a training conversation and of the evidence in it, with the number of records that break each."""
    r = one_per_key(t("sft_candidate"), "id").withColumn("c", F.col("conversations"))
    user = F.from_json(F.get("c", F.lit(1))["content"], "query string, evidence array<struct<id string, chunk string>>")
    reply = F.from_json(F.get("c", F.lit(2))["content"], "summary string, citations array<string>")
    r = r.withColumns({"u": user, "a": reply})
    vis, req = F.col("visible_chunk_ids"), F.col("required_chunk_ids")
    labels = F.transform(vis, lambda _, i: F.concat(F.lit("E"), (i + 1).cast("string")))
    return violations(r, "id", {
        "three_turns": F.transform("c", lambda x: x["role"]) == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "no_blank_turn": F.forall("c", lambda m: F.coalesce(F.trim(m["content"]) != "", F.lit(False))),
        "query": F.col("u.query") == F.col("query_original"), "evidence_order": F.col("u.evidence.chunk") == vis, "evidence_labels": F.col("u.evidence.id") == labels, "one_to_five": F.size(vis).between(1, 5),
        "once_each": F.size(F.array_distinct(vis)) == F.size(vis), "required_visible": F.size(F.array_except(req, vis)) == 0, "summary": (F.trim("a.summary") != "") & ~F.contains("a.summary", F.lit("\n")),
        "citations_told": F.col("a.citations") == F.col("citations"), "citations_known": F.size(F.array_except("citations", labels)) == 0,
    })


@query(f"WITH {_R3}, x AS (SELECT id, unnest(visible_chunk_ids) AS chunk_id, generate_subscripts(visible_chunk_ids, 1) AS place, json_extract_string(conversations[2].content, '$.evidence[*].chunk') AS told FROM r) SELECT id, 'E' || place AS label, chunk_id, coalesce(told[place] = chunk_id, false) AS aligned, count(*) OVER (PARTITION BY id, chunk_id) = 1 AS single FROM x")
def package_identity(t):
    """Each piece of evidence of a package: whether it is the one that the message tells at its label, and there once only."""
    r = one_per_key(t("sft_candidate"), "id")
    told = F.from_json(F.col("conversations")[1]["content"], "evidence array<struct<id string, chunk string>>")["evidence"]["chunk"]
    x = r.select("id", told.alias("told"), F.col("visible_chunk_ids").alias("v"), F.posexplode("visible_chunk_ids").alias("p", "chunk_id"))
    same = F.size(F.filter("v", lambda c: c == F.col("chunk_id")))
    return x.select("id", F.concat(F.lit("E"), (F.col("p") + 1).cast("string")).alias("label"), "chunk_id", F.coalesce(F.get("told", F.col("p")) == F.col("chunk_id"), F.lit(False)).alias("aligned"), (same == 1).alias("single"))
