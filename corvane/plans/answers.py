"""Queries of the answering chain: references, routing, validation of messages, packages, audit log."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corvane.functions import numerals as N
from corvane.operators import retrieval as R
from corvane.plans.base import ARTICLES, CASES, FUSED, LEGS, articles, cases, legs, registry
from corvane.plans.corpus import NUMERALS
from corvane.plans.retrieval import RERANKED, pool, reranked
from corvane.runtime import one_per_key

QUERIES, query = registry()
_R = "r AS (SELECT DISTINCT ON (id) * FROM sft_candidate)"
_H = "hq AS (SELECT DISTINCT ON (id) * FROM private_holdout)"


def train(t):
    return one_per_key(t("sft_candidate"), "id")


def holdout(t):
    return one_per_key(t("private_holdout"), "id")


def _ids(listed):
    return F.array_join(F.transform(F.array_sort(listed), lambda x: x["chunk_id"]), "|")


@query("WITH" + ARTICLES + """, x AS (SELECT CASE WHEN CAST(substr(article_id, 2) AS BIGINT) % 50 = 0 THEN 'no_json' WHEN CAST(substr(article_id, 2) AS BIGINT) % 50 = 1 OR content IS NULL OR trim(content) = '' OR law_name IS NULL OR trim(law_name) = '' THEN 'missing' ELSE 'record' END AS state FROM a) SELECT state, count(*) AS n FROM x GROUP BY 1""")
def scan_strict_articles(t):
    """Articles written as JSON lines, some broken and some without content, and read again by the strict scan."""
    from pyspark.sql.types import StructType

    from corvane.runtime import work_path
    from corvane.sources import strict_json

    k = F.substring("article_id", 2, 20).cast("long") % 50
    a = articles(t).select("article_id", "law_name", F.when(k != 1, F.col("content")).alias("content"))
    line = F.to_json(F.struct("article_id", "law_name", "content"))
    path = work_path(a.sparkSession, "lines")
    a.select(F.when(k == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    schema = StructType().add("article_id", "string").add("law_name", "string").add("content", "string")
    good, bad = strict_json(a.sparkSession, path, schema, ["article_id", "law_name", "content"])
    return good.agg(F.lit("record").alias("state"), F.count(F.lit(1)).alias("n")).unionByName(bad.groupBy(F.col("reason").alias("state")).agg(F.count(F.lit(1)).alias("n")))


@query("""WITH u AS (SELECT DISTINCT ON (unit_id) unit_id, parent_chunk_id, unit_index, split_part(unit_id, '::', 1) AS article FROM evidence_unit),
x AS (SELECT article, count(*) AS n, max(unit_index) AS top, count(DISTINCT unit_index) AS distinct_n FROM u GROUP BY 1) SELECT article, n, top + 1 = n AND distinct_n = n AS contiguous FROM x""")
def unit_sidecar_contiguity(t):
    u = one_per_key(t("evidence_unit"), "unit_id").withColumn("article", F.substring_index("unit_id", "::", 1))
    x = u.groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.max("unit_index").alias("top"), F.count_distinct("unit_index").alias("d"))
    return x.select("article", "n", ((F.col("top") + 1 == F.col("n")) & (F.col("d") == F.col("n"))).alias("contiguous"))


@query("WITH " + _H + "SELECT id, sha256(query_original) AS digest, length(query_original) AS n FROM hq")
def verified_source_digest(t):
    return holdout(t).select("id", F.sha2("query_original", 256).alias("digest"), F.length("query_original").cast("long").alias("n"))


@query("WITH " + _H + "SELECT difficulty, count(*) AS n, string_agg(sha256(query_original), '' ORDER BY sha256(query_original)) AS digests FROM (SELECT DISTINCT difficulty, query_original FROM hq WHERE review_status = 'approved') GROUP BY 1")
def holdout_freeze_manifest(t):
    """The approved questions' digests by difficulty, in order; as many as the authored set holds, which people write."""
    h = holdout(t).filter("review_status = 'approved'").select("difficulty", F.sha2("query_original", 256).alias("d")).distinct()
    return h.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("d")), "").alias("digests"))


@query("WITH x AS (SELECT doc_id, source, n_chars FROM documents), y AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars > 500) AS long FROM x GROUP BY 1) SELECT source, CASE WHEN n = 0 THEN '不适用' ELSE printf('%.2f%%', 100.0 * long / n) END AS share FROM y")
def percent_report(t):
    y = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 500).alias("long"))
    return y.select("source", F.coalesce(F.format_string("%.2f%%", 100.0 * F.col("long") / F.col("n")), F.lit("不适用")).alias("share"))


@query("WITH c AS (SELECT DISTINCT ON (query_id) * FROM evaluation_case) SELECT query_id, split, query_type, len(list_distinct(required_chunk_ids)) AS n FROM c WHERE query_type IN ('semantic_search', 'scenario_advice') AND expected_action = 'answer'")
def eval_case_filter(t):
    """Cases that ask about the law and are to be answered: what retrieval is measured on."""
    c = one_per_key(t("evaluation_case"), "query_id").filter(F.col("query_type").isin("semantic_search", "scenario_advice") & (F.col("expected_action") == "answer"))
    return c.select("query_id", "split", "query_type", F.when(F.col("required_chunk_ids").isNotNull(), F.size(F.array_distinct("required_chunk_ids"))).cast("long").alias("n"))


@query("WITH " + _H + "SELECT id, query_type, difficulty, answer_gt.refuse AS refuse, len(answer_gt.cited_chunk_ids) AS cited FROM hq")
def redacted_results(t):
    """What may be shown of a reserved record: no text of question or answer at any depth."""
    return holdout(t).select("id", "query_type", "difficulty", F.col("answer_gt.refuse").alias("refuse"), F.when(F.col("answer_gt.cited_chunk_ids").isNotNull(), F.size("answer_gt.cited_chunk_ids")).cast("long").alias("cited"))


@query("WITH" + FUSED + "," + ARTICLES + """, k AS (SELECT chunk_id, min(article_id) AS article_id, any_value(law_name) AS law_name FROM a GROUP BY 1)
SELECT p.query_id, p.chunk_id, k.article_id, k.article_id IS NULL AS missing FROM p LEFT JOIN k USING (chunk_id)""")
def candidate_completion(t):
    """Late join of the pool's ids to their articles; what is missing is told, not dropped."""
    k = articles(t).groupBy("chunk_id").agg(F.min("article_id").alias("article_id"))
    return pool(t).select("query_id", "chunk_id").join(k, "chunk_id", "left").select("query_id", "chunk_id", "article_id", F.col("article_id").isNull().alias("missing"))


@query("WITH" + RERANKED + "," + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id FROM c), n AS (SELECT query_id, len(required) AS n FROM c),
x AS (SELECT rr.query_id, rr.chunk_id, row_number() OVER (PARTITION BY rr.query_id ORDER BY rerank) AS place FROM rr WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = rr.query_id AND q.chunk_id = rr.chunk_id))
SELECT x.query_id, x.chunk_id, x.place FROM x JOIN n USING (query_id) WHERE place <= 4 - n""")
def hard_negative_mining(t):
    """Retrieved but not required: the best of these that fill a set of four."""
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"))
    x = reranked(t).join(need, ["query_id", "chunk_id"], "left_anti")
    x = x.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rerank")).cast("long")).join(cases(t).select("query_id", F.size("required").alias("n")), "query_id")
    return x.filter("place <= 4 - n").select("query_id", "chunk_id", "place")


@query("WITH d AS (SELECT query_original AS q FROM private_holdout UNION SELECT query_original FROM evaluation_case UNION SELECT query_original FROM sft_candidate) SELECT substr(sha256(q), 1, 1) AS head, count(*) AS n FROM d GROUP BY 1")
def digest_union(t):
    q = [t(n).select(F.sha2("query_original", 256).alias("d")) for n in ("private_holdout", "evaluation_case", "sft_candidate")]
    return q[0].unionByName(q[1]).unionByName(q[2]).distinct().groupBy(F.substring("d", 1, 1).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + ARTICLES + ", " + NUMERALS + """, h AS (SELECT article_id, unnest(map_values(hierarchy)) AS h FROM a), x AS (SELECT article_id, nullif(regexp_extract(h, '第([零〇一二三四五六七八九十百千两]+)[编章节]', 1), '') AS s FROM h)
SELECT article_id, s, list_position(k.k, s)::INTEGER AS value, list_position(k.k, s) IS NOT NULL AS canonical FROM x, k WHERE s IS NOT NULL""")
def cn_numeral_strict(t):
    """Numerals in the headings of articles: read, and whether they are in canonical spelling, that is spelt again the same."""
    x = articles(t).select("article_id", F.explode(F.map_values("hierarchy")).alias("h")).select("article_id", F.nullif(F.regexp_extract("h", "第([零〇一二三四五六七八九十百千两]+)[编章节]", 1), F.lit("")).alias("s")).filter("s is not null")
    v = N.let(N.chinese_number(F.col("s")), lambda v: F.struct(v.alias("value"), F.coalesce(N.format_number(v) == F.col("s"), F.lit(False)).alias("canonical")))
    return x.select("article_id", "s", v.alias("v")).select("article_id", "s", "v.*")


@query(r"WITH x AS (SELECT id, lower(trim(regexp_replace(query_original, '\s+', ' ', 'g'))) AS p FROM (SELECT DISTINCT id, query_original FROM sft_candidate)) SELECT md5(p) AS prompt, min(id) AS id, count(*) AS n FROM x GROUP BY p")
def prompt_dedupe(t):
    x = train(t).select("id", F.lower(F.trim(F.regexp_replace("query_original", r"\s+", " "))).alias("p"))
    return x.groupBy("p").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select(F.md5("p").alias("prompt"), "id", "n")


@query("WITH" + ARTICLES + """, n AS (SELECT DISTINCT law_name FROM law_register), q AS (SELECT article_id, left(law_name, greatest(2, length(law_name) - CAST(substr(article_id, 2) AS BIGINT) % 7)) AS asked FROM a WHERE law_name IS NOT NULL),
x AS (SELECT article_id, asked, count(*) FILTER (n.law_name = asked) AS exact, count(n.law_name) AS k, min(n.law_name) AS first FROM q LEFT JOIN n ON starts_with(n.law_name, asked) GROUP BY 1, 2)
SELECT article_id, asked, CASE WHEN exact > 0 THEN asked WHEN k = 1 THEN first END AS resolved FROM x""")
def prefix_resolve(t):
    """Names as asked, cut off by up to six signs: the registered law of just that name, else the only one that begins so.

    The register's names are spelt out to all their beginnings once, so that resolving is a join on equal keys.
    """
    n = t("law_register").select("law_name").distinct()
    begin = n.select("law_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("law_name")), lambda k: F.substring(F.col("law_name"), F.lit(1), k))).alias("asked"))
    known = begin.groupBy("asked").agg(F.count(F.lit(1)).alias("k"), F.min("law_name").alias("first"), F.bool_or(F.col("law_name") == F.col("asked")).alias("exact"))
    cut = F.substring(F.col("law_name"), F.lit(1), F.greatest(F.lit(2), F.length("law_name") - (F.substring("article_id", 2, 20).cast("long") % 7).cast("int")))
    q = articles(t).filter("law_name is not null").select("article_id", cut.alias("asked"))
    return q.join(known, "asked", "left").select("article_id", "asked", F.when(F.col("exact"), F.col("asked")).when(F.col("k") == 1, F.col("first")).alias("resolved"))


@query("WITH" + FUSED + "," + ARTICLES + """, k AS (SELECT chunk_id, min(department) AS department FROM a GROUP BY 1 HAVING min(department) IS NOT NULL), x AS (SELECT p.query_id, p.rank, p.chunk_id, k.department FROM p JOIN k USING (chunk_id)),
fd AS (SELECT *, first_value(department) OVER (PARTITION BY query_id ORDER BY rank) AS d1 FROM x) SELECT query_id, arg_min(chunk_id, rank) AS first_id, arg_min(chunk_id, rank) FILTER (department <> d1) AS other_id FROM fd GROUP BY 1""")
def cross_dept_pick(t):
    """The best article and the best of another department."""
    k = articles(t).groupBy("chunk_id").agg(F.min("department").alias("department")).filter("department is not null")
    x = pool(t).join(k, "chunk_id").withColumn("d1", F.first("department").over(W.partitionBy("query_id").orderBy("rank")))
    return x.groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("first_id"), F.min_by(F.col("chunk_id"), F.when(F.col("department") != F.col("d1"), F.col("rank"))).alias("other_id"))


# Phrases that ask for the law of another time.
OTHER_TIME = ("历史版本", "废止前", "失效前", "未来施行", "以前怎么", "当时怎么")


@query("WITH " + _H + """, x AS (SELECT id, regexp_replace(query_original, '\\s+', '', 'g') AS o, regexp_replace(CASE WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 0 THEN '废止前' || query_formal WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 1 THEN repeat(query_formal, 5) WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 2 THEN 'abc' ELSE query_formal END, '\\s+', '', 'g') AS c FROM hq)
SELECT id, CASE WHEN c IS NULL OR c = '' THEN 'empty' WHEN length(c) > greatest(160, 2 * length(o)) THEN 'too_long' WHEN len(list_filter(['""" + "', '".join(OTHER_TIME) + """'], lambda m: contains(c, m) AND NOT contains(o, m))) > 0 THEN 'other_time'
WHEN len(list_intersect(list_distinct(string_split(o, '')), list_distinct(string_split(c, '')))) < least(4, greatest(2, length(o) // 10)) THEN 'unrelated' ELSE 'valid' END AS verdict FROM x WHERE o IS NOT NULL""")
def query_boundary(t):
    """Whether a supplementary search stays within its question: not much longer, about no other time, sharing signs with it.
    Some are changed so that they don't."""
    k, f = F.substring("id", 2, 20).cast("long") % 10, F.col("query_formal")
    made = F.when(k == 0, F.concat(F.lit("废止前"), f)).when(k == 1, F.repeat(f, 5)).when(k == 2, "abc").otherwise(f)
    x = holdout(t).filter("query_original is not null").select("id", F.regexp_replace("query_original", r"\s+", "").alias("o"), F.regexp_replace(made, r"\s+", "").alias("c"))
    other = F.exists(F.array(*[F.lit(m) for m in OTHER_TIME]), lambda m: F.contains(F.col("c"), m) & ~F.contains(F.col("o"), m))
    shared = F.size(F.array_intersect(F.split("o", ""), F.split("c", "")))
    verdict = F.when(F.col("c").isNull() | (F.col("c") == ""), "empty").when(F.length("c") > F.greatest(F.lit(160), 2 * F.length("o")), "too_long").when(other, "other_time")
    return x.select("id", verdict.when(shared < F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.length("o") / 10))), "unrelated").otherwise("valid").alias("verdict"))


_TAIL = "text || repeat(right(text, CAST(2 + doc_id % 9 AS INTEGER)), CAST(doc_id % 4 AS INTEGER))"


@query(f"""WITH x AS (SELECT doc_id, {_TAIL} AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, t, list_max(list_filter(range(2, 65), lambda n: length(t) >= 3 * n AND right(t, 3 * n) = repeat(right(t, n), 3))) AS n FROM x)
SELECT doc_id, n::INTEGER AS n, (length(t) - CASE WHEN n IS NULL THEN 0 ELSE n * (list_max(list_filter(range(1, length(t) // n + 1), lambda k: right(t, n * k) = repeat(right(t, n), k::BIGINT))) - 2) END)::INTEGER AS kept FROM y""")
def repeated_tail(t):
    """Texts, some with their end said again: the longest run of 2 to 64 signs that stands at the end three times or more
    (null: none), and the length that is kept when it is said twice."""
    x = t("documents").filter("text is not null").select("doc_id", F.expr(_TAIL).alias("t"))
    y = x.withColumn("n", F.array_max(F.expr("filter(sequence(2, 64), n -> length(t) >= 3 * n and right(t, 3 * n) = repeat(right(t, n), 3))")))
    times = F.array_max(F.expr("filter(sequence(1, cast(length(t) div n as int)), k -> right(t, n * k) = repeat(right(t, n), k))"))
    return y.select("doc_id", "n", F.when(F.col("n").isNull(), F.length("t")).otherwise(F.length("t") - F.col("n") * (times - 2)).alias("kept"))


@query("WITH c AS (SELECT DISTINCT ON (query_id) * FROM evaluation_case), x AS (SELECT expected_action AS action, coalesce(action_reason, CASE WHEN CAST(regexp_extract(query_id, '[0-9]+$') AS BIGINT) % 11 = 0 THEN 'ambiguous' END) AS reason FROM c) SELECT action, coalesce(reason, '-') AS reason, coalesce((action = 'answer' AND reason IS NULL) OR (action IN ('clarify', 'refuse') AND reason IS NOT NULL), false) AS allowed, count(*) AS n FROM x GROUP BY 1, 2, 3")
def status_matrix(t):
    """Actions with their reasons, and whether the two go together: only answers have none. Every eleventh case is given a
    reason, so that some don't."""
    planted = F.when(F.regexp_extract("query_id", "[0-9]+$", 0).cast("long") % 11 == 0, "ambiguous")
    x = one_per_key(t("evaluation_case"), "query_id").select(F.col("expected_action").alias("action"), F.coalesce("action_reason", planted).alias("reason"))
    fits = ((F.col("action") == "answer") & F.col("reason").isNull()) | (F.col("action").isin("clarify", "refuse") & F.col("reason").isNotNull())
    return x.groupBy("action", F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce(fits, F.lit(False)).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT DISTINCT ON (query_id) * FROM evaluation_case), x AS (SELECT query_id, query_original AS q FROM c WHERE query_original IS NOT NULL) SELECT query_id, length(q) <= 120 AS short, length(q) - length(replace(replace(q, '？', ''), '?', '')) = 1 AS one_mark, suffix(q, '？') OR suffix(q, '?') AS at_end FROM x")
def assessment_validate(t):
    q = F.col("query_original")
    marks = F.length(q) - F.length(F.regexp_replace(q, "[？?]", ""))
    return one_per_key(t("evaluation_case"), "query_id").filter(q.isNotNull()).select("query_id", (F.length(q) <= 120).alias("short"), (marks == 1).alias("one_mark"), (F.endswith(q, F.lit("？")) | F.endswith(q, F.lit("?"))).alias("at_end"))


@query("WITH " + _R + "SELECT id, to_json({'query': query_original, 'evidence': list_transform(visible_chunk_ids, lambda x, i: {'id': 'E' || i, 'chunk': x})})::VARCHAR AS package FROM r")
def package_json(t):
    """Question and evidence of each training record as compact JSON, evidence numbered in order."""
    ev = F.transform("visible_chunk_ids", lambda x, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("id"), x.alias("chunk")))
    return train(t).select("id", F.to_json(F.struct(F.col("query_original").alias("query"), ev.alias("evidence"))).alias("package"))


@query("WITH " + _R + "SELECT id, json_extract_string(conversations[3].content, '$.summary') || '\n依据：' || array_to_string(list_filter(visible_chunk_ids, lambda x: list_contains(required_chunk_ids, x)), '；') AS message FROM r")
def render_text(t):
    reply = F.get_json_object(F.col("conversations")[2]["content"], "$.summary")
    return train(t).select("id", F.concat(reply, F.lit("\n依据："), F.array_join(F.filter("visible_chunk_ids", lambda x: F.array_contains("required_chunk_ids", x)), "；")).alias("message"))


@query("WITH " + _H + "SELECT id, unnest(['original', 'formal', 'both']) AS mode, unnest([query_original IS NOT NULL, query_formal IS NOT NULL, query_original IS NOT NULL AND query_formal IS NOT NULL]) AS possible FROM hq")
def plan_modes(t):
    o, f = F.col("query_original").isNotNull(), F.col("query_formal").isNotNull()
    each = F.array(*[F.struct(F.lit(n).alias("mode"), p.alias("possible")) for n, p in (("original", o), ("formal", f), ("both", o & f))])
    return holdout(t).select("id", F.explode(each).alias("x")).select("id", "x.*")


@query("WITH " + _R + ", x AS (SELECT id, CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 1000 < 200 AS dropped, conversations AS c FROM r) SELECT id, dropped, len(CASE WHEN dropped THEN list_filter(c, lambda m: m.role <> 'system') ELSE c END)::INTEGER AS turns, CASE WHEN dropped THEN list_filter(c, lambda m: m.role <> 'system')[1].role ELSE c[1].role END AS first_role FROM x")
def chat_augment(t):
    """A fifth of the records lose their system message, by a hash of the id."""
    drop = F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % 1000 < 200
    left = F.when(drop, F.filter("conversations", lambda c: c["role"] != "system")).otherwise(F.col("conversations"))
    return train(t).select("id", drop.alias("dropped"), F.size(left).alias("turns"), F.get(left, F.lit(0))["role"].alias("first_role"))


@query("WITH" + RERANKED + "SELECT chunk_id, count(*) AS queries, min(rerank) AS best, round(max(lexical), 6) AS top FROM rr GROUP BY 1")
def shared_rerank(t):
    """Each candidate scored once for its query, whatever lists it stood in."""
    return reranked(t).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("queries"), F.min("rerank").cast("long").alias("best"), F.round(F.max("lexical"), 6).alias("top"))


@query("WITH " + _H + "SELECT id, length(query_formal) <= 112 AS short, query_formal <> query_original AS changed, length(query_formal) - length(replace(query_formal, '？', '')) <= 1 AS single FROM hq WHERE query_formal IS NOT NULL AND query_original IS NOT NULL")
def enhancement_validate(t):
    h = holdout(t).filter("query_formal is not null and query_original is not null")
    return h.select("id", (F.length("query_formal") <= 112).alias("short"), (F.col("query_formal") != F.col("query_original")).alias("changed"), (F.length("query_formal") - F.length(F.replace("query_formal", F.lit("？"), F.lit(""))) <= 1).alias("single"))


#: Responses made of each record: some with thoughts before the answer, some with too many, some without.
_REPLY = "CASE CAST(substr(id, 2) AS BIGINT) % 4 WHEN 0 THEN conversations[3].content WHEN 1 THEN left(conversations[2].content, 60) || '</think>' || conversations[3].content WHEN 2 THEN '短</think>' || conversations[3].content || '</think>' ELSE '' END"


def replies(t):
    c = F.col("conversations")
    k = F.substring("id", 2, 20).cast("long") % 4
    made = F.when(k == 0, c[2]["content"]).when(k == 1, F.concat(F.substring(c[1]["content"], 1, 60), F.lit("</think>"), c[2]["content"])).when(k == 2, F.concat(F.lit("短</think>"), c[2]["content"], F.lit("</think>"))).otherwise("")
    return train(t).select("id", made.alias("reply"))


@query("WITH " + _R + f", x AS (SELECT id, {_REPLY} AS p FROM r), y AS (SELECT id, p, contains(p, '</think>') AS thinks, CASE WHEN contains(p, '</think>') THEN string_split(p, '</think>')[1] END AS thought, CASE WHEN contains(p, '</think>') THEN substr(p, strpos(p, '</think>') + 8) ELSE p END AS answer FROM x),"
       + r""" w AS (SELECT *, regexp_extract_all(lower(answer), '[a-z0-9]+|[\x{4E00}-\x{9FFF}]') AS w FROM y), g AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g FROM w)
SELECT id, round(greatest(-3.0, least(3.0, CASE WHEN length(trim(p)) BETWEEN 20 AND 800 THEN 0.5 ELSE -0.5 END + CASE WHEN NOT thinks THEN 0 ELSE CASE WHEN length(trim(thought)) BETWEEN 20 AND 300 THEN 1.0 ELSE -0.5 END + CASE WHEN len(string_split(p, '</think>')) = 2 THEN 0.25 ELSE -0.25 END END
 - CASE WHEN len(g) > 0 THEN least(0.5, (len(g) - len(list_distinct(g))) * 1.0 / len(g)) ELSE 0 END)), 6)::DOUBLE AS reward FROM g""")  # fmt: skip
def rule_reward(t):
    """The rewards for length, thoughts and their closing, less the penalty for repetition in the answer, within 3 either way."""
    from corvane.functions.text import repetition

    p, tag = F.col("reply"), F.lit("</think>")
    thinks = F.contains(p, tag)
    thought, answer = F.split(p, "</think>")[0], F.when(thinks, F.expr("substring(reply, locate('</think>', reply) + 8)")).otherwise(p)
    length = F.when(F.length(F.trim(p)).between(20, 800), 0.5).otherwise(-0.5)
    think = F.when(~thinks, 0.0).otherwise(F.when(F.length(F.trim(thought)).between(20, 300), 1.0).otherwise(-0.5) + F.when(F.size(F.split(p, "</think>")) == 2, 0.25).otherwise(-0.25))
    return replies(t).select("id", F.round(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), length + think - repetition(answer))), 6).alias("reward"))


_CALLS = "'想一想</think><tool_call>{\"name\":\"search\",\"arguments\":{\"q\":\"' || id || '\"}}</tool_call>' || CASE CAST(substr(id, 2) AS BIGINT) % 3 WHEN 0 THEN '<tool_call>{broken</tool_call>' WHEN 1 THEN chr(10) || '<tool_call>' || chr(10) || '{\"name\":\"lookup\"}' || chr(10) || '</tool_call>' ELSE '' END || '答'"


@query("WITH " + _R + f", x AS (SELECT id, {_CALLS} AS p FROM r), y AS (SELECT id, p, regexp_extract_all(p, '(?s)<tool_call>(.*?)</tool_call>', 1) AS c FROM x) SELECT id, len(c) AS blocks, array_to_string(list_transform(list_filter(c, lambda j: json_valid(j)), lambda j: json_extract_string(j, '$.name')), '|') AS names, string_split(p, '</think>')[1] AS thought FROM y")
def tag_json_extract(t):
    """The tool calls of a response, those that aren't JSON left out, and the thoughts before its answer."""
    k = F.substring("id", 2, 20).cast("long") % 3
    call = F.concat(F.lit('想一想</think><tool_call>{"name":"search","arguments":{"q":"'), "id", F.lit('"}}</tool_call>'))
    rest = F.when(k == 0, "<tool_call>{broken</tool_call>").when(k == 1, '\n<tool_call>\n{"name":"lookup"}\n</tool_call>').otherwise("")
    p = F.concat(call, rest, F.lit("答"))
    blocks = F.regexp_extract_all(p, F.lit("(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    names = F.array_compact(F.transform(blocks, lambda j: F.get_json_object(j, "$.name")))
    return train(t).select("id", F.size(blocks).cast("long").alias("blocks"), F.array_join(names, "|").alias("names"), F.split(p, "</think>")[0].alias("thought"))
