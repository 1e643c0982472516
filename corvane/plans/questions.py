"""Queries on questions: references to articles and their lookup, numbers in one form, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import references as R, routing as G, text as X
from corvane.plans.base import ARTICLES, articles, registry
from corvane.plans.corpus import NUMERALS
from corvane.runtime import one_per_key

QUERIES, query = registry()

#: Questions made of the articles that each evaluation case refers to (law, no, second no), beside those as they were asked.
TEMPLATES = (
    "《{l}》第{a}条是什么？", "请对比{l}第{a}、{b}条。", "《{l}》第{a}条、{b}条怎么规定？", "第{a}条是什么？", "甲法和《{l}》第{a}条是什么？", "{l}第{a}、{b}、1、2条", "比较《{l}》第{a}条之一和《乙条例》第 {b} 条。", "2015年{l}第{a}条是什么",
    "2015年通过的{l}第{a}条是什么", "去年《{l}》怎么规定的", "截至2019年{l}的内容", "2018年按{l}签订时应适用什么", "请帮我代写一份{l}的起诉状", "帮我写一下合同法第{a}条", "{l}的司法解释", "{l}修订前第{a}条", "今天天气怎么样，{b}度", "股票{a}会涨吗", "怎么规避{l}的检查",
)


def _filled(template: str) -> F.Column:
    parts = [F.lit(template)]
    out = parts[0]
    for name, column in (("{l}", "law"), ("{a}", "a"), ("{b}", "b")):
        out = F.replace(out, F.lit(name), F.col(column))
    return out


def questions(t):
    """id and q: of each evaluation case with articles one question by each template, and all questions of three tables."""
    c = one_per_key(t("evaluation_case"), "query_id").filter("size(gt_articles) > 0").select("query_id", F.col("gt_articles")[0]["law_name"].alias("law"), F.regexp_extract(F.col("gt_articles")[0]["article_no"], "^[0-9]+", 0).alias("a"), F.regexp_extract(F.element_at("gt_articles", -1)["article_no"], "^[0-9]+", 0).alias("b"))
    made = c.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}:"), "query_id").alias("id"), _filled(x).alias("q")) for k, x in enumerate(TEMPLATES)])).alias("x")).select("x.*")
    part = lambda name, tab, key: one_per_key(t(tab), key).select(F.concat(F.lit(name), key).alias("id"), F.col("query_original").alias("q"))
    return made.unionByName(part("h:", "private_holdout", "id")).unionByName(part("c:", "evaluation_case", "query_id")).unionByName(part("t:", "sft_candidate", "id"))


_MADE = " UNION ALL ".join(f"SELECT '{k}:' || query_id AS id, replace(replace(replace('{x}', '{{l}}', law), '{{a}}', a), '{{b}}', b) AS q FROM ec" for k, x in enumerate(TEMPLATES))
_Q = f"""ec AS (SELECT query_id, gt_articles[1].law_name AS law, regexp_extract(gt_articles[1].article_no, '^[0-9]+') AS a, regexp_extract(gt_articles[-1].article_no, '^[0-9]+') AS b FROM (SELECT DISTINCT ON (query_id) * FROM evaluation_case) WHERE len(gt_articles) > 0),
qs AS ({_MADE} UNION ALL SELECT DISTINCT 'h:' || id, query_original FROM private_holdout UNION ALL SELECT DISTINCT 'c:' || query_id, query_original FROM evaluation_case UNION ALL SELECT DISTINCT 't:' || id, query_original FROM sft_candidate),
qc AS (SELECT id, q, regexp_replace(q, '\\s+', '', 'g') AS t FROM qs)"""


def _spelt(text: str) -> str:
    """SQL for the list of references in a text, each spelt out."""
    each = f"regexp_extract_all(replace(g, '第', ''), '{R.NUMERAL}(?:条之{R.NUMERAL})?')"
    return f"flatten(list_transform(regexp_extract_all({text}, '{R.GROUP}'), lambda g: list_transform({each}, lambda n: '第' || n || CASE WHEN contains(n, '条') THEN '' ELSE '条' END)))"


@query(f"WITH {_Q} SELECT id, len({_spelt('t')})::INTEGER AS n FROM qc WHERE q IS NOT NULL")
def reference_count(t):
    return questions(t).filter("q is not null").select("id", F.size(R.article_references(F.col("q"))).alias("n"))


@query(f"WITH {_Q} SELECT id, array_to_string({_spelt('t')}, '|') AS expanded FROM qc WHERE len({_spelt('t')}) > 0")
def reference_expand(t):
    """Coordinated references spelt out, one after the other."""
    x = questions(t).select("id", R.article_references(F.col("q")).alias("r"))
    return x.filter("size(r) > 0").select("id", F.array_join("r", "|").alias("expanded"))


_BARE_SQL = "s"
for _pattern in R.STRIP:
    _BARE_SQL = f"regexp_replace({_BARE_SQL}, '{_pattern}', '')"
_REFS = f"""{_Q}, gr AS (SELECT id, unnest(regexp_extract_all(t, '{R.GROUP}')) AS g, unnest(string_split_regex(t, '{R.GROUP}')[1:len(regexp_extract_all(t, '{R.GROUP}'))]) AS s, generate_subscripts(regexp_extract_all(t, '{R.GROUP}'), 1) AS k FROM qc),
gl AS (SELECT *, coalesce(trim(regexp_extract_all(s, '{R.TITLE}', 1)[-1]), nullif(regexp_extract({_BARE_SQL}, '{R.BARE}', 1), '')) AS own, len(regexp_extract_all(s, '{R.TITLE}', 1)) > 1 OR regexp_matches(s, '{R.SEVERAL}') AS several FROM gr),
gi AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS law FROM gl),
rf AS (SELECT id, k, law, several, unnest({_spelt('g')}) AS no, generate_subscripts({_spelt('g')}, 1) AS j FROM gi),
st AS (SELECT id, CASE WHEN count(*) > 3 OR bool_or(several) OR bool_or(law IS NULL) THEN 'clarify' ELSE 'found' END AS status FROM rf GROUP BY 1)"""


@query(f"WITH {_REFS} SELECT qs.id, coalesce(st.status, 'none') AS status, (SELECT string_agg(law || '#' || no, '|' ORDER BY k, j) FROM rf WHERE rf.id = qs.id AND st.status = 'found') AS refs FROM qs LEFT JOIN st ON st.id = qs.id WHERE qs.q IS NOT NULL")
def exact_references(t):
    """Up to three references of each question, with the law each names or inherits; none unless all are clear."""
    x = questions(t).filter("q is not null").select("id", R.exact_references(F.col("q")).alias("x"))
    return x.select("id", "x.status", F.when(F.col("x.status") == "found", F.array_join(F.transform("x.references", lambda r: F.concat_ws("#", r["law"], r["no"])), "|")).alias("refs"))


_ALIAS = r"""al AS (SELECT alias, min(law_name) AS law_name FROM (SELECT DISTINCT law_name, unnest([n, regexp_replace(n, '（[^（）]*）$', ''), regexp_replace(regexp_replace(n, '（[^（）]*）$', ''), '^中华人民共和国', '')]) AS alias
  FROM (SELECT DISTINCT law_name, regexp_replace(law_name, '[\s《》]', '', 'g') AS n FROM a)) GROUP BY 1 HAVING count(DISTINCT law_name) = 1)"""


def _key_sql(no: str) -> str:
    """SQL for an article number in one form, as article_key; list k holds the spellings of 1 to 999."""
    form = f"^第?({R.NUMERAL})条?(?:之({R.NUMERAL}))?$"
    value = lambda p: f"CASE WHEN regexp_full_match({p}, '[0-9]+') THEN nullif(TRY_CAST({p} AS INTEGER), 0) ELSE list_position(k.k, translate({p}, '〇两', '零二')) END"
    main, more = (f"nullif(regexp_extract({no}, '{form}', {j}), '')" for j in (1, 2))
    return f"CASE WHEN {more} IS NULL THEN ({value(main)})::VARCHAR WHEN ({value(more)}) < 100 THEN ({value(main)})::VARCHAR || '之' || k.k[({value(more)})] END"


@query("WITH" + ARTICLES + ", " + NUMERALS + f", n AS (SELECT article_id, unnest([article_no, '第' || article_no || '条', '第' || replace(article_no, '之', '条之'), ' 第 ' || k[article_no_sort_key[1]] || ' 条', article_no || '之1', '第' || article_no || '甲条']) AS no FROM a, k), "
       + f"m AS (SELECT article_id, no, regexp_replace(no, '\\s+', '', 'g') AS c FROM n) SELECT article_id, no, {_key_sql('c')} AS key FROM m, k")
def article_no_key(t):
    """Article numbers as they are written in different ways, in one form."""
    from corvane.functions.numerals import format_number

    no = F.col("article_no")
    spelt = F.concat(F.lit(" 第 "), format_number(F.get("article_no_sort_key", F.lit(0))), F.lit(" 条"))
    ways = F.array(no, F.concat(F.lit("第"), no, F.lit("条")), F.concat(F.lit("第"), F.replace(no, F.lit("之"), F.lit("条之"))), spelt, F.concat(no, F.lit("之1")), F.concat(F.lit("第"), no, F.lit("甲条")))
    return articles(t).select("article_id", F.explode(ways).alias("no")).select("article_id", "no", R.article_key(F.col("no")).alias("key"))


@query("WITH" + ARTICLES + f", {_ALIAS}, {NUMERALS}, {_REFS}, ky AS (SELECT law_name, article_no, min(article_id) AS article_id FROM a GROUP BY 1, 2), "
       + f"lk AS (SELECT rf.id, rf.law, rf.no, al.law_name, {_key_sql('rf.no')} AS key FROM rf JOIN st ON st.id = rf.id AND st.status = 'found' CROSS JOIN k LEFT JOIN al ON al.alias = regexp_replace(rf.law, '[\\s《》]', '', 'g')) "
       + "SELECT lk.id, law, no, ky.article_id FROM lk LEFT JOIN ky ON ky.law_name = lk.law_name AND ky.article_no = lk.key")
def exact_lookup_article(t):
    """The article of each clear reference: the law by its name or alias, if that is one law's only, the number in one form."""
    # A filter by status would be pushed below the references and have them computed twice; unclear ones have none anyway.
    refs = questions(t).select("id", F.explode(R.exact_references(F.col("q"))["references"]).alias("r")).select("id", "r.law", "r.no")
    a = articles(t)
    alias = a.select("law_name").distinct().select("law_name", F.explode(X.law_aliases(F.col("law_name"))).alias("alias")).groupBy("alias").agg(F.min("law_name").alias("law_name"), F.count_distinct("law_name").alias("n")).filter("n = 1").drop("n")
    keys = a.groupBy("law_name", F.col("article_no").alias("key")).agg(F.min("article_id").alias("article_id"))
    known = refs.withColumns({"alias": F.regexp_replace("law", r"[\s《》]", ""), "key": R.article_key(F.col("no"))}).join(alias, "alias", "left")
    return known.join(keys, ["law_name", "key"], "left").select("id", "law", "no", "article_id")


def _after_sql(text: str, pattern: str, with_match: bool) -> str:
    found, parts = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    upto = f"coalesce(list_sum(list_transform({parts}[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform({found}[1:{'i - 1' if with_match else 'i'}], lambda p: length(p))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: substr({text}, ({upto})::BIGINT + 1))"


_OR = lambda patterns: "(?:" + "|".join(patterns) + ")"
_RULES = f"""r0 AS (SELECT id, coalesce(q, '') AS q, coalesce(t, '') AS t FROM qc),
r1 AS (SELECT *, regexp_replace(t, '《[^《》]*》', '《法名》', 'g') AS untitled, len({_spelt('t')}) AS refs, regexp_matches(t, '{_OR(G.LEGAL)}') AS legal, regexp_matches(t, '{_OR(G.OTHER_TOPICS)}') AS topic,
  regexp_matches(replace(replace(replace(t, '写一下合同法', '写一下某某'), '写合同法', '写某某'), '合同法', '某某法'), '{_OR(G.TASKS)}') OR regexp_matches(t, '{_OR(G.OUTCOMES)}') AS task FROM r0),
r2 AS (SELECT *, {_after_sql('untitled', G.YEAR, True)} AS years, {_after_sql('t', G.PAST, True)} AS starts, {_after_sql('t', G.PAST, False)} AS ends FROM r1),
r3 AS (SELECT *, regexp_matches(t, '{_OR(G.OLD_VERSION)}') OR regexp_matches(t, '{G.CUTOFF}') OR len(list_filter(years, lambda s: NOT regexp_matches(s, '{G.ENACTED}') AND len({_spelt('left(s, 80)')}) > 0)) > 0
  OR len(list_filter(range(1, len(starts) + 1), lambda i: NOT regexp_matches(starts[i], '{G.ENACTED}') AND regexp_matches(left(ends[i], 80), '{G.RULE}') AND regexp_matches(left(ends[i], 80), '{G.ASKED}'))) > 0
  OR (regexp_matches(t, '{G.PAST}') AND regexp_matches(t, '{_OR(G.OLD_CASE)}')) AS old FROM r2)"""
_ROUTE = f"""SELECT id, CASE WHEN NOT regexp_matches(q, '[A-Za-z0-9\\x{{4E00}}-\\x{{9FFF}}]') THEN 'clarify empty_input' WHEN length(t) > 256 THEN 'clarify query_too_long' WHEN task THEN 'refuse unsupported_legal_task'
WHEN regexp_matches(t, '{G.SOURCES}') THEN 'refuse unsupported_legal_source' WHEN old AND NOT (topic AND NOT (legal OR refs > 0)) THEN 'refuse time_sensitive' WHEN topic AND NOT (legal OR refs > 0) THEN 'general_chat non_legal'
WHEN refs > 3 THEN 'clarify scope_too_broad' WHEN refs > 0 THEN 'answer exact_lookup' ELSE 'answer retrieval' END AS route FROM r3"""


@query(f"WITH {_Q}, {_RULES} {_ROUTE}")
def route_cascade(t):
    """Where each question goes, and why or how."""
    return questions(t).select("id", G.route(F.col("q")).alias("r")).select("id", F.concat_ws(" ", "r.route", F.coalesce("r.reason", "r.mode")).alias("route"))


@query(f"WITH {_Q}, {_RULES} SELECT id, refs > 0 AS cites, legal, topic, task, regexp_matches(t, '{G.SOURCES}') AS sources, old FROM r3")
def route_features(t):
    """The signs that the routing rules go by."""
    text = R.compact(F.coalesce("q", F.lit("")))
    papers = text
    for name, other in G.HIDDEN:
        papers = F.replace(papers, F.lit(name), F.lit(other))
    return questions(t).select(
        "id", (F.size(R.article_references(text)) > 0).alias("cites"), text.rlike(G.any_of(G.LEGAL)).alias("legal"), text.rlike(G.any_of(G.OTHER_TOPICS)).alias("topic"),
        (papers.rlike(G.any_of(G.TASKS)) | text.rlike(G.any_of(G.OUTCOMES))).alias("task"), text.rlike(G.SOURCES).alias("sources"), G.depends_on_old_law(text).alias("old"),
    )


@query(f"WITH {_Q}, s AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in G.LEGAL) + "]) AS signal) SELECT signal, count(*) AS n FROM qc JOIN s ON contains(t, signal) GROUP BY 1")
def pattern_bank_match(t):
    """How many questions hold each legal signal: the bank is a literal array in one projection, so no pairs are joined."""
    text = R.compact(F.col("q"))
    found = F.filter(F.array(*[F.lit(s) for s in G.LEGAL]), lambda s: F.contains(text, s))
    return questions(t).select(F.explode(found).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT DISTINCT ON (query_id) * FROM evaluation_case), " + f"{_Q}, {_RULES}, w AS ({_ROUTE}) SELECT expected_action, w.route, count(*) AS n FROM c JOIN w ON w.id = 'c:' || c.query_id GROUP BY 1, 2")
def routing_accuracy(t):
    """The expected action of each evaluation case against the route its question takes."""
    want = one_per_key(t("evaluation_case"), "query_id").select("expected_action", F.concat(F.lit("c:"), "query_id").alias("id"))
    return want.join(route_cascade(t), "id").groupBy("expected_action", "route").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_Q} SELECT id, nullif(regexp_extract(t, '《([^《》]+)》第({R.NUMERAL})条', 1), '') AS law, nullif(regexp_extract(t, '《([^《》]+)》第({R.NUMERAL})条', 2), '') AS no FROM qc WHERE q IS NOT NULL")
def citation_extract(t):
    """The first citation of each question, 《law》第n条."""
    text, form = R.compact(F.col("q")), f"《([^《》]+)》第({R.NUMERAL})条"
    return questions(t).filter("q is not null").select("id", F.nullif(F.regexp_extract(text, form, 1), F.lit("")).alias("law"), F.nullif(F.regexp_extract(text, form, 2), F.lit("")).alias("no"))


@query("WITH" + ARTICLES + ", n AS (SELECT law_name, count(*) AS articles FROM a WHERE law_name IS NOT NULL GROUP BY 1), g AS (SELECT DISTINCT unnest(gt_articles).law_name AS law_name FROM evaluation_case), q AS (SELECT law_name, unnest([1, 2, 997, 998, 999]) AS no FROM g) "
       + "SELECT q.law_name, q.no, CASE WHEN n.law_name IS NULL THEN 'no_law' WHEN EXISTS (SELECT 1 FROM a WHERE a.law_name = q.law_name AND a.article_no = q.no::VARCHAR) THEN 'exists' ELSE '《' || q.law_name || '》第' || q.no || '条不存在，《' || q.law_name || '》共' || n.articles || '条，请您核实条号是否正确。' END AS answer FROM q LEFT JOIN n ON n.law_name = q.law_name")
def missing_article(t):
    """Numbers asked of the laws that cases refer to: where there is no such article, a refusal that tells how many there are."""
    a = articles(t).filter("law_name is not null")
    n = a.groupBy("law_name").agg(F.count(F.lit(1)).alias("articles"))
    g = t("evaluation_case").select(F.explode("gt_articles.law_name").alias("law_name")).distinct()
    q = g.select("law_name", F.explode(F.array(*[F.lit(k) for k in (1, 2, 997, 998, 999)])).alias("no"))
    there = a.select("law_name", F.col("article_no").try_cast("int").alias("no")).filter("no is not null").distinct().withColumn("there", F.lit(True))
    x = q.join(n, "law_name", "left").join(there, ["law_name", "no"], "left")
    cite = F.concat(F.lit("《"), "law_name", F.lit("》第"), F.col("no").cast("string"), F.lit("条不存在，《"), "law_name", F.lit("》共"), F.col("articles").cast("string"), F.lit("条，请您核实条号是否正确。"))
    return x.select("law_name", "no", F.when(F.col("articles").isNull(), "no_law").when(F.col("there"), "exists").otherwise(cite).alias("answer"))
