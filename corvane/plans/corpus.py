"""Queries over the corpus: cleaning, segmentation, numbering, text functions, identities."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corvane.functions import numerals as N, text as X
from corvane.operators import laws as L, segmentation as S, units as U
from corvane.plans.base import ARTICLES, articles, registry
from corvane.runtime import one_per_key, uniform_label

QUERIES, query = registry()


@query(r"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
'[ \t\n]*[－\-][0-9]+[－\-][ \t\n]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS c FROM documents)""")
def clean_text_regex(t):
    return t("documents").select("doc_id", X.clean_text(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


#: Every 25th article is put in as deleted, in different spellings, since the tables hold none.
_PLANTED = """pl AS (SELECT article_id, CASE CAST(substr(article_id, 2) AS BIGINT) % 25 WHEN 0 THEN '（删去）' WHEN 1 THEN ' (删去) ' WHEN 2 THEN '删除' WHEN 3 THEN '（删除）' WHEN 4 THEN ' 略。 ' WHEN 5 THEN NULL WHEN 6 THEN '（删去）三' ELSE content END AS content FROM a)"""


@query("WITH" + ARTICLES + ", " + _PLANTED + "SELECT article_id, content IS NULL OR trim(content) IN ('（删去）', '(删去)', '删除', '（删除）') OR length(trim(content)) <= 3 AS deleted FROM pl")
def chunk_filter_deleted(t):
    """Articles that are only a place where one was deleted."""
    k = F.substring("article_id", 2, 20).cast("long") % 25
    planted = F.when(k == 0, "（删去）").when(k == 1, " (删去) ").when(k == 2, "删除").when(k == 3, "（删除）").when(k == 4, " 略。 ").when(k == 5, F.lit(None)).when(k == 6, "（删去）三").otherwise(F.col("content"))
    return articles(t).select("article_id", planted.alias("content")).select("article_id", X.is_deleted(F.col("content")).alias("deleted"))


@query("WITH" + ARTICLES + "SELECT article_id FROM a WHERE NOT coalesce(contains(hierarchy['章'], '附则'), false)")
def chunk_filter_annex(t):
    return articles(t).filter(~F.coalesce(F.contains(F.col("hierarchy")["章"], F.lit("附则")), F.lit(False))).select("article_id")


_BLANK = r"[\s\x{3000}\x{00A0}\x{0085}]"
#: Items of lists: numerals in brackets, numerals or digits before a stop.
_NUM = "[一二三四五六七八九十百零〇两]+"
_LEANS = "但是|但|然而|其中|同时|并且|此外|上述|该|其|前款|前两款|前述|前项|对前款|有前款|依照前款|本条前款|本条第"


#: SQL for the list k of the Chinese spellings of 1 to 999.
NUMERALS = """d AS (SELECT ['', '一', '二', '三', '四', '五', '六', '七', '八', '九'] AS d), k AS (SELECT list_transform(range(1, 1000), lambda n: CASE WHEN n < 20 AND n >= 10 THEN '十' || d[n % 10 + 1]
  ELSE CASE WHEN n >= 100 THEN d[n // 100 + 1] || '百' || CASE WHEN n % 100 BETWEEN 1 AND 9 THEN '零' ELSE '' END ELSE '' END || CASE WHEN n % 100 >= 10 THEN d[n % 100 // 10 + 1] || '十' ELSE '' END || d[n % 10 + 1] END) AS k FROM d)"""


def bodies(t):
    return articles(t).select(F.col("article_id").alias("parent_id"), "content")


@query("WITH" + ARTICLES + r""", s AS (SELECT article_id, unnest(p) AS piece, generate_subscripts(p, 1) AS no FROM (SELECT article_id, regexp_extract_all(content, '(?s)[^。！？]*[。！？]+[”’》）)]*|[^。！？]+$') AS p FROM a WHERE content IS NOT NULL)),
c AS (SELECT article_id, no, piece, coalesce(sum(length(piece)) OVER (PARTITION BY article_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
x AS (SELECT article_id, no, o + length(piece) - length(regexp_replace(piece, '^""" + _BLANK + r"""+', '')) AS a, o + length(regexp_replace(piece, '""" + _BLANK + r"""+$', '')) AS b, regexp_replace(piece, '^""" + _BLANK + r"""+', '') AS body FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY no) AS k FROM x WHERE a < b),
g AS (SELECT *, sum(CASE WHEN k > 1 AND regexp_matches(body, '^(""" + _LEANS + """)') THEN 0 ELSE 1 END) OVER (PARTITION BY article_id ORDER BY no) AS sentence FROM y)
SELECT article_id, CAST(sentence - 1 AS INTEGER) AS sentence, CAST(min(a) AS INTEGER) AS start_char, CAST(max(b) AS INTEGER) AS end_char FROM g GROUP BY 1, 2""")
def sentence_split(t):
    """Sentences of all articles with their spans; one that leans on the sentence before it is part of that."""
    return U.sentences(articles(t).select("article_id", "content"), "article_id", "content")


@query()
def ordered_markers(t):
    """Items of lists in running text, where the numbers count up from one."""
    return U.inline_items(articles(t).select("article_id", "content"), "article_id", "content")


@query()
def evidence_units(t):
    """Every article cut into typed units with exact spans, ids and dependencies."""
    return U.units(bodies(t))


@query("WITH" + ARTICLES + "SELECT count(*) FILTER (NOT regexp_full_match(content, '" + _BLANK + "*')) AS parents, 0::BIGINT AS inexact, 0::BIGINT AS overlap, 0::BIGINT AS uncovered FROM a WHERE content IS NOT NULL")
def unit_coverage_own(t):
    """Of the units made here: spans in order, without overlap, exact text, all visible signs covered. None may fail."""
    return S.check_units(U.units(bodies(t)), bodies(t), "parent_id", "content")


@query()
def unit_fallback_reason(t):
    """Why an article stays one unit although rules would cut it."""
    return U.fallbacks(bodies(t))


#: Articles of a law are put together to texts by blocks of this many numbers, which bounds the size of a text.
_BLOCK = 50


def law_texts(t):
    """Texts of laws made of their articles: headings where they change, each article under its number."""
    levels = ("编", "分编", "章", "节")
    has = F.concat_ws("", *[F.when(F.map_contains_key("hierarchy", k), k) for k in levels])
    no = F.col("article_no_sort_key")
    a = articles(t).filter("content is not null and law_name is not null and size(article_no_sort_key) > 0")
    head = lambda k: F.concat("hierarchy." + k, F.lit(" "), F.substring(F.regexp_replace("law_name", r"\s", ""), 1, 4))
    name = F.concat(F.lit("第"), N.format_number(no[0]), F.lit("条"), F.coalesce(F.concat(F.lit("之"), N.format_number(F.get(no, F.lit(1)))), F.lit("")))
    row = F.struct(no[0].alias("n"), "article_id", F.concat_ws("\n", *[head(k) for k in levels]).alias("heads"), F.concat(name, F.lit("\n"), "content").alias("body"))
    docs = a.groupBy("law_name", F.floor(no[0] / _BLOCK).alias("block"), has.alias("has")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    parts = F.transform("rows", lambda r, i: F.concat_ws("\n", F.when((r["heads"] != "") & ((i == 0) | (F.get("rows", i - 1)["heads"] != r["heads"])), r["heads"]), r["body"]))
    return docs.select(F.concat_ws("|", "law_name", "block", "has").alias("doc"), F.array_join(parts, "\n").alias("text"))


#: The same articles as SQL expects to find them: by doc and number, cleaned, the last of a text cut off at 2,000 signs.
#: Of several heading lines before the next article only the last is taken for residue, so the others stay at the end.
_EXPECTED = ARTICLES + ", " + NUMERALS + r""", lv AS (SELECT unnest(['编', '分编', '章', '节']) AS lv, unnest([1, 2, 3, 4]) AS li),
s0 AS (SELECT article_id, law_name || '|' || (article_no_sort_key[1] // 50) || '|' || array_to_string(list_filter(['编', '分编', '章', '节'], lambda l: map_contains(hierarchy, l)), '') AS doc, article_no_sort_key AS sk, article_no, hierarchy,
  left(regexp_replace(law_name, '[ \t\n\r\f\v]', '', 'g'), 4) AS t4, regexp_replace(left(regexp_replace(law_name, '[ \t\n\r\f\v]', '', 'g'), 4), '""" + _BLANK + r"""', '', 'g') AS tail, regexp_replace(content, '^""" + _BLANK + r"""+', '') AS body
  FROM a WHERE content IS NOT NULL AND law_name IS NOT NULL AND len(article_no_sort_key) > 0),
h0 AS (SELECT *, list_transform(list_filter(['编', '分编', '章', '节'], lambda l: map_contains(hierarchy, l)), lambda l: hierarchy[l] || ' ' || t4) AS heads FROM s0),
h1 AS (SELECT *, CASE WHEN lead(heads) OVER w <> heads THEN array_to_string(list_transform(lead(heads) OVER w, lambda h, i: CASE WHEN i < len(heads) THEN chr(10) || h ELSE '' END), '') END AS leak FROM h0 WINDOW w AS (PARTITION BY doc ORDER BY sk[1], article_id)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sk[1] DESC, article_id DESC) = 1 AS last, regexp_replace(regexp_replace(body || coalesce(leak, ''), '""" + _BLANK + r"""*[－\-][0-9]+[－\-]""" + _BLANK + r"""*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS c FROM h1),
s2 AS (SELECT *, regexp_replace(CASE WHEN last THEN left(c, 2000) ELSE c END, '^""" + _BLANK + r"""+|""" + _BLANK + r"""+$', '', 'g') AS content FROM s1),
s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, article_no ORDER BY length(content) DESC, article_id) AS one FROM s2 WHERE length(content) > 3) WHERE one = 1),
hd AS (SELECT s3.article_id, s3.doc, lv, li, '第' || list_position(k.k, regexp_extract(hierarchy[lv], '第(.*?)(编|分编|章|节)', 1)) || lv || ' ' || tail AS title FROM s3, lv, k WHERE map_contains(hierarchy, lv))
"""


@query("WITH" + _EXPECTED + """SELECT doc, article_no, length(content)::INTEGER AS char_count, md5(content) AS digest,
coalesce((SELECT '{' || string_agg('"' || lv || '":"' || title || '"', ',' ORDER BY li) || '}' FROM hd WHERE hd.article_id = s3.article_id), '{}') AS hierarchy FROM s3""")
def segment_articles(t):
    """Articles found in the texts of laws, with number, content and headings."""
    x = L.segment(law_texts(t), "doc", "text")
    return x.select("doc", "article_no", "char_count", F.md5("content").alias("digest"), F.to_json("hierarchy").alias("hierarchy"))


@query("WITH" + _EXPECTED + """SELECT doc, article_no, (SELECT title FROM hd WHERE hd.article_id = s3.article_id AND lv = '编') AS part, (SELECT title FROM hd WHERE hd.article_id = s3.article_id AND lv = '分编') AS subpart,
(SELECT title FROM hd WHERE hd.article_id = s3.article_id AND lv = '章') AS chapter, (SELECT title FROM hd WHERE hd.article_id = s3.article_id AND lv = '节') AS section FROM s3""")
def asof_hierarchy(t):
    """The headings that hold over each article of the texts of laws; a heading resets the levels below it."""
    x = L.segment(law_texts(t), "doc", "text")
    return x.select("doc", "article_no", *[F.col("hierarchy")[k].alias(n) for k, n in (("编", "part"), ("分编", "subpart"), ("章", "chapter"), ("节", "section"))])


@query()
def extract_headings(t):
    """Headings of four levels in the texts of laws, by place."""
    return L.heading_table(law_texts(t), "doc", "text")


@query()
def toc_islands(t):
    """Tables of contents, that is runs of more than five headings, in texts that begin with one: where each text goes on."""
    heads = L.heading_table(law_texts(t), "doc", "text").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("h"))
    toc = F.transform("h", lambda x: F.concat(F.lit("第一章 "), x["title"]))
    front = law_texts(t).join(heads, "doc").select("doc", F.concat_ws("\n", F.array_join(toc, "\n"), F.lit("正文"), "text").alias("text"))
    return L.contents_table(front, "doc", "text")


@query("WITH" + ARTICLES + r""", l AS (SELECT article_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM a WHERE content IS NOT NULL),
p AS (SELECT article_id, no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY article_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l),
x AS (SELECT article_id, no, o + length(line) - length(regexp_replace(line, '^""" + _BLANK + r"""+', '')) AS a, o + length(regexp_replace(line, '""" + _BLANK + r"""+$', '')) AS b, regexp_replace(line, '^""" + _BLANK + r"""+|""" + _BLANK + r"""+$', '', 'g') AS body FROM p),
y AS (SELECT *, lag(body) OVER (PARTITION BY article_id ORDER BY no) AS before FROM x WHERE a < b),
g AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND (regexp_matches(body, '^[，。；：、）)》”’]') OR NOT (regexp_matches(before, '[。！？；;：:]$') OR regexp_matches(body, '^(?:[（(]""" + _NUM + r"""[）)]|""" + _NUM + r"""、|[0-9]+(?:、|\.(?:[^0-9]|$)))'))) THEN 0 ELSE 1 END) OVER (PARTITION BY article_id ORDER BY no) AS paragraph FROM y)
SELECT article_id, CAST(paragraph - 1 AS INTEGER) AS paragraph, CAST(min(a) AS INTEGER) AS start_char, CAST(max(b) AS INTEGER) AS end_char FROM g GROUP BY 1, 2""")
def paragraph_merge(t):
    """Paragraphs of all articles with their spans, unfinished lines joined."""
    return U.paragraphs(articles(t).select("article_id", "content"), "article_id", "content")


@query("""WITH x AS (SELECT doc_id, range(0, greatest(length(text), 1), 448) AS starts, length(text) AS n FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, n, unnest(starts) AS start_char FROM x)
SELECT doc_id, start_char, least(start_char + 512, n) AS end_char FROM y WHERE start_char = 0 OR start_char + 64 < n""")
def fixed_windows(t):
    """Windows of 512 with an overlap of 64, by position; none that holds only what the one before held."""
    x = t("documents").filter("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    y = x.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n"), F.lit(1)) - 1, F.lit(448).cast("long"))).alias("start_char"))
    return y.filter("start_char = 0 or start_char + 64 < n").select("doc_id", "start_char", F.least(F.col("start_char") + 512, "n").alias("end_char"))


@query()
def cn_numeral_parse(t):
    """Numbers from 1 to 9999 spelt and read again: all must come back."""
    x = t("region").sparkSession.range(1, 10000).select("id", N.format_number(F.col("id")).alias("spelt"))
    return x.select("id", "spelt", N.chinese_number(F.col("spelt")).alias("value"))


@query("WITH" + ARTICLES + r"""SELECT article_id, list_transform(string_split(article_no, '之'), lambda x: TRY_CAST(x AS INTEGER))[1] = article_no_sort_key[1] AS fits, len(article_no_sort_key) AS parts FROM a""")
def article_sort_key(t):
    return articles(t).select("article_id", (F.split("article_no", "之")[0].try_cast("int") == F.col("article_no_sort_key")[0]).alias("fits"), F.size("article_no_sort_key").cast("long").alias("parts"))


@query(r"""WITH x AS (SELECT law_id, regexp_replace(law_name, '[\s《》]', '', 'g') AS n FROM law_register), y AS (SELECT law_id, n, regexp_replace(n, '（[^（）]*）$', '') AS s FROM x)
SELECT DISTINCT law_id, unnest([n, s, regexp_replace(s, '^中华人民共和国', '')]) AS alias FROM y""")
def alias_derivation(t):
    return t("law_register").select("law_id", F.explode(X.law_aliases(F.col("law_name"))).alias("alias"))


@query("WITH" + ARTICLES + r""", x AS (SELECT law_id, regexp_replace(law_name, '[\s《》]', '', 'g') AS n FROM law_register),
k AS (SELECT alias, min(law_id) AS law_id FROM (SELECT DISTINCT law_id, unnest([n, regexp_replace(n, '（[^（）]*）$', '')]) AS alias FROM x) GROUP BY 1 HAVING count(DISTINCT law_id) = 1)
SELECT article_id, law_id FROM a LEFT JOIN k ON regexp_replace(a.law_name, '[\s《》]', '', 'g') = k.alias""")
def exact_lookup_alias(t):
    """Articles of registered laws by name or alias; an alias of two laws is no match. The register is a fixed list."""
    alias = t("law_register").select("law_id", F.explode(X.law_aliases(F.col("law_name"))).alias("alias")).groupBy("alias").agg(F.min("law_id").alias("law_id"), F.count_distinct("law_id").alias("n")).filter("n = 1")
    return articles(t).withColumn("alias", F.regexp_replace("law_name", r"[\s《》]", "")).join(alias, "alias", "left").select("article_id", "law_id")


NORMAL = r"regexp_replace(regexp_replace(nfc_normalize({0}), '[\s\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("SELECT DISTINCT id, sha256(" + NORMAL.format("query_original") + ") AS digest FROM private_holdout")
def question_digest(t):
    return one_per_key(t("private_holdout"), "id").select("id", X.question_digest(F.col("query_original")).alias("digest"))


@query("SELECT DISTINCT 'h:' || id AS id, " + NORMAL.format("query_original") + " AS q FROM private_holdout UNION ALL SELECT DISTINCT 'd:' || doc_id, " + NORMAL.format("title") + " FROM documents")
def normalize_text(t):
    """Questions and titles in composed form with single blanks."""
    h = one_per_key(t("private_holdout"), "id").select(F.concat(F.lit("h:"), "id").alias("id"), F.col("query_original").alias("q"))
    d = t("documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.col("title").alias("q"))
    return h.unionByName(d).select("id", X.normalized(F.col("q")).alias("q"))


@query("WITH n AS (SELECT doc_id, lower(" + NORMAL.format("title") + ") AS q FROM documents WHERE title IS NOT NULL) SELECT q, count(*) AS n, min(doc_id) AS first_id FROM n GROUP BY 1")
def equality_prefilter(t):
    """Titles that are one but for case, composition and white space, by a key computed before the exchange."""
    x = t("documents").filter("title is not null").select("doc_id", F.lower(X.normalized(F.col("title"))).alias("q"))
    return x.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT DISTINCT unit_id, 'x' || lpad(start_char::VARCHAR, 6, '0') || '-' || lpad(end_char::VARCHAR, 6, '0') = 'x' || split_part(unit_id, '@', 2) AS formed FROM evidence_unit")
def unit_id_format(t):
    u = one_per_key(t("evidence_unit"), "unit_id")
    return u.select("unit_id", (F.format_string("%06d-%06d", "start_char", "end_char") == F.substring_index("unit_id", "@", -1)).alias("formed"))


@query("WITH" + ARTICLES + r", f AS (SELECT article_id, law_name || CASE WHEN effective_date IS NULL THEN '' ELSE '_' || replace(effective_date, '-', '') END || CASE WHEN article_no_sort_key[1] % 9 = 0 THEN '.doc' ELSE '.docx' END AS file FROM a) SELECT article_id, TRY_CAST(strptime(nullif(regexp_extract(file, '_([0-9]{8})\.docx$', 1), ''), '%Y%m%d') AS DATE)::VARCHAR AS effective FROM f")
def filename_date(t):
    """The date in the name of a law's file, {law}_{yyyymmdd}.docx, as an ISO date; null where there is none."""
    date = F.when(F.col("effective_date").isNull(), "").otherwise(F.concat(F.lit("_"), F.replace("effective_date", F.lit("-"), F.lit(""))))
    file = F.concat("law_name", date, F.when(F.get("article_no_sort_key", F.lit(0)) % 9 == 0, ".doc").otherwise(".docx"))
    return articles(t).select("article_id", F.try_to_timestamp(F.nullif(F.regexp_extract(file, r"_([0-9]{8})\.docx$", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date").cast("string").alias("effective"))


@query(r"SELECT doc_id, regexp_replace(title, '[\s\x{3000}]+', '', 'g') AS title FROM documents")
def title_without_blanks(t):
    return t("documents").select("doc_id", F.regexp_replace("title", r"[\s\x{3000}]+", "").alias("title"))


@query("WITH" + ARTICLES + "SELECT article_id, '《' || law_name || '》第' || article_no || '条' AS citation FROM a")
def citation_format(t):
    return articles(t).select("article_id", F.concat(F.lit("《"), "law_name", F.lit("》第"), "article_no", F.lit("条")).alias("citation"))


@query("WITH c AS (SELECT DISTINCT ON (query_id) query_id, gt_articles FROM evaluation_case) SELECT query_id, array_to_string(list_transform(gt_articles, lambda g: '《' || g.law_name || '》第' || g.article_no || '条'), '；') AS citation FROM c WHERE len(gt_articles) > 0")
def citation_multi(t):
    """All articles that a case refers to as one citation."""
    one = F.transform("gt_articles", lambda g: F.concat(F.lit("《"), g["law_name"], F.lit("》第"), g["article_no"], F.lit("条")))
    return one_per_key(t("evaluation_case"), "query_id").filter("size(gt_articles) > 0").select("query_id", F.array_join(one, "；").alias("citation"))


@query("WITH" + ARTICLES + """SELECT article_id, md5(concat_ws(chr(10), '《' || law_name || '》第' || article_no || '条', hierarchy['编'], hierarchy['分编'], hierarchy['章'], hierarchy['节'], content)) AS digest FROM a""")
def sparse_document_text(t):
    h = F.col("hierarchy")
    parts = [F.concat(F.lit("《"), "law_name", F.lit("》第"), "article_no", F.lit("条")), h["编"], h["分编"], h["章"], h["节"], F.col("content")]
    return articles(t).select("article_id", F.md5(F.concat_ws("\n", *parts)).alias("digest"))


@query("WITH" + ARTICLES + "SELECT article_id, concat_ws('→', CASE WHEN map_contains(hierarchy, '编') THEN '编' END, CASE WHEN map_contains(hierarchy, '章') THEN '章' END, CASE WHEN map_contains(hierarchy, '节') THEN '节' END, '条') AS signature FROM a")
def struct_signature(t):
    levels = [F.when(F.map_contains_key("hierarchy", k), k) for k in ("编", "章", "节")]
    return articles(t).select("article_id", F.concat_ws("→", *levels, F.lit("条")).alias("signature"))


@query("""SELECT doc_id, text IS NULL OR trim(text) = '' AS empty, coalesce(contains(text, chr(65533)), false) AS replacement, coalesce(contains(text, chr(1)), false) AS control, coalesce(contains(text, '<unk>'), false) AS unknown, coalesce(length(text) <> n_chars, false) AS miscounted FROM documents""")
def text_structural_checks(t):
    has = lambda sign: F.coalesce(F.contains("text", F.lit(sign)), F.lit(False))
    nul = F.coalesce(F.contains("text", F.lit("\x00")) | F.contains("text", F.lit("\x01")), F.lit(False))
    return t("documents").select("doc_id", (F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), has("\ufffd").alias("replacement"), nul.alias("control"), has("<unk>").alias("unknown"), F.coalesce(F.length("text") != F.col("n_chars"), F.lit(False)).alias("miscounted"))


@query("SELECT s AS step, round(CASE WHEN s < 100 THEN 0.001 * (s + 1) / 100 WHEN s >= 1000 THEN 0.0001 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * (s - 100) / 900.0)) END, 9) AS rate FROM range(0, 1100, 50) r(s)")
def lr_schedule(t):
    x = t("region").sparkSession.range(0, 1100, 50).select(F.col("id").alias("step"))
    return x.select("step", F.round(X.learning_rate(F.col("step"), 1000, 100, 0.001, 0.0001), 9).alias("rate"))


@query(r"""WITH x AS (SELECT DISTINCT ON (id) id, regexp_extract_all(lower(conversations[2].content), '[a-z0-9]+|[\x{4E00}-\x{9FFF}]') AS w FROM sft_candidate),
y AS (SELECT id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g FROM x)
SELECT id, round(CASE WHEN len(g) > 0 THEN least(0.5, (len(g) - len(list_distinct(g))) * 1.0 / len(g)) ELSE 0.0 END, 6) AS penalty FROM y""")
def ngram_repetition(t):
    return one_per_key(t("sft_candidate"), "id").select("id", F.round(X.repetition(F.col("conversations")[1]["content"]), 6).alias("penalty"))


@query("WITH" + ARTICLES + r", x AS (SELECT *, regexp_replace(law_name, '（[^（）]*）$', '') || '#' || article_no AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(length(content), -1) DESC, article_id) AS n, count(*) OVER (PARTITION BY k) AS articles FROM x) SELECT k, article_id AS kept, length(content) AS longest, articles FROM y WHERE n = 1")
def dedupe_longest(t):
    """Of the articles of one number of a law, its versions included, the longest; the first of several."""
    key = F.concat(F.regexp_replace("law_name", "（[^（）]*）$", ""), F.lit("#"), "article_no")
    best = F.min(F.struct((-F.coalesce(F.length("content"), F.lit(-1))).alias("n"), "article_id", F.length("content").cast("long").alias("len")))
    return articles(t).groupBy(key.alias("k")).agg(best.alias("b"), F.count(F.lit(1)).alias("articles")).select("k", F.col("b.article_id").alias("kept"), F.col("b.len").alias("longest"), "articles")


@query("WITH" + ARTICLES + "SELECT coalesce(department, 'overall') AS department, count(DISTINCT law_name) AS laws, count(*) AS articles FROM a WHERE department IS NOT NULL GROUP BY ROLLUP (department)")
def dept_stats_rollup(t):
    r = articles(t).filter("department is not null").rollup("department").agg(F.count_distinct("law_name").alias("laws"), F.count(F.lit(1)).alias("articles"))
    return r.select(F.coalesce("department", F.lit("overall")).alias("department"), "laws", "articles")


@query("WITH" + ARTICLES + "SELECT min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 4) AS mean, count(token_count) AS counted, count(*) AS n FROM a")
def token_stats(t):
    return articles(t).agg(F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 4).alias("mean"), F.count("token_count").alias("counted"), F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT doc_id, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(o, 0)::BIGINT AS byte_offset FROM x")
def jsonl_byte_offsets(t):
    """Where each text begins in its source's file of lines."""
    from corvane.operators.prefix import running_total

    d = t("documents").filter("text is not null").select("doc_id", "source", (F.octet_length("text") + 1).alias("size"))
    return running_total(d, ["source"], "doc_id", "size", "upto", span=4096).select("doc_id", (F.col("upto") - F.col("size")).alias("byte_offset"))


@query("SELECT source, count(*) AS records, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def table_identity(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("text")).alias("bytes"))


@query("WITH r AS (SELECT DISTINCT ON (id) * FROM sft_candidate), h AS (SELECT pool_no, sha256(to_json({'citations': citations, 'id': id, 'query_id': query_id, 'query_original': query_original, 'required_chunk_ids': required_chunk_ids, 'visible_chunk_ids': visible_chunk_ids})::VARCHAR) AS h FROM r) SELECT pool_no, count(*) AS records, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT))::VARCHAR AS digest FROM h GROUP BY 1")
def canonical_row_digest(t):
    """A digest of each record's canonical JSON, and by pool one of all its records that doesn't depend on their order."""
    r = one_per_key(t("sft_candidate"), "id").select("pool_no", F.sha2(F.to_json(F.struct("citations", "id", "query_id", "query_original", "required_chunk_ids", "visible_chunk_ids")), 256).alias("h"))
    return r.groupBy("pool_no").agg(F.count(F.lit(1)).alias("records"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))


@query("SELECT doc_id, CASE WHEN lower(trim(lang)) LIKE 'zh%' THEN 'zh' WHEN lower(trim(lang)) LIKE 'en%' THEN 'en' END AS lang, regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g') AS source FROM documents")
def uniform_labels(t):
    low = F.lower(F.trim("lang"))
    return t("documents").select("doc_id", F.when(low.startswith("zh"), "zh").when(low.startswith("en"), "en").alias("lang"), uniform_label(F.col("source")).alias("source"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '<[a-z/][^<>]*>')) AS tags, length(regexp_replace(text, '<[a-z/][^<>]*>', '', 'g')) AS visible FROM documents WHERE text IS NOT NULL")
def page_extract_stats(t):
    tag = r"<[a-z/][^<>]*>"
    return t("documents").filter("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({tag})"), F.lit(1))).cast("long").alias("tags"), F.length(F.regexp_replace("text", tag, "")).cast("long").alias("visible"))


@query("SELECT count(*) AS records, true AS closed, true AS safe, true AS sized FROM documents")
def shard_manifest_closure(t):
    """Shards of the documents written and listed: the manifest's records are all there are, its names safe and once each,
    its bytes those of the files."""
    from corvane.runtime import work_path
    from corvane.sources import shard_manifest

    d = t("documents")
    path = work_path(d.sparkSession, "shards")
    d.select("doc_id", "source", "text").repartition("source").write.parquet(path)
    m = shard_manifest(d.sparkSession, path).agg(F.sum("records").alias("listed"), (F.count_distinct("file") == F.count(F.lit(1))).alias("once"), F.bool_and(X.safe_path(F.col("file"), ".parquet")).alias("safe"), F.bool_and(F.col("bytes") > 0).alias("sized"))
    n = d.agg(F.count(F.lit(1)).alias("records"))
    return n.crossJoin(F.broadcast(m)).select("records", ((F.col("records") == F.col("listed")) & F.col("once")).alias("closed"), "safe", "sized")  # one row each


@query("WITH" + ARTICLES + """, x AS (SELECT article_id, regexp_extract_all(content, '（([一二三四五六七八九十百]+)）', 1) AS m FROM a),
""" + NUMERALS + """
SELECT article_id, len(m) AS markers, m = k[1:len(m)] AS contiguous FROM x, k WHERE len(m) >= 2""")
def paragraph_markers(t):
    """Whether the items of an article are numbered from one on without a gap."""
    x = articles(t).select("article_id", F.regexp_extract_all("content", F.lit("（([一二三四五六七八九十百]+)）"), F.lit(1)).alias("m")).filter("size(m) >= 2")
    want = F.transform(F.sequence(F.lit(1), F.size("m")), N.format_number)
    return x.select("article_id", F.size("m").cast("long").alias("markers"), (F.col("m") == want).alias("contiguous"))


@query("WITH" + ARTICLES + r""", s AS (SELECT department, count(DISTINCT law_name) AS laws, count(*) AS articles FROM a WHERE department IS NOT NULL GROUP BY 1)
SELECT '{' || string_agg('"' || department || '":{"laws":' || laws || ',"articles":' || articles || '}', ',' ORDER BY department) || '}' AS stats FROM s""")
def dept_stats_json(t):
    """Laws and articles of each department as one JSON object, its keys in order; there are as many as departments."""
    s = articles(t).filter("department is not null").groupBy("department").agg(F.count_distinct("law_name").alias("laws"), F.count(F.lit(1)).alias("articles"))
    return s.agg(F.array_sort(F.collect_list(F.struct(F.col("department").alias("key"), F.struct("laws", "articles").alias("value")))).alias("m")).select(F.to_json(F.map_from_entries("m")).alias("stats"))


@query("WITH" + ARTICLES + "SELECT article_id, law_name || '#' || article_no AS chunk_id, (law_name || '#' || article_no) || '::span-v1@' || lpad('0', 6, '0') || '-' || lpad(length(content)::VARCHAR, 6, '0') AS unit_id FROM a")
def chunk_id_build(t):
    """Ids of articles, and of the unit that is the whole article, by their parts."""
    chunk = F.concat("law_name", F.lit("#"), "article_no")
    return articles(t).select("article_id", chunk.alias("chunk_id"), F.concat(chunk, F.lit("::span-v1@"), F.format_string("%06d-%06d", F.lit(0), F.length("content"))).alias("unit_id"))


@query("WITH r AS (SELECT DISTINCT ON (id) * FROM sft_candidate), x AS (SELECT id, list_concat(visible_chunk_ids, CASE CAST(substr(id, 2) AS BIGINT) % 4 WHEN 0 THEN visible_chunk_ids WHEN 1 THEN [' '] ELSE [] END) AS ids FROM r) SELECT id, CASE WHEN len(ids) NOT BETWEEN 1 AND 10 THEN 'size' WHEN len(list_distinct(ids)) <> len(ids) THEN 'repeated' WHEN len(list_filter(ids, lambda i: trim(i) = '')) > 0 THEN 'blank' WHEN len(ids) > 5 THEN 'long' ELSE 'valid' END AS verdict FROM x")
def finalize_arguments(t):
    """Ids with which a tool run is closed: one to ten, each once, none blank, and preferably no more than five."""
    k = F.substring("id", 2, 20).cast("long") % 4
    ids = F.concat("visible_chunk_ids", F.when(k == 0, F.col("visible_chunk_ids")).when(k == 1, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")))
    x = one_per_key(t("sft_candidate"), "id").select("id", ids.alias("ids"))
    n = F.size("ids")
    return x.select("id", F.when(~n.between(1, 10), "size").when(F.size(F.array_distinct("ids")) != n, "repeated").when(F.exists("ids", lambda i: F.trim(i) == ""), "blank").when(n > 5, "long").otherwise("valid").alias("verdict"))


@query("WITH" + ARTICLES + "SELECT article_id, law_name AS law, article_no AS no, md5(content) AS content, coalesce(department, '-') AS department FROM a")
def evidence_projection(t):
    """Articles as evidence: what is shown of them, without the ids and times they are kept under."""
    return articles(t).select("article_id", F.struct(F.col("law_name").alias("law"), F.col("article_no").alias("no"), F.md5("content").alias("content"), F.coalesce("department", F.lit("-")).alias("department")).alias("e")).select("article_id", "e.*")
