"""Queries of retrieval: lists, fusion, search, packing, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.operators import retrieval as R
from corvane.plans.base import ARTICLES, CASES, FUSED, LEGS, POOL, RRF_K, TOP, articles, cases, legs, registry
from corvane.operators.scoring import prompt_tokens, regex_tokens, rerank, retrieval_windows
from corvane.runtime import materialize, one_per_key

QUERIES, query = registry()


def fused(t, k: float = RRF_K) -> DataFrame:
    return R.rrf(legs(t), k, ["query_id"])


def pool(t) -> DataFrame:
    return R.cut(fused(t), POOL, ["query_id"])


@query("WITH" + LEGS + "SELECT query_id, leg, chunk_id, score, rank FROM l")
def rank_total_order(t):
    return legs(t).select("query_id", "leg", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("WITH" + LEGS + "SELECT query_id, chunk_id, round(sum(1.0 / (4.0 + rank)), 9) AS score FROM l GROUP BY 1, 2")
def rrf_fusion(t):
    return fused(t)


@query("WITH" + LEGS + """SELECT query_id, chunk_id, round(sum(CASE leg WHEN 'dense' THEN 0.7 ELSE 0.3 END / (60.0 + rank)), 9) AS score
FROM l GROUP BY 1, 2""")
def weighted_rrf(t):
    return R.rrf(legs(t), 60, ["query_id"], weight=F.when(F.col("leg") == "dense", 0.7).otherwise(0.3))


@query("WITH" + FUSED + "SELECT query_id, chunk_id, score, rank FROM p")
def hybrid_pool(t):
    return pool(t).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("WITH" + FUSED + """, g AS (SELECT e.query_type AS query_group, p.chunk_id, p.rank, p.query_id FROM p JOIN (
  SELECT DISTINCT query_id, query_type FROM evaluation_case) e USING (query_id)),
s AS (SELECT query_group, chunk_id, round(sum(1.0 / (4.0 + rank)), 6) AS score, count(*) AS queries FROM g GROUP BY 1, 2)
SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_group ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20""")
def multi_query_rrf(t):
    kinds = one_per_key(t("evaluation_case"), "query_id").select("query_id", F.col("query_type").alias("query_group"))
    joined = pool(t).select("query_id", "chunk_id", "rank").join(kinds, "query_id")
    s = joined.groupBy("query_group", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.count(F.lit(1)).alias("queries"))
    return R.cut(s, POOL, ["query_group"]).drop("rank")


@query("""SELECT query_id, chunk_id, score, window_index FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, window_index) AS n FROM ranked_hit
  WHERE leg = 'dense' AND score IS NOT NULL AND isfinite(score) AND window_index IS NOT NULL) WHERE n = 1""")
def window_maxpool(t):
    d = t("ranked_hit").filter("leg = 'dense' and score is not null and not isnan(score) and abs(score) < double('inf') and window_index is not null")
    best = d.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("window_index")).alias("w"))).alias("x"))
    return best.select("query_id", "chunk_id", "x.score", (-F.col("x.w")).alias("window_index"))


@query("WITH" + LEGS + """, u AS (SELECT query_id, chunk_id, min(rank * 2 + CASE leg WHEN 'dense' THEN 0 ELSE 1 END) AS seen FROM l WHERE rank <= 5 GROUP BY 1, 2)
SELECT query_id, string_agg(chunk_id, '|' ORDER BY seen) AS pool FROM u GROUP BY 1""")
def pool_union_ordered(t):
    """The two legs' best, taken in turn, each id where it was seen first."""
    u = legs(t, TOP).groupBy("query_id", "chunk_id").agg(F.min(F.col("rank") * 2 + F.when(F.col("leg") == "dense", 0).otherwise(1)).alias("seen"))
    ordered = F.array_sort(F.collect_list(F.struct("seen", "chunk_id")))
    return u.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_id"]), "|").alias("pool"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(t):
    e = t("embeddings")
    return R.dense_search(e, e.filter("vec_id % 20 = 0"), 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


_LOCKED = "第[零〇一二三四五六七八九十百千0-9]+条(?:之[一二三四五六七八九十]+)?"
_TOKENS = (
    f"list_concat(regexp_extract_all(lower({{0}}), '{_LOCKED}'), regexp_extract_all(regexp_replace(lower({{0}}), '{_LOCKED}', ' ', 'g'), '[a-z0-9]+'), "
    f"flatten(list_transform(regexp_extract_all(regexp_replace(lower({{0}}), '{_LOCKED}', ' ', 'g'), '[\\x{{{{4E00}}}}-\\x{{{{9FFF}}}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"
)


@query("WITH" + ARTICLES + ", d AS (SELECT article_id, unnest(" + _TOKENS.format("content") + """) AS term FROM a),
pt AS (SELECT term, article_id, count(*) AS tf FROM d GROUP BY 1, 2)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM pt GROUP BY 1""")
def postings_stats(t):
    post = R.postings(articles(t), "article_id", R.tokens(F.col("content")))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query("WITH" + ARTICLES + ", d0 AS (SELECT article_id, " + _TOKENS.format("content") + """ AS terms FROM a),
st AS (SELECT count(*) AS docs, avg(coalesce(len(terms), 0)) AS avgdl FROM d0),
pt AS (SELECT term, article_id, count(*) AS tf FROM (SELECT article_id, unnest(terms) AS term FROM d0) GROUP BY 1, 2),
i0 AS (SELECT term, ln((docs - count(*) + 0.5) / (count(*) + 0.5)) AS raw, any_value(avgdl) AS avgdl FROM pt, st GROUP BY term, docs),
i AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
qs AS (SELECT DISTINCT id, query_original FROM private_holdout WHERE CAST(substr(id, 2) AS BIGINT) % 20 = 0),
q AS (SELECT id, term, count(*) AS times FROM (SELECT id, unnest(""" + _TOKENS.format("query_original") + """) AS term FROM qs) GROUP BY 1, 2),
s AS (SELECT q.id AS query_id, pt.article_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d0.terms) / avgdl))), 5) AS score
      FROM q JOIN i USING (term) JOIN pt USING (term) JOIN d0 ON d0.article_id = pt.article_id GROUP BY 1, 2)
SELECT query_id, article_id, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM s WHERE score > 0) WHERE rank <= 30""")
def bm25_topk(t):
    q = one_per_key(t("private_holdout"), "id").filter("cast(substring(id, 2) as bigint) % 20 = 0").select(F.col("id").alias("query_id"), F.col("query_original").alias("text"))
    found = R.bm25(articles(t).select("article_id", F.col("content").alias("text")), q, "article_id", "query_id", 30)
    return found.select("query_id", "article_id", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH" + ARTICLES + "SELECT article_id, len(" + _TOKENS.format("content") + ") AS n_terms, list_distinct(" + _TOKENS.format("content") + ").len() AS n_distinct FROM a")
def tokenize_locked(t):
    return articles(t).select("article_id", R.tokens(F.col("content")).alias("x")).select("article_id", F.size("x").cast("long").alias("n_terms"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"))


@query("WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(e, e)), 4) AS norm, round(list_sum(list_transform(e, lambda v: v / sqrt(list_inner_product(e, e)))), 4) AS unit_sum FROM x")
def l2_normalize(t):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    return e.withColumn("n", norm).select("vec_id", F.round("n", 4).alias("norm"), F.round(F.aggregate("e", F.lit(0.0), lambda s, v: s + v / F.col("n")), 4).alias("unit_sum"))


@query("SELECT label, count(*) AS vectors, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max FROM embeddings GROUP BY 1")
def vector_index_stats(t):
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dim_min"), F.max(F.size("embedding")).cast("long").alias("dim_max"))


_U = """u AS (SELECT DISTINCT ON (unit_id) unit_id, parent_chunk_id, unit_index, text, start_char, end_char FROM evidence_unit)"""


def units(t) -> DataFrame:
    return one_per_key(t("evidence_unit").drop("recorded_at", "ingested_at"), "unit_id")


def reranked(t) -> DataFrame:
    """The pool in the order of the reranker: the best window of each article by the share of the question's pairs of signs."""
    q = one_per_key(t("evaluation_case"), "query_id").select("query_id", F.col("query_original").alias("text"))
    texts = articles(t).groupBy("chunk_id").agg(F.min("content").alias("text"))
    return rerank(pool(t).select("query_id", "chunk_id", "rank"), q, texts, "query_id", "chunk_id")


RERANKED = FUSED + """, cq AS (SELECT DISTINCT query_id, list_distinct(list_transform(range(1, length(query_original)), lambda i: substr(query_original, i, 2))) AS q FROM evaluation_case),
ra AS (SELECT chunk_id, min(content) AS content FROM legal_article GROUP BY 1),
rr AS (SELECT query_id, chunk_id, rank, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, rank, chunk_id) AS rerank FROM (
  SELECT query_id, chunk_id, rank, round(coalesce(list_max(list_transform(list_filter(range(0, greatest(length(content), 1), 448), lambda s: s = 0 OR s + 64 < length(content)), lambda s: len(list_filter(q, lambda x: contains(substr(content, s + 1, 512), x))))), 0) / len(q), 6) AS lexical
  FROM p JOIN cq USING (query_id) LEFT JOIN ra USING (chunk_id)))
"""


@query("WITH" + RERANKED + "SELECT query_id, chunk_id, lexical, rerank FROM rr WHERE rerank <= 5")
def rerank_top5(t):
    return reranked(t).filter(F.col("rerank") <= TOP).select("query_id", "chunk_id", "lexical", F.col("rerank").cast("long").alias("rerank"))


@query("WITH" + RERANKED + """, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w),
s AS (SELECT w, query_id, chunk_id, rerank, rank, round(w / (60.0 + rerank) + (1 - w) / (60.0 + rank), 9) AS score FROM rr, w)
SELECT w, query_id, chunk_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY w, query_id ORDER BY score DESC, rerank, rank, chunk_id) AS place FROM s) WHERE place <= 5""")
def rank_fusion_weights(t):
    w = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("w")
    s = reranked(t).select("*", w).withColumn("score", F.round(F.col("w") / (60.0 + F.col("rerank")) + (1 - F.col("w")) / (60.0 + F.col("rank")), 9))
    order = W.partitionBy("w", "query_id").orderBy(F.desc("score"), "rerank", "rank", "chunk_id")
    return s.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 5").select("w", "query_id", "chunk_id", "score", "place")


# The policies for the last places: weights of the reranker in a fusion, and gaps within which the fifth yields.
FUSED_AT, GAPS = (1.0, 0.975, 0.95, 0.9), (0.005, 0.01, 0.02, 0.05)


@query("WITH" + RERANKED + f""", wt AS (SELECT unnest({list(FUSED_AT)}::DOUBLE[]) AS value), gp AS (SELECT unnest({list(GAPS)}::DOUBLE[]) AS value),
fu AS (SELECT 'fusion' AS kind, value, query_id, chunk_id, row_number() OVER (PARTITION BY value, query_id ORDER BY round(value / (60.0 + rerank) + (1 - value) / (60.0 + rank), 9) DESC, rerank, rank, chunk_id) AS place FROM rr, wt),
k5 AS (SELECT query_id, lexical AS s5, rank AS r5 FROM rr WHERE rerank = 5),
ch AS (SELECT value, query_id, min({{'r': rank, 'k': rerank}}).k AS up FROM rr JOIN k5 USING (query_id), gp WHERE rerank BETWEEN 6 AND 10 AND s5 - lexical <= value + 1e-12 AND rank < r5 GROUP BY 1, 2),
bo AS (SELECT 'boundary' AS kind, gp.value, rr.query_id, rr.chunk_id, CASE WHEN rerank = up THEN 5 WHEN up IS NOT NULL AND rerank BETWEEN 5 AND up - 1 THEN rerank + 1 ELSE rerank END AS place FROM rr CROSS JOIN gp LEFT JOIN ch ON ch.query_id = rr.query_id AND ch.value = gp.value),
al AS (SELECT * FROM fu UNION ALL SELECT * FROM bo) SELECT kind, value, query_id, string_agg(chunk_id, '|' ORDER BY place) AS top FROM al WHERE place <= 5 GROUP BY 1, 2, 3""")
def boundary_policy(t):
    """The best five under each of eight policies: fusion with the pool's order at four weights (1: the reranker alone), and
    four gaps within which the fifth gives way to the one of the next five that stands highest in the pool."""
    rr = reranked(t)
    w = F.explode(F.array(*[F.lit(x) for x in FUSED_AT])).alias("value")
    mixed = F.round(F.col("value") / (60.0 + F.col("rerank")) + (1 - F.col("value")) / (60.0 + F.col("rank")), 9)
    order = W.partitionBy("value", "query_id").orderBy(F.desc("mixed"), "rerank", "rank", "chunk_id")
    fusion = rr.select("*", w).withColumn("mixed", mixed).withColumn("place", F.row_number().over(order)).filter("place <= 5").select(F.lit("fusion").alias("kind"), "value", "query_id", "chunk_id", "place")
    ten = rr.filter("rerank <= 10").select("*", F.explode(F.array(*[F.lit(x) for x in GAPS])).alias("value"))
    of = W.partitionBy("value", "query_id")
    fifth = lambda c: F.max(F.when(F.col("rerank") == 5, F.col(c))).over(of)
    ten = ten.withColumns({"s5": fifth("lexical"), "r5": fifth("rank")})
    rival = (F.col("rerank") > 5) & (F.col("s5") - F.col("lexical") <= F.col("value") + 1e-12) & (F.col("rank") < F.col("r5"))
    up = F.min(F.when(rival, F.struct("rank", "rerank"))).over(of)["rerank"]
    k = F.col("rerank")
    ten = ten.withColumn("up", up).withColumn("place", F.when(k == F.col("up"), 5).when((k >= 5) & (k < F.col("up")), k + 1).otherwise(k))
    every = fusion.unionByName(ten.filter("place <= 5").select(F.lit("boundary").alias("kind"), "value", "query_id", "chunk_id", "place"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"])
    return every.groupBy("kind", "value", "query_id").agg(F.array_join(listed, "|").alias("top"))


@query("WITH" + RERANKED + """, x AS (SELECT query_id, chunk_id, rerank, CASE WHEN rerank <= 2 THEN 0 WHEN rerank > 5 AND rank <= 5 THEN 1 ELSE 2 END AS part FROM rr),
y AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rerank) AS n FROM x)
SELECT query_id, string_agg(chunk_id, '|' ORDER BY n) AS merged FROM y WHERE n <= 5 GROUP BY 1""")
def merge_promoted(t):
    """The reranker's best two, then what the pool promotes, then the rest, five in all."""
    x = reranked(t).withColumn("part", F.when(F.col("rerank") <= 2, 0).when((F.col("rerank") > 5) & (F.col("rank") <= 5), 1).otherwise(2))
    y = x.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("part", "rerank"))).filter("n <= 5")
    return y.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda s: s["chunk_id"]), "|").alias("merged"))


@query("WITH" + RERANKED + "," + ARTICLES + """, z AS (SELECT chunk_id, max(coalesce(token_count, char_count, length(content)))::BIGINT AS tokens FROM a GROUP BY 1),
it AS (SELECT query_id, list({'used': tokens, 'kept': [chunk_id]} ORDER BY rerank) AS items FROM rr JOIN z USING (chunk_id) WHERE rerank <= 5 GROUP BY 1),
fo AS (SELECT query_id, list_reduce(items, lambda acc, x: CASE WHEN acc.used + x.used <= 400 THEN {'used': acc.used + x.used, 'kept': list_concat(acc.kept, x.kept)} ELSE acc END, {'used': 0::BIGINT, 'kept': []::VARCHAR[]}) AS x FROM it)
SELECT query_id, x.used AS used, array_to_string(x.kept, '|') AS kept FROM fo""")
def budget_pack_skip(t):
    """The best five of each query that fit 400 tokens, one after the other; what doesn't fit is skipped."""
    size = articles(t).groupBy("chunk_id").agg(F.max(F.coalesce("token_count", "char_count", F.length("content"))).alias("tokens"))
    five = reranked(t).filter(F.col("rerank") <= TOP).join(size, "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("rerank", "chunk_id", F.col("tokens").cast("long").alias("tokens"))))
    packed = five.groupBy("query_id").agg(R.pack(listed, "tokens", 400).alias("x"))
    return packed.select("query_id", "x.used", F.array_join("x.kept", "|").alias("kept"))


@query("WITH" + RERANKED + "," + ARTICLES + """, z AS (SELECT chunk_id, max(coalesce(token_count, char_count, length(content))) AS tokens FROM a GROUP BY 1),
s AS (SELECT rr.query_id, rr.chunk_id, tokens, row_number() OVER (PARTITION BY rr.query_id ORDER BY rerank) - 1 AS bit FROM rr JOIN z USING (chunk_id) WHERE rerank <= 5),
m AS (SELECT query_id, mask, sum(tokens) AS used, sum(1 << (4 - bit)::INT) AS inclusion, count(*) AS n FROM s, range(1, 32) r(mask) WHERE (mask >> bit::INT) & 1 = 1 GROUP BY 1, 2),
k AS (SELECT query_id, count(*) AS items FROM s GROUP BY 1)
SELECT query_id, max(inclusion)::BIGINT AS inclusion FROM m JOIN k USING (query_id) WHERE used <= 400 AND mask < (1 << items::INT) GROUP BY 1""")
def budget_best_subset(t):
    """The best of all subsets of the top five within 400 tokens: earlier candidates weigh more than all later ones."""
    size = articles(t).groupBy("chunk_id").agg(F.max(F.coalesce("token_count", "char_count", F.length("content"))).alias("tokens"))
    five = reranked(t).filter(F.col("rerank") <= TOP).join(size, "chunk_id")
    s = five.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rerank", "tokens"))), lambda x: x["tokens"]).alias("tok"))
    m = s.select("query_id", "tok", F.explode(F.sequence(F.lit(1), F.shiftleft(F.lit(1), 5) - 1)).alias("mask")).filter("mask < power(2, size(tok))")
    used = F.expr("aggregate(sequence(0, size(tok) - 1), 0L, (acc, i) -> acc + if((mask & shiftleft(1, i)) > 0, cast(tok[i] as bigint), 0L))")
    rank = F.expr("aggregate(sequence(0, size(tok) - 1), 0L, (acc, i) -> acc + if((mask & shiftleft(1, i)) > 0, cast(shiftleft(1, 4 - i) as bigint), 0L))")
    return m.withColumn("used", used).filter("used <= 400").groupBy("query_id").agg(F.max(rank).alias("inclusion"))


@query("""WITH x AS (SELECT DISTINCT id, trim(query_original) AS o, trim(query_formal) AS f FROM private_holdout), y AS (SELECT id, unnest(list_concat([o, f, o || ' ' || f], string_split_regex(coalesce(f, o), '[，。？；]'))) AS v, generate_subscripts(list_concat([o, f, o || ' ' || f], string_split_regex(coalesce(f, o), '[，。？；]')), 1) AS k FROM x),
z AS (SELECT id, v, min(k) AS k FROM y WHERE trim(v) <> '' GROUP BY 1, 2), w AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM z)
SELECT id, count(*) AS n_queries, md5(string_agg(v, chr(10) ORDER BY n)) AS digest FROM w WHERE n <= 6 GROUP BY 1""")
def compile_queries(t):
    """The searches for a question: as asked, as rewritten, both together, then the clauses of the rewriting; each once, in
    the order in which they were first seen, six at most."""
    x = one_per_key(t("private_holdout"), "id").select("id", F.trim("query_original").alias("o"), F.trim("query_formal").alias("f"))
    every = F.concat(F.array("o", "f", F.concat("o", F.lit(" "), "f")), F.split(F.coalesce("f", "o"), "[，。？；]"))
    listed = F.slice(F.array_distinct(F.filter(every, lambda v: F.trim(v) != "")), 1, 6)
    return x.select("id", listed.alias("l")).filter("size(l) > 0").select("id", F.size("l").cast("long").alias("n_queries"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("WITH" + ARTICLES + """, w AS (SELECT article_id, len(regexp_extract_all(content, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) AS tokens FROM a) SELECT article_id, tokens::INTEGER AS tokens FROM w WHERE tokens IS NOT NULL""")
def article_tokens(t):
    """Tokens of each article by the default counter."""
    return articles(t).filter("content is not null").select("article_id", regex_tokens(F.col("content")).alias("tokens"))


@query("""WITH r AS (SELECT DISTINCT ON (id) * FROM sft_candidate) SELECT id, list_sum(list_transform(conversations, lambda c: 4 + len(regexp_extract_all(c.role, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) + len(regexp_extract_all(c.content, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))))::INTEGER AS tokens FROM r""")
def prompt_token_count(t):
    """The length of each record's chat by the default counter."""
    return one_per_key(t("sft_candidate"), "id").select("id", prompt_tokens(F.col("conversations")).alias("tokens"))


@query()
def sliding_windows(t):
    """Retrieval windows of all articles: up to 512 tokens with the heading, ended at boundaries, overlapping by 64."""
    head = F.concat(F.lit("《"), "law_name", F.lit("》第"), "article_no", F.lit("条"))
    return retrieval_windows(articles(t).select("article_id", "content", head.alias("heading")), "article_id", "content", "heading")


@query("SELECT vec_id, len(embedding)::INTEGER AS dim, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) + 0.0 AS first, round(embedding[-1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) + 0.0 AS last FROM embeddings")
def dense_index_build(t):
    """A dense index built, published, loaded and validated: its vectors, of length 1."""
    from corvane.runtime import work_path
    from corvane.sources import indexes

    spark = t("embeddings").sparkSession
    path = work_path(spark, "dense-index")
    indexes.save_dense(t("embeddings"), path)
    v, _ = indexes.load_dense(spark, path)
    return v.select("vec_id", F.size("embedding").alias("dim"), (F.round(F.get("embedding", F.lit(0)), 5) + 0.0).alias("first"), (F.round(F.element_at("embedding", -1), 5) + 0.0).alias("last"))


@query("WITH" + ARTICLES + ", d AS (SELECT article_id, unnest(" + _TOKENS.format("content") + ") AS term FROM a), c AS (SELECT term, count(DISTINCT article_id) AS n FROM d GROUP BY 1) SELECT term, n, n AS postings FROM c")
def sparse_index_build(t):
    """A sparse index built, published, loaded and validated: documents of each term by its counts and by its postings."""
    from corvane.runtime import work_path
    from corvane.sources import indexes

    a = articles(t).select("article_id", F.col("content").alias("text"))
    path = work_path(a.sparkSession, "sparse-index")
    indexes.save_sparse(a, path, "article_id")
    postings, terms, _ = indexes.load_sparse(a.sparkSession, path)
    return terms.filter("term is not null").select("term", "n").join(postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings")), "term")


@query("WITH" + LEGS + """, b AS (SELECT query_id, count(*) AS n, max(chunk_id) FILTER (rank = 1) AS best FROM l WHERE leg = 'dense' GROUP BY 1), c AS (SELECT query_id, count(*) AS n, max(chunk_id) FILTER (rank = 1) AS best FROM l WHERE leg = 'sparse' GROUP BY 1)
SELECT coalesce(b.query_id, c.query_id) AS query_id, b.best AS baseline, c.best AS candidate, CASE WHEN b.query_id IS NULL THEN 'no_baseline' WHEN c.query_id IS NULL THEN 'no_candidate' ELSE 'paired' END AS state FROM b FULL JOIN c ON b.query_id = c.query_id""")
def paired_join_complete(t):
    """Records of a baseline and of a candidate by question, and whether both are there: none may be missing in silence."""
    best = lambda leg, name: legs(t, 1).filter(F.col("leg") == leg).select("query_id", F.col("chunk_id").alias(name))
    x = best("dense", "baseline").join(best("sparse", "candidate"), "query_id", "full")
    return x.select("query_id", "baseline", "candidate", F.when(F.col("baseline").isNull(), "no_baseline").when(F.col("candidate").isNull(), "no_candidate").otherwise("paired").alias("state"))


@query("WITH" + LEGS + ", x AS (SELECT query_id, chunk_id, max(rank) FILTER (leg = 'dense') AS d, max(rank) FILTER (leg = 'sparse') AS s FROM l WHERE rank <= 10 GROUP BY 1, 2) SELECT query_id, chunk_id, s AS rank, EXISTS (SELECT 1 FROM l WHERE l.query_id = x.query_id AND l.leg = 'dense') AS compared FROM x WHERE d IS NULL")
def audit_added_hits(t):
    """The ids that the second leg adds to the first one's ten, with their rank there, and whether there was a first one."""
    x = legs(t, 10).groupBy("query_id", "chunk_id").agg(F.max(F.when(F.col("leg") == "dense", F.col("rank"))).alias("d"), F.max(F.when(F.col("leg") == "sparse", F.col("rank"))).alias("s"))
    first = legs(t, 1).filter("leg = 'dense'").select("query_id", F.lit(True).alias("there"))
    return x.filter("d is null").join(first, "query_id", "left").select("query_id", "chunk_id", F.col("s").cast("long").alias("rank"), F.coalesce("there", F.lit(False)).alias("compared"))


_PROMPT = "list_sum(list_transform(conversations, lambda c: 4 + len(regexp_extract_all(c.role, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) + len(regexp_extract_all(c.content, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))))"


@query("WITH r AS (SELECT DISTINCT ON (id) * FROM sft_candidate), x AS (SELECT id, " + _PROMPT + "::INTEGER AS tokens FROM r) SELECT id, tokens, greatest(tokens + 60 - 220, 0) AS overflow, tokens + 60 <= 220 AS fits FROM x")
def length_budget_audit(t):
    """Prompts that leave no room for 60 new tokens in a sequence of 220, and by how much they are too long."""
    n = prompt_tokens(F.col("conversations"))
    return one_per_key(t("sft_candidate"), "id").select("id", n.alias("tokens")).select("id", "tokens", F.greatest(F.col("tokens") + 60 - 220, F.lit(0)).alias("overflow"), (F.col("tokens") + 60 <= 220).alias("fits"))


@query("""WITH w AS (SELECT query_id, chunk_id, score, window_index FROM ranked_hit WHERE leg = 'dense' AND score IS NOT NULL AND isfinite(score) AND chunk_id IS NOT NULL AND window_index IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, window_index) AS n, count(*) OVER (PARTITION BY query_id, chunk_id) AS windows FROM w)
SELECT query_id, chunk_id, score, window_index, windows, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b WHERE n = 1) WHERE rank <= 10""")
def dense_window_topk(t):
    """The ten best chunks of each dense list of windows, each by its best window; all windows are looked at, so no list of
    windows has to be fetched again for want of chunks."""
    d = t("ranked_hit").filter("leg = 'dense' and score is not null and not isnan(score) and abs(score) < double('inf') and chunk_id is not null and window_index is not null")
    b = d.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("window_index")).alias("w"))).alias("x"), F.count(F.lit(1)).alias("windows"))
    order = W.partitionBy("query_id").orderBy(F.desc("x.score"), "chunk_id")
    return b.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "chunk_id", "x.score", (-F.col("x.w")).alias("window_index"), "windows", F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT unit_id, dependency_unit_ids FROM evidence_unit), e0 AS (SELECT DISTINCT unit_id, unnest(dependency_unit_ids) AS dep FROM u),
e AS (SELECT unit_id, dep FROM e0 UNION SELECT dep, unit_id FROM e0 WHERE suffix(unit_id, '7')), c(unit_id, dep) AS (SELECT unit_id, dep FROM e UNION SELECT c.unit_id, e.dep FROM c JOIN e ON e.unit_id = c.dep)
SELECT unit_id, count(*) AS needs, min(dep) AS first_dep, bool_or(dep = unit_id) AS cyclic FROM c GROUP BY 1""")
def dependency_closure(t):
    """All units a unit depends on, directly or not, and whether it depends on itself: joins that double the reach each
    round, until nothing is new. Dependencies of units whose id ends in 7 are put in the other way round too, as cycles."""
    edges = one_per_key(t("evidence_unit"), "unit_id").select("unit_id", F.explode("dependency_unit_ids").alias("dep"))
    back = edges.filter("endswith(unit_id, '7')").select(F.col("dep").alias("unit_id"), F.col("unit_id").alias("dep"))
    known = materialize(edges.unionByName(back).distinct(), "closure")
    n = known.count()
    while True:
        step = known.join(known.select(F.col("unit_id").alias("dep"), F.col("dep").alias("far")), "dep").select("unit_id", F.col("far").alias("dep"))
        known = materialize(known.unionByName(step).distinct(), "closure")
        m = known.count()
        if m == n:
            break
        n = m
    return known.groupBy("unit_id").agg(F.count(F.lit(1)).alias("needs"), F.min("dep").alias("first_dep"), F.bool_or(F.col("dep") == F.col("unit_id")).alias("cyclic"))
