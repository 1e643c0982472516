"""Queries of evaluation: stage metrics, paired comparisons, failure classes, strata, fronts, reviews."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corvane.operators import evaluation as E
from corvane.operators.retrieval import stage_metrics
from corvane.plans.base import CASES, LEGS, STAGE, TOP, cases, legs, registry
from corvane.plans.retrieval import RERANKED, pool, reranked
from corvane.runtime import one_per_key

QUERIES, query = registry()


def judged(t):
    """Of each case the pool in rank order (none: empty) and the metrics at 4, 5, 10 and 20."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    lists = pool(t).groupBy("query_id").agg(ids.alias("pool"))
    x = cases(t).join(lists, "query_id", "left").withColumn("pool", F.coalesce("pool", F.array().cast("array<string>")))
    for k in (4, 5, 10, 20):
        x = x.withColumn(f"m{k}", stage_metrics(F.col("required"), F.slice("pool", 1, k)))
    return x


@query("WITH" + STAGE + "SELECT query_id, first AS first_rank, round(coalesce(1.0 / first, 0), 6) AS rr, hit5 AS matched5, round(hit5 / n, 6) AS coverage5 FROM m")
def first_gt_rank(t):
    first = F.array_min(F.filter(F.transform("required", lambda x: F.array_position("pool", x)), lambda p: p > 0))
    return judged(t).select("query_id", first.alias("first_rank"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("rr"), F.col("m5.matched").cast("long").alias("matched5"), F.round("m5.coverage", 6).alias("coverage5"))


@query("WITH" + STAGE + """SELECT query_type, count(*) AS cases, round(avg(CASE WHEN hit5 > 0 THEN 1.0 ELSE 0 END), 6) AS any5, round(avg(hit5 / n), 6) AS recall5,
round(avg(CASE WHEN hit5 = n THEN 1.0 ELSE 0 END), 6) AS complete5, round(avg(coalesce(CASE WHEN first <= 5 THEN 1.0 / first END, 0)), 6) AS mrr5 FROM m JOIN c USING (query_id) GROUP BY 1""")
def stage_macro_metrics(t):
    m = F.col("m5")
    return judged(t).groupBy("query_type").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(m["any_hit"].cast("double")), 6).alias("any5"), F.round(F.avg(m["coverage"]), 6).alias("recall5"), F.round(F.avg(m["complete"].cast("double")), 6).alias("complete5"), F.round(F.avg(m["rr"]), 6).alias("mrr5"))


@query("WITH" + STAGE + """, k AS (SELECT unnest([4, 5, 10]) AS k), hk AS (SELECT k, q.query_id, any_value(n) AS n, count(*) FILTER (rank <= k) AS hit, min(rank) FILTER (rank <= k) AS first FROM q CROSS JOIN k LEFT JOIN p USING (query_id, chunk_id) GROUP BY 1, 2)
SELECT k, count(*) AS cases, sum(hit)::BIGINT AS matched, count(*) FILTER (hit > 0) AS any_hit, count(*) FILTER (hit = n) AS complete, round(avg(hit / n), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM hk GROUP BY 1""")
def metrics_at_k(t):
    """Counts, mean coverage and reciprocal rank at 4, 5 and 10; a case whose required ids aren't found counts as 0."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in (4, 5, 10)])).alias("x")
    m = F.col("m")
    out = judged(t).select(each).select("x.*").groupBy("k")
    return out.agg(F.count(F.lit(1)).alias("cases"), F.sum(m["matched"]).alias("matched"), F.count_if(m["any_hit"]).alias("any_hit"), F.count_if(m["complete"]).alias("complete"), F.round(F.avg(m["coverage"]), 6).alias("recall"), F.round(F.avg(m["rr"]), 6).alias("mrr"))


@query("WITH" + STAGE + "SELECT n > 1 AS several, count(*) AS cases, round(avg(hit5 / n), 6) AS recall5, count(*) FILTER (hit5 = n) AS complete5 FROM m GROUP BY 1")
def gt_size_groups(t):
    return judged(t).groupBy((F.size("required") > 1).alias("several")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("m5.coverage"), 6).alias("recall5"), F.count_if("m5.complete").alias("complete5"))


_ARMS = STAGE + """, dl AS (SELECT q.query_id, count(*) FILTER (l.rank <= 5) AS hit FROM q LEFT JOIN l ON l.query_id = q.query_id AND l.chunk_id = q.chunk_id AND l.leg = 'dense' GROUP BY 1),
d AS (SELECT m.query_id, hit5 / n - hit / n AS delta FROM m JOIN dl USING (query_id))"""


def deltas(t):
    """Recall at 5 of the fused list less that of the dense list, for each case."""
    dense = legs(t).filter("leg = 'dense'").filter(F.col("rank") <= TOP).groupBy("query_id").agg(F.collect_list("chunk_id").alias("dense"))
    x = judged(t).join(dense, "query_id", "left")
    hit = F.size(F.array_intersect("required", F.coalesce("dense", F.array().cast("array<string>"))))
    return x.select("query_id", "query_type", (F.col("m5.matched") / F.size("required") - hit / F.size("required")).alias("delta"))


@query("WITH" + _ARMS + "SELECT count(*) FILTER (delta > 1e-12) AS improved, count(*) FILTER (abs(delta) <= 1e-12) AS tied, count(*) FILTER (delta < -1e-12) AS degraded, round(avg(delta), 6) AS mean_delta FROM d")
def paired_delta_counts(t):
    return deltas(t).agg(*E.paired_counts("delta"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query()
def paired_bootstrap_ci(t):
    """A 95 % interval of the mean paired difference: 2000 resamples by a Poisson weight that a hash of case and replicate gives."""
    return E.bootstrap(deltas(t), "query_id", "delta", 2000, seed=42)


@query("WITH" + RERANKED + "," + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id, len(required) AS n FROM c),
s AS (SELECT q.query_id, any_value(n) AS n, count(rr.rank) AS in_pool, count(*) FILTER (rerank <= 5) AS in_top FROM q LEFT JOIN rr USING (query_id, chunk_id) GROUP BY 1)
SELECT CASE WHEN in_pool < n THEN 'missing_from_pool' WHEN in_top < n THEN 'demoted_by_rerank' ELSE 'complete' END AS outcome, count(*) AS cases, min(query_id) AS first_case FROM s GROUP BY 1""")
def failure_attribution(t):
    """Each case at its earliest failing stage."""
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"), F.size("required").alias("n"))
    s = need.join(reranked(t), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.first("n").alias("n"), F.count("rank").alias("in_pool"), F.count_if(F.col("rerank") <= TOP).alias("in_top"))
    outcome = F.when(F.col("in_pool") < F.col("n"), "missing_from_pool").when(F.col("in_top") < F.col("n"), "demoted_by_rerank").otherwise("complete")
    return s.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("cases"), F.min("query_id").alias("first_case"))


@query("WITH" + STAGE + "SELECT count(*) FILTER (hit5 = n AND hit4 < n) AS completed_by_fifth, count(*) FILTER (hit4 = n) AS complete_at_4, count(*) AS cases FROM m")
def fifth_candidate_effect(t):
    return judged(t).agg(F.count_if(F.col("m5.complete") & ~F.col("m4.complete")).alias("completed_by_fifth"), F.count_if("m4.complete").alias("complete_at_4"), F.count(F.lit(1)).alias("cases"))


@query("WITH" + STAGE + ", b AS (SELECT unnest(range(0, 6)) AS matched) SELECT b.matched, count(m.query_id) AS cases FROM b LEFT JOIN m ON m.hit5 = b.matched GROUP BY 1")
def histogram_zero_fill(t):
    bins = t("region").sparkSession.range(6).select(F.col("id").alias("matched"))
    return bins.join(judged(t).select("query_id", F.col("m5.matched").alias("matched")), "matched", "left").groupBy("matched").agg(F.count("query_id").alias("cases"))


@query("WITH" + STAGE + """, x AS (SELECT hit5, n, unnest(list_filter(['all', query_type, split, CASE WHEN n > 1 THEN 'several' END], lambda v: v IS NOT NULL)) AS stratum FROM m JOIN c USING (query_id))
SELECT stratum, count(*) AS cases, count(*) FILTER (hit5 = n) AS complete, round(count(*) FILTER (hit5 = n) / count(*), 6) AS rate FROM x GROUP BY 1""")
def strata_summary(t):
    """The same aggregate over strata that overlap: each case is exploded into those it belongs to."""
    strata = F.array_compact(F.array(F.lit("all"), F.col("query_type"), F.col("split"), F.when(F.size("required") > 1, "several")))
    x = judged(t).select(F.explode(strata).alias("stratum"), F.col("m5.complete").alias("complete"))
    return x.groupBy("stratum").agg(F.count(F.lit(1)).alias("cases"), F.count_if("complete").alias("complete"), F.round(F.count_if("complete") / F.count(F.lit(1)), 6).alias("rate"))


_GRID = "WITH" + LEGS + """, g AS (SELECT dk, sk, rk, pk FROM (SELECT unnest([10, 30]) AS dk), (SELECT unnest([10, 30]) AS sk), (SELECT unnest([4.0, 60.0]::DOUBLE[]) AS rk), (SELECT unnest([5, 10]) AS pk)),
f AS (SELECT dk, sk, rk, pk, query_id, chunk_id, round(sum(1.0 / (rk + rank)), 9) AS score FROM l, g WHERE rank <= CASE leg WHEN 'dense' THEN dk ELSE sk END GROUP BY 1, 2, 3, 4, 5, 6),
p AS (SELECT *, row_number() OVER (PARTITION BY dk, sk, rk, pk, query_id ORDER BY score DESC, chunk_id) AS rank FROM f),""" + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id, len(required) AS n FROM c),
s AS (SELECT dk, sk, rk, pk, q.query_id, any_value(n) AS n, count(*) AS hit FROM q JOIN p USING (query_id, chunk_id) WHERE rank <= pk GROUP BY 1, 2, 3, 4, 5),
a AS (SELECT dk, sk, rk, pk, count(*) FILTER (hit = n) AS complete, round(sum(hit / n), 6) AS recall_sum FROM s GROUP BY 1, 2, 3, 4)
"""


def grid(t):
    """Sixteen configurations of both cuts, the constant of the fusion and the pool size, over lists that are ranked once."""
    i = F.col("id")
    of = lambda shift, low, high: F.when(F.floor(i / (1 << shift)) % 2 == 0, low).otherwise(high)
    g = t("region").sparkSession.range(16).select(of(0, 10, 30).alias("dk"), of(1, 10, 30).alias("sk"), of(2, 4.0, 60.0).alias("rk"), of(3, 5, 10).alias("pk"))
    by = ["dk", "sk", "rk", "pk"]
    x = legs(t).crossJoin(F.broadcast(g)).filter(F.col("rank") <= F.when(F.col("leg") == "dense", F.col("dk")).otherwise(F.col("sk")))
    f = x.groupBy(*by, "query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.col("rk") + F.col("rank"))), 9).alias("score"))
    order = W.partitionBy(*by, "query_id").orderBy(F.desc("score"), "chunk_id")
    top = f.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").filter("rank <= pk")
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"), F.size("required").alias("n"))
    s = top.join(need, ["query_id", "chunk_id"]).groupBy(*by, "query_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("hit"))
    return s.groupBy(*by).agg(F.count_if(F.col("hit") == F.col("n")).alias("complete"), F.round(F.sum(F.col("hit") / F.col("n")), 6).alias("recall_sum"))


@query(_GRID + "SELECT * FROM a")
def parameter_grid(t):
    return grid(t).select("dk", "sk", "rk", "pk", "complete", "recall_sum")


@query(_GRID + "SELECT dk, sk, rk, pk, complete, recall_sum FROM a ORDER BY complete DESC, recall_sum DESC, dk, sk, rk, pk LIMIT 1")
def config_leader(t):
    """The best configuration by its tuple of metrics; ties go to the first."""
    key = F.struct("complete", "recall_sum", (-F.col("dk")).alias("a"), (-F.col("sk")).alias("b"), (-F.col("rk")).alias("c"), (-F.col("pk")).alias("d"))
    return grid(t).agg(F.max_by(F.struct("dk", "sk", "rk", "pk", "complete", "recall_sum"), key).alias("x")).select("x.*")


@query(_GRID + """SELECT dk, sk, rk, pk FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.complete >= a.complete AND b.recall_sum >= a.recall_sum AND b.dk + b.sk + b.pk <= a.dk + a.sk + a.pk
AND (b.complete > a.complete OR b.recall_sum > a.recall_sum OR b.dk + b.sk + b.pk < a.dk + a.sk + a.pk))""")
def pareto_front(t):
    """Configurations that no other beats: complete and recall up, list length down."""
    return E.pareto(grid(t).withColumn("cost", F.col("dk") + F.col("sk") + F.col("pk")), ["complete", "recall_sum"], ["cost"]).select("dk", "sk", "rk", "pk")


@query("""WITH x AS (SELECT DISTINCT ON (id) id, lower(regexp_replace(trim(variant), '[\\s\\-]+', '_', 'g')) AS variant, visible_chunk_ids AS v, required_chunk_ids AS r,
  list_transform(citations, lambda c: visible_chunk_ids[CAST(substr(c, 2) AS INTEGER)]) AS cited FROM sft_candidate),
y AS (SELECT variant, len(list_intersect(r, cited)) AS hit, len(list_distinct(r)) AS n, len(list_distinct(cited)) AS m FROM x WHERE variant IS NOT NULL)
SELECT variant, count(*) AS records, round(sum(hit) / sum(n), 6) AS recall, round(sum(hit) / sum(m), 6) AS precision, count(*) FILTER (hit = n AND m = n) AS exact FROM y GROUP BY 1""")
def citation_set_metrics(t):
    x = one_per_key(t("sft_candidate"), "id").select(F.lower(F.regexp_replace(F.trim("variant"), r"[\s\-]+", "_")).alias("variant"), F.col("required_chunk_ids").alias("r"), F.transform("citations", lambda c: F.get("visible_chunk_ids", F.substring(c, 2, 9).cast("int") - 1)).alias("cited")).filter("variant is not null")
    y = x.select("variant", F.size(F.array_intersect("r", "cited")).alias("hit"), F.size(F.array_distinct("r")).alias("n"), F.size(F.array_distinct("cited")).alias("m"))
    return y.groupBy("variant").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("hit") / F.sum("n"), 6).alias("recall"), F.round(F.sum("hit") / F.sum("m"), 6).alias("precision"), F.count_if((F.col("hit") == F.col("n")) & (F.col("m") == F.col("n"))).alias("exact"))


_PAIRS = """hq AS (SELECT DISTINCT ON (id) * FROM private_holdout WHERE answerable),
pr AS (SELECT id, 'sufficient' AS variant, list_distinct(list_concat(retrieval_gt.required_chunk_ids, flatten(list_transform(evidence_variants, lambda v: v.ordered_chunk_ids)))) AS visible, retrieval_gt.required_chunk_ids AS required, answer_gt.summary AS summary, answer_gt.refuse AS refuse, answer_gt.cited_chunk_ids AS cited FROM hq
  UNION ALL SELECT id, 'insufficient', v.ordered_chunk_ids, required, v.answer_gt.summary, v.answer_gt.refuse, v.answer_gt.cited_chunk_ids FROM (SELECT id, retrieval_gt.required_chunk_ids AS required, evidence_variants[1] AS v FROM hq WHERE len(evidence_variants) > 0)),
rc AS (SELECT *, NOT contains(summary, chr(10)) AS valid, summary <> '' AS told, len(list_filter(cited, lambda c: NOT list_contains(visible, c))) = 0 AS within, len(list_distinct(list_intersect(required, cited))) AS found, len(list_distinct(required)) AS n,
  len(list_filter(visible, lambda c: NOT list_contains(required, c))) > 0 AS tempting, len(list_filter(cited, lambda c: list_contains(visible, c) AND NOT list_contains(required, c))) > 0 AS tempted FROM pr),
jd AS (SELECT *, variant = 'sufficient' AND valid AND NOT refuse AND told AND within AND found = n AND NOT tempted AS success, variant = 'insufficient' AND valid AND refuse AS refused, variant = 'insufficient' AND valid AND refuse AND NOT told AND len(cited) = 0 AS shaped FROM rc),
pp AS (SELECT id, bool_or(success) AS success, bool_or(shaped) AS shaped FROM jd GROUP BY 1 HAVING count(*) = 2)"""


@query("WITH " + _PAIRS + """ SELECT round(avg(valid::INT), 6) AS protocol_valid, round(avg(success::INT) FILTER (variant = 'sufficient'), 6) AS answer_success, coalesce(round(avg(refused::INT) FILTER (variant = 'insufficient'), 6), 0) AS refusal_correct,
(SELECT coalesce(round(avg((success AND shaped)::INT), 6), 0) FROM pp) AS paired_success, round(sum(found) FILTER (variant = 'sufficient') / sum(n) FILTER (variant = 'sufficient'), 6) AS citation_recall, round(avg((NOT within)::INT), 6) AS invalid_citation,
coalesce(round(avg(tempted::INT) FILTER (variant = 'sufficient' AND tempting), 6), 0) AS hard_negative_citation, coalesce(round(avg(shaped::INT) FILTER (variant = 'insufficient'), 6), 0) AS refusal_shape FROM jd""")
def pair_metrics(t):
    """The eight metrics of answers to sufficient evidence and to the first insufficient variant of each question."""
    h = one_per_key(t("private_holdout"), "id").filter("answerable")
    req = F.col("retrieval_gt.required_chunk_ids")
    every = F.array_distinct(F.concat(req, F.flatten("evidence_variants.ordered_chunk_ids")))
    part = lambda name, visible, a: F.struct(F.lit(name).alias("variant"), visible.alias("visible"), a["summary"].alias("summary"), a["refuse"].alias("refuse"), a["cited_chunk_ids"].alias("cited"))
    v = F.get("evidence_variants", F.lit(0))
    both = F.array_compact(F.array(part("sufficient", every, F.col("answer_gt")), F.when(v.isNotNull(), part("insufficient", v["ordered_chunk_ids"], v["answer_gt"]))))
    return E.pair_metrics(h.select("id", req.alias("required"), F.explode(both).alias("r")).select("id", "required", "r.*"), "id")


@query("SELECT coalesce(event_type, 'overall') AS source, count(*) AS n, round(sum(value * user_id) / sum(user_id), 4) AS weighted, round(exp(least(sum(value * user_id) / sum(user_id) / 10, 80)), 3) AS perplexity FROM events GROUP BY ROLLUP (event_type)")
def weighted_loss_rollup(t):
    """Weighted means of each source and of all, and the perplexity they stand for: the rollup gives both in one pass."""
    mean = F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id")
    x = t("events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), mean.alias("m"))
    return x.select(F.coalesce("event_type", F.lit("overall")).alias("source"), "n", F.round("m", 4).alias("weighted"), F.round(F.exp(F.least(F.col("m") / 10, F.lit(80.0))), 3).alias("perplexity"))


@query("SELECT lang, count(*) AS docs, min(n_chars) AS least, max(n_chars) AS most, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def length_percentiles(t):
    d = t("documents").filter("n_chars is not null")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.expr("cast(percentile_disc(0.5) within group (order by n_chars) as bigint)").alias("p50"), F.expr("cast(percentile_disc(0.95) within group (order by n_chars) as bigint)").alias("p95"))


@query("SELECT event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def stability_first_last(t):
    return t("events").groupBy("event_type").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT difficulty, coalesce(query_type, 'all') AS query_type, count(*) AS n FROM (SELECT DISTINCT id, difficulty, query_type FROM private_holdout) GROUP BY GROUPING SETS ((difficulty, query_type), (difficulty))")
def distribution_grouping_sets(t):
    """Two distributions in one pass; the spread by type and the total of each difficulty."""
    d = one_per_key(t("private_holdout"), "id")
    return d.groupingSets([["difficulty", "query_type"], ["difficulty"]], "difficulty", "query_type").agg(F.count(F.lit(1)).alias("n")).select("difficulty", F.coalesce("query_type", F.lit("all")).alias("query_type"), "n")


@query("""WITH x AS (SELECT DISTINCT id, difficulty, review_status, query_type, answerable FROM private_holdout), u AS (SELECT difficulty, unnest(['status', 'type', 'answerable']) AS field, unnest([review_status, query_type, answerable::VARCHAR]) AS value FROM x)
SELECT difficulty, field, coalesce(value, '-') AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY difficulty, field), 6) AS share FROM u GROUP BY 1, 2, 3""")
def review_counter_pivot(t):
    """Counts of every value of three fields by difficulty, unpivoted in one pass, with each value's share."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for n, c in (("status", "review_status"), ("type", "query_type"), ("answerable", "answerable"))])
    x = one_per_key(t("private_holdout"), "id").select("difficulty", F.explode(each).alias("x")).groupBy("difficulty", "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("difficulty", "field")), 6))


@query("""WITH x AS (SELECT DISTINCT id FROM private_holdout), h AS (SELECT id, sha256('42:' || id) AS h FROM x), n AS (SELECT count(*) AS n FROM h)
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS k FROM h), n WHERE k <= ceil(n * 0.2)""")
def review_secondary_sample(t):
    """A fifth of the records, by salted hash. The threshold comes from a bucketed count, not from one global sort."""
    return E.hash_fraction(one_per_key(t("private_holdout"), "id").select("id"), "id", "42:", 0.2)


@query("""WITH x AS (SELECT DISTINCT plan_id, plan_group, subset_seed FROM clean_scale_plan)
SELECT plan_group, plan_id, chr(64 + row_number() OVER (PARTITION BY plan_group, substr(plan_id, 1, 10) ORDER BY sha256(plan_group || chr(1) || plan_id), plan_id)::INTEGER) AS label FROM x""")
def blind_permutation(t):
    """Labels in an order that only the hash knows, within groups of at most ten."""
    x = one_per_key(t("clean_scale_plan"), "plan_id").select("plan_id", "plan_group", F.substring("plan_id", 1, 10).alias("part"))
    order = W.partitionBy("plan_group", "part").orderBy(F.sha2(F.concat("plan_group", F.lit("\x01"), "plan_id"), 256), "plan_id")
    return x.select("plan_group", "plan_id", F.char(F.lit(64) + F.row_number().over(order)).alias("label"))


@query("""WITH g AS (SELECT DISTINCT plan_group FROM clean_scale_plan), s AS (SELECT DISTINCT subset_seed FROM clean_scale_plan), f AS (SELECT unnest([1, 2, 3]) AS phase)
SELECT plan_group || '-seed-' || subset_seed || '-' || phase AS trial, CASE WHEN phase = 1 THEN 'run' ELSE 'continue' END AS execution FROM g, s, f""")
def trial_plan_cross(t):
    """Every group with every seed and phase; the three lists are distinct values, checked to be small."""
    p = t("clean_scale_plan")
    g, s = p.select("plan_group").distinct(), p.select("subset_seed").distinct()
    each = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("phase")
    x = g.crossJoin(s).select("*", each)
    return x.select(F.concat_ws("-", "plan_group", F.lit("seed"), "subset_seed", "phase").alias("trial"), F.when(F.col("phase") == 1, "run").otherwise("continue").alias("execution"))
