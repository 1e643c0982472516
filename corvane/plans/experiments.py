"""Queries of experiments: trials, reviews, gates, sweeps, matching, chains."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Window as W, functions as F

from corvane.operators import evaluation as E, sampling as S
from corvane.plans.answers import holdout, train
from corvane.plans.base import ARTICLES, CASES, FUSED, LEGS, STAGE, articles, cases, legs, registry
from corvane.plans.evaluation import deltas, judged
from corvane.plans.integrity import variant
from corvane.plans.retrieval import RERANKED, pool, reranked
from corvane.runtime import one_per_key

QUERIES, query = registry()
_P = "pl AS (SELECT DISTINCT ON (plan_id) * FROM clean_scale_plan)"
_H = "hq AS (SELECT DISTINCT ON (id) * FROM private_holdout)"
_R = "r AS (SELECT DISTINCT ON (id) *, regexp_replace(lower(trim(variant)), '[\\s\\-]+', '_', 'g') AS v FROM sft_candidate)"


def plans(t):
    return one_per_key(t("clean_scale_plan"), "plan_id")


@query("WITH" + RERANKED + "," + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id FROM c)
SELECT q.query_id, q.chunk_id, CASE WHEN rr.rerank IS NULL THEN 'missing_from_pool' WHEN rr.rerank > 5 THEN 'demoted' ELSE 'kept' END AS outcome FROM q LEFT JOIN rr USING (query_id, chunk_id)""")
def rerank_failure_class(t):
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"))
    return need.join(reranked(t), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.when(F.col("rerank").isNull(), "missing_from_pool").when(F.col("rerank") > 5, "demoted").otherwise("kept").alias("outcome"))


_ARMS = STAGE + """, dl AS (SELECT q.query_id, count(*) FILTER (l.rank <= 5) AS hit FROM q LEFT JOIN l ON l.query_id = q.query_id AND l.chunk_id = q.chunk_id AND l.leg = 'dense' GROUP BY 1),
d AS (SELECT m.query_id, hit5 / n - hit / n AS delta FROM m JOIN dl USING (query_id))"""


@query("WITH" + STAGE + """, ds AS (SELECT q.query_id, count(*) FILTER (l.rank <= 5) AS d5, count(*) FILTER (l.rank <= 4) AS d4 FROM q LEFT JOIN l ON l.query_id = q.query_id AND l.chunk_id = q.chunk_id AND l.leg = 'dense' GROUP BY 1),
x AS (SELECT *, count(*) FILTER (hit5 = n AND d5 < n) OVER () - count(*) FILTER (hit5 < n AND d5 = n) OVER () AS net FROM m JOIN ds USING (query_id))
SELECT any_value(net) AS net_gain, any_value(net) >= 3 AS gains, sum(hit5)::BIGINT >= sum(d5)::BIGINT AS covers, count(*) FILTER (hit4 = n) >= count(*) FILTER (d4 = n) AS packs, any_value(net) >= 3 AND sum(hit5)::BIGINT >= sum(d5)::BIGINT AND count(*) FILTER (hit4 = n) >= count(*) FILTER (d4 = n) AS accepted FROM x""")
def acceptance_gate(t):
    """Whether the fused list may replace the dense one: at least three more cases complete than lost, no less of what is
    required in the five, and no fewer cases complete in the four that are packed."""
    dense = legs(t, 5).filter("leg = 'dense'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("d"))
    x = judged(t).join(dense, "query_id", "left").withColumn("d", F.coalesce(F.transform("d", lambda s: s["chunk_id"]), F.array().cast("array<string>")))
    n = F.size("required")
    x = x.select(n.alias("n"), F.col("m5.matched").alias("f5"), F.col("m4.complete").alias("f4"), F.size(F.array_intersect("required", "d")).alias("d5"), (F.size(F.array_intersect("required", F.slice("d", 1, 4))) == n).alias("d4"))
    net = F.count_if((F.col("f5") == F.col("n")) & (F.col("d5") < F.col("n"))) - F.count_if((F.col("f5") < F.col("n")) & (F.col("d5") == F.col("n")))
    y = x.agg(net.alias("net_gain"), (F.sum("f5") >= F.sum("d5")).alias("covers"), (F.count_if("f4") >= F.count_if("d4")).alias("packs"))
    return y.select("net_gain", (F.col("net_gain") >= 3).alias("gains"), "covers", "packs", ((F.col("net_gain") >= 3) & F.col("covers") & F.col("packs")).alias("accepted"))


@query()
def oriented_bootstrap(t):
    """The interval of the paired difference with its sign turned, as for a metric of which less is better."""
    return E.bootstrap(deltas(t).withColumn("delta", -F.col("delta")), "query_id", "delta", 2000, seed=7)


@query("WITH" + LEGS + "," + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id, len(required) AS n FROM c), k AS (SELECT unnest([5, 10, 30]) AS depth),
s AS (SELECT depth, q.query_id, any_value(n) AS n, count(DISTINCT l.chunk_id) AS hit FROM q CROSS JOIN k LEFT JOIN l ON l.query_id = q.query_id AND l.chunk_id = q.chunk_id AND l.rank <= depth GROUP BY 1, 2),
x AS (SELECT depth, query_id, hit = n AS complete, first_value(hit = n) OVER w AS base, lag(hit = n) OVER w AS before FROM s WINDOW w AS (PARTITION BY query_id ORDER BY depth))
SELECT query_id, depth, complete, complete AND base AS kept, complete AND NOT base AS newly_complete, coalesce(before AND NOT complete, false) AS lost FROM x""")
def context_transition(t):
    """Of each case and depth whether it is complete, still complete as at the first depth, newly so, or lost since the one before."""
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"), F.size("required").alias("n"), F.array(F.lit(5), F.lit(10), F.lit(30)).alias("depths"))
    found = legs(t).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    x = need.join(found, ["query_id", "chunk_id"], "left").withColumn("depth", F.explode("depths"))
    s = x.groupBy("depth", "query_id").agg((F.count_if(F.col("rank") <= F.col("depth")) == F.first("n")).alias("complete"))
    w = W.partitionBy("query_id").orderBy("depth")
    s = s.withColumn("base", F.first("complete").over(w)).withColumn("before", F.lag("complete").over(w))
    return s.select("query_id", "depth", "complete", (F.col("complete") & F.col("base")).alias("kept"), (F.col("complete") & ~F.col("base")).alias("newly_complete"), F.coalesce(F.col("before") & ~F.col("complete"), F.lit(False)).alias("lost"))


_PACKED = """, z AS (SELECT chunk_id, max(coalesce(token_count, char_count, length(content)))::BIGINT AS tokens FROM a GROUP BY 1),
it AS (SELECT query_id, list({'used': tokens, 'kept': [chunk_id]} ORDER BY rerank) AS items FROM rr JOIN z USING (chunk_id) WHERE rerank <= 5 GROUP BY 1)"""
_FOLD = "list_reduce(items, lambda acc, x: CASE WHEN acc.used + x.used <= {0} THEN {{'used': acc.used + x.used, 'kept': list_concat(acc.kept, x.kept)}} ELSE acc END, {{'used': 0::BIGINT, 'kept': []::VARCHAR[]}})"


@query("WITH" + RERANKED + "," + ARTICLES + _PACKED + ", b AS (SELECT unnest([200, 400, 600, 800]) AS budget) SELECT budget, sum(len(" + _FOLD.format("budget") + ".kept))::BIGINT AS kept, count(*) AS queries FROM it, b GROUP BY 1")
def context_sweep(t):
    """How many of the top five fit budgets of 200 to 800 tokens."""
    from corvane.operators.retrieval import pack

    size = articles(t).groupBy("chunk_id").agg(F.max(F.coalesce("token_count", "char_count", F.length("content"))).cast("long").alias("tokens"))
    five = reranked(t).filter("rerank <= 5").join(size, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rerank", "chunk_id", "tokens"))).alias("items"))
    each = F.array(*[F.struct(F.lit(b).alias("budget"), F.size(pack(F.col("items"), "tokens", b)["kept"]).alias("kept")) for b in (200, 400, 600, 800)])
    return five.select(F.explode(each).alias("x")).groupBy("x.budget").agg(F.sum("x.kept").alias("kept"), F.count(F.lit(1)).alias("queries"))


@query("WITH " + _H + ", x AS (SELECT id, unnest(evidence_variants) AS v, answer_gt.refuse AS refuse FROM hq) SELECT id, count(*) AS variants, count(*) FILTER (v.answer_gt.refuse IS DISTINCT FROM refuse) AS different FROM x GROUP BY 1 HAVING count(*) FILTER (v.answer_gt.refuse IS DISTINCT FROM refuse) > 0")
def review_disagreements(t):
    x = holdout(t).select("id", F.col("answer_gt.refuse").alias("refuse"), F.explode("evidence_variants").alias("v"))
    return x.groupBy("id").agg(F.count(F.lit(1)).alias("variants"), F.count_if(~F.col("v.answer_gt.refuse").eqNullSafe(F.col("refuse"))).alias("different")).filter("different > 0")


@query("WITH " + _H + ", o AS (SELECT id, row_number() OVER (ORDER BY sha256('review' || chr(0) || id), id) AS k FROM hq) SELECT id, k, least((k - 1) // 20, 7)::BIGINT AS batch FROM o WHERE k <= 158")
def review_batches(t):
    """The first 158 questions in hash order, in seven batches of 20 and the rest."""
    o = S.first_by_hash(holdout(t).select("id"), [], "id", "review", 158)
    return o.select("id", F.col("place").cast("long").alias("k"), F.least(F.floor((F.col("place") - 1) / 20), F.lit(7).cast("long")).alias("batch"))


@query("WITH" + RERANKED + "," + CASES + """, need AS (SELECT query_id, unnest(required) AS chunk_id, len(required) AS n FROM c),
o AS (SELECT rr.query_id, rr.chunk_id, row_number() OVER (PARTITION BY rr.query_id ORDER BY rerank) AS k FROM rr ANTI JOIN need ON need.query_id = rr.query_id AND need.chunk_id = rr.chunk_id),
s AS (SELECT c.query_id, len(required) AS n, count(o.k) FILTER (o.k <= 4 - len(required)) AS fill, count(o.k) FILTER (o.k <= 4) AS bad FROM c LEFT JOIN o USING (query_id) GROUP BY 1, 2)
SELECT query_id, n + fill AS sufficient, bad AS insufficient, n + fill = 4 AND bad = 4 AS usable FROM s""")
def pair_construction(t):
    """For each case a set that suffices (what is required, filled to four) and one that doesn't (four of the others)."""
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"))
    o = reranked(t).join(need, ["query_id", "chunk_id"], "left_anti").withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("rerank"))).filter("k <= 4")
    s = cases(t).select("query_id", F.size("required").alias("n")).join(o, "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.col("k") <= 4 - F.col("n")).alias("fill"), F.count_if(F.col("k") <= 4).alias("bad"))
    return s.select("query_id", (F.col("n") + F.col("fill")).alias("sufficient"), F.col("bad").alias("insufficient"), ((F.col("n") + F.col("fill") == 4) & (F.col("bad") == 4)).alias("usable"))


@query("WITH " + _P + ", g AS (SELECT DISTINCT plan_group FROM pl), s AS (SELECT DISTINCT subset_seed FROM pl) SELECT g.plan_group, s.subset_seed, count(pl.plan_id) AS trials FROM g CROSS JOIN s LEFT JOIN pl ON pl.plan_group = g.plan_group AND pl.subset_seed = s.subset_seed GROUP BY 1, 2")
def trial_coverage(t):
    """Trials of every group and seed, none where there is none."""
    p = plans(t)
    want = p.select("plan_group").distinct().crossJoin(p.select("subset_seed").distinct())
    return want.join(p.select("plan_group", "subset_seed", "plan_id"), ["plan_group", "subset_seed"], "left").groupBy("plan_group", "subset_seed").agg(F.count("plan_id").alias("trials"))


@query("WITH " + _P + "SELECT subset_seed, count(DISTINCT plan_group) AS groups, list_has_all(list(DISTINCT plan_group), ['clean_even', 'clean_double']) AS covered FROM pl GROUP BY 1")
def lr_group_coverage(t):
    both = F.size(F.array_intersect(F.collect_set("plan_group"), F.array(F.lit("clean_even"), F.lit("clean_double")))) == 2
    return plans(t).groupBy("subset_seed").agg(F.count_distinct("plan_group").alias("groups"), both.alias("covered"))


@query("WITH " + _P + "SELECT plan_group, pool_no, string_agg(plan_id || ':' || clean_count, '>' ORDER BY plan_id) AS chain FROM pl GROUP BY 1, 2")
def chain_compile(t):
    x = F.transform(F.array_sort(F.collect_list(F.struct("plan_id", "clean_count"))), lambda p: F.concat_ws(":", p["plan_id"], p["clean_count"]))
    return plans(t).groupBy("plan_group", "pool_no").agg(F.array_join(x, ">").alias("chain"))


@query("WITH " + _P + ", x AS (SELECT plan_id, pool_no, hard_negative_count IS NULL AS missing, bool_or(hard_negative_count IS NULL) OVER (PARTITION BY pool_no ORDER BY plan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM pl) SELECT plan_id, pool_no FROM x WHERE NOT missing AND gap")
def chain_no_gap(t):
    """Trials that have a result although an earlier one of their chain has none."""
    w = W.partitionBy("pool_no").orderBy("plan_id").rowsBetween(W.unboundedPreceding, -1)
    x = plans(t).withColumn("missing", F.col("hard_negative_count").isNull()).withColumn("gap", F.max("missing").over(w))
    return x.filter("not missing and gap").select("plan_id", "pool_no")


@query("WITH " + _R + "SELECT id, row_number() OVER (ORDER BY sha256('43' || chr(0) || id), id) - 1 AS position FROM r")
def deterministic_shuffle(t, start: int = 0):
    """All records with their position, from 0, in the order of a seeded hash; a resumed run takes those from start on.

    The hash's first digits are buckets in that order. Only rows of one bucket are sorted together; counts of the buckets
    before give the offset.
    """
    r = train(t).select("id", S.hash_key("43", "id").alias("h")).withColumn("b", F.substring("h", 1, 3))
    before = F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = r.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", before.alias("offset"))  # at most 4,096 rows
    placed = r.withColumn("place", F.row_number().over(W.partitionBy("b").orderBy("h", "id"))).join(offsets, "b")
    return placed.select("id", (F.col("offset") + F.col("place") - 1).cast("long").alias("position")).filter(F.col("position") >= start)


@query("WITH " + _R + "SELECT id, len(visible_chunk_ids) AS n, array_to_string(list_resize(visible_chunk_ids, 6, '<pad>'), '|') AS padded FROM r")
def pad_sequence(t):
    return train(t).select("id", F.size("visible_chunk_ids").cast("long").alias("n"), F.array_join(F.slice(F.concat("visible_chunk_ids", F.array_repeat(F.lit("<pad>"), 6)), 1, 6), "|").alias("padded"))


@query("WITH y AS (SELECT unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS p FROM documents WHERE text IS NOT NULL) SELECT p AS pair, count(*) AS n FROM y GROUP BY 1")
def pair_counts(t):
    """Neighbouring signs of the whole corpus, all of them: counted by batch in NumPy before the exchange."""
    from corvane.operators.corpus import pair_counts as count

    return count(t("documents"), "text")


@query("WITH " + _H + ", x AS (SELECT id, unnest(answer_gt.quotes).chunk_id AS c, generate_subscripts(answer_gt.quotes, 1) AS k FROM hq) SELECT id, string_agg(c, '|' ORDER BY k) AS derived FROM (SELECT id, c, min(k) AS k FROM x GROUP BY 1, 2) GROUP BY 1")
def derive_required_gt(t):
    """Required ids in the order in which quotes first support them."""
    return holdout(t).filter("size(answer_gt.quotes) > 0").select("id", F.array_join(F.array_distinct("answer_gt.quotes.chunk_id"), "|").alias("derived"))


@query("WITH " + _R + "SELECT id, len(visible_chunk_ids) > len(required_chunk_ids) AS wider, len(list_intersect(visible_chunk_ids, required_chunk_ids)) = len(required_chunk_ids) AS holds FROM r WHERE v = 'hard_negative'")
def hn_variant_contract(t):
    r = train(t).filter(variant() == "hard_negative")
    return r.select("id", (F.size("visible_chunk_ids") > F.size("required_chunk_ids")).alias("wider"), (F.size(F.array_intersect("visible_chunk_ids", "required_chunk_ids")) == F.size("required_chunk_ids")).alias("holds"))


@query("WITH " + _H + "SELECT id, answerable = (unanswerable_reason IS NULL) AS reasoned, query_formal IS NULL OR query_formal <> query_original AS reworded FROM hq")
def authoring_rules(t):
    return holdout(t).select("id", (F.col("answerable") == F.col("unanswerable_reason").isNull()).alias("reasoned"), (F.col("query_formal").isNull() | (F.col("query_formal") != F.col("query_original"))).alias("reworded"))


def match_nearest(group: pd.DataFrame) -> pd.DataFrame:
    """Of one pool (v, id, n): each hard negative, in order of id, with the free clean record nearest by n, and next by id.

    Free records lie in lists by n. Lists that are used up are skipped by links to the next one on either side, which are
    shortened as they are followed; so a choice costs about the same however large the pool is.
    """
    ordered = group.sort_values("id")
    clean, hard = ordered[ordered.v == "clean"], ordered[ordered.v == "hard_negative"]
    free = {n: list(reversed(ids)) for n, ids in clean.groupby("n").id.agg(list).items()}
    sizes = sorted(free)
    down, up = list(range(len(sizes) + 1)), list(range(len(sizes) + 1))  # down is shifted by one: 0 is below all, as up's last is above all

    def follow(links: list[int], k: int) -> int:
        end = k
        while links[end] != end:
            end = links[end]
        while links[k] != end:
            links[k], k = end, links[k]
        return end

    out = []
    for id_, n in zip(hard.id, hard.n):
        at = bisect_left(sizes, n)
        low, high = follow(down, at) - 1, follow(up, at)
        near = [(abs(sizes[k] - n), free[sizes[k]][-1], k) for k in (low, high) if 0 <= k < len(sizes)]
        if not near:
            break
        distance, control, k = min(near)
        free[sizes[k]].pop()
        if not free[sizes[k]]:
            down[k + 1], up[k] = k, k + 1
        out.append((id_, control, distance))
    return pd.DataFrame(out, columns=["id", "control", "distance"])


@query()
def greedy_matched_controls(t):
    """To each hard negative of a pool, in order of id, the clean record nearest in length, and next by id, that isn't taken yet.

    Each choice depends on those before it, so a pool is one task's work; it holds ids and lengths only.
    """
    r = train(t).select("pool_no", "id", variant().alias("v"), F.length("query_original").alias("n")).filter("v in ('clean', 'hard_negative') and n is not null")
    return r.groupBy("pool_no").applyInPandas(match_nearest, "id string, control string, distance int")


@query("WITH " + _R + """, x AS (SELECT v, json_valid(conversations[3].content) AS valid, list_distinct(required_chunk_ids) AS req, list_distinct(list_filter(list_transform(citations, lambda c: visible_chunk_ids[CAST(substr(c, 2) AS INTEGER)]), lambda c: c IS NOT NULL)) AS cited, list_filter(visible_chunk_ids, lambda c: NOT list_contains(required_chunk_ids, c)) AS hard FROM r),
y AS (SELECT *, len(list_intersect(req, cited)) AS found, len(list_intersect(hard, cited)) AS tempted FROM x)
SELECT v, count(*) AS records, count(*) FILTER (valid) AS protocol_valid, count(*) FILTER (NOT valid) AS invalid, round(avg(CASE WHEN len(req) > 0 THEN found / len(req) ELSE 0 END), 6) AS recall, round(avg(CASE WHEN len(cited) > 0 THEN found / len(cited) ELSE 0 END), 6) AS precision,
round(avg((found = len(req) AND len(cited) = len(req))::INT), 6) AS exact_set, sum(tempted)::BIGINT AS hard_citations, coalesce(round(count(*) FILTER (tempted > 0) / nullif(count(*) FILTER (len(hard) > 0), 0), 6), 0) AS hard_rate, sum(greatest(len(cited) - len(req), 0))::BIGINT AS over_citations FROM y GROUP BY 1""")
def answer_summary_metrics(t):
    """Records, protocol, citations and hard negatives cited, by variant; rates over records that have any."""
    cited = F.array_distinct(F.array_compact(F.transform("citations", lambda c: F.get("visible_chunk_ids", F.substring(c, 2, 9).cast("int") - 1))))
    x = train(t).select(variant().alias("v"), F.try_parse_json(F.col("conversations")[2]["content"]).isNotNull().alias("valid"), F.array_distinct("required_chunk_ids").alias("req"), cited.alias("cited"), F.array_except("visible_chunk_ids", "required_chunk_ids").alias("hard"))
    y = x.withColumns({"found": F.size(F.array_intersect("req", "cited")), "tempted": F.size(F.array_intersect("hard", "cited"))})
    part = lambda of: F.coalesce(F.try_divide(F.col("found"), F.size(of)), F.lit(0.0))
    exact = (F.col("found") == F.size("req")) & (F.size("cited") == F.size("req"))
    return y.groupBy("v").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("valid").alias("protocol_valid"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.avg(part("req")), 6).alias("recall"), F.round(F.avg(part("cited")), 6).alias("precision"), F.round(F.avg(exact.cast("int")), 6).alias("exact_set"),
        F.sum("tempted").alias("hard_citations"), F.coalesce(F.round(F.try_divide(F.count_if(F.col("tempted") > 0), F.count_if(F.size("hard") > 0)), 6), F.lit(0.0)).alias("hard_rate"), F.sum(F.greatest(F.size("cited") - F.size("req"), F.lit(0))).alias("over_citations"),
    )


@query("WITH " + _P + """, x AS (SELECT plan_group, pool_no % 2 AS phase, subset_seed, unnest(['clean', 'hard', 'paired']) AS metric, unnest([clean_count, coalesce(hard_negative_count, 0), paired_clean_count])::DOUBLE AS v, plan_id FROM pl),
s AS (SELECT plan_group, phase, metric, subset_seed, avg(v) AS m, count(*) AS n FROM x GROUP BY 1, 2, 3, 4), g AS (SELECT plan_group, phase, metric, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM x GROUP BY 1, 2, 3)
SELECT g.*, by_seed, consistent FROM g JOIN (SELECT plan_group, phase, metric, string_agg(subset_seed || ':' || CAST(round(m, 2) AS DECIMAL(12, 2)), '|' ORDER BY subset_seed) AS by_seed, count(DISTINCT n) = 1 AS consistent FROM s GROUP BY 1, 2, 3) b USING (plan_group, phase, metric)""")
def trial_metric_rollup(t):
    """Mean, least and most of each metric by group and phase, the means by seed, and whether all seeds have as many trials."""
    each = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v")) for n, c in (("clean", F.col("clean_count")), ("hard", F.coalesce("hard_negative_count", F.lit(0))), ("paired", F.col("paired_clean_count")))])
    x = plans(t).select("plan_group", (F.col("pool_no") % 2).alias("phase"), "subset_seed", F.explode(each).alias("x")).select("plan_group", "phase", "subset_seed", "x.*")
    s = x.groupBy("plan_group", "phase", "metric", "subset_seed").agg(F.sum("v").alias("sum"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    seeds = F.transform(F.array_sort(F.collect_list(F.struct("subset_seed", (F.col("sum") / F.col("n")).alias("m")))), lambda p: F.concat(p["subset_seed"].cast("string"), F.lit(":"), F.round(p["m"], 2).cast("decimal(12,2)").cast("string")))
    return s.groupBy("plan_group", "phase", "metric").agg(F.round(F.sum("sum") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_join(seeds, "|").alias("by_seed"), (F.count_distinct("n") == 1).alias("consistent"))


_UNITS = "u AS (SELECT DISTINCT ON (unit_id) unit_id, parent_chunk_id, text, start_char FROM evidence_unit)"
_UNIT_HITS = FUSED + ", " + _UNITS + """, cq AS (SELECT DISTINCT query_id, query_type, list_distinct(list_transform(range(1, length(query_original)), lambda i: substr(query_original, i, 2))) AS q FROM evaluation_case),
uh AS (SELECT p.query_id, cq.query_type, u.parent_chunk_id, u.unit_id, p.rank, u.start_char, round(len(list_filter(q, lambda x: contains(u.text, x))) / len(q), 6) AS score FROM p JOIN u ON u.parent_chunk_id = p.chunk_id JOIN cq ON cq.query_id = p.query_id),
ur AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_chunk_id ORDER BY score DESC, start_char, unit_id) AS n FROM uh)"""


def unit_hits(t):
    """The units of the pool's parents with their score for the question, and their place within the parent."""
    from corvane.operators.scoring import coverage

    q = one_per_key(t("evaluation_case"), "query_id").select("query_id", "query_type", "query_original")
    u = one_per_key(t("evidence_unit"), "unit_id").select("unit_id", "parent_chunk_id", "text", "start_char")
    x = pool(t).select("query_id", F.col("chunk_id").alias("parent_chunk_id"), "rank").join(q, "query_id").join(u, "parent_chunk_id").withColumn("score", F.round(coverage(F.col("query_original"), F.col("text")), 6))
    order = W.partitionBy("query_id", "parent_chunk_id").orderBy(F.desc("score"), "start_char", "unit_id")
    return x.withColumn("n", F.row_number().over(order)).select("query_id", "query_type", "parent_chunk_id", "unit_id", "rank", "start_char", "score", "n")


@query("WITH" + _UNIT_HITS + " SELECT query_id, parent_chunk_id, unit_id, score, n AS place FROM ur WHERE n <= 2")
def unit_seeds(t):
    """The two units of each parent that answer best: by score, then by place in the article."""
    return unit_hits(t).filter("n <= 2").select("query_id", "parent_chunk_id", "unit_id", "score", F.col("n").cast("long").alias("place"))


@query("WITH" + _UNIT_HITS + " SELECT query_id, parent_chunk_id, min(rank) AS rank, max(score) AS score, count(*) AS n_units, string_agg(unit_id, '|' ORDER BY n) AS units FROM ur WHERE n <= 3 GROUP BY 1, 2")
def parent_rollup(t):
    """The pool's parents with up to three of their units; rank and score are those of the best, with no bonus for many units."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "unit_id"))), lambda s: s["unit_id"])
    x = unit_hits(t).filter("n <= 3").groupBy("query_id", "parent_chunk_id")
    return x.agg(F.min("rank").cast("long").alias("rank"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_units"), F.array_join(listed, "|").alias("units"))


@query("WITH" + _UNIT_HITS + """, g AS (SELECT query_type, parent_chunk_id, round(sum(DISTINCT_RR), 6) AS score FROM (SELECT query_type, parent_chunk_id, query_id, 1.0 / (4.0 + min(rank)) AS DISTINCT_RR FROM ur GROUP BY 1, 2, 3) GROUP BY 1, 2),
f AS (SELECT query_type, parent_chunk_id, unit_id, min({'q': query_id, 'n': n}) AS seen FROM ur WHERE n <= 3 GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY query_type, parent_chunk_id ORDER BY seen) AS k FROM f)
SELECT g.query_type, g.parent_chunk_id, g.score, string_agg(unit_id, '|' ORDER BY k) AS units FROM g JOIN o ON o.query_type = g.query_type AND o.parent_chunk_id = g.parent_chunk_id WHERE k <= 3 GROUP BY 1, 2, 3""".replace("f AS (SELECT query_type", "fs AS (SELECT query_type").replace("FROM f)", "FROM fs)"))
def multi_query_parent_rrf(t):
    """Parents over the lists of all questions of a kind, with up to three distinct units in the order in which they were first seen."""
    x = unit_hits(t)
    g = x.groupBy("query_type", "parent_chunk_id", "query_id").agg((1.0 / (4.0 + F.min("rank"))).alias("rr")).groupBy("query_type", "parent_chunk_id").agg(F.round(F.sum("rr"), 6).alias("score"))
    f = x.filter("n <= 3").groupBy("query_type", "parent_chunk_id", "unit_id").agg(F.min(F.struct("query_id", "n")).alias("seen"))
    o = f.withColumn("k", F.row_number().over(W.partitionBy("query_type", "parent_chunk_id").orderBy("seen"))).filter("k <= 3")
    units = o.groupBy("query_type", "parent_chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "unit_id"))), lambda s: s["unit_id"]), "|").alias("units"))
    return g.join(units, ["query_type", "parent_chunk_id"]).select("query_type", "parent_chunk_id", "score", "units")


@query("WITH" + FUSED + "," + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id, len(required) AS n FROM c), md AS (SELECT leg AS mode, query_id, chunk_id, rank FROM l UNION ALL SELECT 'fused', query_id, chunk_id, rank FROM p),
ms AS (SELECT unnest(['dense', 'sparse', 'fused']) AS mode), h AS (SELECT ms.mode, q.query_id, any_value(n) AS n, count(*) FILTER (md.rank <= 5) AS hit, count(md.rank) AS pool, min(md.rank) AS first FROM q CROSS JOIN ms LEFT JOIN md ON md.mode = ms.mode AND md.query_id = q.query_id AND md.chunk_id = q.chunk_id GROUP BY 1, 2)
SELECT mode, count(*) AS cases, round(avg(hit / n), 6) AS recall5, round(avg((hit = n)::INT), 6) AS complete5, round(avg((pool = n)::INT), 6) AS in_pool, round(avg(coalesce(CASE WHEN first <= 5 THEN 1.0 / first END, 0)), 6) AS mrr5 FROM h GROUP BY 1""".replace("h AS (SELECT ms.mode", "hm AS (SELECT ms.mode").replace("FROM h GROUP BY 1", "FROM hm GROUP BY 1"))
def mode_summary(t):
    """Recall, completeness and reciprocal rank of each mode: both legs and their fusion."""
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"), F.size("required").alias("n"))
    need = need.select("*", F.explode(F.array(*[F.lit(m) for m in ("dense", "sparse", "fused")])).alias("mode"))
    lists = legs(t).select(F.col("leg").alias("mode"), "query_id", "chunk_id", "rank").unionByName(pool(t).select(F.lit("fused").alias("mode"), "query_id", "chunk_id", "rank"))
    h = need.join(lists, ["mode", "query_id", "chunk_id"], "left").groupBy("mode", "query_id").agg(F.first("n").alias("n"), F.count_if(F.col("rank") <= 5).alias("hit"), F.count("rank").alias("pool"), F.min("rank").alias("first"))
    rr = F.coalesce(F.when(F.col("first") <= 5, 1.0 / F.col("first")), F.lit(0.0))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return h.groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), mean(F.col("hit") / F.col("n"), "recall5"), mean((F.col("hit") == F.col("n")).cast("int"), "complete5"), mean((F.col("pool") == F.col("n")).cast("int"), "in_pool"), mean(rr, "mrr5"))


@query("WITH " + _H + """, v AS (SELECT difficulty, v.variant_type AS kind, v.answer_gt.refuse AS refuse, len(v.answer_gt.quotes) AS quotes, len(v.answer_gt.cited_chunk_ids) AS cited FROM (SELECT difficulty, unnest(evidence_variants) AS v FROM hq))
SELECT difficulty, (SELECT count(*) FROM hq WHERE hq.difficulty = d.difficulty) AS records, (SELECT count(*) FILTER (review_status = 'approved') FROM hq WHERE hq.difficulty = d.difficulty) AS approved, count(v.kind) AS variants, count(*) FILTER (kind = 'partial_evidence') AS partial,
round(count(*) FILTER (refuse) / nullif(count(v.kind), 0), 6) AS refusal_rate, round(count(*) FILTER (NOT refuse AND quotes >= cited) / nullif(count(*) FILTER (NOT refuse), 0), 6) AS quoted_rate FROM (SELECT DISTINCT difficulty FROM hq) d LEFT JOIN v USING (difficulty) GROUP BY 1""")
def review_metric_summary(t):
    """Counts of records and variants by difficulty, and rates over the variants' answers; null where there is nothing to count."""
    h = holdout(t)
    var = F.coalesce("evidence_variants", F.array().cast(h.schema["evidence_variants"].dataType))
    n = lambda ok: F.sum(F.size(F.filter(var, ok)))
    told = lambda v: ~v["answer_gt"]["refuse"]
    every = F.sum(F.size(var))
    return h.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("review_status") == "approved").alias("approved"), every.alias("variants"), n(lambda v: v["variant_type"] == "partial_evidence").alias("partial"),
        F.round(F.try_divide(n(lambda v: v["answer_gt"]["refuse"]), every), 6).alias("refusal_rate"),
        F.round(F.try_divide(n(lambda v: told(v) & (F.size(v["answer_gt"]["quotes"]) >= F.size(v["answer_gt"]["cited_chunk_ids"]))), n(told)), 6).alias("quoted_rate"),
    )
