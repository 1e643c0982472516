"""Queries of contracts: rules of reserved records, reviews, gates, closed schemas, logs of runs and traces, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.operators import logs
from corvane.operators.prefix import running_total
from corvane.plans.answers import holdout, train
from corvane.plans.base import CASES, LEGS, cases, legs, registry
from corvane.runtime import one_per_key

QUERIES, query = registry()
_H = "hq AS (SELECT DISTINCT ON (id) * FROM private_holdout)"
_R = "r AS (SELECT DISTINCT ON (id) * FROM sft_candidate)"

# The closed sets of the record contract.
TYPES = ("semantic_search", "exact_lookup", "scenario_advice", "cross_law", "irrelevant")
DIFFICULTIES = ("easy", "medium", "hard", "boundary", "unanswerable")
STATES, REASONS, VARIANTS = ("draft", "approved", "rejected"), ("irrelevant", "missing_article", "out_of_scope", "ambiguous"), ("partial_evidence", "irrelevant_evidence")
#: A batch of new drafts, the most records there may be, and what a frozen set holds.
BATCH, MOST = 20, 100
FROZEN = {("answerable", "true"): 80, ("answerable", "false"): 20, ("status", "approved"): 100}


_S = "retrieval_gt.required_chunk_ids"
_IN = lambda values: "(" + ", ".join(repr(v) for v in values) + ")"


def _variants_sql(kind: str, sql: str) -> str:
    return f"len(list_filter(evidence_variants, lambda v: v.variant_type = '{kind}' AND NOT coalesce({sql}, false))) = 0"


#: Rules of a reserved record in SQL. Null counts as broken.
RULES_SQL = {
    **{c: f"trim({c}) <> ''" for c in ("id", "query_original", "query_formal", "department")},
    "query_type": f"query_type IN {_IN(TYPES)}", "answerable": "answerable IS NOT NULL", "difficulty": f"difficulty IN {_IN(DIFFICULTIES)}", "gt_tool_calls": "gt_tool_calls >= 0",
    "review_status": f"review_status IN {_IN(STATES)}", "review_notes": "review_notes IS NOT NULL", "required_once": f"len(list_distinct({_S})) = len({_S})",
    "lookup_of_one": f"NOT (answerable AND query_type = 'exact_lookup') OR len({_S}) = 1", "lookup_is_easy": "NOT (answerable AND query_type = 'exact_lookup') OR difficulty = 'easy'",
    "answer_without_reason": "NOT answerable OR unanswerable_reason IS NULL", "answer_with_evidence": f"NOT answerable OR (len({_S}) > 0 AND trim(answer_gt.summary) <> '' AND NOT answer_gt.refuse)",
    "answer_cites_all": f"NOT answerable OR (answer_gt.cited_chunk_ids = {_S} AND len(answer_gt.quotes) > 0)", "answer_calls": "NOT answerable OR (difficulty <> 'unanswerable' AND gt_tool_calls >= 1)",
    "refusal_reason": f"answerable OR unanswerable_reason IN {_IN(REASONS)}", "refusal_calls": "answerable OR (difficulty = 'unanswerable' AND gt_tool_calls = 0)",
    "refusal_is_empty": f"answerable OR (len({_S}) = 0 AND answer_gt.summary = '' AND len(answer_gt.cited_chunk_ids) = 0 AND len(answer_gt.quotes) = 0 AND answer_gt.refuse)",
    "irrelevant_type": "unanswerable_reason IS DISTINCT FROM 'irrelevant' OR query_type = 'irrelevant'", "missing_article_type": "unanswerable_reason IS DISTINCT FROM 'missing_article' OR query_type = 'exact_lookup'",
    "quotes_of_required": f"len(list_filter(answer_gt.quotes, lambda q: NOT list_contains({_S}, q.chunk_id))) = 0", "quotes_with_text": "len(list_filter(answer_gt.quotes, lambda q: NOT coalesce(trim(q.text) <> '', false))) = 0",
    "variants_of_answers": "len(evidence_variants) = 0 OR answerable", "variant_ids": "len(list_distinct(list_transform(evidence_variants, lambda v: v.id))) = len(evidence_variants)",
    "variant_type": f"len(list_filter(evidence_variants, lambda v: NOT coalesce(v.variant_type IN {_IN(VARIANTS)}, false))) = 0", "variant_evidence": "len(list_filter(evidence_variants, lambda v: NOT coalesce(len(v.ordered_chunk_ids) > 0, false))) = 0",
    "irrelevant_variant": _variants_sql("irrelevant_evidence", f"len(list_intersect(v.ordered_chunk_ids, {_S})) = 0 AND v.answer_gt.summary = '' AND len(v.answer_gt.cited_chunk_ids) = 0 AND len(v.answer_gt.quotes) = 0 AND v.answer_gt.refuse"),
    "partial_variant": _variants_sql("partial_evidence", f"len(list_intersect(v.ordered_chunk_ids, {_S})) BETWEEN 1 AND len(list_distinct({_S})) - 1"),
    "partial_answer": _variants_sql("partial_evidence", f"trim(v.answer_gt.summary) <> '' AND NOT v.answer_gt.refuse AND v.answer_gt.cited_chunk_ids = list_filter(v.ordered_chunk_ids, lambda x: list_contains({_S}, x)) AND len(v.answer_gt.quotes) > 0"),
    "partial_quotes": _variants_sql("partial_evidence", "list_sort(list_distinct(list_transform(v.answer_gt.quotes, lambda q: q.chunk_id))) = list_sort(list_distinct(v.answer_gt.cited_chunk_ids))"),
}


def rules() -> dict:
    """The same rules as conditions on the record's columns."""
    full = lambda c: F.trim(c) != ""
    ans, req, cited, quotes = F.col("answerable"), F.col("retrieval_gt.required_chunk_ids"), F.col("answer_gt.cited_chunk_ids"), F.col("answer_gt.quotes")
    summary, refuse, var, calls = F.col("answer_gt.summary"), F.col("answer_gt.refuse"), F.col("evidence_variants"), F.col("gt_tool_calls")
    kind, reason, level = F.col("query_type"), F.col("unanswerable_reason"), F.col("difficulty")
    lookup, none = ans & (kind == "exact_lookup"), lambda a: F.size(a) == 0
    held = lambda v: F.array_intersect(v["ordered_chunk_ids"], req)
    of = lambda name, ok: F.forall(var, lambda v: (v["variant_type"] != name) | F.coalesce(ok(v, v["answer_gt"]), F.lit(False)))
    ids = lambda a: F.array_sort(F.array_distinct(a))
    return {
        **{c: full(c) for c in ("id", "query_original", "query_formal", "department")},
        "query_type": kind.isin(*TYPES), "answerable": ans.isNotNull(), "difficulty": level.isin(*DIFFICULTIES), "gt_tool_calls": calls >= 0, "review_status": F.col("review_status").isin(*STATES), "review_notes": F.col("review_notes").isNotNull(),
        "required_once": F.size(F.array_distinct(req)) == F.size(req), "lookup_of_one": ~lookup | (F.size(req) == 1), "lookup_is_easy": ~lookup | (level == "easy"), "answer_without_reason": ~ans | reason.isNull(),
        "answer_with_evidence": ~ans | (~none(req) & full(summary) & ~refuse), "answer_cites_all": ~ans | ((cited == req) & ~none(quotes)), "answer_calls": ~ans | ((level != "unanswerable") & (calls >= 1)),
        "refusal_reason": ans | reason.isin(*REASONS), "refusal_calls": ans | ((level == "unanswerable") & (calls == 0)), "refusal_is_empty": ans | (none(req) & (summary == "") & none(cited) & none(quotes) & refuse),
        "irrelevant_type": ~reason.eqNullSafe("irrelevant") | (kind == "irrelevant"), "missing_article_type": ~reason.eqNullSafe("missing_article") | (kind == "exact_lookup"),
        "quotes_of_required": F.forall(quotes, lambda q: F.array_contains(req, q["chunk_id"])), "quotes_with_text": F.forall(quotes, lambda q: F.coalesce(full(q["text"]), F.lit(False))),
        "variants_of_answers": none(var) | ans, "variant_ids": F.size(F.array_distinct(var["id"])) == F.size(var), "variant_type": F.forall(var, lambda v: F.coalesce(v["variant_type"].isin(*VARIANTS), F.lit(False))),
        "variant_evidence": F.forall(var, lambda v: F.coalesce(~none(v["ordered_chunk_ids"]), F.lit(False))),
        "irrelevant_variant": of("irrelevant_evidence", lambda v, a: none(held(v)) & (a["summary"] == "") & none(a["cited_chunk_ids"]) & none(a["quotes"]) & a["refuse"]),
        "partial_variant": of("partial_evidence", lambda v, a: ~none(held(v)) & (F.size(held(v)) < F.size(F.array_distinct(req)))),
        "partial_answer": of("partial_evidence", lambda v, a: full(a["summary"]) & ~a["refuse"] & (a["cited_chunk_ids"] == F.filter(v["ordered_chunk_ids"], lambda x: F.array_contains(req, x))) & ~none(a["quotes"])),
        "partial_quotes": of("partial_evidence", lambda v, a: ids(a["quotes"]["chunk_id"]) == ids(a["cited_chunk_ids"])),
    }


def broken(df: DataFrame) -> DataFrame:
    """df with broken: the names of the rules that a record breaks, in order."""
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules().items()])))


_BROKEN = _H + ", br AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({sql}, false) THEN '{name}' END" for name, sql in RULES_SQL.items()) + "], lambda x: x IS NOT NULL) AS broken FROM hq)"


@query(f"WITH {_BROKEN}, n AS (SELECT unnest([{', '.join(repr(k) for k in RULES_SQL)}]) AS rule), u AS (SELECT id, unnest(broken) AS rule FROM br) SELECT rule, count(u.id) AS broken, min(u.id) AS first_id FROM n LEFT JOIN u USING (rule) GROUP BY 1")
def holdout_rules(t):
    """Of each rule of a reserved record how many break it, none included: one pass, counted before the exchange."""
    h = holdout(t)
    aggs = [x for name, ok in rules().items() for x in (F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"n_{name}"), F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col("id"))).alias(f"i_{name}"))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"n_{n}").alias("broken"), F.col(f"i_{n}").alias("first_id")) for n in RULES_SQL])).alias("x")
    return h.agg(*aggs).select(each).select("x.*")


@query(f"WITH {_BROKEN} SELECT id, array_to_string(broken, '|') AS broken, (review_status = 'approved') = (len(broken) = 0) AS consistent, review_status = 'approved' OR coalesce(trim(review_notes), '') <> '' AS justified FROM br")
def review_pass_iff(t):
    """Whether a record is approved just if it keeps all rules, and whether one that isn't approved says why."""
    b, ok = broken(holdout(t)), F.col("review_status") == "approved"
    return b.select("id", F.array_join("broken", "|").alias("broken"), (ok == (F.size("broken") == 0)).alias("consistent"), (ok | (F.coalesce(F.trim("review_notes"), F.lit("")) != "")).alias("justified"))


@query(f"""WITH {_BROKEN}, x AS (SELECT id, CASE WHEN review_status = 'approved' THEN 'pass' ELSE 'fail' END AS first, CASE WHEN substr(sha256('42:' || id), 1, 1) IN ('0', '1', '2') THEN CASE WHEN len(broken) = 0 THEN 'pass' ELSE 'fail' END END AS second FROM br)
SELECT id, first, second, CASE WHEN second IS NULL OR first = second THEN first ELSE 'escalate' END AS final FROM x""")
def review_final_merge(t):
    """The first review of each record, a second one of a hash sample of three sixteenths, and what both come to."""
    sampled = F.substring(F.sha2(F.concat(F.lit("42:"), "id"), 256), 1, 1).isin("0", "1", "2")
    x = broken(holdout(t)).select("id", F.when(F.col("review_status") == "approved", "pass").otherwise("fail").alias("first"), F.when(sampled, F.when(F.size("broken") == 0, "pass").otherwise("fail")).alias("second"))
    return x.withColumn("final", F.when(F.col("second").isNull() | (F.col("first") == F.col("second")), F.col("first")).otherwise("escalate"))


@query(f"""WITH {_H}, b AS (SELECT CAST(substr(id, 2) AS BIGINT) // {BATCH} AS batch, count(*) AS n, count(*) FILTER (review_status = 'draft') AS drafts, count(*) FILTER (review_status = 'approved') AS approved FROM hq GROUP BY 1),
e AS (SELECT *, coalesce(sum(n) OVER w, 0) AS before, coalesce(sum(approved) OVER w, 0) AS approved_before FROM b WINDOW w AS (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT batch, n, drafts, before::BIGINT AS before, CASE WHEN n <> {BATCH} THEN 'size' WHEN drafts <> n THEN 'not_draft' WHEN approved_before <> before THEN 'open_before' WHEN before + n > {MOST} THEN 'too_many' ELSE 'append' END AS decision FROM e""")
def append_gate(t):
    """Batches of records, by number: one may be appended if it holds just so many drafts, all before it are approved, and
    there don't get too many. Totals before a batch go by spans of batches, so no task orders them all."""
    state = F.col("review_status")
    b = holdout(t).groupBy(F.floor(F.substring("id", 2, 20).cast("long") / BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(state == "draft").alias("drafts"), F.count_if(state == "approved").alias("approved"))
    e = running_total(running_total(b, [], "batch", "n", "upto", 4096), [], "batch", "approved", "approved_upto", 4096).withColumn("before", F.col("upto") - F.col("n"))
    why = F.when(F.col("n") != BATCH, "size").when(F.col("drafts") != F.col("n"), "not_draft").when(F.col("approved_upto") - F.col("approved") != F.col("before"), "open_before").when(F.col("before") + F.col("n") > MOST, "too_many")
    return e.select("batch", "n", "drafts", "before", why.otherwise("append").alias("decision"))


@query(f"WITH {_H}, c AS (SELECT 'answerable' AS kind, answerable::VARCHAR AS value, count(*) AS n FROM hq GROUP BY 2 UNION ALL SELECT 'status', review_status, count(*) FROM hq GROUP BY 2), f AS (SELECT unnest([{', '.join(repr(k[0]) for k in FROZEN)}]) AS kind, unnest([{', '.join(repr(k[1]) for k in FROZEN)}]) AS value, unnest([{', '.join(str(v) for v in FROZEN.values())}]) AS target) SELECT kind, value, coalesce(n, 0) AS n, target, n IS NOT DISTINCT FROM target AS met FROM c FULL JOIN f USING (kind, value)")
def freeze_gate(t):
    """What a frozen set must hold beside what there is; a value without a target isn't met."""
    h = holdout(t)
    count = lambda kind, c: h.groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    want = h.sparkSession.createDataFrame([(k, v, n) for (k, v), n in FROZEN.items()], "kind string, value string, target int")
    x = count("answerable", F.col("answerable")).unionByName(count("status", F.col("review_status"))).join(want, ["kind", "value"], "full")
    return x.select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"), "target", F.col("n").eqNullSafe(F.col("target")).alias("met"))


@query(f"""WITH {_H} SELECT id, CASE WHEN review_status <> 'approved' THEN 'adjust' WHEN answerable THEN 'accept' ELSE 'clarify' END AS decision,
CASE WHEN review_status <> 'approved' THEN coalesce(trim(review_notes), '') <> '' WHEN answerable THEN unanswerable_reason IS NULL AND len(answer_gt.cited_chunk_ids) > 0 ELSE unanswerable_reason IS NOT NULL AND len(answer_gt.cited_chunk_ids) = 0 END AS valid FROM hq""")
def review_decision_validate(t):
    """The decision on each record, and whether its fields go with it: accept needs citations and no reason, clarify a reason
    and no citations, adjust a note."""
    open_, ans, n = F.col("review_status") != "approved", F.col("answerable"), F.size("answer_gt.cited_chunk_ids")
    reason = F.col("unanswerable_reason")
    valid = F.when(open_, F.coalesce(F.trim("review_notes"), F.lit("")) != "").when(ans, reason.isNull() & (n > 0)).otherwise(reason.isNotNull() & (n == 0))
    return holdout(t).select("id", F.when(open_, "adjust").when(ans, "accept").otherwise("clarify").alias("decision"), valid.alias("valid"))


_KEYS = {"user": (1, ("query", "evidence")), "assistant": (2, ("summary", "citations"))}


@query(f"WITH {_R}, k AS (" + " UNION ALL ".join(f"SELECT id, '{role}' AS role, json_keys(CASE WHEN json_valid(conversations[{at + 1}].content) THEN conversations[{at + 1}].content END) AS k, {list(keys)!r} AS want FROM r" for role, (at, keys) in _KEYS.items())
       + ") SELECT id, role, array_to_string(list_sort(list_filter(want, lambda x: NOT coalesce(list_contains(k, x), false))), '|') AS missing, array_to_string(list_sort(list_filter(coalesce(k, []), lambda x: NOT list_contains(want, x))), '|') AS extra, coalesce(len(k) = len(want) AND list_has_all(want, k), false) AS closed FROM k")
def closed_schema_check(t):
    """The fields of each message's object against those it must have: what is missing, what is too much."""
    parts = []
    for role, (at, keys) in _KEYS.items():
        have, want = F.coalesce(F.json_object_keys(F.col("conversations")[at]["content"]), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in keys])
        missing, extra = F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))
        parts.append(F.struct(F.lit(role).alias("role"), F.array_join(missing, "|").alias("missing"), F.array_join(extra, "|").alias("extra"), ((F.size(have) == len(keys)) & (F.size(missing) == 0)).alias("closed")))
    return train(t).select("id", F.explode(F.array(*parts)).alias("x")).select("id", "x.*")


@query(f"""WITH {_H}, v AS (SELECT id AS record, v.id AS id, regexp_extract(v.id, '^(.*)-v[0-9]+$', 1) AS base, CAST(regexp_extract(v.id, '-v([0-9]+)$', 1) AS INTEGER) AS n FROM (SELECT id, unnest(evidence_variants) AS v FROM hq))
SELECT a.id AS first_id, b.id AS next_id FROM v a JOIN v b ON a.base = b.base AND b.n = a.n + 1 AND a.base <> '' UNION ALL SELECT record, id FROM v WHERE n = 1 AND base = record""")
def chain_link(t):
    """Each record linked to its first variant, and each variant to the next one of the same base, by the numbers in the ids."""
    v = holdout(t).select(F.col("id").alias("record"), F.explode("evidence_variants.id").alias("id"))
    v = v.select("record", "id", F.regexp_extract("id", "^(.*)-v[0-9]+$", 1).alias("base"), F.nullif(F.regexp_extract("id", "-v([0-9]+)$", 1), F.lit("")).cast("int").alias("n"))
    a, b = v.filter("base <> ''").select("base", (F.col("n") + 1).alias("n"), F.col("id").alias("first_id")), v.select("base", "n", F.col("id").alias("next_id"))
    return a.join(b, ["base", "n"]).select("first_id", "next_id").unionByName(v.filter("n = 1 and base = record").select(F.col("record").alias("first_id"), F.col("id").alias("next_id")))


# --- logs: a user's events of a day are a run; signup starts it, purchase completes it, error fails it --------------------
_RUN = "ev AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type AS kind FROM events)"


def run_log(t):
    return t("events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"))


@query(f"""WITH {_RUN}, x AS (SELECT user_id, max(event_id) FILTER (kind = 'signup') AS started, max(event_id) FILTER (kind = 'purchase') AS done FROM ev GROUP BY 1)
SELECT user_id, started, CASE WHEN done > started THEN done END AS completed, CASE WHEN started IS NULL THEN 'none' WHEN done > started THEN 'complete' ELSE 'running' END AS state FROM x""")
def metric_log_last_run(t):
    """The last start in each user's log, and the last completion after it."""
    return logs.last_run(run_log(t), ["user_id"], "event_id", "kind", "signup", "purchase")


@query(f"""WITH {_RUN} SELECT user_id, day, count(*) AS events, arg_min(kind, event_id) AS first_kind, arg_max(kind, event_id) AS final_kind,
count(*) FILTER (kind IN ('purchase', 'error')) AS finals, arg_min(kind, event_id) = 'signup' AND arg_max(kind, event_id) IN ('purchase', 'error') AND count(*) FILTER (kind IN ('purchase', 'error')) = 1 AS complete FROM ev GROUP BY 1, 2""")
def trace_completeness(t):
    """Whether each trace begins with its start and ends with the only final event."""
    return logs.traces(run_log(t), ["user_id", "day"], "event_id", "kind", "signup", ("purchase", "error"))


@query(f"""WITH {_RUN}, x AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, day ORDER BY event_id) AS before FROM ev)
SELECT user_id, day, CASE WHEN count(*) FILTER (kind = 'error') = 0 THEN 'completed' ELSE coalesce('failed_after_' || (arg_min({{'b': before}}, event_id) FILTER (kind = 'error')).b, 'failed_at_start') END AS code FROM x GROUP BY 1, 2""")
def failure_code_case(t):
    """Of each trace the stage before its first failure; a trace that failed is never told as completed."""
    return logs.failure_codes(run_log(t), ["user_id", "day"], "event_id", "kind", "error")


@query(f"WITH {_RUN}, m AS (SELECT *, CASE kind WHEN 'purchase' THEN 'exact_lookup' WHEN 'signup' THEN 'retrieval' END AS mode FROM ev) SELECT user_id, day, arg_max(mode, event_id) FILTER (mode IS NOT NULL) AS mode FROM m GROUP BY 1, 2")
def answer_projection(t):
    """The last mode that a trace tells, null if it tells none."""
    mode = F.when(F.col("kind") == "purchase", "exact_lookup").when(F.col("kind") == "signup", "retrieval")
    return logs.last_known(run_log(t).withColumn("mode", mode), ["user_id", "day"], "event_id", "mode")


@query(f"""WITH {_RUN}, x AS (SELECT user_id, day, count(*) FILTER (kind = 'click') AS searches, max(event_id) FILTER (kind = 'view') AS hit, max(event_id) FILTER (kind = 'purchase') AS final, min(event_id) FILTER (kind = 'error') AS missed FROM ev GROUP BY 1, 2)
SELECT user_id, day, searches, CASE WHEN searches > 2 THEN 'too_many_searches' WHEN missed < final THEN 'answered_after_miss' WHEN hit IS NOT NULL AND coalesce(final < hit, true) THEN 'hit_not_promoted' ELSE 'valid' END AS verdict FROM x""")
def tool_log_validate(t):
    """Of each recorded tool run: at most two searches, no answer after a miss, and each hit followed by the answer."""
    return logs.tool_runs(run_log(t), ["user_id", "day"], "event_id", "kind", {"search": "click", "hit": "view", "answer": "purchase", "miss": "error"}, 2)


@query("WITH" + LEGS + "," + CASES + """, q AS (SELECT query_id, unnest(required) AS chunk_id FROM c), lg AS (SELECT unnest(['dense', 'sparse']) AS leg),
s AS (SELECT c.query_id, lg.leg, count(l.rank) FILTER (l.rank <= 5) AS hit, -coalesce(min(l.rank), 99) AS first FROM c CROSS JOIN lg JOIN q ON q.query_id = c.query_id LEFT JOIN l ON l.query_id = c.query_id AND l.leg = lg.leg AND l.chunk_id = q.chunk_id GROUP BY 1, 2),
w AS (SELECT query_id, max({'hit': hit, 'first': first}) FILTER (leg = 'dense') AS base, max({'hit': hit, 'first': first, 'id': leg}) FILTER (leg = 'sparse') AS best FROM s GROUP BY 1)
SELECT query_id, CASE WHEN {'hit': best.hit, 'first': best.first} >= base THEN best.id ELSE 'noop' END AS chosen, base.hit AS baseline_hits, best.hit AS candidate_hits FROM w""")
def non_degrading_select(t):
    """For each case the candidate list, if its scores aren't worse than the baseline's, else none: hits, then first hit."""
    need = cases(t).select("query_id", F.explode("required").alias("chunk_id"))
    every = need.select("query_id", "chunk_id", F.explode(F.array(F.lit("dense"), F.lit("sparse"))).alias("leg"))
    s = every.join(legs(t).select("query_id", "leg", "chunk_id", "rank"), ["query_id", "leg", "chunk_id"], "left").groupBy("query_id", "leg").agg(F.count_if(F.col("rank") <= 5).alias("hit"), (-F.coalesce(F.min("rank"), F.lit(99))).alias("first"))
    return logs.non_degrading(s, "query_id", "leg", "dense", ["hit", "first"])


@query(f"WITH {_H}, x AS (SELECT id, list_transform(answer_gt.quotes, lambda q, i: {{'E': i, 'c': q.chunk_id}}) AS q FROM hq) SELECT id, '{{' || array_to_string(list_sort(list_transform(q, lambda e: '\"' || e.c || '\":' || e.E)), ',') || '}}' AS frozen FROM x WHERE len(q) > 0 AND len(list_distinct(list_transform(q, lambda e: e.c))) = len(q)")
def audit_frozen_map(t):
    """A nested audit value in one canonical form: the map's entries in the order of their keys."""
    from corvane.functions.text import frozen

    q = holdout(t).select("id", F.transform("answer_gt.quotes", lambda q, i: F.struct(q["chunk_id"].alias("key"), (i + 1).alias("value"))).alias("q"))
    q = q.filter((F.size("q") > 0) & (F.size(F.array_distinct("q.key")) == F.size("q")))
    return q.select("id", frozen(F.map_from_entries("q")).alias("frozen"))


@query(f"WITH {_R} SELECT id, list_filter(['query_id', 'source', 'pool_no'], lambda k: k <> 'source') AS kept_keys, pool_no::VARCHAR AS pool FROM r")
def audit_public_keys(t):
    """Audit metadata without the keys that aren't for the public."""
    m = F.create_map(*[x for k in ("query_id", "source", "pool_no") for x in (F.lit(k), F.col(k).cast("string"))])
    public = F.map_filter(m, lambda k, _: k != "source")
    return train(t).select("id", F.map_keys(public).alias("kept_keys"), public["pool_no"].alias("pool"))


@query(r"WITH d AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN '/' ELSE '' END || coalesce(source, '') || CASE doc_id % 7 WHEN 0 THEN '/../x' WHEN 1 THEN '//x' ELSE '' END || '/part-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.tmp' ELSE '.bin' END AS path FROM documents) SELECT doc_id, NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\.\.(/|$)') AND NOT contains(path, '//') AND suffix(path, '.bin') AS safe FROM d")
def safe_relative_path(t):
    """Paths of a manifest that are relative, stay below their folder and end as they must."""
    from corvane.functions.text import safe_path

    i = F.col("doc_id")
    path = F.concat(F.when(i % 5 == 0, "/").otherwise(""), F.coalesce("source", F.lit("")), F.when(i % 7 == 0, "/../x").when(i % 7 == 1, "//x").otherwise(""), F.lit("/part-"), i.cast("string"), F.when(i % 3 == 0, ".tmp").otherwise(".bin"))
    return t("documents").select("doc_id", safe_path(path, ".bin").alias("safe"))


@query("SELECT plan_id, clean_count, max_repeat, clean_count * max_repeat * 5 // 100 AS floor_budget FROM (SELECT DISTINCT plan_id, clean_count, max_repeat FROM clean_scale_plan)")
def training_budget_floor(t):
    """Five percent of a plan's exposures, rounded down, in whole numbers."""
    return one_per_key(t("clean_scale_plan"), "plan_id").select("plan_id", "clean_count", "max_repeat", F.expr("cast(clean_count * max_repeat * 5 div 100 as int)").alias("floor_budget"))


