"""Queries of sampling, exposure planning and packing."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corvane.operators import sampling as S
from corvane.operators.prefix import running_total
from corvane.plans.base import registry
from corvane.plans.integrity import variant
from corvane.runtime import one_per_key

QUERIES, query = registry()
_R = "r AS (SELECT DISTINCT ON (id) *, regexp_replace(lower(trim(variant)), '[\\s\\-]+', '_', 'g') AS v FROM sft_candidate)"


def records(t):
    return one_per_key(t("sft_candidate"), "id").withColumn("v", variant())


@query("WITH " + _R + "SELECT id, v, place FROM (SELECT id, v, row_number() OVER (PARTITION BY v ORDER BY sha256('42' || chr(0) || id), id) AS place FROM r WHERE v IS NOT NULL) WHERE place <= 100")
def sha_order_sample(t):
    return S.first_by_hash(records(t).filter("v is not null").select("id", "v"), ["v"], "id", "42", 100).select("id", "v", F.col("place").cast("long").alias("place"))


@query("WITH " + _R + """SELECT id, v, len(required_chunk_ids) AS n_required, len(visible_chunk_ids) AS n_visible, array_to_string(list_sort(list_distinct(list_transform(required_chunk_ids, lambda c: regexp_replace(c, '#[^#]*$', '')))), '|') AS laws,
(list_sum(list_transform(conversations, lambda c: length(c.content))) // 256)::BIGINT AS bucket FROM r""")
def stratum_key(t):
    """What a record is drawn by: variant, numbers of required and visible articles, the laws it needs, and its length by 256."""
    laws = F.array_sort(F.array_distinct(F.transform("required_chunk_ids", lambda c: F.regexp_replace(c, "#[^#]*$", ""))))
    n = F.aggregate("conversations", F.lit(0).cast("long"), lambda s, c: s + F.length(c["content"]))
    return records(t).select("id", "v", F.size("required_chunk_ids").cast("long").alias("n_required"), F.size("visible_chunk_ids").cast("long").alias("n_visible"), F.array_join(laws, "|").alias("laws"), F.floor(n / 256).alias("bucket"))


@query("WITH " + _R + """, n AS (SELECT pool_no, count(*) AS n FROM r WHERE v = 'clean' GROUP BY 1), x AS (SELECT pool_no, id, n, unnest(range(0, 100 // n + 1)) AS cycle FROM r JOIN n USING (pool_no) WHERE v = 'clean')
SELECT pool_no, id, count(*) AS uses FROM (SELECT *, row_number() OVER (PARTITION BY pool_no ORDER BY cycle, sha256(cycle || chr(0) || id), id) AS place FROM x) WHERE place <= 100 GROUP BY 1, 2""")
def balanced_exposure(t):
    """Exactly 100 exposures of each pool's clean records, as even as can be."""
    r = records(t).filter("v = 'clean'").select("pool_no", "id")
    n = r.groupBy("pool_no").agg(F.count(F.lit(1)).alias("n"))
    x = S.exposures(r.join(n, "pool_no"), "id", F.lit(100), F.col("n"))
    order = W.partitionBy("pool_no").orderBy("cycle", F.sha2(F.concat_ws("\x00", "cycle", "id"), 256), "id")
    return x.withColumn("place", F.row_number().over(order)).filter("place <= 100").groupBy("pool_no", "id").agg(F.count(F.lit(1)).alias("uses"))


@query("SELECT DISTINCT plan_id, clean_count, coalesce(hard_negative_count, 0) AS hard, round_even(2240.0 * coalesce(hard_negative_count, 0) / greatest(clean_count + coalesce(hard_negative_count, 0), 1), 0)::BIGINT AS target FROM clean_scale_plan")
def exposure_targets(t):
    p = one_per_key(t("clean_scale_plan"), "plan_id").withColumn("hard", F.coalesce("hard_negative_count", F.lit(0)))
    return p.select("plan_id", "clean_count", "hard", F.bround(2240.0 * F.col("hard") / F.greatest(F.col("clean_count") + F.col("hard"), F.lit(1)), 0).cast("long").alias("target"))


@query("SELECT source, sum(n_chars)::BIGINT AS tokens, (sum(n_chars) // 2048)::BIGINT AS sequences, (sum(n_chars) % 2048)::BIGINT AS dropped FROM (SELECT source, coalesce(n_chars, 0) AS n_chars FROM documents) GROUP BY 1")
def sequence_packing(t):
    return S.packed_sequences(t("documents"), "source", "n_chars", 2048)


_SHARES = "CASE WHEN source LIKE 'court%' THEN 3 WHEN source IS NULL THEN 0 ELSE 1 END"


@query(f"WITH x AS (SELECT source, coalesce(sum(n_chars), 0)::BIGINT AS n, {_SHARES} AS w FROM documents GROUP BY 1), y AS (SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS weights FROM x), z AS (SELECT source, n, (total * w // weights)::BIGINT AS target FROM y) "
       "SELECT source, n AS once, target, CASE WHEN n > 0 THEN least(target // n, 4) END::BIGINT AS whole_uses, CASE WHEN n > 0 THEN least(target, 4 * n) ELSE 0 END::BIGINT AS exposed, (target - CASE WHEN n > 0 THEN least(target, 4 * n) ELSE 0 END)::BIGINT AS short FROM z")  # fmt: skip
def source_mix_exposure(t):
    """Signs of each source once, its target by weight out of all signs, how often it is used whole, at most four times, and
    what it stays short: exposed and short close to the target."""
    w = F.when(F.startswith("source", F.lit("court")), 3).when(F.col("source").isNull(), 0).otherwise(1)
    x = t("documents").groupBy("source").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("n")).withColumn("w", w)
    every = x.agg(F.sum("n").alias("total"), F.sum("w").alias("weights"))  # one row
    z = x.crossJoin(F.broadcast(every)).select("source", "n", F.expr("cast(total * w div weights as bigint)").alias("target"))
    exposed = F.when(F.col("n") > 0, F.least("target", 4 * F.col("n"))).otherwise(F.lit(0).cast("long"))
    return z.select("source", F.col("n").alias("once"), "target", F.when(F.col("n") > 0, F.least(F.expr("target div n"), F.lit(4).cast("long"))).alias("whole_uses"), exposed.alias("exposed"), (F.col("target") - exposed).alias("short"))


@query("""WITH f AS (SELECT DISTINCT ON (p) lower(regexp_replace(trim(query_original), '\\s+', ' ', 'g')) AS p, min(id) OVER (PARTITION BY lower(regexp_replace(trim(query_original), '\\s+', ' ', 'g'))) AS id, query_type FROM private_holdout ORDER BY p, id)
SELECT query_type, id FROM (SELECT query_type, id, row_number() OVER (PARTITION BY query_type ORDER BY sha256('gen' || chr(0) || id), id) AS place FROM (
  SELECT h.query_type, f.id FROM f JOIN (SELECT DISTINCT id, query_type FROM private_holdout) h USING (id))) WHERE place <= 20""")
def generation_set(t):
    """Prompts once each (the first id), then 20 of each kind in hash order."""
    h = one_per_key(t("private_holdout"), "id").withColumn("p", F.lower(F.regexp_replace(F.trim("query_original"), r"\s+", " ")))
    once = h.groupBy("p").agg(F.min_by("query_type", "id").alias("query_type"), F.min("id").alias("id"))
    return S.first_by_hash(once.select("query_type", "id"), ["query_type"], "id", "gen", 20).select("query_type", "id")


@query("SELECT event_id, user_id, xxx.m AS micro FROM (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS m FROM events) xxx")
def micro_batches(t):
    """Batches of eight of each user's events, the last one as it is; places go by spans of ids, so that no user is one task's work."""
    x = running_total(t("events").select("event_id", "user_id", F.lit(1).alias("one")), ["user_id"], "event_id", "one", "place", span=65536)
    return x.select("event_id", "user_id", F.floor((F.col("place") - 1) / 8).alias("micro"))


@query("""WITH c AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS v FROM events), x AS (SELECT event_id, user_id, sum(v) OVER w AS cur, sum(v) OVER w - v AS prev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, CASE WHEN cur // 250000 > prev // 250000 THEN 'full' ELSE 'quick' END AS kind FROM x WHERE cur // 50000 > prev // 50000""")
def crossed_events(t):
    """Events at which a user's running sum, in hundredths, comes to or over a multiple of 500; one of 2,500 is a full event
    and no quick one. Sums go by spans of ids, so a user with many events isn't one task's work."""
    x = t("events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    x = running_total(x, ["user_id"], "event_id", "v", "cur", span=65536).withColumn("prev", F.col("cur") - F.col("v"))
    over = lambda n: F.floor(F.col("cur") / n) > F.floor(F.col("prev") / n)
    return x.filter(over(50000)).select("event_id", "user_id", F.when(over(250000), "full").otherwise("quick").alias("kind"))


@query("WITH b AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS m FROM events) SELECT event_id, user_id, m - 3 AS micro FROM b WHERE m >= 3")
def skip_batches(t):
    """Batches of eight of each user's events without the first three, numbered from there."""
    return micro_batches(t).filter("micro >= 3").select("event_id", "user_id", (F.col("micro") - 3).alias("micro"))


@query("SELECT event_id, user_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-4), 4) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def group_standardize(t):
    m = t("events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return t("events").join(m, "user_id").select("event_id", "user_id", (F.round((F.col("value") - F.col("m")) / (F.col("s") + 1e-4), 4) + 0.0).alias("z"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS i FROM events),
s AS (SELECT user_id, day, i, sum(value * pow(0.95, i)) OVER (PARTITION BY user_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) / pow(0.95, i) AS advantage FROM e), f AS (SELECT user_id, day, min(i) AS i FROM s GROUP BY 1, 2)
SELECT user_id, day, round(advantage + 1e-9, 6) AS advantage FROM s JOIN f USING (user_id, day, i)""")
def gae_reverse_fold(t):
    """Of each user and day the discounted sum from the user's last event of all back to the first of the day.

    Events are folded by day, over the reversed array, and days by user: what comes after a day counts 0.95 to the power
    of the day's events. So no array holds more than one day's events or one user's days.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    x = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(ordered.alias("v"))
    x = x.select("user_id", "day", F.aggregate(F.reverse("v"), F.lit(0.0), lambda acc, r: r + 0.95 * acc).alias("own"), F.pow(F.lit(0.95), F.size("v")).alias("carry"))
    days = F.sort_array(F.collect_list(F.struct("day", "own", "carry")), asc=False)
    none = F.array().cast("array<struct<day:date,advantage:double>>")
    after = lambda acc: F.when(F.size(acc) == 0, 0.0).otherwise(F.try_element_at(acc, F.lit(-1))["advantage"])
    back = F.aggregate(days, none, lambda acc, d: F.concat(acc, F.array(F.struct(d["day"].alias("day"), (d["own"] + d["carry"] * after(acc)).alias("advantage")))))
    return x.groupBy("user_id").agg(back.alias("days")).select("user_id", F.explode("days").alias("d")).select("user_id", "d.day", F.round(F.col("d.advantage") + 1e-9, 6).alias("advantage"))


@query("""WITH d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, doc_id, p AS position, p - (upto - n) AS place FROM (SELECT source, doc_id, n, upto, unnest(range(((upto - n + 9999) // 10000 * 10000)::BIGINT, upto::BIGINT, 10000)) AS p FROM d)""")
def sequence_locator(t):
    """Which document holds each 10,000th sign of its source's stream, and where in it: sums by spans, then each document
    names the positions within it, so no range is searched."""
    d = t("documents").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    x = running_total(d, ["source"], "doc_id", "n", "upto", span=4096).withColumn("begin", F.col("upto") - F.col("n"))
    first = F.ceil(F.col("begin") / 10000) * 10000
    x = x.filter(first < F.col("upto")).withColumn("position", F.explode(F.sequence(first, F.col("upto") - 1, F.lit(10000).cast("long"))))
    return x.select("source", "doc_id", F.col("position").cast("long").alias("position"), (F.col("position") - F.col("begin")).cast("long").alias("place"))


@query("SELECT event_id, (event_id // 1000)::BIGINT AS epoch, (event_id % 1000)::BIGINT AS position, event_id // 1000 <> (event_id + 6) // 1000 AS crosses FROM events WHERE event_id % 7 = 0")
def epoch_position(t):
    """Epoch and position of each batch of seven, by its first event; one that crosses the end of an epoch is an error."""
    i = F.col("event_id")
    return t("events").filter(i % 7 == 0).select("event_id", F.floor(i / 1000).alias("epoch"), (i % 1000).alias("position"), (F.floor(i / 1000) != F.floor((i + 6) / 1000)).alias("crosses"))


@query("WITH " + _R + "SELECT v, count(*) AS n, count(*) FILTER (len(visible_chunk_ids) >= 5) AS five, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (len(visible_chunk_ids) >= 5) / count(*), 6) END AS ratio FROM r GROUP BY 1")
def hn_five_evidence_ratio(t):
    five = F.count_if(F.size("visible_chunk_ids") >= 5)
    return records(t).groupBy("v").agg(F.count(F.lit(1)).alias("n"), five.alias("five"), F.round(F.try_divide(five, F.count(F.lit(1))), 6).alias("ratio"))


@query("WITH x AS (SELECT DISTINCT plan_id, plan_group, clean_count, max_repeat FROM clean_scale_plan) SELECT plan_group, sum(clean_count)::BIGINT AS records, sum(clean_count * max_repeat)::BIGINT AS exposures, sum(-(-(clean_count * max_repeat) // 8))::BIGINT AS floor_steps FROM x GROUP BY 1")
def plan_summary(t):
    x = one_per_key(t("clean_scale_plan"), "plan_id")
    n = F.col("clean_count") * F.col("max_repeat")
    return x.groupBy("plan_group").agg(F.sum("clean_count").alias("records"), F.sum(n).alias("exposures"), F.sum(F.expr("-(-(clean_count * max_repeat) div 8)")).alias("floor_steps"))


@query("WITH " + _R + ", x AS (SELECT id, unnest(conversations) AS c, generate_subscripts(conversations, 1) - 1 AS turn FROM r), y AS (SELECT id, turn, c.role AS role, length(c.content) AS n, sum(length(c.content)) OVER (PARTITION BY id ORDER BY turn) AS upto FROM x) SELECT id, turn::INTEGER AS turn, (upto - n)::BIGINT AS start, upto::BIGINT AS end FROM y WHERE role = 'assistant'")
def label_mask(t):
    """Characters of a conversation that are learnt: those of the assistant, marked by turn and span."""
    r = records(t).select("id", F.posexplode("conversations").alias("turn", "c")).select("id", "turn", "c.role", F.length("c.content").alias("n"))
    start = F.sum("n").over(W.partitionBy("id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return r.withColumn("start", start).filter("role = 'assistant'").select("id", "turn", "start", (F.col("start") + F.col("n")).alias("end"))


@query("WITH " + _R + "SELECT id, array_to_string(list_transform(conversations, lambda c: '<' || c.role || '>' || c.content), chr(10)) AS prompt FROM r")
def chat_render(t):
    return records(t).select("id", F.array_join(F.transform("conversations", lambda c: F.concat(F.lit("<"), c["role"], F.lit(">"), c["content"])), "\n").alias("prompt"))


_QUOTA = _R + """, s AS (SELECT v, len(required_chunk_ids) AS k, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY 1, 2), a AS (SELECT *, sum(n) OVER () AS total FROM s),
b AS (SELECT *, (n * 200 // total)::BIGINT AS q, (n * 200) % total AS rest FROM a), c AS (SELECT *, row_number() OVER (ORDER BY rest DESC, sha256(v || chr(0) || k)) AS place, 200 - sum(q) OVER () AS spare FROM b),
qt AS (SELECT v, k::BIGINT AS k, n, (q + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM c)"""


def quota_table(t):
    s = records(t).filter("v is not null").groupBy("v", F.size("required_chunk_ids").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return S.quotas(s, ["v", "k"], "n", 200).select("v", "k", "n", "quota")


@query("WITH " + _QUOTA + " SELECT v, k, n, quota FROM qt")
def stratified_quota(t):
    return quota_table(t)


@query("WITH " + _QUOTA + ", o AS (SELECT id, v, len(required_chunk_ids)::BIGINT AS k, row_number() OVER (PARTITION BY v, len(required_chunk_ids) ORDER BY sha256('strata' || chr(0) || id), id) AS place FROM r WHERE v IS NOT NULL) SELECT o.v, o.k, id, place FROM o JOIN qt ON qt.v = o.v AND qt.k = o.k WHERE place <= quota")
def stratified_select(t):
    """The records drawn from each stratum up to its quota, in hash order. No quota is above the total, so the lists are cut
    there before they meet their quotas."""
    r = records(t).filter("v is not null").select("id", "v", F.size("required_chunk_ids").cast("long").alias("k"))
    first = S.first_by_hash(r, ["v", "k"], "id", "strata", 200)
    return first.join(F.broadcast(quota_table(t)), ["v", "k"]).filter("place <= quota").select("v", "k", "id", F.col("place").cast("long").alias("place"))


@query("WITH " + _R + """, hn AS (SELECT DISTINCT pool_no, query_id FROM r WHERE v = 'hard_negative'), c AS (SELECT r.pool_no, r.id, hn.query_id IS NOT NULL AS paired FROM r LEFT JOIN hn USING (pool_no, query_id) WHERE v = 'clean'),
n AS (SELECT pool_no, count(*) AS n, count(*) FILTER (paired) AS p FROM c GROUP BY 1), o AS (SELECT pool_no, id, paired, row_number() OVER (PARTITION BY pool_no ORDER BY paired DESC, sha256('nest' || chr(0) || id), id) AS place FROM c)
SELECT pool_no, id, paired, CASE WHEN place <= greatest(p, n // 5) THEN 1 WHEN place <= greatest(p, 2 * n // 5) THEN 2 WHEN place <= greatest(p, 4 * n // 5) THEN 3 ELSE 4 END AS level FROM o JOIN n USING (pool_no)""")
def nested_subsets(t):
    """Nested subsets of each pool's clean records, of a fifth, two, four fifths and all: each holds the one before, and all
    hold the records that are paired with a hard negative. level is the smallest that a record belongs to.

    Places go by hash buckets: counts of the buckets before give the offset, so no pool is put in order in one task.
    """
    r = records(t)
    hard = r.filter("v = 'hard_negative'").select("pool_no", "query_id").distinct().withColumn("hit", F.lit(True))
    c = r.filter("v = 'clean'").join(hard, ["pool_no", "query_id"], "left").select("pool_no", "id", F.coalesce("hit", F.lit(False)).alias("paired"), S.hash_key("nest", "id").alias("h"))
    c = c.withColumn("b", F.conv(F.substring("h", 1, 3), 16, 10).cast("long") + F.when(F.col("paired"), 0).otherwise(4096))
    counts = c.groupBy("pool_no", "b").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("pool_no").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = c.withColumn("i", F.row_number().over(W.partitionBy("pool_no", "b").orderBy("h", "id"))).join(counts.select("pool_no", "b", before.alias("o")), ["pool_no", "b"])
    n = c.groupBy("pool_no").agg(F.count(F.lit(1)).alias("n"), F.count_if("paired").alias("p"))
    place = F.col("o") + F.col("i")
    upto = lambda part: place <= F.greatest(F.col("p"), F.expr(f"{part} * n div 5"))
    return placed.join(n, "pool_no").select("pool_no", "id", "paired", F.when(upto(1), 1).when(upto(2), 2).when(upto(4), 3).otherwise(4).alias("level"))
