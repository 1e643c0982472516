"""Relational coverage over the star schema: scans, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from corvane.plans.base import registry

QUERIES, query = registry()


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    x = t("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_by_nation(t):
    """Summed up by customer before the joins, so that the larger table is exchanged once and small."""
    o = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "o_custkey").join(t("nation"), "n_nationkey").groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY 1")
def semi_join(t):
    late = t("lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1")
def anti_join(t):
    return t("customer").join(t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def top_parts(t):
    k = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t("part").withColumn("k", k).filter("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_size FROM part INTERSECT SELECT l_linenumber FROM lineitem")
def set_intersect(t):
    return t("part").select("p_size").intersect(t("lineitem").select(F.col("l_linenumber").alias("p_size")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_orderstatus, count(*) FILTER (year(o_orderdate) = 1995) AS y1995, count(*) FILTER (year(o_orderdate) = 1996) AS y1996 FROM orders GROUP BY 1")
def pivot_years(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count_if(F.year("o_orderdate") == 1995).alias("y1995"), F.count_if(F.year("o_orderdate") == 1996).alias("y1996"))


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_events(t):
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1")
def tumbling_windows(t):
    return t("events").groupBy(F.window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, k::BIGINT AS k, count(*) AS n, min(ts) AS start FROM s GROUP BY 1, 2""")
def session_windows(t):
    s = t("events").groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
    return s.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("start")).cast("long").alias("k"), "n", "start")


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts < e.ts OR p.ts = e.ts AND p.event_id <= e.event_id)
AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND (x.ts < e.ts OR x.ts = e.ts AND x.event_id <= e.event_id) AND (x.ts > p.ts OR x.ts = p.ts AND x.event_id > p.event_id))) AS last_purchase
FROM events e WHERE e.event_type = 'click'""")
def asof_purchase(t):
    """The latest purchase at or before each click of the same user: one pass of a window, no range join."""
    upto = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    x = t("events").withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(upto))
    return x.filter("event_type = 'click'").select("event_id", "last_purchase")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, count(DISTINCT user_id) AS users, json_extract_string(any_value(props), '$.k') IS NOT NULL AS keyed FROM events GROUP BY 1")
def event_profile(t):
    from corvane.operators.evaluation import exact_percentile

    e = t("events")
    facts = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.get_json_object(F.any_value("props"), "$.k").isNotNull().alias("keyed"))
    return facts.join(exact_percentile(e, "event_type", "value", 0.5, 1.0), "event_type").select("event_type", F.round("percentile", 4).alias("median"), "users", "keyed")
