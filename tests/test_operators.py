"""Operators by hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import numerals, protocol, text
from corvane.operators import evaluation, prefix, retrieval, sampling


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rrf_of_three_hits_at_k4(spark):
    lists = spark.createDataFrame([("q", "dense", "a1", 1), ("q", "dense", "a2", 2), ("q", "dense", "b", 3), ("q", "sparse", "b", 1)], "query_id string, leg string, chunk_id string, rank int")
    fused = {r.chunk_id: r.score for r in retrieval.rrf(lists, 4, ["query_id"]).collect()}
    assert fused["a1"] == 0.2 and math.isclose(fused["b"], 1 / 5 + 1 / 7, abs_tol=1e-9)


def test_rrf_does_not_depend_on_order_of_rows(spark):
    data = [("q", leg, f"c{k}", k) for leg in ("x", "y", "z") for k in range(1, 20)]
    a = retrieval.rrf(spark.createDataFrame(data, "query_id string, leg string, chunk_id string, rank int"), 60, ["query_id"])
    random.Random(1).shuffle(data)
    assert rows(a) == rows(retrieval.rrf(spark.createDataFrame(data, "query_id string, leg string, chunk_id string, rank int").repartition(3), 60, ["query_id"]))


def test_rank_lists_leaves_out_what_has_no_finite_score(spark):
    hits = spark.createDataFrame([("q", "a", 1.0), ("q", "a", 3.0), ("q", "b", float("nan")), ("q", "c", None), ("q", "d", float("inf")), ("q", None, 9.0), ("q", "e", 3.0)], "query_id string, chunk_id string, score double")
    assert rows(retrieval.rank_lists(hits, 5, ["query_id"]).select("chunk_id", "score", "rank")) == [("a", 3.0, 1), ("e", 3.0, 2)]


def test_dense_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>").repartition(4)
    got = rows(retrieval.dense_search(df, df.filter("vec_id % 20 = 0"), 3, block=2).select("query_id", "rank", "vec_id"))
    m = m.astype(np.float32).astype(float)
    want = [(q, r + 1, int(v)) for q in (0, 20, 40) for r, v in enumerate(np.lexsort((np.arange(60), -np.round(m @ m[q], 5)))[:3])]
    assert got == want


def test_pack_skips_what_does_not_fit(spark):
    x = spark.range(1).select(F.array(*[F.struct(F.lit(c).alias("chunk_id"), F.lit(n).alias("tokens")) for c, n in (("a", 300), ("b", 200), ("c", 90))]).alias("items"))
    assert x.select(retrieval.pack(F.col("items"), "tokens", 400).alias("p")).first().p == (390, ["a", "c"])


def test_pareto_keeps_equal_points(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 0.9, 6), ("d", 0.5, 1)], "k string, good double, cost int")
    assert [r.k for r in evaluation.pareto(df, ["good"], ["cost"]).orderBy("k").collect()] == ["a", "b", "d"]


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(str(k), float(k % 5)) for k in range(200)], "id string, v double")
    r = evaluation.bootstrap(df, "id", "v", 500, 7).first()
    assert r.low < 2.0 < r.high and abs(r["mean"] - 2.0) < 0.05
    assert r == evaluation.bootstrap(df.repartition(5), "id", "v", 500, 7).first()


def test_hash_fraction_takes_the_first_in_hash_order(spark):
    import hashlib

    ids = [f"r{k}" for k in range(97)]
    got = sorted(r.id for r in evaluation.hash_fraction(spark.createDataFrame([(i,) for i in ids], "id string"), "id", "42:", 0.2).collect())
    assert got == sorted(sorted(ids, key=lambda i: hashlib.sha256(("42:" + i).encode()).hexdigest())[:20])


def test_running_total_over_spans(spark):
    data = [(g, k, (k * 7) % 5) for g in ("a", None) for k in range(50)]
    got = rows(prefix.running_total(spark.createDataFrame(data, "g string, k long, n long"), ["g"], "k", "n", "upto", 8).select(F.coalesce("g", F.lit("-")), "k", "upto"))
    want, sums = [], {}
    for g, k, n in data:
        sums[g] = sums.get(g, 0) + n
        want.append((g or "-", k, sums[g]))
    assert got == sorted(want)


def test_quotas_sum_to_the_total(spark):
    s = spark.createDataFrame([(f"s{k}", 3 * k + 1) for k in range(9)], "v string, n long")
    got = sampling.quotas(s, ["v"], "n", 40).collect()
    assert sum(r.quota for r in got) == 40 and all(abs(r.quota - 40 * r.n / 117) < 1 for r in got)


@pytest.mark.parametrize("spelt,value", [("十", 10), ("十二", 12), ("一百零五", 105), ("三百二十", 320), ("九千零一十", 9010), ("两百", 200), ("", None), ("abc", None), (None, None)])
def test_numerals(spark, spelt, value):
    assert spark.createDataFrame([(spelt,)], "s string").select(numerals.chinese_number(F.col("s"))).first()[0] == value


def test_numeral_round_trip(spark):
    x = spark.range(1, 10000).select("id", numerals.chinese_number(numerals.format_number(F.col("id"))).alias("v"))
    assert x.filter("v is null or v <> id").count() == 0


@pytest.mark.parametrize("raw,n,want", [('{"summary":"a","citations":["E1"]}', 1, "none"), ('{"summary":"a","summary":"b","citations":[]}', 1, "repeated_field"), ('{"summary":"a","citations":["E2"]}', 1, "citations"), ('{"summary":"a\\nb","citations":[]}', 1, "summary"), ("{", 1, "no_json"), (None, 0, "empty"), ('{"summary":NaN,"citations":[]}', 1, "no_json"), ("[]", 1, "fields")])
def test_answer_protocol(raw, n, want):
    assert protocol.defect(raw, n) == want


def test_clean_text(spark):
    x = spark.createDataFrame([("a\n\n－12－\n\nb\n\n\n\nc \n",), (None,), ("",)], "t string").select(text.clean_text(F.col("t"))).collect()
    assert [r[0] for r in x] == ["a\nb\n\nc", None, ""]


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime

    from corvane.streaming import events

    at = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    hour = datetime.timedelta(hours=1)
    for k, batch in enumerate([[(1, at, 1, "a", 1.0)], [(2, at + 10 * hour, 1, "a", 1.0)], [(4, at + 20 * hour, 1, "a", 1.0)], [(3, at, 1, "a", 1.0), (5, at + 30 * hour, 1, "a", 1.0)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)
    out = events.drain(events.windowed_counts(events.event_stream(spark, str(tmp_path / "in")), "1 hour", "1 hour"))
    assert sorted((r.window.start, r.n) for r in out.collect())[0] == (at, 1)  # event 3 came too late for the first window


def test_restarted_stream_goes_on_and_writes_nothing_twice(spark, tmp_path):
    import datetime

    from corvane.streaming import events

    at = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    put = lambda *ids: spark.createDataFrame([(k, at + datetime.timedelta(minutes=k), 1, "a", 1.0) for k in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: events.drain(events.once(events.event_stream(spark, str(tmp_path / "in")), "1 hour", "event_id"), "append", str(tmp_path / "out"), str(tmp_path / "state"))
    put(1, 2)
    assert sorted(r.event_id for r in run().collect()) == [1, 2]
    assert sorted(r.event_id for r in run().collect()) == [1, 2]  # nothing new
    put(2, 3)  # 2 comes again, within the watermark
    assert sorted(r.event_id for r in run().collect()) == [1, 2, 3]


def test_exact_percentile(spark):
    import statistics

    data = [("a", float(k * k % 97)) for k in range(50)] + [("b", 3.5)] + [("c", None), ("c", float("nan"))] + [("d", -7.25), ("d", 8.0)]
    got = {r.g: r.percentile for r in evaluation.exact_percentile(spark.createDataFrame(data, "g string, v double"), "g", "v", 0.5, 10.0).collect()}
    assert got == {"a": statistics.median(v for g, v in data if g == "a"), "b": 3.5, "d": 0.375}


def test_group_limit_stands_before_the_exchange(spark):
    hits = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").cast("string").alias("chunk_id"), F.rand(1).alias("score"))
    plan = retrieval.rank_lists(hits, 5, ["query_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bm25_against_the_formula(spark):
    import math
    import re
    from collections import Counter

    docs = {"a": "猫吃鱼 abc", "b": "狗吃鱼吃鱼", "c": "鸟 第三条", "d": "", "e": "abc abc"}
    toks = lambda s: re.findall("第[一二三]条", s) + re.findall("[a-z]+", re.sub("第[一二三]条", " ", s)) + [x for r in re.findall("[一-鿿]+", re.sub("第[一二三]条", " ", s)) for x in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]
    bags = {k: Counter(toks(v)) for k, v in docs.items()}
    avg = sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(x for b in bags.values() for x in b)
    raw = {x: math.log((len(docs) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {x: 0.25 * mean if v < 0 else v for x, v in raw.items()}
    want = {}
    for k, b in bags.items():
        s = sum(idf[x] * b[x] * 2.5 / (b[x] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for x in toks("吃鱼 abc") if b[x])
        if s > 0:
            want[k] = round(s, 5)
    got = retrieval.bm25(spark.createDataFrame(list(docs.items()), "k string, text string"), spark.createDataFrame([("q", "吃鱼 abc"), ("none", "")], "q string, text string"), "k", "q", 9)
    assert {r.k: r.score for r in got.collect()} == want
