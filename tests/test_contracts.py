"""Logs, selection, scoring, windows, frozen values: by hand-made cases, with nulls, ties and empty tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import corpus, logs, scoring

LOG = "run string, at long, kind string, mode string"


def log(spark, **runs):
    return spark.createDataFrame([(r, k, kind, mode) for r, events in runs.items() for k, (kind, mode) in enumerate(events)], LOG)


def kinds(*names):
    return [(n, None) for n in names]


def test_last_run_is_that_of_the_last_start(spark):
    df = log(spark, a=kinds("start", "done", "start", "x"), b=kinds("start", "start", "done", "done"), c=kinds("done", "x"), d=kinds("start", None))
    got = {r.run: (r.started, r.completed, r.state) for r in logs.last_run(df, ["run"], "at", "kind", "start", "done").collect()}
    assert got == {"a": (2, None, "running"), "b": (1, 3, "complete"), "c": (None, None, "none"), "d": (0, None, "running")}
    assert logs.last_run(df.limit(0), ["run"], "at", "kind", "start", "done").count() == 0


def test_traces_and_failures(spark):
    df = log(spark, a=kinds("in", "x", "out"), b=kinds("x", "out"), c=kinds("in", "out", "x"), d=kinds("in", "bad", "out"), e=kinds("bad"))
    assert {r.run: r.complete for r in logs.traces(df, ["run"], "at", "kind", "in", ("out", "bad")).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    assert {r.run: r.code for r in logs.failure_codes(df, ["run"], "at", "kind", "bad").collect()} == {"a": "completed", "b": "completed", "c": "completed", "d": "failed_after_in", "e": "failed_at_start"}


def test_last_known_value(spark):
    df = log(spark, a=[("x", "m"), ("x", "n"), ("x", None)], b=[("x", None)])
    assert {r.run: r["mode"] for r in logs.last_known(df, ["run"], "at", "mode").collect()} == {"a": "n", "b": None}


def test_tool_runs(spark):
    df = log(spark, a=kinds("s", "h", "a"), b=kinds("s", "s", "s", "a"), c=kinds("m", "a"), d=kinds("a", "h"), e=kinds("a", "m"), f=kinds("h"))
    names = {"search": "s", "hit": "h", "answer": "a", "miss": "m"}
    assert {r.run: r.verdict for r in logs.tool_runs(df, ["run"], "at", "kind", names, 2).collect()} == {"a": "valid", "b": "too_many_searches", "c": "answered_after_miss", "d": "hit_not_promoted", "e": "valid", "f": "hit_not_promoted"}


def test_no_candidate_below_the_baseline(spark):
    df = spark.createDataFrame([("q", "base", 2, -1), ("q", "x", 2, -3), ("r", "base", 1, -2), ("r", "x", 1, -2), ("r", "y", 1, -2), ("s", "base", 1, 0)], "q string, c string, hit int, first int")
    got = {r.q: r.chosen for r in logs.non_degrading(df, "q", "c", "base", ["hit", "first"]).collect()}
    assert got == {"q": "noop", "r": "y", "s": "noop"}


def test_reranker_takes_the_best_window_and_any_scorer(spark):
    pool = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("q", "d", 4)], "query_id string, chunk_id string, rank int")
    q = spark.createDataFrame([("q", "押金退还")], "query_id string, text string")
    texts = spark.createDataFrame([("a", "无关的内容"), ("b", "前" * 900 + "押金退还"), ("c", "押金")], "chunk_id string, text string")
    got = [(r.chunk_id, r.lexical) for r in scoring.rerank(pool, q, texts, "query_id", "chunk_id").orderBy("rerank").collect()]
    assert got == [("b", 1.0), ("c", round(1 / 3, 6)), ("a", 0.0), ("d", 0.0)]

    @F.pandas_udf("double")
    def length(question: pd.Series, window: pd.Series) -> pd.Series:
        return window.str.len().astype(float)

    assert scoring.rerank(pool, q, texts, "query_id", "chunk_id", length, inline=False).orderBy("rerank").first().chunk_id == "b"


def test_windows_by_tokens_end_at_boundaries():
    body = "甲乙丙丁戊。" * 10
    got = scoring.token_windows(body, 0, 20, 4)
    assert all(body[b - 1] == "。" for _, b in got) and got[0] == (0, 18) and got[-1][1] == len(body)
    assert all(x[0] < y[0] < x[1] or y[0] == x[1] for x, y in zip(got, got[1:])) and all(b - a <= 20 for a, b in got)
    assert scoring.token_windows("", 0, 20, 4) == [] and scoring.token_windows("甲" * 50, 5, 25, 5) == [(0, 20), (15, 35), (30, 50)]
    assert scoring.token_windows("abc def", 0, 5, 1, lambda t: [(0, 3), (4, 7)]) == [(0, 7)]
    with pytest.raises(ValueError):
        scoring.token_windows("a", 10, 12, 4)


def test_token_counters(spark):
    x = spark.createDataFrame([("ab1 甲，c",), ("",), (None,)], "t string").select(scoring.regex_tokens(F.col("t"))).collect()
    assert [r[0] for r in x] == [4, 0, None]
    chat = spark.createDataFrame([([("user", "a b"), ("assistant", "甲乙")],)], "m array<struct<role:string,content:string>>")
    assert chat.select(scoring.prompt_tokens(F.col("m"))).first()[0] == 2 * (4 + 1 + 2)


def test_pair_counts_of_all_texts(spark):
    df = spark.createDataFrame([("aab",), (None,), ("",), ("b",), ("ab\U0001f600",)], "t string").repartition(2)
    assert {r.pair: r.n for r in corpus.pair_counts(df, "t").collect()} == {"aa": 1, "ab": 2, "b\U0001f600": 1}
    assert corpus.pair_counts(df.limit(0), "t").count() == 0


def test_text_functions(spark):
    x = spark.createDataFrame([("é　 x ",), (None,), ("",)], "t string")
    assert [r[0] for r in x.select(text.normalized(F.col("t"))).collect()] == ["é x", None, ""]
    assert x.select(text.question_digest(F.col("t"))).first()[0] == spark.createDataFrame([("é x",)], "t string").select(text.question_digest(F.col("t"))).first()[0]
    m = spark.createDataFrame([({"b": 2, "a": 1},), ({},), (None,)], "m map<string,int>").select(text.frozen(F.col("m"))).collect()
    assert [r[0] for r in m] == ['{"a":1,"b":2}', "{}", None]
    paths = spark.createDataFrame([("a/b.bin",), ("/a.bin",), ("a/../b.bin",), ("..bin",), ("a//b.bin",), ("a.txt",), (None,)], "p string")
    assert [r[0] for r in paths.select(text.safe_path(F.col("p"), ".bin")).collect()] == [True, False, False, True, False, False, None]
    d = spark.createDataFrame([("（删去）",), (" 删除 ",), ("三个字",), ("四个字。",), (None,)], "t string")
    assert [r[0] for r in d.select(text.is_deleted(F.col("t"))).collect()] == [True, True, True, False, True]
