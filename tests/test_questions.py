"""References in questions, numbers of articles, routing."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import references as R, routing


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, q string").orderBy("k").select(column(F.col("q"))).collect()]


def test_exact_references(spark):
    cases = {
        "请告诉我《某某消防法》第 60 条的内容": [("某某消防法", "第60条")], "刑法第一百三十三条之一怎么规定？": [("刑法", "第一百三十三条之一")], "2020年通过的民法典第577条是什么？": [("民法典", "第577条")],
        "《某某法》第264条和第266条是什么？": [("某某法", "第264条"), ("某某法", "第266条")], "《某某法》第264、266条是什么？": [("某某法", "第264条"), ("某某法", "第266条")],
        "《某某法》第264条、266条之二是什么？": [("某某法", "第264条"), ("某某法", "第266条之二")], "请对比民法典第577、584、585条。": [("民法典", "第577条"), ("民法典", "第584条"), ("民法典", "第585条")],
        "比较《甲法》第264条和《乙法典》第577条。": [("甲法", "第264条"), ("乙法典", "第577条")], "甲条例（修订）的第3条": [("甲条例（修订）", "第3条")],
    }
    got = one(spark, R.exact_references, *cases)
    assert [(g.status, [tuple(x) for x in g.references]) for g in got] == [("found", v) for v in cases.values()]
    unclear = ["第264条是什么？", "甲法和乙法第264条是什么？", "《甲法》和《乙法》第264条是什么？", "甲法第1、2、3、4条是什么？"]
    assert [(g.status, g.references) for g in one(spark, R.exact_references, *unclear)] == [("clarify", [])] * 4
    assert [g and g.status for g in one(spark, R.exact_references, "房东不退押金", "", None)] == ["none", "none", None]


def test_reference_counts(spark):
    cases = {"刑法第264条": 1, "刑法第264、266条": 2, "刑法第264条、266条、第267条": 3, "刑法第1、2、3、4条": 4, "无": 0}
    assert one(spark, lambda q: F.size(R.article_references(q)), *cases) == list(cases.values())


def test_article_numbers_in_one_form(spark):
    cases = {"第一百三十三条之一": "133之一", "133之1": "133之一", "第 264 条": "264", "二百〇三": "203", "第两百条": "200", "第007条": "7", "0": None, "一百三": None, "第1百条": None, "第3条之一百": None, "第十条之二十三": "10之二十三", "abc": None, "": None, None: None}
    assert one(spark, R.article_key, *cases) == list(cases.values())


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("刑法第264条是什么？", ("answer", None, "exact_lookup")), ("房东不退押金怎么办？", ("answer", None, "retrieval")), ("我想咨询一下", ("answer", None, "retrieval")), ("今天天气怎么样？", ("general_chat", "non_legal", None)),
        ("请帮我代写一份离婚起诉状。", ("refuse", "unsupported_legal_task", None)), ("帮我写一下合同法的要点", ("answer", None, "retrieval")), ("帮我写一份租房合同", ("refuse", "unsupported_legal_task", None)),
        ("2020年修法前劳动法如何规定？", ("refuse", "time_sensitive", None)), ("截至2019年的规定", ("refuse", "time_sensitive", None)), ("2015年刑法第264条是什么", ("refuse", "time_sensitive", None)),
        ("2015年通过的某法第264条是什么", ("answer", None, "exact_lookup")), ("去年劳动法怎么规定的", ("refuse", "time_sensitive", None)), ("2018年签订时适用什么", ("refuse", "time_sensitive", None)), ("司法解释怎么说", ("refuse", "unsupported_legal_source", None)),
        ("甲法第1、2、3、4条", ("clarify", "scope_too_broad", None)), ("？！", ("clarify", "empty_input", None)), (None, ("clarify", "empty_input", None)), ("问" * 257, ("clarify", "query_too_long", None)),
        ("胜诉率有多高", ("refuse", "unsupported_legal_task", None)), ("股票走势违法吗", ("answer", None, "retrieval")), ("怎么规避监管检查", ("refuse", "unsupported_legal_task", None)), ("去年天气怎么样，当时", ("general_chat", "non_legal", None)),
    ],
)
def test_routes(spark, question, want):
    assert tuple(one(spark, routing.route, question)[0]) == want
