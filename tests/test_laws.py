"""Texts of laws: contents, headings, articles."""

from corvane.operators import laws as L

LAW = "\n".join(["某某法", "目录", *[f"第{n}章 事项{n}" for n in "一二三四五六"], "", "某某法", "第一编 总则", "第一章 基本　规定", "第一条 为了规范活动，制定本法。", "－1－", "第二条", "本法适用于下列活动。",
                 "第二章 程序", "第一节 申请", "第三条 申请应当书面提出。", "第三条之一 口头申请的，记录在案。", "第四条 （删去）", "第二编 分则", "第五条 依照本法第三章办理。", "第三章 附则", "第六条 本法自公布之日起施行。"])


def test_contents_are_cut_and_articles_stand_under_their_headings():
    text = L.clean(LAW)
    assert text.startswith("某某法\n第一编") and "－1－" not in text
    got = [(no, content, above) for _, no, content, above in L.articles(text)]
    assert got == [
        ("1", "为了规范活动，制定本法。", {"编": "第1编 总则", "章": "第1章 基本规定"}), ("2", "本法适用于下列活动。\n第二章 程序", {"编": "第1编 总则", "章": "第1章 基本规定"}),
        ("3", "申请应当书面提出。", {"编": "第1编 总则", "章": "第2章 程序", "节": "第1节 申请"}), ("3之一", "口头申请的，记录在案。", {"编": "第1编 总则", "章": "第2章 程序", "节": "第1节 申请"}),
        ("5", "依照本法第三章办理。", {"编": "第2编 分则"}),
    ]


def test_runs_of_headings():
    run = [f"第{n}章 甲" for n in "一二三四五六"]
    assert L.contents_end([*run, "正文"]) == 6 and L.contents_end([*run, "", "正文"]) == 7
    assert L.contents_end([*run[:5], "正文"]) == 0 and L.contents_end([*run[:3], "", *run[3:], "正文"]) == 0
    assert L.contents_end([*run, "甲", *run, "乙"]) == 13 and L.contents_end(run) == 0


def test_longest_of_one_number_and_inner_articles():
    assert [(a[1], a[2]) for a in L.articles("第一条 短的内容\n第一条 长一些的内容\n第二条 其他内容")] == [("1", "长一些的内容"), ("2", "其他内容")]
    long = "第三条 甲乙丙丁" + "戊" * 2100
    assert len(L.articles(long)[0][2]) == 2000
    assert L.clean_content("内容。\n第二章 其他") == "内容。" and L.clean_content("内容。 －12－ ") == "内容。"


def test_tables(spark):
    df = spark.createDataFrame([("a", LAW), ("b", None), ("c", ""), ("d", "没有条文")], "k string, t string")
    assert sorted((r.k, r.article_no) for r in L.segment(df, "k", "t").collect()) == [("a", n) for n in ("1", "2", "3", "3之一", "5")]
    assert L.segment(df.limit(0), "k", "t").count() == 0 and L.contents_table(df, "k", "t").collect()[0].k == "a"
    assert {r.level for r in L.heading_table(df, "k", "t").collect()} == {"编", "章", "节"}
