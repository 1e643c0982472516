"""Where a question goes: answered by lookup or by search, asked back, refused or chatted about. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions.references import article_references, compact

# The phrases and patterns of the routing rules.
OLD_VERSION = ("修法前", "修改前", "修订前", "旧法", "旧版", "历史版本", "废止前", "失效前", "原来怎么规定", "以前怎么规定", "当时怎么规定", "当时如何规定", "那时怎么规定", "当年的规定")
OLD_CASE = ("当时", "那时", "彼时", "签订时", "订立时", "发生时", "被罚时", "受伤时", "适用什么", "应适用", "应当适用", "按当时", "按彼时")
PAST = r"(?:(?:19|20)[0-9]{2}(?:年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?|[-./][0-9]{1,2}(?:[-./][0-9]{1,2})?)|(?:[0-9]{1,2}年前|上一年|上年|去年|前年|那年|当年))"
CUTOFF = "(?:截至|截止至|截止到)(?:19|20)[0-9]{2}年"
YEAR = "(?:19|20)[0-9]{2}年"
ENACTED = "^(?:19|20)[0-9]{2}年(?:通过|颁布|公布|施行|生效)(?:并(?:公布|施行|生效))?的"
RULE = "(?:《[^《》]+》|[\\x{4E00}-\\x{9FFF}]{1,20}(?:法|法典)|法律|法规|法条|条文)"
ASKED = "(?:(?:怎么|如何|有何|有什么|是怎样(?:的)?)规定|规定(?:是什么|有哪些|了什么))"
OTHER_TOPICS = (
    "(?:今天天气|明天天气|天气怎么样|天气预报)", "(?:菜谱|怎么做菜|做饭教程|家常菜|推荐[^，。！？?]{0,8}菜)", "(?:游戏攻略|怎么通关|游戏推荐)", "(?:星座|算命)",
    "(?:减肥计划|健身计划|穿搭推荐|化妆教程)", "(?:数学题|解方程|求导|积分题)", "(?:销量|销售额|市场份额|市场规模|保费收入)",
    "(?:英语|外语|口语).{0,12}(?:怎么学|学好|学习)|怎么.{0,8}学好英语", "(?:Python|Java|编程语言).{0,16}(?:初学者|学习|选择)", "(?:股市|股票).{0,12}(?:涨|跌|行情|走势)",
    "(?:高铁|火车|飞机).{0,12}(?:多久|多长时间|时长)", "(?:感冒|发烧).{0,12}(?:吃什么药|用什么药|好得快)", "(?:手机|相机).{0,12}(?:拍照|推荐|最好)", "(?:帮我|请|给我)(?:写|创作).{0,12}(?:诗|小说|故事)",
)
LEGAL = (
    "法律", "法条", "条文", "法规", "刑法", "民法", "诉讼", "合同", "赔偿", "补偿", "处罚", "合法", "违法", "犯罪", "盗窃", "权利", "义务", "侵权", "劳动", "工伤", "婚姻", "公司法", "股东", "董事",
    "清算", "税务", "仲裁", "责任", "被盗", "诈骗", "拒赔", "理赔", "保险合同", "隐私", "版权",
)
SOURCES = "(?:行政法规|监察法规|地方性法规|司法解释|指导性案例|判例)"
_FOR = "(?:帮我|替我|给我|为我|请)"
_PAPER = "(?:起诉状|答辩状|上诉状|申诉书|律师函|合同)"
TASKS = (
    f"{_FOR}(?:代写|撰写|起草|制作)(?:一份|一个|个)?[^，。！？?]{{0,12}}{_PAPER}", f"{_FOR}写(?:一份|一个|个)?[^，。！？?]{{0,12}}{_PAPER}",
    f"{_FOR}(?:完整)?(?:审阅|审核|修改)(?:这份|一份|整份|完整)?[^，。！？?]{{0,8}}{_PAPER}",
)
OUTCOMES = (
    "(?:预测|估算|预判)[^，。！？?]{0,12}(?:胜诉率|胜诉概率|败诉概率|会不会胜诉|能否胜诉|会判几年|判刑多久)", "(?:胜诉率|胜诉概率)[^，。！？?]{0,8}(?:多少|多高)", "(?:保证|确保)[^，。！？?]{0,12}(?:一定|肯定)?胜诉",
    "(?:规避|绕过|逃避)[^，。！？?]{0,16}(?:监管|检查|审查|执法|处罚)",
)
#: Code points of the longest question, and how far behind a time what is asked about it may stand.
LONGEST, SCOPE = 256, 80
#: The name of the contract act is no contract: it is put out of sight before papers are looked for. RE2 and Java alike.
HIDDEN = (("写一下合同法", "写一下某某"), ("写合同法", "写某某"), ("合同法", "某某法"))


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _after(text: Column, pattern: str, with_match: bool) -> Column:
    """The text from each match of pattern on, with the match or from its end."""
    found, parts = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda _, i: F.substring(text, size(parts, i + 1) + size(found, i + F.lit(0 if with_match else 1)) + 1, F.lit(1 << 20)))


def depends_on_old_law(text: Column) -> Column:
    """Whether a question (without blanks) asks for the law of another time."""
    untitled = F.regexp_replace(text, "《[^《》]*》", "《法名》")
    dated = F.exists(_after(untitled, YEAR, True), lambda s: ~s.rlike(ENACTED) & (F.size(article_references(F.substring(s, 1, SCOPE))) > 0))
    starts, ends = _after(text, PAST, True), _after(text, PAST, False)
    asked = F.exists(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: ~x["s"].rlike(ENACTED) & F.substring(x["e"], 1, SCOPE).rlike(RULE) & F.substring(x["e"], 1, SCOPE).rlike(ASKED))
    return text.rlike(any_of(OLD_VERSION)) | text.rlike(CUTOFF) | dated | asked | (text.rlike(PAST) & text.rlike(any_of(OLD_CASE)))


def route(question: Column) -> Column:
    """route (answer, clarify, refuse, general_chat), reason (null for answers) and mode (exact_lookup or retrieval for
    answers) of a question. Rules are asked in a fixed order and the first one decides. Null counts as empty."""
    q = F.coalesce(question, F.lit(""))
    text = compact(q)
    papers = text
    for name, other in HIDDEN:
        papers = F.replace(papers, F.lit(name), F.lit(other))
    references = F.size(article_references(text))
    legal = (references > 0) | text.rlike(any_of(LEGAL))
    other = text.rlike(any_of(OTHER_TOPICS)) & ~legal
    task = papers.rlike(any_of(TASKS)) | text.rlike(any_of(OUTCOMES))
    to = lambda r, reason, mode=None: F.struct(F.lit(r).alias("route"), F.lit(reason).cast("string").alias("reason"), F.lit(mode).cast("string").alias("mode"))
    return (
        F.when(~q.rlike("[A-Za-z0-9\\x{4E00}-\\x{9FFF}]"), to("clarify", "empty_input")).when(F.length(text) > LONGEST, to("clarify", "query_too_long"))
        .when(task, to("refuse", "unsupported_legal_task")).when(text.rlike(SOURCES), to("refuse", "unsupported_legal_source"))
        .when(~other & depends_on_old_law(text), to("refuse", "time_sensitive")).when(other, to("general_chat", "non_legal"))
        .when(references > 3, to("clarify", "scope_too_broad")).when(references > 0, to("answer", None, "exact_lookup")).otherwise(to("answer", None, "retrieval"))
    )
