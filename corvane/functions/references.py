"""References to articles of laws in questions, as column expressions: 《law》第n条, coordinated numbers, inherited laws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions.numerals import chinese_number, format_number, let

# Numerals, words between references, endings of laws' names, words before a name, forms of enactment.
NUMERAL = "[零〇一二三四五六七八九十百千万两0-9]+"
AND = "(?:以及|或者|[、，,和及与或])"
SUFFIX = f"(?:之{NUMERAL})?"
GROUP = f"第{NUMERAL}(?:{AND}第?{NUMERAL})*条{SUFFIX}(?:{AND}{NUMERAL}条{SUFFIX})*"
ENDING = "(?:法典|法|条例|规定|决定|办法|规则|通则)"
TITLE = "《([^《》]+)》"
BARE = f"^([\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9·]+?{ENDING}(?:（[^（）]+）)?)(?:的)?$"
SEVERAL = f"(?:{ENDING}|》){AND}(?:《)?[^《》]*{ENDING}(?:》)?(?:的)?$"
BEFORE = ("请告诉我", "请解释一下", "请说明一下", "请对比一下", "请比较一下", "帮我查一下", "我想了解", "请解释", "请说明", "请对比", "请比较", "帮我查", "请问", "根据", "按照", "对比", "比较")
ENACTED = "^(?:在)?(?:19|20)[0-9]{2}年(?:通过|颁布|公布|施行|生效)的"
#: What goes before a bare name of a law, in this order.
STRIP = (f"^(?:{AND}|[。；;：:])+", "^(?:" + "|".join(BEFORE) + ")[：:,，]*", ENACTED)
#: More references than this in one question are too many to look up.
MOST = 3


def compact(question: Column) -> Column:
    return F.regexp_replace(question, r"\s+", "")


def numbers_of(group: Column) -> Column:
    """The references of a coordinated group, each spelt out: 第264、266条 gives 第264条 and 第266条."""
    each = F.regexp_extract_all(F.regexp_replace(group, "第", ""), F.lit(f"({NUMERAL}(?:条之{NUMERAL})?)"), F.lit(1))
    return F.transform(each, lambda n: F.concat(F.lit("第"), n, F.when(F.contains(n, F.lit("条")), "").otherwise("条")))


def article_references(question: Column) -> Column:
    """All references of a question in order, spelt out; an empty array if there are none, null for null."""
    groups = F.regexp_extract_all(compact(question), F.lit(f"({GROUP})"), F.lit(1))
    return F.flatten(F.transform(groups, numbers_of))


def _law(segment: Column) -> Column:
    """The law that the text before a reference names, null if it names none."""
    bare = segment
    for pattern in STRIP:
        bare = F.regexp_replace(bare, pattern, "")
    titles = F.regexp_extract_all(segment, F.lit(TITLE), F.lit(1))
    return let(titles, lambda found: F.when(F.size(found) > 0, F.trim(F.element_at(found, -1))).otherwise(let(F.regexp_extract(bare, BARE, 1), lambda name: F.nullif(name, F.lit("")))))


def exact_references(question: Column) -> Column:
    """status and references (law, no) of a question.

    status: none (no reference), clarify (more than MOST, a reference without a law, or several laws before one) or
    found. A reference without a law of its own takes that of the reference before it. No part of the references is given
    unless all are clear. Null for a null question.
    """
    text = compact(question)
    groups = F.regexp_extract_all(text, F.lit(f"({GROUP})"), F.lit(1))
    before = F.slice(F.split(text, GROUP), F.lit(1), F.size(groups))
    first = F.struct(F.lit(None).cast("string").alias("law"), F.lit(True).alias("clear"), F.array().cast("array<struct<law:string,no:string>>").alias("refs"))

    def step(acc: Column, x: Column) -> Column:
        several = (F.size(F.regexp_extract_all(x["0"], F.lit(TITLE), F.lit(1))) > 1) | x["0"].rlike(SEVERAL)
        refs = lambda law: F.transform(numbers_of(x["1"]), lambda n: F.struct(law.alias("law"), n.alias("no")))
        return let(F.coalesce(_law(x["0"]), acc["law"]), lambda law: F.struct(law.alias("law"), (acc["clear"] & ~several & law.isNotNull()).alias("clear"), F.concat(acc["refs"], refs(law)).alias("refs")))

    def verdict(done: Column) -> Column:
        n = F.size(done["refs"])
        status = F.when(n == 0, "none").when((n > MOST) | ~done["clear"], "clarify").otherwise("found")
        kept = F.when((n > 0) & (n <= MOST) & done["clear"], done["refs"]).otherwise(F.array().cast("array<struct<law:string,no:string>>"))
        return F.struct(status.alias("status"), kept.alias("references"))

    zipped = F.arrays_zip(before.alias("0"), groups.alias("1"))
    return F.when(question.isNotNull(), let(F.aggregate(zipped, first, step), verdict))


def _strict(numeral: Column) -> Column:
    """The value of digits or of a Chinese numeral in its usual spelling, above 0; null for anything else."""
    plain = F.translate(numeral, "〇两", "零二")
    usual = let(chinese_number(plain), lambda v: F.when(format_number(v) == plain, v))
    return F.nullif(F.when(numeral.rlike("^[0-9]+$"), numeral.try_cast("int")).when(~numeral.rlike("[0-9]"), usual), F.lit(0))


def article_key(no: Column) -> Column:
    """An article's number in one form: 第一百三十三条之一 and 133之1 are 133之一. Null for what is no number, is spelt in an
    unusual way, mixes digits with numerals, is 0, or has a suffix above 99."""
    text = F.regexp_replace(no, r"\s+", "")
    form = f"^第?({NUMERAL})条?(?:之({NUMERAL}))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, form, k), F.lit(""))
    with_suffix = lambda main: let(_strict(part(2)), lambda more: F.when(more < 100, F.concat(main.cast("string"), F.lit("之"), format_number(more))))
    return let(_strict(part(1)), lambda main: F.when(part(2).isNull(), main.cast("string")).otherwise(with_suffix(main)))
