"""Texts that look the same but differ in their characters: one form for all of them.

Each value is mapped sign by sign (width, coding variants of a glyph, look-alike letters; invisible signs go), all inside
the JVM, and the mapped values are grouped in SQL under the accent- and case-sensitive Unicode collation, which also holds
composed and decomposed accents equal. Of each class a canonical member is chosen and joined back.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from corvane.runtime import materialize

# Letters that look like a Latin letter or another sign, each before the sign it looks like.
LOOK_ALIKE = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϹC ϲc ϳj "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҮY ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv "
    "νv ρp υu αa γy ӏl ӀI гr пn ьb "
    # Cherokee, Lisu and small capitals, which are drawn as Latin letters
    "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏟC ᏢP ᏙV ᏚS ᏞL ᏦK ᏴB ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs "
    # points, primes and strokes
    "∶: ꞉: ꞏ· ‧· ∙· ⋅· ‚, ‘' ’' ʹ' ʼ' ′' ⁄/ ∕/ ∼~ ˗- "
    "ՕO օo ɡg ɑa ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM ⅰi ⅴv ⅹx ⅼl ⅽc ⅾd ⅿm ‐- ‑- −- ◯〇 ○〇 "
    # radicals that are drawn as the character
    "⺁厂 ⺄乙 ⺅亻 ⺇几 ⺉刂 ⺌小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺖忄 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬 "
    "⺨犭 ⺩王 ⺪疋 ⺫目 ⺬示 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺹耂 ⺺肀 ⺼月 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 "
    "⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙"
)
# Ranges of signs that leave no mark on the page.
INVISIBLE = ((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0001, 0xE007F), (0xE0100, 0xE01EF))


@lru_cache(maxsize=1)
def sign_table() -> dict[str, str]:
    """The sign each sign is drawn like, or '' for invisible ones.

    By rule, from the Unicode decompositions of one sign: wide and narrow forms, no-break forms, radicals, spaces, and
    signs coded twice (canonical singletons). Other compatibility forms, such as raised digits, look different and stay.
    """
    table: dict[str, str] = {}
    for cp in [*range(0xA0, 0x3400), *range(0xF900, 0xFB00), *range(0xFE10, 0x10000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20)]:
        parts = unicodedata.decomposition(chr(cp)).split()
        tag = parts.pop(0) if parts and parts[0].startswith("<") else ""
        if len(parts) != 1:
            continue
        to = chr(int(parts[0], 16))
        if tag in ("", "<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and (0x2E80 <= cp < 0x2FE0 or to == " "):
            table[chr(cp)] = to
    table |= {a: b for a, b in (x for x in LOOK_ALIKE.split())}
    table |= {chr(cp): "" for a, b in INVISIBLE for cp in range(a, b + 1)}
    for sign in list(table):
        seen = sign
        for _ in range(4):
            seen = table.get(seen, seen)
        table[sign] = seen
    return table


def _translated(column: str | Column, table: dict[str, str]) -> Column:
    kept = [k for k, v in table.items() if v]
    gone = [k for k, v in table.items() if not v]
    c = F.col(column) if isinstance(column, str) else column
    spelt = c
    for k in range(0xFB00, 0xFB07):  # ligatures become two or three signs
        spelt = F.replace(spelt, F.lit(chr(k)), F.lit(unicodedata.normalize("NFKC", chr(k))))
    # nearly all texts of a corpus hold none of the signs of the table
    odd = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ranges([ord(k) for k in table] + [*range(0xFB00, 0xFB07)])) + "]"
    return F.when(c.rlike(odd), F.translate(spelt, "".join(kept) + "".join(gone), "".join(table[k] for k in kept))).otherwise(c)


def mapped(column: str | Column) -> Column:
    """The text with each sign as it looks, by built-in functions only."""
    return _translated(column, sign_table())


@lru_cache(maxsize=1)
def base_table() -> dict[str, str]:
    """sign_table with accented letters put down to their base and accents removed."""
    table = dict(sign_table())
    for cp in [*range(0xC0, 0x3100), *range(0xFB1D, 0xFB50), *range(0x11000, 0x11940), *range(0x1D100, 0x1D200)]:
        if unicodedata.combining(chr(cp)):
            table[chr(cp)] = ""
        elif chr(cp) not in table and (base := unicodedata.normalize("NFD", chr(cp))[0]) != chr(cp):
            table[chr(cp)] = table.get(base, base)
    for cp in [*range(0xC0, 0x3100), *range(0xFB1D, 0xFB50), *range(0x11000, 0x11940), *range(0x1D100, 0x1D200)]:
        for mark in unicodedata.normalize("NFD", chr(cp))[1:]:  # vowel signs and the like, which no class marks as combining
            table[mark] = ""
    for k in range(19 * 21 * 28):  # a Hangul syllable goes by its leading letter, as its single letters do
        table[chr(0xAC00 + k)] = chr(0x1100 + k // (21 * 28))
    table |= {chr(cp): "" for cp in [*range(0x1160, 0x1200), *range(0xD7B0, 0xD800)]}
    for sign, to in table.items():  # what a sign is drawn like may itself be accented, or an accent
        base = unicodedata.normalize("NFD", to)[:1]
        table[sign] = "" if base and unicodedata.combining(base) else table.get(base, base)
    return table


def _ranges(cps: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in sorted(cps):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


def canonical(values: DataFrame) -> DataFrame:
    """kind, key, raw and canonical of values (kind, key, raw), raw being any text; null stays null.

    The canonical member of a class is the one that mapping doesn't change, else the first by code points; if no member
    is as mapped, the class still gets a member of its own and no invented value. A class of one form has that form.
    Empty and blank texts are values like any other. A key that stands there more than once counts once; null is a key. Other columns are ignored.
    """
    values = values.select("kind", "key", "raw")
    named, forms = _classes(values)
    classes = named.join(forms.filter("f = c").select("c", F.col("raw").alias("canonical")), "c").select("kind", "key", "canonical")
    return values.dropDuplicates(["kind", "key"]).join(classes, ["kind", "key"], "left").select("kind", "key", "raw", F.coalesce("canonical", "raw").alias("canonical"))


def _classes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """named: kind, key, f and c, the numbers of its form and of its class, of the rows of values in classes that may have
    more forms, each key once; forms: kind, f, c and raw. The canonical form of a class is the one with f = c.

    Strings that the collation holds equal have the same base signs, so a hash of these brings every class together. Only
    hashes are exchanged to learn which classes have several forms. Of what is in those, the distinct texts are collated,
    however often each stands there, and keys then go by numbers.
    """
    there = values.select("kind", "key", "raw").filter("raw is not null and key is not null")
    hashes = materialize(there.select("kind", "key", F.xxhash64("kind", _translated("raw", base_table())).alias("h"), F.xxhash64("raw").alias("r")), "looks")
    various = hashes.groupBy("h").agg(F.min("r").alias("a"), F.max("r").alias("b")).filter("a <> b").select("h")
    keys = hashes.join(various, "h", "left_semi").select("kind", "key").distinct()
    kept = materialize(there.join(keys, ["kind", "key"], "left_semi"), "lookalike").dropDuplicates(["kind", "key"])
    texts = materialize(kept.select("kind", "raw").distinct().withColumn("f", F.monotonically_increasing_id()), "texts")
    looks = texts.withColumn("look", F.collate(mapped("raw"), "UNICODE"))
    first = F.struct((F.col("raw") != F.collate("look", "UTF8_BINARY")).alias("changed"), "raw", "f")
    classes = looks.groupBy("kind", "look").agg(F.min(first)["f"].alias("c"))
    forms = materialize(looks.join(classes, ["kind", "look"]).select("kind", "raw", "f", "c"), "forms")
    return materialize(kept.join(forms, ["kind", "raw"]).select("kind", "key", "f", "c"), "named"), forms


def _pairs(named: DataFrame) -> DataFrame:
    """Pairs of keys of one kind and class with other forms, once each: the forms are paired, then their keys."""
    forms = named.select("c", "f").distinct()
    pairs = forms.withColumnRenamed("f", "f_a").join(forms.withColumnRenamed("f", "f_b"), "c").filter("f_a < f_b").drop("c")
    a, b = named.select("kind", F.col("f").alias("f_a"), F.col("key").alias("a")), named.select(F.col("f").alias("f_b"), F.col("key").alias("b"))
    return pairs.join(a, "f_a").join(b, "f_b").select("kind", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def _across(named: DataFrame) -> DataFrame:
    """Pairs of a key of the clean side and one of the other side, told by the first sign of the key, of one class."""
    side = lambda s: named.filter(F.col("key").startswith(s)).select("kind", "c", F.substring("key", 2, 1 << 30).alias(f"key_{s}"), F.col("f").alias(f"f_{s}"))
    return side("a").join(side("b"), ["kind", "c"]).filter("f_a <> f_b").select("kind", "key_a", "key_b")


def same_look_pairs(values: DataFrame) -> DataFrame:
    """kind, key_a, key_b (key_a < key_b): pairs of keys of a kind whose texts look the same but aren't the same string.

    Null texts look like nothing. Exact copies are no pair of their own, but each of them pairs with every other form;
    the classes are paired form by form, so copies are only expanded into what the result holds. A key that stands there
    more than once counts once.
    """
    return _pairs(_classes(values)[0])


def same_look_as(values: DataFrame, clean: DataFrame) -> DataFrame:
    """kind, key_a, key_b: keys of clean (kind, key, raw) and of values with a text that looks the same but isn't the same."""
    return _across(_classes(_sides(values, clean))[0])


def _sides(values: DataFrame, clean: DataFrame) -> DataFrame:
    marked = lambda df, side: df.select("kind", F.concat(F.lit(side), "key").alias("key"), "raw")
    return marked(clean, "a").unionByName(marked(values, "b"))


def same_look(texts: DataFrame, values: DataFrame, clean: DataFrame) -> DataFrame:
    """same_look_pairs(texts) and same_look_as(values, clean) in one pass; the kinds of texts must be others."""
    named, _ = _classes(texts.select("kind", F.concat(F.lit("t"), "key").alias("key"), "raw").unionByName(_sides(values, clean)))
    own = named.filter(F.col("key").startswith("t")).withColumn("key", F.substring("key", 2, 1 << 30))
    return _pairs(own).unionByName(_across(named.filter(~F.col("key").startswith("t"))))
