"""Text functions of the corpus as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def sentences(text: Column) -> Column:
    """The sentences of a text with their closing signs; blank rests are left out."""
    return F.regexp_extract_all(text, F.lit(r"([^。！？；\n]+[。！？；]*)"), F.lit(1))


def clean_text(text: Column) -> Column:
    """Page numbers between hyphens and runs of empty lines go; outer blanks go."""
    no_pages = F.regexp_replace(text, r"[ \t\n]*[－\-][0-9]+[－\-][ \t\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(no_pages, r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


#: White space as Python and Unicode have it, which is more than \s of the JVM.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def nfc(text: Column) -> Column:
    """The text in composed form (NFC). The JVM has no built-in function for it, so it runs in Arrow batches."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v) if isinstance(v, str) else None)

    return run(text)


def normalized(text: Column) -> Column:
    """The text composed, with runs of white space made one blank and none at its ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(nfc(text), SPACE, " "), "^ | $", "")


def question_digest(text: Column) -> Column:
    """SHA-256 of the normalized text: equal for questions that differ in composition and white space only; null stays null."""
    return F.sha2(normalized(text), 256)


def law_aliases(name: Column) -> Column:
    """A law's name, the name without a version in brackets at its end, and without the country's name before it."""
    bare = F.regexp_replace(name, r"[\s《》]", "")
    short = F.regexp_replace(bare, r"（[^（）]*）$", "")
    return F.array_distinct(F.array(bare, short, F.regexp_replace(short, "^中华人民共和国", "")))


def repetition(text: Column, n: int = 3, cap: float = 0.5) -> Column:
    """A penalty for repeated n-grams of words: (all - distinct) * 2 * cap / all, at most cap; 0 for fewer than n words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+|[\x{4E00}-\x{9FFF}])"), F.lit(1))
    grams = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(grams) > 0, F.least(F.lit(cap), (F.size(grams) - F.size(F.array_distinct(grams))) * 2 * cap / F.size(grams))).otherwise(0.0)


def learning_rate(step: Column, total: int, warmup: int, top: float, floor: float) -> Column:
    """Linear warm-up, then half a cosine down to floor."""
    done = (step - warmup) / F.lit(float(total - warmup))
    return F.when(step < warmup, top * (step + 1) / warmup).when(step >= total, floor).otherwise(floor + (top - floor) * 0.5 * (1 + F.cos(F.pi() * done)))


def frozen(values: Column) -> Column:
    """A map as JSON with its entries in the order of their keys, so that equal maps have one text; null stays null."""
    entries = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.to_json(F.map_from_entries(entries))


def safe_path(path: Column, suffix: str) -> Column:
    """Whether a path is relative, has no part that is empty or leads up, and ends with suffix; null stays null."""
    return ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.(/|$)") & ~F.contains(path, F.lit("//")) & F.endswith(path, F.lit(suffix))


# What stands in the place of a deleted article.
DELETED = ("（删去）", "(删去)", "删除", "（删除）")


def is_deleted(content: Column) -> Column:
    """Whether an article's text only says that it was deleted, or has no more than three signs; null counts as deleted."""
    bare = F.trim(content)
    return content.isNull() | bare.isin(*DELETED) | (F.length(bare) <= 3)
