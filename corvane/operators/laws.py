"""Texts of laws into articles: cleaning, tables of contents, headings of four levels, articles under their headings.

Each text is worked on where its row lies, in one Arrow pass; nothing is exchanged to look at its lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Numerals, levels from the outermost with the longest title of each, forms of articles and deleted ones.
_NUMERAL = "[一二三四五六七八九十百千零]+"
LEVELS = {"编": 30, "分编": 40, "章": 40, "节": 40}
_ARTICLE = re.compile(rf"(?:^|\n)\s*第({_NUMERAL})条(?:之([一二三四五六七八九十]+))?\s*\n?")
_HEADING = {level: re.compile(rf"^第({_NUMERAL}){level}\s*([^\n]{{2,{most}}})", re.M) for level, most in LEVELS.items()}
_TOC_LINE = re.compile(rf"第{_NUMERAL}[章节编]")
_PAGE = re.compile(r"\s*[－-]\d+[－-]\s*")
_LAST_PAGE = re.compile(r"\s*[－-]\d+[－-]\s*$")
_LAST_HEADING = re.compile(rf"\n+\s*第{_NUMERAL}(?:编|分编|章|节|款)\s*[^\n]*$")
_DELETED = ("（删去）", "(删去)", "删除", "（删除）")
_ANNEX = "附则"
_VALUE = {c: k for k, c in enumerate("零一二三四五六七八九")}
_UNIT = {"十": 10, "百": 100, "千": 1000}
#: A table of contents has more heading lines than TOC_LINES in a run, each below TOC_WIDTH signs. The last article of a
#: text ends after LONGEST signs, and an article longer than that is looked through for articles of its own.
TOC_LINES, TOC_WIDTH, LONGEST = 5, 40, 2000


def number(numeral: str) -> int:
    total = last = 0
    for c in numeral:
        if c in _UNIT:
            total, last = total + (last or 1) * _UNIT[c], 0
        else:
            last = _VALUE[c]
    return total + last


def contents_end(lines: list[str]) -> int:
    """The line with which the text goes on behind its last table of contents; 0 if there is none.

    A table is a run of short heading lines; blank lines interrupt a run only while it is no longer than TOC_LINES.
    """
    run = end = 0
    for k, line in enumerate(lines):
        line = line.strip()
        heading = bool(_TOC_LINE.match(line))
        if heading and len(line) < TOC_WIDTH:
            run += 1
        elif line and not heading:
            end, run = (k if run > TOC_LINES else end), 0
        elif run <= TOC_LINES:
            run = 0
    return end


def clean(text: str) -> str:
    """The text without its table of contents and page numbers; runs of empty lines become one."""
    lines = text.split("\n")
    text = "\n".join(lines[contents_end(lines) :])
    return re.sub(r"\n{3,}", "\n\n", _PAGE.sub("\n", text)).strip()


def headings(text: str) -> list[tuple[int, str, str]]:
    """(place, level, title) of all headings, in order; titles carry the number and no blanks: 第2章 总则."""
    out = [(m.start(), level, f"第{number(m[1])}{level} {re.sub(r'\s+', '', m[2])}") for level, form in _HEADING.items() for m in form.finditer(text)]
    return sorted(out, key=lambda h: h[0])


class Hierarchy:
    """The headings that hold at a place: of each level the last one before it, unless one of a higher level came later."""

    def __init__(self, found: list[tuple[int, str, str]]):
        self.at = {level: [h[0] for h in found if h[1] == level] for level in LEVELS}
        self.titles = {level: [h[2] for h in found if h[1] == level] for level in LEVELS}

    def __call__(self, place: int) -> dict[str, str]:
        out, latest = {}, -1
        for level in LEVELS:
            k = bisect_left(self.at[level], place) - 1
            if k >= 0 and self.at[level][k] > latest:
                latest = self.at[level][k]
                out[level] = self.titles[level][k]
        return out


def clean_content(content: str) -> str:
    """An article's text without a page number and a heading of what follows at its end."""
    return _LAST_HEADING.sub("", _LAST_PAGE.sub("", content)).strip()


def deleted(content: str) -> bool:
    return content in _DELETED or len(content) <= 3


def _between(text: str, hierarchy: Hierarchy, last: int) -> Iterator[tuple[int, str, str, dict[str, str]]]:
    found = list(_ARTICLE.finditer(text))
    for k, m in enumerate(found):
        end = found[k + 1].start() if k + 1 < len(found) else min(len(text), m.end() + last)
        content = clean_content(text[m.end() : end].strip())
        above = hierarchy(m.start())
        if not deleted(content) and _ANNEX not in above.get("章", ""):
            yield m.start(), str(number(m[1])) + (f"之{m[2]}" if m[2] else ""), content, above


def articles(text: str) -> list[tuple[int, str, str, dict[str, str]]]:
    """(place, number, content, headings) of the articles of a cleaned text; deleted ones and those of the annex are left out.

    An article longer than LONGEST that holds several articles is replaced by them; their places are those within it. Of
    articles with one number the longest stays, the first of several, in the place of the number's first.
    """
    hierarchy = Hierarchy(headings(text))
    best: dict[str, tuple] = {}
    for article in _between(text, hierarchy, LONGEST):
        inner = list(_between(article[2], hierarchy, len(text))) if len(article[2]) > LONGEST else []
        for one in inner if len(inner) > 1 else [article]:
            if one[1] not in best or len(one[2]) > len(best[one[1]][2]):
                best[one[1]] = one
    return list(best.values())


def _pass(docs: DataFrame, key: str, text: str, rule, fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """key and the fields of every row that rule gives for a text; null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [rule(t or "") for t in batch.column(1).to_pylist()]
            row = pa.array([k for k, s in enumerate(own) for _ in s], pa.int64())
            flat = [x for s in own for x in s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *(pa.array([x[j] for x in flat], kind) for j, (_, kind) in enumerate(fields.values()))], [key, *fields])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {sql}" for n, (sql, _) in fields.items()))


_MAP = pa.map_(pa.string(), pa.string())


def segment(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, article_no, content, char_count and hierarchy of all articles of all texts, cleaned before."""
    rule = lambda t: [(no, content, len(content), list(above.items())) for _, no, content, above in articles(clean(t))]
    return _pass(docs, key, text, rule, {"article_no": ("string", pa.string()), "content": ("string", pa.string()), "char_count": ("int", pa.int32()), "hierarchy": ("map<string,string>", _MAP)})


def heading_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, level and title of all headings of cleaned texts."""
    return _pass(docs, key, text, lambda t: headings(clean(t)), {"place": ("int", pa.int32()), "level": ("string", pa.string()), "title": ("string", pa.string())})


def contents_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and cut: the line behind the last table of contents of each text that has one."""
    rule = lambda t: [(c,)] if (c := contents_end(t.split("\n"))) else []
    return _pass(docs, key, text, rule, {"cut": ("int", pa.int32())})
