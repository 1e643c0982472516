"""Splitting oversized texts at natural boundaries: a structure tree, packed bottom-up.

A text is parsed into a tree of headings, list levels, blocks and lines. Sibling subtrees are merged to the limit; only a
node that is too large by itself is descended into, first into its structure, then into sentences, clauses, words and at
last into characters (never inside a combined sign). A heading goes with what follows it. Every piece after the first begins with the last code points of the
piece before it, so a piece's own part is at most the limit less the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.codepoints import slices

# Forms of headings and list items, outermost first.
HEADINGS = (
    r"#{1}\s", r"#{2}\s", r"#{3,6}\s", r"<h[1-6]\b",
    r"第[零〇一二三四五六七八九十百千0-9０-９]+编", r"第[零〇一二三四五六七八九十百千0-9０-９]+章",
    r"第[零〇一二三四五六七八九十百千0-9０-９]+节", r"第[零〇一二三四五六七八九十百千0-9０-９]+条",
)
ITEMS = (
    r"[一二三四五六七八九十百]+、", r"[（(][一二三四五六七八九十百]+[）)]", r"[0-9０-９]+[、.．]", r"[（(][0-9０-９]+[）)]",
    r"[①-⑳]", r"[-*•·]\s", r"<li\b", r"[A-Za-z][.)]\s",
)
_LEVEL = re.compile(r"[ \t　]*(?:" + "|".join(f"({x})" for x in HEADINGS + ITEMS) + ")")
_INLINE = re.compile(r"(?<=[：:；;。])[ 　]*(?=[（(][一二三四五六七八九十百0-9０-９]+[）)])")
_BLANK = re.compile(r"\n[ \t　\r]*\n[\s]*")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"[。！？!?…]+[”’」』）)】\"']*\s*|\.(?:[\"')\]]*)(?:\s+|$)|<br\s*/?>|</p>|</li>")
_CLAUSE = re.compile(r"[；;]+\s*|[，,：:、]+[ 　]*")
_WORD = re.compile(r"\s+|(?<=\|)")
_JOINED = re.compile("[̀-ͯ᪰-᫿‍⃐-⃿︀-️\U000e0100-\U000e01ef\U0001f3fb-\U0001f3ff]")

# Signs that end a line of text, which a heading is not.
_STOPS = tuple("。；！？：，、.;!?:,")
#: Code points of the longest line that is taken for a heading.
HEADING = 60

Span = tuple[int, int]


def _cut(text: str, a: int, b: int, pattern: re.Pattern) -> list[Span]:
    """The parts of text[a:b], cut after each match."""
    ends = [m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b]
    bounds = [a, *dict.fromkeys(ends), b]
    return list(zip(bounds, bounds[1:]))


class Node:
    """A span of the text, with the nodes below it; leaves are lines."""

    __slots__ = ("a", "b", "kids")

    def __init__(self, a: int, b: int, kids: list[Node] | None = None):
        self.a, self.b, self.kids = a, b, kids or []


def _lines(text: str, a: int, b: int) -> list[Span]:
    out: list[Span] = []
    for x, y in _cut(text, a, b, _LINE):
        out += _cut(text, x, y, _INLINE)
    return out


def parse(text: str) -> Node:
    """The structure tree: sections by heading level, below them items by list level, else blocks of lines."""
    spans = _lines(text, 0, len(text))
    levels = []
    for x, y in spans:
        m = _LEVEL.match(text, x, y)
        levels.append(m.lastindex if m else 0)

    def build(lo: int, hi: int) -> list[Node]:
        """Nodes of the lines lo to hi: each line of the outermost level there begins one, with what follows below it."""
        present = [levels[k] for k in range(lo, hi) if levels[k]]
        if not present or hi - lo < 2:
            return blocks(lo, hi)
        top = min(present)
        starts = [k for k in range(lo, hi) if levels[k] == top]
        nodes = blocks(lo, starts[0]) if starts[0] > lo else []
        for s, e in zip(starts, [*starts[1:], hi]):
            head = Node(*spans[s])
            nodes.append(Node(spans[s][0], spans[e - 1][1], [head, *build(s + 1, e)]) if e - s > 1 else head)
        return nodes

    def blocks(lo: int, hi: int) -> list[Node]:
        if lo >= hi:
            return []
        parts: list[list[Node]] = [[]]
        for k in range(lo, hi):
            parts[-1].append(Node(*spans[k]))
            if _BLANK.search(text, *spans[k]):
                parts.append([])
        return [p[0] if len(p) == 1 else Node(p[0].a, p[-1].b, p) for p in parts if p]

    return Node(0, len(text), build(0, len(spans)))


def _sign_end(text: str, a: int, at: int, most: int) -> int:
    """The last place up to at, after a, that isn't inside a combined sign, a surrogate of one or a line end of two signs."""
    k = at
    while k > a + 1 and k < len(text) and (_JOINED.match(text, k) or text[k - 1] == "‍" or text[k - 1 : k + 1] == "\r\n"):
        k -= 1
        if at - k > most:
            return at
    return at if k <= a + 1 and at > a + 1 and _JOINED.match(text, k) else k


def _small(text: str, a: int, b: int, cap: int) -> list[Span]:
    """Spans within cap of a line that is larger: sentences, then clauses, then words, then signs."""
    for pattern in (_SENTENCE, _CLAUSE, _WORD):
        parts = _cut(text, a, b, pattern)
        if len(parts) > 1:
            return _merge([s for x, y in parts for s in ([(x, y)] if y - x <= cap else _small(text, x, y, cap))], cap)
    out = []
    while b - a > cap:
        e = _sign_end(text, a, a + cap, 64)
        out.append((a, e))
        a = e
    return [*out, (a, b)]


def _merge(spans: list[Span], cap: int) -> list[Span]:
    """Neighbours put together as long as they stay within cap."""
    out: list[Span] = []
    for a, b in spans:
        if out and b - out[-1][0] <= cap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _bare(text: str, node: Node) -> bool:
    """Whether the node is a line that only announces what follows: a form of heading, short and not ended by a stop."""
    m = _LEVEL.match(text, node.a, node.b)
    line = text[node.a : node.b].strip()
    return bool(m) and m.lastindex <= len(HEADINGS) and not node.kids and len(line) <= HEADING and not line.endswith(_STOPS)


def _pack(text: str, nodes: list[Node], cap: int, lead: int | None = None) -> tuple[list[Span], int | None]:
    """Spans within cap that cover the siblings: whole ones are put together as long as they fit, and only one that is too
    large by itself is descended into. What comes out of it isn't put together with its neighbours.

    lead: where headings begin that stand before the first node and go with it. The second value is the same for
    headings at the end, which go with what follows the siblings.
    """
    out: list[Span] = []
    open_: Span | None = None
    for node in nodes:
        a = node.a if lead is None else lead
        if node.b - a <= cap // 2 and _bare(text, node):
            lead = a
            continue
        lead = None
        if node.b - a <= cap:
            if open_ and node.b - open_[0] <= cap:
                open_ = (open_[0], node.b)
            else:
                out += [open_] if open_ else []
                open_ = (a, node.b)
            continue
        out += [open_] if open_ else []
        open_ = None
        if node.kids:
            parts, lead = _pack(text, node.kids, cap, a if a < node.a else None)
            out += parts
        else:
            out += _small(text, a, node.b, cap)
    return out + ([open_] if open_ else []), lead


def split(text: str, limit: int, overlap: int) -> list[Span]:
    """Spans of the pieces of a text: each at most limit code points, each but the first beginning overlap before the
    end of the one before it. A text within the limit, the empty one too, is one piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, len(text))]
    own, lead = _pack(text, [parse(text)], limit - overlap)
    if lead is not None:  # headings that nothing follows
        own = _merge([*own, (lead, len(text))], limit - overlap) if own and len(text) - own[-1][0] <= limit - overlap else [*own, (lead, len(text))]
    # A first part shorter than the overlap would leave the second piece nothing to repeat.
    while len(own) > 1 and own[0][1] - own[0][0] < overlap:
        room = limit - (own[0][1] - own[0][0])
        a, b = own[1]
        e = b if b - a <= room else _sign_end(text, a, a + room, 64)
        own[:2] = [(own[0][0], e)] + ([(e, b)] if e < b else [])
    return [own[0], *((max(0, a - overlap), b) for a, b in own[1:])]


def split_oversized(df: DataFrame, kind: str, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of all texts longer than limit code points: kind, item_key, window_index (from 0), start_char, end_char, piece.

    Texts within the limit and null texts need no cutting and give no rows. Rows that repeat a key count once; null keys
    are one key. Other columns are ignored. The concatenation of the first piece and the others without their first
    overlap code points is the text.
    """
    from pyspark.sql import functions as F

    big = df.select(F.col(key).cast("string").alias("item_key"), F.col(text).alias("text")).filter(F.length("text") > limit).dropDuplicates(["item_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                spans = [split(t, limit, overlap) for t in texts]
                row = pa.array([k for k, own in enumerate(spans) for _ in own], pa.int32())
                index = pa.array([j for own in spans for j in range(len(own))], pa.int32())
                start, end = (pa.array([x[side] for own in spans for x in own], pa.int32()) for side in (0, 1))
                pieces = pa.array([t[a:b] for t, own in zip(texts, spans) for a, b in own], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(row), pa.string()), part.column(0).take(row), index, start, end, pieces], ["kind", "item_key", "window_index", "start_char", "end_char", "piece"])

    return big.mapInArrow(run, "kind string, item_key string, window_index int, start_char int, end_char int, piece string")
