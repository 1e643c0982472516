"""Test passages inside a large corpus: pigeonhole pieces and bit-parallel edit distance.

Texts are compared by their letters and digits only, in one form. The error budget is a rate: one edit in ten signs, in
alphabetic scripts one in sixteen, whatever the length of the item. A quarter of an item with its budget of k edits is to
hold k + 2 whole pieces, which fixes the length of the pieces that the item is split into. By the pigeonhole principle one
of them stands in the document unchanged, and beside it a piece with at most one edit: were two edits in every neighbour
of a whole piece, there would be k + 1 edits at least. So a single exact hit is asked for, and a neighbour of which half
the signs stand on one diagonal; both are found in NumPy for all documents of a batch at once.

From such a hit the part is drawn out to both sides along furthest-reaching diagonals, and Myers' bit-parallel distance
then verifies it as a whole. Where large parts are found that don't make up half of the item, the rest of it is looked for
again in that document with pieces of half the length. An item is found if verified large parts make up half of it.

The items are sent to all tasks; their number and size is checked (MAX_ITEM_CHARS), beyond it the items are taken in groups.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.codepoints import flat, slices
from corvane.llm.lookalike import base_table

#: Edits in the error budget, a sign: of alphabetic and of other scripts.
BUDGET = {True: 1 / 16, False: 1 / 10}
#: Lengths of pieces in use: each costs a pass over the corpus, and a shorter piece than the budget asks for is a safe choice.
LENGTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16)
#: Largest share of edits in a part; smallest part that counts and least sum of parts, as shares of the item; what an edit
#: costs in signs while a part is drawn out, and how far the balance may then fall.
RATE, LARGE, NEEDED, COST, DROP = 0.25, 0.15, 0.5, 3, 16
MAX_ITEM_CHARS = 4_000_000


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point the letter or digit it is compared as; 0: it isn't compared."""
    to = np.zeros(0x110000, np.uint32)
    base = base_table()
    for cp in [*range(0x30000), *range(0x30000, 0x33480)]:
        c = chr(cp)
        c = base.get(c, c)
        if len(c) == 1 and c.isalnum():
            low = unicodedata.normalize("NFKC", c).lower()
            low = base.get(low, low)
            to[cp] = ord(low) if len(low) == 1 else ord(c)
    return to


def fold(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compared signs of the code points, and where each stood."""
    to = fold_table()[cps]
    at = np.flatnonzero(to)
    return to[at], at


def _no_ligatures(text: str) -> str:
    for k in range(0xFB00, 0xFB07):
        if chr(k) in text:
            text = text.replace(chr(k), unicodedata.normalize("NFKC", chr(k)))
    return text


def fold_text(text: str) -> str:
    return fold(np.frombuffer(_no_ligatures(text).encode("utf-32-le"), np.uint32))[0].tobytes().decode("utf-32-le")


def myers(pattern: str, text: str, begins: bool = False, most: int | None = None) -> tuple[int, int]:
    """The smallest edit distance of pattern to any part of text, and where that part ends (the first such end).

    begins: only parts that begin where text does. most: a distance up to it is returned as soon as it is met.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top, carry = (1 << m) - 1, 1 << (m - 1), 1 if begins else 0
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
                if most is not None and best <= most:
                    break
        ph = (ph << 1 | carry) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


def _along(a: str, i: int, b: str, j: int) -> int:
    """Where in a the signs from i on end to be those of b from j on."""
    end = min(len(a), len(b) - j + i)
    while i + 16 <= end and a[i : i + 16] == b[j : j + 16]:
        i, j = i + 16, j + 16
    while i < end and a[i] == b[j]:
        i, j = i + 1, j + 1
    return i


def reach(item: str, text: str, drop: int = DROP) -> tuple[int, int]:
    """How many of the first signs of item and of text belong together: those that give most signs less COST times the edits.

    By furthest-reaching diagonals: of each number of edits and shift the last sign of the item that can be reached. A
    diagonal whose balance is more than drop below the best is given up, and it ends when none is left.
    """
    first = _along(item, 0, text, 0)
    row, edits, best, at = {0: first}, 0, first, (first, first)
    while row:
        edits += 1
        new: dict[int, int] = {}
        for shift in range(min(row) - 1, max(row) + 2):
            i = max(row.get(shift, -2) + 1, row.get(shift - 1, -2), row.get(shift + 1, -2) + 1)
            if i < 0 or i > len(item) or i + shift > len(text) or i + shift < 0:
                continue
            i = _along(item, i, text, i + shift)
            if i - COST * edits > best:
                best, at = i - COST * edits, (i, i + shift)
            if i - COST * edits >= best - drop:
                new[shift] = i
        row = new
    return at


class Index:
    """The items' pieces by hash, by length of piece, over all items laid end to end with blanks between them."""

    def __init__(self, items: list[tuple[object, str]]):
        folded = [(i, fold_text(t)) for i, t in items]
        folded = [(i, t) for i, t in folded if len(t) >= 2]
        self.ids, self.texts = [i for i, _ in folded], [t for _, t in folded]
        self.size = [piece_length(t) for t in self.texts]
        pad, at, rows = LENGTHS[-1] + 1, 0, []
        self.begin = np.zeros(len(folded), np.int64)
        for k, t in enumerate(self.texts):
            rows += ["\0" * pad, t]
            self.begin[k] = at + pad
            at += pad + len(t)
        self.signs = np.frombuffer("".join([*rows, "\0" * pad]).encode("utf-32-le"), np.uint32)
        self.edits = np.array([budget(t)[1] for t in self.texts], np.int64)
        self.tables, self.pieces = {}, {}
        for p in sorted(set(self.size)):
            own = [k for k, s in enumerate(self.size) if s == p]
            place = np.concatenate([self.begin[k] + np.arange(0, len(self.texts[k]) - p + 1, p) for k in own])
            item = np.repeat(own, [len(range(0, len(self.texts[k]) - p + 1, p)) for k in own])
            h = _hashes_at(self.signs, p, place)
            order = np.argsort(h, kind="stable")
            front = np.zeros(1 << 16, bool)
            front[_fronts(self.signs)[place]] = True
            self.tables[p] = (front, h[order], place[order], item[order])
            self.pieces[p] = np.array([max(1, int((len(t) / 4 + 1) / p) - 1) for t in self.texts], np.int64)

    def hits(self, signs: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents laid end to end, ending at limits: document, item, place in the document and place in the item of
        each whole piece that has a neighbour which goes on with it."""
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for p, (front, table, place, item) in self.tables.items():
            if len(signs) < p:
                continue
            at = np.flatnonzero(front[_fronts(signs)[: len(signs) - p + 1]])
            h = _hashes_at(signs, p, at)
            lo = np.searchsorted(table, h)
            there = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == h)
            at, lo, n = at[there], lo[there], np.searchsorted(table, h[there], side="right") - lo[there]
            k = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pos, off, own = np.repeat(at, n), place[k], item[k]
            doc = np.searchsorted(limits, pos, side="right") - 1
            whole = pos + p <= limits[doc + 1]
            pos, off, own, doc = pos[whole], off[whole], own[whole], doc[whole]
            on = self._goes_on(signs, pos, off, own, p)
            for column, values in zip(found, (doc, own, pos - limits[doc], off - self.begin[own])):
                column.append(values[on])
        return tuple(np.concatenate(c) for c in found)

    def _goes_on(self, signs: np.ndarray, pos: np.ndarray, off: np.ndarray, own: np.ndarray, p: int) -> np.ndarray:
        """Whether the pieces around the whole one go on with it as those of a quarter of the item within its budget do.

        Going away from the whole piece, of each piece the signs that stand on one diagonal are counted, the last one or
        one next to it. An edit takes half of a piece's signs from there at most, so this many remain in the quarter.
        """
        n, edits = self.pieces[p][own], self.edits[own]
        most = int(n.max(initial=1))
        equal = np.zeros((2 * most - 1, len(pos)), np.int16)
        equal[most - 1] = p
        for way in (-1, 1):
            live, shift, bad = np.flatnonzero(n > 1), np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for step in range(1, most):
                x, y = off[live] + way * step * p, pos[live] + way * step * p + shift[live]
                best, turn = np.zeros(len(live), np.int16), np.zeros(len(live), np.int64)
                for by in (0, -1, 1, -2, 2):
                    on = np.zeros(len(live), np.int16)
                    for j in range(p):
                        on += signs[np.clip(y + by + j, 0, len(signs) - 1)] == self.signs[np.clip(x + j, 0, len(self.signs) - 1)]
                    turn[on > best] = by
                    best = np.maximum(best, on)
                equal[most - 1 + way * step, live] = best
                well = best >= p // 2
                shift[live[well]] += turn[well]
                bad[live] = np.where(well, 0, bad[live] + 1)
                live = live[(2 * bad[live] <= edits[live]) & (n[live] > step + 1)]  # a piece that isn't well has two edits
        upto = np.r_[np.zeros((1, len(pos)), np.int64), np.cumsum(equal, 0)]
        enough, column = np.zeros(len(pos), bool), np.arange(len(pos))
        for first in range(most):
            last = np.minimum(first + n, 2 * most - 1)
            inside = (first + n > most - 1) & (first + n <= 2 * most - 1)
            enough |= inside & (upto[last, column] - upto[first] >= n * p - edits * (p + 1) / 2)
        return enough


@lru_cache(maxsize=4096)
def budget(item: str) -> tuple[int, int]:
    """The signs of a quarter of the item, and how many edits it may have."""
    return len(item) // 4, int(BUDGET[2 * sum("a" <= c <= "z" for c in item) > len(item)] * len(item) / 4)


def piece_length(item: str) -> int:
    """The longest piece in use with which a quarter of the item holds two pieces more than its budget of edits."""
    quarter, edits = budget(item)
    return max([p for p in LENGTHS if p <= (quarter + 1) / (edits + 3)], default=LENGTHS[0])


def _fronts(cps: np.ndarray) -> np.ndarray:
    if len(cps) < 2:
        return np.zeros(0, np.int64)
    return ((cps[:-1].astype(np.int64) * 40503 + cps[1:].astype(np.int64) * 30011) & 0xFFFF)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes_at(cps: np.ndarray, p: int, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(p):
        h = (h ^ cps[at + k].astype(np.uint64)) * _MULTIPLIER
        h ^= h >> np.uint64(32)
    return h


class _Parts:
    """The parts of one item that one document holds."""

    def __init__(self, item: str, doc: str):
        self.item, self.doc, self.back = item, doc, item[::-1]
        self.drawn: list[tuple[int, int, int, int]] = []
        self.covered = np.zeros(len(item), bool)

    def inside(self, pos: int, a: int, p: int) -> bool:
        """Whether the piece lies in a part drawn out before."""
        return any(x <= a and a + p <= y and d <= pos and pos + p <= e for x, y, d, e in self.drawn)

    def add(self, pos: int, a: int, p: int) -> None:
        """Draw out and verify the part around a whole piece."""
        m, far = len(self.item), DROP + len(self.item) // 2
        left, back = reach(self.back[m - a :], self.doc[max(0, pos - a - far) : pos][::-1])
        right, on = reach(self.item[a + p :], self.doc[pos + p : pos + m - a + far])
        x, y, d, e = a - left, a + p + right, pos - back, pos + p + on
        self.drawn.append((x, y, d, e))
        if y - x >= LARGE * m and not self.covered[x:y].all() and myers(self.item[x:y], self.doc[d:e])[0] <= RATE * (y - x):
            self.covered[x:y] = True

    @property
    def share(self) -> float:
        return float(self.covered.sum()) / len(self.item)


def beside(item: str, doc: str, pos: int, a: int, p: int) -> bool:
    """Whether a side of a whole piece goes on within the budget of a quarter of the item.

    A quarter with its budget of edits in which the piece lies stands out by half of the rest at least to one side.
    """
    quarter, edits = budget(item)
    half = -(-(quarter - p) // 2)
    if half <= edits:
        return True
    return (
        a + p + half <= len(item) and myers(item[a + p : a + p + half], doc[pos + p : pos + p + half + edits], True, edits)[0] <= edits
        or half <= a and myers(item[a - half : a][::-1], doc[max(0, pos - half - edits) : pos][::-1], True, edits)[0] <= edits
    )


def held(item: str, piece: int, doc: str, hits: list[tuple[int, int]]) -> float:
    """The share of the item that the document holds in large parts; hits: (place in the document, in the item) of pieces."""
    parts = _Parts(item, doc)
    for pos, a in hits:
        if not parts.inside(pos, a, piece) and beside(item, doc, pos, a, piece):
            parts.add(pos, a, piece)
    if parts.covered.any() and parts.share < NEEDED:
        fine = max(2, piece // 2)
        for a in range(0, len(item) - fine + 1, fine):
            if not parts.covered[a : a + fine].any():
                word, pos = item[a : a + fine], -1
                while (pos := doc.find(word, pos + 1)) >= 0:
                    near = sum(x == y for x, y in zip(item[a + fine : a + 3 * fine], doc[pos + fine : pos + 3 * fine]))
                    near += sum(x == y for x, y in zip(item[max(0, a - 2 * fine) : a][::-1], doc[max(0, pos - 2 * fine) : pos][::-1]))
                    if near >= fine and not parts.inside(pos, a, fine):
                        parts.add(pos, a, fine)
    return parts.share


_INDEX: dict[str, Index] = {}


def _index(token: str, items) -> Index:
    """The index of a set of items, made once in each worker process."""
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = Index(items.value)
    return _INDEX[token]


def _leaks_of(part: pa.RecordBatch, index: Index) -> list[tuple[int, int, float]]:
    """(item, document, share) of the items found in a batch of documents, by their numbers."""
    values, cps, bounds = flat(part.column(1))
    if ((cps >= 0xFB00) & (cps < 0xFB07)).any():
        values, cps, bounds = flat(pa.array([_no_ligatures(v) if v else v for v in values], pa.string()))
    signs, at = fold(cps)
    limits = np.searchsorted(at, bounds)
    doc, item, pos, a = index.hits(signs, limits)
    order = np.lexsort((a, pos, item, doc))
    doc, item, pos, a = doc[order], item[order], pos[order].tolist(), a[order].tolist()
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else []
    rows, text, last = [], "", -1
    for x, y in zip(first, [*first[1:], len(doc)]):
        d, i = int(doc[x]), int(item[x])
        if d != last:
            last, text = d, signs[limits[d] : limits[d + 1]].tobytes().decode("utf-32-le")
        share = held(index.texts[i], index.size[i], text, list(zip(pos[x:y], a[x:y])))
        if share >= NEEDED:
            rows.append((i, d, share))
    return rows


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, share: bool = False) -> DataFrame:
    """item_id and doc_id (and share, if wanted): the documents that hold at least half of an item's text, in one large
    part or several.

    Case, spacing, marks and forms of signs don't count, nor do a few changed words or signs. Null and empty texts hold
    and match nothing; items of fewer than two compared signs are never found. Rows that repeat an item's or a document's
    key count once in the result; null keys are left out. Other columns are ignored. documents is read once for each
    group of items (one, as long as the items together have no more than MAX_ITEM_CHARS code points).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kept = items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t"))
    total = kept.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-total // MAX_ITEM_CHARS))
    spark = documents.sparkSession
    doc_kind, item_kind = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    id_type = to_arrow_type(items.schema[item_key].dataType)
    out = None
    for g in range(groups):
        own = kept if groups == 1 else kept.filter(F.pmod(F.xxhash64("i"), F.lit(groups)) == g)
        shared, token = spark.sparkContext.broadcast([tuple(r) for r in own.distinct().toLocalIterator()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, shared)
            for batch in batches:
                for part in slices(batch, 1):
                    rows = _leaks_of(part, index) if index.ids else []
                    ids = pa.array([index.ids[r[0]] for r in rows], id_type)
                    docs = part.column(0).take(pa.array([r[1] for r in rows], pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, docs, pa.array([r[2] for r in rows], pa.float64())], ["item_id", "doc_id", "share"])

        one = documents.select(doc_key, doc_text).filter(F.col(doc_key).isNotNull()).mapInArrow(run, f"item_id {item_kind}, doc_id {doc_kind}, share double")
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))
    return best if share else best.select("item_id", "doc_id")
