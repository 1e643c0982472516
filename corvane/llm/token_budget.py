"""Token counts of texts under a public tokenizer, by a double-array trie and count-only dynamic programming.

Texts are normalized as the tokenizer does it and cut into segments between neighbours that stand side by side in no
vocabulary piece: no token can span such a place, so the counts of segments add up. A segment of one character needs a
table only. Each other distinct segment is counted once: the trie gives all pieces that end at each position, and one
pass over the positions keeps the length of the best path to each of them, never the path.

For a unigram vocabulary the best path is the one of the highest total score (Viterbi). The installed vocabularies are
BPE, for which the highest score is not the tokenizer's choice. There the same pass keeps, at each position, the one
piece with which the encoding of the text up to there ends: the piece that may follow the last piece of the encoding of
what is before it, which a table of merges decides.
"""

from __future__ import annotations

import heapq
from collections import Counter as Counts
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.codepoints import flat, slices
from corvane.llm.encoding import tokenizer_dir


#: Code points of segments that are worked on at a time.
BLOCK = 500_000


class DoubleArray:
    """A trie over code points in two integer arrays: child of node s by symbol c is base[s] + c if check there is s."""

    def __init__(self, words: list[str]):
        often = Counts(c for w in words for c in w)
        symbols = sorted(often, key=lambda c: (-often[c], c))  # frequent symbols get small numbers, which packs the arrays
        self.symbol = np.zeros(0x110000, np.int32)
        for k, c in enumerate(symbols):
            self.symbol[ord(c)] = k + 1
        number = {c: k + 1 for k, c in enumerate(symbols)}
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for k, w in enumerate(words):
            node = 0
            for c in w:
                node = tree[node].setdefault(number[c], len(tree))
                if node == len(tree):
                    tree.append({})
            if w:
                ends[node] = k
        size = len(tree) + 2 * len(symbols) + (1 << 14)
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        value[0] = -1
        begin: dict[int, int] = {}
        top = 1
        free, todo = 1, [(-len(tree[0]), 0, 0)]  # nodes with many children first
        while todo:
            _, node, at = heapq.heappop(todo)
            if node in ends:
                value[at] = ends[node]
            if not tree[node]:
                continue
            kids = np.fromiter(tree[node], np.int64)
            low, looked = int(kids.min()), 0
            while check[free] != -1:
                free += 1
            b = max(1, free - low)
            if len(kids) > 1:  # places before the last one found for as many children are mostly taken
                b = max(b, begin.get(len(kids), 1))
            while True:
                if b + 256 + int(kids.max()) >= len(check):
                    base, check, value = (np.r_[x, np.full(len(x), fill)] for x, fill in ((base, 0), (check, -1), (value, -1)))
                fits = (check[b + np.arange(256)[:, None] + kids] == -1).all(1) if len(kids) > 1 else check[b + low : b + low + 256] == -1
                if fits.any():
                    b += int(fits.argmax())
                    break
                b += 256
                looked += 1
                if looked > 8:  # the front is dense: behind all that is used
                    b, looked = max(1, top - low), 0
            base[at] = b
            begin[len(kids)], top = b, max(top, b + int(kids.max()) + 1)
            check[b + kids] = at
            for c, child in tree[node].items():
                heapq.heappush(todo, (-len(tree[child]), child, b + c))
        used = int(np.flatnonzero(check != -1)[-1]) + 1
        self.base, self.check, self.value = base[:used], check[:used], value[:used]
        self.depth = max(map(len, words), default=0)

    def step(self, node: np.ndarray, cps: np.ndarray) -> np.ndarray:
        """The child of each node by each code point, -1 where there is none."""
        c = self.symbol[cps]
        to = self.base[node] + c
        inside = (c > 0) & (self.base[node] > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.minimum(to, len(self.check) - 1)] == node), to, -1)

    def matches(self, cps: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: positions and numbers of the words of that length that begin there; last[p]: end of p's segment."""
        at, node, out = np.arange(len(cps)), np.zeros(len(cps), np.int64), []
        for k in range(self.depth):
            inside = at + k < last[at]
            at, node = at[inside], node[inside]
            node = self.step(node, cps[at + k])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            word = self.value[node]
            out.append((at[word >= 0], word[word >= 0]))
        return out


class Counter:
    """Counts tokens of texts; rule 'unigram' takes the highest total score, 'bpe' the merges by rank (lowest first).

    scores: of unigram pieces. unknown_cost: tokens for a character that no piece covers, by code point (an array or a
    number). In the unigram rule such a character has a score of ten below the lowest piece's, as is usual.
    """

    def __init__(self, pieces: list[str], scores: list[float], rule: str, unknown_cost: np.ndarray | int = 1):
        self.rule, self.trie = rule, DoubleArray(pieces)
        self.scores = np.array(scores, float)
        pairs = sorted({ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:])})
        self.pairs = np.array(pairs, np.int64)
        self.inner = np.zeros(0x110000, bool)
        self.inner[list({ord(c) for p in pieces if len(p) > 1 for c in p})] = True
        one = np.full(0x110000, -1, np.int64)
        for k, p in enumerate(pieces):
            if len(p) == 1:
                one[ord(p)] = k
        self.single = np.where(one >= 0, 1, unknown_cost).astype(np.int8)
        self.has_single = one >= 0
        if rule == "bpe":
            self._merges(pieces, one)

    def _merges(self, pieces: list[str], one: np.ndarray) -> None:
        """The last merge of each piece, found by merging its characters; pieces that don't come out whole are never made."""
        number = {p: k for k, p in enumerate(pieces)}
        n = len(pieces)
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.ones(n, bool)
        for k, p in enumerate(pieces):
            if len(p) < 2:
                continue
            parts = list(p)
            while len(parts) > 1:
                best = min(((number.get(parts[i] + parts[i + 1], n), i) for i in range(len(parts) - 1)))
                if best[0] >= n:
                    break
                if len(parts) == 2:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and all(x in number for x in parts):
                self.left[k], self.right[k] = number[parts[0]], number[parts[1]]
            else:
                self.made[k] = False
        whole = np.flatnonzero(self.made & (self.left != np.arange(n)))
        key = self.left[whole] * n + self.right[whole]
        order = np.argsort(key)
        self.merge_key, self.merge_id, self.n = key[order], whole[order], n

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when a text that is their concatenation is merged.

        Undoes their merges from the latest to the earliest: at no time may the pieces that met at the seam have merged
        before the merges that were still to come on either side.
        """
        a, b = a.copy(), b.copy()
        result = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            joined = np.where(self.merge_key[at] == key, self.merge_id[at], np.iinfo(np.int64).max)
            bad = joined < limit[live]
            result[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            open_left = self.left[x] != x
            open_right = self.left[y] != y
            # The later of the two merges is undone; where merges have equal rank the left one came first.
            undo_left = open_left & (~open_right | (x > y))
            undo_right = ~undo_left & open_right
            limit[live] = np.where(undo_left, x, np.where(undo_right, y + 1, limit[live]))
            a[live[undo_left]] = self.right[x[undo_left]]
            b[live[undo_right]] = self.left[y[undo_right]]
            live = live[undo_left | undo_right]
        return result

    def segments(self, segments: list[str]) -> np.ndarray:
        """The number of tokens of each segment."""
        if not segments:
            return np.zeros(0, np.int64)
        segments_order = np.argsort([-len(s) for s in segments], kind="stable")
        ordered = [segments[k] for k in segments_order]
        size = np.array([len(s) for s in ordered])
        begin = np.r_[0, np.cumsum(size)]
        cps = np.frombuffer("".join(ordered).encode("utf-32-le"), np.uint32)
        last = np.repeat(begin[1:], size)
        found = np.full((len(cps), max(1, self.trie.depth)), -1, np.int32)
        for k, (at, word) in enumerate(self.trie.matches(cps, last)):
            found[at + k, k] = word  # by the position of its last character
        count = np.zeros((len(ordered), int(size[0]) + 1), np.int64) if len(ordered) * (int(size[0]) + 1) < 30_000_000 else None
        if count is None:  # a few very long segments beside many short ones: apart
            half = max(1, len(ordered) // 2)
            out = np.zeros(len(segments), np.int64)
            if len(ordered) == 1:
                count = np.zeros((1, int(size[0]) + 1), np.int64)
            else:
                out[segments_order[:half]], out[segments_order[half:]] = self.segments(ordered[:half]), self.segments(ordered[half:])
                return out
        state = np.full(count.shape, -1, np.int32) if self.rule == "bpe" else np.full(count.shape, -np.inf)
        if self.rule != "bpe":
            state[:, 0] = 0
        lowest = (self.scores.min() if len(self.scores) else 0.0) - 10
        for p in range(int(size[0])):
            live = int(np.searchsorted(-size, -p))  # segments longer than p
            rows, here = np.arange(live), begin[:live] + p
            options = found[here]
            if self.rule == "bpe":
                todo = np.ones(live, bool)
                for k in range(min(p + 1, options.shape[1]) - 1, -1, -1):
                    r = rows[todo & (options[:, k] >= 0)]
                    if not len(r):
                        continue
                    word, prev = options[r, k].astype(np.int64), state[r, p - k].astype(np.int64)
                    good = self.made[word]
                    ask = good & (prev >= 0)
                    good[ask] = self._may_follow(prev[ask], word[ask])
                    good &= (p - k == 0) | (count[r, p - k] > 0)
                    r, word = r[good], word[good]
                    state[r, p + 1], count[r, p + 1] = word, count[r, p - k] + 1
                    todo[r] = False
                r = rows[todo]
                state[r, p + 1], count[r, p + 1] = -1, count[r, p] + self.single[cps[here[r]]]
            else:
                best, n = np.full(live, -np.inf), np.zeros(live, np.int64)
                for k in range(min(p + 1, options.shape[1])):
                    r = rows[options[:, k] >= 0]
                    score = state[r, p - k] + self.scores[options[r, k]]
                    r, score = r[score > best[r]], score[score > best[r]]
                    best[r], n[r] = score, count[r, p - k] + 1
                r = rows[~self.has_single[cps[here]]]
                score = state[r, p] + lowest
                r, score = r[score > best[r]], score[score > best[r]]
                best[r], n[r] = score, count[r, p] + self.single[cps[here[r]]]
                state[:live, p + 1], count[:live, p + 1] = best, n
        out = np.zeros(len(segments), np.int64)
        out[segments_order] = count[np.arange(len(ordered)), size]
        return out

    def _in_blocks(self, words: list[str]) -> list[int]:
        """Counts of segments, a block of BLOCK code points at a time, so that the tables of a long text stay small."""
        out: list[int] = []
        part = np.cumsum([len(w) for w in words], dtype=np.int64) // BLOCK
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
            out += self.segments(words[a:b]).tolist()
        return out

    def texts(self, cps: np.ndarray, bounds: np.ndarray, known: dict[str, int]) -> np.ndarray:
        """The number of tokens of each text of normalized code points; known keeps the counts of segments."""
        if not len(cps):
            return np.zeros(len(bounds) - 1, np.int64)
        joins = np.zeros(len(cps), bool)  # whether a token may span this code point and the one before
        maybe = np.flatnonzero(self.inner[cps[:-1]] & self.inner[cps[1:]]) + 1
        key = cps[maybe - 1].astype(np.int64) << 21 | cps[maybe]
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        joins[maybe] = self.pairs[at] == key if len(self.pairs) else False
        joins[bounds[bounds < len(cps)]] = False
        begin = np.flatnonzero(~joins)
        end = np.r_[begin[1:], len(cps)]
        tokens = np.zeros(len(begin), np.int64)
        alone = end - begin == 1
        tokens[alone] = self.single[cps[begin[alone]]]
        longer = np.flatnonzero(~alone)
        text = cps.tobytes().decode("utf-32-le")
        words = [text[a:b] for a, b in zip(begin[longer].tolist(), end[longer].tolist())]
        new = [w for w in dict.fromkeys(words) if w not in known]
        fresh = dict(zip(new, self._in_blocks(new)))
        if len(known) > 500_000:
            known.clear()
        tokens[longer] = [known[w] if w in known else fresh[w] for w in words]
        known.update((w, n) for w, n in fresh.items() if len(w) <= 64)
        total = np.r_[0, np.cumsum(tokens)]
        return np.diff(total[np.searchsorted(begin, bounds)])


@lru_cache(maxsize=2)
def piece_counter(model_file: str) -> tuple[Counter, object]:
    """The counter of a sentencepiece BPE model with byte fallback, and its normalizer."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    ids.sort(key=lambda k: (-sp.get_score(k), k))  # the rank in merging
    cost = np.full(0x110000, 4, np.int64)
    cost[:0x10000], cost[:0x800], cost[:0x80] = 3, 2, 1
    return Counter([sp.id_to_piece(k) for k in ids], [sp.get_score(k) for k in ids], "bpe", cost), sp


def count_tokens(df: DataFrame, keep: list[str], text: str, model_file: str | None = None) -> DataFrame:
    """The columns keep of every row, and n_tokens: the number of tokens of its text under a sentencepiece BPE model.

    Special tokens aren't counted. Null and empty texts have 0. Other columns are ignored. model_file must be at the same
    path on every executor.
    """
    file = model_file or f"{tokenizer_dir()}/piece_bpe_32k.model"
    shared = df.sparkSession.sparkContext.broadcast(piece_counter(file)[0])  # some 10 MB, set by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        counter, sp = shared.value, sentencepiece.SentencePieceProcessor(model_file=file)
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = sp.normalize([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                _, cps, bounds = flat(pa.array(texts, pa.string()))
                n = counter.texts(cps, bounds, known)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n)], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens long")


def budget(counted: DataFrame, slices_: list[str]) -> DataFrame:
    """Records and tokens of each slice, nulls being a slice of their own. An empty table has no slices."""
    return counted.groupBy(*slices_).agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"))
