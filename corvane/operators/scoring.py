"""Extension points of retrieval: token counters, scorers, searchers; retrieval windows and the reranker built on them.

A token counter maps a text column to a count, a tokenizer to an array of tokens, a scorer a question and a window column
to a score; each may be an expression of built-in functions or a pandas UDF. A searcher maps a frame of questions
(query, text) and k to a ranked frame (query, item, score, rank).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

TokenCounter = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]
Searcher = Callable[[DataFrame, int], DataFrame]

#: Signs of a window and of what two neighbours share, where windows are cut by signs.
WIDTH, SHARED = 512, 64
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
# Signs that end a sentence, and those that end a clause.
_FULL, _PART = "。！？!?\n", "；;：:，,、"


def regex_tokens(text: Column) -> Column:
    """The default counter: runs of Latin letters and digits, and every other visible sign."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+|[^\sA-Za-z0-9])"), F.lit(1)))


def prompt_tokens(messages: Column, count: TokenCounter = regex_tokens, each: int = 4) -> Column:
    """The length of a chat of messages (role, content) for a budget: tokens of role and content, and some for each turn."""
    return F.aggregate(messages, F.lit(0), lambda n, m: n + each + count(m["role"]) + count(m["content"]))


def pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring signs of a text; none for a text of fewer than two."""
    return F.array_distinct(F.transform(F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(2))))


def windows(text: Column, width: int = WIDTH, shared: int = SHARED) -> Column:
    """The windows of a text by signs: none that holds only what the one before held; one for an empty text."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text), F.lit(1)) - 1, F.lit(width - shared)), lambda s: (s == 0) | (s + shared < F.length(text)))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(width)))


def coverage(question: Column, window: Column) -> Column:
    """The default scorer: the share of the question's pairs of signs that stand in the window; 0 for a question without."""
    asked = pairs(question)
    return F.coalesce(F.try_divide(F.size(F.filter(asked, lambda p: F.contains(window, p))), F.size(asked)), F.lit(0.0))


def rerank(pool: DataFrame, questions: DataFrame, texts: DataFrame, query: str, item: str, scorer: Scorer = coverage, inline: bool = True) -> DataFrame:
    """pool (query, item, rank) with lexical, the best score of any window of the item's text (6 decimals), and rerank.

    questions: query, text; texts: item, text, one row each. An item without a text scores 0. Ties go by rank, then item.
    inline: the scorer is an expression of built-in functions and is taken over the array of windows where the row lies; a
    pandas UDF isn't, so windows become rows, which are put together again by their maximum. Scores must be finite.
    """
    x = pool.join(questions.select(query, F.col("text").alias("__q")), query).join(texts.select(item, F.col("text").alias("__t")), item, "left")
    if inline:
        best = F.array_max(F.transform(windows(F.coalesce("__t", F.lit(""))), lambda w: scorer(F.col("__q"), w)))
        x = x.withColumn("lexical", F.round(best, 6))
    else:
        each = x.select(query, item, "rank", "__q", F.explode(windows(F.coalesce("__t", F.lit("")))).alias("__w"))
        x = each.groupBy(query, item, "rank").agg(F.round(F.max(scorer(F.col("__q"), F.col("__w"))), 6).alias("lexical"))
    order = W.partitionBy(query).orderBy(F.desc("lexical"), "rank", item)
    return x.withColumn("rerank", F.row_number().over(order)).select(query, item, "rank", "lexical", "rerank")


def token_windows(text: str, heading: int, capacity: int, overlap: int, tokenize=None) -> list[tuple[int, int]]:
    """(start, end) of windows of at most capacity - heading tokens each.

    A window ends at the last sentence end in its second half, else at the last clause end there, else where it is full.
    The next one begins at the last boundary that leaves overlap tokens between them, else at the end if the text there is
    closed, else overlap tokens before it; each window goes on past the one before. Blank texts have no window.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)] if tokenize is None else tokenize(text)
    room = capacity - heading
    if room <= overlap:
        raise ValueError("a window must hold more than its heading and the overlap")
    out: list[tuple[int, int]] = []
    a = 0
    while a < len(spans):
        b = min(len(spans), a + room)
        if b < len(spans):
            closes = lambda k, signs: text[spans[k - 1][1] - 1] in signs or text[spans[k - 1][1] : spans[k][0]].count("\n") > 0
            half = range(b, a + (room + 1) // 2 - 1, -1)
            b = next((k for k in half if closes(k, _FULL)), next((k for k in half if closes(k, _FULL + _PART)), b))
        out.append((spans[a][0], spans[b - 1][1]))
        if b == len(spans):
            break
        closed = text[spans[b - 1][1] - 1] in _FULL
        back = next((k for k in range(max(a + 1, b - overlap), a, -1) if text[spans[k - 1][1] - 1] in _FULL + _PART), None)
        following = back if back is not None else b if closed else b - overlap
        a = following if following > a else b
    return out


def retrieval_windows(articles: DataFrame, key: str, text: str, heading: str, capacity: int = 512, overlap: int = 64, tokenize=None) -> DataFrame:
    """key, window_index, start_char and end_char of all articles' windows, each with room for the heading before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for body, head in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = len(_TOKEN.findall(head or "")) if tokenize is None else len(tokenize(head or ""))
                own.append(token_windows(body or "", min(n, capacity - overlap - 1), capacity, overlap, tokenize))
            row = pa.array([k for k, s in enumerate(own) for _ in s], pa.int64())
            flat = [x for s in own for x in s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([j for s in own for j in range(len(s))], pa.int32()), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())], [key, "window_index", "start_char", "end_char"])

    return articles.select(key, text, heading).mapInArrow(run, f"`{key}` {articles.schema[key].dataType.simpleString()}, window_index int, start_char int, end_char int")
