"""Same and nearly same records across splits: a weighted cosine join over inverted lists.

Texts become vectors of terms (pairs of neighbouring signs, and whole numbers) with inverse document frequencies as
weights, counted over all texts of both sides. Terms are ordered from rare to common. Of each vector only the front is put
into the inverted lists: as soon as what is left of it can't reach the threshold any more, neither by its residual norm
nor by its weights times the highest weights of the terms on the other side, the rest is left out. Two vectors that reach
the threshold share a term of both fronts. Their exact dot product is then taken over all terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.llm.codepoints import flat, slices
from corvane.llm.leakage import fold
from corvane.llm.skew import hot_join
from corvane.runtime import materialize

#: Cosine from which two questions with the same numbers are the same. Light changes of wording leave 0.5 or more in
#: all records looked at; other questions with the same numbers stay below 0.3.
THRESHOLD = 0.45


def prepared(rows: DataFrame) -> DataFrame:
    """side, d, block, terms and numbers of each row (side, d, block, text); texts without letters and digits are left out.

    Letters and digits are compared in one form: look-alikes, accents, case, blanks and punctuation don't count. Terms are
    the distinct pairs of neighbouring signs, but for pairs of digits, as integers of both code points, and the whole
    numbers, as negative hashes. numbers: all of them in order of their digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, 3):
                _, cps, bounds = flat(part.column(3))
                signs, at = fold(cps)
                limits = np.searchsorted(at, bounds)
                n = np.diff(limits)
                doc = np.repeat(np.arange(len(n)), n)
                c = signs.astype(np.int64)
                digit = (c >= 0x30) & (c <= 0x39)
                same = np.flatnonzero((doc[:-1] == doc[1:]) & ~(digit[:-1] & digit[1:])) if len(c) > 1 else np.zeros(0, np.int64)
                alone = limits[:-1][n == 1]
                text = signs.tobytes().decode("utf-32-le")
                first = np.flatnonzero(digit & ~(np.r_[False, digit[:-1]] & np.r_[True, doc[:-1] == doc[1:]])) if len(c) else np.zeros(0, np.int64)
                last = np.flatnonzero(digit & ~(np.r_[digit[1:], False] & np.r_[doc[:-1] == doc[1:], True])) + 1 if len(c) else first
                runs = [text[a:b] for a, b in zip(first.tolist(), last.tolist())]
                hashed = np.array([-(xxhash.xxh64_intdigest(r) >> 2) - 1 for r in runs], np.int64)
                key = np.concatenate([c[same] << 21 | c[same + 1], c[alone], hashed])
                own = np.concatenate([doc[same], doc[alone], doc[first]]).astype(np.int64)
                order = np.lexsort((key, own))
                key, own = key[order], own[order]
                fresh = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])] if len(key) else np.zeros(0, bool)
                key, own = key[fresh], own[fresh]
                numbers: list[list[str]] = [[] for _ in n]
                for r, d in zip(runs, doc[first].tolist()):
                    numbers[d].append(r)
                terms = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(n) + 1)).astype(np.int32)), pa.array(key))
                out = pa.RecordBatch.from_arrays([*part.columns[:3], terms, pa.array([",".join(sorted(x)) for x in numbers], pa.string())], ["side", "d", "block", "terms", "numbers"])
                yield out.filter(pa.array(n > 0))

    return rows.select("side", "d", "block", "text").mapInArrow(run, "side int, d string, block string, terms array<long>, numbers string")


def _fronts(vectors: DataFrame, threshold: float) -> DataFrame:
    """The rows (side, v, term) of the vectors' fronts. vectors: side, v, term, idf and the norm of the row's vector."""
    # A term's highest weight on a side is its idf by the smallest norm there.
    least = vectors.groupBy("term", "side").agg(F.min("norm").alias("least"), F.count(F.lit(1)).alias("n"))
    both = least.groupBy("term").agg(*[F.max(F.when(F.col("side") == k, F.col("least"))).alias(f"least_{k}") for k in (0, 1)], F.sum("n").alias("n")).filter("least_0 is not null and least_1 is not null")
    # a term that the other side doesn't have adds to no product
    x = hot_join(vectors, both, ["term"], "n", F.col("v")).withColumn("least", F.when(F.col("side") == 0, F.col("least_1")).otherwise(F.col("least_0"))).drop("least_0", "least_1", "n")
    behind = W.partitionBy("v").orderBy("idf", F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
    w = F.col("idf") / F.col("norm")
    x = x.withColumn("rest", F.sqrt(F.sum(w * w).over(behind))).withColumn("reach", F.sum(w * F.col("idf") / F.col("least")).over(behind))
    return x.filter(F.least("rest", "reach") >= threshold - 1e-9).select("side", "v", "term")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, equal_numbers: bool = False) -> DataFrame:
    """Pairs of rows of left and right (both: d, block, text) of one block with a cosine of at least threshold:
    left_d, right_d, cosine.

    equal_numbers: only pairs whose texts hold the same numbers. They are then part of the block, so that a block that
    holds a third of all rows is split by them before its lists meet.

    block is a column that must be equal, such as a key that both records need to share; with a constant there the join is
    over all rows. Rows with a null d, block or text, and texts without letters and digits, match nothing. d must be
    unique on each side. Equal texts have cosine 1. No pair at or above the threshold is lost.
    """
    side = lambda df, k: df.select(F.lit(k).alias("side"), F.col("d").cast("string").alias("d"), F.col("block").cast("string").alias("block"), "text")
    both = side(left, 0).unionByName(side(right, 1)).filter("d is not null and block is not null and text is not null")
    # Rows go by a number from here on, which is fixed as it is written with them.
    both = materialize(prepared(both).withColumn("v", F.monotonically_increasing_id()), "prepared")
    lists = materialize(both.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "lists")
    total = both.count()
    # Only rows whose block is on the other side too can have a partner; the frequencies above count all rows.
    hashed = both.withColumn("b", F.xxhash64("block", "numbers") if equal_numbers else F.xxhash64("block"))
    blocks = hashed.groupBy("b").agg(F.min("side").alias("x"), F.max("side").alias("y")).filter("x = 0 and y = 1").select("b")
    rows = hashed.join(blocks, "b", "left_semi").select(F.col("side").cast("tinyint").alias("side"), "v", F.explode("terms").alias("term"))
    raw = hot_join(rows, lists, ["term"], "n", F.col("v")).withColumn("idf", F.log1p(total / F.col("n"))).drop("n")
    vectors = raw.withColumn("norm", F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(W.partitionBy("v"))))
    vectors = materialize(vectors.select("side", "v", "term", "idf", "norm"), "vectors")
    fronts = _fronts(vectors, threshold).join(hashed.select("v", "b"), "v")
    a = fronts.filter("side = 0").select(F.col("v").alias("left_v"), "b", "term")
    b = fronts.filter("side = 1").select(F.col("v").alias("right_v"), "b", "term")
    pairs = a.join(b, ["b", "term"]).select("left_v", "right_v").distinct()
    x = vectors.filter("side = 0").select(F.col("v").alias("left_v"), "term", (F.col("idf") / F.col("norm")).alias("wa"))
    y = vectors.filter("side = 1").select(F.col("v").alias("right_v"), "term", (F.col("idf") / F.col("norm")).alias("wb"))
    dots = pairs.join(x, "left_v").join(y, ["right_v", "term"]).groupBy("left_v", "right_v").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    near = dots.filter(F.col("cosine") >= threshold - 1e-9)
    facts = lambda k, name: both.filter(F.col("side") == k).select(F.col("v").alias(f"{name}_v"), F.col("d").alias(f"{name}_d"), F.col("block").alias(f"{name}_block"), F.col("numbers").alias(f"{name}_numbers"))
    sure = near.join(facts(0, "left"), "left_v").join(facts(1, "right"), "right_v").filter("left_block = right_block")
    if equal_numbers:
        sure = sure.filter("left_numbers = right_numbers")
    return sure.select("left_d", "right_d", "cosine")


def same_questions(evaluation: DataFrame, training: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """split, eval_id, train_id, cosine: training questions that are a question of an evaluation record, exactly or nearly.

    evaluation: split, eval_id, forms (array of texts), required (array); training: train_id, text, required. Both must
    require the same set, null and empty sets being alike, and hold the same numbers; questions with other sums or periods
    are others. A pair counts once, with its highest cosine. Null texts match nothing.
    """
    block = lambda c: F.to_json(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))))
    forms = evaluation.select("split", "eval_id", block(F.col("required")).alias("block"), F.posexplode("forms").alias("form", "text")).filter("eval_id is not null")
    left = forms.withColumn("d", F.to_json(F.struct("split", "eval_id", "form")))
    right = training.filter("train_id is not null").select(F.col("train_id").alias("d"), block(F.col("required")).alias("block"), "text")
    sure = cosine_join(left, right, threshold, equal_numbers=True)
    key = F.from_json("left_d", "split string, eval_id string, form int")
    return sure.groupBy(key["split"].alias("split"), key["eval_id"].alias("eval_id"), F.col("right_d").alias("train_id")).agg(F.max("cosine").alias("cosine"))
