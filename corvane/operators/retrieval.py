"""Ranked lists: cutting, pooling, fusing, searching and packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.runtime import materialize


def rank_lists(hits: DataFrame, k: int, keys: list[str], item: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best items of each list, each item once with its highest finite score, ranked from 1; ties go by item.

    The cut stands in the plan as a group limit before the exchange, so long lists are never sorted in one task.
    """
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")) & F.col(item).isNotNull()
    best = hits.filter(finite).groupBy(*keys, item).agg(F.max(score).alias(score))
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rrf(lists: DataFrame, k: float, keys: list[str], item: str = "chunk_id", weight: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum over an item's lists of weight / (k + rank). Lists of weight 0 drop out."""
    w = F.lit(1.0) if weight is None else weight
    part = lists.withColumn("__w", w).filter(F.col("__w") > 0)
    return part.groupBy(*keys, item).agg(F.round(F.sum(F.col("__w") / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))


def cut(scored: DataFrame, k: int, keys: list[str], item: str = "chunk_id") -> DataFrame:
    """The k best of each list by score, ties by item, with rank."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Vectors of a task that are worked on together; the queries are read once for each such block.
VECTOR_BLOCK = 20_000


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """Exact inner-product search: query_id, vec_id, score (5 decimals) and rank of the k best vectors for each query.

    vectors, queries: vec_id, embedding. The queries lie in the shared folder and are taken block by block in every task,
    so neither the driver nor a broadcast holds them; of each task and block only the k best of each query go on.
    """
    path = materialize(queries.select("vec_id", "embedding").filter("embedding is not null"), "queries").inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        def blocks() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch.filter(batch.column(1).is_valid()))
                if sum(b.num_rows for b in held) >= VECTOR_BLOCK:
                    yield pa.Table.from_batches(held)
                    held = []
            if any(b.num_rows for b in held):
                yield pa.Table.from_batches(held)

        for own in blocks():
            ids = own.column(0).to_numpy()
            m = np.concatenate([np.array(c.flatten(), np.float64) for c in own.column(1).chunks]).reshape(len(ids), -1)
            for uri in path:
                system, name = fs.FileSystem.from_uri(uri)
                for q in pq.ParquetFile(system.open_input_file(name)).iter_batches(block):
                    s = np.round(np.array(q.column(1).flatten(), np.float64).reshape(q.num_rows, -1) @ m.T, 5) + 0.0
                    least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                    row, col = np.nonzero(s >= least[:, None])  # with all that tie with the k-th
                    yield pa.RecordBatch.from_arrays([q.column(0).take(pa.array(row)), pa.array(ids[col]), pa.array(s[row, col])], ["query_id", "vec_id", "score"])

    part = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    return cut(part, k, ["query_id"], "vec_id")


_LOCKED = "第[零〇一二三四五六七八九十百千0-9]+条(?:之[一二三四五六七八九十]+)?"
#: Terms of all questions that are sent to the tasks as one set; with more of them the postings are joined instead.
SENT_TERMS = 200_000


def tokens(text: Column) -> Column:
    """Search terms: article numbers kept whole and, outside them, runs of Latin letters and digits and pairs of
    neighbouring Han characters; a Han character that stands alone is a term of its own."""
    low = F.lower(text)
    rest = F.regexp_replace(low, _LOCKED, " ")

    def of_run(run: Column) -> Column:
        signs, n = F.split(run, ""), F.length(run)
        return F.when(n == 1, F.array(run)).otherwise(F.zip_with(F.slice(signs, F.lit(1), n - 1), F.slice(signs, F.lit(2), n - 1), lambda a, b: F.concat(a, b)))

    runs = F.regexp_extract_all(rest, F.lit(r"([\x{4E00}-\x{9FFF}]+)"), F.lit(1))
    return F.concat(F.regexp_extract_all(low, F.lit(f"({_LOCKED})"), F.lit(1)), F.regexp_extract_all(rest, F.lit("([a-z0-9]+)"), F.lit(1)), F.flatten(F.transform(runs, of_run)))


def _counted(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a batch of term lists: terms of each document, distinct terms, and number of list and of term of each entry."""
    sizes = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return sizes, coded.dictionary, np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def postings(docs: DataFrame, key: str, terms: Column, only=None) -> DataFrame:
    """Postings (term, key, tf, len) of an inverted index, len being the document's number of terms. docs has one row for each key.

    A document's terms are counted where its row lies, in Arrow batches, so the terms aren't exchanged to be counted.
    only: a broadcast list of the terms that are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else pa.array(only.value, pa.string())
        for batch in batches:
            sizes, words, row, code = _counted(batch.column(1))
            if wanted is not None:
                kept = pa.compute.is_in(words, wanted).to_numpy(zero_copy_only=False)[code] if len(words) else np.zeros(0, bool)
                row, code = row[kept], code[kept]
            n = max(1, len(words))
            pair, tf = np.unique(row * n + code, return_counts=True)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(pair % n)), batch.column(0).take(pa.array(pair // n)), pa.array(tf.astype(np.int64)), pa.array(sizes[pair // n])], ["term", key, "tf", "len"])

    return docs.select(key, terms.alias("terms")).mapInArrow(run, f"term string, `{key}` {docs.schema[key].dataType.simpleString()}, tf long, len long")


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """term and n, the documents that hold it, summed up by batch first; the row of the null term has n documents and all, their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, row, code = _counted(batch.column(0))
            n = max(1, len(words))
            df = np.bincount(np.unique(row * n + code) % n, minlength=len(words))[: len(words)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.r_[df, len(sizes)]), pa.array(np.r_[np.zeros(len(df), np.int64), sizes.sum()])], ["term", "n", "all"])

    return docs.select(terms.alias("terms")).mapInArrow(run, "term string, n long, all long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))


def postings_and_counts(docs: DataFrame, key: str, terms: Column, only=None) -> DataFrame:
    """Both postings (of the wanted terms) and term_counts (by batch, not yet summed up) in one pass over the documents:
    term, key, tf, len, n, all. Rows of postings have no n, rows of counts no key, tf and len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else pa.array(only.value, pa.string())
        for batch in batches:
            sizes, words, row, code = _counted(batch.column(1))
            n = max(1, len(words))
            pair, tf = np.unique(row * n + code, return_counts=True)
            df = np.bincount(pair % n, minlength=len(words))[: len(words)].astype(np.int64)
            if wanted is not None:
                kept = pa.compute.is_in(words, wanted).to_numpy(zero_copy_only=False)[pair % n] if len(words) else np.zeros(0, bool)
                pair, tf = pair[kept], tf[kept]
            none = lambda count, kind: pa.nulls(count, kind)
            found, terms_ = len(pair), len(words) + 1
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([words.take(pa.array(pair % n)).cast(pa.string()), words.cast(pa.string()), pa.array([None], pa.string())]),
                pa.concat_arrays([batch.column(0).take(pa.array(pair // n)), none(terms_, batch.column(0).type)]),
                pa.concat_arrays([pa.array(tf.astype(np.int64)), none(terms_, pa.int64())]), pa.concat_arrays([pa.array(sizes[pair // n]), none(terms_, pa.int64())]),
                pa.concat_arrays([none(found, pa.int64()), pa.array(np.r_[df, len(sizes)])]), pa.concat_arrays([none(found, pa.int64()), pa.array(np.r_[np.zeros(len(df), np.int64), sizes.sum()])]),
            ], ["term", key, "tf", "len", "n", "all"])

    return docs.select(key, terms.alias("terms")).mapInArrow(run, f"term string, `{key}` {docs.schema[key].dataType.simpleString()}, tf long, len long, n long, all long")


def bm25(docs: DataFrame, queries: DataFrame, key: str, query: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25, the k best documents with a positive score for each query: query, key, score and rank.

    docs: key, text; queries: query, text. idf = ln((N - n + 0.5) / (n + 0.5)); negative ones count as a quarter of the
    mean idf. One pass over the documents counts in how many each term stands and makes postings of the queries' terms only.
    """
    spark = docs.sparkSession
    terms = tokens(F.col("text"))
    asked = materialize(queries.select(query, F.explode(terms).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    words = asked.select("term").distinct()
    only = spark.sparkContext.broadcast([r[0] for r in words.collect()]) if words.count() <= SENT_TERMS else None
    scanned = materialize(postings_and_counts(docs, key, terms, only), "terms")
    counts = scanned.filter("n is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    stats = counts.filter("term is null").select(F.col("n").alias("docs"), (F.col("all") / F.col("n")).alias("avgdl"))  # one row
    idf = counts.filter("term is not null").crossJoin(F.broadcast(stats)).withColumn("raw", F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    rows = asked.join(idf, "term").join(scanned.filter("n is null").select("term", key, "tf", "len"), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    scored = rows.groupBy(query, key).agg(F.round(F.sum(part), 5).alias("score")).filter("score > 0")
    return cut(scored, k, [query], key)


def pack(items: Column, tokens_of: str, budget: int) -> Column:
    """Of an ordered array of structs those that fit a budget one after the other; one that doesn't fit is skipped."""
    first = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda acc, x: F.when(acc["used"] + x[tokens_of] <= budget, F.struct((acc["used"] + x[tokens_of]).cast("long").alias("used"), F.concat(acc["kept"], F.array(x["chunk_id"])).alias("kept"))).otherwise(acc)
    return F.aggregate(items, first, step)


def stage_metrics(required: Column, ranked: Column) -> Column:
    """Of the required ids and a ranked array: how many were matched, coverage, any, complete and reciprocal rank."""
    hit = F.array_intersect(required, ranked)
    first = F.array_min(F.filter(F.transform(required, lambda x: F.array_position(ranked, x)), lambda p: p > 0))
    return F.struct(
        F.size(hit).alias("matched"), (F.size(hit) / F.size(required)).alias("coverage"), (F.size(hit) > 0).alias("any_hit"),
        (F.size(hit) == F.size(required)).alias("complete"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"),
    )
