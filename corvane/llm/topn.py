"""Top N items of every group by statistics-guided skipping.

The candidate rows are written once, clustered by group and descending score, to Parquet files in the shared folder. A
group of any size is spread over as many files and row groups as its rows need, since the range partitioning uses the
score as well. The row groups' statistics (group range, highest score, smallest item) form a manifest. Row groups in
which some group begins are read first; what is left are row groups inside the run of one single group, and of these, in
descending order of their highest score, only those are read that are not strictly below the group's current N-th
(score, item). The number read per group doubles from wave to wave, so long runs of ties need few waves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.runtime import materialize, work_path

_MANIFEST = "file string, rg int, n_rows long, g_min string, g_max string, s_max double, i_min string"


def _open(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(path))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stat(group, column, what):
        s = group.column(column).statistics
        return getattr(s, what) if s is not None and s.has_min_max else None

    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            with _open(uri) as file:
                meta = file.metadata
                at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
                for k in range(meta.num_row_groups):
                    rg = meta.row_group(k)
                    rows.append((uri, k, rg.num_rows, stat(rg, at["g"], "min"), stat(rg, at["g"], "max"), stat(rg, at["score"], "max"), stat(rg, at["item"], "min")))
        names = [x.split()[0] for x in _MANIFEST.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)


def _local_top(n: int):
    """Of each row group, which is in order of group, descending score and item: the first n items of every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(uri) as file:
                    for k in groups:
                        t = file.read_row_group(k, columns=["g", "item", "score"])
                        if not t.num_rows:
                            continue
                        t = t.combine_chunks()
                        g = pc.dictionary_encode(t["g"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
                        item = pc.dictionary_encode(t["item"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
                        first = np.sort(np.unique(g << 32 | item, return_index=True)[1])
                        own = g[first]
                        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
                        yield from t.take(pa.array(first[place < n])).to_batches()

    return run


def _read(row_groups: DataFrame, n: int) -> DataFrame:
    by_file = row_groups.groupBy("file").agg(F.sort_array(F.collect_list("rg")).alias("rgs"))
    return by_file.mapInArrow(_local_top(n), "g string, item string, score double")


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The n best of each group among rows that hold at most n of each row group."""
    once = rows.groupBy("g", "item").agg(F.max("score").alias("score"))
    order = W.partitionBy("g").orderBy(F.desc("score"), F.asc("item"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int, row_group_bytes: int = 2 << 20) -> DataFrame:
    """The n items with the highest scores of each group: the group columns, item, score and rank (from 1).

    An item counts once in a group, with its highest finite score. Null, NaN and infinite scores and null items don't
    count; a group without any counting row is absent; null in a group column is a group of its own. Equal scores go by
    item, smaller code points first. Groups with fewer than n items give all. Other columns of df are ignored, whatever
    their names. n below 1 and an empty df give no rows. row_group_bytes: size of the row groups that are skipped or read.
    """
    spark = df.sparkSession
    key = F.to_json(F.struct(*[F.col(c) for c in groups]), {"ignoreNullFields": "false"})
    value = F.col(score).cast("double")
    rows = df.select(key.alias("g"), F.col(item).cast("string").alias("item"), (value + F.lit(0.0)).alias("score"))
    rows = rows.filter(F.col("item").isNotNull() & (F.abs("score") < float("inf")))
    out = f"{', '.join(f'`{c}` {df.schema[c].dataType.simpleString()}' for c in groups)}"
    order = [F.asc("g"), F.desc("score"), F.asc("item")]
    path = work_path(spark, "topn")
    (rows.filter(F.lit(n > 0)).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(max(row_group_bytes // 8, 8192))).parquet(path))
    files = spark.read.schema(rows.schema).parquet(path).inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)))
    manifest = materialize(listed.mapInArrow(_footers, _MANIFEST).filter("n_rows > 0"), "topn-manifest")
    before = F.lag("g_max").over(W.partitionBy("file").orderBy("rg"))
    inside = (F.col("g_min") == F.col("g_max")) & (F.col("g_max") == before) & F.col("s_max").isNotNull() & F.col("i_min").isNotNull()
    manifest = manifest.withColumn("inside", F.coalesce(inside, F.lit(False)))
    rest = manifest.filter("inside")
    # active: groups that may still change; a group is closed, and not written again, when no row group of it is left to read.
    active = materialize(_best(_read(manifest.filter("not inside"), n), n), "topn-wave")
    parts: list[DataFrame] = []
    done: DataFrame | None = None
    wave = 1
    while True:
        last = active.filter(F.col("rank") == n).select(F.col("g").alias("g_min"), F.col("score").alias("n_score"), F.col("item").alias("n_item"))
        open_ = rest if done is None else rest.join(done, ["file", "rg"], "left_anti")
        below = (F.col("s_max") < F.col("n_score")) | ((F.col("s_max") == F.col("n_score")) & (F.col("i_min") > F.col("n_item")))
        open_ = open_.join(last, "g_min", "left").filter(~F.coalesce(below, F.lit(False)))
        turn = F.row_number().over(W.partitionBy("g_min").orderBy(F.desc("s_max"), F.asc("file"), F.asc("rg")))
        now = materialize(open_.withColumn("turn", turn).filter(F.col("turn") <= wave).select("file", "rg", F.col("g_min").alias("g")), "topn-open")
        if now.isEmpty():
            parts.append(active)
            break
        groups = now.select("g").distinct()
        parts.append(active.join(groups, "g", "left_anti"))
        active = materialize(_best(active.join(groups, "g", "left_semi").select("g", "item", "score").unionByName(_read(now, n)), n), "topn-wave")
        read = now.select("file", "rg")
        done = read if done is None else done.unionByName(read)
        rest = rest.join(groups.withColumnRenamed("g", "g_min"), "g_min", "left_semi")
        wave *= 2
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    parsed = F.from_json("g", out, {"mode": "FAILFAST"})
    return found.select(*[parsed[c].alias(c) for c in groups], F.col("item").alias(item), F.col("score").alias(score), "rank")
