"""Counts over the texts of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """pair and n: how often two signs stand next to each other in all texts. Null texts and single signs have no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            inside = np.ones(max(0, len(cps) - 1), bool)
            inside[np.cumsum([len(t) for t in texts], dtype=np.int64)[:-1] - 1] = False  # not across two texts
            key, n = np.unique((cps[:-1] << 21 | cps[1:])[inside], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([chr(k >> 21) + chr(k & 0x1FFFFF) for k in key.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["pair", "n"])

    return docs.select(text).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
