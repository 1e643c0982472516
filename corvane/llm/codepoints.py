"""Texts of an Arrow batch as one NumPy array of code points, and character tables over all of Unicode."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of text worked on at a time; a longer single text is worked on alone.
CHUNK = 2_000_000


def slices(batch: pa.RecordBatch, column: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about chunk code points in the given text column."""
    n = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(n):
        return
    part = (np.cumsum(n) - n) // chunk
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(begin, np.r_[begin[1:], len(n)]):
        yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """The texts, their code points end to end, and the bounds of each text in them; null counts as empty."""
    values = texts.to_pylist()
    n = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(v for v in values if v)
    return values, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum(n)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For each code point: 0 unknown (not assigned), 1 letter, 2 number, 3 white space, 4 other."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    first = {"L": 1, "N": 2, "M": 4, "P": 4, "S": 4, "Z": 4}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = unicodedata.category(chr(cp))
        kinds[cp] = first.get(c[0], 0) or (4 if c in ("Cc", "Cf", "Co") else 0)
    # The code points with the property White_Space.
    for cp in (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kinds[cp] = 3
    return kinds
