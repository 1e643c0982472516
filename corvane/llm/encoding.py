"""Encoding of a corpus with a public byte-level BPE tokenizer, by reuse of content-defined chunks.

A rolling hash over the code points cuts every text into chunks of some hundreds of code points that depend on the content
only, so equal passages give equal chunks wherever they stand. Chunks are brought together by their hash over the whole
cluster; each that stands in several places is encoded once, and its ids go to the other places.

A cut may fall inside a pre-token; such a join is repaired. A boundary is sure if the tokenizer's pattern must end a
pre-token there whatever stands before and after. What stands between the last sure boundary before the join and the first
one after it is taken out of both chunks and encoded again; if a chunk holds no sure boundary, the piece goes on into the
next chunk. Up to such a boundary, and from it on, the ids of a chunk are those of the whole text, so all ids agree.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.codepoints import classes, flat, slices
from corvane.llm.skew import hot_join
from corvane.runtime import materialize, work_path

#: Code points that the rolling hash looks at, and of a chunk on average.
WINDOW, AVERAGE = 16, 512


def tokenizer_dir() -> str:
    return os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")


@lru_cache(maxsize=2)
def _encoder(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: the pre-token pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def sure(cps: np.ndarray) -> np.ndarray:
    """Whether the pattern ends a pre-token before each code point but the first, whatever the context.

    No alternative goes on into white space after something else, from a letter to a non-letter, from a number to a
    non-number, or from another sign to a number; from another sign to a letter only after an apostrophe.
    """
    kind = classes()[cps]
    a, b, left = kind[:-1], kind[1:], cps[:-1]
    known = (a != 0) & (b != 0) & (a != 3)
    return known & ((b == 3) | ((a != b) & ((b != 1) | (left != 0x27))))


def _marks(cps: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the WINDOW code points before a position asks for a cut."""
    h = np.zeros(len(cps), np.uint64)
    mixed = (cps.astype(np.uint64) + np.uint64(0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for k in range(WINDOW):
        h[k:] += mixed[: len(cps) - k] * np.uint64((0x94D049BB133111EB * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
    return ((h >> np.uint64(40)) % np.uint64(AVERAGE)) == 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, key and text of each text with the ends of its chunks and the two halves of each chunk's hash; null for null texts."""
    import xxhash

    for batch in batches:
        for part in slices(batch, 2):
            values, cps, bounds = flat(part.column(2))
            at = np.flatnonzero(_marks(cps)) + 1 if len(cps) else np.zeros(0, np.int64)
            low, high = np.searchsorted(at, bounds[:-1], side="right"), np.searchsorted(at, bounds[1:])
            ends: list[list[int] | None] = []
            for v, a, b, first in zip(values, low.tolist(), high.tolist(), bounds.tolist()):
                ends.append(None if v is None else [*(at[a:b] - first).tolist(), len(v)] if a < b else [len(v)])
            digests = b"".join(xxhash.xxh3_128_digest(c.encode()) for v, e in zip(values, ends) if e for c in _chunks(v, e))
            halves = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
            offsets = pa.array(np.r_[0, np.cumsum([len(e) if e else 0 for e in ends])].astype(np.int32), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(halves[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(ends, pa.list_(pa.int32())), *lists], ["row", "key", "text", "ends", "h1", "h2"])


def _chunks(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _encode_chunks(encode, chunks: list[str]) -> list[list]:
    """ids of each chunk; its first and last sure boundary, as the text and the number of ids before and behind them. A chunk
    without a sure boundary has all of its text before it."""
    cps = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(c) for c in chunks])
    ok = np.flatnonzero(sure(cps)) + 1 if len(cps) > 1 else np.zeros(0, np.int64)
    begin = ends - [len(c) for c in chunks]
    a, b = np.searchsorted(ok, begin, side="right"), np.searchsorted(ok, ends)
    out: list[list] = [[], [], [], [], []]
    for c, x, i, j in zip(chunks, begin.tolist(), a.tolist(), b.tolist()):
        ids = encode(c)
        head, tail = (c[: ok[i] - x], c[ok[j - 1] - x :]) if i < j else (c, None)
        for column, value in zip(out, (ids, head, len(encode(head)) if i < j else len(ids), tail, len(encode(tail)) if i < j else 0)):
            column.append(value)
    return out


def _apart(first: str, second: str) -> bool:
    """Whether a pre-token must end between two signs."""
    return bool(sure(np.array([ord(first), ord(second)], np.uint32))[0])


def _assemble(encode, parts: list[tuple]) -> np.ndarray:
    """The ids of a text from its chunks (ids, head, head_n, tail, tail_n) in order, with the joins repaired."""
    out: list[np.ndarray] = []
    loose = ""  # text behind the last sure boundary, whose ids are still open
    for k, (ids, head, head_n, tail, tail_n) in enumerate(parts):
        last = k == len(parts) - 1
        if loose and not _apart(loose[-1], head[0]):
            loose, begin = loose + head, head_n
            if tail is None:  # no sure boundary here: on into the next chunk
                continue
            out.append(np.array(encode(loose), np.int32))
        else:
            if loose:
                out.append(np.array(encode(loose), np.int32))
            begin = 0
            if tail is None:
                loose = head
                continue
        loose = "" if last else tail
        out.append(ids[begin : len(ids) if last else len(ids) - tail_n])
    if loose:
        out.append(np.array(encode(loose), np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class _Shared:
    """The shared chunks of some rows, read from the folder that holds them by the upper bits of the row."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.part, self.rows = -1, {}

    def of(self, row: int) -> dict[int, bool] | None:
        """Of a row's shared chunks by their number whether it is the one that encodes the chunk; null if it has none."""
        if row >> 33 != self.part:
            import pyarrow.parquet as pq
            from pyarrow import fs

            self.part, self.rows = row >> 33, {}
            for info in self.system.get_file_info(fs.FileSelector(f"{self.path}/part={self.part}", allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    t = pq.read_table(self.system.open_input_file(info.path), columns=["row", "seq", "own"])
                    for r, s, own in zip(*(c.to_pylist() for c in t.columns)):
                        self.rows.setdefault(r, {})[s] = own
        return self.rows.get(row)


_KINDS = "kind string, row long, key {0}, seq int, h1 long, h2 long, ids array<int>, head string, head_n int, tail string, tail_n int"


def encode_corpus(df: DataFrame, key: str, text: str, ranks_file: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """key and ids (array of int, no special tokens) of every row: exactly the tokenizer's encoding of the whole text.

    Empty text gives an empty list, null text gives null. The strings of special tokens are ordinary text. Rows stay as
    they are delivered: repeated or null keys are kept. Other columns of df are ignored. ranks_file must be at the same
    path on every executor.

    Only hashes are exchanged to learn which chunks stand in several places. Texts without such a chunk are encoded where
    they lie. Of the others each text encodes its own chunks and those shared ones of which it is the first holder; the
    ids of these are exchanged, and only texts with a chunk from elsewhere are put together from parts.
    """
    file = ranks_file or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    texts = materialize(rows.mapInArrow(_cut, f"row long, key {kind}, text string, ends array<int>, h1 array<long>, h2 array<long>"), "texts", "zstd")
    refs = texts.select("row", F.posexplode(F.arrays_zip("h1", "h2")).alias("seq", "h")).select("row", "seq", "h.h1", "h.h2")
    shared = refs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "seq")).alias("first")).filter("n > 1")
    plan = hot_join(refs, shared, ["h1", "h2"], "n", F.col("row")).select("row", "seq", (F.struct("row", "seq") == F.col("first")).alias("own"), F.shiftright("row", 33).alias("part"))
    folder = work_path(df.sparkSession, "shared")
    plan.write.partitionBy("part").parquet(folder)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(file, pattern).encode_ordinary, _Shared(folder)
        for batch in batches:
            for part in slices(batch, 2):
                alone = pa.array([known.of(r) is None for r in part.column(0).to_pylist()])
                own = part.filter(alone)
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array([None if t is None else encode(t) for t in own.column(2).to_pylist()], pa.list_(pa.int32()))], [key, "ids"])

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(file, pattern).encode_ordinary, _Shared(folder)
        names = [x.split()[0] for x in _KINDS.split(", ")]
        for batch in batches:
            for part in slices(batch, 2):
                marked = [known.of(r) for r in part.column(0).to_pylist()]
                some = part.filter(pa.array([m is not None for m in marked]))
                out: list[tuple] = []
                for r, k, t, ends, h1, h2, m in zip(*(c.to_pylist() for c in some.columns), [m for m in marked if m is not None]):
                    chunks = _chunks(t, ends)
                    mine = [j for j in range(len(chunks)) if m.get(j, True)]
                    made = dict(zip(mine, zip(*_encode_chunks(encode, [chunks[j] for j in mine])))) if mine else {}
                    if len(mine) == len(chunks):
                        ids = _assemble(encode, [(np.array(made[j][0], np.int32), *made[j][1:]) for j in mine])
                        out.append(("done", r, k, 0, 0, 0, ids, None, 0, None, 0))
                    else:
                        out += [("part", r, k, j, h1[j], h2[j], *made[j]) if j in made else ("hole", r, k, j, h1[j], h2[j], None, None, 0, None, 0) for j in range(len(chunks))]
                    out += [("shared", r, k, j, h1[j], h2[j], *made[j]) for j in mine if m.get(j, False)]
                kinds = [pa.string(), pa.int64(), some.column(1).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kinds[j]) for j in range(11)], names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(file, pattern).encode_ordinary
        for batch in batches:
            lists = batch.column(1)
            bounds, fields = lists.offsets.to_numpy(), lists.values.flatten()
            ids, at = fields[1].values.to_numpy(zero_copy_only=False), fields[1].offsets.to_numpy()
            head, head_n, tail, tail_n = (f.to_pylist() for f in fields[2:])
            base = bounds[0]
            whole = [[(ids[at[k] : at[k + 1]], head[k], head_n[k], tail[k], tail_n[k]) for k in range(x - base, y - base)] for x, y in zip(bounds, bounds[1:])]
            made = [p[0][0] if len(p) == 1 else _assemble(encode, p) for p in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], [key, "ids"])

    split = work_path(df.sparkSession, "encoded")
    schema = _KINDS.format(kind)
    texts.filter("text is not null").select("row", "key", "text", "ends", "h1", "h2").mapInArrow(involved, schema).write.option("compression", "zstd").partitionBy("kind").parquet(split)
    parts = df.sparkSession.read.schema(schema).parquet(split)
    fields = ["ids", "head", "head_n", "tail", "tail_n"]
    ids = parts.filter("kind = 'shared'").select("h1", "h2", *fields)
    holes = parts.filter("kind = 'hole'").select("row", "key", "seq", "h1", "h2")
    asked = holes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    filled = hot_join(holes, ids.join(asked, ["h1", "h2"]), ["h1", "h2"], "n", F.col("row")).select("row", "key", "seq", *fields)
    open_ = filled.unionByName(parts.filter("kind = 'part'").select("row", "key", "seq", *fields))
    put = open_.groupBy("row").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("seq", *fields))).alias("parts"))
    out_schema = f"`{key}` {kind}, ids array<int>"
    out = texts.select("row", "key", "text").mapInArrow(done, out_schema).unionByName(put.select("key", "parts").mapInArrow(assemble, out_schema))
    return out.unionByName(parts.filter("kind = 'done'").select(F.col("key").alias(key), "ids"))


def encode_directly(df: DataFrame, key: str, text: str, ranks_file: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """The same result without reuse: every text is encoded where it lies. What encode_corpus is measured against."""
    file = ranks_file or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(file, pattern).encode_ordinary
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
