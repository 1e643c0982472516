"""Reading level of documents by familiar words.

Document frequencies of words are counted over the whole corpus; the words above a share of the documents form a list of
familiar words. Words of alphabetic scripts are runs of letters; in Chinese script, which doesn't mark words, pairs of
neighbouring characters take their place.

The familiar-word formula scores a document by the share of its words outside one list and its average sentence length,
each with a coefficient of its script, and three cuts on the score give the scale of the labels (fit_formula). One list
can't tell four levels apart, though: on held-out labels the formula gives the right level to 66 % of Chinese and 47 % of
English texts. So the levels come from the shares outside all lists of SHARES, with their medians over sentences, so that
tables, residue and single passages don't decide, and sentence length, by a multinomial regression (fit: 93 % and 92 %).
Both are fitted, for each script, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.codepoints import classes, flat, slices
from corvane.runtime import materialize

#: Shares of documents from which a word belongs to a familiar list. Words on the longest list number at most the average
#: count of distinct words in a document divided by the lowest share, which bounds what is sent to all tasks.
SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.045, 0.06, 0.08, 0.1, 0.13, 0.17, 0.22, 0.3)
#: Labelled documents the formula is fitted on, at most.
SAMPLE = 6_000
LEVELS = (1, 2, 3, 4)
HAN, ALPHA = 0, 1
_FEATURES = [f"u{k}" for k in range(len(SHARES))] + [f"m{k}" for k in range(len(SHARES))] + ["length", "average"]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 Han character, 2 other letter, 0 neither; and the letter as it is compared."""
    kind = np.where(classes() == 1, 2, 0).astype(np.uint8)
    for a, b in ((0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x33480)):
        kind[a:b] = 1
    from corvane.llm.leakage import fold_table

    return kind, np.where(fold_table() > 0, fold_table(), np.arange(0x110000)).astype(np.uint32)


# Signs that end a sentence.
_ENDS = np.array([ord(c) for c in "。！？；!?;…\n"], np.uint32)


def words(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of the words, where each begins, and the script of each."""
    kind, fold = _tables()
    k, c = kind[cps], fold[cps].astype(np.uint64)
    pair = np.flatnonzero((k[:-1] == 1) & (k[1:] == 1)) if len(k) > 1 else np.zeros(0, np.int64)
    han = c[pair] << np.uint64(21) | c[pair + 1]
    letter = k == 2
    begin = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    at = np.flatnonzero(letter)
    if len(at):
        first = np.searchsorted(at, begin)
        place = (np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))).astype(np.uint64)
        h = (c[at] + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1B54A32D192ED02))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        alpha = np.add.reduceat(h, first) | np.uint64(1 << 63)
    else:
        alpha = np.zeros(0, np.uint64)
    return np.r_[han, alpha].view(np.int64), np.r_[pair, begin], np.r_[np.zeros(len(pair), np.int8), np.ones(len(begin), np.int8)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word the number of documents it stands in; for keys -1 and -2 those with words of each script."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([counts, *(h[1] for h in held)])
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(n, first) if len(first) else n

    for batch in batches:
        for part in slices(batch, 0):
            _, cps, bounds = flat(part.column(0))
            if not len(cps):
                continue
            key, at, script = words(cps)
            doc = np.searchsorted(bounds, at, side="right") - 1
            order = np.argsort(key, kind="stable")  # documents stay in order for each word
            key, doc = key[order], doc[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            fresh = new | np.r_[True, doc[1:] != doc[:-1]] if len(key) else new
            first = np.flatnonzero(new)
            held.append((key[first], np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)))
            for s in (HAN, ALPHA):
                own = np.searchsorted(bounds, at[script == s], side="right") - 1
                held.append((np.array([-1 - s]), np.array([int((np.bincount(own) > 0).sum()) if len(own) else 0])))
            if sum(len(h[0]) for h in held) > 2_000_000:
                keys, counts = merged()
                held = []
    keys, counts = merged()
    for a in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(counts[a : a + 100_000])], ["word", "n"])


def familiar(documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of the longest familiar list, in order, and on how many of the lists each is."""
    counted = documents.select(text).mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "familiar")
    total = {r["word"]: r["n"] for r in counted.filter("word in (-1, -2)").collect()}
    of = [total.get(-1, 0), total.get(-2, 0)]
    # keys of alphabetic words are negative numbers
    least = [max(1.0, SHARES[0] * n) for n in of]
    rows = counted.filter("word not in (-1, -2)").filter(F.col("n") >= F.when(F.col("word") < 0, least[ALPHA]).otherwise(least[HAN])).toPandas()
    key, n = rows["word"].to_numpy(np.int64), rows["n"].to_numpy(float)
    share = n / np.where(key < 0, max(1, of[ALPHA]), max(1, of[HAN]))
    order = np.argsort(key)
    return key[order], (share[:, None] >= np.array(SHARES)).sum(1)[order].astype(np.int8)


def _medians(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The weighted median of each document's values."""
    order = np.lexsort((value, doc))
    d, v, w = doc[order], value[order], weight[order]
    upto = np.cumsum(w)
    total = np.bincount(d, w, n)
    before = np.r_[0, np.cumsum(total)][:-1]
    at = np.minimum(np.searchsorted(upto, before + total / 2), len(v) - 1)
    return np.where(total > 0, v[at], 0.0)


def features_of(cps: np.ndarray, bounds: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its main script (-1: no readable text) and the features."""
    n = len(bounds) - 1
    script, out = np.full(n, -1, np.int8), np.zeros((n, len(_FEATURES)))
    if not len(cps):
        return script, out
    known, degree = lists
    key, at, kind = words(cps)
    if not len(key):
        return script, out
    order = np.argsort(at, kind="stable")
    key, at, kind = key[order], at[order], kind[order]
    end = np.isin(cps, _ENDS)
    end[:-1] |= (cps[:-1] == 0x2E) & ((cps[1:] == 0x20) | (cps[1:] == 0x0A))  # a full stop before a blank
    border = np.zeros(len(cps) + 1, bool)
    border[1:] = end
    border[bounds] = True
    sentence = np.cumsum(border[:-1])[at]
    doc = np.searchsorted(bounds, at, side="right") - 1
    han = np.bincount(doc[kind == HAN], minlength=n)
    alpha = np.bincount(doc[kind == ALPHA], minlength=n)
    main = np.where(han >= 2 * alpha, HAN, ALPHA)  # a pair of characters is about half a word of running text
    script = np.where(han + alpha == 0, -1, main).astype(np.int8)
    own = kind == main[doc]
    key, sentence, doc = key[own], sentence[own], doc[own]
    if len(known):
        k = np.minimum(np.searchsorted(known, key), len(known) - 1)
        on = np.where(known[k] == key, degree[k], 0)
    else:
        on = np.zeros(len(key), np.int8)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    size = np.diff(np.r_[first, len(key)]).astype(float)
    sdoc = doc[first]
    for j in range(len(SHARES)):
        outside = np.add.reduceat((on <= j).astype(float), first)
        out[:, j] = _medians(sdoc, outside / size, size, n)
        out[:, len(SHARES) + j] = np.bincount(sdoc, outside, n) / np.maximum(1, np.bincount(sdoc, size, n))
    out[:, -2] = np.log1p(_medians(sdoc, size, size, n))
    out[:, -1] = np.bincount(sdoc, size, n) / np.maximum(1, np.bincount(sdoc, minlength=n))
    return script, out


def measure(documents: DataFrame, key: str, text: str, lists: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, script and the features of every document that has words."""
    shared = documents.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                _, cps, bounds = flat(part.column(1))
                script, x = features_of(cps, bounds, shared.value)
                columns = [part.column(0), pa.array(script), *(pa.array(x[:, j]) for j in range(x.shape[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "script", *_FEATURES]).filter(pa.array(script >= 0))

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"doc {kind}, script tinyint, " + ", ".join(f"{f} double" for f in _FEATURES))


def _score_terms(x: np.ndarray, j: int) -> np.ndarray:
    """The two terms of the formula: the share of words outside list j, and the average sentence length."""
    return np.c_[x[:, len(SHARES) + j], x[:, -1]]


def fit_formula(x: np.ndarray, level: np.ndarray, rounds: int = 50) -> dict:
    """One coefficient for each term and three cuts, by proportional odds; of all lists the one that fits best."""
    best: dict = {}
    above = np.concatenate([(level >= k).astype(float) for k in LEVELS[1:]])
    for j in range(len(SHARES)):
        terms = _score_terms(x, j)
        mean, scale = terms.mean(0), terms.std(0) + 1e-9
        z = np.tile((terms - mean) / scale, (3, 1))
        z = np.c_[z, np.repeat(np.eye(3), len(x), 0)]
        w, ridge = np.zeros(5), 1e-2 * np.eye(5)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.clip(np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (above - p) - 1e-2 * w), -2, 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
        fits = float((above * np.log(p) + (1 - above) * np.log(1 - p)).sum())
        if not best or fits > best["fits"]:
            best = {"fits": fits, "list": j, "mean": mean, "scale": scale, "coefficients": w[:2], "cuts": w[2:]}
    return best


def by_formula(model: dict, x: np.ndarray) -> np.ndarray:
    score = (_score_terms(x, model["list"]) - model["mean"]) / model["scale"] @ model["coefficients"]
    return 1 + (score[:, None] + model["cuts"] > 0).sum(1)


def _expand(x: np.ndarray) -> np.ndarray:
    x = x[:, :-1]
    return np.c_[x, x[:, :-1] ** 2]


def fit(x: np.ndarray, level: np.ndarray, rounds: int = 60) -> dict:
    """Multinomial logistic regression by Newton-like steps on standardized features."""
    x = _expand(x)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    y = (level[:, None] == np.array(LEVELS)).astype(float)
    w = np.zeros((z.shape[1], len(LEVELS)))
    # a bound on the curvature makes each step safe
    curve = np.linalg.inv(0.5 * z.T @ z + 1e-2 * len(z) / 100 * np.eye(z.shape[1]) + 1e-6 * np.eye(z.shape[1]))
    for _ in range(rounds * 20):
        p = np.exp((s := z @ w) - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w += curve @ (z.T @ (y - p) - 1e-2 * len(z) / 100 * w)
    return {"mean": mean, "scale": scale, "w": w}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "cuts" in model:
        return by_formula(model, x)
    z = np.c_[(_expand(x) - model["mean"]) / model["scale"], np.ones(len(x))]
    return np.array(LEVELS)[(z @ model["w"]).argmax(1)]


def reading_levels(documents: DataFrame, labels: DataFrame, doc_key: str, text: str, label_key: str, level: str, formula: bool = False) -> DataFrame:
    """doc_id and reading_level (1 to 4) of every document that has readable text, that is at least one word.

    Null, empty and blank texts and texts without words get no row. Null levels and levels off the scale are no labels;
    where raters differ, each rating counts. Without labels for a script its documents get the level by the other
    script's formula, and without any labels no document gets a level. Rows that repeat a document count as they are
    delivered. Other columns are ignored. No more than SAMPLE labelled rows, chosen by hash, are used for fitting.
    formula: by the formula of one list alone.
    """
    lists = familiar(documents, text)
    measured = materialize(measure(documents, doc_key, text, lists), "reading")
    rated = labels.filter(F.col(level).isin(*LEVELS)).select(F.col(label_key).alias("doc"), F.col(level).cast("int").alias("level"))
    rated = rated.orderBy(F.xxhash64("doc"), "level").limit(SAMPLE)
    sample = measured.join(rated, "doc").toPandas().sort_values(["doc", "level"])
    models = {}
    for s in (HAN, ALPHA):
        own = sample[sample.script == s]
        if len(own):
            models[s] = (fit_formula if formula else fit)(own[_FEATURES].to_numpy(float), own.level.to_numpy())
    kind = documents.schema[doc_key].dataType.simpleString()
    schema = f"doc_id {kind}, reading_level int"
    if not models:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([batch.column(2 + j).to_numpy() for j in range(len(_FEATURES))]).T.reshape(-1, len(_FEATURES))
            script, got = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for s in (HAN, ALPHA):
                own = script == s
                if own.any():
                    got[own] = predict(shared.value.get(s) or next(iter(shared.value.values())), x[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "reading_level"])

    return measured.select("doc", "script", *_FEATURES).mapInArrow(run, schema)
