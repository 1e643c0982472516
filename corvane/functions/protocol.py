"""Checks of model answers that need a strict JSON parser."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F


class _Repeated(ValueError):
    pass


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Repeated
    return out


def defect(raw: str | None, evidence: int) -> str:
    """The first defect of an answer, or 'none'. The answer must be {"summary": one line, "citations": ["E1", ...]}."""
    if raw is None or not raw.strip():
        return "empty"
    try:
        value = json.loads(raw, object_pairs_hook=_once, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except _Repeated:
        return "repeated_field"
    except (ValueError, RecursionError):
        return "no_json"
    if not isinstance(value, dict) or set(value) != {"summary", "citations"}:
        return "fields"
    summary, cited = value["summary"], value["citations"]
    if not isinstance(summary, str) or not summary.strip() or "\n" in summary:
        return "summary"
    known = {f"E{k + 1}" for k in range(evidence or 0)}
    if not isinstance(cited, list) or len({*map(str, cited)}) != len(cited) or not set(map(str, cited)) <= known:
        return "citations"
    return "none"


def answer_defect(raw: str, evidence: str) -> Column:
    @F.pandas_udf("string")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([defect(a, int(b) if b == b and b is not None else 0) for a, b in zip(r, n)])

    return run(F.col(raw), F.col(evidence))
