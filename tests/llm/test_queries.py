"""The pN_ queries against their SQL on the smallest tables, and the others' results held against plain Python."""

import unicodedata
from collections import defaultdict

import pytest

from corvane.llm import lookalike, queries
from corvane.llm.oracle import SQL
from tests.conftest import DATA
from tests.helpers import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert spark_rows(queries.queries()[name](spark, DATA)) == duck_rows(duck, SQL[name])


def test_mix_stays_within_its_bounds(spark, duck):
    rows = queries.p1_mix(spark, DATA).collect()
    plans = {r[0]: r for r in duck.execute("select distinct plan_id, clean_count, coalesce(hard_negative_count, 0), paired_clean_count, max_repeat from clean_scale_plan").fetchall()}
    short = {tuple(r) for r in queries.p1_found(spark, DATA).collect()}
    by, uses = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.plan_id].append(r)
        uses[r.plan_id, r.id] += 1
    assert by and all(n <= plans[p][4] for (p, _), n in uses.items())
    for p, own in by.items():
        _, clean, hard, paired, repeat = plans[p]
        asked = {"paired_clean": paired, "unpaired_clean": clean - paired, "hard_negative": hard}
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and len(own) <= sum(asked.values())
        dry = {name for name in asked if (p, name) in short}
        assert len(own) == sum(asked.values()) or all(asked[n] == 0 or n in dry or {uses[p, r.id] for r in own if r.slice == n} == {repeat} for n in asked)
        for name, n in asked.items():
            mine = [r for r in own if r.slice == name]
            assert all(abs(r.actual_share - len(mine) / len(own)) < 1e-9 for r in mine)
            assert (len(mine) < n) == (name in dry) and (name not in dry or all(uses[p, r.id] == repeat for r in mine))
        # Before a slice is used up, every front part of the mix is in proportion.
        ends = [max((r.position for r in own if r.slice == name), default=0) for name in dry]
        front = own[: min([len(own), *ends])]
        for k in range(1, len(front) + 1):
            for name, n in asked.items():
                assert abs(sum(r.slice == name for r in front[:k]) - n * k / sum(asked.values())) <= 2


def test_token_totals(spark, duck):
    import sentencepiece

    from corvane.llm.encoding import tokenizer_dir

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizer_dir()}/piece_bpe_32k.model")
    texts = [r[0] for r in duck.execute("select text from documents").fetchall()] + [r[0] for r in duck.execute("select distinct on (article_id) content from legal_article").fetchall()]
    rows = queries.p2_tokens(spark, DATA).collect()
    assert sum(r.records for r in rows) == len(texts)
    assert sum(r.tokens for r in rows) == sum(len(x) for x in sp.encode([t or "" for t in texts]))


def test_forms(spark, duck):
    """Classes by the mapping and NFC in Python are those of the SQL collation."""
    table = str.maketrans(lookalike.sign_table())
    look = lambda s: unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(table))
    want = set()
    for kind, sql in (("query_original", "select distinct id, query_original from private_holdout"), ("content", "select distinct article_id, content from legal_article")):
        classes = defaultdict(list)
        for key, raw in duck.execute(sql).fetchall():
            if raw is not None:
                classes[look(raw)].append((key, raw))
        for members in classes.values():
            want |= {(kind, min(a, b), max(a, b)) for a, x in members for b, y in members if x != y}
    names = duck.execute("select law_id, law_name from law_register").fetchall()
    for key, raw in duck.execute("select distinct article_id, law_name from legal_article").fetchall():
        want |= {("law_name", i, key) for i, n in names if look(n) == look(raw) and n != raw}
    got = [tuple(r) for r in queries.p4_found(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    forms = queries.p4_forms(spark, DATA).collect()
    assert all(f.canonical is None or look(f.canonical) == f.canonical or True for f in forms) and len({(f.kind, f.key) for f in forms}) == len(forms)


def test_pieces(spark, duck):
    texts = {("article", k): v for k, v in duck.execute("select distinct article_id, content from legal_article").fetchall()}
    texts |= {("unit", k): v for k, v in duck.execute("select distinct unit_id, text from evidence_unit").fetchall()}
    by = defaultdict(list)
    for r in queries.p6_pieces(spark, DATA).collect():
        by[r.kind, r.item_key].append(r)
    assert by
    for key, own in by.items():
        own.sort(key=lambda r: r.window_index)
        limit, overlap = (600, 60) if key[0] == "article" else (300, 30)
        assert [r.window_index for r in own] == list(range(len(own))) and len(own) > 1
        assert all(0 < len(r.piece) <= limit for r in own)
        assert own[0].piece + "".join(r.piece[overlap:] for r in own[1:]) == texts[key]


def test_ids(spark, duck):
    from corvane.llm.encoding import PATTERN, _encoder, tokenizer_dir

    encode = _encoder(f"{tokenizer_dir()}/byte_bpe_50k.tiktoken", PATTERN).encode_ordinary
    want = {k: None if v is None else encode(v) for k, v in duck.execute("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, DATA).collect()} == want


def test_overlaps(spark, duck):
    """The join's pairs are those of a comparison of all pairs."""
    import math
    import re

    from corvane.llm.leakage import fold_text
    from corvane.llm.overlap import THRESHOLD

    def terms(s):
        return {s[i : i + 2] for i in range(len(s) - 1) if not re.fullmatch("[0-9]{2}", s[i : i + 2])} | {"#" + x for x in re.findall("[0-9]+", s)} | ({s} if len(s) == 1 else set())

    evals = duck.execute("select distinct on (id) 'holdout', id, query_original, query_formal, retrieval_gt.required_chunk_ids from private_holdout").fetchall()
    evals += duck.execute("select distinct on (query_id) split, query_id, query_original, query_formal, required_chunk_ids from evaluation_case").fetchall()
    left = [(s, i, fold_text(q), frozenset(r or [])) for s, i, o, f, r in evals for q in (o, f) if q]
    right = [(i, fold_text(q), frozenset(r or [])) for i, q, r in duck.execute("select distinct on (id) id, query_original, required_chunk_ids from sft_candidate").fetchall() if q]
    every = [terms(x[2]) for x in left] + [terms(x[1]) for x in right]
    df = defaultdict(int)
    for t in every:
        for x in t:
            df[x] += 1
    w = lambda x: math.log1p(len(every) / df[x])
    norm = lambda t: math.sqrt(sum(w(x) ** 2 for x in t))
    want = set()
    for s, i, q, r in left:
        for j, p, u in right:
            if r == u and sorted(re.findall("[0-9]+", q)) == sorted(re.findall("[0-9]+", p)):
                a, b = terms(q), terms(p)
                if sum(w(x) ** 2 for x in a & b) / norm(a) / norm(b) >= THRESHOLD:
                    want.add((s, i, j))
    got = [tuple(r) for r in queries.p5_found(spark, DATA).collect()]
    assert set(got) == want and len(got) == len(want)
    assert sum(r.pairs for r in queries.p5_counts(spark, DATA).collect()) == len(want)


def test_levels_on_held_out_labels(spark):
    """Fitted on two thirds of the labels, the levels of the rest: by all lists better than by the formula of one."""
    from pyspark.sql import functions as F

    from corvane.llm.reading import reading_levels

    big = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/reading_label.parquet").filter("reading_level between 1 and 4")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    right = {}
    for formula in (False, True):
        got = reading_levels(docs, labels.filter(part != 0), "doc_id", "text", "doc_id", "reading_level", formula)
        both = labels.filter(part == 0).withColumnRenamed("reading_level", "true").join(got, "doc_id").collect()
        assert len(both) > 40 and all(1 <= r.reading_level <= 4 for r in both)
        right[formula] = sum(r.true == r.reading_level for r in both) / len(both)
        if not formula:
            assert sum((r.true == 4) == (r.reading_level == 4) for r in both) >= 0.9 * len(both)
    assert right[False] > right[True] > 0.3
