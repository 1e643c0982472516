"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import codepoints, encoding, leakage, lookalike, mixing, overlap, reading, splitting, token_budget, topn


def rows(df, *cols):
    return sorted(df.select(*cols).collect() if cols else df.collect(), key=str)


# --- mixing ---------------------------------------------------------------------------------------------------------
RECORDS = "pool int, source string, id string, size int"
TARGETS = "plan string, pool int, source string, seed int, target int, max_repeat int"


def test_mix_by_size_repeats_small_sources_and_keeps_order(spark):
    rec = spark.createDataFrame([(1, "a", f"a{k}", 2) for k in range(3)] + [(1, "b", f"b{k}", 1) for k in range(50)], RECORDS)
    tgt = spark.createDataFrame([("p", 1, "a", 7, 12, 2), ("p", 1, "b", 7, 12, 2)], TARGETS)
    got = mixing.mix(rec, tgt).orderBy("position").collect()
    assert sum(r.size for r in got if r.source == "a") == 12 and sum(r.size for r in got if r.source == "b") == 12
    assert [r.finish for r in got] == sorted(r.finish for r in got) and max(r.use for r in got) == 2
    again = mixing.mix(rec.repartition(3), tgt).orderBy("position").collect()
    assert [(r.id, r.use) for r in again] == [(r.id, r.use) for r in got]


@pytest.mark.parametrize("seed", range(4))
def test_mix_is_the_merged_queue_cut_at_the_budget(spark, seed):
    """Against a queue merged and cut in plain Python, over the order and sizes of the operator's own queues."""
    r = random.Random(seed)
    rec = [(1, s, f"{s}{k}", r.randint(1, 4)) for s, n in (("a", 5), ("b", 40), ("c", 90)) for k in range(n)]
    plans = [(f"p{k}", {s: r.randint(0, 60) for s in "abcd"}, r.randint(1, 4)) for k in range(5)]
    tgt = [(p, 1, s, 7, t, m) for p, want, m in plans for s, t in want.items()]
    rec_df, tgt_df = spark.createDataFrame(rec, RECORDS), spark.createDataFrame(tgt, TARGETS)
    queue = {s: [(x.id, x.size) for x in mixing.mix(rec_df, spark.createDataFrame([("q", 1, s, 7, sum(x[3] for x in rec if x[1] == s), 1)], TARGETS)).orderBy("position").collect()] for s in "abc"}
    got = {}
    for x in mixing.mix(rec_df, tgt_df).orderBy("plan", "position").collect():
        got.setdefault(x.plan, []).append((x.source, x.id, x.use))
    for p, want, m in plans:
        merged = []
        for s in "abc":
            upto = 0
            for use in range(m):
                for i, size in queue[s] if want[s] else ():
                    upto += size
                    merged.append((upto / want[s], s, i, use + 1, size))
        mine, held = [], 0
        for _, s, i, use, size in sorted(merged):
            held += size
            if held > sum(want.values()):
                break
            mine.append((s, i, use))
        assert got.get(p, []) == mine


def test_mix_edges(spark):
    rec = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 1), (1, "a", "y", None), (1, "a", None, 1), (None, "a", "z", 1), (1, "a", "w", -3)], RECORDS)
    tgt = spark.createDataFrame([("p", 1, "a", None, 5, None), ("q", 1, "a", 1, None, 3), ("r", 1, "none", 1, 4, 1), ("s", 1, "a", 1, -2, 1), ("t", None, "a", 1, 2, 1)], TARGETS)
    mixed = mixing.mix(rec, tgt)
    assert [(r.plan, r.id, r.use) for r in mixed.collect()] == [("p", "x", 1)]
    short = {(r.plan, r.filled, r.target) for r in mixing.report(mixed, tgt).collect() if r.filled < r.target}
    assert short == {("p", 1, 5), ("r", 0, 4), ("t", 0, 2)}
    assert mixing.mix(rec.limit(0), tgt).count() == 0 and mixing.mix(rec, tgt.limit(0)).count() == 0


def test_prefix_over_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id"), F.floor(F.col("id") / 100).alias("b"))
    got = mixing.prefix_in_order(df, ["g"], "b", [F.asc("id")], {"upto": F.lit(2)})
    assert got.filter("upto <> 2 * (id + 1)").count() == 0


# --- top n ----------------------------------------------------------------------------------------------------------
def brute_top(data, n):
    best = {}
    for q, leg, c, s in data:
        if c is not None and s is not None and s == s and abs(s) != float("inf"):
            best.setdefault((q, leg), {})[c] = max(s, best.get((q, leg), {}).get(c, -1e300))
    return {(q, leg, c, s, k + 1) for (q, leg), own in best.items() for k, (c, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:n])}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_n_with_hot_group_and_ties(spark, n):
    r = random.Random(n)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    data = [("hot", "x", f"c{r.randrange(400)}", r.choice([*odd, round(r.random(), 2)])) for _ in range(6000)]
    data += [(r.choice(["a", None, "b\"}", ""]), r.choice(["x", None]), r.choice([None, "", "é", "z", "\U0001f600"]), r.choice([0.0, -0.0, 1.5, *odd])) for _ in range(400)]
    df = spark.createDataFrame(data, "query_id string, leg string, chunk_id string, s double").withColumns({"g": F.lit(1), "rank": F.lit("r"), "item": F.lit(2.0), "score": F.lit(3)})
    got = topn.top_n_per_group(df.repartition(5), ["query_id", "leg"], "chunk_id", "s", n, row_group_bytes=2048)
    assert {tuple(x) for x in got.collect()} == brute_top(data, n) and got.count() == len(brute_top(data, n))


def test_top_n_edges(spark):
    df = spark.createDataFrame([("q", "a", 1.0)], "g string, item string, score double")
    assert topn.top_n_per_group(df.limit(0), ["g"], "item", "score", 3).count() == 0
    assert topn.top_n_per_group(df, ["g"], "item", "score", 0).count() == 0
    assert [tuple(r) for r in topn.top_n_per_group(df, ["g"], "item", "score", 3).collect()] == [("q", "a", 1.0, 1)]


def test_top_n_leaves_out_most_row_groups_of_a_hot_group(spark, monkeypatch):
    read = []
    real = topn._read
    monkeypatch.setattr(topn, "_read", lambda groups, n: (read.append(groups.count()), real(groups, n))[1])
    df = spark.range(60000).select(F.lit("hot").alias("q"), F.sha2(F.col("id").cast("string"), 256).alias("c"), F.rand(3).alias("s"))
    assert topn.top_n_per_group(df, ["q"], "c", "s", 5, row_group_bytes=20000).count() == 5
    assert sum(read) <= 12  # of more than 60


# --- token counts ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(20))
def test_unigram_counts_are_those_of_viterbi(seed):
    from tokenizers import Tokenizer, models

    r = random.Random(seed)
    letters = "abcd"
    pieces = list(letters) + sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(60)})
    scores = [-9.0 - k * 0.013 for k in range(4)] + [-r.uniform(3, 12) for _ in pieces[4:]]
    counter = token_budget.Counter(pieces, scores, "unigram")
    model = Tokenizer(models.Unigram([("<unk>", -30.0), *zip(pieces, scores)], 0, False))
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(400)]
    _, cps, bounds = codepoints.flat(pa.array(words))
    assert counter.texts(cps, bounds, {}).tolist() == [len(model.encode(w).ids) for w in words]


def test_trie_holds_its_words_and_no_others():
    r = random.Random(1)
    for _ in range(50):
        words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 25))})
        trie = token_budget.DoubleArray(words)
        for text in ["".join(r.choice("abcéz") for _ in range(12)) for _ in range(20)]:
            cps = np.array([ord(c) for c in text], np.uint32)
            got = {(a, words[w]) for at, word in trie.matches(cps, np.full(12, 12)) for a, w in zip(at.tolist(), word.tolist())}
            assert got == {(a, text[a:b]) for a in range(12) for b in range(a + 1, 13) if text[a:b] in words}


def test_bpe_counts_are_the_tokenizers(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{encoding.tokenizer_dir()}/piece_bpe_32k.model")
    r = random.Random(2)
    texts = ["", " ", "a", "\n\n  x", "ﬁ ½ ㎡", "法条😀", "a" * 3000, "中" * 3000, "\U0001f3fd‍", "x́"]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz     .,''-0123ééñ法律条文") for _ in range(r.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").withColumn("n_tokens", F.lit("clash")).repartition(3)
    got = {x.k: x.n_tokens for x in token_budget.count_tokens(df, ["k"], "t").collect()}
    assert got == {k: len(sp.encode(t)) for k, t in enumerate(texts)} | {len(texts): 0}
    assert token_budget.budget(token_budget.count_tokens(df.limit(0), ["k"], "t"), ["k"]).count() == 0


# --- encoding --------------------------------------------------------------------------------------------------------
def test_ids_of_odd_texts(spark):
    encode = encoding._encoder(f"{encoding.tokenizer_dir()}/byte_bpe_50k.tiktoken", encoding.PATTERN).encode_ordinary
    r = random.Random(9)
    signs = "ab'sdlvrmt  \n\t　 é中文。，١२Ⅷ½́‍\U0001f3fd_-<|endoftext|>͸"
    texts = [None, "", " ", "\n", "  a  ", "<|endoftext|>", "it's 'sab' 'll", " x", "a" * 20000, "。" * 5000, " " * 5000]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(1, 120))) for _ in range(600)]
    df = spark.createDataFrame([(k % 500, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted(((x.doc_id, x.ids) for x in encoding.encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((k % 500, None if t is None else encode(t)) for k, t in enumerate(texts)), key=str)
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    # copies over many partitions, one of which holds a third of all rows
    passage = "承运人应当在十日内书面答复，逾期未处理的视为同意；" * 40
    many = [(k, passage * 2 if k % 3 == 0 else f"{k} " + passage * 2 + f"尾{k}" if k % 3 == 1 else f"单独的一段{k}。") for k in range(600)]
    got = {x.doc_id: x.ids for x in encoding.encode_corpus(spark.createDataFrame(many, "doc_id long, text string").repartition(7), "doc_id", "text").collect()}
    assert got == {k: encode(t) for k, t in many}


def test_shared_passages_are_encoded_once_and_joins_are_repaired(spark, monkeypatch):
    monkeypatch.setattr(encoding, "AVERAGE", 24)
    encode = encoding._encoder(f"{encoding.tokenizer_dir()}/byte_bpe_50k.tiktoken", encoding.PATTERN).encode_ordinary
    passage = "承运人应当在十日内书面答复，逾期未处理的视为同意；" * 3 + "The parcel was lost in Pellow Bay, and nobody answered. " * 3
    texts = [f"{k} " + passage + f"尾{k}" for k in range(200)] + ["aaaa" * 500, "it's the 'll 're" * 40, "  \n " * 90]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["row", "key", "text"])
    (out,) = encoding._cut(iter([part]))
    cut = [encoding._chunks(t, e) for t, e in zip(texts, out.column(3).to_pylist())]
    hashes = [h for own in out.column(4).to_pylist() for h in own]
    assert len(set(hashes)) < 0.3 * len(hashes)
    repaired = 0
    for k, t in enumerate(texts):
        own = cut[k]
        assert "".join(own) == t
        parts = [(np.array(i, np.int32), *x) for i, *x in zip(*encoding._encode_chunks(encode, own))]
        assert encoding._assemble(encode, parts).tolist() == encode(t)
        repaired += sum(len(p[0]) for p in parts) != len(encode(t))
    assert repaired > 0


@pytest.mark.parametrize("average", [2, 5, 40])
def test_ids_of_random_texts_with_many_cuts(average, monkeypatch):
    monkeypatch.setattr(encoding, "AVERAGE", average)
    encode = encoding._encoder(f"{encoding.tokenizer_dir()}/byte_bpe_50k.tiktoken", encoding.PATTERN).encode_ordinary
    r = random.Random(average)
    signs = "ab'sdlvrmt  \n\t　 é中文。，１２Ⅷ½́‍\U0001f3fd_-<|endoftext|>͸"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 300))) for _ in range(400)]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["row", "key", "text"])
    (out,) = encoding._cut(iter([part]))
    cut = [encoding._chunks(t, e) for t, e in zip(texts, out.column(3).to_pylist())]
    for k, t in enumerate(texts):
        own = cut[k]
        parts = [(np.array(i, np.int32), *x) for i, *x in zip(*encoding._encode_chunks(encode, own))]
        assert encoding._assemble(encode, parts).tolist() == encode(t)


# --- look-alikes -----------------------------------------------------------------------------------------------------
def test_same_look(spark):
    v = [("a", "café"), ("b", "café"), ("c", "cafe"), ("d", "ｃａｆé"), ("e", "c​afé"), ("f", "сafé"), ("g", "Café"), ("h", None), ("i", ""), ("j", "​"), ("k", "café"), (None, "café"), ("a", "café"), ("l", "第１条"), ("m", "第1条"), ("n", "第2条"), ("o", "x²"), ("p", "x2"), ("q", "⾦额"), ("r", "金额"), ("s", "ﬁne"), ("t", "fine")]
    df = spark.createDataFrame([("k", i, t, 1, 2, 3) for i, t in v], "kind string, key string, raw string, look int, canonical int, h int")
    got = {(r.key_a, r.key_b) for r in lookalike.same_look_pairs(df).collect()}
    same = ["ak", "b", "d", "e", "f"]  # groups of equal strings that look alike
    want = {tuple(sorted((x, y))) for i, p in enumerate(same) for q in same[i + 1 :] for x in p for y in q}
    assert got == want | {("i", "j"), ("l", "m"), ("q", "r"), ("s", "t")}
    forms = {r.key: r.canonical for r in lookalike.canonical(df.filter("key is not null")).collect()}
    assert len({forms[x] for x in "abdefk"}) == 1 and forms["c"] == "cafe" and forms["h"] is None and forms["o"] == "x²" and forms["p"] == "x2"
    empty = df.limit(0)
    assert lookalike.same_look_pairs(empty).count() == 0 and lookalike.canonical(empty).count() == 0 and lookalike.same_look_as(empty, empty).count() == 0


def test_base_signs_bring_all_codings_together(spark):
    """What the collation or the mapping holds equal has one hash of base signs, else the pair is lost before it is asked."""
    import unicodedata

    table = lookalike.base_table()
    base = lambda t: "".join(table.get(c, c) for c in t)
    for cp in [*range(0x21, 0x3400), *range(0xAC00, 0xD7A4), *range(0xF900, 0xFFF0)]:
        c = chr(cp)
        if unicodedata.category(c) not in ("Cn", "Cs", "Co"):
            assert base(c) == base(unicodedata.normalize("NFC", c)) == base(unicodedata.normalize("NFD", c)), hex(cp)
            assert base(c) == base(lookalike.sign_table().get(c, c)), hex(cp)
    v = [("k", "a", "한국 법률"), ("k", "b", unicodedata.normalize("NFD", "한국 법률")), ("k", "c", "ﾀﾞ"), ("k", "d", "ダ"), ("k", "e", "Å"), ("k", "f", "\u212b"), ("k", "g", "한군 법률")]
    v += [("k", f"l{k}", "重复的名称") for k in range(300)] + [("k", "m", "重复的\u200b名称")]
    got = {(r.key_a, r.key_b) for r in lookalike.same_look_pairs(spark.createDataFrame(v, "kind string, key string, raw string")).collect()}
    assert got == {("a", "b"), ("c", "d"), ("e", "f")} | {(f"l{k}", "m") for k in range(300)}


def test_hot_keys_are_spread(spark, monkeypatch):
    from corvane.llm import skew

    monkeypatch.setattr(skew, "HOT", 50)
    big = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(600)] + [(None, 7)], "key long, v long")
    small = big.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key is not null").withColumn("name", F.concat(F.lit("k"), F.col("key")))
    got = skew.hot_join(big, small, ["key"], "n", F.col("v"))
    assert sorted((r.key, r.v, r.name) for r in got.collect()) == sorted((k, v, f"k{k}") for k, v in ((1 if k % 3 else k, k) for k in range(600)))
    assert got.withColumn("part", F.spark_partition_id()).columns == ["key", "v", "n", "name", "part"]
    assert skew.hot_join(big.limit(0), small, ["key"], "n", F.col("v")).count() == 0


# --- overlap ---------------------------------------------------------------------------------------------------------
def test_cosine_join_is_complete(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(12)]

    def near(s):
        s = list(s)
        for _ in range(r.randrange(8)):
            s[r.randrange(len(s))] = r.choice("abcdefgh1")
        return "".join(s)

    a = [(f"l{k}", r.choice("xy"), near(r.choice(base))) for k in range(80)] + [("n1", None, "abc"), ("n2", "x", None), ("n3", "x", "!?"), ("n4", "x", "")]
    b = [(f"r{k}", r.choice("xyz"), near(r.choice(base))) for k in range(120)] + [("r0b", "x", "法" * 2000)]
    schema = "d string, block string, text string"
    got = {(x.left_d, x.right_d) for x in overlap.cosine_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.5).collect()}
    table = {x.d: (x.block, x.terms) for x in overlap.prepared(spark.createDataFrame([(0, *x) for x in a + b], "side int, " + schema).filter("d is not null and block is not null and text is not null")).collect()}
    n, df = len(table), {}
    for _, t in table.values():
        for x in t:
            df[x] = df.get(x, 0) + 1
    w = {x: np.log1p(n / c) for x, c in df.items()}
    norm = lambda t: np.sqrt(sum(w[x] ** 2 for x in t))
    want = set()
    for i, *_ in a:
        for j, *_ in b:
            if i in table and j in table and table[i][0] == table[j][0]:
                if sum(w[x] ** 2 for x in set(table[i][1]) & set(table[j][1])) / norm(table[i][1]) / norm(table[j][1]) >= 0.5:
                    want.add((i, j))
    assert got == want and len(want) > 50
    nothing = spark.createDataFrame([], schema)
    assert overlap.cosine_join(nothing, nothing).count() == 0


def test_other_facts_are_other_questions(spark):
    ev = spark.createDataFrame([("dev", "e1", ["拖欠工资53400元共41个月怎么办？", None], ["c1", "c2"]), ("dev", "e2", None, None), ("dev", "e3", ["空集的问题怎么问"], [])], "split string, eval_id string, forms array<string>, required array<string>")
    tr = spark.createDataFrame([("t1", "请问，拖欠工资５３４００元共41个月怎么办", ["c2", "c1", "c1"]), ("t2", "拖欠工资53400元共42个月怎么办？", ["c1", "c2"]), ("t3", "拖欠工资53400元共41个月怎么办？", ["c1"]), ("t4", "空集的问题怎么问", None), ("t5", None, ["c1", "c2"])], "train_id string, text string, required array<string>")
    assert {(r.eval_id, r.train_id) for r in overlap.same_questions(ev, tr).collect()} == {("e1", "t1"), ("e3", "t4")}


# --- splitting -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(40))
def test_pieces_hold_limit_and_overlap(seed):
    r = random.Random(seed)
    parts = ["# 标题\n", "## Part\n", "第一章 总则\n", "（一）甲；", "（二）乙。", "1. one\n", "- item\n", "句子一。", "word word, word. ", "\n\n", "x" * r.randrange(1, 900), "é" * 40, "\U0001f469‍⚖️", "\r\n", "<p>a</p>", "　　段落，段落，"]
    text = "".join(r.choice(parts) for _ in range(r.randrange(1, 120)))
    limit = r.choice([20, 60, 300])
    over = r.choice([0, 5, 19])
    spans = splitting.split(text, limit, over)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit or not text for a, b in spans)
    assert text[spans[0][0] : spans[0][1]] + "".join(text[a + over : b] for a, b in spans[1:]) == text
    assert all(y[0] == x[1] - over for x, y in zip(spans, spans[1:]))


def test_natural_boundaries():
    text = "# A\n" + "甲" * 40 + "。\n# B\n" + "乙" * 40 + "。\n" + "丙" * 40 + "。\n"
    spans = splitting.split(text, 100, 0)
    assert text[spans[1][0] :].startswith("# B") and len(spans) == 2
    assert splitting.split("", 10, 2) == [(0, 0)] and splitting.split("a" * 10, 10, 2) == [(0, 10)]
    with pytest.raises(ValueError):
        splitting.split("a", 5, 5)


def test_headings_go_with_what_follows_and_loose_ends_stay_apart():
    text = "第一章 甲\n" + "甲" * 90 + "。\n第二章 乙\n" + ("乙" * 40 + "。\n") * 5 + "第三章 丙\n" + ("丙" * 60 + "。\n") * 4
    own = [text[a:b] for a, b in splitting.split(text, 200, 0)]
    assert "".join(own) == text and [p.split("\n")[0] for p in own if p.startswith("第")] == ["第一章 甲", "第二章 乙", "第三章 丙"]
    assert not any("乙。" in p and "第三章" in p for p in own)
    r = random.Random(5)
    for _ in range(200):
        lines = []
        for k in range(r.randint(2, 9)):
            lines += r.choice([[f"# 标题{k}"], [f"第{k}章 总则"], [f"## Part {k}"], [f"# A{k}", f"## B{k}"]])
            lines += ["".join(r.choice("甲乙丙，。") for _ in range(r.randint(1, 120))) + "。" for _ in range(r.randint(1, 6))]
        text = "\n".join(lines)
        pieces = [text[a:b] for a, b in splitting.split(text, 150, 0)]
        assert "".join(pieces) == text and all(len(p) <= 150 for p in pieces)
        for p in pieces:
            last = p.rstrip("\n").rsplit("\n", 1)[-1]
            assert not (last.startswith(("#", "第")) and not last.endswith("。")), (last, pieces)


def test_split_table_edges(spark):
    df = spark.createDataFrame([("a", "x" * 50), ("a", "x" * 50), ("b", None), ("c", ""), ("d", "y" * 10), (None, "z" * 11)], "k string, t string").withColumn("piece", F.lit(1)).withColumn("text", F.lit("clash"))
    got = splitting.split_oversized(df, "unit", "k", "t", 10, 2)
    assert {r.item_key for r in got.collect()} == {"a", None} and splitting.split_oversized(df.limit(0), "unit", "k", "t", 10, 2).count() == 0


# --- leaks -----------------------------------------------------------------------------------------------------------
def test_myers_is_the_edit_distance():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    r = random.Random(8)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(n))) for n in (90, 120))
        assert leakage.myers(p, t)[0] == plain(p, t)


def test_leaks(spark):
    r = random.Random(3)
    zh = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(140))
    other = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(140))
    en = " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(2, 9))) for _ in range(80))
    noise = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    changed = list(zh)
    for k in (11, 40, 77, 120):
        changed[k] = "改"
    docs = [
        (1, noise(300) + zh + noise(300)), (2, noise(50) + zh[:95] + noise(80)), (3, noise(50) + zh[:45] + noise(80)), (4, "".join(changed)),
        (5, zh[:50] + noise(200) + zh[80:]), (6, "\n".join(zh[k : k + 7] + "，" for k in range(0, 140, 7))), (7, en.upper().replace(" ", "  ")), (8, None), (9, ""),
        (10, noise(140)), (11, noise(200_000) + zh), (1, noise(300) + zh + noise(300)), (None, zh), (12, en[: len(en) // 4]),
    ]
    items = [(1, zh), (2, en), (3, other), (4, None), (5, ""), (6, "x"), (1, zh), (None, zh)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("share", F.lit(0)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = [tuple(x) for x in leakage.find_leaks(d, i, "doc_id", "text", "item_id", "text").collect()]
    assert sorted(got) == [(1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (1, 11), (2, 7)]
    assert leakage.find_leaks(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.find_leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_groups_of_items_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    text = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(100)) for _ in range(6)]
    d = spark.createDataFrame([(k, "前" + t + "后") for k, t in enumerate(text)], "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(text)), "item_id long, text string")
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 250)
    assert sorted(tuple(x) for x in leakage.find_leaks(d, i, "doc_id", "text", "item_id", "text").collect()) == [(k, k) for k in range(6)]


@pytest.mark.parametrize("size", [140, 200, 1000, 4000])
def test_recall_does_not_depend_on_the_number_of_edits(size):
    """Items held to 60 % with edits in up to the stated tenth of the signs, spread evenly or at random, in one part or two."""
    r = random.Random(size)
    sign = lambda: chr(0x4E00 + r.randrange(3000))

    def edited(part, edits, even):
        places = {int((k + 0.5) * len(part) / edits) for k in range(edits)} if even else set(r.sample(range(len(part)), edits))
        return "".join({0: "", 1: sign(), 2: c + sign()}[r.randrange(3)] if k in places else c for k, c in enumerate(part))

    lost = tried = 0
    for _ in range(12):
        item = "".join(sign() for _ in range(size))
        index = leakage.Index([(1, item)])
        for cuts in (((0.2, 0.8),), ((0.0, 0.3), (0.65, 0.95))):
            for even in (True, False):
                parts = [item[int(a * size) : int(b * size)] for a, b in cuts]
                doc = "".join("".join(sign() for _ in range(200)) + edited(p, len(p) // 10, even) for p in parts) + "".join(sign() for _ in range(200))
                batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([doc])], ["d", "t"])
                tried, lost = tried + 1, lost + (not leakage._leaks_of(batch, index))
    assert lost <= 0.1 * tried


# --- reading level ---------------------------------------------------------------------------------------------------
def test_reading_edges(spark):
    easy, hard = "小猫爱吃鱼。小狗爱跑步。", "构成要件该当性竞合，抗辩权之援引即告阻断，庶几无违先诉抗辩之规范目的。"
    docs = [(k, (easy if k % 2 else hard) * (2 + k % 5)) for k in range(60)] + [(60, None), (61, ""), (62, " \n"), (63, "123 。！"), (64, easy * 20000), (65, "The cat sat. " * 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("script", F.lit("clash")).withColumn("level", F.lit(9))
    labels = spark.createDataFrame([(k, "r", 1 if k % 2 else 4) for k in range(40)] + [(1, "s", None), (3, "s", 7), (999, "s", 2)], "doc_id long, rater string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(d, labels, "doc_id", "text", "doc_id", "reading_level").collect()}
    assert set(got) == {*range(60), 64, 65} and all(got[k] == (1 if k % 2 else 4) for k in range(60))
    assert reading.reading_levels(d.limit(0), labels, "doc_id", "text", "doc_id", "reading_level").count() == 0
    assert reading.reading_levels(d, labels.limit(0), "doc_id", "text", "doc_id", "reading_level").count() == 0


def test_document_frequencies():
    texts = ["ab ab cd", None, "", "法律法律", "ab 法律"]
    out = pa.Table.from_batches(list(reading._frequencies(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])])))).to_pydict()
    got = dict(zip(out["word"], out["n"]))
    key = lambda s: int(reading.words(np.array([ord(c) for c in s], np.uint32))[0][0])
    assert got[key("ab")] == 2 and got[key("cd")] == 1 and got[key("法律")] == 2 and got[key("律法")] == 1 and got[-1] == 2 and got[-2] == 2
