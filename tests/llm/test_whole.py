"""Operators that once did a part of their job, against the whole of it."""

import random
import unicodedata

import numpy as np

from corvane.llm import leakage, lookalike


# --- leaks -----------------------------------------------------------------------------------------------------------
def leaked(item, doc):
    index = leakage.Index([(1, item)])
    _, _, pos, a = index.hits(np.frombuffer(doc.encode("utf-32-le"), np.uint32), np.array([0, len(doc)]))
    return leakage.held(item, index.size[0], doc, list(zip(pos.tolist(), a.tolist())))


def test_parts_count_to_their_ends():
    r = random.Random(2)
    noise = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    item = noise(480)
    assert 0.5 <= leaked(item, noise(90) + item[10:250] + noise(90)) < 0.51
    assert 0.57 <= leaked(item, noise(90) + item[6:134] + noise(200) + item[206:354] + noise(90)) < 0.59
    words = item[:205] + "改" * 5 + item[210:225] + "动" * 5 + item[230:240]  # a changed word in each of the last two pieces
    assert leaked(item, noise(90) + words + noise(90)) >= 0.5
    spoilt = list(item[10:140] + noise(300) + item[250:364])  # two parts: three pieces are cut by the ends, six are changed
    for k in (45, 65, 85, 105, 440 + 35, 440 + 55):
        spoilt[k] = "改"
    assert leaked(item, "".join(spoilt)) >= 0.5
    assert leaked(item, noise(90) + item[10:240] + noise(90)) < 0.5


def test_reach_ends_where_the_copy_ends():
    assert leakage.reach("abcdefgh", "abcdefgh") == (8, 8) and leakage.reach("abcdefgh", "abcdxyzw") == (4, 4)
    assert leakage.reach("abcdefghijkl", "abcXefghijkl") == (12, 12) and leakage.reach("abcdefghijkl", "abcefghijkl") == (12, 11)
    assert leakage.reach("abc", "") == (0, 0) and leakage.reach("", "abc") == (0, 0) and leakage.reach("abcd", "xyzw") == (0, 0)


# --- look-alikes -----------------------------------------------------------------------------------------------------
def test_a_sign_has_the_base_of_its_composed_form():
    table = lookalike.base_table()
    base = lambda text: "".join(table.get(c, c) for c in text)
    assert not [hex(ord(c)) for c in table if base(c) != base(unicodedata.normalize("NFC", c))]
    assert not [hex(ord(c)) for c, to in table.items() if base(to) != to]


def test_glyphs_coded_otherwise_meet(spark):
    pairs = [("ｶﾞ", "ガ"), ("Å", "Å"), ("ά", "ά"), ("ﾊﾟ", "パ")]
    rows = [("k", f"{side}{k}", f"x{pair[side]}y") for k, pair in enumerate(pairs) for side in (0, 1)]
    got = lookalike.same_look_pairs(spark.createDataFrame(rows, "kind string, key string, raw string")).collect()
    assert {(r.key_a, r.key_b) for r in got} == {(f"0{k}", f"1{k}") for k in range(len(pairs))}
