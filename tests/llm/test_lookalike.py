"""Consistent forms against unicodedata and hand-picked pairs; pairs against comparing all rows."""

import itertools
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxgrid.llm.lookalike import fold_array, pairs_of

SAME = [("Ｇ７（好）", "G7(好)"), ("café", "café"), ("a b　c", "a b c"), ("再​见﻿­", "再见"), ("⽤心", "用心"), ("Pаy", "Pay"),
        ("한", "한"), ("ΡΝ3", "PN3"), ("ﾊﾟ", "パ"), ("ẹ́", "ẹ́"), ("ё", "ë"), ("", "‍")]
APART = [("a", "A"), ("e", "é"), ("x2", "x²"), ("3", "③"), ("体", "體"), ("a  b", "a b"), ("👩‍💻", "👩💻"), ("α", "a")]


def one(s):
    return fold_array(pa.array([s])).to_pylist()[0]


def test_pairs_by_hand():
    for a, b in SAME:
        assert one(a) == one(b), (a, b)
    for a, b in APART:
        assert one(a) != one(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("aeọ̧́̈é한ㅎẬ ‍👩💻하ﬁ"), st.characters(exclude_categories=["Cs"])), max_size=12)), max_size=8))
def test_forms(rows):
    """Forms don't depend on the batch, on the encoding of canonically equal texts, and don't change again."""
    got = fold_array(pa.array(rows, pa.string())).to_pylist()
    for s, f in zip(rows, got, strict=True):
        if s is None:
            assert f is None
            continue
        assert one(s) == f == one(f)
        assert one(unicodedata.normalize("NFD", s)) == f == one(unicodedata.normalize("NFC", s))


def test_pairs_against_all(spark):
    texts = [x for p in SAME + APART for x in p] + ["好的"] * 30 + ["好​的"] * 3 + ["好的⁠"] + [None, None, "长" * 100000, "长" * 100000 + "​"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "k long, t string, row_a int")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and one(a) == one(b)}
    got = [(r.row_a, r.row_b) for r in pairs_of(df, "k", "t", "x").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs_of(df.limit(0), "k", "t", "x").count() == 0


def test_nulls_in_a_frame(spark):
    from voxgrid.llm.lookalike import with_form

    df = spark.createDataFrame([(1, None), (2, "Ａ"), (3, "")], "k int, t string")
    assert sorted((r.k, r.form) for r in with_form(df, "t").collect()) == [(1, None), (2, "A"), (3, "")]
    assert with_form(df.limit(0), "t").count() == 0


def test_classes(spark):
    """Classes agree with the pairs: two rows of a class with different texts are a pair, and no others are."""
    from voxgrid.llm.lookalike import classes_of, pairs_of

    texts = ["Ａ款 很好", "A款 很好", "A款\u3000很好", "A款 很好", "B款", None, "", "", "Ｂ款"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, t string, rows string")
    got = {r.row_id: (r.class_id, r.rows, r.variants) for r in classes_of(df, "id", "t", "s").collect()}
    assert got == {0: (0, 4, 3), 1: (0, 4, 3), 2: (0, 4, 3), 3: (0, 4, 3), 4: (4, 2, 2), 8: (4, 2, 2), 6: (6, 2, 1), 7: (6, 2, 1)}
    pairs = {(r.row_a, r.row_b) for r in pairs_of(df, "id", "t", "s").collect()}
    assert pairs == {(a, b) for a in got for b in got if a < b and got[a][0] == got[b][0] and texts[a] != texts[b]}
    assert classes_of(df.limit(0), "id", "t", "s").count() == 0
