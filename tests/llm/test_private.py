"""Private data: held-out accuracy, Viterbi against all paths, and masking of whole texts."""

import itertools

import numpy as np
import pytest

from voxgrid.llm import labelled, private


@pytest.fixture(scope="module")
def finder():
    return private.Finder(private.trained())


def test_held_out():
    """Frames that training never saw, filled with names, numbers and streets that it never saw either."""
    field = private.trained()
    tokens, gold = private.labelled_tokens(labelled.rows(20, seed=901, frames=labelled.HELD_OUT))
    got = field.decode(tokens)
    assert (got == gold)[gold > 0].mean() > 0.85
    assert (got[gold == 0] > 0).mean() < 0.015
    assert not set(labelled.HELD_OUT) & set(labelled.FRAMES)


def test_decoding_against_all_paths():
    rng = np.random.default_rng(3)
    field = private.Field()
    field.weight[:] = rng.normal(size=field.weight.shape)
    field.move[:] = rng.normal(size=field.move.shape)
    tokens = private.Tokens(["找李", "a1b", "", "好"])
    emit, got = field.scores(tokens), field.decode(tokens)
    move = field.move + field.banned
    for c in range(tokens.n):
        e = emit[tokens.clause == c]
        paths = itertools.product(range(len(private.LABELS)), repeat=len(e))
        score = lambda p: field.first[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        if len(e):
            assert max(paths, key=score) == tuple(got[tokens.clause == c].tolist())


CASES = [
    ("联系章澄舟取件，电话138 3981 9114，随时打。", {"person_name", "phone"}),
    ("come by 12 Wexmoor Road after six", {"address"}),
    ("q05926108 @ inbox . example . org 这个号能收到", {"email"}),
    ("ｃａｓｉｍｉｒ０１４＠ｌｅｔｔｅｒｓ．ｅｘａｍｐｌｅ．ｃｏｍ", {"email"}),
    ("身份证619942199201110317已实名", {"id_number"}),
    ("客服热线400-123-4567打不通", set()),
    ("订单号918753790922114500还没发货，型号里的90075962503X是批次", set()),
    ("hotline 1-800-430-6832 is always busy. firmware 5.19.62 fixed it.", set()),
]


def test_cases_and_masks(finder, spark):
    for text, kinds in CASES:
        assert {private.KINDS[t] for _, _, t in finder.spans([text])[0]} == kinds, text
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(90, None, "x"), (91, "", "x"), (92, "很好，" * 40000 + "电话138 3981 9114", "x"), (0, CASES[0][0], "x")]
    df = spark.createDataFrame(rows, "id long, text string, kinds_of string")
    got = {r.id: r for r in private.with_private(df, "text").collect()}
    assert got[0].masked == "联系[PERSON_NAME]取件，电话[PHONE]，随时打。" and got[90].masked is None and got[91].masked == ""
    assert got[92].masked == "很好，" * 40000 + "电话[PHONE]" and got[5].masked == CASES[5][0]
    assert private.with_private(df.limit(0), "text").count() == 0


def test_batches_agree(finder, monkeypatch):
    texts = [t for t, _ in CASES]
    want = finder.spans(texts)
    monkeypatch.setattr(private, "KEPT", 3)
    assert private.Finder(private.trained()).spans(texts) == want


def test_batches_beyond_the_cache_lose_nothing(finder, monkeypatch):
    texts = [t for t, _ in CASES]
    want = finder.spans(texts)
    assert any(want)
    monkeypatch.setattr(private, "KEPT", 3)
    later = private.Finder(private.trained())
    later.spans(["很好。", "不错。"])  # a worker that has seen a batch before
    assert later.spans(texts) == want and later.spans(texts) == want
    assert len(later.kept) <= 3
