"""Token ids against both public libraries, and the perfect hash against its definition."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxgrid.llm import tokenizer as T

P = pytest.importorskip("public_tokenizers")
SAMPLES = ["", " ", "\n\n  x", "Hello, world! I'll say it's 100% fine.", "更新到新版本以后充电头变得精致了？👩‍💻", "<|endoftext|> is text here", "a" * 3000,
           "http://a.test/x?y=1&z=%20", "é́ ﬁ Ǆ \x00\x7f", "哈哈" * 2000, "\t\r\n 　  ", "'s 'T don't"]


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(*T._built(T.vocabulary_path()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(T.read_ranks(T.vocabulary_path())), special_tokens={})
    return lambda s: (enc.encode_ordinary(s), t.encode(s, add_special_tokens=False).ids)


def ids(encoder, texts):
    offsets, got = encoder.encode(texts)
    return [got[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_samples(encoder, reference):
    for s, got in zip(SAMPLES, ids(encoder, SAMPLES), strict=True):
        a, b = reference(s)
        assert got == a == b


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, s):
    assert ids(encoder, [s])[0] == reference(s)[0]


def test_memory_starts_over(encoder, reference, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 5)
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "更新", "βeta", "x9"]) + str(rng.random()) for _ in range(6)) for _ in range(20)]
    assert ids(encoder, texts) == [reference(t)[0] for t in texts]


def test_perfect_hash():
    keys = [str(i).encode() for i in range(2000)]
    h = T.PerfectHash(keys)
    assert sorted(h.slot_of.tolist()) == list(range(2000))
    import numpy as np
    import xxhash

    assert h.slots(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)).tolist() == h.slot_of.tolist()


def test_frame(spark, reference):
    rows = [(1, "好的 ok", "a"), (2, None, "b"), (3, "", None), (1, "好的 ok", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    got = T.with_ids(df, "text").collect()
    assert sorted((r.doc_id, r.x, tuple(r.ids)) for r in got if r.x) == sorted([(1, "a", tuple(reference("好的 ok")[0]))] * 2 + [(2, "b", ())])
    assert T.with_ids(df.limit(0), "text").count() == 0
