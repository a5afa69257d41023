"""Phrases have up to five tokens."""

import pytest

from voxgrid.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """Writes made-up tables; gives their folder."""

    def write(**rows):
        for name, (values, schema) in rows.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_phrases_of_four_and_five_tokens(spark, tables):
    name = "nova quill ember ridge"
    rows = [(i, t, "neutral", 0.0, False) for i, t in enumerate([f"{name} max", f"{name} max", f"{name} mini", *(f"other{i} words{i}" for i in range(40))])]
    d = tables(coded_items=(rows, "item_seq long, text string, sentiment string, sentiment_score double, ad_flag boolean"))
    got = {r.phrase: r.n for r in catalog.QUERIES["ngram_phrases"](spark, d).collect()}
    words = f"{name} max".split()
    spans = {" ".join(words[a:b]) for a in range(5) for b in range(a + 2, 6)}
    assert got == {p: 2 if "max" in p else 3 for p in spans}
    kept = {r.phrase for r in catalog.QUERIES["phrases_suppressed"](spark, d).collect()}
    assert kept == {name, f"{name} max"}


def test_topics_count_long_phrases(spark, tables):
    rows = [(i, t, "positive", 0.5, False) for i, t in enumerate(["nova quill ember ridge 流畅"] * 2 + [f"other{i} words{i}" for i in range(40)])]
    d = tables(coded_items=(rows, "item_seq long, text string, sentiment string, sentiment_score double, ad_flag boolean"))
    assert [tuple(r) for r in catalog.QUERIES["phrase_topics"](spark, d).collect()] == [("性能", "positive", 4, 8)]
