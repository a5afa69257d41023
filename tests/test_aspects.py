"""Aspect votes count every aspect of the schema."""

import pytest

from voxgrid.functions import lexicon as L
from voxgrid.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """Writes made-up tables; gives their folder."""

    def write(**rows):
        for name, (values, schema) in rows.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_aspect_sentiment_votes_for_every_aspect(spark, tables):
    schema = [(f"d{i // 6}", i % 6, f"aspect{i}", [f"kw{i}x"]) for i in range(18)]
    texts = [f"kw{i}x{w}" for i in range(18) for w in ("失望", "流畅")] + ["kw17x失望，kw17x流畅", "kw16x", None, ""]
    d = tables(coded_items=(list(enumerate(texts)), "item_seq long, text string"), dim_schema=(schema, "domain_id string, dim_ord int, dim_id string, keywords array<string>"))
    want = {(f"aspect{i}", L.scan_text(w)[1], 1) for i in range(18) for w in ("失望", "流畅")}
    got = [tuple(r) for r in catalog.QUERIES["aspect_sentiment"](spark, d).collect()]
    assert len(got) == 36 and set(got) == want
