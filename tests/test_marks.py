"""Repeated marks are collapsed in every row."""

import itertools
import re

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


MARKS = "!?！？。，,.~～…"


def plain(t):
    """Runs of three and more of one mark, read character by character, as one."""
    return "".join(m if m in MARKS and n >= 3 else m * n for m, n in ((m, len(list(g))) for m, g in itertools.groupby(t)))


def test_marks_collapse_in_all_rows(spark, tables):
    texts = [f"好{m * n}的" for m in MARKS for n in (1, 2, 3, 7)] + ["好?!?的", "等...吧~~~好！！！", "......", None, "普通的话"]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = tables(posts=(rows, "post_seq long, content string"), comments=(rows, "comment_seq long, text string"))
    got = {r.comment_seq: r.text for r in catalog.QUERIES["punct_collapse"](spark, d).collect()}
    assert got == {i: plain(t) for i, t in rows if t is not None}
    got = {r.post_seq: r.text for r in catalog.QUERIES["clean_text"](spark, d).collect()}
    assert got == {i: "" if re.fullmatch(r"[\W_]*", t) else plain(t) for i, t in rows if t is not None}
