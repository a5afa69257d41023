"""Rare characters in clean_text: white space, mentions and noise are what its SQL takes for them."""

import pytest

import __spark_entry__
from voxgrid.plans import catalog

CASES = {
    "①": "①",  # a digit is no noise
    "²！": "²！",
    "👨‍👩": "",  # a joiner is
    "Ⓐ": "",
    "‿": "",
    "a\x1cb\x1f": "a b",
    "a\x0bb": "a\x0bb",
    "@小明② 好": "好",
    "@小明Ⓐ 好": "Ⓐ 好",
    "@小‍明 好": "‍明 好",
    "见https://a.b/x\x0b尾 好": "见 好",
    "\U00031350": "\U00031350",  # a Han character of Unicode 15
    "@小\U00031350 好": "好",
    "🫠": "",
    "️❤️": "️❤️",
    "😀 ， 　": "",
    "\n": "",
    "": "",
}


@pytest.fixture
def cleaned(spark, tmp_path):
    rows = list(enumerate([*CASES, None, "好???的", "......"]))
    spark.createDataFrame(rows, "post_seq long, content string").coalesce(1).write.parquet(f"{tmp_path}/posts.parquet")
    got = {r.post_seq: r.text for r in catalog.QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    return tmp_path, dict(rows), got


def test_rare_characters(cleaned):
    _, rows, got = cleaned
    assert {rows[i]: t for i, t in got.items()} == CASES | {"好???的": "好?的", "......": ""}


def test_equal_to_sql_where_the_sql_has_rows(cleaned):
    d, rows, got = cleaned
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view posts as select * from '{d}/posts.parquet/*.parquet'")
    sql = dict(con.execute(__spark_entry__.oracle_sql()["clean_text"]).fetchall())
    assert sql == {i: t for i, t in got.items() if rows[i] in CASES}
