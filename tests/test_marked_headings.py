"""Queries over marked headings, held against their SQL where lines of a document look like headings, or like a table's rows."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FILL = ["plain words stand here."] * 15
TEXTS = [
    "20.118.157.107 Betz +1 (726) 555-7857 das 4325404893167225 mit. Enheitungkeit.oark",
    "\n".join([*FILL, "and so on.", "68.137.175.196 Nting 12 of 40 went on", *FILL]),
    "One sentence ends.\nWHY IS IT SO?\n-----\n3 ALL IN CAPITALS\n1.2 Ends in a colon:\n1.2 Does not " + "x" * 90,
    "It begins.\n---FIELD RULES---\n12 45 88\n2.1.3 Parts\n2.1 Others in twelve words or more of them as one may well see\n# 2.2 Marked\nend.",
    "",
    None,
]


@pytest.fixture(scope="module")
def lookalikes(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lookalikes")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("query", ["heading_candidates", "section_tree", "chunk_section", "chunk_all_union", "section_at_asof", "strategy_stats"])
def test_marked_headings_against_sql(spark, lookalikes, query):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{lookalikes}/documents.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()[query])
    names, rows = [c[0] for c in want.description], want.fetchall()
    got = entry.queries()[query](spark, lookalikes)
    assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(rows)
