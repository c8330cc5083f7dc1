"""Cases where a query used to do less than the whole job, against brute force."""

import random

import pytest

import __spark_entry__ as entry

ITEMS = 1300


@pytest.fixture(scope="module")
def many_items(spark, tmp_path_factory):
    """A folder of documents that hold more benchmark passages than fit into one block."""
    rng, d = random.Random(2), tmp_path_factory.mktemp("items")
    items = [(k, f"passage {k} says {rng.randint(0, 10**9)} dry logs") for k in range(ITEMS)]
    docs = [(k, " ".join(t for i, t in items if i % 60 == k) if k < 60 else None) for k in range(61)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*items, (ITEMS, None)], "item_id long, text string").repartition(3).write.parquet(f"{d}/benchmark.parquet")
    return str(d), items, docs


@pytest.mark.parametrize("query", ["question_spans", "topk_fixed"])
def test_no_benchmark_item_is_lost(spark, many_items, query):
    d, items, docs = many_items
    got = {(r.question_id, r.doc_id) for r in entry.queries()[query](spark, d).select("question_id", "doc_id").collect()}
    assert got == {(i, k) for i, t in items for k, whole in docs if whole and t in whole}
    assert len(got) == ITEMS
