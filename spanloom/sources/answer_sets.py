"""Saved questions with marked answers, as JSON files tied to a document by its fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P

#: The format that is written; any answer set of this version is read, whoever wrote it.
FORMAT, ANY_FORMAT, VERSION = "spanloom-answer-set", "-answer-set", 1
SCHEMA = (
    "format string, version int, document struct<name:string,fingerprint:string>, "
    "items array<struct<question:string,answer:struct<start:int,end:int,text:string>>>"
)


def to_json(items: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, value: a file's content for each document's items (doc_id, question, ans_start, ans_end)."""
    cut = F.substring("text", F.col("ans_start") + 1, F.col("ans_end") - F.col("ans_start"))
    one = F.struct("question", F.struct(F.col("ans_start").alias("start"), F.col("ans_end").alias("end"), cut.alias("text")).alias("answer"))
    rows = items.join(docs.select("doc_id", "name", "text", "fingerprint"), "doc_id").groupBy("doc_id", "name", "fingerprint").agg(F.array_sort(F.collect_list(one)).alias("items"))
    content = F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.struct("name", "fingerprint").alias("document"), "items")
    return rows.select("doc_id", F.to_json(content).alias("value"))


def write(items: DataFrame, docs: DataFrame, path: str) -> None:
    to_json(items, docs).select("value").write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", False).json(path)


def load(saved: DataFrame, docs: DataFrame, size: int = P.SIZE) -> DataFrame:
    """Items of saved sets whose document is the one at hand: doc_id, question, ans_start, ans_end, skipped.

    An item whose answer is longer than half a chunk is marked as skipped.
    """
    good = saved.where(F.col("format").endswith(ANY_FORMAT) & (F.col("version") == VERSION))
    rows = good.select(F.col("document.fingerprint").alias("fingerprint"), F.explode("items").alias("i"))
    rows = rows.join(docs.select("doc_id", "fingerprint"), "fingerprint")
    start, end = F.col("i.answer.start"), F.col("i.answer.end")
    return rows.select("doc_id", "i.question", start.alias("ans_start"), end.alias("ans_end"), (end - start > size // 2).alias("skipped"))
