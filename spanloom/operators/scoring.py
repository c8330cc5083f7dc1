"""Scoring strategies against marked answers, and describing their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions.text import too_small
from .compare import BY


def has_answer(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hits of questions with a marked answer (question_id, doc_id, ans_start, ans_end)."""
    held = S.contains_answer(F.col("start"), F.col("end"), F.col("ans_start"), F.col("ans_end"))
    return hits.join(items.select(*BY, "ans_start", "ans_end"), BY).withColumn("has_answer", held)


def answer_rank(hits: DataFrame, items: DataFrame) -> DataFrame:
    """The first rank that holds the answer, for every item and strategy; null where none does."""
    found = has_answer(hits, items).where("has_answer").groupBy(*BY, "strategy").agg(F.min("rank").alias("answer_rank"))
    every = items.select(*BY).distinct().withColumn("strategy", F.explode(F.array(*map(F.lit, P.STRATEGIES))))
    return every.join(found, [*BY, "strategy"], "left").select(*BY, "strategy", "answer_rank")


def answer_verdict(rank: Column, k: int = P.TOP_K) -> Column:
    return F.coalesce(F.concat(F.lit("Answer found at rank "), rank.cast("string")), F.lit(f"Not in top {k}"))


def evaluate(ranks: DataFrame) -> DataFrame:
    """strategy, found, total, avg_rank (of those found), mrr (0 for a miss)."""
    one = 1 / F.col("answer_rank")
    return ranks.groupBy("strategy").agg(
        F.count("answer_rank").alias("found"),
        F.count("*").alias("total"),
        F.bround(F.avg("answer_rank"), 2).alias("avg_rank"),
        F.bround(F.sum(F.coalesce(one, F.lit(0.0))) / F.count("*"), 3).alias("mrr"),
    )


def strategy_stats(docs: DataFrame, chunks: DataFrame, tokens: Column, max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """For each document and strategy: how many chunks, how long, how many are cut off by the model."""
    n = F.col("end") - F.col("start")
    own = chunks.withColumn("n", n).withColumn("cut", tokens > max_tokens)
    own = own.groupBy("doc_id", "strategy").agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if("cut").alias("truncated"))
    every = docs.select("doc_id").withColumn("strategy", F.explode(F.array(*map(F.lit, P.STRATEGIES))))
    out = every.join(own, ["doc_id", "strategy"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id",
        "strategy",
        zero("count").alias("count"),
        zero(F.bround("mean", 0).cast("long")).alias("avg_chars"),
        zero("least").alias("min_chars"),
        zero("most").alias("max_chars"),
        zero("truncated").alias("truncated"),
        too_small(F.col("mean"), F.col("least")).alias("too_small"),
    )


def usable_items(items: DataFrame, size: int = P.SIZE) -> DataFrame:
    """Saved items whose answer is short enough for some chunk of this size to hold it."""
    return items.where(F.col("ans_end") - F.col("ans_start") <= size // 2)


def check_item(start: Column, end: Column, length: Column) -> Column:
    """Whether a marked span lies in its document."""
    return (start >= 0) & (end > start) & (end <= length)
