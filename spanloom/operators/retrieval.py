"""Retrieval: score every chunk of a question's document, and keep the best of each strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .embedding import term_counts

CHUNK = ["doc_id", "strategy", "chunk_index"]


def ask(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of each question's document, with its score.

    questions: question_id, doc_id, question. Only documents that are asked about
    are counted. Chunks that share no word with the question score 0, and rank.
    """
    wanted = chunks.join(questions.select("doc_id").distinct(), "doc_id", "left_semi")
    theirs = term_counts(wanted, CHUNK)
    norms = theirs.groupBy(*CHUNK).agg(F.sum(F.col("tf") * F.col("tf")).alias("norm"))
    own = term_counts(questions, ["question_id", "doc_id"], "question").withColumnRenamed("tf", "q")
    length = own.groupBy("question_id", "doc_id").agg(F.sum(F.col("q") * F.col("q")).alias("length"))
    dots = own.join(theirs, ["doc_id", "bucket"]).groupBy("question_id", *CHUNK).agg(F.sum(F.col("q") * F.col("tf")).alias("dot"))
    pairs = questions.select("question_id", "doc_id").join(wanted.select(*CHUNK, "start", "end"), "doc_id")
    out = pairs.join(dots, ["question_id", *CHUNK], "left").join(norms, CHUNK, "left").join(length, ["question_id", "doc_id"], "left")
    score = F.coalesce(F.col("dot") / F.sqrt((F.col("norm") * F.col("length")).cast("double")), F.lit(0.0))
    return out.select("question_id", *CHUNK, "start", "end", score.alias("score"))


def top_k(scored: DataFrame, k: int = P.TOP_K, by: tuple[str, ...] = ("question_id", "doc_id", "strategy"), tie: str = "chunk_index") -> DataFrame:
    """The k best of each group, ranked from 1; ties go to the smaller index."""
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.bround("score", 4))


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """question_id, doc_id, strategy, rank, chunk_index, score, start, end."""
    return top_k(ask(questions, chunks), k).select("question_id", "doc_id", "strategy", "rank", "chunk_index", "score", "start", "end")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of dense vectors, in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda z, x: z + x)
