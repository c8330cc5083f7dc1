"""Embedders: a hashed bag of words in the JVM, and a contract for others.

The hashed embedder keeps whole counts: (key columns, bucket, tf) rows and the
squared norm. So scores come from sums of whole numbers, equal in any engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import words


class Embedder(Protocol):
    """What retrieval needs of an embedder."""

    name: str
    max_tokens: int

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """`rows` with `vector` array<double>."""

    def tokens(self, text: Column) -> Column:
        """Tokens of a text."""


def hashed_words(text: Column) -> Column:
    """The bucket of each word."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(P.BUCKETS)).cast("int"))


def term_counts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, bucket, tf: how many of a text's words fall into each bucket.

    Counts are added up before they are shuffled, so at most P.BUCKETS rows of a text move.
    """
    return rows.select(*keys, F.explode(hashed_words(F.col(text))).alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").alias("tf"))


class HashedBag:
    """Word counts in 512 buckets, of unit length; a token is a run without white space."""

    name = "hashed-bag-512"
    max_tokens = P.MAX_TOKENS

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        h = hashed_words(F.col(text))
        counts = F.transform(F.sequence(F.lit(0), F.lit(P.BUCKETS - 1)), lambda b: F.size(F.filter("h", lambda x: x == b)).cast("double"))
        norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda z, x: z + x * x))
        out = rows.withColumn("h", h).withColumn("counts", counts).withColumn("norm", norm)
        return out.withColumn("vector", F.when(F.col("norm") > 0, F.transform("counts", lambda x: x / F.col("norm"))).otherwise(F.col("counts"))).drop("h", "counts", "norm")

    def tokens(self, text: Column) -> Column:
        return F.size(words(text))


class ModelEmbedder:
    """Any model, as a loader that gives (texts -> vectors); loaded once in each worker, fed by Arrow batches."""

    def __init__(self, name: str, load: Callable[[], Callable], max_tokens: int = P.MAX_TOKENS):
        self.name, self.load, self.max_tokens = name, load, max_tokens

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in model(texts.tolist())])

        return rows.withColumn("vector", run(F.col(text)))

    def tokens(self, text: Column) -> Column:
        return F.size(words(text))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (model, text) that the cache doesn't hold."""
    return texts.select("model", "text").dropDuplicates(["model", "text"]).join(cache.select("model", "text"), ["model", "text"], "left_anti")


def refresh_cache(cache: DataFrame, used: DataFrame, most: int = P.CACHED_TEXTS) -> DataFrame:
    """The most recently used `most` entries of (model, text, seq), after `used` was asked for."""
    every = cache.select("model", "text", "seq").unionByName(used.select("model", "text", "seq"))
    return every.groupBy("model", "text").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"), "model", "text").limit(most)
