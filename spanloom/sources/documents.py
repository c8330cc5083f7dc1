"""Documents from files: bytes to normalised text, with an error column instead of a failure."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import looks_like_text, normalize

MAX_BYTES = 5 * 1024 * 1024


def kind(name: Column) -> Column:
    """pdf, text or null by the lower-cased name; a name without a dot is text."""
    low = F.lower(name)
    base = F.regexp_extract(low, r"([^/\\]*)\z", 1)
    text = F.lit(False)
    for e in P.EXTENSIONS:
        text = text | low.endswith(e)
    return F.when(low.endswith(".pdf"), "pdf").when(text | ~F.contains(base, F.lit(".")), "text")


def decode_bytes(data: bytes) -> str:
    """UTF-16 only with its mark, UTF-8, Windows-1252, and at last UTF-8 with replacements."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ("utf-16", "utf-8-sig", "cp1252")
    else:
        order = ("utf-8-sig", "cp1252")
    for name in order:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def _decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def decode(data: Column) -> Column:
    """Spark's decode() can't tell encodings apart, nor has it Windows-1252 without a legacy setting."""
    return F.pandas_udf(_decoded, "string")(data)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the files at a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def load(files: DataFrame, pdf_pages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """name, text, error of files (name, content).

    pdf_pages gives (name, page_no, text) of PDF files (name, content); without it they are errors.
    Equal PDF files are parsed once.
    """
    known = files.withColumn("kind", kind(F.col("name"))).withColumn("big", F.octet_length("content") > MAX_BYTES)
    own = known.where("kind is null or kind = 'text' or big").withColumn("raw", F.when(~F.col("big") & (F.col("kind") == "text"), decode(F.col("content"))))
    out = own.select("name", "kind", "big", "raw")
    papers = known.where("kind = 'pdf' and not big").select("name", F.sha2("content", 256).alias("digest"), "content")
    if pdf_pages is None:
        out = out.unionByName(papers.select("name", F.lit("pdf").alias("kind"), F.lit(False).alias("big"), F.lit(None).cast("string").alias("raw")))
    else:
        from ..operators.cleanup import pages_to_documents

        once = papers.dropDuplicates(["digest"]).select(F.col("digest").alias("name"), "content")
        texts = pages_to_documents(pdf_pages(once).withColumnRenamed("name", "doc_id")).select(F.col("doc_id").alias("digest"), F.col("text").alias("raw"))
        # a file of which the reader gives no page has no text
        out = out.unionByName(papers.select("name", "digest").join(texts, "digest", "left").select("name", F.lit("pdf").alias("kind"), F.lit(False).alias("big"), F.coalesce("raw", F.lit("")).alias("raw")))
    text = normalize(F.col("raw"))
    error = (
        F.when(F.col("big"), "too large")
        .when(F.col("kind").isNull(), "not a .txt, .md or .pdf file")
        .when(F.col("raw").isNull(), "no reader for this kind of file")
        .when((F.col("kind") == "text") & ~looks_like_text(F.col("raw")), "not text")
        .when(text == "\n", "no text in this file")
    )
    return out.select("name", F.when(error.isNull(), text).alias("text"), error.alias("error"))
