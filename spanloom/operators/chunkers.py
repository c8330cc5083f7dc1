"""Chunkers: (doc_id, text) to one row for each chunk.

All three are maps over documents, without a shuffle. A chunk has doc_id, strategy,
chunk_index, start, end, text and headers; start and end are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions.text import let
from .sections import with_sections


def check_settings(size: int = P.SIZE, overlap: int = P.OVERLAP, max_chars: int = P.MAX_CHARS) -> None:
    """The ranges that settings must keep to."""
    if not 50 <= size <= 5000:
        raise ValueError("size must be between 50 and 5000")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    if not 200 <= max_chars <= 10000:
        raise ValueError("max_chars must be between 200 and 10000")


def _rows(docs: DataFrame, strategy: str, spans: Column) -> DataFrame:
    out = docs.select("doc_id", "text", F.posexplode(spans).alias("chunk_index", "s"))
    return out.select("doc_id", F.lit(strategy).alias("strategy"), "chunk_index", F.col("s.start").alias("start"), F.col("s.end").alias("end"), S.cut(F.col("text"), F.col("s")).alias("text"), F.array().cast("array<string>").alias("headers"))


def fixed(docs: DataFrame, size: int = P.SIZE, overlap: int = P.OVERLAP) -> DataFrame:
    return _rows(docs, "fixed", S.fixed(F.col("text"), size, overlap))


def paragraph(docs: DataFrame, max_chars: int = P.MAX_CHARS) -> DataFrame:
    text = F.col("text")
    return _rows(docs, "paragraph", S.split_long(text, S.paragraphs(text), F.lit(max_chars)))


def section(docs: DataFrame, max_chars: int = P.MAX_CHARS, marks: bool = False) -> DataFrame:
    """Sections' bodies packed up to a budget; every chunk's text begins with the section's path. `marks`: as in sections.lines_of."""
    text = F.col("text")

    def chunks(sec: Column) -> Column:
        path = F.array_join(sec["path"], " > ")
        prefix = F.when(path != "", F.concat(path, F.lit("\n\n"))).otherwise(F.lit(""))
        head = F.struct(prefix.alias("prefix"), F.greatest(F.lit(200), max_chars - F.length(prefix)).cast("int").alias("budget"), F.try_element_at(sec["body"], F.lit(1))["start"].alias("first"))
        return let(head, lambda v: F.transform(S.pack(S.split_long(text, sec["body"], v["budget"]), v["budget"]), lambda g: one(sec, v, g)))

    def one(sec: Column, v: Column, g: Column) -> Column:
        begin = F.when(sec["header"].isNotNull() & (g["start"] == v["first"]), sec["header"]["start"]).otherwise(g["start"])
        return F.struct(begin.alias("start"), g["end"].alias("end"), F.concat(v["prefix"], S.cut(text, g)).alias("chunk"), sec["path"].alias("headers"))

    rows = with_sections(docs, marks).select("doc_id", F.posexplode(F.flatten(F.transform("sections", chunks))).alias("chunk_index", "c"))
    return rows.select("doc_id", F.lit("section").alias("strategy"), "chunk_index", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.chunk").alias("text"), F.col("c.headers").alias("headers"))


def every(docs: DataFrame, size: int = P.SIZE, overlap: int = P.OVERLAP, max_chars: int = P.MAX_CHARS, marks: bool = False) -> DataFrame:
    """The chunks of all strategies."""
    return fixed(docs, size, overlap).unionByName(paragraph(docs, max_chars)).unionByName(section(docs, max_chars, marks))
