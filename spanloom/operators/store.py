"""A document store as tables: fingerprints, indexed documents, and the newest ones kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import fingerprint
from . import chunkers, sections


def newest(added: DataFrame, most: int = P.STORE_DOCUMENTS) -> DataFrame:
    """The documents added last, by seq; being read doesn't count. A top-k, not a full sort."""
    return added.orderBy(F.desc("seq"), "doc_id").limit(most)


@dataclass
class Indexed:
    """The tables of a set of documents: one row for each document, chunk and section."""

    docs: DataFrame
    chunks: DataFrame
    sections: DataFrame


def index(docs: DataFrame, size: int = P.SIZE, overlap: int = P.OVERLAP, max_chars: int = P.MAX_CHARS) -> Indexed:
    """Chunk documents by every strategy. Settings out of range are refused."""
    chunkers.check_settings(size, overlap, max_chars)
    docs = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    return Indexed(docs, chunkers.every(docs, size, overlap, max_chars), sections.sections(docs))
