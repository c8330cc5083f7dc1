"""A training corpus from documents: quality, near copies, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir); run() writes its rows as Parquet
in the shared folder and reads them again for the next one. All but the last give
the columns of documents, further ones included.

Nulls: a null text is empty, and stays null unless something is cut from it; a null id
stays null, is nobody's near copy and not held out. Repeated rows (same id and text)
are one document in the near-copies stage, so they stay or go together, and repeat each
other's passages. Rows of one id and different texts are different documents. An empty
table gives empty tables, a text of any length is handled whole.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, packing, quality, shared, suffix_dedup

#: SQL can't express the classifier's fit, so tests hold the rows of each stage after it against a brute-force version.
ORACLE_SQL = None
#: Documents are near copies if their sets of five-word shingles have this similarity, in percent.
NEAR = 80
#: Bytes that a repeated passage has at least. Of passages of 51 words in the test tables, 19 in 20 have 267 or more in
#: English, 287 in the other languages; one in a hundred has less than 203 to 265.
PASSAGE = 240


def _importable(spark: SparkSession) -> None:
    """Let Python workers import this repository where it wasn't shipped to them."""
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if (root := str(Path(__file__).resolve().parents[2])) not in have.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{have}".rstrip(":")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranked quality score doesn't reject."""
    _importable(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id."""
    _importable(spark)
    return minhash.without_copies(docs, NEAR)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that are repeated elsewhere; every document stays, if need be with an empty text. n_chars, if there, follows."""
    _importable(spark)
    cut = suffix_dedup.remove(docs, PASSAGE)
    if "n_chars" not in docs.columns:
        return cut
    plain = cut.toDF(*(c if c in ("text", "n_chars") else f"column_{i}" for i, c in enumerate(docs.columns)))
    return plain.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    _importable(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_copies", keep_one_of_near_copies), ("repeated_passages", cut_repeated_passages), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote is deleted once the next one has."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = shared.kept(stage(spark, docs, sf_dir), name)
        if before is not None:
            shared.drop(before)
        before = docs
    return docs
