"""Chunking a stream of documents: each arriving row is chunked on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import normalize
from ..operators import chunkers


def documents(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 1000) -> DataFrame:
    """A stream of parquet documents, with normalised texts."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.withColumn("text", normalize(F.coalesce("text", F.lit(""))))


def write_chunks(docs: DataFrame, folder: str, checkpoint: str, **settings) -> StreamingQuery:
    """Append the chunks of all strategies to parquet files, each batch once."""
    return chunkers.every(docs, **settings).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
