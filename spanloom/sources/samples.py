"""The built-in samples and their questions, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
SAMPLES = [
    (
        "tent",
        "trailhead-tent-manual.md",
        "Tent manual",
        ["How long is the warranty?", "What isn't covered?", "How should I store the tent over the winter?", "Why is the inside of my tent wet in the morning?", "How much does it weigh?"],
    ),
    (
        "fda",
        "repatha-fda-label.pdf",
        "FDA drug label (PDF)",
        ["What is the recommended dose for adults with HoFH?", "What is Repatha used to treat?", "How much did 420 mg once monthly lower LDL-C compared with placebo?", "How should Repatha be stored?", "What should a patient do if they miss a dose?"],
    ),
]


def samples(spark: SparkSession, files: DataFrame | None = None) -> DataFrame:
    """id, file, title, questions, available: whether `files` (name) holds the file."""
    rows = spark.createDataFrame(SAMPLES, "id string, file string, title string, questions array<string>")
    if files is None:
        return rows.withColumn("available", F.lit(False))
    have = files.select(F.regexp_extract("name", r"([^/\\]*)\z", 1).alias("file")).distinct().withColumn("have", F.lit(True))
    return rows.join(have, "file", "left").select("id", "file", "title", "questions", F.coalesce("have", F.lit(False)).alias("available"))
