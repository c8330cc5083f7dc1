"""Connected components of a link table, by smallest label and pointer jumping.

Labels stay in tables in the shared folder; only a count of changes reaches the
driver. Joins read those tables directly, so adaptive execution may split a node
that has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, kept


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in `links` (a, b), as a kept table: label is the smallest id reachable."""
    both = kept(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = kept(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label")), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = kept(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "low").alias("next")), "labels")
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = lower.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("far", "next")).alias("new"))
        drop(labels)
        labels = kept(new.select("id", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("changed")), "labels")
        drop(lower)
        if not labels.where("changed").limit(1).count():
            drop(both)
            path = labels._kept_in
            labels = labels.drop("changed")
            labels._kept_in = path
            return labels
