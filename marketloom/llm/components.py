"""Connected components of links between documents, in rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, staged


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) for every linked document; ``comp`` is the smallest document of its component.

    Each round gives a node the smallest label among its neighbours' and its own, then follows that label once more.
    Sums are combined before each shuffle, so a document with many links is not a hot group; every round is written to
    the shared folder.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = staged(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("m")).select("doc", F.least("doc", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("doc")).groupBy("u").agg(F.min("comp").alias("near"))
        new = labels.join(near, F.col("doc") == F.col("u"), "left").select("doc", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("doc").alias("to"), F.col("comp").alias("far"))
        new = staged(new.join(jump, "to", "left").select("doc", "old", F.least("to", F.coalesce("far", "to")).alias("comp")), "labels")
        removed(labels)
        labels = new.select("doc", "comp")
        labels.staged_path = new.staged_path
        if new.where("old <> comp").isEmpty():
            removed(both)
            return labels
