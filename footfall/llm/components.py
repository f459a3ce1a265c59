"""Connected components of a link table, by least labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link; the label is the least node of its component.

    `links` has columns a and b. Each round takes the least label among a node's neighbours, then the label
    of that label, and ends when nothing changed; chains shorten by more than half in a round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter(F.col("a") != F.col("b")).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = stored(labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node")
        nearer = nearer.select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        jumped = nearer.join(target, "label").select("node", "_old", F.least("label", "_next").alias("label"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("_old") != F.col("label")).isEmpty():
            return labels
