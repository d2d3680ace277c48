"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage_table


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, root: the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then the label
    of that label, and is staged in the shared folder. Sums to a node are
    combined before the shuffle, so a hub costs no single task its links.
    Null ends are ignored; an empty table gives an empty table.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    both = stage_table(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stage_table(new.join(up, "root").select("node", "old", F.least("root", "above").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels
