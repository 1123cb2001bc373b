"""Connected components of an edge table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Smallest neighbouring label, then the label of that label (pointer jumping), until nothing
    changes. Each round's labels are written to the shared folder. No edges: no rows.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("comp").alias("c"))
        near = both.join(seen, "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("above"))
        stepped = low.join(up, "low", "left").select("node", F.least("low", "above").alias("comp"), "was")
        stepped = materialize(stepped, "labels")
        labels = stepped.select("node", "comp")
        if stepped.filter(F.col("comp") != F.col("was")).isEmpty():
            return labels
