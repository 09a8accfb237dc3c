"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``(v, c)``: the smallest vertex reachable from each vertex of ``edges (a, b)``.

    Every round takes the smallest label among the neighbours and then the
    label of the label, so chains shorten by half or better. Labels are summed
    up before the shuffle; hot vertices on the edge side of the join are left
    to adaptive skew handling. Ends when a round changes nothing.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("v"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "v"), "v", "left") \
            .select("v", F.least("c", "m").alias("c"), F.col("c").alias("before"))
        over = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        nearer = stored(hooked.join(over, "c", "left")
                        .select("v", F.least("c", "cc").alias("c"), "before"), "labels")
        labels = nearer.select("v", "c")
        if nearer.where("c <> before").isEmpty():
            return labels
