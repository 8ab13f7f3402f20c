"""Connected components of an edge table, by rounds of hooking and pointer jumping in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._spark import cut


def _follow(parent: DataFrame) -> DataFrame:
    """parent(parent(c)) for each c; labels without a row of their own are roots."""
    up = parent.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
    return parent.join(up, F.col("p") == F.col("_c"), "left").select("c", F.coalesce("_p", "p").alias("p"))


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, c, ...) with the classes that edges (a, b) of nodes connect made one.

    Every round hooks each class onto its smallest neighbour, follows those pointers
    three times and contracts the edges; it ends when no edge leaves its class. Rows of
    a class with many edges are only ever reduced by partial aggregation or joined.
    """
    left, right = (labels.select(F.col("node").alias(f"_{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    between = edges.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    between = cut(between.where("ca <> cb").select("ca", "cb").distinct())
    steps = []
    while not between.isEmpty():
        both = between.unionByName(between.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        parent = both.groupBy(F.col("ca").alias("c")).agg(F.min("cb").alias("p")).where("p < c")
        for _ in range(3):
            parent = _follow(parent)
        parent = cut(parent)
        steps.append(parent)
        for x in ("ca", "cb"):
            between = between.join(parent, F.col(x) == F.col("c"), "left").withColumn(x, F.coalesce("p", x)).drop("c", "p")
        between = cut(between.where("ca <> cb").distinct())
    for parent in steps:
        up = parent.select(F.col("c").alias("_c"), "p")
        labels = labels.join(up, F.col("c") == F.col("_c"), "left").withColumn("c", F.coalesce("p", "c")).drop("_c", "p")
    return cut(labels) if steps else labels
