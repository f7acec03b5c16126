"""Connected components by contraction, on DataFrames alone.

Every round maps each node to the neighbour (or itself) with the least hash and replaces the graph
by its image, which keeps connected what was connected; hashes instead of ids make long chains
shrink by a constant factor. Rounds end when no edge is left. A star is done in one or two rounds.
Each step is written to the shared folder, so lineage stays short and nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """edges (u, v) of longs, saved -> (node, root) for every node of an edge; loops and repeats are allowed."""
    labels, step = None, 0
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.union(both.select("u", F.col("u").alias("v")))
        to = work.save(both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("m")), f"{name}-to{step}")
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("m").alias("root"))
        else:
            joined = labels.join(to.withColumnRenamed("u", "root"), "root", "left")
            labels = work.save(joined.select("node", F.coalesce("m", "root").alias("root")), f"{name}-labels{step}")
        image = edges.join(to.select("u", F.col("m").alias("mu")), "u").select("mu", "v")
        image = image.join(to.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v").filter("mu <> mv")
        edges = work.save(image.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), f"{name}-edges{step}")
        if edges.isEmpty():
            return labels
        step += 1
