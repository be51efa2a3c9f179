"""Connected components of an edge table by contraction.

Each round points every node to the least of its neighbours and itself, follows these pointers to their ends by doubling, and maps the edges to edges between the ends. Every node that has an edge meets another
node in a round, so nodes at least halve; the least node of a component is always an end, so the last one left is the least. Each step is an aggregation or a join by node, kept in the checkpoint folder.
Once few edges are left, the driver ends it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.held import held

#: Edges that the driver contracts by itself.
FEW = 1 << 16


def _ends(pointers: DataFrame) -> DataFrame:
    """(u, r) with every r followed to the node that points to itself."""
    while True:
        further = pointers.select(F.col("u").alias("r"), F.col("r").alias("s"))
        jumped = held(pointers.join(further, "r").select("u", F.col("s").alias("r"), (F.col("r") != F.col("s")).alias("moved")))
        pointers = jumped.select("u", "r")
        if jumped.filter("moved").isEmpty():
            return pointers


def _ends_of_few(edges: DataFrame) -> DataFrame:
    """(u, r) of a bounded number of edges, r the least node of u's component."""
    parent: dict = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in edges.select("u", "v").collect():
        u, v = sorted((top(u), top(v)))
        parent[v] = u
    kind = edges.schema["u"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(i, top(i)) for i in list(parent)], f"u {kind}, r {kind}")


def connected(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of (u, v): root is the least node of its component. Loops make a node its own root. few: edges that may go to the driver."""
    left = held(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    roots = left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    left = left.filter("u <> v")
    while n := left.limit(few + 1).count():
        if n <= few:
            return held(roots.join(_ends_of_few(left).withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("r", "root").alias("root")))
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = _ends(held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("r"))))
        roots = held(roots.join(ends.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("r", "root").alias("root")))
        of_u, of_v = ends.select("u", F.col("r").alias("a")), ends.select(F.col("u").alias("v"), F.col("r").alias("b"))
        left = held(left.join(of_u, "u").join(of_v, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    return roots
