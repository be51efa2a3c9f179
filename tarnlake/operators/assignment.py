"""Items dealt to workers so that their totals are even, without one task that sees all items.

Longest first to the least loaded worker is within 4/3 of the least possible greatest total, and what matters for that are the large items. Those over a ninth of a worker's even share, at most nine for each worker, are
dealt so on the driver. The rest, in the order of size, are poured into what room is left: an item goes to the worker in whose room the middle of its running total falls. Running totals come from ranges.
A worker's room is filled to within one item at each end, so its total is at most the level plus a ninth of the even share, beside what the large items force.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import number
from tarnlake.functions.ordered import running_totals

#: Items over this share of the even load are dealt singly.
LARGE = 1 / 9


def longest_first(sizes: list[float], workers: int) -> list[int]:
    """The worker of each item, sizes falling: always the least loaded, the first of equals."""
    heap = [(0.0, w) for w in range(workers)]
    out = []
    for s in sizes:
        load, w = heapq.heappop(heap)
        out.append(w)
        heapq.heappush(heap, (load + s, w))
    return out


def level(loads: np.ndarray, amount: float) -> float:
    """How high `amount` fills the room over loads, the lowest first."""
    ordered = np.sort(loads)
    for n in range(1, len(ordered) + 1):
        top = (amount + ordered[:n].sum()) / n
        if n == len(ordered) or top <= ordered[n]:
            return float(top)
    return float(ordered[-1])


def balanced(items: DataFrame, item: str, size: str, workers: int) -> DataFrame:
    """(item, size, worker) with workers from 0. Sizes are 0 or more; null or negative ones count as 0. Equal items each have a row; ties are by item."""
    if workers < 1:
        raise ValueError("at least one worker")
    rows = items.select(item, F.greatest(F.coalesce(number(size), F.lit(0.0)), F.lit(0.0)).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0.0
    bound = total / workers * LARGE
    large = [(r[item], r["size"]) for r in rows.filter(F.col("size") > bound).orderBy(F.desc("size"), item).collect()] if total else []  # nine a worker at most
    chosen = longest_first([s for _, s in large], workers)
    loads = np.zeros(workers)
    for (_, s), w in zip(large, chosen, strict=True):
        loads[w] += s
    spark = items.sparkSession
    dealt = spark.createDataFrame([(i, s, w) for (i, s), w in zip(large, chosen, strict=True)], f"`{item}` {rows.schema[item].dataType.simpleString()}, size double, worker int")
    top = level(loads, total - loads.sum())
    room = np.maximum(top - loads, 0.0)
    starts = np.cumsum(room) - room
    small = rows.filter(F.col("size") <= bound)
    counted = small.groupBy("size").agg(F.count(F.lit(1)).alias("n")).withColumn("amount", F.col("size") * F.col("n"))
    below = running_totals(counted, "size", ["amount"]).select(F.col("size").alias("__size"), "below_amount", "n")
    # Among items of one size, places come from ranges of a hash, so a size that many items share isn't one task.
    spread = small.withColumn("part", F.pmod(F.xxhash64(F.col(item), F.col("size")), F.lit(256)))
    parts = spread.groupBy("size", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = parts.select(F.col("size").alias("__s"), F.col("part").alias("__p"), before.alias("before"))
    placed = spread.join(earlier, (F.col("size") == F.col("__s")) & (F.col("part") == F.col("__p"))).join(below, F.col("size") == F.col("__size"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("size", "part").orderBy(item)) - 1
    middle = F.col("below_amount") + (nth + 0.5) * F.col("size")
    edges = F.array(*[F.lit(float(x)) for x in starts[1:]]) if workers > 1 else F.array().cast("array<double>")
    poured = placed.select(item, "size", F.size(F.filter(edges, lambda e: e <= middle)).alias("worker"))
    return dealt.unionByName(poured)


def worker_totals(dealt: DataFrame) -> DataFrame:
    """(worker, n_items, total) of each worker that has items."""
    return dealt.groupBy("worker").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("total"))
