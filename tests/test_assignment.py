"""Size-balanced assignment against the least possible, and nearest neighbours over many batches."""

import itertools

import numpy as np
import pytest

from tarnlake.operators import assignment, models


def least(sizes, workers):
    """The smallest greatest total over all assignments."""
    best = sum(sizes)
    for split in itertools.product(range(workers), repeat=len(sizes)):
        loads = [0.0] * workers
        for s, w in zip(sizes, split, strict=True):
            loads[w] += s
        best = min(best, max(loads))
    return best


def test_within_four_thirds_of_the_least(spark):
    rng = np.random.default_rng(3)
    for n, workers in ((9, 2), (8, 3)):
        sizes = np.round(rng.exponential(10, n), 1).tolist()
        got = assignment.balanced(spark.createDataFrame(list(enumerate(sizes)), "item int, bytes double"), "item", "bytes", workers).collect()
        loads = np.zeros(workers)
        for r in got:
            loads[r["worker"]] += r["size"]
        assert sorted(r["item"] for r in got) == list(range(n)) and loads.max() <= 4 / 3 * least(sizes, workers) + 1e-9


@pytest.mark.parametrize("kind", ["equal", "tail", "one_large"])
def test_many_small_items_are_even(spark, kind):
    rng = np.random.default_rng(1)
    sizes = {"equal": [5.0] * 900, "tail": rng.pareto(1.2, 900).tolist(), "one_large": [1e4] + [1.0] * 500}[kind]
    rows = [(i, s) for i, s in enumerate(sizes)] + [(5000, None), (5001, -3.0), (5002, 0.0)]
    got = assignment.balanced(spark.createDataFrame(rows, "item int, bytes double").repartition(6), "item", "bytes", 7)
    totals = {r["worker"]: r["total"] for r in assignment.worker_totals(got).collect()}
    even = sum(sizes) / 7
    assert got.count() == len(rows) and max(totals.values()) <= max(even * 10 / 9, max(sizes) + 1e-9) + 1e-6
    assert got.select("item").distinct().count() == len(rows)


def test_nothing_and_one_worker(spark):
    empty = spark.createDataFrame([], "item int, bytes double")
    assert assignment.balanced(empty, "item", "bytes", 3).count() == 0
    one = assignment.balanced(spark.createDataFrame([(1, 2.0), (2, 3.0)], "item int, bytes double"), "item", "bytes", 1)
    assert {r["worker"] for r in one.collect()} == {0}
    with pytest.raises(ValueError):
        assignment.balanced(empty, "item", "bytes", 0)


def test_neighbours_over_batches(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 3)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = {}
        for r in models.nearest_neighbours(df, df.filter("id % 9 = 0"), "id", "v", 4, most_queries=10).collect():
            got.setdefault(r["query"], []).append((r["place"], r["neighbour"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(0, 300, 9):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [n for _, n in sorted(got[q])] == np.lexsort((np.arange(300), d))[:4].tolist()
