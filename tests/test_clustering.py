"""Density, Ward and quality of clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import clustering, components


def plain_density(x, eps, least):
    """DBSCAN over all pairs: core rows, clusters in order of their first core row, borders to the first cluster near."""
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core, label = near.sum(axis=1) >= least, np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = c
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = c
                    todo.append(j)
            c += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return label


@pytest.mark.parametrize(("d", "tile"), [(2, 4096), (2, 60), (5, 100)])
def test_density_against_all_pairs(spark, d, tile):
    rng = np.random.default_rng(d)
    n = 2000 if tile == 4096 else 500
    middle = rng.uniform(-5, 5, (6, d))
    x = np.round(np.concatenate([middle[rng.integers(0, 6, n * 7 // 10)] + 0.4 * rng.normal(size=(n * 7 // 10, d)), rng.uniform(-7, 7, (n * 2 // 10, d)), np.tile(middle[:1], (n // 10, 1))]), 3)
    eps = 0.3 if d == 2 else 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99_999, None)], "id long, v array<double>").repartition(5)
    got = {r["id"]: r["cluster"] for r in clustering.density_clusters(df, "id", "v", eps, 6, tile).collect()}
    want = plain_density(x, eps, 6)
    assert len(got) == n and want.max() >= 3 and (want == -1).any()
    assert [got[i] for i in range(n)] == want.tolist()


def test_density_of_nothing_and_of_noise(spark):
    assert clustering.density_clusters(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 1.0).count() == 0
    far = spark.createDataFrame([(i, [100.0 * i]) for i in range(9)], "id long, v array<double>")
    assert {r["cluster"] for r in clustering.density_clusters(far, "id", "v", 1.0).collect()} == {-1}


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 100, (60, 2))] + [(5000, 5000)] + [(6000, 6001 + i) for i in range(200)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in list(parent)}


def plain_silhouette(x, c, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = d if squared else np.sqrt(d)
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, c == k].mean() for k in set(c) if k != c[i])
        out.append((b - a) / max(a, b))
    return out


def test_silhouettes(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(120, 4)), rng.integers(0, 4, 120)
    x += c[:, None]
    c[0] = 7
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))] + [(200, [0.0] * 4, -1), (201, [0.0] * 4, None)], "id long, v array<double>, cluster int").repartition(4)
    got = {r["id"]: r["silhouette"] for r in clustering.silhouette_squared(df, ["id"], "v", "cluster").collect()}
    assert len(got) == 120 and np.abs(np.array([got[i] for i in range(120)]) - plain_silhouette(x, c, True)).max() < 1e-9
    near = {r["id"]: r["silhouette"] for r in clustering.silhouette(df, df.filter("id % 3 = 0"), "id", "v", "cluster", most_queries=15).collect()}
    want = plain_silhouette(x, c, False)
    assert len(near) == 40 and all(abs(near[i] - want[i]) < 1e-9 for i in near)


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    loss = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))), key=lambda p: loss(groups[p[0]] + groups[p[1]]) - loss(groups[p[0]]) - loss(groups[p[1]]))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_ward(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) + np.repeat(np.arange(4), 10)[:, None] * 1.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    groups = {}
    for r in clustering.ward_clusters(df, ["id"], "v", 5).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == plain_ward(x, 5)
    micro = clustering.ward_clusters(df, ["id"], "v", 4, most_points=15).groupBy("cluster").count().collect()
    assert len(micro) == 4 and sum(r["count"] for r in micro) == 40


def test_sequence(spark):
    rng = np.random.default_rng(42)
    rows = []
    for image in range(2):
        for j in range(150):
            k = j % 3
            a, b = 10 * k + rng.normal(), -8 * k + rng.normal()
            rows.append((image * 1000 + j, f"i{image}", float(a), float(b), float(a * 2), 0.01 * float(rng.normal())))
    rows += [(5000, "i0", float("nan"), 0.0, 0.0, 0.0), (5001, "i0", None, 0.0, 0.0, 0.0), (5002, "i0", float("inf"), 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "row long, image string, a double, b double, twice double, flat double")
    for kw in ({"method": "kmeans"}, {"method": "ward"}, {"method": "dbscan"}, {"method": "kmeans", "components": 2}):
        got = clustering.clustered(df, "row", ["a", "b", "twice", "flat"], k=3, selection="correlation", keep=["image"], **kw)
        labels = got.labels.collect()
        q = got.quality.first()
        assert len(labels) == 300 and q["n_rows"] == 300 and {r["image"] for r in labels} == {"i0", "i1"}
        if kw["method"] != "dbscan":
            assert q["n_clusters"] == 3 and q["silhouette"] > 0.4
        assert "twice" not in got.features and "b" not in got.features
    assert clustering.clustered(df, "row", ["a", "b", "twice", "flat"], k=3, selection="variance").features == ["twice", "a"][::-1]
    with pytest.raises(ValueError):
        clustering.clustered(df, "row", ["a"], method="other")


def test_projection(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["v"] for r in clustering.projected(df, ["id"], [0, 1, 2, 3], components=2).collect()}
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    axes = vt[:2].T * np.where(vt[:2].T[np.abs(vt[:2].T).argmax(axis=0), [0, 1]] < 0, -1, 1)
    assert np.abs(np.array([got[i] for i in range(80)]) - z @ axes).max() < 1e-6
    assert clustering.selected_features(df.withColumn("v", F.col("v")), list("abcd"), "all") == [0, 1, 2, 3]


@pytest.mark.parametrize(("d", "least", "few", "tile", "shift"), [(1, 6, 64, 30, 0), (2, 40, 64, 60, 1e6), (2, 40, 0, 60, 0), (3, 5, 64, 20, 0), (3, 5, 0, 4096, 1e12)])
def test_density_by_cells_against_all_pairs(spark, monkeypatch, d, least, few, tile, shift):
    """Joins of cells and arrays, few rows and many in a core row's surroundings, values too large for cells."""
    monkeypatch.setattr(clustering, "FEW_POINTS", few)
    rng = np.random.default_rng(10 * d + few)
    middle = rng.uniform(-3, 3, (5, d)) * (8 if d == 1 else 1)
    x = shift + np.round(np.concatenate([middle[rng.integers(0, 5, 420)] + 0.3 * rng.normal(size=(420, d)), rng.uniform(-4, 4, (100, d)), np.tile(middle[:1], (30, 1))]), 3)
    eps = {1: 0.03, 2: 0.4, 3: 0.5}[d]
    got = {r["id"]: r["cluster"] for r in clustering.density_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", eps, least, tile).collect()}
    want = plain_density(x, eps, least)
    assert want.max() >= 1 and (want == -1).any()
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_dense_place_without_all_pairs(spark, monkeypatch):
    """Two squares of 20,000 points: no point of a cell of many rows is compared with the points around, and the squares touch by a chain."""
    monkeypatch.setattr(clustering, "_groups", lambda *a: pytest.fail("all pairs of a place"))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(0, 1, (20_000, 2)), rng.uniform(0, 1, (20_000, 2)) + [3, 0], [[9, 9]] * 3, rng.uniform(0, 1, (20_000, 2)) + [3, 3]])
    got = {r["id"]: r["cluster"] for r in clustering.density_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 0.2, 6).collect()}
    assert [got[i] for i in range(len(x))] == [0] * 20_000 + [1] * 20_000 + [-1] * 3 + [2] * 20_000


def test_cells_linked_by_inner_points_only(spark):
    """The outermost points of two cells are over eps apart, points between them aren't."""
    for inner, other, want in ((0.69, 1.5, {0}), (0.4, 1.8, {0, 1})):
        x = [(0.7, 0.0), (0.0, 0.7), (inner, 0.35), (1.42, 0.7), (2.1, 0.01), (other, 0.35)]
        df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(x)], "id long, v array<double>")
        assert {r["cluster"] for r in clustering.density_clusters(df, "id", "v", 1.0, 3, 2).collect()} == want


def test_touch():
    rng = np.random.default_rng(8)
    for gap, want in ((0.1, True), (0.3, False)):
        x, y = rng.uniform(0, 1, (3000, 2)), rng.uniform(0, 1, (3000, 2))
        x[:, 0] *= x[:, 1]  # only near one corner do they come close
        y[:, 0] = 1 + gap + y[:, 0] * y[:, 1]
        near = (((x[:, None] - y[None]) ** 2).sum(axis=2) <= 0.2**2).any()
        assert clustering._touch(x, y, 0.2) == near == want
    assert not clustering._touch(np.zeros((0, 2)), np.zeros((5, 2)), 1.0)


def test_no_row_is_lost_when_vectors_are_formed_again(spark):
    """Vectors that come out otherwise each time, as sums of doubles in another order may, and missing components."""
    import random

    any_v = F.udf(lambda i: [random.random(), None if i == 7 else float("nan") if i == 8 else float("inf") if i == 9 else 0.5], "array<double>").asNondeterministic()
    got = clustering.density_clusters(spark.range(50).withColumn("v", any_v("id")), "id", "v", 2.0, 6).collect()
    assert {r["id"]: r["cluster"] for r in got} == {i: -1 if i in (7, 8, 9) else 0 for i in range(50)}


def test_density_of_values_beyond_whole_numbers(spark):
    df = spark.createDataFrame([(i, [1e30, 0.0]) for i in range(6)] + [(i, [-1e30 * i, 0.1]) for i in range(6, 12)], "id long, v array<double>")
    assert {r["id"]: r["cluster"] for r in clustering.density_clusters(df, "id", "v", 1.0, 6).collect()} == {i: 0 if i < 6 else -1 for i in range(12)}


def test_points_at_a_tie_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    from tarnlake.plans import queries

    duckdb.sql(f"COPY (SELECT i AS c_custkey, CAST(i % 11000 - 1000 + 0.5 AS DOUBLE) AS c_acctbal FROM range(11000) t(i)) TO '{tmp_path}/customer.parquet'")
    duckdb.sql(f"COPY (SELECT i AS o_custkey, i * 1000 + 500.0::DOUBLE AS o_totalprice FROM range(11000) t(i)) TO '{tmp_path}/orders.parquet'")
    want = duckdb.sql(f"SELECT c_custkey, round(c_acctbal / 1000, 3), round(o_totalprice / 1000000, 3) FROM '{tmp_path}/customer.parquet' JOIN '{tmp_path}/orders.parquet' ON o_custkey = c_custkey").fetchall()
    got = {r["c_custkey"]: tuple(r["v"]) for r in queries._spenders(spark, str(tmp_path)).collect()}
    assert got == {i: (x, y) for i, x, y in want}


def test_components_without_the_driver(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (80, 90), (70, 70)]
    want = {i: 0 for i in range(41)} | {80: 80, 90: 80, 100: 80, 70: 70}
    for few in (0, 2, 100):
        assert {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long"), few).collect()} == want
