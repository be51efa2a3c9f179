"""Region properties of hand-made shapes and of random labels."""

import math

import numpy as np

from tarnlake.operators import regions


def test_square_and_line():
    a = np.zeros((10, 12), int)
    a[2:6, 3:7] = 4
    a[8, 1:9] = 9
    square, line = regions.region_rows(a, np.arange(120).reshape(10, 12))
    assert (square["label"], square["area"], square["perimeter"], square["extent"], square["solidity"], square["eccentricity"]) == (4, 16, 12.0, 1.0, 1.0, 0.0)
    assert (square["top"], square["left"], square["bottom"], square["right"], square["centre_y"], square["centre_x"]) == (2, 3, 6, 7, 3.5, 4.5)
    assert math.isclose(square["major_axis"], 4 * math.sqrt(15 / 12)) and math.isclose(square["equivalent_diameter"], math.sqrt(64 / math.pi)) and math.isclose(square["mean_intensity"], 3.5 * 12 + 4.5)
    assert line["area"] == 8 and line["minor_axis"] == 0 and line["eccentricity"] == 1 and line["solidity"] == 1


def test_disc_and_notch():  # steps along axes and diagonals make a circle a twentieth too long
    y, x = np.indices((41, 41))
    disc = ((y - 20) ** 2 + (x - 20) ** 2 <= 225).astype(int)
    (r,) = regions.region_rows(disc)
    assert 0 < r["perimeter"] - 2 * math.pi * 15 < 6 and 0.9 < r["circularity"] < 1.15 and r["solidity"] > 0.95 and abs(r["major_axis"] - 30) < 0.5
    ell = np.zeros((8, 8), int)
    ell[:, :2] = 1
    ell[6:, :] = 1
    (r,) = regions.region_rows(ell)
    assert r["area"] == 28 and r["convex_area"] > 36 and r["solidity"] < 0.76


def test_hull_holds_every_point():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p = rng.integers(0, 9, (rng.integers(3, 30), 2)).astype(float)
        c = regions.hull(p)
        if len(c) > 2:
            for a, b in zip(c, np.roll(c, -1, axis=0), strict=True):
                assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= 0).all()


def test_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [6, 7], rng.integers(0, 4, 42).tolist(), rng.normal(size=42).tolist()) for i in range(5)] + [(9, None, [1], None), (10, [1, 2], None, None), (11, [1, 2], [0, 0], None)]
    df = spark.createDataFrame(rows, "id long, shape array<int>, labels array<int>, image array<double>")
    got = {(r["id"], r["label"]): r for r in regions.region_properties(df, "labels", "shape", ["id"], "image").collect()}
    assert set(got) == {(i, k) for i, _, a, _ in rows[:5] for k in set(a) - {0}}
    for i, _, a, v in rows[:5]:
        a, v = np.array(a).reshape(6, 7), np.array(v).reshape(6, 7)
        for k in set(a.ravel().tolist()) - {0}:
            r, (y, x) = got[i, k], np.nonzero(a == k)
            values = np.linalg.eigvalsh(np.cov(np.array([y, x]), bias=True)) if len(y) > 1 else np.zeros(2)
            assert r["area"] == len(y) and math.isclose(r["centre_x"], x.mean(), abs_tol=1e-12) and math.isclose(r["mean_intensity"], v[a == k].mean(), abs_tol=1e-12)
            assert math.isclose(r["major_axis"], 4 * math.sqrt(max(values[1], 0)), abs_tol=1e-6) and r["convex_area"] >= r["area"]
    totals = {r["id"]: r for r in regions.region_summary(regions.region_properties(df, "labels", "shape", ["id"]), ["id"]).collect()}
    assert set(totals) == set(range(5)) and totals[0]["n_regions"] == len({k for k in rows[0][2]} - {0})
