"""Pair counts and binary patterns against loops over pixels."""

import math

import numpy as np
import pytest

from tarnlake.operators import textures


@pytest.mark.parametrize("symmetric", [False, True])
def test_pairs_against_pixels(symmetric):
    q = np.random.default_rng(1).integers(0, 6, (9, 7))
    for d in (1, 2, 3, 8):
        for angle in (*textures.ANGLES, math.pi):
            dy, dx = round(math.sin(angle) * d), round(math.cos(angle) * d)
            want = np.zeros((6, 6), int)
            pairs = []
            for y in range(9):
                for x in range(7):
                    if 0 <= y + dy < 9 and 0 <= x + dx < 7:
                        for i, j in ((q[y, x], q[y + dy, x + dx]), (q[y + dy, x + dx], q[y, x]))[: 1 + symmetric]:
                            want[i, j] += 1
                            pairs.append((i, j))
            got = textures.pair_counts(q, 6, d, angle, symmetric)
            assert (got == want).all(), (d, angle)
            if len(pairs) > 3:
                a, b = np.array(pairs, float).T
                p = textures.pair_properties(got)
                assert math.isclose(p["contrast"], ((a - b) ** 2).mean()) and math.isclose(p["dissimilarity"], np.abs(a - b).mean()) and math.isclose(p["homogeneity"], (1 / (1 + (a - b) ** 2)).mean())
                assert math.isclose(p["correlation"], np.corrcoef(a, b)[0, 1], abs_tol=1e-9) and math.isclose(p["energy"], math.sqrt((want / want.sum()).ravel() @ (want / want.sum()).ravel()))
    assert textures.pair_properties(textures.pair_counts(np.zeros((4, 4), int), 3, 1, 0.0))["correlation"] == 1.0


def test_patterns_against_pixels():
    a = np.random.default_rng(2).integers(0, 9, (8, 10)).astype(float)
    for points, radius in ((8, 1), (24, 3)):
        got = textures.binary_patterns(a, points, radius)
        for y in range(8):
            for x in range(10):
                bits = []
                for k in range(points):
                    v = y + round(-radius * math.sin(2 * math.pi * k / points), 5)
                    u = x + round(radius * math.cos(2 * math.pi * k / points), 5)
                    s = 0.0
                    for i in (math.floor(v), math.floor(v) + 1):
                        for j in (math.floor(u), math.floor(u) + 1):
                            if 0 <= i < 8 and 0 <= j < 10:
                                s += (1 - abs(v - i)) * (1 - abs(u - j)) * a[i, j]
                    bits.append((s - a[y, x], s))
                if any(abs(b) < 1e-9 and b != 0 for b, _ in bits):
                    continue  # rounding decides
                signs = [b >= 0 for b, _ in bits]
                turns = sum(signs[k] != signs[(k + 1) % points] for k in range(points))
                assert got[y, x] == (sum(signs) if turns <= 2 else points + 1)


def test_features_of_a_table(spark):
    rng = np.random.default_rng(3)
    flat, busy = [2.0] * 64, rng.normal(size=64).tolist()
    df = spark.createDataFrame([(1, [8, 8], flat), (2, [8, 8], busy), (3, None, busy), (4, [8, 8], None)], "id long, shape array<int>, image array<double>")
    got = {r["id"]: r for r in textures.texture_features(df, "image", "shape", ["id"], levels=16).collect()}
    assert got[1]["glcm_contrast_max"] == 0 and got[1]["glcm_energy_min"] == 1 and got[2]["glcm_contrast_mean"] > 1 and got[2]["lbp_entropy"] > 0
    assert got[3]["lbp_energy"] is None and got[4]["glcm_contrast_mean"] is None
