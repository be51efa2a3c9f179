"""Crops, pads and regions against numpy; voxels keep their place in the world."""

import numpy as np
import pytest

from tarnlake.operators import grids

SCHEMA = "id string, shape array<int>, affine array<double>, data array<double>, mask array<double>, note string"
AFFINE = np.array([[0.0, -2, 0.1, 5], [1.5, 0, 0, -7], [0, 0.3, 3, 11], [0, 0, 0, 1]])


def places(shape, affine):
    at = np.stack([*np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), np.ones(shape)], -1)
    return at @ affine.T


@pytest.fixture(scope="module")
def volumes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for shape in ((5, 6, 7), (2, 9, 4), (1, 1, 3)):
        mask = np.zeros(shape)
        mask[0, shape[1] // 2, 1:3] = 1
        rows.append(("x".join(map(str, shape)), list(shape), AFFINE.ravel().tolist(), places(shape, AFFINE)[..., :3].sum(-1).ravel().tolist(), mask.ravel().tolist(), "n"))
    rows += [("flat", [2, 2], AFFINE.ravel().tolist(), [1.0] * 4, [1.0] * 4, ""), ("short", [2, 2, 2], AFFINE.ravel().tolist(), [1.0], [1.0], ""), ("none", None, None, None, None, None), ("bare", [1, 1, 2], AFFINE.ravel().tolist(), [1.0, rng.normal()], [0.0, float("nan")], "")]
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df):
    return {r["id"]: r for r in df.collect()}


def held(row, name="data"):
    return np.array(row[name]).reshape(row["shape"])


def test_crops_keep_places(volumes):
    got = arrays(grids.centre_cropped(volumes, (2, 3, 4)))
    for name, shape in (("5x6x7", (5, 6, 7)), ("2x9x4", (2, 9, 4)), ("1x1x3", (1, 1, 3))):
        at = [max(0, (n - m) // 2) for n, m in zip(shape, (2, 3, 4), strict=True)]
        want = places(shape, AFFINE)[..., :3].sum(-1)[tuple(slice(a, a + m) for a, m in zip(at, (2, 3, 4), strict=True))]
        r = got[name]
        assert np.allclose(held(r), want, atol=1e-9)
        assert np.allclose(held(r), places(r["shape"], np.array(r["affine"]).reshape(4, 4))[..., :3].sum(-1), atol=1e-6)
    assert all(got[n]["data"] is None and got[n]["shape"] is None for n in ("flat", "short", "none"))


@pytest.mark.parametrize("fill", ["min", "max", "mean", -4.5])
def test_pads_keep_places(volumes, fill):
    r = arrays(grids.padded(volumes, (8, 6, 10), fill))["5x6x7"]
    a = places((5, 6, 7), AFFINE)[..., :3].sum(-1)
    value = {"min": a.min(), "max": a.max(), "mean": a.mean()}.get(fill, fill)
    assert np.allclose(held(r), np.pad(a, [(1, 2), (0, 0), (1, 2)], constant_values=value), atol=1e-9)
    world = places(r["shape"], np.array(r["affine"]).reshape(4, 4))[..., :3].sum(-1)
    assert np.allclose(world[1:6, :, 1:8], a, atol=1e-6)
    with pytest.raises(ValueError, match="fill"):
        grids.padded(volumes, (8, 6, 10), "median")


def test_regions_keep_places(volumes):
    got = arrays(grids.regions_of_interest(volumes, margin=(1, 2, 0)))
    assert set(got) == {"5x6x7", "2x9x4", "1x1x3"}
    for name, start, shape in (("5x6x7", [0, 1, 1], [2, 5, 2]), ("2x9x4", [0, 2, 1], [2, 5, 2]), ("1x1x3", [0, 0, 1], [1, 1, 2])):
        r = got[name]
        assert (r["start"], r["shape"], held(r, "mask").sum()) == (start, shape, 2) and r["note"] == "n"
        assert np.allclose(held(r), places(shape, np.array(r["affine"]).reshape(4, 4))[..., :3].sum(-1), atol=1e-6)
    assert grids.regions_of_interest(volumes.limit(0)).count() == 0
