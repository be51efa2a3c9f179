"""2-D or 3-D by a plain numpy version; odd slices."""

import numpy as np
import pytest

from tarnlake.operators import dimension

SCHEMA = "volume string, z int, pixels array<double>, gap double, mean string"


def plain(a, gap, least=30, ratio=0.1):
    """a: slices x pixels."""
    n, held = len(a), []
    if n > 1:
        at = np.linspace(0, n - 1, max(2, int(n * ratio)), dtype=int)
        for i, j in zip(at, at[1:]):  # noqa: B905
            if np.std(a[i]) > 0 and np.std(a[j]) > 0:
                held.append(1 - abs(np.corrcoef(a[i], a[j])[0, 1]))
    differ = n > 1 and (not held or np.mean(held) >= 0.1)
    return (n >= least) + (gap <= 5) + differ >= 2, len(held), np.mean(held) if held else None


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=36)
    made = {
        "one": (rng.normal(size=(1, 36)), 1.0), "short": (rng.normal(size=(7, 36)), 9.0), "long": (rng.normal(size=(73, 36)), 1.0), "alike": (base + rng.normal(size=(45, 36)) * 0.01, 8.0),
        "alike_short": (base + rng.normal(size=(12, 36)) * 0.01, 2.0), "flat": (np.ones((31, 36)) * 3, 9.0), "skewed": (np.exp(rng.normal(size=(33, 36)) * 2), 4.0), "odd": (np.where(rng.random((50, 36)) < 0.02, np.nan, rng.normal(size=(50, 36))), 2.0),
    }
    rows = [(k, z, [float(x) for x in s], gap, "x") for k, (a, gap) in made.items() for z, s in enumerate(a)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(5)  # repeated rows count once
    got = {r["volume"]: r for r in dimension.dimension_analysis(df, "volume", "z", "pixels", "gap").collect()}
    assert set(got) == set(made)
    for k, (a, gap) in made.items():
        is_3d, n, variation = plain(a, gap)
        r = got[k]
        assert (r["is_3d"], r["n_slices"], r["n_pairs"]) == (is_3d, len(a), n), k
        assert variation is None and r["variation"] is None or r["variation"] == pytest.approx(variation, abs=1e-9)
        flat = a[~np.isnan(a)]
        assert r["std"] == pytest.approx(flat.std(), abs=1e-9) and r["mean"] == pytest.approx(flat.mean())
        if flat.std() > 0:
            assert r["skewness"] == pytest.approx((((flat - flat.mean()) / flat.std()) ** 3).mean(), abs=1e-9)
        stds = [np.nanstd(s) for s in a]
        if k != "flat":
            assert r["high_variance_slices"] == sum(s > np.mean(stds) + np.std(stds) for s in stds if len(a) > 1)
    assert got["long"]["models"] == "3d_unet,3d_vnet,cascade_3d" and got["alike"]["is_3d"] is False and got["skewed"]["preparation"] == "log_transform,interpolation"


def test_odd_slices_and_batches(spark):
    rows = [(None, 1, [1.0], 1.0, ""), ("a", None, [1.0], 1.0, ""), ("a", 1, None, None, ""), ("a", 2, [], None, ""), ("a", 3, [1.0, None], None, ""), ("b", 1, None, 2.0, "")]
    got = {r["volume"]: r for r in dimension.dimension_analysis(spark.createDataFrame(rows, SCHEMA), "volume", "z", "pixels", "gap").collect()}
    assert set(got) == {"a", "b"} and got["a"]["n_slices"] == 3 and got["a"]["is_3d"] is False and got["a"]["reasons"] == "variation" and got["b"]["mean"] is None
    empty = dimension.dimension_analysis(spark.createDataFrame([], SCHEMA), "volume", "z", "pixels", "gap")
    assert empty.count() == 0 and dimension.batch_recommendation(empty).count() == 0
    three = spark.createDataFrame([(True, "high"), (False, "medium")], "is_3d boolean, confidence string")
    assert dimension.batch_recommendation(three).first().asDict() == {"n_volumes": 2, "n_3d": 1, "n_high": 1, "approach": "2D", "share": 0.5, "mixed": True}
    with pytest.raises(ValueError, match="ratio"):
        dimension.dimension_analysis(empty, "volume", "z", "pixels", "gap", ratio=0)
