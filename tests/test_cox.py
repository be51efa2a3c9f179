"""Cox regression with ties, categories and a ridge against a direct likelihood in numpy."""

import math

import numpy as np
import pytest

from tarnlake.operators import survival


def direct(t, d, x, ridge):
    """Coefficients and standard errors by Newton's method on Efron's likelihood, term by term; ridge on standardised columns."""
    s = x.std(axis=0)
    z = (x - x.mean(axis=0)) / s
    b = np.zeros(x.shape[1])
    for _ in range(60):
        w = np.exp(z @ b)
        g, h = np.zeros(len(b)), np.zeros((len(b), len(b)))
        for u in np.unique(t[d == 1]):
            risk, dying = t >= u, (t == u) & (d == 1)
            n = dying.sum()
            g += z[dying].sum(axis=0)
            for k in range(n):
                v = w * risk - k / n * w * dying
                m = v @ z / v.sum()
                g -= m
                h += (z.T * v) @ z / v.sum() - np.outer(m, m)
        h += ridge * len(t) * np.eye(len(b))
        step = np.linalg.solve(h, g - ridge * len(t) * b)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b / s, np.sqrt(np.diag(np.linalg.inv(h))) / s


@pytest.mark.parametrize("ridge", [0.0, 0.1])
def test_against_direct_likelihood(spark, ridge):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2)) * [1.0, 20.0] + [5.0, 1000.0]
    stage = rng.integers(0, 3, 150)
    t = np.ceil(rng.exponential(np.exp(-0.6 * (x[:, 0] - 5) + 0.4 * (stage == 2))) * 8)  # many ties
    d = (rng.random(150) < 0.7).astype(int)
    rows = [(float(a), int(e), float(u), float(v), "abc"[c]) for a, e, (u, v), c in zip(t, d, x, stage, strict=True)] + [(None, 1, 1.0, 1.0, "a"), (3.0, 1, None, 1.0, "a"), (3.0, 1, 1.0, 1.0, None), (3.0, None, 1.0, 1.0, "a")]
    df = spark.createDataFrame(rows, "t double, e int, age double, marker double, stage string").repartition(3)
    got = survival.fit_cox(df, "t", "e", ["age", "marker", "stage"], ["stage"], ridge)
    want, errors = direct(t, d, np.column_stack([x, stage == 1, stage == 2]).astype(float), ridge)
    shown = got.summary.collect()
    assert got.n_complete == 150 and [r["term"] for r in shown] == ["age", "marker", "stage_b", "stage_c"]
    for r, b, e in zip(shown, want, errors, strict=True):
        assert math.isclose(r["coefficient"], b, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["standard_error"], e, rel_tol=1e-6)
        assert math.isclose(r["hazard_ratio"], math.exp(b), rel_tol=1e-6) and r["ci_lower"] < r["hazard_ratio"] < r["ci_upper"] and math.isclose(r["p_value"], math.erfc(abs(b / e) / math.sqrt(2)), rel_tol=1e-4)


def test_wrong_tables(spark):
    df = spark.createDataFrame([(1.0, 1, 2.0)], "t double, e int, x double")
    for wrong in ({"covariates": ["x"]}, {"covariates": ["y"]}, {"covariates": ["x"], "categorical": ["z"]}):
        with pytest.raises(ValueError):
            survival.fit_cox(df, "t", "e", **wrong)
