"""Nested cross-validation, nearest-neighbour information and sequential selection against plain numpy, with the same folds."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions.ordered import order_statistics
from tarnlake.operators import folds, information, nested, selector


@pytest.fixture(scope="module")
def cohort(spark):
    """60 subjects, some with two rows; a signal, a copy, noise, a missing-value column and a constant."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        y = int(rng.random() < 0.4)
        for _ in range(1 + i % 2):
            s = y + rng.normal(0, 0.8)
            rows.append((f"p{i:03d}", y, float(s), float(s + rng.normal(0, 0.3)), float(rng.normal()), float(rng.normal()) if rng.random() > 0.15 else None, 3.0))
    return rows, spark.createDataFrame(rows, "patient_id string, label int, signal double, copy double, noise double, gaps double, flat double")


NAMES = ["signal", "copy", "noise", "gaps", "flat"]


def newton(z, y, w, l2):
    """Intercept and weights of an L2 logistic model, by Newton steps with halving."""
    x = np.column_stack([np.ones(len(z)), z])
    reg = np.diag([0.0] + [l2] * z.shape[1])
    loss = lambda b: w @ (np.logaddexp(0, x @ b) - y * (x @ b)) + b @ reg @ b / 2
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + reg, x.T @ (w * (p - y)) + reg @ b)
        t = 1.0
        while loss(b - t * step) > loss(b) + 1e-12 and t > 1e-9:
            t /= 2
        b = b - t * step
        if np.abs(step).max() < 1e-12:
            break
    return b


def area(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


class Set:
    """Medians, scaling and F of a training set."""

    def __init__(self, x, y, most):
        self.fill = np.array([np.median(c[~np.isnan(c)]) for c in x.T])
        z = np.where(np.isnan(x), self.fill, x)
        self.mean, self.std = z.mean(0), z.std(0)
        f = []
        for c in z.T:
            groups = [c[y == k] for k in (0, 1)]
            within = sum(((g - g.mean()) ** 2).sum() for g in groups)
            between = sum(len(g) * (g.mean() - c.mean()) ** 2 for g in groups)
            f.append(-np.inf if c.std() == 0 else between / (within / (len(c) - 2)))
        self.columns = np.sort(np.argsort(-np.array(f), kind="stable")[:most])
        self.weights = np.array([len(y) / (2 * (y == 0).sum()), len(y) / (2 * (y == 1).sum())])

    def matrix(self, x):
        z = (np.where(np.isnan(x), self.fill, x) - self.mean) / np.where(self.std > 0, self.std, 1.0)
        return z[:, self.columns]


@pytest.fixture(scope="module")
def dealt(spark, cohort):
    subjects = folds.subjects_of(cohort[1], "patient_id", "label")
    return {r["subject"]: (r["fold"], r["cells"]) for r in folds.nested_folds(subjects, 4, 3, 42).collect()}


def test_folds(spark, cohort, dealt):
    labels = {r[0]: r[1] for r in cohort[0]}
    for y in (0, 1):
        sizes = [sum(f == k and labels[p] == y for p, (f, _) in dealt.items()) for k in range(1, 5)]
        assert max(sizes) - min(sizes) <= 1
        for outer in range(4):
            inner = [sum(c[outer] == k and labels[p] == y for p, (_, c) in dealt.items()) for k in range(3)]
            assert max(inner) - min(inner) <= 1
    assert all((c[f - 1] == -1) and c.count(-1) == 1 for f, c in dealt.values())
    again = folds.nested_folds(folds.subjects_of(cohort[1].repartition(7), "patient_id", "label"), 4, 3, 42)
    assert {r["subject"]: (r["fold"], r["cells"]) for r in again.collect()} == dealt
    other = folds.stratified_folds(folds.subjects_of(cohort[1], "patient_id", "label"), 4, 43)
    assert {r["subject"]: r["fold"] for r in other.collect()} != {p: f for p, (f, _) in dealt.items()}
    for wrong in ([("a", 0), ("a", 1)], [(None, 0)], [("a", None)]):
        with pytest.raises(ValueError):
            folds.subjects_of(spark.createDataFrame(wrong, "patient_id string, label int"), "patient_id", "label")


def test_nested_against_numpy(cohort, dealt):
    rows, df = cohort
    grid = [0.01, 1.0, 100.0]
    got = nested.nested_cross_validated(df.withColumn("row", F.monotonically_increasing_id()), "label", features=NAMES, outer=4, inner=3, n_features=2, grid={"C": grid}, keys=["patient_id", "signal"])
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
    y, fold, cells = np.array([r[1] for r in rows]), np.array([dealt[r[0]][0] for r in rows]), np.array([dealt[r[0]][1] for r in rows])
    report = {r["fold"]: r for r in got.folds.collect()}
    found = {(r["patient_id"], r["signal"]): r for r in got.predictions.collect()}
    shown = {(r["fold"], r["inner"], r["params"]): r["score"] for r in got.grid.collect()}
    assert len(found) == len(rows)
    for f in range(1, 5):
        scores = np.zeros((3, len(grid)))
        for i in range(3):
            train, test = (cells[:, f - 1] != -1) & (cells[:, f - 1] != i), cells[:, f - 1] == i
            own = Set(x[train], y[train], 2)
            for g, c in enumerate(grid):
                b = newton(own.matrix(x[train]), y[train], own.weights[y[train]], 1 / c)
                scores[i, g] = area(y[test], b[0] + own.matrix(x[test]) @ b[1:])
                assert math.isclose(shown[f, i, json.dumps({"C": c})], scores[i, g], abs_tol=1e-9)
        best = int(scores.mean(axis=0).argmax())
        train = fold != f
        own = Set(x[train], y[train], 2)
        b = newton(own.matrix(x[train]), y[train], own.weights[y[train]], 1 / grid[best])
        assert json.loads(report[f]["best_params"]) == {"C": grid[best]} and report[f]["selected_features"] == [NAMES[c] for c in own.columns]
        assert report[f]["n_test_subjects"] == len({r[0] for r, t in zip(rows, train, strict=True) if not t}) and report[f]["n_train_subjects"] + report[f]["n_test_subjects"] == 60
        s = 1 / (1 + np.exp(-(b[0] + own.matrix(x[~train]) @ b[1:])))
        for k, v in zip(np.flatnonzero(~train), s, strict=True):
            r = found[rows[k][0], rows[k][2]]
            assert r["fold"] == f and r["y_true"] == y[k] and abs(r["y_score"] - v) < 1e-6 and r["y_pred"] == int(v > 0.5)
        assert math.isclose(report[f]["auc"], area(y[~train], s), abs_tol=1e-9)


def test_other_kinds_and_selections(cohort):
    _, df = cohort
    for kw in ({"kind": "naive_bayes"}, {"selection": "l1"}, {"kind": "random_forest", "grid": {"max_depth": [3]}, "outer": 2, "inner": 2}):
        got = nested.nested_cross_validated(df, "label", features=NAMES[:4], n_features=2, **{"outer": 3, "inner": 2, **kw})
        assert got.predictions.count() == 90 and all(0.5 < r["auc"] <= 1 for r in got.folds.collect())
        assert got.selected.filter("feature in ('signal', 'copy')").count() > 0
    for wrong in ({"kind": "logistic_regression", "task": "regression"}, {"outer": 1}, {"selection": "other"}, {"features": ["absent"]}):
        with pytest.raises(ValueError):
            nested.nested_cross_validated(df, "label", **{"features": NAMES, **wrong})


def test_sequence_inside_each_training_set(cohort, spark):
    rows = spark.createDataFrame([(float(r[1]), [r[2], r[4], r[5]], [i % 2], r[0]) for i, r in enumerate(cohort[0])], "y double, x array<double>, cells array<int>, subject string")
    found = nested._chosen_columns(rows, None, 1, 1, "sequence", 2, ["signal", "noise", "gaps"], "classification", 42)
    assert set(found) == {(0, -1), (0, 0)} and all(0 in c for c in found.values())


def test_regression_by_subject(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "patient_id int, y double, a double, b double, c double")
    got = nested.nested_cross_validated(df, "y", kind="linear_regression", task="regression", outer=4, inner=2, n_features=2)
    assert {tuple(r["selected_features"]) for r in got.folds.collect()} == {("a", "b")} and min(r["r2"] for r in got.folds.collect()) > 0.98
    for r in got.predictions.collect():
        train = np.array([q["fold"] for q in sorted(got.predictions.collect(), key=lambda q: q["patient_id"])]) != r["fold"]
        w = np.linalg.lstsq(np.column_stack([np.ones(train.sum()), x[train, :2]]), y[train], rcond=None)[0]
        assert abs(r["y_score"] - (w[0] + x[r["patient_id"], :2] @ w[1:])) < 1e-8
        break


def test_grids():
    assert len(nested.parameter_grid("random_forest")) == 9 and nested.parameter_grid("logistic_regression")[0] == {"C": 0.01}
    assert len(nested.parameter_grid("logistic_regression", "expanded")) == 10
    with pytest.raises(ValueError):
        nested.parameter_grid("none")


def test_order_statistics(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", None) for v in np.round(rng.normal(size=101 if g else 40), 1)] + [("c", 2.0)] * 300 + [("d", None)]
    got = {(r["g"], r["share"]): r["quantile"] for r in order_statistics(spark.createDataFrame(rows, "g string, v double"), "v", [0.25, 0.5, 0.9], ["g"]).collect()}
    for g in ("a", None, "c"):
        for s in (0.25, 0.5, 0.9):
            assert math.isclose(got[g, s], np.quantile([v for k, v in rows if k == g], s), abs_tol=1e-12)
    assert len(got) == 9


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, int(n)))


def plain_information(v, c, k=3):
    sizes = {u: (c == u).sum() for u in set(c)}
    keep = np.array([sizes[u] > 1 for u in c])
    v, c = v[keep], c[keep]
    total = []
    for i in range(len(v)):
        own = np.sort(np.abs(np.delete(v, i)[np.delete(c, i) == c[i]] - v[i]))
        kk = min(k, len(own))
        r = own[kk - 1]
        m = (np.abs(v - v[i]) < r).sum() if r > 0 else (v == v[i]).sum()
        total.append(psi(kk) - psi(len(own) + 1) - psi(m))
    return max(0.0, psi(len(v)) + np.mean(total))


@pytest.mark.parametrize("ranges", [3, 64])
def test_information_against_all_pairs(spark, ranges):
    rng = np.random.default_rng(9)
    c = rng.integers(0, 4, 300)
    c[0] = 9  # a class of one
    table = {"shifted": c + rng.normal(size=300), "noise": rng.normal(size=300), "ties": rng.integers(0, 12, 300).astype(float), "one": np.full(300, 5.0), "hot": np.where(rng.random(300) < 0.4, 0.0, rng.normal(size=300))}
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(c, zip(*table.values(), strict=True), strict=True)], "k int, " + ", ".join(f"{n} double" for n in table))
    got = {r["feature"]: r for r in information.class_information(df, "k", list(table), ranges=ranges).collect()}
    for n, v in table.items():
        assert abs(got[n]["information"] - plain_information(v, c)) < 1e-6 and got[n]["n"] == 299, n


def test_exact_tail():
    for a, b in ((3, 4), (5, 2), (1, 6)):
        us = [sum(1 for i in combo for j in set(range(a + b)) - set(combo) if i > j) for combo in itertools.combinations(range(a + b), a)]
        for u in range(a * b + 1):
            assert math.isclose(selector.exact_tail(u, a, b), np.mean([x >= u for x in us]))
    assert math.isclose(selector.spearman_p(12, 0.6), 0.0391, abs_tol=2e-4)
    assert math.isclose(selector.incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-10)


def test_univariate(spark):
    rng = np.random.default_rng(4)
    y = np.array([0] * 30 + [1] * 25)
    v = np.round(y * 0.5 + rng.normal(size=55), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, v, strict=True)], "y int, v double")
    got = selector.univariate_tests(df, "y", ["v"]).first()
    u = sum((a > b) + (a == b) / 2 for a in v[y == 1] for b in v[y == 0])
    ties = sum(n**3 - n for n in np.unique(v, return_counts=True)[1])
    z = (max(u, 750 - u) - 375 - 0.5) / math.sqrt(750 / 12 * (56 - ties / (55 * 54)))
    assert got["statistic"] == u and math.isclose(got["p_value"], math.erfc(z / math.sqrt(2)))


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(12)
    y = np.array([0] * 30 + [1] * 30)
    rows = [(i, int(k), float(k + rng.normal(0, 0.2)), float(k + rng.normal(0, 0.2)), float(rng.normal()), float(rng.normal())) for i, k in enumerate(y)]
    return spark.createDataFrame(rows, "id int, label int, signal double, signal_copy double, noise_1 double, noise_2 double")


def test_signal_survives(marked):
    settings = selector.Settings(p_threshold=0.1, correlation=0.8, most_features=2, folds=3)
    got = selector.fit(marked, "label", ["signal", "signal_copy", "noise_1", "noise_2"], "id", settings)
    assert "signal" in got.stages["univariate"] and "noise_1" not in got.selected and got.selected
    runs = selector.repeated(marked, "label", ["signal", "signal_copy", "noise_1", "noise_2"], "id", [100, 101, 102], settings)
    assert [r.seed for r in runs] == [100, 101, 102] and all("signal" in r.stages["univariate"] for r in runs)
    assert selector.as_table(marked, runs).filter("stage = 'l1'").groupBy("seed").count().count() == 3


def lasso(z, y, w, l1, logistic):
    """Proximal gradient to the end."""
    x = np.column_stack([np.ones(len(z)), z])
    size = 1 / np.linalg.eigvalsh((x.T * w) @ x / (4 if logistic else 1)).max()
    b = np.zeros(x.shape[1])
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-x @ b)) if logistic else x @ b
        new = b - size * (x.T @ (w * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * l1, 0)
        if np.abs(new - b).max() < 1e-12:
            break
        b = new
    return b


def test_l1_weights(spark, marked):
    from tarnlake.operators import shared_fits as s

    data = np.array([r[1:] for r in marked.orderBy("id").collect()], dtype=float)
    y, x = data[:, 0], data[:, 1:]
    rows = spark.createDataFrame([(float(a), [float(v) for v in b], [i % 3]) for i, (a, b) in enumerate(zip(y, x, strict=True))], "y double, x array<double>, cells array<int>")
    ready = s.prepared(rows, 1, 3, 4, True)
    of = ready.of(0, 1, np.arange(4))
    got = s.fit_all(rows, [s.Penalised(of, 0.0, 2.0), s.Penalised(of, 0.0, 30.0), s.Penalised(of, 0.0, 3.0, linear=True)])
    train = np.arange(60) % 3 != 1
    z = (x - x[train].mean(0)) / x[train].std(0)
    for b, l1, logistic in zip(got, (2.0, 30.0, 3.0), (True, True, False), strict=True):
        want = lasso(z[train], y[train], np.ones(train.sum()), l1, logistic)
        assert np.abs(b - want).max() < 1e-5
    assert not got[1][1:].any()


def test_lasso_path_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    y = 3 * x[:, 1] + 0.3 * rng.normal(size=90)
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, y double, " + ", ".join(f"f{i} double" for i in range(5)))
    got = selector.fit(df, "y", [f"f{i}" for i in range(5)], "id", selector.Settings(task="regression", p_threshold=None, correlation=None, most_features=3))
    assert "f1" in got.selected and 2.7 < got.coefficients["f1"] / x[:, 1].std() < 3.2
