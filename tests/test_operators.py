"""Fixed cases: hand-computed values and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import columns as C
from tarnlake.functions.ordered import with_ranks
from tarnlake.operators import fusion, models, statistics, survival, validate, voxels


def test_icc_of_readings(spark):
    rows = [("p1", "a", 30.0), ("p1", "b", 32.0), ("p2", "a", 60.0), ("p2", "b", 62.0), ("p3", "a", 45.0), ("p3", "b", 47.0), ("p4", "a", 9.0)]
    df = spark.createDataFrame(rows, "patient_id string, reader_id string, v double")
    got = statistics.icc(df, "patient_id", "reader_id", ["v"]).first()
    assert got["n_subjects"] == 3 and abs(got["icc"] - 0.99119) < 1e-4 and got["status"] == "stable"


def test_single_repeat_is_insufficient(spark):
    df = spark.createDataFrame([("p1", "a", 1.0), ("p2", "a", 2.0)], "s string, r string, v double")
    assert statistics.icc(df, "s", "r", ["v"]).first()["status"] == "insufficient_repeats"


def test_auc_and_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.7), (0, 0.3), (1, 0.9), (1, None)], "y int, s double")
    assert statistics.auc(df, F.col("y") == 1, "s").first()["auc"] == 1.0
    tied = spark.createDataFrame([(0, 1.0), (1, 1.0)], "y int, s double")
    assert statistics.auc(tied, F.col("y") == 1, "s").first()["auc"] == 0.5


def test_waterfall_order(spark):
    df = spark.createDataFrame([("p1", 15.0), ("p2", -42.0), ("p3", -10.0), ("p4", None)], "id string, c double")
    assert [r[0] for r in statistics.ordered_changes(df, "id", "c").orderBy("plot_order").collect()] == ["p2", "p3", "p1"]


def test_stability(spark):
    rows = [(r, f) for r, s in enumerate(("ab", "abc", "abd")) for f in s]
    df = spark.createDataFrame(rows, "run int, feature string")
    j = [r["jaccard"] for r in statistics.selection_stability(df, "run", "feature").collect()]
    assert abs(np.mean(j) - 11 / 18) < 1e-9 and min(j) == 0.5 and abs(max(j) - 2 / 3) < 1e-9
    assert {r["feature"] for r in statistics.feature_frequency(df, "run", "feature").filter("consensus").collect()} == {"a", "b"}


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([("L", 3.0, 1), ("L", 6.0, 0), ("H", 9.0, 1), ("H", 12.0, 0)], "g string, t double, e int")
    got = {(r["group"], r["time"]): r["survival"] for r in survival.kaplan_meier(df, "t", "e", "g").collect()}
    assert got == {("L", 0.0): 1.0, ("L", 3.0): 0.5, ("L", 6.0): 0.5, ("H", 0.0): 1.0, ("H", 9.0): 0.5, ("H", 12.0): 0.5}
    assert survival.number_at_risk(df, "t", "g", [0, 6, 12]).count() == 6


def test_cox_matches_direct_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    t = np.round(rng.exponential(np.exp(-0.7 * x)) * 10) + 1
    e = (rng.random(80) < 0.8).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, x, strict=True)], "t double, e int, x double")
    got = survival.cox(df, "t", "e", ["x"]).first()["coefficient"]

    def loss(b):
        out = 0.0
        for u in np.unique(t[e == 1]):
            dead, risk = (t == u) & (e == 1), t >= u
            s, d = np.exp(b * x[risk]).sum(), np.exp(b * x[dead]).sum()
            out += b * x[dead].sum() - sum(np.log(s - j / dead.sum() * d) for j in range(dead.sum()))
        return out

    grid = np.linspace(got - 0.01, got + 0.01, 201)
    assert abs(grid[np.argmax([loss(b) for b in grid])] - got) <= 2e-4


def test_null_keys_meet_and_names_are_prefixed(spark):
    a = spark.createDataFrame([("x", 1.0), (None, 2.0)], "patient_id string, v double")
    b = spark.createDataFrame([("x", 5.0), (None, 6.0), ("y", 7.0)], "patient_id string, b_w double")
    got = {r["patient_id"]: (r["a_v"], r["b_w"]) for r in fusion.fuse({"a": a, "b": b}, how="outer").collect()}
    assert got == {"x": (1.0, 5.0), None: (2.0, 6.0), "y": (None, 7.0)}
    with pytest.raises(ValueError, match="missing columns"):
        fusion.fuse({"a": a.drop("patient_id")})


def test_disjoint(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "id string") for s in ("pq", "qr"))
    with pytest.raises(ValueError, match="q"):
        fusion.assert_disjoint({"a": a, "b": b}, "id")
    fusion.assert_disjoint({"a": a, "b": b.filter("id = 'r'")}, "id")


def test_split_keeps_subjects_together(spark):
    df = fusion.split_by_subject(spark.range(400).selectExpr("id % 40 as p"), "p")
    assert df.groupBy("p").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0


def test_stage_and_size(spark):
    df = spark.createDataFrame([("T1", 2.4), ("t 3", 3.7), ("T2", 3.0), (None, 9.0), ("T1", None)], "t_stage string, tumor_diameter_cm double")
    assert validate.stage_size_conflicts(df).count() == 2


def test_problems_raise(spark):
    df = spark.createDataFrame([("p", 1.0, 1), ("p", -1.0, 2)], "patient_id string, t double, e int")
    with pytest.raises(ValueError, match="repeated_keys"):
        validate.raise_on(validate.survival_problems(df, "t", "e"))


def test_ranks_of_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, 1.0)], "id int, v double")
    assert {r["id"]: r["average_rank"] for r in with_ranks(df, "v").collect()} == {1: 2.5, 2: 2.5, 3: None, 4: 1.0}
    assert with_ranks(df.limit(0), "v").count() == 0


def test_bh_against_loop(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.04, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in statistics.benjamini_hochberg(df, "p").collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    best = 1.0
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        best = min(best, x * len(known) / rank)
        assert abs(got[i] - best) < 1e-12
    assert got[6] is None


def test_images(spark):
    a = [float(x) for x in range(64)]
    df = spark.createDataFrame([(0, a, a)], "id int, a array<double>, b array<double>")
    q = voxels.image_quality(df, "a", "b", ["id"]).first()
    assert q["mse"] == 0 and q["psnr"] == float("inf")
    empty = spark.createDataFrame([(0, [0.0] * 4, [0.0] * 4)], "id int, a array<double>, b array<double>")
    assert voxels.overlap(empty, "a", "b", ["id"]).first()["dice"] == 1.0
    z = voxels.with_normalised(spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [2.0, 2.0])], "id int, a array<double>"), "a", "zscore").orderBy("id").collect()
    assert abs(np.mean(z[0]["normalised"])) < 1e-12 and abs(np.std(z[0]["normalised"]) - 1) < 1e-12 and z[1]["normalised"] == [0.0, 0.0]


def test_names(spark):
    df = spark.createDataFrame([("glcm_contrast",), ("first-order_mean",), ("a<b>.txt",)], "n string")
    got = [r[0] for r in df.select(C.tidy_name(F.col("n"))).collect()]
    assert got[:2] == ["GLCM_Contrast", "Firstorder_Mean"]
    assert df.select(C.safe_filename(F.col("n"))).collect()[2][0] == "a_b_.txt"
    assert spark.sql("select 'd/x.nii.gz' p").select(C.stem(F.col("p"))).first()[0] == "x"


def test_cross_validation_covers_every_row_once(spark):
    rng = np.random.default_rng(7)
    y = np.repeat([0, 1], 20)
    df = spark.createDataFrame([(f"p{i}", int(v), float(v + rng.normal()), float(rng.normal())) for i, v in enumerate(y)], "patient_id string, y int, signal double, noise double")
    out = models.cross_validated(df, "y", "patient_id", ["signal", "noise"], folds=4, keep=1).toPandas()
    assert len(out) == 40 and out.patient_id.nunique() == 40 and out.fold.nunique() == 4


def test_selection_prefers_signal(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, 300)
    rows = [(int(v), float(s := v * 2 + rng.normal()), float(s + rng.normal() * 0.01), float(rng.normal())) for v in y]
    df = spark.createDataFrame(rows, "y int, signal double, copy double, noise double")
    assert models.correlation_filter(df, ["signal", "copy", "noise"]) == ["signal", "noise"]
    assert models.relevance_less_redundancy(df, "y", ["signal", "copy", "noise"], 1).first()["feature"] in ("signal", "copy")
