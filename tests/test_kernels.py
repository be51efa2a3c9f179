import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import inference, kernels
from tarnlake.plans.workflow import run_workflow
from tarnlake.sources import images
from tarnlake.sources.tables import as_table, save_table
from tarnlake.streaming import reports


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for start in map(tuple, np.argwhere(mask > 0)):
        if out[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            p = todo.pop()
            if all(0 <= x < s for x, s in zip(p, mask.shape, strict=True)) and mask[p] > 0 and not out[p]:
                out[p] = n
                todo += [tuple(np.add(p, d)) for d in np.vstack([np.eye(mask.ndim, dtype=int), -np.eye(mask.ndim, dtype=int)])]
    return out


def test_components_against_flood():
    rng = np.random.default_rng(1)
    for shape in ((9, 11), (5, 6, 7), (1, 1)):
        for share in (0.0, 0.3, 0.6, 1.0):
            m = (rng.random(shape) < share).astype(float)
            a, b = kernels.component_labels(m), flood(m)
            assert len({*zip(a.ravel().tolist(), b.ravel().tolist(), strict=True)}) == len(np.unique(b)) == len(np.unique(a))


def test_masks():
    m = np.zeros((9, 9))
    m[2:7, 2:7] = 1
    m[4, 4] = 0
    assert kernels.filled_holes(m)[4, 4] == 1 and kernels.filled_holes(m).sum() == 25
    m[0, 0] = 1
    assert kernels.largest_component(m).sum() == 24 and kernels.without_small(m, 2).sum() == 24 and kernels.opened(m)[0, 0] == 0
    assert kernels.surface_distance(m, m) == 0 and kernels.surface_distance(m, m * 0) is None
    a, b = np.zeros((1, 9)), np.zeros((1, 9))
    a[0, 1] = b[0, 6] = 1
    assert kernels.surface_distance(a, b, [1.0, 2.0]) == 10.0


def test_filters():
    a = np.arange(12.0).reshape(3, 4)
    assert kernels.resampled(a, (5, 7))[::2, ::2].tolist() == a.tolist()
    assert kernels.fitted(a, (5, 2)).tolist() == [[0, 0], [1, 2], [5, 6], [9, 10], [0, 0]]
    assert kernels.otsu(np.array([0.0] * 50 + [10.0] * 50)) < 10 and kernels.median_filtered(a)[1, 1] == np.median(a[:3, :3])
    assert np.allclose(kernels.gaussian_filtered(np.ones((4, 4))), 1) and kernels.equalised(a).max() == 1 and not kernels.mad_normalised(np.ones(3)).any()
    assert abs(kernels.similarity_index(a, a) - 1) < 1e-12


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(24, dtype=float).reshape(2, 3, 4)
    affine = np.diag([1.0, 2.0, 3.0, 1.0])
    (tmp_path / "a.nii.gz").write_bytes(images.encode_nifti(data, affine, [1.0, 2.0, 3.0]))
    (tmp_path / "b.nii").write_bytes(b"broken")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.read_volumes(spark, str(tmp_path)).collect()}
    assert rows["a.nii.gz"]["shape"] == [2, 3, 4] and rows["a.nii.gz"]["data"] == data.ravel().tolist() and rows["a.nii.gz"]["affine"] == affine.ravel().tolist()
    assert rows["b.nii"]["error"] and rows["b.nii"]["data"] is None
    files = images.listing(spark, str(tmp_path), hashes=True)
    assert {r["suffix"] for r in images.manifest(files).collect()} == {".nii.gz", ".nii", None}
    assert {r["name"]: r["present"] for r in images.structure_report(files, ["b.nii", "c.nii"]).collect()} == {"b.nii": True, "c.nii": False}
    assert {r["suffix"]: r["n_failed"] for r in images.batch_report(images.read_volumes(spark, str(tmp_path))).collect()} == {".nii.gz": 0, ".nii": 1, None: 1}


@pytest.mark.parametrize("partitions", [1, 7])
def test_replicates_are_weighted_aucs(spark, monkeypatch, partitions):
    """Ties, also of a third of the rows over several tasks, null scores, and slices of a few rows, against all pairs."""
    monkeypatch.setattr(inference, "CELLS", 60)
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.random() < 0.4), None if i % 50 == 0 else 0.5 if i % 3 == 0 else float(rng.integers(0, 40)) / 40) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y double, s double").dropna()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["replicate"]: r["auc"] for r in inference._replicate_aucs(df, "id", "s", 9, 42).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = df.select("y", "s", F.xxhash64("id").alias("h")).toPandas()
    w, y, s = inference._weights(own["h"].to_numpy().view(np.uint64), 9, 42), own["y"].to_numpy(), own["s"].to_numpy()
    assert sorted(got) == list(range(-1, 9)) and 0.8 < w[:, 1:].mean() < 1.2
    better = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    for j in range(10):
        p, q = w[y == 1, j], w[y == 0, j]
        assert abs(got[j - 1] - p @ better @ q / (p.sum() * q.sum())) < 1e-9
    assert inference.bootstrap_auc(df.filter("y = 1"), "id", "y", "s", n=3).first()["n_replicates"] == 0
    assert inference.bootstrap_auc(df.filter("id < 0"), "id", "y", "s", n=3).first()["auc"] is None


def test_bootstrap_and_harmonisation(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(i, int(v), float(v + rng.normal()), float(rng.normal())) for i, v in enumerate(y)], "id int, y int, s double, t double")
    r = inference.bootstrap_auc(df, "id", "y", "s", n=60).first()
    pos, neg = (np.array([x["s"] for x in df.filter(f"y = {v}").collect()]) for v in (1, 0))
    assert abs(r["auc"] - (pos[:, None] > neg[None, :]).mean()) < 1e-9 and r["low"] < r["auc"] < r["high"] and r["n_replicates"] == 60
    m = inference.compared_models(df, "id", "y", ["s", "t"], n=60).first()
    assert m["low"] > 0 and m["p_value"] == 0
    rows = [(i, b, float(rng.normal() * k + s)) for i in range(200) for b, k, s in (("a", 1, 0), ("b", 3, 5))]
    wide = spark.createDataFrame([(*r, r[2] * 2 + rng.normal()) for r in rows], "id int, b string, f double, g double")
    out = inference.harmonised(wide, ["id"], "b", ["f", "g"]).groupBy("b", "feature").agg(F.avg("adjusted").alias("m"), F.stddev("adjusted").alias("s")).collect()
    f = {r["b"]: (r["m"], r["s"]) for r in out if r["feature"] == "f"}
    assert abs(f["a"][0] - f["b"][0]) < 0.5 and abs(f["a"][1] - f["b"][1]) < 0.5


def test_workflow_reports_each_stage(spark, tmp_path):
    save_table(spark.createDataFrame([("p1", 1.0), ("p2", float("nan"))], "patient_id string, x double"), str(tmp_path / "a.csv"))
    save_table(spark.createDataFrame([("p1", 3.0)], "patient_id string, y double"), str(tmp_path / "b.parquet"))
    assert as_table(spark, str(tmp_path / "a.csv")).filter("x is null").count() == 1
    config = {"output_dir": str(tmp_path / "out"), "fusion": {"tables": {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.parquet")}, "how": "left"}, "icc": {"table": "/nowhere.parquet", "repeat": "r", "features": ["x"]}, "cox": {"enabled": False}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    got = {r["stage"]: (r["status"], r["n_rows"]) for r in run_workflow(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"fusion": ("done", 2), "icc": ("failed", None)}
    with pytest.raises(ValueError, match="unknown stages"):
        run_workflow(spark, {"output_dir": "x", "typo": {}})


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "ok", "2024-01-01 00:10:00"), ("b", "bad", "2024-01-01 00:20:00"), ("a", "ok", "2024-01-01 00:30:00")], "k string, status string, t string").write.json(str(tmp_path / "in"))
    records = reports.arriving(spark, str(tmp_path / "in"), "k string, status string, t timestamp")
    reports.run_available(reports.once_per_key(records, "k", "t"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = reports.status_counts(records, "status").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["status"]: r["n"] for r in spark.table("counts").collect()} == {"ok": 2, "bad": 1}
