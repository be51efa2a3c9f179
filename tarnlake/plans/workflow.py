"""A configured run over the operators: a dictionary (from JSON) names stages, each of which writes a table and a line of the report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import fusion, models, statistics, survival, validate
from tarnlake.sources.tables import as_table, save_table

Stage = Callable[[SparkSession, dict], DataFrame]


def _t(spark: SparkSession, c: dict, key: str = "table") -> DataFrame:
    return as_table(spark, c[key])


STAGES: dict[str, Stage] = {
    "fusion": lambda s, c: fusion.fuse({k: as_table(s, v) for k, v in c["tables"].items()}, c.get("id_column", "patient_id"), c.get("how", "inner"), c.get("fill")),
    "survival_check": lambda s, c: validate.survival_problems(_t(s, c), c["duration"], c["event"], c.get("id_column", "patient_id")),
    "kaplan_meier": lambda s, c: survival.kaplan_meier(_t(s, c), c["duration"], c["event"], c["group"]),
    "cox": lambda s, c: survival.cox(_t(s, c), c["duration"], c["event"], c["covariates"]),
    "batch_effects": lambda s, c: statistics.batch_effects(_t(s, c), c["batch"], c.get("features")),
    "icc": lambda s, c: statistics.icc(_t(s, c), c.get("id_column", "patient_id"), c["repeat"], c["features"], c.get("kind", "icc2_1")),
    "reader_summary": lambda s, c: statistics.reader_summary(_t(s, c), c.get("id_column", "patient_id"), c["value"], c["cutoff"]),
    "calibration": lambda s, c: statistics.calibration(_t(s, c), c["label"], c["score"], c.get("bins", 10)),
    "decision_curve": lambda s, c: statistics.decision_curve(_t(s, c), c["label"], c["score"], c.get("thresholds", [i / 100 for i in range(1, 100)])),
    "cross_validation": lambda s, c: models.cross_validated(_t(s, c), c["label"], c.get("id_column", "patient_id"), c["features"], c.get("model", "logistic_regression"), c.get("folds", 4), c.get("seed", 42), c.get("keep")),
    "interaction": lambda s, c: survival.interaction_model(_t(s, c), c["outcome"], c["treatment"], c["marker"]),
    "cell_proportions": lambda s, c: statistics.cell_proportions(_t(s, c), c["sample"], c["group"], c["kind"], c.get("target")),
    "stage_size": lambda s, c: validate.stage_size_conflicts(_t(s, c), c["stage"], c["diameter"]),
}


def run_workflow(spark: SparkSession, config: dict | str) -> DataFrame:
    """Runs the enabled sections of a configuration in the order of STAGES; returns stage, status, rows and error.

    config: {"output_dir": ..., "<stage>": {"enabled": true, ...}} or a path to such JSON that Spark can read. A stage that fails is reported and the next one runs."""
    if isinstance(config, str):
        config = json.loads("\n".join(r[0] for r in spark.read.text(config, wholetext=True).collect()))
    report = []
    unknown = sorted(set(config) - set(STAGES) - {"output_dir"})
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    for name, stage in STAGES.items():
        section = config.get(name)
        if not section or not section.get("enabled", True):
            continue
        try:
            path = f"{config['output_dir'].rstrip('/')}/{name}.parquet"
            save_table(stage(spark, section), path, mode="overwrite")
            report.append((name, "done", spark.read.parquet(path).count(), None))
        except Exception as e:  # reported with the stage, so that one bad input doesn't end the others
            report.append((name, "failed", None, f"{type(e).__name__}: {e}"[:500]))
    out = spark.createDataFrame(report, "stage string, status string, n_rows long, error string")
    out.coalesce(1).write.mode("overwrite").json(f"{config['output_dir'].rstrip('/')}/report.json")
    return out


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
