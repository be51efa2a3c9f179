"""Survival tables, Cox regression and treatment effects."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import clipped, number, over, require_columns
from tarnlake.functions.held import held
from tarnlake.functions.ordered import range_cuts, running_totals

#: Half the width of a 95 % interval in standard errors.
Z95 = 1.959963984540054


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Per group (null is one) and time: at_risk, events, survival, and n_patients; each group begins at time 0 with survival 1. Windows run over distinct times."""
    at = df.groupBy(F.col(group).alias("group"), number(duration).alias("time")).agg(F.sum(F.col(event).cast("int")).alias("events"), F.count(F.lit(1)).alias("leaving"))
    whole = Window.partitionBy("group")
    at = at.withColumn("at_risk", F.sum("leaving").over(whole.orderBy("time").rowsBetween(0, Window.unboundedFollowing))).withColumn("n_patients", F.sum("leaving").over(whole))
    step = F.product(1 - F.col("events") / F.col("at_risk")).over(whole.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    at = at.select("group", "time", "at_risk", "events", step.alias("survival"), "n_patients")
    start = at.filter("time > 0").groupBy("group").agg(F.max("n_patients").alias("n_patients"), F.min("time")).join(at.filter("time = 0").select(F.col("group").alias("g")).distinct(), F.col("group").eqNullSafe(F.col("g")), "left_anti")
    start = start.select("group", F.lit(0.0).alias("time"), F.col("n_patients").alias("at_risk"), F.lit(0).cast("long").alias("events"), F.lit(1.0).alias("survival"), "n_patients")
    return at.unionByName(start)


def number_at_risk(df: DataFrame, duration: str, group: str, times: list[float]) -> DataFrame:
    """Per group and time: subjects with that duration or more, 0 too. One aggregate; rows are not multiplied."""
    one = df.groupBy(F.col(group).alias("group")).agg(*[F.count_if(number(duration) >= t).alias(f"n{i}") for i, t in enumerate(times)])
    return one.select("group", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.col(f"n{i}").alias("at_risk")) for i, t in enumerate(times)])))


class CoxFit(NamedTuple):
    """summary: term, coefficient, hazard_ratio, standard_error, ci_lower, ci_upper (of the hazard ratio, 95 %), z, p_value; complete rows; partial log-likelihood; Newton steps."""

    summary: DataFrame
    n_complete: int
    log_likelihood: float
    steps: int


def _cox_pass(rows: DataFrame, beta: np.ndarray, cuts: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information at beta, with Efron's ties, as one row of sums over distinct times.

    Risk sets are totals less running totals over ranges of time. Of a time with d deaths, whose risk set has sum R and whose deaths have D, the d terms R - l/d D enter gradient and information through five sums of
    their reciprocals alone, so no matrix is formed for a death."""
    p = len(beta)
    x = [F.col("x")[i] for i in range(p)]
    w = F.exp(sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0)))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    parts = [w, *[w * c for c in x], *[w * x[i] * x[j] for i, j in pairs]]
    died = F.col("d") == 1
    at = rows.groupBy("t").agg(F.sum("d").alias("d"), *[F.sum(c).alias(f"r{i}") for i, c in enumerate(parts)], *[F.sum(F.when(died, c).otherwise(0.0)).alias(f"e{i}") for i, c in enumerate(parts)], *[F.sum(F.when(died, c).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(x)])
    names = [f"r{i}" for i in range(len(parts))]
    totals = at.agg(*[F.sum(n).alias(f"all_{n}") for n in names])
    risk = running_totals(at, "t", names, cuts=cuts).crossJoin(F.broadcast(totals)).filter("d > 0")
    R = [F.col(f"all_{n}") - F.col(f"below_{n}") for n in names]
    risk = risk.select("d", *[r.alias(f"R{i}") for i, r in enumerate(R)], *[f"e{i}" for i in range(len(parts))], *[f"s{i}" for i in range(p)])
    R, D = [F.col(f"R{i}") for i in range(len(parts))], [F.col(f"e{i}") for i in range(len(parts))]

    def term(a: Column, k: Column) -> Column:
        share = k / F.col("d")
        inverse = 1 / (R[0] - share * D[0])
        step = {"a0": inverse, "a1": share * inverse, "b0": inverse * inverse, "b1": share * inverse * inverse, "b2": share * share * inverse * inverse, "ln": -F.ln(inverse)}
        return F.struct(*[(a[n] + v).alias(n) for n, v in step.items()])

    sums = F.aggregate(F.sequence(F.lit(0), F.col("d").cast("int") - 1), F.struct(*[F.lit(0.0).alias(n) for n in ("a0", "a1", "b0", "b1", "b2", "ln")]), term)
    risk = risk.withColumn("q", sums)
    q = lambda n: F.col(f"q.{n}")
    gradient = [F.sum(F.col(f"s{i}") - R[1 + i] * q("a0") + D[1 + i] * q("a1")) for i in range(p)]
    curve = []
    for k, (i, j) in enumerate(pairs):
        ri, rj, di, dj = R[1 + i], R[1 + j], D[1 + i], D[1 + j]
        curve.append(F.sum(R[1 + p + k] * q("a0") - D[1 + p + k] * q("a1") - ri * rj * q("b0") + (ri * dj + rj * di) * q("b1") - di * dj * q("b2")))
    likelihood = F.sum(sum((float(b) * F.col(f"s{i}") for i, b in enumerate(beta)), F.lit(0.0)) - q("ln"))
    row = [0.0 if v is None else float(v) for v in risk.agg(likelihood, *gradient, *curve).first()]
    info = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :], strict=True):
        info[i, j] = info[j, i] = v
    return row[0], np.array(row[1 : 1 + p]), info


def dummies(df: DataFrame, column: str, most: int = 1000) -> list[tuple[str, Column]]:
    """(name, 0 or 1) of every value but the first in order; null is the value of none. More than `most` values are an error."""
    values = sorted(r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return [(f"{column}_{v}", (F.col(column) == v).cast("double")) for v in values[1:]]


def fit_cox(df: DataFrame, duration: str, event: str, covariates: list[str], categorical: list[str] | None = None, penalizer: float = 0.0, rounds: int = 50, tolerance: float = 1e-9) -> CoxFit:
    """Cox proportional hazards over complete rows: Newton's method, Efron's ties; see _cox_pass.

    categorical covariates enter as 0 or 1 for each value but the first. penalizer: ridge, n penalizer / 2 times the squared coefficients of covariates over their deviation. Steps that lessen the likelihood are halved."""
    require_columns(df, [duration, event, *covariates])
    if wrong := set(categorical or []) - set(covariates):
        raise ValueError(f"categorical covariates that aren't covariates: {sorted(wrong)}")
    complete = df.filter(number(duration).isNotNull() & F.col(event).isNotNull()).dropna(subset=covariates)
    named: list[tuple[str, Column]] = []
    for c in covariates:
        named += dummies(complete, c) if c in (categorical or []) else [(c, number(c))]
    raw = complete.select(number(duration).alias("t"), F.col(event).cast("int").alias("d"), F.array(*[c for _, c in named]).alias("x")).filter(F.forall("x", lambda v: v.isNotNull()))
    p = len(named)
    first = raw.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(p)], *[F.stddev_pop(F.col("x")[i]) for i in range(p)]).first()
    n = first[0]
    if n < 5:
        raise ValueError("fewer than 5 complete rows")
    mean, scale = np.array(first[1 : 1 + p], float), np.array([s or 1.0 for s in first[1 + p :]], float)
    rows = held(raw.select("t", "d", F.array(*[(F.col("x")[i] - float(mean[i])) / float(scale[i]) for i in range(p)]).alias("x")))
    cuts = range_cuts(rows, "t")
    beta, kept, best, info, steps = np.zeros(p), np.zeros(p), -np.inf, np.eye(p), 0
    for steps in range(1, rounds + 1):
        likelihood, gradient, here = _cox_pass(rows, beta, cuts)
        value = likelihood - n * penalizer / 2 * beta @ beta
        if value < best - 1e-9 * max(1.0, abs(best)):
            beta = (beta + kept) / 2
            continue
        kept, best, info = beta, value, here + n * penalizer * np.eye(p)
        move = np.linalg.lstsq(info, gradient - n * penalizer * beta, rcond=None)[0]
        if np.abs(move).max() < tolerance:
            break
        beta = beta + move
    errors = np.sqrt(np.diag(np.linalg.pinv(info))) / scale
    table = []
    for (name, _), b, e in zip(named, kept / scale, errors, strict=True):
        z = b / e if e else float("nan")
        table.append((name, float(b), math.exp(b), float(e), math.exp(b - Z95 * e), math.exp(b + Z95 * e), float(z), math.erfc(abs(z) / math.sqrt(2))))
    summary = df.sparkSession.createDataFrame(table, "term string, coefficient double, hazard_ratio double, standard_error double, ci_lower double, ci_upper double, z double, p_value double")
    return CoxFit(summary, n, best + n * penalizer / 2 * float(kept @ kept), steps)


def cox(df: DataFrame, duration: str, event: str, covariates: list[str]) -> DataFrame:
    """fit_cox without a penalty: covariate, coefficient, standard_error."""
    return fit_cox(df, duration, event, covariates).summary.select(F.col("term").alias("covariate"), "coefficient", "standard_error")


def treatment_weights(df: DataFrame, treatment: str, propensity: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with inverse-probability weights for the average effect (ate) and that on the treated (att)."""
    t, e = number(treatment), clipped(number(propensity), low, high)
    return df.withColumns({"weight_ate": over(t, e) + over(1 - t, 1 - e), "weight_att": t + over((1 - t) * e, 1 - e)})


def weighted_effect(df: DataFrame, treatment: str, outcome: str, weight: str) -> DataFrame:
    """One row: weighted outcome of either arm and their difference."""
    t, y, w = number(treatment), number(outcome), F.col(weight)
    arm = lambda v: over(F.sum(F.when(t == v, w * y)), F.sum(F.when(t == v, w)))
    return df.agg(F.count(F.lit(1)).alias("n"), arm(1).alias("treated_rate"), arm(0).alias("control_rate")).withColumn("difference", F.col("treated_rate") - F.col("control_rate"))


def interaction_model(df: DataFrame, outcome: str, treatment: str, marker: str) -> DataFrame:
    """Logistic regression with treatment, marker and their product: term, coefficient, standard_error, p_value."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.select(number(outcome).alias("y"), number(treatment).alias("t"), number(marker).alias("m")).dropna().withColumn("tm", F.col("t") * F.col("m"))
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", maxIter=50).fit(VectorAssembler(inputCols=["t", "m", "tm"], outputCol="features").transform(rows))
    s = model.summary
    values = [*zip(model.coefficients.toArray(), s.coefficientStandardErrors, s.pValues, strict=False), (model.intercept, s.coefficientStandardErrors[-1], s.pValues[-1])]
    return df.sparkSession.createDataFrame([(n, float(c), float(e), float(p)) for n, (c, e, p) in zip((treatment, marker, "interaction", "intercept"), values, strict=True)], "term string, coefficient double, standard_error double, p_value double")


def propensity(df: DataFrame, treatment: str, covariates: list[str], name: str = "propensity") -> DataFrame:
    """df with the probability of treatment by logistic regression on the covariates, missing ones at their median."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = [f"__{c}" for c in covariates]
    rows = df.withColumns({**{f"_{c}": number(c) for c in covariates}, "__label": number(treatment)})
    stages = [Imputer(strategy="median", inputCols=[f"_{c}" for c in covariates], outputCols=made), VectorAssembler(inputCols=made, outputCol="__raw"), StandardScaler(withMean=True, inputCol="__raw", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__label", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__q")]
    return Pipeline(stages=stages).fit(rows).transform(rows).select(*df.columns, vector_to_array("__p")[1].alias(name))
