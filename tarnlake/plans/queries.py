"""The library's own registered queries: each applies an operator to the given tables. ORACLE_SQL has the same results in DuckDB's SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import columns as C
from tarnlake.functions.ordered import order_statistics, with_ranks
from tarnlake.operators import assignment, clustering, dimension, folds, fusion, grids, inference, information, kernels, models, nested, regions, reports, selector, statistics, survival, textures, validate, voxels
from tarnlake.sources import dicom, images, nrrd

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in columns})


# ---------------------------------------------------------------- fusion and cohorts


def _modalities(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("patient_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("peak"))
    return {"clinical": table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_acctbal").alias("balance")), "orders": orders, "events": events}


_FUSED = """
    WITH c AS (SELECT c_custkey AS patient_id, c_acctbal AS clinical_balance FROM customer),
         o AS (SELECT o_custkey AS patient_id, count(*) AS orders_n, round(sum(o_totalprice), 2) AS orders_total FROM orders GROUP BY 1),
         e AS (SELECT user_id AS patient_id, count(*) AS events_n, round(max(value), 4) AS events_peak FROM events GROUP BY 1),
         f AS (SELECT patient_id, clinical_balance, orders_n, orders_total, events_n, events_peak FROM c {how} JOIN o USING (patient_id) {how} JOIN e USING (patient_id))
"""


@query(_FUSED.format(how="LEFT") + """
    SELECT patient_id, coalesce(clinical_balance, median(clinical_balance) OVER ()) AS clinical_balance, coalesce(CAST(orders_n AS DOUBLE), median(orders_n) OVER ()) AS orders_n, round(coalesce(orders_total, median(orders_total) OVER ()), 4) AS orders_total,
           coalesce(CAST(events_n AS DOUBLE), median(events_n) OVER ()) AS events_n, round(coalesce(events_peak, median(events_peak) OVER ()), 6) AS events_peak FROM f
""")
def fusion_left_median(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.fuse(_modalities(spark, d), how="left", fill="median")
    return rounded(rounded(out, "events_peak"), "orders_total", digits=4)


@query(_FUSED.format(how="INNER") + "SELECT patient_id, clinical_balance, CAST(orders_n AS BIGINT) AS orders_n, orders_total, CAST(events_n AS BIGINT) AS events_n, events_peak FROM f")
def fusion_inner(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_modalities(spark, d), how="inner")


@query(_FUSED.format(how="FULL") + "SELECT patient_id, coalesce(clinical_balance, 0) AS clinical_balance, CAST(coalesce(orders_n, 0) AS BIGINT) AS orders_n, coalesce(orders_total, 0) AS orders_total, CAST(coalesce(events_n, 0) AS BIGINT) AS events_n, coalesce(events_peak, 0) AS events_peak FROM f")
def fusion_outer_zero(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_modalities(spark, d), how="outer", fill="zero")


@query(_FUSED.format(how="LEFT") + "SELECT patient_id, clinical_balance, round(coalesce(CAST(events_n AS DOUBLE), avg(events_n) OVER ()), 6) AS events_n, round(coalesce(events_peak, avg(events_peak) OVER ()), 6) AS events_peak FROM f")
def fusion_left_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fusion.fuse(_modalities(spark, d), how="left", fill="mean", drop=("n_x",)), "events_n", "events_peak").select("patient_id", "clinical_balance", "events_n", "events_peak")


def _cohorts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c, o, e = (table(spark, d, t) for t in ("customer", "orders", "events"))
    return {"rich": c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id")), "recent": o.filter("o_orderdate >= '2000-06-01'").select(F.col("o_custkey").alias("id")), "active": e.filter("event_type = 'purchase'").select(F.col("user_id").alias("id"))}


@query("""
    WITH t AS (SELECT c_custkey AS id, 'rich' AS cohort FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT o_custkey, 'recent' FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' UNION ALL SELECT user_id, 'active' FROM events WHERE event_type = 'purchase')
    SELECT id, count(DISTINCT cohort) AS n_cohorts FROM t GROUP BY id HAVING count(DISTINCT cohort) > 1
""")
def cohort_overlap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cohort_overlap(_cohorts(spark, d), "id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def cohort_semi_split(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rows_of(table(spark, d, "orders"), table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def cohort_anti(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rows_of(table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", present=False).select("c_custkey", "c_mktsegment")


@query()
def subject_split(spark: SparkSession, d: str) -> DataFrame:
    return fusion.split_by_subject(table(spark, d, "orders"), "o_custkey").groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_subjects"))


@query("""
    WITH i AS (SELECT doc_id, 'case_' || doc_id AS stem FROM documents),
         f AS (SELECT 'case_' || doc_id || CASE WHEN toxic = 1 THEN '_seg.nii.gz' WHEN quality = 1 THEN '_mask.nii.gz' ELSE '.nii.gz' END AS file FROM labels UNION ALL SELECT 'mask_case_' || doc_id || '.nii.gz' FROM labels WHERE doc_id % 3 = 0),
         m AS (SELECT stem, file, CASE file WHEN stem || '_mask.nii.gz' THEN 1 WHEN stem || '_seg.nii.gz' THEN 2 WHEN 'mask_' || stem || '.nii.gz' THEN 3 ELSE 4 END AS rule FROM i JOIN f ON file IN (stem || '_mask.nii.gz', stem || '_seg.nii.gz', 'mask_' || stem || '.nii.gz', stem || '.nii.gz'))
    SELECT doc_id, stem, (SELECT arg_min(file, rule) FROM m WHERE m.stem = i.stem) AS matched_file, CAST((SELECT min(rule) FROM m WHERE m.stem = i.stem) AS INTEGER) AS rule FROM i
""")
def match_priority(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    case = F.concat(F.lit("case_"), F.col("doc_id").cast("string"))
    files = labels.select(F.concat(case, F.when(F.col("toxic") == 1, "_seg.nii.gz").when(F.col("quality") == 1, "_mask.nii.gz").otherwise(".nii.gz")).alias("file")).unionByName(labels.filter("doc_id % 3 = 0").select(F.concat(F.lit("mask_"), case, F.lit(".nii.gz")).alias("file")))
    return fusion.matched_by_name(table(spark, d, "documents").select("doc_id", case.alias("stem")), files, "stem", "file", ["{}_mask.nii.gz", "{}_seg.nii.gz", "mask_{}.nii.gz", "{}.nii.gz"])


# ---------------------------------------------------------------- validators


def _survival_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", F.datediff(F.col("o_orderdate"), F.lit("1995-01-01")).cast("double").alias("days"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), "o_totalprice")


_SURVIVAL = "WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days, CAST(o_orderstatus = 'F' AS INTEGER) AS event, o_totalprice FROM orders)"


@query(_SURVIVAL + """
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE days IS NULL OR event IS NULL OR o_custkey IS NULL) AS missing_values, count(*) FILTER (WHERE days < 0) AS negative_durations, count(*) FILTER (WHERE event NOT IN (0, 1)) AS bad_events,
           (SELECT count(*) FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM s
""")
def validate_survival(spark: SparkSession, d: str) -> DataFrame:
    return validate.survival_problems(_survival_rows(spark, d), "days", "event", "o_custkey")


@query("""
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_suppkey IS NULL OR l_returnflag IS NULL OR l_orderkey IS NULL OR l_quantity IS NULL) AS missing_values, count(*) FILTER (WHERE l_quantity NOT BETWEEN 0 AND 100) AS out_of_range,
           (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_returnflag, l_suppkey HAVING count(*) > 1)) AS repeated_keys FROM lineitem
""")
def validate_readings(spark: SparkSession, d: str) -> DataFrame:
    return validate.reading_problems(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_suppkey", "l_quantity")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_custkey IS NULL OR c_nationkey IS NULL OR c_mktsegment IS NULL) AS missing_values, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM customer")
def validate_treatment(spark: SparkSession, d: str) -> DataFrame:
    return validate.treatment_problems(table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE nullif(trim(lang), '') IS NULL OR nullif(trim(source), '') IS NULL OR nullif(trim(text), '') IS NULL OR n_chars IS NULL OR trim(CASE WHEN n_chars < 300 THEN '' ELSE text END) = ''")
def validate_accession(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("shown", F.when(F.col("n_chars") < 300, "").otherwise(F.col("text")))
    return validate.incomplete_rows(docs, ["lang", "source", "shown", "n_chars"]).select("doc_id", "lang", "source", "n_chars")


@query("SELECT missing AS lang FROM (SELECT unnest(['en', 'de', 'pl', 'ja']) AS missing) WHERE missing NOT IN (SELECT lang FROM documents)")
def missing_dataset_types(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing_types(table(spark, d, "documents"), "lang", ["en", "de", "pl", "ja"])


@query("""
    WITH m AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN ' , ' ELSE p_name || ', ' || p_brand || ',, ' || p_type END AS markers FROM part)
    SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(markers, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS marker_list, len(list_filter(list_transform(string_split(markers, ','), lambda x: trim(x)), lambda x: x <> '')) = 0 AS no_markers FROM m
""")
def marker_config(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, " , ").otherwise(F.concat("p_name", F.lit(", "), "p_brand", F.lit(",, "), "p_type")).alias("markers"))
    return validate.marker_lists(parts, "p_partkey", "markers").withColumn("marker_list", F.array_join("marker_list", "|"))


@query("""
    WITH s AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'R') AS total, count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount > 0.02) AS mapped, count(DISTINCT l_partkey) AS genes FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey || '-' || l_linenumber AS sample, CAST(total AS DOUBLE) AS total, CAST(mapped AS DOUBLE) AS mapped, CAST(genes AS DOUBLE) AS genes, CASE WHEN total > 0 THEN round(mapped / total, 6) END AS mapping_rate,
           CASE WHEN mapped > total THEN 'mapped reads exceed total reads' WHEN total <= 0 THEN 'non-positive total reads' ELSE '' END AS qc_issue FROM s
""")
def seq_qc(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count_if(F.col("l_returnflag") == "R").alias("total"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.02)).alias("mapped"), F.countDistinct("l_partkey").alias("genes"))
    return rounded(validate.sequencing_quality(s.withColumn("sample", F.concat_ws("-", "l_suppkey", "l_linenumber")), "sample", "total", "mapped", "genes"), "mapping_rate")


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 't 1' ELSE 'T3' END AS t_stage, p_size / 8.0 AS diameter FROM part)
    SELECT p_partkey, t_stage, round(CAST(diameter AS DOUBLE), 6) AS diameter, CASE WHEN t_stage = 't 1' THEN 'T1 with diameter over 2' ELSE 'T3 with diameter up to 4' END AS issue FROM p WHERE (t_stage = 't 1' AND diameter > 2) OR (t_stage = 'T3' AND diameter <= 4)
""")
def stage_size_check(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "t 1").otherwise("T3").alias("t_stage"), (F.col("p_size") / 8.0).cast("double").alias("diameter"))
    return rounded(validate.stage_size_conflicts(p, "t_stage", "diameter"), "diameter")


@query("""
    WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.z') AS z FROM events)
    SELECT event_id, CASE WHEN k IS NULL AND z IS NULL THEN 'k,z' WHEN k IS NULL THEN 'k' WHEN z IS NULL THEN 'z' ELSE '' END AS missing, k IS NOT NULL AND z IS NOT NULL AS complete FROM e
""")
def manifest_completeness(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing_fields(table(spark, d, "events"), "props", ["k", "z"]).select("event_id", F.array_join("missing", ",").alias("missing"), "complete")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_discount IS NULL) AS not_numeric, count(*) FILTER (WHERE l_quantity / 40 NOT BETWEEN 0 AND 1) AS out_of_range FROM lineitem")
def enrichment_check(spark: SparkSession, d: str) -> DataFrame:
    return validate.enrichment_problems(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") / 40), "p")


# ---------------------------------------------------------------- summaries


@query("""
    SELECT l_suppkey, median(l_quantity) AS median_value, round(avg(l_quantity), 6) AS mean_value, round(stddev_samp(l_quantity), 6) AS std_value, min(l_quantity) AS min_value, max(l_quantity) AS max_value, count(*) AS n_readings,
           max(l_quantity) - min(l_quantity) AS value_range, CASE WHEN median(l_quantity) >= 25 THEN 'H-TSR' ELSE 'L-TSR' END AS label FROM lineitem GROUP BY 1
""")
def tsr_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.reader_summary(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", 25), "mean_value", "std_value")


@query("""
    WITH u AS (SELECT c_mktsegment, 'c_acctbal' AS feature, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM customer UNION ALL SELECT c_mktsegment, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
    SELECT c_mktsegment, feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_rate FROM u GROUP BY 1, 2
""")
def batch_effect_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return rounded(statistics.batch_effects(c, "c_mktsegment", ["c_acctbal", "c_nationkey"]), "mean", "std", "missing_rate")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").join(s, "s_suppkey").select(F.col("s_suppkey").alias("sample_id"), F.col("r_name").alias("grp"), F.col("l_returnflag").alias("cell_type"))


_CELLS = """
    WITH c AS (SELECT s_suppkey AS sample_id, r_name AS grp, l_returnflag AS cell_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
         n AS (SELECT sample_id, grp, cell_type, count(*) AS n_cells FROM c GROUP BY ALL),
         p AS (SELECT *, sum(n_cells) OVER (PARTITION BY sample_id, grp) AS total_cells, n_cells / sum(n_cells) OVER (PARTITION BY sample_id, grp) AS proportion FROM n)
"""


@query(_CELLS + "SELECT sample_id, grp, cell_type, n_cells, CAST(total_cells AS BIGINT) AS total_cells, round(proportion, 6) AS proportion FROM p")
def cell_proportions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.cell_proportions(_cells(spark, d), "sample_id", "grp", "cell_type"), "proportion")


@query(_CELLS + "SELECT grp, cell_type, count(DISTINCT sample_id) AS n_samples, round(avg(proportion), 6) AS mean_proportion, round(median(proportion), 6) AS median_proportion, round(stddev_samp(proportion), 6) AS std_proportion FROM p GROUP BY 1, 2")
def cell_group_summary(spark: SparkSession, d: str) -> DataFrame:
    shares = statistics.cell_proportions(_cells(spark, d), "sample_id", "grp", "cell_type")
    return rounded(statistics.proportion_summary(shares, "sample_id", "grp", "cell_type"), "mean_proportion", "median_proportion", "std_proportion")


@query(_CELLS + "SELECT grp, cell_type, count(DISTINCT sample_id) AS n_samples, round(avg(proportion), 6) AS mean_proportion, round(median(proportion), 6) AS median_proportion, round(stddev_samp(proportion), 6) AS std_proportion FROM p WHERE cell_type = 'R' GROUP BY 1, 2")
def target_cell_summary(spark: SparkSession, d: str) -> DataFrame:
    shares = statistics.cell_proportions(_cells(spark, d), "sample_id", "grp", "cell_type", "R")
    return rounded(statistics.proportion_summary(shares, "sample_id", "grp", "cell_type"), "mean_proportion", "median_proportion", "std_proportion")


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} + 0.0 AS v FROM lineitem" for c in _LINE_FEATURES)


@query(f"""
    WITH u AS ({_LINE_LONG}), m AS (SELECT feature, avg(v) AS m FROM u GROUP BY 1),
         k AS (SELECT feature, avg(power(v - m, 2)) AS m2, avg(power(v - m, 3)) AS m3, avg(power(v - m, 4)) AS m4 FROM u JOIN m USING (feature) GROUP BY 1)
    SELECT feature, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS min, round(quantile_cont(v, 0.25), 5) AS q25, round(median(v), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q75, round(max(v), 5) AS max,
           round(any_value(m3 / power(m2, 1.5)), 5) AS skewness, round(any_value(m4 / (m2 * m2) - 3), 5) AS kurtosis, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END), 5) AS missing_rate FROM u JOIN k USING (feature) GROUP BY feature
""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.feature_statistics(table(spark, d, "lineitem"), _LINE_FEATURES)
    return rounded(out, *[c for c in out.columns if c not in ("feature", "n")], digits=5)


@query("""
    WITH u AS (SELECT 'flat' AS feature, 3.0 AS v FROM part UNION ALL SELECT 'p_size', p_size FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part)
    SELECT feature, CAST(stddev_pop(v) AS DOUBLE) AS std, count(v) AS n FROM u GROUP BY 1 HAVING stddev_pop(v) = 0
""")
def constant_features(spark: SparkSession, d: str) -> DataFrame:
    return statistics.constant_features(table(spark, d, "part").withColumn("flat", F.lit(3)), ["flat", "p_size", "p_retailprice"])


_PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM x" for i, a in enumerate(("q", "price", "charge", "disc")) for b in ("q", "price", "charge", "disc")[i + 1 :])


@query(f"WITH x AS (SELECT l_quantity AS q, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS charge, l_discount AS disc FROM lineitem) SELECT * FROM ({_PAIR_SQL}) WHERE abs(correlation) >= 0.5")
def high_corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charge"), F.col("l_discount").alias("disc"))
    return rounded(statistics.correlated_pairs(x, threshold=0.5), "correlation")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS importance FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def importance_by_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.feature_importance(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "importance")


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS raw FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ") SELECT feature, round(raw / max(raw) OVER (), 6) AS importance FROM v")
def importance_normalised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.normalised_importance(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "importance")


_RUNS = "WITH s AS (SELECT DISTINCT user_id % 12 AS run, event_type || '_' || CAST(floor(value / 40) AS BIGINT) AS feature FROM events)"


@query(_RUNS + """
    , z AS (SELECT run, count(*) AS size FROM s GROUP BY 1), x AS (SELECT a.run AS run_a, b.run AS run_b, count(*) AS shared FROM s a JOIN s b ON a.feature = b.feature AND a.run < b.run GROUP BY 1, 2),
    y AS (SELECT a.run AS run_a, b.run AS run_b, a.size + b.size AS sizes FROM z a JOIN z b ON a.run < b.run)
    SELECT run_a, run_b, coalesce(shared, 0) AS shared, sizes - coalesce(shared, 0) AS total, round(coalesce(shared, 0) / (sizes - coalesce(shared, 0)), 6) AS jaccard FROM y LEFT JOIN x USING (run_a, run_b)
""")
def jaccard_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.selection_stability(_runs(spark, d), "run", "feature"), "jaccard")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 12).alias("run"), F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 40).cast("string")).alias("feature"))


@query(_RUNS + "SELECT feature, count(DISTINCT run) AS frequency, round(count(DISTINCT run) / (SELECT count(DISTINCT run) FROM s), 6) AS rate, count(DISTINCT run) = (SELECT count(DISTINCT run) FROM s) AS consensus FROM s GROUP BY 1")
def selection_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.feature_frequency(_runs(spark, d), "run", "feature"), "rate")


# ---------------------------------------------------------------- agreement

_ICC = """
    WITH c AS (SELECT l_suppkey AS s, l_returnflag AS r, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
         k AS (SELECT count(DISTINCT r) AS k FROM c), w AS (SELECT s FROM c GROUP BY 1 HAVING count(*) = (SELECT k FROM k)),
         d AS (SELECT s, r, y, avg(y) OVER (PARTITION BY s) AS rm, avg(y) OVER (PARTITION BY r) AS cm, avg(y) OVER () AS g FROM c WHERE s IN (SELECT s FROM w)),
         q AS (SELECT count(DISTINCT s) AS n, any_value(k.k) AS k, sum(power(rm - g, 2)) / (count(DISTINCT s) - 1) AS msr, sum(power(cm - g, 2)) / (any_value(k.k) - 1) AS msc, sum(power(y - rm - cm + g, 2)) / ((count(DISTINCT s) - 1) * (any_value(k.k) - 1)) AS mse FROM d, k)
    SELECT 'l_quantity' AS feature, n AS n_subjects, k AS n_repeats, round((msr - mse) / (msr + (k - 1) * mse {}), 6) AS icc, CASE WHEN (msr - mse) / (msr + (k - 1) * mse {}) >= 0.75 THEN 'stable' ELSE 'review' END AS status FROM q
"""


@query(_ICC.format("+ k * (msc - mse) / n", "+ k * (msc - mse) / n"))
def icc21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.icc(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["l_quantity"]), "icc")


@query(_ICC.format("", ""))
def icc31(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.icc(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["l_quantity"], kind="icc3_1"), "icc")


@query("""
    WITH c AS (SELECT l_orderkey AS s, l_returnflag AS r, avg(l_quantity) >= 25 AS h FROM lineitem GROUP BY 1, 2),
         p AS (SELECT a.r AS reader_a, b.r AS reader_b, count(*) AS n, avg(CAST(a.h = b.h AS INTEGER)) AS po, avg(CAST(a.h AS INTEGER)) AS pa, avg(CAST(b.h AS INTEGER)) AS pb FROM c a JOIN c b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2)
    SELECT reader_a, reader_b, n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM p
""")
def kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.reader_kappa(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", 25), "agreement", "kappa")


def _ranks(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2"


@query(f"""
    WITH w AS (SELECT l_orderkey, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS a, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1), c AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
         r AS (SELECT *, {_ranks('a')} AS ra, {_ranks('b')} AS rb FROM c)
    SELECT count(*) AS n_pairs, round(avg(a - b), 6) AS mean_difference, round(median(abs(a - b)), 6) AS median_absolute_difference, round(corr(ra, rb), 6) AS spearman FROM r
""")
def specimen_compare(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.specimen_comparison(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus", "l_quantity", ("F", "O")), "mean_difference", "median_absolute_difference", "spearman")


# ---------------------------------------------------------------- predictions


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "quality", "toxic", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))


_SCORED = "WITH s AS (SELECT doc_id, quality, toxic, n_chars / (n_chars + 1000.0) AS score FROM labels JOIN documents USING (doc_id))"


@query(_SCORED + """
    , e AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
    b AS (SELECT quality, score, greatest((SELECT count(*) FROM range(0, 11) t(i) WHERE CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + (hi - lo) * i / 10 END < score) - 1, 0) AS bin FROM s, e)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS observed_rate, round(abs(avg(score) - avg(quality)), 6) AS absolute_error FROM b GROUP BY 1
""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.calibration(_scored(spark, d), "quality", "score"), "mean_score", "observed_rate", "absolute_error")


@query(_SCORED + """
    , t AS (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND quality <> 1) AS fp, count(*) AS n, avg(quality) AS rate FROM s, t GROUP BY 1)
    SELECT threshold, tp AS true_positives, fp AS false_positives, round(tp / n - fp / n * threshold / (1 - threshold), 6) AS net_benefit, round(rate - (1 - rate) * threshold / (1 - threshold), 6) AS treat_all, CAST(0 AS DOUBLE) AS treat_none FROM c
""")
def decision_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.decision_curve(_scored(spark, d), "quality", "score", [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]), "net_benefit", "treat_all")


_PREDICTED = _SCORED + ", p AS (SELECT quality AS y, CAST(score >= 0.45 AS INTEGER) AS p FROM s)"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(F.col("quality").alias("y"), (F.col("score") >= 0.45).cast("int").alias("p"))


@query(_PREDICTED + "SELECT y, p, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return statistics.confusion(_predicted(spark, d), "y", "p")


@query(_PREDICTED + """
    , c AS (SELECT k, count(*) FILTER (WHERE y = k AND p = k) AS tp, count(*) FILTER (WHERE y = k) AS own, count(*) FILTER (WHERE p = k) AS said FROM p, (SELECT unnest([0, 1]) AS k) GROUP BY 1),
    m AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS pr, coalesce(tp / nullif(own, 0), 0) AS re FROM c), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m), a AS (SELECT sum(tp) / sum(own) AS acc FROM c)
    SELECT average, round(acc, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM a, (
        SELECT 'binary' AS average, pr AS precision, re AS recall, f1 FROM f WHERE k = 1 UNION ALL SELECT 'micro', acc, acc, acc FROM a UNION ALL SELECT 'macro', avg(pr), avg(re), avg(f1) FROM f
        UNION ALL SELECT 'weighted', sum(pr * own) / sum(own), sum(re * own) / sum(own), sum(f1 * own) / sum(own) FROM f)
""")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.classification_scores(_predicted(spark, d), "y", "p"), "accuracy", "precision", "recall", "f1")


@query("""
    WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
    SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 2) AS mse, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2 FROM r
""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.regression_scores(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000), "l_extendedprice", "p")
    return rounded(rounded(rounded(out, "r2"), "mae", digits=4), "mse", digits=2)


# ---------------------------------------------------------------- ranks


@query(f"WITH o AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, {_ranks('o_totalprice')} AS r FROM orders) SELECT CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS auc FROM o")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.auc(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_totalprice"), "auc")


@query(f"""
    WITH o AS (SELECT CAST(l_linestatus = 'F' AS INTEGER) AS y, l_quantity AS v, {_ranks('l_quantity')} AS r FROM lineitem), t AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT count(*) AS n FROM o GROUP BY v)),
         u AS (SELECT CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0, sum(y * r) - sum(y) * (sum(y) + 1) / 2 AS u FROM o)
    SELECT n1, n0, round(u, 3) AS u, round((greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z FROM u, t
""")
def mannwhitney_u(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(statistics.mann_whitney(table(spark, d, "lineitem"), F.col("l_linestatus") == "F", "l_quantity"), "n1", "n0", "z"), "u", digits=3)


@query(f"WITH r AS (SELECT {_ranks('l_quantity')} AS a, {_ranks('l_extendedprice')} AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


@query("""
    WITH p AS (SELECT o_orderkey, (o_totalprice % 1000) / 1000 AS p FROM orders), n AS (SELECT p, count(*) AS k FROM p GROUP BY 1), r AS (SELECT p, p * sum(k) OVER () / sum(k) OVER (ORDER BY p) AS raw FROM n),
         a AS (SELECT p, least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM r)
    SELECT o_orderkey, round(adj, 6) AS p_adjusted FROM p JOIN a USING (p)
""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") % 1000) / 1000).alias("p"))
    return rounded(statistics.benjamini_hochberg(p, "p"), "p_adjusted").drop("p")


@query(_SURVIVAL + """
    , a AS (SELECT o_orderpriority AS grp, days AS time, sum(event) AS events, count(*) AS leaving FROM s GROUP BY 1, 2), r AS (SELECT *, sum(leaving) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk, sum(leaving) OVER (PARTITION BY grp) AS n_patients FROM a),
    k AS (SELECT grp, time, at_risk, events, CASE WHEN min(1 - events / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w) END AS survival, n_patients FROM r WINDOW w AS (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT grp AS "group", time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(coalesce(survival, 1), 6) AS survival, CAST(n_patients AS BIGINT) AS n_patients FROM k
    UNION ALL SELECT grp, 0, CAST(max(n_patients) AS BIGINT), 0, 1, CAST(max(n_patients) AS BIGINT) FROM k GROUP BY grp HAVING min(time) > 0
""")
def km_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(survival.kaplan_meier(_survival_rows(spark, d), "days", "event", "o_orderpriority"), "survival")


@query(_SURVIVAL + """ SELECT o_orderpriority AS "group", CAST(t AS DOUBLE) AS time, count(*) FILTER (WHERE days >= t) AS at_risk FROM s, (SELECT unnest([0, 365, 1000, 2000, 5000]) AS t) GROUP BY 1, 2""")
def at_risk(spark: SparkSession, d: str) -> DataFrame:
    return survival.number_at_risk(_survival_rows(spark, d), "days", "o_orderpriority", [0, 365, 1000, 2000, 5000])


@query("WITH c AS (SELECT c_custkey, round(c_acctbal, 0) AS change FROM customer) SELECT c_custkey, change, row_number() OVER (ORDER BY change, c_custkey) AS plot_order FROM c")
def waterfall(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ordered_changes(table(spark, d, "customer").withColumn("change", F.round("c_acctbal", 0)), "c_custkey", "change")


@query("SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS average_rank FROM customer")
def ranks_by_group(spark: SparkSession, d: str) -> DataFrame:
    return with_ranks(table(spark, d, "customer"), "c_nationkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "average_rank")


# ---------------------------------------------------------------- columns and files


@query("""
    WITH w AS (SELECT p_partkey, list_transform(string_split(lower(p_name) || '_glcm_Idn_' || p_brand || '_' || replace(p_type, ' ', '-'), '_'), lambda x: regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) AS words FROM part)
    SELECT p_partkey, array_to_string(list_transform(list_filter(words, lambda x: x <> ''), lambda x: CASE WHEN lower(x) IN ('glcm', 'gldm', 'glrlm', 'glszm', 'ngtdm', 'id', 'idn', 'idm', 'ids') THEN upper(x)
        WHEN regexp_matches(substr(x, 2), '[A-Z]') THEN x ELSE upper(substr(x, 1, 1)) || lower(substr(x, 2)) END), '_') AS name FROM w
""")
def feature_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws("_", F.lower("p_name"), F.lit("glcm"), F.lit("Idn"), F.col("p_brand"), F.replace("p_type", F.lit(" "), F.lit("-")))
    return table(spark, d, "part").select("p_partkey", C.tidy_name(raw).alias("name"))


@query("""
    WITH n AS (SELECT page_id, replace(replace(replace(replace(url, ':', '_'), '/', '_'), '?', '_'), '*', '_') || repeat('x', page_id % 400) || '.html' AS name FROM pages)
    SELECT page_id, CASE WHEN length(name) > 255 THEN left(name, 250) || '.html' ELSE name END AS name FROM n
""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("url", F.repeat(F.lit("x"), (F.col("page_id") % 400).cast("int")), F.lit(".html"))
    return table(spark, d, "pages").select("page_id", C.safe_filename(raw).alias("name"))


@query("SELECT c_custkey, round((least(greatest(c_acctbal, -1000), 3000) + 1000) / 4000, 8) AS unit, round((least(greatest(c_acctbal, -1000), 3000) + 1000) / 4000 * 4000 - 1000, 4) AS back FROM customer")
def intensity_units(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "customer").select("c_custkey", C.to_unit_scale(F.col("c_acctbal")).alias("unit")).withColumn("back", C.from_unit_scale(F.col("unit")))
    return rounded(rounded(out, "unit", digits=8), "back", digits=4)


@query("SELECT source, lang, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_chars, min(doc_id) AS first_id, count(DISTINCT md5(text)) AS n_contents FROM documents GROUP BY 1, 2")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("total_chars"), F.min("doc_id").alias("first_id"), F.countDistinct(F.md5("text")).alias("n_contents"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- images: 64 values as 8 x 8

_VOXELS = "WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(_VOXELS + "SELECT vec_id, CAST(count(*) AS INTEGER) AS n_voxels, round(count(*) / 64, 6) AS share, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sum(v), 6) AS sum, round(sum(v * v), 6) AS energy FROM v WHERE v > 0 GROUP BY 1")
def roi_stats(spark: SparkSession, d: str) -> DataFrame:
    out = voxels.roi_statistics(_images(spark, d), "embedding", ["vec_id"])
    return rounded(out, *[c for c in out.columns if c not in ("vec_id", "n_voxels")])


@query(_VOXELS + "SELECT vec_id, CAST(min(pos // 8) AS INTEGER) AS min_row, CAST(max(pos // 8) AS INTEGER) AS max_row, CAST(min(pos % 8) AS INTEGER) AS min_col, CAST(max(pos % 8) AS INTEGER) AS max_col, round(avg(pos // 8), 6) AS centre_row, round(avg(pos % 8), 6) AS centre_col FROM v WHERE v > 0.1 GROUP BY 1")
def bbox_centroid(spark: SparkSession, d: str) -> DataFrame:
    shifted = _images(spark, d).withColumn("embedding", F.transform(voxels.values("embedding"), lambda x: x - 0.1))
    return rounded(voxels.bounding_box(shifted, "embedding", ["vec_id"], 8), "centre_row", "centre_col")


def _norm(spark: SparkSession, d: str, method: str) -> DataFrame:
    out = voxels.with_normalised(_images(spark, d), "embedding", method)
    return rounded(out.select("vec_id", F.posexplode("normalised").alias("pos", "value")), "value")


@query(_VOXELS + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS value FROM v WINDOW w AS (PARTITION BY vec_id)")
def zscore_norm(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "zscore")


@query(_VOXELS + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) + 0.0 AS value FROM v WINDOW w AS (PARTITION BY vec_id)")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "minmax")


@query(_VOXELS + ", q AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v GROUP BY 1) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) + 0.0 AS value FROM v JOIN q USING (vec_id)")
def percentile_norm(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "percentile")


@query(_VOXELS + ", q AS (SELECT vec_id, quantile_cont(v, 0.25) AS lo, median(v) AS mid, quantile_cont(v, 0.75) AS hi FROM v GROUP BY 1) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - mid) / (hi - lo), 6) + 0.0 AS value FROM v JOIN q USING (vec_id)")
def robust_norm(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d, "robust")


@query(_VOXELS + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((least(greatest(v, -0.15), 0.25) + 0.15) / 0.4 * 255, 5) + 0.0 AS value FROM v")
def window_level(spark: SparkSession, d: str) -> DataFrame:
    out = _images(spark, d).select("vec_id", F.posexplode(voxels.windowed(voxels.values("embedding"), 0.05, 0.4)).alias("pos", "value"))
    return rounded(out, "value", digits=5)


@query(_VOXELS + """
    , p AS (SELECT vec_id, v AS a, round(v, 1) AS b FROM v), r AS (SELECT vec_id, avg((a - b) * (a - b)) AS mse, max(a) - min(a) AS rng, avg(b) / stddev_pop(b) AS snr, avg(b) FILTER (WHERE b > 0) AS m1, avg(b) FILTER (WHERE b <= 0) AS m0, var_pop(b) FILTER (WHERE b > 0) AS v1, var_pop(b) FILTER (WHERE b <= 0) AS v0 FROM p GROUP BY 1)
    SELECT vec_id, round(mse, 6) AS mse, round(20 * log10(rng) - 10 * log10(mse), 5) AS psnr, round(snr, 6) AS snr, round(abs(m1 - m0) / sqrt(v1 + v0), 6) AS cnr FROM r
""")
def image_quality(spark: SparkSession, d: str) -> DataFrame:
    both = _images(spark, d).withColumn("other", F.transform(voxels.values("embedding"), lambda x: F.round(x, 1)))
    return rounded(rounded(voxels.image_quality(both, "embedding", "other", ["vec_id"]), "mse", "snr", "cnr"), "psnr", digits=5)


@query(_VOXELS + """
    , p AS (SELECT a.vec_id, count(*) FILTER (WHERE a.v > 0) AS n_a, count(*) FILTER (WHERE b.v > 0) AS n_b, count(*) FILTER (WHERE a.v > 0 AND b.v > 0) AS n_both FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos GROUP BY 1)
    SELECT vec_id, n_a, n_b, n_both, round(2 * n_both / (n_a + n_b), 6) AS dice, round(n_both / (n_a + n_b - n_both), 6) AS jaccard FROM p
""")
def dice_jaccard(spark: SparkSession, d: str) -> DataFrame:
    e = _images(spark, d)
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rounded(voxels.overlap(both, "a", "b", ["vec_id"]), "dice", "jaccard")


_LEVELS = _VOXELS + ", q AS (SELECT vec_id, pos, CAST(least(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * {n}), {n} - 1) AS INTEGER) AS q FROM v WINDOW w AS (PARTITION BY vec_id))"


@query(_LEVELS.format(n=8) + """
    , p AS (SELECT a.vec_id, a.q AS x, b.q AS y FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1 AND a.pos % 8 < 7), e AS (SELECT vec_id, sum(n * n) / power(sum(n), 2) AS energy FROM (SELECT vec_id, x, y, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1)
    SELECT vec_id, round(avg((x - y) * (x - y)), 6) AS contrast, round(avg(abs(x - y)), 6) AS dissimilarity, round(avg(1 / (1 + (x - y) * (x - y))), 6) AS homogeneity, round(any_value(energy), 6) AS energy FROM p JOIN e USING (vec_id) GROUP BY 1
""")
def glcm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.cooccurrence(_images(spark, d), "embedding", ["vec_id"], 8), "contrast", "dissimilarity", "homogeneity", "energy")


_PAIR_NAMES = [f"glcm_{p}_{s}" for p in textures.PROPERTIES for s in textures.SUMMARIES]


@query(_VOXELS + """
    , q AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, CAST(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 7) AS INTEGER) AS q FROM v WINDOW w AS (PARTITION BY vec_id)),
    o AS (SELECT unnest([1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3]) AS d, unnest([0, 1, 1, 1, 0, 1, 2, 1, 0, 2, 3, 2]) AS dy, unnest([1, 1, 0, -1, 2, 1, 0, -1, 3, 2, 0, -2]) AS dx),
    p AS (SELECT a.vec_id, o.d, o.dy, o.dx, a.q AS i, b.q AS j FROM q a, o JOIN q b ON b.vec_id = a.vec_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
    e AS (SELECT vec_id, d, dy, dx, sqrt(sum(n * n)) / sum(n) AS energy FROM (SELECT vec_id, d, dy, dx, i, j, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL),
    f AS (SELECT vec_id, d, dy, dx, avg((i - j) * (i - j)) AS contrast, avg(abs(i - j)) AS dissimilarity, avg(1 / (1 + (i - j) * (i - j))) AS homogeneity, CASE WHEN stddev_pop(i) = 0 OR stddev_pop(j) = 0 THEN 1 ELSE corr(i, j) END AS correlation FROM p GROUP BY ALL)
    SELECT vec_id, """ + ", ".join(f"round({f}({c}), 6) AS glcm_{c}_{s}" for c in textures.PROPERTIES for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + """
    FROM f JOIN e USING (vec_id, d, dy, dx) GROUP BY vec_id
""")
def texture_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(textures.texture_features(_square(spark, d), "image", "shape", ["vec_id"], levels=8).select("vec_id", *_PAIR_NAMES), *_PAIR_NAMES)


@query(_LEVELS.format(n=4) + """
    , p AS (SELECT vec_id, q AS label, pos // 8 AS y, pos % 8 AS x, v.v FROM q JOIN v USING (vec_id, pos) WHERE q > 0)
    SELECT vec_id, CAST(label AS BIGINT) AS label, count(*) AS area, round(avg(y), 6) AS centre_y, round(avg(x), 6) AS centre_x, min(y) AS top, max(y) + 1 AS bottom, min(x) AS left, max(x) + 1 AS right,
           round(4 * sqrt((var_pop(y) + var_pop(x)) / 2 + sqrt(power((var_pop(y) - var_pop(x)) / 2, 2) + power(covar_pop(y, x), 2))), 6) AS major_axis,
           round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS extent, round(sqrt(4 * count(*) / pi()), 6) AS equivalent_diameter, round(avg(v), 6) AS mean_intensity
    FROM p GROUP BY vec_id, label
""")
def region_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = _square(spark, d).select("vec_id", "shape", "image", voxels.quantised(voxels.values("image"), 4).alias("labels"))
    found = regions.region_properties(rows, "labels", "shape", ["vec_id"], "image")
    digits = ["centre_y", "centre_x", "major_axis", "extent", "equivalent_diameter", "mean_intensity"]
    return rounded(found.select("vec_id", "label", "area", "top", "bottom", "left", "right", *digits), *digits)


@query()
def texture_patterns(spark: SparkSession, d: str) -> DataFrame:
    return textures.texture_features(_square(spark, d), "image", "shape", ["vec_id"], levels=8).select("vec_id", "lbp_energy", "lbp_entropy")


@query(_LEVELS.format(n=16) + ", h AS (SELECT vec_id, q, count(*) AS n FROM q GROUP BY ALL) SELECT vec_id, CAST(count(*) AS INTEGER) AS occupied, round(-sum(n / 64 * log2(n / 64)), 6) AS entropy, CAST(first(q ORDER BY n DESC, q) AS INTEGER) AS mode_bin FROM h GROUP BY 1")
def histogram_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.histogram_entropy(_images(spark, d), "embedding", ["vec_id"]), "entropy")


@query(_VOXELS + ", s AS (SELECT vec_id, pos // 8 AS r, avg(v) AS m FROM v GROUP BY 1, 2), t AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY vec_id ORDER BY r)) AS step FROM s) SELECT vec_id, CAST(count(*) AS INTEGER) AS n_slices, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(avg(step), 6) AS mean_step FROM t GROUP BY 1")
def slice_variation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.slice_variation(_images(spark, d), "embedding", ["vec_id"], 8), "mean", "std", "mean_step")


@query(_VOXELS + "SELECT a.vec_id, CAST(a.pos AS INTEGER) AS pos, CAST(count(*) AS INTEGER) AS n_near, round(avg(b.v), 6) AS local_mean FROM v a JOIN v b ON a.vec_id = b.vec_id AND abs(a.pos // 8 - b.pos // 8) <= 1 AND abs(a.pos % 8 - b.pos % 8) <= 1 AND b.v > 0 WHERE a.v > 0 GROUP BY 1, 2")
def local_mean_kernel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.local_means(_images(spark, d), "embedding", ["vec_id"], 8), "local_mean")


@query(" UNION ALL ".join(f"SELECT label, 'f{i}' AS feature, count(*) AS n, round(avg(embedding[{i + 1}]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[{i + 1}]::DOUBLE), 6) AS std, round(min(embedding[{i + 1}]::DOUBLE), 6) AS min, round(max(embedding[{i + 1}]::DOUBLE), 6) AS max, round(100 * count(*) / (SELECT count(*) FROM embeddings), 6) AS percent FROM embeddings GROUP BY 1" for i in range(4)))
def cluster_characteristics(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).select("label", *[F.col("embedding")[i].alias(f"f{i}") for i in range(4)])
    return rounded(voxels.cluster_characteristics(rows, "label", [f"f{i}" for i in range(4)]), "mean", "std", "min", "max", "percent")


# ---------------------------------------------------------------- models


@query("""
    WITH u AS (SELECT l_returnflag AS g, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem), s AS (SELECT feature, g, count(*) AS n, avg(v) AS m, var_pop(v) AS vp FROM u GROUP BY ALL), m AS (SELECT feature, avg(v) AS gm FROM u GROUP BY 1)
    SELECT feature, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within, round((sum(n * power(m - gm, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))), 6) AS f FROM s JOIN m USING (feature) GROUP BY feature
""")
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.anova_f(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]), "f")


_NB = [f"f{i}" for i in range(6)]


@query("WITH x AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(6)) + "), e AS (SELECT greatest(" .replace("), e", " FROM embeddings), e") + ", ".join(f"var_pop({c})" for c in _NB) + ") * 1e-9 AS eps, count(*) AS total FROM x), c AS (SELECT label AS k, count(*) AS n, " + ", ".join(f"avg({c}) AS m{c}, var_pop({c}) AS v{c}" for c in _NB) + " FROM x GROUP BY 1), s AS (SELECT vec_id, label, k, ln(n / total) + " + " + ".join(f"(-0.5 * ln(2 * pi() * (v{c} + eps)) - power({c} - m{c}, 2) / (2 * (v{c} + eps)))" for c in _NB) + " AS score FROM x, c, e) SELECT vec_id, label, arg_max(k, score) AS predicted FROM s GROUP BY 1, 2")
def gaussian_nb(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).select("vec_id", "label", *[F.col("embedding")[i].alias(f"f{i}") for i in range(6)])
    return models.gaussian_bayes(rows, "label", _NB, ["vec_id"])


@query("""
    WITH q AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
         n AS (SELECT vec_id, label, count(*) AS n FROM q WHERE place <= 5 GROUP BY 1, 2) SELECT vec_id, first(label ORDER BY n DESC, label) AS predicted FROM n GROUP BY 1
""")
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    e = _images(spark, d)
    return models.knn_predict(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "label")


@query()
def kmeans_habitat(spark: SparkSession, d: str) -> DataFrame:
    return models.kmeans(_images(spark, d), ["vec_id", "label"], "embedding", 5)


@query()
def grouped_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).select("vec_id", (F.col("label") < 5).cast("int").alias("y"), *[F.col("embedding")[i].alias(f"f{i}") for i in range(8)])
    return models.cross_validated(rows, "y", "vec_id", [f"f{i}" for i in range(8)], keep=5)


_ALL = [f"f{i}" for i in range(64)]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("vec_id", "label", (F.col("label") < 5).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_ALL)])


def _nested(spark: SparkSession, d: str) -> nested.NestedResult:
    return nested.nested_cross_validated(_labelled(spark, d), "y", "vec_id", _ALL, outer=4, inner=3, n_features=12)


@query()
def nested_cv(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).predictions


@query()
def nested_cv_report(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).folds


_PLACE = "CAST('0x' || substr(md5({seed} || ':' || subject), 1, 13) AS BIGINT)"
_DEALT = "WITH s AS (SELECT c_custkey AS subject, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label FROM customer), f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY " + _PLACE.format(seed="'42'") + ") - 1) % 5 + 1 AS INTEGER) AS fold FROM s)"


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"))
    return folds.subjects_of(rows, "c_custkey", "building")


@query(_DEALT + " SELECT subject, label, fold FROM f")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.stratified_folds(_subjects(spark, d), 5)


@query(_DEALT + ", o AS (SELECT f.*, n.o AS outer_fold FROM f, (SELECT unnest(range(1, 6)) AS o) n), i AS (SELECT subject, outer_fold, CAST((row_number() OVER (PARTITION BY outer_fold, label ORDER BY " + _PLACE.format(seed="CAST(42 + outer_fold AS VARCHAR)") + ") - 1) % 4 AS INTEGER) AS inner_fold FROM o WHERE fold <> outer_fold)"
       " SELECT subject, CAST(outer_fold AS INTEGER) AS outer_fold, coalesce(inner_fold, -1) AS inner_fold FROM o LEFT JOIN i USING (subject, outer_fold)")  # fmt: skip
def nested_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.inner_fold_table(folds.nested_folds(_subjects(spark, d), 5, 4)).select("subject", F.col("outer").alias("outer_fold"), F.col("inner").alias("inner_fold"))


_LONG = "WITH u AS (SELECT vec_id, label, CAST(label < 5 AS INTEGER) AS y, 'f' || (i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"


@query(_LONG + """
    , c AS (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) > 1), p AS (SELECT u.* FROM u JOIN c USING (label)), z AS (SELECT label, count(*) AS of_class, least(3, count(*) - 1) AS k FROM embeddings GROUP BY 1 HAVING count(*) > 1),
    g AS (SELECT a.vec_id, a.feature, a.v, a.label, abs(b.v - a.v) AS d, row_number() OVER (PARTITION BY a.vec_id, a.feature ORDER BY abs(b.v - a.v)) AS place FROM p a JOIN p b ON a.feature = b.feature AND a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT vec_id, feature, v, of_class, k, d AS r FROM g JOIN z USING (label) WHERE place = k),
    m AS (SELECT r.vec_id, r.feature, any_value(of_class) AS of_class, any_value(k) AS k, count(*) AS m FROM r JOIN p ON p.feature = r.feature AND (abs(p.v - r.v) < r.r OR r.r = 0 AND p.v = r.v) GROUP BY 1, 2),
    h AS (SELECT n, -0.57721566490153286 + coalesce(sum(1.0 / (n - 1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi FROM (SELECT CAST(unnest(range(2, (SELECT count(*) + 1 FROM embeddings))) AS DOUBLE) AS n) UNION ALL SELECT 1.0, -0.57721566490153286)
    SELECT feature, count(*) AS n, round(greatest((SELECT psi FROM h WHERE n = (SELECT count(*) FROM embeddings JOIN c USING (label))) + avg(a.psi) - avg(b.psi) - avg(e.psi), 0), 6) AS information
    FROM m JOIN h a ON a.n = m.k JOIN h b ON b.n = m.of_class JOIN h e ON e.n = m.m GROUP BY feature
""")
def knn_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(information.class_information(_labelled(spark, d), "label", _ALL), "information")


@query(_LONG + """
    , r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM u)
    SELECT feature, count(*) AS n, round(sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0, 4) AS statistic FROM r GROUP BY feature
""")
def univariate_tests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selector.univariate_tests(_labelled(spark, d), "y", _ALL), "statistic", digits=4).drop("p_value")


@query()
def sequential_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return selector.as_table(rows, selector.repeated(rows, "y", _ALL, "vec_id", [42, 43, 44], selector.Settings(most_features=10)))


@query("SELECT l_returnflag, CAST(share AS DOUBLE) AS share, round(quantile, 6) AS quantile FROM (SELECT l_returnflag, unnest([0.1, 0.5, 0.75, 0.99]) AS share, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.75, 0.99])) AS quantile FROM lineitem GROUP BY 1)")
def exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(order_statistics(table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.75, 0.99], ["l_returnflag"]), "quantile")


def _spenders(spark: SparkSession, d: str) -> DataFrame:
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 1_000_000).alias("spent"))
    rows = table(spark, d, "customer").join(spent, "c_custkey")
    return rows.select("c_custkey", F.array(F.round(F.col("c_acctbal") / 1000 * 1000) / 1000, F.round(F.col("spent") * 1000) / 1000).alias("v"))  # values at a tie are rounded as SQL's round does


@query("""
    WITH RECURSIVE p AS (SELECT c_custkey AS id, round(c_acctbal / 1000, 3) AS x, round(spent, 3) AS y FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) / 1000000 AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    n AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON abs(a.x - b.x) <= 0.2 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.2 * 0.2),
    c AS (SELECT id FROM n GROUP BY 1 HAVING count(*) >= 6), e AS (SELECT id, other FROM n WHERE id IN (FROM c) AND other IN (FROM c)),
    t AS (SELECT id, id AS root FROM c UNION SELECT e.other, t.root FROM t JOIN e USING (id) WHERE t.root < e.other),
    r AS (SELECT id, min(root) AS root FROM t GROUP BY 1), k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM r)),
    l AS (SELECT id, cluster FROM r JOIN k USING (root)), b AS (SELECT n.id, min(cluster) AS cluster FROM n JOIN l ON l.id = n.other WHERE n.id NOT IN (FROM c) GROUP BY 1)
    SELECT id AS c_custkey, coalesce(l.cluster, b.cluster, -1) AS cluster FROM p LEFT JOIN l USING (id) LEFT JOIN b USING (id)
""")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.density_clusters(_spenders(spark, d), "c_custkey", "v", 0.2, 6)


_PAIRS = """
    WITH z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT a.vec_id, a.label, b.label AS other, sum({distance}) / CASE WHEN a.label = b.label THEN greatest(any_value(n) - 1, 1) ELSE any_value(n) END AS m, any_value(n) AS n FROM embeddings a JOIN embeddings b ON {pick} JOIN z ON z.label = b.label GROUP BY 1, 2, 3),
    q AS (SELECT vec_id, label, max(m) FILTER (WHERE other = label) AS a, max(n) FILTER (WHERE other = label) AS n, min(m) FILTER (WHERE other <> label) AS b FROM s GROUP BY 1, 2)
    SELECT vec_id, {label} AS label, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM q
"""


@query(_PAIRS.format(distance="power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)", pick="true", label="label"))
def silhouette_squared(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.silhouette_squared(_images(spark, d), ["vec_id"], "embedding", "label"), "silhouette")


@query(_PAIRS.format(distance="list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", pick="a.vec_id % 20 = 0", label="CAST(label AS BIGINT)"))
def silhouette_euclidean(spark: SparkSession, d: str) -> DataFrame:
    e = _images(spark, d)
    return rounded(clustering.silhouette(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "label"), "silhouette")


@query()
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.ward_clusters(_images(spark, d), ["vec_id"], "embedding", 10, most_points=200)


@query()
def habitat_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.clustered(_labelled(spark, d), "vec_id", _ALL, k=5, selection="variance", components=8, keep=["label"]).labels


@query()
def mrmr_select(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).select("label", *[F.col("embedding")[i].alias(f"f{i}") for i in range(8)])
    return models.relevance_less_redundancy(rows, "label", [f"f{i}" for i in range(8)], 4)


@query()
def cox_ph(spark: SparkSession, d: str) -> DataFrame:
    rows = _survival_rows(spark, d).withColumns({"price": F.col("o_totalprice") / 100_000, "urgent": F.col("o_orderpriority").startswith("1").cast("int")})
    return rounded(survival.cox(rows, "days", "event", ["price", "urgent"]), "coefficient", "standard_error")


@query()
def cox_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _survival_rows(spark, d).withColumn("price", F.col("o_totalprice") / 100_000)
    return survival.fit_cox(rows, "days", "event", ["price", "o_orderpriority"], ["o_orderpriority"], penalizer=0.01).summary


@query()
def size_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Documents dealt to 16 workers by length."""
    return assignment.worker_totals(assignment.balanced(table(spark, d, "documents"), "doc_id", "n_chars", 16))


@query()
def glm_interaction(spark: SparkSession, d: str) -> DataFrame:
    rows = _survival_rows(spark, d).withColumns({"price": F.col("o_totalprice") / 100_000, "urgent": F.col("o_orderpriority").startswith("1").cast("int")})
    return survival.interaction_model(rows, "event", "urgent", "price")


@query("""
    WITH w AS (SELECT quality AS t, toxic AS y, least(greatest(score, 0.01), 0.99) AS e FROM (SELECT quality, toxic, n_chars / (n_chars + 1000.0) AS score FROM labels JOIN documents USING (doc_id))), v AS (SELECT t, y, t / e + (1 - t) / (1 - e) AS w FROM w)
    SELECT count(*) AS n, round(sum(w * y) FILTER (WHERE t = 1) / sum(w) FILTER (WHERE t = 1), 6) AS treated_rate, round(sum(w * y) FILTER (WHERE t = 0) / sum(w) FILTER (WHERE t = 0), 6) AS control_rate, round(sum(w * y) FILTER (WHERE t = 1) / sum(w) FILTER (WHERE t = 1) - sum(w * y) FILTER (WHERE t = 0) / sum(w) FILTER (WHERE t = 0), 6) AS difference FROM v
""")
def propensity_ipw(spark: SparkSession, d: str) -> DataFrame:
    weighted = survival.treatment_weights(_scored(spark, d), "quality", "score")
    return rounded(survival.weighted_effect(weighted, "quality", "toxic", "weight_ate"), "treated_rate", "control_rate", "difference")


@query()
def propensity_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return survival.propensity(rows, "quality", ["n_chars", "toxic"]).select("doc_id", "propensity")


# ---------------------------------------------------------------- resampling, discrimination, harmonisation


@query()
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _survival_rows(spark, d)
    return inference.bootstrap_auc(rows, "o_orderkey", "event", "o_totalprice")


@query()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("other", F.length(F.col("doc_id").cast("string")) / 10 - F.col("score"))
    return inference.compared_models(rows, "doc_id", "quality", ["score", "other"])


@query(_SURVIVAL + """
    , a AS (SELECT days, count(*) FILTER (WHERE event = 0) AS c, count(*) AS n FROM s GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM a),
    g AS (SELECT days, coalesce(exp(sum(CASE WHEN c < risk THEN ln(1 - c / risk) ELSE -1e9 END) OVER (ORDER BY days ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM r),
    h AS (SELECT t AS time, o_totalprice AS x, CASE WHEN days <= t AND event = 1 THEN 1 / g END AS w, CAST(days > t AS INTEGER) AS q FROM s JOIN g USING (days), (SELECT unnest([500.0, 1500.0])::DOUBLE AS t) WHERE event = 0 OR g > 0),
    b AS (SELECT time, x, sum(coalesce(w, 0)) AS p, sum(q) AS q FROM h GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY time ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
    SELECT time, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM c GROUP BY 1
""")
def time_dependent_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.time_dependent_auc(_survival_rows(spark, d), "days", "event", "o_totalprice", [500.0, 1500.0]), "auc")


@query()
def batch_harmonise(spark: SparkSession, d: str) -> DataFrame:
    return inference.harmonised(table(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["row"], "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])


_QUALITY = ["f0", "f1", "f2"]


@query("WITH x AS (SELECT label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(3)) + " FROM embeddings), g AS (SELECT " + ", ".join(f"avg({c}) AS g{c}" for c in _QUALITY) + " FROM x), s AS (SELECT label, count(*) AS n, " + ", ".join(f"avg({c}) AS m{c}, var_pop({c}) AS v{c}" for c in _QUALITY) + " FROM x GROUP BY 1) SELECT count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_rows, round((sum(n * (" + " + ".join(f"power(m{c} - g{c}, 2)" for c in _QUALITY) + ")) / (count(*) - 1)) / (sum(n * (" + " + ".join(f"v{c}" for c in _QUALITY) + ")) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM s, g")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).select("label", *[F.col("embedding")[i].alias(f"f{i}") for i in range(3)])
    return rounded(inference.cluster_quality(rows, "label", _QUALITY), "calinski_harabasz")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs({b} * ({c} - m))), 6) AS mean_absolute, round(avg({b} * ({c} - m)), 6) + 0.0 AS mean_signed FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)" for c, b in (("l_quantity", 0.1), ("l_discount", -5.0))))
def linear_attributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.linear_attributions(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], [0.1, -5.0]), "mean_absolute", "mean_signed")


@query("SELECT '1.2.' || (vec_id // 8) AS series, count(DISTINCT vec_id) AS n_slices, round(avg(floor(1000 * v::DOUBLE)), 6) AS mean, max(floor(1000 * v::DOUBLE)) AS most, CASE WHEN count(DISTINCT vec_id) > 1 THEN 1.5 ELSE 2.0 END::DOUBLE AS gap, min(vec_id) % 8 * 1.5::DOUBLE AS z, first(floor(1000 * v::DOUBLE) ORDER BY vec_id, i) AS first_value FROM (SELECT vec_id, i, embedding[i] AS v FROM embeddings, range(1, 65) r(i)) GROUP BY vec_id // 8")
def dicom_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as slices of 8 x 8 pixels, eight to a series, written as files with instance numbers against their positions, and read as volumes."""

    def written(batches):
        for batch in batches:
            made = [dicom.encode_dicom(np.floor(1000 * np.array(v, dtype=float)).reshape(8, 8), f"1.2.{i // 8}", 100 - i % 8, (0.0, 0.0, 1.5 * (i % 8)), thickness=2.0) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.dcm" for i in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    files = _images(spark, d).select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(written, "path string, content binary")
    found = dicom.volumes(dicom.decoded_slices(files))
    mean = F.aggregate("data", F.lit(0.0), lambda s, x: s + x) / F.size("data")
    return found.select("series", "n_slices", F.round(mean, 6).alias("mean"), F.array_max("data").alias("most"), F.col("spacing")[0].alias("gap"), F.col("affine")[11].alias("z"), F.col("data")[0].alias("first_value"))


def _square(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("vec_id", F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").cast("array<double>").alias("image"))


@query()
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return kernels.component_sizes(_square(spark, d), "image", "shape", ["vec_id"])


@query()
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return kernels.mapped(_square(spark, d), "image", "shape", kernels.median_filtered, ["vec_id"])


@query(_LEVELS.format(n=16) + """
    , p AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, q, pos // 32 * 2 + pos % 8 // 4 AS tile FROM q), h AS (SELECT vec_id, tile, q, count(*) AS n FROM p GROUP BY ALL),
    g AS (SELECT DISTINCT e.vec_id, t.tile, b.q FROM embeddings e, range(0, 4) t(tile), range(0, 16) b(q)),
    m AS (SELECT vec_id, tile, q, (sum(least(coalesce(n, 0), 3.2)) OVER (PARTITION BY vec_id, tile ORDER BY q) + sum(greatest(coalesce(n, 0) - 3.2, 0)) OVER (PARTITION BY vec_id, tile) * (q + 1) / 16) / 16 AS s FROM g LEFT JOIN h USING (vec_id, tile, q)),
    w AS (SELECT 0 AS side, i, CASE WHEN i < 2 THEN 1 WHEN i < 6 THEN 1 - ((i + 0.5) / 4 - 0.5) ELSE 0 END AS w FROM range(0, 8) r(i) UNION ALL SELECT 1, i, CASE WHEN i < 2 THEN 0 WHEN i < 6 THEN (i + 0.5) / 4 - 0.5 ELSE 1 END FROM range(0, 8) r(i))
    SELECT p.vec_id, CAST(y * 8 + x AS INTEGER) AS pos, round(sum(a.w * b.w * s), 6) AS value FROM p JOIN w a ON a.i = y JOIN w b ON b.i = x JOIN m ON m.vec_id = p.vec_id AND m.q = p.q AND m.tile = a.side * 2 + b.side GROUP BY ALL
""")
def adaptive_equalisation(spark: SparkSession, d: str) -> DataFrame:
    found = kernels.mapped(_square(spark, d), "image", "shape", lambda a: kernels.adaptively_equalised(a, 4, 0.2, 16), ["vec_id"])
    return found.select("vec_id", F.posexplode("data").alias("pos", "value")).withColumn("value", F.round(F.col("value") * 1e6) / 1e6)  # values at a tie are rounded as SQL's round does


@query()
def linear_resample(spark: SparkSession, d: str) -> DataFrame:
    return kernels.mapped(_square(spark, d), "image", "shape", lambda a: kernels.resampled(a, (12, 16)), ["vec_id"])


@query()
def surface_distance(spark: SparkSession, d: str) -> DataFrame:
    e = _square(spark, d)
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("image").alias("other")), "vec_id")
    return kernels.compared(both, "image", "other", "shape", ["vec_id"])


@query(_VOXELS + """
    , p AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, v FROM v), m AS (SELECT vec_id, y, x, CAST(v > 0.2 AS INTEGER) AS c FROM p WHERE abs(v) > 0.15), n AS (SELECT vec_id, y, x FROM p WHERE abs(v) <= 0.15),
    d AS (SELECT n.vec_id, n.y, n.x, m.c, sqrt(power(n.y - m.y, 2) + power(n.x - m.x, 2)) AS d FROM n JOIN m USING (vec_id)), b AS (SELECT vec_id, y, x, first(c ORDER BY d, c) AS cluster FROM d WHERE d <= 2 GROUP BY ALL)
    SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(cluster AS INTEGER) AS cluster FROM n LEFT JOIN b USING (vec_id, y, x)
""")
def noise_assignment(spark: SparkSession, d: str) -> DataFrame:
    v = _images(spark, d).select("vec_id", F.posexplode(voxels.values("embedding")).alias("pos", "v")).select("vec_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), "v")
    members = v.filter("abs(v) > 0.15").withColumn("cluster", (F.col("v") > 0.2).cast("int"))
    return inference.nearest_cluster(v.filter("abs(v) <= 0.15").select("vec_id", "y", "x"), members, "vec_id", ["y", "x"], "cluster", within=2)


# ---------------------------------------------------------------- more image features


@query(_VOXELS + ", m AS (SELECT vec_id, median(v) AS m FROM v GROUP BY 1), d AS (SELECT vec_id, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS d FROM v JOIN m USING (vec_id) GROUP BY 1) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((v - m) / d, 6) + 0.0 AS value FROM v JOIN d USING (vec_id)")
def mad_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.mad_normalised(_images(spark, d), "embedding").select("vec_id", F.posexplode("normalised").alias("pos", "value")), "value")


@query(_VOXELS + ", q AS (SELECT vec_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM v GROUP BY 1) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(least(greatest(v, lo), hi), 6) + 0.0 AS value FROM v JOIN q USING (vec_id)")
def clip_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = voxels.clipped_to_percentiles(_images(spark, d), "embedding", 0.05, 0.95)
    return rounded(out.select("vec_id", F.posexplode("clipped").alias("pos", "value")), "value")


@query(_VOXELS + "SELECT vec_id, CAST((pos // 8 - 2) * 4 + pos % 8 - 2 AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM v WHERE pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5")
def crop_center(spark: SparkSession, d: str) -> DataFrame:
    out = _images(spark, d).select("vec_id", F.posexplode(voxels.central_crop(voxels.values("embedding"), 8, 8, 4, 4)).alias("pos", "value"))
    return rounded(out, "value")


@query(_VOXELS + "SELECT vec_id, round(avg(pos // 8) * 2, 6) AS row, round(avg(pos % 8) * 0.5, 6) AS col, CAST(count(*) AS DOUBLE) AS area FROM v WHERE v > 0 GROUP BY 1")
def center_of_mass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.centre_of_mass(_images(spark, d), "embedding", ["vec_id"], 8, (2.0, 0.5)), "row", "col", "area")


@query(_VOXELS + ", n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS place FROM v WHERE v > 0) SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(pos // 8 AS INTEGER) AS row, CAST(pos % 8 AS INTEGER) AS col, round(v, 6) AS value FROM n WHERE place % 3 = 0")
def voxel_sampling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.voxel_table(_images(spark, d), "embedding", ["vec_id"], 8, step=3), "value")


@query(_VOXELS + """
    , r AS (SELECT vec_id, v, avg(v) OVER (PARTITION BY vec_id) AS m FROM v WHERE v > 0)
    SELECT vec_id, round(avg(v), 5) AS mean, round(median(v), 5) AS median, round(min(v), 5) AS min, round(max(v), 5) AS max, round(max(v) - min(v), 5) AS range, round(stddev_pop(v), 5) AS std, round(var_pop(v), 5) AS variance, round(avg(abs(v - m)), 5) AS mean_absolute_deviation,
           round(sqrt(avg(v * v)), 5) AS root_mean_square, round(sum(v * v), 5) AS energy, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 5) AS quartile_range, round(avg(power(v - m, 3)) / power(var_pop(v), 1.5), 5) AS skewness, round(avg(power(v - m, 4)) / (var_pop(v) * var_pop(v)), 5) AS kurtosis FROM r GROUP BY 1
""")
def intensity_features(spark: SparkSession, d: str) -> DataFrame:
    out = voxels.intensity_features(_images(spark, d), "embedding", ["vec_id"])
    return rounded(out, *[c for c in out.columns if c != "vec_id"], digits=5)


# ---------------------------------------------------------------- reports of runs


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("failed: "), "event_type")).alias("error"))


_RESULTS = "WITH r AS (SELECT event_id, event_type, user_id, value, CASE WHEN event_id % 7 = 0 THEN 'failed: ' || event_type END AS error FROM events)"


@query(_RESULTS + "SELECT count(*) AS n_results, count(*) FILTER (WHERE error IS NULL) AS n_succeeded, count(error) AS n_failed, round(avg(CAST(error IS NULL AS INTEGER)), 6) AS success_rate, round(min(value) FILTER (WHERE error IS NULL), 5) AS min, round(max(value) FILTER (WHERE error IS NULL), 5) AS max, round(avg(value) FILTER (WHERE error IS NULL), 5) AS mean, round(stddev_pop(value) FILTER (WHERE error IS NULL), 5) AS std, round(sum(value) FILTER (WHERE error IS NULL), 3) AS sum FROM r")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = reports.run_summary(_results(spark, d), "error", "value")
    return rounded(rounded(rounded(out, "success_rate"), "min", "max", "mean", "std", digits=5), "sum", digits=3)


@query(_RESULTS + "SELECT error, count(*) AS n FROM r WHERE error IS NOT NULL GROUP BY 1")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.error_counts(_results(spark, d), "error")


@query(_RESULTS + "SELECT event_type, part, count(*) AS n, count(error) AS n_failed FROM (SELECT *, user_id % 3 AS part FROM r) GROUP BY GROUPING SETS ((event_type), (part), ())")
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.usage(_results(spark, d).withColumn("part", F.col("user_id") % 3), ["event_type", "part"], "error")


@query("SELECT count(*) AS n, round(avg(CAST(p_size > 24 AS INTEGER)), 6) AS share, CASE WHEN avg(CAST(p_size > 24 AS INTEGER)) >= 0.5 THEN '3D' ELSE '2D' END AS side, avg(CAST(p_size > 24 AS INTEGER)) > 0.3 AND avg(CAST(p_size > 24 AS INTEGER)) < 0.7 AS mixed FROM part")
def dimension_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.majority(table(spark, d, "part").withColumn("v", F.col("p_size") > 24), "v"), "share")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    return reports.most(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20)


_SLICES = """
WITH e AS (SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS volume, vec_id AS z, embedding FROM embeddings),
v AS (SELECT volume, z, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
s AS (SELECT volume, z, avg(x) AS m, stddev_pop(x) AS sd, max(x) - min(x) AS rg FROM v GROUP BY 1, 2),
t AS (SELECT *, avg(sd) OVER w AS msd, stddev_pop(sd) OVER w AS ssd, avg(rg) OVER w AS mrg FROM s WINDOW w AS (PARTITION BY volume)),
u AS (SELECT volume, count(*) AS n_slices, stddev_pop(m) AS mean_variation, stddev_pop(sd) AS std_variation, stddev_pop(rg) AS range_variation, count(*) FILTER (sd > msd + ssd) AS high_variance_slices, count(*) FILTER (rg < mrg * 0.5) AS low_signal_slices FROM t GROUP BY 1),
k AS (SELECT volume, z, row_number() OVER (PARTITION BY volume ORDER BY z) - 1 AS place, count(*) OVER (PARTITION BY volume) AS n FROM e),
q AS (SELECT *, greatest(2, CAST(floor(n * 0.1) AS BIGINT)) AS m FROM k),
p AS (SELECT volume, z, lead(z) OVER (PARTITION BY volume ORDER BY place) AS following FROM q WHERE n > 1 AND place IN (SELECT CASE WHEN j = m - 1 THEN n - 1 ELSE floor(j * ((n - 1) / (m - 1))) END FROM (SELECT unnest(range(0, m)) AS j))),
c AS (SELECT p.volume, p.z, 1 - abs(corr(a.x, b.x)) AS v FROM p JOIN v a ON a.z = p.z JOIN v b ON b.z = p.following AND b.i = a.i GROUP BY 1, 2),
r AS (SELECT volume, count(v) AS n_pairs, avg(v) AS variation FROM c GROUP BY 1),
g AS (SELECT volume, 1.5 * (volume % 5) AS spacing, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, avg(x * x) AS power, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END) AS sparsity FROM v GROUP BY 1),
h AS (SELECT volume, avg(power(x - mean, 3)) AS m3 FROM v JOIN g USING (volume) GROUP BY 1),
o AS (SELECT *, n_slices >= 30 AS enough, spacing <= 5 AS near, n_slices > 1 AND coalesce(variation >= 0.1, true) AS differ FROM u JOIN g USING (volume) JOIN h USING (volume) LEFT JOIN r USING (volume)),
d AS (SELECT *, CAST(enough AS INT) + CAST(near AS INT) + CAST(differ AS INT) >= 2 AS is_3d, CASE WHEN abs(n_slices - 30) > 10 THEN 'high' ELSE 'medium' END AS confidence FROM o)
"""


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as slices of volumes that grow in length, with different distances of slices."""
    volume = F.floor(F.sqrt("vec_id")).cast("long")
    slices = table(spark, d, "embeddings").select(volume.alias("volume"), "vec_id", "embedding", (1.5 * (volume % 5)).alias("spacing"))
    return dimension.dimension_analysis(slices, "volume", "vec_id", "embedding", "spacing")


@query(
    _SLICES + """SELECT volume, n_slices, CAST(spacing AS DOUBLE) AS spacing, coalesce(n_pairs, 0) AS n_pairs, round(variation, 6) AS variation, is_3d,
concat_ws(',', CASE WHEN enough THEN 'slices' END, CASE WHEN near THEN 'spacing' END, CASE WHEN differ THEN 'variation' END) AS reasons, confidence,
concat_ws(',', CASE WHEN m3 / power(std, 3) > 2 THEN 'log_transform' END, CASE WHEN std / (mean + 1e-8) < 0.1 THEN 'contrast_enhancement' END, CASE WHEN spacing > 3 THEN 'interpolation' END) AS preparation,
CASE WHEN is_3d AND n_slices > 64 THEN '3d_unet,3d_vnet,cascade_3d' WHEN is_3d THEN '3d_unet,3d_vnet' ELSE '2d_unet,2d_attention_unet,slice_ensemble' END AS models,
round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(m3 / power(std, 3), 6) AS skewness, round(power / (std * std), 6) AS signal_to_noise, CAST(floor(log2(max - min + 1)) AS INT) AS effective_bits, round(sparsity, 6) AS sparsity,
round(mean_variation, 6) AS mean_variation, round(std_variation, 6) AS std_variation, round(range_variation, 6) AS range_variation, high_variance_slices, low_signal_slices FROM d"""
)
def volume_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_analysed(spark, d), "variation", "mean", "std", "min", "max", "skewness", "signal_to_noise", "sparsity", "mean_variation", "std_variation", "range_variation")


@query(_SLICES + "SELECT count(*) AS n_volumes, count(*) FILTER (is_3d) AS n_3d, count(*) FILTER (confidence = 'high') AS n_high, CASE WHEN 2 * count(*) FILTER (is_3d) > count(*) THEN '3D' ELSE '2D' END AS approach, round(greatest(count(*) FILTER (is_3d), count(*) FILTER (NOT is_3d)) / count(*), 6) AS share, count(*) FILTER (is_3d) / count(*) > 0.3 AND count(*) FILTER (is_3d) / count(*) < 0.7 AS mixed FROM d")
def batch_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dimension.batch_recommendation(_analysed(spark, d)), "share")


_GRID = "WITH v AS (SELECT vec_id, (i - 1) // 16 AS a, (i - 1) // 4 % 4 AS b, (i - 1) % 4 AS c, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as volumes of 4 x 4 x 4 whose axes are oblique and whose origin depends on the vector."""
    rows = ((2.0, 0.5, 0.0, F.col("vec_id").cast("double")), (0.0, 1.5, 0.25, F.lit(-3.0)), (0.0, 0.0, 4.0, F.lit(7.0)), (0.0, 0.0, 0.0, F.lit(1.0)))
    affine = F.array(*[x if not isinstance(x, float) else F.lit(x) for row in rows for x in row])
    data = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.array(*[F.lit(4)] * 3).alias("shape"), affine.alias("affine"), data.alias("data"), F.transform(data, lambda x: (x > 0.2).cast("int")).alias("mask"))


def _described(df: DataFrame, *more: str) -> DataFrame:
    lengths = F.concat_ws("x", F.col("shape").cast("array<string>"))
    out = df.select("vec_id", *more, lengths.alias("lengths"), voxels.total(F.col("data")).alias("total"), F.col("data")[0].alias("first"), *[F.col("affine")[4 * r + 3].alias(n) for r, n in enumerate("xyz")])
    return rounded(out, "total", "first", "x", "y", "z")


@query(_GRID + """, s AS (SELECT vec_id, sum(x) AS whole, min(x) AS least, sum(x) FILTER (a BETWEEN 1 AND 2 AND c < 3) AS kept, max(x) FILTER (a = 1 AND b = 0 AND c = 0) AS here FROM v GROUP BY 1)
SELECT vec_id, 'crop' AS way, '2x4x3' AS lengths, round(kept, 6) AS total, round(here, 6) AS first, vec_id + 2.0::DOUBLE AS x, -3.0::DOUBLE AS y, 7.0::DOUBLE AS z FROM s
UNION ALL SELECT vec_id, 'pad', '7x4x6', round(whole + least * (7 * 4 * 6 - 64), 6), round(least, 6), vec_id - 2.0::DOUBLE, -3.25::DOUBLE, 3.0::DOUBLE FROM s""")
def volume_windows(spark: SparkSession, d: str) -> DataFrame:
    e = _grid(spark, d)
    ways = [_described(f.withColumn("way", F.lit(n)), "way") for n, f in (("crop", grids.centre_cropped(e, (2, 9, 3))), ("pad", grids.padded(e, (7, 2, 6), "min")))]
    return ways[0].unionByName(ways[1])


@query(_GRID + """, o AS (SELECT vec_id, greatest(min(a) - 1, 0) AS a0, least(max(a) + 2, 4) AS a1, min(b) AS b0, max(b) + 1 AS b1, greatest(min(c) - 1, 0) AS c0, least(max(c) + 2, 4) AS c1 FROM v WHERE x > 0.2 GROUP BY 1)
SELECT vec_id, count(*) FILTER (v.x > 0.2) AS n_mask, concat_ws('x', a1 - a0, b1 - b0, c1 - c0) AS lengths, round(sum(v.x), 6) AS total, round(max(v.x) FILTER (a = a0 AND b = b0 AND c = c0), 6) AS first, round(vec_id + 2.0 * a0 + 0.5 * b0, 6)::DOUBLE AS x, round(-3 + 1.5 * b0 + 0.25 * c0, 6)::DOUBLE AS y, (7 + 4.0 * c0)::DOUBLE AS z
FROM v JOIN o USING (vec_id) WHERE a >= a0 AND a < a1 AND b >= b0 AND b < b1 AND c >= c0 AND c < c1 GROUP BY vec_id, a0, a1, b0, b1, c0, c1""")
def region_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = grids.regions_of_interest(_grid(spark, d), margin=(1, 0, 1))
    return _described(found.withColumn("n_mask", F.size(F.filter("mask", lambda x: x > 0)).cast("long")), "n_mask")


@query(_GRID + " SELECT vec_id, '4x4x4' AS lengths, round(sum(x), 6) AS total, round(max(x) FILTER (a = 0 AND b = 0 AND c = 0), 6) AS first, round(max(x) FILTER (a = 0 AND b = 0 AND c = 1), 6) AS second, vec_id::DOUBLE AS x, -3.0::DOUBLE AS y, 7.0::DOUBLE AS z FROM v GROUP BY vec_id")
def nrrd_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Volumes written as files, every other one packed, and read back."""
    e = _grid(spark, d).withColumn("path", F.col("vec_id").cast("string"))
    files = nrrd.encoded(e.filter("vec_id % 2 = 0"), "gzip").unionByName(nrrd.encoded(e.filter("vec_id % 2 = 1"), "raw"))
    found = images.decoded(files, nrrd.decode_nrrd).withColumn("vec_id", F.col("path").cast("long"))
    return rounded(_described(found.withColumn("second", F.col("data")[1]), "second"), "second")
