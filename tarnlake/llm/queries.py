"""The registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import centroids, chat, decontaminate, exact_dedup, filter_audit, merkle, near_dedup, ngram_lm, packing, quality, secrets, suffix_dedup, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


def op6_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(_documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_repeats(_documents(spark, sf_dir)).drop("spans")


def op4_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.branch_preferences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir), tokenizer_path(), short_first=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), k=4, threshold=(85, 100))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_neighbours(_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("n_verified")


def centroid_sql(clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The clustering in plain SQL: every vector against every centroid, component by component."""
    parts = [f"""
        WITH kept AS (
            SELECT row_number() OVER () AS row, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings WHERE len(embedding) = {dimensions} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), cells AS (SELECT row, unnest(range(1, {dimensions + 1})) AS i, unnest(v) AS x FROM kept),
        c0 AS (
            SELECT place - 1 AS k, unnest(range(1, {dimensions + 1})) AS i, unnest(v) AS y
            FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS place FROM kept) WHERE place <= {clusters}
        )"""]
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS (
            SELECT row, arg_min(k, struct_pack(s := s, k := k)) AS k, min(s) AS s
            FROM (SELECT row, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS s FROM cells JOIN c{r} USING (i) GROUP BY row, k) GROUP BY row
        )""")
        if r < rounds:
            parts.append(f"""
        c{r + 1} AS (
            SELECT k, i, coalesce(m, y) AS y FROM c{r} LEFT JOIN (
                SELECT k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM cells JOIN a{r} USING (row) GROUP BY k, i
            ) USING (k, i)
        )""")
    return ",".join(parts) + f"""
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM kept JOIN a{rounds} USING (row) JOIN (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k) USING (k)
    """


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_secret_scan, op3_suffix_array_dedup, op4_chat_preferences, op5_best_fit_packing, op6_kneser_ney_lm, op7_quality_classifier, op8_warc_converter, op9_ngram_jaccard_join, op10_decontamination, op11_document_fingerprints, op12_filter_audit, op13_centroid_clustering)}

ORACLE_SQL = {
    "op13_centroid_clustering": centroid_sql(),
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
        ), l AS (
            SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1
        ), f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
            FROM w LEFT JOIN l USING (doc_id)
        ), k AS (
            SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2
        ), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), s AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS earlier FROM o, range(1, 6) r(step)
        ), m AS (
            SELECT k.*, filter_order, step, own, contains(failed, own) AS fails, len([y FOR y IN earlier IF y <> '' AND contains(failed, y)]) > 0 AS gone FROM k, s
        ), g AS (
            SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
            FROM m GROUP BY 1, 2, 3, 4
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM g
    """,
    "op4_chat_preferences": """
        WITH t AS (
            SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), s AS (
            SELECT conv_id, min(place) AS early, max(place) AS late FROM t WHERE role = 'assistant' GROUP BY 1 HAVING max(place) > min(place)
        ), o AS (
            SELECT conv_id AS pair_id, true AS is_chosen, place, role, text FROM t JOIN s USING (conv_id) WHERE place <= late
            UNION ALL SELECT conv_id, false, place, role, text FROM t JOIN s USING (conv_id) WHERE place < late
            UNION ALL SELECT conv_id, false, late, role, text FROM t JOIN s USING (conv_id) WHERE place = early
        ), n AS (
            SELECT c.pair_id, coalesce(min(c.place) FILTER (WHERE c.role <> r.role OR c.text <> r.text) - 1, max(c.place)) AS n_common
            FROM o c JOIN o r ON c.pair_id = r.pair_id AND c.place = r.place AND c.is_chosen AND NOT r.is_chosen GROUP BY 1
        ), l AS (
            SELECT pair_id, n_common, is_chosen, place, role, '<|' || role || chr(124) || '>' || chr(10) || text || '<|end|>' || chr(10) AS line, length(text) AS chars
            FROM o JOIN n USING (pair_id)
        ), e AS (
            SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, is_chosen, place <= n_common ORDER BY place) AS stop FROM l
        )
        SELECT pair_id, pair_id AS chosen_conv, pair_id AS rejected_conv, CAST(n_common AS BIGINT) AS n_common,
               coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE is_chosen AND place <= n_common), '') AS prompt,
               coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE is_chosen AND place > n_common), '') AS chosen,
               coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE NOT is_chosen AND place > n_common), '') AS rejected,
               coalesce(string_agg(CAST(stop - chars - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (WHERE is_chosen AND place > n_common AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg(CAST(stop - chars - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (WHERE NOT is_chosen AND place > n_common AND role = 'assistant'), '') AS rejected_mask
        FROM e GROUP BY pair_id, n_common
    """,
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS n FROM documents
        ), r AS (
            SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY body) AS group_size
            FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
        )
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r
    """,
}
