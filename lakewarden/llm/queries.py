"""The operators over their whole tables with production parameters, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, centroids, exact_dedup, html_wrapper, jaccard_join, license_scan, packing, pii, quality_classifier, quality_rules, secret_scan, suffix_dedup
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.drop("spans")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digests=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE], F.sha2(secret_scan.shown("base"), 256).alias("base_sha256"), secret_scan.shown("spans").alias("spans"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def _rounds_sql(rounds: int) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT v.vec_id, min(struct_pack(d := {distance}, c := c.c)) AS best FROM v, c{r} AS c GROUP BY v.vec_id)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT best.c AS c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id), range(1, 65) AS t(i) GROUP BY ALL),
                m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c),
                c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",\n".join(parts)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_license_scan, op3_bpe_round_trip, op4_quality_classifier, op5_exact_dedup, op6_pii, op7_html_extraction,
        op8_best_fit_packing, op9_quality_rules, op10_secret_scan, op11_centroid_clustering, op12_token_alignment,
        op13_suffix_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
    """,
    "op11_centroid_clustering": f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT 16),
        {_rounds_sql(centroids.ROUNDS)}
        SELECT a.vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
               sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{centroids.ROUNDS} AS a JOIN c{centroids.ROUNDS} AS c ON c.c = best.c
    """,
    "op13_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 698) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 300)) AS o FROM d WHERE length(h) >= 100)),
             w AS (SELECT doc_id, o, part, unnest(range(0, length(part) // 2 - 49)) AS q FROM c),
             k AS (SELECT doc_id, o + q AS p, md5_number(substr(part, 2 * q + 1, 100)) AS s FROM w),
             low AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
             hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM k JOIN low USING (s) WHERE least < doc_id),
             runs AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
             gone AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
             stay AS (
                SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM gone
                UNION ALL
                SELECT doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN gone USING (doc_id) GROUP BY doc_id
             ),
             kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS rest FROM stay JOIN d USING (doc_id) GROUP BY doc_id),
             n AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS removed FROM gone GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
