"""One query for each corpus operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.centroids import ClusterRules, cluster_report
from tidemill.llm.common import table
from tidemill.llm.html import page_texts
from tidemill.llm.langid import language_report
from tidemill.llm.media import read_back, store_texts
from tidemill.llm.minhash import near_duplicates
from tidemill.llm.mixing import label_domains, mixing_rates
from tidemill.llm.negatives import hard_negatives
from tidemill.llm.neighbours import nearest
from tidemill.llm.packing import pack
from tidemill.llm.passages import repeated_passages
from tidemill.llm.repeats import repeat_report
from tidemill.llm.secrets import secret_report
from tidemill.llm.warc import archive_report

Query = Callable[[SparkSession, str], DataFrame]

#: Shares of the token total that the mixing query aims at.
TARGET_WEIGHTS = {"good": 0.6, "poor": 0.3, "toxic": 0.1}


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store_texts(table(spark, sf_dir, "documents")))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGET_WEIGHTS)


def op4_warc_splittable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(spark, table(spark, sf_dir, "pages"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op11_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents")).drop("kept")


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def _cluster_sql(rules: ClusterRules) -> str:
    """All rounds, one after another: plain nearest centroids and floored means."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{rules.seed}:' || vec_id)) - 1 AS cluster, v AS c FROM kept
  QUALIFY cluster < {rules.clusters}
)""",
    ]
    for r in range(rules.rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := {gap}::BIGINT, cluster := cluster)) AS best FROM kept, c{r} GROUP BY vec_id, v
)""")
        if r < rules.rounds:
            steps.append(f"""m{r} AS (
  SELECT best.cluster AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(mean, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS mean FROM m{r} GROUP BY cluster) USING (cluster)
)""")
    last = rules.rounds
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.cluster = best.cluster"""


QUERIES: dict[str, Query] = {
    "op1_lossless_webp": op1_lossless_webp,
    "op2_compact_windows": op2_compact_windows,
    "op3_mixing_to_targets": op3_mixing_to_targets,
    "op4_warc_splittable": op4_warc_splittable,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_language_id": op6_language_id,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_packing": op9_packing,
    "op10_html_main_text": op10_html_main_text,
    "op11_radix_negatives": op11_radix_negatives,
    "op12_run_length_index": op12_run_length_index,
    "op13_sort_means": op13_sort_means,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    # Base32 of the SHA-1: each 5 hex digits are 4 digits of the result.
    "op4_warc_splittable": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p
), b AS (
  SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)) AS digits FROM f
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(digits, '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
""",
    "op11_radix_negatives": """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, a.label AS own, b.r AS other, b.vec_id, b.label,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM kept a, kept b WHERE a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)
), positive AS (
  SELECT r, anchor_id, own, other, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY r, p.other ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored n USING (r)
WHERE n.label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
    # Two hex digits are a byte.
    "op12_run_length_index": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS t(i)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s
), hit AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS begins FROM w JOIN f USING (s) WHERE doc_id > first
), run AS (
  SELECT doc_id, i, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, g
), piece AS (
  SELECT doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER o + 1, 2 * (a - lag(b, 1, 0) OVER o)) AS s FROM span JOIN d USING (doc_id)
  WINDOW o AS (PARTITION BY doc_id ORDER BY a)
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(s, '' ORDER BY a) AS kept, max(b) AS tail,
         string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM piece GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN cut USING (doc_id)
""",
    "op13_sort_means": _cluster_sql(ClusterRules()),
}
