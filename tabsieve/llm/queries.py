"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan
from .common import read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import collapse_and_render

    return collapse_and_render(read(spark, sf_dir, "conversations"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(spark, read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode, public_file

    return encode(read(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import rate

    return rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op1_chat_format": """
        WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS n
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list(turn || chr(0) || role || chr(0) || text ORDER BY n) AS ts FROM t GROUP BY conv_id),
        gone AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON a.ts[1] = b.ts[1] AND len(a.ts) < len(b.ts) AND b.ts[:len(a.ts)] = a.ts)
        SELECT conv_id, n // 1024 AS part, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY n) AS text
        FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY ALL""",
    "op8_license_scan": license_scan.oracle(),
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, first_value(page_id) OVER w AS first, payload_bytes >= 100 AND row_number() OVER w > 1 AS again
              FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to FROM g""",
    "op6_nearest_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
}
