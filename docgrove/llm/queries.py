"""The queries opN of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table


def op1_near_dup_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_dups

    return near_dups(table(spark, sf_dir, "embeddings"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_of, read_archives, resolve_revisits, write_archives

    folder, manifest = write_archives(table(spark, sf_dir, "pages"))
    records = resolve_revisits(save(read_archives(folder, manifest, payloads=False)))  # archives are read once
    return records.select(
        page_of("record_id").alias("page_id"),
        F.coalesce("response_length", F.lit(-1).cast("long")).alias("payload_bytes"),
        F.coalesce("response_digest", F.lit("unresolved")).alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), by_size=True)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_documents

    return near_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edits import compare_next

    return compare_next(table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, fit

    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup_embeddings": op1_near_dup_embeddings,
    "op2_lm_score": op2_lm_score,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_mix_sources": op4_mix_sources,
    "op5_best_fit": op5_best_fit,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_fingerprints": op8_fingerprints,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Where SQL can say the same; the others are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op3_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
q AS (SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
 max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL AND doc_id <> keep) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 60 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, coalesce((SELECT count(*) FROM l WHERE l.a = n.doc_id), 0) AS n_similar, (SELECT min(other) FROM r WHERE r.doc_id = n.doc_id) AS component_id FROM n""",
}
