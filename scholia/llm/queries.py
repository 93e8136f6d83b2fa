"""The operators applied to their whole tables: name -> query, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontamination, language_id, license_scan, line_dedup, ngram_jaccard, packing, quality_classifier, quality_rules, suffix_array, token_counts
from scholia.llm.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence.n_words", "licence.n_base", "licence.first_word", "licence.last_word", "licence.base_labels", "licence.labels", "licence.score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.quality_classifier(docs, table(spark, sf_dir, "labels"), columns=["doc_id"]).select("doc_id", "log_weight", "chance", "sample_key", "kept")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.suffix_array_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    found = language_id.language_id(docs, usable=remainder != 2)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "language.*")


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_token_counts, op3_packing, op4_quality_classifier, op5_benchmark_decontamination, op6_line_dedup, op7_quality_rules, op8_suffix_array_dedup, op9_ngram_jaccard, op10_language_id)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL = {
    "op5_benchmark_decontamination": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (
            SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
            FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
        doc AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
        occurs AS (
            SELECT doc_id, p, d.k, item FROM (
                SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
                FROM doc, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS t(p)) AS d
            JOIN win ON win.k = d.k AND win.s = d.s),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM occurs, unnest(range(p, p + k)) AS t(q) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM occurs) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        line AS (
            SELECT doc_id, i, l[i] AS line, {_LOWER.format("trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM split, unnest(range(1, len(l) + 1)) AS t(i)),
        gone AS (SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
        FROM line LEFT JOIN gone ON line.key = gone.key GROUP BY doc_id""",
    # Bytes as hexadecimal digits, two each. A repeated window covers 50 bytes from p on; q is the repeated window before it.
    "op8_suffix_array_dedup": """
        WITH doc AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        win AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM doc, unnest(range(0, n - 49)) AS t(p)),
        first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        dup AS MATERIALIZED (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM win JOIN first USING (s) WHERE doc_id > m),
        total AS (SELECT doc_id, sum(least(50, p - coalesce(q, p - 50))) AS n_removed, count(*) FILTER (WHERE q IS NULL OR p > q + 50) AS n_spans FROM dup GROUP BY doc_id),
        piece AS (
            SELECT doc_id, coalesce(q + 50, 0) AS a, p AS b FROM dup WHERE q IS NULL OR p > q + 50
            UNION ALL SELECT doc_id, max(p) + 50, 1000000000 FROM dup GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (least(b, n) - a)), '' ORDER BY a) AS k FROM piece JOIN doc USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM doc LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_ngram_jaccard": f"""
        WITH RECURSIVE doc AS (SELECT doc_id, {_SPACED_WORDS} AS w FROM documents),
        shingle AS (
            SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        link AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * shared >= 80 * (sa.n + sb.n - shared)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
        FROM documents LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
}
