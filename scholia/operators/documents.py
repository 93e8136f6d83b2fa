"""Planned in the reference's design documents: recognised exam papers as nested JSON, to rows.

The envelope is parsed with a fixed schema; values are text with a confidence. Own decisions where the documents
leave room: a text that isn't JSON, or has another status, gives status null; a confidence that is missing counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this a field needs a review. Fixed value.
CONFIDENT = 0.80
METADATA = ("schoolYear", "term", "subject", "course", "class", "examType", "durationMinutes", "variant", "title", "instructions")
STATUSES = ("success", "partial", "error")
QUESTION_TYPES = ("multiple_choice", "short_answer", "development", "true_false")

_FIELD = "STRUCT<value: STRING, confidence: DOUBLE>"
_QUESTION = f"STRUCT<number: INT, confidence: DOUBLE, text: {_FIELD}, questionType: {_FIELD}, maxScore: {_FIELD}, options: ARRAY<STRUCT<optionLabel: STRING, optionText: STRING, confidence: DOUBLE>>, pageIndex: INT, startY: INT, endY: INT>"
SCHEMA_V1 = (
    "status STRING, requestId STRING, processingTimeMs BIGINT, overallConfidence DOUBLE, document STRUCT<pageCount: INT, mainLanguage: STRING, hasTables: BOOLEAN>, "
    f"metadata STRUCT<{', '.join(f'`{n}`: {_FIELD}' for n in METADATA)}>, questions ARRAY<{_QUESTION}>, "
    "unmappedContent ARRAY<STRUCT<pageIndex: INT, text: STRING, confidence: DOUBLE>>, warnings ARRAY<STRUCT<code: STRING, field: STRING, confidence: DOUBLE>>"
)
#: Versions of the contract.
SCHEMAS = {1: SCHEMA_V1}


def parse(raw: DataFrame, body: str = "body", version: int = 1) -> DataFrame:
    """All columns of raw but the body, and the struct `paper`."""
    parsed = raw.withColumn("paper", F.from_json(body, SCHEMAS[version])).drop(body)
    known = F.when(F.col("paper.status").isin(*STATUSES), F.col("paper.status"))
    return parsed.withColumn("paper", F.col("paper").withField("status", known))


def _low(confidence: Column, limit: float) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < F.lit(limit)


def metadata_rows(papers: DataFrame, limit: float = CONFIDENT) -> DataFrame:
    """(request_id, field, value, confidence, needs_review): a row for each of the ten fields."""
    entries = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"paper.metadata.{n}.value").alias("value"), F.coalesce(f"paper.metadata.{n}.confidence", F.lit(0.0)).alias("confidence")) for n in METADATA))
    rows = papers.select(F.col("paper.requestId").alias("request_id"), F.explode(entries).alias("e"))
    return rows.select("request_id", "e.*", _low(F.col("e.confidence"), limit).alias("needs_review"))


def questions(papers: DataFrame, limit: float = CONFIDENT) -> DataFrame:
    """A row for each question; needs_review where any of its fields is unsure."""
    rows = papers.select(F.col("paper.requestId").alias("request_id"), F.posexplode("paper.questions").alias("order_index", "q"))
    low = _low(F.col("q.text.confidence"), limit) | _low(F.col("q.questionType.confidence"), limit) | _low(F.col("q.maxScore.confidence"), limit) | F.exists(F.coalesce("q.options", F.array()), lambda o: _low(o["confidence"], limit))
    kind = F.when(F.col("q.questionType.value").isin(*QUESTION_TYPES), F.col("q.questionType.value"))
    return rows.select("request_id", "order_index", F.col("q.number").alias("number"), F.col("q.text.value").alias("text"), kind.alias("question_type"), F.col("q.maxScore.value").try_cast("double").alias("max_score"), F.col("q.pageIndex").alias("page_index"), F.col("q.confidence").alias("confidence"), low.alias("needs_review"))


def options(papers: DataFrame, outer: bool = False) -> DataFrame:
    """A row for each option; with outer, a row of nulls for a question without options."""
    asked = papers.select(F.col("paper.requestId").alias("request_id"), F.explode("paper.questions").alias("q"))
    explode = F.posexplode_outer if outer else F.posexplode
    rows = asked.select("request_id", F.col("q.number").alias("number"), explode("q.options").alias("order_index", "o"))
    return rows.select("request_id", "number", "order_index", F.col("o.optionLabel").alias("option_label"), F.col("o.optionText").alias("option_text"), F.col("o.confidence").alias("confidence"))


def confident_questions(papers: DataFrame, limit: float = CONFIDENT) -> DataFrame:
    """The papers with only those questions that are sure enough as a whole."""
    return papers.withColumn("paper", F.col("paper").withField("questions", F.filter("paper.questions", lambda q: ~_low(q["confidence"], limit))))


def review_flags(papers: DataFrame, limit: float = CONFIDENT) -> DataFrame:
    """(request_id, status, overall_confidence, n_questions, n_warnings, low_fields, needs_review)."""
    low = F.array_compact(F.array(*(F.when(F.col(f"paper.metadata.{n}.value").isNotNull() & _low(F.col(f"paper.metadata.{n}.confidence"), limit), F.lit(n)) for n in METADATA)))
    asked = F.exists(F.coalesce("paper.questions", F.array()), lambda q: _low(q["confidence"], limit))
    return papers.select(
        F.col("paper.requestId").alias("request_id"), F.col("paper.status").alias("status"), F.col("paper.overallConfidence").alias("overall_confidence"),
        F.coalesce(F.size("paper.questions"), F.lit(0)).cast("bigint").alias("n_questions"), F.coalesce(F.size("paper.warnings"), F.lit(0)).cast("bigint").alias("n_warnings"),
        F.array_join(low, ",").alias("low_fields"), ((F.size(low) > 0) | asked | (F.col("paper.status") != "success")).alias("needs_review"),
    )


def school_years_wanted(papers: DataFrame) -> DataFrame:
    """(start_year, end_year) named by papers as `2024/2025`."""
    parts = F.split("paper.metadata.schoolYear.value", "/")
    years = papers.select(F.get(parts, F.lit(0)).try_cast("int").alias("start_year"), F.get(parts, F.lit(1)).try_cast("int").alias("end_year"))
    return years.where("start_year < end_year").distinct()


def school_years_to_create(papers: DataFrame, school_years: DataFrame) -> DataFrame:
    """Those that no row has, of any state."""
    return school_years_wanted(papers).join(school_years.select("start_year", "end_year"), ["start_year", "end_year"], "left_anti")


def question_type(body: Column, n_options: Column) -> Column:
    """Own rules: two options of true and false, any options, a short prompt, else a development."""
    words = F.size(F.split(F.trim(body), r"\s+"))
    return F.when(body.rlike(r"(?i)\btrue\b.*\bfalse\b"), "true_false").when(n_options > 0, "multiple_choice").when(words <= 25, "short_answer").otherwise("development")


def segments(raw: DataFrame, body: str = "body") -> DataFrame:
    """Questions of a plain text by their numbers at line starts: (columns of raw but the body, number, text, question_type)."""
    found = raw.withColumn("_s", F.explode(F.regexp_extract_all(body, F.lit(r"(?ms)(^\s*\d{1,3}[.)]\s.*?)(?=^\s*\d{1,3}[.)]\s|\z)"), F.lit(1)))).drop(body)
    text = F.trim(F.regexp_replace("_s", r"^\s*\d{1,3}[.)]\s+", ""))
    labels = F.size(F.regexp_extract_all("_s", F.lit(r"(?m)^\s*([A-H])[.)]\s"), F.lit(1)))
    return found.select(*(c for c in found.columns if c != "_s"), F.regexp_extract("_s", r"^\s*(\d{1,3})", 1).cast("int").alias("number"), text.alias("text"), question_type(text, labels).alias("question_type"))


def operations(papers: DataFrame) -> DataFrame:
    """One row: how papers fare. Papers without a page have no time per page."""
    warned = (F.coalesce(F.size("paper.warnings"), F.lit(0)) > 0).cast("double")
    return papers.agg(F.count(F.lit(1)).alias("n"), F.avg(F.try_divide("paper.processingTimeMs", "paper.document.pageCount")).alias("ms_per_page"), F.avg("paper.overallConfidence").alias("confidence"), F.avg(warned).alias("warning_rate"), F.percentile_approx("paper.processingTimeMs", 0.95).alias("p95_ms"))
