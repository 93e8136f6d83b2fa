"""Recognised papers made of the driver's table `part`, and the rows that queries over them give, as SQL over their JSON.

A paper's JSON is one expression that both engines run. It has every status and an unknown one, fields of any confidence,
missing fields, questions of known and unknown kind with and without options, pages from 0 on, and papers without contents.
Confidences are eighths, so that means are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import documents
from scholia.sources.fixtures import driver_table


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _sure(k: str) -> str:
    return f"'0.' || lpad({_text(f'(({k}) % 8) * 125')}, 3, '0')"


def _field(value: str, k: str) -> str:
    """value: an expression that gives JSON."""
    return f"'{{\"value\":' || {value} || ',\"confidence\":' || {_sure(k)} || '}}'"


def _quoted(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def _question(number: int, text: str, kind: str, score: str, more: str, k: str) -> str:
    return (
        f"'{{\"number\":{number},\"confidence\":' || {_sure(k)} || ',\"text\":' || {_field(_quoted(text), k + ' + 3')} || ',\"questionType\":' || {_field(_quoted(kind), k + ' + 6')}"
        f" || ',\"maxScore\":' || {_field(score, k + ' + 7')} || {more} || ',\"pageIndex\":{number - 1},\"startY\":1,\"endY\":2}}'"
    )


_FIRST = _question(1, "p_type", "CASE p_partkey % 3 WHEN 0 THEN 'short_answer' WHEN 1 THEN 'riddle' ELSE 'true_false' END", f"CASE WHEN p_partkey % 4 = 1 THEN '\"many\"' ELSE {_text('p_size')} END", "''", "p_partkey")
_CHOICES = f"',\"options\":[{{\"optionLabel\":\"A\",\"optionText\":\"' || p_brand || '\",\"confidence\":' || {_sure('p_size')} || '}},{{\"optionLabel\":\"B\",\"optionText\":\"other\",\"confidence\":0.875}}]'"
_SECOND = _question(2, "p_name", "'multiple_choice'", "'2'", _CHOICES, "p_size + 4")
_YEARS = _quoted(f"{_text('2000 + p_size')} || '/' || {_text('2001 + p_size - 2 * (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)')}")
_BODY = (
    "CASE WHEN p_partkey % 7 = 0 THEN '{\"status\":\"error\",\"requestId\":\"p' || " + _text("p_partkey") + " || '\"}' ELSE "
    "'{\"status\":\"' || CASE p_partkey % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'queued' ELSE 'success' END || '\",\"requestId\":\"p' || " + _text("p_partkey")
    + " || '\",\"processingTimeMs\":' || " + _text("p_size * 100") + " || ',\"overallConfidence\":' || " + _sure("p_size")
    + " || ',\"document\":{\"pageCount\":' || CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '4' END || ',\"mainLanguage\":\"pt\",\"hasTables\":false},\"metadata\":{\"course\":' || " + _field(_quoted("p_name"), "p_partkey + 2")
    + " || ',\"schoolYear\":' || " + _field(_YEARS, "p_partkey + 5") + " || CASE WHEN p_partkey % 2 = 0 THEN ',\"durationMinutes\":' || " + _field(_text("p_size"), "p_size + 1") + " ELSE '' END"
    + " || '},\"questions\":[' || " + _FIRST + " || CASE WHEN p_partkey % 2 = 0 THEN ',' || " + _SECOND + " ELSE '' END"
    + " || '],\"unmappedContent\":[],\"warnings\":[' || CASE WHEN p_partkey % 3 = 0 THEN '{\"code\":\"BLUR\",\"field\":\"term\",\"confidence\":0.5}' ELSE '' END || ']}' END"
)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.parse(driver_table(spark, sf_dir, "part").select(F.expr(_BODY).alias("body")))


def _low(path: str, json: str = "q") -> str:
    return f"coalesce(CAST(json_extract({json}, {path}) AS DOUBLE), 0) < {documents.CONFIDENT}"


_NAMES = ", ".join(f"'{n}'" for n in documents.METADATA)
_KINDS = ", ".join(f"'{n}'" for n in documents.QUESTION_TYPES)
_STATUSES = ", ".join(f"'{n}'" for n in documents.STATUSES)
_PAPER = f"paper AS (SELECT {_BODY.replace('AS STRING', 'AS VARCHAR')} AS body FROM part)"
_REQUEST = "json_extract_string(body, '$.requestId') AS request_id"
_ASKED = f"{_PAPER}, asked AS (SELECT {_REQUEST}, CAST(i AS INTEGER) AS order_index, json_extract(body, '$.questions[' || i || ']') AS q FROM paper, unnest(range(0, CAST(json_array_length(body, '$.questions') AS BIGINT))) AS t(i))"
_QUESTIONS = f"""CAST(json_extract(q, '$.number') AS INTEGER) AS number, json_extract_string(q, '$.text.value') AS text,
    CASE WHEN json_extract_string(q, '$.questionType.value') IN ({_KINDS}) THEN json_extract_string(q, '$.questionType.value') END AS question_type,
    TRY_CAST(json_extract_string(q, '$.maxScore.value') AS DOUBLE) AS max_score, CAST(json_extract(q, '$.pageIndex') AS INTEGER) AS page_index, CAST(json_extract(q, '$.confidence') AS DOUBLE) AS confidence,
    {_low("'$.text.confidence'")} OR {_low("'$.questionType.confidence'")} OR {_low("'$.maxScore.confidence'")} OR coalesce(len(list_filter(json_extract(q, '$.options[*].confidence'), lambda x: CAST(x AS DOUBLE) < {documents.CONFIDENT})) > 0, false) AS needs_review"""
_YEAR = "json_extract_string(body, '$.metadata.schoolYear.value')"
_PAGES = "nullif(CAST(json_extract(body, '$.document.pageCount') AS DOUBLE), 0)"
_MS = "CAST(json_extract(body, '$.processingTimeMs') AS BIGINT)"
PAPERS_SQL = {
    "metadata": f"""WITH {_PAPER} SELECT {_REQUEST}, f AS field, json_extract_string(body, '$.metadata.' || f || '.value') AS value,
        coalesce(CAST(json_extract(body, '$.metadata.' || f || '.confidence') AS DOUBLE), 0) AS confidence, {_low("'$.metadata.' || f || '.confidence'", "body")} AS needs_review FROM paper, unnest([{_NAMES}]) AS t(f)""",
    "questions": f"WITH {_ASKED} SELECT request_id, order_index, {_QUESTIONS} FROM asked",
    "confident_questions": f"WITH {_ASKED} SELECT request_id, {_QUESTIONS} FROM asked WHERE NOT ({_low("'$.confidence'")})",
    "options": f"""WITH {_ASKED} SELECT request_id, CAST(json_extract(q, '$.number') AS INTEGER) AS number, CAST(j AS INTEGER) AS order_index, json_extract_string(q, '$.options[' || j || '].optionLabel') AS option_label,
        json_extract_string(q, '$.options[' || j || '].optionText') AS option_text, CAST(json_extract(q, '$.options[' || j || '].confidence') AS DOUBLE) AS confidence FROM asked, unnest(range(0, CAST(json_array_length(q, '$.options') AS BIGINT))) AS t(j)""",
    "review_flags": f"""WITH {_PAPER}, told AS (
            SELECT {_REQUEST}, CASE WHEN json_extract_string(body, '$.status') IN ({_STATUSES}) THEN json_extract_string(body, '$.status') END AS status, CAST(json_extract(body, '$.overallConfidence') AS DOUBLE) AS overall_confidence,
                CAST(coalesce(json_array_length(body, '$.questions'), 0) AS BIGINT) AS n_questions, CAST(coalesce(json_array_length(body, '$.warnings'), 0) AS BIGINT) AS n_warnings,
                array_to_string(list_filter([{_NAMES}], lambda f: json_extract_string(body, '$.metadata.' || f || '.value') IS NOT NULL AND {_low("'$.metadata.' || f || '.confidence'", "body")}), ',') AS low_fields,
                coalesce(len(list_filter(json_extract(body, '$.questions[*].confidence'), lambda x: CAST(x AS DOUBLE) < {documents.CONFIDENT})) > 0, false) AS unsure
            FROM paper)
        SELECT request_id, status, overall_confidence, n_questions, n_warnings, low_fields, low_fields <> '' OR unsure OR status <> 'success' AS needs_review FROM told""",
    "operations": f"""WITH {_PAPER} SELECT count(*) AS n, avg({_MS} / {_PAGES}) AS ms_per_page, avg(CAST(json_extract(body, '$.overallConfidence') AS DOUBLE)) AS confidence,
        avg(CASE WHEN coalesce(json_array_length(body, '$.warnings'), 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS warning_rate, quantile_disc({_MS}, 0.95) AS p95_ms FROM paper""",
    "school_years": f"""SELECT s AS start_year, e AS end_year FROM (SELECT DISTINCT TRY_CAST(split_part({_YEAR}, '/', 1) AS INTEGER) AS s, TRY_CAST(split_part({_YEAR}, '/', 2) AS INTEGER) AS e FROM (SELECT {_BODY.replace('AS STRING', 'AS VARCHAR')} AS body FROM part)) t
        WHERE s < e AND NOT EXISTS (SELECT 1 FROM school_years y WHERE y.start_year = s AND y.end_year = e)""",
}
