from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from scholia.operators import documents, retrieval
from scholia.sources import exchange
from scholia.streaming import reindex


def papers(spark):
    """One paper of two questions, one of one, one of none and without a page."""
    field = lambda v, c: {"value": v, "confidence": c}
    ask = lambda n, c, options: {"number": n, "confidence": c, "text": field("t", c), "questionType": field("true_false", c), "maxScore": field(1, c), "options": options}
    pick = [{"optionLabel": x, "optionText": x, "confidence": 0.9} for x in "AB"]
    rows = [
        {"status": "success", "requestId": "one", "processingTimeMs": 1000, "document": {"pageCount": 2}, "questions": [ask(1, 0.9, []), ask(2, 0.85, pick)]},
        {"status": "partial", "requestId": "three", "processingTimeMs": 900, "document": {"pageCount": 1}, "questions": [ask(1, 0.2, None)]},
        {"status": "error", "requestId": "two", "processingTimeMs": 7, "document": {"pageCount": 0}},
    ]
    return documents.parse(spark.createDataFrame([(json.dumps(r),) for r in rows], "body string"))


def test_what_is_no_paper_has_no_status(spark):
    raw = spark.createDataFrame([("no json",), (json.dumps({"status": "odd"}),), (None,)], "body string")
    assert [r["status"] for r in documents.review_flags(documents.parse(raw)).collect()] == [None, None, None]


def test_options_outer_keeps_questions_without_options(spark):
    assert documents.options(papers(spark)).count() == 2
    assert documents.options(papers(spark), outer=True).count() == 4


def test_confident_questions(spark):
    kept = documents.confident_questions(papers(spark))
    assert [r["n_questions"] for r in documents.review_flags(kept).orderBy("request_id").collect()] == [2, 0, 0]


def test_segments(spark):
    text = "Intro\n1. Why is the sky blue?\n2) Pick one:\nA) red\nB) blue\n3. True or false: false? True is true, not false.\n"
    rows = documents.segments(spark.createDataFrame([(7, text), (8, ""), (9, None)], "id int, body string")).orderBy("number").collect()
    assert [(r["id"], r["number"], r["question_type"]) for r in rows] == [(7, 1, "short_answer"), (7, 2, "multiple_choice"), (7, 3, "true_false")]


def test_operations(spark):
    r = documents.operations(papers(spark)).collect()[0]
    assert (r["n"], r["ms_per_page"]) == (3, (500 + 900) / 2)


def test_references(spark):
    messages = spark.createDataFrame([(1, "see @statement.maths.2024.t1.final and @statement.a.b.c.d"), (2, "none"), (3, None)], "id int, text string")
    got = [(r["id"], r["subject"], r["exam_type"]) for r in retrieval.references(messages).collect()]
    assert got == [(1, "maths", "final"), (1, "a", "d")]


def test_question_documents(spark):
    questions = spark.createDataFrame([(1, 5, "What?", "multiple_choice", 4.0), (2, 5, "Why?", "development", None)], "id bigint, statement_id bigint, text string, question_type string, max_score double")
    options = spark.createDataFrame([(1, 2, "B", "no"), (1, 1, "A", "yes")], "question_id bigint, order_index int, option_label string, option_text string")
    statements = spark.createDataFrame([(5, "maths", "2024", "t1", "final")], "id bigint, subject string, school_year string, term string, exam_type string")
    got = {r["question_id"]: r["content"] for r in retrieval.question_documents(questions, options, statements).collect()}
    assert got[1] == "maths / 2024 / t1 / final\n[multiple_choice] What?\nmax score 4.0\nA) yes\nB) no"
    assert got[2] == "maths / 2024 / t1 / final\n[development] Why?"


def test_top_k_is_that_of_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = vectors[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, None)], "vec_id bigint, embedding array<float>")
    queries = df.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for block in (4, 1000):
        got: dict = {}
        for r in retrieval.top_k(queries, df, k=4, threshold=0.1, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in range(9):
            s = np.round(unit[q].astype(np.float32).astype(float) @ unit.T, 6)
            want = [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if s[i] >= 0.1][:4]
            assert got[q] == want
    truth = spark.createDataFrame([(0, 0), (1, 59)], "query_id bigint, vec_id bigint")
    found = spark.createDataFrame([(0, 0)], "query_id bigint, vec_id bigint")
    assert retrieval.recall_at_k(found, truth).collect()[0]["recall"] == 0.5


def test_cosine(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(retrieval.cosine("a", "b").alias("c")).collect()[0]
    assert abs(r["c"] - 0.5**0.5) < 1e-12


def test_requests_and_responses(spark):
    raw = spark.createDataFrame([(1, '{"accountId": 3, "firstName": "A", "lastName": "B"}'), (2, "no json")], "ordinal bigint, body string")
    rows = exchange.read_requests(raw, "users").orderBy("ordinal").collect()
    assert (rows[0]["account_id"], rows[0]["first_name"], rows[0]["photo"], rows[1]["account_id"]) == (3, "A", None, None)
    accounts = spark.createDataFrame([(1, "ann", "secret")], "id bigint, username string, password_hash string")
    assert json.loads(exchange.to_response(accounts, "accounts").collect()[0]["body"]) == {"id": 1, "username": "ann"}
    where = spark.range(1).select(exchange.location("school_years", F.lit(4)).alias("a"), exchange.location("terms", F.lit(4)).alias("b")).collect()[0]
    assert tuple(where) == ("/api/v1/school-years/4", None)


def test_versions_and_images(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    exchange.save_new_version(spark.range(2), root)
    exchange.save_new_version(exchange.current_version(spark, root).where("id > 0"), root)
    assert [r["id"] for r in exchange.current_version(spark, root).collect()] == [1]
    for name, content in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (tmp_path / "i").mkdir(exist_ok=True)
        (tmp_path / "i" / name).write_bytes(content)
    assert exchange.read_images(spark, f"file://{tmp_path}/i").count() == 2


def test_reindexing_is_idempotent_and_ignores_late_versions(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()

    def send(name, *rows):
        (events / name).write_text("\n".join(json.dumps(dict(zip(("statement_id", "version", "deleted", "content"), r, strict=True))) for r in rows))

    def run():
        q = reindex.start(spark, f"file://{events}", f"file://{tmp_path}/index", f"file://{tmp_path}/checkpoint")
        q.awaitTermination()
        return {r["statement_id"]: r["content"] for r in reindex.visible(exchange.current_version(spark, f"file://{tmp_path}/index")).collect()}

    send("1.json", (1, 1, False, "a"), (1, 2, False, "b"), (2, 1, False, "x"))
    assert run() == {1: "b", 2: "x"}
    send("2.json", (2, 3, True, None), (1, 2, False, "b"))
    assert run() == {1: "b"}
    send("3.json", (2, 2, False, "late"))
    assert run() == {1: "b"}
