"""Planned in the reference's design documents: references in messages, question documents, retrieval of the nearest.

Vectors are compared by cosine, in double precision. The set of queries is stated by the caller and meets all vectors
in blocks of a bounded size; a partial top-k by task goes before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, K, BLOCK = 0.75, 5, 4096
REFERENCE = r"@statement\.([^.\s]+)\.([^.\s]+)\.([^.\s]+)\.([^.\s]+)"
FIELDS = ("subject", "school_year", "term", "exam_type")


def references(messages: DataFrame, text: str = "text") -> DataFrame:
    """A row for each reference in a message: its columns and subject, school_year, term, exam_type."""
    found = messages.withColumn("_r", F.explode(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))))
    return found.select(*messages.columns, *(F.regexp_extract("_r", REFERENCE, i + 1).alias(n) for i, n in enumerate(FIELDS)))


def referenced(messages: DataFrame, statements: DataFrame, text: str = "text") -> DataFrame:
    """The statements that messages name: the mandatory filter of a retrieval."""
    return references(messages, text).join(statements, list(FIELDS))


def question_documents(questions: DataFrame, options: DataFrame, statements: DataFrame) -> DataFrame:
    """(question_id, statement_id, content): text, type, score, ordered options and the statement's data as one text."""
    listed = options.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("order_index", F.concat_ws(") ", "option_label", "option_text").alias("line")))).alias("_o"))
    joined = questions.join(listed, questions["id"] == listed["question_id"], "left").join(statements.withColumnRenamed("id", "_statement"), F.col("statement_id") == F.col("_statement"))
    lines = F.transform(F.coalesce("_o", F.array().cast("array<struct<order_index: int, line: string>>")), lambda o: o["line"])
    head = F.concat_ws(" / ", *FIELDS)
    body = F.concat_ws("\n", head, F.concat_ws(" ", F.concat(F.lit("["), "question_type", F.lit("]")), "text"), F.concat(F.lit("max score "), F.col("max_score").cast("string")), F.nullif(F.array_join(lines, "\n"), F.lit("")))
    return joined.select(questions["id"].alias("question_id"), "statement_id", F.trim(body).alias("content"))


def cosine(a: str, b: str):
    """Cosine of two array columns with built-in functions."""
    dot = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(F.col(c), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return dot / (norm(a) * norm(b))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """queries: (query_id, embedding), vectors: (vec_id, embedding). (query_id, vec_id, similarity, rank); ties by vec_id.

    Each block of queries is sent to all tasks; a task keeps k candidates for each query of the block.
    """
    spark = vectors.sparkSession
    rows = queries.where("embedding is not null").select("query_id", "embedding")
    n = rows.count()
    out = None
    number = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block))))
    for b in range(max(1, -(-n // block))):
        part = rows.where(number == b).collect()
        if not part and b:
            continue
        ids = [r["query_id"] for r in part]
        q = np.array([r["embedding"] for r in part], float).reshape(len(part), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, q / np.where(norm > 0, norm, 1)))

        def nearest(batches, sent=sent):
            ids, q = sent.value
            best: list = [[] for _ in ids]
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                numbers = batch.column(0).to_numpy(zero_copy_only=False)
                v = np.array(batch.column(1).to_pylist(), float)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                s = np.round(q @ (v / np.where(length > 0, length, 1)).T, 9)
                for i in range(len(ids)):
                    near = np.flatnonzero(s[i] >= threshold)
                    order = near[np.lexsort((numbers[near], -s[i][near]))[:k]]
                    best[i] = sorted(best[i] + [(-s[i][j], numbers[j]) for j in order])[:k]
            found = [(ids[i], int(v), -float(s)) for i, rows in enumerate(best) for s, v in rows]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "similarity"), r, strict=True)) for r in found], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())]))

        found = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(nearest, "query_id bigint, vec_id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found and truth: (query_id, vec_id). One row: the mean share of a query's true rows among those found."""
    got = found.groupBy("query_id").agg(F.collect_set("vec_id").alias("got"))
    want = truth.groupBy("query_id").agg(F.collect_set("vec_id").alias("want"))
    share = F.size(F.array_intersect(F.coalesce("got", F.array().cast("array<bigint>")), "want")) / F.size("want")
    return want.join(got, "query_id", "left").agg(F.avg(share).alias("recall"))
