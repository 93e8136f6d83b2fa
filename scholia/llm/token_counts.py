"""Token counts by a separator scan over flat, unindexed token files.

write_token_files() writes a corpus as flat files of little-endian 16-bit words: a document's ids, each one
higher than in the vocabulary, then 0, the end-of-document id. Nothing else is stored: no index, no lengths.
Spark's text sink does the writing (its line separator is the end id), so any file system that Spark knows will do.

separator_scan() reads such files, cuts them into blocks of fixed size, and searches each block for the end id
with one vector operation. A document may span blocks: a block reports its documents' ends, how many ids stand
before its first end and after its last, and a prefix scan over the blocks' summaries (a few numbers each)
stitches the boundaries: it carries the open document's length and the number of documents so far.

Null and empty texts are documents of no ids (count 0). Files without an end at their end hold an open last
document, which counts as one. Empty files and tables give no rows. Rows that repeat are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm import tokens
from scholia.llm.tables import shared_dir

BLOCK = 1 << 16
#: Documents in a file at most; with their mean length it bounds a file, which is read as one value (2 GB at most).
FILE_DOCUMENTS = 20_000
_PART = r"part-(\d+)-"
_SHARE = r"-c(\d+)\D*$"


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", file_documents: int = FILE_DOCUMENTS) -> None:
    path = path or tokens.default_path()

    def ids(column: pa.Array) -> pa.Array:
        got = tokens.encode(path, column.to_pylist())
        if any(len(x) and int(x.max()) >= 0xFFFF for x in got):
            raise ValueError("ids do not fit 16 bits")
        return pa.array([(x + 1).astype("<u2").tobytes() for x in got], pa.binary())

    stream = docs.select(F.arrow_udf(ids, "binary")(F.col(text).cast("string")).cast("string").alias("value"))
    stream.write.option("lineSep", "\0\0").option("maxRecordsPerFile", file_documents).text(folder)


def separator_scan(spark: SparkSession, folder: str, block: int = BLOCK, end: int = 0) -> DataFrame:
    """(part, ordinal, n_tokens): each document's count by the writing task and its place in that task's stream."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    files = files.select(F.regexp_extract("path", _PART, 1).cast("int").alias("part"), F.coalesce(F.regexp_extract("path", _SHARE, 1).try_cast("int"), F.lit(0)).alias("share"), "content", "length")
    size = 2 * block
    blocks = files.select("part", "share", "content", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block"))
    blocks = blocks.select("part", "share", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("ids"))

    def scan(batches):
        for batch in batches:
            ends, tails = [], []
            for raw in batch.column(3).to_pylist():
                ids = np.frombuffer(raw, "<u2")
                at = np.flatnonzero(ids == end)
                ends.append(np.diff(np.r_[-1, at]) - 1)
                tails.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.list_(pa.int64())), pa.array(tails, pa.int64())], names=["part", "share", "block", "counts", "tail"])

    found = blocks.mapInArrow(scan, "part int, share int, block bigint, counts array<bigint>, tail bigint")
    # Prefix scan within a task's stream: what an open document has from the blocks since the last end, and the documents ended so far.
    order = Window.partitionBy("part").orderBy("share", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    some = F.size("counts") > 0
    total = F.sum("tail").over(before)
    closed = F.last(F.when(some, F.col("_upto")), ignorenulls=True).over(before)
    stitched = found.withColumn("_upto", F.sum("tail").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tail"))
    stitched = stitched.withColumn("carry", F.coalesce(total - F.coalesce(closed, F.lit(0)), F.lit(0))).withColumn("done", F.coalesce(F.sum(F.size("counts")).over(before), F.lit(0)))
    last = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("share"), F.desc("block"))) == 1
    stitched = stitched.withColumn("last", last)
    whole = F.when(some, F.concat(F.array(F.get("counts", F.lit(0)) + F.col("carry")), F.slice("counts", 2, F.greatest(F.size("counts") - 1, F.lit(0))))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(some, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    counts = F.when(F.col("last") & (rest > 0), F.concat(whole, F.array(rest))).otherwise(whole)
    return stitched.select("part", "done", F.posexplode(counts).alias("place", "n_tokens")).select("part", (F.col("done") + F.col("place")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) for every row of docs, which must be a scan: the n-th row of a task is the n-th document of its stream."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    write_token_files(docs, folder, path, text)
    place = F.monotonically_increasing_id()
    rows = docs.select(F.col(doc_id).alias("doc_id"), place.alias("_place"))
    rows = rows.select("doc_id", F.shiftright("_place", 33).cast("int").alias("part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"))
    return rows.join(separator_scan(spark, folder), ["part", "ordinal"], "left").select("doc_id", "n_tokens")
