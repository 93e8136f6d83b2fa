"""Requests and responses as JSON, places of new rows, and atomic replacement of stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.sources.schemas import TABLES

_LONG, _INT, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()
#: The bodies of write requests.
REQUESTS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(n, t) for n, t in fields])
    for name, fields in {
        "accounts": [("username", _TEXT), ("email", _TEXT), ("password", _TEXT)],
        "courses": [("code", _TEXT), ("name", _TEXT), ("description", _TEXT)],
        "roles": [("name", _TEXT), ("description", _TEXT)],
        "school_years": [("start_year", _INT), ("end_year", _INT)],
        "sessions": [("account_id", _LONG), ("token", _TEXT), ("ip_address", _TEXT), ("expires_at", _TIME)],
        "terms": [("name", _TEXT), ("number", _INT)],
        "users": [("account_id", _LONG), ("first_name", _TEXT), ("last_name", _TEXT), ("photo", _TEXT)],
        "account_roles": [("account_id", _LONG), ("role_id", _LONG)],
    }.items()
}
PATHS = {name: f"/api/v1/{name.replace('_', '-')}" for name in TABLES}


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def read_requests(raw: DataFrame, table: str, body: str = "body") -> DataFrame:
    """Typed request rows from JSON bodies (camelCase names); a body that isn't JSON gives nulls, which validation rejects."""
    wire = T.StructType([T.StructField(_camel(f.name), f.dataType) for f in REQUESTS[table]])
    parsed = raw.withColumn("_body", F.from_json(body, wire))
    return parsed.select(*(c for c in raw.columns if c != body), *(F.col(f"_body.{_camel(f.name)}").alias(f.name) for f in REQUESTS[table]))


def to_response(df: DataFrame, table: str) -> DataFrame:
    """A JSON text for each row, without hidden columns."""
    names = [n for n in TABLES[table].response if n in df.columns]
    return df.select(F.to_json(F.struct(*(F.col(n).alias(_camel(n)) for n in names))).alias("body"))


def location(table: str, row_id: Column) -> Column:
    """Where a new row is to be found; terms have none."""
    return F.lit(None).cast("string") if table == "terms" else F.format_string(f"{PATHS[table]}/%d", row_id)


def save_new_version(df: DataFrame, root: str) -> str:
    """Write a table's new state beside the old ones, then name it the current one. What is being read is never overwritten."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/_current")
    return version


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The state that save_new_version() named last."""
    rows = spark.read.parquet(f"{root}/_current").select("version", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    version = rows.orderBy(F.desc("at"), F.desc("file")).limit(1).collect()[0]["version"]
    return spark.read.parquet(f"{root}/{version}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded images, one row for equal contents: (digest, path, length, content)."""
    files = spark.read.format("binaryFile").load(path)
    keyed = files.select(F.sha2("content", 256).alias("digest"), "path", "length", "content")
    first = keyed.groupBy("digest").agg(F.min("path").alias("path"))
    return keyed.join(first, ["digest", "path"], "left_semi")
