"""The domain tables over the driver's tables: the expressions of FIXTURES.md, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.schemas import TABLES

_DAY, _GONE = "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ)", "CAST('2024-01-15 00:00:00' AS TIMESTAMP_NTZ)"


def _stamped(deleted: str) -> dict[str, str]:
    return {"created_at": _DAY, "updated_at": _DAY, "deleted_at": f"CASE WHEN {deleted} THEN {_GONE} END"}


#: table -> (driver's table, expressions, grouping). Fixed values.
SOURCES: dict[str, tuple[str, dict[str, str], str]] = {
    "accounts": ("customer", {"id": "c_custkey", "username": "c_name", "email": "lower(c_name) || '@example.com'", "password_hash": "md5(c_name)", "email_verified": "c_custkey % 2 = 0", "active": "c_acctbal >= 0", "last_login": "CAST(NULL AS TIMESTAMP_NTZ)", **_stamped("c_custkey % 7 = 0")}, ""),
    "users": ("orders", {"id": "o_orderkey", "account_id": "o_custkey", "first_name": "'First' || CAST(o_orderkey AS STRING)", "last_name": "'Last' || CAST(o_custkey AS STRING)", "photo": "CASE WHEN o_orderkey % 3 = 0 THEN '/p/' || CAST(o_orderkey AS STRING) END", "created_at": "o_orderdate", "updated_at": "o_orderdate", "deleted_at": "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END"}, ""),
    "sessions": ("events", {"id": "event_id", "account_id": "user_id", "token": "'tok-' || CAST(event_id AS STRING)", "ip_address": "'10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)", "expires_at": "ts + INTERVAL '24' HOUR", "last_used": "ts", "created_at": "ts", "updated_at": "ts", "deleted_at": "CASE WHEN event_type = 'error' THEN ts END"}, ""),
    "roles": ("nation", {"id": "CAST(n_nationkey AS BIGINT)", "name": "upper(n_name)", "description": "CASE WHEN n_regionkey > 0 THEN 'region ' || CAST(n_regionkey AS STRING) END", **_stamped("n_nationkey % 6 = 0")}, ""),
    "account_roles": ("orders", {"id": "o_custkey * 25 + o_orderkey % 25", "account_id": "o_custkey", "role_id": "o_orderkey % 25", "created_at": "min(o_orderdate)", "deleted_at": "CASE WHEN (o_custkey + o_orderkey % 25) % 5 = 0 THEN max(o_orderdate) END"}, "o_custkey, o_orderkey % 25"),
    "courses": ("part", {"id": "p_partkey", "code": "'C' || CAST(p_partkey AS STRING)", "name": "p_name", "description": "p_type", **_stamped("p_size > 40")}, ""),
    "school_years": ("region", {"id": "CAST(r_regionkey AS BIGINT)", "start_year": "CAST(2020 + r_regionkey AS INT)", "end_year": "CAST(2021 + r_regionkey AS INT)", **_stamped("r_regionkey = 4")}, ""),
    "terms": ("region", {"id": "CAST(r_regionkey AS BIGINT)", "number": "CAST(r_regionkey + 1 AS INT)", "name": "r_name", **_stamped("r_regionkey = 3")}, ""),
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, grouping = SOURCES[name]
    df = driver_table(spark, sf_dir, source)
    types = {f.name: f.dataType for f in TABLES[name].schema}
    exprs = {n: F.expr(e).cast(types[n]).alias(n) for n, e in columns.items()}
    if not grouping:
        return df.select(*exprs.values())
    # Keys first, then what is computed of them and of the group.
    keyed = df.select(F.col("o_custkey"), (F.col("o_orderkey") % 25).alias("_role"), "o_orderdate").groupBy("o_custkey", "_role").agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("_last"))
    gone = F.when((F.col("o_custkey") + F.col("_role")) % 5 == 0, F.col("_last"))
    return keyed.select((F.col("o_custkey") * 25 + F.col("_role")).alias("id"), F.col("o_custkey").alias("account_id"), F.col("_role").alias("role_id"), "created_at", gone.alias("deleted_at"))


def as_sql(name: str) -> str:
    """The table as a SELECT that DuckDB runs."""
    source, columns, grouping = SOURCES[name]
    body = ", ".join(f"{e} AS {n}" for n, e in columns.items()).replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("AS STRING", "AS VARCHAR")
    return f"SELECT {body} FROM {source}" + (f" GROUP BY {grouping}" if grouping else "")


def with_tables(sql: str, *names: str) -> str:
    """`sql` after the definitions of the tables it reads."""
    return "WITH " + ", ".join(f"{n} AS ({as_sql(n)})" for n in names) + " " + sql
