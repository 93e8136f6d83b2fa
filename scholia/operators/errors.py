"""Errors as data: a reject carries the status that was meant and the one that reaches the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: code -> (status meant, status on the wire). A known defect turns three of them into 500.
STATUSES = {"not_found": (404, 500), "bad_state": (400, 500), "conflict": (409, 500), "validation": (400, 400), "internal": (500, 500)}
OK = "ok"


def status(code: Column, wire: bool) -> Column:
    out = F.lit(None).cast("int")
    for name, (meant, sent) in STATUSES.items():
        out = F.when(code == name, F.lit(sent if wire else meant)).otherwise(out)
    return out


def with_statuses(df: DataFrame, code: str = "outcome", instance: Column | None = None) -> DataFrame:
    """Adds intended_status and wire_status (null for what went well), and the request's address if given."""
    out = df.withColumns({"intended_status": status(F.col(code), False), "wire_status": status(F.col(code), True)})
    return out if instance is None else out.withColumn("instance", instance)


def accepted(results: DataFrame) -> DataFrame:
    return results.where(F.col("outcome") == OK)


def rejects(results: DataFrame) -> DataFrame:
    return with_statuses(results.where(F.col("outcome") != OK))
