"""Validation of request rows before normalisation: each rule gives a violation or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import not_blank, utf16_length

#: An approximation of what mail validators accept: a local part and a domain of dotted labels. Null and empty pass (other rules catch them).
EMAIL = r"^[^\s@\"(),:;<>\[\]\\]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*$"

#: table -> (field, rule, lower bound, upper bound). Fixed values.
RULES: dict[str, tuple[tuple, ...]] = {
    "accounts": (("username", "not_blank"), ("username", "size", 3, 100), ("email", "not_blank"), ("email", "email"), ("email", "size", 0, 255), ("password", "not_blank"), ("password", "size", 8, 255)),
    "courses": (("code", "not_blank"), ("code", "size", 2, 50), ("name", "not_blank"), ("name", "size", 3, 255), ("description", "size", 0, 5000)),
    "roles": (("name", "not_blank"), ("name", "size", 3, 100), ("description", "size", 0, 500)),
    "school_years": (("start_year", "not_null"), ("start_year", "positive"), ("end_year", "not_null"), ("end_year", "positive")),
    "sessions": (("account_id", "not_null"), ("token", "not_blank"), ("ip_address", "not_blank")),
    "terms": (("name", "not_blank"), ("number", "positive_primitive")),
    "users": (("account_id", "not_null"), ("first_name", "not_blank"), ("first_name", "size", 2, 100), ("last_name", "not_blank"), ("last_name", "size", 2, 100), ("photo", "size", 0, 500)),
    "account_roles": (("account_id", "not_null"), ("role_id", "not_null")),
}


def broken(field: str, rule: str, low: int = 0, high: int = 0) -> Column:
    """Whether the rule is broken; size, email and positive let null pass, a missing primitive number counts as 0."""
    x = F.col(field)
    return {
        "not_null": lambda: x.isNull(),
        "not_blank": lambda: ~not_blank(x),
        "size": lambda: F.coalesce(~utf16_length(x).between(low, high), F.lit(False)),
        "email": lambda: F.coalesce((F.length(x) > 0) & ~x.rlike(EMAIL), F.lit(False)),
        "positive": lambda: F.coalesce(x <= 0, F.lit(False)),
        "positive_primitive": lambda: F.coalesce(x, F.lit(0)) <= 0,
    }[rule]()


def violations(table: str) -> Column:
    """All broken rules, as an array: a field may break several."""
    found = [F.when(broken(*r), F.struct(F.lit(r[0]).alias("field"), F.lit(r[1].removesuffix("_primitive")).alias("rule"), (F.lit(None) if r[0] == "password" else F.col(r[0])).cast("string").alias("rejected"))) for r in RULES[table]]
    return F.array_compact(F.array(*found))


def validated(requests: DataFrame, table: str) -> DataFrame:
    return requests.withColumn("violations", violations(table))
