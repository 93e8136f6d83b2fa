"""Reads: active and trashed rows, keyed look-ups, joins, counts, existence and uniqueness probes.

A row is active while deleted_at is null. All predicates are column comparisons that reach the scan. A look-up by a
unique key returns one row at most because the key is unique; it never cuts rows off to get there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import java_trim
from scholia.sources.schemas import TABLES


def is_active(df: DataFrame | None = None) -> Column:
    return (df["deleted_at"] if df is not None else F.col("deleted_at")).isNull()


def is_trashed(df: DataFrame | None = None) -> Column:
    return ~is_active(df)


def response(df: DataFrame, table: str) -> DataFrame:
    """What readers get to see: never a hidden column."""
    return df.select(*TABLES[table].response)


def active(df: DataFrame, table: str) -> DataFrame:
    return response(df.where(is_active()), table)


def trash(df: DataFrame, table: str) -> DataFrame:
    return response(df.where(is_trashed()), table)


def where_equal(df: DataFrame, values: Mapping[str, object], unlike_id: int | None = None) -> DataFrame:
    """Rows with all these values, in any state; without the row of an id."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df if unlike_id is None else df.where(F.col("id") != F.lit(unlike_id))


def active_by(df: DataFrame, table: str, unlike_id: int | None = None, **values: object) -> DataFrame:
    return active(where_equal(df, values, unlike_id), table)


def trash_by(df: DataFrame, table: str, **values: object) -> DataFrame:
    return trash(where_equal(df, values), table)


def any_state_by(df: DataFrame, table: str, unlike_id: int | None = None, **values: object) -> DataFrame:
    return response(where_equal(df, values, unlike_id), table)


def account_by_username(accounts: DataFrame, username: str) -> DataFrame:
    return active(accounts.where(F.col("username") == java_trim(F.lit(username))), "accounts")


def count_active_by(df: DataFrame, **values: object) -> DataFrame:
    """One row, also where there is nothing to count."""
    return where_equal(df, values).where(is_active()).agg(F.count(F.lit(1)).alias("n"))


def exists_active_by(df: DataFrame, **values: object) -> DataFrame:
    return count_active_by(df, **values).select((F.col("n") > 0).alias("found"))


def counts_by_account(accounts: DataFrame, children: DataFrame) -> DataFrame:
    """Every account, of any state, with the number of its active children (0 where there are none)."""
    counts = children.where(is_active()).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    ids = accounts.select(F.col("id").alias("account_id"))
    return ids.join(counts, "account_id", "left").select("account_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _account_columns(accounts: DataFrame) -> DataFrame:
    return accounts.where(is_active()).select(F.col("id").alias("_account"), "username", "email")


def with_account(children: DataFrame, accounts: DataFrame, table: str, how: str = "inner") -> DataFrame:
    """Active rows with their active account as a struct: inner (rows without one are rejects()) or left (they keep a null)."""
    found = active(children, table)
    joined = found.join(_account_columns(accounts), found["account_id"] == F.col("_account"), how)
    whole = F.when(F.col("_account").isNotNull(), F.struct(F.col("_account").alias("id"), "username", "email")).alias("account")
    return joined.select(*(c for c in found.columns if c != "account_id"), whole)


def flat_account(df: DataFrame) -> DataFrame:
    """with_account() with the struct's fields as columns."""
    return df.select(*(c for c in df.columns if c != "account"), F.col("account.id").alias("account_id"), F.col("account.username").alias("account_username"), F.col("account.email").alias("account_email"))


def without_account(children: DataFrame, accounts: DataFrame, table: str) -> DataFrame:
    """The rejects of an inner with_account()."""
    return active(children, table).join(_account_columns(accounts), F.col("account_id") == F.col("_account"), "left_anti")


def roles_by_account(accounts: DataFrame, links: DataFrame, roles: DataFrame) -> DataFrame:
    """Active roles of active accounts over active links."""
    ids = accounts.where(is_active()).select(F.col("id").alias("account_id"))
    pairs = links.where(is_active()).select("account_id", "role_id").join(ids, "account_id", "left_semi")
    return pairs.join(active(roles, "roles"), F.col("role_id") == F.col("id")).drop("role_id")


def same_key_other_id(df: DataFrame, keys: list[str], any_state: bool = False) -> DataFrame:
    """Pairs of ids whose rows agree in a key (letter case aside for text): what a unique constraint would refuse.

    The groups that hold more than one row are found first, so rows with a unique key are never paired.
    """
    rows = df if any_state else df.where(is_active())
    rows = rows.select("id", *keys)
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
    return rows.join(several, keys).select("id", "first_id", *keys)


def missing_parent(children: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """Rows whose parent row doesn't exist; a trashed parent is a parent."""
    ids = parents.select(F.col("id").alias("_parent"))
    return children.join(ids, children[column] == F.col("_parent"), "left_anti")


def parents_in_use(parents: DataFrame, children: DataFrame, column: str) -> DataFrame:
    """Rows that can't be purged: a child row, of any state, points to them."""
    used = children.select(F.col(column).alias("_used"))
    return parents.join(used, parents["id"] == F.col("_used"), "left_semi")
