"""Writes as pure functions of tables and request rows.

Requests carry an `ordinal` (1, 2, ...), their order in the batch. Each function gives a row per request with an
`outcome` (ok, or the code of an error) and the row as it is stored; apply_*() gives the table's new state. Nothing is
changed in place: the new state is written beside the old one (sources.exchange.save_new_version).

Within a batch, of requests for one key or id the lowest ordinal wins and the others are refused. `now` is an argument.
A new row's id is the largest id plus the ordinal: refused requests leave gaps, as sequences do, and no global sort is
needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.functions.validation import validated
from scholia.operators.errors import OK
from scholia.operators.reads import is_active
from scholia.sources.schemas import TABLES

#: What a create or update stores of a request (the password's hash is computed by the caller's hasher).
NORMALISED: dict[str, dict[str, Callable[[], Column]]] = {
    "accounts": {"username": lambda: text.java_trim(F.col("username")), "email": lambda: text.lower_email(F.col("email"))},
    "courses": {"code": lambda: text.upper_code(F.col("code")), "name": lambda: text.java_trim(F.col("name")), "description": lambda: text.java_trim(F.col("description"))},
    "roles": {"name": lambda: text.upper_code(F.col("name")), "description": lambda: text.java_trim(F.col("description"))},
    "school_years": {"start_year": lambda: F.col("start_year"), "end_year": lambda: F.col("end_year")},
    "sessions": {"account_id": lambda: F.col("account_id"), "token": lambda: text.java_trim(F.col("token")), "ip_address": lambda: text.java_trim(F.col("ip_address")), "expires_at": lambda: F.col("expires_at")},
    "terms": {"number": lambda: F.col("number"), "name": lambda: F.col("name")},
    "users": {"account_id": lambda: F.col("account_id"), "first_name": lambda: text.java_trim(F.col("first_name")), "last_name": lambda: text.java_trim(F.col("last_name")), "photo": lambda: text.text_or_null(F.col("photo"))},
}


def _moment(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _outcome(df: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """The first check that holds names the error."""
    out = F.lit(OK)
    for condition, code in reversed(checks):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return df.withColumn("outcome", out)


def _taken(requests: DataFrame, table: DataFrame, name: str, own_id: str | None = None) -> DataFrame:
    """Adds `taken`: whether a unique key belongs to another row, of any state, or to an earlier valid request."""
    spec = TABLES[name]
    marks = []
    for i, key in enumerate(spec.unique):
        owner = table.groupBy(*(F.col(k).alias(f"_k{i}_{k}") for k in key)).agg(F.min("id").alias(f"_owner{i}"))
        on = [requests[k] == F.col(f"_k{i}_{k}") for k in key]
        requests = requests.join(owner, on, "left").drop(*(f"_k{i}_{k}" for k in key))
        other = F.col(f"_owner{i}").isNotNull() if own_id is None else F.coalesce(F.col(f"_owner{i}") != F.col(own_id), F.lit(False))
        valid = F.when(F.col("_valid") & ~other, F.col("ordinal"))
        first = F.min(valid).over(Window.partitionBy(*key))
        requests = requests.withColumn(f"_taken{i}", other | F.coalesce(first < F.col("ordinal"), F.lit(False))).drop(f"_owner{i}")
        marks.append(F.col(f"_taken{i}"))
    taken = marks[0] if marks else F.lit(False)
    for m in marks[1:]:
        taken = taken | m
    return requests.withColumn("taken", taken).drop(*(f"_taken{i}" for i in range(len(spec.unique))))


def _orphan(requests: DataFrame, parents: dict[str, DataFrame], name: str) -> DataFrame:
    """Adds `orphan`: whether a parent row doesn't exist (a trashed one does)."""
    orphan = F.lit(False)
    for i, (column, parent) in enumerate(TABLES[name].parents):
        if parent in parents:
            ids = parents[parent].select(F.col("id").alias(f"_p{i}"))
            requests = requests.join(ids, F.col(column) == F.col(f"_p{i}"), "left")
            orphan = orphan | (F.col(column).isNotNull() & F.col(f"_p{i}").isNull())
    return requests.withColumn("orphan", orphan).drop(*(f"_p{i}" for i in range(len(TABLES[name].parents))))


def _required(password_hash: Column | None) -> Column:
    if password_hash is None:
        raise ValueError("writing an account needs a hasher: its password_hash is never null")
    return password_hash


def create(table: DataFrame, requests: DataFrame, name: str, now: str, parents: dict[str, DataFrame] | None = None, password_hash: Column | None = None) -> DataFrame:
    """A row per request: ordinal, outcome, violations and all columns of the table, as they are stored."""
    spec = TABLES[name]
    checked = validated(requests, name).withColumn("_broken", F.size("violations") > 0)
    if name == "accounts":
        checked = checked.withColumn("_hash", _required(password_hash))
    checked = checked.withColumns({c: f() for c, f in NORMALISED[name].items()})
    years = F.coalesce(F.col("start_year") >= F.col("end_year"), F.lit(False)) if name == "school_years" else F.lit(False)
    checked = _orphan(checked, parents or {}, name).withColumn("_years", years).withColumn("_valid", ~F.col("_broken") & ~F.col("_years") & ~F.col("orphan"))
    found = _outcome(_taken(checked, table, name), (F.col("_broken"), "validation"), (F.col("_years"), "bad_state"), (F.col("orphan"), "conflict" if spec.conflicts_mapped else "internal"), (F.col("taken"), "conflict" if spec.conflicts_mapped else "internal"))
    moment = _moment(now)
    values: dict[str, Column] = {
        "id": F.when(F.col("outcome") == OK, F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0)) + F.col("ordinal")),
        "email_verified": F.lit(False), "active": F.lit(True), "last_login": F.lit(None), "last_used": moment, "created_at": moment, "updated_at": moment, "deleted_at": F.lit(None),
    }
    if name == "accounts":
        values["password_hash"] = F.col("_hash")
    if name == "sessions":
        values["expires_at"] = text.default_expiry(F.col("expires_at"), moment)
    columns = [(values[n] if n in values else F.col(n)).cast(t).alias(n) for n, t, _ in spec.columns]
    return found.select("ordinal", "outcome", "violations", *columns)


def apply_create(table: DataFrame, results: DataFrame, name: str) -> DataFrame:
    columns = [n for n, _, _ in TABLES[name].columns]
    return table.select(*columns).unionByName(results.where(F.col("outcome") == OK).select(*columns))


def _first_for_id(requests: DataFrame) -> DataFrame:
    return requests.withColumn("_first", F.row_number().over(Window.partitionBy("id").orderBy("ordinal")) == 1)


def update(table: DataFrame, requests: DataFrame, name: str, now: str, parents: dict[str, DataFrame] | None = None, password_hash: Column | None = None, whole: bool = False) -> DataFrame:
    """requests: id and a create's fields. All fields are replaced, nulls too, but: a school year's missing years (unless the request must be `whole`) and a session's missing expiry are kept."""
    spec = TABLES[name]
    checked = validated(requests, name)
    if name == "school_years" and not whole:  # its missing years mean the stored ones
        checked = checked.withColumn("violations", F.filter("violations", lambda v: v["rule"] != "not_null"))
    checked = checked.withColumn("_broken", F.size("violations") > 0)
    if name == "accounts":
        checked = checked.withColumn("_hash", _required(password_hash))
    checked = _first_for_id(checked.withColumns({c: f() for c, f in NORMALISED[name].items()}))
    old = table.where(is_active()).select(F.col("id").alias("_id"), *(F.col(n).alias(f"old_{n}") for n, _, _ in spec.columns if n != "id"))
    joined = checked.join(old, checked["id"] == F.col("_id"), "left").withColumn("_found", F.col("_id").isNotNull())
    kept = {"school_years": ("start_year", "end_year"), "sessions": ("expires_at",)}.get(name, ())
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"old_{c}")) for c in kept}) if kept else joined
    years = F.coalesce(F.col("start_year") >= F.col("end_year"), F.lit(False)) if name == "school_years" else F.lit(False)
    joined = _orphan(joined, parents or {}, name).withColumn("_years", years)
    joined = joined.withColumn("_valid", F.col("_found") & F.col("_first") & ~F.col("_broken") & ~F.col("_years") & ~F.col("orphan"))
    refused = "conflict" if spec.conflicts_mapped else "internal"
    found = _outcome(_taken(joined, table, name, own_id="id"), (F.col("_broken"), "validation"), (~F.col("_found"), "not_found"), (~F.col("_first"), "conflict"), (F.col("_years"), "bad_state"), (F.col("orphan"), refused), (F.col("taken"), refused))
    new = {c: F.col(c) for c in NORMALISED[name]} | {"updated_at": _moment(now)}
    if name == "accounts":
        new["password_hash"] = F.col("_hash")
    columns = [F.col("id") if n == "id" else new.get(n, F.col(f"old_{n}")).cast(t).alias(n) for n, t, _ in spec.columns]
    return found.select("ordinal", "outcome", "violations", *columns)


def apply_changed(table: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """The table with the rows that results (of update, soft_delete, restore or record_login) changed."""
    names = [n for n, _, _ in TABLES[name].columns]
    changed = results.where(F.col("outcome") == OK).select(F.col("id").alias("_id"), *(F.col(n).alias(f"new_{n}") for n in names if n != "id"))
    joined = table.join(changed, table["id"] == F.col("_id"), "left")
    match = F.col("_id").isNotNull()  # not coalesce: null is a value too
    return joined.select("id", *(F.when(match, F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) for n in names if n != "id"))


def _state_change(table: DataFrame, requests: DataFrame, name: str, active: bool, code: str, values: dict[str, Column], *more: tuple[Column, str]) -> DataFrame:
    """requests: (ordinal, id). Rows in the wanted state change; for others the outcome is `code`."""
    spec = TABLES[name]
    wanted = is_active() if active else ~is_active()
    rows = table.where(wanted).select(F.col("id").alias("_id"), *(n for n, _, _ in spec.columns if n != "id"))
    joined = _first_for_id(requests.select("ordinal", "id")).join(rows, F.col("id") == F.col("_id"), "left")
    found = _outcome(joined, (F.col("_id").isNull() | ~F.col("_first"), code), *more)
    columns = [F.col("id") if n == "id" else values.get(n, F.col(n)).cast(t).alias(n) for n, t, _ in spec.columns]
    return found.select("ordinal", "outcome", *columns)


def _stamps(name: str, now: str) -> dict[str, Column]:
    """Every save refreshes updated_at, where there is one."""
    return {"updated_at": _moment(now)} if TABLES[name].audited else {}


def soft_delete(table: DataFrame, requests: DataFrame, name: str, now: str) -> DataFrame:
    return _state_change(table, requests, name, True, "not_found", _stamps(name, now) | {"deleted_at": _moment(now)})


def restore(table: DataFrame, requests: DataFrame, name: str, now: str) -> DataFrame:
    return _state_change(table, requests, name, False, "bad_state", _stamps(name, now) | {"deleted_at": F.lit(None)})


def record_login(accounts: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """An active row whose flag is set; a row without a flag fails."""
    flag = F.col("active")
    return _state_change(accounts, requests, "accounts", True, "not_found", _stamps("accounts", now) | {"last_login": _moment(now)}, (flag.isNull(), "internal"), (~flag, "bad_state"))


def hard_delete(table: DataFrame, requests: DataFrame, name: str, children: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """requests: (ordinal, id). Only trashed rows without children, of any state, go."""
    used = None
    for child, column in children:
        ids = child.select(F.col(column).alias("_used"))
        used = ids if used is None else used.unionByName(ids)
    rows = table.where(~is_active()).select(F.col("id").alias("_id"))
    joined = _first_for_id(requests.select("ordinal", "id")).join(rows, F.col("id") == F.col("_id"), "left")
    if used is None:
        return _outcome(joined, (F.col("_id").isNull() | ~F.col("_first"), "bad_state")).select("ordinal", "outcome", "id")
    joined = joined.join(used.groupBy("_used").agg(F.count(F.lit(1)).alias("_n")), F.col("id") == F.col("_used"), "left")
    return _outcome(joined, (F.col("_id").isNull() | ~F.col("_first"), "bad_state"), (F.col("_used").isNotNull(), "internal")).select("ordinal", "outcome", "id")


def apply_hard_delete(table: DataFrame, results: DataFrame) -> DataFrame:
    gone = results.where(F.col("outcome") == OK).select(F.col("id").alias("_id"))
    return table.join(gone, table["id"] == F.col("_id"), "left_anti")


def assign_role(links: DataFrame, requests: DataFrame, accounts: DataFrame, roles: DataFrame, now: str) -> DataFrame:
    """requests: (ordinal, account_id, role_id). action: insert, restore (created_at is kept), or null where refused."""
    a = accounts.where(is_active()).select(F.col("id").alias("_account"))
    r = roles.where(is_active()).select(F.col("id").alias("_role"))
    old = links.select(F.col("id").alias("_link"), F.col("account_id").alias("_a"), F.col("role_id").alias("_r"), F.col("created_at").alias("_created"), F.col("deleted_at").alias("_deleted"))
    joined = requests.join(a, F.col("account_id") == F.col("_account"), "left").join(r, F.col("role_id") == F.col("_role"), "left")
    joined = joined.join(old, (F.col("account_id") == F.col("_a")) & (F.col("role_id") == F.col("_r")), "left")
    missing = F.col("_account").isNull() | F.col("_role").isNull()
    first = F.min(F.when(~missing, F.col("ordinal"))).over(Window.partitionBy("account_id", "role_id"))
    joined = joined.withColumn("_again", first < F.col("ordinal"))
    found = _outcome(joined, (missing, "not_found"), (F.col("_again") | (F.col("_link").isNotNull() & F.col("_deleted").isNull()), "conflict"))
    ok, fresh = F.col("outcome") == OK, F.col("_link").isNull()
    top = F.coalesce(links.agg(F.max("id")).scalar(), F.lit(0))
    return found.select("ordinal", "outcome", F.when(ok, F.when(fresh, F.lit("insert")).otherwise(F.lit("restore"))).alias("action"), F.when(ok, F.when(fresh, top + F.col("ordinal")).otherwise(F.col("_link"))).cast("bigint").alias("id"), "account_id", "role_id", F.when(ok, F.when(fresh, _moment(now)).otherwise(F.col("_created"))).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def apply_assign(links: DataFrame, results: DataFrame) -> DataFrame:
    names = [n for n, _, _ in TABLES["account_roles"].columns]
    changed = apply_changed(links, results.where("action = 'restore'"), "account_roles")
    return changed.unionByName(results.where("action = 'insert'").select(*names))


def remove_role(links: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """requests: (ordinal, account_id, role_id). Only the link is looked at, not the account or the role."""
    old = links.where(is_active()).select("id", F.col("account_id").alias("_a"), F.col("role_id").alias("_r"), "created_at")
    first = F.row_number().over(Window.partitionBy("account_id", "role_id").orderBy("ordinal")) == 1
    joined = requests.withColumn("_first", first).join(old, (F.col("account_id") == F.col("_a")) & (F.col("role_id") == F.col("_r")), "left")
    found = _outcome(joined, (F.col("id").isNull() | ~F.col("_first"), "not_found"))
    return found.select("ordinal", "outcome", "id", "account_id", "role_id", "created_at", F.when(F.col("outcome") == OK, _moment(now)).alias("deleted_at"))
