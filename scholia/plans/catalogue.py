"""All registered queries of the engine, with the SQL that gives the same rows.

Write queries take their requests from whole tables of the driver's data, by expressions that both engines run, and
return a row per request: what is stored, or the code of the refusal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.passwords import Pbkdf2Hasher, hash_column, matches_column
from scholia.functions.validation import validated
from scholia.operators import analytics, documents, mutations, reads, retrieval
from scholia.plans.papers import PAPERS_SQL, papers
from scholia.sources.fixtures import driver_table, load, with_tables
from scholia.sources.schemas import SERVED, TABLES
from scholia.streaming import reindex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-06-01 12:00:00"
_NOW_SQL = f"TIMESTAMP '{NOW}'"


def _add(name: str, query: Query, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = with_tables(sql, *tables) if tables else sql


def _columns(table: str) -> str:
    return ", ".join(TABLES[table].response)


# Reads.

#: Ids that hit an active and (where the data has a fixed one) a trashed row. Fixed values.
_ACTIVE_ID = {"accounts": 1, "users": 2, "sessions": 1, "roles": 1, "courses": 1, "school_years": 1, "terms": 1}
_TRASHED_ID = {"accounts": 7, "users": 1, "sessions": 0, "roles": 6, "courses": 55, "school_years": 4, "terms": 3}

for _t in SERVED:
    _add(f"{_t}_active", lambda s, d, t=_t: reads.active(load(s, d, t), t), f"SELECT {_columns(_t)} FROM {_t} WHERE deleted_at IS NULL", _t)
    _add(f"{_t}_trash", lambda s, d, t=_t: reads.trash(load(s, d, t), t), f"SELECT {_columns(_t)} FROM {_t} WHERE deleted_at IS NOT NULL", _t)
    _add(f"{_t}_by_id", lambda s, d, t=_t: reads.active_by(load(s, d, t), t, id=_ACTIVE_ID[t]), f"SELECT {_columns(_t)} FROM {_t} WHERE deleted_at IS NULL AND id = {_ACTIVE_ID[_t]}", _t)
    _add(f"{_t}_trash_by_id", lambda s, d, t=_t: reads.trash_by(load(s, d, t), t, id=_TRASHED_ID[t]), f"SELECT {_columns(_t)} FROM {_t} WHERE deleted_at IS NOT NULL AND id = {_TRASHED_ID[_t]}", _t)

_NAME = "Customer#000000001"


def _by(name: str, table: str, where: str, query: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, lambda s, d: query(load(s, d, table)), f"SELECT {_columns(table)} FROM {table} WHERE {where}", table)


_by("accounts_by_flag", "accounts", "active AND deleted_at IS NULL", lambda df: reads.active_by(df, "accounts", active=True))
_by("account_by_username", "accounts", f"username = '{_NAME}' AND deleted_at IS NULL", lambda df: reads.account_by_username(df, f"\t{_NAME} \n"))
_by("dup_username_probe", "accounts", f"username = '{_NAME}' AND id <> 99 AND deleted_at IS NULL", lambda df: reads.active_by(df, "accounts", unlike_id=99, username=_NAME))
_by("users_by_account", "users", "account_id = 1 AND deleted_at IS NULL", lambda df: reads.active_by(df, "users", account_id=1))
_by("sessions_by_account", "sessions", "account_id = 1 AND deleted_at IS NULL", lambda df: reads.active_by(df, "sessions", account_id=1))
_by("course_by_code", "courses", "code = 'C1' AND deleted_at IS NULL", lambda df: reads.active_by(df, "courses", code="C1"))
_by("dup_code_probe", "courses", "code = 'C1' AND id <> 2 AND deleted_at IS NULL", lambda df: reads.active_by(df, "courses", unlike_id=2, code="C1"))
_by("role_by_name", "roles", "name = 'NATION_1' AND deleted_at IS NULL", lambda df: reads.active_by(df, "roles", name="NATION_1"))
_by("dup_name_probe", "roles", "name = 'NATION_1' AND id <> 2 AND deleted_at IS NULL", lambda df: reads.active_by(df, "roles", unlike_id=2, name="NATION_1"))
_by("dup_school_year_probe", "school_years", "start_year = 2024 AND end_year = 2025 AND id <> 1", lambda df: reads.any_state_by(df, "school_years", unlike_id=1, start_year=2024, end_year=2025))
_by("links_by_account_active", "account_roles", "account_id = 1 AND deleted_at IS NULL", lambda df: reads.active_by(df, "account_roles", account_id=1))
_by("links_by_role_active", "account_roles", "role_id = 1 AND deleted_at IS NULL", lambda df: reads.active_by(df, "account_roles", role_id=1))
_by("links_by_account_trash", "account_roles", "account_id = 1 AND deleted_at IS NOT NULL", lambda df: reads.trash_by(df, "account_roles", account_id=1))
_by("links_by_role_trash", "account_roles", "role_id = 1 AND deleted_at IS NOT NULL", lambda df: reads.trash_by(df, "account_roles", role_id=1))
_by("link_active", "account_roles", "account_id = 0 AND role_id = 11 AND deleted_at IS NULL", lambda df: reads.active_by(df, "account_roles", account_id=0, role_id=11))
_by("link_any_state", "account_roles", "account_id = 1 AND role_id = 4", lambda df: reads.any_state_by(df, "account_roles", account_id=1, role_id=4))
_add("link_exists", lambda s, d: reads.exists_active_by(load(s, d, "account_roles"), account_id=1, role_id=2), "SELECT count(*) > 0 AS found FROM account_roles WHERE account_id = 1 AND role_id = 2 AND deleted_at IS NULL", "account_roles")
_add("link_exists_found", lambda s, d: reads.exists_active_by(load(s, d, "account_roles"), account_id=0, role_id=11), "SELECT count(*) > 0 AS found FROM account_roles WHERE account_id = 0 AND role_id = 11 AND deleted_at IS NULL", "account_roles")

for _t in ("sessions", "users"):
    _add(f"{_t}_count_of_account", lambda s, d, t=_t: reads.count_active_by(load(s, d, t), account_id=1), f"SELECT count(*) AS n FROM {_t} WHERE account_id = 1 AND deleted_at IS NULL", _t)
    _add(f"{_t}_count_by_account", lambda s, d, t=_t: reads.counts_by_account(load(s, d, "accounts"), load(s, d, t)), f"SELECT a.id AS account_id, count(c.id) AS n FROM accounts a LEFT JOIN {_t} c ON c.account_id = a.id AND c.deleted_at IS NULL GROUP BY a.id", "accounts", _t)

_ACCOUNT_SQL = "a.id AS account_id, a.username AS account_username, a.email AS account_email"
for _name, _t, _how in (("user_with_account", "users", "inner"), ("users_account_left", "users", "left"), ("sessions_account_left", "sessions", "left")):
    _own = ", ".join(f"x.{c}" for c in TABLES[_t].response if c != "account_id")
    _add(_name, lambda s, d, t=_t, how=_how: reads.flat_account(reads.with_account(load(s, d, t), load(s, d, "accounts"), t, how)), f"SELECT {_own}, {_ACCOUNT_SQL} FROM {_t} x {_how} JOIN accounts a ON a.id = x.account_id AND a.deleted_at IS NULL WHERE x.deleted_at IS NULL", _t, "accounts")
_add("users_without_account", lambda s, d: reads.without_account(load(s, d, "users"), load(s, d, "accounts"), "users"), f"SELECT {_columns('users')} FROM users WHERE deleted_at IS NULL AND account_id NOT IN (SELECT id FROM accounts WHERE deleted_at IS NULL)", "users", "accounts")
_add(
    "roles_by_account",
    lambda s, d: reads.roles_by_account(*(load(s, d, t) for t in ("accounts", "account_roles", "roles"))),
    "SELECT l.account_id, r.id, r.name, r.description, r.created_at, r.updated_at, r.deleted_at FROM account_roles l JOIN accounts a ON a.id = l.account_id JOIN roles r ON r.id = l.role_id WHERE l.deleted_at IS NULL AND a.deleted_at IS NULL AND r.deleted_at IS NULL",
    "accounts", "account_roles", "roles",
)

for _name, _t, _keys, _any in (("shared_course_names", "courses", ["name"], False), ("shared_role_descriptions", "roles", ["description"], True)):
    _k = ", ".join(_keys)
    _add(_name, lambda s, d, t=_t, k=_keys, a=_any: reads.same_key_other_id(load(s, d, t), k, a), f"SELECT id, m AS first_id, {_k} FROM (SELECT id, {_k}, count(*) OVER (PARTITION BY {_k}) AS n, min(id) OVER (PARTITION BY {_k}) AS m FROM {_t} WHERE {'true' if _any else 'deleted_at IS NULL'}) WHERE n > 1 AND {_keys[0]} IS NOT NULL", _t)

# Requests: (driver's table, expressions). Fixed values.

_EIGHTH = "CAST(CAST(floor(s_suppkey / 8) AS BIGINT) AS STRING)"
REQUESTS: dict[str, tuple[str, dict[str, str]]] = {
    "course_create": ("supplier", {"ordinal": "s_suppkey + 1", "code": f"CASE s_suppkey % 4 WHEN 0 THEN chr(9) || ' c' || CAST(s_suppkey AS STRING) || chr(10) WHEN 1 THEN 'n' WHEN 2 THEN 'New' || CAST(s_suppkey AS STRING) ELSE 'dup' || {_EIGHTH} END", "name": "' ' || s_name || ' '", "description": "CASE WHEN s_suppkey % 2 = 0 THEN ' d ' END"}),
    "role_create": ("nation", {"ordinal": "n_nationkey + 1", "name": "CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) || ' ' WHEN 1 THEN 'role ' || CAST(n_nationkey AS STRING) ELSE 'team' END", "description": "CASE WHEN n_regionkey > 1 THEN ' r ' END"}),
    "account_create": ("supplier", {"ordinal": "s_suppkey + 1", "username": "CASE s_suppkey % 4 WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS STRING), 9, '0') WHEN 1 THEN 'ab' ELSE ' new' || CAST(s_suppkey AS STRING) END", "email": "CASE WHEN s_suppkey % 4 = 3 THEN 'no mail' ELSE 'Mixed' || CAST(s_suppkey AS STRING) || '@Example.com' END", "password": "'secret-pass'"}),
    "school_year_create": ("nation", {"ordinal": "n_nationkey + 1", "start_year": "CAST(2000 + n_nationkey AS INT)", "end_year": "CAST(2000 + n_nationkey + n_nationkey % 3 AS INT)"}),
    "session_create": ("supplier", {"ordinal": "s_suppkey + 1", "account_id": "CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey END", "token": "CASE WHEN s_suppkey % 2 = 0 THEN ' tok-' ELSE 'fresh-' END || CAST(s_suppkey AS STRING)", "ip_address": "'10.0.0.1 '", "expires_at": f"CASE WHEN s_suppkey % 3 = 0 THEN CAST('{NOW}' AS TIMESTAMP_NTZ) END"}),
    "term_create": ("region", {"ordinal": "r_regionkey + 1", "number": "CAST(r_regionkey AS INT)", "name": "r_name"}),
    "user_create": ("supplier", {"ordinal": "s_suppkey + 1", "account_id": "CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 100000000 ELSE s_suppkey END", "first_name": "CASE WHEN s_suppkey % 6 = 1 THEN 'A' ELSE ' Ann ' END", "last_name": "s_name", "photo": "CASE s_suppkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' /p ' END"}),
    "course_update": ("supplier", {"ordinal": "s_suppkey + 1", "id": "s_suppkey", "code": "CASE s_suppkey % 3 WHEN 0 THEN 'c' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'c' || CAST(s_suppkey + 1 AS STRING) ELSE 'x' || CAST(s_suppkey AS STRING) END", "name": "s_name", "description": "CAST(NULL AS STRING)"}),
    "account_update": ("supplier", {"ordinal": "s_suppkey + 1", "id": "s_suppkey", "username": "CASE s_suppkey % 3 WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS STRING), 9, '0') WHEN 1 THEN 'Customer#000000003' ELSE ' other' || CAST(s_suppkey AS STRING) END", "email": "'New' || CAST(s_suppkey AS STRING) || '@Example.com'", "password": "CASE WHEN s_suppkey % 5 = 4 THEN 'short' ELSE 'secret-pass' END"}),
    "role_update": ("nation", {"ordinal": "n_nationkey + 1", "id": "CAST(n_nationkey AS BIGINT)", "name": "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'same name' END", "description": "' d'"}),
    "term_update": ("region", {"ordinal": "r_regionkey + 1", "id": "CAST(r_regionkey AS BIGINT)", "number": "CAST(3 - r_regionkey AS INT)", "name": "'T' || r_name"}),
    "user_update": ("supplier", {"ordinal": "s_suppkey + 1", "id": "s_suppkey * 3", "account_id": "s_suppkey", "first_name": "' Bob'", "last_name": "s_name", "photo": "CASE WHEN s_suppkey % 2 = 0 THEN '/new ' END"}),
    "session_update": ("supplier", {"ordinal": "s_suppkey + 1", "id": "s_suppkey", "account_id": "s_suppkey", "token": "'again-' || CAST(s_suppkey AS STRING)", "ip_address": "'10.1.1.1'", "expires_at": f"CASE WHEN s_suppkey % 3 = 0 THEN CAST('{NOW}' AS TIMESTAMP_NTZ) END"}),
    "school_year_update": ("region", {"ordinal": "r_regionkey + 1", "id": "CAST(r_regionkey AS BIGINT)", "start_year": "CASE WHEN r_regionkey % 2 = 0 THEN CAST(2010 + r_regionkey AS INT) END", "end_year": "CASE WHEN r_regionkey = 1 THEN 2000 END"}),
    "ids": ("customer", {"ordinal": "c_custkey + 1", "id": "c_custkey"}),
    "pairs": ("customer", {"ordinal": "c_custkey + 1", "account_id": "c_custkey", "role_id": "c_custkey % 25"}),
}


def requests(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = REQUESTS[name]
    return driver_table(spark, sf_dir, source).select(*(F.expr(e).alias(n) for n, e in columns.items())).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def _req(name: str) -> str:
    source, columns = REQUESTS[name]
    body = ", ".join(f"{'CAST(' + e + ' AS BIGINT)' if n == 'ordinal' else e} AS {n}" for n, e in columns.items())
    return f"(SELECT {body} FROM {source})".replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("AS STRING", "AS VARCHAR")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def _outcome(*checks: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{code}'" for c, code in checks) + " ELSE 'ok' END"


_EMAIL_SQL = r"'^[^\s@]+@[A-Za-z0-9.-]+$'"


def _sql_create(request: str, table: str, fields: dict[str, str], broken: str, keys: list[list[str]], out: list[str], years: str = "false", orphan: str = "false", extra: dict[str, str] | None = None) -> str:
    refused = "conflict" if TABLES[table].conflicts_mapped else "internal"
    norm = ", ".join(f"{e} AS {n}" for n, e in fields.items())
    taken = " OR ".join(f"EXISTS (SELECT 1 FROM {table} t WHERE {' AND '.join(f't.{k} = n.{k}' for k in key)})" for key in keys) or "false"
    later = " OR ".join(f"coalesce(min(CASE WHEN valid AND NOT ({'exists' + str(i)}) THEN ordinal END) OVER (PARTITION BY {', '.join(key)}) < ordinal, false)" for i, key in enumerate(keys)) or "false"
    each = "".join(f", EXISTS (SELECT 1 FROM {table} t WHERE {' AND '.join(f't.{k} = n.{k}' for k in key)}) AS exists{i}" for i, key in enumerate(keys))
    columns = ", ".join((extra or {}).get(c, c) for c in out)
    return f"""SELECT ordinal, {_outcome(("broken", "validation"), ("bad_years", "bad_state"), ("orphan", refused), ("taken OR later", refused))} AS outcome,
        CASE WHEN NOT broken AND NOT bad_years AND NOT orphan AND NOT taken AND NOT later THEN (SELECT coalesce(max(id), 0) FROM {table}) + ordinal END AS id, {columns}
        FROM (SELECT *, {later} AS later FROM (SELECT *, {taken} AS taken{each} FROM (
            SELECT *, NOT broken AND NOT bad_years AND NOT orphan AS valid FROM (SELECT ordinal, {norm}, {broken} AS broken, {years} AS bad_years, {orphan} AS orphan FROM {_req(request)} r)) n))"""


def _hashed(table: str) -> Column | None:
    return hash_column(F.col("password"), Pbkdf2Hasher()) if table == "accounts" else None


def _create(name: str, table: str, out: list[str], parents: tuple[str, ...] = (), **sql) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        found = mutations.create(load(s, d, table), requests(s, d, name), table, NOW, {p: load(s, d, p) for p in parents}, _hashed(table))
        return found.select("ordinal", "outcome", "id", *out)

    _add(name, query, _sql_create(name, table, out=out, **sql), table, *parents)


_create("course_create", "courses", ["code", "name", "description", "created_at"], fields={"code": f"upper({_trim('code')})", "name": _trim("name"), "description": _trim("description")}, broken="length(code) < 2", keys=[["code"]], extra={"created_at": f"{_NOW_SQL} AS created_at"})
_create("role_create", "roles", ["name", "description", "updated_at"], fields={"name": f"upper({_trim('name')})", "description": _trim("description")}, broken="length(name) < 3", keys=[["name"]], extra={"updated_at": f"{_NOW_SQL} AS updated_at"})
_create("account_create", "accounts", ["username", "email", "email_verified", "active"], fields={"username": _trim("username"), "email": f"lower({_trim('email')})"}, broken=f"length(username) < 3 OR NOT regexp_matches(email, {_EMAIL_SQL})", keys=[["username"], ["email"]], extra={"email_verified": "false AS email_verified", "active": "true AS active"})
_create("school_year_create", "school_years", ["start_year", "end_year"], fields={"start_year": "start_year", "end_year": "end_year"}, broken="false", keys=[["start_year", "end_year"]], years="start_year >= end_year")
_create("session_create", "sessions", ["account_id", "token", "ip_address", "expires_at", "last_used"], ("accounts",), fields={"account_id": "account_id", "token": _trim("token"), "ip_address": _trim("ip_address"), "expires_at": f"coalesce(expires_at, {_NOW_SQL} + INTERVAL '24' HOUR)"}, broken="account_id IS NULL", keys=[["token"]], orphan="account_id IS NOT NULL AND account_id NOT IN (SELECT id FROM accounts)", extra={"last_used": f"{_NOW_SQL} AS last_used"})
_create("term_create", "terms", ["number", "name"], fields={"number": "number", "name": "name"}, broken="number <= 0", keys=[])
_create("user_create", "users", ["account_id", "first_name", "last_name", "photo"], ("accounts",), fields={"account_id": "account_id", "first_name": _trim("first_name"), "last_name": _trim("last_name"), "photo": f"nullif({_trim('photo')}, '')"}, broken="length(first_name) < 2", keys=[], orphan="account_id NOT IN (SELECT id FROM accounts)")


def _update(name: str, table: str, fields: dict[str, str], keys: list[list[str]], parents: tuple[str, ...] = (), orphan: str = "false", years: str = "false", broken: str = "false") -> None:
    refused = "conflict" if TABLES[table].conflicts_mapped else "internal"
    kept = [n for n in TABLES[table].response if n not in (*fields, "id", "updated_at")]
    own = ["EXISTS (SELECT 1 FROM " + table + " t WHERE t.id <> n.id AND " + " AND ".join(f"t.{k} = n.{k}" for k in key) + ")" for key in keys]
    taken = (" OR ".join(own) or "false") + " AS taken" + "".join(f", {x} AS exists{i}" for i, x in enumerate(own))
    later = " OR ".join(f"coalesce(min(CASE WHEN valid AND NOT exists{i} THEN ordinal END) OVER (PARTITION BY {', '.join(key)}) < ordinal, false)" for i, key in enumerate(keys)) or "false"
    sql = f"""SELECT ordinal, {_outcome(("broken", "validation"), ("NOT found", "not_found"), ("bad_years", "bad_state"), ("orphan", refused), ("taken OR later", refused))} AS outcome, id, {", ".join((*fields, *kept))}, {_NOW_SQL} AS updated_at
        FROM (SELECT *, {later} AS later FROM (SELECT *, {taken} FROM (SELECT *, found AND NOT broken AND NOT bad_years AND NOT orphan AS valid FROM (
            SELECT *, {years} AS bad_years, {orphan} AS orphan FROM (
                SELECT r.ordinal, r.id, {broken} AS broken, o.id IS NOT NULL AS found, {", ".join(f"{e} AS {n}" for n, e in fields.items())}, {", ".join(f"o.{k}" for k in kept)}
                FROM {_req(name)} r LEFT JOIN {table} o ON o.id = r.id AND o.deleted_at IS NULL))) n))"""

    def query(s: SparkSession, d: str) -> DataFrame:
        found = mutations.update(load(s, d, table), requests(s, d, name), table, NOW, {p: load(s, d, p) for p in parents}, _hashed(table))
        return found.select("ordinal", "outcome", *TABLES[table].response)

    _add(name, query, sql, table, *parents)


_update("course_update", "courses", {"code": f"upper({_trim('r.code')})", "name": _trim("r.name"), "description": "r.description"}, [["code"]])
_update("account_update", "accounts", {"username": _trim("r.username"), "email": f"lower({_trim('r.email')})"}, [["username"], ["email"]], broken="length(r.password) < 8")
_update("role_update", "roles", {"name": f"upper({_trim('r.name')})", "description": _trim("r.description")}, [["name"]])
_update("term_update", "terms", {"number": "r.number", "name": "r.name"}, [], broken="r.number <= 0")
_update("user_update", "users", {"account_id": "r.account_id", "first_name": _trim("r.first_name"), "last_name": _trim("r.last_name"), "photo": f"nullif({_trim('r.photo')}, '')"}, [], ("accounts",), "account_id NOT IN (SELECT id FROM accounts)")
_update("session_update", "sessions", {"account_id": "r.account_id", "token": _trim("r.token"), "ip_address": "r.ip_address", "expires_at": "coalesce(r.expires_at, o.expires_at)"}, [["token"]], ("accounts",), "account_id NOT IN (SELECT id FROM accounts)")
_update("school_year_update", "school_years", {"start_year": "coalesce(r.start_year, o.start_year)", "end_year": "coalesce(r.end_year, o.end_year)"}, [["start_year", "end_year"]], years="coalesce(start_year >= end_year, false)")


def _state(name: str, query: Query, where: str, code: str, values: dict[str, str], more: tuple[tuple[str, str], ...] = ()) -> None:
    shown = [n for n in TABLES["accounts"].response if n != "id"]
    body = ", ".join(f"{values[n]} AS {n}" if n in values else f"a.{n}" for n in shown)
    _add(name, lambda s, d: query(s, d).drop("password_hash"), f"SELECT r.ordinal, {_outcome(('a.id IS NULL', code), *more)} AS outcome, r.id, {body} FROM {_req('ids')} r LEFT JOIN accounts a ON a.id = r.id AND {where}", "accounts")


_state("soft_delete", lambda s, d: mutations.soft_delete(load(s, d, "accounts"), requests(s, d, "ids"), "accounts", NOW), "a.deleted_at IS NULL", "not_found", {"updated_at": _NOW_SQL, "deleted_at": _NOW_SQL})
_state("restore", lambda s, d: mutations.restore(load(s, d, "accounts"), requests(s, d, "ids"), "accounts", NOW), "a.deleted_at IS NOT NULL", "bad_state", {"updated_at": _NOW_SQL, "deleted_at": "CAST(NULL AS TIMESTAMP)"})
_state("record_login", lambda s, d: mutations.record_login(load(s, d, "accounts"), requests(s, d, "ids"), NOW), "a.deleted_at IS NULL", "not_found", {"updated_at": _NOW_SQL, "last_login": _NOW_SQL}, (("a.active IS NULL", "internal"), ("NOT a.active", "bad_state")))
_add(
    "hard_delete",
    lambda s, d: mutations.hard_delete(load(s, d, "accounts"), requests(s, d, "ids"), "accounts", [(load(s, d, t), "account_id") for t in ("users", "sessions", "account_roles")]),
    f"SELECT r.ordinal, CASE WHEN a.id IS NULL THEN 'bad_state' WHEN r.id IN (SELECT account_id FROM users) OR r.id IN (SELECT account_id FROM sessions) OR r.id IN (SELECT account_id FROM account_roles) THEN 'internal' ELSE 'ok' END AS outcome, r.id FROM {_req('ids')} r LEFT JOIN accounts a ON a.id = r.id AND a.deleted_at IS NOT NULL",
    "accounts", "users", "sessions", "account_roles",
)
# The same three changes of the other tables. Requests ask for ids that are active, trashed, used and unknown.
for _t in (t for t in SERVED if t != "accounts"):
    _shown = [n for n in TABLES[_t].response if n != "id"]
    _stamp = {"updated_at": _NOW_SQL} if TABLES[_t].audited else {}
    for _name, _change, _where, _code, _gone in (("soft_delete", mutations.soft_delete, "a.deleted_at IS NULL", "not_found", _NOW_SQL), ("restore", mutations.restore, "a.deleted_at IS NOT NULL", "bad_state", "CAST(NULL AS TIMESTAMP)")):
        _values = _stamp | {"deleted_at": _gone}
        _body = ", ".join(f"{_values[n]} AS {n}" if n in _values else f"a.{n}" for n in _shown)
        _add(
            f"{_t}_{_name}",
            lambda s, d, t=_t, change=_change: change(load(s, d, t), requests(s, d, "ids"), t, NOW).select("ordinal", "outcome", *TABLES[t].response),
            f"SELECT r.ordinal, {_outcome(('a.id IS NULL', _code))} AS outcome, r.id, {_body} FROM {_req('ids')} r LEFT JOIN {_t} a ON a.id = r.id AND {_where}", _t,
        )
    _children = [(c, column) for c, spec in TABLES.items() for column, parent in spec.parents if parent == _t]
    _used = " OR ".join(f"EXISTS (SELECT 1 FROM {c} x WHERE x.{column} = r.id)" for c, column in _children) or "false"
    _add(
        f"{_t}_hard_delete",
        lambda s, d, t=_t, children=_children: mutations.hard_delete(load(s, d, t), requests(s, d, "ids"), t, [(load(s, d, c), column) for c, column in children]),
        f"SELECT r.ordinal, {_outcome(('a.id IS NULL', 'bad_state'), (_used, 'internal'))} AS outcome, r.id FROM {_req('ids')} r LEFT JOIN {_t} a ON a.id = r.id AND a.deleted_at IS NOT NULL", _t, *(c for c, _ in _children),
    )

_add(
    "hard_delete_applied",
    lambda s, d: (lambda links: mutations.apply_hard_delete(links, mutations.hard_delete(links, links.select(F.col("id").alias("ordinal"), "id"), "account_roles")))(load(s, d, "account_roles")),
    "SELECT id, account_id, role_id, created_at, deleted_at FROM account_roles WHERE deleted_at IS NULL", "account_roles",
)
_add(
    "assign_role",
    lambda s, d: mutations.assign_role(load(s, d, "account_roles"), requests(s, d, "pairs"), load(s, d, "accounts"), load(s, d, "roles"), NOW),
    f"""SELECT ordinal, CASE WHEN missing THEN 'not_found' WHEN taken THEN 'conflict' ELSE 'ok' END AS outcome,
        CASE WHEN missing OR taken THEN NULL WHEN link IS NULL THEN 'insert' ELSE 'restore' END AS action,
        CASE WHEN NOT missing AND NOT taken THEN coalesce(link, (SELECT max(id) FROM account_roles) + ordinal) END AS id, account_id, role_id,
        CASE WHEN NOT missing AND NOT taken THEN coalesce(created, {_NOW_SQL}) END AS created_at, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM (SELECT r.*, a.id IS NULL OR o.id IS NULL AS missing, l.id AS link, l.created_at AS created, l.id IS NOT NULL AND l.deleted_at IS NULL AS taken
            FROM {_req("pairs")} r LEFT JOIN accounts a ON a.id = r.account_id AND a.deleted_at IS NULL LEFT JOIN roles o ON o.id = r.role_id AND o.deleted_at IS NULL
            LEFT JOIN account_roles l ON l.account_id = r.account_id AND l.role_id = r.role_id)""",
    "accounts", "roles", "account_roles",
)
_add(
    "remove_role",
    lambda s, d: mutations.remove_role(load(s, d, "account_roles"), requests(s, d, "pairs"), NOW),
    f"SELECT r.ordinal, CASE WHEN l.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome, l.id, r.account_id, r.role_id, l.created_at, CASE WHEN l.id IS NOT NULL THEN {_NOW_SQL} END AS deleted_at FROM {_req('pairs')} r LEFT JOIN account_roles l ON l.account_id = r.account_id AND l.role_id = r.role_id AND l.deleted_at IS NULL",
    "account_roles",
)

# New states.

_add(
    "courses_after_create",
    lambda s, d: (lambda t: mutations.apply_create(t, mutations.create(t, requests(s, d, "course_create"), "courses", NOW), "courses"))(load(s, d, "courses")),
    f"SELECT * FROM courses UNION ALL SELECT id, code, name, description, created_at, {_NOW_SQL} AS updated_at, CAST(NULL AS TIMESTAMP) AS deleted_at FROM ({_sql_create('course_create', 'courses', {'code': f'upper({_trim("code")})', 'name': _trim('name'), 'description': _trim('description')}, 'length(code) < 2', [['code']], ['code', 'name', 'description', 'created_at'], extra={'created_at': f'{_NOW_SQL} AS created_at'})}) WHERE outcome = 'ok'",
    "courses",
)
_add(
    "accounts_after_soft_delete",
    lambda s, d: (lambda t: reads.response(mutations.apply_changed(t, mutations.soft_delete(t, requests(s, d, "ids"), "accounts", NOW), "accounts"), "accounts"))(load(s, d, "accounts")),
    f"SELECT id, username, email, email_verified, active, last_login, created_at, CASE WHEN deleted_at IS NULL THEN {_NOW_SQL} ELSE updated_at END AS updated_at, coalesce(deleted_at, {_NOW_SQL}) AS deleted_at FROM accounts",
    "accounts",
)
_add(
    "links_after_remove",
    lambda s, d: (lambda t: mutations.apply_changed(t, mutations.remove_role(t, requests(s, d, "pairs"), NOW), "account_roles"))(load(s, d, "account_roles")),
    f"SELECT l.id, l.account_id, l.role_id, l.created_at, CASE WHEN l.deleted_at IS NULL AND l.role_id = l.account_id % 25 THEN {_NOW_SQL} ELSE l.deleted_at END AS deleted_at FROM account_roles l",
    "account_roles",
)

# Rejects.

_RULES_SQL = {"username": ("not_blank", f"length({_trim('username')}) = 0"), "username ": ("size", "length(username) NOT BETWEEN 3 AND 100"), "email": ("email", f"NOT regexp_matches(email, {_EMAIL_SQL})")}
_add(
    "validation_rejects",
    lambda s, d: validated(requests(s, d, "account_create"), "accounts").select("ordinal", F.explode("violations").alias("v")).select("ordinal", "v.*"),
    " UNION ALL ".join(f"SELECT ordinal, '{f.strip()}' AS field, '{rule}' AS rule, {f.strip()} AS rejected FROM {_req('account_create')} WHERE {broken}" for f, (rule, broken) in _RULES_SQL.items()),
)
_add(
    "fk_rejects",
    lambda s, d: reads.missing_parent(requests(s, d, "user_create"), load(s, d, "accounts"), "account_id").select("ordinal", "account_id"),
    f"SELECT ordinal, account_id FROM {_req('user_create')} WHERE account_id NOT IN (SELECT id FROM accounts)", "accounts",
)
_add("purge_rejects", lambda s, d: reads.parents_in_use(load(s, d, "accounts"), load(s, d, "users"), "account_id").select("id"), "SELECT id FROM accounts WHERE id IN (SELECT account_id FROM users)", "accounts", "users")
_add(
    "unique_rejects",
    lambda s, d: mutations.create(load(s, d, "courses"), requests(s, d, "course_create"), "courses", NOW).where("outcome = 'conflict'").select("ordinal", "code"),
    f"SELECT ordinal, code FROM ({_sql_create('course_create', 'courses', {'code': f'upper({_trim("code")})', 'name': 'name', 'description': 'description'}, 'length(code) < 2', [['code']], ['code'])}) WHERE outcome = 'conflict'", "courses",
)


def _verify_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's own password and a wrong one, by a salted hasher; not SQL."""
    hasher = Pbkdf2Hasher(rounds=1000)
    rows = reads.active(load(spark, sf_dir, "accounts"), "accounts").select("username").withColumn("hashed", hash_column(F.col("username"), hasher))
    return rows.select("username", matches_column(F.col("username"), F.col("hashed"), hasher).alias("own"), matches_column(F.lit("wrong"), F.col("hashed"), hasher).alias("other"))


_add("verify_password", _verify_password)

# Planned in the reference.

_add("ocr_metadata", lambda s, d: documents.metadata_rows(papers(s, d)), PAPERS_SQL["metadata"])
_add("ocr_questions", lambda s, d: documents.questions(papers(s, d)), PAPERS_SQL["questions"])
_add("ocr_confident_questions", lambda s, d: documents.questions(documents.confident_questions(papers(s, d))).drop("order_index"), PAPERS_SQL["confident_questions"])
_add("ocr_options", lambda s, d: documents.options(papers(s, d)), PAPERS_SQL["options"])
_add("ocr_review_flags", lambda s, d: documents.review_flags(papers(s, d)), PAPERS_SQL["review_flags"])
_add("ocr_school_years", lambda s, d: documents.school_years_to_create(papers(s, d), load(s, d, "school_years")), PAPERS_SQL["school_years"], "school_years")
_add("ocr_operations", lambda s, d: documents.operations(papers(s, d)), PAPERS_SQL["operations"])


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest five of every vector whose id is divisible by 100 (the stated queries), among all vectors."""
    vectors = driver_table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(queries, vectors, threshold=0.2).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


_add(
    "retrieval_topk", _retrieval,
    """SELECT query_id, vec_id, round(s, 5) AS similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
        WHERE s >= 0.2) WHERE rank <= 5""",
)
_add("exam_scores_by_account", lambda s, d: analytics.scores_by_account(driver_table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("score"))), "SELECT o_custkey AS account_id, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100.0 AS mean_score, max(o_totalprice) AS best_score, min(o_totalprice) AS worst_score FROM orders GROUP BY 1")
_add("exam_answers_by_simulation", lambda s, d: analytics.answers_by_simulation(driver_table(s, d, "lineitem").select(F.col("l_orderkey").alias("simulation_id"), F.col("l_quantity").alias("points"), (F.col("l_returnflag") == "R").alias("correct"))), "SELECT l_orderkey AS simulation_id, count(*) AS n_answers, round(sum(l_quantity), 2) AS points, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS share_correct FROM lineitem GROUP BY 1")
_add("rate_limit", lambda s, d: analytics.requests_per_window(driver_table(s, d, "events").select("user_id", "ts"), 60, 1), "SELECT user_id, time_bucket(INTERVAL '60 minutes', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
_add(
    "chat_references",
    lambda s, d: retrieval.references(driver_table(s, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" @statement.maths.2024.t1."), F.col("role")).alias("text"))).drop("text"),
    "SELECT conv_id, turn, 'maths' AS subject, '2024' AS school_year, 't1' AS term, role AS exam_type FROM conversations",
)
_add(
    "reindex_latest",
    lambda s, d: reindex.visible(reindex.latest(driver_table(s, d, "events").select(F.col("user_id").alias("statement_id"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), F.col("props").alias("content")))),
    "SELECT statement_id, version, content FROM (SELECT user_id AS statement_id, event_id AS version, event_type = 'error' AS deleted, props AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND NOT deleted",
)
