"""The 64 routes of the service, over tables as DataFrames: the edge, where single requests are answered.

answer() takes a method, a path, query parameters and a JSON body, and gives the status that was meant, the one on the
wire, the response rows and, for writes, the new state of the table. Only here is anything collected, a row at most;
the set forms in scholia.operators do the same for whole frames of requests.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.passwords import Hasher, hash_column, matches_column
from scholia.operators import mutations, reads
from scholia.operators.errors import OK, STATUSES
from scholia.sources.exchange import PATHS, location, read_requests
from scholia.sources.schemas import SERVED, TABLES

#: Rows of these tables point to rows of the table: (child, column).
CHILDREN = {t: [(c, column) for c, spec in TABLES.items() for column, parent in spec.parents if parent == t] for t in TABLES}


@dataclass(frozen=True)
class Answer:
    status: int
    wire_status: int
    rows: DataFrame | None = None
    location: str | None = None
    #: The table that changed, if one did, and its new state.
    changed: Mapping[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Service:
    spark: SparkSession
    tables: Mapping[str, DataFrame]
    now: str
    hasher: Hasher | None = None

    def answer(self, method: str, path: str, query: Mapping[str, str] | None = None, body: str | None = None) -> Answer:
        for route in ROUTES:
            match = route.pattern.fullmatch(path)
            if match and route.method == method:
                return route.run(self, {**match.groupdict(), **(query or {})}, body)
        return Answer(404, 404)

    def verify_password(self, username: str, password: str) -> bool:
        """False where there is no such active account. No route leads here."""
        if self.hasher is None:
            raise ValueError("a hasher is needed")
        wanted = reads.java_trim(F.lit(username))
        found = self.tables["accounts"].where(reads.is_active() & (F.col("username") == wanted))
        rows = found.select(matches_column(F.lit(password), F.col("password_hash"), self.hasher).alias("ok")).collect()
        return any(r["ok"] for r in rows)

    # Parts of routes.

    def one(self, rows: DataFrame) -> Answer:
        """A row, or not found."""
        return Answer(200, 200, rows) if rows.limit(1).count() else self.error("not_found")

    def error(self, code: str) -> Answer:
        return Answer(*STATUSES[code])

    def _request(self, table: str, body: str | None, row_id: int | None = None) -> DataFrame:
        raw = self.spark.createDataFrame([(1, row_id, body)], "ordinal bigint, id bigint, body string")
        return read_requests(raw if row_id is not None else raw.drop("id"), table)

    def _hash(self, table: str) -> Column | None:
        if table != "accounts":
            return None
        if self.hasher is None:
            raise ValueError("a hasher is needed to store passwords")
        return hash_column(F.col("password"), self.hasher)

    def create(self, table: str, body: str | None) -> Answer:
        results = mutations.create(self.tables[table], self._request(table, body), table, self.now, self.tables, self._hash(table))
        row = results.collect()
        if row[0]["outcome"] != OK:
            return self.error(row[0]["outcome"])
        fixed = self.spark.createDataFrame(row, results.schema)  # a salted hash must not be computed twice
        where = fixed.select(location(table, F.col("id")).alias("l")).collect()[0]["l"]
        status = 200 if table == "terms" else 201
        return Answer(status, status, reads.response(fixed, table), where, {table: mutations.apply_create(self.tables[table], fixed, table)})

    def _changed(self, table: str, results: DataFrame, status: int) -> Answer:
        row = results.collect()
        if row[0]["outcome"] != OK:
            return self.error(row[0]["outcome"])
        fixed = self.spark.createDataFrame(row, results.schema)
        return Answer(status, status, reads.response(fixed, table) if status == 200 else None, None, {table: mutations.apply_changed(self.tables[table], fixed, table)})

    def update(self, table: str, row_id: int, body: str | None) -> Answer:
        return self._changed(table, mutations.update(self.tables[table], self._request(table, body, row_id), table, self.now, self.tables, self._hash(table), whole=True), 200)

    def state(self, change: Callable, table: str, row_id: int) -> Answer:
        return self._changed(table, change(self.tables[table], self._id(row_id), table, self.now), 204)

    def _id(self, row_id: int) -> DataFrame:
        return self.spark.createDataFrame([(1, row_id)], "ordinal bigint, id bigint")

    def purge(self, table: str, row_id: int) -> Answer:
        results = mutations.hard_delete(self.tables[table], self._id(row_id), table, [(self.tables[c], column) for c, column in CHILDREN[table] if c in self.tables])
        outcome = results.collect()[0]["outcome"]
        return self.error(outcome) if outcome != OK else Answer(204, 204, changed={table: mutations.apply_hard_delete(self.tables[table], results)})

    def login(self, row_id: int) -> Answer:
        return self._changed("accounts", mutations.record_login(self.tables["accounts"], self._id(row_id), self.now), 200)

    def with_account(self, row_id: int) -> Answer:
        users = self.tables["users"].where(F.col("id") == row_id)
        return self.one(reads.with_account(users, self.tables["accounts"], "users"))

    def roles_of(self, account: int) -> Answer:
        accounts = self.tables["accounts"].where(F.col("id") == account)
        if not accounts.where(reads.is_active()).limit(1).count():
            return self.error("not_found")
        links = self.tables["account_roles"].where(F.col("account_id") == account)
        return Answer(200, 200, reads.roles_by_account(accounts, links, self.tables["roles"]).drop("account_id"))

    def _pair(self, account: int, role: int) -> DataFrame:
        return self.spark.createDataFrame([(1, account, role)], "ordinal bigint, account_id bigint, role_id bigint")

    def assign(self, account: int, role: int) -> Answer:
        links = self.tables["account_roles"]
        results = mutations.assign_role(links, self._pair(account, role), self.tables["accounts"], self.tables["roles"], self.now)
        outcome = results.collect()[0]["outcome"]
        return self.error(outcome) if outcome != OK else Answer(204, 204, changed={"account_roles": mutations.apply_assign(links, results)})

    def remove(self, account: int, role: int) -> Answer:
        links = self.tables["account_roles"]
        results = mutations.remove_role(links, self._pair(account, role), self.now)
        outcome = results.collect()[0]["outcome"]
        return self.error(outcome) if outcome != OK else Answer(204, 204, changed={"account_roles": mutations.apply_changed(links, results, "account_roles")})


@dataclass(frozen=True)
class Route:
    method: str
    path: str
    run: Callable[[Service, Mapping[str, str], str | None], Answer]

    @cached_property
    def pattern(self) -> re.Pattern:
        return re.compile(re.sub(r"\{(\w+)\}", lambda m: f"(?P<{m[1]}>[^/]+)" if m[1] == "username" else rf"(?P<{m[1]}>-?\d+)", self.path))


def _family(t: str) -> list[Route]:
    base = PATHS[t]
    return [
        Route("GET", base, lambda s, p, b: Answer(200, 200, reads.active(s.tables[t], t))),
        Route("GET", f"{base}/trash", lambda s, p, b: Answer(200, 200, reads.trash(s.tables[t], t))),
        Route("GET", f"{base}/{{id}}", lambda s, p, b: s.one(reads.active_by(s.tables[t], t, id=int(p["id"])))),
        Route("POST", base, lambda s, p, b: s.create(t, b)),
        Route("PUT", f"{base}/{{id}}", lambda s, p, b: s.update(t, int(p["id"]), b)),
        Route("DELETE", f"{base}/{{id}}", lambda s, p, b: s.state(mutations.soft_delete, t, int(p["id"]))),
        Route("POST", f"{base}/{{id}}/restore", lambda s, p, b: s.state(mutations.restore, t, int(p["id"]))),
        Route("DELETE", f"{base}/{{id}}/purge", lambda s, p, b: s.purge(t, int(p["id"]))),
    ]


_ACCOUNTS, _USERS = PATHS["accounts"], PATHS["users"]
ROUTES: list[Route] = [r for t in SERVED for r in _family(t)] + [
    Route("GET", f"{_ACCOUNTS}/active", lambda s, p, b: Answer(200, 200, reads.active_by(s.tables["accounts"], "accounts", active=p.get("active", "true") == "true"))),
    Route("GET", f"{_ACCOUNTS}/username/{{username}}", lambda s, p, b: s.one(reads.account_by_username(s.tables["accounts"], p["username"]))),
    Route("POST", f"{_ACCOUNTS}/{{id}}/login", lambda s, p, b: s.login(int(p["id"]))),
    Route("GET", f"{_ACCOUNTS}/{{account}}/roles", lambda s, p, b: s.roles_of(int(p["account"]))),
    Route("POST", f"{_ACCOUNTS}/{{account}}/roles/{{role}}", lambda s, p, b: s.assign(int(p["account"]), int(p["role"]))),
    Route("DELETE", f"{_ACCOUNTS}/{{account}}/roles/{{role}}", lambda s, p, b: s.remove(int(p["account"]), int(p["role"]))),
    Route("GET", f"{_USERS}/{{id}}/with-account", lambda s, p, b: s.with_account(int(p["id"]))),
    Route("GET", f"{_USERS}/account/{{account}}", lambda s, p, b: Answer(200, 200, reads.active_by(s.tables["users"], "users", account_id=int(p["account"])))),
]
