"""The fixed schemas of the tables, and what must hold between their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_LONG, _INT, _TEXT, _FLAG, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


@dataclass(frozen=True)
class Table:
    """A soft-deletable table. Columns are (name, type, nullable); `response` is what readers get to see."""

    name: str
    columns: tuple[tuple[str, T.DataType, bool], ...]
    unique: tuple[tuple[str, ...], ...] = ()
    parents: tuple[tuple[str, str], ...] = ()
    hidden: tuple[str, ...] = ()
    #: Whether a key that exists already is told from other failures (409), or not (500).
    conflicts_mapped: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, null) for n, t, null in self.columns])

    @property
    def response(self) -> list[str]:
        return [n for n, _, _ in self.columns if n not in self.hidden]

    @property
    def audited(self) -> bool:
        return any(n == "updated_at" for n, _, _ in self.columns)


def _audit(null: bool = False) -> tuple:
    return (("created_at", _TIME, null), ("updated_at", _TIME, null), ("deleted_at", _TIME, True))


ACCOUNTS = Table("accounts", (("id", _LONG, False), ("username", _TEXT, False), ("email", _TEXT, False), ("password_hash", _TEXT, False), ("email_verified", _FLAG, True), ("active", _FLAG, True), ("last_login", _TIME, True), *_audit()), unique=(("username",), ("email",)), hidden=("password_hash",))
USERS = Table("users", (("id", _LONG, False), ("account_id", _LONG, False), ("first_name", _TEXT, False), ("last_name", _TEXT, False), ("photo", _TEXT, True), *_audit()), parents=(("account_id", "accounts"),), conflicts_mapped=False)
SESSIONS = Table("sessions", (("id", _LONG, False), ("account_id", _LONG, False), ("token", _TEXT, False), ("ip_address", _TEXT, False), ("expires_at", _TIME, False), ("last_used", _TIME, False), *_audit()), unique=(("token",),), parents=(("account_id", "accounts"),), conflicts_mapped=False)
ROLES = Table("roles", (("id", _LONG, False), ("name", _TEXT, False), ("description", _TEXT, True), *_audit()), unique=(("name",),))
ACCOUNT_ROLES = Table("account_roles", (("id", _LONG, False), ("account_id", _LONG, False), ("role_id", _LONG, False), ("created_at", _TIME, False), ("deleted_at", _TIME, True)), unique=(("account_id", "role_id"),), parents=(("account_id", "accounts"), ("role_id", "roles")))
COURSES = Table("courses", (("id", _LONG, False), ("code", _TEXT, False), ("name", _TEXT, False), ("description", _TEXT, True), *_audit(True)), unique=(("code",),))
SCHOOL_YEARS = Table("school_years", (("id", _LONG, False), ("start_year", _INT, False), ("end_year", _INT, False), *_audit()), unique=(("start_year", "end_year"),))
TERMS = Table("terms", (("id", _LONG, False), ("number", _INT, False), ("name", _TEXT, False), *_audit()), conflicts_mapped=False)

TABLES = {t.name: t for t in (ACCOUNTS, USERS, SESSIONS, ROLES, ACCOUNT_ROLES, COURSES, SCHOOL_YEARS, TERMS)}
#: Tables that have a service of their own (links between accounts and roles belong to the roles' service).
SERVED = tuple(n for n in TABLES if n != "account_roles")
