from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.operators import errors, mutations, reads
from scholia.sources.schemas import TABLES

NOW, OLD = "2024-06-01 12:00:00", "2024-01-01 00:00:00"


def table(spark, name, *rows):
    """Rows as (id, other columns before the audit columns, deleted)."""
    spec = TABLES[name]
    own = [n for n, _, _ in spec.columns if n not in ("created_at", "updated_at", "deleted_at")]
    df = spark.createDataFrame([(*r,) for r in rows], ", ".join(f"{n} {t.simpleString()}" for n, t, _ in spec.columns if n in own) + ", gone boolean")
    stamp = F.lit(OLD).cast("timestamp_ntz")
    audit = {"created_at": stamp, "deleted_at": F.when(F.col("gone"), stamp)} | ({"updated_at": stamp} if spec.audited else {})
    return df.withColumns(audit).select(*(n for n, _, _ in spec.columns))


def outcomes(df):
    return {r["ordinal"]: r["outcome"] for r in df.collect()}


def roles(spark):
    return table(spark, "roles", (1, "ADMIN", None, False), (2, "OLD", None, True))


def test_create_normalises_and_numbers(spark):
    got = mutations.create(roles(spark), spark.createDataFrame([(1, " new\t", " d ")], "ordinal bigint, name string, description string"), "roles", NOW).collect()[0]
    assert (got["outcome"], got["id"], got["name"], got["description"]) == ("ok", 3, "NEW", "d")


def test_no_break_space_is_kept(spark):
    got = mutations.create(roles(spark), spark.createDataFrame([(1, " ab", None)], "ordinal bigint, name string, description string"), "roles", NOW).collect()[0]
    assert got["name"] == " AB"


def test_duplicates_of_active_trashed_and_earlier_rows(spark):
    requests = spark.createDataFrame([(1, "admin", None), (2, "old", None), (3, "new", None), (4, "NEW ", None), (5, "", None)], "ordinal bigint, name string, description string")
    results = mutations.create(roles(spark), requests, "roles", NOW)
    assert outcomes(results) == {1: "conflict", 2: "conflict", 3: "ok", 4: "conflict", 5: "validation"}
    after = mutations.apply_create(roles(spark), results, "roles")
    assert sorted(r["name"] for r in after.collect()) == ["ADMIN", "NEW", "OLD"]
    rejected = {r["ordinal"]: (r["intended_status"], r["wire_status"]) for r in errors.rejects(results).collect()}
    assert rejected == {1: (409, 500), 2: (409, 500), 4: (409, 500), 5: (400, 400)}


def test_create_on_an_empty_table(spark):
    got = mutations.create(roles(spark).limit(0), spark.createDataFrame([(1, "first", None)], "ordinal bigint, name string, description string"), "roles", NOW).collect()[0]
    assert (got["outcome"], got["id"]) == ("ok", 1)


def test_equal_years_are_refused(spark):
    years = table(spark, "school_years", (1, 2024, 2025, False))
    requests = spark.createDataFrame([(1, 2024, 2024), (2, 2024, 2025), (3, 2025, 2026)], "ordinal bigint, start_year int, end_year int")
    assert outcomes(mutations.create(years, requests, "school_years", NOW)) == {1: "bad_state", 2: "conflict", 3: "ok"}


def accounts(spark):
    return table(spark, "accounts", (1, "ann", "a@x.example", "h1", True, True, None, False), (2, "bob", "b@x.example", "h2", True, False, None, False), (3, "cy", "c@x.example", "h3", True, True, None, True), (4, "di", "d@x.example", "h4", True, None, None, False))


def ids(spark, *values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "ordinal bigint, id bigint")


def test_parents_may_be_trashed_but_not_missing(spark):
    users = table(spark, "users", (1, 1, "A", "B", None, False))
    requests = spark.createDataFrame([(1, 3, "Ann", "Bee", " "), (2, 9, "Ann", "Bee", None)], "ordinal bigint, account_id bigint, first_name string, last_name string, photo string")
    results = mutations.create(users, requests, "users", NOW, {"accounts": accounts(spark)})
    assert outcomes(results) == {1: "ok", 2: "internal"}
    assert results.where("ordinal = 1").collect()[0]["photo"] is None


def test_update_replaces_nulls_too(spark):
    courses = table(spark, "courses", (1, "C1", "Name", "text", False), (2, "C2", "Other", None, True))
    requests = spark.createDataFrame([(1, 1, " c9 ", "New name", None), (2, 2, "c2", "Other", None), (3, 1, "c8", "Again", None)], "ordinal bigint, id bigint, code string, name string, description string")
    results = mutations.update(courses, requests, "courses", NOW)
    assert outcomes(results) == {1: "ok", 2: "not_found", 3: "conflict"}
    after = {r["id"]: (r["code"], r["description"], str(r["updated_at"])) for r in mutations.apply_changed(courses, results, "courses").collect()}
    assert after == {1: ("C9", None, NOW), 2: ("C2", None, OLD)}


def test_update_keeps_its_own_key(spark):
    courses = table(spark, "courses", (1, "C1", "Name", None, False), (2, "C2", "Other", None, True))
    requests = spark.createDataFrame([(1, 1, "c1", "Same", None)], "ordinal bigint, id bigint, code string, name string, description string")
    assert outcomes(mutations.update(courses, requests, "courses", NOW)) == {1: "ok"}


def test_session_expiry(spark):
    sessions = table(spark, "sessions").withColumn("expires_at", F.col("expires_at"))
    requests = spark.createDataFrame([(1, 1, "t", "ip", None)], "ordinal bigint, account_id bigint, token string, ip_address string, expires_at timestamp_ntz")
    got = mutations.create(sessions, requests, "sessions", NOW, {"accounts": accounts(spark)}).collect()[0]
    assert (str(got["expires_at"]), str(got["last_used"])) == ("2024-06-02 12:00:00", NOW)


def test_soft_delete_and_restore(spark):
    a = accounts(spark)
    gone = mutations.soft_delete(a, ids(spark, 1, 3, 9, 1), "accounts", NOW)
    assert outcomes(gone) == {1: "ok", 2: "not_found", 3: "not_found", 4: "not_found"}
    back = mutations.restore(a, ids(spark, 3, 1), "accounts", NOW)
    assert outcomes(back) == {1: "ok", 2: "bad_state"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.sampled_from([1, 2, 4]), min_size=1))
def test_restore_undoes_soft_delete_but_for_the_stamp(spark, chosen):
    a, wanted = accounts(spark), ids(spark, *sorted(chosen))
    after = mutations.apply_changed(a, mutations.soft_delete(a, wanted, "accounts", NOW), "accounts")
    again = mutations.apply_changed(after, mutations.restore(after, wanted, "accounts", NOW), "accounts")
    assert sorted(map(repr, again.drop("updated_at").collect())) == sorted(map(repr, a.drop("updated_at").collect()))


def test_login_needs_an_active_flag(spark):
    assert outcomes(mutations.record_login(accounts(spark), ids(spark, 1, 2, 3, 4), NOW)) == {1: "ok", 2: "bad_state", 3: "not_found", 4: "internal"}


def test_purge_needs_trash_and_no_children(spark):
    a = accounts(spark)
    users = table(spark, "users", (1, 3, "A", "B", None, True))
    assert outcomes(mutations.hard_delete(a, ids(spark, 1, 3), "accounts", [(users, "account_id")])) == {1: "bad_state", 2: "internal"}
    left = mutations.apply_hard_delete(a, mutations.hard_delete(a, ids(spark, 3), "accounts", [(users.limit(0), "account_id")]))
    assert sorted(r["id"] for r in left.collect()) == [1, 2, 4]


def test_assign_and_remove(spark):
    links = table(spark, "account_roles", (1, 1, 1, False), (2, 2, 1, True))
    pairs = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 4, 1), (4, 4, 1), (5, 3, 1), (6, 1, 2)], "ordinal bigint, account_id bigint, role_id bigint")
    results = mutations.assign_role(links, pairs, accounts(spark), roles(spark), NOW)
    assert outcomes(results) == {1: "conflict", 2: "ok", 3: "ok", 4: "conflict", 5: "not_found", 6: "not_found"}
    after = mutations.apply_assign(links, results)
    assert sorted((r["id"], r["deleted_at"] is None, str(r["created_at"])) for r in after.collect()) == [(1, True, OLD), (2, True, OLD), (5, True, NOW)]
    assert outcomes(mutations.remove_role(links, pairs, NOW)) == {1: "ok", 2: "not_found", 3: "not_found", 4: "not_found", 5: "not_found", 6: "not_found"}


def test_reads_on_empty_tables(spark):
    a = accounts(spark).limit(0)
    assert reads.count_active_by(a, id=1).collect()[0]["n"] == 0
    assert reads.exists_active_by(a, id=1).collect()[0]["found"] is False
    assert reads.active(a, "accounts").count() == 0


def test_accounts_without_children_count_zero(spark):
    users = table(spark, "users", (1, 1, "A", "B", None, False), (2, 2, "A", "B", None, True))
    got = {r["account_id"]: r["n"] for r in reads.counts_by_account(accounts(spark), users).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}


def test_user_of_a_trashed_account(spark):
    users = table(spark, "users", (1, 1, "A", "B", None, False), (2, 3, "A", "B", None, False))
    assert [r["id"] for r in reads.with_account(users, accounts(spark), "users").collect()] == [1]
    left = {r["id"]: r["account"] for r in reads.with_account(users, accounts(spark), "users", "left").collect()}
    assert left[1]["username"] == "ann" and left[2] is None
    assert [r["id"] for r in reads.without_account(users, accounts(spark), "users").collect()] == [2]


def test_shared_keys(spark):
    rows = table(spark, "courses", (1, "A", "same", None, False), (2, "B", "same", None, False), (3, "C", "other", None, False))
    assert sorted((r["id"], r["first_id"]) for r in reads.same_key_other_id(rows, ["name"]).collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("change", [mutations.create, mutations.update])
def test_an_account_is_not_written_without_a_hasher(spark, change):
    requests = spark.createDataFrame([(1, 1, "ann", "a@b.c", "long enough")], "ordinal bigint, id bigint, username string, email string, password string")
    with pytest.raises(ValueError, match="hasher"):
        change(accounts(spark), requests, "accounts", NOW)


def test_a_school_year_is_updated_in_part_unless_it_must_be_whole(spark):
    from datetime import datetime

    moment = datetime(2024, 1, 1)
    years = spark.createDataFrame([(1, 2020, 2021, moment, moment, None)], TABLES["school_years"].schema)
    requests = spark.createDataFrame([(1, 1, 2019, None)], "ordinal bigint, id bigint, start_year int, end_year int")
    assert outcomes(mutations.update(years, requests, "school_years", NOW)) == {1: "ok"}
    assert outcomes(mutations.update(years, requests, "school_years", NOW, whole=True)) == {1: "validation"}
