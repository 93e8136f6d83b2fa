from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from scholia.plans.catalogue import ORACLE_SQL, QUERIES
from scholia.sources.fixtures import load
from scholia.sources.schemas import TABLES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_engine_queries_are_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_shows_a_password_hash(name, spark, sf_dir):
    assert "password_hash" not in QUERIES[name](spark, sf_dir).columns


@pytest.mark.parametrize("table", sorted(TABLES))
def test_tables_have_their_schema(table, spark, sf_dir):
    got = {f.name: f.dataType for f in load(spark, sf_dir, table).schema}
    assert got == {n: t for n, t, _ in TABLES[table].columns}


def test_verify_password(spark, sf_dir):
    rows = QUERIES["verify_password"](spark, sf_dir).collect()
    assert rows and all(r["own"] and not r["other"] for r in rows)


def test_predicates_reach_the_scan(spark, sf_dir, capsys):
    QUERIES["sessions_by_account"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(user_id,1)" in plan
