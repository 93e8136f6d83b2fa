from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from scholia.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(name, same_rows):
    assert same_rows(QUERIES[name], ORACLE_SQL[name])


def test_all_ten_are_registered():
    names = [n.split("_")[0] for n in entry_points.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11)) and "pipeline" in entry_points.queries()
