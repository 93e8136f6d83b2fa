from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        inside = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{inside}'")
    return connection


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Whether a query's rows are those of its SQL: names, kinds of types and values, in any order."""

    def kind(t) -> str:
        name = str(t)
        return "timestamp" if name.startswith("timestamp") else {"large_string": "string", "string_view": "string"}.get(name, name)

    def check(query, sql: str) -> int:
        mine, theirs = query(spark, sf_dir).toArrow(), duck.sql(sql).to_arrow_table()
        names = sorted(mine.column_names)
        assert names == sorted(theirs.column_names)
        for n in names:
            assert kind(mine.schema.field(n).type) == kind(theirs.schema.field(n).type), n
        rows = [sorted(map(repr, zip(*(t[n].to_pylist() for n in names), strict=True))) for t in (mine, theirs)]
        assert rows[0] == rows[1]
        return len(rows[0])

    return check
