from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.functions.passwords import Pbkdf2Hasher
from scholia.functions.validation import violations

STRINGS = st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\r\x00\x1f  \U0001f600ß")), max_size=8), min_size=1, max_size=30)
#: White space but no-break spaces, as in functions.text.
BLANK = {chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(STRINGS)
def test_strings_behave_as_in_a_utf16_world(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", text.java_trim(F.col("x")).alias("t"), text.has_text(F.col("x")).alias("h"), text.utf16_length(F.col("x")).alias("n"), text.not_blank(F.col("x")).alias("b")).collect()
    for r in rows:
        x = values[r["i"]]
        trimmed = x.strip("".join(map(chr, range(0x21))))
        assert (r["t"], r["h"], r["n"], r["b"]) == (trimmed, any(c not in BLANK for c in x), len(x.encode("utf-16-be")) // 2, bool(trimmed))


def test_nulls_have_no_text(spark):
    r = spark.sql("SELECT CAST(NULL AS STRING) AS x").select(text.has_text(F.col("x")), text.not_blank(F.col("x")), text.java_trim(F.col("x"))).collect()[0]
    assert tuple(r) == (False, False, None)


def _rules(spark, table, schema, *rows):
    found = spark.createDataFrame(rows, schema).select(violations(table).alias("v")).collect()
    return [[(v["field"], v["rule"]) for v in r["v"]] for r in found]


def test_rules_are_checked_before_trimming_and_all_of_them(spark):
    got = _rules(spark, "roles", "name string, description string", (" a ", None), ("", None), (None, "x" * 501), ("\U0001f600a", None))
    assert got == [[], [("name", "not_blank"), ("name", "size")], [("name", "not_blank"), ("description", "size")], []]


def test_mail_and_password(spark):
    rows = [("abc", "a@b.example", "long enough"), ("abc", "nobody", "short"), ("abc", None, None), ("abc", "a@-b.example", "long enough")]
    got = _rules(spark, "accounts", "username string, email string, password string", *rows)
    assert got == [[], [("email", "email"), ("password", "size")], [("email", "not_blank"), ("password", "not_blank")], [("email", "email")]]


def test_passwords_are_not_shown_in_violations(spark):
    v = spark.createDataFrame([("abc", "a@b.example", "short")], "username string, email string, password string").select(violations("accounts").alias("v")).collect()[0]["v"]
    assert v[0]["rejected"] is None


def test_numbers(spark):
    assert _rules(spark, "terms", "name string, number int", ("x", None), ("x", 1)) == [[("number", "positive")], []]
    assert _rules(spark, "school_years", "start_year int, end_year int", (None, 0)) == [[("start_year", "not_null"), ("end_year", "positive")]]


def test_hasher_is_salted():
    h = Pbkdf2Hasher(rounds=10)
    assert h.hash("p") != h.hash("p") and h.matches("p", h.hash("p")) and not h.matches("q", h.hash("p")) and not h.matches("p", "$2b$12$x")
