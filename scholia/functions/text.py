"""Scalar functions with the semantics of the strings they come from (UTF-16, control characters count as blanks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank when asking for text. No-break spaces (U+00A0, U+2007, U+202F) don't.
BLANKS = r"\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"


def java_trim(x: Column) -> Column:
    """Without the characters up to U+0020 at both ends; no-break spaces stay."""
    return F.regexp_replace(x, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def has_text(x: Column) -> Column:
    """Whether there is a character that isn't a blank; null: no."""
    return F.coalesce(x.rlike(rf"[^{BLANKS}]"), F.lit(False))


def not_blank(x: Column) -> Column:
    """Whether anything is left after java_trim; null: no."""
    return F.coalesce(F.length(java_trim(x)) > 0, F.lit(False))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def upper_code(x: Column) -> Column:
    return F.upper(java_trim(x))


def lower_email(x: Column) -> Column:
    return F.lower(java_trim(x))


def text_or_null(x: Column) -> Column:
    return F.when(has_text(x), java_trim(x))


def default_expiry(given: Column, now: Column) -> Column:
    return F.coalesce(given, now + F.expr("INTERVAL 24 HOURS"))
