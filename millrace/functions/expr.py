"""Parsers that give NULL on malformed text under ANSI, blanks, hashes and first-match reasons."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DecimalType

DATE, TIMESTAMP = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"
TRUE_WORDS = ("true", "t", "1", "yes", "y")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.trim(col(c))


def blank(c: Column | str) -> Column:
    """True for NULL and for text of spaces only; never NULL."""
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


def parsed(c: Column | str, kind: str | DataType) -> Column:
    """The trimmed text as ``kind``, NULL where it is none."""
    return trimmed(c).try_cast(kind)


def money(c: Column | str, precision: int = 10) -> Column:
    """Exact decimal with two places; text that is no number, or too large, gives NULL."""
    return parsed(c, DecimalType(precision, 2))


def narrowed(c: Column, precision: int = 10, scale: int = 2) -> Column:
    """A decimal rounded half up to ``scale`` places, NULL where it does not fit."""
    return c.try_cast(DecimalType(precision, scale))


def as_date(c: Column | str, fmt: str = DATE) -> Column:
    return F.try_to_timestamp(trimmed(c), F.lit(fmt)).cast("date")


def as_timestamp(c: Column | str, fmt: str = TIMESTAMP) -> Column:
    return F.try_to_timestamp(trimmed(c), F.lit(fmt))


def flag(c: Column | str, words: Iterable[str] = TRUE_WORDS) -> Column:
    """True where the text is one of ``words`` in any case, else false."""
    return F.coalesce(F.lower(trimmed(c)).isin(*words), F.lit(False))


def malformed(raw: Column | str, value: Column | str) -> Column:
    """Text was there, but it did not parse."""
    return ~blank(raw) & col(value).isNull()


def row_hash(columns: Iterable[str]) -> Column:
    """SHA-256 over the named columns in alphabetical order, NULL told apart from text."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("<NULL>")) for c in sorted(columns))), 256)


def first_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition is true; conditions that are NULL do not match."""
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in rules), F.lit(None).cast("string"))


def zero_if_null(c: Column | str, precision: int = 14) -> Column:
    """Typed zero in place of NULL, so that money stays decimal."""
    return F.coalesce(col(c), F.lit(0).cast(DecimalType(precision, 2)))
