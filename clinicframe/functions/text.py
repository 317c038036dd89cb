"""Text, date and identifier expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def full_name() -> Column:
    """First and last name; NULL when either part is NULL."""
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


def contains_any(column: str | Column, terms: Iterable[str], ci: bool = False) -> Column:
    """True when the text contains one of the terms, optionally ignoring case and accents."""
    text = F.col(column) if isinstance(column, str) else column
    if ci:
        text = F.collate(text, "UNICODE_CI_AI")
    found = [F.contains(text, F.collate(F.lit(t), "UNICODE_CI_AI") if ci else F.lit(t)) for t in terms]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def stripped(column: str | Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    text = F.col(column) if isinstance(column, str) else column
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(column: str | Column) -> Column:
    return F.nullif(stripped(column), F.lit(""))


def domain_rank(column: str, values: Iterable[str]) -> Column:
    """Sort position of an enumerated value: its place in the declaration, not the alphabet."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def patient_code(number: Column) -> Column:
    """``PAT-`` and at least three digits; longer numbers are kept whole."""
    return F.format_string("PAT-%03d", number)


def patient_number(column: str) -> Column:
    """The number inside a ``PAT-<digits>`` identifier, NULL for any other format."""
    digits = F.regexp_extract(F.col(column), r"^PAT-([0-9]+)$", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def day_text(column: str | Column) -> Column:
    return F.date_format(column, "MM/dd/yyyy")


def money_text(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("decimal(20,2)").cast("string")


def in_order(columns: Sequence[str]) -> Column:
    """One comparable value for a list of sort columns; a single one stays as it is, which groups faster."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
