"""Money parsing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinicframe.functions.text import stripped

CENT = "decimal(20,2)"
NOT_COUNTED = "REFUNDED"


def parse_amount(column: str | Column) -> Column:
    """Decimal text rounded half-even to cents; NULL when it is not a finite number.

    Surrounding white space, digit-grouping underscores and exponents are understood.
    """
    plain = F.replace(stripped(column), F.lit("_"), F.lit(""))
    return F.bround(plain.try_cast("decimal(38,18)"), 2).cast(CENT)


def counted_amount(amount: str = "amount_paid", status: str = "status") -> Column:
    """What a payment adds to the paid total: refunded payments add nothing."""
    return F.when(F.col(status) != NOT_COUNTED, F.col(amount)).otherwise(F.lit(0)).cast("decimal(10,2)")
