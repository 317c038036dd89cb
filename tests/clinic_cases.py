"""Values and helpers of the clinic tests; a name no other test folder has, so that the whole tree can be collected at once."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

THEN = datetime(2024, 1, 1, 9, 0, 0)
KEY = "only for tests"


def money(text: str) -> Decimal:
    return Decimal(text)


def rows(df, *columns):
    """The collected rows as tuples, in order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def rows_read(df):
    """Rows that the scans of a query handed on; row groups that were skipped have none."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))
