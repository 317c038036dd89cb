"""Looking at plans and comparing results."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``explain`` prints."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side has; empty when the results are equal."""
    return left.exceptAll(right).unionByName(right.exceptAll(left))
