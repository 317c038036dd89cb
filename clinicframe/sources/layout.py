"""Orders stored so that filters on either of two columns skip most row groups.

The values of both columns are scaled to whole numbers and their bits interleaved. Rows
sorted by that number lie close to their neighbours in both columns, so the statistics
of a row group span a small range of each: a filter on one column alone skips nearly as
well as the square root of the number of row groups allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.text import patient_number
from clinicframe.schemas import ORDER_STATUS

BITS = 16


def status_place(status: str = "status") -> Column:
    """The place of a status in its declared order; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(ORDER_STATUS)), F.col(status)), F.lit(0)), F.lit(len(ORDER_STATUS) + 1))


def day_number(day: str = "order_date") -> Column:
    return F.unix_date(F.col(day))


def by_patient_and_date() -> tuple[Column, Column]:
    return patient_number("patient_id"), day_number()


def by_status_and_date() -> tuple[Column, Column]:
    return status_place(), day_number()


def interleaved(first: Column, second: Column, bits: int = BITS) -> Column:
    """Two whole numbers below 2 ** bits as one with their bits in turn."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for place, value in ((2 * k + 1, first), (2 * k, second)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def write_clustered(orders: DataFrame, path: str, by: tuple[Column, Column], row_group_bytes: int | None = None, mode: str = "errorifexists") -> None:
    """Write orders in the order of two interleaved columns. The ranges of both are found in one pass; missing values come first."""
    found = orders.agg(*[f(c.cast("long")).alias(f"{n}{i}") for i, c in enumerate(by) for n, f in (("low", F.min), ("high", F.max))]).first()
    scaled = []
    for i, column in enumerate(by):
        low, high = (found[f"{n}{i}"] or 0 for n in ("low", "high"))
        # Fewer values than numbers: each value then spans several, so both columns reach the leading bits.
        step = ((1 << BITS) - 2) / max(1, high - low)
        scaled.append(F.coalesce(F.floor((column.cast("long") - low) * F.lit(step)) + 1, F.lit(0)))
    placed = orders.withColumn("__place", interleaved(*scaled))
    writer = placed.repartitionByRange("__place", "order_id").sortWithinPartitions("__place", "order_id").drop("__place").write.mode(mode)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size.row.check.min", "10")
    writer.parquet(path)
