"""Rules checked when a change is committed, on the changed rows alone.

A row that did not change broke no rule before, so only changed rows are tested; of all
other rows no more is read than the one column a rule compares, and of that only the
row groups whose range meets the changed keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.model import Clinic
from clinicframe.operators import quality
from clinicframe.operators.skew import join_grouped
from clinicframe.schemas import PRIMARY_KEY, REFERENCES, UNIQUE_KEYS

COLUMNS = ("rule", "table_name", "column_name", "value")


def difference(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``new`` that ``old`` lacks, rows of ``old`` that ``new`` lacks), repeats counted."""
    names = new.columns
    both = new.withColumn("__side", F.lit(1)).unionByName(old.select(*names).withColumn("__side", F.lit(-1)))
    net = both.groupBy(*names).agg(F.sum("__side").cast("int").alias("__net")).filter(F.col("__net") != 0)

    def rows(count):
        return net.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(0)) + 1))).filter(F.col("__copy") <= count).select(*names)

    return rows(F.col("__net")), rows(-F.col("__net"))


def _finding(rule: str, table: str, column: str, rows: DataFrame) -> DataFrame:
    value = F.col(column).cast("string").alias("value")
    return rows.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), value)


def _rows_at_fault(table: str, rows: DataFrame) -> list[DataFrame]:
    return [quality.row_violations(table, rows, rule).select("rule", "table_name", "column_name", F.col("row_key").alias("value")) for rule in quality.RULES]


class _Keys:
    """The keys of some rows, with the range of each column, fetched in one pass."""

    def __init__(self, rows: DataFrame, columns: Sequence[str]) -> None:
        bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
        self.rows, self._bounds = rows, rows.agg(F.count("*").alias("n"), *bounds).first()

    @property
    def any(self) -> bool:
        return self._bounds["n"] > 0

    def has(self, column: str) -> bool:
        return self._bounds[f"low_{column}"] is not None

    def of(self, column: str) -> DataFrame:
        return self.rows.select(column).filter(F.col(column).isNotNull()).distinct()

    def near(self, table: DataFrame, column: str) -> DataFrame:
        """The one column of a table, within the range of the keys: row groups outside it are skipped."""
        return table.select(column).filter(F.col(column).between(self._bounds[f"low_{column}"], self._bounds[f"high_{column}"]))


def of_tables(clinic: Clinic, tables: Sequence[str]) -> DataFrame:
    """What is wrong with whole tables."""
    found = [f for t in tables for f in _rows_at_fault(t, clinic.table(t))]
    found += [quality.duplicate_keys(t, clinic.table(t)).select(*COLUMNS) for t in tables]
    # A table of parents written anew may lack one that another table needs.
    children = {c for c, _, p in REFERENCES if c in tables or p in tables}
    return reduce(DataFrame.unionByName, [*found, quality.orphans(clinic, tuple(children)).select(*COLUMNS)] if children else found)


def of_changes(after: Clinic, rows: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame | None:
    """What a change breaks: ``after`` is the clinic with it, ``rows`` the changed and the removed rows of each table.

    None if there is nothing to check.
    """
    found = []
    for table, (changed, removed) in rows.items():
        unique = (PRIMARY_KEY[table], *UNIQUE_KEYS[table])
        parents = [(column, parent) for child, column, parent in REFERENCES if child == table]
        children = [(child, column) for child, column, parent in REFERENCES if parent == table]
        new = _Keys(changed, dict.fromkeys((*unique, *[c for c, _ in parents])))
        if new.any:
            found += _rows_at_fault(table, changed)
        for column in filter(new.has, unique):
            same = join_grouped(new.near(after.table(table), column), new.of(column), column, "left_semi")
            found.append(_finding("unique", table, column, same.groupBy(column).count().filter("count > 1")))
        for column, parent in parents:
            if new.has(column):
                lacking = new.of(column).join(new.near(after.table(parent), column), column, "left_anti")
                found.append(_finding("reference", table, column, lacking))
        lost = _Keys(removed, dict.fromkeys(c for _, c in children)) if children else None
        for child, column in children:
            if lost.has(column):
                absent = lost.of(column).join(lost.near(after.table(table), column), column, "left_anti")
                needed = join_grouped(lost.near(after.table(child), column), absent, column, "left_semi")
                found.append(_finding("reference", child, column, needed))
    return reduce(DataFrame.unionByName, found) if found else None
