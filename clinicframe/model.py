"""The clinic as a set of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinicframe.schemas import TABLES

Table = DataFrame | Callable[[], DataFrame]


class Clinic:
    """One DataFrame per clinic table, read as ``clinic.payments`` or ``clinic.table("payments")``.

    A table may be given as a function, called when the table is first used.
    Operators never modify a clinic, they return new DataFrames or a new clinic.
    """

    def __init__(self, **tables: Table):
        odd = set(tables) ^ set(TABLES)
        if odd:
            raise ValueError(f"unknown or missing tables: {', '.join(sorted(odd))}")
        self._tables = tables

    @classmethod
    def table_names(cls) -> list[str]:
        return list(TABLES)

    def table(self, name: str) -> DataFrame:
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def with_tables(self, **changed: Table) -> Clinic:
        return Clinic(**{**self._tables, **changed})

    @property
    def spark(self) -> SparkSession:
        return next((t for t in self._tables.values() if isinstance(t, DataFrame)), self.table("lab_test")).sparkSession
