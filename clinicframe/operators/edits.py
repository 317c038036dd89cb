"""The changes of the clinic as edits of the rows they touch, for commits that leave all other files alone.

Every function returns the edits of one change; the operators of ``changes`` and
``ledger`` do the work, on the rows of the touched files instead of the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.model import Clinic
from clinicframe.operators import changes, ledger
from clinicframe.schemas import PRIMARY_KEY, REFERENCES


class Edit(NamedTuple):
    """A change of one table.

    ``keys`` (one column of the edited table) or ``condition`` find the rows it touches;
    ``rewrite`` turns the rows of their files into what replaces them and leaves other
    rows alone. ``added`` are new rows.
    """

    table: str
    rewrite: Callable[[DataFrame], DataFrame] | None = None
    keys: DataFrame | None = None
    condition: Column | None = None
    added: DataFrame | None = None


def on_rows(clinic: Clinic, table: str, change: Callable[[Clinic], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A change of a clinic's table as a change of some of its rows."""
    return lambda rows: change(clinic.with_tables(**{table: rows}))


def contact(clinic: Clinic, patient_id: str, number: str, address: str, key: str | bytes, now: datetime | None = None) -> list[Edit]:
    """Set one patient's contact and address."""
    change = on_rows(clinic, "clinic_patients", lambda c: changes.change_contact(c, patient_id, number, address, key, now))
    return [Edit("clinic_patients", change, keys=clinic.spark.createDataFrame([(patient_id,)], "patient_id string"))]


def completed_old_orders(clinic: Clinic, as_of: date, days: int = 7, now: datetime | None = None) -> list[Edit]:
    """Complete the pending orders that are at least ``days`` old."""
    old = (F.col("status") == "PENDING") & (F.col("order_date") <= F.date_sub(F.lit(as_of), days))
    return [Edit("lab_test", on_rows(clinic, "lab_test", lambda c: changes.complete_old_orders(c, as_of, days, now)), condition=old)]


def deleted(clinic: Clinic, table: str, keys: DataFrame) -> list[Edit]:
    """Delete the rows of one table whose key is listed (one column)."""
    column, = keys.columns
    return [Edit(table, lambda rows: changes.delete_keys(rows, keys, column), keys=keys)]


def deleted_orders(clinic: Clinic, orders: DataFrame) -> list[Edit]:
    """Delete the listed orders with their panel rows and payments."""
    listed = orders.select("order_id").distinct()
    tables = ["lab_test", *[child for child, _, parent in REFERENCES if parent == "lab_test"]]
    return [edit for table in tables for edit in deleted(clinic, table, listed)]


def cancelled_orders(clinic: Clinic) -> list[Edit]:
    """Delete cancelled orders and what belongs to them."""
    return deleted_orders(clinic, clinic.lab_test.filter("status = 'CANCELLED'"))


def patient_test(clinic: Clinic, patient_id: str, test_name: str) -> list[Edit]:
    """Delete one patient's orders of a test and what belongs to them."""
    return deleted_orders(clinic, clinic.lab_test.filter(changes.patient_test_condition(clinic, patient_id, test_name)))


def deleted_payments(clinic: Clinic, payments: DataFrame) -> list[Edit]:
    return deleted(clinic, "payments", payments.select("payment_id"))


def posted_results(clinic: Clinic, test_type: str, results: DataFrame, order_by: Sequence[str], now: datetime | None = None) -> list[Edit]:
    """Add panel rows and complete their orders."""
    panel = changes.panel_of(test_type)
    read = changes.read_results(clinic, panel, results, order_by, now)
    done = lambda rows: changes.patch_rows(rows, read.done, "order_id", ("status",), now)
    return [Edit(panel, added=read.new), Edit("lab_test", done, keys=read.done.select("order_id"))]


def patched(
    clinic: Clinic, table: str, patch: DataFrame, columns: Sequence[str], now: datetime | None = None, order_by: Sequence[str] = ()
) -> list[Edit]:
    """Set columns of the rows whose primary key is in ``patch``."""
    key = PRIMARY_KEY[table]
    return [Edit(table, lambda rows: changes.patch_rows(rows, patch, key, columns, now, order_by), keys=patch.select(key))]


def recorded_payments(
    clinic: Clinic, entries: DataFrame, order_by: Sequence[str], key: str | bytes, high_water: int | None = None, now: datetime | None = None
) -> list[Edit]:
    """Enter the acceptable payments; only rows above the high-water mark are new."""
    return [Edit("payments", added=ledger.new_payments(clinic, entries, order_by, key, high_water, now).payments)]
