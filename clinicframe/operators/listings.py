"""Projections, filters and sorted listings of single tables.

Every listing that sorts adds a unique key as the last sort column: ties are then
ordered, and the range partitioning behind the sort can split a value that
repeats in a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.text import contains_any, domain_rank, full_name
from clinicframe.model import Clinic
from clinicframe.operators.skew import join_grouped
from clinicframe.schemas import ORDER_STATUS, PANEL_OF_TEST

BY_NAME = ("last_name", "first_name", "patient_id")


def patients_by_name(clinic: Clinic) -> DataFrame:
    return clinic.clinic_patients.select("patient_id", "first_name", "last_name", "age", "sex", "contact").orderBy(*BY_NAME)


def patient_list(clinic: Clinic) -> DataFrame:
    """The register without contact data."""
    return clinic.clinic_patients.select(
        "patient_id", "first_name", "last_name", "age", "sex", "address", "registered_at"
    ).orderBy(*BY_NAME)


def patients_aged(clinic: Clinic, low: int = 20, high: int = 30) -> DataFrame:
    """Patients whose age lies in the closed range."""
    chosen = clinic.clinic_patients.filter(F.col("age").between(low, high)).orderBy("age", "last_name", "patient_id")
    return chosen.select("patient_id", full_name().alias("full_name"), "age", "address")


def patients_in_places(clinic: Clinic, places: Iterable[str], ci: bool = False) -> DataFrame:
    return clinic.clinic_patients.filter(contains_any("address", places, ci)).select(
        "patient_id", "first_name", "last_name", "address", "contact"
    )


def catalog_by_price(clinic: Clinic) -> DataFrame:
    return clinic.lab_test_catalog.select("test_id", "test_name", "price", "description").orderBy(F.desc("price"), "test_id")


def catalog_by_name(clinic: Clinic) -> DataFrame:
    return clinic.lab_test_catalog.select("test_id", "test_name", "price", "description").orderBy("test_name", "test_id")


def catalog_from_price(clinic: Clinic, least: Decimal | int | str = 250) -> DataFrame:
    priced = clinic.lab_test_catalog.filter(F.col("price") >= F.lit(Decimal(str(least))))
    return priced.select("test_id", "test_name", "price").orderBy(F.desc("price"), "test_id")


def order_statuses(clinic: Clinic) -> DataFrame:
    """The statuses in use, in declaration order."""
    return clinic.lab_test.select("status").distinct().orderBy(domain_rank("status", ORDER_STATUS))


def orders_of_year(clinic: Clinic, year: int) -> DataFrame:
    """Orders of one year, as a half-open date range so that the scan can skip row groups."""
    day = F.col("order_date")
    chosen = clinic.lab_test.filter((day >= F.lit(date(year, 1, 1))) & (day < F.lit(date(year + 1, 1, 1))))
    return chosen.select("order_id", "patient_id", "test_id", "order_date", "status").orderBy(F.desc("order_date"), "order_id")


def low_hemoglobin(clinic: Clinic, below: Decimal | str = "13.0") -> DataFrame:
    low = clinic.cbc.filter(F.col("hemoglobin") < F.lit(Decimal(str(below))))
    return low.select("cbc_id", "order_id", "hemoglobin", "hematocrit", "platelets").orderBy("hemoglobin", "cbc_id")


def abnormal_protein(clinic: Clinic) -> DataFrame:
    """Protein other than 'Negative'; an unrecorded protein does not count as abnormal."""
    found = clinic.urinalysis.filter(F.col("protein") != "Negative")
    return found.select("ua_id", "order_id", "ph", "protein", "other_findings").orderBy("protein", "ua_id")


def parasites_found(clinic: Clinic) -> DataFrame:
    """A parasite other than the text 'None'; an unrecorded parasite does not count as found."""
    found = clinic.fecalysis.filter(F.col("parasite_id") != "None")
    return found.select("fa_id", "order_id", "appearance", "parasite_id", "other_findings").orderBy("parasite_id", "fa_id")


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def lookup_many(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``; each row once, however often its key is listed."""
    return join_grouped(table, keys.select(key).distinct(), key, "left_semi").select(*table.columns)


def orderable_tests(clinic: Clinic) -> DataFrame:
    """The tests that have a result panel."""
    chosen = clinic.lab_test_catalog.filter(F.col("test_name").isin(*PANEL_OF_TEST))
    return chosen.select("test_id", "test_name").orderBy("test_name")


def patient_picker(clinic: Clinic) -> DataFrame:
    return clinic.clinic_patients.orderBy(*BY_NAME).select("patient_id", full_name().alias("full_name"))


def test_picker(clinic: Clinic) -> DataFrame:
    return clinic.lab_test_catalog.select("test_id", "test_name").orderBy("test_name", "test_id")


USER_COLUMNS: Sequence[str] = ("user_id", "username", "role_name", "patient_id", "mysql_username", "is_active")


def user_list(clinic: Clinic) -> DataFrame:
    """Accounts by name, never with the password hash."""
    return clinic.app_users.select(*USER_COLUMNS).orderBy("username", "user_id")


def active_users(clinic: Clinic) -> DataFrame:
    return user_list(clinic.with_tables(app_users=clinic.app_users.filter("is_active")))


def latest_orders(clinic: Clinic, k: int) -> DataFrame:
    """The ``k`` latest orders: a top-k report, planned without a full sort."""
    return clinic.lab_test.select("order_id", "patient_id", "order_date", "status").orderBy(F.desc("order_date"), "order_id").limit(k)
