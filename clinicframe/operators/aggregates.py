"""Grouped reports and subquery reports.

Rows are reduced before they are joined: a test or patient that owns a large
share of the orders is one pre-aggregated row by the time it meets a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.text import full_name
from clinicframe.model import Clinic
from clinicframe.operators.listings import BY_NAME


def revenue_by_test(clinic: Clinic) -> DataFrame:
    """How often each test was ordered, in any status, and the revenue at catalog price."""
    counted = clinic.lab_test.groupBy("test_id").agg(F.count("order_id").alias("times_ordered"))
    priced = counted.join(clinic.lab_test_catalog.select("test_id", "test_name", "price"), "test_id")
    revenue = (F.col("price") * F.col("times_ordered")).cast("decimal(20,2)")
    total = priced.withColumn("total_revenue", revenue).orderBy(F.desc("total_revenue"), "test_id")
    return total.select("test_name", "times_ordered", "total_revenue")


def blood_count_by_sex(clinic: Clinic) -> DataFrame:
    """Patients with a blood count and mean readings over all counts, by sex.

    Readings are summed per patient first, so each patient joins once and needs no
    distinct count afterwards.
    """
    readings = ("hemoglobin", "platelets", "wbc")
    own = clinic.lab_test.select("order_id", "patient_id").join(clinic.cbc.select("order_id", *readings), "order_id")
    sums = [F.sum(F.col(r).cast("decimal(18,2)")).alias(f"sum_{r}") for r in readings]
    counts = [F.count(r).alias(f"n_{r}") for r in readings]
    per_patient = own.groupBy("patient_id").agg(*sums, *counts)
    by_sex = clinic.clinic_patients.select("patient_id", "sex").join(per_patient, "patient_id").groupBy("sex")

    def mean(reading: str, kind: str):
        total, n = F.sum(f"sum_{reading}"), F.sum(f"n_{reading}")
        return F.try_divide(total.cast("decimal(26,6)"), n.cast("decimal(12,0)")).cast(kind)

    return by_sex.agg(
        F.count("patient_id").alias("patient_count"),
        mean("hemoglobin", "decimal(9,6)").alias("avg_hemoglobin"),
        mean("platelets", "decimal(14,4)").alias("avg_platelets"),
        F.round(mean("wbc", "decimal(9,6)"), 2).cast("decimal(9,2)").alias("avg_wbc"),
    )


def highest_price_by_patient(clinic: Clinic) -> DataFrame:
    """The dearest test each patient ordered, joined and grouped in one pass."""
    prices = clinic.lab_test_catalog.select("test_id", "price")
    best = clinic.lab_test.select("patient_id", "test_id").join(prices, "test_id").groupBy("patient_id")
    return _name_and_sort(clinic, best.agg(F.max("price").alias("max_test_price")))


def highest_price_of_ordering_patients(clinic: Clinic) -> DataFrame:
    """Patients that ordered anything, with the dearest test, NULL if no test of theirs is in the catalog."""
    prices = clinic.lab_test_catalog.select("test_id", "price")
    best = clinic.lab_test.select("patient_id", "test_id").join(prices, "test_id", "left").groupBy("patient_id")
    return _name_and_sort(clinic, best.agg(F.max("price").alias("max_test_price")))


def _name_and_sort(clinic: Clinic, best: DataFrame) -> DataFrame:
    named = clinic.clinic_patients.select("patient_id", full_name().alias("patient_name")).join(best, "patient_id")
    return named.orderBy(F.desc("max_test_price"), "patient_id")


def patient_overview(clinic: Clinic, as_array: bool = False) -> DataFrame:
    """Each patient with the distinct tests taken and the last visit; patients without orders stay.

    ``as_array`` adds the names as an array too, which stays right for names with commas.

    Orders shrink to one row per patient and test before any name is collected, so
    a list never holds more entries than the catalog has tests.
    """
    visits = clinic.lab_test.groupBy("patient_id", "test_id").agg(F.max("order_date").alias("last_visit"))
    named = visits.join(clinic.lab_test_catalog.select("test_id", "test_name"), "test_id", "left")
    per_patient = named.groupBy("patient_id").agg(
        F.array_sort(F.collect_set("test_name")).alias("tests"), F.max("last_visit").alias("last_visit")
    )
    taken = F.when(F.size("tests") > 0, F.array_join("tests", ","))
    overview = clinic.clinic_patients.join(per_patient, "patient_id", "left").select(
        "patient_id", "first_name", "last_name", "age", "sex", "address", "registered_at", taken.alias("tests_taken"), "last_visit",
        F.coalesce(taken, F.lit("No tests")).alias("tests_taken_text"),
        F.coalesce(F.date_format("last_visit", "yyyy-MM-dd"), F.lit("N/A")).alias("last_visit_text"),
        *([F.coalesce("tests", F.array().cast("array<string>")).alias("tests_taken_array")] if as_array else []),
    )
    return overview.orderBy(*BY_NAME)


def first_order(clinic: Clinic) -> DataFrame:
    return clinic.lab_test.agg(F.min("order_id").alias("first_order_id"))


def took_one_test_never_other(clinic: Clinic, taken: str = "CBC", never: str = "URINALYSIS") -> DataFrame:
    """Patients that ordered one test and never another; unknown names match no order.

    Both conditions come from one grouping of the orders of the two tests.
    """
    catalog = clinic.lab_test_catalog
    ids = {name: catalog.filter(F.col("test_name") == name).select("test_id").scalar() for name in (taken, never)}
    flagged = (
        clinic.lab_test.filter((F.col("test_id") == ids[taken]) | (F.col("test_id") == ids[never]))
        .groupBy("patient_id")
        .agg(F.bool_or(F.col("test_id") == ids[taken]).alias("has"), F.bool_or(F.col("test_id") == ids[never]).alias("other"))
        .filter(F.coalesce("has", F.lit(False)) & ~F.coalesce("other", F.lit(False)))
    )
    people = clinic.clinic_patients.join(flagged, "patient_id", "left_semi")
    return people.select("patient_id", full_name().alias("patient_name")).orderBy("patient_id")
