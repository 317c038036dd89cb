"""Joined reports over patients, orders, tests, panels and payments.

Skew: orders join patients and tests from their many side, which adaptive
execution can split when one patient or one test holds a large share. Where a
report keeps orders without payments, the paid and the unpaid orders are two
branches, because the optional side of an outer join cannot be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.crypto import decrypted
from clinicframe.functions.text import full_name
from clinicframe.model import Clinic
from clinicframe.operators.listings import lookup_many
from clinicframe.operators.skew import join_grouped
from clinicframe.schemas import ORDER_STATUS


def _patients(clinic: Clinic, *extra: str) -> DataFrame:
    return clinic.clinic_patients.select("patient_id", full_name().alias("patient_name"), *extra)


def _tests(clinic: Clinic, *extra: str) -> DataFrame:
    return clinic.lab_test_catalog.select("test_id", "test_name", *extra)


def order_lines(clinic: Clinic, patient: tuple[str, ...] = (), test: tuple[str, ...] = ()) -> DataFrame:
    """Orders with their patient's name and test name, plus the columns asked for."""
    orders = clinic.lab_test.withColumnsRenamed({"created_at": "order_created_at", "updated_at": "order_updated_at"})
    return join_grouped(orders, _patients(clinic, *patient), "patient_id").join(_tests(clinic, *test), "test_id")


def with_panels(orders: DataFrame, clinic: Clinic, cbc: tuple[str, ...]) -> DataFrame:
    """Left-join the key readings of the three panels; every join is on the unique order number."""
    return (
        orders.join(clinic.cbc.select("order_id", *cbc), "order_id", "left")
        .join(clinic.urinalysis.select("order_id", "protein"), "order_id", "left")
        .join(clinic.fecalysis.select("order_id", "parasite_id"), "order_id", "left")
    )


def patient_orders_by_date(clinic: Clinic) -> DataFrame:
    lines = order_lines(clinic, test=("price",)).orderBy(F.desc("order_date"), "order_id")
    return lines.select("patient_id", "patient_name", "test_name", "price", "order_date", "status")


def low_hemoglobin_orders(clinic: Clinic, below: str = "13.0") -> DataFrame:
    low = clinic.cbc.filter(F.col("hemoglobin") < F.lit(below).cast("decimal(5,2)"))
    joined = clinic.lab_test.select("order_id", "patient_id", "order_date").join(
        low.select("order_id", "wbc", "rbc", "hemoglobin", "platelets"), "order_id"
    )
    named = joined.join(_patients(clinic), "patient_id").orderBy("hemoglobin", "order_id")
    return named.select("order_id", "patient_name", "order_date", "wbc", "rbc", "hemoglobin", "platelets")


def key_result() -> Column:
    """The one reading a test is known by; NULL while its panel is missing, 'N/A' for other tests."""
    test = F.col("test_name")
    return (
        F.when(test == "CBC", F.concat(F.lit("Hgb: "), F.col("hemoglobin").cast("string"), F.lit(" g/dL")))
        .when(test == "URINALYSIS", F.concat(F.lit("Protein: "), "protein"))
        .when(test == "FECALYSIS", F.concat(F.lit("Parasite: "), "parasite_id"))
        .otherwise("N/A")
    )


def key_results(clinic: Clinic) -> DataFrame:
    # Panels first: three joins on the order number share one partitioning of the orders.
    orders = clinic.lab_test.select("order_id", "patient_id", "test_id", "order_date")
    read = with_panels(orders, clinic, ("hemoglobin",))
    named = read.join(_tests(clinic), "test_id").join(_patients(clinic), "patient_id")
    result = named.select("patient_id", "patient_name", "test_name", "order_date", key_result().alias("key_result"), "order_id")
    return result.orderBy("patient_id", "order_date", "order_id").drop("order_id")


def panel_records(clinic: Clinic, panel: str) -> DataFrame:
    """All rows of one panel with the patient and the order date."""
    rows = clinic.table(panel)
    who = clinic.lab_test.select("order_id", "patient_id", "order_date")
    joined = rows.join(who, "order_id").join(_patients(clinic), "patient_id").withColumnRenamed("patient_name", "name")
    return joined.orderBy("order_date", "order_id").select("patient_id", "name", "order_date", *rows.columns)


def panel_report(clinic: Clinic, panel: str, orders: DataFrame) -> DataFrame:
    """The printed report of each listed order: name parts, age and all readings."""
    rows = lookup_many(clinic.table(panel), orders, "order_id")
    who = clinic.lab_test.select("order_id", "patient_id", "order_date")
    people = clinic.clinic_patients.select("patient_id", "first_name", "last_name", "age")
    joined = rows.join(who, "order_id").join(people, "patient_id")
    return joined.select("patient_id", "first_name", "last_name", "age", "order_date", *rows.columns)


def payment_lines(clinic: Clinic, receipt: Column) -> DataFrame:
    paid = clinic.payments.select(
        "payment_id", "order_id", "amount_paid", "payment_method", "payment_date", "status", receipt.alias("receipt_number")
    )
    lines = order_lines(clinic).select("order_id", "patient_id", "patient_name", "test_name")
    return paid.join(lines, "order_id")


def payment_ledger(clinic: Clinic, key: str | bytes) -> DataFrame:
    """Payments with patient, test and decrypted receipt, latest first."""
    receipt = decrypted("receipt_number_encrypted", "encryption_iv", key)
    return payment_lines(clinic, receipt).orderBy(F.desc("payment_date"), F.desc("payment_id"))


def payment_detail(clinic: Clinic, key: str | bytes, payments: DataFrame) -> DataFrame:
    """The edit form's data for each listed payment."""
    chosen = clinic.with_tables(payments=lookup_many(clinic.payments, payments, "payment_id"))
    return payment_lines(chosen, decrypted("receipt_number_encrypted", "encryption_iv", key)).drop("payment_date")


def order_payments(clinic: Clinic, key: str | bytes, orders: DataFrame) -> DataFrame:
    """The payments of each listed order with decrypted receipts, latest first."""
    rows = lookup_many(clinic.payments, orders, "order_id").orderBy("order_id", F.desc("payment_date"), F.desc("payment_id"))
    receipt = decrypted("receipt_number_encrypted", "encryption_iv", key).alias("receipt_number")
    return rows.select("order_id", "payment_id", "amount_paid", "payment_method", "payment_date", "status", receipt)


def payment_header(clinic: Clinic, orders: DataFrame) -> DataFrame:
    """What is to be paid for each listed order."""
    wanted = lookup_many(clinic.lab_test.select("order_id", "patient_id", "test_id"), orders, "order_id")
    return wanted.join(_tests(clinic, "price"), "test_id").select("order_id", "patient_id", "test_name", "price")


def order_list(clinic: Clinic) -> DataFrame:
    lines = order_lines(clinic).orderBy(F.desc("order_date"), "order_id")
    return lines.select("order_id", "order_date", "status", "patient_id", "patient_name", "test_id", "test_name")


def patient_orders(clinic: Clinic, patients: DataFrame) -> DataFrame:
    """Orders with prices of each listed patient."""
    wanted = lookup_many(clinic.lab_test, patients, "patient_id")
    lines = wanted.join(_tests(clinic, "price"), "test_id").orderBy("patient_id", "order_id")
    return lines.select("patient_id", "order_id", "order_date", "test_name", "price", "status")


def _with_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per payment of an order, and one row with NULLs per unpaid order."""
    paid = payments.join(orders, "order_id")
    unpaid = orders.join(payments.select("order_id").distinct(), "order_id", "left_anti")
    return paid.unionByName(unpaid, allowMissingColumns=True)


def patient_review(clinic: Clinic, patients: DataFrame) -> DataFrame:
    """Orders of each listed patient with payments and blood count.

    The blood count joins before names and tests do, so that the order number is
    shuffled on anew for the payments and an order with very many can be split.
    """
    wanted = clinic.with_tables(
        clinic_patients=lookup_many(clinic.clinic_patients, patients, "patient_id"),
        lab_test=clinic.lab_test.join(clinic.cbc.select("order_id", "hemoglobin", "wbc"), "order_id", "left"),
    )
    orders = order_lines(wanted).withColumnRenamed("status", "order_status")
    paid = clinic.payments.select("order_id", "payment_id", "amount_paid", "payment_method", F.col("status").alias("payment_status"))
    rows = _with_payments(orders, paid).orderBy("patient_id", "order_id", "payment_id")
    return rows.select(
        "patient_id", "patient_name", "order_id", "test_name", "order_status", "amount_paid", "payment_method",
        "payment_status", "hemoglobin", "wbc",
    )


def completed_by_age(clinic: Clinic, low: int = 20, high: int = 30) -> DataFrame:
    chosen = clinic.with_tables(
        clinic_patients=clinic.clinic_patients.filter(F.col("age").between(low, high)),
        lab_test=clinic.lab_test.filter(F.col("status") == "COMPLETED"),
    )
    lines = order_lines(chosen).orderBy(F.desc("order_date"), "order_id")
    return lines.select("patient_id", "patient_name", "test_name", "order_date", "status")


# Role views: unsorted, one per audience.


def patient_portal(clinic: Clinic) -> DataFrame:
    """Completed orders, as released to patients."""
    done = clinic.with_tables(lab_test=clinic.lab_test.filter(F.col("status") == "COMPLETED"))
    lines = order_lines(done, patient=("first_name", "last_name"))
    return lines.select("patient_id", "first_name", "last_name", "order_date", "test_name", "status")


def frontdesk_dashboard(clinic: Clinic) -> DataFrame:
    """Orders with prices and without results."""
    return order_lines(clinic, test=("price",)).select(
        "patient_id", F.col("patient_name").alias("name"), "test_name", F.col("price").alias("total_amount"), "status", "order_date"
    )


def labtech_workspace(clinic: Clinic) -> DataFrame:
    """The work queue with key readings: everything not cancelled."""
    open_orders = clinic.lab_test.filter(F.col("status").isin(*[s for s in ORDER_STATUS if s != "CANCELLED"]))
    read = with_panels(open_orders.select("order_id", "patient_id", "test_id", "status"), clinic, ("hemoglobin", "wbc"))
    people = clinic.clinic_patients.select("patient_id", "first_name", "last_name")
    named = read.join(people, "patient_id").join(_tests(clinic), "test_id")
    return named.select("order_id", "first_name", "last_name", "test_name", "status", "hemoglobin", "wbc", "protein", "parasite_id")


def doctor_clinical_view(clinic: Clinic) -> DataFrame:
    """Clinical history without billing."""
    read = with_panels(clinic.lab_test.select("order_id", "patient_id", "test_id", "order_date"), clinic, ("hemoglobin",))
    named = read.join(_patients(clinic, "age", "sex"), "patient_id").join(_tests(clinic), "test_id")
    return named.select(
        "patient_id", F.col("patient_name").alias("name"), "age", "sex", "test_name", "order_date", "hemoglobin",
        "protein", "parasite_id",
    )


def admin_audit_log(clinic: Clinic) -> DataFrame:
    """Orders with their payments: one row per payment, one for an unpaid order."""
    orders = order_lines(clinic, test=("price",)).withColumnsRenamed({"price": "total_amount", "status": "order_status"})
    paid = clinic.payments.select(
        "payment_id", "order_id", "amount_paid", "payment_method", "payment_date", "receipt_number",
        F.col("status").alias("payment_status"),
    )
    return _with_payments(orders, paid).select(
        "order_id", "patient_id", "patient_name", "test_name", "total_amount", "order_status", "order_date", "payment_id",
        "amount_paid", "payment_method", "payment_date", "receipt_number", "payment_status", "order_created_at",
        "order_updated_at",
    )
