"""What orders cost, what was paid, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.amounts import CENT, counted_amount
from clinicframe.functions.text import day_text, money_text
from clinicframe.model import Clinic
from clinicframe.operators.skew import join_grouped


def paid_to_date(payments: DataFrame) -> DataFrame:
    """Sum of the payments of each order that has any, refunded ones counted as zero."""
    return payments.groupBy("order_id").agg(F.sum(counted_amount()).cast(CENT).alias("paid"))


def paid_by_others(payments: DataFrame) -> DataFrame:
    """For every payment, what the other payments of its order add up to."""
    own = payments.select("payment_id", "order_id", counted_amount().alias("own"))
    joined = join_grouped(own, paid_to_date(payments), "order_id")
    return joined.select("payment_id", "order_id", (F.col("paid") - F.col("own")).cast(CENT).alias("paid_by_others"))


def billing_by_order(clinic: Clinic, sums: DataFrame | None = None) -> DataFrame:
    """Price, paid and balance of every order, cancelled ones included.

    Payments are summed per order before the join, so prices are never repeated; stored
    sums (``clinicframe.sources.bills``) spare reading the payments.
    """
    priced = clinic.lab_test.select("order_id", "patient_id", "test_id", "order_date").join(
        clinic.lab_test_catalog.select("test_id", "test_name", "price"), "test_id"
    )
    paid = F.coalesce("paid", F.lit(0).cast(CENT))
    sums = paid_to_date(clinic.payments) if sums is None else sums.select("order_id", "paid")
    billed = priced.join(sums, "order_id", "left")
    return billed.select(
        "patient_id", "order_id", "order_date", "test_name", "price", paid.alias("paid"),
        (F.col("price") - paid).cast(CENT).alias("balance"),
    )


def billing_statement(clinic: Clinic) -> DataFrame:
    """The lines of the printed bills, amounts with two decimals."""
    lines = billing_by_order(clinic).orderBy("patient_id", "order_date", "order_id")
    texts = [money_text(c).alias(f"{c}_text") for c in ("price", "paid", "balance")]
    return lines.select("patient_id", "order_id", day_text("order_date").alias("date_text"), "test_name", *texts)


def billing_by_patient(clinic: Clinic, paid_sums: DataFrame | None = None) -> DataFrame:
    """Total, paid and balance of every patient; zero for patients without orders."""
    sums = [F.sum(c).cast(CENT).alias(n) for c, n in (("price", "total"), ("paid", "paid"))]
    totals = billing_by_order(clinic, paid_sums).groupBy("patient_id").agg(*sums)
    joined = clinic.clinic_patients.select("patient_id", "first_name", "last_name").join(totals, "patient_id", "left")
    total, paid = (F.coalesce(c, F.lit(0).cast(CENT)) for c in ("total", "paid"))
    return joined.select(
        "patient_id", "first_name", "last_name", total.alias("total"), paid.alias("paid"), (total - paid).cast(CENT).alias("balance")
    )


def overpaid_orders(clinic: Clinic) -> DataFrame:
    """Orders paid beyond their price."""
    over = billing_by_order(clinic).filter(F.col("paid") > F.col("price"))
    return over.select("order_id", "price", "paid", (F.col("paid") - F.col("price")).cast(CENT).alias("excess"))
