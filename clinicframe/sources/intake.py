"""Batches of incoming data derived from the star-schema Parquet files.

They play the part of forms and imports: unchecked rows with natural defects
(negative ages, repeated keys, unknown statuses, references to nowhere), and
requests, result sheets, payment entries and access logs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.functions.text import patient_code
from clinicframe.model import Clinic
from clinicframe.sources.testdata import star_reader


def _pick(column: Column, cases: dict, otherwise: Column | str | None = None) -> Column:
    picked = None
    for value, result in cases.items():
        test = column == value
        picked = F.when(test, result) if picked is None else picked.when(test, result)
    return picked.otherwise(otherwise)


class Intake:
    """Lazy batches over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = star_reader(spark, sf_dir)

    def patients(self) -> DataFrame:
        """An unchecked patient import."""
        sex = F.when(F.col("c_nationkey") < 10, "M").when(F.col("c_nationkey") < 20, "F").otherwise(F.col("c_mktsegment"))
        return self._read("customer").select(
            patient_code(F.col("c_custkey") + 1).alias("patient_id"),
            F.nullif("c_mktsegment", F.lit("BUILDING")).alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.floor(F.col("c_acctbal") / 100).cast("int").alias("age"),
            sex.alias("sex"),
            F.format_string("0917%07d", "c_nationkey").alias("contact"),
        )

    def orders(self) -> DataFrame:
        """An unchecked order import."""
        status = {"1-URGENT": "PENDING", "2-HIGH": "COMPLETED", "3-MEDIUM": "CANCELLED"}
        return self._read("orders").select(
            (F.col("o_orderkey") + 1).alias("order_id"),
            patient_code(F.floor(F.col("o_totalprice") / 300) + 1).alias("patient_id"),
            (F.col("o_custkey") + 601).alias("test_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            _pick(F.col("o_orderpriority"), status, F.col("o_orderpriority")).alias("status"),
        )

    def payments(self) -> DataFrame:
        """Unchecked payment entries with the amount as typed in."""
        line = F.col("l_linenumber")
        product = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
        text = product.cast("decimal(18,4)").cast("string")
        typed = _pick(F.col("l_tax"), {
            0.08: F.lit("n/a"), 0.07: F.concat(F.lit("  "), text, F.lit("\t")), 0.06: F.concat(text, F.lit("e1")),
            0.05: F.lit(None).cast("string"),
        }, text)
        return self._read("lineitem").select(
            (F.col("l_orderkey") * 8 + line).alias("payment_id"),
            (F.col("l_orderkey") + F.col("l_suppkey") * 10 + 1).alias("order_id"),
            F.col("l_discount").cast("decimal(10,2)").alias("amount_paid"),
            typed.alias("amount_text"),
            _pick(line, {1: "CASH", 2: "CARD", 3: "GCASH", 4: "INSURANCE", 5: "CHEQUE"}, "CASH").alias("payment_method"),
            _pick(F.col("l_returnflag"), {"A": "PAID", "N": "PARTIAL"}, F.col("l_returnflag")).alias("status"),
            F.col("l_shipdate").alias("payment_date"),
        )

    def users(self) -> DataFrame:
        """An unchecked account import."""
        key = F.col("s_suppkey").cast("string")
        roles = {0: "role_admin", 1: "role_front_desk", 2: "role_lab_tech", 3: "role_doctor", 4: "role_patient"}
        return self._read("supplier").select(
            (F.col("s_suppkey") + 1).alias("user_id"),
            F.when(F.col("s_nationkey") < 12, F.col("s_name")).otherwise(F.concat(F.lit("user"), key)).alias("username"),
            _pick(F.col("s_nationkey") % 6, roles, "role_guest").alias("role_name"),
            F.when(F.col("s_acctbal") > 5000, patient_code(F.col("s_suppkey") + 1)).alias("patient_id"),
            F.concat(F.lit("clinic_user"), key).alias("mysql_username"),
        )

    def walk_ins(self) -> DataFrame:
        """New patients at the front desk, in order of arrival."""
        key = F.col("s_suppkey")
        return self._read("supplier").select(
            key.alias("arrival"), F.lit("Walk-in").alias("first_name"), F.concat(F.lit(" "), "s_name").alias("last_name"),
            (20 + F.col("s_nationkey")).cast("int").alias("age"), F.lit("F").alias("sex"),
            F.lit(" ").alias("address"), F.format_string("0800%07d", key).alias("contact"),
        )

    def demo_patients(self) -> DataFrame:
        """Patients to insert unless their identifier is taken; some identifiers come twice."""
        key = F.col("s_suppkey")
        code = F.when(F.col("s_acctbal") < 5000, F.concat(F.lit("DEMO-"), F.floor(key / 2).cast("string"))).otherwise(patient_code(key + 1))
        return self._read("supplier").select(code.alias("patient_id"), F.col("s_name").alias("first_name"))

    def account_changes(self) -> DataFrame:
        """Accounts with their balance, from which status and role changes are drawn."""
        key = F.col("s_suppkey")
        return self._read("supplier").select(
            (key + 1).alias("user_id"), F.concat(F.lit("clinic_user"), key.cast("string")).alias("mysql_username"),
            (F.col("s_acctbal") > 0).alias("is_active"),
        )

    def order_requests(self) -> DataFrame:
        """Requested tests by name, one per event; some names are not in the catalog."""
        tests = {"view": "CBC", "click": "URINALYSIS", "purchase": "FECALYSIS", "error": "CBC"}
        return self._read("events").select(
            "event_id", "ts", patient_code(F.col("user_id") + 1).alias("patient_id"),
            _pick(F.col("event_type"), tests, "X-RAY").alias("test_name"), F.col("ts").cast("date").alias("order_date"),
        )

    def search_terms(self) -> DataFrame:
        """Contacts searched for, with many repeats."""
        return self._read("events").select(F.format_string("09%09d", "user_id").alias("term"))

    def access_requests(self) -> DataFrame:
        """A log of who asked for what."""
        objects = {"view": "v_frontdesk_dashboard", "signup": "clinic_patients", "click": "v_labtech_workspace", "error": "lab_test"}
        value = F.col("value")
        privilege = F.when(value < 5, "SELECT").when(value < 10, "INSERT").when(value < 15, "UPDATE").otherwise("DELETE")
        return self._read("events").select(
            "event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
            _pick(F.col("event_type"), objects, "payments").alias("object_name"), privilege.alias("privilege"),
        )


def result_sheets(clinic: Clinic) -> DataFrame:
    """Blood counts as text, several per order, some blank and some unreadable."""
    return clinic.payments.select(
        F.col("payment_id").alias("sheet"), "order_id", F.col("amount_paid").cast("string").alias("wbc"),
        F.lit(" 4.75 ").alias("rbc"),
        F.when(F.col("payment_method") == "CASH", "   ").otherwise("13.40").alias("hemoglobin"),
        F.when(F.col("status") == "REFUNDED", "n/a").otherwise("250").alias("platelets"),
        *[F.lit("").alias(c) for c in ("hematocrit", "mcv", "mch", "neutrophils", "lymphocytes", "monocytes", "eosinophils", "basophils")],
    )


def urinalysis_edits(clinic: Clinic) -> DataFrame:
    """Corrected urinalysis sheets of completed orders, blank where a reading is withdrawn."""
    done = clinic.lab_test.filter(F.col("status") == "COMPLETED").select("order_id")
    return clinic.urinalysis.join(done, "order_id", "left_semi").select(
        "order_id", F.lit("Turbid").alias("appearance"), F.lit(" ").alias("color"), F.col("ph").cast("string").alias("ph"),
        F.lit("1.020").alias("specific_gravity"), F.when(F.col("other_findings") == "None", "\t").otherwise("Trace").alias("glucose"),
        "protein", F.lit("").alias("ketones"), F.lit("Negative").alias("nitrites"), "other_findings",
    )


def payment_edits(clinic: Clinic) -> DataFrame:
    """One edit per payment: cash doubled, card halved, GCash refunded."""
    amount = F.col("amount_paid")
    new = F.when(F.col("payment_method") == "CASH", amount * 2).when(F.col("payment_method") == "CARD", amount / 2).otherwise(amount)
    return clinic.payments.select(
        "payment_id", new.cast("decimal(10,2)").alias("amount_paid"), "payment_method",
        F.when(F.col("payment_method") == "GCASH", "REFUNDED").otherwise("PAID").alias("status"),
    )


def payment_entries(clinic: Clinic) -> DataFrame:
    """Every payment entered again with a surcharge, some with receipts that exist, repeat or are blank."""
    receipts = {"CARD": F.lit(" "), "GCASH": F.col("receipt_number"), "INSURANCE": F.concat(F.lit("N-"), F.col("order_id").cast("string"))}
    return clinic.payments.select(
        F.col("payment_id").alias("entry"), "order_id", (F.col("amount_paid") * F.lit(1.125).cast("decimal(4,3)")).cast("string").alias("amount_text"),
        "payment_method", "status",
        _pick(F.col("payment_method"), receipts, F.concat(F.lit("E-"), F.col("payment_id").cast("string"))).alias("receipt_number"),
    )
