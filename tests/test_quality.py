"""Planted defects must be found, clean tables must pass."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from clinic_cases import rows
from pyspark.sql import functions as F

from clinicframe.operators import quality
from clinicframe.plans.explain import plan_text


@pytest.mark.parametrize("rule", ["not_null", "check", "enum", "length"])
def test_clean_tables_pass(clinic, rule):
    for name, df in clinic.tables().items():
        quality.enforce(quality.row_violations(name, df, rule))


def test_planted_row_defects(make):
    people = make(
        "clinic_patients",
        {"patient_id": "PAT-001", "first_name": None, "last_name": "L", "age": -1, "sex": "X"},
        {"patient_id": "PAT-00000002", "first_name": "F", "last_name": "L", "age": None, "sex": "MM"},
        {"patient_id": "PAT-003", "first_name": "F", "last_name": "L" * 51, "age": 0, "sex": None},
    )

    def found(rule):
        return sorted(rows(quality.row_violations("clinic_patients", people, rule), "row_key", "column_name"))

    assert found("not_null") == [("PAT-00000002", "age"), ("PAT-001", "first_name"), ("PAT-003", "sex")]
    assert found("check") == [("PAT-00000002", "sex"), ("PAT-001", "age"), ("PAT-001", "sex")]
    assert found("length") == [("PAT-00000002", "patient_id"), ("PAT-00000002", "sex"), ("PAT-003", "last_name")]
    with pytest.raises(ValueError, match="rule broken"):
        quality.enforce(quality.row_violations("clinic_patients", people, "check"))


def test_unknown_values(make):
    orders = make(
        "lab_test", {"order_id": 1, "patient_id": "P", "test_id": 1, "order_date": date(2024, 1, 1), "status": "DONE"},
        {"order_id": 2, "patient_id": "P", "test_id": 1, "order_date": date(2024, 1, 1), "status": None},
    )
    assert rows(quality.row_violations("lab_test", orders, "enum")) == [("enum", "lab_test", "1", "status")]


def test_duplicates_allow_repeated_nulls(clinic, make):
    twice = clinic.payments.unionByName(make(
        "payments", {"payment_id": 1, "order_id": 1, "amount_paid": D("1.00"), "payment_method": "CASH", "receipt_number": "R-5", "status": "PAID"},
        {"payment_id": 90, "order_id": 1, "amount_paid": D("1.00"), "payment_method": "CASH", "receipt_number": None, "status": "PAID"},
    ))
    assert sorted(rows(quality.duplicate_keys("payments", twice), "column_name", "value", "n_rows")) == [("payment_id", "1", 2), ("receipt_number", "R-5", 2)]


def test_orphans(clinic):
    assert quality.orphans(clinic).isEmpty()
    cut = clinic.with_tables(lab_test=clinic.lab_test.filter("order_id <> 3"), clinic_patients=clinic.clinic_patients.filter("patient_id <> 'PAT-001'"))
    assert sorted(rows(quality.orphans(cut), "table_name", "row_key", "value")) == [
        ("app_users", "5", "PAT-001"), ("cbc", "2", "3"), ("lab_test", "1", "PAT-001"), ("lab_test", "2", "PAT-001"),
        ("payments", "5", "3"), ("urinalysis", "2", "3"),
    ]


def test_panel_mismatches(clinic):
    assert sorted(rows(quality.panel_mismatches(clinic))) == [
        ("completed without panel", "cbc", 5, "CBC"), ("panel of another test", "cbc", 7, "FECALYSIS"),
        ("panel of another test", "urinalysis", 3, "CBC"),
    ]


@pytest.mark.parametrize("text, amount, reason", [
    ("12.345", "12.34", None), ("12.355", "12.36", None), (" 7\t", "7.00", None), ("1e3", "1000.00", None), ("1_000", "1000.00", None),
    ("abc", None, "not a number"), ("NaN", None, "not a number"), (None, None, "not a number"), ("", None, "not a number"),
    ("0.005", "0.00", "not positive"), ("-3", "-3.00", "not positive"), ("100000000", "100000000.00", "too large"),
])
def test_amounts_round_half_even(spark, text, amount, reason):
    entry = spark.createDataFrame([(text, "CASH", "PAID")], "amount_text string, payment_method string, status string")
    assert rows(quality.payment_input(entry), "amount", "reject_reason") == [(None if amount is None else D(amount), reason)]


def test_options(spark):
    entries = spark.createDataFrame([("1", "CHEQUE", "PAID"), ("1", "CARD", None)], "amount_text string, payment_method string, status string")
    assert rows(quality.payment_input(entries), "reject_reason") == [("unknown method",), ("unknown status",)]


def test_identifiers(spark):
    users = spark.createDataFrame(
        [(1, "a b", "ok", "role_admin", None), (2, "x" * 81, "ok", "role_guest", None), (3, "A-z_0.9", "", "role_patient", None),
         (4, "fine", "fine", "role_patient", "PAT-001")],
        "user_id long, username string, mysql_username string, role_name string, patient_id string",
    )
    assert sorted(rows(quality.identifier_errors(users), "user_id", "column_name")) == [
        (1, "username"), (2, "role_name"), (2, "username"), (3, "mysql_username"), (3, "patient_id"),
    ]


def test_orphans_read_each_parent_once(clinic):
    text = plan_text(quality.orphans(clinic), "simple")
    assert text.count("LeftOuter") == 3 and "LeftAnti" not in text


def test_large_keys_are_counted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(quality, "KEYS_PER_TASK", 100)
    # Key 5 is hot, 7 and 8 repeat, the rest occur once; receipts are missing but for two equal ones.
    key = F.when(F.col("id") < 400, 5).when(F.col("id") < 403, 7).when(F.col("id") < 405, 8).when(F.col("id") < 410, None).otherwise(F.col("id"))
    receipt = F.when(F.col("id").isin(3, 900), "R-1")
    payments = spark.range(0, 1000, 1, 4).select(key.alias("payment_id"), receipt.alias("receipt_number"))
    found = quality.duplicate_keys("payments", payments)
    assert sorted(rows(found, "column_name", "value", "n_rows")) == [
        ("payment_id", "5", 400), ("payment_id", "7", 3), ("payment_id", "8", 2), ("receipt_number", "R-1", 2),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count(", 10), REPARTITION_BY_NUM") == 4
