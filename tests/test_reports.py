"""Listings, joins, aggregates and billing on the small hand-made clinic."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from clinic_cases import rows
from pyspark.sql import functions as F

from clinicframe.operators import aggregates, billing, joins, listings
from clinicframe.plans.explain import differences


def test_listings(clinic):
    assert [r[0] for r in rows(listings.patients_by_name(clinic))] == ["PAT-005", "PAT-006", "PAT-002", "PAT-003", "PAT-001"]
    assert rows(listings.patients_aged(clinic, 20, 30)) == [
        ("PAT-001", "Ada Zimmer", 20, "North Port, Oslo"), ("PAT-002", "Bo Young", 30, "South Port, Rome"),
    ]
    assert {r[0] for r in rows(listings.patients_in_places(clinic, ("Oslo", "Lima")))} == {"PAT-001", "PAT-006"}
    assert {r[0] for r in rows(listings.patients_in_places(clinic, ("ósLO",), ci=True))} == {"PAT-001", "PAT-005"}
    assert rows(listings.catalog_by_price(clinic), "test_id") == [(4,), (1,), (3,), (2,)]
    assert rows(listings.catalog_from_price(clinic, "120.50"), "test_id") == [(4,), (1,), (3,)]
    assert rows(listings.orderable_tests(clinic), "test_name") == [("CBC",), ("FECALYSIS",), ("URINALYSIS",)]
    assert "password_hash" not in listings.user_list(clinic).columns
    assert rows(listings.active_users(clinic), "username") == [("ada",), ("desk",), ("doc",), ("lab",), ("root",)]


def test_statuses_sort_by_declaration(clinic):
    assert rows(listings.order_statuses(clinic)) == [("PENDING",), ("COMPLETED",), ("CANCELLED",)]


def test_year_bounds_are_half_open(clinic):
    assert rows(listings.orders_of_year(clinic, 2024), "order_id") == [(4,), (8,), (7,), (6,), (3,), (2,)]


def test_null_readings_are_not_abnormal(clinic):
    assert rows(listings.low_hemoglobin(clinic), "order_id") == [(1,)]
    assert rows(listings.abnormal_protein(clinic), "order_id") == [(3,)]
    assert rows(listings.parasites_found(clinic), "order_id") == [(7,)]


def test_lookups(clinic, spark):
    assert rows(listings.lookup(clinic.lab_test, "order_id", 3), "patient_id") == [("PAT-002",)]
    keys = spark.createDataFrame([(3,), (3,), (99,)], "order_id long")
    assert rows(listings.lookup_many(clinic.lab_test, keys, "order_id"), "order_id") == [(3,)]
    assert rows(listings.latest_orders(clinic, 2), "order_id") == [(5,), (4,)]


def test_key_results(clinic):
    assert rows(joins.key_results(clinic), "patient_id", "test_name", "key_result") == [
        ("PAT-001", "CBC", "Hgb: 12.50 g/dL"), ("PAT-001", "URINALYSIS", None), ("PAT-002", "CBC", "Hgb: 13.00 g/dL"),
        ("PAT-002", "LIPIDS", "N/A"), ("PAT-003", "FECALYSIS", "Parasite: None"), ("PAT-003", "CBC", None),
        ("PAT-005", "FECALYSIS", "Parasite: Giardia spp."), ("PAT-005", "FECALYSIS", None),
    ]


def test_missing_name_part_gives_no_name(clinic):
    nameless = clinic.with_tables(clinic_patients=clinic.clinic_patients.withColumn("last_name", F.lit(None).cast("string")))
    assert set(rows(listings.patient_picker(nameless), "full_name")) == {(None,)}


def test_joined_reports(clinic, spark):
    assert rows(joins.patient_orders_by_date(clinic), "order_date", "test_name")[0] == (date(2025, 1, 1), "CBC")
    assert rows(joins.low_hemoglobin_orders(clinic), "order_id", "patient_name") == [(1, "Ada Zimmer")]
    assert rows(joins.panel_records(clinic, "fecalysis"), "name", "fa_id") == [("Cy Young", 1), ("Di Abel", 2), ("Di Abel", 3)]
    one = spark.createDataFrame([(7,)], "order_id long")
    assert rows(joins.panel_report(clinic, "cbc", one), "patient_id", "first_name", "age", "cbc_id") == [("PAT-005", "Di", 19, 3)]
    assert rows(joins.completed_by_age(clinic, 20, 31), "patient_id", "test_name") == [("PAT-003", "CBC"), ("PAT-001", "URINALYSIS"), ("PAT-001", "CBC")]
    assert rows(joins.payment_header(clinic, one), "test_name", "price") == [("FECALYSIS", D("120.50"))]


def test_views(clinic):
    assert {r[0] for r in rows(joins.patient_portal(clinic))} == {"PAT-001", "PAT-003", "PAT-005"}
    assert joins.frontdesk_dashboard(clinic).count() == 8
    assert set(rows(joins.labtech_workspace(clinic), "order_id")) == {(n,) for n in (1, 2, 3, 5, 6, 7, 8)}
    assert set(rows(joins.doctor_clinical_view(clinic).filter("patient_id = 'PAT-002'"), "test_name", "hemoglobin", "protein")) == {
        ("CBC", D("13.00"), "1+"), ("LIPIDS", None, None),
    }


def test_audit_log_has_a_row_per_payment_and_one_for_unpaid_orders(clinic):
    log = joins.admin_audit_log(clinic)
    assert sorted(rows(log, "order_id", "payment_id"), key=str) == sorted(
        [(1, 1), (1, 2), (1, 3), (2, 4), (3, 5), (4, None), (5, None), (6, 6), (7, None), (8, None)], key=str
    )
    outer = clinic.lab_test.join(clinic.payments.select("order_id", "payment_id"), "order_id", "left").select("order_id", "payment_id")
    assert differences(log.select("order_id", "payment_id"), outer).isEmpty()


def test_patient_review(clinic, spark):
    one = spark.createDataFrame([("PAT-001",)], "patient_id string")
    assert rows(joins.patient_review(clinic, one), "test_name", "amount_paid", "payment_status", "hemoglobin") == [
        ("CBC", D("150.00"), "PAID", D("12.50")), ("CBC", D("30.00"), "PARTIAL", D("12.50")), ("CBC", D("70.00"), "REFUNDED", D("12.50")),
        ("URINALYSIS", D("100.00"), "REFUNDED", None),
    ]


def test_revenue_counts_cancelled_orders_and_drops_unordered_tests(clinic):
    assert rows(aggregates.revenue_by_test(clinic)) == [
        ("CBC", 3, D("600.00")), ("FECALYSIS", 3, D("361.50")), ("LIPIDS", 1, D("300.00")), ("URINALYSIS", 1, D("100.00")),
    ]


def test_means_go_over_counts_not_patients(clinic):
    by_sex = {r.sex: r for r in aggregates.blood_count_by_sex(clinic).collect()}
    assert (by_sex["F"].patient_count, by_sex["F"].avg_hemoglobin, by_sex["F"].avg_platelets) == (2, D("12.500000"), D("252.5000"))
    assert (by_sex["M"].patient_count, by_sex["M"].avg_hemoglobin, by_sex["M"].avg_wbc) == (1, D("13.000000"), D("6.00"))


def test_took_one_never_other(clinic):
    assert rows(aggregates.took_one_test_never_other(clinic), "patient_id") == [("PAT-002",), ("PAT-003",)]
    assert rows(aggregates.took_one_test_never_other(clinic, "CBC", "X-RAY"), "patient_id") == [("PAT-001",), ("PAT-002",), ("PAT-003",)]
    assert rows(aggregates.took_one_test_never_other(clinic, "X-RAY", "CBC")) == []


def test_highest_price_and_its_rewrite_agree(clinic):
    best = aggregates.highest_price_of_ordering_patients(clinic)
    assert rows(best, "patient_id", "max_test_price") == [
        ("PAT-002", D("300.00")), ("PAT-001", D("200.00")), ("PAT-003", D("200.00")), ("PAT-005", D("120.50")),
    ]
    assert differences(best, aggregates.highest_price_by_patient(clinic)).isEmpty()
    lost = clinic.with_tables(lab_test_catalog=clinic.lab_test_catalog.filter("test_id <> 3"))
    assert ("PAT-005", None) in rows(aggregates.highest_price_of_ordering_patients(lost), "patient_id", "max_test_price")


def test_overview_keeps_patients_without_orders(clinic):
    seen = {r.patient_id: r for r in aggregates.patient_overview(clinic).collect()}
    assert (seen["PAT-001"].tests_taken, seen["PAT-001"].last_visit) == ("CBC,URINALYSIS", date(2024, 1, 1))
    assert seen["PAT-005"].tests_taken == "FECALYSIS"
    assert (seen["PAT-006"].tests_taken, seen["PAT-006"].tests_taken_text, seen["PAT-006"].last_visit_text) == (None, "No tests", "N/A")


def test_billing(clinic):
    bills = {r.order_id: (r.price, r.paid, r.balance) for r in billing.billing_by_order(clinic).collect()}
    assert bills[1] == (D("200.00"), D("180.00"), D("20.00"))
    assert bills[2] == (D("100.00"), D("0.00"), D("100.00"))
    assert bills[4] == (D("300.00"), D("0.00"), D("300.00"))
    totals = {r.patient_id: (r.total, r.paid, r.balance) for r in billing.billing_by_patient(clinic).collect()}
    assert totals["PAT-001"] == (D("300.00"), D("180.00"), D("120.00"))
    assert totals["PAT-006"] == (D("0.00"), D("0.00"), D("0.00"))
    assert rows(billing.overpaid_orders(clinic)) == [(6, D("120.50"), D("150.00"), D("29.50"))]
    others = dict(rows(billing.paid_by_others(clinic.payments), "payment_id", "paid_by_others"))
    assert (others[1], others[2], others[3], others[5]) == (D("30.00"), D("150.00"), D("180.00"), D("0.00"))
    first = billing.billing_statement(clinic).first()
    assert (first.date_text, first.price_text, first.paid_text, first.balance_text) == ("12/31/2023", "200.00", "180.00", "20.00")
