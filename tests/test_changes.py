"""Batch inserts, updates and deletes."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from clinic_cases import KEY, THEN, money, rows
from pyspark.sql import functions as F

from clinicframe.operators import changes, encryption, firstcome, keys, ledger, quality
from clinicframe.operators.firstcome import one_at_a_time
from clinicframe.operators.encryption import CONTACT, RECEIPT
from clinicframe.session import stored

NOW = datetime(2024, 7, 1, 12, 0, 0)


def codes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "patient_id string")


def test_gaps_are_filled_first_and_other_formats_ignored(spark):
    used = codes(spark, "PAT-001", "PAT-1", "PAT-003", "PAT-0005", "DEMO-002", "PAT-x", "XPAT-2", "PAT-000", "PAT-99999999999999")
    assert sorted(rows(keys.next_patient_ids(used, 4))) == [(1, "PAT-002"), (2, "PAT-004"), (3, "PAT-006"), (4, "PAT-007")]
    assert sorted(rows(keys.next_patient_ids(codes(spark).limit(0), 2))) == [(1, "PAT-001"), (2, "PAT-002")]


def test_gaps_across_buckets(spark):
    used = spark.range(1, 70_001).filter("id not in (5, 32768, 32769, 65536, 65537)").select(F.format_string("PAT-%03d", "id").alias("patient_id"))
    assert [r[1] for r in sorted(rows(keys.next_patient_ids(used, 7)))] == [
        "PAT-005", "PAT-32768", "PAT-32769", "PAT-65536", "PAT-65537", "PAT-70001", "PAT-70002",
    ]


def test_more_new_numbers_than_one_bucket_holds(spark):
    new = keys.free_patient_numbers(codes(spark, "PAT-002"), 70_000)
    found = new.agg(F.count("rank"), F.count_distinct("number"), F.min("number"), F.max("number"), F.sum("rank")).first()
    assert tuple(found) == (70_000, 70_000, 1, 70_001, 70_000 * 70_001 // 2)


def test_numbering_follows_the_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    numbered = keys.number_rows(df, ("x",), "n", 11)
    values = sorted(rows(numbered, "n", "x"))
    assert [n for n, _ in values] == list(range(11, 5011))
    assert [x for _, x in values] == sorted(x for _, x in values)


def test_ids_continue_above_the_mark(clinic, spark):
    assert keys.high_water_mark(clinic.lab_test, "order_id") == 8
    new = keys.assign_ids(spark.createDataFrame([("b",), ("a",)], "x string"), "order_id", ("x",), 20)
    assert sorted(rows(new, "order_id", "x")) == [(21, "a"), (22, "b")]


def test_register_patients(clinic, spark):
    arrivals = spark.createDataFrame(
        [(1, " Flo ", "Reed", 40, "F", "", "0907"), (2, "Gus", "Ray", 41, "M", "Pier", "")],
        "arrival int, first_name string, last_name string, age int, sex string, address string, contact string",
    )
    table = changes.register_patients(clinic, arrivals, ("arrival",), KEY, NOW).clinic_patients
    new = table.filter("patient_id in ('PAT-004', 'PAT-007')").withColumn("seen", encryption.visible(CONTACT, KEY))
    assert sorted(rows(new, "patient_id", "first_name", "address", "contact", "seen", "created_at")) == [
        ("PAT-004", "Flo", "", "0907", "0907", NOW), ("PAT-007", "Gus", "Pier", "", "", NOW),
    ]
    assert table.count() == 7


def test_register_patients_refuses_broken_rules(clinic, spark):
    arrivals = spark.createDataFrame(
        [(1, "Flo", "Reed", -5, "F", "", "0907"), (2, "Gus", "Ray", 41, "Q", "", "0908"), (3, "Una", "Fox", 41, " F ", "", "0907"),
         (4, "Una", "Fox", 41, "F", "", "0907 "), (5, "Una", "Fox", None, "F", "", "0909")],
        "arrival int, first_name string, last_name string, age int, sex string, address string, contact string",
    )
    done = changes.register_patients(clinic, arrivals, ("arrival",), KEY, NOW)
    assert sorted(rows(done.rejected)) == [(1, "bad age"), (2, "bad sex"), (4, "contact repeated in batch")]
    assert done.clinic_patients.count() == 7
    again = changes.register_patients(clinic.with_tables(clinic_patients=done.clinic_patients), arrivals.filter("arrival = 3"), ("arrival",), KEY, NOW)
    assert rows(again.rejected) == [(3, "contact exists")]


def test_refused_order_requests(clinic, spark):
    requests = spark.createDataFrame(
        [(1, "PAT-006", "CBC"), (2, "PAT-404", "CBC"), (3, "PAT-006", "X-RAY"), (4, None, None)], "n int, patient_id string, test_name string"
    )
    refused = changes.refused_order_requests(clinic, requests)
    assert sorted(rows(refused, "n", "reject_reason")) == [(2, "unknown patient"), (3, "unknown test"), (4, "unknown patient")]


def test_place_orders(clinic, spark):
    requests = spark.createDataFrame(
        [(1, "PAT-006", "CBC"), (2, "PAT-404", "CBC"), (3, "PAT-006", "X-RAY"), (4, "PAT-001", "LIPIDS")], "n int, patient_id string, test_name string"
    ).withColumn("order_date", F.lit(date(2024, 7, 1)))
    table = changes.place_orders(clinic, requests, ("n",), high_water=10, now=NOW)
    assert sorted(rows(table.filter("order_id > 8"), "order_id", "patient_id", "test_id", "status")) == [(11, "PAT-006", 1, "PENDING"), (12, "PAT-001", 4, "PENDING")]
    assert table.schema.names == clinic.lab_test.schema.names


def test_insert_if_absent(clinic, spark):
    new = spark.createDataFrame([("PAT-001", "Twin"), ("pat-001", "Lower")], "patient_id string, first_name string")
    table = changes.insert_if_absent(clinic.clinic_patients.select("patient_id", "first_name"), new, "patient_id")
    assert ("pat-001", "Lower") in rows(table) and ("PAT-001", "Twin") not in rows(table)


def test_post_results(clinic, spark):
    sheets = spark.createDataFrame(
        [(1, 6, "Brown", " "), (2, 6, "Green", "x"), (3, 5, "Brown", "None"), (4, 99, "Brown", "None"), (5, 7, "Brown", "None")],
        "n int, order_id long, appearance string, parasite_id string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("consistency", "occult_blood", "wbc", "rbc", "bacteria", "other_findings")})
    empty = clinic.with_tables(fecalysis=clinic.fecalysis.filter("order_id = 7"))
    posted = changes.post_results(empty, "Fecalysis", sheets, ("n",), NOW)
    assert sorted(rows(posted.panel, "fa_id", "order_id", "appearance", "parasite_id"), key=str) == [
        (2, 7, None, "Giardia spp."), (3, 6, "Brown", None), (4, 5, "Brown", "None"),
    ]
    assert sorted(rows(posted.rejected)) == [(6, "repeated in batch"), (7, "result exists"), (99, "unknown order")]
    status = {r.order_id: (r.status, r.updated_at) for r in posted.lab_test.collect()}
    assert status[6] == ("COMPLETED", NOW) and status[5] == ("COMPLETED", THEN) and status[8] == ("PENDING", THEN)
    with pytest.raises(ValueError, match="no result panel"):
        changes.post_results(clinic, "LIPIDS", sheets, ("n",))


def test_unreadable_numbers_are_refused(clinic, spark):
    names = [f for f in clinic.cbc.columns if f not in ("cbc_id", "order_id", "created_at", "updated_at")]
    sheet = spark.createDataFrame([(1, 8, "12..5"), (2, 2, " 12.5 ")], "n int, order_id long, hemoglobin string").withColumns(
        {c: F.lit("") for c in names if c != "hemoglobin"}
    )
    posted = changes.post_results(clinic, "CBC", sheet, ("n",), NOW)
    assert rows(posted.rejected) == [(8, "unreadable number")]
    assert rows(posted.panel.filter("order_id = 2"), "hemoglobin", "wbc") == [(D("12.50"), None)]


def test_patch_tells_null_from_no_change(clinic, spark):
    patch = spark.createDataFrame([("PAT-001", None), ("PAT-002", "South Port, Rome")], "patient_id string, address string")
    table = {r.patient_id: r for r in changes.patch_rows(clinic.clinic_patients, patch, "patient_id", ("address",), NOW).collect()}
    assert (table["PAT-001"].address, table["PAT-001"].updated_at) == (None, NOW)
    assert (table["PAT-002"].address, table["PAT-002"].updated_at) == ("South Port, Rome", THEN)
    assert table["PAT-005"].address == "Hill, OSLO"


def test_edit_results_clears_blank_readings(clinic, spark):
    edit = spark.createDataFrame([(3, " 2+ ", " ")], "order_id long, protein string, color string").withColumns(
        {c: F.lit("") for c in ("appearance", "ph", "specific_gravity", "glucose", "ketones", "nitrites", "other_findings")}
    )
    assert sorted(rows(changes.edit_results(clinic, "urinalysis", edit, NOW), "order_id", "protein", "color")) == [(2, None, None), (3, "2+", None)]


def test_change_contact_renews_the_cipher(clinic):
    sealed = clinic.with_tables(clinic_patients=encryption.encrypt_column(clinic.clinic_patients, CONTACT, KEY, "keep"))
    table = changes.change_contact(sealed, "PAT-001", "0999", "New", KEY, NOW)
    seen = {r[0]: r[1:] for r in rows(table.withColumn("seen", encryption.visible(CONTACT, KEY)), "patient_id", "contact", "address", "seen")}
    assert seen["PAT-001"] == ("0999", "New", "0999") and seen["PAT-002"] == ("0902", "South Port, Rome", "0902")
    assert encryption.find_by_token(table, CONTACT, "0901").isEmpty()


def test_complete_old_orders(clinic):
    done = changes.complete_old_orders(clinic, date(2024, 6, 9), 7, NOW)
    assert {r[0] for r in rows(done.filter(F.col("updated_at") == F.lit(str(NOW)).cast("timestamp_ntz")), "order_id")} == {3, 6}


def test_deletes_keep_rows_with_unknown_condition(clinic):
    unsure = clinic.lab_test.withColumn("status", F.when(F.col("order_id") != 1, F.col("status")))
    assert {r[0] for r in rows(changes.delete_cancelled(clinic.with_tables(lab_test=unsure)), "order_id")} == {1, 2, 3, 5, 6, 7, 8}
    assert {r[0] for r in rows(changes.delete_patient_test(clinic, "PAT-005", "FECALYSIS"), "order_id")} == {1, 2, 3, 4, 5, 6}
    assert changes.delete_patient_test(clinic, "PAT-005", "X-RAY").count() == 8


def test_cascades_leave_no_orphans(clinic, spark):
    after = changes.cascade_delete_patients(clinic, codes(spark, "PAT-001", "PAT-404"))
    assert {n: df.count() for n, df in after.tables().items()} == {
        "clinic_patients": 4, "lab_test_catalog": 4, "lab_test": 6, "cbc": 2, "urinalysis": 1, "fecalysis": 3, "payments": 2, "app_users": 6,
    }
    assert rows(after.app_users.filter("username = 'ada'"), "patient_id") == [(None,)]
    assert quality.orphans(after).isEmpty()
    tests = spark.createDataFrame([(3,)], "test_id long")
    after = changes.cascade_delete_tests(clinic, tests)
    assert (after.lab_test.count(), after.cbc.count(), after.fecalysis.count(), after.payments.count()) == (5, 2, 0, 5)
    assert quality.orphans(after).isEmpty()


def test_accounts(clinic, spark):
    flags = spark.createDataFrame([(6, True), (2, False)], "user_id long, is_active boolean")
    assert dict(rows(changes.set_user_status(clinic, flags, NOW), "user_id", "is_active")) == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    grants = spark.createDataFrame([("db_lab", "role_doctor")], "mysql_username string, role_name string")
    assert dict(rows(changes.grant_roles(clinic, grants, NOW), "username", "role_name"))["lab"] == "role_doctor"
    revokes = spark.createDataFrame([("db_lab", "role_lab_tech"), ("db_doc", "role_admin")], "mysql_username string, role_name string")
    assert dict(rows(changes.revoke_roles(clinic, revokes, NOW), "username", "is_active")) == {
        "root": True, "desk": True, "lab": False, "doc": True, "ada": True, "old": False,
    }


def test_rename_patients_only_without_orders(clinic, spark):
    names = spark.createDataFrame([("PAT-006", "PAT-060"), ("PAT-001", "PAT-010")], "patient_id string, new_patient_id string")
    after = changes.rename_patients(clinic, names)
    assert {r[0] for r in rows(after.clinic_patients, "patient_id")} == {"PAT-001", "PAT-002", "PAT-003", "PAT-005", "PAT-060"}


def test_record_payments(clinic, spark):
    entries = spark.createDataFrame(
        [(1, 5, "150.005", None, None, "N-1"), (2, 5, "60", "CARD", "PAID", "N-2"), (3, 5, "5e1", "CARD", "PARTIAL", " "),
         (4, 5, "abc", "CASH", "PAID", None), (5, 7, "1", "CASH", "PAID", "R-1"), (6, 7, "2", "CASH", "PAID", "N-1"),
         (7, 7, "3", "CHEQUE", "PAID", None), (8, 99, "3", "CASH", "PAID", None), (9, 7, "0.004", "CASH", "PAID", None)],
        "n int, order_id long, amount_text string, payment_method string, status string, receipt_number string",
    )
    recorded = ledger.record_payments(clinic, entries, ("n",), KEY, now=NOW)
    new = recorded.payments.filter("payment_id > 6").withColumn("seen", encryption.visible(RECEIPT, KEY))
    assert sorted(rows(new, "payment_id", "order_id", "amount_paid", "payment_method", "status", "receipt_number", "seen")) == [
        (7, 5, D("150.00"), "CASH", "PAID", "N-1", "N-1"), (8, 5, D("50.00"), "CARD", "PARTIAL", None, ""),
    ]
    assert sorted(rows(recorded.rejected, "n", "reject_reason")) == [
        (2, "exceeds balance"), (4, "not a number"), (5, "receipt exists"), (6, "receipt repeated"), (7, "unknown method"),
        (8, "unknown order"), (9, "not positive"),
    ]


def test_deciding_payments_writes_narrow_parquet_only(clinic, spark, monkeypatch):
    kept = []

    def watched(df):
        kept.append(stored(df))
        return kept[-1]

    monkeypatch.setattr(firstcome, "stored", watched)
    monkeypatch.setattr(keys, "stored", watched)
    entries = spark.createDataFrame(
        [(1, 5, "150", "CASH", "PAID", "N-1", "x"), (2, 7, "2", "CASH", "PAID", "N-1", "y")],
        "n int, order_id long, amount_text string, payment_method string, status string, receipt_number string, note string",
    )
    recorded = ledger.record_payments(clinic, entries, ("n",), KEY, now=NOW)
    assert rows(recorded.rejected, "n", "reject_reason") == [(2, "receipt repeated")]
    assert len(kept) == 4 and not any({"amount_text", "amount", "note"} & set(df.columns) for df in kept)
    assert "reject_reason" not in kept[-1].columns


def test_receipts_are_looked_up_once(clinic, spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ledger, "stored", lambda df: kept.append(stored(df)) or kept[-1], raising=False)
    entries = spark.createDataFrame(
        [(1, 5, "150", "CASH", "PAID", "N-1", "x"), (2, 5, "x", "CASH", "PAID", "N-2", "y")],
        "n int, order_id long, amount_text string, payment_method string, status string, receipt_number string, note string",
    )
    rejected = ledger.record_payments(clinic, entries, ("n",), KEY, now=NOW).rejected
    # Refused entries are read from what was stored: no second join with the ledger.
    assert "Join" not in rejected._jdf.queryExecution().optimizedPlan().toString()
    assert [set(df.columns) for df in kept] == [{"n", "order_id", "amount_paid", "payment_method", "status", "receipt_number", "reject_reason"}]
    assert [r.n for r in rejected.collect()] == [2]


def test_refused_entries_leave_their_receipt_free(clinic, spark):
    # Entry 1 does not fit order 5, so 2 takes its receipt; 2 then uses up the room that 3 wanted, so 4 takes that one's.
    entries = spark.createDataFrame(
        [(1, 5, "9999", "X-1"), (2, 5, "150", "X-1"), (3, 5, "100", "X-2"), (4, 5, "50", "X-2"), (5, 5, "1", "X-1")],
        "n int, order_id long, amount_text string, receipt_number string",
    ).withColumns({"payment_method": F.lit("CASH"), "status": F.lit("PAID")})
    recorded = ledger.record_payments(clinic, entries, ("n",), KEY, now=NOW)
    assert sorted(rows(recorded.payments.filter("payment_id > 6"), "amount_paid", "receipt_number")) == [(D("50.00"), "X-2"), (D("150.00"), "X-1")]
    assert sorted(rows(recorded.rejected, "n", "reject_reason")) == [(1, "exceeds balance"), (3, "exceeds balance"), (5, "receipt repeated")]


def test_first_come_against_one_after_another(spark):
    rng = random.Random(8)
    data = [(n, rng.choice([None, *range(25)]), rng.choice([None, *range(25)])) for n in range(120)]
    taken, expected = (set(), set()), {}
    for n, a, b in data:
        expected[n] = a not in taken[0] and b not in taken[1]
        if expected[n]:
            for keys_taken, value in zip(taken, (a, b)):
                if value is not None:
                    keys_taken.add(value)
    decided = one_at_a_time(spark.createDataFrame(data, "n int, a int, b int"), {"a": "a taken", "b": "b taken"}, ("n",))
    assert dict(rows(decided, "n", "accepted")) == expected


def test_apply_payment_edits(clinic, spark):
    sealed = clinic.with_tables(payments=encryption.encrypt_column(clinic.payments, RECEIPT, KEY, "empty"))
    edits = spark.createDataFrame(
        [(1, "170.00", "CARD", "PAID", "R-9"), (5, "500.00", "CASH", "PAID", "R-8"), (6, "10.00", "CASH", "PAID", "")],
        "payment_id long, amount string, payment_method string, status string, receipt_number string",
    ).withColumn("amount_paid", F.col("amount").cast("decimal(10,2)")).drop("amount")
    table = ledger.apply_payment_edits(sealed, edits, ("payment_id",), KEY, NOW).withColumn("seen", encryption.visible(RECEIPT, KEY))
    seen = {r[0]: r[1:] for r in rows(table, "payment_id", "amount_paid", "payment_method", "receipt_number", "seen")}
    assert seen[1] == (D("170.00"), "CARD", "R-9", "R-9")
    assert seen[5] == (D("200.00"), "CASH", "R-5", "R-5")
    assert seen[6] == (D("10.00"), "CASH", None, None)
    assert seen[3] == (D("70.00"), "CASH", None, "")


def test_add_users(clinic, spark):
    requests = spark.createDataFrame(
        [(1, "new.one", "h", "role_doctor", None, " "), (2, "new.one", "h", "role_doctor", None, "x"), (3, "desk", "h", "role_doctor", None, ""),
         (4, "a b", "h", "role_doctor", None, "x"), (5, "pat", "h", "role_patient", " ", "x"), (6, "pat", "h", "role_patient", "PAT-002", "db_pat"),
         (7, "pat2", "h", "role_patient", "PAT-001", ""), (8, "pat3", "h", "role_patient", "PAT-404", ""), (9, "g", "h", "role_guest", None, "")],
        "n int, username string, password_hash string, role_name string, patient_id string, mysql_username string",
    )
    added = changes.add_users(clinic, requests, ("n",), now=NOW)
    assert sorted(rows(added.app_users.filter("user_id > 6"), "user_id", "username", "patient_id", "mysql_username", "is_active")) == [
        (7, "new.one", None, "new.one", True), (8, "pat", "PAT-002", "db_pat", True),
    ]
    assert sorted(rows(added.rejected, "n", "reject_reason")) == [
        (2, "name repeated in batch"), (3, "name has an account"), (4, "bad username"), (5, "bad patient_id"),
        (7, "patient has an account"), (8, "unknown patient"), (9, "bad role_name"),
    ]


def test_edit_patients_and_tests(clinic, spark):
    edit = spark.createDataFrame([("PAT-003", 32, " Cyd ", "Young", "M", "", " 0903 ")], "patient_id string, age int, first_name string, last_name string, sex string, address string, contact string")
    table = changes.edit_patients(clinic, edit, KEY, NOW).withColumn("seen", encryption.visible(CONTACT, KEY))
    assert rows(table.filter("patient_id = 'PAT-003'"), "first_name", "age", "address", "contact", "seen") == [("Cyd", 32, "", "0903", "0903")]
    assert rows(table.filter("patient_id = 'PAT-001'"), "contact", "contact_encrypted", "updated_at") == [("0901", None, THEN)]
    price = spark.createDataFrame([(4, "LIPIDS", D("310.00"), None)], "test_id long, test_name string, price decimal(10,2), description string")
    assert dict(rows(changes.edit_tests(clinic, price, NOW), "test_id", "price"))[4] == D("310.00")


def test_renumber_orders_only_without_panels(clinic, spark):
    numbers = spark.createDataFrame([(4, 40), (1, 10)], "order_id long, new_order_id long")
    after = changes.renumber_orders(clinic, numbers)
    assert {r[0] for r in rows(after.lab_test, "order_id")} == {1, 2, 3, 40, 5, 6, 7, 8}
    assert quality.orphans(after).isEmpty()


def test_repeats_in_a_batch_change_each_row_once(clinic, spark):
    table = clinic.clinic_patients.select("patient_id", "first_name")
    new = spark.createDataFrame([("PAT-900", "Zed", 2), ("PAT-900", "Amy", 1), (None, "No", 3), (None, "Id", 4), ("PAT-001", "Old", 5)], "patient_id string, first_name string, at int")
    added = changes.insert_if_absent(table, new.drop("at"), "patient_id", ("first_name",))
    assert added.count() == table.count() + 3 and added.filter("patient_id = 'PAT-900' and first_name = 'Amy'").count() == 1
    patch = spark.createDataFrame([(1, "PENDING", 1), (1, "CANCELLED", 2)], "order_id long, status string, at int")
    patched = changes.patch_rows(clinic.lab_test, patch, "order_id", ("status",), order_by=("at",))
    assert patched.count() == clinic.lab_test.count() and patched.filter("order_id = 1").first()["status"] == "CANCELLED"
    numbers = spark.createDataFrame([(4, 40), (4, 41)], "order_id long, new_order_id long")
    moved = changes.renumber_orders(clinic, numbers)
    assert moved.lab_test.count() == clinic.lab_test.count() and moved.lab_test.filter("order_id = 41").count() == 1


def test_a_good_sheet_after_an_unreadable_one_is_posted(clinic, spark):
    blank = {c: "" for c in ("wbc", "rbc", "hematocrit", "platelets", "mcv", "mch", "neutrophils", "lymphocytes", "monocytes", "eosinophils", "basophils")}
    sheets = spark.createDataFrame([{"sheet": n, "order_id": 5, "hemoglobin": h, **blank} for n, h in ((1, "n/a"), (2, "12.5"), (3, "13"))])
    posted = changes.post_results(clinic, "cbc", sheets, ("sheet",))
    assert posted.panel.filter("order_id = 5").first()["hemoglobin"] == money("12.50")
    assert sorted(r["reject_reason"] for r in posted.rejected.collect()) == ["repeated in batch", "unreadable number"]
