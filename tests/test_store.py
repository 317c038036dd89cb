"""Stored clinics: changes that rewrite only touched files, checks at commit, writers that meet."""

from __future__ import annotations

import re
import shutil
import threading
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from clinic_cases import KEY, THEN, rows
from pyspark.sql import functions as F

from clinicframe.operators import changes, edits, guards
from clinicframe.plans.explain import plan_text
from clinicframe.sources import snapshots, versions

NOW = datetime(2025, 5, 5)


MADE = []


@pytest.fixture
def root(clinic, tmp_path, tmp_path_factory):
    """A stored clinic of its own for each test: the log is copied, files are never changed."""
    if not MADE:
        MADE.append(str(tmp_path_factory.mktemp("stored")))
        assert snapshots.commit_snapshot(clinic, MADE[0], check=False, parts=4) == 1
    shutil.copytree(f"{MADE[0]}/_versions", tmp_path / "clinic" / "_versions")
    return str(tmp_path / "clinic")


def files(spark, root, version=None):
    found = versions.state(spark, root, version)
    return {t: set(found.files(t)) for t in found.entry.schemas}


def same(left, right, *names):
    for name in names:
        a, b = (sorted(map(repr, rows(c.table(name).select(*sorted(c.table(name).columns))))) for c in (left, right))
        assert a == b, name


def commit(spark, root, change):
    """Commit; returns per table how many files the new version adds and drops, where any."""
    before = files(spark, root)
    number = snapshots.commit_changes(spark, root, change)
    after = files(spark, root)
    assert number == snapshots.current_version(spark, root)
    return {t: (len(after[t] - before[t]), len(before[t] - after[t])) for t in after if after[t] != before[t]}


def test_tables_are_cut_by_key(spark, root, clinic):
    kept = files(spark, root)
    assert len(kept["lab_test"]) == 4 and len(kept["payments"]) > 1
    bounds = rows(versions.state(spark, root).lines.filter("table_name = 'lab_test'").selectExpr("int(low)", "int(high)").orderBy(F.expr("CAST(low AS INT)")))
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    same(snapshots.read_snapshot(spark, root), clinic, *kept)


def test_one_contact_rewrites_one_file(spark, root, clinic):
    touched = commit(spark, root, lambda c: edits.contact(c, "PAT-002", "0999", "East", KEY, NOW))
    assert touched == {"clinic_patients": (1, 1)}
    expected = clinic.with_tables(clinic_patients=changes.change_contact(clinic, "PAT-002", "0999", "East", KEY, NOW))
    same(snapshots.read_snapshot(spark, root), expected, "clinic_patients", "lab_test")
    same(snapshots.read_snapshot(spark, root, 1), clinic, "clinic_patients")


def test_deletes_rewrite_the_files_of_deleted_rows(spark, root, clinic):
    touched = commit(spark, root, edits.cancelled_orders)
    assert touched == {"lab_test": (1, 1)}
    gone = clinic.lab_test.filter("status = 'CANCELLED'")
    expected = changes.cascade_delete_orders(clinic, gone)
    same(snapshots.read_snapshot(spark, root), expected, "lab_test", "payments")
    touched = commit(spark, root, lambda c: edits.patient_test(c, "PAT-001", "CBC"))
    assert set(touched) == {"lab_test", "cbc", "payments"} and all(1 <= dropped <= 2 for _, dropped in touched.values())
    expected = changes.cascade_delete_orders(expected, expected.lab_test.filter("order_id = 1"))
    same(snapshots.read_snapshot(spark, root), expected, *snapshots.TABLES)
    same(snapshots.read_snapshot(spark, root, 1), clinic, "lab_test", "cbc")


def test_deleted_payments(spark, root, clinic):
    two = spark.createDataFrame([(4,), (99,)], "payment_id long")
    assert commit(spark, root, lambda c: edits.deleted_payments(c, two)) in ({"payments": (1, 1)}, {"payments": (0, 1)})
    same(snapshots.read_snapshot(spark, root), clinic.with_tables(payments=changes.delete_payments(clinic, two)), "payments")
    assert commit(spark, root, lambda c: edits.deleted_payments(c, spark.createDataFrame([(99,)], "payment_id long"))) == {}


def test_posted_results_touch_their_orders_only(spark, root, clinic):
    sheets = spark.createDataFrame(
        [(5, "12.5", 1), (5, "1", 2), (77, "1", 3), (4, "odd", 4)], "order_id long, hemoglobin string, at int"
    ).withColumns({f.name: F.lit(None).cast("string") for f in changes.panel_fields("cbc") if f.name != "hemoglobin"})
    touched = commit(spark, root, lambda c: edits.posted_results(c, "CBC", sheets, ["at"], NOW))
    assert touched == {"cbc": (1, 0), "lab_test": (1, 1)}
    whole = changes.post_results(clinic, "CBC", sheets, ["at"], NOW)
    same(snapshots.read_snapshot(spark, root), clinic.with_tables(cbc=whole.panel, lab_test=whole.lab_test), "cbc", "lab_test")
    assert snapshots.high_water_marks(spark, root)["cbc"] == 4


def test_old_orders_by_condition(spark, root, clinic):
    touched = commit(spark, root, lambda c: edits.completed_old_orders(c, date(2024, 4, 1), now=NOW))
    assert touched == {"lab_test": (1, 1)}
    same(snapshots.read_snapshot(spark, root), clinic.with_tables(lab_test=changes.complete_old_orders(clinic, date(2024, 4, 1), now=NOW)), "lab_test")


# Rules at commit


def payment(spark, n, order_id, amount="1.00", receipt=None):
    row = (n, order_id, D(amount), "CASH", THEN, receipt, "PAID", THEN, THEN)
    names = "payment_id long, order_id long, amount_paid decimal(10,2), payment_method string, payment_date timestamp_ntz, receipt_number string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"
    return spark.createDataFrame([row], names)


@pytest.mark.parametrize("name, change", [
    ("reference", lambda c: [edits.Edit("payments", added=payment(c.spark, 50, 999))]),
    ("unique", lambda c: [edits.Edit("payments", added=payment(c.spark, 50, 7, receipt="R-5"))]),
    ("unique", lambda c: [edits.Edit("payments", added=payment(c.spark, 1, 7))]),
    ("check", lambda c: edits.patched(c, "clinic_patients", c.spark.createDataFrame([("PAT-002", -1)], "patient_id string, age int"), ("age",))),
    ("enum", lambda c: edits.patched(c, "lab_test", c.spark.createDataFrame([(3, "LOST")], "order_id long, status string"), ("status",))),
    ("not_null", lambda c: edits.patched(c, "lab_test", c.spark.createDataFrame([(3, None)], "order_id long, status string"), ("status",))),
    ("length", lambda c: edits.patched(c, "clinic_patients", c.spark.createDataFrame([("PAT-002", "x" * 99)], "patient_id string, last_name string"), ("last_name",))),
    ("reference", lambda c: edits.deleted(c, "lab_test", c.spark.createDataFrame([(1,)], "order_id long"))),
    ("reference", lambda c: edits.deleted(c, "lab_test_catalog", c.spark.createDataFrame([(4,)], "test_id long"))),
])
def test_a_broken_rule_publishes_nothing(spark, root, clinic, name, change):
    with pytest.raises(ValueError, match=f"'rule': '{name}'"):
        snapshots.commit_changes(spark, root, change)
    assert snapshots.current_version(spark, root) == 1


def test_rules_broken_elsewhere_do_not_matter(spark, root):
    """Only changed rows are checked: what was wrong before stays a matter of the full checks."""
    bad = payment(spark, 50, 999)
    one = snapshots.read_snapshot(spark, root)
    snapshots.commit_snapshot(one.with_tables(payments=one.payments.unionByName(bad)), root, changed=("payments",), check=False, parts=4)
    assert commit(spark, root, lambda c: [edits.Edit("payments", added=payment(spark, 51, 7))]) == {"payments": (1, 0)}
    with pytest.raises(ValueError, match="'rule': 'reference'"):
        snapshots.commit_snapshot(snapshots.read_snapshot(spark, root), root)


def test_checks_read_single_columns_of_other_tables(spark, root):
    after = snapshots.read_snapshot(spark, root)
    new = payment(spark, 50, 7, receipt="R-9").checkpoint()
    text = plan_text(guards.of_changes(after, {"payments": (new, new.limit(0))}))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert schemas and all(s.count(":") <= 1 for s in schemas)
    assert "GreaterThanOrEqual(order_id,7)" in text and "LessThanOrEqual(order_id,7)" in text


# Writers that meet


def meeting(spark, root, mine, other):
    """A change during whose preparation another writer commits; returns how often it was prepared."""
    calls = []

    def change(c):
        calls.append(1)
        prepared = mine(c)
        if len(calls) == 1:
            snapshots.commit_changes(spark, root, other)
        return prepared

    return change, calls


def add(spark, n, order_id, **more):
    return lambda c: [edits.Edit("payments", added=payment(spark, n, order_id, **more))]


def test_writers_of_different_keys_are_both_applied(spark, root, clinic):
    change, calls = meeting(spark, root, add(spark, 50, 7), add(spark, 51, 5))
    assert snapshots.commit_changes(spark, root, change) == 3 and len(calls) == 1
    assert {50, 51} <= {r[0] for r in rows(snapshots.read_snapshot(spark, root).payments, "payment_id")}


def test_a_writer_of_the_same_order_starts_over(spark, root):
    def pay(amount, at):
        entries = spark.createDataFrame([(2, amount, at)], "order_id long, amount_text string, at int").withColumns(
            {c: F.lit(None).cast("string") for c in ("payment_method", "status", "receipt_number")}
        )
        return lambda c: edits.recorded_payments(c, entries, ["at"], KEY, now=NOW)

    # Order 2 costs 100 and its only payment is refunded: of 70 and 60 only one fits.
    change, calls = meeting(spark, root, pay("60.00", 1), pay("70.00", 2))
    snapshots.commit_changes(spark, root, change)
    assert len(calls) == 2
    paid = rows(snapshots.read_snapshot(spark, root).payments.filter("order_id = 2 AND status = 'PAID'"), "amount_paid")
    assert paid == [(D("70.00"),)]


def test_the_same_new_key_is_not_published_twice(spark, root):
    change, calls = meeting(spark, root, add(spark, 50, 7), add(spark, 50, 5))
    with pytest.raises(ValueError, match="'rule': 'unique'"):
        snapshots.commit_changes(spark, root, change)
    assert len(calls) == 2 and snapshots.current_version(spark, root) == 2


def test_the_other_may_delete_what_a_row_needs(spark, root):
    gone = lambda c: edits.deleted_orders(c, spark.createDataFrame([(8,)], "order_id long"))
    change, calls = meeting(spark, root, add(spark, 50, 8), gone)
    with pytest.raises(ValueError, match="'rule': 'reference'"):
        snapshots.commit_changes(spark, root, change)
    assert snapshots.read_snapshot(spark, root).payments.filter("order_id = 8").isEmpty()


def test_rewriting_one_file_for_different_rows_starts_over(spark, root):
    status = lambda n, s: lambda c: edits.patched(c, "app_users", spark.createDataFrame([(n, s)], "user_id long, is_active boolean"), ("is_active",), NOW)
    one = snapshots.read_snapshot(spark, root)
    snapshots.commit_snapshot(one, root, changed=("app_users",), check=False, parts=1)
    change, calls = meeting(spark, root, status(1, False), status(2, False))
    snapshots.commit_changes(spark, root, change)
    assert len(calls) == 2
    assert {r[0] for r in rows(snapshots.read_snapshot(spark, root).app_users.filter("NOT is_active"), "user_id")} == {1, 2, 6}


def test_a_load_of_whole_tables_does_not_overwrite_unseen_rows(spark, root, clinic, monkeypatch):
    plain = snapshots._write
    once = []

    def slow(*arguments, **more):
        if not once:
            once.append(1)
            snapshots.commit_changes(spark, root, add(spark, 50, 7))
        return plain(*arguments, **more)

    monkeypatch.setattr(snapshots, "_write", slow)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit_snapshot(clinic, root, check=False)
    assert snapshots.current_version(spark, root) == 2


def test_threads(spark, root):
    start, failed = threading.Barrier(3), []

    def writer(n):
        start.wait()
        try:
            snapshots.commit_changes(spark, root, add(spark, 50 + n, (5, 6, 7)[n]))
        except Exception as error:  # noqa: BLE001 - shown below
            failed.append(error)

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and snapshots.current_version(spark, root) == 4
    assert {50, 51, 52} <= {r[0] for r in rows(snapshots.read_snapshot(spark, root).payments, "payment_id")}


def test_versions_list_all_files_now_and_then(spark, root, clinic, monkeypatch):
    monkeypatch.setattr(snapshots, "FULL_EVERY", 2)
    for n in range(3):
        snapshots.commit_changes(spark, root, add(spark, 50 + n, 7))
    assert [v.full for v in versions.history(spark, root)] == [True, True, False, True]
    for version, n in ((1, 6), (2, 7), (3, 8), (4, 9)):
        assert snapshots.read_snapshot(spark, root, version).payments.count() == n


def test_a_version_number_goes_to_one_writer(spark, tmp_path):
    path, won = f"{tmp_path}/log/1.json", []
    race = [threading.Thread(target=lambda n=n: won.append((versions.create_once(spark, path, f"writer {n}"), n))) for n in range(8)]
    for t in race:
        t.start()
    for t in race:
        t.join()
    winner, = [n for ok, n in won if ok]
    assert open(path).read() == f"writer {winner}"


def test_files_of_old_versions_are_reclaimed(spark, clinic, tmp_path):
    root = str(tmp_path / "old")
    snapshots.commit_snapshot(clinic, root, check=False, parts=4)
    snapshots.commit_changes(spark, root, lambda c: edits.contact(c, "PAT-002", "0999", "East", KEY, NOW))
    snapshots.commit_changes(spark, root, add(spark, 50, 7))
    with pytest.raises(ValueError, match="'rule'"):
        snapshots.commit_changes(spark, root, add(spark, 51, 999))
    before = snapshots.read_snapshot(spark, root, 2).clinic_patients
    assert snapshots.reclaim(spark, root, keep=2) == 0
    # The replaced file of version 1 and what the refused commit wrote, with their checksums.
    assert snapshots.reclaim(spark, root, keep=2, hours=0) > 0
    assert before.count() == 5 and snapshots.read_snapshot(spark, root, 2).payments.count() == 6
    assert snapshots.read_snapshot(spark, root).payments.count() == 7
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        snapshots.read_snapshot(spark, root, 1).clinic_patients.collect()
    assert snapshots.reclaim(spark, root, keep=2, hours=0) == 0
    snapshots.commit_changes(spark, root, add(spark, 52, 7))
    assert snapshots.read_snapshot(spark, root).payments.count() == 8
