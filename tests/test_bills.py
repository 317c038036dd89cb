"""Stored sums of payments against the sums of all payments."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from clinic_cases import KEY, rows
from pyspark.sql import functions as F

from clinicframe.operators import billing, changes, edits
from clinicframe.sources import bills, snapshots


def entries(spark, *payments):
    table = spark.createDataFrame(list(payments), "order_id long, amount_text string, at int")
    return table.withColumns({c: F.lit(None).cast("string") for c in ("payment_method", "status", "receipt_number")})


def test_sums_follow_the_versions(spark, clinic, tmp_path):
    root = str(tmp_path / "clinic")
    with pytest.raises(ValueError, match="no snapshot"):
        bills.refresh(spark, root)
    snapshots.commit_snapshot(clinic, root, check=False, parts=4)
    with pytest.raises(ValueError, match="no sums"):
        bills.paid_per_order(spark, root)
    assert bills.refresh(spark, root, parts=4) == 4 and bills.refresh(spark, root) == 0

    def check():
        now = snapshots.read_snapshot(spark, root)
        stored = bills.paid_per_order(spark, root)
        assert sorted(rows(stored, "order_id", "paid")) == sorted(rows(billing.paid_to_date(now.payments), "order_id", "paid"))
        assert sorted(rows(billing.billing_by_order(now, stored))) == sorted(rows(billing.billing_by_order(now)))

    check()
    # New payments on an order that has some and on one that has none.
    new = entries(spark, (1, "5.00", 1), (5, "12.50", 2))
    snapshots.commit_changes(spark, root, lambda c: edits.recorded_payments(c, new, ["at"], KEY))
    before = {r[0] for r in rows(bills.paid_per_order(spark, root).select("_metadata.file_path"))}
    assert bills.refresh(spark, root) == 1
    after = {r[0] for r in rows(bills.paid_per_order(spark, root).select("_metadata.file_path"))}
    assert len(before & after) == 3
    check()
    # Two versions at once: payments go, one amount changes, an order goes.
    gone = spark.createDataFrame([(4,)], "payment_id long")
    less = spark.createDataFrame([(1, D("1.25"))], "payment_id long, amount_paid decimal(10,2)")
    snapshots.commit_changes(spark, root, lambda c: edits.deleted_payments(c, gone))
    snapshots.commit_changes(spark, root, lambda c: edits.patched(c, "payments", less, ("amount_paid",)))
    snapshots.commit_changes(spark, root, lambda c: edits.deleted_orders(c, spark.createDataFrame([(6,)], "order_id long")))
    bills.refresh(spark, root)
    check()
    # A version without payments among its changes moves nothing.
    snapshots.commit_changes(spark, root, lambda c: edits.contact(c, "PAT-001", "1", "x", KEY))
    assert bills.refresh(spark, root) == 0
    # Loads of whole tables.
    now = snapshots.read_snapshot(spark, root)
    snapshots.commit_snapshot(now.with_tables(payments=changes.delete_where(now.payments, F.col("order_id") == 3)), root, changed=("payments",), check=False)
    bills.refresh(spark, root)
    check()
