"""The cap on payments against a step-by-step reckoning."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from clinic_cases import rows
from pyspark.sql import functions as F

from clinicframe.operators import caps
from clinicframe.operators.caps import accept_payments, accept_steps, edit_payments


def reckon(entries, rooms):
    """Accept one after another: (group, seq, cents or None, free) with cents left per group."""
    accepted = {}
    kind = lambda cents, free: 0 if free else 1 if cents <= 0 else 2
    known = [e for e in entries if e[2] is not None]
    left = dict(rooms)
    for group, seq, cents, free in sorted(known, key=lambda e: (e[0], kind(e[2], e[3]), e[1])):
        fits = group in left and (free or cents <= left[group])
        if fits:
            left[group] -= cents
        accepted[group, seq] = fits
    return {(e[0], e[1]): accepted.get((e[0], e[1]), False) for e in entries}


def judge(spark, entries, rooms, **limits):
    schema = "grp long, seq long, step decimal(12,2), free boolean"
    data = [(g, s, None if c is None else Decimal(c) / 100, f) for g, s, c, f in entries]
    df = spark.createDataFrame(data, schema).repartition(3)
    room = spark.createDataFrame([(g, Decimal(r) / 100) for g, r in rooms.items()], "grp long, room decimal(20,2)")
    out = accept_steps(df, room, "grp", ("seq",), F.col("step"), F.col("free"), **limits)
    return {(r.grp, r.seq): r.accepted for r in out.collect()}


def random_case(seed, groups, size, top):
    rng = random.Random(seed)
    entries, rooms = [], {}
    for g in range(groups):
        if rng.random() < 0.9:
            rooms[g] = rng.choice([rng.randint(-50, 50), rng.randint(0, top), rng.randint(top, 8 * top), 0])
        for s in range(rng.randint(1, size)):
            cents = rng.choice([rng.randint(1, 5), rng.randint(1, top), rng.randint(1, 4 * top), -rng.randint(0, top // 4 + 1), None])
            free = rng.random() < 0.1
            entries.append((g, s, -abs(cents) if free and cents is not None else cents, free))
    return entries, rooms


@pytest.mark.parametrize("limits", [{}, {"fold_rows": 0, "chunk_rows": 7}, {"fold_rows": 10, "chunk_rows": 20}])
def test_random_steps(spark, limits):
    entries, rooms = random_case(11, 25, 40, 1000)
    assert judge(spark, entries, rooms, **limits) == reckon(entries, rooms)


@pytest.mark.parametrize("block_rows", [1, 4, 16])
def test_blocks_of_sums_decide_as_single_rows_do(spark, block_rows):
    entries, rooms = random_case(21 + block_rows, 8, 60, 3000)
    limits = {"fold_rows": 3, "chunk_rows": 120, "block_rows": block_rows}
    assert judge(spark, entries, rooms, **limits) == reckon(entries, rooms)


def test_rounds_sort_only_blocks_that_may_decide(spark, monkeypatch):
    kept, store = [], caps.stored

    def watched(df):
        kept.append(store(df))
        return kept[-1]

    monkeypatch.setattr(caps, "stored", watched)
    entries = [(1, s, 1 + s % 3, False) for s in range(3000)]
    assert judge(spark, entries, {1: 2500}, fold_rows=10, block_rows=50) == reckon(entries, {1: 2500})
    looked = [df.count() for df in kept if {"__at", "__before"} <= set(df.columns)]
    assert len(looked) > 5 and max(looked) <= 100


def test_one_group_holding_nearly_everything(spark):
    rng = random.Random(5)
    entries = [(1, s, rng.choice([1, 2, 3, 50, 700, 4000]), False) for s in range(1500)] + [(2, 0, 10, False)]
    rooms = {1: 9_000, 2: 9}
    expected = reckon(entries, rooms)
    assert judge(spark, entries, rooms, fold_rows=100, chunk_rows=100) == expected
    assert judge(spark, entries, rooms) == expected


def test_many_large_groups_are_not_broadcast(spark, monkeypatch):
    entries, rooms = random_case(3, 6, 40, 300)
    assert judge(spark, entries, rooms, fold_rows=5, chunk_rows=20) == reckon(entries, rooms)


def test_halving_ends_on_slowly_shrinking_room(spark):
    # A cent, then an amount just above what is left, over and over.
    entries = [(1, s, 1 if s % 2 == 0 else 512 - s // 2, False) for s in range(600)]
    assert judge(spark, entries, {1: 512}, fold_rows=0, chunk_rows=50) == reckon(entries, {1: 512})


def test_rejected_payments_leave_room_for_later_ones(clinic, make, spark):
    day = "2024-05-01 00:00:00"
    data = [(1, 4, "250.00", "PAID"), (2, 4, "100.00", "PAID"), (3, 4, "50.00", "PARTIAL"), (4, 4, "999.00", "REFUNDED"),
            (5, 4, "0.01", "PAID"), (6, 99, "1.00", "PAID"), (7, 99, "1.00", "REFUNDED"), (8, 4, "0.00", "PAID"), (9, None, "1.00", "PAID")]
    incoming = spark.createDataFrame(data, "payment_id long, order_id long, amount string, status string").select(
        "payment_id", "order_id", F.col("amount").cast("decimal(10,2)").alias("amount_paid"), "status", F.lit(day).cast("timestamp_ntz").alias("payment_date")
    )
    for limits in ({}, {"fold_rows": 0, "chunk_rows": 2}):
        judged = accept_payments(clinic, incoming, **limits)
        assert sorted(rows(judged, "payment_id", "accepted", "reject_reason")) == [
            (1, True, None), (2, False, "exceeds balance"), (3, True, None), (4, True, None), (5, False, "exceeds balance"),
            (6, False, "unknown order"), (7, False, "unknown order"), (8, False, "amount not positive"), (9, False, "unknown order"),
        ]


def test_payment_up_to_the_exact_price_is_accepted(clinic, spark):
    incoming = spark.createDataFrame([(1, 1, "20.00", "PAID"), (2, 1, "0.01", "PAID")], "payment_id long, order_id long, amount string, status string")
    typed = incoming.select("payment_id", "order_id", F.col("amount").cast("decimal(10,2)").alias("amount_paid"), "status")
    judged = accept_payments(clinic, typed, ("payment_id",))
    assert sorted(rows(judged, "payment_id", "accepted")) == [(1, True), (2, False)]


def test_edit_leaves_out_the_payment_itself(clinic, spark):
    # Order 1 costs 200.00 and has 150 + 30 counted, 70 refunded.
    edits = spark.createDataFrame(
        [(1, "170.00", "PAID"), (5, "200.01", "PAID"), (6, "120.50", "PAID"), (77, "1.00", "PAID")], "payment_id long, amount string, status string"
    ).select("payment_id", F.col("amount").cast("decimal(10,2)").alias("amount_paid"), "status")
    judged = edit_payments(clinic, edits)
    assert sorted(rows(judged, "payment_id", "accepted", "reject_reason")) == [
        (1, True, None), (5, False, "exceeds balance"), (6, True, None), (77, False, "unknown payment"),
    ]


def test_edits_that_free_room_come_before_those_that_take_it(clinic, spark):
    edits = spark.createDataFrame(
        [(1, "180.00", "PAID"), (2, "20.00", "PARTIAL"), (3, "5.00", "PAID")], "payment_id long, amount string, status string"
    ).select("payment_id", F.col("amount").cast("decimal(10,2)").alias("amount_paid"), "status")
    for limits in ({}, {"fold_rows": 0, "chunk_rows": 1}):
        assert sorted(rows(edit_payments(clinic, edits, **limits), "payment_id", "accepted")) == [(1, True), (2, True), (3, False)]
