"""Payments accepted in order under a price cap.

Whether a payment fits depends on which earlier ones were accepted, so a running
sum over all earlier payments is wrong: it would count rejected ones. Two exact
methods share the work:

* An order with few payments folds its sorted list inside the group.
* An order with many payments is never gathered. While the room left lies in
  [b, 2b) for a power of two b, amounts below b always fit, and at most one amount
  of b or more can be accepted before the room drops below b. So the first point
  where the room drops below b is found by distributed running sums over blocks of
  the order, all orders at once, and each such round at least halves b: about
  log2(price in cents) rounds, however many payments there are. A block is summed
  up once, by powers of two; a round sorts only the rows of blocks that may hold
  the point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinicframe.functions.amounts import CENT, NOT_COUNTED, counted_amount
from clinicframe.functions.text import in_order
from clinicframe.model import Clinic
from clinicframe.operators.billing import paid_to_date
from clinicframe.operators.firstcome import Cap
from clinicframe.operators.skew import join_grouped
from clinicframe.schemas import DOMAINS
from clinicframe.session import stored

FOLD_ROWS = 1_000
CHUNK_ROWS = 200_000
#: Consecutive rows of an order that a round of halving judges by their sums alone, if it can.
BLOCK_ROWS = 4_096
# Kinds of steps, in the order they apply within a group.
FREE, LOWER, RAISE = 0, 1, 2


def accept_steps(
    rows: DataFrame, room: DataFrame, group: str, arrival: Sequence[str], step: Column, free: Column,
    fold_rows: int = FOLD_ROWS, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Append ``room`` and ``accepted``: a greedy choice of steps within each group.

    A step takes its amount out of the group's room and is accepted if that much is
    left. Free steps always are, and apply first; then come steps that take nothing
    or give back, then those that take, each kind in ``arrival`` order, which must be
    unique within a group. A NULL step, or a group without ``room``, is never
    accepted. ``room`` has one row per group.
    """
    kind = F.when(free, FREE).when(step <= 0, LOWER).otherwise(RAISE)
    marked = rows.withColumns({"__cents": (step * 100).cast("bigint"), "__kind": F.when(step.isNotNull(), kind)})
    limits = room.select(group, F.col("room").cast(CENT).alias("room"))
    columns = rows.columns
    sizes = stored(marked.groupBy(group).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > fold_rows))
    total, groups = sizes.agg(F.sum("__rows"), F.count(F.lit(1))).first()
    if not groups:
        return _fold(marked, limits, group, arrival, columns)
    large = sizes.select(group)
    small = _fold(join_grouped(marked, large, group, "left_anti").select(*marked.columns), limits, group, arrival, columns)
    chunks = -(-total // chunk_rows)
    hot = join_grouped(marked, large, group, "left_semi").select(*marked.columns)
    return small.unionByName(_by_halving(hot, limits, group, arrival, columns, chunks, block_rows))


def _fold(marked: DataFrame, room: DataFrame, group: str, arrival: Sequence[str], columns: Sequence[str]) -> DataFrame:
    entry = F.struct("__kind", *arrival, "__cents", F.struct(*columns).alias("row"))
    lists = marked.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    state_type = "struct<left:bigint,fits:array<boolean>>"

    def apply(state: Column, item: Column) -> Column:
        cents = item["__cents"]
        fits = F.coalesce((item["__kind"] == FREE) | (cents <= state["left"]), F.lit(False))
        left = state["left"] - F.when(fits, cents).otherwise(0)
        return F.struct(left.alias("left"), F.array_append(state["fits"], fits).alias("fits")).cast(state_type)

    start = F.struct((F.col("room") * 100).cast("bigint").alias("left"), F.array().cast("array<boolean>").alias("fits"))
    judged = lists.join(room, group, "left").withColumn("fits", F.aggregate("entries", start.cast(state_type), apply, lambda s: s["fits"]))
    each = judged.select("room", F.explode(F.arrays_zip(F.col("entries.row").alias("row"), "fits")).alias("one"))
    known = F.col("room").isNotNull()
    return each.select("one.row.*", "room", (known & F.col("one.fits")).alias("accepted"))


def _by_halving(
    marked: DataFrame, room: DataFrame, group: str, arrival: Sequence[str], columns: Sequence[str], chunks: int, block_rows: int
) -> DataFrame:
    cents, kind, at = F.col("__cents"), F.col("__kind"), F.col("__at")
    placed = stored(
        marked.repartitionByRange(chunks, group, *arrival).sortWithinPartitions(group, *arrival)
        .withColumns({"__block": F.expr(f"monotonically_increasing_id() div {block_rows}"), "__at": in_order(arrival)})
    )
    at_type = placed.schema["__at"].dataType.simpleString()
    span = f"struct<after:{at_type},until:{at_type},base:bigint>"
    freed = placed.groupBy(group).agg(F.sum(F.when(kind == FREE, cents).otherwise(0)).alias("__freed"))
    start = freed.join(room, group, "left").withColumn("left", (F.col("room") * 100).cast("bigint") - F.col("__freed"))
    start = stored(start)
    lowering = join_grouped(placed.filter(kind == LOWER).select(group, "__at", "__cents"), start.select(group, "left"), group)
    # Until one step brings the room to zero or above none is accepted, and from there on all are.
    first = lowering.filter(cents <= F.col("left")).groupBy(group).agg(F.min("__at").alias("__first"))
    given = join_grouped(lowering, first, group).filter(at >= F.col("__first")).groupBy(group).agg(F.sum("__cents").alias("__given"))
    state = stored(start.join(first, group, "left").join(given, group, "left").select(
        group, "room", "__first", (F.col("left") - F.coalesce("__given", F.lit(0))).alias("left"),
        F.lit(None).cast(at_type).alias("after"), F.lit(None).cast("bigint").alias("__last"), F.array().cast(f"array<{span}>").alias("spans"),
    ).withColumn("active", F.coalesce(F.col("left") > 0, F.lit(False))))
    taking = placed.filter(kind == RAISE).select(group, *arrival, "__block", "__at", "__cents")
    blocks = stored(_by_size(taking, group))
    rest = blocks.limit(0)
    while not state.filter("active").isEmpty():
        state, rest = _halve(taking, blocks, rest, state, group, arrival, span)

    def in_span(s: Column) -> Column:
        inside = (s["after"].isNull() | (at > s["after"])) & (s["until"].isNull() | (at <= s["until"]))
        return F.coalesce(inside & ((cents < s["base"]) | (at == s["until"])), F.lit(False))

    judged = join_grouped(placed, state.select(group, "room", "__first", "spans"), group)
    fits = F.when(kind == FREE, True).when(kind == LOWER, F.coalesce(at >= F.col("__first"), F.lit(False))).when(
        kind == RAISE, F.exists("spans", in_span)
    ).otherwise(False)
    return judged.select(*columns, "room", (F.col("room").isNotNull() & fits).alias("accepted"))


def _by_size(taking: DataFrame, group: str) -> DataFrame:
    """Per group, block and power of two that the amounts reach: their sum and the least of them."""
    power = F.length(F.bin("__cents"))
    return taking.filter(F.col("__cents") > 0).groupBy(group, "__block", power.alias("__power")).agg(
        F.sum("__cents").alias("__sum"), F.min("__cents").alias("__least")
    )


def _halve(
    taking: DataFrame, blocks: DataFrame, rest: DataFrame, state: DataFrame, group: str, arrival: Sequence[str], span: str
) -> tuple[DataFrame, DataFrame]:
    """Advance every active group past the point where its room drops below its power of two.

    Sums of blocks tell in which blocks that point can lie; only the rows of these are looked
    at. ``rest`` sums up what follows ``after`` in the block that holds it. Returns the new
    state and its ``rest``.
    """
    cents, base, left = F.col("__cents"), F.col("base"), F.col("left")
    current = state.withColumn("base", F.expr("shiftleft(1L, length(bin(`left`)) - 1)"))
    live = current.filter("active").select(group, "left", "after", "__last", "base")
    whole = join_grouped(blocks, live, group).filter(F.col("__last").isNull() | (F.col("__block") > F.col("__last")))
    ahead_of = whole.unionByName(join_grouped(rest, live, group))
    is_small = F.col("__least") < base
    sums = ahead_of.groupBy(group, "__block", "left", "after", "base").agg(
        F.coalesce(F.sum(F.when(is_small, F.col("__sum"))), F.lit(0)).alias("__small"), F.min(F.when(~is_small, F.col("__least"))).alias("__big")
    )
    earlier = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("__before", F.coalesce(F.sum("__small").over(earlier), F.lit(0)))
    # A big amount is accepted for certain if it fits the room at the end of its block, and perhaps if it fits that at the start.
    start = left - F.col("__before")
    end = start - F.col("__small")
    certain = (end < base) | F.coalesce(F.col("__big") <= end, F.lit(False))
    possible = certain | F.coalesce(F.col("__big") <= start, F.lit(False))
    marked = reached.withColumns({"__certain": certain, "__possible": possible})
    open_still = ~F.coalesce(F.max("__certain").over(earlier), F.lit(False))
    looked_at = stored(marked.withColumn("__open", open_still).filter("__open and __possible").select(
        group, "__block", "left", "after", "base", "__before"
    ))
    ahead = F.col("after").isNull() | (F.col("__at") > F.col("after"))
    rows = stored(taking.join(looked_at, [group, "__block"]).filter(ahead & (cents <= left)))
    is_small = cents < base
    small = F.when(is_small, cents).otherwise(0)
    up_to_here = Window.partitionBy(group, "__block").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("__within", F.sum(small).over(up_to_here))
    left_here = left - F.col("__before") - F.col("__within")
    drops = F.when(is_small, left_here < base).otherwise(cents <= left_here)
    left_after = F.when(is_small, left_here).otherwise(left_here - cents)
    first = running.filter(drops).groupBy(group).agg(F.min(F.struct("__at", left_after.alias("left"), "__block")).alias("drop"))
    moved = current.join(first, group, "left")
    active, until, left_then = F.col("active"), F.col("drop.__at"), F.col("drop.left")
    dropped = active & F.col("drop").isNotNull()
    new_span = F.struct(F.col("after").alias("after"), until.alias("until"), base.alias("base")).cast(span)
    state = stored(moved.select(
        group, "room", "__first",
        F.when(dropped, left_then).otherwise(left).alias("left"),
        F.when(dropped, until).otherwise(F.col("after")).alias("after"),
        F.when(dropped, F.col("drop.__block")).otherwise(F.col("__last")).alias("__last"),
        F.when(active, F.array_append("spans", new_span)).otherwise(F.col("spans")).alias("spans"),
        (dropped & F.coalesce(left_then > 0, F.lit(False))).alias("active"),
    ))
    moved_to = state.filter("active").select(group, F.col("__last").alias("__block"), F.col("after").alias("__until"))
    behind = rows.select(group, "__block", "__at", "__cents").join(moved_to, [group, "__block"]).filter("__at > __until")
    return state, _by_size(behind, group)


def open_room(clinic: Clinic) -> DataFrame:
    """Price, paid and remaining room of every order."""
    priced = clinic.lab_test.select("order_id", "test_id").join(clinic.lab_test_catalog.select("test_id", "price"), "test_id")
    billed = priced.join(paid_to_date(clinic.payments), "order_id", "left")
    paid = F.coalesce("paid", F.lit(0).cast(CENT))
    return billed.select("order_id", "price", paid.alias("paid"), (F.col("price") - paid).cast(CENT).alias("room"))


ARRIVAL = ("payment_date", "payment_id")


def _positive_amount() -> Column:
    """What the row counts towards the price; NULL when its amount is not positive."""
    return F.when(F.col("amount_paid") > 0, counted_amount())


def _judge(clinic: Clinic, rows: DataFrame, arrival: Sequence[str], step: Column, **limits: int) -> DataFrame:
    # Rows without an order get a made-up negative one each, so that they never form one huge group.
    own = -1 - F.shiftrightunsigned(F.xxhash64(*arrival), 1)
    keyed = rows.withColumn("__order", F.coalesce("order_id", own))
    room = open_room(clinic).select(F.col("order_id").alias("__order"), "room")
    judged = accept_steps(keyed, room, "__order", arrival, step, F.col("status") == NOT_COUNTED, **limits)
    return judged.drop("__order")


def accept_payments(clinic: Clinic, incoming: DataFrame, arrival: Sequence[str] = ARRIVAL, **limits: int) -> DataFrame:
    """Judge new payments in arrival order against what each order still owes.

    Refunded payments are recorded without counting. Adds ``accepted`` and ``reject_reason``.
    """
    judged = _judge(clinic, incoming, arrival, _positive_amount(), **limits)
    return judged.withColumn("reject_reason", _refusal()).drop("room")


def _refusal() -> Column:
    return (
        F.when(F.col("room").isNull(), "unknown order")
        .when(F.coalesce(F.col("amount_paid") <= 0, F.lit(True)), "amount not positive")
        .when(~F.col("accepted"), "exceeds balance")
    )


def payment_cap(clinic: Clinic, arrival: Sequence[str] = ARRIVAL) -> Cap:
    """The rule of ``accept_payments`` for requests that also use up keys."""
    return Cap(
        "order_id", open_room(clinic).select("order_id", "room"), (_positive_amount() * 100).cast("bigint"), F.col("status") == NOT_COUNTED, _refusal(),
        lambda rows: accept_payments(clinic, rows, arrival),
    )


def _known_options(columns: Sequence[str]) -> dict[str, Column]:
    """For the options an edit sets: whether the value is one of those allowed."""
    domains = {name: values for name, values in DOMAINS["payments"].items() if name in columns}
    return {name: F.coalesce(F.col(name).isin(*values), F.lit(False)) for name, values in domains.items()}


def edit_payments(clinic: Clinic, edits: DataFrame, arrival: Sequence[str] = ("payment_id",), **limits: int) -> DataFrame:
    """Judge edits of recorded payments: the other payments plus the new amount must not exceed the price.

    A batch holds at most one edit per payment. Within an order, edits to REFUNDED
    come first and always pass, then edits that lower the counted amount, then those
    that raise it, each kind in arrival order. Unknown methods and statuses are refused. Adds ``order_id``, ``accepted`` and ``reject_reason``.
    """
    own = clinic.payments.select("payment_id", "order_id", counted_amount().alias("__own"))
    options = _known_options(edits.columns)
    step = (_positive_amount() - F.col("__own")).cast("decimal(11,2)")
    matched = edits.join(own, "payment_id", "left").withColumn("__step", F.when(reduce(lambda a, b: a & b, options.values(), F.lit(True)), step))
    judged = _judge(clinic, matched, arrival, F.col("__step"), **limits)
    reason = (
        F.when(F.col("order_id").isNull(), "unknown payment")
        .when(~options.get("payment_method", F.lit(True)), "unknown method").when(~options.get("status", F.lit(True)), "unknown status")
        .when(F.col("__step").isNull(), "amount not positive")
        .when(~F.col("accepted"), "exceeds balance")
    )
    return judged.withColumn("reject_reason", reason).select(*edits.columns, "order_id", "accepted", "reject_reason")
