"""Requests decided one after another, where an accepted one uses up its keys.

Most requests share no key with another one: these are decided at once. The others are
tied: a refusal may free a key for the next, whose acceptance may refuse a third, and so
on. Tied requests that are connected by keys or by a shared cap are folded in order in
one pass, each connected group on its own. Only groups of more than ``FOLD_ROWS``
requests take rounds, of which each settles at least the earliest wrong decision.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.functions.text import in_order
from clinicframe.operators.components import components
from clinicframe.operators.skew import join_grouped
from clinicframe.session import stored

#: Tied requests that one task folds; so many in all are folded without looking for groups first.
FOLD_ROWS = 4096


class Cap(NamedTuple):
    """What else decides: an accepted request takes ``cents`` out of the room of its ``group``.

    ``room`` has one row (group, room) per group. A request whose group has no room
    listed, or with NULL ``cents``, is refused; a ``free`` one is accepted whatever is left.
    ``judge`` decides many requests at once by the same rule; ``reason`` says from
    ``room`` and ``accepted`` why one was refused.
    """

    group: str
    room: DataFrame
    cents: Column
    free: Column
    reason: Column
    judge: Callable[[DataFrame], DataFrame]


def one_at_a_time(
    requests: DataFrame, keys: dict[str, str], order_by: Sequence[str], cap: Cap | None = None, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Append ``accepted`` and ``reject_reason``: the outcome of deciding each request after all earlier ones.

    ``keys`` maps key columns to the reason for refusing a request whose key an earlier
    accepted request has; a NULL key is never taken. ``order_by`` must tell requests apart.
    """
    columns = requests.columns
    judge = cap.judge if cap else _accept_all
    marked = stored(_tied(stored(requests.withColumn("__id", F.monotonically_increasing_id())), keys, cap))
    loose = judge(marked.filter(~F.col("__tied")).select(*columns)).select(*columns, "accepted", "reject_reason")
    tied = marked.filter("__tied").drop("__tied")
    n = tied.count()
    if not n:
        return stored(loose)
    if n <= fold_rows:
        return stored(loose.unionByName(_folded(tied.withColumn("__part", F.lit(0)), columns, keys, order_by, cap)))
    parts = components(_links(tied, keys, cap)).select(F.col("node").alias("__id"), F.col("component").alias("__part"))
    placed = tied.join(parts, "__id", "left").withColumn("__part", F.coalesce("__part", "__id"))
    placed = stored(placed)
    large = placed.groupBy("__part").agg(F.count("*").alias("__rows")).filter(F.col("__rows") > fold_rows).select("__part")
    large = stored(large)
    small = join_grouped(placed, large, "__part", "left_anti").select(*placed.columns)
    out = loose.unionByName(_folded(small, columns, keys, order_by, cap))
    if not large.isEmpty():
        rest = join_grouped(placed, large, "__part", "left_semi").select(*columns)
        out = out.unionByName(_in_rounds(rest, keys, order_by, judge))
    return stored(out)


def _shared(requests: DataFrame, key: str) -> DataFrame:
    """(key, first): the values that several requests have, with the smallest of their numbers."""
    counted = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    return counted.filter("__n > 1").select(key, "__first")


def _tied(requests: DataFrame, keys: dict[str, str], cap: Cap | None) -> DataFrame:
    """Append whether a request shares a key, or the cap of one that does."""
    marked = requests.withColumn("__tied", F.lit(False))
    for key in keys:
        marked = join_grouped(marked, _shared(requests, key), key, "left")
        marked = marked.withColumn("__tied", F.col("__tied") | F.col("__first").isNotNull()).drop("__first")
    if cap:
        with_tied = marked.filter("__tied").filter(F.col(cap.group).isNotNull()).select(cap.group).distinct().withColumn("__near", F.lit(True))
        marked = join_grouped(marked, with_tied, cap.group, "left")
        marked = marked.withColumn("__tied", F.col("__tied") | F.coalesce("__near", F.lit(False))).drop("__near")
    return marked


def _links(tied: DataFrame, keys: dict[str, str], cap: Cap | None) -> DataFrame:
    """Each tied request with the first one of its keys and of its cap: one link a key, however many share it."""
    by = [*keys, *([cap.group] if cap else [])]
    return reduce(DataFrame.union, [
        join_grouped(tied.select("__id", k), _shared(tied, k), k).select(F.col("__id").alias("a"), F.col("__first").alias("b")) for k in by
    ])


def _folded(tied: DataFrame, columns: Sequence[str], keys: dict[str, str], order_by: Sequence[str], cap: Cap | None) -> DataFrame:
    """Decide the requests of each part in order. What earlier ones took is carried along: their keys, and group and cents."""
    rows = tied
    if cap:
        rows = join_grouped(rows, cap.room.select(cap.group, F.col("room").alias("room")), cap.group, "left")
        rows = rows.withColumns({"__cents": cap.cents, "__free": F.coalesce(cap.free, F.lit(False)), "__group": F.col(cap.group)})
    else:
        rows = rows.withColumns({"room": F.lit(None).cast("decimal(20,2)"), "__cents": F.lit(0).cast("long"), "__free": F.lit(True), "__group": F.lit(0)})
    known = F.col("room").isNotNull() if cap else F.lit(True)
    names = [f"__k{i}" for i in range(len(keys))]
    entry = F.struct(
        in_order(order_by).alias("at"), F.struct(*columns, "room").alias("row"), F.col("__cents").alias("cents"), F.col("__free").alias("free"), known.alias("known"),
        (F.coalesce("room", F.lit(0)) * 100).cast("long").alias("room"), F.col("__group").alias("group"), *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)],
    )
    lists = rows.groupBy("__part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    group_type = rows.schema["__group"].dataType.simpleString()
    spent_type = f"array<struct<group:{group_type},cents:bigint>>"
    state_type = f"struct<{','.join(f'{n}:array<string>' for n in names)},spent:{spent_type},out:array<int>>"
    start = F.struct(*[F.array().cast("array<string>").alias(n) for n in names], F.array().cast(spent_type).alias("spent"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        # 0 accepted, k taken by its k-th key, -1 refused by the cap.
        taken = [F.coalesce(F.array_contains(state[n], item[n]), F.lit(False)) for n in names]
        used = F.aggregate(F.filter(state["spent"], lambda s: s["group"] == item["group"]), F.lit(0).cast("long"), lambda total, s: total + s["cents"])
        fits = F.coalesce(item["known"] & item["cents"].isNotNull() & (item["free"] | (item["cents"] <= item["room"] - used)), F.lit(False))
        code = reduce(lambda rest, k: F.when(taken[k], k + 1).otherwise(rest), reversed(range(len(names))), F.when(fits, 0).otherwise(-1))
        good = code == 0
        grown = [F.when(good & item[n].isNotNull(), F.array_append(state[n], item[n])).otherwise(state[n]).alias(n) for n in names]
        spent = F.when(good & (item["cents"] != 0), F.array_append(state["spent"], F.struct(item["group"].alias("group"), item["cents"].alias("cents"))))
        return F.struct(*grown, F.coalesce(spent, state["spent"]).alias("spent"), F.array_append(state["out"], code).alias("out")).cast(state_type)

    done = lists.select(F.explode(F.arrays_zip(F.col("entries.row").alias("row"), F.aggregate("entries", start.cast(state_type), step, lambda s: s["out"]).alias("code"))).alias("one"))
    told = done.select("one.row.*", (F.col("one.code") == 0).alias("accepted"), F.col("one.code").alias("__code"))
    reasons = [F.when(F.col("__code") == k, reason) for k, reason in enumerate(keys.values(), 1)]
    other = [F.when(F.col("__code") == -1, cap.reason)] if cap else []
    return told.select(*columns, "accepted", F.coalesce(*reasons, *other, F.lit(None).cast("string")).alias("reject_reason"))


def _accept_all(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"accepted": F.lit(True), "reject_reason": F.lit(None).cast("string")})


def _in_rounds(requests: DataFrame, keys: dict[str, str], order_by: Sequence[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """At first the earliest request of every key holds it. A round then judges the holders
    and hands the keys of refused ones on. Decisions depend on earlier requests only, so each
    round settles the earliest wrong one, and a round that changes nothing is the answer.
    """
    columns, at = requests.columns, in_order(order_by)

    def held(decided: DataFrame) -> DataFrame:
        taken = decided
        for key in keys:
            first = decided.filter(F.col("accepted") & F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias(f"__first_{key}"))
            taken = join_grouped(taken, first, key, "left")
        late = [F.when(at > F.col(f"__first_{key}"), reason) for key, reason in keys.items()]
        return taken.withColumn("__held", F.coalesce(*late, F.lit(None).cast("string")))

    state = held(requests.withColumn("accepted", F.lit(True))).select(*columns, "__held")
    while True:
        judged = judge(state.filter("__held is null").select(*columns)).withColumn("__was", F.lit(None).cast("string"))
        refused = state.filter("__held is not null").select(
            *columns, F.lit(False).alias("accepted"), F.col("__held").alias("reject_reason"), F.col("__held").alias("__was")
        )
        decided = stored(judged.select(*refused.columns).unionByName(refused))
        after = held(decided)
        if after.filter(~F.col("__held").eqNullSafe(F.col("__was"))).isEmpty():
            return decided.drop("__was")
        state = after.select(*columns, "__held")


def taken_keys(existing: DataFrame, requests: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """Append ``__taken``: the reason of the first key column of a request that a row of ``existing`` has already."""
    marked = requests
    for key in reasons:
        used = existing.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(f"__used_{key}", F.lit(True))
        marked = join_grouped(marked, used, key, "left")
    found = [F.when(F.col(f"__used_{key}"), reason) for key, reason in reasons.items()]
    return reduce(lambda df, key: df.drop(f"__used_{key}"), reasons, marked.withColumn("__taken", F.coalesce(*found, F.lit(None).cast("string"))))
