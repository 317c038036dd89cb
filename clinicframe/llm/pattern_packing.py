"""Best-fit packing by length patterns and non-negative least squares.

1. Documents become pieces of at most ``capacity`` tokens; the pieces' lengths are
   counted. Everything that follows on the driver works on these counts, at most one
   per length, whatever the number of documents.
2. Patterns of up to four lengths that fill a sequence almost to the end are listed.
   Non-negative least squares finds how often to use each, so that the lengths they use
   come near the counts; the repeats are rounded down and cut to what is there.
3. The remaining counts are packed best fit, longest first, many equal sequences at once.
4. The plan says for each length which ranks go to which pattern. Pieces are ranked
   within their length by their place in a checkpointed table, with one offset per part
   of it, so a length that most pieces share needs no common task.

Nulls: a null text is empty, a piece of one end mark; a null doc_id is returned as null.
Repeated rows are packed each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinicframe.llm.common import identifier, in_order
from clinicframe.llm.tokens import encoder
from clinicframe.session import ensure_checkpoint_dir

CAPACITY = 2048
END_MARK = 0
#: Second and third lengths tried for each first length of a pattern.
BRANCHES = 8
SWEEPS = 12
#: A pattern may leave this many places empty.
SLACK = 4


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_order, piece, start, length, ids_crc32) of every document, its end mark included."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, np.array([END_MARK], "<u4").tobytes()
        for frame in frames:
            rows = []
            for order, text in zip(frame["doc_order"], frame["text"]):
                ids = encode(text) + end
                for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    rows.append((order, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_order", "piece", "start", "length", "ids_crc32"])

    return in_order(docs).mapInPandas(cut, "doc_order long, piece int, start long, length long, ids_crc32 long")


def list_patterns(present: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Pairs, triples and quadruples of the given lengths that leave at most SLACK places."""
    found: set[tuple[int, ...]] = set()

    def closing(so_far: tuple[int, ...], room: int) -> None:
        at = bisect.bisect_right(present, room)
        if at and room - present[at - 1] <= SLACK:
            found.add(tuple(sorted((*so_far, present[at - 1]), reverse=True)))

    def spread(room: int) -> list[int]:
        at = bisect.bisect_right(present, room)
        return [present[i] for i in sorted({int(x) for x in np.linspace(0, at - 1, BRANCHES)})] if at else []

    for a in present:
        closing((a,), capacity - a)
        for b in spread(capacity - a):
            closing((a, b), capacity - a - b)
            for c in spread(capacity - a - b)[:: BRANCHES // 2]:
                closing((a, b, c), capacity - a - b - c)
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int]) -> list[float]:
    """Repeats, none below zero, that bring the patterns' lengths nearest to the counts in least squares.

    One repeat at a time is set to its best value while the others stand, over and over.
    """
    shapes = [[(n, p.count(n)) for n in sorted(set(p))] for p in patterns]
    rest = {n: float(c) for n, c in counts.items()}
    repeats = [0.0] * len(patterns)
    for _ in range(SWEEPS):
        for i, shape in enumerate(shapes):
            best = repeats[i] + sum(m * rest[n] for n, m in shape) / sum(m * m for _, m in shape)
            step = max(0.0, best) - repeats[i]
            if step:
                repeats[i] += step
                for n, m in shape:
                    rest[n] -= m * step
    return repeats


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: (lengths in a sequence, how many such sequences)."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = min(capacity // length, left)
                many = left // per
                content, room, left = (length,) * per, capacity - per * length, left - many * per
            else:
                room = rooms[at]
                content, many = by_room[room].pop()
                per = min(room // length, left)
                used = min(many, left // per)
                if used < many:
                    by_room[room].append((content, many - used))
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                content, room, many, left = content + (length,) * per, room - per * length, used, left - used * per
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room[room].append((content, many))
    return [x for room in sorted(by_room) for x in by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences of which lengths hold all counted pieces."""
    rest = {n: c for n, c in counts.items() if c}
    out = []
    if rest.get(capacity):
        out.append(((capacity,), rest.pop(capacity)))
    patterns = list_patterns(sorted(rest), capacity)
    for pattern, repeats in zip(patterns, fit_repeats(patterns, rest)):
        many = min(int(repeats), *(rest[n] // pattern.count(n) for n in pattern))
        if many > 0:
            out.append((pattern, many))
            for n in pattern:
                rest[n] -= many
    return out + best_fit({n: c for n, c in rest.items() if c}, capacity)


def slots(packing: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its (first rank, first sequence, offset), by rank."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for content, many in packing:
        offset = 0
        for length in content:
            out[length].append((ranks[length], sequence, offset))
            ranks[length] += many
            offset += length
        sequence += many
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _placed(frames: Iterator[pd.DataFrame], table: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        ranks = frame["rank"].to_numpy()
        for length, rows in frame.reset_index(drop=True).groupby("length").indices.items():
            slot = table[int(length)]
            at = np.searchsorted(slot[:, 0], ranks[rows], side="right") - 1
            sequence[rows] = slot[at, 1] + ranks[rows] - slot[at, 0]
            offset[rows] = slot[at, 2]
        yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the pieces of each length within their part."""
    seen: dict[int, int] = defaultdict(int)
    for frame in frames:
        nth = frame.groupby("length").cumcount().to_numpy() + np.array([seen[n] for n in frame["length"]], np.int64)
        for length, n in frame["length"].value_counts().items():
            seen[length] += int(n)
        yield frame.assign(nth=nth)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    ensure_checkpoint_dir(docs.sparkSession)
    cut = pieces(docs, tokenizer, capacity).withColumn("part", F.spark_partition_id()).checkpoint()
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.mapInPandas(_numbered, "doc_order long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    ranked = numbered.join(offsets, ["part", "length"]).select(
        "doc_order", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    schema = "doc_order long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.mapInPandas(lambda frames: _placed(frames, table), schema)
    return placed.select(identifier().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
