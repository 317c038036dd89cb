"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by Orchard's search.

Components become whole numbers and vectors are cut into ``PARTS`` consecutive parts. A
part's codebook starts as that part of the vectors with the smallest vec_ids; a round
gives every part to its nearest entry and moves each entry to the floor of their mean.
Each codebook has, for every entry, the other entries in order of distance from it. The
search stands at an entry and walks down its list; an entry that is nearer to the part
becomes the one to stand at, and the walk goes on in its list. Entries met before are
skipped by a mark. Once the list's next entry is more than twice as far from the current
one as the part is, no entry behind it can be as near, and the search stops. Squared
distances of whole numbers decide all of this without rounding, ties included. All parts
of an Arrow batch walk at once. Tasks add up sums and counts per entry; only these and
the codebooks, both of fixed size, pass through the driver.

Nulls: vectors that are null, empty, or hold null or non-finite components are dropped; a
null vec_id sorts last and is returned as null. All codes need one length: of the lengths
that ``PARTS`` divides, only vectors of that which most rows have are kept (of those held
equally often the longest). Rows that repeat are coded each; of rows with one vec_id those
with the smaller vector come first into a codebook, which has fewer entries where there
are fewer rows. Null labels count as one label. Components and sums are cut off at the
ends of a long. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import identifier
from clinicframe.llm.vectors import I64_MAX, PIECES, added, common_length, largest, matrix, pieces, whole_vectors
from clinicframe.operators.skew import join_grouped
from clinicframe.session import ensure_checkpoint_dir

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Below this magnitude squared distances of parts stay in a long; beyond it numbers of any size are used.
_PLAIN = 1 << 24


def _numbers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object or largest(x) < _PLAIN else x.astype(object)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


class Codebooks:
    """Entries of all parts (part, entry, component) with their lists of neighbours by distance."""

    def __init__(self, entries: np.ndarray) -> None:
        entries = _numbers(entries)
        parts, size, width = entries.shape
        distance = np.stack([_apart(own[:, None], own[None]) for own in entries])
        order = np.argsort(distance, axis=2, kind="stable")
        base = (np.arange(parts) * size)[:, None, None]
        self.entries, self.size = entries.reshape(-1, width), size
        # Entries are numbered through all parts; each list is one row.
        self.lists = (order + base).reshape(parts * size, size)
        self.far = np.take_along_axis(distance, order, axis=2).reshape(parts * size, size)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of the rows, both with one column a part."""
        size, parts = self.size, len(self.entries) // self.size
        points = x.reshape(len(x) * parts, -1)
        if self.entries.dtype == object or largest(points) >= _PLAIN:
            points = points.astype(object)
        at = np.tile(np.arange(parts) * size, len(x))
        best = _apart(points, self.entries[at])
        met = np.zeros((len(points), size), bool)
        met[:, 0] = True
        walking, step = np.arange(len(points)), np.zeros(len(points), np.int64)
        while len(walking):
            here = at[walking]
            ahead = step[walking]
            going = self.far[here, ahead] <= 4 * best[walking]
            walking, here, ahead = walking[going], here[going], ahead[going]
            other = self.lists[here, ahead]
            step[walking] += 1
            new = ~met[walking, other % size]
            who, entry = walking[new], other[new]
            met[who, entry % size] = True
            distance = _apart(points[who], self.entries[entry])
            nearer = ((distance < best[who]) | ((distance == best[who]) & (entry < at[who]))).astype(bool)
            moved = who[nearer]
            at[moved], best[moved], step[moved] = entry[nearer], distance[nearer], 0
            walking = walking[step[walking] < size]
        return (at % size).reshape(len(x), parts), best.reshape(len(x), parts)


def _totals(frames: Iterator[pd.DataFrame], length: int, books: Codebooks, parts: int) -> Iterator[pd.DataFrame]:
    """Sums and counts of a task, one row for each entry used and component; the count is component -1."""
    slots, width = len(books.entries), length // parts
    counts, sums = np.zeros(slots, np.int64), np.zeros((slots, width), object)
    for frame in frames:
        x = matrix(frame["x"], length)
        slot = (books.nearest(x)[0] + np.arange(parts) * books.size).reshape(-1)
        counts += np.bincount(slot, minlength=slots)
        order = np.argsort(slot, kind="stable")
        used, first = np.unique(slot[order], return_index=True)
        sums[used] += np.add.reduceat(_numbers(x).reshape(len(slot), width)[order], first, axis=0).astype(object)
    used = np.flatnonzero(counts)
    rows = [(int(s), -1, 0, int(counts[s])) for s in used]
    rows += [(int(s), j, *part) for s in used for j in range(width) for part in pieces(int(sums[s, j]))]
    yield pd.DataFrame(rows, columns=["slot", "component", "place", "piece"])


def trained(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after the rounds."""
    first = rows.select("vec_order", "x").orderBy("vec_order", "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64)
    books = start.reshape(len(first), parts, length // parts).swapaxes(0, 1).astype(object)
    for _ in range(rounds):
        search = Codebooks(books.astype(np.int64))
        sums = rows.select("x").mapInPandas(lambda f: _totals(f, length, search, parts), f"slot int, component int, {PIECES}")
        total = added(sums, "slot", "component")
        flat = books.reshape(-1, length // parts).copy()
        for (slot, component), value in total.items():
            if component >= 0:
                flat[slot, component] = value // total[slot, -1]
        books = flat.reshape(books.shape)
    return books.astype(np.int64)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks for every kept vector."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("none"))
    rows = whole_vectors(vectors.withColumn("label", label), scale, "label")
    length = common_length(rows, parts)
    if not length:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.col("dim") == length)
    books = trained(rows, length, parts, entries, rounds)
    search = Codebooks(books)
    names = np.array([f"{i:02x}" for i in range(max(256, books.shape[1]))], object)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            code, distance = search.nearest(matrix(frame["x"], length))
            error = [min(I64_MAX, int(e)) for e in distance.sum(axis=1)]
            yield pd.DataFrame({"vec_order": frame["vec_order"], "label": frame["label"], "code": ["".join(c) for c in names[code]], "error": error})

    done = rows.select("vec_order", "label", "x").mapInPandas(coded, "vec_order long, label string, code string, error long").checkpoint()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(I64_MAX).cast("decimal(38,0)")).cast("long")
    known = join_grouped(done, done.groupBy("label").agg(total.alias("label_error")), "label")
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()
    return known.select(identifier("vec_order").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
