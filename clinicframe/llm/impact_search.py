"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Components become whole numbers. The index is dealt into shards of at most about
``SHARD_CELLS`` numbers, each stored as one row; opened, a shard has a posting list for
each axis, cut into segments of one quantised component value. For a query, a segment's
impact is the largest product that any of its postings can add. Segments of all axes are
taken by falling impact and added to one running score a vector, whose axes seen are
counted. What a vector has not met yet adds at most (axes not seen) * (next impact).
Queries go through the segments in groups, so that a posting is read once for all of them
and the postings between two looks are added in one product of matrices.
The k best of the running scores, computed exactly, give a score that a member must reach.
Processing stops once the vectors that could still reach it are few; those and no others
are scored exactly, so stopping early never changes a result. Blocks of queries meet the
shards in rounds, each with as many shards as all rounds before: a query's k-th score so
far goes along, and what a round writes stays near k rows a query.

Of equal vectors only the k + 1 smallest vec_ids are indexed, since no others can be among
a query's k. Vectors are scored against those of their own length. Nulls: vectors that
are null, empty, or hold null or non-finite components take no part; a null vec_id is
never a query, sorts last and is returned as null. A query's own row is left out once, so
a row that repeats finds its twin, and a repeated query gets a list each time. Scores
beyond a long are cut off at its ends, as components are. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinicframe.llm.common import LAST_ID, identifier, run_starts
from clinicframe.llm.vectors import I64_MAX, largest, matrix, whole_vectors
from clinicframe.operators.skew import join_grouped
from clinicframe.session import ensure_checkpoint_dir

K = 20
EVERY = 20
SCALE = 64
SHARD_CELLS = 1 << 22
QUERY_CELLS = 1 << 20
#: Segments of an axis, queries that go through them together, and the shares of all postings after which is looked at what could still be a member.
LEVELS = 32
GROUP = 128
LOOKS = (0.4, 0.6, 0.8)


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The numbers in the smallest type that holds them."""
    for kind in ("i1", "i2", "i4", "i8"):
        if largest(x) <= np.iinfo(kind).max or kind == "i8":
            return kind, x.astype(kind).tobytes()
    raise AssertionError


def _packed(frame: pd.DataFrame, key: str) -> pd.DataFrame:
    """Vectors of one shard or block as one row."""
    frame = frame.sort_values("vec_order", kind="stable")
    dim = int(frame["dim"].iloc[0])
    kind, data = _narrow(matrix(frame["x"], dim))
    return pd.DataFrame([(dim, int(frame[key].iloc[0]), frame["vec_order"].to_numpy("<i8").tobytes(), kind, data)], columns=["dim", key, "ids", "kind", "data"])


class Shard:
    """Posting lists of the vectors of one shard, by axis and quantised value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, (n, dim) = ids, x, x.shape
        self.largest = largest(x)
        members, values, low, high, starts, axes = [], [], [], [], [], []
        for axis in range(dim):
            column = x[:, axis]
            order = np.argsort(column, kind="stable")
            ranked = column[order].astype(np.int64)
            width = max(1, -(-(int(ranked[-1]) - int(ranked[0]) + 1) // LEVELS))
            first = run_starts((ranked - ranked[0]).astype(np.uint64) // np.uint64(width))
            members.append(order.astype(np.int32))
            values.append(column[order])
            low.append(ranked[first])
            high.append(ranked[np.append(first[1:], n) - 1])
            starts.append(first + axis * n)
            axes.append(np.full(len(first), axis))
        self.members, self.values = np.concatenate(members), np.concatenate(values)
        self.low, self.high, self.axes = np.concatenate(low), np.concatenate(high), np.concatenate(axes)
        self.starts = np.concatenate(starts)
        self.ends = np.append(self.starts[1:], n * dim)
        # Doubles hold the scores exactly where ``searched`` adds running scores.
        self.exact = x.astype(np.float64)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)

    def possible(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of at least all that reach both ``floor`` and the k-th score here."""
        return next(self.searched(query[None], k, np.array([floor])))

    def searched(self, queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query what ``possible`` gives; queries go through the segments in groups."""
        n, dim = self.x.shape
        step = max(1, min(GROUP, 2 * SHARD_CELLS // n))
        for start in range(0, len(queries), step):
            group = queries[start : start + step]
            wide = np.array([dim * self.largest * largest(query) >= 1 << 46 for query in group])
            held = iter(self._of_group(group[~wide].astype(np.int64), k, floors[start : start + step][~wide]) if not wide.all() else ())
            for query, is_wide in zip(group, wide):
                if is_wide:
                    products = self.x.astype(object) @ query.astype(object)
                    yield np.arange(n), np.array([max(-I64_MAX - 1, min(I64_MAX, int(v))) for v in products], np.int64)
                else:
                    yield next(held)

    def _of_group(self, weights: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """A segment is taken by the largest impact that it has for a query of the group; each query stops for itself."""
        n, dim = self.x.shape
        # Single precision holds whole numbers up to this, too.
        kind = np.float32 if dim * self.largest * largest(weights) < 1 << 24 else np.float64
        of_segment = weights[:, self.axes]
        impact = np.maximum(np.abs(of_segment * self.low), np.abs(of_segment * self.high))
        order = np.argsort(-impact.max(axis=0), kind="stable")
        # The largest impact of what is left, for each query.
        left = np.maximum.accumulate(impact[:, order[::-1]], axis=1)[:, ::-1]
        share = np.cumsum(self.ends[order] - self.starts[order]) / (n * dim)
        bounds = [0, *(np.searchsorted(share, LOOKS) + 1), len(order)]
        running, seen = np.zeros((len(weights), n), kind), np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(weights)
        active = np.arange(len(weights))
        for begin, end in zip(bounds, bounds[1:]):
            running[active] += weights[active].astype(kind) @ self._postings(np.sort(order[begin:end]), seen, kind)
            if end >= len(order):
                break
            for q in active:
                reach = running[q] + (dim - seen) * int(left[q, end])
                could = np.flatnonzero(reach >= max(int(floors[q]), self._bar(running[q], weights[q], k)))
                if len(could) <= max(4 * k, n // 16):
                    found[q] = could, self.scores(could, weights[q])
            active = np.array([q for q in active if found[q] is None], np.int64)
            if not len(active):
                break
        for q in active:
            found[q] = np.arange(n), running[q].astype(np.int64)
        return found

    def _postings(self, segments: np.ndarray, seen: np.ndarray, kind: type) -> np.ndarray:
        """(axis, vector): the components that these segments post, 0 elsewhere; ``seen`` counts them for each vector."""
        n, dim = self.x.shape
        posted = np.zeros((dim, n), kind)
        axes = self.axes[segments]
        for some in np.split(segments, np.flatnonzero(np.diff(axes)) + 1):
            if len(some):
                rows, values = (np.concatenate([of[b:e] for b, e in zip(self.starts[some], self.ends[some])]) for of in (self.members, self.values))
                posted[self.axes[some[0]], rows] = values
                seen[rows] += 1
        return posted

    def _bar(self, running: np.ndarray, query: np.ndarray, k: int) -> int:
        """A score that k vectors of this shard reach."""
        if len(running) < k:
            return -I64_MAX
        probe = np.argpartition(running, len(running) - min(len(running), 2 * k))[-min(len(running), 2 * k) :]
        return int(np.partition(self.scores(probe, query), len(probe) - k)[len(probe) - k])


def _opened(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["data"], row["kind"]).reshape(len(ids), row["dim"])


FOUND = "dim int, block int, place int, query_order long, score long, vec_order long, own boolean"


def _searched(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 best of one shard for each query of a block, as far as they reach what the query has already."""
    out = []
    for block in left.itertuples():
        for part in right.itertuples():
            ids, queries = _opened(block._asdict())
            names, x = _opened(part._asdict())
            shard = Shard(names, x)
            floors = np.full(len(ids), -I64_MAX - 1)
            if block.places is not None:
                floors[np.asarray(block.places, np.int64)] = np.asarray(block.floors, np.int64)
            for place, (own, query, (rows, scores)) in enumerate(zip(ids, queries, shard.searched(queries, k + 1, floors))):
                good = scores >= floors[place]
                rows, scores = rows[good], scores[good]
                if len(rows) > k + 1:
                    bar = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    rows, scores = rows[scores >= bar], scores[scores >= bar]
                best = np.lexsort((names[rows], ~scores))[: k + 1] if len(rows) else np.zeros(0, np.int64)
                rows, scores = rows[best], scores[best]
                same = names[rows] == own
                same[same] = (x[rows[same]] == query).all(axis=1)
                out.append(pd.DataFrame({
                    "dim": x.shape[1], "block": block.block, "place": place, "query_order": own, "score": scores, "vec_order": names[rows], "own": same,
                }))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])


def _dealt(rows: DataFrame, counts: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows with ``key``, one of ``n`` numbers for their length."""
    number = F.pmod(F.xxhash64(*by), F.col("n")).cast("int")
    return join_grouped(rows, counts, "dim").withColumn(key, number).drop("n")


def _first_of_each(rows: DataFrame, by: tuple[str, ...], order: tuple[Column, ...], k: int) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides its k best others."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = whole_vectors(vectors, scale)
    asked = (F.col("vec_order") != LAST_ID) & (F.col("vec_order") % every == 0)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("rows"), F.count(F.when(asked, 1)).alias("queries")).withColumn(
        "shards", F.ceil(F.col("rows") * F.col("dim") / SHARD_CELLS)
    )
    # Few queries are dealt into more blocks, so that all cores have some.
    spread = F.least(F.ceil(F.col("queries") / 64), F.ceil(F.lit(2 * spark.sparkContext.defaultParallelism) / F.col("shards")))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), spread, F.ceil(F.col("queries") * F.col("dim") / QUERY_CELLS))).checkpoint()
    shards, blocks = (sizes.select("dim", F.col(c).alias("n")) for c in ("shards", "blocks"))

    kept = _first_of_each(rows, ("x",), (F.col("vec_order"),), k + 1)
    index = _dealt(kept, shards, "shard", "x", "vec_order").groupBy("dim", "shard").applyInPandas(
        lambda f: _packed(f, "shard"), "dim int, shard int, ids binary, kind string, data binary"
    ).checkpoint()
    queries = _dealt(rows.filter(asked), blocks, "block", "vec_order").groupBy("dim", "block").applyInPandas(
        lambda f: _packed(f, "block"), "dim int, block int, ids binary, kind string, data binary"
    ).checkpoint()

    by = ("dim", "block", "place")
    order = (F.col("score").desc(), F.col("vec_order"))
    best = spark.createDataFrame([], FOUND)
    most, low, high = sizes.agg(F.max("shards")).first()[0] or 0, 0, 1
    while low < most:
        floors = best.groupBy(*by).agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k + 1)
        floors = floors.groupBy("dim", "block").agg(F.collect_list(F.struct("place", "floor")).alias("f")).select("dim", "block", F.col("f.place").alias("places"), F.col("f.floor").alias("floors"))
        due = sizes.filter(F.col("shards") > low).select("dim", "blocks", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("shards").cast("int")) - 1)).alias("shard"))
        asking = queries.join(floors, ["dim", "block"], "left").join(due.select("dim", "shard"), "dim")
        answering = index.join(due, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        found = asking.groupBy("dim", "block", "shard").cogroup(answering.groupBy("dim", "block", "shard")).applyInPandas(lambda a, b: _searched(a, b, k), FOUND)
        best = _first_of_each(best.unionByName(found), by, order, k + 1).checkpoint()
        low, high = high, 2 * high
    whole = Window.partitionBy(*by).orderBy(*order, F.col("own").desc())
    place, passed = F.row_number().over(whole), F.sum(F.col("own").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    ranked = best.withColumns({"place_in": place, "passed": passed}).filter(~F.col("own") | (F.col("passed") > 1))
    ranked = ranked.withColumn("rank", F.col("place_in") - F.least("passed", F.lit(1)).cast("int")).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_order").alias("query_id"), F.col("rank").cast("int").alias("rank"), identifier("vec_order").alias("vec_id"), "score")
