"""Helpers of the operators that turn embeddings into whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import LAST_ID

I64_MAX = np.iinfo(np.int64).max
_PIECE = 48


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole_vectors(vectors: DataFrame, factor: int, *columns: str) -> DataFrame:
    """(vec_order, the named columns, x, dim) of usable rows: x is floor(factor * component), cut off at the ends of a long.

    A missing vec_id becomes the last number, so that it sorts after every other.
    """
    vector = F.col("embedding").cast("array<double>")
    x = F.transform(vector, lambda c: F.floor(c * F.lit(float(factor))))
    order = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vec_order")
    return vectors.filter(finite(vector)).select(order, *columns, x.alias("x"), F.size("embedding").alias("dim"))


def common_length(rows: DataFrame, parts: int = 1) -> int:
    """The length that most vectors have, of those that ``parts`` divides; of lengths held equally often the longest. 0 for none."""
    counted = rows.filter(F.col("dim") % parts == 0).groupBy("dim").count()
    best = counted.agg(F.max(F.struct("count", "dim")).alias("best")).first()["best"]
    return best["dim"] if best else 0


def matrix(column: pd.Series, length: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, length), np.int64)


def largest(values: np.ndarray) -> int:
    """The largest magnitude; a Python number, because that of the least long is no long."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def pieces(value: int) -> Iterator[tuple[int, int]]:
    """(place, piece) of a whole number of any size, so that pieces of one place can be added up in Spark."""
    place = 0
    while not -(1 << _PIECE) < value < 1 << _PIECE:
        yield place, value & ((1 << _PIECE) - 1)
        value, place = value >> _PIECE, place + 1
    yield place, value


PIECES = "place int, piece long"


def added(parts: DataFrame, *key: str) -> dict[tuple, int]:
    """Exact sums of pieces for each key; the keys must be few."""
    total: dict[tuple, int] = {}
    for row in parts.groupBy(*key, "place").agg(F.sum(F.col("piece").cast("decimal(38,0)")).alias("sum")).collect():
        name = tuple(row[k] for k in key)
        total[name] = total.get(name, 0) + (int(row["sum"]) << (_PIECE * row["place"]))
    return total
