"""Joins whose many side may hold a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_grouped(many: DataFrame, grouped: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to a side that was grouped, made distinct or joined by the same key.

    Adaptive execution splits a hot key only where both sides of the join are fresh
    shuffles, and a side that is partitioned by the key already gets none. A hash of
    the key as a second join column makes Spark shuffle that (reduced) side again, so
    the many side can be split.
    """
    tagged = [df.withColumn("__tag", F.hash(key)) for df in (many, grouped)]
    return tagged[0].join(tagged[1], [key, "__tag"], how).drop("__tag")
