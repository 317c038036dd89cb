"""What was paid on each order, kept beside a stored clinic and moved along by what commits change.

The sums of one version are a table cut by order number, as the payments are. A later
version differs from it by the rows of the files that it dropped and added; their signed
sum moves the orders concerned, and only files of sums that hold such orders are written
anew. Untouched payments are never read again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from clinicframe.functions.amounts import CENT, counted_amount
from clinicframe.session import ensure_checkpoint_dir
from clinicframe.sources.versions import State, create_once, state

SUMS = f"order_id long, paid {CENT}, n_payments long"
ENTRY = "number long, version long, files array<struct<path:string,low:long,high:long>>"


def _current(spark: SparkSession, root: str) -> dict | None:
    try:
        found = spark.read.schema(ENTRY).json(f"{root}/_paid").filter("number is not null")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = found.orderBy(F.desc("number")).first()
    return last.asDict(recursive=True) if last else None


def _read(spark: SparkSession, files: list[dict]) -> DataFrame:
    return spark.read.schema(SUMS).parquet(*[f["path"] for f in files]) if files else spark.createDataFrame([], SUMS)


def _write(sums: DataFrame, root: str, parts: int | None) -> list[dict]:
    path = f"{root}/paid/{uuid.uuid4().hex}"
    spread = sums.repartitionByRange(parts, "order_id") if parts else sums.repartitionByRange("order_id")
    spread.sortWithinPartitions("order_id").write.parquet(path)
    bounds = sums.sparkSession.read.schema(SUMS).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min("order_id").alias("low"), F.max("order_id").alias("high")
    )
    return [r.asDict() for r in bounds.collect()]


def _summed(payments: DataFrame, sign: int = 1) -> DataFrame:
    return payments.groupBy("order_id").agg(
        (sign * F.sum(counted_amount())).cast(CENT).alias("paid"), (sign * F.count("*")).cast("long").alias("n_payments")
    )


def _added_up(sums: DataFrame) -> DataFrame:
    return sums.groupBy("order_id").agg(F.sum("paid").cast(CENT).alias("paid"), F.sum("n_payments").alias("n_payments"))


def _moved(before: State, after: State) -> DataFrame:
    """By how much each order's sums differ between two versions, from the files that only one of them has."""
    old, new = set(before.files("payments")), set(after.files("payments"))
    sides = [_summed(s.read("payments", sorted(files)), sign) for s, files, sign in ((after, new - old, 1), (before, old - new, -1)) if files]
    if not sides:
        return after.spark.createDataFrame([], SUMS)
    return _added_up(reduce(DataFrame.unionByName, sides)).filter("paid <> 0 or n_payments <> 0")


def refresh(spark: SparkSession, root: str, parts: int | None = None) -> int:
    """Bring the sums to the current version of the clinic; returns how many of their files were written."""
    target, have = state(spark, root), _current(spark, root)
    if target is None:
        raise ValueError(f"no snapshot under {root}")
    if have and have["version"] == target.version:
        return 0
    if have is None:
        kept, written = [], _write(_summed(target.read("payments")), root, parts)
    else:
        ensure_checkpoint_dir(spark)
        moved = _moved(state(spark, root, have["version"]), target).checkpoint()
        touched = _touched(spark, have["files"], moved)
        kept = [f for f in have["files"] if f not in touched]
        sums = _added_up(_read(spark, touched).unionByName(moved)).filter("n_payments > 0")
        written = [] if moved.isEmpty() else _write(sums, root, max(1, len(touched)))
    number = have["number"] + 1 if have else 1
    entry = {"number": number, "version": target.version, "files": kept + written}
    if not create_once(spark, f"{root}/_paid/{number:012d}.json", json.dumps(entry)):
        return refresh(spark, root, parts)
    return len(written)


def _touched(spark: SparkSession, files: list[dict], moved: DataFrame) -> list[dict]:
    """The files that hold sums of moved orders."""
    low, high = moved.agg(F.min("order_id"), F.max("order_id")).first()
    near = [f for f in files if low is not None and f["low"] <= high and f["high"] >= low]
    if not near:
        return []
    rows = _read(spark, near).select("order_id", F.col("_metadata.file_path").alias("path"))
    hit = {r["path"] for r in rows.join(moved.select("order_id"), "order_id", "left_semi").select("path").distinct().collect()}
    return [f for f in near if f["path"] in hit]


def paid_per_order(spark: SparkSession, root: str) -> DataFrame:
    """The sums as they were last brought up to date; orders without payments have no row."""
    have = _current(spark, root)
    if have is None:
        raise ValueError(f"no sums under {root}")
    return _read(spark, have["files"])
