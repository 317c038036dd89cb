"""Key allocation for batches: running numbers and gap-filling patient numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinicframe.functions.text import patient_code, patient_number
from clinicframe.session import stored

# Fixed value: numbers per bucket of Spark's bitmap functions.
BUCKET = 32768
PLACE_BITS = 33


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """Append consecutive numbers in the given total order, without a single-task sort.

    The rows are range-partitioned and sorted once, and frozen by storing them so
    that a retried task cannot renumber them. Only one row per partition (its size)
    passes through the running sum that yields the partition's first number.
    """
    spread = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stored(spread.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.col("__place") - F.shiftleft(part, PLACE_BITS)
    numbered = placed.withColumn("__part", part).join(F.broadcast(first), "__part")
    return numbered.withColumn(name, F.col("__before") + within + start).drop("__part", "__before", "__place")


def high_water_mark(table: DataFrame, key: str) -> int:
    """The largest key in use, 0 for an empty table."""
    return table.agg(F.max(key)).first()[0] or 0


def assign_ids(rows: DataFrame, key: str, order_by: Sequence[str | Column], high_water: int) -> DataFrame:
    """Number new rows from just above the high-water mark, so deleted keys are never used again."""
    return number_rows(rows.drop(key), order_by, key, high_water + 1)


def _bit_is_clear(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 0


def free_patient_numbers(patients: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest positive numbers no ``PAT-<digits>`` identifier uses, as ``(rank, number)``.

    Used numbers are condensed into one bitmap per 32768 numbers, which also drops
    duplicates such as PAT-1 and PAT-001. The running count of free numbers goes over
    the buckets, not the patients, and only buckets that supply a number are opened.
    """
    spark = patients.sparkSession
    # At most one number per patient is used, so the k smallest free ones end here.
    buckets = -(-(patients.count() + k) // BUCKET)
    used = patients.select(patient_number("patient_id").alias("n")).filter(F.col("n").between(1, buckets * BUCKET))
    bitmaps = used.groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bitmap")
    )
    used_up = bitmaps.select("bucket", F.bitmap_count("bitmap").alias("used"))
    spine = spark.range(1, buckets + 1).withColumnRenamed("id", "bucket").join(used_up, "bucket", "left")
    before = F.sum("free").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counted = spine.select("bucket", (F.lit(BUCKET) - F.coalesce("used", F.lit(0))).alias("free"))
    counted = counted.withColumn("before", F.coalesce(before, F.lit(0)))
    opened = counted.filter((F.col("before") < k) & (F.col("free") > 0)).join(bitmaps, "bucket", "left").select(
        "bucket", "before", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(BUCKET - 1))).alias("position")
    )
    clear = opened.filter(F.col("bitmap").isNull() | _bit_is_clear(F.col("bitmap"), F.col("position")))
    in_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy("position"))
    ranked = clear.select(
        (F.col("before") + in_bucket).alias("rank"), ((F.col("bucket") - 1) * BUCKET + F.col("position") + 1).alias("number")
    )
    return ranked.filter(F.col("rank") <= k)


def next_patient_ids(patients: DataFrame, k: int) -> DataFrame:
    """The next ``k`` patient identifiers to hand out, gaps first, with their rank."""
    return free_patient_numbers(patients, k).select("rank", patient_code(F.col("number")).alias("patient_id"))
