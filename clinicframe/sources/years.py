"""Orders stored by year."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The upper bounds of the year ranges; later years share the last one.
YEAR_BOUNDS = (2024, 2025, 2026)


def year_bucket(column: str = "order_date", bounds: Sequence[int] = YEAR_BOUNDS) -> Column:
    """The name of the year range a date falls in."""
    year, label = F.year(column), None
    for bound in bounds:
        label = F.when(year < bound, f"p{bound - 1}") if label is None else label.when(year < bound, f"p{bound - 1}")
    return label.otherwise("p_future")


def orders_by_year_bucket(orders: DataFrame, bounds: Sequence[int] = YEAR_BOUNDS) -> DataFrame:
    return orders.select("order_id", "order_date", F.year("order_date").alias("order_year"), year_bucket(bounds=bounds).alias("year_bucket"))


def write_orders_by_year(orders: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one folder per year.

    Ranges over year, date and number give files of similar size even if one year
    dominates, few files per year, and narrow date ranges within each file.
    """
    yearly = orders.withColumn("order_year", F.year("order_date"))
    spread = yearly.repartitionByRange("order_year", "order_date", "order_id")
    spread.sortWithinPartitions("order_year", "status", "order_date").write.mode(mode).partitionBy("order_year").parquet(path)


def orders_in_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Orders of a closed range of years: skips other folders, and row groups by date."""
    orders, day = spark.read.parquet(path), F.col("order_date")
    pruned = orders.filter(F.col("order_year").between(first, last))
    return pruned.filter((day >= F.lit(date(first, 1, 1))) & (day < F.lit(date(last + 1, 1, 1))))


def orders_on_days(spark: SparkSession, path: str, days: DataFrame, column: str = "order_date") -> DataFrame:
    """Orders of the days in a table: which years' folders are opened is found out from that table when the query runs.

    Spark prunes folders by a join only where the other side has a filter, hence the bounds that every year meets.
    """
    years = days.select(F.col(column).alias("order_date"), F.year(column).alias("order_year")).distinct().filter(F.col("order_year").between(1, 9999))
    return spark.read.parquet(path).join(years, ["order_year", "order_date"], "left_semi")
