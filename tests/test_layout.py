"""Layouts that let filters and joins skip data."""

from __future__ import annotations

import pytest
from clinic_cases import rows, rows_read
from pyspark.sql import functions as F

from clinicframe.plans.explain import plan_text
from clinicframe.sources import layout, years

N = 20_000


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(1, N + 1).select(
        F.col("id").alias("order_id"), F.format_string("PAT-%03d", F.pmod(F.xxhash64("id"), F.lit(500)) + 1).alias("patient_id"),
        (F.col("id") % 7).alias("test_id"), F.date_add(F.lit("2021-01-01"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1400))).cast("int")).alias("order_date"),
        F.element_at(F.array(*map(F.lit, ("PENDING", "COMPLETED", "COMPLETED", "COMPLETED", "CANCELLED"))), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) + 1).cast("int")).alias("status"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("note"),
    ).checkpoint()


def test_bits_take_turns(spark):
    pairs = spark.createDataFrame([(5, 3), (0, 0), (65535, 0), (0, 65535)], "a long, b long")
    assert rows(pairs.select(layout.interleaved(F.col("a"), F.col("b")))) == [(0b100111,), (0,), (0xAAAAAAAA,), (0x55555555,)]


@pytest.mark.parametrize("by, conditions", [
    (layout.by_patient_and_date, {"patient_id = 'PAT-077'": 0.5, "order_date < DATE'2021-02-01'": 0.35, "patient_id = 'PAT-077' AND order_date < DATE'2021-02-01'": 0.1}),
    (layout.by_status_and_date, {"status = 'PENDING' AND order_date <= DATE'2021-03-01'": 0.12, "status = 'CANCELLED'": 0.4, "order_date > DATE'2024-10-01'": 0.35}),
])
def test_filters_on_either_column_skip_row_groups(spark, orders, tmp_path, by, conditions):
    path = str(tmp_path / "orders")
    layout.write_clustered(orders.coalesce(1), path, by(), row_group_bytes=64 << 10)
    stored = spark.read.parquet(path)
    assert stored.columns == orders.columns and stored.count() == N
    for condition, most in conditions.items():
        found = stored.filter(condition).select("order_id")
        assert rows_read(found) <= most * N, condition
        assert sorted(rows(found)) == sorted(rows(orders.filter(condition).select("order_id")))


def test_missing_values_and_empty_tables(spark, orders, tmp_path):
    odd = orders.limit(5).withColumn("order_date", F.lit(None).cast("date")).withColumn("patient_id", F.lit("other"))
    layout.write_clustered(odd, str(tmp_path / "odd"), layout.by_patient_and_date())
    assert spark.read.parquet(str(tmp_path / "odd")).count() == 5
    layout.write_clustered(orders.limit(0), str(tmp_path / "none"), layout.by_status_and_date())
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_a_table_of_days_opens_the_folders_of_its_years(spark, orders, tmp_path):
    path = str(tmp_path / "years")
    years.write_orders_by_year(orders, path)
    days = spark.createDataFrame([("2022-03-01",), ("2022-03-02",), ("2022-03-02",), (None,)], "d string").select(F.to_date("d").alias("day"))
    found = years.orders_on_days(spark, path, days, "day")
    expected = orders.filter("order_date IN (DATE'2022-03-01', DATE'2022-03-02')")
    assert sorted(rows(found, "order_id")) == sorted(rows(expected, "order_id"))
    assert "dynamicpruning" in plan_text(found)
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert "order_year" in scans
