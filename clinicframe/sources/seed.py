"""Loading seed rows from CSV files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinicframe.operators.keys import assign_ids
from clinicframe.schemas import PRIMARY_KEY, TABLES


def read_seed(
    spark: SparkSession, path: str, table: str, columns: Iterable[str], key_order: Iterable[str] = (), high_water: int = 0
) -> DataFrame:
    """Seed rows from CSV with the listed columns; left-out columns take their defaults.

    A file without the key column gets generated keys in ``key_order``. A malformed line is an error.
    """
    schema, given = TABLES[table], list(columns)
    declared = T.StructType([schema[c] for c in given])
    rows = spark.read.schema(declared).option("mode", "FAILFAST").option("header", True).option("nullValue", "").csv(path)
    key = PRIMARY_KEY[table]
    if key not in given:
        rows = assign_ids(rows, key, list(key_order) or given, high_water)
    return with_defaults(rows, table)


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Bring rows to the full schema of a table: declared defaults, now for time stamps, else NULL."""
    now = F.current_timestamp()
    # The declared column defaults.
    defaults = {
        ("lab_test", "status"): F.lit("PENDING"), ("payments", "payment_method"): F.lit("CASH"),
        ("payments", "status"): F.lit("PAID"), ("app_users", "is_active"): F.lit(True),
        ("clinic_patients", "registered_at"): now, ("payments", "payment_date"): now,
    }
    columns = []
    for field in TABLES[table].fields:
        stamp = now if field.name in ("created_at", "updated_at") else F.lit(None)
        value = F.col(field.name) if field.name in rows.columns else defaults.get((table, field.name), stamp)
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)
