"""Reading and writing the clinic tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.model import Clinic
from clinicframe.schemas import LOAD_ORDER, TABLES


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A base table from Parquet, with its declared schema."""
    return spark.read.schema(TABLES[table]).parquet(path)


def read_clinic(spark: SparkSession, root: str) -> Clinic:
    """All base tables below one folder, one subfolder per table."""
    return Clinic(**{name: read_table(spark, f"{root}/{name}", name) for name in Clinic.table_names()})


def write_clinic(clinic: Clinic, root: str) -> None:
    """Write every table to a new folder, parents first; an existing one is an error."""
    for name in LOAD_ORDER:
        clinic.table(name).write.mode("errorifexists").parquet(f"{root}/{name}")


def register_tables(clinic: Clinic) -> None:
    """Make the base tables available to ``spark.sql`` under their own names."""
    for name, df in clinic.tables().items():
        df.createOrReplaceTempView(name)


def missing_tables(spark: SparkSession) -> list[str]:
    """Base tables the session does not know."""
    known = {t.name for t in spark.catalog.listTables()}
    return [name for name in Clinic.table_names() if name not in known]


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def row_count_profile(clinic: Clinic) -> DataFrame:
    """The number of rows of every table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in clinic.tables().items()
    ]
    return reduce(DataFrame.unionByName, counts)
