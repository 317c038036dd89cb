"""Moving tables with legacy names to the live names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.schemas import TABLES

# Live table name by legacy name.
LIVE_NAME = {
    "patients": "clinic_patients",
    "test_catalog": "lab_test_catalog",
    "test_orders": "lab_test",
    "cbc_results": "cbc",
    "urinalysis_results": "urinalysis",
    "fecalysis_results": "fecalysis",
}


def from_legacy(tables: dict[str, DataFrame], now: datetime) -> dict[str, DataFrame]:
    """Live tables from legacy ones: live types, missing time stamps set, missing status PENDING."""
    unknown = sorted(set(tables) - set(LIVE_NAME))
    if unknown:
        raise ValueError("not legacy tables: " + ", ".join(unknown))
    return {LIVE_NAME[name]: _to_live(df, LIVE_NAME[name], now) for name, df in tables.items()}


def _to_live(df: DataFrame, table: str, now: datetime) -> DataFrame:
    fallback = {"created_at": F.lit(str(now)), "updated_at": F.lit(str(now)), "registered_at": F.lit(str(now)), "status": F.lit("PENDING")}
    columns = []
    for field in TABLES[table].fields:
        given = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = given.cast(field.dataType)
        if field.name in fallback:
            value = F.coalesce(value, fallback[field.name].cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)
