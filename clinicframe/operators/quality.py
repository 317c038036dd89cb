"""Checks of the rules the clinic's tables must obey; each returns the offending rows.

The row-level checks test all rules of a table in one pass over it. ``enforce``
turns any of the results into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from clinicframe.functions.amounts import parse_amount
from clinicframe.model import Clinic
from clinicframe.operators.billing import overpaid_orders
from clinicframe.schemas import (
    DOMAINS, MAX_LENGTH, PANEL_OF_TEST, PAYMENT_METHOD, PAYMENT_STATUS, PRIMARY_KEY, REFERENCES, ROLES, TABLES,
    UNIQUE_KEYS,
)

__all__ = [
    "account_rules", "duplicate_keys", "enforce", "identifier_errors", "orphans", "overpaid_orders", "panel_mismatches", "payment_input",
    "row_violations",
]

# The check conditions of the table definitions.
CHECKS = {
    "clinic_patients": {"age": "age >= 0", "sex": "sex IN ('M', 'F')"},
    "lab_test_catalog": {"price": "price > 0"},
    "payments": {"amount_paid": "amount_paid > 0"},
}
# Fixed value: the form of account names.
IDENTIFIER = "^[A-Za-z0-9_.-]{1,80}$"
#: Rows of a key that one task counts, see ``duplicate_keys``.
KEYS_PER_TASK = 250_000


def _not_null(table: str) -> dict[str, Column]:
    return {f.name: F.col(f.name).isNull() for f in TABLES[table].fields if not f.nullable}


def _checks(table: str) -> dict[str, Column]:
    return {name: ~F.expr(condition) for name, condition in CHECKS.get(table, {}).items()}


def _domains(table: str) -> dict[str, Column]:
    return {name: ~F.col(name).isin(*values) for name, values in DOMAINS.get(table, {}).items()}


def _lengths(table: str) -> dict[str, Column]:
    return {name: F.length(name) > limit for name, limit in MAX_LENGTH[table].items()}


RULES = {"not_null": _not_null, "check": _checks, "enum": _domains, "length": _lengths}


def row_violations(table: str, df: DataFrame, rule: str) -> DataFrame:
    """Rows breaking ``not_null``, ``check``, ``enum`` or ``length``, one line per broken column.

    A condition that is unknown because of a NULL is not broken. Columns the data
    does not have are not checked.
    """
    broken = {name: bad for name, bad in RULES[rule](table).items() if name in df.columns}
    names = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in broken.items()]).cast("array<string>"))
    key = F.col(PRIMARY_KEY[table]).cast("string").alias("row_key")
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), key, F.explode(names).alias("column_name"))


def duplicate_keys(table: str, df: DataFrame) -> DataFrame:
    """Values of primary and unique keys that occur more than once; NULL may repeat in a unique key.

    Nearly every row of such a key is a group of its own, so large tables are counted in tasks of ``KEYS_PER_TASK`` rows.
    """
    found, parts = [], -(-df.count() // KEYS_PER_TASK)
    for column in (PRIMARY_KEY[table], *UNIQUE_KEYS[table]):
        if column in df.columns:
            # Whole numbers become text after the grouping: they take less memory.
            key = F.col(column) if isinstance(df.schema[column].dataType, IntegralType) else F.col(column).cast("string")
            counted = _occurrences(df.filter(F.col(column).isNotNull()).select(key.alias("value")), parts)
            found.append(counted.filter("n_rows > 1").select(
                F.lit("unique").alias("rule"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                F.col("value").cast("string").alias("value"), "n_rows",
            ))
    return reduce(DataFrame.unionByName, found)


def _occurrences(values: DataFrame, parts: int) -> DataFrame:
    """How often each value occurs. A value is first counted within each partition it comes from, so a hot one never meets in one task."""
    if parts < 2:
        return values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
    apart = values.withColumn("__from", F.spark_partition_id()).repartition(parts, "value", "__from")
    within = apart.groupBy("value", "__from").agg(F.count(F.lit(1)).alias("n_rows")).drop("__from")
    return within.repartition(parts, "value").groupBy("value").agg(F.sum("n_rows").alias("n_rows"))


def orphans(clinic: Clinic, tables: tuple[str, ...] | None = None) -> DataFrame:
    """Child rows whose parent does not exist; a NULL reference is allowed.

    All children of a parent are put together first, so a parent's keys are read and
    shuffled once. The join is an outer one: an anti join would be moved into each child.
    """
    children: dict[tuple[str, str], list[DataFrame]] = {}
    for child, column, parent in REFERENCES:
        if tables is None or child in tables:
            rows = clinic.table(child).filter(F.col(column).isNotNull())
            key = F.col(PRIMARY_KEY[child]).cast("string").alias("row_key")
            children.setdefault((parent, column), []).append(rows.select(F.lit(child).alias("table_name"), key, column))
    found = []
    for (parent, column), rows in children.items():
        here = clinic.table(parent).select(column, F.lit(True).alias("__here"))
        lost = reduce(DataFrame.unionByName, rows).join(here, column, "left").filter(F.col("__here").isNull())
        found.append(lost.select(
            F.lit("reference").alias("rule"), "table_name", "row_key", F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"),
        ))
    return reduce(DataFrame.unionByName, found)


def panel_mismatches(clinic: Clinic) -> DataFrame:
    """Panel rows on orders of another test, and completed orders whose own panel row is missing.

    Every order learns which panels it has, over one partitioning by order number.
    """
    tests = clinic.lab_test_catalog.select("test_id", "test_name")
    orders = clinic.lab_test.select("order_id", "test_id", "status").join(tests, "test_id").drop("test_id")
    rows = [clinic.table(p).select("order_id", *[F.lit(p == q).alias(f"has_{q}") for q in PANEL_OF_TEST.values()]) for p in PANEL_OF_TEST.values()]
    have = reduce(DataFrame.unionByName, rows).groupBy("order_id").agg(*[F.bool_or(f"has_{p}").alias(f"has_{p}") for p in PANEL_OF_TEST.values()])
    orders = orders.join(have, "order_id", "left")
    test, done, findings = F.col("test_name"), F.col("status") == "COMPLETED", []
    for name, panel in PANEL_OF_TEST.items():
        has = F.coalesce(f"has_{panel}", F.lit(False))
        stray = F.struct(F.lit("panel of another test").alias("rule"), F.lit(panel).alias("panel"))
        lacking = F.struct(F.lit("completed without panel").alias("rule"), F.lit(panel).alias("panel"))
        findings += [F.when(has & (test != name), stray), F.when(~has & (test == name) & done, lacking)]
    found = orders.select("order_id", "test_name", F.explode(F.array_compact(F.array(*findings))).alias("finding"))
    return found.select("finding.rule", "finding.panel", "order_id", "test_name")


def payment_input(rows: DataFrame, amount: str = "amount_text") -> DataFrame:
    """Parse payment entries: adds ``amount`` in cents precision and the first ``reject_reason``."""
    parsed = rows.withColumn("amount", parse_amount(amount))
    value = F.col("amount")
    reason = (
        F.when(value.isNull(), "not a number")
        .when(value <= 0, "not positive")
        .when(value > F.lit("99999999.99").cast("decimal(20,2)"), "too large")
        .when(~F.coalesce(F.col("payment_method").isin(*PAYMENT_METHOD), F.lit(False)), "unknown method")
        .when(~F.coalesce(F.col("status").isin(*PAYMENT_STATUS), F.lit(False)), "unknown status")
    )
    return parsed.withColumn("reject_reason", reason)


def account_rules() -> dict[str, Column]:
    """The column at fault and the condition under which it is."""
    return {
        "username": ~F.col("username").rlike(IDENTIFIER),
        "mysql_username": ~F.col("mysql_username").rlike(IDENTIFIER),
        "role_name": ~F.col("role_name").isin(*ROLES),
        "patient_id": (F.col("role_name") == "role_patient") & F.col("patient_id").isNull(),
    }


def identifier_errors(users: DataFrame) -> DataFrame:
    """Accounts with a malformed name, an unknown role, or a patient role without patient."""
    names = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in account_rules().items()]))
    return users.select(F.lit("account").alias("rule"), F.col("user_id"), F.explode(names).alias("column_name"))


def enforce(violations: DataFrame) -> None:
    """Raise if a check found anything, naming one example."""
    example = violations.first()
    if example is not None:
        raise ValueError(f"rule broken: {example.asDict()}")
