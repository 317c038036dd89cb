"""Clinic tables derived from the star-schema Parquet files (see FIXTURES.md section 2).

Grouped tables are grouped by the derived key itself, so a later join on that
key reuses the shuffle of the grouping.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.model import Clinic
from clinicframe.schemas import TABLES

START = "TIMESTAMP_NTZ '2020-01-01 00:00:00'"

# Declared, so that opening a table reads no file footers.
STAR_SCHEMA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _typed(df: DataFrame, table: str, **columns: str) -> DataFrame:
    """Select the columns of a table with their declared types; ``columns`` gives SQL for those that are not there yet."""
    texts = [f"CAST({columns.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}" for f in TABLES[table].fields]
    return df.selectExpr(*texts)


def _patients(read) -> DataFrame:
    # Nations are a fixed list of 25.
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return _typed(
        placed, "clinic_patients",
        patient_id="format_string('PAT-%03d', c_custkey + 1)",
        first_name="split_part(c_name, '#', 1)", last_name="split_part(c_name, '#', 2)",
        age="18 + c_custkey % 63", sex="IF(c_custkey % 2 = 0, 'F', 'M')",
        address="IF(c_custkey % 17 <> 0, concat(c_mktsegment, ' District, ', n_name, ', ', r_name), NULL)",
        contact="IF(c_custkey % 29 <> 0, format_string('09%09d', c_custkey), NULL)",
        registered_at=START, created_at=START, updated_at=START,
    )


def _catalog(read) -> DataFrame:
    name = "CASE p_partkey WHEN 0 THEN 'CBC' WHEN 1 THEN 'URINALYSIS' WHEN 2 THEN 'FECALYSIS' ELSE concat(upper(p_name), ' ', p_partkey) END"
    return _typed(
        read("part"), "lab_test_catalog", test_id="p_partkey + 1", test_name=name, price="p_retailprice", description="p_type",
        created_at=START, updated_at=START,
    )


def _orders(read) -> DataFrame:
    return _typed(
        read("orders"), "lab_test", order_id="o_orderkey + 1",
        patient_id="format_string('PAT-%03d', IF(o_custkey % 10 = 3, o_custkey - 1, o_custkey) + 1)",
        test_id="IF(o_orderkey % 4 < 3, o_orderkey % 4 + 1, 4 + o_orderkey % 190)",
        order_date="o_orderdate", status="CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PENDING' ELSE 'CANCELLED' END",
        created_at="o_orderdate", updated_at="o_orderdate",
    )


def _lines_by_order(read, flag: str) -> DataFrame:
    """What the panels need to know of the lines of one kind, per order."""
    lines = read("lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.expr("l_orderkey + 1 AS order_id"))
    return lines.agg(*[F.expr(text) for text in (
        "max(l_quantity) AS most", "min(l_quantity) AS least", "sum(l_quantity) AS total", "min(l_linenumber) AS first_line",
        "max(l_linenumber) AS last_line", "max(l_shipdate) AS shipped",
    )])


def _cbc(read) -> DataFrame:
    return _typed(
        _lines_by_order(read, "A"), "cbc", cbc_id="order_id", wbc="4 + most / 10", rbc="3 + most / 20", hemoglobin="8 + least / 5",
        hematocrit="3 * (8 + least / 5)", platelets="150 + total", mcv="87", mch="29", neutrophils="55", lymphocytes="35",
        monocytes="5", eosinophils="4", basophils="1", created_at="shipped", updated_at="shipped",
    )


def _urinalysis(read) -> DataFrame:
    protein = "CASE first_line WHEN 1 THEN 'Negative' WHEN 2 THEN 'Trace' WHEN 3 THEN '1+' WHEN 4 THEN '2+' END"
    return _typed(
        _lines_by_order(read, "N"), "urinalysis", ua_id="order_id", appearance="'Clear'", color="'Yellow'", ph="5 + most / 25",
        specific_gravity="1.010", glucose="'Negative'", protein=protein, ketones="'Negative'", nitrites="'Negative'",
        other_findings="IF(last_line > 5, 'RBCs Present', 'None')", created_at="shipped", updated_at="shipped",
    )


def _fecalysis(read) -> DataFrame:
    parasite = "CASE first_line WHEN 1 THEN 'None' WHEN 2 THEN 'Giardia spp.' WHEN 3 THEN 'Ascaris spp.' WHEN 4 THEN 'Hookworm spp.' END"
    return _typed(
        _lines_by_order(read, "R"), "fecalysis", fa_id="order_id", appearance="'Brown'", consistency="IF(last_line > 4, 'Soft', 'Formed')",
        occult_blood="'Negative'", parasite_id=parasite, wbc="'1/hpf'", rbc="'1/hpf'", bacteria="'Few'", other_findings="'None'",
        created_at="shipped", updated_at="shipped",
    )


def _payments(read) -> DataFrame:
    grouped = read("lineitem").groupBy(F.expr("l_orderkey + 1 AS order_id"), "l_linenumber")
    # The largest flag letter by its code: a number keeps the grouping hash-based.
    lines = grouped.agg(*[F.expr(text) for text in ("max(l_quantity) AS most", "max(l_shipdate) AS shipped", "max(ascii(l_returnflag)) AS flag")])
    number = "(order_id - 1) * 8 + l_linenumber"
    return _typed(
        lines, "payments", payment_id=number, amount_paid="most * 10", payment_date="shipped",
        payment_method="CASE l_linenumber % 4 WHEN 0 THEN 'CASH' WHEN 1 THEN 'CARD' WHEN 2 THEN 'GCASH' ELSE 'INSURANCE' END",
        receipt_number=f"IF(l_linenumber <> 7, concat('RCPT-', {number}), NULL)",
        status="CASE flag WHEN ascii('A') THEN 'PAID' WHEN ascii('N') THEN 'PARTIAL' ELSE 'REFUNDED' END",
        created_at="shipped", updated_at="shipped",
    )


def _users(read) -> DataFrame:
    roles = "array('role_admin', 'role_front_desk', 'role_lab_tech', 'role_doctor', 'role_patient')"
    return _typed(
        read("supplier"), "app_users", user_id="s_suppkey + 1", username="concat('user', s_suppkey)",
        password_hash="sha2(concat('user', s_suppkey), 256)", role_name=f"{roles}[int(s_suppkey % 5)]",
        patient_id="IF(s_suppkey % 5 = 4, format_string('PAT-%03d', s_suppkey + 1), NULL)",
        mysql_username="concat('clinic_user', s_suppkey)", is_active="s_suppkey % 7 <> 0",
        created_at=START, updated_at=START,
    )


def star_reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.schema(STAR_SCHEMA[name]).parquet(f"{sf_dir}/{name}.parquet")


def clinic_from_testdata(spark: SparkSession, sf_dir: str) -> Clinic:
    read = star_reader(spark, sf_dir)
    makers = {
        "clinic_patients": _patients, "lab_test_catalog": _catalog, "lab_test": _orders, "cbc": _cbc, "urinalysis": _urinalysis,
        "fecalysis": _fecalysis, "payments": _payments, "app_users": _users,
    }
    return Clinic(**{name: partial(make, read) for name, make in makers.items()})
