"""One key with a third of all rows: joins split it, groupings never gather it."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clinicframe.operators import access, aggregates, billing, changes, joins, listings
from clinicframe.plans.explain import differences, plan_text
from clinicframe.sources import intake, tables
from clinicframe.sources.testdata import clinic_from_testdata

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The clinic with a third of the orders on one patient and a third of the payments on one order."""
    whole = clinic_from_testdata(spark, SF_DIR)
    third = F.pmod(F.xxhash64("order_id"), F.lit(3)) == 0
    clinic = whole.with_tables(
        lab_test=whole.lab_test.withColumn("patient_id", F.when(third, "PAT-001").otherwise(F.col("patient_id"))).repartition(12),
        payments=whole.payments.withColumn("order_id", F.when(third, 7).otherwise(F.col("order_id"))).repartition(12),
    )
    root = str(tmp_path_factory.mktemp("skewed") / "clinic")
    tables.write_clinic(clinic, root)
    for name, value in SMALL.items():
        spark.conf.set(name, value)
    yield tables.read_clinic(spark, root)
    for name in SMALL:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


REPORTS = {
    "orders": joins.order_list,
    "audit": joins.admin_audit_log,
    "review": lambda c: joins.patient_review(c, c.clinic_patients.filter("contact is null or patient_id = 'PAT-001'")),
    "others": lambda c: billing.paid_by_others(c.payments),
    "patient orders": lambda c: joins.patient_orders(c, c.clinic_patients),
    "portal": lambda c: access.portal_for_users(c.with_tables(app_users=c.app_users.withColumns(
        {"patient_id": F.format_string("PAT-%03d", "user_id"), "role_name": F.lit("role_patient"), "is_active": F.lit(True)}))),
    "lookup": lambda c: listings.lookup_many(c.payments, c.lab_test, "order_id"),
    "delete": lambda c: changes.delete_keys(c.payments, c.lab_test.filter("status = 'CANCELLED'"), "order_id"),
    "sheets": lambda c: changes.post_results(
        c.with_tables(cbc=c.cbc.filter("order_id <> 7")), "cbc", intake.result_sheets(c), ("sheet",)).rejected,
}


@pytest.mark.parametrize("name", REPORTS)
def test_joins_split_the_hot_key(spark, skewed, name):
    df = REPORTS[name](skewed)
    n = len(df.collect())
    assert "skew=true" in plan_text(df, "simple").split("Initial Plan")[0]
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    plain = REPORTS[name](skewed)
    assert differences(df, plain).isEmpty() and n > 0
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_hot_groups_meet_joins_as_one_row(skewed):
    for df in (aggregates.blood_count_by_sex(skewed), billing.billing_by_order(skewed), aggregates.patient_overview(skewed)):
        plan = plan_text(df, "simple")
        assert "partial_" in plan or "PartialAggregate" in plan
