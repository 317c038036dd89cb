"""Plans must push filters, prune columns, aggregate early and stay inside the JVM."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from clinicframe.plans import registry
from clinicframe.operators import access, aggregates, billing, joins, listings
from clinicframe.plans.explain import plan_text
from clinicframe.sources import tables
from clinicframe.sources.testdata import clinic_from_testdata

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The clinic as stored tables, with broadcasting off so that plans look as they do at scale."""
    root = str(tmp_path_factory.mktemp("stored") / "clinic")
    tables.write_clinic(clinic_from_testdata(spark, SF_DIR), root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield tables.read_clinic(spark, root)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scan(stored):
    assert "GreaterThanOrEqual(order_date,1997-01-01), LessThan(order_date,1998-01-01)" in plan_text(listings.orders_of_year(stored, 1997))
    assert "LessThan(hemoglobin,13.00)" in plan_text(listings.low_hemoglobin(stored))
    assert "Not(EqualTo(protein,Negative))" in plan_text(listings.abnormal_protein(stored))
    plan = plan_text(joins.completed_by_age(stored))
    assert "GreaterThanOrEqual(age,20), LessThanOrEqual(age,30)" in plan and "EqualTo(status,COMPLETED)" in plan


def test_only_needed_columns_are_read(stored):
    plan = plan_text(billing.paid_to_date(stored.payments))
    assert "ReadSchema: struct<order_id:bigint,amount_paid:decimal(10,2),status:string>" in plan
    plan = plan_text(aggregates.revenue_by_test(stored))
    assert "ReadSchema: struct<order_id:bigint,test_id:bigint>" in plan and "description" not in plan


def test_orders_are_counted_before_they_meet_the_catalog(stored):
    plan = plan_text(aggregates.revenue_by_test(stored), "simple")
    assert plan.index("SortMergeJoin") < plan.index("HashAggregate")


def test_panel_joins_share_one_partitioning(stored):
    plan = plan_text(joins.key_results(stored), "simple")
    assert plan.count("hashpartitioning(order_id") == 4
    assert "LeftOuter" in plan


def test_one_pass_over_the_orders_for_took_and_never(stored):
    plan = plan_text(aggregates.took_one_test_never_other(stored), "simple")
    outer = plan.split("Subquery", 1)[0]
    assert outer.count("SortMergeJoin") == 1 and "LeftSemi" in plan


def test_top_k_needs_no_full_sort(stored):
    plan = plan_text(listings.latest_orders(stored, 5), "simple")
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_audit_broadcasts_only_the_fixed_grants(stored, spark):
    requests = spark.createDataFrame([("user1", "cbc", "SELECT")], "username string, object_name string, privilege string")
    plan = plan_text(access.access_audit(stored, requests), "simple")
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_workers_and_no_nested_loops(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF_DIR), "simple")
    for bad in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
