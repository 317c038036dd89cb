"""Every registered query equals its reference SQL at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import oracle_check
import pytest

import __spark_entry__ as entry
from clinicframe.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_check.connect(SF_DIR)


def test_every_query_has_reference_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, connection, name):
    assert oracle_check.compare(spark, connection, SF_DIR, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "patient_name", "test_name", "order_date", "key_result"]
    assert df.count() == 1500
