"""Token lookups on stored copies: what is skipped and what is shuffled."""

from __future__ import annotations

import pytest
from clinic_cases import KEY, rows_read
from pyspark.sql import functions as F

from clinicframe.operators.encryption import CONTACT, encrypt_column, find_by_token, find_many_by_token
from clinicframe.plans.explain import plan_text
from clinicframe.sources import lookup

N = 6000


@pytest.fixture(scope="module")
def patients(spark):
    """A third of the patients have no contact."""
    people = spark.range(N).select(
        F.format_string("PAT-%05d", "id").alias("patient_id"), F.when(F.col("id") % 3 > 0, F.format_string("09%08d", "id")).alias("contact"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("address"),
    )
    return encrypt_column(people, CONTACT, KEY).checkpoint()


def ids(df):
    return sorted(r[0] for r in df.select("patient_id").collect())


def test_one_term_opens_one_row_group(spark, patients, tmp_path):
    path = str(tmp_path / "by_token")
    lookup.write_by_token(patients, CONTACT, path, row_group_bytes=64 << 10)
    for term in ("0900000001", "0900004001", "", "no such contact"):
        assert ids(lookup.find_stored(spark, path, CONTACT, term)) == ids(find_by_token(patients, CONTACT, term))
    found = lookup.find_stored(spark, path, CONTACT, "0900000001")
    assert "PushedFilters: [IsNotNull(contact_token_hash), EqualTo(contact_token_hash," in plan_text(found)
    assert 1 <= rows_read(found) < N / 10
    # Absent terms fall into the range of some row group, and the filter shuts it.
    absent = [rows_read(lookup.find_stored(spark, path, CONTACT, f"absent {k}")) for k in range(5)]
    assert sum(absent) < N / 10 and absent.count(0) >= 3


def test_a_batch_does_not_shuffle_the_table(spark, patients):
    lookup.write_buckets(patients, CONTACT, "patients_by_token", 4)
    terms = spark.createDataFrame([("0900000001",), ("0900004001",), ("0900004001",), ("",), (None,), ("none",)], "term string")
    # The batch is joined by sorting, as if it were too large to send to every task.
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.find_many_stored(spark, "patients_by_token", CONTACT, terms, "term")
        assert ids(found) == ids(find_many_by_token(patients, CONTACT, terms, "term"))
        text = plan_text(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    join = text[text.index("SortMergeJoin") :]
    side = join[: join.index("Exchange")]
    assert "patients_by_token" in side and "Bucketed: true" in text
    sizes = spark.table("patients_by_token").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.min("count")).first()
    assert sizes[0] < 1.3 * sizes[1]
