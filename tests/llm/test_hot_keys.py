"""One payload, identifier or leaf with a third of all rows is split between tasks; samples reach the driver at their own size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinicframe.llm import embedding_dedup, golomb_dedup, warc_chunks
from clinicframe.llm.common import smallest

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def easily_split(spark):
    before = {name: spark.conf.get(name, None) for name in SMALL}
    for name, value in SMALL.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def text(k: str) -> str:
    return f"sha2(cast({k} as string), 512)"


def test_hot_payload_is_split(easily_split):
    pages = easily_split.range(6000).select(
        F.col("id").alias("page_id"), F.expr(f"concat('http://a/', {text('-id')})").alias("url"),
        F.expr(f"case when id % 3 = 0 then repeat('same ', 300) when id % 3 = 1 then concat({', '.join(text(f'id + {k}') for k in range(9))}) else '' end").alias("html"),
    ).repartition(12)
    plan = warc_chunks.planned(pages)
    assert "skew=true" in executed_plan(plan)
    rows = {r["page_id"]: r for r in plan.collect()}
    assert len(rows) == 6000 and rows[5997]["record_type"] == "response" and rows[5997]["refers_to"] is None
    assert all(rows[i]["refers_to"] == 5997 for i in range(0, 5997, 3))
    assert all(rows[i]["record_type"] == "response" for i in range(6000) if i % 3)


def test_rows_without_identifier_are_split(easily_split):
    docs = easily_split.range(6000).select(
        F.expr("case when id % 3 > 0 then id end").alias("doc_id"),
        F.expr(f"case when id % 30 = 0 then 'a copy' when id = 1 then 'a  copy' else concat({text('id')}, {text('id + 1')}) end").alias("text"),
    ).repartition(12)
    found = golomb_dedup.exact_groups(docs)
    assert "skew=true" in executed_plan(found)
    rows = found.collect()
    assert len(rows) == 6000 and sum(r["kept"] for r in rows) == 6000 - 200
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["group_size"] > 1} == {(1, 201)}


def test_sample_is_that_of_a_whole_sort(spark):
    """For hashes that spread, all equal and fewer than asked for, also without rows."""
    for rows, hashed in ((20_000, "xxhash64(id)"), (3000, "0L"), (3000, "9223372036854775807L"), (50, "xxhash64(id)"), (0, "xxhash64(id)")):
        df = spark.range(rows).repartition(7)
        got = [r["id"] for r in smallest(df, [F.expr(hashed), "id"], 100).collect()]
        assert got == [r["id"] for r in df.orderBy(F.expr(hashed), "id").limit(100).collect()]


def test_sample_does_not_grow_with_the_partitions(spark):
    """The task that merges the sample reads few rows more than it returns, however many parts the table has."""
    df = spark.range(60_000).repartition(40).checkpoint()
    bound = int((500 + 8 * 500**0.5) / 60_000 * (1 << 64)) - (1 << 63)
    passed = df.filter(F.xxhash64("id") < bound).count()
    assert 500 <= passed < 1000
    assert smallest(df, [F.xxhash64("id")], 500).rdd.getNumPartitions() == 1


def test_many_vectors_of_one_leaf_find_their_copies(easily_split, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 64)
    draw = np.random.default_rng(5)
    middle = draw.normal(size=8)
    rows = [(k, [float(x) for x in (middle + 0.3 * draw.normal(size=8) if k % 3 == 0 else draw.normal(size=8))], 1) for k in range(900)]
    found = embedding_dedup.near_copies(easily_split.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in found.collect()} == dict(enumerate(links.tolist()))
