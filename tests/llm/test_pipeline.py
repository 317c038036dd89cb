"""The pipeline on the smallest tables: every stage keeps what it should of the one before."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from clinicframe.llm import quality_classifier
from clinicframe.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    first = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = quality_classifier.scored(first, labels).filter("predicted = 1").count()
    assert kept["quality"].count() == good
    texts = [" ".join(r["text"].split()) for r in kept["exact_copies"].collect()]
    assert len(texts) == len(set(texts)) == len({" ".join(r["text"].split()) for r in kept["quality"].collect()})
    mixed = kept["source_mix"].count()
    assert kept["packing"].filter("piece = 0").count() == mixed > kept["near_copies"].count()
    assert corpus_pipeline.run(spark, SF_DIR).count() == kept["packing"].count()


def test_every_operator_is_registered():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
