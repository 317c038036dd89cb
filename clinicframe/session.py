"""Session settings and the checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "clinicframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` entries (dots as ``__``) win over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where the result must then be shuffled again.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the one the session names in ``spark.checkpoint.dir``.

    A session without that setting, as in tests, gets a folder in the warehouse, which all executors share too.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared checkpoint folder and read again.

    Lineage ends there, in fewer bytes than a checkpoint takes; later reads take only the columns they
    need, and Spark knows the size, so that it broadcasts what is small instead of shuffling the other side.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of DataFrames made within are removed as soon as an action on them ends.

    Otherwise they stay until the driver's garbage collection finds them, which jobs of many
    small rounds hardly cause. What is to be used after the block is stored within it; a
    DataFrame that runs twice makes its shuffle files anew.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bytes of rows that go to a Python worker at once where texts do.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Actions within send rows to Python workers in batches of about ``BATCH_BYTES``, whatever the length of texts.

    Batches are bounded by rows alone otherwise, and a batch is several times in memory: in Arrow
    on both sides, and as Python strings in workers, which keep what they once needed.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
