"""Stored copies of protected tables in which a token is found without reading the table.

One copy is sorted by token and has a Bloom filter for each row group: a single term
opens the one row group whose range it falls into, and not even that if the filter
rules it out. The other is cut into buckets of tokens: a batch of terms is shuffled to
the buckets, the table is not. Tokens of protected columns are unique but for rows
without text, which all have the token of '' or none; these lie apart, so that no
bucket holds more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.functions.crypto import token
from clinicframe.operators.encryption import Secret, find_by_token
from clinicframe.schemas import PRIMARY_KEY


def write_by_token(df: DataFrame, secret: Secret, path: str, row_group_bytes: int | None = None) -> None:
    """Write the rows in order of their token. The primary key comes second and spreads rows without one."""
    order = (secret.token, PRIMARY_KEY[secret.table])
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write
    writer = writer.option(f"parquet.bloom.filter.enabled#{secret.token}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size.row.check.min", "10")
    writer.parquet(path)


def find_stored(spark: SparkSession, path: str, secret: Secret, term: str) -> DataFrame:
    """Rows of a copy written by ``write_by_token`` whose protected text equals ``term``."""
    return find_by_token(spark.read.parquet(path), secret, term)


def _has_text(secret: Secret) -> Column:
    return F.coalesce(F.col(secret.token) != F.sha2(F.lit(""), 256), F.lit(False))


def write_buckets(df: DataFrame, secret: Secret, name: str, buckets: int) -> None:
    """Write tables ``name``, cut into buckets of tokens, and ``name_without_text`` for rows that have none."""
    has_text = _has_text(secret)
    spread = df.filter(has_text).repartition(buckets, secret.token)
    spread.write.bucketBy(buckets, secret.token).sortBy(secret.token).saveAsTable(name)
    df.filter(~has_text).write.saveAsTable(f"{name}_without_text")


def find_many_stored(spark: SparkSession, name: str, secret: Secret, terms: DataFrame, term: str) -> DataFrame:
    """Rows whose protected text equals one of the terms, each once; only the terms are shuffled."""
    wanted = terms.select(token(term).alias(secret.token)).distinct()
    found = spark.table(name).join(wanted, secret.token, "left_semi")
    rest = spark.table(f"{name}_without_text")
    # At most one row: whether '' is among the terms.
    empty = wanted.filter(~_has_text(secret))
    return found.unionByName(rest.join(F.broadcast(empty), secret.token, "left_semi"))
