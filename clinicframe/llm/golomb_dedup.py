"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every document's normalised text gets a SHA-256 digest. The table (doc_id, digest,
   sender) is checkpointed; a sender is a run of up to ``SENDER_ROWS`` rows of one part
   of it, so senders stay what they are when a task runs again.
2. Each sender sorts the first ``BITS`` bits of its distinct digests, cuts them by owner
   and sends each owner the Golomb-Rice code of the differences.
3. An owner decodes its lists, finds the fingerprints that two senders hold and answers
   each sender with one bit per fingerprint. What a sender holds twice it knows itself.
4. Only documents whose fingerprint is marked are suspects. Their texts are grouped byte
   by byte; a fingerprint that merely collides leaves groups of one.

Nulls: a null text is empty, a null doc_id sorts after every other and is returned as
null. Repeated rows are documents of their own; where the smallest doc_id of a group
occurs more than once, all of its rows are the one that stays. An empty table gives no
rows; further input columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import U64, block_count, identifier, in_order
from clinicframe.operators.skew import join_grouped
from clinicframe.session import ensure_checkpoint_dir

BITS = 48
SENDER_ROWS = 1 << 18


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[ \t-\r]+", " ")


def rice_parameter(count: int, span: int) -> int:
    """Bits of a remainder, for ``count`` sorted values below ``span``."""
    return max(0, int(span // max(1, count)).bit_length() - 1)


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct values below ``span``: all quotients of the differences in unary, then all remainders in binary."""
    k = rice_parameter(len(values), span)
    steps = np.diff(values, prepend=U64.type(0))
    quotients, remainders = (steps >> np.uint64(k)).astype(np.int64), steps & np.uint64((1 << k) - 1)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    binary = (remainders[:, None] >> np.arange(k - 1, -1, -1, dtype=U64)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, binary.astype(np.uint8).ravel()])).tobytes()


def golomb_decode(code: bytes, count: int, span: int) -> np.ndarray:
    k = rice_parameter(count, span)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    first = int(ends[-1]) + 1 if count else 0
    binary = bits[first : first + count * k].reshape(count, k).astype(U64)
    remainders = (binary << np.arange(k - 1, -1, -1, dtype=U64)).sum(axis=1, dtype=U64)
    return np.cumsum((quotients.astype(U64) << np.uint64(k)) + remainders, dtype=U64)


def fingerprints(digests: pd.Series) -> np.ndarray:
    """The first ``BITS`` bits of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(U64) >> np.uint64(64 - BITS)


def _messages(frames: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """One row per sender and owner; a sender's rows stand together in its part."""
    held: list[pd.DataFrame] = []

    def send() -> pd.DataFrame:
        frame = pd.concat(held)
        values = np.unique(fingerprints(frame["digest"]))
        owner = values // np.uint64(span)
        out = []
        for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(owner)) + 1):
            base = owner[part[0]] * np.uint64(span)
            out.append((int(owner[part[0]]), int(frame["sender"].iloc[0]), len(part), golomb_encode(values[part] - base, span)))
        return pd.DataFrame(out, columns=["owner", "sender", "count", "code"])

    for frame in frames:
        for sender, rows in frame.groupby("sender", sort=False):
            if held and held[-1]["sender"].iloc[0] != sender:
                yield send()
                held.clear()
            held.append(rows)
    if held:
        yield send()


def _answers(frame: pd.DataFrame, span: int) -> pd.DataFrame:
    """Of one owner: for each sender a bit per fingerprint, set if another sender has it too; senders without any are left out."""
    lists = [golomb_decode(c, n, span) for c, n in zip(frame["code"], frame["count"])]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    out = []
    for owner, sender, own in zip(frame["owner"], frame["sender"], lists):
        marks = np.isin(own, shared, assume_unique=True)
        if marks.any():
            out.append((owner, sender, len(own), np.packbits(marks).tobytes()))
    return pd.DataFrame(out, columns=["owner", "sender", "count", "marks"])


def _suspects(rows: pd.DataFrame, answers: pd.DataFrame, span: int) -> pd.DataFrame:
    """Of one sender: its documents with a mark for those that may have a copy."""
    values = fingerprints(rows["digest"])
    distinct, where, counts = np.unique(values, return_inverse=True, return_counts=True)
    marked = counts > 1
    for owner, count, marks in zip(answers["owner"], answers["count"], answers["marks"]):
        first = int(np.searchsorted(distinct, np.uint64(owner) * np.uint64(span)))
        marked[first : first + count] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=count).astype(bool)
    return pd.DataFrame({"doc_order": rows["doc_order"], "digest": rows["digest"], "suspect": marked[where]})


def mark_suspects(docs: DataFrame) -> DataFrame:
    """(doc_order, digest, suspect) for every document, after the exchange of fingerprints."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    span = (1 << BITS) // block_count(spark) + 1
    digests = (
        in_order(docs)
        .select("doc_order", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("slot"))
        .select("doc_order", "digest", F.floor(F.col("slot") / SENDER_ROWS).alias("sender"))
        .checkpoint()
    )
    messages = digests.mapInPandas(lambda frames: _messages(frames, span), "owner long, sender long, count long, code binary")
    answers = messages.groupBy("owner").applyInPandas(lambda f: _answers(f, span), "owner long, sender long, count long, marks binary")
    return (
        digests.groupBy("sender").cogroup(answers.groupBy("sender"))
        .applyInPandas(lambda a, b: _suspects(a, b, span), "doc_order long, digest binary, suspect boolean")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    marked = mark_suspects(docs).checkpoint()
    plain = marked.filter(~F.col("suspect")).select(
        "doc_order", F.col("doc_order").alias("keep_order"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    suspects = marked.filter("suspect")
    # The few suspects decide which texts are read on; equal texts meet by their bytes, summed up before they move.
    texts = join_grouped(in_order(docs), suspects.select("doc_order").distinct(), "doc_order").select("doc_order", normalised(F.col("text")).alias("text"))
    groups = texts.groupBy("text").agg(F.min("doc_order").alias("keep_order"), F.count("*").alias("group_size"))
    groups = groups.select("keep_order", "group_size", F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = suspects.join(groups, "digest").select("doc_order", "keep_order", "group_size", "digest")
    return plain.unionByName(copies).select(
        identifier().alias("doc_id"),
        identifier("keep_order").alias("keep_id"),
        "group_size",
        (F.col("doc_order") == F.col("keep_order")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows repeated with one doc_id and one text, one."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    digest = F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = docs.withColumn("__own", digest)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")))
    return rows.dropDuplicates(["doc_id", "__own"]).select(*[rows[c] for c in docs.columns])
