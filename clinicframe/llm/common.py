"""Helpers that several operators share: input columns, blocks of documents, packed messages and rolling hashes.

Operators on long matches work in rounds between *blocks* and *owners*. A block holds
the documents of one hash of the identifier; an owner holds one range of hash values.
A block sends each owner one row of packed arrays with what it has found, one entry per
distinct value, so a value that a third of all documents contain reaches its owner once
per block. The owner answers each block in the same way. Both counts follow
``spark.sql.shuffle.partitions``, so the work per task stays the same as data grows.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.session import ensure_checkpoint_dir

BLOCKS_PER_PARTITION = 1
#: A missing doc_id sorts after every other.
LAST_ID = np.iinfo(np.int64).max
U64 = np.dtype("<u8")
I64 = np.dtype("<i8")
U32 = np.dtype("<u4")
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MULTIPLIER_2 = 0xD6E8FEB86659FD93 | 1


def block_count(spark: SparkSession) -> int:
    """Blocks of documents, and owners of hash ranges, for the session's shuffle partitions."""
    return BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text without nulls; all other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_order, text): doc_id, or the last number where it is missing, so that it crosses to Python as a whole number."""
    return id_and_text(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_order"), "text")


def identifier(column: str = "doc_order") -> Column:
    """The doc_id that ``in_order`` numbered."""
    return F.nullif(F.col(column), F.lit(LAST_ID))


FILTER_BITS = 1 << 23


def blocked_texts(docs: DataFrame, blocks: int, only: np.ndarray | None = None) -> DataFrame:
    """(block, doc_order, packed): each document's UTF-8 text, compressed, dealt by block.

    The block depends on identifier and text, so repeats of one identifier spread out
    and a task that runs again deals alike. ``only`` is a filter made by ``id_filter``:
    documents outside it are left out, a few others may come along.
    """
    base = in_order(docs).select(
        F.pmod(F.xxhash64("doc_order", "text"), F.lit(blocks)).cast("int").alias("block"), _filter_bit("doc_order").alias("bit"), "doc_order", "text"
    )

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for frame in frames:
            if only is not None:
                bit = frame["bit"].to_numpy()
                frame = frame[(only[bit >> 6] >> (bit & 63).astype(U64) & np.uint64(1)).astype(bool)]
            yield pd.DataFrame({"block": frame["block"], "doc_order": frame["doc_order"], "packed": [squeeze(t.encode()) for t in frame["text"]]})

    return base.mapInPandas(pack, "block int, doc_order long, packed binary")


def _filter_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS)).cast("long")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A filter of one megabyte, whatever the number of identifiers: a bit per hash value, made by the executors."""
    bit = _filter_bit(column)
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, U64)
    for row in words.toPandas().itertuples():
        out[row.word] = np.int64(row.bits).astype(U64)
    return out


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared checkpoint folder and read again: lineage ends there, in fewer bytes than a checkpoint takes."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest(df: DataFrame, order: list[Column | str], rows: int) -> DataFrame:
    """The ``rows`` rows of the smallest ``order``, the first of which is a 64-bit hash; checkpointed.

    Sorting cuts each partition to ``rows`` rows, and all of these would meet in one place.
    So rows are counted, and only hashes below a bound that lets some more than ``rows``
    pass are sorted; where hashes repeat so much that too few do, all are.
    """
    ensure_checkpoint_dir(df.sparkSession)
    number = df.count()
    bound = int((rows + 8 * rows**0.5) / max(1, number) * (1 << 64)) - (1 << 63)
    first = lambda d: d.orderBy(*order).limit(rows).checkpoint()
    if bound < LAST_ID:
        found = first(df.filter((F.expr(order[0]) if isinstance(order[0], str) else order[0]) < F.lit(bound)))
        if found.count() == min(rows, number):
            return found
    return first(df)


def unpacked(frame: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    """(order, UTF-8 text) of each document of a block."""
    expand = zstandard.ZstdDecompressor().decompress
    for order, packed in zip(frame["doc_order"], frame["packed"]):
        yield int(order), expand(packed)


def release() -> None:
    """Give memory that a task no longer uses back to the system: Python workers outlive their tasks, and several share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    out = values ^ (values >> np.uint64(31))
    out = out * np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x81DADEF4BC2DD44D)
    return out ^ (out >> np.uint64(33))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2 ** 64, extended on demand."""

    def __init__(self, multiplier: int) -> None:
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, m, U64)])) for m in (self.multiplier, self.inverse))
        return self.up[:n], self.down[:n]


POWERS, POWERS_2 = Powers(_MULTIPLIER), Powers(_MULTIPLIER_2)


class Rolling:
    """Hashes of runs of values, from prefix sums of value times multiplier ** position modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, powers: Powers = POWERS) -> None:
        up, self.down = powers.get(max(1, len(values)))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[: len(values)], dtype=U64)])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


WORD_POWERS = Powers(0xA3B195354A39B70D)
#: Bytes of a text that are hashed at once, and the length from which a word is hashed on its own.
SLICE, LONG_WORD = 1 << 16, 128
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTERS = mix(np.arange(1, 257, dtype=U64) * np.uint64(_MULTIPLIER))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of the text, in order; all words of a slice of it at once."""
    if len(text) <= SLICE:
        return _hashes_of_slice(text)
    out, start = [], 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE)
        piece = text[start : gap.start() if gap else len(text)]
        # A very long word is hashed alone, so that no array is as long as it.
        out += [_hashes_of_slice(piece)] if len(piece) <= 2 * SLICE else [_hashes_of_slice(w) if len(w) < LONG_WORD else _hash_of_long(w) for w in piece.split()]
        start += len(piece)
    return np.concatenate(out) if out else np.zeros(0, U64)


def _hash_of_long(word: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(word)], U64)


def _hashes_of_slice(text: bytes) -> np.ndarray:
    letters = np.frombuffer(text, np.uint8)
    edge = np.ones(len(letters) + 2, bool)
    edge[1:-1] = _IS_GAP[letters]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turns[::2], turns[1::2]
    rolling = Rolling(_LETTERS[letters], WORD_POWERS)
    out = mix((rolling.sums[ends] - rolling.sums[starts]) * rolling.down[starts])
    for k in np.flatnonzero(ends - starts >= LONG_WORD):
        out[k] = _hash_of_long(text[starts[k] : ends[k]])[0]
    return out


def deal(keys: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, positions in keys) for each owner that gets any."""
    owner = (keys >> np.uint64(20)) % np.uint64(owners)
    order = np.argsort(owner, kind="stable")
    if len(order):
        bounds = np.flatnonzero(np.diff(owner[order], prepend=owner[order[0]] + np.uint64(1)))
        for part in np.split(order, bounds[1:]):
            yield int(owner[part[0]]), part


def joined(cells: Iterable[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal rows of sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def members(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a value is in the sorted table, where)."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at
