"""Repeated passages of words, found with difference-cover anchors.

A passage is ``window`` consecutive words. Positions are taken modulo a period; at those
in a difference cover the next ``anchor`` words are hashed. For any two places there is a
shift below the period that brings both to cover positions, so two equal passages always
share an aligned anchor, although only about one position in five is hashed.

1. Every block of documents sends the hashes of its anchors to their owners, which
   answer with those that more than one document has.
2. A block extends each such anchor to all passages that contain it, hashes these whole
   (128 bits) and sends each once, with the smallest and the largest doc_id that has it.
   Owners answer with the smallest doc_id of all, where it is not the only one.
3. Words covered by a passage that a smaller doc_id has too are removed.

No pairs are formed, and a passage in a third of all documents is one entry per block.

Nulls: a null text has no words; a null doc_id sorts after every other, so it is never
the one that keeps. Rows repeated with one doc_id do not remove words from each other.
Texts of fewer words than the window stay whole. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from clinicframe.llm.common import I64, POWERS_2, U64, Rolling, block_count, blocked_texts, deal, identifier, joined, members, mix, run_starts, unpacked, word_hashes

WINDOW = 50
#: A perfect difference set; every distance modulo 31 is a difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def difference_cover(period: int) -> tuple[int, ...]:
    """Positions modulo the period among whose differences every number occurs: a run of r and every r-th."""
    if period == PERIOD:
        return COVER
    r = max(1, round(period**0.5))
    return tuple(sorted({*range(min(r, period)), *range(0, period, r), period - 1}))


class Passages:
    """Hashes of one document's words, anchors and passages."""

    def __init__(self, text: bytes, window: int) -> None:
        self.hashes = word_hashes(text)
        self.window, self.n = window, len(self.hashes)
        self.period = min(PERIOD, window)
        self.anchor = window - self.period + 1
        self.rolling = Rolling(self.hashes)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) at the cover positions."""
        cover = np.array(difference_cover(self.period))
        places = (np.arange(0, max(0, self.n - self.anchor + 1), self.period)[:, None] + cover).ravel()
        places = places[places <= self.n - self.anchor]
        return places, self.rolling.at(places, self.anchor)

    def around(self, places: np.ndarray) -> np.ndarray:
        """Starts of the passages that contain an anchor at one of the places."""
        change = np.zeros(self.n + 2, np.int32)
        first = np.maximum(0, places - (self.window - self.anchor))
        last = np.minimum(places, self.n - self.window)
        np.add.at(change, first[first <= last], 1)
        np.add.at(change, last[first <= last] + 1, -1)
        return np.flatnonzero(np.cumsum(change) > 0)

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        second = Rolling(mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), POWERS_2)
        return self.rolling.at(starts, self.window), second.at(starts, self.window)


def _anchors(frame: pd.DataFrame, owners: int, window: int) -> pd.DataFrame:
    found = [np.unique(p.anchors()[1]) for _, text in unpacked(frame) if (p := Passages(text, window)).n >= window]
    keys, counts = np.unique(np.concatenate([*found, np.zeros(0, U64)]), return_counts=True)
    many = (counts > 1).astype(np.uint8)
    block = int(frame["block"].iloc[0])
    rows = [(owner, block, keys[at].tobytes(), many[at].tobytes()) for owner, at in deal(keys, owners)]
    return pd.DataFrame(rows, columns=["owner", "block", "keys", "many"])


def shared_keys(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: for each block its keys that occur elsewhere too, or more than once in the block."""
    keys, many = joined(frame["keys"], U64), joined(frame["many"], np.dtype(np.uint8))
    block = np.repeat(frame["block"].to_numpy(), [len(m) for m in frame["many"]])
    distinct, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    np.add.at(counts, where, many)
    keep = counts[where] > 1
    rows = [(int(b), keys[keep & (block == b)].tobytes()) for b in np.unique(block[keep])]
    return pd.DataFrame(rows, columns=["block", "keys"])


def _passages(frame: pd.DataFrame, answers: pd.DataFrame, owners: int, window: int) -> pd.DataFrame:
    columns = ["owner", "block", "first", "second", "low", "high"]
    shared = np.sort(joined(answers["keys"], U64))
    found: list[tuple[np.ndarray, ...]] = []
    for order, text in unpacked(frame) if len(shared) else ():
        p = Passages(text, window)
        if p.n < window:
            continue
        places, keys = p.anchors()
        starts = p.around(places[members(keys, shared)[0]])
        if len(starts):
            found.append((*p.names(starts), np.full(len(starts), order, I64)))
    if not found:
        return pd.DataFrame([], columns=columns)
    first, second, order = (np.concatenate(x) for x in zip(*found))
    at = np.lexsort((second, first))
    first, second, order = first[at], second[at], order[at]
    runs = run_starts(first, second)
    parts = (first[runs], second[runs], np.minimum.reduceat(order, runs), np.maximum.reduceat(order, runs))
    block = int(frame["block"].iloc[0])
    return pd.DataFrame([(owner, block, *(x[at].tobytes() for x in parts)) for owner, at in deal(parts[0], owners)], columns=columns)


def _earliest(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: for each block the passages that a smaller doc_id than its largest has, with the smallest."""
    first, second, low, high = (joined(frame[c], d) for c, d in (("first", U64), ("second", U64), ("low", I64), ("high", I64)))
    block = np.repeat(frame["block"].to_numpy(), [len(x) // 8 for x in frame["first"]])
    at = np.lexsort((second, first))
    first, second, low, high, block = first[at], second[at], low[at], high[at], block[at]
    runs = run_starts(first, second)
    least = np.repeat(np.minimum.reduceat(low, runs), np.diff(np.append(runs, len(first))))
    keep = least < high
    first, second, least, block = first[keep], second[keep], least[keep], block[keep]
    rows = [(int(b), *(x[block == b].tobytes() for x in (first, second, least))) for b in np.unique(block)]
    return pd.DataFrame(rows, columns=["block", "first", "second", "least"])


def _cut(frame: pd.DataFrame, answers: pd.DataFrame, window: int) -> pd.DataFrame:
    first, second, least = (joined(answers[c], d) for c, d in (("first", U64), ("second", U64), ("least", I64)))
    at = np.argsort(first, kind="stable")
    first, second, least = first[at], second[at], least[at]
    out = []
    for order, text in unpacked(frame):
        words = text.split()
        removed = np.zeros(len(words), bool)
        if len(first) and len(words) >= window:
            p = Passages(text, window)
            known, where = members(p.rolling.all(window), first)
            starts = np.flatnonzero(known)
            where = where[starts]
            starts = starts[(least[where] < order) & (p.names(starts)[1] == second[where])]
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + window, -1)
            removed = np.cumsum(change[:-1]) > 0
        kept = b" ".join(words) if not removed.any() else b" ".join(w for w, r in zip(words, removed) if not r)
        out.append((order, len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return pd.DataFrame(out, columns=["doc_order", "n_words", "n_removed", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words for every document."""
    blocks = block_count(docs.sparkSession)
    texts = blocked_texts(docs, blocks)
    by_block = lambda df: df.groupBy("block")
    sent = by_block(texts).applyInPandas(lambda f: _anchors(f, blocks, window), "owner int, block int, keys binary, many binary")
    shared = sent.groupBy("owner").applyInPandas(shared_keys, "block int, keys binary")
    passages = by_block(texts).cogroup(by_block(shared)).applyInPandas(
        lambda f, a: _passages(f, a, blocks, window),
        "owner int, block int, first binary, second binary, low binary, high binary",
    )
    earliest = passages.groupBy("owner").applyInPandas(_earliest, "block int, first binary, second binary, least binary")
    cut = by_block(texts).cogroup(by_block(earliest)).applyInPandas(
        lambda f, a: _cut(f, a, window), "doc_order long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
    return cut.select(identifier().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return deduplicated(docs, window).drop("kept")
