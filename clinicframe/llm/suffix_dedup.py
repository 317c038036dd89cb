"""Repeated strings of bytes, from the interval tree of common prefixes of an enhanced suffix array.

A repeat is a string of ``length`` bytes or more that starts at two places. The suffix
array is built in pieces that can be built apart:

1. Of the k-grams in a string of ``length`` bytes the one with the smallest hash is its
   anchor. Equal strings have equal anchors at equal distances, so starts with one anchor
   form a stretch of text, and strings of different anchors never need to meet. Blocks
   send the anchors' hashes to owners, which answer with those that occur twice.
2. Blocks send each distinct stretch with a shared anchor once, with its first place in
   the block and whether there are more. Its bytes go along only where the anchor has
   other stretches too; one that is all its anchor has, as in copies, is known by the
   anchor. An anchor with more than ``HOT`` stretches is split up: its stretches go as
   single strings, each by its hash alone to the owner of that.
3. An owner sorts the suffixes of its stretches, takes the common prefixes of neighbours
   and scans them with a stack. Every interval of the tree with a prefix of ``length`` or
   more is a group of all places with that string; it is maximal, and reported, if the
   bytes to the left of its places differ or a place starts its stretch. An equal stretch
   is one leaf, its places counted with it. Of each interval the earliest place stays.
4. Blocks mark their bytes and report the repeats, each with the earliest place.

Memory of a task follows its block and not what repeats: bytes are copied from texts once
they have their place in a message, messages are compressed, and an owner builds the
array for some anchors at a time.

Nulls: a null text is empty; a null doc_id sorts after every other. Rows repeated with one
doc_id are ordered by nothing but their starts: strings that start at the same place of
both stay. Texts under ``length`` bytes stay whole. An empty table gives no rows; further
columns are ignored. Texts are taken whole, long ones in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from clinicframe.llm.common import (
    I64, U32, U64, Rolling, block_count, blocked_texts, deal, identifier, members, mix, release, run_starts, stored, unpacked,
)
from clinicframe.session import freed_shuffles, small_batches

LENGTH = 100
GRAM = 32
HOT = 2000
#: Owners of stretches for each block; a suffix array takes more memory than the texts it comes from.
OWNERS = 3
#: Starts of one text that are looked at together.
PART = 1 << 19
#: Stretches whose bytes are copied at once, and suffixes from which on an owner begins another array.
COPIED, SUFFIXES = 1 << 14, 1 << 17
_PLACE = np.uint64((1 << 21) - 1)
_BYTES = mix(np.arange(1, 257, dtype=U64) * np.uint64(0x2545F4914F6CDD1D))
_U8, _U16 = np.dtype(np.uint8), np.dtype("<u2")
#: Of a shared anchor: one stretch in all, several, or so many that they are split up.
_ALONE, _SEVERAL, _SPLIT = range(3)
#: Flags of an entry: the block has more places of the stretch; its bytes come along.
_MORE, _HELD = np.uint8(1), np.uint8(2)
ANCHORS = {"anchor": U64, "name": U64, "many": _U8, "stretches": U32}
SHARED = {"anchor": U64, "kind": _U8}
#: ``name`` is 0 where the anchor has this stretch only.
ENTRIES = {"anchor": U64, "name": U64, "count": _U16, "low": I64, "low_start": I64, "flags": _U8}
REPEATS = {"anchor": U64, "name": U64, "count": _U16, "step": _U16, "long": _U16, "first": I64, "first_start": I64}


def squeezed(columns: Iterable[np.ndarray], own: np.ndarray, content: np.ndarray | bytes = b"") -> bytes:
    """A message: the rows ``own`` of the columns, and bytes that belong to them."""
    message = b"".join([len(own).to_bytes(8, "little"), *(c[own].tobytes() for c in columns), content])
    return zstandard.ZstdCompressor(level=1).compress(message)


def opened(cells: Iterable[bytes], types: dict[str, np.dtype]) -> tuple[list[np.ndarray], list[int], np.ndarray]:
    """(columns, rows of each message, bytes) of messages, one after another."""
    expand, rows = zstandard.ZstdDecompressor().decompress, []
    pieces: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (*types.values(), _U8)]
    for cell in cells:
        message = expand(cell)
        n, at = int.from_bytes(message[:8], "little"), 8
        for found, dtype in zip(pieces, types.values()):
            found.append(np.frombuffer(message, dtype, n, at))
            at += n * dtype.itemsize
        pieces[-1].append(np.frombuffer(message, _U8, -1, at) if at < len(message) else np.zeros(0, _U8))
        rows.append(n)
    *columns, content = (np.concatenate(x) for x in pieces)
    return columns, rows, content


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, its positions) of each block."""
    at = np.argsort(block, kind="stable")
    if len(at):
        starts = run_starts(block[at])
        for part in np.split(at, starts[1:]):
            yield int(block[part[0]]), part


class Stretches:
    """The stretches of (part of) one text: anchor, name, first start and number of starts of each."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        gram = min(GRAM, length)
        self.rolling = Rolling(_BYTES[data])
        grams = self.rolling.all(gram)
        width, n = length - gram + 1, len(data) - length + 1
        keys = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, U64)
        keys[: len(grams)] = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        table = keys.reshape(-1, width)
        upto = np.minimum.accumulate(table, axis=1).ravel()
        since = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(since[:n], upto[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        self.start = run_starts(place)
        self.count = np.diff(np.append(self.start, n))
        self.anchor = grams[place[self.start]]
        self.name = self._names(self.start, self.count, length)

    def _names(self, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
        sums, end = self.rolling.sums, start + count + length - 1
        return mix((sums[end] - sums[start]) * self.rolling.down[start] + count.astype(U64))

    def select(self, keep: np.ndarray) -> "Stretches":
        self.start, self.count, self.anchor, self.name = self.start[keep], self.count[keep], self.anchor[keep], self.name[keep]
        return self

    def split(self, which: np.ndarray, length: int) -> None:
        """Cut the chosen stretches into single strings."""
        if which.any():
            times = np.where(which, self.count, 1)
            step = np.where(np.repeat(which, times), spread(np.zeros(len(times), np.int64), times), 0)
            count = np.where(np.repeat(which, times), 1, np.repeat(self.count, times))
            self.start, self.anchor, self.count = np.repeat(self.start, times) + step, np.repeat(self.anchor, times), count
            self.name = self._names(self.start, self.count, length)


def parts(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, bytes) of overlapping parts that hold every string of ``length`` bytes once."""
    data = np.frombuffer(text, np.uint8)
    for first in range(0, max(0, len(data) - length + 1), PART):
        yield first, data[first : first + PART + length - 1]


def _anchors(frame: pd.DataFrame, owners: int, length: int) -> pd.DataFrame:
    found = [(s.anchor, s.name) for _, text in unpacked(frame) for _, data in parts(text, length) for s in [Stretches(data, length)]]
    anchor, name = (np.concatenate([*(f[k] for f in found), np.zeros(0, U64)]) for k in (0, 1))
    del found
    at = np.lexsort((name, anchor))
    anchor, name = anchor[at], name[at]
    distinct, runs = run_starts(anchor, name), run_starts(anchor)
    occurrences = np.diff(np.append(runs, len(anchor)))
    stretches = np.diff(np.append(np.searchsorted(distinct, runs), len(distinct))).astype(U32)
    table, block = (anchor[runs], name[runs], (occurrences > 1).astype(np.uint8), stretches), int(frame["block"].iloc[0])
    rows = [(owner, block, squeezed(table, own)) for owner, own in deal(table[0], owners)]
    return pd.DataFrame(rows, columns=["owner", "block", "message"])


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: for each block its anchors that occur twice in all, and of which kind they are."""
    (anchor, name, many, stretches), rows, _ = opened(frame["message"], ANCHORS)
    block = np.repeat(frame["block"].to_numpy(), rows)
    at = np.lexsort((name, anchor))
    anchor, name, many, stretches, block = (x[at] for x in (anchor, name, many, stretches, block))
    runs, names = run_starts(anchor), run_starts(anchor, name)
    times = np.diff(np.append(runs, len(anchor)))
    # A block that has several stretches gives the name of one.
    several = (np.diff(np.append(np.searchsorted(names, runs), len(names))) > 1) | (np.maximum.reduceat(stretches, runs) > 1)
    kind = np.where(np.add.reduceat(stretches, runs, dtype=np.int64) > HOT, _SPLIT, np.where(several, _SEVERAL, _ALONE)).astype(np.uint8)
    keep = np.flatnonzero(np.repeat(times + np.add.reduceat(many, runs, dtype=np.int64) > 1, times))
    table = (anchor[keep], np.repeat(kind, times)[keep])
    return pd.DataFrame([(b, squeezed(table, own)) for b, own in by_block(block[keep])], columns=["block", "message"])


def _sent(frame: pd.DataFrame, answers: pd.DataFrame, owners: int, length: int) -> pd.DataFrame:
    (keys, kinds), _, _ = opened(answers["message"], SHARED)
    at = np.argsort(keys)
    keys, kinds = keys[at], kinds[at]
    found: list[tuple[np.ndarray, ...]] = []
    for number, (_, text) in enumerate(unpacked(frame) if len(keys) else ()):
        for first, data in parts(text, length):
            s = Stretches(data, length)
            known, where = members(s.anchor, keys)
            s.select(known).split(kinds[where[known]] == _SPLIT, length)
            found.append((s.anchor, s.name, s.count.astype(_U16), np.full(len(s.start), number, np.int32), s.start + first))
    if not sum(len(f[0]) for f in found):
        return pd.DataFrame([], columns=["owner", "block", "message"])
    anchor, name, count, number, start = (np.concatenate(x) for x in zip(*found))
    del found
    kind = kinds[np.searchsorted(keys, anchor)]
    name[kind == _ALONE] = 0
    order = frame["doc_order"].to_numpy()[number]
    at = np.lexsort((start, order, name, anchor))
    anchor, name, count, number, start, order, kind = (x[at] for x in (anchor, name, count, number, start, order, kind))
    runs = run_starts(anchor, name)
    ends = np.append(runs[1:], len(anchor)) - 1
    more = (order[runs] != order[ends]) | (start[runs] != start[ends])
    anchor, name, count, number, start, order, kind = (x[runs] for x in (anchor, name, count, number, start, order, kind))
    held = kind == _SEVERAL
    table = (anchor, name, count, order, start, more * _MORE | held * _HELD)
    # A split anchor has single strings only; they go by their own names.
    dealt = list(deal(np.where(kind == _SPLIT, name, anchor), owners))
    sequence = np.concatenate([own for _, own in dealt])
    size = np.where(held, count.astype(np.int64) + length - 1, 0)
    ends = np.cumsum(size[sequence])
    place = np.empty(len(size), np.int64)
    place[sequence] = ends - size[sequence]
    content = np.empty(ends[-1], np.uint8)
    expand, packed = zstandard.ZstdDecompressor().decompress, frame["packed"].to_numpy()
    wanted = np.flatnonzero(held)
    for of, some in by_block(number[wanted]):
        data = np.frombuffer(expand(packed[of]), np.uint8)
        for k in range(0, len(some), COPIED):
            own = wanted[some[k : k + COPIED]]
            content[spread(place[own], size[own])] = data[spread(start[own], size[own])]
    block, rows, done = int(frame["block"].iloc[0]), [], 0
    for owner, own in dealt:
        upto = done + int(size[own].sum())
        rows.append((owner, block, squeezed(table, own, content[done:upto].tobytes())))
        done = upto
    return pd.DataFrame(rows, columns=["owner", "block", "message"])


class SuffixArray:
    """Suffixes of stretches in order, as far as their stretch goes, with the common prefix of each and the one before."""

    def __init__(self, text: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> None:
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
        words = np.zeros(len(text), U64)
        for k in range(8):
            words |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
        width = -(-int(lengths.max()) // 8)
        columns = []
        for k in range(width):
            column = words[np.minimum(places + 8 * k, len(text) - 1)]
            beyond = np.clip(8 * (k + 1) - lengths, 0, 8).astype(U64)
            shift = np.uint64(8) * beyond
            column = np.where(beyond >= 8, np.uint64(0), (column >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))
            columns.append(column)
        self.order = np.lexsort((lengths, *columns[::-1]))
        common = np.full(max(0, len(places) - 1), 8 * width, np.int64)
        for k in range(width - 1, -1, -1):
            column = columns[k][self.order]
            differ = column[1:] ^ column[:-1]
            zeros = np.zeros(len(differ), np.int64)
            rest = differ.copy()
            for byte in range(8):
                zeros += (rest >> np.uint64(56 - 8 * byte) == 0) & (zeros == byte)
            common = np.where(differ != 0, 8 * k + zeros, common)
        own = lengths[self.order]
        self.common = np.minimum(common, np.minimum(own[1:], own[:-1]))


def scan(array: SuffixArray, rank: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the longest prefix that an earlier place of a reported interval shares, and that earliest place.

    ``rank`` orders the places; ``left`` is the byte before each, below zero where it is
    not known. Each interval on the stack holds its prefix, its earliest suffix and the
    byte to the left of all, or -1 once two differ; when it closes, every suffix but the
    earliest of each part it is made of has found its longest prefix, so each is settled once.
    """
    best, source = np.zeros(len(rank), np.int64), np.full(len(rank), -1, np.int64)
    order, common = array.order.tolist(), [*array.common.tolist(), 0]
    ranks, lefts = rank.tolist(), left.tolist()
    stack: list[list] = []  # prefix, open suffixes, earliest, left byte
    for i, suffix in enumerate(order):
        part = [suffix, lefts[suffix]]
        depth = common[i]
        while stack and stack[-1][0] > depth:
            prefix, open_suffixes, earliest, byte = stack.pop()
            open_suffixes.append(part[0])
            earliest = part[0] if ranks[part[0]] < ranks[earliest] else earliest
            byte = byte if byte == part[1] else -1
            if byte < 0:
                for x in open_suffixes:
                    if x != earliest:
                        best[x], source[x] = prefix, earliest
            part = [earliest, byte]
        if depth < length:
            continue
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[1].append(part[0])
            top[2] = part[0] if ranks[part[0]] < ranks[top[2]] else top[2]
            top[3] = top[3] if top[3] == part[1] else -1
        else:
            stack.append([depth, [part[0]], part[0], part[1]])
    return best, source


def _repeats(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of one owner: for each block and stretch the repeats in it: place in the stretch, length, earliest place of all."""
    (anchor, name, count, low, low_start, flags), rows, data = opened(frame["message"], ENTRIES)
    count = count.astype(np.int64)
    block = np.repeat(frame["block"].to_numpy(), rows)
    size = count + length - 1
    brought = np.where(flags & _HELD, size, 0)
    place = np.cumsum(brought) - brought
    at = np.lexsort((low_start, low, name, anchor))
    anchor, name, count, size, place, block, low, low_start, flags = (x[at] for x in (anchor, name, count, size, place, block, low, low_start, flags))
    runs = run_starts(anchor, name)
    of = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(anchor))))
    # Copies of whole stretches: the earliest place of each distinct one.
    first, first_start = low[runs], low_start[runs]
    copied = np.flatnonzero((first[of] != low) | (first_start[of] != low_start) | (flags & _MORE > 0))
    found = [(copied, np.zeros(len(copied), np.int64), size[copied], first[of[copied]], first_start[of[copied]])]
    # Distinct stretches with one anchor share strings; those found twice by their hash make up the suffix array.
    chosen = np.flatnonzero(flags[runs] & _HELD)
    for some in _portions(anchor[runs][chosen], count[runs][chosen]):
        which = chosen[some]
        own = runs[which]
        times, long = count[own], size[own]
        stretch, step = np.repeat(which, times), spread(np.zeros(len(own), np.int64), times)
        begin = np.cumsum(long) - long
        text = data[spread(place[own], long)]
        spots = np.repeat(begin, times) + step
        names = Rolling(_BYTES[text]).at(spots, length)
        _, where, counts = np.unique(names, return_inverse=True, return_counts=True)
        live = counts[where] > 1
        stretch, step, spots = stretch[live], step[live], spots[live]
        if not len(stretch):
            continue
        array = SuffixArray(text, spots, size[runs][stretch] - step)
        order, start = first[stretch], first_start[stretch] + step
        rank = np.empty(len(spots), np.int64)
        rank[np.lexsort((start, order))] = np.arange(len(spots))
        best, source = scan(array, rank, np.where(step > 0, text[np.maximum(spots - 1, 0)].astype(np.int64), -1), length)
        hit = np.flatnonzero(best)
        found.append((runs[stretch[hit]], step[hit], best[hit], order[source[hit]], start[source[hit]]))
    entry, step, long, order, start = (np.concatenate(x) for x in zip(*found))
    table = (anchor[entry], name[entry], count[entry].astype(_U16), step.astype(_U16), long.astype(_U16), order, start)
    return pd.DataFrame([(b, squeezed(table, own)) for b, own in by_block(block[entry])], columns=["block", "message"])


def _portions(anchor: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of stretches, sorted by anchor, in portions of about ``SUFFIXES`` suffixes; those of an anchor stay together."""
    if len(anchor):
        groups = run_starts(anchor)
        before = (np.cumsum(count) - count)[groups]
        yield from np.split(np.arange(len(anchor)), groups[run_starts(before // SUFFIXES)][1:])


def _marked(frame: pd.DataFrame, answers: pd.DataFrame, length: int) -> Iterator[tuple[int, bytes, list[tuple[np.ndarray, ...]]]]:
    """(order, text, repeats) of each document of a block; repeats are (start, length, first, first_start)."""
    table, _, _ = opened(answers["message"], REPEATS)
    at = np.lexsort((table[1], table[0]))
    anchor, name, count, step, long, first, first_start = (x[at] for x in table)
    del table
    split, shared = np.unique(anchor[(count == 1) & (name > 0)]), np.unique(anchor)
    alone = name[np.searchsorted(anchor, shared)] == 0
    runs = run_starts(anchor, name)
    ends = np.append(runs[1:], len(anchor))
    # One number for anchor and name; the name is compared again.
    key = mix(anchor[runs] + name[runs])
    by_key = np.argsort(key)
    key, runs, ends = key[by_key], runs[by_key], ends[by_key]
    for order, text in unpacked(frame):
        repeats = []
        for begin, data in parts(text, length) if len(key) else ():
            s = Stretches(data, length)
            known, where = members(s.anchor, shared)
            s.select(known)
            s.name[alone[where[known]]] = 0
            places, names, anchors = [s.start], [s.name], [s.anchor]
            hot = members(s.anchor, split)[0]
            if hot.any():
                s.select(hot).split(s.count > 0, length)
                places, names, anchors = [*places, s.start], [*names, s.name], [*anchors, s.anchor]
            start, named, anchored = (np.concatenate(x) for x in (places, names, anchors))
            known, where = members(mix(anchored + named), key)
            known &= name[runs[where]] == named
            start, where = start[known] + begin, where[known]
            times = ends[where] - runs[where]
            row = spread(runs[where], times)
            spot = np.repeat(start, times) + step[row]
            later = (first[row] < order) | ((first[row] == order) & (first_start[row] < spot))
            repeats.append((spot[later], long[row][later].astype(np.int64), first[row][later], first_start[row][later]))
        yield order, text, repeats


def _cut(frame: pd.DataFrame, answers: pd.DataFrame, length: int) -> pd.DataFrame:
    out = []
    for order, text, repeats in _marked(frame, answers, length):
        change = np.zeros(len(text) + 1, np.int32)
        for start, long, _, _ in repeats:
            np.add.at(change, start, 1)
            np.add.at(change, start + long, -1)
        removed = np.cumsum(change[:-1]) > 0
        kept = np.frombuffer(text, np.uint8)[~removed].tobytes() if removed.any() else text
        spans = int((removed & ~np.concatenate([[False], removed[:-1]])).sum()) if len(text) else 0
        out.append((order, len(text), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["doc_order", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _listed(frame: pd.DataFrame, answers: pd.DataFrame, length: int) -> pd.DataFrame:
    rows = [(order, *row) for order, _, repeats in _marked(frame, answers, length) for r in repeats for row in zip(*(x.tolist() for x in r))]
    return pd.DataFrame(rows, columns=["doc_order", "start", "length", "first_order", "first_start"])


def _lean(step: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """The step, after which memory that it no longer uses is given back."""
    # The number of arguments tells Spark whether the key is one of them.
    if step.__code__.co_argcount == 1:
        return lambda frame: _after(step(frame))
    return lambda frame, answers: _after(step(frame, answers))


def _after(frame: pd.DataFrame) -> pd.DataFrame:
    release()
    return frame


def _rounds(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(texts by block, repeats by block)."""
    blocks = block_count(docs.sparkSession)
    texts = blocked_texts(docs, blocks)
    to_owner, to_block = "owner int, block int, message binary", "block int, message binary"
    anchors = texts.groupBy("block").applyInPandas(_lean(lambda f: _anchors(f, blocks, length)), to_owner)
    shared = anchors.groupBy("owner").applyInPandas(_lean(_shared), to_block)
    sent = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_lean(lambda f, a: _sent(f, a, OWNERS * blocks, length)), to_owner)
    repeats = sent.groupBy("owner").applyInPandas(_lean(lambda f: _repeats(f, length)), to_block)
    return texts, repeats


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, first_doc_id, first_start: each later place of each repeat with the earliest; one earliest place and length is one group."""
    texts, repeats = _rounds(docs, length)
    listed = texts.groupBy("block").cogroup(repeats.groupBy("block")).applyInPandas(
        lambda f, a: _listed(f, a, length), "doc_order long, start long, length long, first_order long, first_start long"
    )
    return listed.select(identifier().alias("doc_id"), "start", "length", identifier("first_order").alias("first_doc_id"), "first_start")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document; stored."""
    with small_batches(docs.sparkSession), freed_shuffles(docs.sparkSession):
        texts, repeats = _rounds(docs, length)
        cut = texts.groupBy("block").cogroup(repeats.groupBy("block")).applyInPandas(
            _lean(lambda f, a: _cut(f, a, length)), "doc_order long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        )
        return stored(cut.select(identifier().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"))
