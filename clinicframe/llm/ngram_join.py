"""Documents whose word n-grams are nearly the same, by universe partitioning.

A document's set holds the hashes of its n-grams. Two sets with a Jaccard similarity of
``percent`` or more differ in at most ``h`` hashes, where ``h`` follows from the larger
size. Sizes are cut into bands; a band deals all hashes into segments. Each segment has a
weight: 1 if only equal segments are to meet, 2 if segments that differ by one hash are
to meet as well, for which all its one-deletion variants are indexed next to itself.
With weights that add up to ``h + 1`` or more, two similar sets agree on some segment. The
cost-based allocation picks for each band how many segments get which weight and how
much weight to spare, from the number of documents in the band: variants cost index
entries, thin segments cost comparisons. The spared weight lets sets leave out their
empty segments, which would otherwise meet for nothing.

Blocks of documents send segment names to their owners, of whom each band has a few. An owner tells names apart by 32
bits; names that clash only add comparisons. It compares all sets of a name by one bit for
each of ``SKETCH`` cells, which tells sets that have more than the allowed hashes apart,
and answers with the sets that still have a partner: texts that share a passage or a line
end here, without a row for any pair, and names that the same sets share become one. Such comparisons under one name grow with the square
of the sets that share it. Sets are then compared, by sketches and then exactly, in two rounds: each with the first set
of its names, and, within a name whose sets did not all end up in one component, those
outside the first set's component with the sets of other components. Sets in one
component need no comparison, so a large group of near copies costs about one each. For the exact
comparison pairs are dealt to tasks by the sets around which they lie, and each text is sent once to each of its tasks.

Links run between sets, each under its own hash, never between identifiers; only a finished
component takes the smallest doc_id of its rows. Rows without doc_id, or with the same one,
are therefore documents of their own, linked by their texts alone.

Nulls: a null text has no words and an empty set; empty sets are linked with nothing. A
null doc_id sorts last and is returned as null. Equal sets are linked. An empty table gives
no rows; further columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import I64, LAST_ID, U32, U64, Rolling, block_count, blocked_texts, deal, id_filter, identifier, joined, mix, release, run_starts, stored, unpacked, word_hashes
from clinicframe.llm.components import components
from clinicframe.operators.skew import join_grouped
from clinicframe.session import ensure_checkpoint_dir, freed_shuffles, small_batches

NGRAM = 4
PERCENT = 85
BAND_RATIO = 1.5
LARGEST = 1 << 40
#: Assumed by the cost model: a comparison in index entries, and the share of hashes common to unrelated texts.
COMPARISON = 20.0
COMMON = 0.1
MOST_SPARE = 4
#: Rounds in which a name compares one of its sets with the others.
LEADERS = 2
#: Sets of one name that meet in one task.
TILE = 4096
#: Cells of a set's sketch.
SKETCH = 256
#: Names that a task deals or sorts at once.
PORTION = 1 << 19


def bands(ratio: float = BAND_RATIO) -> list[int]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < LARGEST:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


BANDS = bands()


@dataclass(frozen=True)
class Scheme:
    """Segments of a band: the first ``double`` have weight 2, the other ``single`` weight 1."""

    band: int
    double: int
    single: int
    spare: int

    @property
    def segments(self) -> int:
        return self.double + self.single


def scheme(band: int, documents: int, percent: int = PERCENT) -> Scheme | None:
    """The cheapest allocation of a band; None where only equal sets are similar."""
    low, high = BANDS[band], BANDS[band + 1] - 1
    # |a| + |b| - 2 |a and b| is at most this, from |a and b| >= percent / (100 + percent) * (|a| + |b|).
    differ = 2 * high * (100 - percent) // (100 + percent)
    if not differ:
        return None

    def cost(spare: int, double: int) -> float:
        single = differ + 1 + spare - 2 * double
        segments = double + single
        per = (low * high) ** 0.5 / segments
        light = segments * exp(-per)
        many_light = 1 - sum(exp(-light) * light**k / factorial(k) for k in range(spare + 1))
        meet = single * COMMON**per + double * (1 + per) * COMMON ** max(0.0, per - 1)
        return single + double * (1 + per) + COMPARISON * documents * (many_light**2 + meet)

    spare, double = min(((s, d) for s in range(MOST_SPARE + 1) for d in {(differ + 1 + s) * k // 32 for k in range(17)}), key=lambda c: cost(*c))
    return Scheme(band, double, differ + 1 + spare - 2 * double, spare)


def names(tokens: np.ndarray, plan: Scheme) -> np.ndarray:
    """The names under which a set is indexed: of its segments, and of their one-deletion variants where the weight is 2."""
    segment = (mix(tokens ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(plan.segments)).astype(np.int64)
    spread = mix(tokens)
    count = np.bincount(segment, minlength=plan.segments)
    order = np.argsort(segment, kind="stable")
    filled = np.flatnonzero(count)
    total = np.zeros(plan.segments, U64)
    total[filled] = np.add.reduceat(spread[order], np.cumsum(count[filled]) - count[filled])
    weight = np.where(np.arange(plan.segments) < plan.double, 2, 1)
    light = count < weight
    # With little weight in thin segments another segment is sure to meet; a set with more shows them too.
    all_shown = weight[light].sum() > plan.spare
    salt = mix(np.arange(plan.segments, dtype=U64) + np.uint64(plan.band << 32))
    whole = np.arange(plan.segments) if all_shown else filled
    twice = (segment < plan.double) & (all_shown | (count[segment] > 1))
    return np.concatenate([mix(total[whole] + salt[whole]), mix(total[segment[twice]] - spread[twice] + salt[segment[twice]])])


def ngrams(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-cased words; of a shorter text its only sequence."""
    words = word_hashes(text.lower())
    if not len(words):
        return np.zeros(0, U64)
    rolling = Rolling(words)
    return np.unique(rolling.all(n) if len(words) >= n else rolling.at(np.zeros(1, np.int64), len(words)) + np.uint64(len(words)))


def set_name(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) if len(tokens) else 0


def text_name(text: bytes) -> int:
    """What Spark's xxhash64 gives for the text, as an unsigned number."""
    return xxhash.xxh64_intdigest(text, seed=42)


def band_of(size: int) -> int:
    return int(np.searchsorted(BANDS, size, side="right")) - 1


def own_plans(size: int, plans: dict[int, Scheme], percent: int) -> list[Scheme]:
    """The allocations of the set's own band and, if it can be similar to a larger set of the next, of that."""
    band = band_of(size)
    own = [plans[band]] if band in plans else []
    if band + 1 in plans and 100 * size >= percent * BANDS[band + 1]:
        own.append(plans[band + 1])
    return own


def all_names(tokens: np.ndarray, plans: dict[int, Scheme], percent: int) -> np.ndarray:
    """Names in the bands of ``own_plans``."""
    return np.unique(np.concatenate([np.zeros(0, U64), *(names(tokens, p) for p in own_plans(len(tokens), plans, percent))]))


def places(plans: dict[int, Scheme], documents: dict[int, int], owners: int) -> dict[int, tuple[int, int]]:
    """(first, number) of the owners of each band's names, by its share of all names.

    A set goes along with its names to each owner that gets any. Were all bands dealt to all
    owners, that would be nearly every owner, the more of them the larger the tables are.
    """
    # Of the band below, about a third of the sets can be similar to larger ones.
    sets = {b: documents.get(b, 0) + documents.get(b - 1, 0) / 3 for b in plans}
    weight = {b: sets[b] * (p.single + p.double * (1 + (BANDS[b] * BANDS[b + 1]) ** 0.5 / p.segments)) + 1e-9 for b, p in plans.items()}
    out, before, total = {}, 0.0, sum(weight.values())
    for band, share in weight.items():
        first = min(owners - 1, int(before / total * owners))
        before += share
        out[band] = (first, max(1, min(owners, ceil(before / total * owners)) - first))
    return out


def placed_names(tokens: np.ndarray, plans: dict[int, Scheme], place: dict[int, tuple[int, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names as in ``all_names``, and the owner of each: the upper half of a name chooses among its band's owners."""
    found = [(np.unique(names(tokens, p)), place[p.band]) for p in own_plans(len(tokens), plans, percent)]
    owner = [first + (key >> np.uint64(32)).astype(I64) % number for key, (first, number) in found]
    return np.concatenate([np.zeros(0, U64), *(key for key, _ in found)]), np.concatenate([np.zeros(0, I64), *owner])


def sketch(tokens: np.ndarray) -> bytes:
    """How many hashes fall into each of SKETCH cells, at most 255."""
    return np.minimum(np.bincount((tokens >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def odd_cells(tokens: np.ndarray) -> bytes:
    """One bit for each of SKETCH cells: whether an odd number of hashes falls into it. Each hash that only one of two sets has flips one bit."""
    return np.packbits((np.bincount((tokens >> np.uint64(24)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _indexed(
    frames: Iterator[pd.DataFrame], owners: int, plans: dict[int, Scheme], n: int, percent: int, place: dict[int, tuple[int, int]] | None = None
) -> Iterator[pd.DataFrame]:
    """Messages of one block to the owners, each portion of its documents on its own: names with their sets, and the documents, dealt by set."""
    place = place or dict.fromkeys(plans, (0, owners))
    block, docs, found, seen, size = 0, [], [], set(), 0
    for frame in frames:
        block = int(frame["block"].iloc[0])
        for order, text in unpacked(frame):
            tokens = ngrams(text, n)
            name = set_name(tokens)
            docs.append((name, order, len(tokens), sketch(tokens), text_name(text)))
            if len(tokens) and name not in seen:
                seen.add(name)
                found.append((name, *placed_names(tokens, plans, place, percent), len(tokens), odd_cells(tokens)))
                size += len(found[-1][1])
            if size >= PORTION:
                yield _messages(block, docs, found, owners)
                docs, found, size = [], [], 0
    if docs:
        yield _messages(block, docs, found, owners)
    del docs, found, seen
    release()


def _messages(block: int, docs: list[tuple[int, int, int, bytes, int]], found: list[tuple[int, np.ndarray, np.ndarray, int, bytes]], owners: int) -> pd.DataFrame:
    distinct = np.array([f[0] for f in found], U64)
    sizes = np.array([f[3] for f in found], U32)
    odd = np.frombuffer(b"".join(f[4] for f in found), np.uint8).reshape(-1, SKETCH // 8)
    doc_set, doc_text = (np.array([d[k] for d in docs], U64) for k in (0, 4))
    doc_order, doc_size = (np.array([d[k] for d in docs], I64) for k in (1, 2))
    sketches = np.frombuffer(b"".join(d[3] for d in docs), np.uint8).reshape(-1, SKETCH)
    key = np.concatenate([*(f[1] for f in found), np.zeros(0, U64)])
    of = np.repeat(np.arange(len(found), dtype=U32), [len(f[1]) for f in found])
    messages = {}
    # The upper half of a name has chosen the owner, who gets the lower half.
    owner_of = np.concatenate([*(f[2] for f in found), np.zeros(0, I64)])
    for owner, at in deal(owner_of.astype(U64) << np.uint64(20), owners):
        here, index = np.unique(of[at], return_inverse=True)
        # Names stand in the order of their sets: one bit each says whether a new set begins.
        new = np.packbits(np.diff(index, prepend=0).astype(np.uint8)).tobytes()
        messages[owner] = [key[at].astype(U32).tobytes(), new, *[x[here].tobytes() for x in (distinct, sizes, odd)], b"", b"", b"", b"", b""]
    for owner, at in deal(mix(doc_set ^ doc_order.astype(U64)), owners):
        messages.setdefault(owner, [b""] * len(MESSAGE))[5:] = [x[at].tobytes() for x in (doc_set, doc_order, doc_size, sketches, doc_text)]
    return pd.DataFrame([(o, block, *m) for o, m in messages.items()], columns=["owner", "block", *MESSAGE])


MESSAGE = ("key", "new", "sets", "sizes", "odd", "doc_set", "doc_order", "doc_size", "sketches", "doc_text")


def _shared(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Of one owner: a row per document, with its sketch, and a row (set, key) per set and name under which another set may be similar.

    Near copies share most of their names, and names that the same sets share say the same:
    the key is a hash of these sets, and each is written once.
    """
    held, sizes, odd, told = [], [], [], np.zeros(0, U64)
    for frame in frames:
        docs = [joined(frame[c], d) for c, d in (("doc_set", U64), ("doc_order", I64), ("doc_size", I64), ("doc_text", U64))]
        sketches = b"".join(frame["sketches"])
        block = np.repeat(frame["block"].to_numpy(), [len(x) // 8 for x in frame["doc_set"]])
        yield pd.DataFrame({
            "set": docs[0].view(I64), "doc_order": docs[1], "size": docs[2], "block": block, "key": 0,
            "sketch": [sketches[SKETCH * k : SKETCH * (k + 1)] for k in range(len(block))],
            "text": docs[3].view(I64),
        })
        held += zip(frame["key"], frame["new"], frame["sets"])
        sizes += list(frame["sizes"])
        odd += list(frame["odd"])
    listed, sizes = joined((sets for _, _, sets in held), U64), joined(sizes, U32).astype(I64)
    odd = joined(odd, U64).reshape(-1, SKETCH // 64)
    begins = np.cumsum([0] + [len(sets) // 8 for _, _, sets in held])
    # Equal names fall into one portion, so portions can be sorted one by one.
    portions = 1 << (sum(len(k) for k, _, _ in held) // 4 // PORTION).bit_length()
    for portion in range(portions):
        parts = [_portion(key, new, portion, portions) for key, new, _ in held]
        key = np.concatenate([*(k for k, _ in parts), np.zeros(0, U32)])
        of = np.concatenate([*(at + begin for (_, at), begin in zip(parts, begins)), np.zeros(0, np.int64)])
        order = np.lexsort((listed[of], key))
        key, of = key[order], of[order]
        runs = run_starts(key, listed[of])
        key, of = key[runs], of[runs]
        good = _promising(key, sizes[of], odd[of], percent)
        sharing, sets = sharers(key[good], listed[of[good]], told)
        told = np.union1d(told, sharing)
        yield pd.DataFrame({"set": sets.view(I64), "doc_order": 0, "size": -1, "block": -1, "key": sharing.view(I64), "sketch": b"", "text": 0})
    del frame, sketches, docs, held, odd, parts, key, of, order, runs, good, sharing, sets, told
    release()


def sharers(key: np.ndarray, sets: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, set) of the sets that share a name, from sorted names: equal ones once, and none whose hash is in ``told``.

    Where hashes of different sets clash, these meet as under one name, which only adds comparisons.
    """
    starts = run_starts(key)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64)
    shared = mix(np.add.reduceat(mix(sets), starts))
    _, first = np.unique(shared, return_index=True)
    new = np.zeros(len(starts), bool)
    new[first] = ~np.isin(shared[first], told)
    rows = np.diff(np.append(starts, len(key)))
    return np.repeat(shared[new], rows[new]), sets[np.repeat(new, rows)]


def _portion(keys: bytes, new: bytes, portion: int, portions: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of a message that fall into the portion, with the places of their sets in it."""
    key = np.frombuffer(keys, U32)
    here = np.flatnonzero(key & np.uint32(portions - 1) == portion)
    of = np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=len(key)), dtype=np.int64)
    return key[here], of[here]


def _promising(key: np.ndarray, sizes: np.ndarray, odd: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of sorted names have another under the same name that may be similar.

    Every two entries of a name are looked at, in place: nothing is written for a pair.
    """
    good = np.zeros(len(key), bool)
    step, left = 1, np.arange(max(0, len(key) - 1))
    while True:
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            return good
        for start in range(0, len(left), PORTION):
            a = left[start : start + PORTION]
            b = a + step
            apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
            fits = (apart <= most_different(sizes[a], sizes[b], percent)) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
            good[a[fits]] = good[b[fits]] = True
        step += 1


def _contents(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the texts of the wanted sets, compressed, for each task that compares them."""
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for order, text, node, task in zip(wanted["doc_order"], wanted["text"], wanted["node"], wanted["task"]) if len(wanted) else ():
        asked.setdefault((order, text), []).append((task, node))
    frame = frame[frame["doc_order"].isin([order for order, _ in asked])]
    out = []
    for (order, text), packed in zip(unpacked(frame), frame["packed"]):
        out += [(task, node, packed) for task, node in asked.pop((order, signed(text_name(text))), ())]
    return pd.DataFrame(out, columns=["task", "node", "packed"])


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def most_different(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many hashes two similar sets of these sizes can have apart."""
    return (a + b) * (100 - percent) // (100 + percent)


def _possible(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose sketches are no farther apart than similar sets can be; sets differ in at least as many hashes as their sketches do."""
    for frame in frames:
        x, y = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sketch_a", "sketch_b"))
        apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
        yield frame.loc[apart <= most_different(frame["size_a"].to_numpy(), frame["size_b"].to_numpy(), percent), ["a", "b"]]


def _similar(contents: pd.DataFrame, pairs: pd.DataFrame, n: int, percent: int) -> pd.DataFrame:
    """Of one task: similar pairs that link whatever its similar pairs link. Sets that are linked already need no comparison."""
    tokens = {node: ngrams(text, n) for node, text in unpacked(contents[["node", "packed"]].rename(columns={"node": "doc_order"}))} if len(contents) else {}
    root = {node: node for node in tokens}

    def find(node: int) -> int:
        while root[node] != node:
            root[node] = node = root[root[node]]
        return node

    found = []
    for a, b in zip(pairs["a"], pairs["b"]) if len(pairs) else ():
        one, two = find(a), find(b)
        if one != two:
            x, y = tokens[a], tokens[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[two] = one
                found.append((a, b))
    del tokens, root
    release()
    return pd.DataFrame(found, columns=["a", "b"])


def dealt_pairs(pairs: DataFrame, tasks: int) -> DataFrame:
    """The distinct pairs (a, b) with the task that compares them.

    A pair goes by the smallest set that an end of it is paired with, so that sets which are all
    paired with each other, or with one, meet in one task and each text is sent there once. Where more than
    ``TILE`` pairs go by one set, they are spread over tasks; the pairs of a set that has few of them stay together.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    hubs = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("hub"), F.count("*").alias("degree"))
    for end in ("a", "b"):
        pairs = join_grouped(pairs, hubs.select(F.col("node").alias(end), F.col("hub").alias(f"hub_{end}"), F.col("degree").alias(f"degree_{end}")), end)
    found = pairs.select("a", "b", F.least("hub_a", "hub_b").alias("hub"), F.when(F.col("degree_a") < F.col("degree_b"), F.col("a")).otherwise(F.col("b")).alias("fewer"))
    found = join_grouped(found, found.groupBy("hub").agg(F.count("*").alias("rows")), "hub")
    part = F.pmod(F.xxhash64("fewer"), F.ceil(F.col("rows") / TILE))
    return found.select("a", "b", F.pmod(F.xxhash64("hub", part), F.lit(tasks)).cast("int").alias("task"))


def compared(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of similar sets that link all sets which ``pairs`` with similar sets link: first by sketch, then exactly, on texts read again.

    Texts meet in tasks that pairs are dealt to; no row carries a text or a set for a single pair.
    """
    blocks = block_count(docs.sparkSession)
    side = lambda df, name: df.select(*[F.col(c).alias(f"{c}_{name}" if c != "node" else name) for c in df.columns])
    sketches = sets.select("node", "size", "sketch")
    possible = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").mapInPandas(lambda f: _possible(f, percent), "a long, b long").checkpoint()
    dealt = stored(dealt_pairs(possible, blocks))
    nodes = dealt.select("task", F.col("a").alias("node")).union(dealt.select("task", "b")).distinct()
    wanted = stored(sets.join(nodes, "node").select("block", "doc_order", "text", "node", "task"))
    texts = blocked_texts(docs, blocks, id_filter(wanted, "doc_order"))
    contents = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_contents, "task int, node long, packed binary")
    return contents.groupBy("task").cogroup(dealt.groupBy("task")).applyInPandas(lambda c, p: _similar(c, p, n, percent), "a long, b long").checkpoint()


def band_counts(docs: DataFrame, n: int) -> dict[int, int]:
    """Documents of each band that holds any."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sizes = docs.select(F.greatest(F.lit(1), words - (n - 1)).alias("size"))
    # Some ten rows per band, whatever the number of documents.
    counted = sizes.groupBy(F.floor(8 * F.ln("size")).alias("level")).agg(F.count("*").alias("n"), F.max("size").alias("largest")).collect()
    documents: dict[int, int] = {}
    for row in counted:
        band = band_of(row["largest"])
        documents[band] = documents.get(band, 0) + row["n"]
    return documents


def schemes(documents: dict[int, int], percent: int) -> dict[int, Scheme]:
    """The allocation of each band up to that of the longest text, from the number of documents by band."""
    last = max(documents, default=-1) + 1
    found = {b: scheme(b, documents.get(b, 0) + documents.get(b - 1, 0), percent) for b in range(last + 1)}
    return {b: s for b, s in found.items() if s}


def linked(named: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of all sets that are linked, from the names (key, node) that sets share.

    In each of ``LEADERS`` rounds every name whose sets are in several components puts one
    of them up, another for each name and round, and compares it with those outside its
    component. Near copies that share many names meet many leaders that way and end up
    together at a cost of one comparison a name and set. What is left apart then is
    compared set by set, but only pairs that sketches do not tell apart are written.
    """
    placed = join_grouped(named, sets.select("node", "size"), "node").withColumn("own", F.col("node"))
    groups = named.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(LEADERS + 1):
        # Names all of whose sets are in one component need no more comparisons.
        parts = placed.groupBy("key").agg(
            F.min("own").alias("least"), F.max("own").alias("most"), F.count("*").alias("rows"),
            F.min_by(F.struct("node", "size", "own"), F.xxhash64("node", "key", F.lit(turn))).alias("leader"),
        ).filter("least < most")
        rest = stored(join_grouped(placed, parts.select("key", "rows", "leader"), "key"))
        if rest.isEmpty():
            break
        if turn < LEADERS:
            lead = rest.filter(F.col("own") != F.col("leader.own")).filter(100 * F.least("size", "leader.size") >= percent * F.greatest("size", "leader.size"))
            pairs = lead.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))
        else:
            pairs = _crossing(rest, sets, percent)
        found = compared(pairs.distinct(), sets, docs, n, percent)
        if not found.isEmpty():
            # Of earlier links one a set is enough.
            groups = components(found.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        placed = rest.select("key", "node", "size").join(groups.select("node", F.col("component").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    return groups


def _crossing(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components of one name that sketches do not tell apart.

    A name's sets are dealt into tiles of about ``TILE``, and every two tiles meet in a
    cell of their own, so a name that very many sets share is spread over tasks.
    """
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles).cast("int")
    dealt = rest.select("key", "node", "size", "own", tile.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    cells = join_grouped(dealt, sets.select("node", "sketch"), "node").withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")
    order = ("key", "low", "high", "node")
    spread = cells.repartition("key", "low", "high").sortWithinPartitions(*order)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            # The last cell may go on in the next batch.
            last = frame[list(order[:3])].iloc[-1]
            ends = int((frame[list(order[:3])] == last).all(axis=1).to_numpy().argmax())
            yield _apart_by_little(frame.iloc[:ends], percent)
            kept = frame.iloc[ends:]
        if kept is not None:
            yield _apart_by_little(kept, percent)
        release()

    return spread.mapInPandas(meet, "a long, b long")


def _apart_by_little(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of sorted cells the pairs of different components whose sketches similar sets can have, each once."""
    cell = run_starts(*[frame[c].to_numpy() for c in ("key", "low", "high")])
    cell = np.repeat(np.arange(len(cell)), np.diff(np.append(cell, len(frame))))
    node, size, own, tile = (frame[c].to_numpy() for c in ("node", "size", "own", "tile"))
    inside = frame["low"].to_numpy() == frame["high"].to_numpy()
    cells = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, SKETCH)
    # A full cell says nothing about the parity of its count.
    odd = np.packbits((cells & 1) * (cells < 255), axis=1).view(U64)
    found, step, left = [np.zeros((0, 2), np.int64)], 1, np.arange(max(0, len(frame) - 1))
    while True:
        left = left[left + step < len(frame)]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
        for start in range(0, len(left), PORTION // 8):
            a = left[start : start + PORTION // 8]
            b = a + step
            most = most_different(size[a], size[b], percent)
            fits = (own[a] != own[b]) & (inside[a] | (tile[a] != tile[b])) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
            fits &= np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64) <= most
            a, b, most = a[fits], b[fits], most[fits]
            near = np.abs(cells[a].astype(np.int16) - cells[b]).sum(axis=1, dtype=np.int64) <= most
            found.append(np.stack([np.minimum(node[a], node[b])[near], np.maximum(node[a], node[b])[near]], axis=1))
        step += 1


def near_rows(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_order, text, size, component, first) for every row: its text's xxhash64, the number of its n-grams, its component's name and smallest doc_order."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    blocks = block_count(spark)
    documents = band_counts(docs, n)
    plans = schemes(documents, percent)
    place = places(plans, documents, blocks)

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _indexed(frames, blocks, plans, n, percent, place)

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _shared(frames, percent)

    # The many rounds of small joins would otherwise keep all their files until the driver happens to collect its garbage.
    with freed_shuffles(spark), small_batches(spark):
        sent = blocked_texts(docs, blocks).groupBy("block").applyInPandas(indexed, "owner int, block int, " + ", ".join(f"{c} binary" for c in MESSAGE))
        table = stored(sent.groupBy("owner").applyInPandas(shared, "set long, doc_order long, size long, block int, key long, sketch binary, text long"))
        # A set goes by its hash; one of its rows stands for it when texts are read again.
        sets = table.filter("size > 0").groupBy("set").agg(F.min(F.struct("doc_order", "text", "block", "size", "sketch")).alias("m"))
        sets = stored(sets.select(F.col("set").alias("node"), "m.doc_order", "m.text", "m.block", "m.size", "m.sketch"))
        # Owners may have found the same sharers.
        named = table.filter("size < 0").select("key", F.col("set").alias("node")).distinct()
        groups = linked(named, sets, docs, n, percent)
        by_set = stored(sets.join(groups, "node", "left").select("node", "doc_order", F.coalesce("component", "node").alias("component")))
    listed = table.filter("size >= 0")
    smallest = by_set.groupBy("component").agg(F.min("doc_order").alias("first"))
    by_set = join_grouped(by_set.select("node", "component"), smallest, "component").withColumnRenamed("node", "set")
    out = join_grouped(listed.filter("size > 0").select("doc_order", "text", "size", "set"), by_set, "set").select("doc_order", "text", "size", "component", "first")
    alone = listed.filter("size = 0").select("doc_order", "text", "size", F.lit(0).cast("long").alias("component"), F.col("doc_order").alias("first"))
    return out.unionByName(alone)


def near_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return near_rows(docs, n, percent).select(identifier().alias("doc_id"), F.col("size").alias("n_shingles"), identifier("first").alias("component_id"))


def keep_first(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Of each component one row, of those with the smallest doc_id, and every row without words; with all their columns."""
    rows = stored(near_rows(docs, n, percent))
    # Of several texts under the smallest doc_id, as without doc_id, the one with the smallest hash stays.
    chosen = rows.filter("size > 0").groupBy("component").agg(F.min(F.struct("doc_order", "text")).alias("m")).select("m.*")
    copies = rows.filter("size > 0").groupBy("doc_order", "text").agg((F.count("*") > 1).alias("several"))
    kept = chosen.join(copies, ["doc_order", "text"])
    kept = kept.unionByName(rows.filter("size = 0").select("doc_order", "text", F.lit(False).alias("several")).distinct())
    kept = stored(kept.select(F.col("doc_order").alias("__order"), F.col("text").alias("__text"), F.col("several").alias("__several")))
    named = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__order"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__text"))
    found = named.join(kept, ["__order", "__text"])
    if not kept.filter("__several").isEmpty():
        found = found.filter("not __several").unionByName(found.filter("__several").dropDuplicates(["__order", "__text"]))
    return found.select(*docs.columns)
