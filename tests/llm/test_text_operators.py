"""The operators on documents against brute-force versions, on a table of hard cases."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import zstandard
from llm_cases import LAST, reachable

from clinicframe import session
from clinicframe.llm import common, cover_dedup, golomb_dedup, ngram_join, quality_classifier, suffix_dedup, weighted_mix


def order(doc_id):
    return LAST if doc_id is None else doc_id


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(400)}" for _ in range(n))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_golomb_code_round_trip():
    draw = np.random.default_rng(0)
    for n, span in ((0, 10), (1, 1), (5, 5), (1000, 1 << 40), (300, 301)):
        values = np.sort(draw.choice(min(span, 1 << 20), n, replace=False).astype(np.uint64)) * np.uint64(max(1, span >> 20))
        assert (golomb_dedup.golomb_decode(golomb_dedup.golomb_encode(values, span), n, span) == values).all()


@pytest.mark.parametrize("sender_rows", [4, 1 << 18])
def test_exact_groups(documents, mixed_rows, monkeypatch, sender_rows):
    monkeypatch.setattr(golomb_dedup, "SENDER_ROWS", sender_rows)
    groups = defaultdict(list)
    for i, t, _ in mixed_rows:
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append(order(i))
    expected = []
    for text, ids in groups.items():
        for i in ids:
            first = min(ids)
            expected.append((None if i == LAST else i, None if first == LAST else first, len(ids), i == first, sha(text.encode())))
    assert collected(golomb_dedup.exact_groups(documents(*mixed_rows))) == sorted(expected, key=repr)
    kept = golomb_dedup.keep_first(documents(*mixed_rows))
    assert kept.columns == documents().columns
    assert sorted(order(r["doc_id"]) for r in kept.collect()) == sorted({order(i) for i, _, k, stays, _ in expected if stays})


def test_passages_of_words(documents, mixed_rows):
    first: dict[tuple, int] = {}
    split = [(order(i), (t or "").encode().split()) for i, t, _ in mixed_rows]
    for i, words in split:
        for k in range(len(words) - 49):
            name = tuple(words[k : k + 50])
            first[name] = min(first.get(name, LAST), i)
    expected = []
    for i, words in split:
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - 49):
            if first[tuple(words[k : k + 50])] < i:
                gone[k : k + 50] = True
        expected.append((None if i == LAST else i, len(words), int(gone.sum()), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    assert sum(e[2] for e in expected) > 200
    assert collected(cover_dedup.digest(documents(*mixed_rows))) == sorted(expected, key=repr)


@pytest.mark.parametrize("period", [*range(1, 40)])
def test_every_distance_is_a_difference_of_the_cover(period):
    cover = cover_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("hot", [0, 2000])
def test_repeats_of_bytes(documents, mixed_rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rows = [(order(i), (t or "").encode()) for i, t, _ in mixed_rows if i is not None]
    places: dict[bytes, tuple] = {}
    for i, data in rows:
        for k in range(len(data) - 99):
            places[data[k : k + 100]] = min(places.get(data[k : k + 100], (LAST, 0)), (i, k))
    expected = []
    for i, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if places[data[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        expected.append((i, len(data), int(gone.sum()), spans, sha(np.frombuffer(data, np.uint8)[~gone].tobytes())))
    docs = documents(*[r for r in mixed_rows if r[0] is not None])
    assert collected(suffix_dedup.digest(docs)) == sorted(expected, key=repr)


def test_repeat_groups_name_the_earliest_place_and_are_maximal(documents):
    passage = "the quick brown fox " * 3 + "jumps over the lazy dog while nobody looks at all " * 2
    docs = documents((1, "aa" + passage + "zz", "s"), (2, "bb" + passage + "yy", "s"), (3, "c" + passage, "s"))
    found = {tuple(r) for r in suffix_dedup.repeat_groups(docs).collect()}
    for doc, start in ((2, 2), (3, 1)):
        covered = set()
        for d, s, n, first, first_start in found:
            if d == doc:
                assert first == 1 and first_start - 2 == s - start
                covered |= set(range(s, s + n))
        assert covered == set(range(start, start + len(passage)))


def ngram_sets(rows, n=4):
    out = []
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        out.append((order(i), frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])))
    return out


@pytest.mark.parametrize("percent", [85, 60])
def test_ngram_join(documents, mixed_rows, percent):
    rows = list(mixed_rows)
    base = rows[3][1].split()
    for k in range(24):  # a chain of near copies and many documents that only share a part
        varied = list(base)
        for j in range(k % 12):
            varied[(7 * j + 5) % 120] = f"v{j}"
        rows.append((100 + k, " ".join(varied[: 120 - k % 5]), "b"))
    sets = ngram_sets(rows)
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    smallest = reachable([i for i, _ in sets], links)
    expected = sorted((None if i == LAST else i, len(s), None if not s and i == LAST else (i if not s else smallest[i])) for i, s in sets if i != LAST)
    got = [tuple(r) for r in ngram_join.near_components(documents(*rows), percent=percent).collect()]
    assert sorted(g for g in got if g[0] is not None) == expected
    assert len(got) == len(rows)


def test_near_copies_without_identifier(documents):
    base = [prose(seed, 120).split() for seed in (21, 22, 23, 24)]
    near = lambda k, at: " ".join([*base[k][:at], "changed", *base[k][at + 1 :]])
    rows = [(5, " ".join(base[0]), "a"), (7, " ".join(base[1]), "a"), (None, near(0, 60), "a"), (None, near(1, 60), "a")]
    rows += [(None, " ".join(base[2]), "a"), (None, near(2, 60), "a"), (None, " ".join(base[3]), "a"), (None, " ".join(base[3]).upper(), "a"), (None, " ".join(base[3]), "a")]
    rows += [(None, prose(25, 120), "a"), (None, "", "a"), (None, None, "a"), (8, near(0, 30), "a"), (8, prose(26, 120), "a"), (9, " ".join(base[3]), "a")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.near_components(documents(*rows)).collect()), key=repr)
    assert got == sorted([(5, 5), (7, 7), (None, 5), (None, 7), *[(None, None)] * 2, *[(None, 9)] * 3, *[(None, None)] * 3, (8, 5), (8, 8), (9, 9)], key=repr)
    kept = ngram_join.keep_first(documents(*rows))
    assert kept.columns == documents().columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    one = [t for t in texts if t[1] in (rows[4][1], rows[5][1])]
    assert len(one) == 1 and one[0][0] is None
    assert sorted((t for t in texts if t not in one), key=repr) == sorted([r[:2] for r in (rows[0], rows[1], rows[9], rows[10], rows[11], rows[13], rows[14])], key=repr)


def test_near_copies_without_identifier_stay_once(documents):
    text = prose(27, 60)
    kept = ngram_join.keep_first(documents((None, text, "a"), (None, text, "a"), (None, text.upper(), "a"), (None, prose(28, 60), "a"), (3, None, "a")))
    assert sorted((r["text"] or "").lower() for r in kept.collect()) == sorted(["", text, prose(28, 60)])


def test_similar_sets_share_a_name():
    draw = np.random.default_rng(3)
    plans = {b: s for b in range(30) if (s := ngram_join.scheme(b, 10 ** (b % 12)))}
    assert any(p.double for p in plans.values()) and any(not p.double for p in plans.values())
    for size in (7, 9, 14, 30, 65, 200, 900):
        for _ in range(60):
            base = common.mix(draw.integers(0, 1 << 60, size + 40).astype(np.uint64))
            a, b = set(base[:size].tolist()), set(base[draw.integers(0, size // 8 + 1) : size + draw.integers(0, size // 8 + 1)].tolist())
            if a != b and 100 * len(a & b) >= 85 * len(a | b):
                one, two = (ngram_join.all_names(np.array(sorted(s), np.uint64), plans, 85) for s in (a, b))
                assert len(np.intersect1d(one, two)), (size, len(a), len(b))


def test_mix_reads_texts_once(documents, mixed_rows):
    plan = weighted_mix.mix(documents(*mixed_rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "md5" not in plan


def test_mix_reaches_its_targets(documents, mixed_rows):
    rows = [(i, t, s) for i, t, s in mixed_rows] + [(1000 + k, "some words here " * (1 + k % 7), "abcdefgh"[k % 8]) for k in range(200)]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_names = {}, 1.5 * sum(sizes.values()), list(names)
    while open_names:
        share = {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        full = [s for s in open_names if share[s] > 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_names.remove(s)
    got = weighted_mix.taken(documents(*rows), ["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    by_source = defaultdict(int)
    for r in got:
        source = r["row"]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
        assert 0 <= r["times"] <= 2
        by_source[source] += r["times"] * r["size"]
    longest = max(size(t) for _, t, s in rows)
    for s in names:
        assert abs(by_source[s] - target[s]) <= longest
    repeated = weighted_mix.mixed(documents(*rows))
    assert repeated.columns == documents().columns and repeated.count() == sum(r["times"] for r in got)
    assert collected(weighted_mix.mix(documents(*rows))) == collected(weighted_mix.mix(documents(*rows).repartition(5)))


def test_empty_tables(documents):
    none = documents()
    for df in (
        golomb_dedup.exact_groups(none), cover_dedup.digest(none), suffix_dedup.digest(none), ngram_join.near_components(none), weighted_mix.mix(none)
    ):
        assert df.count() == 0


def test_names_in_portions(monkeypatch):
    # Near copies, and texts that share half with them: only the former have a partner under their names.
    texts = [" ".join("x" if j == 3 * k else f"w{j}" for j in range(120)) for k in range(30)]
    texts += [" ".join(f"w{j}" if j < 60 else f"v{k}-{j}" for j in range(120)) for k in range(10)]
    plans = {b: s for b in range(12) if (s := ngram_join.scheme(b, 40))}
    frame = pd.DataFrame({"block": 3, "doc_order": range(40), "packed": [zstandard.compress(t.encode()) for t in texts]})

    def found(portion):
        monkeypatch.setattr(ngram_join, "PORTION", portion)
        sent = pd.concat(ngram_join._indexed(iter([frame]), 4, plans, 4, 85))
        out = pd.concat([x for _, group in sent.groupby("owner") for x in ngram_join._shared(iter([group]), 85)])
        return sorted(map(tuple, out.to_numpy().tolist()))

    whole = found(1 << 19)
    assert sum(r[2] >= 0 for r in whole) == 40 and sum(r[2] < 0 for r in whole) > 100
    assert len({r[0] for r in whole if r[2] < 0}) == 30
    assert found(16) == whole


def test_sets_go_to_few_owners():
    """However many owners there are, a band's names go to its share of them, and all bands cover them."""
    documents = dict.fromkeys(range(20), 10_000)
    plans = {b: p for b in range(20) if (p := ngram_join.scheme(b, 20_000))}
    place = ngram_join.places(plans, documents, 40)
    assert set(place) == set(plans) and {o for first, number in place.values() for o in range(first, first + number)} == set(range(40))
    tokens = common.mix(np.arange(60, dtype=np.uint64))
    key, owner = ngram_join.placed_names(tokens, plans, place, 85)
    assert sorted(key) == sorted(ngram_join.all_names(tokens, plans, 85))
    assert len(set(owner.tolist())) <= sum(place[p.band][1] for p in ngram_join.own_plans(60, plans, 85)) < 10 < len(key)
    assert ngram_join.places({}, {}, 40) == {}


def test_names_of_the_same_sets_become_one(monkeypatch):
    # Two near copies share nearly all their names, which say no more than one does.
    texts = [" ".join("x" if j == 50 * k else f"w{j}" for j in range(400)) for k in (1, 2)]
    plans = {b: s for b in range(24) if (s := ngram_join.scheme(b, 40))}
    frame = pd.DataFrame({"block": 3, "doc_order": range(2), "packed": [zstandard.compress(t.encode()) for t in texts]})
    for portion in (1 << 19, 16):
        monkeypatch.setattr(ngram_join, "PORTION", portion)
        sent = pd.concat(ngram_join._indexed(iter([frame]), 1, plans, 4, 85))
        out = pd.concat(ngram_join._shared(iter([sent]), 85))
        assert len(out[out["size"] < 0]) == 2 and out[out["size"] < 0]["key"].nunique() == 1
    sets = np.array([1, 2, 1, 2, 1, 3, 2, 3], np.uint64)
    key, of = ngram_join.sharers(np.array([5, 5, 6, 6, 7, 7, 8, 8], np.uint32), sets, np.zeros(0, np.uint64))
    assert sorted(of.tolist()) == [1, 1, 2, 2, 3, 3] and len(set(key.tolist())) == 3
    assert not len(ngram_join.sharers(np.array([9, 9], np.uint32), sets[:2], key)[0])


def test_comparisons_in_place(monkeypatch):
    """Of cells of one name the pairs of different components that sketches leave, in tiles and across the ends of batches."""
    draw = np.random.default_rng(11)
    tokens = [np.unique(draw.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([base[: len(base) - 4], draw.integers(0, 1 << 63, 4).astype(np.uint64)])) for base in tokens for _ in range(5)]
    frame = pd.DataFrame({
        "key": 7, "low": 0, "high": 1, "node": range(15), "size": [len(s) for s in sets], "own": [k % 2 for k in range(15)],
        "tile": [k // 3 % 2 for k in range(15)], "sketch": [ngram_join.sketch(s) for s in sets],
    })
    met = lambda f: {tuple(r) for r in ngram_join._apart_by_little(f, 85).to_numpy().tolist()}
    alike = {(a, b) for a in range(15) for b in range(a + 1, 15) if a // 5 == b // 5 and a % 2 != b % 2}
    assert met(frame) == {(a, b) for a, b in alike if a // 3 % 2 != b // 3 % 2}
    assert met(frame.assign(high=0)) == alike
    monkeypatch.setattr(ngram_join, "PORTION", 16)
    assert met(frame.assign(high=0)) == alike and met(frame.assign(key=range(15))) == set()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_groups_just_under_the_threshold(documents, monkeypatch, n, percent):
    """Very many texts that share a passage, and near copies on both sides of the threshold; names dealt into many tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    draw, base = random.Random(n), [f"b{k}" for k in range(90)]
    texts = [" ".join(w if draw.random() > p else f"c{draw.randrange(10**6)}" for w in base) for p in (0.01, 0.015, 0.02, 0.03) for _ in range(12)]
    texts += [" ".join([*base[:50], *(f"d{draw.randrange(10**6)}" for _ in range(40))]) for _ in range(30)]
    shingles = [frozenset(tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(shingles[a] & shingles[b]) >= percent * len(shingles[a] | shingles[b])]
    expected = reachable(range(len(texts)), links)
    got = ngram_join.near_components(documents(*[(k, t, "s") for k, t in enumerate(texts)]), n, percent)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == expected
    assert len(set(expected.values())) > 31


def test_pairs_around_one_set_meet_in_one_task(spark, monkeypatch):
    """A text goes to a task once, not once for each of its pairs; very many pairs around one set are spread."""
    among = [(a, b) for a in range(10, 40) for b in range(a + 1, 40)]
    around = [(k, 1000) for k in range(100, 300)]
    pairs = spark.createDataFrame(among + around, "a long, b long")
    dealt = [tuple(r) for r in ngram_join.dealt_pairs(pairs, 64).collect()]
    assert sorted(r[:2] for r in dealt) == among + around
    assert len({t for a, _, t in dealt if a < 40}) == 1 and len({t for a, _, t in dealt if a >= 100}) == 1
    monkeypatch.setattr(ngram_join, "TILE", 50)
    dealt = [tuple(r) for r in ngram_join.dealt_pairs(pairs, 64).collect()]
    assert sorted(r[:2] for r in dealt) == among + around
    assert len({t for a, _, t in dealt if a < 40}) > 3 and 1 < len({t for a, _, t in dealt if a >= 100}) <= 4
    assert ngram_join.dealt_pairs(pairs.limit(0), 64).count() == 0


def test_rounds_leave_no_shuffle_files(spark, documents):
    texts = [(k, " ".join(f"x{k}" if j == 9 * (k % 5) else f"w{k // 5}-{j}" for j in range(200)), "a") for k in range(20)]
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    there = lambda: set(Path(spark.sparkContext._temp_dir).parents[1].glob("blockmgr-*/*/shuffle_*.data"))
    old = there()
    found = ngram_join.near_components(documents(*texts))
    for _ in range(50):  # files go in the background
        if not there() - old:
            break
        time.sleep(0.2)
    assert not there() - old
    assert spark.conf.get(setting, None) == before
    assert sorted(tuple(r) for r in found.collect()) == [(k, 197, k // 5 * 5) for k in range(20)] == sorted(tuple(r) for r in found.collect())


def test_links_of_a_large_group_are_few():
    """Of near copies that are all paired with each other, a task returns one link a set; what is not linked is compared."""
    texts = [" ".join(f"x{k}" if j == 40 * (k % 5) + 3 else f"w{k // 10}-{j}" for j in range(200)) for k in range(30)]
    contents = pd.DataFrame({"task": 0, "node": range(30), "packed": [zstandard.compress(t.encode()) for t in texts]})
    pairs = pd.DataFrame([(a, b, 0) for a in range(30) for b in range(a + 1, 30)], columns=["a", "b", "task"])
    found = [tuple(r) for r in ngram_join._similar(contents, pairs, 4, 85).to_numpy().tolist()]
    assert len(found) == 27 and reachable(range(30), found) == {k: k // 10 * 10 for k in range(30)}
    assert not len(ngram_join._similar(contents, pairs.iloc[:0], 4, 85)) and not len(ngram_join._similar(contents, pairs[pairs["b"] - pairs["a"] > 20], 4, 85))


def test_word_hashes_in_slices(monkeypatch):
    """A word has one hash wherever it stands, in short and in long texts, and one of its own."""
    draw = random.Random(8)
    words = [bytes(draw.choice(b"ab\xc3\xa4\x00\x1f") for _ in range(draw.choice((1, 2, 3, 5, 9, 127, 128, 129, 700)))) for _ in range(400)]
    text = b" \n" + b"".join(w + draw.choice((b" ", b"\t\x0b", b"\r\n  ", b"\x0c")) for w in words)
    whole = common.word_hashes(text)
    assert text.split() == words and len(whole) == len(words)
    assert [int(common.word_hashes(w)[0]) for w in words] == whole.tolist()
    assert len(set(whole.tolist())) == len(set(words))
    for size in (1, 50, 300, 2000):
        monkeypatch.setattr(common, "SLICE", size)
        assert (common.word_hashes(text) == whole).all() and len(common._hashes_of_slice(b" ")) == 0 == len(common.word_hashes(b" " * 3 * size))
    monkeypatch.undo()
    # Letters are looked up and added up for all words of a text at once: far fewer steps than words.
    steps = []
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    common.word_hashes(b"some words " * 2000)
    sys.setprofile(None)
    assert len(steps) < 200


# Memory of workers


def test_texts_reach_workers_in_batches_of_bounded_bytes(spark, documents, mixed_rows, monkeypatch):
    def held(frames):
        for frame in frames:
            yield pd.DataFrame({"bytes": [int(frame["text"].str.len().sum())]})

    long = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 200000) as text")
    with session.small_batches(spark):
        sent = [r["bytes"] for r in long.mapInPandas(held, "bytes long").checkpoint().collect()]
    assert sum(sent) == 64 * 200_000 and max(sent) <= session.BATCH_BYTES + 400_000
    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {"texts": [], "features": []}
    before = spark.conf.get(limit, None)
    texts, features = ngram_join.blocked_texts, quality_classifier.feature_table
    monkeypatch.setattr(ngram_join, "blocked_texts", lambda *a: seen["texts"].append(spark.conf.get(limit, None)) or texts(*a))
    monkeypatch.setattr(quality_classifier, "feature_table", lambda d: seen["features"].append(spark.conf.get(limit, None)) or features(d))
    docs = documents(*mixed_rows)
    ngram_join.near_components(docs).collect()
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    quality_classifier.scored(docs, labels)
    quality_classifier.keep_good(docs, labels)
    assert len(seen["texts"]) > 1 and len(seen["features"]) == 2
    assert {x for v in seen.values() for x in v} == {str(session.BATCH_BYTES)}
    assert spark.conf.get(limit, None) == before
