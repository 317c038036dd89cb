"""Messages and arrays of the byte repeats stay small however much repeats, and say the same."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
import zstandard

from clinicframe.llm import suffix_dedup

LENGTH = 100


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(400)}" for _ in range(n))


def of_blocks(rows, blocks):
    packed = [(order % blocks, order, zstandard.compress(text)) for order, text in rows]
    return [f for _, f in pd.DataFrame(packed, columns=["block", "doc_order", "packed"]).groupby("block")]


def messages(frames, owners):
    """What blocks send to owners."""
    anchors = pd.concat([suffix_dedup._anchors(f, owners, LENGTH) for f in frames])
    shared = pd.concat([suffix_dedup._shared(g) for _, g in anchors.groupby("owner")])
    return pd.concat([suffix_dedup._sent(f, shared[shared["block"] == f["block"].iloc[0]], 2 * owners, LENGTH) for f in frames])


def repeats(sent):
    return pd.concat([suffix_dedup._repeats(g, LENGTH) for _, g in sent.groupby("owner")])


def cut(frames, found):
    return sorted(r for f in frames for r in suffix_dedup._cut(f, found[found["block"] == f["block"].iloc[0]], LENGTH).itertuples(index=False, name=None))


def expected(rows):
    places = {}
    for i, data in rows:
        for k in range(len(data) - LENGTH + 1):
            places[data[k : k + LENGTH]] = min(places.get(data[k : k + LENGTH], (i, k)), (i, k))
    out = []
    for i, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - LENGTH + 1):
            if places[data[k : k + LENGTH]] < (i, k):
                gone[k : k + LENGTH] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def edited(text, step, at, letter="X"):
    out = list(text)
    for k in range(at, len(out), step):
        out[k] = letter
    return "".join(out)


@pytest.mark.parametrize(("hot", "suffixes", "copied"), [(2000, 1 << 17, 1 << 14), (2000, 50, 3), (0, 50, 3), (8, 200, 5)])
def test_repeats_are_those_of_a_comparison(monkeypatch, hot, suffixes, copied):
    """For copies, edited copies, a line in many texts, periods and equal rows; anchors split up or not, arrays and copying in portions or not."""
    for name, value in (("HOT", hot), ("SUFFIXES", suffixes), ("COPIED", copied), ("PART", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    base, line = prose(1, 300), prose(2, 25)
    texts = [base, base, edited(base, 151, 20), edited(base, 230, 90, "Y"), base[200:900], prose(3, 200) + base[:400], "ab " * 200, "é" * 150, "short", ""]
    texts += [f"{prose(10 + k, 20)} {line} {prose(40 + k, 20)}" for k in range(15)]
    rows = [(k, t.encode()) for k, t in enumerate(texts)]
    rows += [rows[3], rows[0]]
    frames = of_blocks(rows, 3)
    got = cut(frames, repeats(messages(frames, 3)))
    assert sum(r[2] for r in got) > 3000
    assert got == expected(rows)


def test_bytes_of_copies_are_not_sent():
    """A text that only comes as whole copies goes to owners as its anchors."""
    rows = [(k, prose(100 + k % 20, 800).encode()) for k in range(40)]
    sent = messages(of_blocks(rows, 2), 2)
    bytes_sent = sum(len(x) for c in sent.columns if sent[c].dtype == object for x in sent[c])
    assert bytes_sent < 0.5 * sum(len(t) for _, t in rows)


def test_strings_of_a_split_anchor_go_by_their_hash(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    line = prose(5, 18)
    rows = [(k, f"{prose(200 + k, 25)} {line} {prose(500 + k, 25)}".encode()) for k in range(200)]
    sent = messages(of_blocks(rows, 2), 2)
    bytes_sent = sum(len(x) for c in sent.columns if sent[c].dtype == object for x in sent[c])
    strings = 200 * 30
    assert bytes_sent < 60 * strings  # the strings have 100 bytes each


def test_memory_of_an_owner_does_not_follow_what_repeats():
    """Edited copies of more text: an owner's arrays are made for some anchors at a time."""
    texts = [prose(600 + k, 6000) for k in range(12)]
    rows = [(2 * k + j, (edited(t, 160, 50) if j else t).encode()) for k, t in enumerate(texts) for j in (0, 1)]
    sent = messages(of_blocks(rows, 2), 1).assign(owner=0)
    tracemalloc.start()
    try:
        suffix_dedup._repeats(sent, LENGTH)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 * sum(len(t) for _, t in rows)
