from __future__ import annotations

import random

import pytest

WORDS = [f"w{k}" for k in range(400)]
#: Columns whose names the operators use inside, to see that they do not clash.
CLASHING = {"block": "x", "key": "y", "size": "z", "row": "r", "part": "p", "rep": "q", "digest": "d"}


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, source), with extra columns of clashing names."""

    def build(*rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *CLASHING.values()) for i, t, s in rows], schema)

    return build


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture
def mixed_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages and rows that repeat."""
    passage, base = prose(1, 70), prose(2, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, prose(3, 90), "a"), (2, None, "a"), (3, "", None), (4, base, "b"), (5, base.replace(" ", "\t\n", 3), "b"), (6, " ".join(near), "a"),
        (7, prose(4, 30) + " " + passage + " " + prose(5, 20), "c"), (8, passage, None), (9, prose(6, 10) + " " + passage, "b"),
        (9, prose(6, 10) + " " + passage, "b"), (10, "one two", "c"), (11, "One TWO", "c"), (12, "ab " * 400, "a"), (13, prose(7, 20_000), "a"),
        (14, "é" * 300 + " " + passage, "b"), (None, base, "b"), (None, None, None), (15, " \n", "a"),
    ]
    return rows
