"""Whitening, exact search and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from clinicframe.llm import impact_search, orchard_codes, polynomial_whitening
from clinicframe.llm.queries import ORACLES, QUERIES

#: Columns whose names the operators use inside.
CLASHING = {"x": 1, "dim": 2, "n": 3, "block": 4, "shard": 5, "rank": 6, "score": 7, "code": 8, "vec_order": 9}
NAN, INF = float("nan"), float("inf")
LAST = (1 << 63) - 1


@pytest.fixture
def embeddings(spark):
    def build(*rows, element="double"):
        schema = f"vec_id long, embedding array<{element}>, label int, " + ", ".join(f"{c} int" for c in CLASHING)
        return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], b, *CLASHING.values()) for i, v, b in rows], schema)

    return build


def odd_rows(dim):
    """Vectors that take no part."""
    return [(901, None, 1), (902, [None] * dim, 1), (903, [NAN] * dim, None), (904, [1.0] * (dim - 1) + [INF], 2), (905, [], 1), (920, [-INF] * dim, 1)]


def usable(rows):
    return [(i, v, b) for i, v, b in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def cut(value):
    return max(-LAST - 1, min(LAST, value))


def whole(vector, factor):
    return [cut(math.floor(Fraction(c) * factor)) for c in vector]


def spread_rows(dim, n, seed, scale=1.0):
    draw = np.random.default_rng(seed)
    mixing = draw.normal(size=(dim, dim)) * np.linspace(2, 0.1, dim)
    return [(i, (draw.normal(size=dim) @ mixing * scale).tolist(), int(draw.integers(3))) for i in range(n)]


# Whitening


def test_polynomial_of_a_small_matrix_is_exact(spark):
    m = np.array([[4, 1, 0], [1, 3, 10**30], [0, 10**30, 10**61]], object)
    trace = int(sum(m.diagonal()))
    minors = sum(int(m[i, i] * m[j, j] - m[i, j] * m[j, i]) for i in range(3) for j in range(i + 1, 3))
    det = int(4 * (3 * 10**61 - 10**60) - 10**61)
    assert polynomial_whitening.characteristic_polynomial(spark, m) == [-det, minors, -trace, 1]


def test_roots_that_repeat_and_roots_that_nearly_do():
    def product(roots):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
        return c

    big = 10**40
    found = polynomial_whitening.largest_roots(product([big, big, big - 1, 7, 0, 0]), 4)
    assert [(round(r.value), r.times) for r in found] == [(big, 2), (big - 1, 1), (7, 1)]
    assert polynomial_whitening.largest_roots(product([5, 0]), 4) == [(Fraction(5), 1)]
    assert polynomial_whitening.roots_above(product([1, 2, 3]), Fraction(2)) == 1


def check_whitening(frame, rows, dim):
    kept = [(i, whole(v, 256)) for i, v, _ in usable(rows) if len(v) == dim]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array([[float(n * c - s) for c, s in zip(x, sums)] for x in fit]) / n
    covariance = centre.T @ centre / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = polynomial_whitening.whiten(frame).toPandas().astype(object)
    assert len(got) == len(kept) * min(4, dim)
    order = lambda ids: [LAST if i is None or i != i else i for i in ids]
    assert sorted(order(got["vec_id"])) == sorted(order([i for i, _ in kept for _ in range(min(4, dim))]))
    named = {i: x for i, x in kept}
    signs = {}
    for row in got.itertuples():
        if row.vec_id is None or row.vec_id != row.vec_id:
            continue
        x, k = named[row.vec_id], row.component - 1
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert row.n == n and int(row.deviation_text) == deviation
        assert row.deviation == deviation if deviation <= LAST else row.deviation is None or row.deviation != row.deviation
        assert row.explained == pytest.approx(values[k] / values.sum(), rel=1e-6)
        mine = (np.array([float(n * c - s) for c, s in zip(x, sums)]) / n) @ vectors[:, k] / np.sqrt(values[k])
        if abs(mine) > 1e-6:
            sign = signs.setdefault(k, np.sign(mine) * np.sign(row.whitened))
            assert row.whitened * sign == pytest.approx(mine, abs=1e-6, rel=1e-6)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    return got


def test_whitening_against_eigenvectors(embeddings):
    rows = spread_rows(6, 150, 1) + odd_rows(6) + [(300, [1.0, 2.0], 1), (301, [1.0, 2.0], 1)]
    rows += [(200, rows[3][1], 0), (200, rows[3][1], 0), (None, rows[5][1], None), (None, [0.5] * 6, 1)]
    check_whitening(embeddings(*rows), rows, 6)


def test_whitening_of_very_large_numbers_is_exact(embeddings):
    rows = spread_rows(3, 40, 2, scale=1e12)
    got = check_whitening(embeddings(*rows), rows, 3)
    assert got["deviation"].isna().all()


def test_whitening_without_variance(spark, embeddings):
    got = polynomial_whitening.whiten(embeddings((1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1))).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)
    line = [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(5)]
    got = polynomial_whitening.whiten(embeddings(*line)).collect()
    assert {(r["component"], r["whitened"] is None, round(r["explained"], 9)) for r in got} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    # A square: two equal roots, any pair of axes will do.
    got = polynomial_whitening.whiten(embeddings((1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [0.0, -1.0], 1))).collect()
    assert {round(r["explained"], 9) for r in got} == {0.5} and got[0]["identity_error"] < 1e-9


def test_empty_tables(embeddings):
    for rows in ([], odd_rows(4)):
        for run in (polynomial_whitening.whiten, impact_search.top_k, orchard_codes.encode):
            assert run(embeddings(*rows)).count() == 0


# Search


def brute_force(rows, k):
    kept = [(LAST if i is None else i, whole(v, 64)) for i, v, _ in usable(rows)]
    out = []
    for q, (name, x) in enumerate(kept):
        if name != LAST and name % 20 == 0:
            scored = sorted((-cut(sum(a * b for a, b in zip(x, y))), other) for c, (other, y) in enumerate(kept) if c != q and len(x) == len(y))
            out += [(name, rank, None if other == LAST else other, -s) for rank, (s, other) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def searched(frame, k):
    return sorted((tuple(r) for r in impact_search.top_k(frame, k).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def search_rows():
    rows = spread_rows(8, 400, 3, scale=0.05) + odd_rows(8) + [(-20, [0.0] * 8, 1)]
    # Copies of a query, ties, repeated rows, rows without id, another length, one alone in its length.
    rows += [(500 + i, rows[40][1], 1) for i in range(40)] + [(60, rows[60][1], 0), (60, rows[61][1], 0), (None, rows[80][1], 1), (None, rows[80][1], 1)]
    return rows + [(1000, [1.0, -1.0], 1), (1001, [1.0, 1.0], 2), (1002, [-3.0, 1.0], None), (1020, [1.0] * 5, 1)]


@pytest.mark.parametrize("cells", [1 << 22, 64 * 8])
def test_search_against_brute_force(embeddings, monkeypatch, cells):
    """In one shard, and in eight and more over several rounds."""
    monkeypatch.setattr(impact_search, "SHARD_CELLS", cells)
    rows = search_rows()
    assert searched(embeddings(*rows), 5) == brute_force(rows, 5)


def test_search_stops_early_and_stays_exact():
    draw = np.random.default_rng(4)
    x = np.floor(draw.normal(size=(3000, 32)) * np.linspace(12, 1, 32)).astype(np.int64)
    shard, stopped = impact_search.Shard(np.arange(3000), x), 0
    for query in x[:40]:
        exact = x @ query
        bar = np.sort(exact)[-11]
        for floor in (-LAST - 1, int(bar)):
            rows, scores = shard.possible(query, 11, floor)
            assert (scores == exact[rows]).all() and set(np.flatnonzero(exact >= bar)) <= set(rows)
            stopped += len(rows) < 3000
    assert stopped > 40


def test_queries_share_postings(monkeypatch):
    """A posting is read once for a group of queries, not once for each; a query with large numbers goes alone."""
    draw = np.random.default_rng(5)
    x = np.floor(draw.normal(size=(2000, 16)) * 20).astype(np.int64)
    shard, read = impact_search.Shard(np.arange(2000), x), []
    plain = impact_search.Shard._postings
    monkeypatch.setattr(impact_search.Shard, "_postings", lambda self, segments, *rest: read.extend(segments) or plain(self, segments, *rest))
    queries = np.concatenate([x[:50], x[50:51] << 45, x[51:100]])
    exact = [x.astype(object) @ q.astype(object) for q in queries]
    floors = np.array([-LAST - 1 if k % 2 else min(LAST, sorted(e)[-11]) for k, e in enumerate(exact)])
    for e, (rows, scores) in zip(exact, shard.searched(queries, 11, floors), strict=True):
        cut = [max(-LAST - 1, min(LAST, int(v))) for v in e]
        assert scores.tolist() == [cut[r] for r in rows] and {r for r in range(2000) if cut[r] >= sorted(cut)[-11]} <= set(rows.tolist())
    assert len(read) == len(set(read)) <= len(shard.axes)


def test_search_with_very_large_numbers(embeddings):
    rows = [(i * 10, [math.ldexp(s * (i + 1), p), 3.0 * i], 1) for i in range(6) for s, p in ((1, 40), (-1, 20), (1, 70))]
    assert searched(embeddings(*rows), 4) == brute_force(rows, 4)


# Codes


def brute_codes(rows, dim, parts, entries, rounds):
    kept = sorted(((LAST if i is None else i, whole(v, 256), b) for i, v, b in usable(rows) if len(v) == dim), key=lambda r: r[:2])
    width = dim // parts
    pieces = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    books = [[list(row[p]) for row in pieces[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda p, piece: min((apart(piece, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        books = [
            [
                [sum(c) // len(own) for c in zip(*own)] if (own := [row[p] for row, k in zip(pieces, picked) if k == e]) else books[p][e]
                for e in range(len(books[p]))
            ]
            for p in range(parts) for picked in [[near(p, row[p])[1] for row in pieces]]
        ]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    done = [(i, [near(p, row[p]) for p in range(parts)], b) for (i, _, b), row in zip(kept, pieces)]
    errors = [(i, "".join(f"{k:02x}" for _, k in best), cut(sum(d for d, _ in best)), b) for i, best, b in done]
    total = {}
    for _, _, e, b in errors:
        total[b] = total.get(b, 0) + e
    return sorted([(None if i == LAST else i, code, e, cut(total[b]), digest) for i, code, e, b in errors], key=repr)


def coded(frame, **options):
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in orchard_codes.encode(frame, **options).select(*columns).collect()), key=repr)


def test_codes_against_brute_force(embeddings):
    rows = spread_rows(12, 200, 6, scale=0.05) + odd_rows(12) + [(700, [1.0] * 7, 1), (701, [1.0, 2.0, 3.0, 4.0], 1)]
    rows += [(3, rows[9][1], None), (3, rows[9][1], None), (None, rows[11][1], 1), (None, rows[12][1], None)]
    # Whole numbers on a coarse grid, so that many distances are equal.
    grid = np.random.default_rng(7).integers(-1, 2, size=(60, 12)) / 256
    rows += [(-i, v.tolist(), None) for i, v in enumerate(grid, 1)]
    assert coded(embeddings(*rows), parts=4, entries=16) == brute_codes(rows, 12, 4, 16, 2)


def test_codes_of_few_and_of_very_large_vectors(embeddings):
    few = [(5, [1.0, 2.0, 3.0, 4.0], 1), (4, [1.0, 2.0, 3.0, 4.5], 1)]
    assert coded(embeddings(*few), parts=2) == brute_codes(few, 4, 2, 64, 2)
    rows = spread_rows(4, 60, 8, scale=1e9)
    assert coded(embeddings(*rows), parts=2, entries=8) == brute_codes(rows, 4, 2, 8, 2)


def test_neighbour_lists_spare_distances():
    """The walk meets fewer entries than there are, and ends at the nearest."""
    draw = np.random.default_rng(9)
    entries, x = draw.integers(-500, 500, size=(2, 64, 3)), draw.integers(-500, 500, size=(300, 6))
    books, calls = orchard_codes.Codebooks(entries), []
    plain = orchard_codes._apart
    orchard_codes._apart = lambda a, b: calls.append(len(a)) or plain(a, b)
    try:
        code, distance = books.nearest(x)
    finally:
        orchard_codes._apart = plain
    table = ((x.reshape(300, 2, 1, 3) - entries[None]) ** 2).sum(axis=3)
    assert (code == table.argmin(axis=2)).all() and (distance == table.min(axis=2)).all()
    assert sum(calls) < 0.7 * 300 * 2 * 64


@pytest.mark.parametrize("name", ["op12_impact_search", "op13_orchard_codes"])
def test_registered_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    theirs = connection.sql(ORACLES[name])
    mine = QUERIES[name](spark, folder).select(*theirs.columns)
    assert sorted(tuple(r) for r in mine.collect()) == sorted(theirs.fetchall())
