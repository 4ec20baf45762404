"""Vector codes against plain k-means in Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscale.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q string, near int, extra double"


def brute_force(rows, parts=4, entries=256, rounds=4, scale=1024):
    """[(vec_id, label, code, error)] and the codebooks, one vector at a time."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(-(-max((len(r[1]) for r in kept), default=0) // parts), 1) * parts
    whole = [[max(-vc.MOST, min(vc.MOST, math.floor(scale * float(np.float32(x))))) for x in r[1]] for r in kept]
    whole = [q + [0] * (width - len(q)) for q in whole]
    d = width // parts
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    cut = [[q[p * d : p * d + d] for p in range(parts)] for q in whole]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (apart(x, book[e]), e))
    for _ in range(rounds):
        codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if own:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(r[0], r[2], code, sum(apart(c[p], books[p][code[p]]) for p in range(parts))) for r, c, code in zip(kept, cut, codes, strict=True)], books


def some_rows(n=220, d=8, seed=1, spread=0.05):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.4) for _ in range(d)] for _ in range(12)]
    rows = [(i if i % 23 else None, [x + r.gauss(0, spread) for x in r.choice(middles)], i % 5 if i % 7 else None) for i in range(n)]
    rows += [rows[3], rows[4], (5, [0.25] * d, 1), (5, [0.25] * d, 2), (1000, None, 1), (1001, [None] * d, 1), (1002, [float("nan")] * d, 1), (1003, [float("inf")] * d, 1)]
    return rows + [(2000 + i, [0.5] * d, 9) for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "q", 1, 0.5) for r in rows], SCHEMA)


def plain(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("entries, rounds, d, kept", [(16, 4, 8, 4), (256, 4, 8, 16), (40, 6, 12, 2), (1, 2, 8, 16), (24, 9, 8, 1)])
def test_matches_brute_force(spark, monkeypatch, entries, rounds, d, kept):
    monkeypatch.setattr(vc, "FIRST_KEPT", kept)
    monkeypatch.setattr(vc, "LEAST_KEPT", 1)
    rows = some_rows(d=d)
    coded, books = vc.fit_codes(frame(spark, rows), ["vec_id", "label"], entries=entries, rounds=rounds)
    want, want_books = brute_force(rows, entries=entries, rounds=rounds)
    assert books.tolist() == want_books
    assert plain([(r.vec_id, r.label, r.code, r.error) for r in coded.collect()]) == plain(want)


def test_large_components_are_verified_in_integers(spark):
    """Doubles can't tell these apart; the integers can."""
    r = random.Random(5)
    rows = [(i, [r.choice([-1, 1]) * (16_000.0 + r.randint(0, 3) / 1024) for _ in range(64)], 1) for i in range(60)]
    rows += [(100 + i, [3e38, -3e38] * 32, 2) for i in range(3)]
    coded, books = vc.fit_codes(frame(spark, rows), ["vec_id"], entries=20)
    want, want_books = brute_force(rows, entries=20)
    assert books.tolist() == want_books
    assert plain([(r.vec_id, r.code, r.error) for r in coded.collect()]) == plain([(w[0], w[2], w[3]) for w in want])


def test_lengths_differ(spark):
    rows = [(i, [0.01 * i] * (i % 7), 0) for i in range(40)]
    coded, books = vc.fit_codes(frame(spark, rows), ["vec_id"], entries=8)
    want, want_books = brute_force(rows, entries=8)
    assert books.tolist() == want_books
    assert plain([(r.vec_id, r.code, r.error) for r in coded.collect()]) == plain([(w[0], w[2], w[3]) for w in want])


def test_bounds_hold_while_entries_move():
    """Whatever is skipped, a lower bound never lies over a distance, nor an upper one below it."""
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (400, 6))
    books = x[:50].copy()
    code, upper, near, lower, outer = vc.nearest_of_all(x, books, 5)
    skipped = 0
    for _ in range(12):
        new = books + rng.integers(-12, 13, books.shape)
        moved = np.sqrt(vc.squares(new, books))
        needed = vc.step(x, new, moved, code, upper, near, lower, outer)
        books, skipped = new, skipped + int((needed == 0).sum())
        apart = np.sqrt(((x[:, None] - books) ** 2).sum(-1))
        exact = ((x[:, None] - books) ** 2).sum(-1)
        assert (code == exact.argmin(axis=1)).all()
        assert (upper >= apart[np.arange(400), code]).all()
        assert (np.diff(lower, axis=1) >= -1e-6).all() or (lower <= np.take_along_axis(apart, near.astype(int), 1)).all()
        assert (lower <= np.take_along_axis(apart, near.astype(int), 1)).all()
        rest = apart.copy()
        np.put_along_axis(rest, near.astype(int), np.inf, 1)
        rest[np.arange(400), code] = np.inf
        assert (outer <= rest.min(axis=1)).all()
    assert skipped > 400


def test_kept_bounds_adapt():
    near, lower = np.arange(12).reshape(1, 2, 6).astype(np.int16), np.arange(12.0).reshape(1, 2, 6)
    state = vc.Bounds(np.zeros((1, 2)), np.zeros((1, 2)), near, lower, np.full((1, 2), 20.0))
    few = state.kept(2)
    assert few.near.tolist() == [[[0, 1], [6, 7]]] and few.outer.tolist() == [[2.0, 8.0]]
    assert few.kept(4).near.tolist() == [[[0, 1, -1, -1], [6, 7, -1, -1]]] and np.isinf(few.kept(4).lower[0, 0, 2])


def test_depths_decide_what_is_kept(spark):
    rows = lambda *depths: spark.createDataFrame([([n],) for n in depths], "needed array<smallint>")
    assert vc.kept_next(rows(*[17] * 20, *[0] * 80), 16, 256) == 32
    assert vc.kept_next(rows(*[17] * 20, *[0] * 80), 16, 64) == 16
    assert vc.kept_next(rows(*[0] * 99, 9), 16, 256) == 4
    assert vc.kept_next(rows(*[0] * 90, *[9] * 10), 16, 256) == 9


def test_digest_and_odd_tables(spark):
    rows = some_rows()
    out = vc.vector_codes_digest(frame(spark, rows)).collect()
    want, books = brute_force(rows)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert plain([(r.vec_id, r.code, r.error, r.label_error) for r in out]) == plain([(i, "".join(f"{c:02x}" for c in code), e, sums[label]) for i, label, code, e in want])
    assert {r.codebooks_sha256 for r in out} == {vc.books_hash(np.array(books))}
    none = frame(spark, [(1, None, 1)])
    assert vc.vector_codes_digest(none).count() == 0 and vc.vector_codes_digest(none.filter(F.lit(False))).count() == 0
    assert [tuple(r) for r in vc.fit_codes(frame(spark, [(1, [], 1)]), ["vec_id", "extra"])[0].collect()] == [(1, 0.5, [0, 0, 0, 0], 0)]
