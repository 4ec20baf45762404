"""One key with nearly all rows: the same results as one key at a time, by tasks of like size."""

import datetime as dt
import random
import tracemalloc
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnscale.operators import retrieval, signals


def brute_velocity(rows, window, span, rate, samples, chars):
    found = {}
    by = defaultdict(list)
    for node, ts, n in rows:
        if n > 0:
            by[node].append((ts, n))
    for node, own in by.items():
        first = min(own)[0]
        for ts in sorted({t for t, _ in own}):
            recent = [n for t, n in own if ts - window < t <= ts]
            gone = ts - first
            if len(recent) >= samples and gone >= span and gone and len(recent) * 1000 / gone >= rate and sum(recent) / len(recent) >= chars:
                found[node] = ts
                break
    return sorted(found.items())


def brute_flatline(rows, window, quiet, ratio):
    found = {}
    by = defaultdict(list)
    for node, ts, n in rows:
        by[node].append((ts, max(n, 1)))
    for node, own in by.items():
        peak, start = 0, None
        for ts in sorted({t for t, _ in own}):
            recent = [(t, n) for t, n in own if ts - window <= t <= ts]
            rate = sum(n for _, n in recent) / max(ts - min(recent)[0], 1)
            peak = max(peak, rate)
            if start is not None and ts - start >= quiet:
                break
            if rate < ratio * peak:
                start = ts if start is None else start
            else:
                start = None
        if start is not None:
            found[node] = start + quiet
    return sorted(found.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("slices", [1, 3, None])
def test_slices_of_time(spark, seed, slices):
    r = random.Random(seed)
    rows = [("hot", r.randint(-500, 4000), r.choice([0, 1, 2, 3, 40])) for _ in range(500)] + [(f"n{r.randint(0, 9)}", r.randint(0, 2500), r.randint(0, 4)) for _ in range(200)]
    rows += [("gap", t, n) for t, n in ((0, 500), (1, 500), (900, 1), (1500, 1), (2600, 1), (5000, 1))] + [("one", 7, 3)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "node string, ts_ms long, chars_added long, event_id long")
    for window, span, rate, samples, chars in ((100, 200, 3.0, 3, 2.0), (37, 50, 0.5, 2, 1.0), (300, 1000, 1.0, 20, 8.0)):
        got = signals.velocity_candidates(df, window, span, rate, samples, chars, slices and slices * window)
        assert sorted((x.node, x.ts_ms) for x in got.collect()) == brute_velocity(rows, window, span, rate, samples, chars)
    for window, quiet, ratio in ((50, 300, 0.05), (20, 100, 0.3), (200, 800, 0.5)):
        got = signals.flatline_completion(df, window, quiet, ratio, slices and slices * window)
        assert sorted((x.node, x.completed_ms) for x in got.collect()) == brute_flatline(rows, window, quiet, ratio)


def test_a_slice_is_what_a_task_sorts(spark):
    """With all rows in one node, no window has more moments than a slice and its halo have milliseconds."""
    rows = spark.range(40_000).select(F.lit("hot").alias("node"), (F.col("id") % 8000).alias("ts_ms"), F.lit(1).cast("long").alias("chars_added"))
    sliced = signals.with_halo(signals.moments(rows, F.col("chars_added"), 10, 100)[0], 9, 100)
    counts = [x["count"] for x in sliced.groupBy("node", "slice").count().collect()]
    assert len(counts) == 81 and max(counts) <= 109 and sliced.filter("not halo").agg(F.sum("n")).head()[0] == 40_000


def brute_dedup(rows, size):
    kept, recent = [], defaultdict(list)
    for k, text, at, i in sorted(rows, key=lambda x: (str(x[0]), x[2], x[3])):
        if text:
            if text in recent[k]:
                continue
            recent[k] = [*recent[k], text][-size:]
        kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("side_by_side", [1, 2, 8])
@pytest.mark.parametrize("texts, size", [("cycle", 4), ("random", 3), ("random", 50), ("runs", 2)])
def test_pieces_of_one_client(spark, monkeypatch, side_by_side, texts, size):
    """Also where what a window holds changes all that comes after it."""
    monkeypatch.setattr(signals, "SIDE_BY_SIDE", side_by_side)
    r, day = random.Random(size), dt.datetime(2024, 1, 1)
    make = {"cycle": lambda i: f"t{i % (size + 1)}", "random": lambda i: r.choice("abcdefg"), "runs": lambda i: f"t{i // 7}"}[texts]
    rows = [("hot" if i % 9 else None if i % 2 else f"c{i % 5}", make(i) if i % 11 else "", day + dt.timedelta(seconds=i // 2), i) for i in range(400)]
    df = spark.createDataFrame(rows, "session_id string, text string, recorded_at timestamp, id long")
    got = signals.rolling_dedup(df.repartition(3), size=size, pieces=12)
    assert sorted(x.id for x in got.collect()) == brute_dedup(rows, size)


def test_a_session_of_most_turns(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SALT_TURNS", 20)
    r = random.Random(1)
    turns = [(i, "hot" if i % 10 else f"s{i % 3}", "p" if i % 17 else "q", "long enough text " * 4 if i % 13 else "short", i) for i in range(600)]
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)] if i % 7 else [1.0, 0.0, 0.0, 0.0]) for i in range(600) if i % 4]
    drafts = [(f"d{i}", "hot" if i % 2 else f"s{i % 3}", "p", [r.gauss(0, 1) for _ in range(4)] if i else None) for i in range(12)]
    t = spark.createDataFrame(turns, "id long, chat_session_id string, provider string, text string, n long")
    v = spark.createDataFrame(vectors, "timeline_id long, embedding array<float>")
    d = spark.createDataFrame(drafts, "draft_id string, chat_session_id string, provider string, query_embedding array<float>")
    got = retrieval.topk_similar(d, t, v, 5)
    assert set(t.columns) | {"draft_id", "distance", "rank"} == set(got.columns)
    found = defaultdict(list)
    for x in got.collect():
        found[x.draft_id].append((x.distance, x.id))
    monkeypatch.setattr(retrieval, "SALT_TURNS", 10**9)
    want = defaultdict(list)
    for x in retrieval.topk_similar(d, t, v, 5).collect():
        want[x.draft_id].append((x.distance, x.id))
    assert {k: sorted(x) for k, x in found.items()} == {k: sorted(x) for k, x in want.items()} and len(want) == 11
    import numpy as np

    known = dict(vectors)
    for draft, session, provider, query in drafts[1:]:
        own = [i for i, s, p, text, _ in turns if (s, p) == (session, provider) and len(text) >= 50 and i in known]
        cos = lambda x: 1 - float(np.dot(np.float32(known[x]), np.float32(query)) / np.linalg.norm(np.float32(known[x])) / np.linalg.norm(np.float32(query)))  # noqa: B023, E731
        nearest = sorted((round(cos(i), 6), i) for i in own)[:5]
        assert [i for _, i in sorted(want[draft])] == [i for _, i in nearest]


def table_diff(a, b):
    """The whole table of best lengths, and the walk from its end."""
    best = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[-1][j] + 1 if x == y else max(best[-1][j + 1], row[j]))
        best.append(row)
    i, j, kinds = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            kinds.append("unchanged")
            i, j = i - 1, j - 1
        elif j and (not i or best[i][j - 1] >= best[i - 1][j]):
            kinds.append("added")
            j -= 1
        else:
            kinds.append("removed")
            i -= 1
    return kinds


def test_diffs_have_the_ties_of_the_whole_table():
    r = random.Random(9)
    for _ in range(600):
        letters = "abcdefgh"[: r.randint(1, 8)]
        a, b = ([r.choice(letters) for _ in range(r.randint(0, 30))] for _ in range(2))
        assert list(signals.edits(a, b)) == table_diff(a, b)
    assert signals.word_diff_segments("", "") == [] and signals.word_diff_segments("a b", "") == [("removed", "a b")]


@pytest.mark.parametrize("words", [50, 10**9])
def test_long_diffs_take_little_memory(monkeypatch, words):
    r = random.Random(1)
    a = [f"w{r.randint(0, words)}" for _ in range(60_000)]
    b = [w if r.random() < 0.9 else "new" for w in a if r.random() < 0.95]
    tracemalloc.start()
    kinds = list(signals.edits(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(kinds) - kinds.count("removed") == len(b) and len(kinds) - kinds.count("added") == len(a)
