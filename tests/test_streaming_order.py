"""Stateful streams: rows in any order, one file a batch, give the batch form's rows; state goes with silence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from turnscale.operators import rollups, signals
from turnscale.operators.embedding import hash_embedder
from turnscale.plans import composite_queries
from turnscale.streaming import jobs

LATE, NEVER, LAST = "1000 days", 10**15, 4_102_444_800_000


def streamed(spark, rows, schema, path, last, seed):
    """A file for each of five shuffled pieces, then one with a row far later."""
    r = random.Random(seed)
    rows = rows[:]
    r.shuffle(rows)
    for n in range(5):
        spark.createDataFrame(rows[n::5] or rows[:0], schema).coalesce(1).write.mode("append").parquet(str(path))
    spark.createDataFrame([last], schema).coalesce(1).write.mode("append").parquet(str(path))
    return jobs.with_schema(spark, str(path), spark.createDataFrame([], schema).schema, 1)


def run(spark, query, name, path):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_velocity(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [("late", t, 3) for t in (300, 0, 100, 200)] + [(f"n{i % 4}", r.randint(0, 4000), r.randint(0, 5)) for i in range(60)]
    schema = "node string, ts_ms long, chars_added long"
    want = plain(signals.velocity_candidates(spark.createDataFrame(rows, schema)))
    assert ("late", 200, "velocity", 0.6) in want and len(want) > 2
    stream = streamed(spark, rows, schema, tmp_path / "in", ("last", LAST, 1), seed)
    assert run(spark, jobs.velocity(stream, late=LATE, forget_ms=NEVER), f"velocity{seed}", tmp_path / "c") == want


def test_dedup_and_roots(spark, tmp_path):
    r, day = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(f"c{i % 2}", r.choice(["a", "b", "c", "d", ""]), day + dt.timedelta(microseconds=700 * i), i, r.choice([None, 1.5])) for i in range(60)]
    schema = "session_id string, text string, recorded_at timestamp, id long, extra double"
    want = plain(signals.rolling_dedup(spark.createDataFrame(rows, schema), size=2))
    stream = streamed(spark, rows, schema, tmp_path / "d", ("last", "z", dt.datetime(2090, 1, 1), 0, 0.0), 1)
    assert run(spark, jobs.rolling_dedup(stream, size=2, late=LATE, forget_ms=NEVER), "dedup_order", tmp_path / "dc") == want
    rows = [("c", i, r.sample(["file:///a", "file:///b", "http://x", "file:///c"], r.randint(0, 3))) for i in range(1, 40)]
    schema = "client_id string, ts long, roots array<string>"
    want = plain(signals.roots_diff(spark.createDataFrame(rows, schema)))
    stream = streamed(spark, rows, schema, tmp_path / "r", ("last", LAST, None), 2)
    assert run(spark, jobs.roots(stream, late=LATE, forget_ms=NEVER), "roots_order", tmp_path / "rc") == want


def test_vote_counts_the_latest_of_a_detector(spark, tmp_path):
    rows = [("a", "x", 0.6, 1), ("a", "x", 0.1, 2), ("a", "y", 0.5, 3), ("a", "x", 0.5, 4), ("b", "x", 0.69, 5)]
    schema = "node string, detector string, confidence double, ts_ms long"
    stream = streamed(spark, rows, schema, tmp_path / "v", ("last", "x", 0.1, LAST), 4)
    assert run(spark, jobs.vote(stream, late=LATE, forget_ms=NEVER), "vote_order", tmp_path / "vc") == [("a", 4, 0.75)]


def test_completion_by_event_although_silence_was_nearer(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("a", at(0), "mutation", 1500), ("a", at(1400), "sse_end", 1500), ("a", at(1450), "mutation", 1500), ("b", at(0), "mutation", 1500), ("b", at(1300), "stop_gone", 1500), ("b", at(5000), "sse_end", 1500)]
    rows += [("c", at(0), "mutation", 1500), ("c", at(1000), "flatline", 1500), ("d", at(5), "sse_end", 0), ("d", at(5), "stop_gone", 0)]
    schema, base = "node string, ts timestamp, kind string, debounce_ms long", 1704067200000
    stream = streamed(spark, rows, schema, tmp_path / "s", ("last", dt.datetime(2090, 1, 1), "mutation", 1500), 5)
    want = [("a", base + 1700, "sse_interceptor"), ("b", base + 1500, "debounce"), ("c", base + 1000, "flatline"), ("d", base + 305, "sse_interceptor")]
    assert run(spark, jobs.completion(stream, late=LATE), "ends_order", tmp_path / "sc") == want


STORES = ["waiting", "clock"]


@pytest.mark.parametrize("job, stores", [("completion", ["ends"]), ("velocity", ["recent", "node"]), ("vote", ["fired"])])
def test_state_goes_with_silence(spark, tmp_path, job, stores):
    """Of thousands of nodes that have been silent for long enough, none is left in the state; the last one is."""
    hour = 3_600_000
    nodes = spark.range(3000).select(F.format_string("n%05d", "id").alias("node"), (F.col("id") % 7 + F.lit(1704067200000)).alias("ts_ms"))
    last = spark.range(1).select(F.lit("last").alias("node"), F.lit(1704067200000 + 50 * hour).alias("ts_ms"))
    path = str(tmp_path / "in")
    for part in (nodes, last.union(spark.range(1).select(F.lit("second").alias("node"), F.lit(1704067200000 + 60 * hour).alias("ts_ms")))):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.with_schema(spark, path, nodes.schema, 1)
    if job == "completion":
        rows = jobs.completion(stream.select("node", F.timestamp_millis("ts_ms").alias("ts"), F.lit("mutation").alias("kind"), F.lit(1500).cast("long").alias("debounce_ms")), forget_ms=hour)
    elif job == "velocity":
        rows = jobs.velocity(stream.withColumn("chars_added", F.lit(3).cast("long")), forget_ms=hour)
    else:
        rows = jobs.vote(stream.withColumns({"detector": F.lit("x"), "confidence": F.lit(0.9)}), forget_ms=hour)
    checkpoint = tmp_path / "c"
    found = run(spark, rows, f"silence_{job}", checkpoint)
    assert job == "velocity" or len(found) >= 3000
    for store in [*stores, *STORES]:
        reader = spark.read.format("statestore").option("stateVarName", store).load(str(checkpoint))
        assert reader.count() <= 2, store


@pytest.mark.parametrize("job", ["completion", "vote", "roots", "velocity"])
def test_keys_share_state(spark, tmp_path, monkeypatch, job):
    """A thousand keys have as many states as there are buckets, and what comes out is right for each."""
    monkeypatch.setattr(jobs, "BUCKETS", 4)
    day, path = 86_400_000, str(tmp_path / "in")
    times = F.explode(F.array(*[F.lit(n).cast("long") for n in (0, 100, 200, 300)]))
    rows = spark.range(1000).select(F.format_string("n%04d", "id").alias("node"), "id", times.alias("ms"))
    for part in (rows.filter("(id + ms / 100) % 2 = 0"), rows.filter("(id + ms / 100) % 2 = 1"), spark.range(1).select(F.lit("last").alias("node"), F.lit(0).cast("long").alias("id"), F.lit(9 * day).alias("ms"))):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.with_schema(spark, path, rows.schema, 1)
    late = {"late": "1 day", "forget_ms": NEVER}
    if job == "completion":
        events = stream.select("node", F.timestamp_millis(F.col("ms") + day).alias("ts"), F.when(F.col("id") % 2 == 0, "mutation").otherwise("flatline").alias("kind"), F.lit(150).cast("long").alias("debounce_ms"))
        out, store = jobs.completion(events, **late), "ends"
        want = [(f"n{n:04}", day + 450, "debounce") if n % 2 == 0 else (f"n{n:04}", day, "flatline") for n in range(1000)]
    elif job == "vote":
        votes = stream.select("node", F.col("ms").alias("ts_ms"), F.format_string("d%d", "ms").alias("detector"), ((F.col("id") % 2 + 2) / 10).alias("confidence"))
        out, store = jobs.vote(votes, 0.6, **late), "latest"
        want = [(f"n{n:04}", 200, 0.657) for n in range(1, 1000, 2)]
    elif job == "roots":
        lists = stream.select(F.col("id").alias("client_id"), F.col("ms").alias("ts"), F.when(F.col("ms") < 200, F.array(F.format_string("file:///%d", "id"))).otherwise(F.array(F.lit("file:///all"))).alias("roots"))
        out, store = jobs.roots(lists.filter("client_id > 0 or ts > 1000"), **late), "roots"
        want = [row for n in range(1, 1000) for row in [(n, 0, "added", f"file:///{n}"), (n, 200, "added", "file:///all"), (n, 200, "removed", f"file:///{n}")]]
    else:
        added = stream.select("node", F.col("ms").alias("ts_ms"), (F.col("id") % 3 * 2).alias("chars_added"))
        out, store = jobs.velocity(added, 1000, 150, 1.0, 3, 3.0, **late), "node"
        want = [(f"n{n:04}", 200, "velocity", signals.VELOCITY_CONFIDENCE) for n in range(1000) if n % 3 == 2]
    found = run(spark, out, f"shared_{job}", tmp_path / "c")
    assert found == sorted(want, key=str)
    for name in (store, "clock"):
        assert 0 < spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "c")).count() <= 4


def test_embedding_attempts(spark, tmp_path):
    path, rows = str(tmp_path / "e"), spark.createDataFrame([(1, "good"), (2, "bad"), (3, " ")], "id long, text string")

    def embedder(texts):
        if "bad" in texts:
            raise ConnectionError("away")
        return hash_embedder(8)(texts)

    sink, none = jobs.embed_sink(path, embedder, 8, batch=1), rows.limit(0)
    queue = lambda: [tuple(r) for r in jobs.read_embed_queue(spark, path).select("timeline_id", "attempts", "last_error").collect()]
    for number, want in enumerate([1, 2, 3, 3]):
        sink(rows if number == 0 else none, number)
        assert queue() == [(2, want, "unavailable")]
        sink(rows if number == 0 else none, number)  # it comes again
        assert queue() == [(2, want, "unavailable")]
    found = sorted(map(tuple, spark.read.parquet(f"{path}/results").select("batch", "timeline_id", "status").collect()))
    assert found == [(0, 1, "ok"), (0, 2, "unavailable"), (0, 3, "blank"), (1, 2, "unavailable"), (2, 2, "unavailable")]
    later = str(tmp_path / "f")
    jobs.embed_sink(later, embedder, 8, batch=1)(rows, 0)
    jobs.embed_sink(later, hash_embedder(8), 8)(none, 1)
    assert jobs.read_embed_queue(spark, later).count() == 0


def test_live_metrics(spark, tmp_path):
    schema = "id long, session_id string, chat_session_id string, client_source string, injected boolean, cache_hit_estimated boolean, actual_input_tokens long, actual_output_tokens long, saved_input_cost_usd double, saved_cache_cost_usd double, saved_output_cost_usd double"
    r = random.Random(1)
    rows = [(i, r.choice(["test-1", "ses_1", "ses_2", None]), r.choice(["c1", "c2", "c3", None]), r.choice(["chat", "coding", None]), i % 3 == 0, i % 4 == 0, i, 2 * i, i / 1000, None if i % 5 else 0.01, i / 7000) for i in range(90)]
    turns, sessions = spark.createDataFrame(rows, schema), spark.createDataFrame([("c1",), ("c2",), ("c9",)], "id string")
    assert plain(rollups.usage_stats_of(rollups.usage_sums(turns), sessions)) == plain(rollups.usage_stats(turns, sessions))
    shown = []
    sink = lambda: jobs.live_metrics_sink(str(tmp_path / "m"), lambda: sessions, lambda row: shown.append(tuple(row.head())), 4)
    for number in range(3):
        sink()(turns.filter(F.col("id") % 3 == number), number)
        want = tuple(rollups.usage_stats(turns.filter(F.col("id") % 3 <= number), sessions).head())
        assert shown[-1] == want and len(shown) == number + 1
        sink()(turns.filter(F.col("id") % 3 == number), number)  # after a restart it comes again: nothing is added or shown
        assert len(shown) == number + 1
    sink()(turns.limit(0), 3)
    assert len(shown) == 3


@pytest.mark.parametrize("name", ["stream_vote", "stream_roots", "stream_velocity"])
def test_few_state_partitions(spark, tmp_path, monkeypatch, name):
    """A session's 200 partitions aren't those of the state, its changes are committed, and a batch is read by many tasks."""
    setting = "spark.sql.shuffle.partitions"
    monkeypatch.setattr(composite_queries, "scratch", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get(setting)
    spark.conf.set(setting, 200)
    try:
        found = composite_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(setting) == "200"
        assert found.count() > 0
    finally:
        spark.conf.set(setting, before)
    state = tmp_path / "stream-checkpoint" / "state" / "0"
    assert len([p for p in state.iterdir() if p.name.isdigit()]) == jobs.PARTITIONS
    assert list(state.rglob("*.changelog"))
    assert len(list((tmp_path / "arrivals").glob("*.parquet"))) == 3 * composite_queries.FILES + 1


def test_roots_of_odd_lists(spark, tmp_path):
    odd = 'file:///"a"\n\\é😀'
    rows = [("c", 1, [odd, None, "", odd, "https://x"]), ("c", 2, None), ("c", 3, [odd]), ("c", 4, [odd, odd]), ("c", 5, []), ("d", 6, [None])]
    stream = streamed(spark, rows, "client_id string, ts long, roots array<string>", tmp_path / "r", ("last", LAST, None), 2)
    want = [("c", 1, "added", odd), ("c", 2, "removed", odd), ("c", 3, "added", odd), ("c", 5, "removed", odd)]
    assert run(spark, jobs.roots(stream, late=LATE, forget_ms=NEVER), "odd_roots", tmp_path / "rc") == want
