"""Stream results equal batch results on the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from turnscale.operators import signals, state
from turnscale.operators.embedding import hash_embedder
from turnscale.streaming import jobs


def run(spark, query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()))


def stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return jobs.with_schema(spark, str(path), spark.read.parquet(str(path)).schema, files)


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_rolling_dedup(spark, tmp_path):
    rows = [(f"c{i % 2}", ["a", "b", "c", ""][i % 4 if i < 8 else i % 3], at(i), i) for i in range(16)]
    df = spark.createDataFrame(rows, "session_id string, text string, recorded_at timestamp, id long")
    want = sorted(map(tuple, signals.rolling_dedup(df, size=2).collect()))
    assert run(spark, jobs.rolling_dedup(stream(spark, df, tmp_path / "in"), size=2), "dedup") == want


def test_velocity_and_vote(spark, tmp_path):
    rows = [("fast", 100 * i, 3) for i in range(6)] + [("slow", 1000 * i, 3) for i in range(6)] + [("tiny", 100 * i, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "node string, ts_ms long, chars_added long")
    want = sorted(map(tuple, signals.velocity_candidates(df).collect()))
    assert want == [("fast", 200, "velocity", 0.6)]
    assert run(spark, jobs.velocity(stream(spark, df, tmp_path / "v")), "velocity") == want
    votes = spark.createDataFrame([("a", "x", 0.6, 1), ("a", "y", 0.4, 2), ("a", "z", 0.9, 3), ("b", "x", 0.6, 1)], "node string, detector string, confidence double, ts_ms long")
    assert run(spark, jobs.vote(stream(spark, votes, tmp_path / "c")), "vote") == [("a", 2, 0.76)]


def test_roots(spark, tmp_path):
    rows = [("c", 1, ["file:///a", "http://x"]), ("c", 2, ["file:///a", "file:///b"]), ("c", 3, None), ("d", 1, [])]
    df = spark.createDataFrame(rows, "client_id string, ts long, roots array<string>")
    want = sorted(map(tuple, signals.roots_diff(df).collect()))
    assert len(want) == 4
    assert run(spark, jobs.roots(stream(spark, df, tmp_path / "r")), "roots") == want


def test_debounce_and_blackouts(spark, tmp_path):
    rows = [("p", "a", None, at(0)), ("p", "a", "b", at(300)), ("p", "a", None, at(2000)), ("p", "z", None, at(10_000_000))]
    df = spark.createDataFrame(rows, "project_id string, path string, dest_path string, ts timestamp")
    got = run(spark, jobs.debounce(stream(spark, df, tmp_path / "e")), "bursts")
    assert [(r[1], r[4]) for r in got] == [("a", 2), ("a", 1), ("b", 1)]
    busy = [("h", "s", at(10_000 * i), 2, False) for i in range(40)] + [("h", "t", at(10_000 * i), 2, i == 5) for i in range(40)] + [("x", "x", at(10**9), 1, True)]
    df = spark.createDataFrame(busy, "host string, session string, ts timestamp, mutations long, detected boolean")
    assert run(spark, jobs.blackouts(stream(spark, df, tmp_path / "b")), "dark") == [("h", "s", 390.0, 80)]


def test_completion(spark, tmp_path):
    rows = [("a", at(0), "mutation", 1500), ("a", at(400), "sse_end", 1500), ("b", at(0), "mutation", 1500), ("b", at(1000), "mutation", 1500), ("c", at(0), "mutation", 2000), ("c", at(100), "stop_gone", 2000), ("z", at(10_000_000), "mutation", 1500)]
    df = spark.createDataFrame(rows, "node string, ts timestamp, kind string, debounce_ms long")
    base = 1704067200000
    want = [("a", base + 700, "sse_interceptor"), ("b", base + 2500, "debounce"), ("c", base + 400, "stop_button")]
    assert run(spark, jobs.completion(stream(spark, df, tmp_path / "s")), "ends") == want
    signals_ = spark.createDataFrame([("a", 400, None, None, 0, 1500), ("b", None, None, None, 1000, 1500), ("c", None, 100, None, 0, 2000)], "node string, sse_end_ms long, stop_gone_ms long, flatline_ms long, last_mutation_ms long, debounce_ms long")
    assert sorted((r[0], r[1] + base, r[2]) for r in signals.stream_completion(signals_).collect()) == want


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "s", "m1", "a", 1), (2, "s", None, "b", 1)], "id long, session_id string, message_id string, text string, arrival_seq long")
    new = spark.createDataFrame([(3, "s", "m1", "c", 2), (4, "s", "m2", "d", 1)], old.schema)
    sink = jobs.upsert_turns_sink(spark, str(tmp_path / "turns"))
    for batch in (old, new, new):
        sink(batch, 0)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "turns")).select("id", "message_id", "text").collect()), key=str)
    assert got == sorted(map(tuple, state.upsert_turns(old.unionByName(new)).select("id", "message_id", "text").collect()), key=str)
    jobs.embed_sink(str(tmp_path / "vec"), hash_embedder(8), 8)(old, 7)
    assert spark.read.parquet(str(tmp_path / "vec/results")).filter("status = 'ok'").count() == 2
    seen = []
    feed = jobs.write_change_feed(lambda: spark.range(1).select(F.lit(len(seen) // 2).alias("x")), seen.append)
    for n in range(3):
        feed(old, n)
    assert len(seen) == 1
