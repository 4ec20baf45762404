"""Streaming forms: stateless ones as plans, tables by foreachBatch, and stateful ones with event-time state.

Sessions need the RocksDB state store for the stateful processors:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

import itertools
import json
import operator
import pickle
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from turnscale.functions.text import djb2
from turnscale.operators import rollups, signals, state
from turnscale.operators.embedding import BATCH, Embedder, embed
from turnscale.sources import versions
from turnscale.sources.writers import fingerprint, write_change_feed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Each batch opens and commits the state of each shuffle partition, which takes a quarter of a second whatever is in it. So a
#: stream should have a few for each core, not Spark's 200, and commit its changes, not its files.
PARTITIONS = 48
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def debounce(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of file events; a move is an event of both paths. A burst comes out once the watermark has passed it."""
    paths = F.array_compact(F.array("path", "dest_path")) if "dest_path" in events.columns else F.array("path")
    rows = events.withColumn("path", F.explode(paths)).withWatermark("ts", late)
    return signals.debounce(rows, gap)


def replace_parts(spark: SparkSession, path: str, parts: list[int], rows: DataFrame, keep_seconds: float = 0.0, marks: dict[str, object] | None = None) -> None:
    """Put rows (with their `part`) in the place of these parts of the table at path; its other parts aren't touched.

    A version of the table (see turnscale.sources.versions): stopped anywhere, the table is what it was before, or what it
    is to be. The old parts can be read for keep_seconds more.
    """
    versions.replace_pieces(spark, path, [str(n) for n in parts], rows, "part", marks, keep_seconds)


def read_parts(spark: SparkSession, path: str, schema: StructType, parts: list[int] | None = None) -> DataFrame:
    """The rows of these parts of a table that replace_parts wrote, or of all; none where there is no table."""
    version = versions.current(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    return versions.rows_of(spark, path, version, None if parts is None else [str(n) for n in parts])


def with_part(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def touched_parts(rows: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, list[int]]:
    """rows with their part by hash of the keys, and the numbers of the parts they have: `parts` at most."""
    rows = with_part(rows, keys, parts)
    return rows, sorted(r[0] for r in rows.select("part").distinct().collect())


def upsert_turns_sink(spark: SparkSession, path: str, parts: int = 64, keep_seconds: float = 0.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges arrivals into the turn table at path, which has `parts` by hash of the session:
    a batch rewrites those of its sessions. A batch that comes again changes nothing: its arrivals are already there with
    the same arrival_seq. `read_parts` reads the table; give keep_seconds the time that a read takes while the stream runs."""

    def on_batch(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        try:
            _, touched = touched_parts(batch, ["session_id"], parts)
            if not touched:
                return
            old = read_parts(session, path, batch.schema, touched)
            unnamed = batch.filter("message_id is null or message_id = ''").join(old.select("id"), "id", "left_anti")
            merged = old.unionByName(batch.filter("message_id is not null and message_id != ''")).unionByName(unnamed)
            replace_parts(session, path, touched, with_part(state.upsert_turns(merged), ["session_id"], parts), keep_seconds)
        finally:
            batch.unpersist()

    return on_batch


def batch_mark(batch: DataFrame, number: int, key: str) -> list[int]:
    """What tells a batch that comes again after a stop from another one of the same number: its rows' number and ids."""
    count, ids = batch.agg(F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)"))).head()
    return [number, count, str(ids)]


def embed_sink(path: str, embedder: Embedder, dim: int = 768, most: int = state.MOST_ATTEMPTS, batch: int = BATCH) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that embeds a batch's turns (id, text), and those that have failed before.

    Under path: results of each batch by its number, and `queue`, a versioned table of the turns that have failed
    (timeline_id, text, attempts, completed, last_error): each batch tries those of fewer than `most` attempts again; what
    succeeds leaves it, what has failed `most` times stays, closed. A batch that comes again after its queue was
    committed is left out, before that it does the same again. The queue has failures alone, so it is rewritten whole.
    """
    shape = "timeline_id {}, text string, attempts int, completed boolean, last_error string"

    def on_batch(turns: DataFrame, number: int) -> None:
        spark = turns.sparkSession
        rows = turns.select(F.col("id").alias("timeline_id"), "text").persist()
        try:
            mark, old = batch_mark(rows, number, "timeline_id"), versions.current(spark, f"{path}/queue")
            if old and old.marks.get("batch") == mark:
                return
            queue = versions.rows_of(spark, f"{path}/queue", old) if old else spark.createDataFrame([], shape.format(rows.schema["timeline_id"].dataType.simpleString()))
            again = queue.filter(F.col("attempts") < most)
            due = again.select("timeline_id", "text").unionByName(rows.join(queue.select("timeline_id"), "timeline_id", "left_anti")).dropDuplicates(["timeline_id"])
            folder = f"{path}/results/batch={number}"
            embed(due, embedder, dim=dim, batch=batch).write.mode("overwrite").parquet(folder)
            results = spark.read.parquet(folder)
            _, tried = state.apply_embed_results(queue.select("timeline_id", "attempts", "completed", "last_error"), results, dim)
            texts = queue.select("timeline_id", "text").unionByName(due).dropDuplicates(["timeline_id"])
            left = tried.filter("not completed").join(texts, "timeline_id").select(*queue.columns)
            versions.write_version(left, f"{path}/queue", marks={"batch": mark})
        finally:
            rows.unpersist()

    return on_batch


def read_embed_queue(spark: SparkSession, path: str) -> DataFrame:
    """The turns of an embed_sink that have failed so far; closed ones have as many attempts as it makes."""
    return versions.read_version(spark, f"{path}/queue")


def metrics_sink(turns: Callable[[], DataFrame], sessions: Callable[[], DataFrame], emit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that emits the dashboard's row when it has changed, for tables that change in any way: it
    reads all turns for each batch. live_metrics_sink reads new turns alone."""
    return write_change_feed(lambda: rollups.usage_stats(turns(), sessions()), emit)


def live_metrics_sink(path: str, sessions: Callable[[], DataFrame], emit: Callable[[DataFrame], None], parts: int = 16, keep_seconds: float = 0.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over turns as they arrive, each once: it emits the dashboard's row when it has changed.

    The table at path keeps sums by session, in parts by hash: a batch adds its own sums to the parts that it touches, and
    the row is made of the sums. Which batch was added last and what was emitted last are marks of the table, set together
    with it: after a stop a batch is not added twice, and a row that was emitted is emitted again only if the stop came
    before its mark.
    """
    keys = rollups.USAGE_KEYS

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            mark, old = batch_mark(batch, number, "id"), versions.current(spark, path)
            if not old or old.marks.get("batch") != mark:
                new, touched = touched_parts(rollups.usage_sums(batch), keys, parts)
                kept = read_parts(spark, path, new.drop("part").schema, touched)
                merged = rollups.add_usage_sums(kept.unionByName(new.drop("part")))
                replace_parts(spark, path, touched, with_part(merged, keys, parts), keep_seconds, {"batch": mark})
            version = versions.current(spark, path)
            row = rollups.usage_stats_of(versions.rows_of(spark, path, version), sessions()).persist()
            if version.marks.get("emitted") != (print_ := fingerprint(row)):
                emit(row)
                versions.mark(spark, path, {"emitted": print_}, keep_seconds)
            row.unpersist()
        finally:
            batch.unpersist()

    return on_batch


#: How late rows may be, and how long a key may be silent before its state is dropped, unless told otherwise.
LATE, FORGET_MS = "0 seconds", 86_400_000
EARLIEST = -(1 << 62)
FIRST = operator.itemgetter(0)
#: A call of the state costs about a millisecond, so the keys of a bucket by hash share one state. A stream with far more live
#: keys can have more buckets: what a bucket has is in memory at once, and is written again when a row of it is due.
BUCKETS, BUCKET = 1024, "_bucket"


def packed(value: Any) -> tuple[bytes]:
    return (zlib.compress(pickle.dumps(value), 1),)


def unpacked(state: tuple) -> Any:
    return pickle.loads(zlib.decompress(bytes(state[-1])))  # noqa: S301  our own state


def plain_values(column: pd.Series) -> list:
    """The values of a column, None where pandas has NaN for a null."""
    values = column.tolist()
    return values if column.dtype.kind in "iub" else [None if x is pd.NaT or isinstance(x, float) and x != x else x for x in values]


class InOrder(StatefulProcessor):
    """Rows of a key wait in state until the watermark has passed them, and go on in order of time, whatever batch brought
    them. A key that has been silent for forget_ms of event time loses all its state; one that comes back starts anew.

    `ts` is the event time; rows without one go first. The group is a bucket of keys; it has one timer: for the earliest row
    that waits in it, or the next end of one of its keys' silence. What a job knows of keys is in its `stores`, each a dict by
    key: `kept` has them by name.
    """

    stores: tuple[str, ...] = ()

    def __init__(self, columns: list[str], order: list[str], out: list[str], forget_ms: int):
        self.columns, self.order, self.out, self.forget_ms = columns, order, out, forget_ms
        self.key = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, rows binary")
        self.timer = handle.getValueState("timer", "due long")
        self.clock = handle.getValueState("clock", "latest binary")
        self.states = {name: handle.getValueState(name, "nodes binary") for name in self.stores}

    def advance(self, key: Any, rows: list[tuple], kept: dict[str, dict]) -> list[tuple]:
        """What the next rows of a key bring out, in order; changes what is kept of it."""
        raise NotImplementedError

    def due_alone(self, key: Any, kept: dict[str, dict]) -> int | None:
        """A time in ms at which something comes out without a row, and what it is: see `expire`."""
        return None

    def expire(self, key: Any, kept: dict[str, dict]) -> list[tuple]:
        return []

    def _set_timer(self, before: int | None, due: int) -> None:
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            times = pd.to_datetime(frame["ts"])
            stamps = times.to_numpy("datetime64[us]").astype("int64").tolist()
            stamps = [us if there else EARLIEST for there, us in zip(times.notna().tolist(), stamps, strict=True)]
            least = min(stamps)
            self.waiting.appendValue((least, *packed([stamps, plain_values(frame[self.key]), [plain_values(frame[c]) for c in self.columns]])))
            earliest = least if earliest is None else min(earliest, least)
        before = self.timer.get()
        soon = max(-(-earliest // 1000), 0)
        self._set_timer(before and before[0], min(before[0], soon) if before else soon)
        return iter(())

    def _due_rows(self, now: int) -> tuple[dict[Any, list[tuple]], dict[Any, int]]:
        """The rows until now by key, as (what they go by, us first, and the row), and the earliest time of those that a key has
        later; these go on waiting."""
        ready: dict[Any, list[tuple]] = {}
        later: dict[Any, int] = {}
        rest: list[tuple] = []
        places = [self.columns.index(c) for c in self.order]
        for block in self.waiting.get() if self.waiting.exists() else ():
            stamps, keys, columns = unpacked(block)
            ranks = zip(stamps, *([(x is None, 0 if x is None else x) for x in columns[i]] for i in places), strict=True)
            for rank, key, row in zip(ranks, keys, zip(*columns, strict=True), strict=True):
                if rank[0] <= now * 1000:
                    ready.setdefault(key, []).append((rank, row))
                else:
                    rest.append((rank[0], key, row))
                    later[key] = min(rank[0], later.get(key, rank[0]))
        if ready and rest:
            stamps, keys, rows = zip(*rest, strict=True)
            self.waiting.put([(min(stamps), *packed([stamps, keys, list(zip(*rows, strict=True))]))])
        elif ready:
            self.waiting.clear()
        return ready, later

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = self._due_rows(now)
        states = {"": self.clock, **self.states}
        kept = {name: unpacked(found) if (found := state.get()) else {} for name, state in states.items()}
        latest = kept.pop("")
        out: list[tuple] = []
        for node, rows in ready.items():
            rows.sort(key=FIRST)
            out += self.advance(node, [row for _, row in rows], kept)
            latest[node] = max(latest.get(node, EARLIEST), rows[-1][0][0])
        due: int | None = None
        for node in list(latest):
            alone = self.due_alone(node, kept)
            if alone is not None and alone <= now:
                out += self.expire(node, kept)
                alone = self.due_alone(node, kept)
            nxt = alone
            if node not in later and alone is None:
                nxt = max(latest[node], 0) // 1000 + self.forget_ms
                if now >= nxt:
                    del latest[node]
                    for store in kept.values():
                        store.pop(node, None)
                    continue
            if nxt is not None and (due is None or nxt < due):
                due = nxt
        if later:
            soon = max(-(-min(later.values()) // 1000), 0)
            due = soon if due is None else min(due, soon)
        for name, state in states.items():
            nodes = kept[name] if name else latest
            state.update(packed(nodes)) if nodes else state.clear()
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def from_ms(ms: str) -> Column:
    """Event time of a clock in ms. It is set on by a day, as such a clock may count from 0, where the first watermark is."""
    return F.timestamp_millis(F.col(ms) + 86_400_000).alias("ts")


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: Any, late: str) -> DataFrame:
    """The processor over rows (key, ts and others); rows that come `late` after the newest are left out."""
    processor.key = key
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    return rows.withColumn(BUCKET, bucket).withWatermark("ts", late).groupBy(BUCKET).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class RollingDedup(InOrder):
    """Turns of a client whose hash isn't among its last different ones."""

    stores = ("recent",)

    def __init__(self, columns: list[str], size: int, forget_ms: int):
        super().__init__([*columns, "text_djb2"], ["id"] if "id" in columns else [], columns, forget_ms)
        self.size = size

    def advance(self, key: Any, rows: list[tuple], kept: dict[str, dict]) -> list[tuple]:
        recent, out, text = kept["recent"].get(key, []), [], self.out.index("text")
        for row in rows:
            there = True
            if row[text]:
                (there,), recent = signals.keep_unseen([int(row[-1])], self.size, recent)
            if there:
                out.append(row[:-1])
        if recent:
            kept["recent"][key] = recent
        return out


def rolling_dedup(turns: DataFrame, key: str = "session_id", size: int = signals.DEDUP_SIZE, late: str = LATE, forget_ms: int = 30 * FORGET_MS) -> DataFrame:
    rows = turns.withColumns({"text_djb2": djb2(F.coalesce("text", F.lit(""))), "ts": F.col("recorded_at")})
    return in_order(rows, key, RollingDedup(turns.columns, size, forget_ms), turns.schema, late)


class Velocity(InOrder):
    """The first moment at which a node's text streams; as signals.velocity_candidates, incrementally."""

    stores = ("node", "recent")

    def __init__(self, window_ms: int, span_ms: int, rate: float, samples: int, chars: float, forget_ms: int):
        super().__init__(["ts_ms", "chars_added"], ["ts_ms"], ["node", "ts_ms", "detector", "confidence"], forget_ms)
        self.limits = (window_ms, span_ms, rate, samples, chars)

    def advance(self, key: Any, rows: list[tuple], kept: dict[str, dict]) -> list[tuple]:
        window, span, rate, samples, chars = self.limits
        first, fired = kept["node"].get(key, (None, False))
        recent = deque(kept["recent"].get(key, ()))
        total, hits = sum(n for _, n in recent), []
        added = ((int(ts), int(n)) for ts, n in rows if ts is not None and n is not None and n > 0)
        for ts, same in itertools.groupby(added, key=lambda r: r[0]):  # rows of one moment count together
            if fired:
                break
            first = ts if first is None else first
            while recent and ts - recent[0][0] >= window:
                total -= recent.popleft()[1]
            for row in same:
                recent.append(row)
                total += row[1]
            gone = ts - first
            if len(recent) >= samples and gone >= span and gone and len(recent) * 1000 / gone >= rate and total / len(recent) >= chars:
                fired = True
                hits.append((key, ts, "velocity", signals.VELOCITY_CONFIDENCE))
        if first is not None:
            kept["node"][key] = (first, fired)
        if fired:
            kept["recent"].pop(key, None)
        elif recent:
            kept["recent"][key] = list(recent)
        return hits


def velocity(
    mutations: DataFrame, window_ms: int = signals.WINDOW_MS, span_ms: int = signals.LEAST_SPAN, rate: float = signals.LEAST_RATE, samples: int = signals.LEAST_SAMPLES,
    chars: float = signals.LEAST_CHARS, late: str = LATE, forget_ms: int = FORGET_MS,
) -> DataFrame:
    rows = mutations.select("node", "ts_ms", "chars_added", from_ms("ts_ms"))
    processor = Velocity(window_ms, span_ms, rate, samples, chars, forget_ms)
    return in_order(rows, "node", processor, "node string, ts_ms long, detector string, confidence double", late)


class Vote(InOrder):
    """Promotes a node once its detectors together are confident enough."""

    stores = ("latest", "fired")

    def __init__(self, least: float, tie: list[str], forget_ms: int):
        super().__init__(["detector", "confidence", "ts_ms", *tie], ["ts_ms", *tie], ["node", "ts_ms", "confidence"], forget_ms)
        self.least = least

    def advance(self, key: Any, rows: list[tuple], kept: dict[str, dict]) -> list[tuple]:
        if key in kept["fired"]:
            return []
        latest = kept["latest"].setdefault(key, {})
        for detector, confidence, ts, *_ in rows:
            if confidence is None:
                continue
            latest[detector] = float(confidence)
            miss = 1.0
            for c in latest.values():
                miss *= 1 - c
            score = round(max(1 - miss, *latest.values()), 9)
            if score >= self.least:
                kept["fired"][key] = True
                del kept["latest"][key]
                return [(key, None if ts is None else int(ts), score)]
        return []


def vote(candidates: DataFrame, least: float = 0.7, late: str = LATE, forget_ms: int = FORGET_MS) -> DataFrame:
    """Of equal times the later row by event_id, if there is one, counts after the other."""
    tie = [c for c in ("event_id",) if c in candidates.columns]
    rows = candidates.select("node", "detector", "confidence", "ts_ms", *tie, from_ms("ts_ms"))
    return in_order(rows, "node", Vote(least, tie, forget_ms), "node string, ts_ms long, confidence double", late)


#: Events that end an answer, in order of precedence at one moment: kind, source, and whether it settles first.
ENDINGS = [("sse_end", "sse_interceptor", True), ("stop_gone", "stop_button", True), ("flatline", "flatline", False)]
RANKS = {kind: n for n, (kind, _, _) in enumerate(ENDINGS)}


class Completion(InOrder):
    """The end of a node's answer: the first of an event that ends it, after settling, and silence after its mutations."""

    # The end by silence, which mutations put off, the end by an event, which nothing does, its precedence, and whether it is done.
    stores = ("ends",)
    NONE = (None, None, None, False)

    def __init__(self, settle_ms: int, forget_ms: int):
        super().__init__(["ts_ms", "kind", "debounce_ms"], ["ts_ms"], ["node", "completed_ms", "source"], forget_ms)
        self.settle = settle_ms

    def _first(self, silence: int | None, event: int | None) -> int | None:
        return min((x for x in (silence, event) if x is not None), default=None)

    def advance(self, key: Any, rows: list[tuple], kept: dict[str, dict]) -> list[tuple]:
        silence, event, rank, done = kept["ends"].get(key, self.NONE)
        if done:
            return []
        for ts, kind, wait in rows:
            if ts is None:
                continue
            end = self._first(silence, event)
            if end is not None and ts >= end:
                break
            if kind == "mutation":
                silence = int(ts + wait)
            elif kind in RANKS:
                at = int(ts + self.settle * ENDINGS[RANKS[kind]][2])
                if event is None or (at, RANKS[kind]) < (event, rank):
                    event, rank = at, RANKS[kind]
        if silence is not None or event is not None:
            kept["ends"][key] = (silence, event, rank, False)
        return []

    def due_alone(self, key: Any, kept: dict[str, dict]) -> int | None:
        silence, event, _, done = kept["ends"].get(key, self.NONE)
        return None if done else self._first(silence, event)

    def expire(self, key: Any, kept: dict[str, dict]) -> list[tuple]:
        silence, event, rank, _ = kept["ends"][key]
        kept["ends"][key] = (silence, event, rank, True)
        by_event = event is not None and (silence is None or event <= silence)
        return [(key, event, ENDINGS[rank][1]) if by_event else (key, silence, "debounce")]


def completion(events: DataFrame, settle_ms: int = 300, late: str = "1 second", forget_ms: int = FORGET_MS) -> DataFrame:
    """(node, completed_ms, source) of events (node, ts, kind, debounce_ms): kind is mutation, sse_end, stop_gone or flatline.

    A flatline ends at once, as it was quiet for long enough when it was seen. A node that has ended is remembered for
    forget_ms after its last event, and what comes for it in that time is ignored.
    """
    rows = events.select("node", "ts", F.unix_millis("ts").alias("ts_ms"), "kind", "debounce_ms")
    return in_order(rows, "node", Completion(settle_ms, forget_ms), "node string, completed_ms long, source string", late)


class Roots(InOrder):
    """Changes of a client's workspace roots from list to list."""

    stores = ("roots",)

    def __init__(self, forget_ms: int):
        super().__init__(["at", "roots"], ["at"], ["client_id", "ts", "change", "root"], forget_ms)

    def advance(self, key: Any, rows: list[tuple], kept: dict[str, dict]) -> list[tuple]:
        before, out, last = kept["roots"].get(key, set()), [], None
        for ts, roots in rows:
            if roots == last is not None:
                continue
            now, last = set(json.loads(roots)) if roots else set(), roots
            out += [(key, ts, "added", r) for r in sorted(now - before)] + [(key, ts, "removed", r) for r in sorted(before - now)]
            before = now
        if before:
            kept["roots"][key] = before
        else:
            kept["roots"].pop(key, None)
        return out


def roots(snapshots: DataFrame, late: str = LATE, forget_ms: int = 30 * FORGET_MS) -> DataFrame:
    """Changes of (client_id, ts, roots), ts in ms. A client that was silent for forget_ms counts as without roots."""
    files = F.to_json(F.array_sort(F.array_distinct(F.filter("roots", lambda r: r.startswith("file://")))))  # one text costs Python less than an array
    rows = snapshots.select("client_id", F.col("ts").alias("at"), files.alias("roots"), from_ms("ts"))
    kind = rows.schema["client_id"].dataType.simpleString()
    return in_order(rows, "client_id", Roots(forget_ms), f"client_id {kind}, ts long, change string, root string", late)


def blackouts(events: DataFrame, window: str = "1 hour", late: str = "1 minute", least_seconds: int = 300, least_mutations: int = 50) -> DataFrame:
    """Host sessions that were long and busy without a detector firing, of events (host, session, ts, mutations, detected)."""
    rows = events.withWatermark("ts", late).groupBy("host", "session", F.session_window("ts", window).alias("w")).agg(
        F.sum("mutations").cast("long").alias("mutations"), F.max(F.coalesce("detected", F.lit(False))).alias("detected"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    seconds = (F.unix_millis("last") - F.unix_millis("first")) / 1000
    return rows.filter((seconds >= least_seconds) & (F.col("mutations") >= least_mutations) & ~F.col("detected")).select("host", "session", seconds.alias("seconds"), "mutations")


def incremental_corpus_sink(read_files: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame], path: str, schema: StructType, parts: int = 64, keep_seconds: float = 0.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over debounced file events: the files of the batch are read and chunked again, and take the
    place of their old chunks; files that are gone lose them.

    read_files gives the files (project_id, path, ...) of the (project_id, path) it gets, so that it can read those
    alone. The chunk table at path, of this schema, has `parts` by hash of the file: a batch rewrites those of its files.
    `read_parts` reads it; give keep_seconds the time that a read takes while the stream runs.
    """
    keys = ["project_id", "file_path"]

    def on_batch(events: DataFrame, _: int) -> None:
        session = events.sparkSession
        files = events.select("project_id", "path").distinct().persist()
        try:
            named, touched = touched_parts(files.withColumnRenamed("path", "file_path"), keys, parts)
            if not touched:
                return
            kept = read_parts(session, path, schema, touched).join(named, keys, "left_anti")
            fresh = chunk(read_files(files)).select(*schema.names)
            replace_parts(session, path, touched, with_part(kept.unionByName(fresh), keys, parts), keep_seconds)
        finally:
            files.unpersist()

    return on_batch


def with_schema(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
