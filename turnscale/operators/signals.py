"""Signals in streams of mutations and turns, over whole tables; turnscale.streaming has their incremental forms."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from turnscale.functions.text import djb2

# Window in ms, least samples, span in ms, samples a second, mean characters; confidence of a hit.
WINDOW_MS, LEAST_SAMPLES, LEAST_SPAN, LEAST_RATE, LEAST_CHARS = 5000, 3, 200, 3.0, 2.0
VELOCITY_CONFIDENCE = 0.6
# Window and quiet time in ms, share of the peak that counts as flat.
FLAT_WINDOW, FLAT_QUIET, FLAT_RATIO = 500, 800, 0.05
DEDUP_SIZE = 50


def assign_turn_ids(turns: DataFrame) -> DataFrame:
    """turn_no within each session: a new number for each message not seen before, in order of its first time."""
    first = turns.groupBy("session_id", "message_id").agg(F.min(F.struct("recorded_at", "id")).alias("f"))
    numbered = first.withColumn("turn_no", F.row_number().over(Window.partitionBy("session_id").orderBy("f")))
    same = F.col("t.session_id").eqNullSafe(F.col("n.session_id")) & F.col("t.message_id").eqNullSafe(F.col("n.message_id"))
    return turns.alias("t").join(numbered.drop("f").alias("n"), same, "left").select("t.*", "n.turn_no")


#: Windows of a slice: what a slice takes from the one before it is one window.
SLICE_WINDOWS = 64


def moments(mutations: DataFrame, chars: Column, window_ms: int, slice_ms: int | None) -> tuple[DataFrame, int]:
    """(node, ts_ms, slice, n, chars): each node's moments with the number and characters of their mutations, in slices of
    time. Rows of one moment are summed before they are shuffled, so that a slice has slice_ms rows of a node at most."""
    width = max(slice_ms or SLICE_WINDOWS * window_ms, window_ms)
    sums = mutations.groupBy("node", "ts_ms").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))
    return sums.withColumn("slice", F.floor(F.col("ts_ms") / width).cast("long")), width


def with_halo(rows: DataFrame, back_ms: int, width: int) -> DataFrame:
    """rows, and those of the last back_ms of a slice in the next one, too, marked as its halo."""
    near = F.col("ts_ms") >= (F.col("slice") + 1) * width - back_ms
    places = F.when(near, F.array(F.struct(F.col("slice"), F.lit(False).alias("halo")), F.struct((F.col("slice") + 1).alias("slice"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(F.col("slice"), F.lit(False).alias("halo"))))
    return rows.select("node", "ts_ms", "n", "chars", F.explode(places).alias("p")).select("node", "ts_ms", "n", "chars", "p.*")


def velocity_candidates(
    mutations: DataFrame, window_ms: int = WINDOW_MS, span_ms: int = LEAST_SPAN, rate_per_s: float = LEAST_RATE, samples: int = LEAST_SAMPLES, chars: float = LEAST_CHARS, slice_ms: int | None = None
) -> DataFrame:
    """(node, ts_ms, detector, confidence): the first moment at which a node's text streams.

    Over the mutations with characters in the last window_ms: enough of them, a long enough time since the node's first,
    enough a second over that time, and enough characters each. A node's time is cut into slices, each with a window of
    the one before it, so that a node of any size is the work of many tasks.
    """
    rows, width = moments(mutations.filter("chars_added > 0"), F.col("chars_added"), window_ms, slice_ms)
    first = rows.groupBy("node").agg(F.min("ts_ms").alias("first"))
    recent = Window.partitionBy("node", "slice").orderBy("ts_ms").rangeBetween(-(window_ms - 1), 0)
    rows = with_halo(rows, window_ms - 1, width).select("node", "ts_ms", "halo", F.sum("n").over(recent).alias("n"), F.sum("chars").over(recent).alias("chars"))
    dense = rows.filter(~F.col("halo") & (F.col("n") >= samples) & (F.col("chars") / F.col("n") >= chars))
    span = F.col("ts_ms") - F.col("first")
    hits = dense.join(first, "node").filter((span >= span_ms) & (F.try_divide(F.col("n") * 1000.0, span) >= rate_per_s))
    return hits.groupBy("node").agg(F.min("ts_ms").alias("ts_ms")).select("node", "ts_ms", F.lit("velocity").alias("detector"), F.lit(VELOCITY_CONFIDENCE).alias("confidence"))


def before_slice(rows: DataFrame, combine: Callable[[Column], Column], value: Column) -> DataFrame:
    """(node, slice, carried): what a node's slices before each come to, combined from one row of each; null before the first."""
    parts = rows.groupBy("node", "slice").agg(combine(value).alias("part"))
    earlier = Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("node", "slice", combine(F.col("part")).over(earlier).alias("carried"))


def flatline_completion(mutations: DataFrame, window_ms: int = FLAT_WINDOW, quiet_ms: int = FLAT_QUIET, ratio: float = FLAT_RATIO, slice_ms: int | None = None) -> DataFrame:
    """(node, completed_ms): when a node's rate has been below ratio of its peak for quiet_ms.

    The rate at a mutation is the characters of the last window_ms, at 1 each at least, by the time since the first of
    them (1 ms at least); the peak is the highest so far. A flat stretch starts at its first flat mutation and ends with a
    rate that isn't flat. It completes at its first mutation quiet_ms or more after the start, or quiet_ms after the start
    where nothing comes in between to end it. Rates are made in slices of time with a window of the one before; the peak
    and the number of rates that aren't flat go on from slice to slice by one row of each.
    """
    rows, width = moments(mutations, F.greatest("chars_added", F.lit(1)), window_ms, slice_ms)
    recent = Window.partitionBy("node", "slice").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    rate = F.sum("chars").over(recent) / F.greatest(F.col("ts_ms") - F.min("ts_ms").over(recent), F.lit(1))
    rows = with_halo(rows, window_ms, width).select("node", "slice", "ts_ms", "halo", rate.alias("rate")).filter("not halo")
    so_far = Window.partitionBy("node", "slice").orderBy("ts_ms")
    peaks = before_slice(rows, F.max, F.col("rate"))
    peak = F.greatest(F.max("rate").over(so_far), F.col("carried"))
    rows = rows.join(peaks, ["node", "slice"]).select("node", "slice", "ts_ms", (F.col("rate") < F.lit(float(ratio)) * peak).alias("flat"))
    busy = F.when(F.col("flat"), 0).otherwise(1)
    counts = before_slice(rows, F.sum, busy)
    rows = rows.join(counts, ["node", "slice"]).select("node", "ts_ms", "flat", (F.coalesce("carried", F.lit(0)) + F.sum(busy).over(so_far)).alias("stretch"))
    ends = rows.filter("not flat").groupBy("node", "stretch").agg(F.min("ts_ms").alias("from_ms"))
    flats = rows.filter("flat").groupBy("node", "stretch").agg(F.min("ts_ms").alias("start"))
    following = ends.select("node", (F.col("stretch") - 1).alias("stretch"), F.col("from_ms").alias("next_ms"))
    both = flats.join(following, ["node", "stretch"], "left")
    hit = both.filter(F.col("next_ms").isNull() | (F.col("next_ms") - F.col("start") >= quiet_ms))
    return hit.groupBy("node").agg((F.min("start") + quiet_ms).alias("completed_ms"))


def keep_unseen(hashes: list[int], size: int, recent: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Which hashes aren't among the last `size` different ones, and those after them; a repeat doesn't renew its place."""
    recent = list(recent or [])
    kept = []
    for h in hashes:
        kept.append(h not in recent)
        if kept[-1]:
            recent = [*recent, h][-size:]
    return kept, recent


#: Rounds in which pieces of one client are run side by side, before what is left of it goes through in one.
SIDE_BY_SIDE = 8
#: Turns of a piece.
PIECE_ROWS = 500_000


def run_pieces(rows: pd.DataFrame, size: int, windows: dict[str, list[int]]) -> tuple[list[bool], dict[str, list[int]]]:
    """Which of the rows (k, h), by client and time, repeat; and the clients' windows after them, from those given before."""
    repeats, after = [], {}
    for k, own in itertools.groupby(zip(rows["k"], rows["h"], strict=True), key=lambda r: r[0]):
        kept, after[k] = keep_unseen([h for _, h in own], size, windows.get(k, []))
        repeats += [not x for x in kept]
    return repeats, after


def rolling_dedup(turns: DataFrame, key: str = "session_id", size: int = DEDUP_SIZE, pieces: int | None = None) -> DataFrame:
    """Turns without those whose text's djb2 is among the client's last `size` different ones; empty texts always stay.

    Ids and hashes are sorted by client and time into `pieces` of like size (as many as shuffle partitions, of PIECE_ROWS
    at most), so that a client of any size is cut into several. Each piece runs with an empty window first, then again with the window that
    the piece before it has come to, as long as that differs from what it has run with: mostly twice, as what was new
    before a piece seldom changes what is new at its end. What still changes after SIDE_BY_SIDE rounds goes through in
    order, a task for each client. A window for each piece comes to the driver.
    """
    spark, client = turns.sparkSession, F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    pieces = pieces or max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.count() // PIECE_ROWS + 1)
    marks = turns.filter("text != ''").select(client.alias("k"), "recorded_at", "id", djb2(F.col("text")).alias("h"))
    cut = marks.repartitionByRange(pieces, "k", "recorded_at", "id").withColumn("piece", F.spark_partition_id())
    cut = cut.persist(StorageLevel.DISK_ONLY)
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    shape = f"piece int, k string, id {kinds['id']}, repeat boolean, window array<long>, round int"

    def ran(rows: DataFrame, windows: dict[tuple[int, str], list[int]], turn: int) -> DataFrame:
        """(piece, k, id, repeat, window, round): the window after it is on the last row of each client of a piece."""

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["k", "recorded_at", "id"], ignore_index=True)
            n = int(group["piece"].iloc[0])
            repeats, after = run_pieces(group, size, {k: w for (at, k), w in windows.items() if at == n})
            last = group["k"] != group["k"].shift(-1)
            ends = [after[k] if end else None for k, end in zip(group["k"], last, strict=True)]
            return pd.DataFrame({"piece": n, "k": group["k"], "id": group["id"], "repeat": repeats, "window": pd.Series(ends, dtype=object), "round": turn})

        return rows.groupBy("piece").applyInPandas(run, shape)

    results = [ran(cut, {}, 0).persist(StorageLevel.DISK_ONLY)]
    # Only the first client of a piece can have begun in another one, and only the last can go on.
    edges = results[0].filter("window is not null").groupBy("piece").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("window", "k").alias("window"), F.min_by("window", "k").alias("first_window"))
    chain = {r["piece"]: r for r in edges.collect()}
    order, before = sorted(chain), {}
    for earlier, n in itertools.pairwise(order):
        if chain[earlier]["last"] == chain[n]["first"]:
            before[n] = earlier
    after = {(n, k): list(w) for n, r in chain.items() for k, w in ((r["first"], r["first_window"]), (r["last"], r["window"]))}
    used: dict[int, list[int]] = dict.fromkeys(before, [])
    for turn in range(1, SIDE_BY_SIDE + 1):
        given = {n: after[earlier, chain[n]["first"]] for n, earlier in before.items()}
        stale = [n for n in before if given[n] != used[n]]
        if not stale:
            break
        rows = cut.join(F.broadcast(spark.createDataFrame([(n, chain[n]["first"]) for n in stale], "piece int, k string")), ["piece", "k"])
        if turn < SIDE_BY_SIDE:
            results.append(ran(rows, {(n, chain[n]["first"]): given[n] for n in stale}, turn).persist(StorageLevel.DISK_ONLY))
            for r in results[-1].filter("window is not null").select("piece", "k", "window").collect():
                after[r["piece"], r["k"]] = list(r["window"])
            used |= {n: given[n] for n in stale}
        else:  # from each client's first stale piece on, in order
            starts: dict[str, int] = {}
            for n in stale:
                starts.setdefault(chain[n]["first"], n)
            late = [(n, k, starts[k]) for n in before if (k := chain[n]["first"]) in starts and n >= starts[k]]
            rows = cut.join(F.broadcast(spark.createDataFrame(late, "piece int, k string, start int")), ["piece", "k"])
            results.append(in_sequence(rows, size, {k: given[n] for k, n in starts.items()}, turn, shape))
    every = functools.reduce(DataFrame.unionByName, results).select("piece", "k", "id", "repeat", "round")
    if len(results) > 1:  # the last run of a client's piece counts
        every = every.groupBy("piece", "k", "id").agg(F.max_by("repeat", "round").alias("repeat"))
    repeats = every.filter("repeat").select(F.col("k").alias("_k"), F.col("id").alias("_id"))
    return turns.join(repeats, (client == repeats["_k"]) & (turns["id"] == repeats["_id"]), "left_anti")


def in_sequence(rows: DataFrame, size: int, windows: dict[str, list[int]], turn: int, shape: str) -> DataFrame:
    """The rows (piece, k, recorded_at, id, h) of some clients, each client's in order through one task with its window alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict[str, list[int]] = {}
        for batch in batches:
            repeats, after = run_pieces(batch, size, windows | recent)
            recent |= after
            yield pd.DataFrame({"piece": batch["piece"], "k": batch["k"], "id": batch["id"], "repeat": repeats, "window": None, "round": turn})

    return rows.repartition("k").sortWithinPartitions("k", "recorded_at", "id").select("piece", "k", "id", "h").mapInPandas(run, shape)


def debounce(events: DataFrame, gap: str = "500 milliseconds", keys: tuple[str, ...] = ("project_id", "path")) -> DataFrame:
    """One row per burst of events of a path: its first and last time and its size. Works on streams with a watermark too."""
    rows = events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last_event"))
    return rows.select(*keys, F.col("w.start").alias("first_event"), "last_event", "events")


def stream_completion(signals: DataFrame, settle_ms: int = 300) -> DataFrame:
    """(node, completed_ms, source): the first of a node's possible ends.

    signals: node, sse_end_ms, stop_gone_ms, flatline_ms, last_mutation_ms, debounce_ms; null where there is none.
    """
    ends = [("sse_interceptor", F.col("sse_end_ms") + settle_ms), ("stop_button", F.col("stop_gone_ms") + settle_ms), ("flatline", F.col("flatline_ms")), ("debounce", F.col("last_mutation_ms") + F.col("debounce_ms"))]
    options = F.filter(F.array(*[F.struct(at.cast("long").alias("at"), F.lit(n).alias("n"), F.lit(name).alias("source")) for n, (name, at) in enumerate(ends)]), lambda x: x["at"].isNotNull())
    first = F.array_min(options)
    return signals.select("node", first["at"].alias("completed_ms"), first["source"].alias("source")).filter("completed_ms is not null")


def roots_diff(snapshots: DataFrame) -> DataFrame:
    """(client_id, ts, change, root) between each client's consecutive lists of workspace roots; only file:// ones count."""
    names = F.array_distinct(F.filter(F.coalesce("roots", F.array().cast("array<string>")), lambda r: r.startswith("file://")))
    order = Window.partitionBy("client_id").orderBy("ts")
    rows = snapshots.select("client_id", "ts", names.alias("now"))
    rows = rows.withColumn("before", F.coalesce(F.lag("now").over(order), F.array().cast("array<string>")))
    both = F.concat(
        F.transform(F.array_except("now", "before"), lambda r: F.struct(F.lit("added").alias("change"), r.alias("root"))),
        F.transform(F.array_except("before", "now"), lambda r: F.struct(F.lit("removed").alias("change"), r.alias("root"))),
    )
    return rows.select("client_id", "ts", F.explode(both).alias("d")).select("client_id", "ts", "d.*")


def connected_clients(events: DataFrame) -> DataFrame:
    """Clients of (client_id, kind, ts) whose last connect is after their last disconnect, or who have none."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    rows = events.groupBy("client_id").agg(last("connect").alias("connected_at"), last("disconnect").alias("disconnected_at"))
    return rows.filter(F.col("connected_at").isNotNull() & (F.col("disconnected_at").isNull() | (F.col("connected_at") > F.col("disconnected_at"))))


#: Bits of words' places that are kept at once.
PLACE_BITS = 1 << 29


class Places:
    """For each word of a text, a number whose bits are its places; made when asked for, and kept while there is room."""

    def __init__(self, words: list[str]):
        self.at: dict[str, list[int]] = {}
        for n, word in enumerate(words):
            self.at.setdefault(word, []).append(n)
        self.made: dict[str, int] = {}
        self.room = PLACE_BITS // max(len(words), 1)

    def __getitem__(self, word: str) -> int:
        bits = self.made.get(word)
        if bits is None:
            own = self.at.get(word, ())
            if len(own) < 9:
                return sum(1 << n for n in own)
            marks = np.zeros(own[-1] + 1, np.uint8)
            marks[own] = 1
            bits = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
            if len(self.made) < self.room:
                self.made[word] = bits
        return bits


def common_lengths(a: list[str], places: Places, level: int, full: int) -> Iterator[int]:
    """After each word of a, where the length of the longest common subsequence with the first words of b does not rise: bit
    j is set if b's word j adds nothing. One addition of long numbers makes a row of the usual table (Hyyrö 2004)."""
    for word in a:
        same = level & places[word]
        level = ((level + same) | (level - same)) & full
        yield level


def edits(a: list[str], b: list[str]) -> Iterator[str]:
    """From the end, whether a longest common subsequence keeps, adds or removes a word; where it can, it keeps, and where
    words can be added or removed first, those added come last.

    Of the table's rows, every sqrt(n)-th is kept; those between are made again from it when they are come to.
    """
    places, full = Places(b), (1 << len(b)) - 1
    every = max(math.isqrt(len(a)), 1)
    kept = [full]
    for n, level in enumerate(common_lengths(a, places, full, full), 1):
        if n % every == 0:
            kept.append(level)
    j = len(b)
    for block in range(len(kept) - 1, -1, -1):
        words = a[block * every : (block + 1) * every]
        levels = list(common_lengths(words, places, kept.pop(), full))
        for word, level in zip(reversed(words), reversed(levels), strict=True):
            while j and b[j - 1] != word and level >> (j - 1) & 1:
                yield "added"
                j -= 1
            if j and b[j - 1] == word:
                yield "unchanged"
                j -= 1
            else:
                yield "removed"
    yield from itertools.repeat("added", j)


def word_diff_segments(original: str, rewritten: str) -> list[tuple[str, str]]:
    """(kind, text) segments of a word diff by a longest common subsequence, white space being words too."""
    a, b = (re.findall(r"\s+|\S+", s or "") for s in (original, rewritten))
    kinds = list(edits(a, b))[::-1]
    old, new, out = iter(a), iter(b), []
    for kind, run in itertools.groupby(kinds):
        words = []
        for _ in run:
            if kind != "removed":
                words.append(next(new))
            if kind != "added":
                word = next(old)
                words += [word] if kind == "removed" else []
        out.append((kind, "".join(words)))
    return out


def word_diff(pairs: DataFrame, original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """pairs with `diff`: the segments that lead from the original to the rewritten text; null texts are empty."""

    @F.pandas_udf("array<struct<type:string,text:string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"type": k, "text": t} for k, t in word_diff_segments(x or "", y or "")] for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("diff", diff(original, rewritten))


def diff_sizes(diffs: DataFrame, key: str) -> DataFrame:
    """Characters added, removed and unchanged per key."""
    rows = diffs.select(key, F.explode("diff").alias("d"))
    return rows.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("d.type") == t, F.length("d.text"))), F.lit(0)).cast("long").alias(f"chars_{t}") for t in ("added", "removed", "unchanged")])
