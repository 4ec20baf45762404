"""Tables that change: each change is a function of the old rows and the new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscale.functions.filters import has_text
from turnscale.functions.text import seconds_between

from .rollups import build_chat_sessions

# What a re-sent turn replaces, and what it replaces only if it has it; states of an opt-in; limits.
REPLACED = ["text", "char_count", "recorded_at", "actual_input_tokens", "actual_output_tokens", "saved_input_cost_usd", "saved_cache_cost_usd", "saved_output_cost_usd", "measurement_basis", "baseline_period"]
FILLED = ["baseline_full_repo", "baseline_naive_rag", "client_source", "chat_session_id"]
OPT_IN_STATES = ("opted_in", "opted_out", "pending")
MOST_ATTEMPTS, ERROR_CHARS = 3, 500


def upsert_turns(arrivals: DataFrame, replaced: Sequence[str] = REPLACED, filled: Sequence[str] = FILLED) -> DataFrame:
    """One row per (session_id, message_id) of old and new turns together, ordered by arrival_seq.

    The last arrival gives the replaced columns, the last that has one each filled column, the first all others. Turns
    without a message_id (null or empty) are rows of their own. arrival_seq is that of the last arrival.
    """
    rows = arrivals.withColumn("message_id", F.nullif(F.col("message_id"), F.lit("")))
    keys = ["session_id", "message_id"]
    seq = F.struct("arrival_seq", "id")
    columns = []
    for c in arrivals.columns:
        if c in keys:
            continue
        if c == "arrival_seq":
            columns.append(F.max(c).alias(c))
        elif c in filled:
            columns.append(F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c))
        else:
            pick = F.max_by if c in replaced else F.min_by
            columns.append(pick(F.struct(c), seq)[c].alias(c))
    merged = rows.filter("message_id is not null").groupBy(*keys).agg(*columns)
    return merged.select(*arrivals.columns).unionByName(rows.filter("message_id is null"))


def upsert_chat_sessions(turns: DataFrame) -> DataFrame:
    """Chat sessions of old and new turns together: they are a function of the turns."""
    return build_chat_sessions(turns)


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert_pricing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prices by provider and model, the latest fetched; a feed without a usable row is an error and changes nothing."""
    usable = new.filter("input_per_m is not null and output_per_m is not null")
    if usable.isEmpty():
        raise ValueError("the feed has no usable price")
    return latest_by(old.unionByName(usable, allowMissingColumns=True), ["provider", "model"], ["fetched_at"])


def upsert_file_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["project_id", "file_path"]
    a = new.select(*keys, F.col("content_hash").alias("_h"), F.col("last_seen").alias("_s"))
    both = old.join(a, keys, "full")
    return both.select(*keys, F.coalesce("_h", "content_hash").alias("content_hash"), F.coalesce("_s", "last_seen").alias("last_seen"))


def pending_embeddings(turns: DataFrame, vectors: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Turns with text and no vector, of fewer than three attempts: a queue that needs no table."""
    rows = turns.filter(has_text(F.trim("text"))).join(vectors.select(F.col("timeline_id").alias("id")), "id", "left_anti")
    if attempts is None:
        return rows
    tried = attempts.groupBy(F.col("timeline_id").alias("id")).agg(F.max("attempts").alias("_tries"))
    return rows.join(tried, "id", "left").filter(F.coalesce("_tries", F.lit(0)) < MOST_ATTEMPTS).drop("_tries")


def pending_batch(pending: DataFrame, n: int = 16) -> DataFrame:
    """The oldest n pending turns."""
    return pending.orderBy("recorded_at", "id").limit(n)


def record_once(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones of keys that aren't there yet."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def record_rewrites(old: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rewrites, each id once, with the session of their external id and provider."""
    known = sessions.filter("external_session_id is not null").groupBy("external_session_id", "provider_id").agg(F.min("id").alias("_s"))
    linked = new.join(known, ["external_session_id", "provider_id"], "left").withColumn("chat_session_id", F.coalesce("chat_session_id", "_s")).drop("_s")
    return record_once(old, linked, "rewrite_id")


def session_registry(events: DataFrame) -> DataFrame:
    """Sessions of (session_id, kind, ts): registered first, closed last; a register after that changes nothing."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("ts"))
    rows = events.groupBy("session_id").agg(F.min(at("register")).alias("created_at"), F.max(at("close")).alias("closed_at"))
    return rows.filter("created_at is not null")


def record_opt_in(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest decision of each project by ts; states that there aren't are left out."""
    return latest_by(old.unionByName(new.filter(F.col("state").isin(*OPT_IN_STATES))), ["project_path"], ["ts"])


def forget_sessions(tables: dict[str, tuple[DataFrame, str]], forget: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of forgotten sessions, and (table, deleted) counts.

    tables: name -> (rows, session column); forget: (session_id). Rows of null sessions stay.
    """
    ids = forget.filter("session_id is not null").select("session_id").distinct()
    kept, counts = {}, []
    for name, (rows, column) in tables.items():
        hit = F.col(column) == ids["session_id"]
        kept[name] = rows.join(ids, hit, "left_anti")
        counts.append(rows.join(ids, hit, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return kept, out


def forget_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without rows, and how many each had."""
    counts = [rows.agg(F.lit(name).alias("table"), F.count("*").alias("deleted")) for name, rows in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return {name: rows.filter(F.lit(False)) for name, rows in tables.items()}, out


def apply_embed_results(attempts: DataFrame, results: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, attempts) after results (timeline_id, status, embedding, error) of one try each.

    ok with a vector of `dim` is done; 'blank' is done without one; any other try counts as an attempt, with the reason
    'wrong_dim', 'unavailable' or the error's first 500 characters.
    """
    sized = F.size("embedding") == dim
    good = (F.col("status") == "ok") & F.coalesce(sized, F.lit(False))
    vectors = results.filter(good).select("timeline_id", "embedding")
    reason = F.when(F.col("status") == "ok", "wrong_dim").when(F.col("status") == "unavailable", "unavailable").otherwise(F.substring("error", 1, ERROR_CHARS))
    outcome = results.select("timeline_id", (good | (F.col("status") == "blank")).alias("done"), F.when(~good & (F.col("status") != "blank"), reason).alias("last_error"))
    old = attempts.select("timeline_id", F.col("attempts").alias("_a"), F.col("completed").alias("_c"), F.col("last_error").alias("_e"))
    both = old.join(outcome, "timeline_id", "full")
    tries = F.coalesce("_a", F.lit(0)) + F.when(F.coalesce("done", F.lit(True)), 0).otherwise(1)
    done = F.coalesce("_c", F.lit(False)) | F.coalesce("done", F.lit(False))
    return vectors, both.select("timeline_id", tries.cast("int").alias("attempts"), done.alias("completed"), F.when(~done, F.coalesce("last_error", "_e")).alias("last_error"))


def evolve_schema(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with the columns that they lack, null."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def progress_snapshot(jobs: DataFrame, now: Column) -> DataFrame:
    """Progress of indexing jobs: shares done, elapsed seconds, rates once half a second has gone, and the longer of the
    times that files and entities still take, in the phases that have one."""
    done = lambda a, b: F.when(F.coalesce(b, F.lit(0)) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b)))
    elapsed = F.coalesce(seconds_between(now, F.col("started_at")), F.lit(0.0))
    rate = lambda c: F.when(F.col("elapsed_seconds") > 0.5, F.coalesce(c, F.lit(0)) / F.col("elapsed_seconds"))
    rows = jobs.withColumn("elapsed_seconds", elapsed).withColumns({"rate_files": rate(F.col("files_processed")), "rate_entities": rate(F.col("entities_embedded"))})
    left = lambda total, part, speed: F.when((F.col(speed) > 0) & (F.col(total) > F.col(part)), (F.col(total) - F.col(part)) / F.col(speed))
    eta = F.when(F.col("phase").isin("parse", "embed"), F.greatest(left("files_total", "files_processed", "rate_files"), left("entities_total", "entities_embedded", "rate_entities")))
    return rows.select(
        *jobs.columns, done(F.col("files_processed"), F.col("files_total")).alias("files_pct"), done(F.col("entities_embedded"), F.col("entities_total")).alias("entities_pct"),
        "elapsed_seconds", "rate_files", "rate_entities", eta.alias("eta_seconds"), (F.col("phase") == "paused").alias("is_paused"),
    )


def recent_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "project_id")
