"""Roll-ups of turns and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscale.functions.filters import coding_session_filter, has_text, is_chat_source, not_fixture_session, orphan_chat_filter
from turnscale.functions.text import is_valid_external_session_id

#: Money is summed as decimals, so that a sum doesn't depend on the order of its rows.
MONEY = "decimal(38,12)"


def money(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(F.coalesce(column.cast(MONEY), F.lit(0).cast(MONEY))), F.lit(0).cast(MONEY))


def rounded(column: Column, places: int = 4) -> Column:
    return F.round(column, places).cast("double")


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def pct(part: Column, whole: Column, times: float = 100.0) -> Column:
    """part / whole in percent to one place, 0 where whole is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)) * times, 1)


def linked(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns whose chat session there is."""
    return turns.join(sessions.select(F.col("id").alias("chat_session_id")), "chat_session_id", "left_semi")


def dashboard_counts(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: sessions, turns, tokens, injected and cache-hit turns of the linked turns, and their rates."""
    counts = linked(turns, sessions).agg(
        F.count_distinct("chat_session_id").alias("sessions"),
        F.count("*").alias("turns"),
        total("actual_input_tokens").alias("total_input_tokens"),
        total("actual_output_tokens").alias("total_output_tokens"),
        F.count_if("injected").alias("injected_turns"),
        F.count_if("cache_hit_estimated").alias("cache_hit_turns"),
    )
    injected, cached, n = F.col("injected_turns"), F.col("cache_hit_turns"), F.col("turns")
    return counts.select(
        "*", pct(injected, n).alias("injection_rate_pct"), pct(cached, injected).alias("cache_hit_rate_pct"), pct(cached, n).alias("savings_pct"), pct(injected, n).alias("recall_pct")
    )


def savings_split(turns: DataFrame) -> DataFrame:
    """One row: dollars saved on input, cache and output, in all, by chats and by coding; totals of rounded parts."""
    rows = turns.filter(not_fixture_session(F.col("session_id")))
    chat = is_chat_source(F.col("client_source"))
    sums, totals = [], []
    for scope, condition in (("total", F.lit(True)), ("chat", chat), ("coding", ~chat)):
        parts = []
        for kind in ("input", "cache", "output"):
            name = f"{scope}_{kind}_saved_usd"
            sums.append(F.round(money(F.when(condition, F.col(f"saved_{kind}_cost_usd"))), 4).alias(name))
            parts.append(F.col(name))
        totals.append((parts[0] + parts[1] + parts[2]).cast("double").alias(f"{scope}_saved_usd"))
    out = rows.agg(*sums)
    return out.select(*[F.col(c).cast("double").alias(c) for c in out.columns], *totals)


def tokens_saved() -> Column:
    """The mean overhead of a group's injected, uncached turns times its cache hits, cut to a whole number."""
    measured = F.col("injected") & ~F.col("cache_hit_estimated") & F.col("baseline_no_context").isNotNull()
    overhead = F.sum(F.when(measured, F.col("actual_input_tokens") - F.col("baseline_no_context"))).cast("double")
    mean = F.try_divide(overhead, F.count_if(measured).cast("double"))
    return F.coalesce((mean * F.count_if("cache_hit_estimated")).cast("long"), F.lit(0)).cast("long").alias("tokens_saved_est")


def tokens_saved_total(turns: DataFrame) -> DataFrame:
    """One row: tokens_saved_est of every chat session, summed."""
    each = turns.filter("chat_session_id is not null").groupBy("chat_session_id").agg(tokens_saved())
    return each.agg(total("tokens_saved_est").alias("total_tokens_saved_est"))


def metrics() -> list[Column]:
    """The sums that every session roll-up has."""
    return [
        total("actual_input_tokens").alias("total_input_tokens"),
        total("actual_output_tokens").alias("total_output_tokens"),
        F.count_if("injected").alias("injected_turns"),
        F.count_if("cache_hit_estimated").alias("cache_hit_turns"),
        *[rounded(money(f"saved_{kind}_cost_usd")).alias(f"{kind}_saved_usd") for kind in ("input", "cache", "output")],
    ]


def newest(rows: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    return rows if most is None else rows.orderBy(*order).limit(most)


def session_rollup(sessions: DataFrame, turns: DataFrame, most: int | None = 200) -> DataFrame:
    """Every chat session with the counts and sums of its turns, or zeros; the newest `most`, all for None.

    The sums are grouped by session before they meet the sessions, so no turn is shuffled twice.
    """
    own = turns.filter("chat_session_id is not null")
    sums = own.groupBy("chat_session_id").agg(F.count("*").alias("turn_count"), *metrics(), tokens_saved())
    rows = sessions.join(sums, sessions["id"] == F.col("chat_session_id"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in sums.dtypes if c != "chat_session_id"]
    rows = rows.select(F.col("id").alias("session_key"), F.lit("chat").alias("source"), F.col("provider_id").alias("provider"), *zero, F.col("first_at").alias("first_seen"), F.col("last_at").alias("last_seen"))
    return newest(rows, [F.desc("last_seen"), F.col("session_key")], most)


def coding_rollup(turns: DataFrame, sessions: DataFrame, most: int | None = 50) -> DataFrame:
    """Coding sessions by session_id, with the provider of their latest turn ('harness' if it has none)."""
    rows = turns.filter(not_fixture_session(F.col("session_id")) & coding_session_filter(F.col("chat_session_id"), F.col("client_source"), F.col("provider")))
    known = sessions.filter("external_session_id is not null").select(F.col("external_session_id").alias("session_id"))
    rows = rows.join(known, "session_id", "left_anti").groupBy(F.col("session_id").alias("session_key")).agg(
        F.max_by(F.struct("provider"), F.struct("recorded_at", "id")).alias("latest"), F.count("*").alias("turn_count"), *metrics(), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen")
    )
    rows = rows.withColumn("provider", F.coalesce("latest.provider", F.lit("harness"))).withColumn("source", F.lit("coding")).withColumn("tokens_saved_est", F.lit(0).cast("long")).drop("latest")
    return newest(rows, [F.desc("last_seen"), F.col("session_key")], most)


def orphan_chat_rollup(turns: DataFrame, most: int | None = 50) -> DataFrame:
    """Chats without a chat session, by session_id and provider ('unknown' if none)."""
    rows = turns.filter(not_fixture_session(F.col("session_id")) & orphan_chat_filter(F.col("chat_session_id"), F.col("client_source"), F.col("provider")))
    rows = rows.groupBy(F.col("session_id").alias("session_key"), F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(
        F.count("*").alias("turn_count"), *metrics(), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen")
    )
    rows = rows.withColumn("source", F.lit("chat")).withColumn("tokens_saved_est", F.lit(0).cast("long"))
    return newest(rows, [F.desc("last_seen"), F.col("session_key"), F.col("provider")], most)


def all_sessions(sessions: DataFrame, turns: DataFrame, most: tuple[int | None, int | None, int | None] = (200, 50, 50)) -> DataFrame:
    """Chat sessions, orphan chats and coding sessions, one after the other."""
    chats = session_rollup(sessions, turns, most[0])
    return chats.unionByName(orphan_chat_rollup(turns, most[2])).unionByName(coding_rollup(turns, sessions, most[1]))


def build_chat_sessions(turns: DataFrame) -> DataFrame:
    """Chat sessions from turns: provider and external id, first and last seen, turns.

    A turn sent again under its message_id counts once; a turn without one always counts. Turns whose external id is
    null or not valid make no session.
    """
    rows = turns.filter(is_valid_external_session_id(F.col("external_session_id")))
    return rows.groupBy(F.col("provider").alias("provider_id"), "external_session_id").agg(
        F.min("recorded_at").alias("first_seen"),
        F.max("recorded_at").alias("last_seen"),
        (F.count_distinct("session_id", "message_id") + F.count_if(F.col("message_id").isNull())).alias("turn_count"),
    )


def corpus_rollup(files: DataFrame) -> DataFrame:
    """Files and tokens per project, of (project_id, path, token_count)."""
    return files.groupBy("project_id").agg(F.count("*").alias("n_files"), total("token_count").alias("n_tokens"))


def embedding_coverage(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per chat session: turns, those done (with a vector, or without text), those pending."""
    done = vectors.select(F.col("timeline_id").alias("id")).distinct().withColumn("has_vector", F.lit(True))
    rows = turns.filter("chat_session_id is not null").join(done, "id", "left")
    complete = F.coalesce("has_vector", F.lit(False)) | ~has_text(F.trim("text"))
    return rows.groupBy("chat_session_id").agg(F.count("*").alias("total_turns"), F.count_if(complete).alias("with_embeddings"), F.count_if(~complete).alias("pending"))


def rewrite_quality(rewrites: DataFrame, similarities: str = "similarities", ages: str = "ages_hours") -> DataFrame:
    """One row per rewrite_id, the first that arrived: mean of the similarities that aren't null, and ages in whole
    hours, none negative."""
    rows = rewrites.groupBy("rewrite_id").agg(F.min_by(F.struct(*[c for c in rewrites.columns if c != "rewrite_id"]), "arrival_seq").alias("r"))
    rows = rows.select("rewrite_id", "r.*")
    known = F.filter(similarities, lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))
    whole = F.transform(F.filter(ages, lambda x: x.isNotNull()), lambda x: F.greatest(F.lit(0.0), F.floor(x + 0.5).cast("double")))
    return rows.withColumn("avg_similarity", mean).withColumn("age_hours", whole).drop(similarities, ages)


def rewrite_outcomes(quality: DataFrame) -> DataFrame:
    """Per provider: rewrites, and the shares confirmed and degraded in percent."""
    return quality.groupBy("provider_id").agg(
        F.count("*").alias("rewrites"), pct(F.count_if("user_confirmed"), F.count("*")).alias("confirmed_pct"), pct(F.count_if("degraded"), F.count("*")).alias("degraded_pct")
    )


def usage_stats(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of counts, rates and savings for a tool's answer."""
    counts, money_ = dashboard_counts(turns, sessions), savings_split(turns)
    return counts.join(money_).select(
        "sessions", "turns", "total_input_tokens", "total_output_tokens", "injected_turns", "cache_hit_turns", "injection_rate_pct", "cache_hit_rate_pct", "savings_pct", "total_saved_usd"
    )


#: What usage sums are kept by: the money of a session can be a chat's or a coding tool's.
USAGE_KEYS = ["chat_session_id", "counted"]
USAGE_SUMS = ["turns", "input_tokens", "output_tokens", "injected", "cached"]
SAVED = ["input", "cache", "output"]


def usage_sums(turns: DataFrame) -> DataFrame:
    """Sums of turns by chat session and by whether their savings count (no fixture session's do), of which usage_stats_of
    makes what usage_stats makes of the turns. Sums of several tables of turns add up."""
    counted = not_fixture_session(F.col("session_id")).alias("counted")
    tokens = [total(f"actual_{kind}_tokens").alias(f"{kind}_tokens") for kind in ("input", "output")]
    flags = [F.count_if("injected").alias("injected"), F.count_if("cache_hit_estimated").alias("cached")]
    return turns.groupBy("chat_session_id", counted).agg(F.count("*").alias("turns"), *tokens, *flags, *[money(f"saved_{kind}_cost_usd").alias(kind) for kind in SAVED])


def add_usage_sums(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*USAGE_KEYS).agg(*[total(c).alias(c) for c in USAGE_SUMS], *[money(c).alias(c) for c in SAVED])


def usage_stats_of(sums: DataFrame, sessions: DataFrame) -> DataFrame:
    """usage_stats from usage_sums."""
    here = linked(sums, sessions)
    counts = here.agg(
        F.count_distinct("chat_session_id").alias("sessions"), total("turns").alias("turns"), total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"),
        total("injected").alias("injected_turns"), total("cached").alias("cache_hit_turns"),
    )
    saved = sums.filter("counted").agg(*[F.round(money(kind), 4).alias(kind) for kind in SAVED])
    injected, cached, n = F.col("injected_turns"), F.col("cache_hit_turns"), F.col("turns")
    row = counts.crossJoin(saved)  # of one row each
    return row.select(
        *counts.columns, pct(injected, n).alias("injection_rate_pct"), pct(cached, injected).alias("cache_hit_rate_pct"), pct(cached, n).alias("savings_pct"),
        (F.col("input") + F.col("cache") + F.col("output")).cast("double").alias("total_saved_usd"),
    )


def list_chat_sessions(sessions: DataFrame, turns: DataFrame, most: int | None = 20) -> DataFrame:
    """Chat sessions with turns and one sum of dollars saved, newest first."""
    each = F.coalesce("saved_input_cost_usd", F.lit(0.0)).cast(MONEY) + F.coalesce("saved_cache_cost_usd", F.lit(0.0)).cast(MONEY) + F.coalesce("saved_output_cost_usd", F.lit(0.0)).cast(MONEY)
    sums = turns.groupBy("chat_session_id").agg(F.count("*").alias("turn_count"), F.sum(each).alias("saved"))
    rows = sessions.join(sums, sessions["id"] == sums["chat_session_id"], "left")
    rows = rows.select(F.col("id").alias("session_key"), F.col("provider_id").alias("provider"), F.coalesce("turn_count", F.lit(0)).alias("turn_count"), rounded(F.coalesce("saved", F.lit(0).cast(MONEY))).alias("saved_usd"), F.col("last_at").alias("last_seen"))
    return newest(rows, [F.desc("last_seen"), F.col("session_key")], most)


def blackouts(host_sessions: DataFrame, least_seconds: int = 300, least_mutations: int = 50) -> DataFrame:
    """Host sessions of (host, session, ts_ms, mutations, detected): long and busy, though no detector fired."""
    rows = host_sessions.groupBy("host", "session").agg(
        ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("seconds"), total("mutations").alias("mutations"), F.coalesce(F.max("detected"), F.lit(False)).alias("detected")
    )
    return rows.filter((F.col("seconds") >= least_seconds) & (F.col("mutations") >= least_mutations) & ~F.col("detected")).drop("detected")


def detector_vote(candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """Per node: latest confidence of each detector, together 1 - product(1 - c) or the highest of them; promoted if
    that is `least` or more. Of equal times the later row by event_id counts."""
    latest = candidates.groupBy("node", "detector").agg(F.max_by("confidence", F.struct("ts_ms", "event_id")).alias("confidence"))
    rows = latest.groupBy("node").agg((F.lit(1.0) - F.product(F.lit(1.0) - F.col("confidence"))).alias("joint"), F.max("confidence").alias("highest"), F.count("*").alias("detectors"))
    score = F.greatest("joint", "highest")
    return rows.select("node", "detectors", F.round(score, 9).alias("confidence"), (F.round(score, 9) >= least).alias("promoted"))
