"""Retrieval of earlier turns for drafts: similarity and recency under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscale.functions.filters import draft_usable, has_text, not_chitchat
from turnscale.functions.text import age_human, cosine_distance, seconds_between, to_iso_utc, tokens_floor4

from .history import top_per_key

# Half-life of recency in seconds, weight of similarity, candidates per draft.
HALF_LIFE, ALPHA, CANDIDATES = 259200, 0.7, 20


def recency(ts: Column, now: Column) -> Column:
    return F.pow(F.lit(0.5), seconds_between(now, ts) / F.lit(HALF_LIFE))


def final_score(similarity: Column, ts: Column, now: Column, alpha: float = ALPHA) -> Column:
    return F.lit(alpha) * similarity + F.lit(1 - alpha) * recency(ts, now)


#: Turns of a session that one task compares with a draft; more are dealt out.
SALT_TURNS = 50_000


def nearest_ids(drafts: DataFrame, turns: DataFrame, vectors: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(draft_id, keys, id, distance) of the k turns (id, keys) of each draft's keys with the nearest vectors.

    The turns of keys that have more than SALT_TURNS are dealt out by a hash of their ids, and the drafts of these keys go
    to every part; each part keeps its k nearest of a draft, and of those the k nearest stay.
    """
    rows = turns.join(vectors.select(F.col("timeline_id").alias("id"), "embedding"), "id")
    salts = turns.groupBy(*keys).agg(F.ceil(F.count("*") / SALT_TURNS).cast("int").alias("salts")).filter("salts > 1")
    salted = rows.join(salts, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    wanted = drafts.filter("query_embedding is not null").select("draft_id", "query_embedding", *keys)
    everywhere = wanted.join(salts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    both = salted.join(everywhere, [*keys, "salt"]).select("draft_id", "salt", *keys, "id", cosine_distance(F.col("embedding"), F.col("query_embedding")).alias("distance"))
    near = top_per_key(both.filter("distance is not null"), ["draft_id", "salt"], [F.col("distance"), F.col("id")], k)
    return top_per_key(near.drop("salt"), ["draft_id"], [F.col("distance"), F.col("id")], k)


def topk_similar(drafts: DataFrame, turns: DataFrame, vectors: DataFrame, k: int = CANDIDATES, draft_keys: tuple[str, ...] = ("chat_session_id", "provider"), least_chars: int = 50) -> DataFrame:
    """The k turns nearest to each draft by cosine, among those of its session and provider with a vector and enough text.

    drafts: draft_id, query_embedding and the keys. All drafts are answered by one join on the keys, of ids and vectors
    alone; the k kept meet the turns' other columns after it. An id is a turn of its session once.
    """
    keys = list(draft_keys)
    rows = turns.filter(not_chitchat(F.col("text"), least_chars)).select("id", *keys)
    return turns.join(nearest_ids(drafts, rows, vectors, k, keys), ["id", *keys])


def budget_lists(scored: DataFrame, key: str = "draft_id", budget: str = "token_budget") -> DataFrame:
    """(key, considered, used, taken) of each key's few rows: those taken by score, each that still fits, as structs.

    scored has final_score, distance, id, cost and budget. A row that doesn't fit is passed over and uses no budget,
    which no running sum could tell.
    """
    columns = [c for c in scored.columns if c != key]
    order = F.struct((-F.col("final_score")).alias("s"), F.col("distance").alias("d"), F.col("id").alias("i"), F.struct(*columns).alias("row"))
    groups = scored.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("rows"), F.max(budget).alias("b"))
    row_type = scored.select(F.struct(*columns).alias("row")).schema["row"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{row_type}>").alias("taken"))

    def take(state: Column, item: Column) -> Column:
        total = state["used"] + item["row"]["cost"]
        return F.when(total <= F.col("b"), F.struct(total.alias("used"), F.array_append(state["taken"], item["row"]).alias("taken"))).otherwise(state)

    state = groups.select(key, F.size("rows").cast("long").alias("considered"), F.aggregate("rows", start, take).alias("f"))
    return state.select(key, "considered", "f.used", "f.taken")


def fit_to_budget(scored: DataFrame, key: str = "draft_id", budget: str = "token_budget") -> DataFrame:
    """The rows of each key that budget_lists takes."""
    return budget_lists(scored, key, budget).select(key, F.explode("taken").alias("row")).select(key, "row.*")


def rewrite_context(drafts: DataFrame, turns: DataFrame, vectors: DataFrame, sessions: DataFrame, now: Column, k: int = CANDIDATES) -> DataFrame:
    """One row per draft: outcome, counts, and the turns to put before it, oldest first.

    A draft's session is its own, or that of its external id and provider. reason: 'no_history' without session or
    turns; 'draft_too_short'; 'embeddings_pending' (degraded) when the draft or all turns have no vector, with the
    newest k turns of 50 characters or more; null else, with the k nearest scored by similarity and recency to 4
    places and fitted to the budget.
    """
    known = sessions.filter("external_session_id is not null").groupBy("external_session_id", "provider_id").agg(F.min("id").alias("resolved"))
    rows = drafts.join(known, ["external_session_id", "provider_id"], "left").withColumn("session", F.coalesce("chat_session_id", "resolved")).drop("chat_session_id", "resolved")
    # What is asked of a text is a flag before any shuffle; texts themselves are joined once, with the turns that stay.
    named = turns.withColumnsRenamed({"chat_session_id": "session", "provider": "turn_provider"}).filter("session is not null")
    slim = named.select("session", "id", "recorded_at", has_text(F.trim("text")).alias("has_text"), not_chitchat(F.col("text")).alias("said"))
    done = vectors.select(F.col("timeline_id").alias("id"), F.lit(True).alias("done"))
    complete = F.coalesce("done", F.lit(False)) | ~F.col("has_text")
    stats = slim.select("session", "id", "has_text").join(done, "id", "left").groupBy("session").agg(F.count("*").alias("total_turns"), F.count_if(complete).alias("with_embeddings"))
    rows = rows.join(stats, "session", "left").withColumns({"total_turns": F.coalesce("total_turns", F.lit(0)), "with_embeddings": F.coalesce("with_embeddings", F.lit(0))})
    reason = (
        F.when(F.col("session").isNull(), "no_history").when(~draft_usable(F.col("draft_prompt")), "draft_too_short").when(F.col("total_turns") == 0, "no_history")
        .when(F.col("query_embedding").isNull() | (F.col("with_embeddings") == 0), "embeddings_pending")
    )
    rows = rows.withColumn("reason", reason)
    said = slim.filter("said").select("session", "id", "recorded_at")
    pending = said.join(rows.filter("reason = 'embeddings_pending'").select("draft_id", "session", "token_budget"), "session")
    pending = top_per_key(pending, ["draft_id"], [F.desc("recorded_at"), F.desc("id")], k)
    normal = rows.filter("reason is null").select("draft_id", "session", F.col("provider_id"), "query_embedding", "token_budget")
    of_provider = said.select("session", "id").join(sessions.select(F.col("id").alias("session"), "provider_id"), "session")
    near = nearest_ids(normal, of_provider, vectors, k, ["session", "provider_id"]).join(normal.select("draft_id", "token_budget"), "draft_id")
    picked = ["draft_id", "session", "id", "token_budget"]
    chosen = near.select(*picked, "distance").unionByName(pending.select(*picked, F.lit(None).cast("double").alias("distance")))
    texts = chosen.join(named.select("session", "id", "role", "text", "recorded_at"), ["session", "id"])
    near, pending = texts.filter("distance is not null"), texts.filter("distance is null")
    similarity = F.lit(1.0) - F.col("distance")
    scored = near.withColumn("final_score", F.round(final_score(similarity, F.col("recorded_at"), now), 4)).withColumn("cost", tokens_floor4(F.col("text")))
    scores = {"similarity": F.round(similarity, 4), "recency": F.round(recency(F.col("recorded_at"), now), 4)}
    columns = ["draft_id", "id", "role", "text", "recorded_at", *scores, "final_score"]
    fitted = budget_lists(scored.withColumns(scores).select(*columns, "distance", "cost", "token_budget"))
    none = F.lit(None).cast("double")
    newest = pending.select("draft_id", "id", "role", "text", "recorded_at", none.alias("similarity"), none.alias("recency"), none.alias("final_score"))
    newest = newest.groupBy("draft_id").agg(F.count("*").alias("considered"), F.sum(tokens_floor4(F.col("text"))).alias("used"), F.collect_list(F.struct(*columns[1:])).alias("taken"))

    def shown(row: Column) -> Column:
        at = row["recorded_at"]
        return F.struct(at.alias("o"), *[row[c].alias(c) for c in ("id", "role", "text")], to_iso_utc(at).alias("captured_at"), *[row[c].alias(c) for c in ("similarity", "recency", "final_score")], age_human(at, now).alias("age"))

    answers = [part.select("draft_id", "considered", "used", F.sort_array(F.transform("taken", shown)).alias("retrieved_turns")) for part in (fitted, newest)]
    out = rows.join(answers[0].unionByName(answers[1]), "draft_id", "left")
    zero = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long")
    return out.select(
        "draft_id", "reason", (F.coalesce("reason", F.lit("")) == "embeddings_pending").alias("degraded"), "total_turns", "with_embeddings", (F.col("total_turns") - F.col("with_embeddings")).alias("pending"),
        zero("considered").alias("turns_considered"), zero(F.size("retrieved_turns")).alias("turns_returned"), zero("used").alias("token_budget_used"), F.col("token_budget").alias("token_budget_total"), "retrieved_turns",
    )
