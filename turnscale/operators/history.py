"""History of chats: latest, first, distinct and matching turns, and the context made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscale.functions.filters import has_text, is_chat_source, search_like
from turnscale.functions.text import make_snippet, render_turn, tokens_min1


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1. Spark keeps n rows a key on either side of the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def latest_turns(turns: DataFrame, scope: str, n: int) -> DataFrame:
    """The newest n turns with a text (empty ones too) of each scope, newest first by `rank`."""
    rows = turns.filter(F.col("text").isNotNull() & F.col(scope).isNotNull())
    return top_per_key(rows, [scope], [F.desc("recorded_at"), F.desc("id")], n)


def chat_history(turns: DataFrame, n: int) -> DataFrame:
    """The oldest n turns of each chat session that aren't empty, oldest first by `rank`."""
    rows = turns.filter(has_text(F.col("text")) & F.col("chat_session_id").isNotNull())
    return top_per_key(rows, ["chat_session_id"], [F.col("recorded_at"), F.col("id")], n)


def dedup_history(turns: DataFrame, scope: Sequence[str], n: int, sources: str = "all") -> DataFrame:
    """Distinct texts of each scope with their least role and latest time, the newest n by `rank`.

    sources: 'all', 'chat' (the chat sources) or 'coding' (all others). Texts are hashed for the shuffle and kept once.
    """
    rows = turns.filter(has_text(F.col("text")))
    for c in scope:
        rows = rows.filter(F.col(c).isNotNull())
    if sources != "all":
        chat = is_chat_source(F.col("client_source"))
        rows = rows.filter(chat if sources == "chat" else ~chat)
    rows = rows.groupBy(*scope, "text").agg(F.min("role").alias("role"), F.max("recorded_at").alias("recorded_at"))
    return top_per_key(rows, scope, [F.desc("recorded_at"), F.col("text")], n)


def joined_turns(rows: DataFrame, scope: Sequence[str], order: str) -> DataFrame:
    """The turns of each scope as one text, by `order`; a scope has the few turns that a rank left it."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), render_turn(F.col("role"), F.col("text")).alias("t"))))
    return rows.groupBy(*scope).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"), F.count("*").alias("turns"))


def get_context(turns: DataFrame, sessions: DataFrame, scope: str = "session", n: int = 10) -> DataFrame:
    """Context of every chat session (by external id and provider, chat sources only) or every project (coding only).

    The newest n distinct texts, oldest first. With `session`, sessions without such turns have an empty context and 0 tokens.
    """
    if scope == "project":
        rows = dedup_history(turns, ["project_id"], n, "coding").withColumn("o", -F.col("rank"))
        return joined_turns(rows, ["project_id"], "o").withColumn("token_count", tokens_min1(F.col("context")))
    rows = dedup_history(turns, ["chat_session_id"], n, "chat").withColumn("o", -F.col("rank"))
    texts = joined_turns(rows, ["chat_session_id"], "o")
    out = sessions.join(texts, sessions["id"] == texts["chat_session_id"], "left")
    context = F.coalesce("context", F.lit(""))
    tokens = F.when(context == "", 0).otherwise(tokens_min1(context)).cast("long")
    return out.select(F.col("provider_id").alias("provider"), "external_session_id", context.alias("context"), F.coalesce("turns", F.lit(0)).alias("turns"), tokens.alias("token_count"))


def context_for_chat(turns: DataFrame, scope: str, n: int = 5) -> DataFrame:
    """The newest n turns of each session or provider, rendered oldest first."""
    rows = latest_turns(turns, scope, n).withColumn("o", -F.col("rank"))
    return joined_turns(rows, [scope], "o")


def search_turns(turns: DataFrame, query: str, n: int = 20, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The newest n turns of each project that have the query in their text, with a snippet. An empty query has none."""
    rows = turns.filter(has_text(F.col("text")) & search_like(F.col("text"), query))
    rows = rows.select("id", "project_id", "session_id", "role", "recorded_at", make_snippet(F.col("text"), query.strip()).alias("snippet"))
    return top_per_key(rows, list(keys), [F.desc("recorded_at"), F.desc("id")], n)
