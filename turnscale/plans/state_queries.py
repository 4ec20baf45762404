"""Queries of tables that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.operators import corpus, embedding, rollups, state

from .corpus_queries import files, lines
from .views import view, with_views

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def hashes(rows: DataFrame, seen: int) -> DataFrame:
    return corpus.content_hashes(rows).select("project_id", F.col("path").alias("file_path"), "content_hash", F.lit(seen).cast("long").alias("last_seen"))


@register("""SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.path, o.path) AS file_path, sha256(coalesce(n.content, o.content)) AS content_hash, CAST(CASE WHEN n.path IS NULL THEN 1 ELSE 2 END AS BIGINT) AS last_seen
    FROM {v_files_prev} o FULL JOIN {v_files} n ON n.project_id = o.project_id AND n.path = o.path""")
def upsert_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_file_hashes(hashes(view(spark, sf_dir, "v_files_prev"), 1), hashes(files(spark, sf_dir), 2))


@register(f"""WITH f AS (SELECT project_id, CASE WHEN p.content IS NULL THEN 'new' WHEN c.content IS NULL THEN 'deleted' WHEN p.content = c.content THEN 'unchanged' ELSE 'modified' END AS x FROM {{v_files}} c FULL JOIN {{v_files_prev}} p USING (project_id, path)),
    n AS (SELECT DISTINCT project_id, file_path, stable_hash, true AS n FROM {lines('{v_files}', 8, 5)}), o AS (SELECT DISTINCT project_id, file_path, stable_hash, true AS o FROM {lines('{v_files_prev}', 8, 5)}),
    d AS (SELECT project_id, CASE WHEN o IS NULL THEN 'add' WHEN n IS NULL THEN 'remove' ELSE 'unchanged' END AS x FROM n FULL JOIN o USING (project_id, file_path, stable_hash)),
    a AS (SELECT project_id, count(*) FILTER (x = 'new') AS files_new, count(*) FILTER (x = 'modified') AS files_modified, count(*) FILTER (x = 'deleted') AS files_deleted, count(*) FILTER (x = 'unchanged') AS files_unchanged FROM f GROUP BY 1),
    b AS (SELECT project_id, count(*) FILTER (x = 'add') AS chunks_added, count(*) FILTER (x = 'remove') AS chunks_removed, count(*) FILTER (x = 'unchanged') AS chunks_unchanged FROM d GROUP BY 1)
    SELECT a.*, coalesce(chunks_added, 0) AS chunks_added, coalesce(chunks_removed, 0) AS chunks_removed, coalesce(chunks_unchanged, 0) AS chunks_unchanged FROM a LEFT JOIN b USING (project_id)""")
def reindex_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = files(spark, sf_dir), view(spark, sf_dir, "v_files_prev")
    diff = corpus.diff_snapshots(corpus.content_hashes(now), corpus.content_hashes(before))
    return corpus.reindex_summary(diff, corpus.diff_chunks(corpus.chunk_windows(now, 8, 5), corpus.chunk_windows(before, 8, 5)))


@register(f"""WITH o AS (SELECT project_id, file_path, line_start, line_end, stable_hash FROM {lines('{v_files_prev}', 8, 5)} WHERE (project_id, file_path) NOT IN (SELECT (project_id, path) FROM {{v_files}})),
    n AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path, stable_hash ORDER BY line_start DESC, line_end DESC) AS k FROM {lines('{v_files}', 8, 5)})
    SELECT * FROM o UNION ALL SELECT project_id, file_path, line_start, line_end, stable_hash FROM n WHERE k = 1""")
def apply_chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = files(spark, sf_dir)
    touched = now.select("project_id", F.col("path").alias("file_path"))
    rows = corpus.apply_chunk_diff(corpus.chunk_windows(now, 8, 5), corpus.chunk_windows(view(spark, sf_dir, "v_files_prev"), 8, 5), touched)
    return rows.select("project_id", "file_path", "line_start", "line_end", "stable_hash")


@register("""SELECT id AS timeline_id, CAST(CASE WHEN id % 5 IN (0, 1) THEN 0 ELSE 1 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS attempts, id % 5 IN (0, 1) AS completed,
    CASE id % 5 WHEN 2 THEN 'wrong_dim' WHEN 3 THEN 'unavailable' WHEN 4 THEN substr(text, 1, 500) END AS last_error FROM {v_turns}""")
def apply_embed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn had a try before if its id is even, and has another one now, whose outcome is by id."""
    turns, i = view(spark, sf_dir, "v_turns"), F.col("id") % 5
    before = turns.filter("id % 2 = 0").select(F.col("id").alias("timeline_id"), F.lit(1).alias("attempts"), F.lit(False).alias("completed"), F.lit("old").alias("last_error"))
    status = F.when(i.isin(0, 2), "ok").when(i == 1, "blank").when(i == 3, "unavailable").otherwise("error")
    vector = F.when(i == 0, F.array(F.lit(1.0), F.lit(2.0))).when(i == 2, F.array(F.lit(1.0)))
    return state.apply_embed_results(before, turns.select(F.col("id").alias("timeline_id"), status.alias("status"), vector.alias("embedding"), F.col("text").alias("error")), 2)[1]


@register("""SELECT id AS timeline_id, CASE WHEN trim(text) = '' THEN 'blank' ELSE 'ok' END AS status, CAST('0x' || substr(sha256(text), 3, 2) AS BIGINT) AS second FROM {v_turns}""")
def embed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.embed_by_hash(view(spark, sf_dir, "v_turns").withColumnRenamed("id", "timeline_id"), dim=64)
    return rows.select("timeline_id", "status", F.round(F.col("embedding")[1] * 255).cast("long").alias("second"))


@register("""SELECT id FROM {v_turns} WHERE trim(text) <> '' AND id NOT IN (SELECT timeline_id FROM {v_vectors}) ORDER BY recorded_s, id LIMIT 16""")
def pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_batch(state.pending_embeddings(view(spark, sf_dir, "v_turns"), view(spark, sf_dir, "v_vectors"))).select("id")


@register("""SELECT user_id AS session_id, min(event_id) FILTER (event_type = 'click') AS created_at, max(event_id) FILTER (event_type = 'error') AS closed_at FROM {v_mutations} GROUP BY user_id HAVING min(event_id) FILTER (event_type = 'click') IS NOT NULL""")
def session_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "register").when(F.col("event_type") == "error", "close")
    return state.session_registry(view(spark, sf_dir, "v_mutations").select(F.col("user_id").alias("session_id"), kind.alias("kind"), F.col("event_id").alias("ts")))


@register("""WITH d AS (SELECT '/w/' || CAST(o_custkey AS STRING) AS project_path, CASE o_orderkey % 4 WHEN 0 THEN 'opted_in' WHEN 1 THEN 'opted_out' WHEN 2 THEN 'pending' ELSE 'maybe' END AS state, o_orderkey AS ts FROM orders)
    SELECT project_path, arg_max(state, ts) AS state, max(ts) AS ts FROM d WHERE state <> 'maybe' GROUP BY 1""")
def opt_in_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    decided = F.when(i % 4 == 0, "opted_in").when(i % 4 == 1, "opted_out").when(i % 4 == 2, "pending").otherwise("maybe")
    rows = view(spark, sf_dir, "orders").select(F.concat(F.lit("/w/"), F.col("o_custkey").cast("string")).alias("project_path"), decided.alias("state"), i.alias("ts"))
    return state.record_opt_in(rows.filter("false"), rows)


@register("""WITH p AS (SELECT CAST(ps % 7 AS STRING) AS provider, CAST(ps % 50 AS STRING) AS model, CAST(ps AS DOUBLE) AS input_per_m, ps AS fetched_at FROM (SELECT p_partkey AS ps FROM part) WHERE ps % 3 > 0)
    SELECT provider, model, arg_max(input_per_m, fetched_at) AS input_per_m, max(fetched_at) AS fetched_at FROM p GROUP BY 1, 2""")
def upsert_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a price of one of 350 models; a third of them lack an input price."""
    i = F.col("p_partkey")
    rows = view(spark, sf_dir, "part").select((i % 7).cast("string").alias("provider"), (i % 50).cast("string").alias("model"), F.when(i % 3 > 0, i.cast("double")).alias("input_per_m"), F.lit(1.0).alias("output_per_m"), i.alias("fetched_at"))
    early = rows.filter("fetched_at % 2 = 0 and input_per_m is not null")
    return state.upsert_pricing(early, rows.filter("fetched_at % 2 = 1")).select("provider", "model", "input_per_m", "fetched_at")


@register("""WITH x AS (SELECT external_session_id, provider_id, min(id) AS sid FROM {v_sessions} WHERE external_session_id IS NOT NULL GROUP BY 1, 2)
    SELECT draft_id AS rewrite_id, coalesce(chat_session_id, sid) AS chat_session_id FROM {v_drafts} LEFT JOIN x USING (external_session_id, provider_id)""")
def record_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of every draft, half of which are there already, and all of which arrive again."""
    rows = view(spark, sf_dir, "v_drafts").select(F.col("draft_id").alias("rewrite_id"), "external_session_id", "provider_id", "chat_session_id")
    sessions = view(spark, sf_dir, "v_sessions")
    there = state.record_rewrites(rows.filter("false"), rows.filter(F.length("rewrite_id") % 2 == 0), sessions)
    return state.record_rewrites(there, rows, sessions).select("rewrite_id", "chat_session_id")


@register("""SELECT rewrite_id, round(s, 6) AS avg_similarity, h AS hours FROM (SELECT o_orderkey AS rewrite_id, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 7 + CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE o_custkey % 7 END) / 2.0 END AS s,
    CAST(greatest(0, floor(o_custkey % 40 / 4.0 - 2 + 0.5)) AS BIGINT) AS h FROM orders)""")
def rewrite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("o_orderkey"), (F.col("o_custkey") % 7).cast("double")
    second = F.when(i % 3 == 1, c).when(i % 3 == 2, 1.0)
    rows = view(spark, sf_dir, "orders").select(
        i.alias("rewrite_id"), F.lit(1).alias("arrival_seq"), F.array(F.when(i % 3 > 0, c), second).alias("similarities"), F.array(F.lit(None).cast("double"), F.col("o_custkey") % 40 / 4.0 - 2).alias("ages_hours")
    )
    out = rollups.rewrite_quality(rows)
    return out.select("rewrite_id", F.round("avg_similarity", 6).alias("avg_similarity"), F.col("age_hours")[0].cast("long").alias("hours"))
