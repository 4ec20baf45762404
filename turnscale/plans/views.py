"""Views that carry the given tables into the turn model, as SQL that Spark and DuckDB read alike.

Ids, flags, prices and times are integer functions of the given keys, so that a view's work grows with its table.
recorded_s and the like are seconds since 1970; `recorded_at` is added for Spark by `view`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which ages are taken: 2024-02-01, as seconds.
NOW = 1706745600

VIEWS: dict[str, tuple[list[str], str]] = {}

VIEWS["v_turns"] = (["conversations"], """
SELECT conv_id * 1000 + turn + 1 AS id,
       CASE WHEN conv_id % 17 = 0 THEN 'test-' ELSE 'ses_' END || CAST(conv_id AS STRING) AS session_id,
       CASE WHEN turn % 9 = 8 THEN NULL ELSE 'm' || CAST(turn AS STRING) END AS message_id,
       turn + 1 AS turn_id,
       'proj_' || CAST(conv_id % 5 AS STRING) AS project_id,
       CASE conv_id % 8 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google' WHEN 3 THEN 'meta'
            WHEN 4 THEN 'xai' WHEN 5 THEN 'deepseek' WHEN 6 THEN 'local' ELSE NULL END AS provider,
       CASE conv_id % 7 WHEN 0 THEN 'chat' WHEN 1 THEN 'browser_ext' WHEN 2 THEN 'web' WHEN 3 THEN 'coding'
            WHEN 4 THEN 'harness' ELSE NULL END AS client_source,
       CASE WHEN conv_id % 4 = 3 THEN NULL ELSE 'cs_' || CAST(conv_id AS STRING) END AS chat_session_id,
       CASE WHEN conv_id % 4 = 3 THEN NULL WHEN conv_id % 13 = 5 THEN 'bad id ' || CAST(conv_id AS STRING)
            ELSE 'ext-' || CAST(conv_id AS STRING) END AS external_session_id,
       CASE conv_id % 4 WHEN 0 THEN 'm-large-20240229' WHEN 1 THEN 'm-small-2024-03-01' WHEN 2 THEN 'm-large' ELSE 'm-unknown' END AS model,
       role, text, CAST(length(text) AS BIGINT) AS char_count,
       CAST(1000 + length(text) AS BIGINT) AS actual_input_tokens,
       CAST(50 + length(text) % 400 AS BIGINT) AS actual_output_tokens,
       CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE CAST(800 AS BIGINT) END AS baseline_no_context,
       CASE WHEN conv_id % 3 = 0 THEN CAST(20000 AS BIGINT) END AS baseline_full_repo,
       CASE WHEN conv_id % 3 = 1 THEN CAST(4000 AS BIGINT) END AS baseline_naive_rag,
       (conv_id + turn) % 3 = 0 AS injected,
       (conv_id + turn) % 3 = 1 AS cache_hit_estimated,
       conv_id % 11 = 0 AS baseline_period,
       CAST((conv_id * 7 + turn * 13) % 1000 AS DOUBLE) / 100000 AS saved_input_cost_usd,
       CASE WHEN turn % 4 = 0 THEN NULL ELSE CAST((conv_id * 5 + turn * 11) % 1000 AS DOUBLE) / 1000000 END AS saved_cache_cost_usd,
       CAST((conv_id * 3 + turn) % 1000 AS DOUBLE) / 1000000 AS saved_output_cost_usd,
       1704067200 + conv_id % 700 * 3600 + turn * 60 AS recorded_s
FROM {conversations}""")

VIEWS["v_resends"] = (["v_turns"], """
SELECT id, session_id, message_id, text, role, client_source, baseline_full_repo, actual_input_tokens, recorded_s, CAST(1 AS BIGINT) AS arrival_seq FROM {v_turns}
UNION ALL
SELECT id + 1000000000000, session_id, message_id, text || ' (edited)', 'user', CASE WHEN id % 4 = 0 THEN NULL ELSE 'harness' END,
       CASE WHEN id % 8 = 0 THEN CAST(9000 AS BIGINT) END, actual_input_tokens + 7, recorded_s + 30, CAST(2 AS BIGINT) FROM {v_turns} WHERE id % 6 = 0""")

VIEWS["v_sessions"] = (["v_turns"], """
SELECT chat_session_id AS id, min(provider) AS provider_id, min(external_session_id) AS external_session_id, min(recorded_s) AS first_s, max(recorded_s) AS last_s
FROM {v_turns} WHERE chat_session_id IS NOT NULL GROUP BY chat_session_id
UNION ALL
SELECT 'cs_empty_' || session_id, 'openai', 'ext-empty-' || session_id, min(recorded_s), min(recorded_s)
FROM {v_turns} WHERE turn_id = 1 AND id % 50 = 1 GROUP BY session_id""")

VIEWS["v_vectors"] = (["v_turns", "embeddings"], """
SELECT t.id AS timeline_id, e.embedding FROM {v_turns} t JOIN {embeddings} e ON e.vec_id = t.id // 1000 * 7 + t.turn_id WHERE t.id % 5 <> 0""")

VIEWS["v_drafts"] = (["v_turns", "embeddings"], """
SELECT 'd_' || t.session_id AS draft_id, t.chat_session_id, t.provider AS provider_id, t.external_session_id,
       CASE WHEN t.id // 1000 % 9 = 4 THEN ' short ' ELSE 'Please continue: ' || substr(t.text, 1, 40) END AS draft_prompt,
       CASE WHEN t.id // 1000 % 10 = 1 THEN NULL ELSE e.embedding END AS query_embedding, CASE WHEN t.id // 1000 % 2 = 0 THEN 1500 ELSE 300 END AS token_budget
FROM {v_turns} t LEFT JOIN {embeddings} e ON e.vec_id = t.id // 1000 WHERE t.turn_id = 1""")

VIEWS["v_files"] = (["documents"], """
SELECT source AS project_id,
       CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN 'data/' WHEN 4 THEN 'lib/core/' ELSE '' END
       || 'f' || CAST(doc_id AS STRING)
       || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.ts' ELSE '.png' END AS path,
       text AS content, CAST(length(text) AS BIGINT) AS length, doc_id
FROM {documents}""")

VIEWS["v_files_prev"] = (["v_files"], """
SELECT project_id, path, CASE WHEN doc_id % 11 = 0 THEN content || chr(10) || 'old' ELSE content END AS content, length, doc_id
FROM {v_files} WHERE doc_id % 7 <> 0
UNION ALL
SELECT project_id, 'gone/' || path, content, length, doc_id FROM {v_files} WHERE doc_id % 13 = 0""")

VIEWS["v_mutations"] = (["events"], """
SELECT 'n' || CAST(user_id AS STRING) AS node, {epoch_ms} AS ts_ms, CAST(length(props) % 4 AS BIGINT) AS chars_added, event_id, event_type, user_id
FROM {events}""")

VIEWS["v_candidates"] = (["v_mutations"], """
SELECT node || '-' || CAST(ts_ms // 86400000 AS STRING) AS node, ts_ms, event_id,
       CASE event_type WHEN 'click' THEN 'aria_live' WHEN 'view' THEN 'semantic_attr' WHEN 'error' THEN 'velocity' ELSE 'structural' END AS detector,
       CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.4 WHEN 'error' THEN 0.6 ELSE 0.3 END + CAST(event_id % 3 AS DOUBLE) / 10 AS confidence
FROM {v_mutations}""")

VIEWS["v_prices"] = ([], """
SELECT * FROM (VALUES ('anthropic', 'm-large', 10.0, 50.0, 12.5, 1.0, 'live'), ('anthropic', 'm-small-2024-03-01', 1.0, 5.0, 1.25, 0.1, 'live'),
  ('openai', 'm-small', 2.0, 8.0, NULL, 0.5, 'live'), ('openai', 'm-large', 5.0, 20.0, NULL, NULL, 'static'), ('google', 'm-large', 1.25, 10.0, NULL, 0.3, 'static'),
  ('deepseek', 'm-small', 0.5, 1.5, NULL, 0.05, 'static'), ('xai', 'm-large-20240229', 3.0, 15.0, NULL, 0.75, 'live'), ('xai', 'm-large', 4.0, 16.0, NULL, 0.8, 'static'))
AS p(provider, model, input_per_m, output_per_m, cache_write_per_m, cache_read_per_m, origin)""")

VIEWS["v_cohort"] = (["v_turns"], """
SELECT project_id, CAST(sum(actual_output_tokens) AS DOUBLE) / count(*) AS baseline_avg_output_tokens FROM {v_turns}
WHERE baseline_period AND project_id <> 'proj_4' GROUP BY project_id""")

EPOCH_MS = {"spark": "unix_millis(CAST(ts AS TIMESTAMP))", "duckdb": "(epoch_us(ts) // 1000)"}


def for_spark(sql: str) -> str:
    return sql.replace(" // ", " DIV ").replace("{epoch_ms}", EPOCH_MS["spark"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the given tables, as a DataFrame; seconds columns `x_s` have a timestamp `x_at` beside them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs, sql = VIEWS[name]
    df = spark.sql(for_spark(sql), **{i: view(spark, sf_dir, i) for i in inputs})
    return df.withColumns({c[:-2] + "_at": F.timestamp_seconds(c) for c in df.columns if c.endswith("_s")})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as {v_...} put before it."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS[name][0]:
            if other in VIEWS:
                visit(other)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if "{" + name + "}" in sql:
            visit(name)
    plain = lambda text: text.replace("{epoch_ms}", EPOCH_MS["duckdb"])
    for name in needed:
        tables = {i: i for i in VIEWS[name][0]}
        body = plain(VIEWS[name][1])
        for table in tables:
            body = body.replace("{" + table + "}", table)
        needed[needed.index(name)] = f"{name} AS ({body})"
    for name in VIEWS:
        sql = sql.replace("{" + name + "}", name)
    head = "WITH " + ", ".join(needed) if needed else ""
    sql = sql.strip()
    return f"{head}, {sql[5:]}" if needed and sql.upper().startswith("WITH ") else f"{head} {sql}"
