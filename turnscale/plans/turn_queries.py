"""Queries over turns: savings, roll-ups, history, retrieval, state and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.operators import history, retrieval, rollups, savings, signals, state

from .scalar_queries import ISO, now_ts
from .views import NOW, view, with_views

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_turns")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_sessions")


def iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in columns})


USD = "CAST(round(coalesce(sum(CAST({0} AS DECIMAL(38,12))), 0), 4) AS DOUBLE)"
SUMS = f"""CAST(coalesce(sum(actual_input_tokens), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(actual_output_tokens), 0) AS BIGINT) AS total_output_tokens,
    count(*) FILTER (injected) AS injected_turns, count(*) FILTER (cache_hit_estimated) AS cache_hit_turns,
    {USD.format('saved_input_cost_usd')} AS input_saved_usd, {USD.format('saved_cache_cost_usd')} AS cache_saved_usd, {USD.format('saved_output_cost_usd')} AS output_saved_usd"""
SAVED_EST = """CAST(trunc(coalesce(CAST(sum(actual_input_tokens - baseline_no_context) FILTER (injected AND NOT cache_hit_estimated AND baseline_no_context IS NOT NULL) AS DOUBLE)
    / nullif(count(*) FILTER (injected AND NOT cache_hit_estimated AND baseline_no_context IS NOT NULL), 0) * count(*) FILTER (cache_hit_estimated), 0)) AS BIGINT)"""
REAL = "NOT starts_with(session_id, 'test-') AND NOT starts_with(session_id, 'e2e-')"

CHATS = f"""SELECT s.id AS session_key, 'chat' AS source, s.provider_id AS provider, coalesce(turn_count, 0) AS turn_count, coalesce(total_input_tokens, 0) AS total_input_tokens,
    coalesce(total_output_tokens, 0) AS total_output_tokens, coalesce(injected_turns, 0) AS injected_turns, coalesce(cache_hit_turns, 0) AS cache_hit_turns,
    coalesce(input_saved_usd, 0) AS input_saved_usd, coalesce(cache_saved_usd, 0) AS cache_saved_usd, coalesce(output_saved_usd, 0) AS output_saved_usd,
    coalesce(tokens_saved_est, 0) AS tokens_saved_est, {ISO.format('s.first_s')} AS first_seen, {ISO.format('s.last_s')} AS last_seen
    FROM {{v_sessions}} s LEFT JOIN (SELECT chat_session_id, count(*) AS turn_count, {SUMS}, {SAVED_EST} AS tokens_saved_est FROM {{v_turns}} GROUP BY 1) t ON s.id = t.chat_session_id
    ORDER BY s.last_s DESC, s.id LIMIT 200"""
CODING = f"""SELECT session_id AS session_key, 'coding' AS source, coalesce(arg_max(coalesce(provider, '-'), recorded_s * 1000 + turn_id), 'harness') AS provider, count(*) AS turn_count, {SUMS}, CAST(0 AS BIGINT) AS tokens_saved_est,
    {ISO.format('min(recorded_s)')} AS first_seen, {ISO.format('max(recorded_s)')} AS last_seen FROM {{v_turns}}
    WHERE chat_session_id IS NULL AND {REAL} AND (client_source IN ('coding', 'harness') OR (client_source IS NULL AND (provider IS NULL OR provider NOT IN
      ('meta','xai','copilot','google','anthropic','openai','perplexity','deepseek','grok','mistral'))))
      AND session_id NOT IN (SELECT external_session_id FROM {{v_sessions}} WHERE external_session_id IS NOT NULL)
    GROUP BY session_id ORDER BY max(recorded_s) DESC, session_id LIMIT 50"""
CODING = f"SELECT * REPLACE (CASE WHEN provider = '-' THEN 'harness' ELSE provider END AS provider) FROM ({CODING})"
ORPHANS = f"""SELECT session_id AS session_key, 'chat' AS source, coalesce(provider, 'unknown') AS provider, count(*) AS turn_count, {SUMS}, CAST(0 AS BIGINT) AS tokens_saved_est,
    {ISO.format('min(recorded_s)')} AS first_seen, {ISO.format('max(recorded_s)')} AS last_seen FROM {{v_turns}}
    WHERE chat_session_id IS NULL AND {REAL} AND (client_source IN ('chat','browser_ext','web') OR (client_source IS NULL AND provider IN ('meta','xai','copilot','google')))
    GROUP BY session_id, provider ORDER BY max(recorded_s) DESC, session_id, 3 LIMIT 50"""


@register(CHATS)
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(rollups.session_rollup(sessions(spark, sf_dir), turns(spark, sf_dir)), "first_seen", "last_seen")


@register(CODING)
def coding_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(rollups.coding_rollup(turns(spark, sf_dir), sessions(spark, sf_dir)), "first_seen", "last_seen")


@register(ORPHANS)
def orphan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(rollups.orphan_chat_rollup(turns(spark, sf_dir)), "first_seen", "last_seen")


@register(f"SELECT * FROM ({CHATS}) UNION ALL BY NAME SELECT * FROM ({CODING}) UNION ALL BY NAME SELECT * FROM ({ORPHANS})")
def all_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(rollups.all_sessions(sessions(spark, sf_dir), turns(spark, sf_dir)), "first_seen", "last_seen")


COUNTS = """SELECT count(DISTINCT chat_session_id) AS sessions, count(*) AS turns, CAST(sum(actual_input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(actual_output_tokens) AS BIGINT) AS total_output_tokens,
    count(*) FILTER (injected) AS injected_turns, count(*) FILTER (cache_hit_estimated) AS cache_hit_turns FROM {v_turns} t WHERE chat_session_id IN (SELECT id FROM {v_sessions})"""
RATES = f"""SELECT *, round(injected_turns / turns * 100, 1) AS injection_rate_pct, round(cache_hit_turns / injected_turns * 100, 1) AS cache_hit_rate_pct,
    round(cache_hit_turns / turns * 100, 1) AS savings_pct, round(injected_turns / turns * 100, 1) AS recall_pct FROM ({COUNTS})"""
CHAT = "client_source IN ('chat', 'browser_ext', 'web')"
PART = "CAST(round(coalesce(sum(CAST(saved_{k}_cost_usd AS DECIMAL(38,12))) FILTER ({c}), 0), 4) AS DECIMAL(18,4)) AS {s}_{k}_saved_usd"
SPLIT = "SELECT " + ", ".join(PART.format(k=k, c=c, s=s) for s, c in (("total", "true"), ("chat", CHAT), ("coding", f"coalesce(NOT ({CHAT}), true)")) for k in ("input", "cache", "output")) + f" FROM {{v_turns}} WHERE {REAL}"
SPLIT = "SELECT " + ", ".join(f"CAST({s}_{k}_saved_usd AS DOUBLE) AS {s}_{k}_saved_usd" for s in ("total", "chat", "coding") for k in ("input", "cache", "output")) + ", " + ", ".join(f"CAST({s}_input_saved_usd + {s}_cache_saved_usd + {s}_output_saved_usd AS DOUBLE) AS {s}_saved_usd" for s in ("total", "chat", "coding")) + f" FROM ({SPLIT})"


@register(RATES)
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.dashboard_counts(turns(spark, sf_dir), sessions(spark, sf_dir))


@register(SPLIT)
def savings_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.savings_split(turns(spark, sf_dir))


@register(f"SELECT r.sessions, r.turns, r.total_input_tokens, r.total_output_tokens, r.injected_turns, r.cache_hit_turns, r.injection_rate_pct, r.cache_hit_rate_pct, r.savings_pct, s.total_saved_usd FROM ({RATES}) r, ({SPLIT}) s")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.usage_stats(turns(spark, sf_dir), sessions(spark, sf_dir))


@register(f"SELECT CAST(sum(x) AS BIGINT) AS total_tokens_saved_est FROM (SELECT {SAVED_EST} AS x FROM {{v_turns}} WHERE chat_session_id IS NOT NULL GROUP BY chat_session_id)")
def tokens_saved_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.tokens_saved_total(turns(spark, sf_dir))


@register(f"""SELECT provider AS provider_id, external_session_id, {ISO.format('min(recorded_s)')} AS first_seen, {ISO.format('max(recorded_s)')} AS last_seen,
    count(DISTINCT session_id || '/' || message_id) + count(*) FILTER (message_id IS NULL) AS turn_count FROM {{v_turns}}
    WHERE regexp_full_match(external_session_id, '[A-Za-z0-9_.\\-]{{1,256}}') GROUP BY provider, external_session_id""")
def chat_sessions_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(state.upsert_chat_sessions(turns(spark, sf_dir)), "first_seen", "last_seen")


@register("""SELECT t.chat_session_id, count(*) AS total_turns, count(*) FILTER (v.timeline_id IS NOT NULL OR trim(t.text) = '') AS with_embeddings,
    count(*) FILTER (v.timeline_id IS NULL AND trim(t.text) <> '') AS pending FROM {v_turns} t LEFT JOIN {v_vectors} v ON v.timeline_id = t.id WHERE t.chat_session_id IS NOT NULL GROUP BY 1""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.embedding_coverage(turns(spark, sf_dir), view(spark, sf_dir, "v_vectors"))


@register("SELECT id, session_id FROM {v_turns} t WHERE trim(text) <> '' AND id NOT IN (SELECT timeline_id FROM {v_vectors})")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_embeddings(turns(spark, sf_dir), view(spark, sf_dir, "v_vectors")).select("id", "session_id")


@register(f"""SELECT s.id AS session_key, s.provider_id AS provider, count(t.id) AS turn_count,
    CAST(round(coalesce(sum(CAST(coalesce(saved_input_cost_usd, 0) AS DECIMAL(38,12)) + CAST(coalesce(saved_cache_cost_usd, 0) AS DECIMAL(38,12)) + CAST(coalesce(saved_output_cost_usd, 0) AS DECIMAL(38,12))), 0), 4) AS DOUBLE) AS saved_usd, {ISO.format('s.last_s')} AS last_seen
    FROM {{v_sessions}} s LEFT JOIN {{v_turns}} t ON t.chat_session_id = s.id GROUP BY s.id, s.provider_id, s.last_s ORDER BY s.last_s DESC, s.id LIMIT 20""")
def list_chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(rollups.list_chat_sessions(sessions(spark, sf_dir), turns(spark, sf_dir)), "last_seen")


PRICED = r"""w AS (SELECT DISTINCT provider, model FROM {v_turns} WHERE provider IS NOT NULL AND model IS NOT NULL),
    n AS (SELECT provider, model, model AS name, 0 AS step FROM w UNION ALL SELECT provider, model, regexp_replace(model, '-(\d{8}|\d{4}-\d{2}-\d{2})$', ''), 1 FROM w),
    r AS (SELECT n.provider, n.model, p.input_per_m, p.output_per_m, p.cache_read_per_m,
            row_number() OVER (PARTITION BY n.provider, n.model ORDER BY CASE WHEN origin = 'live' THEN 0 ELSE 2 END + step) AS k
          FROM n JOIN {v_prices} p ON p.provider = n.provider AND p.model = n.name),
    rates AS (SELECT * FROM r WHERE k = 1)"""


@register(f"WITH {PRICED} SELECT t.id, CAST(input_per_m AS DOUBLE) AS input_per_m, CAST(output_per_m AS DOUBLE) AS output_per_m, CAST(cache_read_per_m AS DOUBLE) AS cache_read_per_m FROM {{v_turns}} t LEFT JOIN rates r ON r.provider = t.provider AND r.model = t.model")
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = savings.lookup_rates(turns(spark, sf_dir), view(spark, sf_dir, "v_prices"))
    return rows.select("id", *[F.col(c).cast("double").alias(c) for c in ("input_per_m", "output_per_m", "cache_read_per_m")])


@register(f"""WITH {PRICED},
    j AS (SELECT t.*, CAST(r.input_per_m AS DOUBLE) AS i, CAST(r.output_per_m AS DOUBLE) AS o, CAST(r.cache_read_per_m AS DOUBLE) AS c, k.baseline_avg_output_tokens AS avg_out,
            NOT t.baseline_period AND r.input_per_m IS NOT NULL AS ok, coalesce(t.baseline_full_repo, t.baseline_naive_rag, t.baseline_no_context) AS base
          FROM {{v_turns}} t LEFT JOIN rates r ON r.provider = t.provider AND r.model = t.model LEFT JOIN {{v_cohort}} k ON k.project_id = t.project_id),
    s AS (SELECT id, CASE WHEN ok AND injected AND base IS NOT NULL THEN greatest(0, base - actual_input_tokens) * i / 1e6 ELSE 0 END AS a,
            CASE WHEN ok AND cache_hit_estimated AND c IS NOT NULL THEN greatest(0.0, actual_input_tokens * i - actual_input_tokens * c) / 1e6 ELSE 0 END AS b,
            CASE WHEN ok AND avg_out IS NOT NULL THEN greatest(0, CAST(round_even(avg_out, 0) AS BIGINT) - actual_output_tokens) * o / 1e6 ELSE 0 END AS d FROM j)
    SELECT id, round(a + 1e-9, 6) AS saved_input_cost_usd, round(b + 1e-9, 6) AS saved_cache_cost_usd, round(d + 1e-9, 6) AS saved_output_cost_usd,
      CASE WHEN d > 0 THEN 'output_cohort_measured' WHEN b > 0 THEN 'cache_measured' ELSE 'input_measured' END AS measurement_basis FROM s""")
def turn_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums are nudged off the halves of the sixth place, which binary fractions put on either side."""
    rows = savings.turn_savings(turns(spark, sf_dir), view(spark, sf_dir, "v_prices"), view(spark, sf_dir, "v_cohort"), places=None)
    usd = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("saved_input_cost_usd", "saved_cache_cost_usd", "saved_output_cost_usd")]
    return rows.select("id", *usd, "measurement_basis")


@register(f"""WITH g AS (SELECT project_id, text, min(role) AS role, max(recorded_s) AS s FROM {{v_turns}} WHERE text <> '' AND coalesce(NOT ({CHAT}), true) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY s DESC, text) AS rank FROM g)
    SELECT project_id, text, role, {ISO.format('s')} AS recorded_at, rank FROM r WHERE rank <= 10""")
def dedup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso(history.dedup_history(turns(spark, sf_dir), ["project_id"], 10, "coding"), "recorded_at")


@register("SELECT id, rank, chat_session_id FROM (SELECT id, chat_session_id, row_number() OVER (PARTITION BY chat_session_id ORDER BY recorded_s DESC, id DESC) AS rank FROM {v_turns} WHERE chat_session_id IS NOT NULL AND text IS NOT NULL) WHERE rank <= 5")
def latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_turns(turns(spark, sf_dir), "chat_session_id", 5).select("id", "rank", "chat_session_id")


@register("SELECT id, rank, chat_session_id FROM (SELECT id, chat_session_id, row_number() OVER (PARTITION BY chat_session_id ORDER BY recorded_s, id) AS rank FROM {v_turns} WHERE chat_session_id IS NOT NULL AND text <> '') WHERE rank <= 4")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.chat_history(turns(spark, sf_dir), 4).select("id", "rank", "chat_session_id")


@register("""WITH r AS (SELECT provider, role, text, row_number() OVER (PARTITION BY provider ORDER BY recorded_s DESC, id DESC) AS k FROM {v_turns} WHERE provider IS NOT NULL AND text IS NOT NULL)
    SELECT provider, string_agg('[' || upper(coalesce(role, 'assistant')) || '] ' || text, chr(10) || chr(10) ORDER BY k DESC) AS context, count(*) AS turns FROM r WHERE k <= 5 GROUP BY provider""")
def context_for_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.context_for_chat(turns(spark, sf_dir), "provider")


@register(f"""WITH g AS (SELECT chat_session_id, text, min(role) AS role, max(recorded_s) AS s FROM {{v_turns}} WHERE text <> '' AND chat_session_id IS NOT NULL AND {CHAT} GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY chat_session_id ORDER BY s DESC, text) AS k FROM g),
    c AS (SELECT chat_session_id, string_agg('[' || upper(coalesce(role, 'assistant')) || '] ' || text, chr(10) || chr(10) ORDER BY k DESC) AS context, count(*) AS n FROM r WHERE k <= 10 GROUP BY 1)
    SELECT provider_id AS provider, external_session_id, coalesce(context, '') AS context, coalesce(n, 0) AS turns,
      CAST(CASE WHEN context IS NULL THEN 0 ELSE greatest(1, length(context) // 4) END AS BIGINT) AS token_count FROM {{v_sessions}} s LEFT JOIN c ON c.chat_session_id = s.id""")
def get_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.get_context(turns(spark, sf_dir), sessions(spark, sf_dir))


@register("SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY recorded_s DESC, id DESC) AS rank FROM {v_turns} WHERE text ILIKE '%th_re%') WHERE rank <= 20")
def search_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search_turns(turns(spark, sf_dir), " Th_re ").select("id", "rank")


NEAR = """c AS (SELECT d.draft_id, t.id, t.text, t.role, t.recorded_s, d.token_budget, 1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(d.query_embedding AS DOUBLE[])) AS distance
      FROM {v_drafts} d JOIN {v_turns} t ON t.chat_session_id = d.chat_session_id AND t.provider = d.provider_id JOIN {v_vectors} v ON v.timeline_id = t.id
      WHERE length(t.text) >= 50 AND d.query_embedding IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY distance, id) AS rank FROM c WHERE distance IS NOT NULL),
    near AS (SELECT * FROM k WHERE rank <= 20)"""


@register(f"WITH {NEAR} SELECT draft_id, id, rank, round(distance, 6) AS distance FROM near")
def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = view(spark, sf_dir, "v_drafts").withColumn("provider", F.col("provider_id"))
    return retrieval.topk_similar(drafts, turns(spark, sf_dir), view(spark, sf_dir, "v_vectors")).select("draft_id", "id", "rank", F.round("distance", 6).alias("distance"))


SCORED = f"""scored AS (SELECT *, round(0.7 * (1 - distance) + (1 - 0.7) * pow(0.5, greatest(0, {NOW} - recorded_s) / 259200.0), 4) AS final, length(text) // 4 AS cost FROM near),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY final DESC, distance, id) AS p FROM scored),
    lists AS (SELECT draft_id, max(token_budget) AS b, list(cost ORDER BY p) AS costs, list(id ORDER BY p) AS ids FROM ordered GROUP BY draft_id),
    steps AS (SELECT draft_id, ids, list_reduce(list_prepend({{'used': CAST(0 AS BIGINT), 'at': CAST(0 AS BIGINT), 'cost': CAST(0 AS BIGINT), 'taken': CAST([] AS BIGINT[])}},
        list_transform(range(len(costs)), lambda i: {{'used': CAST(0 AS BIGINT), 'at': CAST(i + 1 AS BIGINT), 'cost': CAST(costs[i + 1] AS BIGINT), 'taken': CAST([b] AS BIGINT[])}})),
        lambda s, x: CASE WHEN s['used'] + x['cost'] <= x['taken'][1] THEN {{'used': s['used'] + x['cost'], 'at': x['at'], 'cost': x['cost'], 'taken': list_append(s['taken'], x['at'])}} ELSE s END) AS st FROM lists),
    fitted AS (SELECT draft_id, unnest(list_transform(st['taken'], lambda i: ids[i])) AS id FROM steps)"""


@register(f"WITH {NEAR}, {SCORED} SELECT f.draft_id, f.id, s.final AS final_score FROM fitted f JOIN scored s ON s.draft_id = f.draft_id AND s.id = f.id")
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = view(spark, sf_dir, "v_drafts").withColumn("provider", F.col("provider_id"))
    near = retrieval.topk_similar(drafts, turns(spark, sf_dir), view(spark, sf_dir, "v_vectors")).join(drafts.select("draft_id", "token_budget"), "draft_id")
    score = F.round(retrieval.final_score(1 - F.col("distance"), F.col("recorded_at"), now_ts()), 4)
    scored = near.withColumn("final_score", score).withColumn("cost", F.floor(F.length("text") / 4).cast("long"))
    return retrieval.fit_to_budget(scored).select("draft_id", "id", "final_score")


@register(f"""WITH {NEAR}, {SCORED},
    st AS (SELECT t.chat_session_id, count(*) AS total, count(v.timeline_id) AS done FROM {{v_turns}} t LEFT JOIN {{v_vectors}} v ON v.timeline_id = t.id GROUP BY 1),
    x AS (SELECT external_session_id, provider_id, min(id) AS sid FROM {{v_sessions}} WHERE external_session_id IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT d.draft_id, d.token_budget, coalesce(d.chat_session_id, x.sid) AS sid, d.draft_prompt, d.query_embedding, coalesce(st.total, 0) AS total, coalesce(st.done, 0) AS done
          FROM {{v_drafts}} d LEFT JOIN x ON x.external_session_id = d.external_session_id AND x.provider_id = d.provider_id LEFT JOIN st ON st.chat_session_id = coalesce(d.chat_session_id, x.sid)),
    o AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_history' WHEN length(trim(draft_prompt)) < 10 THEN 'draft_too_short' WHEN total = 0 THEN 'no_history' WHEN query_embedding IS NULL OR done = 0 THEN 'embeddings_pending' END AS reason FROM d),
    fb AS (SELECT o.draft_id, t.id, t.text, row_number() OVER (PARTITION BY o.draft_id ORDER BY t.recorded_s DESC, t.id DESC) AS k FROM o JOIN {{v_turns}} t ON t.chat_session_id = o.sid WHERE o.reason = 'embeddings_pending' AND length(t.text) >= 50),
    shown AS (SELECT f.draft_id, f.id, s.cost FROM fitted f JOIN scored s USING (draft_id, id) JOIN o USING (draft_id) WHERE o.reason IS NULL UNION ALL SELECT draft_id, id, length(text) // 4 FROM fb WHERE k <= 20),
    con AS (SELECT draft_id, count(*) AS c FROM scored JOIN o USING (draft_id) WHERE o.reason IS NULL GROUP BY 1 UNION ALL SELECT draft_id, count(*) FROM fb WHERE k <= 20 GROUP BY 1),
    l AS (SELECT draft_id, count(*) AS n, CAST(sum(cost) AS BIGINT) AS used, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM shown GROUP BY 1)
    SELECT o.draft_id, o.reason, coalesce(o.reason = 'embeddings_pending', false) AS degraded, o.total AS total_turns, o.done AS with_embeddings, o.total - o.done AS pending,
      coalesce(c, 0) AS turns_considered, coalesce(n, 0) AS turns_returned, coalesce(used, 0) AS token_budget_used, CAST(o.token_budget AS INT) AS token_budget_total, coalesce(ids, '') AS ids
    FROM o LEFT JOIN l USING (draft_id) LEFT JOIN con USING (draft_id)""")
def rewrite_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = view(spark, sf_dir, "v_drafts")
    rows = retrieval.rewrite_context(drafts, turns(spark, sf_dir), view(spark, sf_dir, "v_vectors"), sessions(spark, sf_dir), now_ts())
    ids = F.array_join(F.transform(F.coalesce("retrieved_turns", F.array().cast(rows.schema["retrieved_turns"].dataType)), lambda t: t["id"].cast("string")), ",")
    return rows.withColumn("ids", ids).drop("retrieved_turns")


@register("""WITH r AS (SELECT * FROM {v_resends} WHERE message_id IS NOT NULL),
    m AS (SELECT session_id, message_id, min(arrival_seq) AS lo, max(arrival_seq) AS hi FROM r GROUP BY 1, 2),
    u AS (SELECT f.id, m.session_id, m.message_id, l.text, f.role, coalesce(l.client_source, f.client_source) AS client_source, coalesce(l.baseline_full_repo, f.baseline_full_repo) AS baseline_full_repo, l.actual_input_tokens, m.hi AS arrival_seq
      FROM m JOIN r f ON f.session_id = m.session_id AND f.message_id = m.message_id AND f.arrival_seq = m.lo JOIN r l ON l.session_id = m.session_id AND l.message_id = m.message_id AND l.arrival_seq = m.hi)
    SELECT * FROM u UNION ALL BY NAME SELECT id, session_id, message_id, text, role, client_source, baseline_full_repo, actual_input_tokens, arrival_seq FROM {v_resends} WHERE message_id IS NULL""")
def upsert_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_turns(view(spark, sf_dir, "v_resends").drop("recorded_s", "recorded_at"))


@register("""SELECT 'turns' AS "table", count(*) AS deleted FROM {v_turns} WHERE chat_session_id IN (SELECT id FROM {v_sessions} WHERE id LIKE '%7')
    UNION ALL SELECT 'sessions', count(*) FROM {v_sessions} WHERE id LIKE '%7'""")
def forget_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    return state.forget_sessions({"turns": (turns(spark, sf_dir), "chat_session_id"), "sessions": (s, "id")}, s.filter(F.col("id").endswith("7")).select(F.col("id").alias("session_id")))[1]


@register("""WITH f AS (SELECT session_id, message_id, min(recorded_s * 1000 + turn_id) AS k FROM {v_turns} GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k) AS turn_no FROM f)
    SELECT t.id, CAST(n.turn_no AS INT) AS turn_no FROM {v_turns} t JOIN n ON n.session_id = t.session_id AND n.message_id IS NOT DISTINCT FROM t.message_id""")
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.assign_turn_ids(turns(spark, sf_dir)).select("id", "turn_no")


@register("""WITH l AS (SELECT node, detector, arg_max(confidence, ts_ms * 100000 + event_id % 100000) AS c FROM {v_candidates} GROUP BY 1, 2),
    v AS (SELECT node, count(*) AS detectors, round(greatest(1 - product(1 - c), max(c)), 9) AS confidence FROM l GROUP BY node) SELECT *, confidence >= 0.7 AS promoted FROM v""")
def detector_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.detector_vote(view(spark, sf_dir, "v_candidates"))


HOURS = 3_600_000


@register(f"""WITH m AS (SELECT * FROM {{v_mutations}} WHERE chars_added > 0),
    w AS (SELECT node, ts_ms, count(*) OVER r AS n, avg(chars_added) OVER r AS mean, ts_ms - min(ts_ms) OVER (PARTITION BY node) AS span FROM m
          WINDOW r AS (PARTITION BY node ORDER BY ts_ms RANGE BETWEEN {48 * HOURS - 1} PRECEDING AND CURRENT ROW))
    SELECT node, min(ts_ms) AS ts_ms, 'velocity' AS detector, CAST(0.6 AS DOUBLE) AS confidence FROM w WHERE n >= 3 AND span >= {HOURS} AND n * 1000.0 / nullif(span, 0) >= 0.00004 AND mean >= 1 GROUP BY node""")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.velocity_candidates(view(spark, sf_dir, "v_mutations"), 48 * HOURS, HOURS, 0.00004, 3, 1.0)


@register(f"""WITH r AS (SELECT node, ts_ms, event_id, sum(greatest(chars_added, 1)) OVER w / greatest(ts_ms - min(ts_ms) OVER w, 1) AS rate FROM {{v_mutations}}
      WINDOW w AS (PARTITION BY node ORDER BY ts_ms RANGE BETWEEN {12 * HOURS} PRECEDING AND CURRENT ROW)),
    p AS (SELECT *, rate < 0.05 * max(rate) OVER (PARTITION BY node ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS flat FROM r),
    s AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM p),
    f AS (SELECT node, g, min(ts_ms) AS start FROM s WHERE flat GROUP BY 1, 2), e AS (SELECT node, g - 1 AS g, min(ts_ms) AS nxt FROM s WHERE NOT flat GROUP BY 1, 2)
    SELECT f.node, min(start) + {8 * HOURS} AS completed_ms FROM f LEFT JOIN e ON e.node = f.node AND e.g = f.g WHERE nxt IS NULL OR nxt - start >= {8 * HOURS} GROUP BY f.node""")
def flatline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.flatline_completion(view(spark, sf_dir, "v_mutations"), 12 * HOURS, 8 * HOURS)


@register("""SELECT node AS host, CAST(ts_ms // 86400000 AS STRING) AS session, (max(ts_ms) - min(ts_ms)) / 1000 AS seconds, CAST(sum(chars_added) AS BIGINT) AS mutations FROM {v_mutations}
    GROUP BY 1, 2 HAVING (max(ts_ms) - min(ts_ms)) / 1000 >= 300 AND sum(chars_added) >= 3 AND NOT bool_or(event_type = 'error')""")
def blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_mutations").select(F.col("node").alias("host"), F.expr("CAST(ts_ms DIV 86400000 AS STRING)").alias("session"), "ts_ms", F.col("chars_added").alias("mutations"), (F.col("event_type") == "error").alias("detected"))
    return rollups.blackouts(rows, 300, 3)


@register(f"""WITH g AS (SELECT node, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER w >= {6 * HOURS} OR lag(ts_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM {{v_mutations}} WINDOW w AS (PARTITION BY node ORDER BY ts_ms)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY node ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT node, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS events FROM s GROUP BY node, k""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "v_mutations").withColumn("ts", F.timestamp_millis("ts_ms"))
    rows = signals.debounce(events, "6 hours", ("node",))
    return rows.select("node", F.unix_millis("first_event").alias("first_ms"), F.unix_millis("last_event").alias("last_ms"), "events")


@register()
def rolling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rolling_dedup(turns(spark, sf_dir).select("session_id", "text", "recorded_at", "id"), "session_id", 5).select("id")


@register("""SELECT node, CAST(least(ts + 300, coalesce(ts - 1000 + 300, 9e18), ts + 1500) AS BIGINT) AS completed_ms, 'sse_interceptor' AS source FROM (SELECT node, min(ts_ms) AS ts FROM {v_mutations} GROUP BY node) WHERE false
    UNION ALL SELECT node, CASE WHEN user_id % 3 = 0 THEN ts + 300 WHEN user_id % 3 = 1 THEN ts - 700 ELSE ts + 1500 END, CASE WHEN user_id % 3 = 0 THEN 'sse_interceptor' WHEN user_id % 3 = 1 THEN 'stop_button' ELSE 'debounce' END
    FROM (SELECT node, user_id, max(ts_ms) AS ts FROM {v_mutations} GROUP BY node, user_id)""")
def stream_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = view(spark, sf_dir, "v_mutations").groupBy("node", "user_id").agg(F.max("ts_ms").alias("last_mutation_ms"))
    i, t = F.col("user_id") % 3, F.col("last_mutation_ms")
    rows = last.select("node", F.when(i == 0, t).alias("sse_end_ms"), F.when(i == 1, t - 1000).alias("stop_gone_ms"), F.lit(None).cast("long").alias("flatline_ms"), "last_mutation_ms", F.lit(1500).alias("debounce_ms"))
    return signals.stream_completion(rows)


ROOTS = """SELECT user_id AS client_id, event_id AS ts, list_distinct(['file:///r' || CAST(event_id % 3 AS STRING), 'file:///r' || CAST(event_id % 5 AS STRING)]) AS roots FROM {v_mutations}"""


@register(f"""WITH s AS ({ROOTS}), b AS (SELECT *, coalesce(lag(roots) OVER (PARTITION BY client_id ORDER BY ts), []) AS before FROM s),
    d AS (SELECT client_id, ts, 'added' AS change, unnest(list_filter(roots, lambda x: NOT list_contains(before, x))) AS root FROM b
      UNION ALL SELECT client_id, ts, 'removed', unnest(list_filter(before, lambda x: NOT list_contains(roots, x))) FROM b) SELECT * FROM d""")
def roots_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = lambda n: F.concat(F.lit("file:///r"), (F.col("event_id") % n).cast("string"))
    return signals.roots_diff(view(spark, sf_dir, "v_mutations").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("ts"), F.array(root(3), root(5), F.lit("https://x")).alias("roots")))


@register("""SELECT user_id AS client_id FROM {v_mutations} GROUP BY user_id HAVING max(event_id) FILTER (event_type IN ('click', 'view')) IS NOT NULL
    AND (max(event_id) FILTER (event_type = 'error') IS NULL OR max(event_id) FILTER (event_type IN ('click', 'view')) > max(event_id) FILTER (event_type = 'error'))""")
def connected_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "connect").when(F.col("event_type") == "error", "disconnect")
    return signals.connected_clients(view(spark, sf_dir, "v_mutations").select(F.col("user_id").alias("client_id"), kind.alias("kind"), F.col("event_id").alias("ts"))).select("client_id")


@register("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS provider_id, count(*) AS rewrites, round(count(*) FILTER (o_custkey % 2 = 0) / count(*) * 100, 1) AS confirmed_pct,
    round(count(*) FILTER (o_custkey % 5 = 0) / count(*) * 100, 1) AS degraded_pct FROM orders GROUP BY 1""")
def rewrite_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a rewrite that arrives twice; the second arrival must not count."""
    c, i = F.col("o_custkey"), F.col("o_orderkey")
    one = view(spark, sf_dir, "orders").select(
        i.alias("rewrite_id"), F.lit(1).alias("arrival_seq"), F.when(i % 3 == 0, "a").otherwise("b").alias("provider_id"), (c % 2 == 0).alias("user_confirmed"), (c % 5 == 0).alias("degraded"),
        F.array((c % 7).cast("double"), F.lit(None).cast("double")).alias("similarities"), F.array(F.lit(-1.0), F.lit(2.4)).alias("ages_hours"),
    )
    again = one.withColumns({"arrival_seq": F.lit(2), "user_confirmed": F.lit(True), "degraded": F.lit(True)})
    return rollups.rewrite_outcomes(rollups.rewrite_quality(one.unionByName(again)))
