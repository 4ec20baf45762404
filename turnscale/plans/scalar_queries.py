"""Queries of the scalar functions, filters and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.functions import filters, text
from turnscale.operators import contract, corpus, savings, signals, state
from turnscale.sources import readers

from .views import NOW, view, with_views

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


ISO = "strftime(make_timestamp({}*1000000), '%Y-%m-%dT%H:%M:%SZ')"
def now_ts():
    return F.timestamp_seconds(F.lit(NOW))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_turns")


@register("SELECT id, CASE WHEN lower(trim(client_source)) IN ('chat','browser_ext','web') THEN 'chat' ELSE 'coding' END AS client_kind FROM {v_turns}")
def client_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.normalize_client_source(F.col("client_source")).alias("client_kind"))


@register("SELECT id, coalesce(regexp_full_match(external_session_id, '[A-Za-z0-9_.\\-]{1,256}'), false) AS valid FROM {v_turns}")
def session_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.is_valid_external_session_id(F.col("external_session_id")).alias("valid"))


@register(f"SELECT id, {ISO.format('recorded_s')} AS iso, CAST(recorded_s AS BIGINT) AS parsed_s FROM {{v_turns}}")
def recorded_at_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are written as text, with a space or a T by turn, and parsed again."""
    rows = turns(spark, sf_dir)
    written = F.when(F.col("id") % 2 == 0, F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss")).otherwise(text.to_iso_utc(F.col("recorded_at")))
    return rows.select("id", text.to_iso_utc(F.col("recorded_at")).alias("iso"), F.unix_seconds(text.parse_recorded_at(written)).alias("parsed_s"))


@register(f"""
    WITH ages AS (SELECT id, greatest({NOW} - 2400000 - recorded_s, 0) AS a FROM {{v_turns}})
    SELECT id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || ' minute' || CASE WHEN a // 60 = 1 THEN '' ELSE 's' END || ' ago'
      WHEN a < 86400 THEN (a // 3600) || ' hour' || CASE WHEN a // 3600 = 1 THEN '' ELSE 's' END || ' ago'
      ELSE (a // 86400) || ' day' || CASE WHEN a // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM ages""")
def age_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.age_human(F.col("recorded_at"), F.timestamp_seconds(F.lit(NOW - 2400000))).alias("age"))


@register("""SELECT id, CAST(length(text) // 4 AS BIGINT) AS floor4, CAST(greatest(1, length(text) // 4) AS BIGINT) AS min1,
    CAST(greatest(1, floor(length(text) / 3.5)) AS BIGINT) AS code FROM {v_turns}""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return turns(spark, sf_dir).select("id", text.tokens_floor4(t).alias("floor4"), text.tokens_min1(t).alias("min1"), text.tokens_code(t).alias("code"))


@register(r"SELECT id, regexp_replace(model, '-(\d{8}|\d{4}-\d{2}-\d{2})$', '') AS model FROM {v_turns}")
def model_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.normalize_model(F.col("model")).alias("model"))


@register(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)),
      '[\t\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+(\n|$)', '\1', 'g'), '^\n+', ''), '\n+$', '')) AS stable_hash FROM documents""")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", text.stable_hash(F.col("text")).alias("stable_hash"))


@register("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").withColumn("content", F.col("text"))
    return corpus.content_hashes(rows).select("doc_id", "sha1", "content_hash")


@register("""SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' END AS language FROM (SELECT doc_id, lang FROM documents)""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("doc_id", text.detect_language(F.col("path")).alias("language"))


@register("""SELECT id, substr(text, 1, 0) || CASE WHEN position('the' IN lower(text)) > 0 THEN
      CASE WHEN position('the' IN lower(text)) > 61 THEN '…' ELSE '' END
      || trim(substr(text, CAST(greatest(0, position('the' IN lower(text)) - 61) + 1 AS INT), CAST(least(length(text), position('the' IN lower(text)) + 62) - greatest(0, position('the' IN lower(text)) - 61) AS INT)), ' ' || chr(10) || chr(9) || chr(13))
      || CASE WHEN position('the' IN lower(text)) + 62 < length(text) THEN '…' ELSE '' END
      ELSE trim(substr(text, 1, 120), ' ' || chr(10) || chr(9) || chr(13)) END AS snippet FROM {v_turns}""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.make_snippet(F.col("text"), "The").alias("snippet"))


@register("""WITH h AS (SELECT id, sha256(text) AS d FROM {v_turns}),
    v AS (SELECT id, list_transform(range(768), lambda i: CAST('0x' || substr(d, CAST(i % 32 * 2 + 1 AS INT), 2) AS BIGINT)) AS b FROM h)
    SELECT id, CAST(len(b) AS BIGINT) AS dim, CAST(list_sum(b) AS BIGINT) AS total, round(b[1] / 255.0, 9) AS v0, round(b[34] / 255.0, 9) AS v33 FROM v""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("id", text.hash_embedding(F.col("text")).alias("e"))
    total = F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x) * 255).cast("long")
    return rows.select("id", F.size("e").cast("long").alias("dim"), total.alias("total"), F.round(F.col("e")[0], 9).alias("v0"), F.round(F.col("e")[33], 9).alias("v33"))


@register("""SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(text.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@register("""SELECT id, trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\\r\\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS cleaned FROM {v_turns}""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.clean_turn_text(F.col("text")).alias("cleaned"))


@register("""WITH t AS (SELECT id, CASE id % 4 WHEN 0 THEN '▋ ' WHEN 1 THEN text WHEN 2 THEN ' ' || chr(10) ELSE '…' || substr(text, 1, 1) END AS t FROM {v_turns})
    SELECT id, regexp_full_match(t, '[\\x00-\\x20▋█▉▊▌▍▎▏⏺⏵●…]*') AS artifact FROM t""")
def streaming_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("text"), F.col("id") % 4
    shown = F.when(i == 0, "▋ ").when(i == 1, t).when(i == 2, " \n").otherwise(F.concat(F.lit("…"), F.substring(t, 1, 1)))
    return turns(spark, sf_dir).select("id", text.is_streaming_artifact(shown).alias("artifact"))


@register(r"""SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '') AS rest,
    nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '/([0-9]+)', 1), '') AS session FROM pages""")
def url_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    return view(spark, sf_dir, "pages").select("page_id", F.nullif(rest, F.lit("")).alias("rest"), text.url_session(F.col("url"), F.lit("/([0-9]+)"), F.lit(None).cast("string")).alias("session"))


PHRASES = ["Delete this chat history.", " forget this conversation", "DELETE all my memory", "nuke everything", "stop tracking", "show memory.", "what do you remember?", "show me what you've saved", "please delete this chat"]


@register("SELECT id, CASE WHEN id % 9 IN (0, 1) THEN 'delete_this_chat' WHEN id % 9 IN (2, 3) THEN 'delete_all_memory' WHEN id % 9 = 4 THEN 'pause' WHEN id % 9 IN (5, 6, 7) THEN 'show_memory' END AS command, CASE WHEN id % 9 IN (0,1,2,3) THEN true WHEN id % 9 < 8 THEN false END AS destructive, CASE WHEN id % 9 IN (2, 3) THEN 'double' WHEN id % 9 < 8 THEN 'single' END AS confirmation FROM {v_turns}")
def command_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("id") % 9).cast("int"))
    return turns(spark, sf_dir).select("id", text.classify_command(phrase).alias("c")).select("id", "c.command", "c.destructive", "c.confirmation")


@register("""SELECT id, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda h, c: xor(h * 33, c) & 4294967295) AS hash FROM {v_turns} WHERE text <> ''""")
def djb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).filter("text != ''").select("id", text.djb2(F.col("text")).alias("hash"))


@register("""SELECT id, '[' || upper(coalesce(role, 'assistant')) || '] ' || text AS rendered,
    '<Established_Context>' || chr(10) || role || chr(10) || '</Established_Context>' || chr(10) || chr(10) || '<Active_Prompt>' || chr(10) || text || chr(10) || '</Active_Prompt>' AS prompt FROM {v_turns}""")
def render_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.render_turn(F.col("role"), F.col("text")).alias("rendered"), text.render_prompt(F.col("role"), F.col("text")).alias("prompt"))


@register("""WITH t AS (SELECT id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM {v_turns}),
    h AS (SELECT id, t, substr(t, 1, 201) AS h FROM t),
    p AS (SELECT id, t, h, 201 - position(chr(10) IN reverse(h)) AS line, 201 - position(' ' IN reverse(h)) AS space FROM h)
    SELECT id, CASE WHEN length(t) <= 200 THEN t WHEN position(chr(10) IN h) > 0 AND line > 100 THEN rtrim(substr(t, 1, line), ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || '…'
      WHEN position(' ' IN h) > 0 AND space > 0 THEN substr(t, 1, space) || '…' ELSE substr(t, 1, 200) || '…' END AS short FROM p""")
def compress_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.compress_context(F.col("text"), 200).alias("short"))


@register("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'C:/w/' || CAST(doc_id AS STRING) WHEN 1 THEN '/home/a b/' || CAST(doc_id AS STRING) END AS path FROM documents""")
def file_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    uri = F.when(i == 0, F.concat(F.lit("file:///C:/w/"), d)).when(i == 1, F.concat(F.lit("file:///home/a%20b/"), d)).otherwise(F.concat(F.lit("https://x/"), d))
    return view(spark, sf_dir, "documents").select("doc_id", text.file_uri_to_path(uri).alias("path"))


@register("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(p_partkey AS DOUBLE) END AS per_m FROM part""")
def per_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey") % 4
    price = F.when(i == 0, "0").when(i == 1, "n/a").otherwise((F.col("p_partkey") / 1e6).cast("string"))
    return view(spark, sf_dir, "part").select("p_partkey", text.per_token_to_per_million(price).alias("per_m"))


@register("""SELECT path, 'ts:' || project_id || ':' || substr(sha256('/w/' || project_id), 1, 8) AS project FROM {v_files}""")
def project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").select("path", text.project_id_from_path(F.concat(F.lit("/w/"), F.col("project_id"))).alias("project"))


@register("""WITH t AS (SELECT id, greatest(0, length(text) - 100) AS s FROM {v_turns})
    SELECT id, CAST(floor(s / 4.0 + 0.5) AS BIGINT) AS tokens, round(floor(s / 4.0 + 0.5) * 0.00003, 5) AS usd FROM t""")
def display_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("id", text.display_cost(F.col("text"), F.substring("text", 1, 100)).alias("c"))
    return rows.select("id", "c.tokens", "c.usd")


@register("""SELECT id, text <> '' AS has_text, length(text) >= 50 AS not_chitchat, NOT starts_with(session_id, 'test-') AND NOT starts_with(session_id, 'e2e-') AS real,
    coalesce(client_source IN ('chat','browser_ext','web'), false) AS chat, lower(text) LIKE '%the%' AS found,
    length(trim(substr(text, 1, 12), ' ' || chr(10))) >= 10 AS draft FROM {v_turns}""")
def turn_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return turns(spark, sf_dir).select(
        "id", filters.has_text(t).alias("has_text"), filters.not_chitchat(t).alias("not_chitchat"), filters.not_fixture_session(F.col("session_id")).alias("real"),
        filters.is_chat_source(F.col("client_source")).alias("chat"), filters.search_like(t, "The").alias("found"), filters.draft_usable(F.substring(t, 1, 12)).alias("draft"),
    )


@register("""WITH v AS (SELECT id, list_filter([CASE WHEN provider IS NULL THEN 'missing:provider' END, 'missing:tokens_estimated', 'missing:block_hash',
      CASE WHEN provider NOT IN ('openai', 'anthropic', 'ollama', 'vscode_extension') THEN 'enum:provider' END], lambda x: x IS NOT NULL) AS v FROM {v_turns})
    SELECT id, array_to_string(list_sort(v), ',') AS violations FROM v""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "session_id", "turn_id", "project_id", "provider", "model", "actual_input_tokens", "actual_output_tokens", "injected"]
    rows = contract.validate_contract(turns(spark, sf_dir).select(*columns), [*contract.FIELDS, "id"])
    return rows.select("id", F.array_join(F.sort_array("violations"), ",").alias("violations"))


FEED = "'{\"id\": \"' || slug || '/m-' || p_partkey || '\", \"pricing\": {\"prompt\": \"' || price || '\", \"completion\": \"0.00002\", \"input_cache_read\": \"0.000001\"}}'"


@register("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'mistral' ELSE 'meta' END AS provider, 'm-' || CAST(p_partkey AS STRING) AS model,
    CAST(p_partkey AS DOUBLE) AS input_per_m, CAST(20 AS DOUBLE) AS output_per_m, CAST(1 AS DOUBLE) AS cache_read_per_m FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 <> 0""")
def price_feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed of one entry per part: known and unknown slugs, and prices of 0."""
    i = F.col("p_partkey")
    slug = F.when(i % 3 == 0, "mistralai").when(i % 3 == 1, "meta-llama").otherwise("someone")
    pricing = F.struct(F.when(i % 5 == 0, "0").otherwise((i / 1e6).cast("string")).alias("prompt"), F.lit("0.00002").alias("completion"), F.lit("0.000001").alias("input_cache_read"))
    entry = F.struct(F.concat(slug, F.lit("/m-"), i.cast("string")).alias("id"), pricing.alias("pricing"))
    feed = view(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("value"))
    return readers.parse_price_feed(feed).drop("cache_write_per_m")


@register("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, 1 + o_orderkey % 100 / 100.0 AS rate FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT round(15.0 / arg_max(rate, k), 2) AS goal_usd, arg_max(rate, k) AS rate FROM o""")
def fx_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates come as one observation per order, the key being the date; some have none."""
    i = F.col("o_orderkey")
    cell = F.struct(F.when(i % 7 != 0, (1 + i % 100 / 100.0).cast("string")).alias("v"))
    one = F.struct(F.lpad(i.cast("string"), 12, "0").alias("d"), cell.alias("FXUSDCAD"))
    fx = readers.parse_fx(view(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(one).alias("observations"))).alias("value")))
    return savings.subscription_goal_usd(fx).select("goal_usd", "rate")


@register(f"""WITH j AS (SELECT o_orderkey, o_custkey % 100 AS total, o_orderkey % 130 AS done, o_custkey % 50 AS et, o_orderkey % 60 AS ed,
      CASE o_orderkey % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'embed' WHEN 2 THEN 'paused' ELSE 'done' END AS phase, CAST(o_orderkey % 900 AS DOUBLE) AS e FROM orders),
    r AS (SELECT *, CASE WHEN e > 0.5 THEN done / e END AS rf, CASE WHEN e > 0.5 THEN ed / e END AS re FROM j)
    SELECT o_orderkey AS job, phase = 'paused' AS is_paused, round(CASE WHEN total <= 0 THEN 0 ELSE least(1.0, done / total) END, 6) AS files_pct,
      round(CASE WHEN phase IN ('parse', 'embed') THEN greatest(CASE WHEN rf > 0 AND total > done THEN (total - done) / rf END, CASE WHEN re > 0 AND et > ed THEN (et - ed) / re END) END, 6) AS eta
    FROM r""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    phase = F.when(i % 4 == 0, "parse").when(i % 4 == 1, "embed").when(i % 4 == 2, "paused").otherwise("done")
    jobs = view(spark, sf_dir, "orders").select(
        i.alias("job"), phase.alias("phase"), (c % 100).alias("files_total"), (i % 130).alias("files_processed"), (c % 50).alias("entities_total"), (i % 60).alias("entities_embedded"),
        F.timestamp_seconds(F.lit(NOW) - i % 900).alias("started_at"),
    )
    rows = state.progress_snapshot(jobs, now_ts())
    return rows.select("job", "is_paused", F.round("files_pct", 6).alias("files_pct"), F.round("eta_seconds", 6).alias("eta"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = F.concat(text.compress_context(F.col("text"), 300), F.lit(" end"))
    return turns(spark, sf_dir).select("id", "provider", F.col("text").alias("original"), rewritten.alias("rewritten"))


@register()
def word_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against its cleaned text with one word more, and characters per provider."""
    return signals.diff_sizes(signals.word_diff(word_pairs(spark, sf_dir)), "provider")
