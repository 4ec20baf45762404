"""Queries of sources, sinks, composite indexing jobs and streams: each writes given tables or reads them as they arrive."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.functions.text import looks_binary, tokens_min1
from turnscale.operators import corpus, embedding, packs, rollups, signals, state
from turnscale.sources import readers, versions, writers
from turnscale.streaming import jobs

from . import turn_queries
from .corpus_queries import SELECTED, corpus_files, files, lines
from .turn_queries import HOURS
from .views import view, with_views

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = with_views(sql) if "{v_" in sql else sql
        return f

    return add


@functools.cache
def local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="turnscale-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares: spark.checkpoint.dir; in local mode a folder of our own will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# Sources

#: Files that take many times the disk of the input are written as so many trees at most, one after the other; as fewer where
#: these would have less than so many bytes.
TREES, TREE_BYTES = 10, 256 << 20


@register("SELECT session_id, turn_id, CAST(length(text) AS BIGINT) AS char_count, injected, false AS incomplete, epoch_us(make_timestamp(recorded_s * 1000000)) // 1000000 AS second FROM {v_turns}")
def read_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as requests without counts of characters, and read."""
    path = scratch(spark, "requests")
    rows = view(spark, sf_dir, "v_turns")
    rows.select("session_id", "turn_id", "text", "role", "provider", "injected", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("recorded_at")).write.json(path)
    return readers.read_turns(spark, path).select("session_id", "turn_id", "char_count", "injected", "incomplete", F.unix_timestamp("recorded_at").alias("second"))


@register("""SELECT 'source=' || source AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY source
    HAVING sum(octet_length(encode(text)) + 1) <= 1000000""")
def read_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source as one file of a tree; files of over a megabyte are passed over."""
    path = scratch(spark, "tree")
    view(spark, sf_dir, "documents").filter("text is not null").select("source", "text").repartition("source").write.partitionBy("source").text(path)
    rows = readers.read_source_tree(spark, path, "p")
    return rows.select(F.split("path", "/")[0].alias("folder"), F.octet_length("content").cast("long").alias("bytes"))


@register("""WITH d AS (SELECT 'source=' || source || '/pack=' || CAST(doc_id // 100 AS VARCHAR) AS folder, (octet_length(encode(text)) + 1) * CASE WHEN doc_id // 100 % 8 = 0 THEN 40 ELSE 1 END AS b FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
    SELECT folder, CAST(sum(b) AS BIGINT) AS bytes FROM d GROUP BY folder HAVING sum(b) <= 1000000""")
def read_source_tree_of_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source's share of a hundred documents, so that there are more files of more documents. Every eighth has its
    texts forty times, which puts most of these over a megabyte.

    The files take many times the disk of their documents, so they are dealt into trees, each of which is written, read and
    deleted by itself.
    """
    base, copies = scratch(spark, "packs"), F.when(F.col("pack") % 8 == 0, 40).otherwise(1)
    rows = view(spark, sf_dir, "documents").filter("text is not null and source is not null").select("source", F.expr("doc_id DIV 100").alias("pack"), "text")
    size = rows.agg(F.sum((F.octet_length("text") + F.lit(1)).cast("long") * copies)).first()[0] or 0
    count, tasks = min(TREES, size // TREE_BYTES + 1), 4 * spark.sparkContext.defaultParallelism
    parted = rows.withColumn("part", F.pmod(F.xxhash64("source", "pack"), F.lit(count)).cast("int"))
    parted.write.option("compression", "zstd").partitionBy("part").parquet(f"{base}/parts")
    with ThreadPoolExecutor(1) as beside:
        deleted: Future | None = None
        for part in range(count):
            path = f"{base}/tree-{part}"
            texts = spark.read.schema(parted.schema).parquet(f"{base}/parts").filter(F.col("part") == part)
            # The work is in the number of files, so their tasks don't go by bytes. Copies are made behind the shuffle.
            dealt = texts.repartition(tasks, "source", "pack").select("source", "pack", F.explode(F.array_repeat("text", copies)).alias("text"))
            dealt.write.partitionBy("source", "pack").text(path)
            found = readers.read_source_tree(spark, path, "p")
            found = found.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("folder"), F.octet_length("content").cast("long").alias("bytes"))
            found.coalesce(tasks).write.mode("append").parquet(f"{base}/found")
            # Many files take a while to delete, so that goes on while the next tree is begun; a third isn't before it has ended.
            if deleted:
                deleted.result()
            deleted = beside.submit(delete, spark, path)
            delete(spark, f"{base}/parts/part={part}")
        deleted.result()
    return spark.read.schema(found.schema).parquet(f"{base}/found")


@register("""SELECT CAST(p_partkey % 7 AS STRING) AS provider, CAST(p_partkey % 50 AS STRING) AS model, CAST(max(p_partkey) AS DOUBLE) AS input_per_m, CAST(min(p_partkey) AS DOUBLE) AS output_per_m FROM part GROUP BY 1, 2""".replace("STRING", "VARCHAR"))
def read_price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest and lowest part of 350 models as the nested map of a price file."""
    path, i = scratch(spark, "matrix"), F.col("p_partkey")
    models = view(spark, sf_dir, "part").groupBy((i % 7).cast("string").alias("provider"), (i % 50).cast("string").alias("model")).agg(F.max(i).cast("double").alias("input_per_m"), F.min(i).cast("double").alias("output_per_m"))
    entry = F.struct("model", F.struct("input_per_m", "output_per_m"))
    providers = models.groupBy("provider").agg(F.map_from_entries(F.collect_list(entry)).alias("models"))
    providers.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("provider", "models"))).alias("providers"))).alias("value")).write.text(path)
    return readers.read_price_matrix(spark, path).select("provider", "model", "input_per_m", "output_per_m")


@register("""SELECT 'h' || CAST(s_suppkey AS VARCHAR) || '.example' AS host, 'p' || CAST(s_nationkey AS VARCHAR) AS provider_id, '/c/([a-z0-9]+)' AS url_session_pattern,
    CASE WHEN s_suppkey % 2 = 0 THEN '/c/' END AS path_filter, CAST(s_suppkey % 9 * 100 AS INT) AS debounce_ms FROM supplier""")
def read_provider_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, i = scratch(spark, "hints"), F.col("s_suppkey")
    hint = F.struct(
        F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("provider_id"), F.lit("/c/([a-z0-9]+)").alias("url_session_pattern"),
        F.when(i % 2 == 0, "/c/").alias("path_filter"), (i % 9 * 100).cast("int").alias("debounce_ms"),
    )
    hosts = view(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), i.cast("string"), F.lit(".example")).alias("host"), hint.alias("h"))
    hosts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("host", "h"))).alias("providers"))).alias("value")).write.text(path)
    return readers.read_provider_hints(spark, path)


@register("""SELECT 'h' || CAST(s_suppkey AS VARCHAR) || '.example' AS host, 'p' || CAST(s_nationkey AS VARCHAR) AS provider_id, CAST(NULL AS VARCHAR) AS url_session_pattern,
    '/n' || CAST(s_nationkey AS VARCHAR) AS path_filter, CAST(s_suppkey % 9 * 100 AS INT) AS debounce_ms FROM supplier""")
def read_provider_hints_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of hints for each nation, each in one value, read together."""
    path, i, nation = scratch(spark, "nations"), F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    hint = F.struct(F.concat(F.lit("p"), nation).alias("provider_id"), F.concat(F.lit("/n"), nation).alias("path_filter"), (i % 9 * 100).cast("int").alias("debounce_ms"))
    hosts = view(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("h"), i.cast("string"), F.lit(".example")).alias("host"), hint.alias("h"))
    values = hosts.groupBy("s_nationkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("host", "h"))).alias("providers"))).alias("value"))
    values.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return readers.read_provider_hints(spark, f"{path}/*")


# Sinks and tables


@register("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS BIGINT) AS o_custkey FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT o_orderkey, CAST(o_custkey AS BIGINT) FROM orders WHERE o_orderkey % 5 = 0""")
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are written, changed from the table itself, and added to."""
    path, rows = scratch(spark, "table"), view(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"))
    writers.write_table(rows, path)
    old = spark.read.schema(rows.schema).parquet(path).filter("o_orderkey % 5 != 0")
    writers.write_table(old.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))), path)
    writers.write_table(rows.filter("o_orderkey % 5 = 0"), path, "append")
    return spark.read.schema(rows.schema).parquet(path)


@register("""SELECT 'first' AS version, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
    SELECT 'last', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END FROM orders""")
def write_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is overwritten from itself and added to; what was read before that still has the first version's rows."""
    path, rows = scratch(spark, "versions"), view(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"))
    versions.write_version(rows.filter("o_orderkey % 2 = 0"), path)
    first = versions.read_version(spark, path)
    versions.write_version(first.withColumn("o_custkey", F.col("o_custkey") + 1), path)
    versions.write_version(rows.filter("o_orderkey % 2 = 1"), path, "append")
    named = lambda df, name: df.select(F.lit(name).alias("version"), "o_orderkey", "o_custkey")
    return named(first, "first").unionByName(named(versions.read_version(spark, path), "last"))


@register("SELECT CAST(2 AS INT) AS parts, count(*) AS orders FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(1 AS INT), count(*) FROM orders")
def write_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four snapshots of the orders, the second and the fourth are what was emitted before them."""
    path, rows, turn = scratch(spark, "feed"), view(spark, sf_dir, "orders"), iter((2, 2, 1, 1))

    def snapshot() -> DataFrame:
        parts = next(turn)
        return rows.filter(F.col("o_orderkey") % parts == 0).agg(F.lit(parts).alias("parts"), F.count("*").alias("orders"))

    on_batch = writers.write_change_feed(snapshot, lambda row: row.write.mode("append").parquet(path))
    for n in range(4):
        on_batch(rows, n)
    return spark.read.parquet(path)


@register("""SELECT 'orders' AS "table", count(*) AS deleted, CAST(0 AS BIGINT) AS kept FROM orders UNION ALL SELECT 'customer', count(*), 0 FROM customer""")
def forget_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, counts = state.forget_all({t: view(spark, sf_dir, t) for t in ("orders", "customer")})
    kept = [rows.agg(F.lit(name).alias("table"), F.count("*").alias("kept")) for name, rows in left.items()]
    return counts.join(kept[0].unionByName(kept[1]), "table")


@register("SELECT c_custkey, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DOUBLE) AS score FROM customer")
def evolve_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "customer").select("c_custkey")
    return state.evolve_schema(rows, {"c_custkey": "string", "note": "string", "score": "double"})


@register("SELECT 'p' || CAST(o_custkey % 9 AS VARCHAR) AS project_id, o_orderkey AS started_at FROM orders")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 9).cast("string")).alias("project_id"), F.col("o_orderkey").alias("started_at"))
    return state.recent_jobs(rows)


@register("""SELECT id AS timeline_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN id % 16 = 3 THEN 'wrong_dim' WHEN id % 16 = 7 THEN 'unavailable' WHEN id % 16 = 11 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN trim(text) <> '' AND id % 16 NOT IN (3, 7, 11) THEN CAST('0x' || substr(sha256(CAST(id AS STRING)), 3, 2) AS BIGINT) END AS second FROM {v_turns}""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through the batch embedder, one at a time; the texts are their ids, and some of them fail."""

    def embedder(texts):
        left = int(texts[0]) % 16
        if left == 7:
            raise ConnectionError("away")
        if left == 11:
            raise ValueError("broken")
        return embedding.hash_embedder(32 if left == 3 else 64)(texts)

    rows = view(spark, sf_dir, "v_turns").select(F.col("id").alias("timeline_id"), F.when(F.trim("text") == "", "").otherwise(F.col("id").cast("string")).alias("text"))
    out = embedding.embed(rows, embedder, dim=64, batch=1)
    return out.select("timeline_id", "status", F.round(F.col("embedding")[1] * 255).cast("long").alias("second"))


# Composite indexing

INDEXED = "NOT (path LIKE '%node_modules/%' OR path LIKE 'data/%' OR path LIKE '%.png' OR length = 0 OR length > 1000000)"
NOW_INDEXED, OLD_INDEXED = (f"(SELECT * FROM {{{v}}} WHERE {INDEXED})" for v in ("v_files", "v_files_prev"))


@register(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id, stable_hash ORDER BY file_path, line_start, line_end) AS k FROM {lines(NOW_INDEXED, 50, 100)} WHERE CAST(substr(project_id, 4) AS INT) % 2 = 0)
    SELECT project_id, file_path, line_start, line_end, stable_hash FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM {lines('{v_files_prev}', 50, 100)} o WHERE o.project_id = n.project_id AND o.stable_hash = n.stable_hash)""")
def backfill_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, none = files(spark, sf_dir), F.array().cast("array<string>")
    opted = F.when(F.substring("project_id", 4, 9).cast("int") % 2 == 0, "opted_in").otherwise("opted_out")
    opt_in = now.select("project_id").distinct().select("project_id", opted.alias("state"), none.alias("user_added_dirs"), none.alias("user_excluded_dirs"))
    return corpus.backfill_code(now, opt_in, corpus.chunk_windows(view(spark, sf_dir, "v_files_prev"))).select("project_id", "file_path", "line_start", "line_end", "stable_hash")


REINDEXED = f"""o AS (SELECT project_id, file_path, line_start, line_end, stable_hash FROM {lines('{v_files_prev}', 50, 100)} WHERE (project_id, file_path) NOT IN (SELECT (project_id, path) FROM {{v_files}})),
    n AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path, stable_hash ORDER BY line_start DESC, line_end DESC) AS k FROM {lines(NOW_INDEXED, 50, 100)})"""


@register(f"WITH {REINDEXED} SELECT * FROM o UNION ALL SELECT project_id, file_path, line_start, line_end, stable_hash FROM n WHERE k = 1")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _ = corpus.reindex(files(spark, sf_dir), corpus.chunk_windows(view(spark, sf_dir, "v_files_prev")))
    return chunks.select("project_id", "file_path", "line_start", "line_end", "stable_hash")


@register("""SELECT project_id, path, md5(content) AS mark FROM {v_files_prev} WHERE doc_id % 11 <> 0 OR path LIKE 'gone/%' UNION ALL SELECT project_id, path, md5(content) FROM {v_files} WHERE doc_id % 11 = 0""")
def replace_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file is one chunk; those that differ from before are changed."""
    chunk = lambda v: view(spark, sf_dir, v).select("project_id", "path", F.md5(F.col("content").cast("binary")).alias("mark"), "doc_id")
    changed = chunk("v_files").filter("doc_id % 11 = 0")
    return corpus.replace_file_chunks(chunk("v_files_prev"), changed, changed).drop("doc_id")


@register(f"SELECT project_id, file_path, line_start, stable_hash FROM {lines('{v_files}', 8, 5)} WHERE substr(stable_hash, 1, 1) >= '8'")
def chunks_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.chunk_windows(files(spark, sf_dir), 8, 5)
    return corpus.chunks_without_vectors(chunks, chunks.filter("stable_hash < '8'").select("stable_hash").distinct()).select("project_id", "file_path", "line_start", "stable_hash")


@register(f"SELECT least(count(*), 10) AS chunks, least(count(*), 10) AS with_text, least(count(*), 10) AS with_vector FROM {lines('{v_files}', 8, 5)}")
def verify_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten chunks at random, all of which have text and a vector: the sampling is the feature."""
    chunks = corpus.chunk_windows(files(spark, sf_dir), 8, 5)
    return corpus.verify_sample(chunks, chunks.select("stable_hash")).agg(F.count("*").alias("chunks"), F.count_if("has_text").alias("with_text"), F.count_if("has_vector").alias("with_vector"))


@register(f"SELECT least(count(*), 10) AS chunks, least(count(*), 10) AS texts_right, least(count(*), 10) AS vectors_right FROM {lines('{v_files}', 8, 5)}")
def verify_sample_of_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten chunks at random, of which about half have a vector, and about half a text: what is said of each must hold."""
    chunks = corpus.chunk_windows(files(spark, sf_dir), 8, 5)
    blank = F.substring("stable_hash", 2, 1) < "8"
    sample = corpus.verify_sample(chunks.withColumn("text", F.when(~blank, F.col("text"))), chunks.filter("stable_hash < '8'").select("stable_hash"))
    right = [F.count_if(F.col("has_text") == ~blank).alias("texts_right"), F.count_if(F.col("has_vector") == (F.col("stable_hash") < "8")).alias("vectors_right")]
    return sample.agg(F.count("*").alias("chunks"), *right)


@register("""WITH t AS (SELECT project_id, path AS file_path, len(string_split(replace(content, '*/', ''), chr(10))) AS n FROM {v_files} WHERE path LIKE '%.ts')
    SELECT project_id, file_path, CAST(1 AS INT) AS line_start, CAST(5 AS INT) AS line_end, 'class' AS entity_kind, 'Shop' AS entity_name FROM t
    UNION ALL SELECT project_id, file_path, 2, 4, 'method', 'first' FROM t UNION ALL SELECT project_id, file_path, CAST(n + 8 AS INT), CAST(n + 8 AS INT), 'declaration', 'last' FROM t
    UNION ALL SELECT project_id, file_path, CAST(n + 9 AS INT), CAST(n + 11 AS INT), 'interface', 'Seen' FROM t""")
def chunk_entities_braced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TypeScript files with their texts in a comment between a class and other declarations."""
    body = F.concat(
        F.lit("export class Shop {\n  first() {\n    return 1\n  }\n}\n/*\n"), F.replace("content", F.lit("*/"), F.lit("")), F.lit("\n*/\nconst last = `${'{'}`\nexport interface Seen {\n  at: number\n}\n")
    )
    rows = files(spark, sf_dir).filter(F.endswith("path", F.lit(".ts"))).withColumn("content", body)
    return corpus.chunk_entities(rows).select("project_id", "file_path", "line_start", "line_end", "entity_kind", "entity_name")


@register("SELECT path, doc_id % 4 = 0 AS is_binary FROM {v_files}")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero byte at the start of one file in four, and at the end of another, beyond what is looked at."""
    i, zero, far = F.col("doc_id") % 4, F.lit("\x00"), F.repeat(F.lit("x"), 8192)
    text = F.when(i == 0, F.concat(zero, "content")).when(i == 1, F.concat(far, "content", zero)).otherwise(F.col("content"))
    return view(spark, sf_dir, "v_files").select("path", looks_binary(text.cast("binary")).alias("is_binary"))


SPACE = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '^{SPACE}+', ''), '{SPACE}+$', '')"


ORACLE["chunk_documents"] = with_views(f"""WITH cut AS (
      SELECT project_id, path, CAST(0 AS BIGINT) AS n, '' AS piece, {stripped('content')} AS rest FROM {{v_files}}
      UNION ALL
      SELECT project_id, path, n + 1, substr(rest, 1, k), substr(rest, k + 1) FROM (
        SELECT *, CASE WHEN length(rest) <= 2000 THEN length(rest)
            WHEN regexp_matches(substr(rest, 1902, 100), '{SPACE}') THEN 1901 + length(regexp_extract(substr(rest, 1902, 100), '(?s)^(.*){SPACE}', 1)) ELSE 2000 END AS k
        FROM cut WHERE rest <> '')),
    pieces AS (SELECT project_id, path, n, {stripped('piece')} AS text FROM cut WHERE n > 0)
    SELECT project_id, path, CAST(row_number() OVER (PARTITION BY project_id, path ORDER BY n) - 1 AS INT) AS chunk_idx, CAST(greatest(1, length(text) // 4) AS BIGINT) AS token_count, sha256(text) AS text_hash
    FROM pieces WHERE text <> ''""").replace("WITH ", "WITH RECURSIVE ", 1)


def _ingested() -> str:
    outer = with_views("""SELECT c.project_id, c.path, CASE WHEN p.content = c.content THEN 'skipped' ELSE 'ingested' END AS status,
        CAST(CASE WHEN p.content = c.content THEN 0 ELSE coalesce(t.tokens, 0) END AS BIGINT) AS token_count, CAST(CASE WHEN p.content = c.content THEN 0 ELSE coalesce(t.n, 0) END AS BIGINT) AS chunks
        FROM {v_files} c LEFT JOIN {v_files_prev} p USING (project_id, path) LEFT JOIN (SELECT project_id, path, sum(token_count) AS tokens, count(*) AS n FROM (CHUNKS) GROUP BY 1, 2) t USING (project_id, path)""")
    return outer.replace("CHUNKS", ORACLE["chunk_documents"])


@register(_ingested())
def ingest_corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its status, its tokens, and the chunks that it has in the chunk table."""
    known = corpus.content_hashes(view(spark, sf_dir, "v_files_prev")).select("project_id", "path", "sha1")
    rows, chunks = corpus.ingest_corpus(files(spark, sf_dir), known)
    counts = chunks.groupBy("project_id", "path").agg(F.count("*").alias("chunks"))
    return rows.join(counts, ["project_id", "path"], "left").select("project_id", "path", "status", "token_count", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@register(f"""WITH {SELECTED},
    l AS (SELECT project_id, path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM {{v_files}}),
    c AS (SELECT l.project_id, l.path, i, f.e, greatest(1, length(t) // 4) AS cost FROM l JOIN selected s ON s.project_id = l.project_id AND s.f.p = l.path),
    u AS (SELECT *, sum(cost) OVER (PARTITION BY project_id, path ORDER BY i) AS used FROM c),
    k AS (SELECT *, used <= e OR i = 0 AS kept FROM u)
    SELECT project_id, path, CAST(i AS INT) AS chunk_idx, truncated FROM (SELECT *, bool_or(NOT kept) OVER (PARTITION BY project_id, path) AS truncated FROM k) WHERE kept""")
def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a chunk, so that files are cut where their tokens end."""
    selected = packs.select_files(packs.rank_files(corpus_files(spark, sf_dir)))
    rows = files(spark, sf_dir).select("project_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("chunk_idx", "text"))
    return packs.pack_file_chunks(selected, rows.withColumn("token_count", tokens_min1(F.col("text")))).select("project_id", "path", "chunk_idx", "truncated")


@register("""WITH p AS (SELECT *, CASE WHEN path LIKE 'docs/%' THEN doc_id % 2 = 1 WHEN path LIKE '%.png' THEN NOT path LIKE 'src/%' ELSE false END AS gone FROM {v_files}) SELECT path FROM p WHERE NOT gone""")
def ignore_rules_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures go but for those of src, docs go, and those of even number are taken back, whatever they are."""
    rows = view(spark, sf_dir, "v_files")
    rules = [(1, "*.png"), (2, "!/src/*"), (3, "/docs/"), *((4 + n, f"!/docs/*{n}.*") for n in range(0, 10, 2))]
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("position"), F.lit(r).alias("rule")) for n, r in rules])).alias("r")
    return corpus.ignored_by_rules(rows, rows.select("project_id").distinct().select("project_id", listed).select("project_id", "r.*")).select("path")


@register("SELECT provider, count(*) AS pairs, true AS originals, true AS rewrites FROM {v_turns} GROUP BY provider")
def word_diff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a diff leaves and removes is the original text, what it leaves and adds the rewritten one."""
    pairs = view(spark, sf_dir, "v_turns").select("provider", F.coalesce("text", F.lit("")).alias("original"), F.concat(F.substring("text", 20, 200), F.lit(" end of "), F.substring("text", 1, 60)).alias("rewritten"))
    side = lambda kind: F.array_join(F.transform(F.filter("diff", lambda d: d["type"] != kind), lambda d: d["text"]), "")
    rows = signals.word_diff(pairs).select("provider", (side("added") == F.col("original")).alias("o"), (side("removed") == F.coalesce("rewritten", F.lit(""))).alias("r"))
    return rows.groupBy("provider").agg(F.count("*").alias("pairs"), F.bool_and("o").alias("originals"), F.bool_and("r").alias("rewrites"))


SEEN = "{{'t': {t}, 'id': {i}, 'recent': {r}, 'kept': {k}}}"
NO_IDS, NO_TEXTS = "CAST([] AS BIGINT[])", "CAST([] AS VARCHAR[])"

def fold(text: str, size: int) -> str:
    """SQL of rolling_dedup over turns whose text is this expression."""
    return f"""WITH o AS (SELECT session_id, list({{'t': {text}, 'id': id}} ORDER BY recorded_s, id) AS x FROM {{v_turns}} GROUP BY 1),
    r AS (SELECT list_reduce(list_prepend({SEEN.format(t="''", i='CAST(0 AS BIGINT)', r=NO_TEXTS, k=NO_IDS)}, list_transform(x, lambda i: {SEEN.format(t="i['t']", i="i['id']", r=NO_TEXTS, k=NO_IDS)})),
      lambda s, i: CASE WHEN i['t'] <> '' AND list_contains(s['recent'], i['t']) THEN s
        ELSE {SEEN.format(t="i['t']", i="i['id']", r=f"CASE WHEN i['t'] = '' THEN s['recent'] ELSE list_append(s['recent'], i['t'])[-{size}:] END", k="list_append(s['kept'], i['id'])")} END)['kept'] AS k FROM o)
    SELECT unnest(k) AS id FROM r"""


FOLD = fold("CASE WHEN char_count % 5 = 0 THEN '' ELSE CAST(char_count % 5 AS STRING) END", 3)
ORACLE["rolling_dedup"] = with_views(fold("coalesce(text, '')", 5))


def resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a few texts, so that most have been seen."""
    n = F.col("char_count") % 5
    return view(spark, sf_dir, "v_turns").select("session_id", F.when(n == 0, "").otherwise(n.cast("string")).alias("text"), "recorded_at", "id")


@register(FOLD)
def rolling_dedup_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rolling_dedup(resent(spark, sf_dir), "session_id", 3).select("id")


# Streams: a given table arrives as files, and what the job has put out when it has read all of them is the result.


#: Files of a batch of a stateful stream, each read by a task of its own.
FILES = 16


def arrivals(spark: SparkSession, rows: DataFrame, batches: int = 3, last: DataFrame | None = None) -> DataFrame:
    """rows as a stream of so many batches in no order of time; `last` comes after them and sets the watermark on. A batch is one
    file, or FILES where there is a `last`."""
    path, files = scratch(spark, "arrivals"), 1 if last is None else FILES
    rows.repartition(batches * files).write.parquet(path)
    if last is not None:
        last.select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    return jobs.with_schema(spark, path, rows.schema, files)


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that the stream appends, as a table."""
    path = scratch(spark, "stream")
    partitions = "spark.sql.shuffle.partitions"
    settings = {**jobs.SETTINGS, partitions: str(min(int(spark.conf.get(partitions)), jobs.PARTITIONS))}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(path)


def into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mutations").select("node", "ts_ms", F.col("chars_added"), "event_id", "event_type", "user_id")


#: Far after all events: a row of this time makes the watermark pass them, though files bring rows in any order.
LATER, LATE, NEVER = 4_102_444_800_000, "3650 days", 10**15


def later(rows: DataFrame, **values: Column) -> DataFrame:
    """One row with these values, none of which a result has."""
    return rows.limit(1).withColumns(values)


@register(turn_queries.ORACLE["debounce"])
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mutations(spark, sf_dir).select(F.lit("p").alias("project_id"), F.col("node").alias("path"), F.timestamp_millis("ts_ms").alias("ts"))
    last = later(rows, path=F.lit("last"), ts=F.timestamp_millis(F.lit(LATER)))
    out = drained(spark, jobs.debounce(arrivals(spark, rows, last=last), "6 hours", LATE))
    return out.select(F.col("path").alias("node"), F.unix_millis("first_event").alias("first_ms"), F.unix_millis("last_event").alias("last_ms"), "events")


@register(turn_queries.ORACLE["blackouts"])
def stream_blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mutations(spark, sf_dir).select(F.col("node").alias("host"), F.expr("CAST(ts_ms DIV 86400000 AS STRING)").alias("session"), F.timestamp_millis("ts_ms").alias("ts"), F.col("chars_added").alias("mutations"), (F.col("event_type") == "error").alias("detected"))
    last = later(rows, host=F.lit("last"), ts=F.timestamp_millis(F.lit(LATER)))
    return drained(spark, jobs.blackouts(arrivals(spark, rows, last=last), "25 hours", LATE, least_seconds=300, least_mutations=3))


@register(turn_queries.ORACLE["velocity"])
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mutations(spark, sf_dir)
    stream = arrivals(spark, rows, last=later(rows, node=F.lit("last"), ts_ms=F.lit(LATER)))
    return drained(spark, jobs.velocity(stream, 48 * HOURS, HOURS, 0.00004, 3, 1.0, LATE, NEVER))


@register(turn_queries.ORACLE["roots_diff"])
def stream_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = lambda n: F.concat(F.lit("file:///r"), (F.col("event_id") % n).cast("string"))
    rows = mutations(spark, sf_dir).select(F.col("user_id").alias("client_id"), F.col("event_id").alias("ts"), F.array(root(3), root(5), F.lit("https://x")).alias("roots"))
    last = later(rows, client_id=F.lit(-1).cast(rows.schema["client_id"].dataType), ts=F.lit(LATER))
    return drained(spark, jobs.roots(arrivals(spark, rows, last=last), LATE, NEVER))


@register(FOLD)
def stream_rolling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resent(spark, sf_dir)
    last = later(rows, session_id=F.lit("last"), recorded_at=F.timestamp_millis(F.lit(LATER)))
    return drained(spark, jobs.rolling_dedup(arrivals(spark, rows, last=last), "session_id", 3, LATE, NEVER)).select("id")


DETECTORS = {"aria_live": "a", "semantic_attr": "b", "velocity": "c", "structural": "d"}
LATEST = ", ".join(f"coalesce(last_value(CASE WHEN detector = '{d}' THEN confidence END IGNORE NULLS) OVER w, 0) AS {n}" for d, n in DETECTORS.items())


@register(f"""WITH e AS (SELECT node, ts_ms, {LATEST} FROM {{v_candidates}} WINDOW w AS (PARTITION BY node ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING))
    SELECT node, min(ts_ms) AS ts_ms FROM e WHERE round(greatest(1 - (1 - a) * (1 - b) * (1 - c) * (1 - d), a, b, c, d), 9) >= 0.7 GROUP BY node""")
def stream_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_candidates")
    stream = arrivals(spark, rows, last=later(rows, node=F.lit("last"), ts_ms=F.lit(LATER)))
    return drained(spark, jobs.vote(stream, 0.7, LATE, NEVER)).select("node", "ts_ms")


@register("""SELECT node, CASE WHEN user_id % 2 = 0 THEN ts + 300 ELSE ts + 1500 END AS completed_ms, CASE WHEN user_id % 2 = 0 THEN 'sse_interceptor' ELSE 'debounce' END AS source
    FROM (SELECT node, user_id, min(ts_ms) AS ts FROM {v_mutations} GROUP BY node, user_id)""")
def stream_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's first mutation, with an end of its stream at the same moment if its user is even; silence ends the others."""
    first = mutations(spark, sf_dir).groupBy("node", "user_id").agg(F.min("ts_ms").alias("ts_ms"))
    kinds = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("mutation"), F.lit("sse_end"))).otherwise(F.array(F.lit("mutation")))
    rows = first.select("node", F.timestamp_millis("ts_ms").alias("ts"), F.explode(kinds).alias("kind"), F.lit(1500).cast("long").alias("debounce_ms"))
    last = later(rows, node=F.lit("last"), ts=F.timestamp_millis(F.lit(LATER)), kind=F.lit("mutation"))
    return drained(spark, jobs.completion(arrivals(spark, rows, last=last), late=LATE))


@register("""WITH e AS (SELECT node || '-' || CAST(ts_ms // 86400000 AS VARCHAR) AS node, ts_ms, event_type FROM {v_mutations}),
    m AS (SELECT node, ts_ms, lead(ts_ms) OVER (PARTITION BY node ORDER BY ts_ms) AS nxt FROM e WHERE event_type <> 'error'),
    ends AS (SELECT node, ts_ms + 7200000 AS end_ms, 4 AS n FROM m WHERE nxt IS NULL OR nxt >= ts_ms + 7200000
        UNION ALL SELECT node, ts_ms + 300, 1 FROM e WHERE event_type = 'click' UNION ALL SELECT node, ts_ms + 300, 2 FROM e WHERE event_type = 'view'
        UNION ALL SELECT node, ts_ms, 3 FROM e WHERE event_type = 'error'),
    f AS (SELECT node, end_ms, n, row_number() OVER (PARTITION BY node ORDER BY end_ms, n) AS k FROM ends)
    SELECT node, end_ms AS completed_ms, CASE n WHEN 1 THEN 'sse_interceptor' WHEN 2 THEN 'stop_button' WHEN 3 THEN 'flatline' ELSE 'debounce' END AS source FROM f WHERE k = 1""")
def stream_completions_of_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's day ends by a click or a view, after settling, by an error at once, or two hours after its last other event;
    clicks and views are mutations, too, so that ends are put off and others come after the first."""
    node, kind = F.concat_ws("-", "node", F.expr("CAST(ts_ms DIV 86400000 AS STRING)")), F.col("event_type")
    kinds = F.when(kind == "click", F.array(F.lit("mutation"), F.lit("sse_end"))).when(kind == "view", F.array(F.lit("mutation"), F.lit("stop_gone"))).when(kind == "error", F.array(F.lit("flatline"))).otherwise(F.array(F.lit("mutation")))
    rows = mutations(spark, sf_dir).select(node.alias("node"), F.timestamp_millis("ts_ms").alias("ts"), F.explode(kinds).alias("kind"), F.lit(7_200_000).cast("long").alias("debounce_ms"))
    last = later(rows, node=F.lit("last"), ts=F.timestamp_millis(F.lit(LATER)), kind=F.lit("mutation"))
    return drained(spark, jobs.completion(arrivals(spark, rows, last=last), late=LATE))


class Stopped(RuntimeError):
    pass


def through_a_stop(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """The stream stops after the sink is done with batch 1 and before that is noted, so that the batch comes again."""

    def stops(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if number == 1:
            raise Stopped

    with contextlib.suppress(StreamingQueryException):
        into(stream, stops, checkpoint)
    into(stream, sink, checkpoint)


@register(turn_queries.ORACLE["upsert_turns"])
def stream_upsert_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "turns"), view(spark, sf_dir, "v_resends").drop("recorded_s", "recorded_at")
    stream = arrivals(spark, rows)
    through_a_stop(stream, jobs.upsert_turns_sink(spark, path, 8), f"{path}-checkpoint")
    return jobs.read_parts(spark, path, stream.schema)


@register("SELECT id AS timeline_id, CASE WHEN trim(text) = '' THEN 'blank' ELSE 'ok' END AS status FROM {v_turns}")
def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "vectors")
    through_a_stop(arrivals(spark, view(spark, sf_dir, "v_turns").select("id", "text")), jobs.embed_sink(path, embedding.hash_embedder(8), 8), f"{path}-checkpoint")
    return spark.read.parquet(f"{path}/results").select("timeline_id", "status")


@register("""WITH e AS (SELECT id, id % 4 AS batch, id % 16 // 4 AS fails FROM {v_turns} WHERE trim(text) <> '')
    SELECT id AS timeline_id, CAST(least(fails, 4 - batch, 3) AS INT) AS attempts, CASE fails WHEN 1 THEN '4 values' WHEN 2 THEN 'unavailable' ELSE 'broken' END AS last_error FROM e
    WHERE fails > 0 AND NOT (fails = 1 AND batch < 3) AND NOT (fails = 2 AND batch < 2)""")
def stream_embed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be embedded after four batches. Of sixteen ids four fail once, four twice and four always; a turn
    of an early batch is tried again with each later one, three times at most."""
    path, rows = scratch(spark, "attempts"), view(spark, sf_dir, "v_turns").filter("trim(text) != ''").select("id", F.col("id").cast("string").alias("text"))

    def embedder(number: int) -> embedding.Embedder:
        def of(texts: Sequence[str]) -> list[list[float]]:
            n = int(texts[0])
            fails, tries = n % 16 // 4, number - n % 4 + 1
            if fails == 1 and tries < 2:
                return [[0.5] * 4]
            if fails == 2 and tries < 3:
                raise ConnectionError("away")
            if fails == 3:
                raise ValueError("broken")
            return embedding.hash_embedder(8)(texts)

        return of

    for number in range(4):
        jobs.embed_sink(path, embedder(number), 8, batch=1)(rows.filter(F.col("id") % 4 == number), number)
    return jobs.read_embed_queue(spark, path).select("timeline_id", "attempts", "last_error")


@register(turn_queries.ORACLE["usage_stats"])
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's row is emitted at the first batch, and not again by the others, as it stays what it is."""
    path, turns, sessions = scratch(spark, "metrics"), view(spark, sf_dir, "v_turns"), view(spark, sf_dir, "v_sessions")
    sink = jobs.metrics_sink(lambda: turns, lambda: sessions, lambda row: row.write.mode("append").parquet(path))
    into(arrivals(spark, turns.select("id")), sink, f"{path}-checkpoint")
    return spark.read.parquet(path).select(rollups.usage_stats(turns, sessions).columns)


@register(turn_queries.ORACLE["usage_stats"])
def stream_live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row after turns have come in three batches, one of them twice, with sums alone kept between them."""
    path, turns, sessions = scratch(spark, "live"), view(spark, sf_dir, "v_turns"), view(spark, sf_dir, "v_sessions")
    shown: list[DataFrame] = []
    sink = jobs.live_metrics_sink(path, lambda: sessions, lambda row: shown.append(spark.createDataFrame(row.collect(), row.schema)), 4)
    through_a_stop(arrivals(spark, turns.drop("recorded_at")), sink, f"{path}-checkpoint")
    return shown[-1]


@register(f"""SELECT project_id, file_path, line_start, stable_hash FROM {lines('{v_files_prev}', 8, 5)} WHERE (project_id, file_path) NOT IN (SELECT (project_id, path) FROM {{v_files}} WHERE doc_id % 3 = 0)
    UNION ALL SELECT project_id, file_path, line_start, stable_hash FROM {lines('(SELECT * FROM {v_files} WHERE doc_id % 3 = 0)', 8, 5)}""")
def stream_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the snapshot before, after events of one file in three of the one now."""
    path, now = scratch(spark, "chunks"), view(spark, sf_dir, "v_files")
    old = corpus.chunk_windows(view(spark, sf_dir, "v_files_prev"), 8, 5).select("project_id", "file_path", "line_start", "stable_hash")
    jobs.replace_parts(spark, path, list(range(8)), jobs.with_part(old, ["project_id", "file_path"], 8))
    read = lambda files: now.join(files, ["project_id", "path"], "left_semi")
    sink = jobs.incremental_corpus_sink(read, lambda rows: corpus.chunk_windows(rows, 8, 5), path, old.schema, 8)
    through_a_stop(arrivals(spark, now.filter("doc_id % 3 = 0").select("project_id", "path"), 2), sink, f"{path}-checkpoint")
    return jobs.read_parts(spark, path, old.schema)
