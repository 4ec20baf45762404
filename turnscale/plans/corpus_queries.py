"""Queries over source trees: decisions, diffs, chunks and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.functions.text import tokens_min1
from turnscale.operators import corpus, packs, rollups

from .views import view, with_views

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files").drop("doc_id")


@register("""SELECT project_id, path, indexed, reason FROM (SELECT project_id, path, reason IS NULL AS indexed, reason FROM (SELECT project_id, path,
    CASE WHEN path LIKE '%node_modules/%' THEN 'denylisted-dir:node_modules' WHEN path LIKE 'docs/%' AND project_id = 'src1' THEN 'user-excluded:docs'
      WHEN path LIKE 'data/%' AND project_id <> 'src2' THEN 'secondary-skip:data' WHEN path LIKE '%.png' THEN 'deny-extension:.png'
      WHEN length = 0 THEN 'empty-file' WHEN length > 1000000 THEN 'too-large:' || CAST(length AS STRING) WHEN regexp_matches(path, '^lib/core/[^/]*[.]ts$') OR regexp_matches(path, '(^|/)f1[^/][.]py$') THEN 'gitignore' END AS reason FROM {v_files}))""")
def index_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    projects = rows.select("project_id").distinct()
    none = F.array().cast("array<string>")
    opt_in = projects.select(
        "project_id", F.when(F.col("project_id") == "src2", F.array(F.lit("data"))).otherwise(none).alias("user_added_dirs"), F.when(F.col("project_id") == "src1", F.array(F.lit("docs"))).otherwise(none).alias("user_excluded_dirs")
    )
    rules = projects.select("project_id", F.explode(F.array(*[F.lit(r) for r in ("# built", "lib/core/*.ts", "f1?.py", "")])).alias("rule"))
    return corpus.decide_files(rows, opt_in, rules).select("project_id", "path", "indexed", "reason")


@register("SELECT path FROM {v_files} WHERE NOT (path LIKE 'docs/%' OR path LIKE '%.png')")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    rules = rows.select("project_id").distinct().select("project_id", F.explode(F.array(F.lit("/docs/"), F.lit("*.png"))).alias("rule"))
    return corpus.ignored_by_rules(rows, rules).select("path")


@register("SELECT project_id, count(*) AS files FROM {v_files} WHERE CAST(substr(project_id, 4) AS INT) % 3 = 0 GROUP BY project_id")
def gate_opted_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    n = F.substring("project_id", 4, 9).cast("int") % 3
    state = F.when(n == 0, "opted_in").when(n == 1, "pending").otherwise("opted_out")
    return corpus.gate_opted_in(rows, rows.select("project_id").distinct().select("project_id", state.alias("state"))).groupBy("project_id").agg(F.count("*").alias("files"))


@register("""SELECT project_id, path, CASE WHEN p.content IS NULL THEN 'new' WHEN c.content IS NULL THEN 'deleted' WHEN p.content = c.content THEN 'unchanged' ELSE 'modified' END AS change
    FROM {v_files} c FULL JOIN {v_files_prev} p USING (project_id, path)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.diff_snapshots(corpus.content_hashes(files(spark, sf_dir)), corpus.content_hashes(view(spark, sf_dir, "v_files_prev")))


#: SQL of a text's hash without its layout, and of its tokens as code.
STABLE_HASH = r"""sha256(regexp_replace(regexp_replace(regexp_replace(text, '[\t\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+(\n|$)', '\1', 'g'), '^\n+', ''), '\n+$', ''))"""
CODE_TOKENS = "CAST(greatest(1, floor(length(text) / 3.5)) AS BIGINT)"


def lines(source: str, small: int, window: int) -> str:
    """SQL of chunk_windows over a view of files."""
    return f"""(WITH l AS (SELECT project_id, path AS file_path, string_split(content, chr(10)) AS l FROM {source}),
      w AS (SELECT *, unnest(CASE WHEN len(l) <= {small} THEN [CAST(0 AS BIGINT)] ELSE range(0, len(l), {window}) END) AS s FROM l),
      c AS (SELECT project_id, file_path, s, CAST(s + 1 AS INT) AS line_start, CAST(CASE WHEN len(l) <= {small} THEN len(l) ELSE least(s + {window}, len(l)) END AS INT) AS line_end,
        array_to_string(CASE WHEN len(l) <= {small} THEN l ELSE l[s + 1 : s + {window}] END, chr(10)) AS text, len(l) <= {small} AS whole FROM w)
      SELECT *, {STABLE_HASH} AS stable_hash
      FROM c WHERE regexp_matches(text, '\\S'))"""


@register(f"""SELECT project_id, file_path, line_start, line_end, stable_hash, CASE WHEN whole THEN 'file' ELSE 'file_window' END AS entity_kind,
    CASE WHEN NOT whole THEN 'window_' || CAST(s // 5 AS STRING) END AS entity_name, {CODE_TOKENS} AS token_estimate FROM {lines('{v_files}', 8, 5)}""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.chunk_windows(files(spark, sf_dir), 8, 5)
    return rows.select("project_id", "file_path", "line_start", "line_end", "stable_hash", "entity_kind", "entity_name", "token_estimate")


@register(f"""WITH n AS (SELECT DISTINCT project_id, file_path, stable_hash, true AS n FROM {lines('{v_files}', 8, 5)}), o AS (SELECT DISTINCT project_id, file_path, stable_hash, true AS o FROM {lines('{v_files_prev}', 8, 5)})
    SELECT project_id, file_path, stable_hash, CASE WHEN o IS NULL THEN 'add' WHEN n IS NULL THEN 'remove' ELSE 'unchanged' END AS change FROM n FULL JOIN o USING (project_id, file_path, stable_hash)""")
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.diff_chunks(corpus.chunk_windows(files(spark, sf_dir), 8, 5), corpus.chunk_windows(view(spark, sf_dir, "v_files_prev"), 8, 5))


@register(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id, stable_hash ORDER BY file_path, line_start, line_end) AS k FROM {lines('{v_files}', 8, 5)})
    SELECT project_id, file_path, line_start, stable_hash FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM {lines('{v_files_prev}', 8, 5)} o WHERE o.project_id = n.project_id AND o.stable_hash = n.stable_hash)""")
def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.skip_known_hashes(corpus.chunk_windows(files(spark, sf_dir), 8, 5), corpus.chunk_windows(view(spark, sf_dir, "v_files_prev"), 8, 5))
    return rows.select("project_id", "file_path", "line_start", "stable_hash")


@register()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_documents(files(spark, sf_dir)).select("project_id", "path", "chunk_idx", "token_count", F.sha2("text", 256).alias("text_hash"))


@register(f"""WITH b AS (SELECT project_id, path, regexp_replace(content, '[''\\\\]', '', 'g') AS t FROM {{v_files}}),
    bodies AS (SELECT project_id, path, 'import os' || chr(10) || chr(10) || 'def first():' || chr(10) || '    ''''''' || t || '''''''' || chr(10) || chr(10) || 'class Second:' || chr(10)
        || '    def third(self):' || chr(10) || '        return 1' || chr(10) AS content, CAST(length(t) - length(replace(t, chr(10), '')) AS INT) AS n FROM b),
    split AS (SELECT *, string_split(content, chr(10)) AS l FROM bodies WHERE path LIKE '%.py'),
    entities AS (SELECT project_id, path AS file_path, 3 AS line_start, 4 + n AS line_end, l, 'function' AS entity_kind, 'first' AS entity_name FROM split
      UNION ALL SELECT project_id, path, 6 + n, 8 + n, l, 'class', 'Second' FROM split UNION ALL SELECT project_id, path, 7 + n, 8 + n, l, 'method', 'third' FROM split),
    chunks AS (SELECT project_id, file_path, line_start, line_end, entity_kind, entity_name, array_to_string(l[line_start : line_end], chr(10)) AS text FROM entities)
    SELECT project_id, file_path, line_start, line_end, entity_kind, entity_name, {STABLE_HASH} AS stable_hash, {CODE_TOKENS} AS token_estimate FROM chunks
    UNION ALL SELECT project_id, file_path, line_start, line_end, CASE WHEN whole THEN 'file' ELSE 'file_window' END, CASE WHEN NOT whole THEN 'window_' || CAST(s // 100 AS STRING) END, stable_hash, {CODE_TOKENS}
    FROM {lines("(SELECT project_id, path, content FROM bodies WHERE path NOT LIKE '%.py')", 50, 100)}""")
def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stand in the body of a function, so that Python files have entities."""
    body = F.concat(F.lit("import os\n\ndef first():\n    '''"), F.regexp_replace("content", r"['\\]", ""), F.lit("'''\n\nclass Second:\n    def third(self):\n        return 1\n"))
    return corpus.chunk_entities(files(spark, sf_dir).withColumn("content", body)).select("project_id", "file_path", "line_start", "line_end", "entity_kind", "entity_name", "stable_hash", "token_estimate")


INDEXED = "NOT regexp_matches(path, '(^|/)(node_modules|data)/|[.]png$') AND length BETWEEN 1 AND 1000000"


@register(f"""WITH diff AS (SELECT project_id, path, CASE WHEN p.content IS NULL THEN 'new' WHEN c.content IS NULL THEN 'deleted' WHEN p.content = c.content THEN 'unchanged' ELSE 'modified' END AS change
      FROM {{v_files}} c FULL JOIN {{v_files_prev}} p USING (project_id, path)),
    after AS (SELECT * FROM {{v_files}} WHERE {INDEXED} AND (project_id, path) IN (SELECT (project_id, path) FROM diff WHERE change <> 'unchanged')),
    before AS (SELECT * FROM {{v_files_prev}} WHERE {INDEXED} AND (project_id, path) IN (SELECT (project_id, path) FROM diff WHERE change <> 'unchanged')),
    n AS (SELECT DISTINCT project_id, file_path, stable_hash, true AS n FROM {lines('after', 50, 100)}), o AS (SELECT DISTINCT project_id, file_path, stable_hash, true AS o FROM {lines('before', 50, 100)}),
    chunks AS (SELECT project_id, count(*) FILTER (o IS NULL) AS chunks_added, count(*) FILTER (n IS NULL) AS chunks_removed, count(*) FILTER (n AND o) AS chunks_unchanged
      FROM n FULL JOIN o USING (project_id, file_path, stable_hash) GROUP BY project_id),
    files AS (SELECT project_id, count(*) FILTER (change = 'new') AS files_new, count(*) FILTER (change = 'modified') AS files_modified, count(*) FILTER (change = 'deleted') AS files_deleted,
      count(*) FILTER (change = 'unchanged') AS files_unchanged FROM diff GROUP BY project_id)
    SELECT project_id, files_new, files_modified, files_deleted, files_unchanged, coalesce(chunks_added, 0) AS chunks_added, coalesce(chunks_removed, 0) AS chunks_removed, coalesce(chunks_unchanged, 0) AS chunks_unchanged
    FROM files LEFT JOIN chunks USING (project_id)""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = view(spark, sf_dir, "v_files_prev").drop("doc_id")
    old = corpus.chunk_entities(corpus.decide_files(previous).filter("indexed").select(*previous.columns))
    return corpus.sweep(files(spark, sf_dir), previous, old)[1]


@register("""SELECT project_id, path, sha1(content) AS sha1, length AS size_bytes, CASE WHEN p.content = c.content THEN 'skipped' ELSE 'ingested' END AS status
    FROM {v_files} c LEFT JOIN {v_files_prev} p USING (project_id, path)""".replace("length AS", "c.length AS").replace("sha1(content)", "sha1(c.content)"))
def ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.content_hashes(view(spark, sf_dir, "v_files_prev")).select("project_id", "path", "sha1")
    return corpus.ingest_corpus(files(spark, sf_dir), known)[0].drop("token_count")


FILES = """SELECT project_id, path, sha1(content) AS sha1, CAST(greatest(1, length // 4) AS BIGINT) AS token_count FROM {v_files}"""


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.content_hashes(files(spark, sf_dir)).select("project_id", "path", "sha1", tokens_min1(F.col("content")).alias("token_count"))


@register(f"SELECT project_id, count(*) AS n_files, CAST(sum(token_count) AS BIGINT) AS n_tokens FROM ({FILES}) GROUP BY 1")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_rollup(corpus_files(spark, sf_dir))


def ranked(files: str) -> str:
    return f"""ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, is_docs ORDER BY token_count DESC, path) AS rank
    FROM (SELECT *, regexp_matches(lower(path), '[.](md|rst|txt)$') AS is_docs FROM ({files}))) WHERE rank <= CASE WHEN is_docs THEN 20 ELSE 40 END)"""


@register(f"WITH {ranked(FILES)} SELECT project_id, path, is_docs, rank FROM ranked")
def file_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.rank_files(corpus_files(spark, sf_dir)).select("project_id", "path", "is_docs", "rank")


def selected(files: str) -> str:
    return f"""{ranked(files)},
    items AS (SELECT project_id, list({{'d': is_docs, 'e': least(token_count, 1000), 'p': path}} ORDER BY NOT is_docs, rank) AS x FROM ranked GROUP BY 1),
    picked AS (SELECT project_id, list_reduce(list_prepend({{'docs': CAST(0 AS BIGINT), 'total': CAST(0 AS BIGINT), 'd': false, 'e': CAST(0 AS BIGINT), 'p': '', 'taken': CAST([] AS STRUCT(p STRING, e BIGINT)[])}},
        list_transform(x, lambda i: {{'docs': CAST(0 AS BIGINT), 'total': CAST(0 AS BIGINT), 'd': i['d'], 'e': i['e'], 'p': i['p'], 'taken': CAST([] AS STRUCT(p STRING, e BIGINT)[])}})),
        lambda s, i: CASE WHEN s['total'] + i['e'] <= 4000 AND (NOT i['d'] OR s['docs'] + i['e'] <= 1500)
          THEN {{'docs': s['docs'] + CASE WHEN i['d'] THEN i['e'] ELSE 0 END, 'total': s['total'] + i['e'], 'd': i['d'], 'e': i['e'], 'p': i['p'], 'taken': list_append(s['taken'], {{'p': i['p'], 'e': i['e']}})}} ELSE s END)['taken'] AS t FROM items),
    selected AS (SELECT project_id, unnest(range(len(t))) AS place, unnest(t) AS f FROM picked)"""


SELECTED = selected(FILES)


@register(f"WITH {SELECTED} SELECT project_id, CAST(place AS INT) AS place, f.p AS path, f.e AS eff FROM selected")
def pack_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.select_files(packs.rank_files(corpus_files(spark, sf_dir)))


@register(f"""WITH {SELECTED},
    parts AS (SELECT project_id, string_agg('<file path="' || f.p || '">' || chr(10) || content || chr(10) || '</file>' || chr(10), chr(10) ORDER BY place) AS body, count(*) AS files, CAST(sum(f.e) AS BIGINT) AS used,
        substr(sha256(project_id || string_agg(chr(10) || f.p || ':' || sha1(content), '' ORDER BY f.p)), 1, 16) AS block_hash
      FROM selected JOIN (SELECT project_id, path, content FROM {{v_files}}) v USING (project_id) WHERE v.path = f.p GROUP BY project_id),
    totals AS (SELECT project_id, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS t FROM ({FILES}) GROUP BY 1),
    blocks AS (SELECT project_id, block_hash, t, rtrim('# Project context: ' || project_id || chr(10) || '# Files included: ' || files || ' of ' || n || ' (~' || used || ' tokens)' || chr(10) || chr(10) || body, ' ' || chr(10)) || chr(10) AS b FROM parts JOIN totals USING (project_id))
    SELECT project_id, b AS block_text, block_hash, CAST(greatest(1, length(b) // 4) AS BIGINT) AS token_count, 300 AS expiry_hint_s, t AS raw_codebase_tokens FROM blocks
    UNION ALL SELECT project_id, '', 'empty', 0, 60, t FROM totals WHERE project_id NOT IN (SELECT project_id FROM parts)""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file is one chunk here, so that the pack can be told in SQL; tests cover files of many."""
    chunks = files(spark, sf_dir).select("project_id", "path", F.lit(0).alias("chunk_idx"), F.col("content").alias("text"), tokens_min1(F.col("content")).alias("token_count"))
    return packs.context_pack_files(corpus_files(spark, sf_dir), chunks)


@register(f"""WITH chunks AS (SELECT project_id, file_path AS path, line_start, stable_hash, text, {CODE_TOKENS} AS cost FROM {lines('{v_files}', 50, 100)}),
    {selected('SELECT project_id, path, CAST(sum(cost) AS BIGINT) AS token_count FROM chunks GROUP BY 1, 2')},
    summed AS (SELECT project_id, path, place, f.e AS eff, line_start, stable_hash, text, sum(cost) OVER (PARTITION BY project_id, path ORDER BY line_start) <= f.e OR row_number() OVER (PARTITION BY project_id, path ORDER BY line_start) = 1 AS kept
      FROM selected JOIN chunks USING (project_id) WHERE f.p = path),
    bodies AS (SELECT project_id, place, eff, '<file path="' || path || '">' || chr(10) || string_agg(text, chr(10) ORDER BY line_start) FILTER (kept)
        || CASE WHEN bool_and(kept) THEN '' ELSE chr(10) || '# ... (file truncated to fit context budget)' END || chr(10) || '</file>' || chr(10) AS part FROM summed GROUP BY project_id, place, path, eff),
    parts AS (SELECT project_id, string_agg(part, chr(10) ORDER BY place) AS body, count(*) AS files, CAST(sum(eff) AS BIGINT) AS used FROM bodies GROUP BY 1),
    marks AS (SELECT project_id, sha1(project_id || string_agg('|' || stable_hash, '' ORDER BY place, line_start)) AS block_hash FROM summed WHERE kept GROUP BY project_id),
    totals AS (SELECT project_id, count(DISTINCT path) AS n, CAST(sum(cost) AS BIGINT) AS t FROM chunks GROUP BY 1)
    SELECT project_id, rtrim('# Project context: ' || project_id || chr(10) || '# Files included: ' || files || ' of ' || n || ' (~' || used || ' tokens)' || chr(10) || chr(10) || body, ' ' || chr(10)) || chr(10) AS block_text,
      block_hash, used AS token_count, 3600 AS expiry_hint_s, t AS raw_codebase_tokens FROM parts JOIN marks USING (project_id) JOIN totals USING (project_id)
    UNION ALL SELECT project_id, '', 'empty', 0, 60, t FROM totals WHERE project_id NOT IN (SELECT project_id FROM parts)""")
def context_pack_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.context_pack_chunks(corpus.chunk_windows(files(spark, sf_dir)))


@register("SELECT project_id, path FROM {v_files_prev} WHERE (project_id, path) IN (SELECT (project_id, path) FROM {v_files})")
def purge_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = view(spark, sf_dir, "v_files_prev").drop("doc_id")
    diff = corpus.diff_snapshots(corpus.content_hashes(files(spark, sf_dir)), corpus.content_hashes(previous))
    return corpus.purge_missing_files(previous, diff).select("project_id", "path")
