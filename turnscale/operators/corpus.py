"""Source trees: which files to index, what changed, and their chunks."""

from __future__ import annotations

import ast

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscale.functions.filters import glob_to_regex, opted_in
from turnscale.functions.text import SPACE_CLASS, detect_language, file_name, file_suffix, looks_binary, stable_hash, strip, tokens_code, tokens_min1

from .entities import braced_entities

# Folders and files that are never indexed, folders that a project may add, and limits.
HARD_DENY = [
    "node_modules", ".pnpm", ".yarn", "bower_components", "venv", ".venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "site-packages",
    "target", "vendor", ".bundle", "Pods", ".gradle", "build", ".build", "dist", "out", ".next", ".nuxt", ".svelte-kit", ".astro", ".git", ".svn", ".hg",
    ".DS_Store", "Thumbs.db", ".vscode", ".idea", ".vs", ".ssh", ".aws", ".gcp", ".config", ".gnupg", ".kube", ".docker", "logs", "tmp", "temp",
    "checkpoints", "wandb", "mlruns", ".dvc",
]
DENY_EXTENSIONS = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".o", ".a", ".jar", ".war", ".ear", ".class", ".pyc", ".pyo", ".pyd",
    ".mp4", ".mov", ".avi", ".mkv", ".webm", ".mp3", ".wav", ".ogg", ".flac", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp", ".tiff", ".pdf", ".psd", ".ai", ".sketch",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".db", ".sqlite", ".sqlite3", ".duckdb", ".pt", ".pth", ".ckpt", ".safetensors", ".gguf", ".onnx",
]
DENY_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "composer.lock", "Cargo.lock", "Gemfile.lock"]
SECONDARY_SKIP = ["data", "datasets", "fixtures", "mocks", "docs/build", "site", "coverage", ".coverage", "storybook-static"]
MOST_BYTES = 1_000_000
CHUNK_CHARS, WALK_BACK = 2000, 100
SMALL_LINES, WINDOW_LINES = 50, 100


def index_decision(path: Column, size: Column, added: Column | None = None, excluded: Column | None = None, ignored: Column | None = None, binary: Column | None = None) -> Column:
    """struct(indexed, reason) of a relative path; the first rule that fails names the reason.

    Rules in order: outside the root, a denied folder (whatever its case), a folder the project excludes or that is skipped
    unless the project adds it (part by part), a denied name or extension, size, ignore rules, binary content.
    """
    none = F.array().cast("array<string>")
    added, excluded = (F.coalesce(x, none) if x is not None else none for x in (added, excluded))
    parts = F.split(path, "/")
    low = [d.lower() for d in HARD_DENY]
    denied = F.get(F.filter(parts, lambda p: F.lower(p).isin(low)), F.lit(0))
    skip = lambda p: p.isin(SECONDARY_SKIP) & ~F.array_contains(added, p)
    skipped = F.get(F.filter(parts, lambda p: F.array_contains(excluded, p) | skip(p)), F.lit(0))
    why_skipped = F.when(F.array_contains(excluded, skipped), F.concat(F.lit("user-excluded:"), skipped)).otherwise(F.concat(F.lit("secondary-skip:"), skipped))
    name, suffix = file_name(path), file_suffix(path)
    reason = (
        F.when(path.isNull() | path.startswith("/") | F.array_contains(parts, ".."), "outside-project-root")
        .when(denied.isNotNull(), F.concat(F.lit("denylisted-dir:"), denied))
        .when(skipped.isNotNull(), why_skipped)
        .when(name.isin(DENY_NAMES), F.concat(F.lit("deny-basename:"), name))
        .when(suffix.isin(DENY_EXTENSIONS), F.concat(F.lit("deny-extension:"), suffix))
        .when(size > MOST_BYTES, F.concat(F.lit("too-large:"), size.cast("string")))
        .when(size == 0, "empty-file")
    )
    reason = reason if ignored is None else reason.when(ignored, "gitignore")
    reason = reason if binary is None else reason.when(binary, "binary-content")
    return F.struct(reason.isNull().alias("indexed"), reason.alias("reason"))


def decide_files(files: DataFrame, opt_in: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """files (project_id, path, length, content) with `indexed` and `reason`.

    opt_in has user_added_dirs and user_excluded_dirs of a project_id, rules its ignore rules as in rule_patterns.
    """
    rows, added, excluded, ignored = files, None, None, None
    if opt_in is not None:
        rows = rows.join(opt_in.select("project_id", "user_added_dirs", "user_excluded_dirs"), "project_id", "left")
        added, excluded = F.col("user_added_dirs"), F.col("user_excluded_dirs")
    if rules is not None:
        rows = rows.join(rule_patterns(rules), "project_id", "left")
        ignored = last_rule_ignores(F.col("path"))
    content = F.col("content").cast("binary")
    decided = rows.withColumn("_d", index_decision(F.col("path"), F.col("length"), added, excluded, ignored, looks_binary(content)))
    return decided.select(*files.columns, "_d.indexed", "_d.reason")


def rule_patterns(rules: DataFrame) -> DataFrame:
    """(project_id, patterns): each project's ignore rules as structs (at, negated, pattern), in order; comments left out.

    rules: (project_id, rule) and, where the order counts, `position`. A rule that begins with ! takes files back that a
    rule before it ignores; without positions all such rules come last.
    """

    @F.pandas_udf("string")
    def pattern(rule: pd.Series) -> pd.Series:
        return rule.map(lambda r: glob_to_regex(r) if isinstance(r, str) else None)

    negated = F.startswith("rule", F.lit("!"))
    at = F.col("position").cast("long") if "position" in rules.columns else negated.cast("long")
    rows = rules.select("project_id", at.alias("at"), negated.alias("negated"), pattern(F.regexp_replace("rule", "^!", "")).alias("pattern")).filter("pattern is not null")
    return rows.groupBy("project_id").agg(F.sort_array(F.collect_set(F.struct("at", "negated", "pattern"))).alias("patterns"))


def last_rule_ignores(path: Column) -> Column:
    """Whether the last of the `patterns` that the path matches isn't one that takes it back."""
    rules = F.coalesce("patterns", F.array().cast("array<struct<at:bigint,negated:boolean,pattern:string>>"))
    return F.aggregate(rules, F.lit(False), lambda ignored, r: F.when(F.regexp_like(path, r["pattern"]), ~r["negated"]).otherwise(ignored))


def ignored_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files that the ignore rules of their project leave."""
    return files.join(rule_patterns(rules), "project_id", "left").filter(~last_rule_ignores(F.col("path"))).select(*files.columns)


def gate_opted_in(rows: DataFrame, opt_in: DataFrame) -> DataFrame:
    """Rows of projects that have opted in; a project that is missing there has not."""
    return rows.join(opt_in.filter(opted_in(F.col("state"))).select("project_id"), "project_id", "left_semi")


def refused_projects(rows: DataFrame, opt_in: DataFrame) -> DataFrame:
    return rows.select("project_id").distinct().join(opt_in.filter(opted_in(F.col("state"))), "project_id", "left_anti")


def content_hashes(files: DataFrame) -> DataFrame:
    content = F.col("content").cast("binary")
    return files.withColumns({"sha1": F.sha1(content), "content_hash": F.sha2(content, 256)})


def diff_snapshots(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(project_id, path, change) between two snapshots of (project_id, path, content_hash)."""
    new = current.select("project_id", "path", F.col("content_hash").alias("new"))
    old = previous.select("project_id", "path", F.col("content_hash").alias("old"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("new") != F.col("old"), "modified").otherwise("unchanged")
    return new.join(old, ["project_id", "path"], "full").select("project_id", "path", change.alias("change"))


def diff_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """(project_id, file_path, stable_hash, change) by hash within each file; equal hashes of a file are one, the last."""
    keys = ["project_id", "file_path", "stable_hash"]
    a, b = new.select(*keys).distinct().withColumn("n", F.lit(True)), old.select(*keys).distinct().withColumn("o", F.lit(True))
    change = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "remove").otherwise("unchanged")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def apply_chunk_diff(new: DataFrame, old: DataFrame, files: DataFrame) -> DataFrame:
    """The chunk table after the given files (project_id, file_path) were chunked again: their chunks are the new ones.

    Of a region of lines (and of a hash within a file) the last stays; chunks of other files are untouched. Line numbers
    are those of the new file, also where a chunk's text is the same.
    """
    keep = old.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")
    last = Window.partitionBy("project_id", "file_path", "stable_hash").orderBy(F.desc("line_start"), F.desc("line_end"))
    fresh = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return keep.unionByName(fresh.dropDuplicates(["project_id", "file_path", "line_start", "line_end"]))


def reindex_summary(file_diff: DataFrame, chunk_diff: DataFrame) -> DataFrame:
    """Per project: files new, modified, deleted, unchanged; chunks added, removed, unchanged."""
    files = file_diff.groupBy("project_id").agg(*[F.count_if(F.col("change") == c).alias(f"files_{c}") for c in ("new", "modified", "deleted", "unchanged")])
    chunks = chunk_diff.groupBy("project_id").agg(*[F.count_if(F.col("change") == c).alias(f"chunks_{n}") for c, n in (("add", "added"), ("remove", "removed"), ("unchanged", "unchanged"))])
    return files.join(chunks, "project_id", "left").na.fill(0)


def skip_known_hashes(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks whose hash their project doesn't have yet; of equal new ones the first by file and line."""
    first = Window.partitionBy("project_id", "stable_hash").orderBy("file_path", "line_start", "line_end")
    rows = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return rows.join(old.select("project_id", "stable_hash"), ["project_id", "stable_hash"], "left_anti").dropDuplicates(["project_id", "file_path", "line_start", "line_end"])


def cut_text(text: Column, chars: int = CHUNK_CHARS, back: int = WALK_BACK) -> Column:
    """Pieces of `chars` characters, cut at white space within the last `back` of each, or hard; stripped, none empty.

    A piece is what is left, or as many characters as stand before white space, or the full number of them.
    """
    piece = rf"(?s).{{1,{chars}}}\z|.{{{chars - back + 1},{chars}}}(?=[{SPACE_CLASS}])|.{{{chars}}}"
    pieces = F.transform(F.regexp_extract_all(strip(F.coalesce(text, F.lit(""))), F.lit(piece), F.lit(0)), strip)
    return F.filter(pieces, lambda p: p != "")


def chunk_documents(files: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """(project_id, path, chunk_idx, text, token_count): pieces of each file's content, from 0."""
    pieces = cut_text(F.col("content").cast("string"), chars)
    rows = files.select("project_id", "path", F.posexplode(pieces).alias("chunk_idx", "text"))
    return rows.withColumn("token_count", tokens_min1(F.col("text")))


def with_chunk_fields(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"language": detect_language(F.col("file_path")), "stable_hash": stable_hash(F.col("text")), "token_estimate": tokens_code(F.col("text"))})


def window_parts(lines: Column, small: int, window: int) -> Column:
    """Chunks of a file's lines: one if it has `small` or fewer, else one for each window; blank ones are left out."""
    n = F.size(lines)
    whole = n <= small
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(window)))
    size = F.when(whole, n).otherwise(F.lit(window))

    def part(s: Column, i: Column) -> Column:
        text, name = F.array_join(F.slice(lines, s + 1, size), "\n"), F.when(~whole, F.concat(F.lit("window_"), i.cast("string")))
        kind = F.when(whole, "file").otherwise("file_window")
        return F.struct((s + 1).alias("line_start"), F.least(s + size, n).alias("line_end"), text.alias("text"), kind.alias("entity_kind"), name.alias("entity_name"))

    return F.filter(F.transform(starts, part), lambda c: F.rlike(c["text"], F.lit(r"\S")))


def chunk_windows(files: DataFrame, small: int = SMALL_LINES, window: int = WINDOW_LINES) -> DataFrame:
    """Chunks of whole files of `small` lines or fewer, and of windows of other files; blank ones are left out."""
    lines = F.split(F.col("content").cast("string"), "\n", -1)
    rows = files.select("project_id", F.col("path").alias("file_path"), lines.alias("lines"))
    rows = rows.select("project_id", "file_path", F.explode(window_parts(F.col("lines"), small, window)).alias("c"))
    return with_chunk_fields(rows.select("project_id", "file_path", "c.*"))


def python_entities(source: str | None) -> list[tuple[str, str, int, int]] | None:
    """(kind, name, first line, last line) of top-level functions and classes, and of the methods of undecorated
    classes; null if it isn't Python or has none."""
    try:
        body = ast.parse(source or "").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    found = []
    for node in body:
        if type(node) not in kinds:
            continue
        marks = node.decorator_list
        found.append((kinds[type(node)], node.name, min([node.lineno, *(m.lineno for m in marks)]), node.end_lineno))
        if isinstance(node, ast.ClassDef) and not marks:
            found += [("method", m.name, min([m.lineno, *(x.lineno for x in m.decorator_list)]), m.end_lineno) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return found or None


#: Languages of which entities are read, and whether they have types.
BRACED = {"javascript": False, "typescript": True, "tsx": True}
ENTITY = pa.struct([("kind", pa.string()), ("name", pa.string()), ("first", pa.int32()), ("last", pa.int32())])


def source_entities(language: str | None, source: str | None) -> list[tuple[str, str | None, int, int]] | None:
    """(kind, name, first line, last line) of a source's entities; null where it has none or the language isn't read."""
    if language == "python":
        return python_entities(source)
    return braced_entities(source, BRACED[language]) if language in BRACED else None


def chunk_entities(files: DataFrame) -> DataFrame:
    """A chunk for each top-level function, class or other declaration, and each method, of Python, JavaScript and
    TypeScript files; windows for all that have none, or can't be read, and for other languages."""

    @F.arrow_udf("array<struct<kind:string,name:string,first:int,last:int>>")
    def entities(language: pa.Array, content: pa.Array) -> pa.Array:
        # One text at a time is a Python string; the others stay in Arrow.
        found = (source_entities(a.as_py(), b.as_py()) for a, b in zip(language, content, strict=True))
        return pa.array((None if e is None else [dict(zip(ENTITY.names, x, strict=True)) for x in e] for e in found), pa.list_(ENTITY))

    language, content = detect_language(F.col("path")), F.col("content").cast("string")
    read = F.when(language.isin("python", *BRACED), language)
    rows = files.select("project_id", F.col("path").alias("file_path"), content.alias("content"), read.alias("read"))
    # The entities are read once, for both kinds of files.
    rows = rows.withColumn("entities", entities("read", F.when(F.col("read").isNotNull(), F.col("content"))))
    rows = rows.select("project_id", "file_path", "entities", F.split("content", "\n", -1).alias("lines"))

    def part(e: Column) -> Column:
        text = F.array_join(F.slice("lines", e["first"], e["last"] - e["first"] + 1), "\n")
        return F.struct(e["first"].alias("line_start"), e["last"].alias("line_end"), text.alias("text"), e["kind"].alias("entity_kind"), e["name"].alias("entity_name"))

    parts = F.when(F.col("entities").isNotNull(), F.transform("entities", part)).otherwise(window_parts(F.col("lines"), SMALL_LINES, WINDOW_LINES))
    return with_chunk_fields(rows.select("project_id", "file_path", F.explode(parts).alias("c")).select("project_id", "file_path", "c.*"))


def ingest_corpus(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file rows, chunks) of the files that are new or changed against known (project_id, path, sha1).

    A file that isn't UTF-8 is 'failed', one without text has 0 tokens, others are 'ingested'; unchanged ones are 'skipped'.
    """
    hashed = content_hashes(files).join(known.select("project_id", "path", F.col("sha1").alias("_known")), ["project_id", "path"], "left")
    text = F.col("content").cast("string")
    status = F.when(F.col("_known") == F.col("sha1"), "skipped").when(~F.is_valid_utf8(text), "failed").otherwise("ingested")
    hashed = hashed.withColumn("status", status)
    chunks = chunk_documents(hashed.filter("status = 'ingested'"))
    tokens = chunks.groupBy("project_id", "path").agg(F.sum("token_count").cast("long").alias("token_count"))
    rows = hashed.select("project_id", "path", "sha1", F.col("length").alias("size_bytes"), "status").join(tokens, ["project_id", "path"], "left").na.fill(0, ["token_count"])
    return rows, chunks


def replace_file_chunks(chunks: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """The chunk table without the changed files' old chunks and with their new ones."""
    return chunks.join(changed.select("project_id", "path").distinct(), ["project_id", "path"], "left_anti").unionByName(fresh)


def backfill_code(files: DataFrame, opt_in: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks of all indexed files of projects that have opted in. Running it again adds nothing."""
    indexed = decide_files(gate_opted_in(files, opt_in), opt_in).filter("indexed")
    return skip_known_hashes(chunk_entities(indexed), existing)


def fresh_chunks(files: DataFrame) -> DataFrame:
    """The chunks of those files that must be indexed."""
    return chunk_entities(decide_files(files).filter("indexed").select(*files.columns))


def reindex(files: DataFrame, old_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk table, chunk diff) after these files changed; files that must not be indexed, or are empty, lose their chunks."""
    fresh = fresh_chunks(files)
    touched = files.select("project_id", F.col("path").alias("file_path"))
    before = old_chunks.join(touched.distinct(), ["project_id", "file_path"], "left_semi")
    return apply_chunk_diff(fresh, old_chunks, touched), diff_chunks(fresh, before)


def purge_missing_files(rows: DataFrame, diff: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a table without the files that a snapshot diff calls deleted."""
    gone = diff.filter("change = 'deleted'").select("project_id", F.col("path").alias(path))
    return rows.join(gone, ["project_id", path], "left_anti")


def sweep(current: DataFrame, previous: DataFrame, old_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk table, summary) of a new snapshot of files against the one before."""
    diff = diff_snapshots(content_hashes(current), content_hashes(previous))
    changed = current.join(diff.filter("change in ('new', 'modified')"), ["project_id", "path"], "left_semi")
    chunks, _ = reindex(changed, purge_missing_files(old_chunks, diff, "file_path"))
    # Old chunks can be a long plan: those of changed files and of files that are gone are taken from it together.
    touched = diff.filter("change != 'unchanged'").select("project_id", F.col("path").alias("file_path"))
    before = old_chunks.join(touched, ["project_id", "file_path"], "left_semi")
    return chunks, reindex_summary(diff, diff_chunks(fresh_chunks(changed), before))


def verify_sample(chunks: DataFrame, vectors: DataFrame, n: int = 10, seed: int = 7) -> DataFrame:
    """A random sample of n chunks, and whether each has text and a vector."""
    sample = chunks.orderBy(F.rand(seed)).limit(n)
    has = vectors.select("stable_hash").distinct().withColumn("v", F.lit(True))
    return sample.join(has, "stable_hash", "left").select("project_id", "file_path", "stable_hash", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), F.coalesce("v", F.lit(False)).alias("has_vector"))


def chunks_without_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("stable_hash"), "stable_hash", "left_anti")
