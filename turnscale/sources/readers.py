"""Sources: turns, source trees, price feeds, price tables, exchange rates and provider hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscale.functions.text import file_name, per_token_to_per_million

from . import schemas

# Suffixes that are read, folders and names that are not, largest file; providers by their slug; fallback rate.
SUFFIXES = [
    ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".md", ".mdx", ".rst", ".txt", ".rs", ".go", ".java", ".kt", ".rb", ".php", ".cs", ".swift",
    ".c", ".h", ".cc", ".cpp", ".hpp", ".html", ".css", ".scss", ".toml", ".yaml", ".yml", ".json", ".sql", ".sh", ".ps1",
]
SKIP_FOLDERS = [
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "out",
    "target", ".next", ".tox", ".cache", "coverage", ".idea", ".vscode",
]
SKIP_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock", "Gemfile.lock", "composer.lock"]
MOST_BYTES = 1_000_000
PROVIDERS = {
    "anthropic": "anthropic", "openai": "openai", "google": "google", "deepseek": "deepseek", "mistralai": "mistral", "meta-llama": "meta",
    "x-ai": "xai", "perplexity": "perplexity", "cohere": "cohere",
}
FALLBACK_RATE, FALLBACK_DATE = 1.36, "2026-06-13"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def with_turn_defaults(rows: DataFrame) -> DataFrame:
    """Absent flags are false, absent counts of characters those of the text."""
    flags = ["tokens_estimated", "injected", "cache_eligible", "cache_hit_estimated", "incomplete"]
    rows = rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    return rows.withColumn("char_count", F.coalesce("char_count", F.length("text").cast("long")))


def read_turns(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Turn requests of JSON lines, as a table or as a stream of the files that come."""
    reader = spark.readStream if streaming else spark.read
    return with_turn_defaults(reader.schema(schemas.TURN_REQUEST).json(path))


def read_source_tree(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """(project_id, path, length, content) of a folder's source files; path is relative.

    Folders, names, suffixes and sizes are decided before any content is read: the binary source prunes the column. A task
    lists many folders: unless told otherwise, Spark starts one for each.
    """
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)
    # The scheme may be written with one slash or three, so the root is found by its plain path.
    plain = root.split("://", 1)[-1].rstrip("/")
    start = F.instr(F.col("path"), F.lit(plain + "/"))
    rows = files.withColumn("path", F.substring(F.col("path"), start + len(plain) + 1, F.length("path")))
    suffix = F.regexp_extract(F.lower(file_name(F.col("path"))), r"[^.](\.[^.]+)$", 1)
    folders = F.filter(F.split("path", "/"), lambda p: p.isin(SKIP_FOLDERS))
    wanted = suffix.isin(SUFFIXES) & (F.size(folders) == 0) & ~file_name(F.col("path")).isin(SKIP_NAMES) & (F.col("length") <= MOST_BYTES)
    return rows.filter(wanted).select(F.lit(project_id).alias("project_id"), "path", "length", "content")


def parse_price_feed(texts: DataFrame, column: str = "value") -> DataFrame:
    """Prices of feeds, each a JSON list or an object whose `data` is one.

    Of ids slug/model with a known slug; input and output prices must be above 0, cache prices may be missing.
    """
    body = F.coalesce(F.get_json_object(column, "$.data"), F.col(column))
    rows = texts.select(F.explode(F.from_json(body, schemas.PRICE_FEED)).alias("e")).filter(F.contains("e.id", F.lit("/")))
    parts = F.split("e.id", "/", 2)
    known = F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair])
    price = lambda name: per_token_to_per_million(F.col(f"e.pricing.{name}"))
    rows = rows.select(
        F.try_element_at(known, parts[0]).alias("provider"), parts[1].alias("model"), price("prompt").alias("input_per_m"), price("completion").alias("output_per_m"),
        price("input_cache_write").alias("cache_write_per_m"), price("input_cache_read").alias("cache_read_per_m"),
    )
    return rows.filter("provider is not null and input_per_m is not null and output_per_m is not null")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path)


def read_price_feed(spark: SparkSession, path: str) -> DataFrame:
    return parse_price_feed(whole_text(spark, path))


def read_price_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(provider, model, rates) of a nested map of static prices."""
    rows = whole_text(spark, path).select(F.explode(F.from_json("value", schemas.PRICE_MATRIX)["providers"]).alias("provider", "models"))
    return rows.select("provider", F.explode("models").alias("model", "r")).select("provider", "model", "r.*")


def parse_fx(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row (rate, date, source): the latest observation; the fallback if it is missing or not above 0."""
    last = F.try_element_at(F.from_json(column, schemas.FX)["observations"], F.lit(-1))
    rows = texts.select(last["FXUSDCAD"]["v"].try_cast("double").alias("rate"), last["d"].alias("date"))
    best = rows.filter("rate > 0").agg(F.max_by("rate", "date").alias("rate"), F.max("date").alias("date"))
    there = F.col("rate").isNotNull()
    return best.select(
        F.coalesce("rate", F.lit(FALLBACK_RATE)).alias("rate"), F.when(there, F.col("date")).otherwise(FALLBACK_DATE).alias("date"), F.when(there, "observed").otherwise("fallback").alias("source")
    )


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    return parse_fx(whole_text(spark, path))


def read_provider_hints(spark: SparkSession, path: str) -> DataFrame:
    """(host, provider_id, url_session_pattern, path_filter, debounce_ms)."""
    rows = whole_text(spark, path).select(F.explode(F.from_json("value", schemas.HINTS)["providers"]).alias("host", "h"))
    return rows.select("host", "h.*")
