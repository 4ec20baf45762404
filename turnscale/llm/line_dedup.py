"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, ascii_lower, saved, scratch, wide_hash


def text_lines(text: Column) -> Column:
    """The \\n-split lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, least_chars: int) -> Column:
    """Two hashes of each line's key, which is the line without ASCII white space at its ends and with A-Z lower-cased;
    null for a key that is too short to be looked at."""

    def hashed(key: Column) -> Column:
        h1, h2 = wide_hash(key)
        return F.when(F.length(key) >= least_chars, F.struct(h1.alias("h1"), h2.alias("h2")))

    # One step each: an expression within a lambda is worked out again wherever it is named.
    trimmed = F.transform(text_lines(text), lambda line: F.btrim(line, F.lit(SPACES)))
    return F.transform(F.transform(trimmed, ascii_lower), hashed)


class LineRuns:
    """Sorted runs of (h1, h2, docs) in levels, and the keys known to be common, which no run counts any more.

    A new batch is anti-joined with the common keys, and what is left is counted and added as a run of level 0. When a
    level has `fanout` runs, they are merged into one of the next level, so a key is rewritten once a level and there are
    never more than fanout * log(batches) runs. A key that reaches least_docs in a run, new or merged, is a common one from
    then on. A run is complete before it is listed, and never changed: a lost executor's tasks can run again at any time.
    """

    SCHEMA = T.StructType([*[T.StructField(c, T.LongType()) for c in ("h1", "h2", "docs")], T.StructField("common", T.BooleanType())])

    def __init__(self, spark: SparkSession, path: str, least_docs: int, fanout: int = 4):
        self.spark, self.path, self.least_docs, self.fanout = spark, path, least_docs, fanout
        self.levels: list[list[str]] = []
        self.written: list[str] = []

    def _write(self, run: DataFrame) -> str:
        path = f"{self.path}/run-{len(self.written):05d}"
        run.withColumn("common", F.col("docs") >= self.least_docs).sortWithinPartitions("common", "h1", "h2").write.partitionBy("common").parquet(path)
        self.written.append(path)
        return path

    def _read(self, paths: list[str], common: bool) -> DataFrame:
        found = [self.spark.read.schema(self.SCHEMA).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, found).filter(F.col("common") == common).drop("common")

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("docs").cast("long").alias("docs"))

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The rows of (h1, h2, ...) whose key isn't known to be common."""
        return keys.join(self._read(self.written, True).select("h1", "h2").distinct(), ["h1", "h2"], "left_anti") if self.written else keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (h1, h2), a row for each document that has the key; compact the levels that are full."""
        run = self._write(self.unknown(keys).groupBy("h1", "h2").agg(F.count("*").alias("docs")))
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._write(self.merged(self._read(self.levels[level], False)))
            self.levels[level] = []

    def common(self) -> DataFrame:
        """(h1, h2) of the keys that are in least_docs documents of all batches together."""
        live = [p for level in self.levels for p in level]
        rest = self.merged(self._read(live, False)).filter(F.col("docs") >= self.least_docs)
        return rest.select("h1", "h2").unionByName(self._read(self.written, True).select("h1", "h2")).distinct()


def document_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2) of (keys): each key of a document once."""
    return lines.select(F.explode(F.array_compact(F.array_distinct("keys"))).alias("k")).select("k.h1", "k.h2")


def dedup_lines(documents: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = 6, fanout: int = 3, keep_first: bool = False, counts: bool = True) -> DataFrame:
    """Drop every line whose key is in at least `least_docs` documents, from every document.

    With keep_first, the document of smallest doc_id among those that have the key keeps its lines.

    The documents come in `batches` by hash. Each batch's keys are anti-joined with the keys that the runs know to be
    common; the rest are counted and added as a run, and full levels are compacted. As a line goes by the count over all
    documents, lines are dropped when the last batch is in: then the lines of all documents are joined with the common
    keys. Only hashes are shuffled for this, and the positions of dropped lines; texts are read twice and shuffled once,
    to meet their positions. Spark merges runs by a shuffle of their keys, of which every one is in a run once.

    Returns the documents' columns with the text replaced; with `counts`, n_lines and n_dropped after them (in place of
    columns of these names). A null or empty text is one empty line, and with least_chars 0 that line can be dropped, too; a null
    text stays null if nothing was dropped. Rows that repeat a doc_id are documents of their own; null ids are fine.
    """
    if batches < 1 or fanout < 2:
        raise ValueError("batches must be positive and fanout at least 2")
    spark = documents.sparkSession
    # Equal ids with equal texts drop equal lines, so this tells rows apart as far as it matters.
    row_key = F.xxhash64("doc_id", "text")
    keyed = documents.select(F.col("doc_id").alias("_id"), row_key.alias("_row"), line_hashes(F.col("text"), least_chars).alias("keys"))
    home = scratch(spark, "line-runs")
    keyed.withColumn("batch", F.pmod("_row", F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(f"{home}/arrivals")
    keyed = spark.read.schema(T.StructType([*keyed.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{home}/arrivals")
    runs = LineRuns(spark, home, least_docs, fanout)
    for n in range(batches):
        runs.add(document_keys(keyed.filter(F.col("batch") == n)))
    frequent = saved(runs.common(), "common-lines")
    places = keyed.select("_id", "_row", F.posexplode("keys").alias("at", "k")).select("_id", "_row", "at", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    hits = places.filter("h1 is not null").join(frequent, ["h1", "h2"])
    if keep_first:
        hits = saved(hits, "line-hits")
        first = hits.groupBy("h1", "h2").agg(F.min("_id").alias("_first"))
        hits = hits.join(first, ["h1", "h2"]).filter(~F.col("_id").eqNullSafe(F.col("_first")))
    dropped = hits.groupBy(F.xxhash64("_id", "_row").alias("_key"), "_row").agg(F.collect_set("at").alias("_at"))
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(whole.alias("d"), row_key.alias("_r"), F.xxhash64("doc_id", row_key).alias("_k"))
    rows = rows.join(dropped, (F.col("_k") == F.col("_key")) & (F.col("_r") == F.col("_row")), "left")
    # A column of its own, so that the text is split once and not for each line that stays.
    rows = rows.withColumn("_lines", text_lines(F.col("d.text")))
    text = without_lines(F.col("d.text"), F.col("_lines"), F.col("_at"))
    added = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_at"), F.lit(0)).cast("long")} if counts else {}
    columns = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in documents.columns if c not in added]
    return rows.select(*columns, *[v.alias(k) for k, v in added.items()])


def without_lines(text: Column, lines: Column, places: Column) -> Column:
    """The text without the lines at these places (from 0); the text itself where places is null. lines is a column."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.when(places.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def line_dedup_digest(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    rows = dedup_lines(documents.select("doc_id", "text"), **options)
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))
