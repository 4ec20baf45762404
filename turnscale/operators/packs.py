"""Context packs: the files of each project that fit a token budget, docs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscale.functions.text import SPACE_CLASS, tokens_min1

from .history import top_per_key

# Tokens of a pack, of its docs, of any one file; files looked at; suffixes of docs.
TOTAL, DOCS, PER_FILE = 4000, 1500, 1000
MOST_DOCS, MOST_OTHERS = 20, 40
DOC_SUFFIXES = (".md", ".rst", ".txt")
TRUNCATED = "# ... (file truncated to fit context budget)"


def is_docs(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(DOC_SUFFIXES[0]) | low.endswith(DOC_SUFFIXES[1]) | low.endswith(DOC_SUFFIXES[2])


def rank_files(files: DataFrame) -> DataFrame:
    """The largest docs and other files of each project, of (project_id, path, token_count): is_docs and rank."""
    ranked = top_per_key(files.withColumn("is_docs", is_docs(F.col("path"))), ["project_id", "is_docs"], [F.desc("token_count"), F.col("path")], MOST_OTHERS)
    return ranked.filter(~F.col("is_docs") | (F.col("rank") <= MOST_DOCS))


def select_files(ranked: DataFrame) -> DataFrame:
    """Files taken into each project's pack, with `place` (from 0) and `eff`, the tokens they may use.

    Docs come first and have a budget of their own within the total; a file that doesn't fit is passed over. A project
    has 60 ranked files at most.
    """
    eff = F.least("token_count", F.lit(PER_FILE)).cast("long")
    item = F.struct((~F.col("is_docs")).alias("o"), "rank", "path", eff.alias("eff"))
    groups = ranked.groupBy("project_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<path:string,eff:bigint>>").alias("taken"))

    def take(s: Column, x: Column) -> Column:
        fits = (s["total"] + x["eff"] <= TOTAL) & (x["o"] | (s["docs"] + x["eff"] <= DOCS))
        docs = F.when(x["o"], s["docs"]).otherwise(s["docs"] + x["eff"])
        taken = F.array_append(s["taken"], F.struct(x["path"].alias("path"), x["eff"].alias("eff")))
        return F.when(fits, F.struct(docs.alias("docs"), (s["total"] + x["eff"]).alias("total"), taken.alias("taken"))).otherwise(s)

    return groups.select("project_id", F.posexplode(F.aggregate("items", start, take)["taken"]).alias("place", "f")).select("project_id", "place", "f.path", "f.eff")


def pack_file_chunks(selected: DataFrame, chunks: DataFrame, order: str = "chunk_idx", tokens: str = "token_count") -> DataFrame:
    """The chunks of every selected file up to its tokens, the first in any case; `truncated` if some are left out.

    chunks: project_id, path, text and the named columns. Each chunk counts 1 token at least, so that what fits is a
    prefix and a running sum finds it.
    """
    rows = chunks.join(selected, ["project_id", "path"])
    one = Window.partitionBy("project_id", "path")
    cost = F.greatest(F.coalesce(F.col(tokens), F.lit(1)), F.lit(1))
    rows = rows.withColumn("used", F.sum(cost).over(one.orderBy(order))).withColumn("n", F.row_number().over(one.orderBy(order)))
    kept = (F.col("used") <= F.col("eff")) | (F.col("n") == 1)
    return rows.withColumn("kept", kept).withColumn("truncated", F.max(~kept).over(one)).filter("kept").drop("kept", "n")


def render_pack(packed: DataFrame, totals: DataFrame, order: str) -> DataFrame:
    """project_id, block_text, used tokens and number of files of each pack; totals: project_id, n_files, n_tokens."""
    text = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    files = packed.groupBy("project_id", "place", "path", "eff", "truncated").agg(F.array_join(text, "\n").alias("body"))
    part = F.concat(F.lit('<file path="'), F.col("path"), F.lit('">\n'), F.col("body"), F.when(F.col("truncated"), "\n" + TRUNCATED).otherwise(""), F.lit("\n</file>\n"))
    packs = files.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", part.alias("t")))), lambda x: x["t"]).alias("parts"), F.count("*").alias("files"), F.sum("eff").alias("used"))
    rows = packs.join(totals, "project_id")
    head = F.concat(F.lit("# Project context: "), F.col("project_id"), F.lit("\n# Files included: "), F.col("files"), F.lit(" of "), F.col("n_files"), F.lit(" (~"), F.col("used"), F.lit(" tokens)\n\n"))
    body = F.regexp_replace(F.concat(head, F.array_join("parts", "\n")), rf"[{SPACE_CLASS}]++\z", "")
    return rows.select("project_id", F.concat(body, F.lit("\n")).alias("block_text"), "files", "used", "n_files", "n_tokens")


def empty_packs(totals: DataFrame, packs: DataFrame) -> DataFrame:
    """The stub of projects of which nothing fits."""
    rest = totals.join(packs.select("project_id"), "project_id", "left_anti")
    zero = F.lit(0).cast("long")
    return rest.select("project_id", F.lit("").alias("block_text"), F.lit("empty").alias("block_hash"), zero.alias("token_count"), F.lit(60).alias("expiry_hint_s"), F.nullif(F.col("n_tokens"), zero).alias("raw_codebase_tokens"))


def context_pack_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A pack for each project with files (project_id, path, sha1, token_count) and chunks (.., chunk_idx, text, token_count).

    block_hash: the first 16 digits of the SHA-256 of the project and its selected paths and hashes, by path.
    """
    selected = select_files(rank_files(files))
    totals = files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.sum("token_count").cast("long").alias("n_tokens"))
    line = F.concat(F.lit("\n"), F.col("path"), F.lit(":"), F.col("sha1"))
    marks = selected.join(files.select("project_id", "path", "sha1"), ["project_id", "path"]).groupBy("project_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "").alias("marks")
    )
    packs = render_pack(pack_file_chunks(selected, chunks), totals, "chunk_idx").join(marks, "project_id")
    digest = F.substring(F.sha2(F.concat("project_id", "marks").cast("binary"), 256), 1, 16)
    out = packs.select("project_id", "block_text", digest.alias("block_hash"), tokens_min1(F.col("block_text")).alias("token_count"), F.lit(300).alias("expiry_hint_s"), F.col("n_tokens").alias("raw_codebase_tokens"))
    return out.unionByName(empty_packs(totals, out))


def context_pack_chunks(code_chunks: DataFrame) -> DataFrame:
    """A pack for each project from line chunks (project_id, file_path, line_start, stable_hash, text, token_estimate).

    block_hash: SHA-1 of the project and the hashes of the packed chunks, in order; token_count is what the files may use.
    """
    chunks = code_chunks.withColumnsRenamed({"file_path": "path", "token_estimate": "token_count"})
    files = chunks.groupBy("project_id", "path").agg(F.sum("token_count").cast("long").alias("token_count"))
    selected = select_files(rank_files(files))
    totals = files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.sum("token_count").cast("long").alias("n_tokens"))
    packed = pack_file_chunks(selected, chunks, "line_start")
    marks = packed.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "line_start", "stable_hash"))), lambda x: x["stable_hash"]).alias("marks"))
    packs = render_pack(packed, totals, "line_start").join(marks, "project_id")
    digest = F.sha1(F.concat_ws("|", F.col("project_id"), F.col("marks")).cast("binary"))
    out = packs.select("project_id", "block_text", digest.alias("block_hash"), F.col("used").alias("token_count"), F.lit(3600).alias("expiry_hint_s"), F.nullif(F.col("n_tokens"), F.lit(0)).alias("raw_codebase_tokens"))
    return out.unionByName(empty_packs(totals, out))


def context_packs(files: DataFrame, chunks: DataFrame, code_chunks: DataFrame) -> DataFrame:
    """Packs from files, and from line chunks for the projects that have no files."""
    rest = code_chunks.join(files.select("project_id").distinct(), "project_id", "left_anti")
    return context_pack_files(files, chunks).unionByName(context_pack_chunks(rest))
