"""Quality rules: counts of each text, and how many documents of a host share its lines."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, saved
from .line_dedup import text_lines, without_lines

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, counted from 0."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def repeated_words(words: list[bytes]) -> int:
    """Words in any window of eight that occurs twice or more. Windows are numbered exactly, by pairs of pairs of pairs."""
    if len(words) <= WINDOW or len(set(words)) == len(words):
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        ids = pair_ids(ids[:-step], ids[step:])
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(starts):
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and of each line with a word the halves of its 128-bit
    hash, its words and its place."""
    import xxhash

    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space only
    seen, duplicates, keys, more, sizes, places = set(), 0, [], [], [], []
    for place, line in enumerate(text.split("\n")):
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            duplicates += line in seen
            seen.add(line)
            first, second = struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(own).lower()))
            keys.append(first)
            more.append(second)
            sizes.append(len(own))
            places.append(place)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words), keys, more, sizes, places


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


LINES = ["keys", "more", "sizes", "places"]


def count_texts(documents: DataFrame, host: Column) -> DataFrame:
    """row (unique), doc_id, host, same (a hash of the text), COUNTS, LINES of every document; saved."""

    @F.pandas_udf(f"struct<{','.join(f'{c}:long' for c in COUNTS)},keys:array<long>,more:array<long>,sizes:array<int>,places:array<int>>")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=[*COUNTS, *LINES])

    rows = bound_batches(documents).select(F.monotonically_increasing_id().alias("row"), "doc_id", host.cast("string").alias("host"), F.xxhash64("text").alias("same"), counts("text").alias("c"))
    return saved(rows.select("row", "doc_id", "host", "same", "c.*"), "text-counts")


def common_lines(counts: DataFrame, least_docs: int, share: float, copies_count: bool = True) -> DataFrame:
    """(host, keys, more) of the lines that more documents of the host have than the limit.

    The limit is least_docs, or that share of the host's documents if it is more. Without copies_count, documents of
    equal texts count once.
    """
    own = "row" if copies_count else "same"
    each = counts.select("host", own, F.explode(F.array_distinct(F.arrays_zip("keys", "more"))).alias("k"))
    each = each if copies_count else each.distinct()
    found = each.groupBy("host", "k.keys", "k.more").agg(F.count("*").alias("docs")).filter(F.col("docs") > least_docs)
    if share > 0:
        docs = saved(counts.groupBy("host").agg(F.count_distinct(own).alias("n")).withColumnRenamed("host", "_host"), "host-documents")
        found = found.join(docs, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("docs") > F.lit(float(share)) * F.col("n"))
    return found.select("host", "keys", "more")


def removed_lines(counts: DataFrame, least_docs: int, share: float, copies_count: bool) -> DataFrame:
    """(row, n_removed_words, removed): the words of a row's common lines, and their places in the text."""
    shared = saved(common_lines(counts, least_docs, share, copies_count), "shared-lines").withColumnRenamed("host", "_host")
    lines = counts.select("row", "host", F.explode(F.arrays_zip(*LINES)).alias("l")).select("row", "host", "l.*")
    hits = lines.join(shared, F.col("host").eqNullSafe(F.col("_host")) & (lines["keys"] == shared["keys"]) & (lines["more"] == shared["more"]), "left_semi")
    return hits.groupBy("row").agg(F.sum("sizes").alias("n_removed_words"), F.collect_list("places").alias("removed"))


def judged(documents: DataFrame, host: str, least_docs: int, share: float, copies_count: bool, least_words: int, most_repeated: int, most_removed: float) -> DataFrame:
    counts = count_texts(documents, F.col(f"`{host}`"))
    rows = counts.drop(*LINES).join(removed_lines(counts, least_docs, share, copies_count), "row", "left")
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - gone
    kept = ~failed & (left >= least_words) & (gone <= F.lit(float(most_removed)) * F.col("n_words"))
    return rows.select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"), gone.alias("n_removed_words"), "host", "same", "removed")


def apply_quality_rules(
    documents: DataFrame, host: str = "source", least_docs: int = 10, share: float = 0.0, least_words: int = 20, most_repeated: int = 30, most_removed: float = 0.5, copies_count: bool = True
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words of every document.

    base_failed: fewer than least_words words, or over most_repeated percent of them in repeated windows. Of the
    others, lines (words lower-cased, spaces as one) that over least_docs distinct documents of the host share are
    removed; a document is kept if least_words words and most_removed of all words are left. With a share, the limit is
    that share of the host's documents, if it is more. Texts are read once, and never shuffled: only hashes and counts
    of lines are.

    A null text has no words. A null host is a host. Rows that repeat a doc_id are documents of their own, and so are
    rows of equal texts; without copies_count, these count as one document of their host.
    """
    return judged(documents, host, least_docs, share, copies_count, least_words, most_repeated, most_removed).drop("host", "same", "removed")


def clean_documents(
    documents: DataFrame, host: str = "source", least_docs: int = 10, share: float = 0.0, least_words: int = 20, most_repeated: int = 30, most_removed: float = 0.5, copies_count: bool = True
) -> DataFrame:
    """The documents that apply_quality_rules keeps, with their columns, the text being without the removed lines.

    Texts are shuffled once, to meet the places of their lines. Rows of equal id, host and text are treated alike.
    """
    rules = judged(documents, host, least_docs, share, copies_count, least_words, most_repeated, most_removed)
    kept = rules.filter("kept").groupBy("doc_id", "host", "same").agg(F.first("removed").alias("_at")).withColumnsRenamed({"doc_id": "_id", "host": "_host", "same": "_same"})
    of = documents[f"`{host}`"].cast("string")
    same = documents["doc_id"].eqNullSafe(kept["_id"]) & of.eqNullSafe(kept["_host"]) & (F.xxhash64(documents["text"]) == kept["_same"])
    whole = F.struct(*[documents[f"`{c}`"].alias(c) for c in documents.columns])
    rows = documents.join(kept, same).select(whole.alias("d"), text_lines(documents["text"]).alias("lines"), kept["_at"].alias("at"))
    text = without_lines(F.col("d.text"), F.col("lines"), F.col("at"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in documents.columns])
