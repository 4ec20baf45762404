"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Rows that are summed together.
BUCKET_ROWS = 5_000
#: Words of a packet: a longer document is served in so many at a time.
QUANTUM = 200
#: Bits of the shuffle key.
KEY_BITS = 60


def shuffle_key(doc_id: Column, seed: str = "") -> Column:
    """The document's place in its source's shuffled order: the first 60 bits of an MD5."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), text)), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target of every source in `sizes` (source, size); in every row besides the budget in whole
    words and all_rows, the number of rows.

    Sources by code point, null last, take the weights in turn. Each has its weight's part of `share` times all
    words, but `most` times its own at most; what is cut off goes to the others by weight. This level is found in
    closed form: by rising most * size / weight, a source is full if the level of those not yet full reaches it.
    All of this is over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everywhere = Window.partitionBy()
    full = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    full = full.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everywhere))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    full = full.withColumn("full", left * F.col("weight") >= F.col("cap") * F.sum("weight").over(after))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everywhere), F.lit(0.0))
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - spent) * F.col("weight") / open_weight)
    all_rows = F.sum("rows").over(everywhere)
    return full.select("source", "source_size", "rows", target.alias("target"), F.floor("budget").alias("budget"), all_rows.alias("all_rows"))


def words_before(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], words: str, out: str) -> DataFrame:
    """rows with `out`, the sum of `words` of the rows before each among those of equal keys, in the order (bucket, *order).

    Sums run within each bucket, then over the buckets, of which there is a row each; so no task has all rows of a key.
    """
    sums = rows.groupBy(*keys, "bucket").agg(F.sum(words).alias("_words"))
    buckets = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lift = F.coalesce(F.sum("_words").over(buckets), F.lit(0)).alias("_lift")
    lifts = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_bucket"), lift)
    within = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(words).over(within), F.lit(0)))
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("bucket") == F.col("_bucket"))
    return rows.join(lifts, same).withColumn(out, F.col(out) + F.col("_lift")).drop(*lifts.columns, "bucket")


def queue(documents: DataFrame, weights: Sequence[float], share: float, most: float, seed: str, bucket_rows: int, equal_rows_as_one: bool) -> DataFrame:
    """doc_id, text_hash, source, size, rows, and the source's columns and `start`, the words that its queue has before; saved.

    A source's queue is its documents in the order of shuffle_key. With equal_rows_as_one, rows of equal id, source and
    text are one entry of all their words; else each is an entry. Texts are read once, here.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", size.alias("size"))
    if equal_rows_as_one:
        sized = sized.groupBy("doc_id", "text_hash", "source").agg(F.sum("size").alias("size"))
    sized = saved(sized.withColumn("key", shuffle_key(F.col("doc_id"), seed)), "sizes")
    targets = saved(source_targets(sized, weights, share, most), "mix-targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    n_buckets = F.ceil(F.col("rows") / F.lit(bucket_rows)).cast("double")
    rows = rows.withColumn("bucket", F.floor(F.col("key") / F.lit(float(2**KEY_BITS)) * n_buckets))
    return saved(words_before(rows, ["source"], ["key", "doc_id", "text_hash"], "size", "start"), "queues")


def packets(queued: DataFrame, most: float, bucket_rows: int, quantum: int | None) -> DataFrame:
    """The packets of every queue with their virtual finish times, and `before`: the words of the packets that finish earlier.

    Every source is read over and over, as often as a document may be taken. A packet is `quantum` words of one pass of a
    document, or what is left of it; without a quantum, all of it. It finishes when its source, served at the rate of
    its target, has given all words through it: cumulative words divided by the target. All packets are sorted by that
    time, range by range (`bucket`): up to time 1 every range of equal width has about as many words.
    """
    parts = F.ceil(F.col("size") / F.lit(quantum)).cast("int") if quantum else F.lit(1)
    size = F.col("size") if quantum is None else F.least(F.lit(quantum), F.col("size") - F.col("part") * quantum)
    passes = F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))
    rows = queued.filter("size > 0").withColumn("pass", F.explode(passes)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("words", size.cast("long"))
    through = F.col("pass") * F.col("source_size") + F.col("start") + F.col("part") * F.lit(quantum or 0) + F.col("words")
    rows = rows.withColumn("virtual_finish", through / F.col("target"))
    ranges = F.ceil(F.col("all_rows") / F.lit(bucket_rows)).cast("double")
    rows = rows.withColumn("bucket", F.floor(F.col("virtual_finish") * ranges))
    order = ["virtual_finish", F.col("source").asc_nulls_last(), "start", "pass", "part"]
    return words_before(rows, [], order, "words", "before")


def mix_order(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: str = "", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text_hash, source, pass, virtual_finish of all whole documents of the mix, sorted by virtual_finish over all
    sources and cut where the next would go over the budget. A document's second copy comes a pass of its source later.

    Rows of equal id, source and text are one entry. Only ids and numbers are sorted, no texts.
    """
    items = packets(queue(documents, weights, share, most, seed, bucket_rows, equal_rows_as_one=True), most, bucket_rows, None)
    kept = items.filter(F.col("before") + F.col("words") <= F.col("budget"))
    return kept.select("doc_id", "text_hash", "source", "pass", "virtual_finish").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "doc_id")


def mix_sources(
    documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: str = "", bucket_rows: int = BUCKET_ROWS, quantum: int = QUANTUM
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken of every document.

    Every source is a queue of its shuffled documents, read again from the start up to `most` times. Packets of `quantum`
    words have virtual finish times: the source's words through them divided by its target. The packets of all sources
    are sorted by it and cut where the running total reaches the budget; the packet there gives the words up to it. So
    the mix has the budget to the word and each source its target to a packet. taken counts repeats.

    Null and wordless texts have size 0 and taken 0; a null source is a source; rows that repeat a doc_id are documents
    of their own. Running sums go over buckets of some `bucket_rows` rows, so that a source of any share of the rows is
    spread over tasks; texts are read once, and only ids and numbers are shuffled.
    """
    queued = queue(documents, weights, share, most, seed, bucket_rows, equal_rows_as_one=False)
    served = packets(queued, most, bucket_rows, quantum)
    served = served.withColumn("served", F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("before"))))
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    taken = served.groupBy(*columns, "start").agg(F.sum("served").cast("long").alias("taken")).drop("start")
    return taken.unionByName(queued.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def take_mix(documents: DataFrame, **options) -> DataFrame:
    """The documents of mix_order in whole copies: rows taken twice repeat, rows not taken are gone; the columns of documents.

    The mix is made of ids; whole rows are shuffled once, to meet how often they are taken. Nulls and repeated rows as
    in mix_order: rows of equal id, source and text are taken alike.
    """
    picks = mix_order(documents, **options).groupBy("doc_id", "text_hash", "source").agg(F.count("*").cast("int").alias("_copies"))
    picks = picks.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "source": "_source"}).hint("shuffle_hash")
    same = documents["doc_id"].eqNullSafe(picks["_id"]) & (F.xxhash64(documents["text"]) == picks["_hash"]) & documents["source"].eqNullSafe(picks["_source"])
    whole = F.struct(*[documents[f"`{c}`"].alias(c) for c in documents.columns])
    return documents.join(picks, same).select(F.explode(F.array_repeat(whole, picks["_copies"])).alias("d")).select("d.*")
