"""Groups of documents that are alike by their word shingles: SimHashes around anchors first, an exact pass for the rest.

Texts whose SimHashes meet around an anchor (simhash.covering_links) are candidates, and the exact similarity decides. But
at a similarity of 0.8 two SimHashes differ in some ten of 64 bits, which no covering code of a bearable fan-out reaches. So
an exact pass by prefix filtering takes what is left: two sets of a Jaccard similarity of t or more have one of their first
|s| - ceil(t |s|) + 1 members in common, whatever the order of all shingles is. Every text goes to a cell for each of its
first shingles, and texts that share a cell are candidates. No pair is missed. The order is by hash, with the shingles that
a sample of the texts has often at the end, so that few texts meet by a common phrase.

Candidates of a cell are paired with its least text first, those of a crowd with a few texts; after that only texts that
aren't yet in one group are paired, so that a group of any number of near copies costs a few pairs a text, not all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, delete_since, free_name, marked, saved, wide_hash
from .components import components
from .simhash import covering_links, majority_bits, shingle_hashes

#: Nodes of a cell that one task pairs with as many.
BLOCK = 1024
#: Texts of a cell from which on it is a crowd, and the texts that all of a crowd are paired with at first.
CROWD, HUBS = 32, 8
#: Texts of the sample, in how many of them a shingle is a common one, and how many common ones are taken at most.
SAMPLE, OFTEN, MOST_COMMON = 20_000, 8, 10_000
#: Longs of parity bits, where no other number is asked for; longs of the short bits that pairs of a cell are told apart by.
SKETCH, SHORT = 16, 4


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes as signed longs, in order."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def prefix(members: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first members of a set (in order), those of common last: as many as two sets of that similarity can't differ in."""
    if len(common):
        often = np.isin(members, common, assume_unique=True)
        members = np.concatenate([members[~often], members[often]])
    return members[: len(members) - math.ceil(similarity * len(members) - 1e-9) + 1]


def sketch_longs(size: int) -> int:
    """Longs of parity bits for a set of that size: a power of 2, SHORT at least, with two bits a member or more."""
    return max(SHORT, 1 << math.ceil(math.log2(max(32, size) / 32)))


def parity_bits(members: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Longs of bits; a bit tells whether an odd number of the members fall to it.

    A member of just one of two sets turns one bit, so their bits differ in as many places as the sets do, or fewer. The
    bits of half as many longs are the first half XOR the second.
    """
    places = (members.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * longs)
    odd = np.bincount(places.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The commonest shingles of a sample of SAMPLE texts or so, MOST_COMMON at most, in order; they go through the driver."""

    @F.pandas_udf("array<long>")
    def shingles(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in batch])

    one_in = texts.count() // SAMPLE + 1
    some = texts.filter(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(one_in)) == 0).dropDuplicates(["node"])
    found = some.select(F.explode(shingles("text")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    return np.array(sorted(r["s"] for r in found.orderBy(F.desc("n"), "s").limit(MOST_COMMON).select("s").collect()), np.int64)


def cells(firsts: DataFrame) -> DataFrame:
    """(cell, n, hub, node) of the cells in which n texts, two or more, meet; hub is the least of them.

    Cells of the same texts, told by 128 bits, are one.
    """
    members = firsts.select(F.explode("first").alias("cell"), "node", "size")
    again = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("y")]
    met = members.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("hub"), *again).filter("n > 1")
    met = saved(met.groupBy("n", "x", "y").agg(F.min("cell").alias("cell"), F.min("hub").alias("hub")).select("cell", "n", "hub"), "cells")
    return saved(members.join(met, "cell").select("cell", "n", "hub", "node", "size"), "members")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: every text with the hub of each of its cells, and with the HUBS texts of least hashes of its crowds."""
    one = members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    crowds = members.filter(F.col("n") > CROWD).select("cell", "node")
    least = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"] for k in range(HUBS)]
    hubs = crowds.groupBy("cell").agg(F.array_distinct(F.array(*least)).alias("hubs"))
    more = crowds.join(hubs, "cell").select("node", F.explode("hubs").alias("hub")).filter("node != hub")
    return one.unionByName(more.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")))


def cell_pairs(members: DataFrame, near: Callable[[str, str], Column], block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of all nodes of different roots that meet in a cell of (cell, node, root, ...) and are near.

    Each node is in a cell once; without a column root all nodes have their own. near gets the prefixes `l.` and `r.` of
    the two sides' columns. The nodes of a cell's commonest root aren't paired with each other, only with the others, so
    that a large group costs what it has to be compared with. Both kinds are cut into blocks of some `block` nodes by
    hash and joined block against block, so that no task has a whole large cell.
    """
    if "root" not in members.columns:
        members = members.withColumn("root", F.col("node"))
    by_root = members.groupBy("cell", "root").agg(F.count("*").alias("n"))
    met = by_root.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("own"), F.sum("n").alias("n")).filter("n > own")
    blocks = lambda n: F.ceil(n / block).cast("int")
    met = saved(met.select("cell", "most", blocks(F.col("own")).alias("inner"), blocks(F.col("n") - F.col("own")).alias("outer")), "open-cells")
    deal = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), n).cast("int")
    own = F.when(F.col("root") == F.col("most"), deal(F.col("inner"))).otherwise(F.col("inner") + deal(F.col("outer")))
    split = saved(members.join(met, "cell").withColumn("own", own), "open-members")
    left = split.withColumn("other", F.explode(F.sequence(F.greatest("own", "inner"), F.col("inner") + F.col("outer") - 1))).alias("l")
    right = split.filter("own >= inner").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own")))).alias("r")
    same = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.own") == F.col("r.other")) & (F.col("l.other") == F.col("r.own"))
    once = (F.col("l.node") < F.col("r.node")) | (F.col("l.own") < F.col("r.own"))
    both = left.join(right, same & once & (F.col("l.root") != F.col("r.root")) & near("l.", "r."))
    return both.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def prefix_table(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, size, first, bits, short, print) of each different text of (node, text): the number of its shingles, the first
    of them, their parity bits, SHORT longs of such, and their SimHash; saved."""
    common = common_shingles(texts, shingle)

    @F.pandas_udf("struct<size:int,first:array<long>,bits:array<long>,short:array<long>,print:long>")
    def of(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for text in batch:
            hashes = shingle_hashes(text, shingle)
            members = np.unique(hashes.view(np.int64))
            word = majority_bits(hashes[:, None]).view(np.int64)[0]
            bits = parity_bits(members, sketch_longs(len(members)))
            rows.append((len(members), prefix(members, common, similarity), bits, np.bitwise_xor.reduce(bits.reshape(-1, SHORT)), word))
        return pd.DataFrame(rows, columns=["size", "first", "bits", "short", "print"])

    each = texts.select("node", of("text").alias("p"))
    return saved(each.groupBy("node").agg(F.first("p").alias("p")).select("node", "p.*"), "prefixes")


def size_fits(x: str, y: str, similarity: float) -> Column:
    """Whether sets of these sizes can be so alike."""
    return F.least(x, y) >= F.lit(similarity - 1e-9) * F.greatest(x, y)


def most_differing(x: str, y: str, similarity: float) -> Column:
    """In how many members two sets of these sizes that are so alike differ at most."""
    return F.lit((1 - similarity) / (1 + similarity)) * (F.col(x) + F.col(y)) + 1e-6


def short_fits(x: str, y: str, similarity: float) -> Column:
    """Whether sets can be so alike by their sizes and short parity bits, of columns with these prefixes."""
    differing = sum((F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))) for k in range(SHORT)), F.lit(0))
    return size_fits(x + "size", y + "size", similarity) & (differing <= most_differing(x + "size", y + "size", similarity))


def plausible(pairs: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose numbers of shingles and parity bits let them be so alike; none that is gets lost."""
    left, right = (firsts.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
    xor = lambda x, y: x.bitwiseXOR(y)

    def level(mine: str, other: str) -> Column:
        """The bits, folded once if the other side has fewer; sizes that fit are never further apart."""
        half = (F.size(mine) / 2).cast("int")
        folded = F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), xor)
        return F.when(F.size(mine) > F.size(other), folded).otherwise(F.col(mine))

    differing = F.aggregate(F.zip_with(level("a_bits", "b_bits"), level("b_bits", "a_bits"), xor), F.lit(0), lambda s, x: s + F.bit_count(x))
    both = pairs.join(left, "a").join(right, "b").filter(size_fits("a_size", "b_size", similarity))
    return both.filter(differing <= most_differing("a_size", "b_size", similarity)).select("a", "b")


def print_pairs(firsts: DataFrame) -> DataFrame:
    """(a, b), a < b, of texts whose SimHashes meet around an anchor: the least text of every SimHash stands for it."""
    words = saved(firsts.groupBy("print").agg(F.min("node").alias("least")), "prints")
    copies = firsts.join(words, "print").filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = covering_links(words.select(F.col("print").alias("fingerprint")))
    ends = links.join(words.select(F.col("print").alias("a"), F.col("least").alias("x")), "a").join(words.select(F.col("print").alias("b"), F.col("least").alias("y")), "b")
    return copies.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have that Jaccard similarity, or more, on the sets of their shingles."""

    @F.pandas_udf("array<long>")
    def shingles(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in batch])

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: np.ndarray, q: np.ndarray) -> bool:
            common = len(np.intersect1d(p, q, assume_unique=True))
            return common >= similarity * (len(p) + len(q) - common)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = saved(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", shingles("text").alias("s")), "shingles")
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(alike("x", "y")).select("a", "b")


def similar_groups(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the texts of (node, text) that are alike to another, through any number of others.

    First the pairs of texts whose SimHashes meet, and of every text with the hubs of each of its cells, are checked. Then the pairs of every cell whose texts these links don't yet join.
    Tables on the way are deleted when the links are saved that they were made for.
    """
    spark, start = texts.sparkSession, marked()
    firsts = prefix_table(texts, shingle, similarity)
    members = cells(firsts)
    first = hub_pairs(members).unionByName(print_pairs(firsts)).distinct()
    tried = saved(plausible(first, firsts, similarity), "candidates")
    before = marked()
    alike = saved(similar_pairs(tried, texts, shingle, similarity), "alike")
    delete_since(spark, before, [alike])
    roots = components(alike)
    short = firsts.select("node", *[F.col("short")[k].alias(f"s{k}") for k in range(SHORT)])
    grouped = members.drop("hub", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(short, "node")
    before = marked()
    more = cell_pairs(saved(grouped, "grouped-members"), lambda x, y: short_fits(x, y, similarity)).join(tried, ["a", "b"], "left_anti")
    left = saved(plausible(more, firsts, similarity), "candidates-left")
    delete_since(spark, before, [left])
    more = saved(similar_pairs(left, texts, shingle, similarity), "alike-left")
    for c in "ab":  # links of what the first groups are
        more = more.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    tops = components(saved(more, "links-left"))
    merged = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    merged = merged.select("node", F.coalesce("top", "root").alias("root"))
    out = saved(merged.unionByName(tops.join(roots, "node", "left_anti")), "roots")
    delete_since(spark, start, [out])
    return out


def node(text: Column) -> Column:
    return F.xxhash64(text)


def second(text: Column) -> Column:
    return wide_hash(text)[1]


def clashes(documents: DataFrame) -> DataFrame:
    """(hash, first): hashes that different texts share, told by a second hash, of which `first` is the least; saved."""
    each = documents.select(node(F.col("text")).alias("hash"), second(F.col("text")).alias("other"))
    found = each.groupBy("hash").agg(F.min("other").alias("first"), F.max("other").alias("last"))
    return saved(found.filter("first != last").select("hash", "first"), "clashes")


def with_node(documents: DataFrame, shared: DataFrame, name: str) -> DataFrame:
    """documents with a node of their text: its hash, or, where it shares that with another text, the second hash.

    Two hashes together have 128 bits: of the texts of any corpus a few dozen share the first, and none both.
    """
    both = documents.withColumns({name: node(F.col("text")), f"{name}_other": second(F.col("text"))})
    if shared.isEmpty():
        return both.drop(f"{name}_other")
    marked = shared.withColumnsRenamed({"hash": f"{name}_hash", "first": f"{name}_first"})
    joined = both.join(marked, F.col(name) == F.col(f"{name}_hash"), "left")
    own = F.when(F.col(f"{name}_other") != F.col(f"{name}_first"), F.col(f"{name}_other")).otherwise(F.col(name))
    return joined.withColumn(name, own).drop(f"{name}_other", f"{name}_hash", f"{name}_first")


def near_copy_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, root): the group of every row of documents, by a hash of its text (see with_node).

    Equal texts are one node. Wordless texts are alike only if they are equal.
    """
    return grouped_rows(documents.select("doc_id", "text"), clashes(documents), shingle, similarity)


def grouped_rows(documents: DataFrame, shared: DataFrame, shingle: int, similarity: float) -> DataFrame:
    named = with_node(documents, shared, "text_hash")
    rows = named.select("doc_id", "text_hash")
    texts = bound_batches(named).select(F.col("text_hash").alias("node"), "text")
    wordy = texts.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    roots = similar_groups(wordy, shingle, similarity)
    return rows.join(roots, rows["text_hash"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))


def drop_near_copies(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with its columns; of rows that repeat it, one.

    Rows with a null id stay, as nothing can name them. Null texts are equal to each other.
    """
    named = documents.filter("doc_id is not null")
    shared = clashes(named)
    groups = saved(grouped_rows(named.select("doc_id", "text"), shared, shingle, similarity), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("f.*")
    counts = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    stays = saved(first.join(counts, ["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "stays")
    name = free_name(documents, "node")
    rows = with_node(named, shared, name)
    on = lambda s: (rows["doc_id"] == s["_id"]) & (rows[name] == s["_hash"])
    single, repeated = stays.filter("n = 1"), stays.filter("n > 1")
    once = rows.join(single, on(single), "left_semi").drop(name)
    again = rows.join(repeated, on(repeated), "left_semi").drop(name).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(documents.filter("doc_id is null"))
