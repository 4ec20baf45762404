"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, saved
from .components import components

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of the whole text, A-Z lower-cased; of all its words if they are fewer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit hashes (n x k), k words whose bits are set in over half the rows; zeros for no rows.

    Bits are counted in bytes, by as many rows as a byte can count.
    """
    n, k = hashes.shape
    ones = np.zeros(64 * k, np.int64)
    for at in range(0, n, 255 * 32):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255 * 32]).view(np.uint8), bitorder="little").reshape(-1, 64 * k)
        rows = min(len(bits), 255)
        full = len(bits) // rows * rows
        ones += bits[:full].reshape(rows, -1).sum(axis=0, dtype=np.uint8).reshape(-1, 64 * k).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def simhash64(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit SimHash over all word shingles of the whole text; 0 if it has no word."""
    return int(majority_bits(shingle_hashes(text, shingle)[:, None])[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """The SimHash as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


# The anchors are the words of the perfect Hamming code on bits 0 to 62, with bit 63 free: every word of 64 bits is
# within 1 of exactly one of them. Bit i stands at place i + 1; a word's syndrome is the XOR of the places of its ones.
PLACES = range(1, 64)


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def syndrome(word: Column) -> Column:
    """By which place a word differs from its anchor; 0 if it is one."""
    checks = [sum(1 << (p - 1) for p in PLACES if p >> k & 1) for k in range(6)]
    total = F.lit(0)
    for k, check in enumerate(checks):
        total = total + F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(signed(check)))) % 2, k)
    return total


def anchor_masks(s: int) -> list[int]:
    """What to XOR a word of syndrome s with to reach each anchor within distance 2 of it."""
    place = lambda p: 1 << (p - 1)
    free = 1 << 63
    if s == 0:
        return [0, signed(free)]
    return [place(s), signed(place(s) | free)] + [place(i) | place(i ^ s) for i in PLACES if i < i ^ s]


def covering_links(words: DataFrame) -> DataFrame:
    """Links (a, b) that join all words of (fingerprint) at distance 2 or less, words being distinct.

    The code's covering radius is 1. Two words within the threshold of 2 have a middle within 1 of both, and the
    middle's anchor is within 1 of it, so both words are at distance 2 or less from that anchor: each is replicated to
    every anchor in this reach, 33 at most, which is covering radius plus half the threshold from either side, and
    meets all it can link to. There are 2081 words around an anchor, so that no group grows with the data.
    Per anchor, links that span its clusters are returned, not all pairs.
    """
    masks = F.array(*[F.array(*[F.lit(m) for m in anchor_masks(s)]) for s in range(64)])
    word = F.col("fingerprint")
    reach = F.transform(F.get(masks, syndrome(word)), lambda m: word.bitwiseXOR(m))
    copies = words.select(word, F.explode(reach).alias("anchor"))
    met = copies.groupBy("anchor").agg(F.collect_list("fingerprint").alias("met")).filter(F.size("met") > 1)
    near = spanning_links(F.col("met"))
    return met.select(F.explode(near).alias("l")).select(F.col("l.a").alias("a"), F.col("l.b").alias("b"))


def spanning_links(met: Column) -> Column:
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def links(groups: pd.Series) -> pd.Series:
        return pd.Series([cluster_links(np.asarray(g, np.int64)) for g in groups])

    return links(met)


def cluster_links(words: np.ndarray) -> list[dict[str, int]]:
    """Links between words at distance 2 or less that join what all such links join."""
    found, open_ = [], np.ones(len(words), bool)
    for start in range(len(words)):
        queue = [start] if open_[start] else []
        open_[start] = False
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(open_)
            close = rest[np.bitwise_count((words[rest] ^ words[at]).view(np.uint64)) <= 2]
            open_[close] = False
            queue += close.tolist()
            found += [{"a": int(words[at]), "b": int(words[i])} for i in close]
    return found


def near_duplicates(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents.

    Fingerprints at 2 or fewer differing bits are linked; component_id is the smallest doc_id that links reach. Equal
    fingerprints are one word of the search, so groups of copies of any size cost one word. Null and wordless texts
    have fingerprint zero, linked like any other. Null ids are never a component_id unless the component has none
    but nulls; repeated rows share their component.
    """
    prints = saved(bound_batches(documents).select("doc_id", fingerprint(F.col("text"), shingle).alias("fingerprint")), "fingerprints")
    words = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "words")
    roots = components(covering_links(words.select("fingerprint")))
    tops = words.join(roots, words["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    tops = saved(tops, "roots")
    least = saved(tops.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_print = saved(tops.join(least, "root").select("fingerprint", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(by_print, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """One document of each component: its row of smallest doc_id. Of rows that repeat this id, one stays.

    The columns are those of documents. Rows with a null id stay, as nothing can name them.
    """
    found = near_duplicates(documents, shingle)
    stays = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = documents.filter("doc_id is not null").join(stays, "doc_id", "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(documents.filter("doc_id is null"))
