"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Bits of a substring; an index has a bucket for each of its values.
SUBSTRING = 8


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_rotation(sample: np.ndarray, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """A rotation (dimensions x bits) under which the signs of the unit vectors lose least: principal axes, then
    alternating between codes and the orthogonal matrix that best turns the axes onto them."""
    dims = sample.shape[1]
    start = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]
    if len(sample) < 2:
        return start
    axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dims, dims))[1][:, ::-1]
    projected, turn = sample @ axes, start
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return axes @ turn


def encode(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Sign bits of the rotated vectors, packed; the tail of the last byte is 0."""
    return np.packbits(unit @ rotation >= 0, axis=1)


def learn_radius(sample: np.ndarray, rotation: np.ndarray, k: int, queries: int = 400, recall: float = 0.99) -> int:
    """The Hamming radius that has this share of the k nearest of the first `queries` unit vectors of the sample.

    Nearest neighbours among more rows are nearer, and so are their codes, so that it is enough for all of them.
    """
    codes, some = encode(sample, rotation), sample[:queries]
    k = min(k, len(sample) - 1)
    if k < 1:
        return codes.shape[1] * SUBSTRING
    near = some @ sample.T
    near[np.arange(len(some)), np.arange(len(some))] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    apart = np.bitwise_count(codes[:queries, None] ^ codes[best]).sum(axis=2, dtype=np.int64)
    return int(np.quantile(apart, recall, method="higher"))


def probe_order(radius: int) -> np.ndarray:
    """All values of a substring at distance radius or less from 0."""
    flips = itertools.chain.from_iterable(itertools.combinations(range(SUBSTRING), r) for r in range(min(radius, SUBSTRING) + 1))
    return np.array([sum(1 << b for b in bits) for bits in flips], np.int64)


class MultiIndex:
    """An index for each substring of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, k], kind="stable") for k in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, k], np.arange(257)) for k, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes at distance radius or less, by pigeonhole: of m substrings, radius mod m + 1 differ in at
        most radius // m bits, or another differs in less; only such values are looked up."""
        m = self.codes.shape[1]
        near = np.zeros(len(self.codes), bool)
        for k in range(m):
            reach = radius // m - (k > radius % m)
            if reach < 0:
                continue
            values = code[k] ^ probe_order_cached(reach)
            order, starts = self.order[k], self.starts[k]
            for a, b in zip(starts[values].tolist(), starts[values + 1].tolist(), strict=True):
                near[order[a:b]] = True
        found = np.flatnonzero(near)
        distance = np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64)
        return found[distance <= radius]


_PROBES: dict[int, np.ndarray] = {}


def probe_order_cached(radius: int) -> np.ndarray:
    if radius not in _PROBES:
        _PROBES[radius] = probe_order(radius)
    return _PROBES[radius]


def scaled(vectors: list) -> np.ndarray:
    """Vectors by powers of two, so that the largest component of each lies between 0.5 and 1: a cosine is the same bit for
    bit, and no square under- or overflows."""
    x = np.array(vectors, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def block_nearest(queries: pd.DataFrame, rows: pd.DataFrame, rotation: np.ndarray, radius: int, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query of a block, by exact cosine over what the index retrieves."""
    out: list[pd.DataFrame] = []
    if len(queries) and len(rows):
        vectors, ids = scaled(rows["v"].tolist()), rows["vec_id"].to_numpy()
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        index = MultiIndex(encode(vectors / norms[:, None], rotation))
        asked = scaled(queries["v"].tolist())
        asked_norms = np.sqrt((asked * asked).sum(axis=1))
        codes = encode(asked / asked_norms[:, None], rotation)
        for n, query_id in enumerate(queries["vec_id"].tolist()):
            found = index.within(codes[n], radius)
            found = found[ids[found] != query_id]
            scores = (vectors[found] * asked[n]).sum(axis=1) / (norms[found] * asked_norms[n])
            best = np.lexsort((ids[found], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found][best], "score": scores[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search_blocks(queries: DataFrame, rows: DataFrame, n_rows: int, n_queries: int, rotation: np.ndarray, radius: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each block of rows for each query, then of all blocks."""
    row_blocks, query_blocks = max(1, math.ceil(n_rows / block)), max(1, math.ceil(n_queries / block))
    deal = lambda n: F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("q", deal(query_blocks)).withColumn("r", all_of(row_blocks))
    indexed = rows.withColumn("r", deal(row_blocks)).withColumn("q", all_of(query_blocks))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return block_nearest(left, right, rotation, radius, k)

    found = asked.groupBy("q", "r").cogroup(indexed.groupBy("q", "r")).applyInPandas(nearest, f"query_id {kind}, vec_id {kind}, score double")
    # Scores are finite, so that the greatest structs are the nearest, then the smallest ids.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    best = found.groupBy("query_id").agg(best.alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 5, radius_share: float | None = None, sample: int = 10_000, block: int = 16_384, vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row for which `queries` holds, by cosine.

    A rotation is learned on the `sample` vectors of least id hash; the signs of a rotated vector are its code, one bit
    per dimension, cut into bytes with an index each. A query retrieves every code within radius_share of all bits (by
    default within learn_radius of the sample) and its finds are ranked by the vectors in double precision. Rows and queries meet in blocks of `block`, each with an
    index of its own, so that no task holds more than a block of either. Queries that find fewer than k rows are asked
    again with the whole code as radius, so that all have k, or all other rows if there are fewer.

    The radius fits the vectors: clustered ones have their nearest within a few bits, and most codes are never looked at;
    nearly isotropic ones have them at a cosine of 0.4, where over a third of the bits differ. The recall is measured in
    the tests. Vectors that are null, zero, or hold null or non-finite
    components take no part, null ids neither. Vectors of different lengths have no cosine: each length is searched by
    itself, with a rotation of its own. Rows that repeat an id are candidates each, but not of queries of their id. Ties
    go to the smaller id.
    """
    rows = vectors.select("vec_id", F.col(f"`{vector}`").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = saved(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dims", F.size("v")), "vectors")
    sizes = rows.groupBy("dims").agg(F.count("*").alias("rows"), F.count_if("asked").alias("queries")).filter("queries > 0").orderBy("dims").collect()
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    found = [search_length(rows.filter(F.col("dims") == r["dims"]), r["dims"], r["rows"], r["queries"], k, radius_share, sample, block) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], schema)


def search_length(rows: DataFrame, dims: int, n_rows: int, n_queries: int, k: int, radius_share: float | None, sample: int, block: int) -> DataFrame:
    """nearest_neighbours of the `asked` of rows (vec_id, v, asked), all vectors having `dims` components."""
    learn = scaled([r[0] for r in rows.orderBy(F.xxhash64(F.lit("fit"), "vec_id"), "vec_id").select("v").limit(sample).collect()])
    learn /= np.linalg.norm(learn, axis=1, keepdims=True)
    rotation = fit_rotation(learn)
    radius = learn_radius(learn, rotation, k) if radius_share is None else round(radius_share * dims)
    asked = rows.filter("asked")
    search = lambda q, n, r: search_blocks(q.select("vec_id", "v"), rows.select("vec_id", "v"), n_rows, n, rotation, r, k, block)
    first = saved(search(asked, n_queries, radius), "nearest")
    full = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = saved(asked.join(full, "vec_id", "left_anti"), "short-queries")
    n_short = short.count()
    if n_short:
        again = saved(search(short, n_short, dims + SUBSTRING * 8), "nearest-again")
        first = first.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
