"""Product codes of vectors by k-means in integers, with adaptive distance bounds kept for every part (Drake and Hamerly)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, delete, saved_at

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are held to this, so that squared distances of parts of 2,048 components fit 64 bits.
MOST = 1 << 24
#: Nearest entries that a part keeps bounds of: at first, and at least.
FIRST_KEPT, LEAST_KEPT = 16, 4
#: Share of parts that may need all entries before more bounds are kept, and that may look deeper than what is kept.
MANY_FULL, FEW_DEEPER = 0.1, 0.02
#: What rounding of a distance can come to, as a share of it.
SLACK = 1e-9
#: Largest sum of squares that doubles hold exactly.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vectors: DataFrame, parts: int, scale: int, keep: list[str]) -> tuple[DataFrame, int]:
    """(keep columns, q: the integers of each usable vector, filled with zeros to the longest one's length), and that length.

    The length is a multiple of `parts`, and not 0. A component is floor(scale * x), held to MOST.
    """
    rows = vectors.filter(usable(F.col("embedding")))
    longest = rows.agg(F.max(F.size("embedding"))).head()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    zeros = F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.concat(F.transform("embedding", whole), zeros).alias("q")), width


@dataclass
class Bounds:
    """Of n vectors' parts (n x parts): the code, an upper bound of the distance to its entry, the nearest other entries
    (n x parts x b, id -1 for none) with lower bounds in rising order, and one lower bound for all entries besides."""

    code: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    def kept(self, b: int) -> Bounds:
        """The same with b nearest entries: the bound of the first one given up counts for all besides."""
        have = self.near.shape[2]
        if b < have:
            return Bounds(self.code, self.upper, self.near[:, :, :b], self.lower[:, :, :b], np.minimum(self.outer, self.lower[:, :, b]))
        more = ((0, 0), (0, 0), (0, b - have))
        return Bounds(self.code, self.upper, np.pad(self.near, more, constant_values=-1), np.pad(self.lower, more, constant_values=np.inf), self.outer)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers, pair by pair."""
    apart = x - entries
    return np.einsum("ij,ij->i", apart, apart)


def all_squares(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows to all entries by a product of doubles, and by how much they can be off: 0 if exact."""
    a, b = x.astype(np.float64), entries.astype(np.float64)
    xx, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    most = float(xx.max(initial=0) + bb.max(initial=0))
    return xx[:, None] + bb - 2 * (a @ b.T), 0.0 if 4 * most < EXACT else 4 * most * x.shape[1] * 2.0**-52


def nearest_of_all(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Code, upper bound, the b nearest others with lower bounds, and the bound beyond, by looking at every entry.

    Where rounding leaves several entries that can be the nearest, integers decide; ties go to the lower index.
    """
    n, k = len(x), len(entries)
    apart, off = all_squares(x, entries)
    code = apart.argmin(axis=1)
    if off:
        rows, found = np.nonzero(apart <= apart[np.arange(n), code][:, None] + 2 * off)
        code = least_of(n, rows, found, squares(x[rows], entries[found]))
    upper = np.sqrt(squares(x, entries[code])) * (1 + SLACK)
    lower = np.sqrt(np.maximum(apart - off, 0)) * (1 - SLACK)
    lower[np.arange(n), code] = np.inf
    near, bounds, outer = np.full((n, b), -1, np.int16), np.full((n, b), np.inf), np.full(n, np.inf)
    if k > 1:
        first = min(b + 1, k - 1)
        found = np.argpartition(lower, first - 1, axis=1)[:, :first]
        values = np.take_along_axis(lower, found, 1)
        order = np.argsort(values, axis=1, kind="stable")
        found, values = np.take_along_axis(found, order, 1), np.take_along_axis(values, order, 1)
        there = min(b, first)
        near[:, :there], bounds[:, :there] = found[:, :there], values[:, :there]
        if first > b:
            outer = values[:, b]
    return code, upper, near, bounds, outer


def least_of(n: int, rows: np.ndarray, found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The entry of the least value of each of n rows, ties to the lower index; every row has one."""
    order = np.lexsort((found, values, rows))
    first = np.searchsorted(rows[order], np.arange(n))
    return found[order][first]


def step(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Move the bounds of one part of n vectors with its entries, and find the nearest entry of those whose bounds don't tell;
    the arrays are changed. Returns how many kept entries each row looked at; b + 1 if all.

    An entry whose lower bound lies over the upper bound is farther than the present one. What is left is measured in integers.
    """
    n, b = near.shape
    needed = np.zeros(n, np.int16)
    there = near >= 0
    drift = np.where(there, moved[near], 0)
    held = np.where(there, lower, 0)
    lower[:] = np.where(there, held - drift - SLACK * (np.abs(held) + drift), np.inf)
    most, beyond = moved.max(initial=0), np.where(np.isinf(outer), 0, outer)
    outer[:] = np.where(np.isinf(outer), np.inf, beyond - most - SLACK * (np.abs(beyond) + most))
    upper[:] = (upper + moved[code]) * (1 + SLACK)
    least = np.minimum(lower.min(axis=1, initial=np.inf), outer)
    open_ = np.flatnonzero(upper >= least)
    own = squares(x[open_], entries[code[open_]])
    upper[open_] = np.sqrt(own) * (1 + SLACK)
    still = upper[open_] >= least[open_]
    open_, own = open_[still], own[still]
    whole = outer[open_] <= upper[open_]
    full, listed, own = open_[whole], open_[~whole], own[~whole]
    if len(full):
        code[full], upper[full], near[full], lower[full], outer[full] = nearest_of_all(x[full], entries, b)
        needed[full] = b + 1
    if len(listed):
        looked = lower[listed] <= upper[listed][:, None]
        needed[listed] = b - np.argmax(looked[:, ::-1], axis=1)
        rows, at = np.nonzero(looked)
        found = near[listed[rows], at]
        apart = squares(x[listed[rows]], entries[found])
        lower[listed[rows], at] = np.sqrt(apart) * (1 - SLACK)
        m = np.arange(len(listed))
        best = least_of(len(listed), np.concatenate([m, rows]), np.concatenate([code[listed], found]), np.concatenate([own, apart]))
        changed = best != code[listed]
        slot = (near[listed[changed]] == best[changed][:, None]).argmax(axis=1)
        at = listed[changed]
        near[at, slot], lower[at, slot] = code[at], np.sqrt(own[changed]) * (1 - SLACK)
        code[at] = best[changed]
        upper[at] = np.sqrt(squares(x[at], entries[code[at]])) * (1 + SLACK)
        order = np.argsort(lower[listed], axis=1, kind="stable")
        near[listed], lower[listed] = np.take_along_axis(near[listed], order, 1), np.take_along_axis(lower[listed], order, 1)
    return needed


# A row of the table between two rounds.
SHORTS, DOUBLES = T.ArrayType(T.ShortType()), T.ArrayType(T.DoubleType())
STATE = (
    T.StructType().add("code", SHORTS).add("before", SHORTS).add("upper", DOUBLES).add("near", SHORTS)
    .add("lower", T.ArrayType(T.FloatType())).add("outer", DOUBLES).add("needed", SHORTS).add("error", "long")
)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, have: int, b: int) -> DataFrame:
    """rows (others, q and the state, if moved isn't None) with the state after books (parts x k x d) have moved so far.

    have: the entries whose bounds the rows keep now; b: those they keep from now on.
    """
    parts, k, d = books.shape
    others = [f for f in rows.schema.fields if f.name not in STATE.names]
    schema = T.StructType([*others, *STATE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            get = lambda name, width, batch=batch: matrix(batch.column(name), width)
            q = get("q", parts * d).astype(np.int64).reshape(n, parts, d)
            if moved is None:
                state = Bounds(np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.full((n, parts, b), -1, np.int16), np.full((n, parts, b), np.inf), np.full((n, parts), np.inf))
            else:
                cube = lambda name: get(name, parts * have).reshape(n, parts, have)  # noqa: B023, E731
                state = Bounds(get("code", parts).astype(np.int64), get("upper", parts).copy(), cube("near").copy(), cube("lower").astype(np.float64), get("outer", parts).copy()).kept(b)
            before, needed, error = state.code.copy(), np.zeros((n, parts), np.int16), np.zeros(n, np.int64)
            for p in range(parts if n else 0):
                views = [np.ascontiguousarray(getattr(state, name)[:, p]) for name in ("code", "upper", "near", "lower", "outer")]
                if moved is None:
                    views = nearest_of_all(q[:, p], books[p], b)
                else:
                    needed[:, p] = step(q[:, p], books[p], moved[p], *views)
                for name, value in zip(("code", "upper", "near", "lower", "outer"), views, strict=True):
                    getattr(state, name)[:, p] = value
                error += squares(q[:, p], books[p][state.code[:, p]])
            down = state.lower.astype(np.float32)
            down = np.where(down > state.lower, np.nextafter(down, np.float32(-np.inf)), down)
            if moved is None:
                before[:] = -1
            columns = [lists(state.code.astype(np.int16)), lists(before.astype(np.int16)), lists(state.upper), lists(state.near.reshape(n, -1)), lists(down.reshape(n, -1)), lists(state.outer), lists(needed), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def changes(rows: DataFrame, parts: int, k: int, d: int) -> DataFrame:
    """(part, entry, place, total, n): what rows that have left an entry for another take from its sums and add to them.

    A task sends its own sums; n is counted at place 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * k, d), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            q = matrix(batch.column("q"), parts * d).reshape(-1, d).astype(np.int64)
            code, before = (matrix(batch.column(c), parts).astype(np.int64) for c in ("code", "before"))
            differ = (code != before).reshape(-1)
            for value, sign in ((code, 1), (before, -1)):
                chosen = differ & (value >= 0).reshape(-1)
                slots = (value + np.arange(parts) * k).reshape(-1)[chosen]
                order = np.argsort(slots, kind="stable")
                found, first = np.unique(slots[order], return_index=True)
                if len(found):
                    sums[found] += sign * np.add.reduceat(q[chosen][order], first, axis=0)
                counts += sign * np.bincount(slots, minlength=parts * k)
        slots = np.flatnonzero(sums.any(axis=1) | (counts != 0))
        at, place = np.repeat(slots, d), np.tile(np.arange(d), len(slots))
        n = np.where(place == 0, counts[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at // k, at % k, place, sums[slots].reshape(-1), n)], names=["part", "entry", "place", "total", "n"])

    moved = rows.select("q", "code", "before").mapInArrow(run, "part long, entry long, place long, total long, n long")
    return moved.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def kept_next(rows: DataFrame, b: int, k: int) -> int:
    """How many bounds to keep, by what the last round looked at: one row for each depth comes to the driver."""
    depth = F.explode("needed").alias("depth")
    found = {r[0]: r[1] for r in rows.select(depth).groupBy("depth").count().collect()}
    total = sum(found.values())
    if found.get(b + 1, 0) > MANY_FULL * total:
        return max(min(2 * b, k // 4), LEAST_KEPT)
    deeper, depth = 0, b
    while depth > LEAST_KEPT and (deeper + found.get(depth, 0)) <= FEW_DEEPER * total:
        deeper += found.get(depth, 0)
        depth -= 1
    return depth


def fit_codes(vectors: DataFrame, keep: list[str], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(keep columns, code array, error), and the codebooks (parts x entries x components), after `rounds` of k-means.

    Columns: vec_id and embedding; of these and others, keep says which the result has (none named code, error, q or as
    the state). The entries start as the parts of the first `entries` vectors by vec_id (nulls last, then by components).
    Rows without a usable vector are left out; shorter vectors count as ending in zeros; fewer vectors than entries make
    fewer entries; an empty table no rows. Between rounds rows keep their bounds in a table in the shared folder, which
    the next one replaces. The driver holds codebooks and their sums: parts x entries rows of components.
    """
    if not 0 < entries <= 32_767 or parts < 1:
        raise ValueError("parts and entries must be positive, entries at most 32,767")
    spark = vectors.sparkSession
    rows, width = quantised(bound_batches(vectors), parts, scale, list(dict.fromkeys([*keep, "vec_id"])))
    first = [r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    rows, d, k = rows.select(*[F.col(f"`{c}`") for c in keep], "q"), width // parts, len(first)
    books = np.array(first, np.int64).reshape(k, parts, d).transpose(1, 0, 2).copy()
    if not k:
        empty = rows.filter(F.lit(False)).withColumns({"code": F.array().cast("array<smallint>"), "error": F.lit(0).cast("long")})
        return empty.drop("q"), books
    sums, counts = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
    moved, old, b = None, None, min(FIRST_KEPT, max(k - 1, 1))
    have = b
    for n in range(rounds + 1):
        state, path = saved_at(assigned(rows, books, moved, have, b), "bounds")
        if old:
            delete(spark, old)
        rows, old, have = state, path, b
        if n == rounds:
            break
        for part, entry, place, total, count in changes(state, parts, k, d).collect():
            sums[part, entry, place] += total
            counts[part, entry] += count
        if moved is not None:
            b = kept_next(state, b, k)
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        moved = np.sqrt(np.array([squares(new[p], books[p]) for p in range(parts)])) * (1 + SLACK)
        books = new
    return rows.select(*[F.col(f"`{c}`") for c in keep], "code", "error"), books


def books_hash(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex, error, the error over equal labels, and the hash of the codebooks.

    Sums by label are made before they are joined, so that a label of most rows is one row there; null labels are equal.
    """
    coded, books = fit_codes(vectors, ["vec_id", "label"])
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    rows = coded.select("vec_id", "label", code.alias("code"), "error")
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))
