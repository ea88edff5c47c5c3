"""Vector measures and exact neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import VectorIndexError
from ..sources.registry import VectorIndex

#: Numbers of a block of asked vectors and of a chunk of all vectors, at most, and rows of a block that is not divided further.
NUMBERS, LEAST = 2**22, 4096
#: Rows and columns of one matrix product.
ROWS, COLUMNS = 256, 4096


def check(index: VectorIndex | None, dimension: int) -> None:
    if index and index.dimension != dimension:
        raise VectorIndexError(f"the index on {index.key!r} has {index.dimension} dimensions, the query {dimension}")


def similarity(c: Column, query: list[float], metric: str = "cosine") -> Column:
    """Larger is nearer: the cosine (0 for a zero vector), 1 - distance, or the inner product; in double.

    A vector of another length than the query is an error.
    """
    q = F.array(*[F.lit(x) for x in query])
    pairs = F.zip_with(c.cast("array<double>"), q, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def total(f) -> Column:  # noqa: ANN001
        return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["a"], p["b"]))

    if metric == "euclidean":
        out = 1 - F.sqrt(total(lambda a, b: (a - b) * (a - b)))
    else:
        out = total(lambda a, b: a * b)
        if metric == "cosine":
            norm = F.sqrt(F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda s, a: s + a * a)) * F.lit(float(np.sqrt(sum(x * x for x in query))))
            out = F.when(norm == 0, 0.0).otherwise(out / norm)
    wrong = F.raise_error(F.concat(F.lit(f"a vector has another length than {len(query)}: "), F.size(c).cast("string")))
    return F.when(F.size(c) != len(query), wrong.cast("double")).otherwise(out)


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as a matrix in double; nulls in them are NaN."""
    c = c.combine_chunks()
    sizes = np.unique(c.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise VectorIndexError(f"vectors have the lengths {sizes[:5].tolist()}")
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), int(sizes[0]))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n != 0)


def _best(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k largest measures, rounded, and the rows of x they are of (-1: none), ties to smaller ones.

    ``own`` has the row of x that is left out for each of q, -1 for none.  Matrix products are of bounded size, and only
    what is above the k-th of the rows before is looked at: as rows come in order, equal ones later cannot win.
    """
    if metric == "cosine":
        q, x = _unit(q), _unit(x)
    squares = (x * x).sum(1) if metric == "euclidean" else None
    best, place = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    for i in range(0, len(q), ROWS):
        a, mine = q[i : i + ROWS], own[i : i + ROWS]
        top, where = best[i : i + ROWS], place[i : i + ROWS]
        for j in range(0, len(x), COLUMNS):
            s = a @ x[j : j + COLUMNS].T
            if squares is not None:
                s = 1 - np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + squares[j : j + COLUMNS] - 2 * s))
            here = np.flatnonzero((mine >= j) & (mine < j + s.shape[1]))
            s[here, mine[here] - j] = -np.inf
            # what rounds to more than the k-th so far
            low = top[:, -1] + 4.9e-13 - 1e-15 * np.where(np.isfinite(top[:, -1]), np.abs(top[:, -1]), 0)
            rows = np.flatnonzero(s.max(1) > low)
            if not len(rows):
                continue
            s, low = s[rows], low[rows]
            r, c = np.nonzero(s > low[:, None])
            if len(r) > 8 * k * len(rows) and k < s.shape[1]:
                kth = np.round(np.partition(s, -k, 1)[:, -k], 12)
                low = np.maximum(low, kth - 5.1e-13 - 1e-15 * np.where(np.isfinite(kth), np.abs(kth), 0))
                r, c = np.nonzero(s > low[:, None])
            every = np.concatenate([top[rows].ravel(), np.round(s[r, c], 12)])
            at = np.concatenate([where[rows].ravel(), c + j])
            r = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
            order = np.lexsort((-every, r))  # stable: equal ones stay in order
            n = np.arange(len(r)) - np.searchsorted(r[order], np.arange(len(rows)))[r[order]]
            order = order[n < k]
            top[rows], where[rows] = every[order].reshape(-1, k), at[order].reshape(-1, k)
    return best, place


def neighbors(asked: DataFrame, every: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(id, other, n): for each asked (id, x) the k others of largest measure, n from 1, ties to smaller ids.

    Blocks of asked rows meet chunks of all rows, both of bounded size; each task returns its k best.
    """
    n_asked, (n_every, size) = asked.count(), every.agg(F.count("*"), F.max(F.size("x"))).first()
    rows = max(1, NUMBERS // max(1, size or 1))
    blocks, chunks = max(1, -(-n_asked // rows)), max(1, -(-n_every // rows))
    while blocks * chunks < 2 * every.sparkSession.sparkContext.defaultParallelism and max(n_asked / blocks, n_every / chunks) > LEAST:
        blocks, chunks = (blocks + 1, chunks) if n_asked / blocks > n_every / chunks else (blocks, chunks + 1)

    def dealt(df: DataFrame, own: int, copies: int, mine: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        copied = df.select(F.col("id").alias("id"), F.col("x").alias("x"), place.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))
        return copied.repartition(blocks * chunks, "b", "c").groupBy("b", "c")

    left = dealt(asked, blocks, chunks, "b", "c")
    right = dealt(every, chunks, blocks, "c", "b")

    def solve(a: pa.Table, e: pa.Table) -> pa.Table:
        ids, others, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(a) and len(e):
            own, x_ids = a["id"].to_numpy(), e["id"].to_numpy()
            q, x = _matrix(a["x"]), _matrix(e["x"])
            if q.shape[1] != x.shape[1]:
                raise VectorIndexError(f"vectors have the lengths {sorted([q.shape[1], x.shape[1]])}")
            good = np.isfinite(q).all(1)
            own, q = own[good], q[good]
            order = np.argsort(x_ids, kind="stable")
            order = order[np.isfinite(x).all(1)[order]]
            x, x_ids = x[order], x_ids[order]
            if len(q) and len(x):
                at = np.minimum(np.searchsorted(x_ids, own), len(x_ids) - 1)
                best, place = _best(q, x, np.where(x_ids[at] == own, at, -1), k, metric)
                good = np.isfinite(best)
                ids, others, found = np.repeat(own, k)[good.ravel()], x_ids[place[good]], best[good]
        return pa.table([ids, others, found], ["id", "other", "s"])

    near = left.cogroup(right).applyInArrow(solve, "id long, other long, s double")
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))
    return near.withColumn("n", n).where(F.col("n") <= k).select("id", "other", "n")
