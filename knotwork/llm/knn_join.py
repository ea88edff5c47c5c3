"""Exact top-k inner-product search as a Voronoi join.

Pivots, more of them for more data, cut the space into cells.  Every vector keeps its distance to its
own pivot.  The few vectors nearest to each pivot are summaries that go to all queries: the k-th best
score of a query among them is a score that it surely reaches.  Of a cell's queries only the smallest
such score, the farthest query and the range of norms are kept; they bound every inner product of these
queries with a vector from above, by the triangle inequality, by Cauchy-Schwarz and by the angles to the
pivots, and a vector goes only where the bound reaches that score.

Cells of queries that want much the same vectors are joined into groups, as long as a group's queries
make one block: a vector is sent once to a group, however many of its cells want it.  Where bounds rule
nothing out (vectors of all directions in many dimensions) the groups are as large as that, and the join
is a blocked scan with one copy of the vectors for each block of queries.  Within a group, blocks of
queries meet chunks of vectors of bounded size, so a cell with a third of all rows is many tasks; each
returns its k best.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, spool

K = 20
FACTOR = 64
#: Pivots at least and at most; between them, half the square root of the number of vectors.
PIVOTS = (16, 1024)
#: What sending a vector costs, in scores of one vector; decides the groups, never the result.
COPY = 300
#: Vectors in a chunk and queries in a block, about.
CHUNK = 4096
QUERIES = 4096
#: Queries scored at once, and pairs of a cell and a vector that are looked at at once.
ROWS = 256
PAIRS = 500_000

log = logging.getLogger(__name__)


def _matrix(column: pa.Array, dims: int, factor: int) -> np.ndarray:
    """floor(factor * x) of a column of lists, missing components at the end as 0."""
    out = np.zeros((len(column), dims))
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(dims) < sizes[:, None]] = np.floor(factor * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _packed(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of each query's k best identifiers, each with its largest score; ties to smaller ids; never its own id.

    ``top`` bounds the absolute components; it decides the arithmetic, which is always exact.
    """
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    # rows after the first of an identifier; where there are some, its larger score moves to the first
    first = np.flatnonzero(np.r_[True, x_ids[1:] != x_ids[:-1]]) if len(x) else np.zeros(0, np.int64)
    repeated = len(first) < len(x)
    ids_of = x_ids[first] if repeated else x_ids
    reach = q.shape[1] * top * top
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object
    if kind is object:
        q, x = q.astype(object), x.astype(object)
        for one, own in zip(q, q_ids, strict=True):
            s = [min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in x @ one]
            if repeated:
                s = [max(s[a:b]) for a, b in zip(first, [*first[1:], len(s)], strict=True)]
            at = sorted((i for i in range(len(s)) if ids_of[i] != own), key=lambda i: (-s[i], i))[:k]
            yield np.full(len(at), own), ids_of[at], np.array([s[i] for i in at], np.int64)
        return
    xt = np.ascontiguousarray(x.T.astype(kind))
    n = len(ids_of)
    last = np.arange(n - 1, -1, -1)
    none = np.iinfo(np.int64).min
    wide = reach * n >= 1 << 62
    for at in range(0, len(q), ROWS):
        ids = q_ids[at : at + ROWS]
        s = (q[at : at + ROWS].astype(kind) @ xt).astype(np.int64)
        if repeated:
            s = np.maximum.reduceat(s, first, axis=1)
        if wide:
            for row, own in zip(s, ids, strict=True):
                i = np.lexsort((ids_of, -row))
                i = i[ids_of[i] != own][:k]
                yield np.full(len(i), own), ids_of[i], row[i]
            continue
        key = s * n + last  # unique: score, then smaller id
        key[ids_of == ids[:, None]] = none
        m = min(k, n)
        i = np.argpartition(key, n - m, axis=1)[:, n - m :] if m < n else np.broadcast_to(np.arange(n), key.shape)
        good = np.take_along_axis(key, i, 1) != none
        yield np.repeat(ids, m)[good.ravel()], ids_of[i][good], np.take_along_axis(s, i, 1)[good]


class Bounds:
    """What the summaries say of cells' queries and vectors; a few numbers for each pair of pivots."""

    def __init__(self, pivots: np.ndarray, queries: dict[int, tuple[float, float, float, float, int]]) -> None:
        """queries: by cell the farthest query, smallest and largest squared norm, smallest sure score, number."""
        self.pivots = pivots
        self.ids = np.array(sorted(queries), np.int64)
        self.radius, self.low2, self.high2, self.theta, self.many = (np.array([queries[i][c] for i in self.ids.tolist()], float) for c in range(5))
        p = pivots[self.ids] if len(self.ids) else pivots[:0]
        norms = np.sqrt((pivots**2).sum(1))
        self.between = np.sqrt(np.maximum(0, ((p**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * p @ pivots.T)))
        self.inner, self.norms = p @ pivots.T, norms
        with np.errstate(divide="ignore", invalid="ignore"):
            own = norms[self.ids] if len(self.ids) else norms[:0]
            self.angle = np.nan_to_num(np.arccos(np.clip(self.inner / (own[:, None] * norms), -1, 1)), nan=math.pi / 2)
            # a query within radius of its pivot is within this angle of it
            self.turn = np.where(self.radius < own, np.arcsin(np.clip(self.radius / own, 0, 1)), math.pi)
        self.slack = 1e-6 * (1 + np.abs(self.inner).max(initial=0) + self.high2.max(initial=0))
        self.group_of = {int(c): i for i, c in enumerate(self.ids.tolist())}
        self.order, self.first = np.arange(len(self.ids)), np.arange(len(self.ids))

    def wanted(self, cell: np.ndarray, d: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """(cells with queries, vectors): whether a vector may be among the k best of a query of the cell."""
        step = max(1, PAIRS // max(1, len(self.ids)))
        parts = [self._wanted(cell[at : at + step], d[at : at + step], n2[at : at + step]) for at in range(0, len(cell), step)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(self.ids), 0), bool)

    def _wanted(self, cell: np.ndarray, d: np.ndarray, n2: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, self.between[:, cell] - self.radius[:, None] - d)
        high = np.sqrt(self.high2)[:, None]
        upper = np.minimum(0.5 * (self.high2[:, None] + n2 - gap**2), self.inner[:, cell] + self.radius[:, None] * self.norms[cell] + high * d)
        norm = np.sqrt(n2)
        with np.errstate(divide="ignore", invalid="ignore"):
            lean = np.nan_to_num(np.arccos(np.clip((n2 + self.norms[cell] ** 2 - d**2) / (2 * norm * self.norms[cell]), -1, 1)), nan=math.pi / 2)
        apart = np.maximum(np.abs(self.angle[:, cell] - lean) - self.turn[:, None], 0)
        # angles at a zero pivot say nothing
        cosine = np.where(self.norms[cell] > 0, np.cos(np.minimum(apart, math.pi)), 1)
        upper = np.minimum(upper, np.where(cosine > 0, high, np.sqrt(self.low2)[:, None]) * norm * cosine)
        return upper >= (self.theta - self.slack)[:, None]

    def join(self, cell: np.ndarray, d: np.ndarray, n2: np.ndarray, vectors: int) -> None:
        """Form groups by what a sample of the vectors says: neighbours join where one copy for both costs less."""
        if not len(self.ids):
            return
        want = self.wanted(cell, d, n2)
        scale = vectors / max(1, want.shape[1])
        left, chain = list(range(1, len(self.ids))), [0]
        while left:  # a chain of near pivots
            near = min(left, key=lambda i: (self.between[chain[-1], self.ids[i]], i))
            left.remove(near)
            chain.append(near)
        groups: list[list[int]] = []
        mine, queries = None, 0.0
        cost = lambda kept, n: kept.sum() * scale * (COPY + n)
        for i in chain:
            n = self.many[i]
            both = None if mine is None else mine | want[i]
            if both is not None and queries + n <= QUERIES and cost(both, queries + n) <= cost(mine, queries) + cost(want[i], n):
                groups[-1].append(i)
                mine, queries = both, queries + n
            else:
                groups.append([i])
                mine, queries = want[i], n
        self.order = np.array([i for g in groups for i in g])
        self.first = np.cumsum([0, *map(len, groups[:-1])])
        self.group_of = {int(self.ids[i]): g for g, members in enumerate(groups) for i in members}

    def reach(self, cell: np.ndarray, d: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """(groups, vectors): whether a vector goes to a group."""
        if not len(self.ids):
            return np.zeros((0, len(cell)), bool)
        return np.logical_or.reduceat(self.wanted(cell, d, n2)[self.order], self.first, axis=0)


def top_k(
    vectors: DataFrame, k: int = K, every: int = 20, factor: int = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest integer inner product of each query.

    Queries are the rows whose identifier ``every`` divides; components become floor(factor * x).
    Vectors that are null or hold a null or non-finite component, and rows without an identifier,
    take no part; vectors of different lengths compare as if padded with zeros; a vector and others
    of its own identifier are not compared; repeated rows count once, with the larger score.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = pick(vectors, id=id_col, v=vector_col).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    dims, top, n = rows.agg(F.max(F.size("v")), F.max(largest), F.count("*")).first()
    dims, top = dims or 1, int(factor * (top or 0)) + 1
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"

    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(n) // 2))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    points = np.zeros((max(1, len(chosen)), dims))
    for i, r in enumerate(chosen):
        points[i, : len(r["v"])] = np.floor(factor * np.array(r["v"]))
    points = np.unique(points, axis=0)
    points2 = (points**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["v"], dims, factor)
            n2 = (x * x).sum(1)
            cell = (points2 - 2 * x @ points.T).argmin(1)
            d = np.sqrt(((x - points[cell]) ** 2).sum(1))
            raw = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(cell, pa.int32()), pa.array(d), pa.array(n2)], ["id", "v", "cell", "d", "n2"]
            )

    data = spool(rows.mapInArrow(assign, "id long, v binary, cell int, d double, n2 double"), "cells")
    queries = data.filter(F.pmod("id", F.lit(every)) == 0)
    # k + 1 identifiers a cell, one of which may be a query's own; one that lies in several cells counts once
    near = Window.partitionBy("cell").orderBy("d", "id")
    summary = data.groupBy("id").agg(F.min(F.struct("d", "cell", "n2", "v")).alias("x")).select("x.cell", "x.d", "x.n2", "x.v", "id")
    summary = summary.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r").toArrow()
    known = _packed(summary["v"].combine_chunks(), kind).astype(float) if len(summary) else np.zeros((0, dims))
    known_ids = summary["id"].to_numpy()
    context = data.sparkSession.sparkContext
    sample = context.broadcast((known, known_ids))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The score that each query surely reaches."""
        x, ids = sample.value
        for b in batches:
            q, own, out = _packed(b["v"], kind).astype(float), b["id"].to_numpy(), []
            for at in range(0, len(q), ROWS):
                s = q[at : at + ROWS] @ x.T
                s[ids == own[at : at + ROWS, None]] = -np.inf
                out.append(np.partition(s, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(s), -np.inf))
            yield pa.RecordBatch.from_arrays([b["cell"], b["d"], b["n2"], pa.array(np.concatenate(out) if out else np.zeros(0))], ["cell", "d", "n2", "t"])

    told = queries.select("id", "v", "cell", "d", "n2").mapInArrow(sure, "cell int, d double, n2 double, t double")
    grouped = told.groupBy("cell").agg(F.max("d"), F.min("n2"), F.max("n2"), F.min("t"), F.count("*")).collect()
    bounds = Bounds(points, {r[0]: tuple(r[1:]) for r in grouped})
    bounds.join(summary["cell"].to_numpy().astype(np.int64), summary["d"].to_numpy(), summary["n2"].to_numpy(), n)
    shared = context.broadcast(bounds)
    group_ids = np.arange(len(bounds.first) if len(bounds.ids) else 0, dtype=np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(group_ids), np.int64)
        for b in batches:
            total += shared.value.reach(*(b[c].to_numpy() for c in ("cell", "d", "n2"))).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(group_ids), pa.array(total)], ["g", "n"])

    sizes = dict(data.select("cell", "d", "n2").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n")).collect())
    chunks = np.array([max(1, -(-sizes.get(g, 0) // CHUNK)) for g in group_ids.tolist()], np.int64)
    asked = np.zeros(len(group_ids), np.int64)
    for r in grouped:
        asked[bounds.group_of[r[0]]] += r[5]
    blocks = -(-asked // QUERIES)
    if n and len(group_ids):
        log.info("%d cells of queries in %d groups; share of (group, vector) pairs kept %.3f", len(bounds.ids), len(group_ids), sum(sizes.values()) / (n * len(group_ids)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, i = np.nonzero(shared.value.reach(*(b[c].to_numpy() for c in ("cell", "d", "n2"))))
            chunk = (b["h"].to_numpy()[i].view(np.uint64) % chunks[g].astype(np.uint64)).astype(np.int64)
            many = blocks[g]
            block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            g, i, chunk = np.repeat(g, many), np.repeat(i, many), np.repeat(chunk, many)
            yield from _keyed(b, group_ids[g], chunk, block, i)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = np.array([shared.value.group_of[c] for c in b["cell"].to_pylist()], np.int64)
            block = (b["h"].to_numpy().view(np.uint64) % blocks[g].astype(np.uint64)).astype(np.int64) if len(g) else g
            many = chunks[g]
            chunk = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield from _keyed(b, group_ids[np.repeat(g, many)], chunk, np.repeat(block, many), np.repeat(np.arange(len(g)), many))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 3]
        if len(left) and len(right):
            q, x = (_packed(t["v"].combine_chunks(), kind) for t in (left, right))
            parts += best(q, left["id"].to_numpy(), x, right["id"].to_numpy(), k, top)
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], ["query_id", "vec_id", "score"])

    keys, out = ["g", "c", "b"], "g int, c long, b long, id long, v binary"
    # by row, so that an identifier of many rows is not one task; the k best identifiers of each chunk hold those of all
    seeded = [F.xxhash64("id", F.monotonically_increasing_id(), F.lit(s)).alias("h") for s in ("vector", "query")]
    left = queries.select("id", "v", "cell", seeded[1]).mapInArrow(spread, out).groupBy(*keys)
    right = data.select("id", "v", "cell", "d", "n2", seeded[0]).mapInArrow(route, out).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(solve, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(b: pa.RecordBatch, g: np.ndarray, chunk: np.ndarray, block: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Copies of rows i under their keys, some thousands at a time."""
    for at in range(0, len(i), 20_000):
        part = slice(at, at + 20_000)
        rows = pa.array(i[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(g[part], pa.int32()), pa.array(chunk[part]), pa.array(block[part]), b["id"].take(rows), b["v"].take(rows)], ["g", "c", "b", "id", "v"]
        )
