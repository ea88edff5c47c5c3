"""SimHash near-duplicate groups with BK-trees.

Fingerprints at most RADIUS bits apart are linked and linked fingerprints form components.
Only distinct fingerprints are compared.  Cutting the 64 bits into RADIUS + 1 parts leaves at
least one part of a linked pair without a difference, and the same holds for what that part
leaves over; so every pair meets in a shard of fingerprints that agree under one of nine masks of
about 35 bits.  A shard over SHARD_LIMIT is cut again, under masks of about 45, 52 and 56 bits;
under the last 2 ** 8 fingerprints are all there can be, so a shard's size is bounded whatever the
data.  For each shard one task builds a BK-tree (children keyed by their integer Hamming distance
to the parent) and follows only edges within the radius.  The trees together grow with the data,
so each goes to the one task that holds its probes instead of being broadcast to all.  A shard
returns a spanning forest of its links, never all pairs.  Components come from large-star and
small-star rounds over these forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, pick, release, skew_join, spool

WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a shard beyond which it is cut under finer masks.
SHARD_LIMIT = 4096
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 if it has no word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    whole = b" ".join(w)
    starts = [0]
    for x in w[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    ends = [s + len(x) for s, x in zip(starts[words - 1 :], w[words - 1 :], strict=True)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), BLOCK):
        raw = b"".join([digest(whole[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])  # noqa: B905
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the signed 64-bit value of each row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what another operator has remembered in this worker
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b["text"]), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps.view(np.int64))], ["id", "fp"])
        release()

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class BKTree:
    """Distinct 64-bit integers; a node's children are keyed by their distance to it."""

    def __init__(self, values: list[int]) -> None:
        self.children: dict[int, dict[int, int]] = {}
        self.root: int | None = None
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        node = self.root
        while distance := (node ^ value).bit_count():
            below = self.children[node].get(distance)
            if below is None:
                self.children[node][distance] = value
                self.children[value] = {}
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                yield node
            kids = self.children[node]
            todo += [kids[k] for k in range(max(1, distance - radius), distance + radius + 1) if k in kids]


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, smallest of its local component) for every member that is not the smallest itself."""
    parent = {v: v for v in values}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    tree = BKTree([])
    for v in values:
        for near in tree.within(v, radius):
            a, b = find(v), find(near)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, r) for v in values if (r := find(v)) != v]


def _cut(mask_left: list[int]) -> list[list[int]]:
    """Three parts of the bit positions, as even as can be."""
    n, parts = len(mask_left), RADIUS + 1
    edges = [round(n * k / parts) for k in range(parts + 1)]
    return [mask_left[edges[k] : edges[k + 1]] for k in range(parts)]


def _finer(fixed: list[int]) -> list[list[int]]:
    """The masks (lists of bit positions) under which a shard of one mask is cut again."""
    left = [b for b in range(64) if b not in set(fixed)]
    return [sorted(fixed + part) for part in _cut(left)]


def _signed(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _shards(nodes: DataFrame) -> DataFrame:
    """Rows (fps: array of distinct fingerprints that agree under a mask), bounded in size."""

    def keyed(df: DataFrame, masks: list[list[int]]) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for m in masks])
        return df.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.v")

    masks = [f for m in _finer([]) for f in _finer(m)]
    out, level = [], keyed(nodes, masks)
    while len(masks[0]) < 54:
        sizes = level.groupBy("m", "v").agg(F.count("*").alias("n"))
        large = spool(sizes.filter(F.col("n") > SHARD_LIMIT).select("m", "v"), "large")
        if large.isEmpty():
            break
        out.append(level.join(large, ["m", "v"], "left_anti"))
        finer = {_signed(m): _finer(m) for m in masks}
        lookup = F.create_map(*[x for m, fs in finer.items() for x in (F.lit(m), F.array(*[F.lit(_signed(f)) for f in fs]))])
        crowded = level.join(large, ["m", "v"], "left_semi").select("fp", F.explode(lookup[F.col("m")]).alias("m")).distinct()
        level = spool(crowded, "crowded").select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("v"))
        masks = list({tuple(f): f for fs in finer.values() for f in fs}.values())
    out.append(level)
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.groupBy("m", "v").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), b < a: a spanning forest of all links between the distinct fingerprints in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for fps in batch["fps"] for p in forest([x & 0xFFFFFFFFFFFFFFFF for x in fps.as_py()])]
            arr = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], ["a", "b"])

    return _shards(nodes).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of every node's component, for nodes that have an edge.

    Alternates large-star and small-star until nothing changes; each round is written to the
    shared folder.  The order is Spark's order of ``long``.
    """
    edges = spool(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("many"))
        # large star: every larger neighbour of a node is linked to the smallest
        # the hub of a star may have most edges
        large = skew_join(both.filter("b > a"), low, "a", "many", 2 * edges.count()).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        # small star: every smaller neighbour and the node itself are linked to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        after = spool(small.filter("a != b").distinct(), "edges")
        # done when every node has one edge and no root has a smaller neighbour: a star forest
        crooked = after.groupBy("a").count().filter("count > 1").select("a").unionByName(
            after.select("a").join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        )
        edges = after
        if crooked.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, component_root.

    Without ``similarity``, fingerprints within RADIUS bits are linked; with it, texts whose sets of
    shingles are that similar (see ``near_copies``, where fingerprints only propose).

    A null or empty text has fingerprint zero, which is linked like any other.  ``component_id``
    is the smallest non-null identifier reachable; ``component_root``, one of the component's
    fingerprints, tells components apart even where identifiers repeat.  Rows that repeat an identifier each get a row;
    an empty table gives an empty result; other columns play no part.
    """
    if similarity is not None:
        from . import near_copies  # which uses this module

        return near_copies.near_duplicates(docs, id_col, text_col, words, similarity)
    fps = spool(fingerprints(docs, id_col, text_col, words), "fingerprints")
    # rows of one fingerprint are counted before they meet anything: a hot one stays where it is
    nodes = spool(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "nodes")
    stars = components(links(nodes.select("fp")))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = spool(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("many"))
    named = skew_join(rooted.select("fp", "root", "rows"), lowest, "root", "many", rooted.count())
    largest = nodes.agg(F.max("rows")).first()[0] or 0
    out = skew_join(fps, named.select("fp", "root", "component_id", "rows"), "fp", "rows", largest)
    return out.select(F.col("id").alias("doc_id"), hexadecimal("fp").alias("fingerprint"), "component_id", hexadecimal("root").alias("component_root"))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
