"""Bulk loading: validated DataFrames become the first version of a graph."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import DuplicateEdge, DuplicateVertex, IncompleteLoad, SchemaViolation, VectorIndexError
from ..functions.values import MAX_RANK
from .graph import EDGE_COLUMNS, VERTEX_COLUMNS, declare_columns, sorted_edges

if TYPE_CHECKING:
    from .store import GraphStore


@dataclass(frozen=True)
class LoadStats:
    vertices: int
    edges: int
    files: int
    seconds: float


def assign_ranks(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Ranks where they are null: they go on from the largest explicit one of the same (src, label, dst)."""
    key = ["src", "label", "dst"]
    by = [F.col(c) for c in (order or [c for c in edges.columns if c not in (*key, "rank")])] or [F.lit(0)]
    top = F.coalesce(F.max("rank").over(Window.partitionBy(*key)), F.lit(-1))
    n = F.row_number().over(Window.partitionBy(*key, F.col("rank").isNull()).orderBy(*by))
    return edges.withColumn("rank", F.coalesce(F.col("rank"), top + n).cast("int"))


def dangling(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no vertex."""
    ids = vertices.select("id")
    missing_src = edges.join(ids, edges["src"] == ids["id"], "left_anti")
    missing_dst = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "__i"), F.col("dst") == F.col("__i"), "left_anti")
    return missing_src.unionByName(missing_dst)


class BulkLoader:
    """load_vertices once, then load_edges, then commit; leaving before loads nothing.

    Rows are written once, into the folder that the new version will name, and counted and looked at
    on the way; checks of keys and ends read their columns back.
    """

    def __init__(self, store: GraphStore) -> None:
        self._store, self._base, self._began = store, store.version, time.time()
        self._folder = store.new_folder("data")
        self._vertices: DataFrame | None = None
        self._edges: DataFrame | None = None
        self._pieces: dict[str, list[dict]] = {"vertices": [], "edges": []}
        self._counts = {"vertices": 0, "edges": 0}
        self._registry = store.registry.copy()

    def __enter__(self) -> BulkLoader:
        return self

    def __exit__(self, *_: object) -> None:
        if self._folder:
            self._store.discard(self._folder)
        self._vertices = self._edges = self._folder = None

    def _stored(self, df: DataFrame, part: str, *looks: Column) -> tuple[DataFrame, dict]:
        """A frame written and read back, and what was seen on the way."""
        path, part, seen = f"{self._folder}/{part}-{len(self._pieces[part.split('-')[0]])}", part.split("-")[0], Observation()
        df.observe(seen, F.count("*").alias("n"), F.collect_set("label").alias("labels"), *looks).write.parquet(path)
        got = seen.get
        for label in sorted(got["labels"]):
            self._registry.write_label(label, part == "edges")
        self._pieces[part].append({"path": path, "schema": df.schema.json()})
        self._counts[part] += got["n"]
        return df.sparkSession.read.schema(df.schema).parquet(path), got

    def load_vertices(self, vertices: DataFrame) -> BulkLoader:
        if self._vertices is not None:
            raise IncompleteLoad("vertices are loaded once")
        declare_columns(self._registry, vertices, VERTEX_COLUMNS)
        vertices = vertices.withColumn("id", F.col("id").cast("bigint"))
        indexed = [(F.size(k) != x.dimension) | (F.col("id") < 0) for k, x in self._registry.indexes.items() if k in vertices.columns]
        wrong = reduce(lambda a, b: a | b, indexed, F.lit(False))
        vertices, seen = self._stored(vertices, "vertices", F.count(F.when(F.col("id").isNull(), 1)).alias("none"), F.count(F.when(wrong, 1)).alias("wrong"))
        if seen["wrong"]:
            raise VectorIndexError(f"{seen['wrong']} vectors have another dimension than their index, or negative ids")
        if seen["none"] or not vertices.groupBy("id").count().where("count > 1").isEmpty():
            raise DuplicateVertex("an id is null or occurs more than once")
        self._vertices = vertices
        return self

    def load_edges(self, edges: DataFrame) -> BulkLoader:
        if self._vertices is None:
            raise IncompleteLoad("vertices come before edges")
        single = self._registry.edge_mode == "single"
        assigned = "rank" not in edges.columns and not single
        if single:
            edges = edges.withColumn("rank", F.lit(0))
        elif assigned:
            edges = edges.withColumn("rank", F.lit(None).cast("int"))
        declare_columns(self._registry, edges, EDGE_COLUMNS)
        if any(k in self._registry.indexes for k in edges.columns):
            raise VectorIndexError("indexes are for vertices")
        edges = edges.withColumns({"src": F.col("src").cast("bigint"), "dst": F.col("dst").cast("bigint"), "rank": F.col("rank").cast("int")})
        if assigned:
            edges = assign_ranks(edges)
        looks = [F.count(F.when(F.col("rank").isNull(), 1)).alias("none"), F.count(F.when(~F.col("rank").between(0, MAX_RANK), 1)).alias("odd")]
        edges, seen = self._stored(sorted_edges(edges), "edges", *looks)
        if seen["none"]:  # some have ranks and some have not: what was written is read once more
            given = self._pieces["edges"].pop()
            self._counts["edges"] -= seen["n"]
            edges, seen = self._stored(sorted_edges(assign_ranks(edges)), "edges-ranked", *looks)
            self._store.discard(given["path"])
        if seen["odd"]:
            raise SchemaViolation(f"a rank is outside 0 to {MAX_RANK}")
        every = edges if self._edges is None else self._edges.unionByName(edges, allowMissingColumns=True)
        # ranks that were all assigned here are distinct among themselves
        if (self._edges is not None or not assigned) and not every.groupBy(*EDGE_COLUMNS).count().where("count > 1").isEmpty():
            raise DuplicateEdge("an edge occurs more than once")
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if not ends.join(self._vertices, "id", "left_anti").isEmpty():
            raise SchemaViolation("an edge ends at a vertex that is not loaded")
        self._edges = every
        return self

    def commit(self) -> LoadStats:
        if self._vertices is None:
            raise IncompleteLoad("nothing is loaded")
        self._store.load(self._pieces["vertices"], self._pieces["edges"], self._registry, self._base)
        files = sum(self._store.files(p["path"]) for part in self._pieces.values() for p in part)
        self._folder = None
        return LoadStats(self._counts["vertices"], self._counts["edges"], files, time.time() - self._began)
