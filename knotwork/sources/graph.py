"""A property graph: two DataFrames and a schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaViolation
from ..functions.values import TYPES, class_of
from .registry import Registry

VERTEX_COLUMNS = ("id", "label")
EDGE_COLUMNS = ("src", "label", "dst", "rank")


class PropertyGraph:
    """vertices(id, label, properties...) and edges(src, label, dst, rank, properties...).

    Every property key has one type in the whole graph, so properties are plain nullable columns, and
    Parquet readers see which of them a traversal needs.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, registry: Registry | None = None, max_iterations: int = 1000) -> None:
        for df, own, what in ((vertices, VERTEX_COLUMNS, "vertices"), (edges, EDGE_COLUMNS, "edges")):
            if missing := set(own) - set(df.columns):
                raise SchemaViolation(f"{what} lack the columns {sorted(missing)}")
        self.vertices, self.edges = vertices, edges
        self.registry = registry or Registry(edge_mode="multi")
        self.max_iterations = max_iterations
        for df, own in ((vertices, VERTEX_COLUMNS), (edges, EDGE_COLUMNS)):
            for f in df.schema:
                if f.name not in own and f.name not in self.registry.keys:
                    self.registry.keys[f.name] = _type_name(f)

    @property
    def vertex_keys(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in VERTEX_COLUMNS]

    @property
    def edge_keys(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_COLUMNS]

    def with_frames(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
        return PropertyGraph(self.vertices if vertices is None else vertices, self.edges if edges is None else edges, self.registry, self.max_iterations)

    def label_number(self, label: Column) -> Column:
        """The registered number of an edge label column; 0 for labels that are not registered."""
        names = self.registry.edge_labels
        if not names:
            return F.lit(0)
        return F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))]), label), F.lit(0))

    def adjacency(self, direction: str, labels: tuple[str, ...]) -> DataFrame:
        """Edges as seen from a vertex ``a``: the other end ``b``, ``dir`` and the label's position ``lp``.

        A label that is listed twice counts twice.
        """
        edges = self.edges
        number = self.label_number(F.col("label"))
        if len(set(labels)) < len(labels):
            parts = [edges.where(F.col("label") == n).withColumn("lp", F.lit(i)) for i, n in enumerate(labels)]
            edges = reduce(DataFrame.unionByName, parts)
        elif labels:
            place = reduce(lambda c, x: c.when(F.col("label") == x[1], x[0]), list(enumerate(labels))[1:], F.when(F.col("label") == labels[0], 0))
            edges = edges.where(F.col("label").isin(*labels)).withColumn("lp", place)
        else:
            edges = edges.withColumn("lp", number)
        sides = []
        if direction in ("out", "both"):
            sides.append(edges.withColumns({"a": F.col("src"), "b": F.col("dst"), "dir": F.lit("OUT")}))
        if direction in ("in", "both"):
            sides.append(edges.withColumns({"a": F.col("dst"), "b": F.col("src"), "dir": F.lit("IN")}))
        return reduce(DataFrame.unionByName, sides)

    def degrees(self, direction: str, labels: tuple[str, ...] = ()) -> DataFrame:
        """(a, n): the number of edges by vertex; a loop counts once for each direction."""
        return self.adjacency(direction, labels).groupBy("a").agg(F.count("*").alias("n"))

    def g(self) -> object:
        """A source of read traversals on this graph as it is."""
        from ..plans.traversal import Traversal

        return Traversal(GraphSource(self))


class GraphSource:
    """Runs read plans on a graph."""

    def __init__(self, graph: PropertyGraph) -> None:
        self.graph = graph

    def run(self, plan: tuple, ordered: bool = False) -> object:
        from ..operators.compile import run

        return run(self.graph, plan, ordered)


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Adjacency reads by label and source: files and row groups are sorted by them."""
    return edges.sortWithinPartitions("label", "src")


def declare_columns(registry: Registry, df: DataFrame, own: tuple[str, ...]) -> None:
    """Register a frame's property columns, or check them in strict mode; all columns of ``own`` must be there."""
    if missing := set(own) - set(df.columns):
        raise SchemaViolation(f"the columns {sorted(missing)} are missing")
    for f in df.schema:
        if f.name not in own:
            if registry.mode == "strict":
                registry.check_key(f.name)
            registry.add_property_key(f.name, registry.keys.get(f.name) if registry.type_of(f.name) == f.dataType else _type_name(f))


def _type_name(field: T.StructField) -> str:
    for name, kind in TYPES.items():
        if kind == field.dataType and name not in ("uint16", "uuid"):
            return name
    if class_of(field.dataType) == "vector":
        return "float_vector"
    raise SchemaViolation(f"column {field.name} has the type {field.dataType.simpleString()}, which no property can have")
