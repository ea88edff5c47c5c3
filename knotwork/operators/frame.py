"""Traversers as a DataFrame with a statically known kind of value."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ANY, class_of, edge_id, to_any

if TYPE_CHECKING:
    from ..sources.graph import PropertyGraph

EDGE_TYPE = T.StructType(
    [T.StructField("src", T.LongType()), T.StructField("label", T.StringType()), T.StructField("dst", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("dir", T.StringType())]
)
#: Property columns that a frame carries along; Catalyst drops those that nothing reads.
PREFIX = "p_"
LABEL = "p__label"


@dataclass(frozen=True)
class Kind:
    """vertex, edge, scalar, property, list, map or path; ``type`` is that of column v."""

    name: str
    type: T.DataType
    inner: Kind | None = None
    key: Kind | None = None

    @property
    def element(self) -> bool:
        return self.name in ("vertex", "edge")


VERTEX = Kind("vertex", T.LongType())
EDGE = Kind("edge", EDGE_TYPE)
PATH = Kind("path", T.ArrayType(T.StructType([T.StructField("obj", ANY), T.StructField("labels", T.ArrayType(T.StringType()))])))
MIXED = Kind("scalar", ANY)


def scalar(kind: T.DataType) -> Kind:
    return Kind("scalar", kind)


@dataclass(frozen=True)
class Vertex:
    id: int
    label: str
    properties: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Edge:
    src: int
    label: str
    dst: int
    rank: int
    properties: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Property:
    key: str
    value: Any
    owner: Any = field(default=None, compare=False)


@dataclass(frozen=True)
class Path:
    objects: tuple[Any, ...]
    labels: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Frame:
    """df has the value in column ``v``.

    loaded: whether label and property columns are there.  order: whether ``__ord``, the emission order as
    an array that compares element by element, is there; sort: columns that come before it.  path: whether
    ``__path`` is there.  tags: columns of labelled values by label.  scope: whether ``__scope``, the
    traverser that a sub-traversal started from, is there, and then ``scopes`` has all of them.
    """

    graph: PropertyGraph
    df: DataFrame
    kind: Kind
    loaded: bool = False
    order: bool = False
    sort: tuple[tuple[str, str], ...] = ()
    path: bool = False
    tags: dict[str, tuple[str, Kind]] = field(default_factory=dict)
    scope: bool = False
    scopes: DataFrame | None = None

    def but(self, **changes: Any) -> Frame:
        return replace(self, **changes)

    @property
    def carried(self) -> list[str]:
        """Columns other than the value and its properties."""
        return [c for c in self.df.columns if c != "v" and not c.startswith(PREFIX)]

    def bare(self) -> DataFrame:
        """The rows without what ``load`` adds."""
        return self.df.drop(*[c for c in self.df.columns if c.startswith(PREFIX)])

    def sort_columns(self, reverse: bool = False) -> list[Column]:
        out = []
        for name, way in (*self.sort, *((("__ord", "asc"),) if self.order else ())):
            up = (way == "asc") != reverse
            # nulls are last in both directions; reversed, they come first
            c = F.col(name)
            out.append((c.asc_nulls_first() if up else c.desc_nulls_first()) if reverse else (c.asc_nulls_last() if up else c.desc_nulls_last()))
        return out

    def load(self) -> Frame:
        """With the label and property columns of the element."""
        if self.loaded or not self.kind.element:
            return self
        g = self.graph
        if self.kind.name == "vertex":
            side = g.vertices.select(F.col("id").alias("__id"), F.col("label").alias(LABEL), *[F.col(k).alias(PREFIX + k) for k in g.vertex_keys])
            df = self.df.join(side, F.col("v") == F.col("__id")).drop("__id")
        else:
            own = ("src", "label", "dst", "rank")
            side = g.edges.select(*[F.col(c).alias(f"__{c}") for c in own], *[F.col(k).alias(PREFIX + k) for k in g.edge_keys])
            match = (F.col("v.src") == F.col("__src")) & (F.col("v.label") == F.col("__label")) & (F.col("v.dst") == F.col("__dst")) & (F.col("v.rank") == F.col("__rank"))
            df = self.df.join(side, match).drop(*[f"__{c}" for c in own]).withColumn(LABEL, F.col("v.label"))
        return self.but(df=df, loaded=True)

    def has_key(self, key: str) -> bool:
        return self.loaded and PREFIX + key in self.df.columns

    def as_any(self, value: Column | None = None) -> Column:
        """The value as a tagged struct."""
        v = F.col("v") if value is None else value
        none = {"l": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}

        def tagged(tag: str, **parts: Column) -> Column:
            every = none | parts
            return F.struct(F.lit(tag).alias("tag"), *[every[k].alias(k) for k in ("l", "d", "s")])

        name = self.kind.name
        if name == "vertex":
            return tagged("v", l=v)
        if name == "edge":
            return tagged("e", s=edge_id(v["src"], self.graph.label_number(v["label"]), v["dst"], v["rank"]))
        if name == "scalar":
            return to_any(v, self.kind.type)
        if name == "property":
            return tagged("p", s=v["key"])
        return tagged("j", s=F.to_json(v))

    # results
    def flat(self, keys: tuple[str, ...] | None = None) -> DataFrame:
        """One row for each result under plain column names; sorted where the traversal orders."""
        frame, kind = self, self.kind
        if kind.name == "map" and "key" in frame.df.columns:
            key = frame.df["key"]
            return frame.df.select((_text(key) if kind.key and kind.key.type == ANY else key).alias("key"), F.col("value"))
        if kind.element:
            frame = frame.load() if kind.name == "vertex" or keys is not None else frame
            known = frame.graph.vertex_keys if kind.name == "vertex" else frame.graph.edge_keys
            wanted = [] if keys is None else known if not keys else [k for k in keys if k in known]
            props = [F.col(PREFIX + k).alias(k) for k in wanted]
            if kind.name == "vertex":
                cols = [F.col("v").alias("id"), F.col(LABEL).alias("label"), *props]
            else:
                cols = [F.col(f"v.{c}").alias(c) for c in ("src", "label", "dst", "rank")] + props
        elif kind.name == "property":
            cols = [F.col("v.owner").alias("owner"), F.col("v.key").alias("key"), _text(F.col("v.value")).alias("value")]
        elif kind.type == ANY:
            cols = [F.col("v.tag").alias("tag"), _text(F.col("v")).alias("value")]
        else:
            cols = [F.col("v").alias("value")]
        df = frame.df.orderBy(*frame.sort_columns()) if frame.sort else frame.df
        return df.select(*cols)

    def objects(self, keys: tuple[str, ...] | None = None, first: bool = False) -> Iterator[Any]:
        """Results as Python objects, in emission order where the traversal tracks it."""
        if self.kind.name == "map" and "key" in self.df.columns:
            kind = self.kind
            pairs = [(r["key"], r["value"]) for r in self.df.select("key", "value").collect()]
            yield {_hashable(self._object(k, kind.key)): self._object(x, kind.inner) for k, x in pairs}
            return
        frame = self
        props: list[str] = []
        if self.kind.element:
            frame = self.load() if self.kind.name == "vertex" or keys is not None else self
            known = self.graph.vertex_keys if self.kind.name == "vertex" else self.graph.edge_keys
            props = [] if keys is None else list(known) if not keys else [k for k in keys if k in known]
        df = frame.df.orderBy(*frame.sort_columns()) if frame.order or frame.sort else frame.df
        df = df.select("v", *([LABEL] if self.kind.name == "vertex" else []), *[PREFIX + k for k in props])
        rows = df.limit(1).collect() if first else df.toLocalIterator()
        for r in rows:
            own = {k: r[PREFIX + k] for k in props if r[PREFIX + k] is not None}
            if self.kind.name == "vertex":
                yield Vertex(r["v"], r[LABEL], own)
            elif self.kind.name == "edge":
                yield Edge(*[r["v"][c] for c in ("src", "label", "dst", "rank")], own)
            else:
                yield self._object(r["v"], self.kind)

    def _object(self, value: Any, kind: Kind | None) -> Any:
        if value is None or kind is None:
            return value
        if kind.name == "vertex":
            return Vertex(value, "")
        if kind.name == "edge":
            return Edge(*[value[c] for c in ("src", "label", "dst", "rank")])
        if kind.name == "list":
            return [self._object(x, kind.inner) for x in value]
        if kind.name == "map":
            return {_hashable(self._object(x["key"], kind.key)): self._object(x["value"], kind.inner) for x in value}
        if kind.name == "path":
            return Path(tuple(self._plain(x["obj"]) for x in value), tuple(tuple(x["labels"]) for x in value))
        if kind.name == "property":
            return Property(value["key"], self._plain(value["value"]), self._plain(value["owner"]))
        return self._plain(value) if kind.type == ANY else value

    def _plain(self, x: Row | None) -> Any:
        if x is None:
            return None
        if x["tag"] == "v":
            return Vertex(x["l"], "")
        if x["tag"] == "e":
            from ..functions.values import decode_edge_id

            src, number, dst, rank = decode_edge_id(x["s"])
            return Edge(src, self.graph.registry.edge_label(number) or "", dst, rank)
        if x["tag"] == "b":
            return bool(x["l"])
        if x["tag"] == "x":
            return bytes.fromhex(x["s"])
        return next((x[c] for c in ("l", "d", "s") if x[c] is not None), None)


def _hashable(x: Any) -> Any:
    return tuple(map(_hashable, x)) if isinstance(x, list) else x


def _text(c: Column) -> Column:
    """A tagged struct as text."""
    return F.coalesce(F.when(c["tag"] == "b", F.when(c["l"] == 1, "true").otherwise("false")), c["s"], c["l"].cast("string"), c["d"].cast("string"))


def is_number(kind: Kind) -> bool:
    return kind.name == "scalar" and (kind.type == ANY or class_of(kind.type) in ("int", "float"))
