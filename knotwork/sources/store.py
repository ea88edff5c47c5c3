"""Versioned graphs on a shared file system, as base files and deltas.

A version is a manifest that names the folders of the base files and, in order, the deltas committed
since.  A delta has the elements that one transaction wrote, each whole, and marks those that it
dropped; a reader takes the newest state of each key and lays it over the base with one anti join.  So
a commit writes what it changed, a change of the schema only a manifest, and nothing rewrites the base
but ``compact``.  Many deltas are merged into one, which rewrites the deltas alone.

Manifests are created exclusively, in order.  A transaction that finds newer versions than the one it
began on looks at the keys that those wrote: it conflicts if one of them is among its own, if they
dropped an end of an edge it adds or added an edge to a vertex it drops, or if the whole graph was
loaded anew; else it commits behind them.  Readers stay on the version they opened.  Any Hadoop file
system will do whose exclusive create is atomic.
"""

from __future__ import annotations

import json
import uuid
import weakref
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, DuplicateEdge, DuplicateVertex, IncidentEdges, NotFound, ReadOnly, SchemaConflict, SchemaViolation, TraversalError, UnsupportedOperation, VectorIndexError
from ..functions.values import MAX_RANK, TYPES
from ..operators.compile import Compiler, run
from ..operators.frame import EDGE, EDGE_TYPE, VERTEX, Frame
from ..plans.rewrite import rewrite
from ..plans.steps import WRITES, Plan, Step, walk
from ..plans.traversal import Traversal
from .bulk import BulkLoader
from .graph import EDGE_COLUMNS, VERTEX_COLUMNS, PropertyGraph, declare_columns, sorted_edges
from .registry import Registry, SchemaSession
from .spool import remove, spool

_VERTICES = "id long, label string"
_EDGES = "src long, label string, dst long, rank int"
#: The key columns of each part of a graph.
KEYS = {"vertices": ["id"], "edges": list(EDGE_COLUMNS)}
_EMPTY = {"vertices": _VERTICES, "edges": _EDGES}
DEAD = "__dead"
#: Deltas beyond which a commit merges them into one.
MERGE_AFTER = 16


def overlay(base: DataFrame, changes: DataFrame | None, part: str) -> DataFrame:
    """The elements of ``base`` with those of ``changes``, whole or dead and one a key, in place of their like."""
    if changes is None:
        return base
    kept = base.join(changes.select(*KEYS[part]), KEYS[part], "left_anti").select(*base.columns)
    return kept.unionByName(changes.where(~F.col(DEAD)).drop(DEAD), allowMissingColumns=True)


class GraphStore:
    """A graph that lives in a folder.  Options count when the folder is new and are kept from then on."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "auto", edge_mode: str = "single") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._sessions: weakref.WeakSet = weakref.WeakSet()
        self._closed = False
        if self.version < 0:
            first = {"kind": "load", "registry": Registry(mode, edge_mode).dumps(), "vertices": [], "edges": [], "deltas": [], "own": None}
            self._create(0, first)  # if another opened the folder first, theirs counts
        self._refresh()

    # files
    def _fs(self, path: str) -> tuple[Any, Any]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest-{version:010d}.json"

    @property
    def version(self) -> int:
        """The newest version; -1 if there is none."""
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return -1
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=-1)

    def _manifest(self, version: int) -> dict:
        fs, where = self._fs(self._name(version))
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, manifest: dict) -> bool:
        """Create a version's manifest; False if that version is there already.  Other failures are raised as they are."""
        fs, where = self._fs(self._name(version))
        try:
            stream = fs.create(where, False)
        except Exception:  # py4j has no types for what went wrong
            if fs.exists(where):
                return False
            raise
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return True

    def new_folder(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def files(self, folder: str) -> int:
        fs, where = self._fs(folder)
        return sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(where)) if fs.exists(where) else 0

    def discard(self, folder: str) -> None:
        """Remove a folder that no manifest names."""
        remove(self.spark, folder)

    def _read(self, piece: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(piece["schema"]))).parquet(piece["path"])

    def _written(self, df: DataFrame, path: str) -> dict:
        df.write.parquet(path)
        return {"path": path, "schema": df.schema.json()}

    def changes(self, deltas: list[dict], part: str) -> DataFrame | None:
        """The newest state of each key that the deltas name."""
        frames = [self._read(d[part]).withColumn("__seq", F.lit(i)) for i, d in enumerate(deltas) if d[part]]
        if not frames:
            return None
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if len(frames) == 1:
            return every.drop("__seq")
        rest = [c for c in every.columns if c not in (*KEYS[part], "__seq")]
        newest = every.groupBy(*KEYS[part]).agg(F.max_by(F.struct(*rest), "__seq").alias("x"))
        return newest.select(*KEYS[part], *[F.col("x")[c].alias(c) for c in rest])

    def _part(self, manifest: dict, part: str) -> DataFrame:
        pieces = [self._read(p) for p in manifest[part]]
        base = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces) if pieces else self.spark.createDataFrame([], _EMPTY[part])
        return overlay(base, self.changes(manifest["deltas"], part), part)

    def open(self, version: int | None = None) -> PropertyGraph:
        m = self._manifest(self.version if version is None else version)
        return PropertyGraph(self._part(m, "vertices"), self._part(m, "edges"), Registry.loads(m["registry"]))

    # new versions
    def load(self, vertices: list[dict], edges: list[dict], registry: Registry, base: int) -> None:
        """A version of new base files; Conflict if another came first."""
        manifest = {"kind": "load", "registry": registry.dumps(), "vertices": vertices, "edges": edges, "deltas": [], "own": None}
        if not self._create(base + 1, manifest):
            raise Conflict(f"version {base + 1} was committed meanwhile")
        self.registry = registry

    def append(self, delta: dict, registry: Registry, base: int) -> None:
        """A version with one more delta, behind those committed since ``base``, unless they conflict."""
        seen = base
        while True:
            for v in range(seen + 1, self.version + 1):
                newer = self._manifest(v)
                if newer["kind"] == "load" or newer["kind"] == "delta" and self._conflict(delta, newer["own"]):
                    raise Conflict(f"version {v} wrote what this transaction wrote or relied on")
                try:
                    registry = Registry.loads(newer["registry"]).merged(registry)
                except SchemaConflict as error:
                    raise Conflict(f"version {v} declared a name otherwise") from error
                seen = v
            m = self._manifest(seen)
            deltas = [*m["deltas"], delta]
            if len(deltas) > MERGE_AFTER:
                deltas = [self._merge(deltas)]
            if self._create(seen + 1, m | {"kind": "delta", "registry": registry.dumps(), "deltas": deltas, "own": delta}):
                self.registry = registry
                return

    def _merge(self, deltas: list[dict]) -> dict:
        folder, out = self.new_folder("delta"), {}
        for part in KEYS:
            found = self.changes(deltas, part)
            out[part] = None if found is None else self._written(found, f"{folder}/{part}")
        return out

    def _conflict(self, mine: dict, theirs: dict) -> bool:
        """Whether two deltas on one version cannot both stand."""

        def meet(a: DataFrame | None, b: DataFrame | None, on: list[str]) -> bool:
            return a is not None and b is not None and not a.join(b.select(*on), on, "left_semi").isEmpty()

        def ends(delta: dict) -> DataFrame | None:
            return self._read(delta["edges"]).where(~F.col(DEAD)).select(F.explode(F.array("src", "dst")).alias("id")) if delta["edges"] else None

        def dropped(delta: dict) -> DataFrame | None:
            return self._read(delta["vertices"]).where(DEAD).select("id") if delta["vertices"] else None

        same = any(meet(self._read(mine[p]), self._read(theirs[p]), KEYS[p]) for p in KEYS if mine[p] and theirs[p])
        return same or meet(ends(mine), dropped(theirs), ["id"]) or meet(ends(theirs), dropped(mine), ["id"])

    def declare(self, registry: Registry) -> None:
        """A version of the same files with another schema; nothing but a manifest is written."""
        while True:
            at = self.version
            m = self._manifest(at)
            current = Registry.loads(m["registry"])
            if current.version >= registry.version:
                raise SchemaConflict("the schema changed since this session began")
            merged = current.merged(registry)
            if self._create(at + 1, m | {"kind": "schema", "registry": merged.dumps(), "own": None}):
                self.registry = merged
                return

    def compact(self) -> None:
        """A version of the same content in new base files without deltas; Conflict if another came first."""
        at, folder = self.version, self.new_folder("data")
        m = self._manifest(at)
        if not m["deltas"]:
            return
        graph = self.open(at)
        vertices = self._written(graph.vertices, f"{folder}/vertices")
        edges = self._written(sorted_edges(graph.edges), f"{folder}/edges")
        if not self._create(at + 1, m | {"kind": "compact", "vertices": [vertices], "edges": [edges], "deltas": [], "own": None}):
            self.discard(folder)
            raise Conflict(f"version {at + 1} was committed meanwhile")

    # sessions
    def _began(self, session: Any) -> Any:
        if self._closed:
            raise TraversalError("the store is closed")
        self._sessions.add(session)
        return session

    def read(self) -> ReadSession:
        return self._began(ReadSession(self))

    def begin(self) -> Transaction:
        return self._began(Transaction(self))

    def _refresh(self) -> None:
        """Another process may have declared names since."""
        self.registry = Registry.loads(self._manifest(self.version)["registry"])

    def open_schema(self) -> StoredSchema:
        self._refresh()
        return StoredSchema(self)

    def open_bulk_loader(self) -> BulkLoader:
        self._refresh()
        return BulkLoader(self)

    def index_manager(self) -> IndexManager:
        return IndexManager(self)

    def close(self) -> None:
        """Ends open sessions, without committing; nothing can begin afterwards."""
        for session in list(self._sessions):
            session.graph = None
        self._closed = True


class IndexManager:
    """Searches read the vectors themselves, so that there is nothing to save; ``rebuild`` looks at them all."""

    def __init__(self, store: GraphStore) -> None:
        self._store = store

    def save(self, key: str) -> None:
        if key not in self._store.registry.indexes:
            raise NotFound(f"property key {key!r} has no index")

    def rebuild(self, key: str) -> int:
        """The number of vectors under the index; an error if one has another dimension or a vertex of negative id."""
        self.save(key)
        vertices = self._store.open().vertices
        if key not in vertices.columns:
            return 0
        wrong = (F.size(key) != self._store.registry.indexes[key].dimension) | (F.col("id") < 0)
        n, bad = vertices.where(F.col(key).isNotNull()).agg(F.count("*"), F.count(F.when(wrong, 1))).first()
        if bad:
            raise VectorIndexError(f"{bad} vectors of {key!r} have another dimension, or negative ids")
        return n

    def save_all(self) -> None:
        for key in self._store.registry.indexes:
            self.save(key)


class StoredSchema(SchemaSession):
    def commit(self) -> None:
        super().commit()
        self._owner.declare(self._staged)

    def __enter__(self) -> StoredSchema:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.commit()


class ReadSession:
    """Traversals on the version that was the newest when the session began."""

    def __init__(self, store: GraphStore) -> None:
        self.graph: PropertyGraph | None = store.open()

    def g(self) -> Traversal:
        return Traversal(self)

    def run(self, plan: Plan, ordered: bool = False) -> Frame:
        if self.graph is None:
            raise TraversalError("the session has ended")
        if any(s.op in WRITES for s in walk(plan)):
            raise ReadOnly("a read session cannot write")
        return run(self.graph, plan, ordered)

    def close(self) -> None:
        self.graph = None

    def __enter__(self) -> ReadSession:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Transaction:
    """Reads its own writes; ``commit`` writes them as a delta or conflicts.

    The written elements, whole or marked dead, are one small frame for each part of the graph, laid
    over the version that the transaction began on.  Single writes check what they need at once; for
    many elements ``add_vertices``, ``put_vertices`` and ``add_edges`` take DataFrames and check them
    in one join.
    """

    #: Writes after which the staged frames are written out to cut their lineage.
    CUT_EVERY = 10

    def __init__(self, store: GraphStore) -> None:
        self._store, self._base = store, store.version
        self._opened = store.open(self._base)
        self.graph: PropertyGraph | None = self._opened
        self._staged: dict[str, DataFrame | None] = dict.fromkeys(KEYS)
        self._writes = 0

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if self.graph is not None:
            if kind is None:
                self.commit()
            else:
                self.rollback()

    def g(self) -> Traversal:
        return Traversal(self)

    def commit(self) -> None:
        self._open()
        if self._writes:
            folder = self._store.new_folder("delta")
            delta = {p: None if df is None else self._store._written(df, f"{folder}/{p}") for p, df in self._staged.items()}
            try:
                self._store.append(delta, self.graph.registry, self._base)
            except Conflict:
                self._store.discard(folder)
                raise
        self.graph = None

    def rollback(self) -> None:
        self.graph = None

    def _open(self) -> PropertyGraph:
        if self.graph is None:
            raise TraversalError("the transaction has ended")
        return self.graph

    def _stage(self, part: str, rows: DataFrame, dead: bool = False) -> None:
        """Rows, one a key, take the place of what is staged or stored under their keys."""
        rows, staged = rows.withColumn(DEAD, F.lit(dead)), self._staged[part]
        if staged is not None:
            staged = staged.join(rows.select(*KEYS[part]), KEYS[part], "left_anti").select(*staged.columns)
            rows = staged.unionByName(rows, allowMissingColumns=True)
        self._writes += 1
        self._staged[part] = spool(rows) if self._writes % self.CUT_EVERY == 0 else rows
        self.graph = self._opened.with_frames(*[overlay(getattr(self._opened, p), self._staged[p], p) for p in KEYS])

    # traversals with writes run step by step, at once
    def run(self, plan: Plan, ordered: bool = False) -> Frame:
        graph = self._open()
        for step in plan:
            if any(s.op in WRITES for sub in step.subs for s in walk(sub)):
                raise UnsupportedOperation("writes inside sub-traversals")
        if not any(s.op in WRITES for s in plan):
            return run(graph, plan, ordered)
        frame: Frame | None = None
        reads: list[Step] = []
        for step in plan:
            if step.op not in WRITES:
                reads.append(step)
                continue
            if reads:
                frame = Compiler(self.graph, tuple(plan)).steps(rewrite(tuple(reads)), None if reads[0].op in ("V", "E") else frame)
                reads = []
            frame = getattr(self, f"_{step.op}")(frame, step)
        return Compiler(self.graph, tuple(plan)).steps(rewrite(tuple(reads)), frame) if reads else frame

    # many elements at once
    def _declared(self, df: DataFrame, part: str) -> DataFrame:
        """A frame of new elements with its names registered and its types those of the schema; written out."""
        own, registry = (VERTEX_COLUMNS, EDGE_COLUMNS)[part == "edges"], self._open().registry
        declare_columns(registry, df, own)
        wanted = [F.col(c).cast(T.IntegerType() if c == "rank" else T.StringType() if c == "label" else T.LongType()) for c in own]
        df = spool(df.select(*wanted, *[F.col(c).cast(TYPES[registry.keys[c]]) for c in df.columns if c not in own]))
        for (label,) in df.select("label").distinct().collect():  # labels, not rows
            registry.write_label(label, part == "edges")
        for key, index in registry.indexes.items():
            if key not in df.columns:
                continue
            if part == "edges":
                raise VectorIndexError(f"the index on {key!r} is for vertices")
            if not df.where(F.col(key).isNotNull() & ((F.size(key) != index.dimension) | (F.col("id") < 0))).isEmpty():
                raise VectorIndexError(f"a vector of {key!r} has another dimension than {index.dimension}, or a negative id")
        return df

    def add_vertices(self, vertices: DataFrame) -> None:
        """New vertices (id, label, properties...)."""
        rows = self._declared(vertices, "vertices")
        if not rows.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty() or not rows.join(self.graph.vertices, "id", "left_semi").isEmpty():
            raise DuplicateVertex("an id is null, occurs more than once or exists")
        self._stage("vertices", rows)

    def put_vertices(self, vertices: DataFrame) -> None:
        """Vertices (id, label, properties...) that are added or, where the id exists, take the place of what is there."""
        rows = self._declared(vertices, "vertices")
        if not rows.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
            raise DuplicateVertex("an id is null or occurs more than once")
        self._stage("vertices", rows)

    def add_edges(self, edges: DataFrame) -> None:
        """New edges (src, label, dst, properties...), with ranks in the edge mode multi (0 where there is no such column)."""
        if "rank" not in edges.columns:
            edges = edges.withColumn("rank", F.lit(0))
        rows = self._declared(edges, "edges")
        multi = self.graph.registry.edge_mode == "multi"
        if not rows.where(f"rank IS NULL OR rank NOT BETWEEN 0 AND {MAX_RANK if multi else 0}").isEmpty():
            raise SchemaViolation(f"a rank is 0 to {MAX_RANK}, and 0 in the edge mode single")
        self._added_edges(rows)

    def _added_edges(self, new: DataFrame) -> None:
        g = self.graph
        ends = new.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.join(g.vertices, "id", "left_anti").isEmpty():
            raise NotFound("an end of the edge is no vertex")
        if not new.join(g.edges, list(EDGE_COLUMNS), "left_semi").isEmpty() or not new.groupBy(*EDGE_COLUMNS).count().where("count > 1").isEmpty():
            raise DuplicateEdge("the edge exists")
        self._stage("edges", new)

    # single writes
    def _register(self, label: str | None, props: dict[str, Any], edge: bool, vid: int | None = None) -> None:
        registry = self.graph.registry
        if label is not None:
            registry.write_label(label, edge)
        for key, value in props.items():
            registry.write_value(key, value)
            index = registry.indexes.get(key)
            if index and edge:
                raise VectorIndexError(f"the index on {key!r} is for vertices")
            if index and (len(value) != index.dimension or vid is not None and vid < 0):
                raise VectorIndexError(f"the index on {key!r} takes {index.dimension} dimensions and ids from 0 on")

    @staticmethod
    def _cell(value: Any) -> Any:
        return bytearray(value.bytes) if isinstance(value, uuid.UUID) else list(map(float, value)) if isinstance(value, (list, tuple)) else value

    def _row(self, own: dict[str, Any], props: dict[str, Any], schema: str) -> DataFrame:
        fields = list(T.StructType.fromDDL(schema).fields) + [T.StructField(k, TYPES[self.graph.registry.keys[k]]) for k in props]
        return self.graph.vertices.sparkSession.createDataFrame([tuple(own.values()) + tuple(map(self._cell, props.values()))], T.StructType(fields))

    def _addV(self, frame: Frame | None, step: Step) -> Frame:  # noqa: N802
        label, vid, props = step.args[0], step.args[1], dict(step.args[2])
        if vid is None:
            raise TraversalError("addV needs property('id', number)")
        self._register(label, props, edge=False, vid=vid)
        if not self.graph.vertices.where(F.col("id") == vid).isEmpty():
            raise DuplicateVertex(f"vertex {vid} exists")
        row = self._row({"id": vid, "label": label}, props, _VERTICES)
        self._stage("vertices", row)
        return self._elements(row.select(F.col("id").alias("v")), VERTEX)

    def _addE(self, frame: Frame | None, step: Step) -> Frame:  # noqa: N802
        label, src, dst, rank, props = *step.args[:4], dict(step.args[4])
        if src is None and dst is None or (src is None or dst is None) and (frame is None or frame.kind.name != "vertex"):
            raise TraversalError("addE needs from and to; a vertex that arrives takes the place of one of them")
        if self.graph.registry.edge_mode == "single" and rank:
            raise UnsupportedOperation("ranks need the edge mode multi")
        if not 0 <= rank <= MAX_RANK:
            raise SchemaViolation(f"a rank is 0 to {MAX_RANK}")
        self._register(label, props, edge=True)
        if src is not None and dst is not None:
            new = self._row({"src": src, "label": label, "dst": dst, "rank": rank}, props, _EDGES)
        else:
            v = F.col("v").cast("bigint")
            ends = frame.df.select((v if src is None else F.lit(src).cast("bigint")).alias("src"), F.lit(label).alias("label"), (v if dst is None else F.lit(dst).cast("bigint")).alias("dst"))
            new = ends.withColumn("rank", F.lit(rank))
            for key, value in props.items():
                one = self._row({"src": 0, "label": "", "dst": 0, "rank": 0}, {key: value}, _EDGES).first()[key]
                new = new.withColumn(key, (F.array(*map(F.lit, one)) if isinstance(one, list) else F.lit(one)).cast(TYPES[self.graph.registry.keys[key]]))
            new = spool(new)
        self._added_edges(new)
        v = F.struct(*EDGE_COLUMNS, F.lit("OUT").alias("dir")).cast(EDGE_TYPE)
        return self._elements(new.select(v.alias("v")), EDGE)

    def _elements(self, df: DataFrame, kind: Any) -> Frame:
        return Frame(self.graph, df, kind)

    def _keys_of(self, frame: Frame) -> DataFrame:
        """The distinct elements of a frame by their key columns, written out before the graph changes."""
        if frame.kind.name == "vertex":
            return spool(frame.df.select(F.col("v").alias("id")).distinct())
        return spool(frame.df.select(*[F.col(f"v.{c}").alias(c) for c in EDGE_COLUMNS]).distinct())

    def _changed(self, frame: Frame, key: str, value: Callable[[Any], Any]) -> None:
        """Set one property of a frame's elements: they are read whole and staged."""
        part = "vertices" if frame.kind.name == "vertex" else "edges"
        df, kind = getattr(self.graph, part), TYPES[self.graph.registry.keys[key]]
        rows = df.join(self._keys_of(frame), KEYS[part], "left_semi").withColumn(key, value(kind))
        self._stage(part, spool(rows))

    def _property(self, frame: Frame | None, step: Step) -> Frame:
        key, value = step.args
        if frame is None or not frame.kind.element:
            raise TraversalError("property needs a vertex or an edge")
        self._register(None, {key: value}, edge=frame.kind.name == "edge")
        cell = self._cell(value)
        column = F.array(*map(F.lit, cell)) if isinstance(cell, list) else F.lit(cell)
        kept = frame.but(df=spool(frame.df.select("v")), loaded=False, order=False, sort=(), path=False, tags={})
        self._changed(kept, key, lambda kind: column.cast(kind))
        return kept.but(graph=self.graph)

    def _drop(self, frame: Frame | None, step: Step) -> Frame:
        g = self.graph
        if frame is None:
            raise TraversalError("drop needs something to drop")
        if frame.kind.name == "vertex":
            keys = self._keys_of(frame)
            if not g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(keys, "id", "left_semi").isEmpty():
                raise IncidentEdges("a vertex with edges cannot be dropped")
            self._stage("vertices", spool(g.vertices.select("id", "label").join(keys, "id", "left_semi")), dead=True)
        elif frame.kind.name == "edge":
            self._stage("edges", spool(self._keys_of(frame).join(g.edges, list(EDGE_COLUMNS), "left_semi").select(*EDGE_COLUMNS)), dead=True)
        elif frame.kind.name == "property":
            rows = spool(frame.df.select("v.key", "v.owner").distinct())
            for (key,) in rows.select("key").distinct().collect():
                own = rows.where(F.col("key") == key).select("owner.tag", "owner.l", "owner.s")
                vertices = own.where("tag = 'v'").select(F.col("l").alias("v"))
                if not vertices.isEmpty():
                    self._changed(Frame(self.graph, vertices, VERTEX), key, lambda kind: F.lit(None).cast(kind))
                edges = own.where("tag = 'e'").select("s")
                if not edges.isEmpty():
                    self._changed(self._by_edge_id(edges), key, lambda kind: F.lit(None).cast(kind))
        else:
            raise TraversalError(f"drop does not apply to {frame.kind.name}")
        return frame.but(graph=self.graph, df=frame.df.where(F.lit(False)))

    def _by_edge_id(self, ids: DataFrame) -> Frame:
        from ..functions.values import edge_id

        g = self.graph
        own = edge_id(F.col("src"), g.label_number(F.col("label")), F.col("dst"), F.col("rank"))
        v = F.struct(*EDGE_COLUMNS, F.lit("OUT").alias("dir")).cast(EDGE_TYPE)
        return Frame(g, g.edges.withColumn("s", own).join(ids, "s", "left_semi").select(v.alias("v")), EDGE)
