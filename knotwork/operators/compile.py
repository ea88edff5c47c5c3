"""Steps as DataFrame transformations.

Adjacency is an equi-join of the traversers' vertex with one end of the edges, a filter a ``where``, a
filtering sub-traversal a semi or anti join.  A sub-traversal's result depends on the injected value only
(with its path or labels where it reads them), so it is computed once for each distinct value, which every
row of the sub-traversal carries as ``__scope``, and joined back; barriers inside group by the scope.  A
sub-traversal without barriers that is to be flattened needs no scope at all and continues the outer frame.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TraversalError, UnexpectedDataType, UnsupportedOperation, VectorIndexError
from ..functions.predicates import P, compiled, predicate
from ..functions.values import ANY, class_of, decode_edge_id, edge_id, literal, to_any
from ..plans.rewrite import rewrite
from ..plans.steps import BARRIERS, FILTERS, ORDERED, PATHED, Plan, Step, walk
from ..sources.graph import PropertyGraph
from ..sources.spool import read, spool, write
from . import vector
from .frame import EDGE, EDGE_TYPE, LABEL, MIXED, PATH, PREFIX, VERTEX, Frame, Kind, is_number, scalar

#: Passes of a repeat after which the lineage is cut.
CUT_EVERY = 8


def run(graph: PropertyGraph, plan: Plan, ordered: bool = False) -> Frame:
    """The frame of a whole traversal; ``ordered`` asks for the emission order even if no step needs it."""
    plan = rewrite(plan)
    return Compiler(graph, plan, ordered).steps(plan, None)


class Compiler:
    def __init__(self, graph: PropertyGraph, plan: Plan, ordered: bool = False) -> None:
        self.graph = graph
        self.order = ordered or any(s.op in ORDERED for s in walk(plan))
        self.path = any(s.op in PATHED for s in walk(plan))

    def steps(self, plan: Plan, frame: Frame | None) -> Frame:
        for step in plan:
            if frame is None and step.op not in ("V", "E"):
                raise TraversalError(f"a traversal begins with V or E, not {step.op}")
            frame = getattr(self, f"_{step.op}")(frame, step)
        if frame is None:
            raise TraversalError("a traversal needs a step")
        return frame

    # shared pieces

    def _labels(self, step: Step) -> tuple[str, ...]:
        for label in step.args:
            self.graph.registry.check_label(label, edge=True)
        return step.args

    def _moved(self, frame: Frame, df: DataFrame, kind: Kind, loaded: bool = False) -> Frame:
        """A frame with a new value in v: the path grows by it."""
        out = frame.but(df=df, kind=kind, loaded=loaded)
        if frame.path:
            item = F.struct(out.as_any().alias("obj"), F.array().cast("array<string>").alias("labels"))
            out = out.but(df=df.withColumn("__path", F.concat("__path", F.array(item))))
        return out

    def _grown(self, *parts: Column) -> list[Column]:
        """The emission order with more components, if it is tracked."""
        return [F.concat("__ord", F.array(*[p.cast("bigint") for p in parts])).alias("__ord")] if self.order else []

    def _keep(self, frame: Frame, *less: str) -> list[Column]:
        return [F.col(c) for c in frame.carried if c not in less]

    def _need(self, frame: Frame, step: Step, *names: str) -> None:
        if frame.kind.name not in names:
            raise UnexpectedDataType(f"{step.op} applies to {' or '.join(names)}, not {frame.kind.name}")

    def _none(self, frame: Frame) -> Frame:
        return frame.but(df=frame.df.where(F.lit(False)))

    def _sealed(self, frame: Frame) -> Frame:
        """Sort columns become one position, so that they can follow an outer order.

        Inside a scope rows are numbered by scope.  Outside, a global sort deals them to ranges, and a
        row's position is that of its range and within it; the frame is written out, so that all who
        read it see the same positions.
        """
        if not frame.sort:
            return frame
        own = [c for c, _ in frame.sort]
        if frame.scope:
            n = F.row_number().over(Window.partitionBy("__scope").orderBy(*frame.sort_columns()))
            return frame.but(df=frame.df.withColumn("__ord", F.array(n.cast("bigint"))).drop(*own), sort=())
        if not frame.order:
            return frame.but(df=frame.df.drop(*own), sort=())
        placed = frame.df.orderBy(*frame.sort_columns()).withColumn("__ord", F.array(F.monotonically_increasing_id())).drop(*own)
        return frame.but(df=spool(placed), sort=())

    # sources

    def _source(self, df: DataFrame, kind: Kind, position: list[Column], frame: Frame | None) -> Frame:
        cols = [F.array(*[p.cast("bigint") for p in position]).alias("__ord")] if self.order else []
        scope = frame is not None and frame.scope
        if scope:
            cols.append(F.col("__scope"))
        if self.path:
            cols.append(F.array().cast(PATH.type).alias("__path"))
        props = [c for c in df.columns if c.startswith(PREFIX)]
        out = df.select("v", *props, *cols)
        base = Frame(self.graph, out, kind, order=self.order, path=self.path, scope=scope, scopes=frame.scopes if scope else None)
        return self._moved(base, out, kind, loaded=True)

    def _V(self, frame: Frame | None, step: Step) -> Frame:  # noqa: N802
        g = self.graph
        ids = [int(getattr(i, "id", i)) for i in step.args]
        cols = [F.col("id").alias("v"), F.col("label").alias(LABEL), *[F.col(k).alias(PREFIX + k) for k in g.vertex_keys]]
        if frame is not None and frame.scope:
            if not ids:
                raise UnsupportedOperation("V without ids inside a sub-traversal would pair every traverser with every vertex")
            each = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(i).cast("bigint").alias("__want")) for p, i in enumerate(ids)]))
            asked = frame.scopes.select("__scope", each.alias("x")).select("__scope", "x.pos", "x.__want")
            return self._source(asked.join(g.vertices, F.col("__want") == F.col("id")).select("__scope", "pos", *cols), VERTEX, [F.col("pos")], frame)
        if not ids:
            return self._source(g.vertices.select(*cols), VERTEX, [F.col("v")], frame)
        if len(set(ids)) == len(ids) and not self.order:
            return self._source(g.vertices.where(F.col("id").isin(*ids)).select(*cols), VERTEX, [F.col("v")], frame)
        asked = g.vertices.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, __want long")
        found = g.vertices.where(F.col("id").isin(*set(ids))).join(F.broadcast(asked), F.col("id") == F.col("__want"))
        return self._source(found.select("pos", *cols), VERTEX, [F.col("pos")], frame)

    def _E(self, frame: Frame | None, step: Step) -> Frame:  # noqa: N802
        g = self.graph
        v = F.struct("src", "label", "dst", "rank", F.lit("OUT").alias("dir")).cast(EDGE_TYPE).alias("v")
        cols = [v, F.col("label").alias(LABEL), *[F.col(k).alias(PREFIX + k) for k in g.edge_keys]]
        if frame is not None and frame.scope:
            raise UnsupportedOperation("E inside a sub-traversal")
        if not step.args:
            df = g.edges.select(*cols)
            return self._source(df, EDGE, [F.col("v.src"), g.label_number(F.col("v.label")), F.col("v.dst"), F.col("v.rank")], frame)
        asked = [(p, *key) for p, text in enumerate(step.args) if (key := decode_edge_id(text)) and g.registry.edge_label(key[1])]
        asked = [(p, s, g.registry.edge_label(n), d, r) for p, s, n, d, r in asked]
        wanted = g.edges.sparkSession.createDataFrame(asked, "pos long, __s long, __l string, __d long, __r int")
        match = (F.col("src") == F.col("__s")) & (F.col("label") == F.col("__l")) & (F.col("dst") == F.col("__d")) & (F.col("rank") == F.col("__r"))
        return self._source(g.edges.join(F.broadcast(wanted), match).select("pos", *cols), EDGE, [F.col("pos")], frame)

    # adjacency

    def _expand(self, frame: Frame, step: Step, direction: str, edges: bool) -> Frame:
        self._need(frame, step, "vertex")
        side = self.graph.adjacency(direction, self._labels(step))
        df = frame.df.select("v", *self._keep(frame)).join(side, F.col("v") == F.col("a"))
        return self._arrived(frame, df, direction, edges, bool(step.args))

    def _arrived(self, frame: Frame, df: DataFrame, direction: str, edges: bool, named: bool) -> Frame:
        way = (F.col("dir") == "IN").cast("int")
        parts = [F.col("lp"), F.col("b"), F.col("rank")]
        if direction == "both":  # by label, out before in; without labels all out before all in
            parts = [F.col("lp"), way, *parts[1:]] if named else [way, *parts]
        rest = [c for c in self._keep(frame) if not self.order or c._jc.toString() != "__ord"]
        rest += self._grown(*parts)
        if not edges:
            return self._moved(frame, df.select(F.col("b").alias("v"), *rest), VERTEX)
        v = F.struct("src", "label", "dst", "rank", "dir").cast(EDGE_TYPE).alias("v")
        props = [F.col("label").alias(LABEL), *[F.col(k).alias(PREFIX + k) for k in self.graph.edge_keys]]
        return self._moved(frame, df.select(v, *props, *rest), EDGE, loaded=True)

    def _out(self, f: Frame, s: Step) -> Frame:
        return self._expand(f, s, "out", False)

    def _in(self, f: Frame, s: Step) -> Frame:
        return self._expand(f, s, "in", False)

    def _both(self, f: Frame, s: Step) -> Frame:
        return self._expand(f, s, "both", False)

    def _outE(self, f: Frame, s: Step) -> Frame:  # noqa: N802
        return self._expand(f, s, "out", True)

    def _inE(self, f: Frame, s: Step) -> Frame:  # noqa: N802
        return self._expand(f, s, "in", True)

    def _bothE(self, f: Frame, s: Step) -> Frame:  # noqa: N802
        return self._expand(f, s, "both", True)

    def _to_end(self, frame: Frame, step: Step, end: Column) -> Frame:
        self._need(frame, step, "edge")
        return self._moved(frame, frame.df.select(end.alias("v"), *self._keep(frame)), VERTEX)

    def _outV(self, f: Frame, s: Step) -> Frame:  # noqa: N802
        return self._to_end(f, s, F.col("v.src"))

    def _inV(self, f: Frame, s: Step) -> Frame:  # noqa: N802
        return self._to_end(f, s, F.col("v.dst"))

    def _otherV(self, f: Frame, s: Step) -> Frame:  # noqa: N802
        return self._to_end(f, s, F.when(F.col("v.dir") == "OUT", F.col("v.dst")).otherwise(F.col("v.src")))

    def _degree(self, frame: Frame, step: Step) -> Frame:
        self._need(frame, step, "vertex")
        direction, labels = step.args
        for label in labels:
            self.graph.registry.check_label(label, edge=True)
        counts = self.graph.degrees(direction, labels)
        df = frame.df.join(counts, F.col("v") == F.col("a"), "left")
        return self._moved(frame, df.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("v"), *self._keep(frame)), scalar(T.LongType()))

    # filters

    def _condition(self, frame: Frame, step: Step) -> tuple[Frame, Column]:
        """A filter step as a condition on a frame that has the columns for it; never null."""
        kind, p = frame.kind, predicate(step.args[-1]) if step.op != "has_key" else None
        false = F.lit(False)
        if step.op in ("has", "has_key"):
            key = step.args[0]
            self.graph.registry.check_key(key)
            if not kind.element:
                return frame, false
            frame = frame.load()
            if not frame.has_key(key):
                return frame, false
            c = F.col(PREFIX + key)
            return frame, c.isNotNull() if p is None else compiled(p, c, frame.df.schema[PREFIX + key].dataType)
        if step.op == "hasLabel":
            for label in p.operands:
                self.graph.registry.check_label(label, edge=kind.name == "edge")
            if not kind.element:
                return frame, false
            frame = frame.load() if kind.name == "vertex" else frame
            return frame, compiled(p, F.col(LABEL) if kind.name == "vertex" else F.col("v.label"), T.StringType())
        if step.op == "hasId":
            if kind.name == "vertex":
                p = P(p.op, tuple(getattr(x, "id", x) for x in p.operands))
                return frame, compiled(p, F.col("v"), T.LongType())
            if kind.name != "edge":
                return frame, false
            if p.op not in ("eq", "ne", "within", "without"):
                raise UnsupportedOperation(f"hasId({p.op}) on edges")
            same = false
            for text in p.operands:
                key = decode_edge_id(text)
                label = self.graph.registry.edge_label(key[1]) if key else None
                if label:
                    same = same | ((F.col("v.src") == key[0]) & (F.col("v.label") == label) & (F.col("v.dst") == key[2]) & (F.col("v.rank") == key[3]))
            return frame, same if p.op in ("eq", "within") else ~same
        if step.op == "hasRank":
            return frame, compiled(p, F.col("v.rank"), T.IntegerType()) if kind.name == "edge" else false
        if kind.name != "scalar":
            return frame, false
        return frame, compiled(p, F.col("v"), kind.type)

    def _boolean(self, frame: Frame, plan: Plan) -> tuple[Frame, Column] | None:
        """A sub-plan that only looks at the value, as one condition."""
        if not plan:
            return None
        parts = []
        for step in plan:
            if step.op in FILTERS:
                frame, c = self._condition(frame, step)
            elif step.op in ("and", "or", "not") and step.subs:
                inner = []
                for sub in step.subs:
                    if (got := self._boolean(frame, sub)) is None:
                        return None
                    frame = got[0]
                    inner.append(got[1])
                c = ~inner[0] if step.op == "not" else reduce((lambda a, b: a & b) if step.op == "and" else (lambda a, b: a | b), inner)
            else:
                return None
            parts.append(c)
        return frame, reduce(lambda a, b: a & b, parts)

    def _filter(self, frame: Frame, step: Step) -> Frame:
        frame, c = self._condition(frame, step)
        return frame.but(df=frame.df.where(c))

    _has = _has_key = _hasLabel = _hasId = _hasRank = _is = _filter

    def _where(self, frame: Frame, step: Step) -> Frame:
        return self._exists(frame, step.subs[0])

    def _not(self, frame: Frame, step: Step) -> Frame:
        return self._exists(frame, step.subs[0], anti=True)

    def _and(self, frame: Frame, step: Step) -> Frame:
        return reduce(self._exists, step.subs, frame)

    def _or(self, frame: Frame, step: Step) -> Frame:
        found = [self._boolean(frame, s) for s in step.subs]
        if found and all(found):
            loaded = frame
            conditions = []
            for sub in step.subs:
                loaded, c = self._boolean(loaded, sub)
                conditions.append(c)
            return loaded.but(df=loaded.df.where(reduce(lambda a, b: a | b, conditions)))
        if not step.subs:
            return self._none(frame)
        keys = [self._matches(frame, s) for s in step.subs]
        return self._semi(frame, step.subs, reduce(DataFrame.unionByName, keys), "left_semi")

    def _exists(self, frame: Frame, plan: Plan, anti: bool = False) -> Frame:
        """Traversers for which the sub-traversal gives something (or, anti, nothing)."""
        if not plan:
            return self._none(frame) if anti else frame
        if (got := self._boolean(frame, plan)) is not None:
            return got[0].but(df=got[0].df.where(~got[1] if anti else got[1]))
        return self._semi(frame, (plan,), self._matches(frame, plan), "left_anti" if anti else "left_semi")

    def _semi(self, frame: Frame, plans: tuple[Plan, ...], keys: DataFrame, how: str) -> Frame:
        own = self._scope_value(frame, tuple(s for p in plans for s in p))
        return frame.but(df=frame.df.join(keys, own.eqNullSafe(F.col("__key")), how))

    def _matches(self, frame: Frame, plan: Plan) -> DataFrame:
        """Scopes for which a sub-plan has results, as column __key; from the edges themselves where that will do."""
        first = plan[0]
        direct = {"out": "out", "in": "in", "both": "both", "outE": "out", "inE": "in", "bothE": "both"}.get(first.op)
        plain = not any(s.op in BARRIERS or s.op in ("select", "degree", "V", "E") for s in walk(plan)) and not self.path
        if direct and plain and frame.kind.name == "vertex" and not any(s.op in ("local", "union", "coalesce", "choose", "repeat") for s in walk(plan)):
            side = self.graph.adjacency(direct, self._labels(first))
            df = side.withColumn("__scope", F.col("a"))
            if self.order:
                df = df.withColumn("__ord", F.array().cast("array<bigint>"))
            start = Frame(self.graph, df.select("a", *(["__ord"] if self.order else []), "__scope").withColumnRenamed("a", "v"), VERTEX, order=self.order, scope=True)
            found = self.steps(plan[1:], self._arrived(start, df, direct, first.op.endswith("E"), bool(first.args)))
        else:
            found = self._sub(frame, plan)
        return found.df.select(F.col("__scope").alias("__key"))

    # sub-traversals

    def _scope_value(self, frame: Frame, plan: Plan) -> Column:
        """What a sub-plan's result depends on: the value, and the path or labels if it reads them."""
        parts = [F.col("v")]
        if self.path:
            parts.append(F.col("__path"))
        if any(s.op == "select" for s in walk(plan)):
            parts += [F.col(c) for c, _ in frame.tags.values()]
        return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])

    def _sub(self, frame: Frame, plan: Plan, body: Callable[[Frame], Frame] | None = None) -> Frame:
        """The frame of a sub-plan over the distinct values of an outer frame."""
        tags = frame.tags if any(s.op == "select" for s in walk(plan)) else {}
        scope = self._scope_value(frame, plan)
        own = ["v", *(["__path"] if self.path else []), *[c for c, _ in tags.values()]]
        df = frame.df.select(*own).distinct().withColumn("__scope", scope)
        scopes = df.select("__scope")
        if self.order:
            df = df.withColumn("__ord", F.array().cast("array<bigint>"))
        inner = Frame(self.graph, df, frame.kind, order=self.order, path=self.path, tags=dict(tags), scope=True, scopes=scopes)
        return body(inner) if body else self.steps(plan, inner)

    def _joined(self, frame: Frame, sub: Frame, plan: Plan, branch: int | None = None) -> Frame:
        """The results of a sub-frame for every outer traverser."""
        sub = self._sealed(self._nested(sub))
        new_tags = {k: t for k, t in sub.tags.items() if k not in frame.tags}
        inner = [F.col("v").alias("__new"), F.col("__scope").alias("__key"), *[F.col(c) for c, _ in new_tags.values()]]
        inner += [F.col("__ord").alias("__more")] if self.order else []
        inner += [F.col("__path").alias("__newpath")] if self.path else []
        props = [c for c in sub.df.columns if c.startswith(PREFIX)]
        own = frame.df.withColumn("__own", self._scope_value(frame, plan)).drop(*[c for c in frame.df.columns if c.startswith(PREFIX)])
        df = own.join(sub.df.select(*inner, *props), F.col("__own").eqNullSafe(F.col("__key")))
        df = df.withColumn("v", F.col("__new"))
        if self.order:
            df = df.withColumn("__ord", F.concat("__ord", *([F.array(F.lit(branch).cast("bigint"))] if branch is not None else []), "__more"))
        if self.path:
            df = df.withColumn("__path", F.col("__newpath"))
        df = df.drop("__own", "__new", "__key", "__more", "__newpath")
        return frame.but(df=df, kind=sub.kind, loaded=sub.loaded, tags=frame.tags | new_tags)

    def _needs_scope(self, plan: Plan) -> bool:
        return any(s.op in BARRIERS or s.op in ("V", "E") for s in plan)

    def _flat(self, frame: Frame, plan: Plan, branch: int | None = None) -> Frame:
        """A sub-plan's results for every traverser of the outer frame."""
        if self._needs_scope(plan):
            return self._joined(frame, self._sub(frame, plan), plan, branch)
        if branch is not None and self.order:
            frame = frame.but(df=frame.df.withColumn("__ord", F.concat("__ord", F.array(F.lit(branch).cast("bigint")))))
        return self.steps(plan, frame)

    def _nested(self, frame: Frame) -> Frame:
        """A map as a value instead of rows of keys and values."""
        if frame.kind.name != "map" or "key" not in frame.df.columns:
            return frame
        by = ["__scope"] if frame.scope else []
        entry = F.struct(*(["__first"] if self.order else []), "key", "value")
        items = F.array_sort(F.collect_list(entry)) if self.order else F.collect_list(entry)
        items = F.transform(items, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
        df = frame.df.groupBy(*by).agg(items.alias("v"))
        empty = F.array().cast(frame.kind.type)
        if frame.scope:
            df = frame.scopes.withColumnRenamed("__scope", "__s").join(df, F.col("__s").eqNullSafe(F.col("__scope")), "left").select(F.coalesce("v", empty).alias("v"), F.col("__s").alias("__scope"))
        return self._after_barrier(frame.but(df=df), df, frame.kind)

    def _merged(self, frames: list[Frame]) -> Frame:
        """The union of frames; values of different kinds become tagged."""
        frames = [self._sealed(self._nested(f)) if len(frames) > 1 else f for f in frames]
        first = frames[0]
        kind = first.kind
        if any(f.kind != kind for f in frames):
            both = [f.kind for f in frames]
            if all(k.name == "scalar" and k.type != ANY and class_of(k.type) == class_of(kind.type) and class_of(k.type) in ("int", "float") for k in both):
                wide = T.LongType() if class_of(kind.type) == "int" else T.DoubleType()
                frames = [f.but(df=f.df.withColumn("v", F.col("v").cast(wide)), kind=scalar(wide)) for f in frames]
                kind = scalar(wide)
            else:
                frames = [f.but(df=f.df.select(f.as_any().alias("v"), *self._keep(f)), kind=MIXED, loaded=False) for f in frames]
                kind = MIXED
        loaded = all(f.loaded for f in frames) and kind.element
        if not loaded:
            frames = [f.but(df=f.df.drop(*[c for c in f.df.columns if c.startswith(PREFIX)])) for f in frames]
        tags = reduce(lambda a, b: a | b, [f.tags for f in frames])
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df for f in frames])
        return first.but(df=df, kind=kind, loaded=loaded, tags=tags, sort=() if len(frames) > 1 else first.sort)

    def _union(self, frame: Frame, step: Step) -> Frame:
        if not step.subs:
            return self._none(frame)
        return self._merged([self._flat(frame, sub, i) for i, sub in enumerate(step.subs)])

    def _local(self, frame: Frame, step: Step) -> Frame:
        return self._flat(frame, step.subs[0])

    def _coalesce(self, frame: Frame, step: Step) -> Frame:
        out, rest = [], frame
        for i, sub in enumerate(step.subs):
            out.append(self._flat(rest, sub))
            if i + 1 < len(step.subs):
                rest = self._exists(rest, sub, anti=True)
        return self._merged(out) if out else self._none(frame)

    def _choose(self, frame: Frame, step: Step) -> Frame:
        condition, yes, no = step.subs
        return self._merged([self._flat(self._exists(frame, condition), yes), self._flat(self._exists(frame, condition, anti=True), no)])

    def _repeat(self, frame: Frame, step: Step) -> Frame:
        body = step.subs[0]
        if any(s.op in BARRIERS for s in walk(body)):  # per start and depth
            return self._joined(frame, self._sub(frame, body + step.subs[1] + step.subs[2], lambda f: self._loop(f, step)), body + step.subs[1] + step.subs[2])
        if not step.args[1]:
            return self._loop(frame, step)
        settled = self._settled(tuple(s for sub in step.subs for s in sub))
        return self._followed(frame, step, settled) or self._loop(frame, step, settled)

    def _repeat_count(self, frame: Frame, step: Step) -> Frame:
        """A repeat as numbers of results that ``total`` adds up; those of a start are counted before they meet their traversers."""
        plan = tuple(s for sub in step.subs for s in sub)
        if self.order or self.path or not any(s.op in BARRIERS for s in walk(step.subs[0])):
            return self._scalar(self._nested(self._repeat(frame, step)), F.lit(1).cast("bigint"), T.LongType())
        return self._joined(frame, self._sub(frame, plan, lambda f: self._loop(f, step, count=True)), plan)

    def _alike(self, now: Frame, members: DataFrame | None) -> tuple[Frame, DataFrame | None]:
        """Scopes whose (distinct) vertices are the same go on as one, as their steps give the same from there.

        Also the table (__member, __scope) of the starting scopes by those that go on.  Hashes of the sets say which
        may be alike, the sets themselves decide.
        """
        rows = spool(now.df.select("__scope", "v"))
        sums = [F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), *[F.bit_xor(F.xxhash64(F.lit(i), "v")).alias(f"h{i}") for i in (0, 1)]]
        marks = spool(rows.groupBy("__scope").agg(*sums))
        same = ["n", "low", "high", "h0", "h1"]
        firsts = marks.groupBy(*same).agg(F.min("__scope").alias("__first"))
        if 2 * firsts.count() > marks.count():
            return now.but(df=rows, loaded=False), members
        pairs = spool(marks.join(firsts, same).select(F.col("__scope").alias("__s"), "__first", "n"))
        # up to two vertices are all in the marks
        asked = pairs.where("n > 2 AND __s <> __first").join(rows, F.col("__s") == F.col("__scope")).select("__s", "__first", "v")
        held = rows.select(F.col("__scope").alias("__h"), F.col("v").alias("__v"))
        wrong = asked.join(held, (F.col("__first") == F.col("__h")) & (F.col("v") == F.col("__v")), "left_anti").select(F.col("__s").alias("__w")).distinct()
        pairs = pairs.join(wrong, F.col("__s") == F.col("__w"), "left")
        pairs = spool(pairs.select("__s", F.when(F.col("__w").isNull(), F.col("__first")).otherwise(F.col("__s")).alias("__to")))
        kept = rows.join(pairs.where("__s = __to").select("__s"), F.col("__scope") == F.col("__s"), "left_semi")
        if members is None:
            members = pairs.select(F.col("__s").alias("__member"), F.col("__to").alias("__scope"))
        else:
            members = members.join(pairs, F.col("__scope") == F.col("__s")).select("__member", F.col("__to").alias("__scope"))
        return now.but(df=kept, loaded=False), members

    def _followed(self, frame: Frame, step: Step, settled: Compiler) -> Frame | None:
        """An ``until`` over one adjacency step with filters, where no vertex has two ways on, by doubling.

        Every vertex's way to the vertex where it stops doubles in length each round, so that the rounds
        are the logarithm of the longest way.  A way that ends without a stop gives nothing.
        """
        (_, until, emit), (body, stop, _) = step.args, step.subs
        plain = body and body[0].op in ("out", "in", "both") and all(s.op in FILTERS for s in body[1:])
        if not until or emit or not plain or self.order or self.path or frame.kind.name != "vertex":
            return None
        direction = body[0].op
        side = settled.graph.adjacency(direction, self._labels(body[0]))
        if not side.groupBy("a").count().where("count > 1").isEmpty():
            return None
        frame = self._sealed(frame)
        start = Frame(self.graph, side.select(F.col("a").alias("v"), F.col("a").alias("__a")), VERTEX)
        moved = self.steps(body[1:], self._arrived(start, side.withColumn("__a", F.col("a")), direction, False, bool(body[0].args)))
        if (got := self._boolean(moved, stop)) is None:
            return None
        ways = spool(got[0].df.select("__a", F.col("v").alias("__z"), got[1].alias("__stop")))
        last, ended, long = ways, ways.where("__stop"), 1
        while not (going := last.where("NOT __stop")).isEmpty():
            if long >= self.graph.max_iterations and long >= ways.count():  # longer than all edges: a circle
                if not frame.df.join(going, F.col("v") == F.col("__a"), "left_semi").isEmpty():
                    raise TraversalError(f"repeat did not end within {long} passes")
                break
            on = ended.unionByName(going).select(F.col("__a").alias("__b"), F.col("__z").alias("__y"), F.col("__stop").alias("__s"))
            last = spool(going.join(on, F.col("__z") == F.col("__b")).select("__a", F.col("__y").alias("__z"), F.col("__s").alias("__stop")))
            ended, long = ended.unionByName(last.where("__stop")), 2 * long
        found = frame.df.select("v", *self._keep(frame)).join(ended.select("__a", "__z"), F.col("v") == F.col("__a"))
        return self._moved(frame, found.select(F.col("__z").alias("v"), *self._keep(frame)), VERTEX)

    def _loop(self, frame: Frame, step: Step, settled: Compiler | None = None, count: bool = False) -> Frame:
        (times, until, emit), (body, stop, condition) = step.args, step.subs
        frame = self._sealed(frame)
        out: list[Frame] = []
        given: dict[Any, tuple[Frame, list[str]]] = {}
        start = None
        if self.order:  # emitted by start, then depth
            start = "__start"
            frame = frame.but(df=frame.df.withColumn(start, F.col("__ord")).withColumn("__ord", F.array().cast("array<bigint>")))
        now, depth = frame, 0
        members = None
        set_wise = body[-1:] and body[-1].op == "dedup" and frame.scope and not self.order and not self.path and frame.df.schema["__scope"].dataType == T.LongType()
        inner = settled or (self._settled(body + stop + condition) if until else self)

        def give(f: Frame) -> None:
            if start:
                f = f.but(df=f.df.withColumn("__ord", F.concat(start, F.array(F.lit(depth).cast("bigint")), "__ord")).drop(start))
            if count:
                f = f.but(df=f.df.groupBy("__scope").agg(F.count("*").alias("v")), kind=scalar(T.LongType()), loaded=False, tags={})
            if members is not None:
                f = f.but(df=f.df.join(members.withColumnRenamed("__scope", "__s"), F.col("__scope") == F.col("__s")).withColumn("__scope", F.col("__member")).drop("__member", "__s"))
            if until:  # there may be many passes
                kept = f.bare()
                given.setdefault((f.kind, kept.schema.json()), (f.but(df=kept, loaded=False, graph=self.graph), []))[1].append(write(kept))
            else:
                out.append(f)

        while True:
            if depth and set_wise and now.kind == VERTEX and now.carried == ["__scope"]:
                now, members = self._alike(now, members)
            depth += 1
            if now.scope:
                now = now.but(scopes=now.df.select("__scope").distinct())
            before = now.df.select("__scope", start).distinct() if start and now.scope else None
            now = self._sealed(self._nested(inner.steps(body, now)))
            if start and start not in now.df.columns:  # a barrier dropped it
                now = now.but(df=now.df.join(before.withColumnRenamed("__scope", "__s"), F.col("__scope").eqNullSafe(F.col("__s"))).drop("__s"))
            if times and depth == times:
                give(now)
                break
            if until:
                got = inner._boolean(now, stop) or (now, None)
                now = got[0] if got[1] is None else got[0].but(df=got[0].df.withColumn("__stop", got[1]))
                now = now.but(df=spool(now.bare()), loaded=False)
                if got[1] is None:
                    give(inner._exists(now, stop))
                    now = inner._exists(now, stop, anti=True)
                    now = now.but(df=spool(now.bare()), loaded=False)
                else:
                    give(now.but(df=now.df.where("__stop").drop("__stop")))
                    now = now.but(df=now.df.where("NOT __stop").drop("__stop"))
            if emit:
                give(inner._exists(now, condition) if emit == "if" else now)
            if not until and depth % CUT_EVERY == 0:
                now = now.but(df=spool(now.df))
            if until:
                if now.df.isEmpty():
                    break
                if depth >= self.graph.max_iterations:
                    raise TraversalError(f"repeat did not end within {depth} passes")
        return self._merged(out + [f.but(df=read(f.df, *paths)) for f, paths in given.values()])

    def _settled(self, plan: Plan) -> Compiler:
        """A compiler that reads the edges which the passes of a loop follow from files, so that they are not made again each time."""
        steps = [s for s in walk(plan) if s.op in ("out", "in", "both", "outE", "inE", "bothE", "degree")]
        asked = [s.args[1] if s.op == "degree" else s.args for s in steps]
        if not steps or any(s.op == "E" for s in walk(plan)):
            return self
        edges = self.graph.edges
        if all(asked):
            edges = edges.where(F.col("label").isin(*sorted({x for labels in asked for x in labels})))
        if not any(s.op.endswith("E") for s in steps):
            edges = edges.select("src", "label", "dst", "rank")
        out = copy.copy(self)
        out.graph = self.graph.with_frames(edges=spool(edges))
        return out

    # labels and paths

    def _as(self, frame: Frame, step: Step) -> Frame:
        df, tags = frame.df, dict(frame.tags)
        for label in step.args:
            name = f"__t_{label}"
            df = df.withColumn(name, F.struct(F.col("v").alias("v"), *([F.size("__path").alias("n")] if frame.path else [])))
            tags[label] = (name, frame.kind)
        if frame.path:
            last = F.element_at("__path", -1)
            labelled = F.struct(last["obj"].alias("obj"), F.array(*[F.lit(x) for x in step.args]).alias("labels"))
            df = df.withColumn("__path", F.concat(F.slice("__path", F.lit(1), F.size("__path") - 1), F.array(labelled)))
        return frame.but(df=df, tags=tags)

    def _select(self, frame: Frame, step: Step) -> Frame:
        label = next((x for x in step.args if x in frame.tags), None)
        if label is None:
            return self._none(frame)
        name, kind = frame.tags[label]
        df = frame.df.drop(*[c for c in frame.df.columns if c.startswith(PREFIX)]).where(F.col(name).isNotNull())
        if frame.path:
            df = df.withColumn("__path", F.slice("__path", F.lit(1), F.col(name)["n"]))
        return frame.but(df=df.withColumn("v", F.col(name)["v"]), kind=kind, loaded=False)

    def _path(self, frame: Frame, step: Step) -> Frame:
        return frame.but(df=frame.df.select(F.col("__path").alias("v"), *self._keep(frame)), kind=PATH, loaded=False)

    def _vertices_of_path(self) -> Column:
        return F.transform(F.filter("__path", lambda x: x["obj"]["tag"] == "v"), lambda x: x["obj"]["l"])

    def _simplePath(self, frame: Frame, step: Step) -> Frame:  # noqa: N802
        own = self._vertices_of_path()
        return frame.but(df=frame.df.where(F.size(F.array_distinct(own)) == F.size(own)))

    def _cyclicPath(self, frame: Frame, step: Step) -> Frame:  # noqa: N802
        own = self._vertices_of_path()
        return frame.but(df=frame.df.where(F.size(F.array_distinct(own)) < F.size(own)))

    # projections

    def _keys(self, frame: Frame, step: Step) -> list[str]:
        self._need(frame, step, "vertex", "edge")
        for key in step.args:
            self.graph.registry.check_key(key)
        return list(step.args) or (self.graph.vertex_keys if frame.kind.name == "vertex" else self.graph.edge_keys)

    def _values(self, frame: Frame, step: Step) -> Frame:
        keys = self._keys(frame, step)
        frame = frame.load()
        keys = [k for k in keys if frame.has_key(k)]
        if not keys:
            return self._moved(self._none(frame), frame.df.where(F.lit(False)).select(F.lit(None).cast("string").alias("v"), *self._keep(frame)), scalar(T.StringType()))
        types = [frame.df.schema[PREFIX + k].dataType for k in keys]
        if len(keys) == 1:
            c = F.col(PREFIX + keys[0])
            return self._moved(frame, frame.df.where(c.isNotNull()).select(c.alias("v"), *self._keep(frame)), scalar(types[0]))
        same = all(t == types[0] for t in types)
        cols = [F.col(PREFIX + k) if same else to_any(F.col(PREFIX + k), t) for k, t in zip(keys, types, strict=True)]
        kind = scalar(types[0]) if same else MIXED
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("x")) for i, c in enumerate(cols)]))
        df = frame.df.select(each.alias("__x"), *self._keep(frame)).where("__x.x IS NOT NULL")
        return self._moved(frame, df.select(F.col("__x.x").alias("v"), *self._keep(frame, "__ord"), *self._grown(F.col("__x.i"))), kind)

    def _properties(self, frame: Frame, step: Step) -> Frame:
        keys = self._keys(frame, step)
        frame = frame.load()
        keys = [k for k in keys if frame.has_key(k)]
        item = [
            F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), to_any(F.col(PREFIX + k), frame.df.schema[PREFIX + k].dataType).alias("value")) for i, k in enumerate(keys)
        ]
        empty = "array<struct<i:int,key:string,value:struct<tag:string,l:bigint,d:double,s:string>>>"
        df = frame.df.select(frame.as_any().alias("__o"), F.explode(F.array(*item) if item else F.array().cast(empty)).alias("__x"), *self._keep(frame)).where("__x.value IS NOT NULL")
        v = F.struct(F.col("__o").alias("owner"), F.col("__x.key").alias("key"), F.col("__x.value").alias("value"))
        df = df.select(v.alias("v"), *self._keep(frame, "__ord"), *self._grown(F.col("__x.i")))
        return self._moved(frame, df, Kind("property", df.schema["v"].dataType))

    def _scalar(self, frame: Frame, value: Column, kind: T.DataType) -> Frame:
        return self._moved(frame, frame.df.select(value.alias("v"), *self._keep(frame)), scalar(kind))

    def _id(self, frame: Frame, step: Step) -> Frame:
        self._need(frame, step, "vertex", "edge")
        if frame.kind.name == "vertex":
            return self._scalar(frame, F.col("v"), T.LongType())
        e = F.col("v")
        return self._scalar(frame, edge_id(e["src"], self.graph.label_number(e["label"]), e["dst"], e["rank"]), T.StringType())

    def _label(self, frame: Frame, step: Step) -> Frame:
        self._need(frame, step, "vertex", "edge")
        if frame.kind.name == "edge":
            return self._scalar(frame, F.col("v.label"), T.StringType())
        return self._scalar(frame.load(), F.col(LABEL), T.StringType())

    def _rank(self, frame: Frame, step: Step) -> Frame:
        self._need(frame, step, "edge")
        return self._scalar(frame, F.col("v.rank"), T.IntegerType())

    def _constant(self, frame: Frame, step: Step) -> Frame:
        value = step.args[0]
        df = frame.df.select((F.lit(None).cast("string") if value is None else literal(value)).alias("v"), *self._keep(frame))
        return self._moved(frame, df, scalar(df.schema["v"].dataType))

    def _identity(self, frame: Frame, step: Step) -> Frame:
        return frame

    def _unfold(self, frame: Frame, step: Step) -> Frame:
        frame = self._nested(frame)
        if frame.kind.name != "list":
            return frame
        df = frame.df.select(F.posexplode("v").alias("__i", "__x"), *self._keep(frame))
        return self._moved(frame, df.select(F.col("__x").alias("v"), *self._keep(frame, "__ord"), *self._grown(F.col("__i"))), frame.kind.inner)

    # barriers

    def _after_barrier(self, frame: Frame, df: DataFrame, kind: Kind) -> Frame:
        """A frame of barrier results (v, and __scope inside a sub-traversal): order, path and labels begin anew."""
        if self.order:
            df = df.withColumn("__ord", F.array().cast("array<bigint>"))
        if self.path:
            nested = frame.scope and isinstance(df.schema["__scope"].dataType, T.StructType) and "c1" in df.schema["__scope"].dataType.names
            df = df.withColumn("__path", F.col("__scope.c1") if nested else F.array().cast(PATH.type))
        out = Frame(self.graph, df, kind, order=self.order, path=self.path, scope=frame.scope, scopes=frame.scopes)
        return self._moved(out, df, kind)

    def _aggregated(self, frame: Frame, value: Column, empty: Column, kind: Kind) -> Frame:
        """One row in all, or one for each scope; a scope without input has the value of an empty input."""
        if not frame.scope:
            df = frame.df.agg(value.alias("v"))
        else:
            df = frame.df.groupBy("__scope").agg(value.alias("v"), F.lit(True).alias("__some"))
            scopes = frame.scopes.select(F.col("__scope").alias("__s"))
            df = scopes.join(df, F.col("__s").eqNullSafe(F.col("__scope")), "left")
            df = df.select(F.when(F.col("__some"), F.col("v")).otherwise(empty).alias("v"), F.col("__s").alias("__scope"))
        return self._after_barrier(frame, df, kind)

    def _count(self, frame: Frame, step: Step) -> Frame:
        if frame.kind.name == "map":
            frame = self._nested(frame)
        return self._aggregated(frame, F.count(F.lit(1)), F.lit(0).cast("bigint"), scalar(T.LongType()))

    def _total(self, frame: Frame, step: Step) -> Frame:
        """The sum of counts: 0 without input."""
        return self._aggregated(frame, F.coalesce(F.sum("v"), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"), scalar(T.LongType()))

    def _reduced(self, frame: Frame, ints: Callable[[Column], Column], floats: Callable[[Column], Column]) -> Frame:
        if not is_number(frame.kind):
            kind = scalar(T.DoubleType())
            none = F.lit(None).cast("double")
            return self._aggregated(frame, F.max(none), none, kind)
        v = F.col("v")
        if frame.kind.type == ANY:
            number = F.when(v["tag"] == "i", v["l"].cast("double")).when(v["tag"] == "f", v["d"])
            whole = F.when(v["tag"] == "i", v["l"])
            mixed = F.count(F.when(v["tag"] == "f", 1)) > 0
            none = F.lit(None)

            def tagged(tag: str, part: Column, is_int: bool) -> Column:
                value = F.struct(F.lit(tag).alias("tag"), (part if is_int else none).cast("bigint").alias("l"), (none if is_int else part).cast("double").alias("d"), none.cast("string").alias("s"))
                return F.when(part.isNotNull(), value)

            found = F.when(mixed, tagged("f", floats(number), False)).otherwise(tagged("i", ints(whole), True))
            return self._aggregated(frame, found, none.cast(ANY), MIXED)
        if class_of(frame.kind.type) == "int":
            return self._aggregated(frame, ints(v.cast("bigint")), F.lit(None).cast("bigint"), scalar(T.LongType()))
        return self._aggregated(frame, floats(v.cast("double")), F.lit(None).cast("double"), scalar(T.DoubleType()))

    def _sum(self, frame: Frame, step: Step) -> Frame:
        return self._reduced(frame, F.sum, F.sum)

    def _max(self, frame: Frame, step: Step) -> Frame:
        return self._reduced(frame, F.max, lambda c: F.max(F.nanvl(c, F.lit(None))))

    def _min(self, frame: Frame, step: Step) -> Frame:
        return self._reduced(frame, F.min, lambda c: F.min(F.nanvl(c, F.lit(None))))

    def _mean(self, frame: Frame, step: Step) -> Frame:
        if not is_number(frame.kind):
            return self._sum(frame, step)
        v = F.col("v")
        number = F.when(v["tag"] == "i", v["l"].cast("double")).when(v["tag"] == "f", v["d"]) if frame.kind.type == ANY else v.cast("double")
        return self._aggregated(frame, F.avg(number), F.lit(None).cast("double"), scalar(T.DoubleType()))

    def _listed(self, frame: Frame, value: Column) -> Column:
        """The values of a group as a list in emission order, sort columns first."""
        own = [F.col(c).alias(f"s{i}") for i, (c, _) in enumerate(frame.sort)]
        items = F.collect_list(F.struct(*own, F.col("__ord").alias("o"), value.alias("x")))

        def compared(a: Column, b: Column) -> Column:
            out = F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
            for i, (_, way) in reversed(list(enumerate(frame.sort))):
                x, y = a[f"s{i}"], b[f"s{i}"]
                first, last = (x < y, x > y) if way == "asc" else (x > y, x < y)
                # nulls are last in both directions
                out = F.when(x.isNull() & y.isNotNull(), 1).when(x.isNotNull() & y.isNull(), -1).when(first, -1).when(last, 1).otherwise(out)
            return out

        items = F.array_sort(items, compared) if frame.sort else F.array_sort(items)
        return F.transform(items, lambda x: x["x"])

    def _fold(self, frame: Frame, step: Step) -> Frame:
        frame = self._nested(frame)
        kind = Kind("list", T.ArrayType(frame.kind.type), frame.kind)
        return self._aggregated(frame, self._listed(frame, F.col("v")), F.array().cast(kind.type), kind)

    def _first(self, frame: Frame) -> Column | None:
        """What says which group was emitted first, if an aggregation can: the least of the sort columns and the order."""
        parts = []
        for name, way in frame.sort:
            kind = frame.df.schema[name].dataType
            if way == "desc" and not isinstance(kind, T.NumericType):
                return None
            parts += [F.col(name).isNull(), F.col(name) if way == "asc" else -F.col(name).cast("double" if isinstance(kind, T.FractionalType) else "decimal(38,0)")]
        return F.min(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)], F.col("__ord").alias("o")) if parts else F.col("__ord"))

    def _grouped(self, frame: Frame, step: Step, count: bool) -> Frame:
        if self.order and self._first(frame) is None:
            frame = self._sealed(frame)
        by = step.args[0]
        if by is not None:
            self.graph.registry.check_key(by)
            self._need(frame, step, "vertex", "edge")
            frame = frame.load()
            if not frame.has_key(by):
                df, key_kind, key = frame.df.where(F.lit(False)), scalar(T.StringType()), F.lit(None).cast("string")
            else:
                key_kind, key = scalar(frame.df.schema[PREFIX + by].dataType), F.col(PREFIX + by)
                df = frame.df.where(key.isNotNull())
        else:
            key_kind, key, df = frame.kind, self._canonical(frame), frame.df
        scope = ["__scope"] if frame.scope else []
        value = F.count(F.lit(1)) if count else self._listed(frame, F.col("v"))
        first = [self._first(frame).alias("__first")] if self.order else []
        df = df.groupBy(*scope, key.alias("key")).agg(value.alias("value"), *first)
        inner = scalar(T.LongType()) if count else Kind("list", T.ArrayType(frame.kind.type), frame.kind)
        entry = T.ArrayType(T.StructType([T.StructField("key", key_kind.type), T.StructField("value", inner.type)]))
        return Frame(self.graph, df, Kind("map", entry, inner, key_kind), scope=frame.scope, scopes=frame.scopes)

    def _group(self, frame: Frame, step: Step) -> Frame:
        return self._grouped(frame, step, False)

    def _groupCount(self, frame: Frame, step: Step) -> Frame:  # noqa: N802
        return self._grouped(frame, step, True)

    def _canonical(self, frame: Frame) -> Column:
        """The value by which traversers are equal: an edge without the direction it was met in."""
        v = F.col("v")
        if frame.kind.name != "edge":
            return v
        return F.struct(v["src"].alias("src"), v["label"].alias("label"), v["dst"].alias("dst"), v["rank"].alias("rank"), F.lit("OUT").alias("dir"))

    def _dedup(self, frame: Frame, step: Step) -> Frame:
        frame = self._nested(frame)
        scope = ["__scope"] if frame.scope else []
        df = frame.df.withColumn("__same", self._canonical(frame))
        if frame.sort:
            n = F.row_number().over(Window.partitionBy(*scope, "__same").orderBy(*frame.sort_columns()))
            df = df.withColumn("__n", n).where("__n = 1").drop("__n")
        elif frame.order:
            rest = [c for c in df.columns if c not in ("__same", *scope)]
            best = F.min_by(F.struct(*rest), F.col("__ord")).alias("__best")
            df = df.groupBy(*scope, "__same").agg(best).select(*scope, *[F.col("__best")[c].alias(c) for c in rest])
        else:
            df = df.dropDuplicates([*scope, "__same"])
        return frame.but(df=df.drop("__same"))

    def _order(self, frame: Frame, step: Step) -> Frame:
        frame = self._nested(frame)
        keys = step.args[0]
        for key, _ in keys:
            self.graph.registry.check_key(key)
        cols: list[tuple[Column, str]] = []
        if keys:
            frame = frame.load()
            cols = [(F.col(PREFIX + k), way) for k, way in keys if frame.has_key(k)]
        elif frame.kind.name == "vertex" or frame.kind.name == "scalar" and frame.kind.type != ANY:
            cols = [(F.col("v"), "asc")]
        elif frame.kind.type == ANY:
            cols = [(F.coalesce(F.col("v.l").cast("double"), F.col("v.d")), "asc"), (F.col("v.s"), "asc")]
        at = len(frame.sort)
        df, new = frame.df, []
        for i, (c, way) in enumerate(cols):
            name = f"__k{at + i}"
            df = df.withColumn(name, c)
            new.append((name, way))
        return frame.but(df=df, sort=(*new, *frame.sort))

    def _numbered(self, frame: Frame) -> Frame:
        n = F.row_number().over(Window.partitionBy("__scope").orderBy(*frame.sort_columns()))
        return frame.but(df=frame.df.withColumn("__n", n))

    def _cut(self, frame: Frame, low: int, high: int) -> Frame:
        """Traversers low to high - 1 in emission order; high -1: to the end."""
        frame = self._nested(frame)
        if frame.scope:
            out = self._numbered(frame)
            c = F.col("__n") > low
            return out.but(df=out.df.where(c if high < 0 else c & (F.col("__n") <= high)).drop("__n"))
        if high >= 0:
            high = max(low, high)
            df = frame.df.orderBy(*frame.sort_columns())
            return frame.but(df=(df.offset(low) if low else df).limit(high - low))
        if not low:
            return frame
        # without an upper bound: all but the first, which are few and found without one task for all rows
        first = frame.df.orderBy(*frame.sort_columns()).limit(low).select(F.col("__ord").alias("__o"))
        return frame.but(df=frame.df.join(first, F.col("__ord") == F.col("__o"), "left_anti"))

    def _limit(self, frame: Frame, step: Step) -> Frame:
        return self._cut(frame, 0, step.args[0])

    def _range(self, frame: Frame, step: Step) -> Frame:
        return self._cut(frame, *step.args)

    def _skip(self, frame: Frame, step: Step) -> Frame:
        return self._cut(frame, step.args[0], -1)

    def _tail(self, frame: Frame, step: Step) -> Frame:
        n = step.args[0]
        frame = self._nested(frame)
        if n < 0:
            return frame
        back = frame.sort_columns(reverse=True)
        if frame.scope:
            k = F.row_number().over(Window.partitionBy("__scope").orderBy(*back))
            return frame.but(df=frame.df.withColumn("__n", k).where(F.col("__n") <= n).drop("__n"))
        return frame.but(df=frame.df.orderBy(*back).limit(n))

    # vectors

    def _measured(self, frame: Frame, step: Step) -> tuple[Frame, Column]:
        key, query = step.args[0], step.args[1]
        self._need(frame, step, "vertex", "edge")
        self.graph.registry.check_key(key)
        frame = frame.load()
        if not frame.has_key(key):
            return self._none(frame), F.lit(None).cast("double")
        index = self.graph.registry.indexes.get(key)
        if index and frame.kind.name == "edge":
            raise VectorIndexError(f"the index on {key!r} is for vertices")
        c = F.col(PREFIX + key)
        vector.check(index, len(query))
        return frame.but(df=frame.df.where(c.isNotNull())), vector.similarity(c, list(query), index.metric if index else "cosine")

    def _nearest(self, frame: Frame, step: Step) -> Frame:
        k = step.args[2]
        frame, measure = self._measured(frame, step)
        name = f"__k{len(frame.sort)}"
        df = frame.df.withColumn(name, measure).withColumn("__tie", F.col("v"))
        by = [F.col(name).desc_nulls_last(), F.col("__tie").asc_nulls_last()]
        if frame.scope:
            df = df.withColumn("__n", F.row_number().over(Window.partitionBy("__scope").orderBy(*by))).where(F.col("__n") <= k).drop("__n")
        else:
            df = df.orderBy(*by).limit(k)
        return frame.but(df=df, sort=((name, "desc"), ("__tie", "asc"), *frame.sort))

    def _similarity(self, frame: Frame, step: Step) -> Frame:
        frame, measure = self._measured(frame, step)
        return self._moved(frame, frame.df.select(measure.cast("float").alias("v"), *self._keep(frame)), scalar(T.FloatType()))

    def _neighbors(self, frame: Frame, step: Step) -> Frame:
        key, k = step.args
        self._need(frame, step, "vertex")
        self.graph.registry.check_key(key)
        if key not in self.graph.vertex_keys:
            return self._none(frame)
        index = self.graph.registry.indexes.get(key)
        every = self.graph.vertices.where(F.col(key).isNotNull()).select(F.col("id"), F.col(key).alias("x"))
        asked = frame.df.select(F.col("v").alias("id")).distinct().join(every, "id")
        near = vector.neighbors(asked, every, k, index.metric if index else "cosine")
        df = frame.df.select("v", *self._keep(frame)).join(near.withColumnRenamed("id", "__i"), F.col("v") == F.col("__i"))
        return self._moved(frame, df.select(F.col("other").alias("v"), *self._keep(frame, "__ord"), *self._grown(F.col("n"))), VERTEX)
