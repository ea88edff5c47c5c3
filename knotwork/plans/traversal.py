"""The fluent, immutable traversal builder and the anonymous builder ``__``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from ..errors import TraversalError
from ..functions.predicates import P, only, predicate
from .steps import WRITES, Plan, Step, walk

if TYPE_CHECKING:
    from ..operators.frame import Frame

DIRECTIONS = ("out", "in", "both")


class Traversal:
    """A chain of steps.  Every method returns a new traversal; terminals need a source."""

    def __init__(self, source: Any = None, steps: Plan = (), keys: tuple[str, ...] | None = None) -> None:
        self._source, self._steps, self._keys = source, steps, keys

    def _add(self, op: str, *args: Any, subs: tuple[Plan, ...] = ()) -> Traversal:
        return type(self)(self._source, (*self._steps, Step(op, args, subs)), self._keys)

    def _replace(self, step: Step) -> Traversal:
        return type(self)(self._source, (*self._steps[:-1], step), self._keys)

    @property
    def steps(self) -> Plan:
        for step in self._steps:
            if step.op == "repeat" and not (step.args[0] or step.args[1]):
                raise TraversalError("repeat needs times or until behind it")
        return self._steps

    @staticmethod
    def _sub(t: Traversal, what: str) -> Plan:
        if not isinstance(t, Traversal):
            raise TraversalError(f"{what} takes a traversal")
        return t.steps

    # sources
    def V(self, *ids: Any) -> Traversal:  # noqa: N802
        return self._add("V", *_listed(ids))

    def E(self, *keys: Any) -> Traversal:  # noqa: N802
        return self._add("E", *_listed(keys))

    # adjacency
    def out(self, *labels: Any) -> Traversal:
        return self._add("out", *_listed(labels))

    def in_(self, *labels: Any) -> Traversal:
        return self._add("in", *_listed(labels))

    def both(self, *labels: Any) -> Traversal:
        return self._add("both", *_listed(labels))

    def outE(self, *labels: Any) -> Traversal:  # noqa: N802
        return self._add("outE", *_listed(labels))

    def inE(self, *labels: Any) -> Traversal:  # noqa: N802
        return self._add("inE", *_listed(labels))

    def bothE(self, *labels: Any) -> Traversal:  # noqa: N802
        return self._add("bothE", *_listed(labels))

    def outV(self) -> Traversal:  # noqa: N802
        return self._add("outV")

    def inV(self) -> Traversal:  # noqa: N802
        return self._add("inV")

    def otherV(self) -> Traversal:  # noqa: N802
        return self._add("otherV")

    def degree(self, direction: str = "both") -> Traversal:
        name = str(getattr(direction, "name", direction)).lower()
        if name not in DIRECTIONS:
            raise TraversalError(f"direction {direction!r} is none of {DIRECTIONS}")
        return self._add("degree", name, ())

    # filters
    def has(self, *args: Any) -> Traversal:
        """has(key), has(key, value or predicate) or has(label, key, value or predicate)"""
        if len(args) == 1:
            return self._add("has_key", args[0])
        if len(args) == 3:
            return self.hasLabel(args[0]).has(*args[1:])
        if len(args) != 2:
            raise TraversalError("has takes one to three arguments")
        key, p = args[0], predicate(args[1])
        if key == "id":
            return self.hasId(p)
        if key == "label":
            return self.hasLabel(p)
        return self._add("has", key, p)

    def hasLabel(self, *labels: Any) -> Traversal:  # noqa: N802
        p = labels[0] if len(labels) == 1 and isinstance(labels[0], P) else P("within", _listed(labels))
        return self._add("hasLabel", only(p, "eq", "ne", "within", "without"))

    def hasId(self, *ids: Any) -> Traversal:  # noqa: N802
        return self._add("hasId", predicate(ids[0] if len(ids) == 1 else list(ids)))

    def hasRank(self, value: Any) -> Traversal:  # noqa: N802
        return self._add("hasRank", predicate(value))

    def is_(self, value: Any) -> Traversal:
        return self._add("is", predicate(value))

    def where(self, t: Traversal) -> Traversal:
        sub = self._sub(t, "where")
        if not sub:
            raise TraversalError("where needs a step")
        return self._add("where", subs=(sub,))

    def not_(self, t: Traversal) -> Traversal:
        return self._add("not", subs=(self._sub(t, "not_"),))

    def and_(self, *ts: Traversal) -> Traversal:
        return self._add("and", subs=tuple(self._sub(t, "and_") for t in ts))

    def or_(self, *ts: Traversal) -> Traversal:
        return self._add("or", subs=tuple(self._sub(t, "or_") for t in ts))

    def simplePath(self) -> Traversal:  # noqa: N802
        return self._add("simplePath")

    def cyclicPath(self) -> Traversal:  # noqa: N802
        return self._add("cyclicPath")

    # projections
    def values(self, *keys: Any) -> Traversal:
        return self._add("values", *_listed(keys))

    def properties(self, *keys: Any) -> Traversal:
        return self._add("properties", *_listed(keys))

    def id(self) -> Traversal:
        return self._add("id")

    def label(self) -> Traversal:
        return self._add("label")

    def rank(self) -> Traversal:
        return self._add("rank")

    def constant(self, value: Any) -> Traversal:
        return self._add("constant", value)

    def identity(self) -> Traversal:
        return self._add("identity")

    def unfold(self) -> Traversal:
        return self._add("unfold")

    def path(self) -> Traversal:
        return self._add("path")

    def as_(self, *labels: str) -> Traversal:
        if not labels:
            raise TraversalError("as_ needs a label")
        return self._add("as", *labels)

    def select(self, *labels: str) -> Traversal:
        """The nearest earlier value that carries the label; of several labels the first that is found."""
        if not labels:
            raise TraversalError("select needs a label")
        return self._add("select", *labels)

    # barriers
    def count(self) -> Traversal:
        return self._add("count")

    def sum(self) -> Traversal:
        return self._add("sum")

    def mean(self) -> Traversal:
        return self._add("mean")

    def max(self) -> Traversal:
        return self._add("max")

    def min(self) -> Traversal:
        return self._add("min")

    def fold(self) -> Traversal:
        return self._add("fold")

    def dedup(self) -> Traversal:
        return self._add("dedup")

    def group(self) -> Traversal:
        return self._add("group", None)

    def groupCount(self) -> Traversal:  # noqa: N802
        return self._add("groupCount", None)

    def order(self) -> Traversal:
        return self._add("order", ())

    def order_by(self, key: str, direction: str = "asc") -> Traversal:
        return self.order().by(key, direction)

    def by(self, key: str, order: Any = "asc") -> Traversal:
        """A sort key behind ``order`` or the key property behind ``group`` and ``groupCount``."""
        last = self._steps[-1] if self._steps else None
        if last is None or last.op not in ("order", "group", "groupCount"):
            raise TraversalError("by follows order, group or groupCount")
        if last.op != "order":
            if last.args[0] is not None:
                raise TraversalError(f"{last.op} takes one by")
            return self._replace(Step(last.op, (key,)))
        name = str(getattr(order, "name", order)).lower()
        if name not in ("asc", "desc"):
            raise TraversalError(f"order {order!r} is neither asc nor desc")
        return self._replace(Step("order", (((*last.args[0], (key, name))),)))

    def limit(self, n: int) -> Traversal:
        return self._add("limit", _size(n))

    def range(self, low: int, high: int) -> Traversal:
        if low < 0:
            raise TraversalError("a range begins at 0 or later")
        return self._add("range", low, _size(high))

    def skip(self, n: int) -> Traversal:
        if n < 0:
            raise TraversalError("skip takes 0 or more")
        return self._add("skip", n)

    def tail(self, n: int = 1) -> Traversal:
        return self._add("tail", _size(n))

    # branches
    def union(self, *ts: Traversal) -> Traversal:
        return self._add("union", subs=tuple(self._sub(t, "union") for t in ts))

    def coalesce(self, *ts: Traversal) -> Traversal:
        return self._add("coalesce", subs=tuple(self._sub(t, "coalesce") for t in ts))

    def choose(self, condition: Traversal, yes: Traversal, no: Traversal | None = None) -> Traversal:
        subs = [self._sub(condition, "choose"), self._sub(yes, "choose"), (Step("identity"),) if no is None else self._sub(no, "choose")]
        return self._add("choose", subs=tuple(subs))

    def local(self, t: Traversal) -> Traversal:
        return self._add("local", subs=(self._sub(t, "local"),))

    def repeat(self, t: Traversal) -> Traversal:
        """args: times, whether until is set, emit (None, "all" or "if"); subs: body, until, emit condition"""
        return self._add("repeat", None, False, None, subs=(self._sub(t, "repeat"), (), ()))

    def _repeating(self, what: str) -> Step:
        last = self._steps[-1] if self._steps else None
        if last is None or last.op != "repeat":
            raise TraversalError(f"{what} follows repeat")
        return last

    def times(self, n: int) -> Traversal:
        last = self._repeating("times")
        if n < 1 or last.args[0] or last.args[1]:
            raise TraversalError("times takes 1 or more, once, and not with until")
        return self._replace(Step("repeat", (n, False, last.args[2]), last.subs))

    def until(self, t: Traversal) -> Traversal:
        last = self._repeating("until")
        if last.args[0] or last.args[1]:
            raise TraversalError("until stands once and not with times")
        return self._replace(Step("repeat", (None, True, last.args[2]), (last.subs[0], self._sub(t, "until"), last.subs[2])))

    def emit(self, t: Traversal | None = None) -> Traversal:
        last = self._repeating("emit")
        if last.args[2]:
            raise TraversalError("emit stands once")
        if t is None:
            return self._replace(Step("repeat", (*last.args[:2], "all"), last.subs))
        return self._replace(Step("repeat", (*last.args[:2], "if"), (*last.subs[:2], self._sub(t, "emit"))))

    emit_if = emit

    # vectors
    def nearest(self, key: str, query: list[float], k: int) -> Traversal:
        if k < 1:
            raise TraversalError("nearest takes 1 or more")
        return self._add("nearest", key, tuple(map(float, query)), k)

    def with_ef_search(self, ef: int) -> Traversal:
        """A recall knob of approximate searches; searches are exact here."""
        if not self._steps or self._steps[-1].op != "nearest":
            raise TraversalError("with_ef_search follows nearest")
        return self

    def similarity(self, key: str, query: list[float]) -> Traversal:
        return self._add("similarity", key, tuple(map(float, query)))

    def neighbors(self, key: str, k: int) -> Traversal:
        """Extension: for each element the k other elements of the graph with the most similar vectors."""
        if k < 1:
            raise TraversalError("neighbors takes 1 or more")
        return self._add("neighbors", key, k)

    # writes
    def addV(self, label: str, vid: int | None = None) -> Traversal:  # noqa: N802
        return self._add("addV", label, vid, ())

    def addE(self, label: str) -> Traversal:  # noqa: N802
        return self._add("addE", label, None, None, 0, ())

    def from_(self, vertex: Any) -> Traversal:
        return self._end(1, vertex, "from_")

    def to(self, vertex: Any) -> Traversal:
        return self._end(2, vertex, "to")

    def _end(self, at: int, vertex: Any, what: str) -> Traversal:
        last = self._steps[-1] if self._steps else None
        if last is None or last.op != "addE":
            raise TraversalError(f"{what} follows addE")
        if last.args[at] is not None:
            raise TraversalError(f"{what} stands once")
        args = list(last.args)
        args[at] = int(getattr(vertex, "id", vertex))
        return self._replace(Step("addE", tuple(args)))

    def property(self, key: str, value: Any) -> Traversal:
        last = self._steps[-1] if self._steps else None
        if key == "label":
            raise TraversalError("a label cannot be changed")
        if last is not None and last.op == "addV":
            if key == "id":
                return self._replace(Step("addV", (last.args[0], int(value), last.args[2])))
            return self._replace(Step("addV", (*last.args[:2], (*last.args[2], (key, value)))))
        if last is not None and last.op == "addE":
            if key == "rank":
                return self._replace(Step("addE", (*last.args[:3], int(value), last.args[4])))
            return self._replace(Step("addE", (*last.args[:4], (*last.args[4], (key, value)))))
        if key in ("id", "rank"):
            raise TraversalError(f"{key} can be set right behind the adding step only")
        return self._add("property", key, value)

    def drop(self) -> Traversal:
        return self._add("drop")

    # results
    def withProperties(self, *keys: Any) -> Traversal:  # noqa: N802
        """Which properties result elements carry: all without arguments; without this step none."""
        return type(self)(self._source, self._steps, _listed(keys))

    def _frame(self, ordered: bool = False) -> Frame:
        if self._source is None:
            raise TraversalError("an anonymous traversal has no results of its own")
        return self._source.run(self.steps, ordered)

    def writes(self) -> bool:
        return any(s.op in WRITES for s in walk(self.steps))

    def to_df(self) -> DataFrame:
        """The result as a flat DataFrame; nothing runs before an action."""
        return self._frame().flat(self._keys)

    def to_list(self) -> list[Any]:
        """All results as Python objects in emission order."""
        return list(self.iter())

    def iter(self) -> Iterator[Any]:
        return self._frame(ordered=True).objects(self._keys)

    def next(self) -> Any:
        """The first result, or None."""
        return next(self._frame(ordered=True).objects(self._keys, first=True), None)

    def to_set(self) -> set[Any]:
        return set(self._frame().objects(self._keys))

    def iterate(self) -> None:
        """Run for the effects only."""
        frame = self._frame()
        if not self.writes():
            frame.df.foreach(lambda _: None)

    def explain(self) -> str:
        """The steps, as rewritten, and Spark's plan."""
        from .rewrite import rewrite

        steps = "\n".join(map(str, rewrite(self.steps)))
        df = self.to_df()
        return f"{steps}\n{df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"


def _listed(items: tuple) -> tuple:
    return tuple(items[0]) if len(items) == 1 and isinstance(items[0], (list, tuple, set, frozenset)) else items


def _size(n: int) -> int:
    if n < -1:
        raise TraversalError("a size is 0 or more, or -1 for no bound")
    return n


class _Anonymous:
    """``__.out("knows")`` begins an anonymous traversal with any step."""

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(Traversal(), name)


__ = _Anonymous()
