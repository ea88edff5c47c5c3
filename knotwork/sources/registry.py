"""The schema of a graph: labels, property keys with one type each, modes and vector indexes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import SchemaConflict, SchemaViolation, VectorIndexError
from ..functions.values import TYPES, type_of_literal

#: Keys that name an element's own parts.
RESERVED = ("id", "label", "rank")
METRICS = ("cosine", "euclidean", "dot")


@dataclass(frozen=True)
class VectorIndex:
    """What a vector property holds and how it compares; searches are exact, so kind and knobs have no effect on results."""

    key: str
    dimension: int
    metric: str = "cosine"
    kind: str = "hnsw"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50


@dataclass
class Registry:
    """Label numbers are dense from 1 in order of registration; vertex and edge labels are apart."""

    mode: str = "auto"
    edge_mode: str = "single"
    vertex_labels: list[str] = field(default_factory=list)
    edge_labels: list[str] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, VectorIndex] = field(default_factory=dict)
    version: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "strict"):
            raise SchemaViolation(f"schema mode {self.mode!r} is neither auto nor strict")
        if self.edge_mode not in ("single", "multi"):
            raise SchemaViolation(f"edge mode {self.edge_mode!r} is neither single nor multi")

    def copy(self) -> Registry:
        return replace(
            self, vertex_labels=list(self.vertex_labels), edge_labels=list(self.edge_labels), keys=dict(self.keys), indexes=dict(self.indexes)
        )

    def merged(self, other: Registry) -> Registry:
        """This schema with what the other declares besides; modes and indexes of the newer version."""
        out, newer = self.copy(), other if other.version > self.version else self
        for label in other.vertex_labels:
            out.add_vertex_label(label)
        for label in other.edge_labels:
            out.add_edge_label(label)
        for key, kind in other.keys.items():
            out.add_property_key(key, kind)
        return replace(out, mode=newer.mode, edge_mode=newer.edge_mode, indexes=dict(newer.indexes), version=newer.version)

    # names
    def label_id(self, label: str) -> int:
        """Number of an edge label; -1 if there is none."""
        return self.edge_labels.index(label) + 1 if label in self.edge_labels else -1

    def edge_label(self, number: int) -> str | None:
        return self.edge_labels[number - 1] if 0 < number <= len(self.edge_labels) else None

    def type_of(self, key: str) -> T.DataType | None:
        return TYPES[self.keys[key]] if key in self.keys else None

    def check_label(self, label: str, edge: bool) -> None:
        """In strict mode a query may only name what is declared."""
        if self.mode == "strict" and label not in (self.edge_labels if edge else self.vertex_labels):
            raise SchemaViolation(f"{'edge' if edge else 'vertex'} label {label!r} is not declared")

    def check_key(self, key: str) -> None:
        if key in RESERVED:
            raise SchemaViolation(f"{key!r} is reserved; there are steps of that name")
        if self.mode == "strict" and key not in self.keys:
            raise SchemaViolation(f"property key {key!r} is not declared")

    # declarations
    def add_vertex_label(self, label: str) -> None:
        if label not in self.vertex_labels:
            self.vertex_labels.append(label)

    def add_edge_label(self, label: str) -> None:
        if label not in self.edge_labels:
            self.edge_labels.append(label)

    def add_property_key(self, key: str, kind: str) -> None:
        if key in RESERVED:
            raise SchemaViolation(f"{key!r} is reserved")
        if kind not in TYPES:
            raise SchemaViolation(f"{kind!r} is no value type; {', '.join(TYPES)} are")
        if self.keys.setdefault(key, kind) != kind:
            raise SchemaConflict(f"property key {key!r} has type {self.keys[key]}, not {kind}")

    def set_edge_mode(self, mode: str) -> None:
        if mode not in ("single", "multi"):
            raise SchemaViolation(f"edge mode {mode!r} is neither single nor multi")
        if self.edge_mode == "multi" and mode == "single":
            raise SchemaConflict("the edge mode goes from single to multi only")
        self.edge_mode = mode

    def add_vector_index(self, index: VectorIndex) -> None:
        if index.metric not in METRICS or index.dimension < 1:
            raise VectorIndexError(f"metric must be one of {METRICS} and the dimension positive")
        if self.keys.get(index.key, "float_vector") != "float_vector":
            raise SchemaConflict(f"property key {index.key!r} holds no vectors")
        if index.key in self.indexes:
            raise SchemaConflict(f"property key {index.key!r} has an index already")
        self.keys.setdefault(index.key, "float_vector")
        self.indexes[index.key] = index

    def drop_vector_index(self, key: str) -> None:
        if self.indexes.pop(key, None) is None:
            raise VectorIndexError(f"property key {key!r} has no index")

    # writes
    def write_label(self, label: str, edge: bool) -> None:
        self.check_label(label, edge)
        (self.add_edge_label if edge else self.add_vertex_label)(label)

    def write_value(self, key: str, value: Any) -> None:
        """Register the key with the value's type, or see that the value has the key's."""
        if key in RESERVED:
            raise SchemaViolation(f"{key!r} cannot be written as a property")
        if key not in self.keys:
            self.check_key(key)
            self.keys[key] = type_of_literal(value)
            return
        given, known = type_of_literal(value), self.keys[key]
        fits = given == known or (given, known) in {("int32", "int64"), ("int32", "uint16"), ("float64", "float32")}
        if not fits or known == "uint16" and not 0 <= value <= 65_535:
            raise SchemaViolation(f"property {key!r} has type {known}, not {given}")

    # persistence
    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Registry:
        raw = json.loads(text)
        raw["indexes"] = {k: VectorIndex(**v) for k, v in raw["indexes"].items()}
        return cls(**raw)


class SchemaSession:
    """Stages declarations and commits them at once, unless the schema has moved on since."""

    def __init__(self, owner: Any) -> None:
        self._owner, self._base, self._staged = owner, owner.registry.version, owner.registry.copy()

    def __getattr__(self, name: str) -> Any:
        if name not in {"add_vertex_label", "add_edge_label", "add_property_key", "set_edge_mode", "add_vector_index", "drop_vector_index"}:
            raise AttributeError(name)

        def staged(*args: Any, **options: Any) -> SchemaSession:
            getattr(self._staged, name)(*args, **options)
            return self

        return staged

    def set_schema_mode(self, mode: str) -> SchemaSession:
        if mode not in ("auto", "strict"):
            raise SchemaViolation(f"schema mode {mode!r} is neither auto nor strict")
        self._staged.mode = mode
        return self

    def commit(self) -> None:
        if self._owner.registry.version != self._base:
            raise SchemaConflict("the schema changed since this session began")
        self._staged.version = self._base + 1
        self._owner.registry = self._staged
