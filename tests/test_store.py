"""Transactions, schema sessions and bulk loading."""

import pytest

from knotwork.errors import (
    Conflict,
    DuplicateEdge,
    DuplicateVertex,
    IncidentEdges,
    IncompleteLoad,
    NotFound,
    ReadOnly,
    SchemaConflict,
    SchemaViolation,
    TraversalError,
    UnsupportedOperation,
    VectorIndexError,
)
from knotwork.functions.predicates import P
from knotwork.plans.traversal import __
from knotwork.sources.registry import VectorIndex
from knotwork.sources.store import GraphStore


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/graph")


def test_writes_are_read_back_and_committed(store):
    with store.begin() as t:
        t.g().addV("person").property("id", 1).property("name", "ann").property("age", 30).iterate()
        t.g().addV("person").property("id", 2).property("name", "bob").iterate()
        t.g().addE("knows").from_(1).to(2).property("since", 2001).iterate()
        assert t.g().V(1).out("knows").values("name").to_list() == ["bob"]
        t.g().V(2).property("age", 41).iterate()
    with store.read() as r:
        assert sorted(r.g().V().values("age").to_list()) == [30, 41]
        assert r.g().E().values("since").to_list() == [2001]
        with pytest.raises(ReadOnly):
            r.g().V(1).drop().iterate()
    with store.begin() as t:
        with pytest.raises(IncidentEdges):
            t.g().V(2).drop().iterate()
        t.g().V(1).outE("knows").drop().iterate()
        t.g().V(2).drop().iterate()
        t.g().V(1).properties("age").drop().iterate()
        assert t.g().V().withProperties().to_list()[0].properties == {"name": "ann"}


def test_edges_from_arriving_vertices(store):
    with store.begin() as t:
        for i in (1, 2, 3):
            t.g().addV("n").property("id", i).iterate()
        t.g().V(1, 2).addE("to").to(3).property("w", 0.5).iterate()
        assert t.g().V(3).in_("to").id().to_set() == {1, 2}
        assert t.g().E().values("w").to_list() == [0.5, 0.5]


def test_integrity(store):
    t = store.begin()
    t.g().addV("n").property("id", 1).iterate()
    with pytest.raises(DuplicateVertex):
        t.g().addV("n").property("id", 1).iterate()
    with pytest.raises(NotFound):
        t.g().addE("e").from_(1).to(9).iterate()
    t.g().addE("e").from_(1).to(1).iterate()
    with pytest.raises(DuplicateEdge):
        t.g().addE("e").from_(1).to(1).iterate()
    with pytest.raises(UnsupportedOperation):
        t.g().addE("e").from_(1).to(1).property("rank", 1).iterate()
    with pytest.raises(TraversalError):
        t.g().addV("n").iterate()
    with pytest.raises(TraversalError):
        t.g().addE("e").iterate()
    t.g().V(1).property("x", 1).iterate()
    with pytest.raises(SchemaViolation):
        t.g().V(1).property("x", "one").iterate()
    assert t.g().V(1).degree("both").to_list() == [2]


def test_writers_of_one_key_conflict_and_readers_stay(store):
    reader = store.read()
    a, b = store.begin(), store.begin()
    for t in (a, b):
        t.g().addV("n").property("id", 1).iterate()
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert reader.g().V().count().next() == 0
    assert store.read().g().V().id().to_list() == [1]
    a, b = store.begin(), store.begin()  # a counter that two raise at once
    for t in (a, b):
        t.g().V(1).property("x", 1).iterate()
    a.commit()
    with pytest.raises(Conflict):
        b.commit()


def test_writers_of_other_keys_both_commit(store):
    a, b = store.begin(), store.begin()
    a.g().addV("n").property("id", 1).property("x", 5).iterate()
    b.g().addV("m").property("id", 2).property("y", "z").iterate()
    a.commit()
    b.commit()
    g = store.read().g()
    assert g.V().id().to_list() == [1, 2] and g.V().values("x").to_list() == [5] and g.V().values("y").to_list() == ["z"]
    a, b = store.begin(), store.begin()
    a.g().V(2).drop().iterate()
    b.g().addE("e").from_(1).to(2).iterate()  # needs what the other drops
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    a, b = store.begin(), store.begin()
    a.g().addE("e").from_(1).to(1).iterate()
    b.g().V(1).drop().iterate()  # drops what the other needs
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    a, b = store.begin(), store.begin()
    a.g().addV("n").property("id", 7).property("w", 5).iterate()
    b.g().addV("n").property("id", 8).property("w", "five").iterate()  # one key, two types
    a.commit()
    with pytest.raises(Conflict):
        b.commit()


def data_files(tmp_path):
    return {str(f) for f in tmp_path.rglob("*.parquet") if "graph" in str(f)}


def test_nothing_is_rewritten(spark, store, tmp_path, monkeypatch):
    with store.open_bulk_loader() as loader:
        loader.load_vertices(spark.range(1000).selectExpr("id", "'n' AS label", "id AS x")).load_edges(spark.range(999).selectExpr("id AS src", "'e' AS label", "id + 1 AS dst")).commit()
    before = data_files(tmp_path)
    with store.open_schema() as s:
        s.add_vertex_label("other")
    assert data_files(tmp_path) == before  # a change of the schema writes a manifest
    monkeypatch.setattr("knotwork.sources.store.MERGE_AFTER", 3)
    for i in range(5):
        with store.begin() as t:
            for j in range(2):
                t.g().addV("other").property("id", 2000 + 2 * i + j).property("x", i).iterate()
            t.g().V(i).property("x", -1 - i).iterate()
            t.g().V(500 + i).outE("e").drop().iterate()
    assert before <= data_files(tmp_path)
    manifest = store._manifest(store.version)
    assert manifest["vertices"][0]["path"] in " ".join("file:" + f for f in before).replace("file:", "file://") and len(manifest["deltas"]) <= 3
    new = spark.read.option("recursiveFileLookup", True).parquet(*[d["vertices"]["path"] for d in manifest["deltas"]])
    assert new.count() == 15  # the deltas hold what was written, and only that
    g = store.read().g()
    assert g.V().count().next() == 1010 and g.E().count().next() == 994
    assert sorted(g.V(0, 1, 2, 3, 4).values("x").to_list()) == [-5, -4, -3, -2, -1]
    store.compact()
    assert store._manifest(store.version)["deltas"] == []
    g = store.read().g()
    assert g.V().count().next() == 1010 and g.E().count().next() == 994 and g.V().hasLabel("other").count().next() == 10


def test_failures_that_are_no_conflicts_stay_what_they_are(store, monkeypatch):
    t = store.begin()
    t.g().addV("n").property("id", 1).iterate()
    monkeypatch.setattr(store, "_name", lambda version, real=store._name: real(version) if version < 1 else "nosuchscheme://x/y")
    with pytest.raises(Exception) as error:
        t.commit()
    assert not isinstance(error.value, Conflict)


def test_many_elements_at_once(spark, store):
    people = spark.range(100).selectExpr("id", "'person' AS label", "concat('p', id) AS name")
    knows = spark.range(99).selectExpr("id AS src", "'knows' AS label", "id + 1 AS dst", "id * 0.5D AS w")
    with store.begin() as t:
        t.add_vertices(people)
        t.add_edges(knows)
        assert t.g().V(7).out("knows").values("name").to_list() == ["p8"]
        with pytest.raises(DuplicateVertex):
            t.add_vertices(people.limit(1))
        with pytest.raises(DuplicateEdge):
            t.add_edges(knows.limit(1))
        with pytest.raises(NotFound):
            t.add_edges(knows.limit(1).selectExpr("src", "label", "999L AS dst"))
        with pytest.raises(SchemaViolation):
            t.add_edges(knows.limit(1).selectExpr("src", "label", "src AS dst", "3 AS rank"))
    with store.begin() as t:
        t.put_vertices(spark.range(90, 110).selectExpr("id", "'robot' AS label"))
    g = store.read().g()
    assert g.V().hasLabel("robot").count().next() == 20 and g.V().count().next() == 110 and g.V().values("name").count().next() == 90
    assert g.E().values("w").sum().next() == sum(range(99)) / 2


def test_closed_stores_and_ended_sessions(store):
    t, r = store.begin(), store.read()
    t.g().addV("n").property("id", 1).iterate()
    store.close()
    for session in (t, r):
        with pytest.raises(TraversalError):
            session.g().V().to_list()
    for begin in (store.begin, store.read):
        with pytest.raises(TraversalError):
            begin()
    assert GraphStore(store.spark, store.path, edge_mode="multi").registry.edge_mode == "single"  # options of the first open stay


def test_vector_indexes_limit_what_is_written(spark, store):
    with store.open_schema() as s:
        s.add_vector_index(VectorIndex("emb", 2, "euclidean"))
    with store.begin() as t:
        t.g().addV("n").property("id", 1).property("emb", [1.0, 2.0]).iterate()
        for vid, value in ((2, [1.0]), (-2, [1.0, 2.0])):
            with pytest.raises(VectorIndexError):
                t.g().addV("n").property("id", vid).property("emb", value).iterate()
        t.g().addE("e").from_(1).to(1).iterate()
        with pytest.raises(VectorIndexError):
            t.g().E().property("emb", [1.0, 2.0]).iterate()
        with pytest.raises(VectorIndexError):
            t.add_vertices(spark.createDataFrame([(5, "n", [1.0])], "id long, label string, emb array<float>"))
    assert store.index_manager().rebuild("emb") == 1
    with pytest.raises(NotFound):
        store.index_manager().rebuild("other")
    with pytest.raises(VectorIndexError):
        store.read().g().V().nearest("emb", [1.0], 1).to_list()
    with store.open_schema() as s:
        s.drop_vector_index("emb")
    assert store.read().g().V().nearest("emb", [1.0, 2.0], 1).id().to_list() == [1]


def test_rollback(store):
    with pytest.raises(ZeroDivisionError), store.begin() as t:
        t.g().addV("n").property("id", 1).iterate()
        raise ZeroDivisionError
    assert store.read().g().V().count().next() == 0


def test_schema_sessions(store):
    with store.open_schema() as s:
        s.add_vertex_label("person").add_edge_label("knows").add_property_key("age", "int32").set_schema_mode("strict")
    with pytest.raises(SchemaConflict):
        store.open_schema().add_property_key("age", "string")
    r = store.read()
    with pytest.raises(SchemaViolation):
        r.g().V().hasLabel("robot").to_list()
    with pytest.raises(SchemaViolation):
        r.g().V().has("height", 1).to_list()
    with pytest.raises(SchemaViolation):
        store.begin().g().addV("robot").property("id", 1).iterate()
    with store.open_schema() as s:
        s.set_edge_mode("multi")
    with pytest.raises(SchemaConflict):
        store.open_schema().set_edge_mode("single")
    first, second = store.open_schema(), store.open_schema()
    first.add_vertex_label("a").commit()
    with pytest.raises(SchemaConflict):
        second.add_vertex_label("b").commit()


def test_bulk_load(spark, store):
    """A tower of eight floors whose lift goes from the lowest to every even floor: 7 steps and 3 rides (to 2, 4 and 6)."""
    floors = spark.createDataFrame([(f, "floor", f * 3.5) for f in range(8)], "id long, label string, height double")
    steps = spark.createDataFrame([(f, f + 1) for f in range(7)], "src long, dst long").selectExpr("src", "'stairs' AS label", "dst")
    rides = spark.createDataFrame([(0, f, f // 2) for f in (2, 4, 6)], "src long, dst long, price int").selectExpr("src", "'lift' AS label", "dst", "price")
    with store.open_bulk_loader() as loader:
        with pytest.raises(IncompleteLoad):
            loader.load_edges(steps)
        with pytest.raises(IncompleteLoad):
            loader.commit()
        stats = loader.load_vertices(floors).load_edges(steps).load_edges(rides).commit()
    assert (stats.vertices, stats.edges) == (8, 10) and stats.files >= 3 and stats.seconds > 0
    g = store.read().g()
    assert g.V().where(__.out().count().is_(P.gt(1))).id().to_list() == [0]
    assert g.V(0).repeat(__.out()).times(2).id().to_set() == {2, 3, 5, 7}
    assert g.V(0).degree("out").to_list() == [4] and g.E().values("price").sum().next() == 6
    with store.open_bulk_loader() as loader:  # left without commit
        loader.load_vertices(floors.limit(1))
    assert store.read().g().V().count().next() == 8


def test_bulk_load_errors(spark, store):
    v = spark.createDataFrame([(1, "a"), (2, "a")], "id long, label string")
    with pytest.raises(DuplicateVertex):
        store.open_bulk_loader().load_vertices(v.union(v))
    e = spark.createDataFrame([(1, "x", 2), (1, "x", 2)], "src long, label string, dst long")
    with pytest.raises(DuplicateEdge):
        store.open_bulk_loader().load_vertices(v).load_edges(e)
    with pytest.raises(SchemaViolation):
        store.open_bulk_loader().load_vertices(v.limit(1)).load_edges(e.limit(1).selectExpr("src", "label", "99L AS dst"))


def test_loaded_ranks_go_on_from_explicit_ones(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/many", edge_mode="multi")
    v = spark.createDataFrame([(1, "a"), (2, "a")], "id long, label string")
    e = spark.createDataFrame([(1, "x", 2, 4), (1, "x", 2, None), (2, "x", 1, None)], "src long, label string, dst long, rank int")
    with store.open_bulk_loader() as loader:
        assert loader.load_vertices(v).load_edges(e).commit().edges == 3
    assert sorted((r.src, r["rank"]) for r in store.open().edges.collect()) == [(1, 4), (1, 5), (2, 0)]


def test_ranks_go_on_from_explicit_ones(spark):
    from knotwork.sources.bulk import assign_ranks

    e = spark.createDataFrame([(1, "x", 2, 4, "a"), (1, "x", 2, None, "b"), (1, "x", 2, None, "c"), (1, "y", 2, None, "d")], "src long, label string, dst long, rank int, p string")
    assert {r["p"]: r["rank"] for r in assign_ranks(e).collect()} == {"a": 4, "b": 5, "c": 6, "d": 0}
