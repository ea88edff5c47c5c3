"""Golden results on a graph of six vertices and six edges."""

import pytest

from knotwork.errors import SchemaViolation, TraversalError, UnexpectedDataType, UnsupportedOperation
from knotwork.functions.predicates import P
from knotwork.functions.values import decode_edge_id, encode_edge_id
from knotwork.plans.rewrite import rewrite
from knotwork.plans.traversal import __
from knotwork.sources.graph import PropertyGraph
from knotwork.sources.registry import Registry, VectorIndex

PEOPLE = [
    (1, "person", "marko", 29, None, [1.0, 0.0, 0.0]), (2, "person", "vadas", 27, None, [0.9, 0.1, 0.0]), (3, "software", "lop", None, "java", [0.0, 1.0, 0.0]),
    (4, "person", "josh", 32, None, [0.0, 0.0, 1.0]), (5, "software", "ripple", None, "java", None), (6, "person", "peter", 35, None, [0.0, 0.0, 0.0]),
]
LINKS = [(1, "knows", 2, 0, 0.5), (1, "knows", 4, 0, 1.0), (1, "created", 3, 0, 0.4), (4, "created", 5, 0, 1.0), (4, "created", 3, 0, 0.4), (6, "created", 3, 0, 0.2)]
ALL = (1, 2, 3, 4, 5, 6)


def build(spark, mode="auto", links=LINKS):
    v = spark.createDataFrame(PEOPLE, "id long, label string, name string, age int, lang string, emb array<float>")
    e = spark.createDataFrame(links, "src long, label string, dst long, rank int, weight double")
    names = {"vertex_labels": ["person", "software"], "edge_labels": ["knows", "created", "friends"]}
    return PropertyGraph(v, e, Registry(mode, "multi", **names), max_iterations=6)


@pytest.fixture(scope="module")
def g(spark):
    return build(spark).g()


CASES = {
    "count": (lambda g: g.V(*ALL).count(), [6]),
    "out_edges": (lambda g: g.V(*ALL).outE().count(), [6]),
    "in_edges": (lambda g: g.V(*ALL).inE().count(), [6]),
    "both": (lambda g: g.V(*ALL).both().count(), [12]),
    "where_other_end": (lambda g: g.V().hasLabel("person").outE("created", "knows").where(__.otherV().hasLabel("software")).count(), [4]),
    "both_edges_other_end": (lambda g: g.V().hasLabel("person").bothE("knows").otherV().hasLabel("person").count(), [4]),
    "both_edges_other_end_dedup": (lambda g: g.V().hasLabel("person").bothE("knows").otherV().hasLabel("person").dedup().count(), [3]),
    "values": (lambda g: g.V().values("age", "name", "lang").count(), [12]),
    "both_edges": (lambda g: g.V().bothE().hasLabel("created").count(), [8]),
    "both_edges_dedup": (lambda g: g.V().bothE().hasLabel("created").dedup().count(), [4]),
    "union": (lambda g: g.V().hasLabel("person").union(__.outE("created"), __.outE("knows")).count(), [6]),
    "union_per_traverser": (lambda g: g.V().hasLabel("person").union(__.out().count(), __.in_().count()), [3, 0, 0, 1, 2, 1, 1, 0]),
    "repeat_times": (lambda g: g.V(3).repeat(__.in_("created", "knows")).times(2).values("name"), ["marko"]),
    "repeat_until_emit": (lambda g: g.V(5).repeat(__.in_()).until(__.has("age", P.lt(30))).emit().values("name"), ["josh", "marko"]),
    "repeat_emit": (lambda g: g.V(3).repeat(__.both("created")).times(2).emit().id(), [1, 3, 3, 3, 4, 5, 6]),
    "repeat_until": (lambda g: g.V(6).repeat(__.both("created")).until(__.has("age")).id(), [1, 4, 6]),
    "repeat_dedup_per_start": (lambda g: g.V(1, 6).repeat(__.out("created").in_("created").dedup()).times(1).id(), [1, 4, 6, 1, 4, 6]),
    "not": (lambda g: g.V().not_(__.hasLabel("person")).values("name"), ["lop", "ripple"]),
    "and": (lambda g: g.V().and_(__.hasLabel("person"), __.has("age", P.gt(30))).values("name"), ["josh", "peter"]),
    "or": (lambda g: g.V().or_(__.has("name", "marko"), __.has("name", "lop")).values("name"), ["lop", "marko"]),
    "or_semi": (lambda g: g.V().or_(__.out("knows"), __.in_("created")).id(), [1, 3, 5]),
    "not_out": (lambda g: g.V().hasLabel("person").not_(__.out()).values("name"), ["vadas"]),
    "where_deep": (lambda g: g.V().where(__.out("created").has("name", "ripple")).values("name"), ["josh"]),
    "where_count": (lambda g: g.V().where(__.out().count().is_(P.gt(1))).values("name"), ["josh", "marko"]),
    "sum": (lambda g: g.V().values("age").sum(), [123]),
    "mean": (lambda g: g.V().values("age").mean(), [30.75]),
    "max": (lambda g: g.V().values("age").max(), [35]),
    "min": (lambda g: g.V().values("age").min(), [27]),
    "sum_float": (lambda g: g.E().values("weight").sum(), [3.5]),
    "sum_of_nothing": (lambda g: g.V().has("name", "nobody").values("age").sum(), [None]),
    "max_of_strings": (lambda g: g.V().values("name").max(), [None]),
    "count_of_nothing": (lambda g: g.V().has("name", "nobody").out().count(), [0]),
    "simple_path": (lambda g: g.V(1).out("knows").both("knows").simplePath().count(), [0]),
    "cyclic_path": (lambda g: g.V(1).out("knows").both("knows").cyclicPath().count(), [2]),
    "select": (lambda g: g.V(1).as_("a").out("knows").as_("b").select("a").values("name"), ["marko", "marko"]),
    "no_labels": (lambda g: g.V(1).hasLabel([]).count(), [0]),
    "all_properties": (lambda g: g.V(1).properties().count(), [3]),
    "order": (lambda g: g.V().hasLabel("person").order().by("age", "desc").values("name"), ["peter", "josh", "marko", "vadas"]),
    "order_nulls_last": (lambda g: g.V().order().by("age", "desc").limit(5).id(), [6, 4, 1, 2, 3]),
    "order_limit": (lambda g: g.V().order().by("name").limit(2).values("name"), ["josh", "lop"]),
    "skip": (lambda g: g.V().skip(4).id(), [5, 6]),
    "tail": (lambda g: g.V().tail(2).id(), [5, 6]),
    "range": (lambda g: g.V().range(1, 3).id(), [2, 3]),
    "no_limit": (lambda g: g.V().limit(-1).count(), [6]),
    "local_count": (lambda g: g.V().hasLabel("person").local(__.out().count()), [3, 0, 2, 1]),
    "local_limit": (lambda g: g.V().hasLabel("person").local(__.out("created").limit(1)).id(), [3, 3, 3]),
    "fold": (lambda g: g.V().values("age").fold(), [[29, 27, 32, 35]]),
    "fold_of_nothing": (lambda g: g.V().has("name", "nobody").values("age").fold(), [[]]),
    "unfold": (lambda g: g.V().values("age").fold().unfold().count(), [4]),
    "group_count": (lambda g: g.V().label().groupCount(), [{"person": 4, "software": 2}]),
    "group_by": (lambda g: g.V().group().by("lang").count(), [1]),
    "coalesce": (lambda g: g.V().hasLabel("person").coalesce(__.out("knows"), __.out("created")).id(), [2, 4, 5, 3, 3]),
    "choose": (lambda g: g.V().choose(__.hasLabel("person"), __.values("age"), __.values("lang")).count(), [6]),
    "choose_without_else": (lambda g: g.V(1, 3).choose(__.hasLabel("software"), __.in_("created")).id(), [1, 1, 4, 6]),
    "degree": (lambda g: g.V().degree("both"), [3, 1, 3, 3, 1, 1]),
    "ids_in_order_repeated": (lambda g: g.V(2, 1, 1, 99).id(), [2, 1, 1]),
    "has_strictly_typed": (lambda g: g.V().has("age", "29").count(), [0]),
    "has_int_and_float": (lambda g: g.V().has("age", 29.0).count(), [1]),
    "missing_fails_ne": (lambda g: g.V().has("age", P.ne(1)).count(), [4]),
    "within_nothing": (lambda g: g.V().has("age", []).count(), [0]),
    "unknown_label": (lambda g: g.V().hasLabel(P.ne("robot")).count(), [6]),
    "constant": (lambda g: g.V(1).constant(7).is_(P.lt(8)), [7]),
    "restart": (lambda g: g.V(1).V(2).id(), [2]),
    "nearest": (lambda g: g.V().nearest("emb", [1.0, 0.0, 0.0], 2).id(), [1, 2]),
    "nearest_with_path": (lambda g: g.V(1).out().nearest("emb", [1.0, 0.0, 0.0], 1).id(), [2]),
    "similarity": (lambda g: g.V(3, 1).similarity("emb", [1.0, 0.0, 0.0]), [0.0, 1.0]),
    "neighbors": (lambda g: g.V(1).neighbors("emb", 1).id(), [2]),
}


#: Whose emission order is left open here.
UNORDERED = {
    "repeat_times", "repeat_until_emit", "or", "and", "where_count", "coalesce", "choose_without_else", "union_per_traverser", "repeat_emit", "repeat_until",
}


@pytest.mark.parametrize("name", CASES)
def test_golden(g, name):
    build_one, expected = CASES[name]
    got = build_one(g).to_list()
    assert got == expected if name not in UNORDERED else sorted(got, key=str) == sorted(expected, key=str)


def test_paths(g):
    paths = g.V(1).bothE().otherV().path().to_list()
    assert [len(p.objects) for p in paths] == [3, 3, 3]
    assert all(p.objects[0].id == 1 for p in paths)
    path = g.V(1).as_("a").out("knows").as_("b").path().to_list()[0]
    assert path.labels == (("a",), ("b",))


def test_edge_ids(g):
    ids = g.E().id().to_list()
    assert all(len(i) == 30 for i in ids) and len(set(ids)) == 6
    assert set(ids) == {encode_edge_id(s, ["knows", "created"].index(label) + 1, d, r) for s, label, d, r, _ in LINKS}
    assert decode_edge_id(encode_edge_id(-5, 1, 7, 65535)) == (-5, 1, 7, 65535)
    assert g.E(ids[0], "nonsense").count().to_list() == [1]
    assert g.E().hasId(ids[0]).count().to_list() == [1]
    assert g.E().hasId(P.ne("nonsense")).count().to_list() == [6]


def test_kind_errors(g):
    for t in (lambda: g.V().inV(), lambda: g.V().rank(), lambda: g.V().values("age").values("age"), lambda: g.E().out()):
        with pytest.raises(UnexpectedDataType):
            t().to_df()


def test_builder_errors(g):
    for t in (
        lambda: g.V().repeat(__.out()).to_list(), lambda: g.V().repeat(__.out()).times(0), lambda: g.V().times(2), lambda: g.V().where(__.identity()).by("x"),
        lambda: g.V().repeat(__.out()).times(1).until(__.out()), lambda: g.V().limit(-2), lambda: __.out().to_list(), lambda: g.V().with_ef_search(3),
    ):
        with pytest.raises(TraversalError):
            t()
    with pytest.raises(UnsupportedOperation):
        g.V().hasLabel(P.gt("a"))
    with pytest.raises(SchemaViolation):
        g.E().values("rank").to_df()


def test_endless_repeat_is_stopped(spark):
    g = build(spark, links=[*LINKS, (2, "knows", 1, 0, 0.1)]).g()
    with pytest.raises(TraversalError):
        g.V(1).repeat(__.out("knows")).until(__.hasLabel("software")).to_list()


def test_strict_reads(spark):
    g = build(spark, "strict").g()
    with pytest.raises(SchemaViolation):
        g.V().hasLabel("robot").to_df()
    with pytest.raises(SchemaViolation):
        g.V().out("hates").to_df()


def test_vector_index_checks_dimensions(spark):
    from knotwork.errors import VectorIndexError

    graph = build(spark)
    graph.registry.add_vector_index(VectorIndex("emb", 3, "euclidean"))
    assert graph.g().V().nearest("emb", [0.0, 0.0, 0.9], 1).id().to_list() == [4]
    with pytest.raises(VectorIndexError):
        graph.g().V().nearest("emb", [0.0], 1).to_df()


def test_rewrites():
    plan = rewrite(__.where(__.values("age").is_(3)).out("knows").count().steps)
    assert [s.op for s in plan] == ["has", "degree", "total"]
    assert [s.op for s in rewrite(__.local(__.out().count()).steps)[0].subs[0]] == ["degree"]
    assert rewrite(__.where(__.out().fold()).steps) == ()


ORDERED = {
    "fold": (lambda g: g.V().order().by("age", "desc").by("name").id().fold(), [[6, 4, 1, 2, 3, 5]]),
    "fold_asc": (lambda g: g.V().order().by("lang").by("age").values("name").fold(), [["lop", "ripple", "vadas", "marko", "josh", "peter"]]),
    "group": (lambda g: g.V().hasLabel("person").order().by("age", "desc").group().by("lang"), [{}]),
    "group_label": (lambda g: g.V().order().by("name", "desc").label().group(), [{"person": ["person"] * 4, "software": ["software"] * 2}]),
    "union": (lambda g: g.V().order().by("age", "desc").union(__.id(), __.constant(0)), [6, 0, 4, 0, 1, 0, 2, 0, 3, 0, 5, 0]),
    "repeat": (lambda g: g.V().hasLabel("person").order().by("name", "desc").repeat(__.out("created")).times(1).id(), [3, 3, 3, 5]),
}


@pytest.mark.parametrize("name", ORDERED)
def test_order_before_barriers_needs_no_single_task(g, name):
    build_, want = ORDERED[name]
    t = build_(g)
    got = t.to_list()
    assert (got == want) if name != "repeat" else sorted(got) == want
    plan = t.explain()
    assert "Window" not in plan


def test_global_positions_follow_the_sort(spark):
    rows = spark.range(20_000).selectExpr("id", "'n' AS label", "pmod(hash(id), 1000) AS x")
    g = PropertyGraph(rows, spark.createDataFrame([], "src long, label string, dst long, rank int")).g()
    got = g.V().order().by("x", "desc").union(__.values("x"), __.id()).to_list()
    want = sorted(((r.x, r.id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert got == [y for pair in want for y in pair]


def test_filters_reach_the_scan(spark, tmp_path):
    graph = build(spark)
    graph.vertices.write.parquet(f"{tmp_path}/v")
    graph.edges.write.parquet(f"{tmp_path}/e")
    graph = graph.with_frames(spark.read.parquet(f"{tmp_path}/v"), spark.read.parquet(f"{tmp_path}/e"))
    text = graph.g().V().has("name", "marko").out("knows").count().explain()
    assert "EqualTo(name,marko)" in text and "EqualTo(label,knows)" in text
    assert "weight" not in text.split("Physical Plan")[1]
