"""Repeats over long ways and many passes."""

import random

import pytest

from knotwork.errors import TraversalError
from knotwork.functions.predicates import P
from knotwork.plans.traversal import __
from knotwork.sources.graph import PropertyGraph
from knotwork.sources.registry import Registry


def graph(spark, links, colours, max_iterations=6):
    v = spark.createDataFrame(sorted(colours.items()), "id long, colour string").selectExpr("id", "'x' AS label", "colour")
    e = spark.createDataFrame(sorted(links), "src long, dst long").selectExpr("src", "'next' AS label", "dst", "0 AS rank")
    return PropertyGraph(v, e, Registry("auto", "multi", vertex_labels=["x"], edge_labels=["next"]), max_iterations=max_iterations)


def ids(df):
    return sorted(r[0] for r in df.collect())


def walked(links, colours, starts, stop):
    """By single steps; a start may have several ways."""
    out, now = [], list(starts)
    while now:
        now = [b for a in now for x, b in links if x == a]
        out += [b for b in now if colours[b] == stop]
        now = [b for b in now if colours[b] != stop]
    return sorted(out)


def test_until_over_single_ways_longer_than_the_passes(spark):
    """Ways that end, ways that stop late, starts that occur twice, and a circle that no start reaches."""
    pick = random.Random(7)
    colours = {i: pick.choice(["red"] + ["grey"] * 9) for i in range(200)} | {300: "grey", 301: "grey"}
    chain = [(i, i + 1) for i in range(199) if i % 70 != 69]
    g = graph(spark, [*chain, (300, 301), (301, 300)], colours).g()
    starts = g.V().hasId(P.lt(200))
    want = walked(chain, colours, range(200), "red")
    assert ids(starts.repeat(__.out("next")).until(__.has("colour", "red")).id().to_df()) == want and len(want) > 100
    twice = [b for b in range(50) for _ in range(2)]
    got = g.V(*twice).repeat(__.out("next")).until(__.has("colour", "red")).id().to_df()
    assert ids(got) == walked(chain, colours, twice, "red")
    with pytest.raises(TraversalError):
        g.V(5, 300).repeat(__.out("next")).until(__.has("colour", "red")).id().to_df()


def test_until_over_single_ways_doubles(spark, monkeypatch):
    from knotwork.operators import compile as compiler

    written = []
    monkeypatch.setattr(compiler, "spool", lambda df, f=compiler.spool: written.append(1) or f(df))
    colours = {i: "grey" for i in range(100)} | {100: "red"}
    g = graph(spark, [(i, i + 1) for i in range(100)], colours, 1000).g()
    assert ids(g.V().repeat(__.out("next")).until(__.has("colour", "red")).id().to_df()) == [100] * 100
    assert len(written) <= 10


def stars(spark, hubs, leaves, max_iterations=6):
    """Leaves of several hubs; every leaf has an edge to each hub of its set."""
    colours = {i: "hub" for i in range(hubs)} | {100 + i: "leaf" for i in range(leaves)}
    pick = random.Random(3)
    sets = [pick.sample(range(hubs), pick.choice([1, 3, 3, 4])) for _ in range(6)]
    links = {(100 + i, h) for i in range(leaves) for h in sets[i % 6]}
    return graph(spark, links, colours, max_iterations).g(), links


def set_walk(links, start, times):
    """Vertices after each pass of both().dedup()."""
    out, now = [], {start}
    for _ in range(times):
        now = {b for a in now for x, y in links for b in ((y,) if x == a else ()) + ((x,) if y == a else ())}
        out.append(now)
    return out


@pytest.mark.parametrize("times", [1, 2, 3, 4])
def test_dedup_by_start_gives_each_start_its_own(spark, times):
    g, links = stars(spark, 5, 40)
    starts = [*range(100, 140), 100, 107]
    loop = lambda: g.V(*starts).repeat(__.both("next").dedup()).times(times)
    want = [set_walk(links, s, times) for s in starts]
    assert ids(loop().id().to_df()) == sorted(v for w in want for v in w[-1])
    assert loop().count().to_list() == [sum(len(w[-1]) for w in want)]
    assert loop().emit().count().to_list() == [sum(len(x) for w in want for x in w)]
    assert ids(loop().emit().id().to_df()) == sorted(v for w in want for x in w for v in x)


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    """Sets of one size with the same ends, whose hashes are made equal."""
    from knotwork.operators import compile as compiler

    links = {(100 + i, h) for i in range(8) for h in ((0, 1 + i % 2, 5))} | {(200 + h, h) for h in range(6)}
    g = graph(spark, links, {x: "x" for link in links for x in link}).g()
    monkeypatch.setattr(compiler.F, "xxhash64", lambda *cols: compiler.F.lit(7).cast("bigint"))
    df = g.V(*range(100, 108)).repeat(__.out("next").dedup()).times(1).id().to_df()
    assert df.count() == 24
    got = g.V(*range(100, 108)).repeat(__.both("next").dedup()).times(2).id().to_df()
    assert ids(got) == sorted(v for i in range(100, 108) for v in set_walk(links, i, 2)[-1])


def test_starts_alike_go_on_as_one(spark):
    """A pass after the first has rows for distinct sets only, and starts are counted before they meet their results."""
    g, links = stars(spark, 5, 600)
    df = g.V().hasId(P.gte(100)).repeat(__.both("next").dedup()).times(2).count().to_df()
    assert df.collect()[0][0] == sum(len(set_walk(links, 100 + i, 2)[-1]) for i in range(6)) * 100
    rows = []
    walk = [df._jdf.queryExecution().executedPlan()]
    while walk:
        node = walk.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        walk += [node.children().apply(i) for i in range(node.children().size())]
    assert max(rows) < 20000  # one for each start and result would be over 100,000


def scans(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Relation [")


def test_until_with_several_ways_reads_its_results_at_once(spark):
    """Stepwise passes: the plan of the result does not grow with their number, and its steps are not made again."""
    colours = {i: "red" if i % 9 == 8 else "grey" for i in range(40)}
    links = [(i, i + d) for i in range(40) for d in (1, 2) if i + d < 40 and (d == 1 or i % 5 == 0)]
    g = graph(spark, links, colours, 100).g()
    df = g.V().repeat(__.out("next")).until(__.has("colour", "red")).id().to_df()
    assert ids(df) == walked(links, colours, range(40), "red")
    assert scans(df) == 1
    emitted = g.V(0, 3).repeat(__.out("next")).until(__.where(__.in_("next").has("colour", "red"))).emit().id().to_df()
    assert scans(emitted) == 1 and emitted.count() > 10
    ordered = g.V(3, 0).repeat(__.out("next")).until(__.has("colour", "red")).id().to_list()
    assert sorted(ordered) == walked(links, colours, [3, 0], "red")


def test_edges_of_a_loop_are_made_once(spark):
    """However many passes there are, what makes the edges runs a bounded number of times."""
    made = spark.sparkContext.accumulator(0)
    colours = {i: "red" if i == 30 else "grey" for i in range(31)}
    base = graph(spark, [(i, i + 1) for i in range(30)], colours, 100)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    g = base.with_frames(edges=base.edges.mapInArrow(count, base.edges.schema)).g()
    assert ids(g.V(0).repeat(__.out("next")).until(__.has("colour", "red")).id().to_df()) == [30]
    assert g.V(0).repeat(__.out("next")).until(__.has("colour", "red")).id().to_list() == [30]
    assert made.value <= 4 * 30
