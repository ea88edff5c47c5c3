"""Queries that write: bulk loads, transactions, schemas and indexes of stored graphs, with the SQL of what is read back.

Each loads whole tables into a store of its own in the shared folder, writes, and returns what a new reader finds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Conflict, GraphError, SchemaViolation, TraversalError, VectorIndexError
from ..functions.predicates import P
from ..functions.values import encode_edge_id
from ..sources.registry import VectorIndex
from ..sources.spool import scratch
from ..sources.store import GraphStore
from ..sources.tables import EDGE_LABELS, KINDS, UNIT, load
from .traversal import __

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL over v(ertices) and e(dges); the catalogue puts their definitions before it.
SQL: dict[str, str] = {}

_PROPS = {
    "region": ("name",), "nation": ("name",), "customer": ("name", "acctbal", "mktsegment"), "supplier": ("name", "acctbal"),
    "part": ("name", "size"), "order": ("totalprice",), "item": ("emb", "cls"), "event": ("event_type",),
}


def stored(name: str, sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def vid(kind: str, key: int) -> int:
    return KINDS[kind] * UNIT + key


def vertices_of(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    names = list(dict.fromkeys(p for k in kinds for p in _PROPS[k]))
    return load(spark, folder).vertices.where(F.col("label").isin(*kinds)).select("id", "label", *names)


def edges_of(spark: SparkSession, folder: str, *labels: str, props: tuple[str, ...] = ()) -> DataFrame:
    return load(spark, folder).edges.where(F.col("label").isin(*labels)).select("src", "label", "dst", "rank", *props)


def places(spark: SparkSession, folder: str, edge_mode: str = "multi") -> GraphStore:
    """Regions, nations, customers and suppliers with the edges between them."""
    store = GraphStore(spark, scratch(spark), edge_mode=edge_mode)
    with store.open_bulk_loader() as loader:
        loader.load_vertices(vertices_of(spark, folder, "region", "nation", "customer", "supplier")).load_edges(edges_of(spark, folder, "in_region", "in_nation")).commit()
    return store


def items(spark: SparkSession, folder: str, metric: str | None) -> GraphStore:
    store = GraphStore(spark, scratch(spark))
    if metric:
        with store.open_schema() as s:
            s.add_vector_index(VectorIndex("emb", 64, metric))
    with store.open_bulk_loader() as loader:
        loader.load_vertices(vertices_of(spark, folder, "item")).commit()
    return store


def refused(error: type[GraphError], act: Callable[[], object]) -> bool:
    try:
        act()
    except error:
        return True
    return False


# writes
@stored("addv", "SELECT id, label, name FROM v WHERE label = 'region' UNION ALL VALUES (99, 'continent', 'PANGAEA'), (98, 'continent', 'GONDWANA')")
def addv(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().addV("continent").property("id", 99).property("name", "PANGAEA").iterate()
        t.g().addV("continent").property("id", 98).property("name", "GONDWANA").iterate()
    return store.read().g().V().hasLabel("region", "continent").withProperties("name").to_df()


@stored("adde_from_to", "SELECT src, label, dst, rank, NULL::DOUBLE AS since FROM e WHERE label = 'in_region' UNION ALL VALUES (1000000000000, 'twin', 1000000000001, 0, 0.5::DOUBLE), (1000000000000, 'twin', 1000000000001, 1, NULL)")
def adde_from_to(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    a, b = vid("region", 0), vid("region", 1)
    with store.begin() as t:
        t.g().addE("twin").from_(a).to(b).property("since", 0.5).iterate()
        t.g().addE("twin").from_(a).to(b).property("rank", 1).iterate()
    return store.read().g().E().hasLabel("in_region", "twin").withProperties("since").to_df()


@stored("adde_arriving", "SELECT id AS src, 'member' AS label, 77::BIGINT AS dst, 0 AS rank, 3 AS level FROM v WHERE label IN ('customer', 'supplier')")
def adde_arriving(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().addV("club").property("id", 77).iterate()
        t.g().V().hasLabel("customer", "supplier").addE("member").to(77).property("level", 3).iterate()
    return store.read().g().E().hasLabel("member").withProperties("level").to_df()


@stored("property_of_vertices", "SELECT id, label, name, CASE WHEN label = 'supplier' THEN 5 END AS rating FROM v WHERE label IN ('supplier', 'nation')")
def property_of_vertices(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().V().hasLabel("supplier").property("rating", 4).iterate()
        t.g().V().hasLabel("supplier").property("rating", 5).iterate()
    return store.read().g().V().hasLabel("supplier", "nation").withProperties("name", "rating").to_df()


@stored("property_of_edges", "SELECT src, label, dst, rank, CASE WHEN label = 'in_nation' THEN 2.5 END::DOUBLE AS weight FROM e WHERE label IN ('in_nation', 'in_region')")
def property_of_edges(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().E().hasLabel("in_nation").property("weight", 2.5).iterate()
    return store.read().g().E().withProperties("weight").to_df()


@stored("drop_edges_and_vertices", "SELECT id, label, acctbal FROM v WHERE label IN ('customer', 'supplier', 'nation') AND NOT (label = 'customer' AND acctbal < 0)")
def drop_edges_and_vertices(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().V().hasLabel("customer").has("acctbal", P.lt(0.0)).outE("in_nation").drop().iterate()
        t.g().V().hasLabel("customer").has("acctbal", P.lt(0.0)).drop().iterate()
    return store.read().g().V().hasLabel("customer", "supplier", "nation").withProperties("acctbal").to_df()


@stored("drop_edges", "SELECT src, label, dst, rank FROM e WHERE label IN ('in_nation', 'in_region') AND src NOT IN (SELECT id FROM v WHERE label = 'customer' AND acctbal < 0)")
def drop_edges(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().V().hasLabel("customer").has("acctbal", P.lt(0.0)).outE("in_nation").drop().iterate()
    return store.read().g().E().to_df()


@stored("drop_properties", "SELECT id, label, name, NULL::VARCHAR AS mktsegment FROM v WHERE label = 'customer'")
def drop_properties(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().V().hasLabel("customer").properties("mktsegment").drop().iterate()
    return store.read().g().V().hasLabel("customer").withProperties("name", "mktsegment").to_df()


@stored("batch_writes", "SELECT id, label, name, CASE WHEN label = 'supplier' THEN acctbal END AS acctbal, (SELECT count(*) FROM e WHERE e.src = v.id AND e.label = 'supplies') AS supplies FROM v WHERE label IN ('supplier', 'part')")
def batch_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Upserts of all suppliers and parts, and an edge for each that one supplies the other."""
    store = places(spark, folder)
    with store.begin() as t:
        t.put_vertices(vertices_of(spark, folder, "supplier", "part").select("id", "label", "name", F.when(F.col("label") == "supplier", F.col("acctbal")).alias("acctbal")))
        t.add_edges(edges_of(spark, folder, "supplies"))
    g = store.read().g().V().hasLabel("supplier", "part").as_("a").degree("out")
    degrees = g._source.run(g.steps).df.select(F.col("__t_a.v").alias("id"), F.col("v").alias("supplies"))
    own = store.open().edges.where("label <> 'supplies'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("others"))  # in_nation
    found = store.read().g().V().hasLabel("supplier", "part").withProperties("name", "acctbal").to_df()
    return found.join(degrees, "id").join(own, "id", "left").select("id", "label", "name", "acctbal", (F.col("supplies") - F.coalesce("others", F.lit(0))).alias("supplies"))


# sessions
@stored("read_snapshot", "SELECT 'pinned' AS reader, count(*) AS n FROM v WHERE label IN ('region', 'nation', 'customer', 'supplier') UNION ALL SELECT 'new', count(*) FROM v WHERE label IN ('region', 'nation', 'customer')")
def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    pinned = store.read()
    with store.begin() as t:
        t.g().V().hasLabel("supplier").outE("in_nation").drop().iterate()
        t.g().V().hasLabel("supplier").drop().iterate()
    counts = [(name, r.g().V().count().to_df()) for name, r in (("pinned", pinned), ("new", store.read()))]
    return counts[0][1].select(F.lit("pinned").alias("reader"), F.col("value").alias("n")).unionByName(counts[1][1].select(F.lit("new").alias("reader"), F.col("value").alias("n")))


@stored("read_your_writes", "SELECT dst AS id, count(*) + 1 AS n FROM e WHERE label = 'in_nation' AND src >= 4000000000000 GROUP BY dst")
def read_your_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Within a transaction that is never committed: new edges, dropped ones and vertices at once."""
    store = places(spark, folder)
    t = store.begin()
    t.g().V().hasLabel("customer").outE("in_nation").drop().iterate()
    t.g().addV("office").property("id", 5).iterate()
    t.g().V().hasLabel("supplier").out("in_nation").dedup().addE("in_nation").from_(5).iterate()
    ends = t.g().E().hasLabel("in_nation").inV().groupCount().to_df()
    return ends.select(F.col("key").alias("id"), F.col("value").alias("n"))


@stored("commit_conflicts", "SELECT id, label, CASE WHEN label = 'supplier' THEN 1 END AS rating FROM v WHERE label IN ('supplier', 'nation') UNION ALL VALUES (50, 'extra', NULL), (51, 'conflicts', NULL)")
def commit_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Of two that write the same keys the second conflicts; a third, of other keys, commits behind the first."""
    store = places(spark, folder)
    first, second, third, last = (store.begin() for _ in range(4))
    first.g().V().hasLabel("supplier").property("rating", 1).iterate()
    second.g().V().hasLabel("supplier").property("rating", 2).iterate()
    third.g().addV("extra").property("id", 50).iterate()
    first.commit()
    third.commit()
    last.g().addV("conflicts" if refused(Conflict, second.commit) else "none").property("id", 51).iterate()
    last.commit()
    return store.read().g().V().hasLabel("supplier", "nation", "extra", "conflicts", "none").withProperties("rating").to_df()


@stored("transaction_contexts", "SELECT id, label FROM v WHERE label IN ('region', 'nation', 'customer', 'supplier') UNION ALL VALUES (1, 'kept')")
def transaction_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Left by an error, a transaction rolls back; left in order, it commits."""
    store = places(spark, folder)

    def fails() -> None:
        with store.begin() as t:
            t.g().E().drop().iterate()
            t.g().V().drop().iterate()
            raise TraversalError("on purpose")

    refused(TraversalError, fails)
    with store.begin() as t:
        t.g().addV("kept").property("id", 1).iterate()
    return store.read().g().V().to_df()


@stored("open_options", "SELECT 'single' AS edge_mode, 'auto' AS mode, TRUE AS ranks_refused, count(*) AS edges FROM e WHERE label IN ('in_region', 'in_nation')")
def open_options(spark: SparkSession, folder: str) -> DataFrame:
    """What the first open set stays, whatever later ones ask for."""
    path = places(spark, folder, edge_mode="single").path
    again = GraphStore(spark, path, mode="strict", edge_mode="multi")
    a, b = vid("region", 0), vid("region", 1)
    no_ranks = refused(GraphError, lambda: again.begin().g().addE("x").from_(a).to(b).property("rank", 1).iterate())
    r = again.registry
    return again.read().g().E().count().to_df().select(F.lit(r.edge_mode).alias("edge_mode"), F.lit(r.mode).alias("mode"), F.lit(no_ranks).alias("ranks_refused"), F.col("value").alias("edges"))


@stored("close_store", "SELECT TRUE AS ended, TRUE AS refused, count(*) AS n FROM v WHERE label IN ('region', 'nation', 'customer', 'supplier')")
def close_store(spark: SparkSession, folder: str) -> DataFrame:
    """Closing ends sessions without committing, and nothing can begin; the folder opens again."""
    store = places(spark, folder)
    t = store.begin()
    t.g().addV("lost").property("id", 1).iterate()
    store.close()
    ended, no_more = refused(TraversalError, t.commit), refused(TraversalError, store.begin)
    count = GraphStore(spark, store.path).read().g().V().count().to_df()
    return count.select(F.lit(ended).alias("ended"), F.lit(no_more).alias("refused"), F.col("value").alias("n"))


@stored("compact_store", "SELECT id, label, CASE WHEN label = 'supplier' THEN 5 END AS rating FROM v WHERE label IN ('region', 'nation', 'supplier')")
def compact_store(spark: SparkSession, folder: str) -> DataFrame:
    store = places(spark, folder)
    with store.begin() as t:
        t.g().V().hasLabel("customer").outE("in_nation").drop().iterate()
        t.g().V().hasLabel("customer").drop().iterate()
        t.g().V().hasLabel("supplier").property("rating", 5).iterate()
    store.compact()
    return store.read().g().V().withProperties("rating").to_df()


@stored(
    "terminals",
    "SELECT 'to_list' AS terminal, n_name AS value FROM nation UNION ALL SELECT 'iter', n_name FROM nation UNION ALL SELECT DISTINCT 'to_set', n_name FROM nation "
    "UNION ALL SELECT 'next', n_name FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation) UNION ALL SELECT 'to_df', n_name FROM nation",
)
def terminals(spark: SparkSession, folder: str) -> DataFrame:
    names = places(spark, folder).read().g().V().hasLabel("nation").values("name")
    names.iterate()
    rows = [("to_list", x) for x in names.to_list()] + [("iter", x) for x in names.iter()] + [("to_set", x) for x in names.to_set()] + [("next", names.next())]
    return spark.createDataFrame(rows, "terminal string, value string").unionByName(names.to_df().select(F.lit("to_df").alias("terminal"), "value"))


# schema
@stored(
    "schema_ddl",
    "VALUES ('vertex label', 'person', '1'), ('vertex label', 'robot', '2'), ('edge label', 'knows', '1'), ('key', 'age', 'int32'), ('key', 'emb', 'float_vector'), "
    "('key', 'face', 'float_vector'), ('index', 'emb', 'dot'), ('mode', 'strict', ''), ('edge mode', 'multi', ''), ('refused', 'robots', 'SchemaViolation')",
)
def schema_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """All eight declarations over two sessions, as another opener reads them; strict mode refuses what is not declared."""
    store = GraphStore(spark, scratch(spark))
    with store.open_schema() as s:
        s.add_vertex_label("person").add_vertex_label("robot").add_edge_label("knows").add_property_key("age", "int32").set_edge_mode("multi")
        s.add_vector_index(VectorIndex("emb", 3, "dot")).add_vector_index(VectorIndex("face", 3))
    store.open_schema().drop_vector_index("face").set_schema_mode("strict").commit()
    r = GraphStore(spark, store.path).registry
    rows = [("vertex label", x, str(i)) for i, x in enumerate(r.vertex_labels, 1)] + [("edge label", x, str(r.label_id(x))) for x in r.edge_labels]
    rows += [("key", k, kind) for k, kind in r.keys.items()] + [("index", k, x.metric) for k, x in r.indexes.items()] + [("mode", r.mode, ""), ("edge mode", r.edge_mode, "")]
    if refused(SchemaViolation, lambda: store.begin().g().addV("robots").property("id", 1).iterate()):
        rows.append(("refused", "robots", "SchemaViolation"))
    return spark.createDataFrame(rows, "col0 string, col1 string, col2 string")


# vectors
_Q = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
_QSQL = f"(SELECT [{', '.join(map(str, _Q))}]::DOUBLE[] AS q)"


@stored("nearest_euclidean", f"SELECT id FROM v, {_QSQL} WHERE emb IS NOT NULL ORDER BY list_distance(emb::DOUBLE[], q), id LIMIT 20")
def nearest_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "euclidean").read().g().V().nearest("emb", _Q, 20).id().to_df().select(F.col("value").alias("id"))


@stored("nearest_dot", f"SELECT id FROM v, {_QSQL} WHERE emb IS NOT NULL ORDER BY list_inner_product(emb::DOUBLE[], q) DESC, id LIMIT 20")
def nearest_dot(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "dot").read().g().V().nearest("emb", _Q, 20).with_ef_search(10).id().to_df().select(F.col("value").alias("id"))


@stored("nearest_per_label", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cls ORDER BY list_cosine_similarity(emb::DOUBLE[], q) DESC, id) AS k FROM v, {_QSQL} WHERE emb IS NOT NULL) WHERE k <= 3")
def nearest_per_label(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest of each class: one scope for each class vertex."""
    store = items(spark, folder, None)
    with store.begin() as t:
        classes = store.open().vertices.select((F.col("cls") + 1).cast("long").alias("id"), F.lit("class").alias("label")).distinct()
        t.add_vertices(classes)
        members = store.open().vertices.where("label = 'item'").select((F.col("cls") + 1).cast("long").alias("src"), F.lit("has").alias("label"), F.col("id").alias("dst"))
        t.add_edges(members)
    return store.read().g().V().hasLabel("class").local(__.out("has").nearest("emb", _Q, 3)).id().to_df().select(F.col("value").alias("id"))


@stored("index_ddl", f"SELECT 'euclidean' AS metric, id FROM (SELECT id FROM v, {_QSQL} WHERE emb IS NOT NULL ORDER BY list_distance(emb::DOUBLE[], q), id LIMIT 5) UNION ALL SELECT 'none', id FROM (SELECT id FROM v, {_QSQL} WHERE emb IS NOT NULL ORDER BY list_cosine_similarity(emb::DOUBLE[], q) DESC, id LIMIT 5)")
def index_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """An index declares the metric of searches; without it they go by the cosine."""
    store = items(spark, folder, "euclidean")
    with_index = store.read().g().V().nearest("emb", _Q, 5).id().to_df()
    with store.open_schema() as s:
        s.drop_vector_index("emb")
    without = store.read().g().V().nearest("emb", _Q, 5).id().to_df()
    return with_index.select(F.lit("euclidean").alias("metric"), F.col("value").alias("id")).unionByName(without.select(F.lit("none").alias("metric"), F.col("value").alias("id")))


@stored("index_maintenance", "SELECT count(emb) AS vectors FROM v")
def index_maintenance(spark: SparkSession, folder: str) -> DataFrame:
    manager = items(spark, folder, "cosine").index_manager()
    manager.save("emb")
    manager.save_all()
    return spark.createDataFrame([(manager.rebuild("emb"),)], "vectors long")


@stored("index_limits", "VALUES ('dimension of a query', TRUE), ('dimension of a vector', TRUE), ('negative id', TRUE), ('edge', TRUE), ('good vector', FALSE)")
def index_limits(spark: SparkSession, folder: str) -> DataFrame:
    store = items(spark, folder, "cosine")
    t, whole = store.begin(), [0.5] * 64
    add = lambda i, x: t.g().addV("item").property("id", i).property("emb", x).iterate()
    tries = {
        "dimension of a query": lambda: store.read().g().V().nearest("emb", [1.0], 1), "dimension of a vector": lambda: add(1, [1.0, 2.0]),
        "negative id": lambda: add(-1, whole), "good vector": lambda: add(1, whole),
        "edge": lambda: t.g().addE("like").from_(1).to(1).property("emb", whole).iterate(),
    }
    rows = [(what, refused(VectorIndexError, (lambda a=act: a().to_list()) if what.endswith("query") else act)) for what, act in tries.items()]
    return spark.createDataFrame(rows, "col0 string, col1 boolean")


# bulk loads
@stored("bulk_vertices", "SELECT id, label, name, acctbal, mktsegment FROM v WHERE label IN ('region', 'nation', 'customer', 'supplier')")
def bulk_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return places(spark, folder).read().g().V().withProperties("name", "acctbal", "mktsegment").to_df()


@stored("bulk_edges_single", "SELECT src, label, dst, 0 AS rank FROM e WHERE label IN ('in_region', 'in_nation')")
def bulk_edges_single(spark: SparkSession, folder: str) -> DataFrame:
    return places(spark, folder, edge_mode="single").read().g().E().to_df()


@stored("bulk_edges_multi", "SELECT src, dst, rank, linenumber FROM e WHERE label = 'contains'")
def bulk_edges_multi(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all orders, ranked by the loader among parallel ones."""
    store = GraphStore(spark, scratch(spark), edge_mode="multi")
    line = spark.read.parquet(f"{folder}/lineitem.parquet")
    number = F.row_number().over(Window.partitionBy("src", "dst").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    lines = line.withColumns({"src": F.lit(vid("order", 0)) + F.col("l_orderkey"), "dst": F.lit(vid("part", 0)) + F.col("l_partkey")})
    lines = lines.select("src", F.lit("contains").alias("label"), "dst", number.alias("at"), F.col("l_linenumber").cast("int").alias("linenumber"))
    with store.open_bulk_loader() as loader:
        loader.load_vertices(vertices_of(spark, folder, "order", "part")).load_edges(lines).commit()
    return store.read().g().E().withProperties("linenumber").to_df().select("src", "dst", "rank", "linenumber")


@stored("bulk_endpoint_check", "SELECT TRUE AS refused, count(*) AS vertices FROM v WHERE label = 'nation'")
def bulk_endpoint_check(spark: SparkSession, folder: str) -> DataFrame:
    """Edges to regions that are not loaded are refused, and what was loaded before them is no version."""
    store = GraphStore(spark, scratch(spark))
    nations = vertices_of(spark, folder, "nation")
    with store.open_bulk_loader() as loader:
        no = refused(SchemaViolation, lambda: loader.load_vertices(nations).load_edges(edges_of(spark, folder, "in_region")))
    with store.open_bulk_loader() as loader:
        loader.load_vertices(nations).commit()
    return store.read().g().V().count().to_df().select(F.lit(no).alias("refused"), F.col("value").alias("vertices"))


@stored("bulk_degrees", "SELECT v.id, count(x.a) AS n FROM v LEFT JOIN (SELECT src AS a, label FROM e UNION ALL SELECT dst, label FROM e) x ON x.a = v.id AND x.label IN ('in_region', 'in_nation') WHERE v.label IN ('nation', 'region') GROUP BY v.id")
def bulk_degrees(spark: SparkSession, folder: str) -> DataFrame:
    t = places(spark, folder).read().g().V().hasLabel("nation", "region").as_("a").degree("both")
    return t._source.run(t.steps).df.select(F.col("__t_a.v").alias("id"), F.col("v").alias("n"))


@stored("bulk_sorted_files", "SELECT label, count(*) AS n, 0::BIGINT AS out_of_order FROM e WHERE label IN ('in_region', 'in_nation') GROUP BY label")
def bulk_sorted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Edges lie sorted by label and source in each file."""
    store = places(spark, folder)
    rows = store.open().edges.select("label", "src", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    before = Window.partitionBy("f").orderBy("i")
    rows = rows.withColumn("wrong", F.lag(F.struct("label", "src")).over(before) > F.struct("label", "src"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("wrong"), 1)).alias("out_of_order"))


@stored("bulk_stats", "SELECT (SELECT count(*) FROM v WHERE label IN ('order', 'part', 'event')) AS vertices, (SELECT count(*) FROM e WHERE label IN ('contains', 'next')) AS edges, TRUE AS timed, TRUE AS files")
def bulk_stats(spark: SparkSession, folder: str) -> DataFrame:
    store = GraphStore(spark, scratch(spark), edge_mode="multi")
    with store.open_bulk_loader() as loader:
        loader.load_vertices(vertices_of(spark, folder, "order", "part", "event"))
        stats = loader.load_edges(edges_of(spark, folder, "contains")).load_edges(edges_of(spark, folder, "next")).commit()
    return spark.createDataFrame([(stats.vertices, stats.edges, stats.seconds > 0, stats.files > 2)], "vertices long, edges long, timed boolean, files boolean")


@stored("bulk_commit", "SELECT 0 AS before, 1 AS after, count(*) AS n FROM e WHERE label = 'supplies'")
def bulk_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Nothing is to be seen before the commit, all of it after."""
    store = GraphStore(spark, scratch(spark))
    with store.open_bulk_loader() as loader:
        loader.load_vertices(vertices_of(spark, folder, "supplier", "part")).load_edges(edges_of(spark, folder, "supplies"))
        before = store.version
        loader.commit()
    return store.read().g().E().count().to_df().select(F.lit(before).alias("before"), F.lit(store.version).alias("after"), F.col("value").alias("n"))


# steps whose other entries say little
@stored("e_by_ids_found", "SELECT src, label, dst, rank FROM e WHERE label = 'in_region'")
def e_by_ids_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a nation and a region by edge id: those that are edges, each once."""
    graph = load(spark, folder)
    keys = [[r[0] for r in graph.vertices.where(F.col("label") == kind).select("id").collect()] for kind in ("nation", "region")]  # 25 and 5
    number = EDGE_LABELS.index("in_region") + 1
    return graph.g().E(*[encode_edge_id(a, number, b, 0) for a in keys[0] for b in keys[1]]).to_df()


@stored("not_next", "SELECT id FROM v WHERE label = 'event' AND id NOT IN (SELECT src FROM e WHERE label = 'next')")
def not_next(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder).g().V().hasLabel("event").not_(__.out("next")).id().to_df().select(F.col("value").alias("id"))
