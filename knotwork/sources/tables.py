"""The synthetic tables as one property graph.

A vertex id is kind * 10^12 + key.  Vertices and edges are unions of the tables, one branch for each
label; a label or property that a traversal asks for prunes the branches that cannot have it, because
theirs is a constant.  Ranks of parallel edges are numbered in a window that is only there if a rank is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .registry import Registry, VectorIndex

UNIT = 10**12
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "event": 7, "item": 8, "document": 9}
EDGE_LABELS = ["in_region", "in_nation", "placed", "contains", "filled_by", "supplies", "did", "next"]
_LINE = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def vertex_id(kind: str, key: Column | str | int) -> Column:
    key = F.lit(key) if isinstance(key, int) else F.col(key) if isinstance(key, str) else key
    return F.lit(KINDS[kind] * UNIT).cast("bigint") + key.cast("bigint")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def load(spark: SparkSession, folder: str) -> PropertyGraph:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def vertices(kind: str, df: DataFrame, key: str, **props: Column) -> DataFrame:
        return df.select(vertex_id(kind, key).alias("id"), F.lit(kind).alias("label"), *[c.alias(k) for k, c in props.items()])

    c = F.col
    line = table("lineitem")
    events = table("events")
    marks = table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    parts = [
        vertices("region", table("region"), "r_regionkey", name=c("r_name")),
        vertices("nation", table("nation"), "n_nationkey", name=c("n_name")),
        vertices("customer", table("customer"), "c_custkey", name=c("c_name"), acctbal=c("c_acctbal"), mktsegment=c("c_mktsegment")),
        vertices("supplier", table("supplier"), "s_suppkey", name=c("s_name"), acctbal=c("s_acctbal")),
        vertices(
            "part", table("part"), "p_partkey", name=c("p_name"), brand=c("p_brand"), ptype=c("p_type"), size=c("p_size").cast("int"), retailprice=c("p_retailprice")
        ),
        vertices(
            "order", table("orders"), "o_orderkey", orderstatus=c("o_orderstatus"), totalprice=c("o_totalprice"), orderpriority=c("o_orderpriority"), orderdate_us=micros("o_orderdate")
        ),
        vertices("event", events, "event_id", event_type=c("event_type"), value=c("value"), ts_us=micros("ts")),
        vertices("item", table("embeddings"), "vec_id", emb=c("embedding"), cls=c("label").cast("int")),
        vertices(
            "document", table("documents").join(marks, "doc_id", "left"), "doc_id",
            lang=c("lang"), source=c("source"), n_chars=c("n_chars"), quality=c("quality").cast("int"), toxic=c("toxic").cast("int"),
        ),
    ]

    def edges(label: str, df: DataFrame, src: Column, dst: Column, rank: Column | None = None, **props: Column) -> DataFrame:
        rank = F.lit(0) if rank is None else rank
        return df.select(src.alias("src"), F.lit(label).alias("label"), dst.alias("dst"), rank.cast("int").alias("rank"), *[p.alias(k) for k, p in props.items()])

    def number(*ends: str) -> Column:
        return F.row_number().over(Window.partitionBy(*ends).orderBy(*_LINE)) - 1

    line_props = {
        "quantity": c("l_quantity"), "extendedprice": c("l_extendedprice"), "discount": c("l_discount"), "tax": c("l_tax"),
        "returnflag": c("l_returnflag"), "linestatus": c("l_linestatus"), "linenumber": c("l_linenumber").cast("int"), "shipdate_us": micros("l_shipdate"),
    }
    following = events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("after")).where("after IS NOT NULL")
    links = [
        edges("in_region", table("nation"), vertex_id("nation", "n_nationkey"), vertex_id("region", "n_regionkey")),
        edges("in_nation", table("customer"), vertex_id("customer", "c_custkey"), vertex_id("nation", "c_nationkey")),
        edges("in_nation", table("supplier"), vertex_id("supplier", "s_suppkey"), vertex_id("nation", "s_nationkey")),
        edges("placed", table("orders"), vertex_id("customer", "o_custkey"), vertex_id("order", "o_orderkey")),
        edges("contains", line, vertex_id("order", "l_orderkey"), vertex_id("part", "l_partkey"), number("l_orderkey", "l_partkey"), **line_props),
        edges("filled_by", line, vertex_id("order", "l_orderkey"), vertex_id("supplier", "l_suppkey"), number("l_orderkey", "l_suppkey")),
        edges("supplies", line.select("l_suppkey", "l_partkey").distinct(), vertex_id("supplier", "l_suppkey"), vertex_id("part", "l_partkey")),
        edges("did", events, vertex_id("customer", "user_id"), vertex_id("event", "event_id")),
        edges("next", following, vertex_id("event", "event_id"), vertex_id("event", "after")),
    ]
    join = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    registry = Registry(edge_mode="multi", vertex_labels=list(KINDS), edge_labels=list(EDGE_LABELS))
    graph = PropertyGraph(join(parts), join(links), registry)
    graph.registry.indexes["emb"] = VectorIndex("emb", 64)
    return graph
