"""Named traversals over the table graph and the SQL that says the same of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import P
from ..sources import bulk
from ..sources.tables import KINDS, UNIT, load
from . import stored
from .traversal import Traversal, __

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_V = """v AS (
  SELECT 1000000000000 + r_regionkey::BIGINT AS id, 'region' AS label, r_name AS name FROM region
  UNION ALL BY NAME SELECT 2000000000000 + n_nationkey::BIGINT AS id, 'nation' AS label, n_name AS name FROM nation
  UNION ALL BY NAME SELECT 3000000000000 + c_custkey AS id, 'customer' AS label, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer
  UNION ALL BY NAME SELECT 4000000000000 + s_suppkey AS id, 'supplier' AS label, s_name AS name, s_acctbal AS acctbal FROM supplier
  UNION ALL BY NAME SELECT 5000000000000 + p_partkey AS id, 'part' AS label, p_name AS name, p_brand AS brand, p_type AS ptype, p_size AS size, p_retailprice AS retailprice FROM part
  UNION ALL BY NAME SELECT 6000000000000 + o_orderkey AS id, 'order' AS label, o_orderstatus AS orderstatus, o_totalprice AS totalprice, o_orderpriority AS orderpriority, epoch_us(o_orderdate) AS orderdate_us FROM orders
  UNION ALL BY NAME SELECT 7000000000000 + event_id AS id, 'event' AS label, event_type, value, epoch_us(ts) AS ts_us FROM events
  UNION ALL BY NAME SELECT 8000000000000 + vec_id AS id, 'item' AS label, embedding AS emb, embeddings.label AS cls FROM embeddings
  UNION ALL BY NAME SELECT 9000000000000 + doc_id AS id, 'document' AS label, lang, source, n_chars, quality, toxic
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
)"""
_E = """e AS (
  SELECT 2000000000000 + n_nationkey::BIGINT AS src, 'in_region' AS label, 1000000000000 + n_regionkey::BIGINT AS dst, 0 AS rank FROM nation
  UNION ALL BY NAME SELECT 3000000000000 + c_custkey AS src, 'in_nation' AS label, 2000000000000 + c_nationkey::BIGINT AS dst, 0 AS rank FROM customer
  UNION ALL BY NAME SELECT 4000000000000 + s_suppkey AS src, 'in_nation' AS label, 2000000000000 + s_nationkey::BIGINT AS dst, 0 AS rank FROM supplier
  UNION ALL BY NAME SELECT 3000000000000 + o_custkey AS src, 'placed' AS label, 6000000000000 + o_orderkey AS dst, 0 AS rank FROM orders
  UNION ALL BY NAME SELECT 6000000000000 + l_orderkey AS src, 'contains' AS label, 5000000000000 + l_partkey AS dst,
    (row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INTEGER AS rank,
    l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, l_returnflag AS returnflag, l_linestatus AS linestatus, l_linenumber AS linenumber, epoch_us(l_shipdate) AS shipdate_us FROM lineitem
  UNION ALL BY NAME SELECT 6000000000000 + l_orderkey AS src, 'filled_by' AS label, 4000000000000 + l_suppkey AS dst,
    (row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INTEGER AS rank FROM lineitem
  UNION ALL BY NAME SELECT DISTINCT 4000000000000 + l_suppkey AS src, 'supplies' AS label, 5000000000000 + l_partkey AS dst, 0 AS rank FROM lineitem
  UNION ALL BY NAME SELECT 3000000000000 + user_id AS src, 'did' AS label, 7000000000000 + event_id AS dst, 0 AS rank FROM events
  UNION ALL BY NAME SELECT 7000000000000 + event_id AS src, 'next' AS label, 7000000000000 + after AS dst, 0 AS rank
    FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NOT NULL
)"""


def vid(kind: str, key: int) -> int:
    return KINDS[kind] * UNIT + key


def query(name: str, build: Callable[[Traversal], Traversal | DataFrame], sql: str, columns: str = "", recursive: bool = False) -> None:
    """Register a traversal under its result's column names and its SQL over v(ertices) and e(dges)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        got = build(load(spark, folder).g())
        df = got.to_df() if isinstance(got, Traversal) else got
        return df.toDF(*columns.split()) if columns else df

    QUERIES[name] = run
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_V},\n{_E}{',' if recursive else ''}\n{sql}"


def customers(g: Traversal) -> Traversal:
    return g.V().hasLabel("customer")


# sources and adjacency
query("flagship_two_hops", lambda g: customers(g).hasId(P.lt(vid("customer", 100))).out("placed").dedup().out("contains").dedup().count(),
      "SELECT count(DISTINCT c.dst) AS n FROM e p JOIN e c ON c.src = p.dst AND c.label = 'contains' WHERE p.label = 'placed' AND p.src BETWEEN 3000000000000 AND 3000000000099", "n")
query("v_scan_count", lambda g: g.V().count(), "SELECT count(*) AS n FROM v", "n")
query("e_scan_count", lambda g: g.E().count(), "SELECT count(*) AS n FROM e", "n")
query("v_by_ids", lambda g: g.V(vid("customer", 1), vid("part", 2), vid("order", 3), 17), "SELECT id, label FROM v WHERE id IN (3000000000001, 5000000000002, 6000000000003, 17)")
query("v_by_ids_repeated", lambda g: g.V([vid("part", 5), vid("part", 4), vid("part", 5)]).values("name"),
      "SELECT name FROM v JOIN (VALUES (5000000000005), (5000000000004), (5000000000005)) w(i) ON v.id = w.i", "name")
query("v_restart", lambda g: g.V().hasLabel("region").V(vid("nation", 3)).values("name"), "SELECT name FROM v WHERE id = 2000000000003", "name")
query("e_by_ids", lambda g: g.E(_edge("in_region", vid("nation", 1), None), "malformed"), "SELECT src, label, dst, rank FROM e WHERE FALSE")
query("out_1hop", lambda g: g.V().out("placed"), "SELECT v.id, v.label FROM e JOIN v ON v.id = e.dst WHERE e.label = 'placed'")
query("in_1hop", lambda g: g.V().hasLabel("part").in_("contains").count(), "SELECT count(*) AS n FROM e WHERE label = 'contains'", "n")
query("both_1hop", lambda g: g.V().hasLabel("nation").both("in_region", "in_nation").id(),
      "SELECT dst AS id FROM e WHERE label = 'in_region' UNION ALL SELECT src FROM e WHERE label = 'in_nation'", "id")
query("out_all_labels", lambda g: g.V().hasLabel("order").out().count(), "SELECT count(*) AS n FROM e WHERE src BETWEEN 6000000000000 AND 6999999999999", "n")
query("out_repeated_label", lambda g: g.V().hasLabel("nation").out("in_region", "in_region").count(), "SELECT 2 * count(*) AS n FROM e WHERE label = 'in_region'", "n")
query("oute_props", lambda g: g.V().hasLabel("order").has("totalprice", P.gt(400000.0)).outE("contains").withProperties("quantity", "discount"),
      "SELECT e.src, e.label, e.dst, e.rank, e.quantity, e.discount FROM e JOIN v ON v.id = e.src WHERE e.label = 'contains' AND v.totalprice > 400000")
query("ine_props", lambda g: g.V().hasLabel("part").has("size", P.lt(3)).inE("contains").values("quantity"),
      "SELECT e.quantity FROM e JOIN v ON v.id = e.dst WHERE e.label = 'contains' AND v.size < 3", "quantity")
query("bothe_otherv", lambda g: g.V().hasLabel("nation").bothE("in_region", "in_nation").otherV().id(),
      "SELECT dst AS id FROM e WHERE label = 'in_region' UNION ALL SELECT src FROM e WHERE label = 'in_nation'", "id")
query("oute_inv", lambda g: g.V().hasLabel("supplier").outE("supplies").inV().dedup().count(), "SELECT count(DISTINCT dst) AS n FROM e WHERE label = 'supplies'", "n")
query("ine_outv", lambda g: g.V().hasLabel("part").inE("supplies").outV().dedup().id(), "SELECT DISTINCT src AS id FROM e WHERE label = 'supplies'", "id")
query("e_point_lookup", lambda g: g.V(vid("nation", 3)).outE("in_region").where(__.otherV().hasId(vid("region", 1))).id().count(),
      "SELECT count(*) AS n FROM e WHERE label = 'in_region' AND src = 2000000000003 AND dst = 1000000000001", "n")
for _d, _c in (("out", "src"), ("in", "dst")):
    query(f"degree_{_d}", lambda g, d=_d: _pairs(g.V().hasLabel("customer", "nation"), __.degree(d)),
          f"SELECT v.id, count(e.src) AS n FROM v LEFT JOIN e ON e.{_c} = v.id WHERE v.label IN ('customer', 'nation') GROUP BY v.id")
query("degree_both", lambda g: _pairs(g.V().hasLabel("order"), __.degree("both")),
      "SELECT v.id, count(x.a) AS n FROM v LEFT JOIN (SELECT src AS a FROM e UNION ALL SELECT dst FROM e) x ON x.a = v.id WHERE v.label = 'order' GROUP BY v.id")

# predicates
_HAS = {
    "eq": ("mktsegment", P.eq("BUILDING"), "mktsegment = 'BUILDING'"), "ne": ("mktsegment", P.ne("BUILDING"), "mktsegment <> 'BUILDING'"),
    "gt": ("acctbal", P.gt(5000), "acctbal > 5000"), "gte": ("size", P.gte(40), "size >= 40"), "lt": ("acctbal", P.lt(0.0), "acctbal < 0"),
    "lte": ("size", P.lte(5), "size <= 5"), "between": ("size", P.between(10, 20), "size >= 10 AND size < 20"),
    "within": ("brand", P.within("Brand#11", "Brand#23"), "brand IN ('Brand#11', 'Brand#23')"),
    "without": ("orderstatus", P.without("F", "O"), "orderstatus NOT IN ('F', 'O')"),
}
for _n, (_k, _p, _w) in _HAS.items():
    query(f"has_{_n}", lambda g, k=_k, p=_p: g.V().has(k, p).id(), f"SELECT id FROM v WHERE {_w}", "id")
query("has_exists", lambda g: g.V().has("acctbal").count(), "SELECT count(acctbal) AS n FROM v", "n")
query("has_label_key", lambda g: g.V().has("supplier", "acctbal", P.gt(9000.0)).id(), "SELECT id FROM v WHERE label = 'supplier' AND acctbal > 9000", "id")
query("has_cross_kind", lambda g: g.V().has("size", "2").count(), "SELECT 0::BIGINT AS n", "n")
query("has_int_as_float", lambda g: g.V().has("size", 2.0).count(), "SELECT count(*) AS n FROM v WHERE size = 2", "n")
query("haslabel_within", lambda g: g.V().hasLabel("region", "nation").id(), "SELECT id FROM v WHERE label IN ('region', 'nation')", "id")
query("haslabel_ne", lambda g: g.V().hasLabel(P.ne("event")).count(), "SELECT count(*) AS n FROM v WHERE label <> 'event'", "n")
query("haslabel_none", lambda g: g.V().hasLabel([]).count(), "SELECT 0::BIGINT AS n", "n")
query("hasid_between", lambda g: g.V().hasId(P.between(vid("part", 10), vid("part", 20))), "SELECT id, label FROM v WHERE id >= 5000000000010 AND id < 5000000000020")
query("hasrank_gt", lambda g: g.E().hasLabel("contains").hasRank(P.gt(0)), "SELECT src, label, dst, rank FROM e WHERE label = 'contains' AND rank > 0")
query("is_gt", lambda g: g.V().values("totalprice").is_(P.gt(450000.0)), "SELECT totalprice AS x FROM v WHERE totalprice > 450000", "x")

# projections
query("values_multi", lambda g: g.V().hasLabel("part").has("size", P.lt(4)).values("name", "size"),
      "SELECT 's' AS tag, name AS value FROM v WHERE label = 'part' AND size < 4 UNION ALL SELECT 'i', size::VARCHAR FROM v WHERE label = 'part' AND size < 4", "tag value")
query("values_all", lambda g: g.V().hasLabel("customer").values().count(), "SELECT 3 * count(*) AS n FROM customer", "n")
query("properties_multi", lambda g: g.V().hasLabel("supplier").properties("name", "acctbal").to_df().where("key = 'name'").select("owner.l", "key", "value"),
      "SELECT id, 'name' AS key, name AS value FROM v WHERE label = 'supplier'", "id key value")
query("edge_id", lambda g: g.E().hasLabel("contains").id().dedup().count(), "SELECT count(*) AS n FROM e WHERE label = 'contains'", "n")
query("vertex_id", lambda g: g.V().hasLabel("item").id(), "SELECT id FROM v WHERE label = 'item'", "id")
query("label_step", lambda g: g.V().label().dedup(), "SELECT DISTINCT label FROM v", "label")
query("rank_step", lambda g: g.E().hasLabel("filled_by").rank().groupCount(), "SELECT rank AS key, count(*) AS value FROM e WHERE label = 'filled_by' GROUP BY rank")
query("constant_step", lambda g: g.V().hasLabel("region").constant("x"), "SELECT 'x' AS x FROM region", "x")
query("identity_step", lambda g: g.V().hasLabel("nation").identity().values("name"), "SELECT n_name AS name FROM nation", "name")
query("with_properties", lambda g: g.V().hasLabel("customer").has("acctbal", P.gt(9500.0)).withProperties("name", "acctbal"),
      "SELECT id, label, name, acctbal FROM v WHERE label = 'customer' AND acctbal > 9500")
query("fold_unfold", lambda g: g.V().hasLabel("part").values("size").fold().unfold().sum(), "SELECT sum(size)::BIGINT AS n FROM v", "n")
query("missing_properties", lambda g: g.V().hasLabel("document").has("toxic", P.ne(1)).count(), "SELECT count(*) AS n FROM v WHERE label = 'document' AND toxic <> 1", "n")

# barriers
query("dedup_vertices", lambda g: customers(g).out("in_nation").dedup().id(), "SELECT DISTINCT dst AS id FROM e WHERE label = 'in_nation' AND src BETWEEN 3000000000000 AND 3999999999999", "id")
query("dedup_edges_bothe", lambda g: g.V().hasLabel("nation", "region").bothE("in_region").dedup(), "SELECT src, label, dst, rank FROM e WHERE label = 'in_region'")
query("dedup_values", lambda g: g.V().values("mktsegment").dedup(), "SELECT DISTINCT mktsegment AS x FROM v WHERE mktsegment IS NOT NULL", "x")
query("sum_int", lambda g: g.V().values("size").sum(), "SELECT sum(size)::BIGINT AS x FROM v", "x")
query("sum_float", lambda g: _rounded(g.V().values("acctbal").sum(), 2), "SELECT round(sum(acctbal), 2) AS value FROM v")
query("sum_mixed", lambda g: g.V().hasLabel("part").values("size", "name").sum().to_df().select(F.col("value").cast("bigint")), "SELECT sum(size)::BIGINT AS x FROM v", "x")
query("mean", lambda g: _rounded(g.V().values("totalprice").mean(), 4), "SELECT round(avg(totalprice), 4) AS value FROM v")
query("max_", lambda g: g.V().values("totalprice").max(), "SELECT max(totalprice) AS x FROM v", "x")
query("min_", lambda g: g.V().values("size").min(), "SELECT min(size)::BIGINT AS x FROM v", "x")
query("max_of_strings", lambda g: g.V().values("mktsegment").max(), "SELECT NULL::DOUBLE AS x", "x")
query("count_empty", lambda g: g.V().has("name", "no such name").out().count(), "SELECT 0::BIGINT AS n", "n")
query("sum_empty", lambda g: g.V().has("name", "no such name").values("size").sum(), "SELECT NULL::BIGINT AS n", "n")
query("group_by_segment", lambda g: _lists(customers(g).group().by("mktsegment")),
      "SELECT mktsegment AS key, count(*) AS n, min(id) AS low, max(id) AS high FROM v WHERE mktsegment IS NOT NULL GROUP BY 1")
query("group_value", lambda g: _lists(g.V().hasLabel("supplier").out("in_nation").group()), "SELECT dst AS key, count(*) AS n, dst AS low, dst AS high FROM e WHERE label = 'in_nation' AND src >= 4000000000000 GROUP BY 1")
query("groupcount_label", lambda g: g.V().label().groupCount(), "SELECT label AS key, count(*) AS value FROM v GROUP BY label")
query("groupcount_by", lambda g: g.V().hasLabel("order").groupCount().by("orderpriority"), "SELECT orderpriority AS key, count(*) AS value FROM v WHERE label = 'order' GROUP BY 1")
query("group_fold_size", lambda g: g.V().hasLabel("part").values("size").fold().to_df().select(F.size("value").cast("bigint"), F.array_max("value")),
      "SELECT count(*) AS n, max(size) AS top FROM v WHERE label = 'part'", "n top")

# order and slices
query("order_by_1", lambda g: g.V().hasLabel("supplier").order().by("acctbal", "desc").values("name"), "SELECT name FROM v WHERE label = 'supplier'", "name")
query("order_by_2", lambda g: g.V().hasLabel("part").order().by("size", "desc").by("name").limit(15).withProperties("size", "name"),
      "SELECT id, label, size, name FROM v WHERE label = 'part' ORDER BY size DESC, name, id LIMIT 15")
query("topk_limit", lambda g: g.V().hasLabel("order").order().by("totalprice", "desc").limit(10).id(), "SELECT id FROM v WHERE label = 'order' ORDER BY totalprice DESC, id LIMIT 10", "id")
query("limit_in_emission_order", lambda g: customers(g).limit(7).id(), "SELECT id FROM v WHERE label = 'customer' ORDER BY id LIMIT 7", "id")
query("range_", lambda g: g.V().hasLabel("part").order().by("retailprice").range(5, 12).id(), "SELECT id FROM v WHERE label = 'part' ORDER BY retailprice, id LIMIT 7 OFFSET 5", "id")
query("skip_", lambda g: g.V().hasLabel("nation").order().by("name").skip(20).values("name"), "SELECT n_name AS name FROM nation ORDER BY n_name OFFSET 20", "name")
query("tail_", lambda g: g.V().hasLabel("customer").tail(5).id(), "SELECT id FROM v WHERE label = 'customer' ORDER BY id DESC LIMIT 5", "id")
query("order_values", lambda g: g.V().values("retailprice").order().limit(3), "SELECT retailprice AS x FROM v WHERE retailprice IS NOT NULL ORDER BY 1 LIMIT 3", "x")

# filters by sub-traversal
query("where_out", lambda g: customers(g).where(__.out("placed")).id(), "SELECT DISTINCT src AS id FROM e WHERE label = 'placed'", "id")
query("where_otherv_has", lambda g: g.V().hasLabel("nation").outE("in_region").where(__.otherV().has("name", "ASIA")).outV().values("name"),
      "SELECT a.name FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE e.label = 'in_region' AND b.name = 'ASIA'", "name")
query("where_count_gt", lambda g: customers(g).where(__.out("placed").count().is_(P.gt(15))).id(), "SELECT src AS id FROM e WHERE label = 'placed' GROUP BY src HAVING count(*) > 15", "id")
query("where_nested", lambda g: customers(g).where(__.out("placed").where(__.out("contains").has("size", P.gt(49)))).count(),
      "SELECT count(DISTINCT p.src) AS n FROM e p JOIN e c ON c.src = p.dst AND c.label = 'contains' JOIN v ON v.id = c.dst AND v.size > 49 WHERE p.label = 'placed'", "n")
query("where_values", lambda g: g.V().hasLabel("part").where(__.values("size").is_(P.lt(2))).id(), "SELECT id FROM v WHERE label = 'part' AND size < 2", "id")
query("not_out", lambda g: customers(g).not_(__.out("placed")).id(), "SELECT id FROM v WHERE label = 'customer' AND id NOT IN (SELECT src FROM e WHERE label = 'placed')", "id")
query("and_", lambda g: customers(g).and_(__.out("placed"), __.has("acctbal", P.gt(5000.0))).id(),
      "SELECT id FROM v WHERE label = 'customer' AND acctbal > 5000 AND id IN (SELECT src FROM e WHERE label = 'placed')", "id")
query("or_", lambda g: customers(g).or_(__.not_(__.out("placed")), __.has("acctbal", P.lt(0.0))).id(),
      "SELECT id FROM v WHERE label = 'customer' AND (acctbal < 0 OR id NOT IN (SELECT src FROM e WHERE label = 'placed'))", "id")
query("or_local", lambda g: g.V().or_(__.has("size", 1), __.hasLabel("region")).id(), "SELECT id FROM v WHERE size = 1 OR label = 'region'", "id")

# branches
query("union_branches", lambda g: g.V().hasLabel("nation").union(__.out("in_region"), __.in_("in_nation")).id(),
      "SELECT dst AS id FROM e WHERE label = 'in_region' UNION ALL SELECT src FROM e WHERE label = 'in_nation'", "id")
query("union_scoped_count", lambda g: g.V().hasLabel("nation").union(__.out("in_region").count(), __.in_("in_nation").count()),
      "SELECT (SELECT count(*) FROM e WHERE e.src = v.id AND e.label = 'in_region') AS n FROM v WHERE label = 'nation' UNION ALL SELECT (SELECT count(*) FROM e WHERE e.dst = v.id AND e.label = 'in_nation') FROM v WHERE label = 'nation'", "n")
query("union_mixed", lambda g: g.V().hasLabel("region").union(__.id(), __.values("name")), "SELECT 'i' AS tag, id::VARCHAR AS value FROM v WHERE label = 'region' UNION ALL SELECT 's', name FROM v WHERE label = 'region'", "tag value")
query("coalesce_first", lambda g: customers(g).coalesce(__.out("placed"), __.out("in_nation")).count(),
      "SELECT (SELECT count(*) FROM e WHERE label = 'placed') + (SELECT count(*) FROM e WHERE label = 'in_nation' AND src < 4000000000000 AND src NOT IN (SELECT src FROM e WHERE label = 'placed')) AS n", "n")
query("choose_if", lambda g: customers(g).choose(__.has("acctbal", P.gt(0.0)), __.constant("credit"), __.constant("debt")).groupCount(),
      "SELECT CASE WHEN acctbal > 0 THEN 'credit' ELSE 'debt' END AS key, count(*) AS value FROM v WHERE label = 'customer' GROUP BY 1")
query("choose_without_else", lambda g: g.V().hasLabel("nation", "region").choose(__.hasLabel("nation"), __.out("in_region")).id(),
      "SELECT dst AS id FROM e WHERE label = 'in_region' UNION ALL SELECT id FROM v WHERE label = 'region'", "id")
query("local_count", lambda g: customers(g).local(__.out("placed").count()), "SELECT (SELECT count(*) FROM e WHERE e.src = v.id AND e.label = 'placed') AS n FROM v WHERE label = 'customer'", "n")
query("local_limit", lambda g: customers(g).local(__.out("placed").limit(2)).id(),
      "SELECT dst AS id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e WHERE label = 'placed') WHERE k <= 2", "id")
query("local_order_limit", lambda g: customers(g).local(__.out("placed").order().by("totalprice", "desc").limit(1)).id(),
      "SELECT id FROM (SELECT v.id, row_number() OVER (PARTITION BY e.src ORDER BY v.totalprice DESC, v.id) AS k FROM e JOIN v ON v.id = e.dst WHERE e.label = 'placed') WHERE k = 1", "id")
query("local_sum", lambda g: g.V().hasLabel("nation").local(__.in_("in_nation").count().sum()), "SELECT (SELECT count(*) FROM e WHERE e.dst = v.id AND e.label = 'in_nation') AS n FROM v WHERE label = 'nation'", "n")

# labels and paths
query("as_select", lambda g: g.V().hasLabel("nation").as_("n").out("in_region").has("name", "EUROPE").select("n").values("name"),
      "SELECT a.name FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE e.label = 'in_region' AND b.name = 'EUROPE'", "name")
query("path_3", lambda g: _paths(g.V().hasLabel("supplier").out("in_nation").out("in_region").path()),
      "SELECT concat_ws('-', a.src, a.dst, b.dst) AS path FROM e a JOIN e b ON b.src = a.dst AND b.label = 'in_region' WHERE a.label = 'in_nation' AND a.src >= 4000000000000")
query("simple_path", lambda g: g.V().hasLabel("nation").out("in_region").in_("in_region").simplePath().count(),
      "SELECT count(*) AS n FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src WHERE a.label = 'in_region' AND b.label = 'in_region'", "n")
query("cyclic_path", lambda g: g.V().hasLabel("nation").out("in_region").in_("in_region").cyclicPath().count(), "SELECT count(*) AS n FROM e WHERE label = 'in_region'", "n")
query("repeat_times2", lambda g: g.V().hasLabel("supplier").repeat(__.out("in_nation", "in_region")).times(2).groupCount(),
      "SELECT b.dst AS key, count(*) AS value FROM e a JOIN e b ON b.src = a.dst AND b.label = 'in_region' WHERE a.label = 'in_nation' AND a.src >= 4000000000000 GROUP BY 1")
query("repeat_times3_emit", lambda g: g.V().hasLabel("event").hasId(P.lt(vid("event", 300))).repeat(__.out("next")).times(3).emit().id(),
      "r(id, d) AS (SELECT id, 0 FROM v WHERE label = 'event' AND id < 7000000000300 UNION ALL SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id AND e.label = 'next' WHERE d < 3) SELECT id FROM r WHERE d > 0", "id", True)
query("repeat_until", lambda g: g.V().hasLabel("event").hasId(P.lt(vid("event", 40))).repeat(__.out("next")).until(__.has("event_type", "purchase")).id(),
      "r(id, stop) AS (SELECT id, FALSE FROM v WHERE label = 'event' AND id < 7000000000040 UNION ALL SELECT e.dst, coalesce(v.event_type = 'purchase', FALSE) FROM r JOIN e ON e.src = r.id AND e.label = 'next' JOIN v ON v.id = e.dst WHERE NOT stop) SELECT id FROM r WHERE stop", "id", True)
query("repeat_emit_if", lambda g: g.V().hasLabel("event").hasId(P.lt(vid("event", 200))).repeat(__.out("next")).times(4).emit_if(__.has("event_type", "click")).id(),
      "r(id, d) AS (SELECT id, 0 FROM v WHERE label = 'event' AND id < 7000000000200 UNION ALL SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id AND e.label = 'next' WHERE d < 4) SELECT id FROM r JOIN v USING (id) WHERE d = 4 OR d > 0 AND v.event_type = 'click'", "id", True)
query("repeat_dedup_scoped", lambda g: g.V().hasLabel("supplier").repeat(__.both("in_nation").dedup()).times(2).count(),
      "SELECT count(*) AS n FROM (SELECT DISTINCT a.src, b.src FROM e a JOIN e b ON a.dst = b.dst WHERE a.label = 'in_nation' AND b.label = 'in_nation' AND a.src >= 4000000000000)", "n")

# vectors
_COS = "list_inner_product(emb::DOUBLE[], q) / (sqrt(list_inner_product(emb::DOUBLE[], emb::DOUBLE[])) * sqrt(list_inner_product(q, q)))"
_Q = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
_QSQL = f"[{', '.join(map(str, _Q))}]::DOUBLE[]"
query("similarity", lambda g: g.V().hasLabel("item").similarity("emb", _Q).to_df().select(F.round(F.col("value").cast("double"), 4).alias("s")),
      f"SELECT round(({_COS})::FLOAT::DOUBLE, 4) AS s FROM v, (SELECT {_QSQL} AS q) WHERE label = 'item'")
query("nearest_10", lambda g: g.V().nearest("emb", _Q, 10).id(), f"SELECT id FROM v, (SELECT {_QSQL} AS q) WHERE emb IS NOT NULL ORDER BY {_COS} DESC, id LIMIT 10", "id")
query("nearest_filtered", lambda g: g.V().has("cls", 3).nearest("emb", _Q, 5).with_ef_search(64).id(), f"SELECT id FROM v, (SELECT {_QSQL} AS q) WHERE cls = 3 ORDER BY {_COS} DESC, id LIMIT 5", "id")
query("neighbors_3", lambda g: g.V().hasLabel("item").hasId(P.lt(vid("item", 20))).as_("a").neighbors("emb", 3).to_df().select("id"),
      "SELECT o AS id FROM (SELECT b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.emb::DOUBLE[], b.emb::DOUBLE[]), 12) DESC, b.id) AS k FROM v a JOIN v b ON a.id <> b.id AND b.label = 'item' WHERE a.label = 'item' AND a.id < 8000000000020) WHERE k <= 3")

# the same steps over whole tables
query("flagship_two_hops_all", lambda g: customers(g).out("placed").dedup().out("contains").dedup().count(),
      "SELECT count(DISTINCT c.dst) AS n FROM e p JOIN e c ON c.src = p.dst AND c.label = 'contains' WHERE p.label = 'placed'", "n")
query("repeat_times3_emit_all", lambda g: g.V().hasLabel("event").repeat(__.out("next")).times(3).emit().id(),
      "r(id, d) AS (SELECT id, 0 FROM v WHERE label = 'event' UNION ALL SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id AND e.label = 'next' WHERE d < 3) SELECT id FROM r WHERE d > 0", "id", True)
query("repeat_until_all", lambda g: g.V().hasLabel("event").repeat(__.out("next")).until(__.has("event_type", "purchase")).id(),
      "r(id, stop) AS (SELECT id, FALSE FROM v WHERE label = 'event' UNION ALL SELECT e.dst, coalesce(v.event_type = 'purchase', FALSE) FROM r JOIN e ON e.src = r.id AND e.label = 'next' JOIN v ON v.id = e.dst WHERE NOT stop) SELECT id FROM r WHERE stop", "id", True)
query("repeat_emit_if_all", lambda g: g.V().hasLabel("event").repeat(__.out("next")).times(4).emit_if(__.has("event_type", "click")).id(),
      "r(id, d) AS (SELECT id, 0 FROM v WHERE label = 'event' UNION ALL SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id AND e.label = 'next' WHERE d < 4) SELECT id FROM r JOIN v USING (id) WHERE d = 4 OR d > 0 AND v.event_type = 'click'", "id", True)
# no SQL: all pairs of items; tested against brute force
QUERIES["neighbors_3_all"] = lambda spark, folder: load(spark, folder).g().V().hasLabel("item").as_("a").neighbors("emb", 3).to_df().select("id")


# writes, sessions, schemas, indexes and loads
QUERIES |= stored.QUERIES
ORACLES |= {name: f"WITH {_V},\n{_E}\n{sql}" for name, sql in stored.SQL.items()}


# bulk ingest
def _line_edges(spark: SparkSession, folder: str) -> DataFrame:
    line = spark.read.parquet(f"{folder}/lineitem.parquet")
    explicit = F.when(F.col("l_linenumber") == 1, F.lit(3))
    return line.select("l_orderkey", "l_suppkey", explicit.alias("rank"), "l_linenumber", "l_partkey").dropDuplicates(["l_orderkey", "l_suppkey", "l_linenumber"])


QUERIES["bulk_rank_assign"] = lambda spark, folder: (
    bulk.assign_ranks(
        _line_edges(spark, folder).select(F.col("l_orderkey").alias("src"), F.lit("x").alias("label"), F.col("l_suppkey").alias("dst"), "rank", "l_linenumber"), ["l_linenumber"]
    ).select("src", "dst", "rank", "l_linenumber")
)
ORACLES["bulk_rank_assign"] = """
WITH t AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst, l_linenumber, CASE WHEN l_linenumber = 1 THEN 3 END AS r FROM lineitem)
SELECT src, dst, l_linenumber,
  coalesce(r, coalesce(max(r) OVER (PARTITION BY src, dst), -1) + row_number() OVER (PARTITION BY src, dst, r IS NULL ORDER BY l_linenumber))::INTEGER AS rank FROM t"""
QUERIES["bulk_dangling_check"] = lambda spark, folder: bulk.dangling(
    load(spark, folder).vertices.where("label <> 'region'"), load(spark, folder).edges.where("label = 'in_region'")
).select("src", "dst")
ORACLES["bulk_dangling_check"] = f"WITH {_V},\n{_E}\nSELECT src, dst FROM e WHERE label = 'in_region'"


def _edge(label: str, src: int, dst: int | None) -> str:
    from ..functions.values import encode_edge_id
    from ..sources.tables import EDGE_LABELS

    return encode_edge_id(src, EDGE_LABELS.index(label) + 1, -1 if dst is None else dst, 0)


def _pairs(t: Traversal, sub: Traversal) -> DataFrame:
    """(id, n): a value of every vertex beside the vertex itself."""
    frame = t.as_("a")._source.run((*t.as_("a").steps, *sub.steps))
    return frame.df.select(F.col("__t_a.v").alias("id"), F.col("v").alias("n"))


def _rounded(t: Traversal, digits: int) -> DataFrame:
    return t.to_df().select(F.round("value", digits).alias("value"))


def _lists(t: Traversal) -> DataFrame:
    df = t.to_df()
    return df.select("key", F.size("value").cast("bigint").alias("n"), F.array_min("value").alias("low"), F.array_max("value").alias("high"))


def _paths(t: Traversal) -> DataFrame:
    return t.to_df().select(F.array_join(F.transform("value", lambda x: x["obj"]["l"].cast("string")), "-").alias("path"))
