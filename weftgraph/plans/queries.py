"""The registered graph queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import aggregates as A
from weftgraph.functions import scalar as S
from weftgraph.operators import cycles, ordered, paths, schema, text, vector, writes
from weftgraph.operators.bound import BoundPairs
from weftgraph.operators.counting import Hop, times
from weftgraph.operators.match import nulls_first, nulls_last, relationships, start, v
from weftgraph.operators.procedures import call_procedure
from weftgraph.operators.vector_index import build_index
from weftgraph.operators.versions import End, Graph, Pattern, Versions, delete_edges, merge
from weftgraph.plans.lineage import materialized
from weftgraph.sources.catalog import GraphCatalog
from weftgraph.sources.tables import star_graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def money(x: Column) -> Column:
    """A sum of money that does not depend on the order of its addends."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


@query("""SELECT c_mktsegment AS segment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    m = start(star_graph(spark, d), "c", "Customer").out("c", "PLACED", "o").where(v("o.o_totalprice") > 100000)
    return m.returns_grouped({"segment": v("c.c_mktsegment")}, orders=A.count(), total=money(v("o.o_totalprice")))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def scan_label(spark, d):
    return start(star_graph(spark, d), "r", "Region").returns(id=v("r.id"), name=v("r.r_name"))


@query("SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Vector', count(*) FROM embeddings UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
def scan_all_nodes(spark, d):
    return star_graph(spark, d).all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def scan_where(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").where((v("c.c_acctbal") > 9000) & (v("c.c_mktsegment") == "BUILDING"))
    return m.returns(id=v("c.id"), name=v("c.c_name"))


@query("SELECT p_partkey AS id FROM part WHERE p_size = 10 AND p_brand = 'Brand#13'")
def inline_map(spark, d):
    wanted = {"p_size": 10, "p_brand": "Brand#13"}
    m = start(star_graph(spark, d), "p", "Part")
    for k, x in wanted.items():
        m = m.where(v(f"p.{k}") == x)
    return m.returns(id=v("p.id"))


@query("SELECT c_custkey AS customer, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%'")
def hop_out(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").out("c", "PLACED", "o").where(v("o.o_orderpriority").startswith("1"))
    return m.returns(customer=v("c.id"), o=v("o.id"))


@query("SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def hop_in(spark, d):
    m = start(star_graph(spark, d), "o", "Order").where(v("o.o_totalprice") > 300000).into("o", "PLACED", "c")
    return m.returns(o=v("o.id"), name=v("c.c_name"))


_NEXT = "nxt AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT * FROM nxt WHERE dst IS NOT NULL)"


@query(f"WITH {_NEXT}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst) SELECT event_type AS type, count(*) AS n FROM events JOIN b ON src = event_id GROUP BY 1")
def hop_undirected(spark, d):
    m = start(star_graph(spark, d), "a", "Event").both("a", "NEXT", "b")
    return m.returns_grouped({"type": v("a.event_type")}, n=A.count())


@query("""SELECT r_name AS region, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def hop3_region_rollup(spark, d):
    m = start(star_graph(spark, d), "r", "Region").into("r", "IN_REGION", "n").into("n", "CUSTOMER_OF", "c").out("c", "PLACED", "o")
    return m.returns_grouped({"region": v("r.r_name")}, orders=A.count(), total=money(v("o.o_totalprice")))


@query("SELECT p_brand AS brand, count(*) AS lines, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1".replace("sum(", "CAST(sum(", 1).replace("BIGINT)) AS", "BIGINT)) AS BIGINT) AS", 1))
def hop_edge_properties(spark, d):
    m = start(star_graph(spark, d), "o", "Order").where(v("o.o_orderstatus") == "F").out("o", "CONTAINS", "p", rel="l")
    return m.returns_grouped({"brand": v("p.p_brand")}, lines=A.count(), quantity=F.sum(v("l.l_quantity").cast("long")))


@query("SELECT type, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT 'CONTAINS' AS type, l_orderkey AS src FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', l_orderkey FROM lineitem) GROUP BY 1")
def type_alternatives(spark, d):
    rows = relationships(star_graph(spark, d), ["CONTAINS", "SUPPLIED_BY"])
    return rows.groupBy("type").agg(A.count().alias("n"), F.count_distinct("src").alias("sources"))


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def cartesian_two_parts(spark, d):
    m = start(star_graph(spark, d), "r", "Region").part("n", "Nation", on=F.lit(True))
    return m.returns(region=v("r.r_name"), nation=v("n.n_name"))


@query("SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def shared_var_parts(spark, d):
    m = times(start(star_graph(spark, d), "n", "Nation"), "n", [Hop("CUSTOMER_OF", "c", forward=False), Hop("SUPPLIER_OF", "s", forward=False)], "ways")
    return m.returns_grouped({"nation": v("n.n_name")}, pairs=F.sum("ways"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def theta_where(spark, d):
    m = start(star_graph(spark, d), "a", "Supplier").part("b", "Supplier", on=(v("a.s_nationkey") == v("b.s_nationkey")) & (v("a.s_acctbal") < v("b.s_acctbal")))
    return m.returns(a=v("a.id"), b=v("b.id"))


@query("SELECT c_custkey AS id, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def optional_match(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").where(v("c.c_nationkey") == 3).optional("c", lambda x: x.out("c", "PLACED", "o"))
    return m.returns(id=v("c.id"), o=v("o.id"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1")
def optional_where(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").optional("c", lambda x: x.out("c", "PLACED", "o").where(v("o.o_totalprice") > 250000))
    return m.returns_grouped({"id": v("c.id")}, big=A.count(v("o.id")))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_semi(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").exists("c", lambda x: x.out("c", "PLACED", "o").where(v("o.o_orderstatus") == "P"))
    return m.returns(id=v("c.id"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def not_exists_anti(spark, d):
    urgent = lambda x: x.out("c", "PLACED", "o").where(v("o.o_orderpriority").startswith("1"))
    return start(star_graph(spark, d), "c", "Customer").not_exists("c", urgent).returns(id=v("c.id"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def exists_in_or(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").exists_flag("c", lambda x: x.out("c", "PLACED", "o").where(v("o.o_totalprice") > 350000), "big")
    return m.where((v("c.c_acctbal") < 0) | F.col("big")).returns(id=v("c.id"))


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def count_subquery(spark, d):
    return start(star_graph(spark, d), "c", "Customer").count_of("c", lambda x: x.out("c", "PLACED", "o"), "orders").returns(id=v("c.id"), orders=F.col("orders"))


@query("SELECT n_nationkey AS id, coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation")
def collect_subquery(spark, d):
    none = F.array().cast("array<bigint>")
    m = start(star_graph(spark, d), "n", "Nation").aggregate("n", lambda x: x.into("n", "SUPPLIER_OF", "s"), found=(A.collect(v("s.id")), none))
    return m.returns(id=v("n.id"), suppliers=F.array_join("found", ","))


@query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name > 'C' GROUP BY 1")
def pattern_comprehension(spark, d):
    inner = lambda x: x.into("r", "IN_REGION", "n").where(v("n.n_name") > "C")
    m = start(star_graph(spark, d), "r", "Region").aggregate("r", inner, names=(A.collect(v("n.n_name")), F.array().cast("array<string>")))
    return m.where(F.size("names") > 0).returns(region=v("r.r_name"), nations=F.array_join("names", ","))


@query("SELECT c_custkey AS id, o_orderkey AS o FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2")
def call_subquery_topk(spark, d):
    m = start(star_graph(spark, d), "c", "Customer")
    return m.call("c", lambda x: x.out("c", "PLACED", "o"), [F.desc("o__o_totalprice"), F.col("o__id")], 2).returns(id=v("c.id"), o=v("o.id"))


@query("""WITH l AS (SELECT *, hash(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS eid FROM lineitem)
SELECT a.l_orderkey AS o, count(*) AS pairs FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.eid <> b.eid GROUP BY 1""")
def rel_uniqueness_pair(spark, d):
    m = times(start(star_graph(spark, d), "o", "Order"), "o", [Hop("CONTAINS", "p"), Hop("CONTAINS", "q")], "ways")
    return m.returns_grouped({"o": v("o.id")}, pairs=F.sum("ways"))


@query("SELECT a.s_nationkey AS nation, count(*) AS pairs FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) y ON x.l_partkey = y.l_partkey AND x.l_suppkey <> y.l_suppkey JOIN supplier a ON a.s_suppkey = x.l_suppkey GROUP BY 1")
def hop2_same_type(spark, d):
    m = times(start(star_graph(spark, d), "a", "Supplier"), "a", [Hop("SUPPLIES", "p", then=(Hop("SUPPLIES", "b", forward=False),))], "ways")
    return m.returns_grouped({"nation": v("a.s_nationkey")}, pairs=F.sum("ways"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2))::DOUBLE AS mean FROM orders GROUP BY 1".replace("CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2))::DOUBLE", "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4)"))
def agg_basic(spark, d):
    o = start(star_graph(spark, d), "o", "Order")
    mean = F.round(money(v("o.o_totalprice")) / F.count(F.lit(1)), 4)
    return o.returns_grouped({"priority": v("o.o_orderpriority")}, n=A.count(), low=F.min(v("o.o_totalprice")), high=F.max(v("o.o_totalprice")), mean=mean)


@query("SELECT l_returnflag AS flag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(A.count(F.col("l_suppkey"), True).alias("suppliers"), A.count(F.col("l_partkey"), True).alias("parts"))


@query("SELECT p_brand AS brand, CASE WHEN count(*) <= 1 THEN 0.0 ELSE round(stddev_samp(p_size), 6) END AS sd, round(stddev_pop(p_size), 6) AS sdp FROM part GROUP BY 1")
def agg_stdev(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(A.stdev(F.col("p_size")), 6).alias("sd"), F.round(A.stdevp(F.col("p_size")), 6).alias("sdp"))


@query("SELECT p_brand AS brand, quantile_cont(p_size, 0.5) AS median, CAST(quantile_disc(p_size, 0.25) AS BIGINT) AS low FROM part GROUP BY 1")
def agg_percentile(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(A.percentile_cont("p_size", 0.5).alias("median"), A.percentile_disc("p_size", 0.25, "long").alias("low"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
def agg_collect_ordered(spark, d):
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region"))
    return rows.agg(F.array_join(F.reverse(A.collect_ordered(F.col("n_name"), F.col("n_name"))), ";").alias("names"))


@query("SELECT c_custkey AS id, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1")
def sum_empty_zero(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").optional("c", lambda x: x.out("c", "PLACED", "o").where(v("o.o_totalprice") > 400000))
    return m.returns_grouped({"id": v("c.id")}, total=A.total(v("o.o_totalprice").cast("decimal(18,2)")).cast("double"), n=A.count(v("o.id")))


@query("SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def with_having(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").out("c", "PLACED", "o")
    return m.returns_grouped({"customer": v("c.id")}, n=A.count()).where("n > 12")


@query("WITH top AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) SELECT c_custkey AS customer, o_orderkey AS o FROM top JOIN orders ON o_custkey = c_custkey")
def with_topk_then_expand(spark, d):
    top = start(star_graph(spark, d), "c", "Customer").order_by(F.desc("c__c_acctbal"), F.col("c__id")).limit(10).with_("c")
    return top.out("c", "PLACED", "o").returns(customer=v("c.id"), o=v("o.id"))


@query("SELECT DISTINCT c_mktsegment AS segment, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
def with_distinct(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").out("c", "CUSTOMER_OF", "n")
    return m.returns(distinct=True, segment=v("c.c_mktsegment"), region=v("n.n_regionkey"))


@query("SELECT r_name AS name, unnest([1, 2, 3]) * r_regionkey AS x FROM region")
def unwind_list(spark, d):
    m = start(star_graph(spark, d), "r", "Region").unwind(F.array(F.lit(1), F.lit(2), F.lit(3)), "x")
    return m.returns(name=v("r.r_name"), x=F.col("x") * v("r.r_regionkey"))


@query("SELECT n_nationkey AS id, unnest(range(1, n_nationkey + 1, 5)) AS x FROM nation")
def unwind_range(spark, d):
    m = start(star_graph(spark, d), "n", "Nation").unwind(S.range_list(1, v("n.id"), 5), "x")
    return m.returns(id=v("n.id"), x=F.col("x"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    g = star_graph(spark, d)
    return start(g, "c", "Customer").returns(nation=v("c.c_nationkey")).unionByName(start(g, "s", "Supplier").returns(nation=v("s.s_nationkey"))).distinct()


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    g = star_graph(spark, d)
    return start(g, "c", "Customer").returns(nation=v("c.c_nationkey")).unionByName(start(g, "s", "Supplier").returns(nation=v("s.s_nationkey")))


_NULLED = "(SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS bal FROM supplier)"


@query(f"SELECT s_suppkey AS id, row_number() OVER (ORDER BY bal ASC NULLS LAST, s_suppkey) AS up, row_number() OVER (ORDER BY bal DESC NULLS FIRST, s_suppkey) AS down FROM {_NULLED} QUALIFY up <= 20 OR down <= 20")
def order_nulls(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("bal"))
    ends = [rows.orderBy(order(F.col("bal")), "s_suppkey").limit(20) for order in (nulls_last, nulls_first)]
    # 40 rows at most; their ranks are counts of the rows before them.
    few = ends[0].union(ends[1]).distinct().select(F.col("s_suppkey").alias("id"), F.col("bal").alias("own"))
    tie = F.col("bal").eqNullSafe(F.col("own")) & (F.col("s_suppkey") < F.col("id"))
    lower = (F.col("bal") < F.col("own")) | (F.col("bal").isNotNull() & F.col("own").isNull()) | tie
    upper = (F.col("bal") > F.col("own")) | (F.col("bal").isNull() & F.col("own").isNotNull()) | tie
    return rows.join(F.broadcast(few)).groupBy("id").agg((F.count_if(lower) + 1).alias("up"), (F.count_if(upper) + 1).alias("down"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def skip_limit(spark, d):
    return start(star_graph(spark, d), "o", "Order").returns(id=v("o.id"), price=v("o.o_totalprice")).orderBy(F.desc("price"), "id").offset(5).limit(10)


@query("""SELECT p_partkey AS id, lower(p_name) AS low, upper(p_brand) AS up, substring(p_name, 3, 4) AS sub, left(p_type, 3) AS l, right(p_type, 3) AS r, replace(p_brand, '#', '-') AS rep,
reverse(p_brand) AS rev, CAST(length(p_name) AS BIGINT) AS n, string_split(p_brand, '#')[1] AS head, starts_with(p_type, 'S') AS st, p_name LIKE '%a%' AS has FROM part""")
def string_functions(spark, d):
    p = lambda c: v(f"p.{c}")
    return start(star_graph(spark, d), "p", "Part").returns(
        id=p("id"), low=F.lower(p("p_name")), up=F.upper(p("p_brand")), sub=S.substring(p("p_name"), 2, 4), l=S.left(p("p_type"), 3), r=S.right(p("p_type"), 3), rep=S.FUNCTIONS["replace"](p("p_brand"), "#", "-"),
        rev=F.reverse(p("p_brand")), n=S.size(p("p_name"), True), head=S.head(S.split(p("p_brand"), "#")), st=p("p_type").startswith("S"), has=p("p_name").contains("a"),
    )


@query("""SELECT s_suppkey AS id, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, CAST(sign(s_acctbal) AS DOUBLE) AS s, floor(s_acctbal + 0.5) AS r, round(sqrt(abs(s_acctbal)), 6) AS q,
CAST(trunc(s_suppkey / 7) AS BIGINT) AS d, s_suppkey % 7 AS m, round(power(s_suppkey, 2), 3) AS p, round(ln(s_suppkey + 1), 9) AS l, round(sin(s_suppkey), 9) AS si FROM supplier""")
def math_functions(spark, d):
    x, k = v("s.s_acctbal"), v("s.id")
    return start(star_graph(spark, d), "s", "Supplier").returns(
        id=k, a=F.abs(x), c=S.ceil(x), f=S.floor(x), s=F.signum(x), r=S.round_half_up(x), q=F.round(F.sqrt(F.abs(x)), 6), d=S.integer_divide(k, F.lit(7)), m=k % 7, p=F.round(F.pow(k, F.lit(2)), 3),
        l=F.round(F.ln(k + 1), 9), si=F.round(F.sin(k), 9),
    )


@query("""WITH l AS (SELECT n_nationkey AS id, [n_nationkey, n_regionkey, 7] AS xs FROM nation)
SELECT id, CAST(len(xs) AS BIGINT) AS n, xs[1] AS head, xs[3] AS last, xs[2] AS item, xs[-2] AS neg, NULL::INTEGER AS out, list_sum(xs[2:]) AS tail, list_sum(xs[1:2]) AS cut, list_sum(xs) AS total,
len(list_filter(xs, lambda x: x > 5)) = len(xs) AS every, len(list_filter(xs, lambda x: x > 20)) > 0 AS some, len(list_filter(xs, lambda x: x > 20)) = 0 AS none, len(list_filter(xs, lambda x: x = 7)) = 1 AS single,
list_contains(xs, 3) AS has, array_to_string(list_transform(list_filter(xs, lambda x: x > 1), lambda x: x * 2), ',') AS doubled FROM l""".replace("list_sum(xs[2:])", "CAST(list_sum(xs[2:]) AS BIGINT)").replace("list_sum(xs[1:2])", "CAST(list_sum(xs[1:2]) AS BIGINT)").replace("list_sum(xs) ", "CAST(list_sum(xs) AS BIGINT) "))
def list_functions(spark, d):
    xs = F.col("xs")
    total = lambda a: S.reduce_list(a, F.lit(0), lambda acc, x: acc + x, "bigint")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_nationkey", "n_regionkey", F.lit(7)).alias("xs"))
    return rows.select(
        "id", S.size(xs).alias("n"), S.head(xs).alias("head"), S.last(xs).alias("last"), S.item(xs, 1).alias("item"), S.item(xs, -2).alias("neg"), S.item(xs, 9).alias("out"), total(S.tail(xs)).alias("tail"),
        total(S.slice_list(xs, 0, -1)).alias("cut"), total(xs).alias("total"), S.all_in(xs, lambda x: x > 5).alias("every"), S.any_in(xs, lambda x: x > 20).alias("some"), S.none_in(xs, lambda x: x > 20).alias("none"),
        S.single_in(xs, lambda x: x == 7).alias("single"), S.in_list(F.lit(3), xs).alias("has"), F.array_join(S.comprehension(xs, lambda x: x > 1, lambda x: x * 2), ",").alias("doubled"),
    )


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, year(o_orderdate) AS y, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS later FROM orders")
def temporal_functions(spark, d):
    at = v("o.o_orderdate")
    return start(star_graph(spark, d), "o", "Order").returns(id=v("o.id"), day=S.date(at).cast("string"), y=F.year(at).cast("long"), later=S.date(at + S.duration(months=1)).cast("string"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS class FROM orders")
def case_forms(spark, d):
    s, p = v("o.o_orderstatus"), v("o.o_totalprice")
    return start(star_graph(spark, d), "o", "Order").returns(
        id=v("o.id"), state=F.when(s == "F", "done").when(s == "O", "open").otherwise("other"), **{"class": F.when(p > 200000, 2).when(p > 100000, 1).otherwise(0)}
    )


@query("SELECT p_partkey AS id FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].')")
def regex_match(spark, d):
    return start(star_graph(spark, d), "p", "Part").where(S.matches(v("p.p_brand"), "Brand#[1-3].")).returns(id=v("p.id"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (1, 2, 3) THEN true ELSE NULL END AS found, (n_regionkey = 1) <> (n_nationkey > 10) AS either FROM nation")
def null_logic(spark, d):
    xs = F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(None).cast("int"))
    return start(star_graph(spark, d), "n", "Nation").returns(id=v("n.id"), found=S.in_list(v("n.id"), xs), either=S.xor(v("n.n_regionkey") == 1, v("n.id") > 10))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS bad, CAST(trunc(value) AS BIGINT) AS whole, lower(CAST(value > 50 AS VARCHAR)) AS flag FROM events")
def conversion_functions(spark, d):
    e = start(star_graph(spark, d), "e", "Event")
    whole = S.to_integer(v("e.value"))
    return e.returns(id=v("e.id"), k=S.to_integer(F.get_json_object(v("e.props"), "$.k")), bad=S.to_integer(v("e.event_type")), whole=whole, flag=(v("e.value") > 50).cast("string"))


def _next(spark, d) -> DataFrame:
    return star_graph(spark, d).edge_rows("NEXT")


@query(f"WITH {_NEXT} SELECT a.src AS start, a.dst AS \"end\", 1 AS hops FROM e a UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON b.src = a.dst")
def varlen_1_2(spark, d):
    seeds = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return paths.var_length(_next(spark, d), seeds, 1, 2).select("start", "end", "hops")


@query(f"WITH RECURSIVE {_NEXT}, r(seed, node, distance) AS (SELECT event_id, event_id, 0 FROM events UNION ALL SELECT seed, dst, distance + 1 FROM r JOIN e ON src = node WHERE distance < 6) SELECT seed, node, min(distance) AS distance FROM r GROUP BY 1, 2")
def varlen_reach(spark, d):
    seeds = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return paths.reachable(_next(spark, d), seeds, 6)


_BIP = "s AS (SELECT DISTINCT l_suppkey AS x, l_partkey + 1000000000 AS y FROM lineitem), b AS (SELECT x, y FROM s UNION ALL SELECT y, x FROM s)"


def _supplies(spark, d) -> DataFrame:
    """An edge for each line, from its supplier to its part: what reads them tells the repeats of SUPPLIES apart."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"))


def _nations(spark, d) -> DataFrame:
    """Suppliers by nation: all pairs of one nation are asked for."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group"))


_PAIRS = "p AS (SELECT a.s_suppkey AS source, c.s_suppkey AS target FROM supplier a JOIN supplier c ON a.s_nationkey = c.s_nationkey AND a.s_suppkey < c.s_suppkey)"


@query(f"""WITH {_BIP}, {_PAIRS}, two AS (SELECT DISTINCT q.x AS f, r.y AS g FROM b q JOIN b r ON r.x = q.y WHERE q.x < 1000000000), four AS (SELECT DISTINCT h.f, k.g FROM two h JOIN two k ON k.f = h.g)
SELECT source, target, CASE WHEN two.f IS NOT NULL THEN 2 ELSE 4 END AS distance FROM p JOIN four ON four.f = source AND four.g = target LEFT JOIN two ON two.f = source AND two.g = target""")
def shortest_path_length(spark, d):
    return paths.shortest_lengths_within(_supplies(spark, d), _nations(spark, d), 4)


@query(f"""WITH {_BIP}, {_PAIRS}, two AS (SELECT q.x AS f, r.y AS g, count(*) AS n FROM b q JOIN b r ON r.x = q.y WHERE q.x < 1000000000 GROUP BY 1, 2),
four AS (SELECT h.f, k.g, sum(h.n * k.n) AS n FROM two h JOIN two k ON k.f = h.g WHERE h.f <> h.g AND k.f <> k.g GROUP BY 1, 2)
SELECT source, target, CASE WHEN two.f IS NOT NULL THEN 2 ELSE 4 END AS distance, coalesce(two.n, four.n)::BIGINT AS n FROM p LEFT JOIN two ON two.f = source AND two.g = target LEFT JOIN four ON four.f = source AND four.g = target WHERE two.f IS NOT NULL OR four.f IS NOT NULL""")
def all_shortest_paths(spark, d):
    return paths.count_shortest_paths_within(_supplies(spark, d), _nations(spark, d), 4)


#: Events of one user over days: a NEXT chain taken both ways, between all events of a user within a part of it.
@query(f"WITH {_NEXT}, o AS (SELECT event_id AS x, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.x AS source, b.x AS target, abs(a.i - b.i) AS distance, 1::BIGINT AS n FROM o a JOIN o b ON b.u = a.u AND b.x > a.x AND abs(a.i - b.i) <= 7")
def shortest_paths_of_users(spark, d):
    users = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("group"))
    return paths.count_shortest_paths_within(_next(spark, d), users, 7)


@query(f"WITH RECURSIVE {_NEXT}, r(seed, node, distance) AS (SELECT event_id, event_id, 0 FROM events UNION ALL SELECT seed, dst, distance + 1 FROM r JOIN e ON src = node) SELECT seed, count(*) AS reached, max(distance)::BIGINT AS farthest FROM r GROUP BY 1")
def varlen_unbounded(spark, d):
    ids = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return paths.reach_counts(_next(spark, d), ids)


@query("SELECT s_suppkey AS id, count(l_partkey) AS degree FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1")
def degree(spark, d):
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return paths.degrees(star_graph(spark, d).edge_rows("SUPPLIES"), ids, "out")


@query(f"WITH {_NEXT} SELECT src AS id, dst AS neighbour FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst")
def neighbours(spark, d):
    return paths.neighbours(_next(spark, d), table(spark, d, "events").select(F.col("event_id").alias("id")), "both")


@query(f"WITH {_PAIRS}, s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT source AS a, target AS b, x.l_partkey + 1000000000 AS neighbour FROM p JOIN s x ON x.l_suppkey = source JOIN s y ON y.l_suppkey = target AND y.l_partkey = x.l_partkey")
def common_neighbours(spark, d):
    return paths.common_neighbours_within(_supplies(spark, d), _nations(spark, d))


@query(f"WITH RECURSIVE {_NEXT}, p AS (SELECT min(event_id) OVER (PARTITION BY user_id) AS source, event_id AS target FROM events), r(seed, node, k) AS (SELECT DISTINCT source, source, 0 FROM p UNION ALL SELECT seed, dst, k + 1 FROM r JOIN e ON src = node WHERE k < 5) SELECT source, target, EXISTS (SELECT 1 FROM r WHERE seed = source AND node = target) AS connected FROM p")
def path_exists(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id")
    first = ev.groupBy("user_id").agg(F.min("event_id").alias("source"))
    return paths.path_exists(_next(spark, d), ev.join(first, "user_id").select("source", F.col("event_id").alias("target")), 5)


@query(f"WITH {_NEXT}, n0 AS (SELECT event_id AS x FROM events WHERE event_type = 'error'), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n1 AS (SELECT x FROM n0 UNION SELECT dst FROM n0 JOIN b ON src = x), n2 AS (SELECT x FROM n1 UNION SELECT dst FROM n1 JOIN b ON src = x) SELECT src, dst FROM e WHERE src IN (SELECT x FROM n2) AND dst IN (SELECT x FROM n2)")
def subgraph(spark, d):
    return paths.subgraph(_next(spark, d), table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id")), 2)


@query("""WITH l AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query, r.vec_id, list_sum(list_transform(list_zip(r.e, q.e), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (r.n * q.n) AS score FROM l r JOIN l q ON q.vec_id % 50 = 0)
SELECT query, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.score DESC, vec_id) <= 20""")
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vector.top_k_join(rows, asked, "vec_id", "embedding", 20).select("query", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT o_custkey + 1000000, 0.0, 'NEW' FROM (SELECT DISTINCT o_custkey FROM orders)")
def create_nodes(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "orders").select((F.col("o_custkey") + 1_000_000).alias("id")).distinct()
    return writes.create_nodes(nodes, new.withColumns({"bal": F.lit(0.0), "segment": F.lit("NEW")}))


@query("WITH b AS (SELECT o_custkey * 2 AS id, max(o_orderpriority) AS tag FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN b.id IS NULL THEN c_mktsegment ELSE tag END AS tag FROM customer LEFT JOIN b ON b.id = c_custkey UNION ALL SELECT id, tag FROM b WHERE id NOT IN (SELECT c_custkey FROM customer)")
def merge_nodes(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tag"))
    batch = table(spark, d, "orders").groupBy((F.col("o_custkey") * 2).alias("id")).agg(F.max("o_orderpriority").alias("tag"))
    return writes.merge_nodes(nodes, batch, ["id"], on_match=["tag"])


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE s_name END AS name, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END AS bal FROM supplier")
def set_and_remove(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), "s_nationkey")
    named = writes.set_properties(nodes, F.col("bal") < 0, name=F.lit("debt"))
    return writes.remove_properties(named, F.col("s_nationkey") == 3, ["bal"]).select("id", "name", "bal")


@query("SELECT 'nodes' AS kind, count(*) AS n FROM part WHERE p_size > 5 UNION ALL SELECT 'edges', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 5")
def detach_delete(spark, d):
    part = table(spark, d, "part")
    gone = part.where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    # Parts and orders are different labels: only the parts' end is looked up.
    lines = table(spark, d, "lineitem").select((-F.col("l_orderkey") - 1).alias("src"), F.col("l_partkey").alias("dst"))
    left = writes.delete_nodes(part, "p_partkey", gone).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n")
    return left.unionByName(writes.detach(lines, gone).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem UNION SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey = p_partkey")
def merge_edges(spark, d):
    edges = star_graph(spark, d).edge_rows("SUPPLIES").select("src", "dst")
    pairs = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("src"), F.col("p_partkey").alias("dst"))
    return writes.merge_edges(edges, pairs)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique(spark, d):
    return schema.violations_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'text' AS property, count(*) FILTER (text IS NULL) AS missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents")
def constraint_present(spark, d):
    return schema.violations_present(table(spark, d, "documents"), ["text", "lang"])


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_edges(spark, d):
    # After orders and parts were deleted without their relationships.
    orders = table(spark, d, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("id"))
    parts = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"))
    return schema.dangling(star_graph(spark, d).edge_rows("CONTAINS"), orders, parts)


@query("SELECT 'r_regionkey' AS property, count(r_regionkey) AS filled FROM region UNION ALL SELECT 'r_name', count(r_name) FROM region")
def property_fill(spark, d):
    return schema.property_fill(table(spark, d, "region"))


@query("""WITH known AS (SELECT DISTINCT p_brand AS known FROM part WHERE p_size <= 3), asked AS (SELECT p_brand AS name FROM part UNION SELECT reverse(p_brand) FROM part UNION SELECT p_type FROM part),
met AS (SELECT name, known, levenshtein(lower(name), lower(known)) AS edits FROM asked, known)
SELECT 'E201' AS code, '' AS owner, name, arg_min(known, edits * 100000 + rank) FILTER (edits <= 3) AS suggestion FROM (SELECT *, rank() OVER (ORDER BY known) AS rank FROM met) WHERE name NOT IN (SELECT known FROM known) GROUP BY name""")
def check_names(spark, d):
    # Labels are the brands of small parts; asked for are all brands, brands backwards, and types.
    part = table(spark, d, "part")
    described = part.where("p_size <= 3").select(F.lit("node").alias("kind"), F.col("p_brand").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("source", "target", "property", "type")]).distinct()
    names = part.select(F.explode(F.array("p_brand", F.reverse("p_brand"), "p_type")).alias("name")).distinct()
    return schema.check_names(names.select(F.lit("label").alias("kind"), F.lit("").alias("owner"), "name"), described)


def _described_customers(spark, d, some: str) -> DataFrame:
    """A description with segments as labels and nations as properties, typed by how many customers have both."""
    rows = table(spark, d, "customer").where(some).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    many = F.when(F.count(F.lit(1)) > 1, "many").otherwise("one").alias("type")
    return rows.groupBy(F.col("c_mktsegment").alias("name"), F.col("n_name").alias("property")).agg(many).select(F.lit("node").alias("kind"), "name", *[F.lit(None).cast("string").alias(c) for c in ("source", "target")], "property", "type")


_SEGMENTS = "SELECT c_mktsegment AS name, n_name AS property, CASE WHEN count(*) > 1 THEN 'many' ELSE 'one' END AS type FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE {} GROUP BY 1, 2"


@query(f"""WITH a AS ({_SEGMENTS.format("c_acctbal < 0")}), b AS ({_SEGMENTS.format("c_acctbal > 9000")})
SELECT 'node' AS kind, coalesce(a.name, b.name) AS name, coalesce(a.property, b.property) AS property, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'retyped' END AS change
FROM a FULL JOIN b ON a.name = b.name AND a.property = b.property WHERE a.name IS NULL OR b.name IS NULL OR a.type <> b.type""")
def schema_diff(spark, d):
    return schema.schema_diff(_described_customers(spark, d, "c_acctbal < 0"), _described_customers(spark, d, "c_acctbal > 9000"))


@query(f"""WITH a AS ({_SEGMENTS.format("c_acctbal < 0")}), b AS ({_SEGMENTS.format("c_acctbal > 9000")})
SELECT name, property, type, 'first' AS origin FROM a UNION ALL SELECT name, property, type, 'second' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.name = b.name AND a.property = b.property)""")
def schema_merge(spark, d):
    first, second = _described_customers(spark, d, "c_acctbal < 0"), _described_customers(spark, d, "c_acctbal > 9000")
    both = schema.schema_merge(first.withColumn("origin", F.lit("first")), second.withColumn("origin", F.lit("second")))
    return both.select("name", "property", "type", "origin")


@query("""SELECT 'node' AS kind, name, n FROM (SELECT 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Nation', count(*) FROM nation
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Vector', count(*) FROM embeddings UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events)
UNION ALL SELECT 'relationship', name, n FROM (SELECT 'IN_REGION' AS name, count(n_regionkey) AS n FROM nation UNION ALL SELECT 'CUSTOMER_OF', count(c_nationkey) FROM customer UNION ALL SELECT 'SUPPLIER_OF', count(s_nationkey) FROM supplier UNION ALL SELECT 'PLACED', count(o_custkey) FROM orders
UNION ALL SELECT 'DID', count(user_id) FROM events UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem UNION ALL SELECT 'NEXT', count(*) - count(DISTINCT user_id) FROM events)""")
def graph_counts(spark, d):
    return star_graph(spark, d).counts()


@query()
def text_chunks(spark, d):
    return text.chunks(table(spark, d, "documents"), "doc_id", "text", 400, 80)


@query("""WITH names(label, name) AS (VALUES ('Word', 'heat'), ('Word', 'Rea'), ('Word', 'that')), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS word FROM documents)
SELECT doc_id, label, name FROM w JOIN names ON lower(name) = word""")
def entity_mentions(spark, d):
    names = spark.createDataFrame([("Word", "heat"), ("Word", "Rea"), ("Word", "that")], "label string, name string")
    return text.mentions(table(spark, d, "documents"), "doc_id", "text", names)


#: Words, blanks and other runs of a text in order, and the triples of a word, a verb and a word with blanks between.
_TRIPLES = r"""ts AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[\x09-\x0D \p{Z}]+|[^\p{L}\p{M}\p{N}_\x09-\x0D \p{Z}]+') AS x FROM documents),
met AS (SELECT x[i] AS subject, upper(x[i + 2]) AS type, x[i + 4] AS object, x[i + 1] || x[i + 3] AS gaps FROM ts, unnest(range(1, len(x) - 3)) AS t(i) WHERE lower(x[i + 2]) IN (VERBS)),
triples AS (SELECT DISTINCT subject, type, object FROM met WHERE regexp_full_match(gaps, '[\x09-\x0D \p{Z}]+') AND regexp_full_match(subject || object, '[\p{L}\p{M}\p{N}_]+'))"""


@query("WITH " + _TRIPLES.replace("VERBS", "'the', 'of'") + " SELECT type, count(*) AS n FROM triples GROUP BY 1")
def relation_edges(spark, d):
    found = text.relations(table(spark, d, "documents"), "doc_id", "text", {"the": "THE", "of": "OF"})
    return text.triples(found).groupBy("type").agg(A.count().alias("n"))


@query("WITH " + _TRIPLES.replace("VERBS", "'of'") + r""", known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS name FROM benchmark),
names AS (SELECT subject AS name FROM triples UNION SELECT object FROM triples) SELECT names.name, known.name IS NOT NULL AS found FROM names LEFT JOIN known ON known.name = names.name""")
def entity_status(spark, d):
    found = text.triples(text.relations(table(spark, d, "documents"), "doc_id", "text", {"of": "OF"}))
    known = text.words(table(spark, d, "benchmark"), "item_id", "text").select(F.col("word").alias("name")).distinct()
    return text.entity_status(found, known)


@query("SELECT n_nationkey AS nation, count(*) AS pairs FROM nation JOIN customer c ON c.c_nationkey = n_nationkey JOIN customer e ON e.c_nationkey = n_nationkey AND e.c_custkey <> c.c_custkey GROUP BY 1")
def fk_uniqueness_pair(spark, d):
    m = times(start(star_graph(spark, d), "n", "Nation"), "n", [Hop("CUSTOMER_OF", "c", forward=False), Hop("CUSTOMER_OF", "e", forward=False)], "ways")
    return m.returns_grouped({"nation": v("n.id")}, pairs=F.sum("ways"))


@query("SELECT l_suppkey AS supplier, sum(k * (k - 1))::BIGINT AS pairs FROM (SELECT l_suppkey, count(*) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1) GROUP BY 1")
def comma_uniqueness(spark, d):
    m = times(start(star_graph(spark, d), "s", "Supplier"), "s", [Hop("SUPPLIES", "p"), Hop("SUPPLIES", "q")], "ways")
    return m.returns_grouped({"supplier": v("s.id")}, pairs=F.sum("ways"))


@query(f"WITH {_NEXT} SELECT a.event_id AS a, x.dst AS b, y.dst AS c, z.src AS d FROM events a JOIN e x ON x.src = a.event_id LEFT JOIN e y ON y.src = a.event_id LEFT JOIN e z ON z.dst = a.event_id WHERE a.event_type = 'purchase'")
def optional_then_hop(spark, d):
    m = start(star_graph(spark, d), "a", "Event").where(v("a.event_type") == "purchase").out("a", "NEXT", "b")
    m = m.optional("a", lambda x: x.out("a", "NEXT", "c")).optional("a", lambda x: x.into("a", "NEXT", "d"))
    return m.returns(a=v("a.id"), b=v("b.id"), c=v("c.id"), d=v("d.id"))


@query("SELECT s_nationkey AS nation, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) ON s = l_suppkey AND p = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def cycle_closed(spark, d):
    # One line is both relationships, so order, supplier and part meet through a line and the supplier's parts.
    g = star_graph(spark, d)
    g.add_edges("LINE", lambda: table(spark, d, "lineitem"), "Order", "Supplier", "l_orderkey", "l_suppkey", by_place=True)
    m = start(g, "o", "Order").out("o", "LINE", "s", rel="l").out("s", "SUPPLIES", "p").where(v("p.id") == v("l.l_partkey"))
    return m.returns_grouped({"nation": v("s.s_nationkey")}, n=A.count())


@query("SELECT type, count(*) AS n FROM (SELECT 'CONTAINS' AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT 'SUPPLIED_BY' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F') GROUP BY 1")
def any_type_hop(spark, d):
    # Orders are one row each and fewer than their lines, which would be sorted otherwise.
    m = start(star_graph(spark, d), "o", "Order").where(v("o.o_orderstatus") == "F").hint("shuffle_hash").any("o", "x", rel="r")
    return m.returns_grouped({"type": m.type_of("r")}, n=A.count())


@query("SELECT n_name AS nation, type, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k, 'CUSTOMER_OF' AS type FROM customer UNION ALL SELECT s_nationkey, 'SUPPLIER_OF' FROM supplier) ON k = n_nationkey GROUP BY 1, 2")
def alternatives_hop(spark, d):
    m = start(star_graph(spark, d), "n", "Nation").any("n", "x", ["CUSTOMER_OF", "SUPPLIER_OF"], rel="r", forward=False)
    return m.returns_grouped({"nation": v("n.n_name"), "type": m.type_of("r")}, n=A.count())


@query(f"WITH {_NEXT} SELECT a.event_id AS id, x.dst AS \"end\", 1 AS length, a.event_id || ',' || x.dst AS nodes FROM events a JOIN e x ON x.src = a.event_id WHERE a.event_type = 'signup' UNION ALL SELECT a.event_id, y.dst, 2, a.event_id || ',' || x.dst || ',' || y.dst FROM events a JOIN e x ON x.src = a.event_id JOIN e y ON y.src = x.dst WHERE a.event_type = 'signup'")
def path_hop(spark, d):
    m = start(star_graph(spark, d), "a", "Event").where(v("a.event_type") == "signup").path("a", "NEXT", "b", 1, 2, "p")
    return m.returns(id=v("a.id"), end=v("b.id"), length=v("p.length"), nodes=F.array_join("p__nodes", ","))


@query("SELECT c_custkey AS id, n, n_name AS nation FROM (SELECT c_custkey, c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY n DESC, c_custkey LIMIT 20 OFFSET 5) JOIN nation ON n_nationkey = c_nationkey")
def with_group_skip_limit(spark, d):
    m = start(star_graph(spark, d), "c", "Customer").out("c", "PLACED", "o").group("c", n=A.count())
    m = m.order_by(F.desc("n"), F.col("c__id")).skip(5).limit(20).out("c", "CUSTOMER_OF", "x")
    return m.returns(id=v("c.id"), n=F.col("n"), nation=v("x.n_name"))


@query("SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def several_labels(spark, d):
    m = start(star_graph(spark, d), "x", "Party")
    return m.returns_grouped({"label": v("x.label")}, n=A.count())


@query("SELECT s_suppkey AS id, 'Supplier,Party' AS labels, 's_acctbal,s_name,s_nationkey,s_suppkey' AS keys FROM supplier")
def node_functions(spark, d):
    m = start(star_graph(spark, d), "s", "Supplier:Party")
    return m.returns(id=v("s.id"), labels=F.array_join(m.labels_of("s"), ","), keys=F.array_join(F.array_sort(m.keys_of("s")), ","))


#: The tables behind the labels, and their columns.
_LABELS = {
    "Region": ("region", "r_regionkey r_name"),
    "Nation": ("nation", "n_nationkey n_name n_regionkey"),
    "Customer": ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
    "Supplier": ("supplier", "s_suppkey s_name s_nationkey s_acctbal"),
    "Part": ("part", "p_partkey p_name p_brand p_type p_size p_retailprice"),
    "Order": ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
    "Event": ("events", "event_id ts user_id event_type value props"),
    "Document": ("documents", "doc_id text lang source n_chars"),
    "Vector": ("embeddings", "vec_id embedding label"),
    "User": ("(SELECT DISTINCT user_id FROM events)", "user_id"),
}


@query("SELECT label, count(*) AS n, sum(filled)::BIGINT AS filled FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS label, {' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in cs.split())} AS filled FROM {t}" for k, (t, cs) in _LABELS.items()) + ") GROUP BY 1")
def nodes_with_properties(spark, d):
    rows = star_graph(spark, d).all_nodes(properties=True)
    return rows.groupBy("label").agg(A.count().alias("n"), F.sum(F.size(F.json_object_keys("properties"))).cast("long").alias("filled"))


@query("""WITH e AS (SELECT c_name AS name, o_orderstatus AS status, min(p_brand) AS source, max(p_brand) AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT a.name AS name, a.source AS old_source, a.target AS old_target, b.source AS new_source, b.target AS new_target FROM e a JOIN e b ON a.name = b.name AND a.status = 'F' AND b.status = 'O' WHERE a.source <> b.source OR a.target <> b.target""")
def schema_moved_ends(spark, d):
    # For each customer as a type, the first and last brand of its finished orders, and of its open ones.
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    ends = lambda status: lines.where(F.col("o_orderstatus") == status).groupBy(F.col("c_name").alias("name")).agg(F.min("p_brand").alias("source"), F.max("p_brand").alias("target")).withColumn("kind", F.lit("relationship"))
    return schema.moved_ends(ends("F"), ends("O"))


#: Customers and suppliers of one nation, and the orders of the one that the other delivers.
_TRADE = """pairs AS (SELECT n_name AS nation, c_custkey AS c, c_acctbal AS bal, s_suppkey AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey),
lines AS (SELECT o_custkey AS c, l_suppkey AS s, o_orderkey AS o, o_totalprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _compatriot_traders(spark, d):
    hops = Hop("CUSTOMER_OF", "c", forward=False), Hop("SUPPLIER_OF", "s", forward=False)
    return BoundPairs(start(star_graph(spark, d), "n", "Nation"), "n", *hops)


def _bought(x):
    """(c)-[:PLACED]->(o)-[:SUPPLIED_BY]->(s), for a customer and a supplier that are bound outside."""
    return x.out("c", "PLACED", "o").out("o", "SUPPLIED_BY", "s")


@query(f"WITH {_TRADE} SELECT nation, count(*) AS n FROM pairs WHERE EXISTS (SELECT 1 FROM lines WHERE lines.c = pairs.c AND lines.s = pairs.s) GROUP BY 1")
def exists_two_bound(spark, d):
    m = _compatriot_traders(spark, d).counted(_bought, "k", "pairs").where(F.col("k") > 0)
    return m.returns_grouped({"nation": v("n.n_name")}, n=F.sum("pairs"))


@query(f"WITH {_TRADE} SELECT nation, count(*) AS n FROM pairs WHERE NOT EXISTS (SELECT 1 FROM lines WHERE lines.c = pairs.c AND lines.s = pairs.s AND price > 20 * bal) GROUP BY 1")
def not_exists_outer_property(spark, d):
    dear = lambda x: _bought(x).where(v("o.o_totalprice") > 20 * v("c.c_acctbal"))
    m = _compatriot_traders(spark, d).counted(dear, "k", "pairs").where(F.col("k") == 0)
    return m.returns_grouped({"nation": v("n.n_name")}, n=F.sum("pairs"))


@query(f"WITH {_TRADE} SELECT nation, count(*) AS n, count(o) AS orders FROM pairs LEFT JOIN lines ON lines.c = pairs.c AND lines.s = pairs.s GROUP BY 1")
def optional_two_bound(spark, d):
    # A pair has a row for each of its orders, or one without any.
    m = _compatriot_traders(spark, d).counted(_bought, "k", "pairs")
    return m.returns_grouped({"nation": v("n.n_name")}, n=F.sum(F.greatest("k", F.lit(1)) * F.col("pairs")), orders=F.sum(F.col("k") * F.col("pairs")))


@query(f"WITH {_TRADE}, k AS (SELECT nation, (SELECT count(*) FROM lines WHERE lines.c = pairs.c AND lines.s = pairs.s) AS k FROM pairs) SELECT nation, k, count(*) AS n FROM k GROUP BY 1, 2")
def count_two_bound(spark, d):
    return _compatriot_traders(spark, d).counted(_bought, "k", "pairs").returns_grouped({"nation": v("n.n_name"), "k": F.col("k")}, n=F.sum("pairs"))


@query(f"WITH {_TRADE} SELECT pairs.c AS c, pairs.s AS s, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS orders FROM pairs JOIN lines ON lines.c = pairs.c AND lines.s = pairs.s GROUP BY 1, 2")
def collect_two_bound(spark, d):
    m = _compatriot_traders(spark, d).aggregate(_bought, found=A.collect(v("o.id")))
    return m.returns(c=v("c.id"), s=v("s.id"), orders=F.array_join(F.array_sort("found"), ","))


@query(f"WITH {_TRADE} SELECT pairs.c AS c, pairs.s AS s, string_agg(CAST(floor(price) AS BIGINT), ';' ORDER BY floor(price)) AS prices FROM pairs JOIN lines ON lines.c = pairs.c AND lines.s = pairs.s WHERE price > 200000 GROUP BY 1, 2")
def comprehension_two_bound(spark, d):
    dear = lambda x: _bought(x).where(v("o.o_totalprice") > 200000)
    m = _compatriot_traders(spark, d).aggregate(dear, prices=A.collect(F.floor(v("o.o_totalprice"))))
    return m.returns(c=v("c.id"), s=v("s.id"), prices=F.array_join(F.array_sort("prices"), ";"))


@query(f"WITH {_TRADE} SELECT c, s, o FROM (SELECT pairs.c, pairs.s, o, row_number() OVER (PARTITION BY pairs.c, pairs.s ORDER BY price DESC, o) AS r FROM pairs JOIN lines ON lines.c = pairs.c AND lines.s = pairs.s) WHERE r <= 1")
def call_two_bound(spark, d):
    m = _compatriot_traders(spark, d).call(_bought, [F.desc("o__o_totalprice"), F.col("o__id")], 1)
    return m.returns(c=v("c.id"), s=v("s.id"), o=v("o.id"))


@query("SELECT n_name AS nation, label, count(*) AS n FROM (SELECT c_nationkey AS k, 'Customer' AS label FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) JOIN nation ON n_nationkey = k WHERE label = 'Customer' GROUP BY 1, 2")
def joint_label_hop(spark, d):
    m = start(star_graph(spark, d), "x", "Party").out("x", "CUSTOMER_OF", "n")
    return m.returns_grouped({"nation": v("n.n_name"), "label": v("x.label")}, n=A.count())


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER () AS e, l_quantity > 25 AS big FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT o_orderpriority AS priority, count(*) AS triples FROM orders JOIN l a ON a.l_orderkey = o_orderkey AND a.big JOIN l b ON b.l_orderkey = o_orderkey AND b.e <> a.e JOIN l c ON c.l_orderkey = o_orderkey AND c.e NOT IN (a.e, b.e) GROUP BY 1""")
def count_three_branches(spark, d):
    # Three different lines of an order, one of them large.
    hops = [Hop("CONTAINS", "p", where=v("rel.l_quantity") > 25), Hop("CONTAINS", "q"), Hop("CONTAINS", "r")]
    m = times(start(star_graph(spark, d), "o", "Order"), "o", hops, "ways")
    return m.returns_grouped({"priority": v("o.o_orderpriority")}, triples=F.sum("ways"))


@query("""SELECT n_name AS nation, sum(k * g)::BIGINT AS ways FROM nation JOIN (SELECT c_nationkey, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey
JOIN (SELECT s_nationkey, count(*) AS g FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1""")
def count_deep_branches(spark, d):
    # Orders of a nation's customers, beside finished orders that its suppliers had lines of.
    done = Hop("SUPPLIED_BY", "x", forward=False, where=v("x.o_orderstatus") == "F")
    hops = [Hop("CUSTOMER_OF", "c", forward=False, then=(Hop("PLACED", "o"),)), Hop("SUPPLIER_OF", "s", forward=False, then=(done,))]
    m = times(start(star_graph(spark, d), "n", "Nation"), "n", hops, "ways")
    return m.returns_grouped({"nation": v("n.n_name")}, ways=F.sum("ways"))


@query()
def vector_index_topk(spark, d):
    """As vector_topk, by the index; tests hold its recall against the exact search."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    index = build_index(rows, "vec_id", "embedding")
    return index.search(asked, 20).select("query", "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.99) AS high FROM lineitem GROUP BY 1
UNION ALL SELECT NULL, quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.99) FROM lineitem""")
def percentiles_of_prices(spark, d):
    rows = table(spark, d, "lineitem")
    by_flag = ordered.percentiles(rows.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice", {"median": 0.5, "high": 0.99})
    whole = ordered.percentiles(rows, [], "l_extendedprice", {"median": 0.5, "high": 0.99})
    return by_flag.unionByName(whole, allowMissingColumns=True)


@query("SELECT l_suppkey AS supplier, quantile_disc(l_extendedprice, 0.25) AS low, quantile_disc(l_extendedprice, 0.75) AS high FROM lineitem GROUP BY 1")
def percentiles_disc(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "supplier")
    return ordered.percentiles(rows, ["supplier"], "l_extendedprice", {"low": 0.25, "high": 0.75}, discrete=True)


#: Names of two and three words, the first ones of each passage of the benchmark.
_NAMES = r"""bw AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM benchmark), names AS (SELECT DISTINCT 'Pair' AS label, array_to_string(ws[1:2], ' ') AS name, 2 AS k FROM bw WHERE len(ws) >= 2 UNION SELECT 'Triple', array_to_string(ws[1:3], ' '), 3 FROM bw WHERE len(ws) >= 3)"""


@query(f"""WITH RECURSIVE {_NAMES}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i FROM d),
r AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o AS two, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS MATERIALIZED (SELECT doc_id, i, max(k) AS k FROM (SELECT doc_id, i, k FROM r JOIN names ON name = two UNION ALL SELECT doc_id, i, k FROM r JOIN names ON name = three) GROUP BY 1, 2),
pick(doc_id, i, k) AS (SELECT doc_id, min(i), arg_min(k, i) FROM m GROUP BY 1 UNION ALL SELECT p.doc_id, min(m.i), arg_min(m.k, m.i) FROM pick p JOIN m ON m.doc_id = p.doc_id AND m.i >= p.i + p.k GROUP BY p.doc_id)
SELECT pick.doc_id, pick.i::INTEGER AS at, CASE k WHEN 2 THEN 'Pair' ELSE 'Triple' END AS label, CASE k WHEN 2 THEN two ELSE three END AS name FROM pick JOIN r ON r.doc_id = pick.doc_id AND r.i = pick.i""")
def phrase_mentions(spark, d):
    own = table(spark, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("ws"))
    names = [own.where(F.size("ws") >= k).select(F.lit(label).alias("label"), F.array_join(F.slice("ws", 1, k), " ").alias("name")) for label, k in (("Pair", 2), ("Triple", 3))]
    return text.phrase_mentions(table(spark, d, "documents"), "doc_id", "text", names[0].unionByName(names[1]))


_KNOWN = r"""k0 AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS known FROM benchmark), known AS (SELECT known, row_number() OVER (ORDER BY known) * 10 AS id FROM k0)"""
_RESOLVED = """names AS MATERIALIZED (SELECT subject AS name FROM triples UNION SELECT object FROM triples), keys AS MATERIALIZED (SELECT DISTINCT lower(name) AS key FROM names),
exact AS (SELECT key, id FROM keys JOIN known ON known = key), open AS (SELECT key FROM keys WHERE key NOT IN (SELECT key FROM exact)),
near AS (SELECT key, min(id) AS id FROM open JOIN known ON length(key) >= 5 AND abs(length(key) - length(known)) <= 1 AND levenshtein(key, known) <= 1 GROUP BY 1),
placed AS (SELECT key, id, false AS created FROM exact UNION ALL SELECT key, id, false FROM near
UNION ALL SELECT key, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY key), true FROM open WHERE key NOT IN (SELECT key FROM near))"""


def _known_nodes(spark, d):
    own = text.words(table(spark, d, "benchmark"), "item_id", "text").select(F.col("word").alias("name")).distinct()
    return ordered.numbered(own, ["name"], "n", 1).select((F.col("n") * 10).alias("id"), "name")


@query("WITH " + _TRIPLES.replace("VERBS", "'of'") + f", {_KNOWN}, {_RESOLVED} SELECT name, id::BIGINT AS id, created FROM names JOIN placed ON key = lower(name)")
def upsert_nodes(spark, d):
    found = text.triples(text.relations(table(spark, d, "documents"), "doc_id", "text", {"of": "OF"}))
    return text.resolved(found.select(F.explode(F.array("subject", "object")).alias("name")), _known_nodes(spark, d))


_TOLD = _TRIPLES.replace("VERBS", "'of'").replace("met AS (SELECT", "met AS (SELECT doc_id,").replace("SELECT DISTINCT subject", "SELECT DISTINCT doc_id, subject")


@query(f"""WITH {_TOLD}, {_KNOWN}, {_RESOLVED}, e AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM triples JOIN placed a ON a.key = lower(subject) JOIN placed b ON b.key = lower(object)),
told AS (SELECT DISTINCT doc_id, id FROM (SELECT doc_id, unnest([lower(subject), lower(object)]) AS key FROM triples) JOIN placed USING (key))
SELECT 'edges' AS kind, count(*) AS n FROM e WHERE src % 7 <> 0 UNION ALL SELECT 'mentions', count(*) FROM told UNION ALL SELECT 'nodes', count(*) FROM placed WHERE created""")
def upsert_graph(spark, d):
    # Of the graph's edges, those from nodes whose id is divisible by 7 exist already.
    found = materialized(text.relations(table(spark, d, "documents"), "doc_id", "text", {"of": "OF"}), "found")
    nodes = materialized(_known_nodes(spark, d), "nodes")
    none = spark.createDataFrame([], "src long, type string, dst long")
    _, edges, _ = text.upsert_triples(found, nodes, none, "doc_id")
    new_nodes, new_edges, mentions = text.upsert_triples(found, nodes, materialized(edges.where("src % 7 = 0"), "edges"), "doc_id")
    kinds = [x.agg(A.count().alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, x in (("nodes", new_nodes), ("edges", new_edges), ("mentions", mentions))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


_BOUGHT = "SELECT o_custkey AS c, p_brand AS brand, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = '{}' GROUP BY 1, 2"


@query(f"""WITH v1 AS ({_BOUGHT.format('F')}), v2 AS ({_BOUGHT.format('O')}),
one AS (SELECT *, row_number() OVER (ORDER BY c, brand) - 1 AS id FROM v1), fresh AS (SELECT v2.*, (SELECT count(*) FROM v1) + row_number() OVER (ORDER BY v2.c, v2.brand) - 1 AS id FROM v2 LEFT JOIN v1 ON v1.c = v2.c AND v1.brand = v2.brand WHERE v1.c IS NULL),
e AS (SELECT one.id, one.c, one.brand, one.lines + coalesce(v2.lines, 0) AS lines, v2.c IS NOT NULL AS again FROM one LEFT JOIN v2 ON v2.c = one.c AND v2.brand = one.brand UNION ALL SELECT id, c, brand, lines, false FROM fresh)
SELECT id, c, brand, lines, again FROM e WHERE lines % 5 <> 0""")
def merge_pattern_versions(spark, d):
    # MERGE (a:Buyer {c})-[r:LIKES]->(b:Brand {name}) of finished, then of open orders; then DELETE some; read, compacted.
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    # Both batches come from one join, which is made once.
    lines = materialized(rows.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus", F.col("o_custkey").alias("c"), F.col("p_brand").alias("brand")).agg(A.count().alias("n")), "lines")
    bought = lambda status: lines.where(F.col("o_orderstatus") == status).drop("o_orderstatus")
    none = lambda schema: Versions(spark.createDataFrame([], schema))
    g = Graph({"Buyer": none("id long, c long"), "Brand": none("id long, name string")}, {"LIKES": none("id long, src long, dst long, lines long, again boolean")})
    likes = Pattern(End("Buyer", {"c": "c"}), "LIKES", End("Brand", {"name": "brand"}))
    made, seen = {"r.lines": F.col("n"), "r.again": F.lit(False)}, {"r.lines": F.col("r__lines") + F.col("n"), "r.again": F.lit(True)}
    for status in ("F", "O"):
        g = merge(g, bought(status), likes, made, seen)
    g = delete_edges(g, "LIKES", g.edges["LIKES"].at().where("lines % 5 = 0").select("id"))
    a, b = g.nodes["Buyer"].compacted().at().toDF("src", "c"), g.nodes["Brand"].compacted().at().toDF("dst", "brand")
    return g.edges["LIKES"].at().join(a, "src").join(b, "dst").select("id", "c", "brand", "lines", "again")


def _named_graph(spark, d):
    """Parts by name and brand, suppliers by name, brands by name: keys of text, and of two columns."""
    part, supplier = table(spark, d, "part").dropDuplicates(["p_name", "p_brand"]), table(spark, d, "supplier").dropDuplicates(["s_name"])
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    g = GraphCatalog().add_keyed_nodes("Part", part.select("p_name", "p_brand", "p_size"), ("p_name", "p_brand"))
    g.add_keyed_nodes("Supplier", supplier.select("s_name", "s_nationkey"), ("s_name",)).add_keyed_nodes("Brand", part.select(F.col("p_brand").alias("name")).distinct(), ("name",))
    g.add_keyed_edges("SELLS", lines.select("s_name", "p_name", "p_brand").distinct(), "Supplier", "Part", ("s_name",), ("p_name", "p_brand"), key=("s_name", "p_name", "p_brand"))
    return g.add_keyed_edges("OF_BRAND", part.select("p_name", "p_brand"), "Part", "Brand", ("p_name", "p_brand"), ("p_brand",), key=("p_name", "p_brand"))


@query("""WITH x AS (SELECT DISTINCT s_name, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT s_name AS supplier, p_brand AS brand, count(*) AS n FROM x GROUP BY 1, 2""")
def text_keys_hops(spark, d):
    m = start(_named_graph(spark, d), "s", "Supplier").out("s", "SELLS", "p").out("p", "OF_BRAND", "b")
    return m.returns_grouped({"supplier": v("s.s_name"), "brand": v("b.name")}, n=A.count())


@query("""WITH x AS (SELECT DISTINCT s_name, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), first AS (SELECT min(s_name) AS s FROM supplier)
SELECT DISTINCT z.s_name AS supplier, CASE WHEN z.s_name = first.s THEN 0 ELSE 2 END AS distance FROM x JOIN first ON x.s_name = first.s JOIN x z ON z.p_name = x.p_name AND z.p_brand = x.p_brand""")
def text_keys_paths(spark, d):
    # Suppliers within two hops of the first one by name, over the parts that both sell.
    g = _named_graph(spark, d)
    rows = g.edge_rows("SELLS").select("src", (-F.col("dst") - 1).alias("dst"))
    near = paths.reachable(paths.undirected(rows), spark.range(1), 2).where("node >= 0")
    names = start(g, "s", "Supplier").returns(node=v("s.id"), supplier=v("s.s_name"))
    return near.join(names, "node").select("supplier", "distance")


@query(f"WITH {_NEXT} SELECT a.event_id AS id, a.event_type || '>' || b.event_type || '>' || c.event_type AS types, round(a.value + b.value + c.value, 6) AS total, 'Event:' || c.event_id AS last FROM events a JOIN e x ON x.src = a.event_id JOIN e y ON y.src = x.dst JOIN events b ON b.event_id = x.dst JOIN events c ON c.event_id = y.dst WHERE a.event_type = 'signup'")
def path_node_properties(spark, d):
    m = start(star_graph(spark, d), "a", "Event").where(v("a.event_type") == "signup").path("a", "NEXT", "b", 2, 2, "p")
    m = m.nodes_of("p", "along")
    total = F.aggregate("along", F.lit(0.0), lambda s, x: s + x["value"])
    return m.returns(id=v("a.id"), types=F.array_join("along.event_type", ">"), total=F.round(total, 6), last=m.element_id("b"))


@query("SELECT s_nationkey AS nation, count(*) AS n FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) ON s = y.l_suppkey AND p = x.l_partkey JOIN supplier ON s_suppkey = s JOIN orders ON o_orderkey = x.l_orderkey GROUP BY 1")
def triangle_closed(spark, d):
    # An order, a part of it, and a supplier of the order who supplies that part: the last hop closes on a bound part.
    m = start(star_graph(spark, d), "o", "Order").out("o", "CONTAINS", "p").out("o", "SUPPLIED_BY", "s").out("s", "SUPPLIES", "p")
    return m.returns_grouped({"nation": v("s.s_nationkey")}, n=A.count())


@query("SELECT n_name AS nation, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def four_cycle_closed(spark, d):
    # (c)-[:PLACED]->(o)-[:SUPPLIED_BY]->(s)-[:SUPPLIER_OF]->(n)<-[:CUSTOMER_OF]-(c)
    m = start(star_graph(spark, d), "c", "Customer").out("c", "PLACED", "o").out("o", "SUPPLIED_BY", "s", rel="l").out("s", "SUPPLIER_OF", "n").into("n", "CUSTOMER_OF", "c")
    return m.returns_grouped({"nation": v("n.n_name")}, n=A.count(), total=money(v("l.l_extendedprice")))


@query("""WITH o AS (SELECT event_id AS x, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT a.x AS s, b.x AS t FROM o a JOIN o b ON b.u = a.u AND b.i > a.i AND b.i <= a.i + 4), t AS (SELECT p.s AS a, p.t AS b, q.t AS c FROM e p JOIN e q ON q.s = p.t JOIN e r ON r.s = p.s AND r.t = q.t)
SELECT node, count(*) AS n FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY 1""")
def triangles_of_events(spark, d):
    # Events at most four steps apart are joined.
    ids = table(spark, d, "events").select(F.col("event_id").alias("id"))
    near = paths.reachable(_next(spark, d), ids, 4).where("distance > 0").select(F.col("seed").alias("src"), F.col("node").alias("dst"))
    return cycles.triangle_counts(near)


@query("SELECT label AS name, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS label FROM {t}" for k, (t, _) in _LABELS.items()) + " UNION ALL SELECT 'Party' FROM customer UNION ALL SELECT 'Party' FROM supplier) GROUP BY 1 HAVING count(*) > 5")
def call_labels(spark, d):
    return call_procedure(star_graph(spark, d), "db.labels", name="label", n="n").where("n > 5")


@query(" UNION ALL ".join(f"SELECT '{c}' AS propertyKey, '{k}' AS label, count({c}) AS n FROM {t}" for k, (t, cs) in _LABELS.items() for c in cs.split()))
def call_property_keys(spark, d):
    return call_procedure(star_graph(spark, d), "db.propertyKeys")


@query("""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) + INTERVAL 14 MONTH + INTERVAL 10 DAY AS VARCHAR)[:10] AS later, CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS VARCHAR) AS first,
CAST(make_date(year(o_orderdate), 1, 1) + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS VARCHAR)[:10] AS same, CAST(CAST(make_date(year(o_orderdate), 1, 4) - CAST(isodow(make_date(year(o_orderdate), 1, 4)) - 1 AS INTEGER) + 7 AS DATE) AS VARCHAR) AS second_week FROM orders""")
def temporal_constructors(spark, d):
    at = v("o.o_orderdate")
    return start(star_graph(spark, d), "o", "Order").returns(
        id=v("o.id"), later=S.date(S.date(at) + S.duration_from(F.lit("P1Y2M10D"))).cast("string"), first=S.date_of({"year": F.year(at), "month": F.month(at)}).cast("string"),
        same=S.date_of({"year": F.year(at), "ordinalDay": F.dayofyear(at)}).cast("string"), second_week=S.date_of({"year": F.year(at), "week": 2}).cast("string"),
    )
