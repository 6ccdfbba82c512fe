"""Registered queries of the graph, record and measurement operators on the driver's tables, each with the same query in DuckDB's SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .functions import literals, terms
from .operators import changes, entries, indexes, paging, shapes, tables
from .plans import patterns
from .registry import ORACLE_SQL, QUERIES, query
from .registry import table as _t
from .sources import quads, stores

__all__ = ["ORACLE_SQL", "QUERIES"]

PAGE_AFTER, PAGE_SIZE = 1000, 25
STATUSES = ("P", "F")


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """Nations, regions, customers and suppliers as quads, the nations in two graphs."""
    nation = _t(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("inRegion"))
    region = quads.quads_of(_t(spark, sf, "region"), "r_regionkey", "region", "geo")
    nations = [quads.quads_of(nation, "n_nationkey", "nation", g, {"inRegion": "region"}) for g in ("geo", "copy")]
    customer = quads.quads_of(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("inNation")), "c_custkey", "customer", "people", {"inNation": "nation"})
    supplier = quads.quads_of(_t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("inNation")), "s_suppkey", "supplier", "people", {"inNation": "nation"})
    return patterns.union(region, *nations, customer, supplier)


def _apart(spark: SparkSession, sf: str) -> DataFrame:
    """The union graph of all but the copy of the nations: graphs that share no triple."""
    return patterns.union_graph(_graph(spark, sf), ["geo", "people"], disjoint=True)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return quads.quads_of(_t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", "order", "orders", {"o_custkey": "customer"})


# Graph patterns


@query("SELECT o_orderkey::VARCHAR AS o, o_custkey::VARCHAR AS c, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'")
def bgp_star(spark: SparkSession, sf: str) -> DataFrame:
    g = patterns.union_graph(_orders(spark, sf), disjoint=True)
    found = patterns.join(patterns.pattern(g, "?o", "<o_orderstatus>", '"F"'), patterns.pattern(g, "?o", "<o_custkey>", "?c"), patterns.pattern(g, "?o", "<o_orderpriority>", "?priority"))
    return found.select(*(quads.value(F.col(c)).alias(c) for c in ("o", "c", "priority")))


@query("SELECT c_custkey::VARCHAR AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bgp_chain(spark: SparkSession, sf: str) -> DataFrame:
    g = _apart(spark, sf)
    steps = [("?c", "<inNation>", "?n"), ("?c", "<c_mktsegment>", "?segment"), ("?n", "<n_name>", "?nation"), ("?n", "<inRegion>", "?r"), ("?r", "<r_name>", "?region")]
    return patterns.join(*(patterns.pattern(g, *s) for s in steps)).select(*(quads.value(F.col(c)).alias(c) for c in ("c", "nation", "region")))


@query("SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 40 GROUP BY 1")
def optional_filter(spark: SparkSession, sf: str) -> DataFrame:
    left = _t(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("balance"))
    right = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("price"))
    return patterns.optional(left, right, F.col("r.price") > F.col("l.balance") * 40).groupBy("c").agg(F.count("o").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS c, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS x FROM customer),
b AS (SELECT o_custkey AS c, o_orderkey AS o, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 25)::INTEGER END AS x FROM orders)
SELECT a.c, b.o, coalesce(a.x, b.x) AS x FROM a JOIN b ON a.c = b.c AND (a.x = b.x OR a.x IS NULL OR b.x IS NULL)""")
def compat_join(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.expr("CASE WHEN c_acctbal > 0 THEN c_nationkey END AS x"))
    b = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.expr("CASE WHEN o_orderstatus <> 'P' THEN int(o_orderkey % 25) END AS x"))
    return patterns.compatible_join(a, b, ["c"], ["x"])


_URGENT = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"


@query(f"SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_URGENT})")
def not_exists(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.not_exists(_t(spark, sf, "customer").select(F.col("c_custkey").alias("c")), _t(spark, sf, "orders").where(_URGENT).select(F.col("o_custkey").alias("c")))


@query(f"SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_URGENT})")
def exists(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.exists(_t(spark, sf, "customer").select(F.col("c_custkey").alias("c")), _t(spark, sf, "orders").where(_URGENT).select(F.col("o_custkey").alias("c")))


@query("SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_returnflag = 'R')")
def minus(spark: SparkSession, sf: str) -> DataFrame:
    left = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    return patterns.minus(left, _t(spark, sf, "lineitem").where("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("s")))


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_pad(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.union(_t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), _t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('P', 'F')")
def values_join(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.values(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("status")), "status", STATUSES)


@query("SELECT 'nation/' || n_nationkey AS s, n_name AS o FROM nation")
def graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    found = patterns.pattern(patterns.union_graph(_graph(spark, sf), ["geo", "copy"]), "?s", "<n_name>", "?o")
    return found.select(F.translate("s", "<>", "").alias("s"), quads.value(F.col("o")).alias("o"))


@query("SELECT 'nation/' || n_nationkey AS s, g FROM nation, (VALUES ('geo'), ('copy')) t(g)")
def graph_scope(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.pattern(_graph(spark, sf), "?s", "<inRegion>", "?o", "?g").select(F.translate("s", "<>", "").alias("s"), "g")


@query("""WITH RECURSIVE e(a, b) AS (SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation), r(a, b) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r""")
def path_star(spark: SparkSession, sf: str) -> DataFrame:
    g = _apart(spark, sf)
    edges = patterns.union(*(patterns.pattern(g, "?a", p, "?b") for p in ("<inNation>", "<inRegion>")))
    return patterns.closure(edges).select(*(F.translate(c, "<>", "").alias(c) for c in "ab"))


@query("SELECT s, count(*)::BIGINT AS n FROM (SELECT 'nation/' || c_nationkey AS s FROM customer UNION ALL SELECT 'nation/' || s_nationkey FROM supplier) GROUP BY 1")
def path_inverse_count(spark: SparkSession, sf: str) -> DataFrame:
    found = patterns.pattern(_apart(spark, sf), "?x", "<inNation>", "?s")
    return found.groupBy(F.translate("s", "<>", "").alias("s")).agg(F.count("*").alias("n"))


# Records and entries


@query("""SELECT c_custkey::VARCHAR AS record, c_mktsegment AS kind,
sha256(min(c_custkey::VARCHAR) OVER (PARTITION BY c_nationkey, c_mktsegment)) AS entry FROM customer""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    customer = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record"), F.col("c_mktsegment").alias("kind"), "c_nationkey", "c_custkey")
    from pyspark.sql import Window

    chain = customer.withColumn("b", F.lag("record").over(Window.partitionBy("c_nationkey", "kind").orderBy("c_custkey")))
    return entries.entries(customer.select("record", "kind"), chain.where("b is not null").select(F.col("record").alias("a"), "b"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 25)")
def count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    small = _t(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return patterns.not_exists(_t(spark, sf, "lineitem"), small).agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT o_custkey AS c, string_agg(DISTINCT o_orderpriority, ' ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def group_concat(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " ").alias("priorities"))


@query("""SELECT c, number, day FROM (SELECT o_custkey AS c, strftime(min(o_orderdate), '%Y-%m-%d') AS day, o_orderpriority,
row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderdate), o_orderpriority)::INTEGER AS number FROM orders GROUP BY o_custkey, o_orderpriority)""")
def first_number(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    first = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c"), "o_orderpriority").agg(F.min("o_orderdate").alias("first"))
    number = F.row_number().over(Window.partitionBy("c").orderBy("first", "o_orderpriority"))
    return first.select("c", number.alias("number"), F.date_format("first", "yyyy-MM-dd").alias("day"))


@query("""SELECT a.p_partkey AS record, b.p_partkey AS other, list_sort(list_distinct(list(a.p_type))) AS origins FROM part a JOIN part b
ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey GROUP BY 1, 2""")
def blocking_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return entries.blocked_pairs(_t(spark, sf, "part"), "p_partkey", ["p_brand", "p_size"], "p_type")


_SPANS = "SELECT l_orderkey AS o, o_custkey AS c, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


@query(f"WITH x AS ({_SPANS}) SELECT a.o AS record, b.o AS other FROM x a JOIN x b ON a.c = b.c AND a.o < b.o AND a.s <= b.e AND b.s <= a.e")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    spans = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).groupBy(F.col("l_orderkey").alias("o"), F.col("o_custkey").alias("c")).agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    return entries.overlapping(spans, "o", ["c"], "s", "e")


@query("SELECT DISTINCT a.event_id AS record, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts::DATE = b.ts::DATE AND a.event_id < b.event_id")
def day_equal(spark: SparkSession, sf: str) -> DataFrame:
    return entries.blocked_pairs(_t(spark, sf, "events").withColumn("day", F.to_date("ts")), "event_id", ["user_id", "event_type", "day"])


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS a, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS b FROM pages)
SELECT a, b FROM p WHERE a IN (SELECT a FROM p GROUP BY a HAVING count(*) = 1) AND b IN (SELECT b FROM p GROUP BY b HAVING count(*) = 1)""")
def one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.regexp_extract("url", p, 1) for p in ("://([^/?#]*)", "://[^/?#]*([^?#]*)")]
    return entries.one_to_one(_t(spark, sf, "pages").select(parts[0].alias("a"), parts[1].alias("b")).distinct(), "a", "b")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS n FROM part) WHERE n = 1")
def star_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return entries.least_of_each(_t(spark, sf, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], [F.asc("p_name"), F.asc("p_partkey")])


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) p WHERE p.previous = e.event_id)")
def heads(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    chain = _t(spark, sf, "events").withColumn("previous", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return entries.heads(chain, "event_id", "previous").select("event_id", "user_id")


_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_ORDER)}) AS n FROM lineitem) WHERE n = 1""")
def dedupe_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return entries.first_arrivals(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.asc(c) for c in _ORDER]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT event_id, value, before FROM (SELECT *, max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before > value")
def went_back(spark: SparkSession, sf: str) -> DataFrame:
    return tables.went_back(_t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", F.to_date("ts")).select("event_id", "value", "before")


# Measurements


_SIDES = """WITH ev AS (SELECT user_id AS event, min(ts)::DATE AS day FROM events WHERE event_type = 'purchase' GROUP BY 1),
m AS (SELECT ev.event, e.event_type AS test, e.value AS v, e.ts::DATE AS d, e.ts::DATE <= ev.day AS b FROM ev JOIN events e ON e.user_id = ev.event),
s AS (SELECT event, test, count(v) FILTER (WHERE b) AS before_n, count(v) FILTER (WHERE NOT b) AS after_n, avg(v) FILTER (WHERE b) AS before_mean, avg(v) FILTER (WHERE NOT b) AS after_mean,
  max(v) FILTER (WHERE b) AS before_max, min(v) FILTER (WHERE NOT b) AS after_min, strftime(max(d) FILTER (WHERE b), '%Y-%m-%d') AS before_last,
  coalesce(var_pop(v) FILTER (WHERE b), 0) * count(v) FILTER (WHERE b) + coalesce(var_pop(v) FILTER (WHERE NOT b), 0) * count(v) FILTER (WHERE NOT b) AS q
  FROM m GROUP BY 1, 2)
"""


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    events = _t(spark, sf, "events").withColumn("day", F.to_date("ts"))
    first = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("day").alias("day")).select(F.col("user_id").alias("event"), "user_id", "day")
    return changes.sides(first, events.select("user_id", F.col("event_type").alias("test"), "day", "value"), by="user_id")


@query(_SIDES + "SELECT event, test, before_n, after_n, round(before_mean, 6) AS before_mean, round(after_mean, 6) AS after_mean, before_max, after_min, before_last FROM s WHERE before_n > 0 AND after_n > 0")
def event_sides(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf).select("event", "test", "before_n", "after_n", *(F.round(c, 6).alias(c) for c in ("before_mean", "after_mean")), "before_max", "after_min", F.col("before_last").cast("string").alias("before_last"))


@query(_SIDES + """SELECT event, test, round(abs(after_mean - before_mean) / greatest(sqrt(q / (before_n + after_n - 2)), abs(before_mean) * 0.01, 2.220446049250313e-16), 4) AS score,
CASE WHEN after_mean > before_mean THEN 'up' ELSE 'down' END AS direction FROM s WHERE before_n >= 3 AND after_n >= 3
UNION ALL SELECT event, test, 0, 'not enough results' FROM s WHERE before_n > 0 AND after_n > 0 AND (before_n < 3 OR after_n < 3)""")
def change_score(spark: SparkSession, sf: str) -> DataFrame:
    return changes.scored(_sides(spark, sf)).select("event", "test", F.round("score", 4).alias("score"), "direction")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), event_type) AS n FROM events GROUP BY 1, 2) WHERE n = 1")
def majority_unit(spark: SparkSession, sf: str) -> DataFrame:
    return changes.majority_unit(_t(spark, sf, "events"), "user_id", "event_type", "ts")


@query("""SELECT l_partkey AS drug, strftime(min(o_orderdate), '%Y-%m-%d') AS started, strftime(max(l_shipdate), '%Y-%m-%d') AS ended FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def therapy_fold(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    found = changes.therapies(lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey), "l_partkey", "o_orderdate", "l_shipdate")
    return found.select("drug", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("started", "ended")))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS e, s_nationkey AS g FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT a.r AS record, b.r AS other, min(a.e) AS first_shared, count(*) AS n_shared FROM x a JOIN x b ON a.e = b.e AND a.r < b.r AND a.g <> b.g GROUP BY 1, 2""")
def shared_ingredient_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, supplier = _t(spark, sf, "lineitem"), _t(spark, sf, "supplier")
    return changes.shared_element_pairs(lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey), "l_suppkey", "l_partkey", "s_nationkey")


# Pages, handles and coverage


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey > {PAGE_AFTER} ORDER BY 1 LIMIT {PAGE_SIZE})")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return paging.keyset_page(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", PAGE_AFTER, PAGE_SIZE)


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return paging.offset_page(orders, [F.asc("o_orderdate"), F.asc("o_orderkey")], 100, 50).drop("o_orderdate")


@query("""SELECT o_orderkey, sum(starts) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS run FROM (SELECT *,
CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_orderstatus THEN 0 ELSE 1 END AS starts FROM orders)""")
def row_run_page(spark: SparkSession, sf: str) -> DataFrame:
    return paging.runs(_t(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus", F.floor(F.col("o_orderkey") / 65_536)).select("o_orderkey", F.col("run").cast("long").alias("run"))


@query("""WITH d AS (SELECT c_custkey, sha256(c_custkey::VARCHAR) AS h FROM customer), w AS (SELECT *, coalesce(lag(h) OVER (ORDER BY h), '') AS p, coalesce(lead(h) OVER (ORDER BY h), '') AS q FROM d)
SELECT c_custkey, substr(h, 1, (SELECT min(k)::INTEGER FROM range(8, 65) r(k) WHERE substr(h, 1, k) <> substr(p, 1, k) AND substr(h, 1, k) <> substr(q, 1, k))) AS handle FROM w""")
def handles(spark: SparkSession, sf: str) -> DataFrame:
    digits = _t(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("digits"))
    return paging.handles(digits, "digits").select("c_custkey", "handle")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS s, l_linenumber::BIGINT + 1 AS e FROM lineitem),
y AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x)
SELECT l_orderkey, count(*) FILTER (WHERE s > b) AS n_gaps, min(s) AS covered_from, max(e) AS covered_to FROM y GROUP BY 1""")
def coverage_gap(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    return paging.gaps(_t(spark, sf, "lineitem").select("l_orderkey", n.alias("s"), (n + 1).alias("e")), ["l_orderkey"], "s", "e", F.floor(F.col("s") / 1024))


# Differences, refresh, preference


@query("""WITH a AS (SELECT l_partkey AS k, l_returnflag AS f FROM lineitem WHERE l_quantity <= 25), b AS (SELECT l_partkey AS k, l_returnflag AS f FROM lineitem WHERE l_quantity > 25),
c AS (SELECT k, f, sum(n) AS n FROM (SELECT k, f, 1 AS n FROM a UNION ALL SELECT k, f, -1 FROM b) GROUP BY 1, 2)
SELECT CASE WHEN n > 0 THEN 'missing' ELSE 'unexpected' END AS side, k, f, abs(n)::BIGINT AS n FROM c WHERE n <> 0""")
def multiset_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("f"), "l_quantity")
    return tables.multiset_difference(rows.where("l_quantity <= 25").drop("l_quantity"), rows.where("l_quantity > 25").drop("l_quantity"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, count(*) > 0 AS held FROM lineitem SEMI JOIN part ON l_partkey = p_partkey AND p_size > 20 GROUP BY ALL UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, false FROM lineitem ANTI JOIN part ON l_partkey = p_partkey AND p_size > 20 GROUP BY ALL")
def holds(spark: SparkSession, sf: str) -> DataFrame:
    held = _t(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"))
    return tables.holds(_t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct(), held, ["l_partkey"])


_PRICES = "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM {} GROUP BY 1"


@query(_PRICES.format("lineitem"))
def incremental_vs_full(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = _t(spark, sf, "lineitem")

    def view(rows: DataFrame) -> DataFrame:
        return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))

    late = F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp")
    touched = lineitem.where(late).select("l_orderkey").distinct()
    fresh = view(lineitem.join(touched, "l_orderkey", "left_semi"))
    return tables.replaced(view(lineitem.where(~late)), fresh, ["l_orderkey"], touched)


@query("""SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE source WHEN 'toxic' THEN 0 WHEN 'quality' THEN 1 ELSE 2 END, source) AS n FROM (
SELECT doc_id, 'quality' AS source, quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'none', 0 FROM documents)) WHERE n = 1""")
def preferred_source(spark: SparkSession, sf: str) -> DataFrame:
    labels, part = _t(spark, sf, "labels"), lambda df, source, score: df.select("doc_id", F.lit(source).alias("source"), score.cast("int").alias("score"))
    rows = patterns.union(part(labels, "quality", F.col("quality")), part(labels.where("toxic = 1"), "toxic", F.col("toxic")), part(_t(spark, sf, "documents"), "none", F.lit(0)))
    return tables.preferred(rows, ["doc_id"], "source", ["toxic", "quality"])


@query("""WITH a AS (SELECT p_partkey, 0 AS step, p_brand AS through FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_retailprice < 1200 UNION ALL SELECT p_partkey, 2, p_name FROM part)
SELECT p_partkey, step, through FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY step, through) AS n FROM a) WHERE n = 1""")
def class_fallback(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    steps = [part.where(w).select("p_partkey", F.col(c).alias("through")) for w, c in (("p_size < 10", "p_brand"), ("p_retailprice < 1200", "p_type"), ("true", "p_name"))]
    return tables.first_step(*steps, key=["p_partkey"], order=["through"]).select("p_partkey", "step", "through")


@query("""WITH RECURSIVE e(a, b) AS (SELECT DISTINCT p_brand, p_brand || '/' || p_type FROM part UNION SELECT DISTINCT p_brand || '/' || p_type, p_brand || '/' || p_type || '/' || p_size FROM part),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, count(*) AS n FROM r GROUP BY 1""")
def nested_panel(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part").select("p_brand", F.concat_ws("/", "p_brand", "p_type").alias("panel"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("member"))
    edges = part.select(F.col("p_brand").alias("a"), F.col("panel").alias("b")).unionByName(part.select(F.col("panel").alias("a"), F.col("member").alias("b")))
    return patterns.closure(edges, zero_length=False).groupBy("a").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey::VARCHAR = '17' OR contains(lower(p_name), '17') ORDER BY p_partkey LIMIT 50")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return tables.search(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", " 17")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1 HAVING count(o_orderkey) < 3")
def min_count_shape(spark: SparkSession, sf: str) -> DataFrame:
    return tables.too_few(_t(spark, sf, "customer"), "c_custkey", _t(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), 3)


@query("""SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement, round((avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))))
/ (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 6) AS kappa FROM labels""")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return tables.kappa(_t(spark, sf, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("SELECT role, count(*) AS turns, sum(length(text))::BIGINT AS chars, round(sum(CASE WHEN length(text) > 200 THEN length(text) * 3 ELSE length(text) END) / 1000000, 6) AS cost FROM conversations GROUP BY 1")
def token_costs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text").cast("long")
    return _t(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(n).alias("chars"), F.round(F.sum(F.when(n > 200, n * 3).otherwise(n)) / 1000000, 6).alias("cost"))


# Scalar functions


_LAST = "regexp_extract(url || CASE WHEN page_id % 3 = 0 THEN '%20a%C3%A9+b' ELSE '' END, '([^/#]*)$', 1)"


@query(f"SELECT page_id, url_decode({_LAST}) AS notation FROM pages WHERE {_LAST} <> ''")
def code_notation(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "%20a%C3%A9+b").otherwise(""))
    return _t(spark, sf, "pages").select("page_id", terms.notation_of(url).alias("notation")).where("notation is not null")


@query("SELECT p_partkey, 'http://codes.example/' || url_encode(p_name || ' *~/é') AS iri FROM part")
def iri_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", terms.code_iri("http://codes.example/", F.concat("p_name", F.lit(" *~/é"))).alias("iri"))


@query("SELECT c_custkey, 'ni:///sha-256;' || rtrim(replace(replace(base64(unhex(sha256(c_name || 'é😀'))), '+', '-'), '/', '_'), '=') AS name, lower(c_mktsegment || 'ÀÉ') AS kind FROM customer")
def sha_name(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey", terms.document_name(F.concat("c_name", F.lit("é😀"))).alias("name"), F.lower(F.concat("c_mktsegment", F.lit("ÀÉ"))).alias("kind"))


_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_MONTH_WORDS = "'^(january|february|march|april|june|july|august|september|sept|october|november|december)$'"


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+'), lambda w: w NOT IN ('t', 'z', 'utc')) AS words FROM documents)
SELECT doc_id, array_to_string(list_transform(words, lambda w: CASE WHEN list_position({_MONTHS}, w[:3]) > 0 AND (length(w) = 3 OR regexp_matches(w, {_MONTH_WORDS}))
THEN list_position({_MONTHS}, w[:3])::VARCHAR ELSE regexp_replace(w, '^0+(\\p{{N}})', '\\1') END), ' ') AS words FROM w""")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.array_join(terms.word_tokens(F.col("text")), " ").alias("words"))


@query("SELECT conv_id, turn, list_max(regexp_extract_all(text, '\\b(?:19|20)\\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01])\\b')) AS latest FROM conversations")
def latest_date(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "conversations").select("conv_id", "turn", terms.latest_date(F.col("text")).alias("latest"))


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '000000000000' AS instant, strftime(ts, '%Y-%m-%d') AS day FROM events")
def instant_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = terms.instant_key(F.col("ts"))
    return _t(spark, sf, "events").select("event_id", key.alias("instant"), terms.day_of(key).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < o_custkey * 1000 THEN -1 WHEN o_totalprice > o_custkey * 1000 THEN 1 ELSE 0 END AS cmp FROM orders")
def cmp3(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders")
    return orders.select("o_orderkey", terms.compare(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), (F.col("o_custkey") * 1000).cast("string")).alias("cmp"))


@query("SELECT p_partkey, p_name, kind || hex(encode(p_name)) || '.' AS up FROM (SELECT *, '2' AS kind FROM part)")
def sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", "p_name", terms.sort_key(F.col("p_name"), "2").alias("up"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[0-9]+|[^0-9]+'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN lpad(length(w::BIGINT::VARCHAR)::VARCHAR, 9, '0') || w::BIGINT ELSE w END), '') AS natural FROM part")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", terms.natural_key(F.col("p_name")).alias("natural"))


@query("""SELECT p_partkey, p_partkey::VARCHAR AS whole, 'integer' AS whole_type, p_size || '.5' AS part, CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END AS odd FROM part""")
def canonical_terms(spark: SparkSession, sf: str) -> DataFrame:
    held = lambda text, kind: literals.canonical(text, kind)
    part = _t(spark, sf, "part").select("p_partkey", held(F.concat(F.lit("+00"), "p_partkey"), "int").alias("w"), held(F.concat(F.lit("0"), "p_size", F.lit(".500")), "decimal").alias("d"), held((F.col("p_size") % 2).cast("string"), "boolean").alias("b"))
    return part.select("p_partkey", F.col("w.lex").alias("whole"), F.replace("w.datatype", F.lit(literals.XSD), F.lit("")).alias("whole_type"), F.col("d.lex").alias("part"), F.col("b.lex").alias("odd"))


# Stores and indexes


@query("""WITH t AS (SELECT '<customer/' || c_custkey || '>' AS nt FROM customer UNION SELECT '<c_mktsegment>' UNION SELECT '"' || c_mktsegment || '"' FROM customer)
SELECT nt, CASE WHEN nt LIKE '<%' THEN 2 ELSE 3 END AS kind, substr(nt, 2, length(nt) - 2) AS lex, CASE WHEN nt NOT LIKE '<%' THEN 'string' END AS datatype FROM t""")
def term_table(spark: SparkSession, sf: str) -> DataFrame:
    return stores.term_table(quads.quads_of(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "customer", "people")).drop("lang")


@query("SELECT '<order/' || o_orderkey || '>' AS s, o_orderstatus AS o, o_orderpriority AS g FROM orders WHERE substr(o_orderpriority, 1, 1)::INTEGER <= 2")
def as_of_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.concat(F.lit("<order/"), "o_orderkey", F.lit(">")).alias("s"), F.lit("<status>").alias("p"), F.col("o_orderstatus").alias("o"), F.col("o_orderpriority").alias("g"))
    steps = rows.select("g").distinct().withColumn("step", F.substring("g", 1, 1).cast("int"))
    return stores.as_of(rows, steps, 2).drop("p")


@query("SELECT p_partkey, 'local' AS origin, p_name FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'packed', p_name FROM part WHERE p_size >= 10")
def starter_overlay(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    local, packed = (rows.select("p_partkey", F.lit(origin).alias("origin"), "p_name") for rows, origin in ((part.where("p_size < 10"), "local"), (part, "packed")))
    return stores.overlaid(local, packed, "p_partkey")


@query("SELECT DISTINCT l_partkey AS code, l_suppkey AS subject FROM lineitem")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.inverted(_t(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_partkey AS target, l_suppkey AS source, bool_or(l_quantity = 50) AS precise FROM lineitem GROUP BY 1, 2")
def inverse_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.inverse_mapping(_t(spark, sf, "lineitem").withColumn("whole", F.col("l_quantity") == 50), "l_suppkey", "l_partkey", "whole")


@query("SELECT l_returnflag, count(*) AS n, sum(('0x' || substr(sha256(k), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM (SELECT DISTINCT l_returnflag, l_partkey::VARCHAR AS k FROM lineitem) GROUP BY 1")
def set_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").cast("string").alias("k"))
    return indexes.fingerprint(rows, "k", ["l_returnflag"]).withColumn("fingerprint", F.col("fingerprint").cast("string"))


@query("""WITH d AS (SELECT c_custkey, sha256(c_custkey::VARCHAR) AS h, substr(sha256(c_custkey::VARCHAR), 1, 8 + (c_custkey % 5)::INTEGER) AS handle FROM customer)
SELECT a.handle, min(b.c_custkey) AS c_custkey FROM (SELECT DISTINCT handle FROM d) a JOIN d b ON starts_with(b.h, a.handle) GROUP BY 1 HAVING count(*) = 1""")
def handle_resolution(spark: SparkSession, sf: str) -> DataFrame:
    held = _t(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("digits"))
    asked = held.select(F.expr("substr(digits, 1, 8 + int(c_custkey % 5))").alias("handle")).distinct()
    return indexes.resolved(asked, "handle", held, "digits").select("handle", "c_custkey")


@query("SELECT DISTINCT '<customer/' || o_custkey || '>' AS name FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def undescribed(spark: SparkSession, sf: str) -> DataFrame:
    orders = quads.quads_of(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "order", "orders", {"o_custkey": "customer"})
    customer = quads.quads_of(_t(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey", "customer", "people")
    return indexes.undescribed(orders.unionByName(customer))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'click')) AS other FROM events GROUP BY 1")
def counts_per_kind(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.per_kind(_t(spark, sf, "events"), "user_id", "event_type", ["purchase", "click"])


# Shapes and texts


@query("""SELECT o_orderkey AS node, 'in' AS "constraint", o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT o_orderkey, 'pattern', o_orderstatus FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[FO]$') UNION ALL SELECT o_orderkey, 'max', o_custkey::VARCHAR FROM orders WHERE o_custkey > 100""")
def shape_values(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"in": ("o_orderpriority", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "pattern": ("o_orderstatus", F.col("o_orderstatus").rlike("^[FO]$")), "max": ("o_custkey", F.col("o_custkey") <= 100)}
    return shapes.value_violations(_t(spark, sf, "orders"), "o_orderkey", checks)


@query("SELECT c_custkey AS node, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(DISTINCT o_orderpriority) NOT BETWEEN 1 AND 4")
def shape_counts(spark: SparkSession, sf: str) -> DataFrame:
    given = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return shapes.count_violations(_t(spark, sf, "customer"), given, "c_custkey", least=1, most=4)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def written_days(spark: SparkSession, sf: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(day, "yyyyMMddHHmm")).when(k == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    return _t(spark, sf, "orders").select("o_orderkey", terms.iso_date(text).alias("day"))


@query(r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])')")
def word_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "conversations").where(terms.mentions(F.col("text"), "The")).select("conv_id", "turn")


from . import graph_queries, matching_queries, record_queries, term_queries  # noqa: E402, F401  (they register their own)
