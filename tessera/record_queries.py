"""Registered queries of series, reference tables, citations, derivations and pages, each with its SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .operators import changes, citations, entries, filing, paging, shapes, tables
from .plans import patterns
from .registry import query, table
from .sources import quads

# Series and timelines

_LABS = """SELECT user_id AS person, event_type AS code, event_id AS place, CASE WHEN event_id % 13 = 0 THEN '2024-01' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS performed,
CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE round(value, 2)::DECIMAL(18,2)::VARCHAR END AS value, CASE WHEN event_id % 4 = 0 THEN 'mg' ELSE 'g' END AS unit FROM events"""
_DRUGS = """SELECT user_id AS person, event_id AS place, 'http://codes.example/rx/' || event_id % 3 AS code, 'drug' AS medication, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS started,
CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS written, CASE WHEN event_id % 6 = 0 THEN strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') END AS ended FROM events WHERE event_type = 'purchase'"""


def _labs(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events"), F.col("event_id")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.round("value", 2).cast("decimal(18,2)").cast("string")
    return e.select(F.col("user_id").alias("person"), F.col("event_type").alias("code"), k.alias("place"), F.when(k % 13 == 0, "2024-01").otherwise(time).alias("performed"), F.when(k % 7 == 0, "n/a").otherwise(number).alias("value"), F.when(k % 4 == 0, "mg").otherwise("g").alias("unit"))


def _drugs(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events").where("event_type = 'purchase'"), F.col("event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select(
        F.col("user_id").alias("person"),
        k.alias("place"),
        F.concat(F.lit("http://codes.example/rx/"), k % 3).alias("code"),
        F.lit("drug").alias("medication"),
        F.when(k % 2 == 0, day("ts")).alias("started"),
        F.when(k % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("written"),
        F.when(k % 6 == 0, day(F.col("ts") + F.expr("INTERVAL 3 DAY"))).alias("ended"),
    )


@query(f"""WITH m AS ({_DRUGS}), l AS (SELECT *, CASE WHEN performed LIKE '____-__-__%' THEN performed[:10] END AS day, TRY_CAST(CASE WHEN value <> 'n/a' THEN value END AS DOUBLE) AS v FROM ({_LABS})),
t AS (SELECT person, string_split(code, '/')[-1] AS label, min(coalesce(started, written[:10])) AS day, max(ended) AS ended FROM m GROUP BY 1, 2),
ev AS (SELECT person, 'start' AS kind, label, day FROM t WHERE day IS NOT NULL UNION ALL SELECT person, 'stop', label, ended FROM t WHERE ended IS NOT NULL),
u AS (SELECT person, code, unit FROM (SELECT person, code, unit, row_number() OVER (PARTITION BY person, code ORDER BY count(*) DESC, min((day, place)), unit) AS n FROM l WHERE day IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2, 3) WHERE n = 1),
k AS (SELECT l.person, l.code, count(*) FILTER (WHERE day IS NOT NULL AND v IS NULL) AS unparsed, count(*) FILTER (WHERE day IS NOT NULL AND v IS NOT NULL AND l.unit <> u.unit) AS other_unit, count(*) FILTER (WHERE day IS NULL) AS undated, min(day) AS lo, max(day) AS hi FROM l LEFT JOIN u USING (person, code) GROUP BY 1, 2),
x AS (SELECT ev.person, ev.kind, ev.label, ev.day, k.code, u.unit, unparsed, other_unit, undated FROM ev JOIN k USING (person) JOIN u ON u.person = ev.person AND u.code = k.code WHERE lo <= ev.day AND hi > ev.day),
s AS (SELECT x.person, x.kind || ':' || x.label || ':' || x.code AS key, x.day AS date, x.unit, unparsed, other_unit, undated,
  count(v) FILTER (WHERE l.day <= x.day) AS bn, count(v) FILTER (WHERE l.day > x.day) AS an, coalesce(avg(v) FILTER (WHERE l.day <= x.day), 0) AS bm, coalesce(avg(v) FILTER (WHERE l.day > x.day), 0) AS am,
  coalesce(var_pop(v) FILTER (WHERE l.day <= x.day), 0) * count(v) FILTER (WHERE l.day <= x.day) + coalesce(var_pop(v) FILTER (WHERE l.day > x.day), 0) * count(v) FILTER (WHERE l.day > x.day) AS q
  FROM x LEFT JOIN l ON l.person = x.person AND l.code = x.code AND l.unit = x.unit AND l.day IS NOT NULL AND l.v IS NOT NULL GROUP BY ALL)
SELECT person, key, date, unit, unparsed, other_unit, undated, bn AS before_n, an AS after_n, round(bm, 6) AS before_mean, round(am, 6) AS after_mean,
CASE WHEN bn < 3 OR an < 3 THEN 'not enough results' WHEN am > bm THEN 'up' ELSE 'down' END AS direction,
CASE WHEN bn < 3 OR an < 3 THEN 0 ELSE round(abs(am - bm) / greatest(sqrt(q / (bn + an - 2)), abs(bm) * 0.01, 2.220446049250313e-16), 4) END AS score FROM s""")
def lab_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What changed after each therapy's start and stop, with what was left out."""
    found = changes.changes_in(_drugs(spark, sf), _labs(spark, sf), "person")
    return found.select("person", "key", "date", "unit", "unparsed", "other_unit", "undated", "before_n", "after_n", *(F.round(c, 6).alias(c) for c in ("before_mean", "after_mean")), "direction", F.round("score", 4).alias("score"))


@query(f"SELECT person, code AS test, performed[:10] AS day, value::DOUBLE AS value, unit, place FROM ({_LABS}) WHERE performed LIKE '____-__-__%' AND value <> 'n/a'")
def lab_series(spark: SparkSession, sf: str) -> DataFrame:
    """The results that a series shows."""
    return changes.series(_labs(spark, sf), "person")


@query(f"""SELECT person, code AS test, count(*) FILTER (WHERE performed LIKE '____-__-__%' AND value <> 'n/a') AS shown, count(*) FILTER (WHERE performed LIKE '____-__-__%' AND value = 'n/a') AS unparsed,
count(*) FILTER (WHERE performed NOT LIKE '____-__-__%') AS undated FROM ({_LABS}) GROUP BY 1, 2""")
def lab_series_left(spark: SparkSession, sf: str) -> DataFrame:
    """What series leave out."""
    return changes.series_left(_labs(spark, sf), "person")


@query(f"SELECT place, medication AS name, string_split(code, '/')[-1] AS notation, started, written[:10] AS written, ended, coalesce(started, written[:10], '9999') AS at FROM ({_DRUGS})")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Medications person start, else person the day their prescription was written."""
    return changes.timeline(_drugs(spark, sf))


@query("""SELECT user_id, whole, fraction, name FROM (SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS whole, rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') AS fraction, event_id::VARCHAR AS name,
row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0'), event_id::VARCHAR) AS n FROM events) WHERE n = 1""")
def earliest_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """The soonest arrival by seconds, digits of the fraction and name."""
    rows = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("whole"), F.rtrim(F.date_format("ts", "SSSSSS"), F.lit("0")).alias("fraction"), F.col("event_id").cast("string").alias("name"))
    return changes.earliest(rows, "user_id", "whole", "fraction", "name")


@query("""WITH a AS (SELECT s_suppkey AS entry, s_nationkey AS code, list_distinct([s_suppkey % 7, s_suppkey % 11 + 3, s_nationkey % 5 + 1]) AS e FROM supplier)
SELECT a.entry, b.entry AS other, list_filter([a.entry % 7, a.entry % 11 + 3, a.code % 5 + 1], lambda x: list_contains(b.e, x))[1] AS element FROM a JOIN a b ON a.entry < b.entry AND a.code <> b.code AND list_has_any(a.e, b.e)""")
def sharing_an_ingredient(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that share an element and no code, with the first shared one in the first's order."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    return changes.sharing(table(spark, sf, "supplier").select(s.alias("entry"), F.array(n).alias("codes"), F.array(s % 7, s % 11 + 3, n % 5 + 1).alias("elements")), "entry", "codes", "elements")


# Reference tables

_OWN = "SELECT p_brand || '-' || p_size AS code, p_type AS relation, p_name AS class FROM part WHERE p_size % 3 = 0 UNION SELECT p_brand, 'LARGE', p_name FROM part WHERE p_size < 4"
_WALK = f"""WITH own AS ({_OWN}), maps AS (SELECT DISTINCT p_brand || '-' || p_size AS form, p_brand AS ingredient FROM part), stated AS (SELECT * FROM maps WHERE ingredient <> 'Brand#11'),
codes AS (SELECT form AS code FROM maps UNION SELECT ingredient FROM maps UNION SELECT code FROM own), direct AS (SELECT code, relation, class, 0 AS step, code AS through FROM codes JOIN own USING (code)),
w AS (SELECT * FROM direct UNION ALL SELECT * FROM (SELECT ingredient AS code, relation, class, 1, form FROM stated JOIN own ON own.code = form UNION ALL SELECT form, relation, class, 2, ingredient FROM stated JOIN own ON own.code = ingredient) x(code, relation, class, step, through) ANTI JOIN direct USING (code, relation)),
found AS (SELECT code, relation, class, min((step, through)) AS f FROM w GROUP BY 1, 2, 3)"""


def _walk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    form = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    own = part.where("p_size % 3 = 0").select(form.alias("code"), F.col("p_type").alias("relation"), F.col("p_name").alias("class"))
    own = own.unionByName(part.where("p_size < 4").select(F.col("p_brand").alias("code"), F.lit("LARGE").alias("relation"), F.col("p_name").alias("class"))).distinct()
    maps = part.select(form.alias("form"), F.col("p_brand").alias("ingredient")).distinct()
    return tables.class_walk(own, maps, maps.where("ingredient <> 'Brand#11'").select("form"))


@query(_WALK + " SELECT code, relation, class, f[1] AS step, f[2] AS through FROM found".replace("f[1]", "struct_extract_at(f, 1)").replace("f[2]", "struct_extract_at(f, 2)"))
def medication_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes through a code, its precise forms or its ingredient."""
    return _walk(spark, sf)[0]


@query(_WALK + """ SELECT DISTINCT a.form AS code, own.relation FROM stated a JOIN stated b ON a.ingredient = b.ingredient AND a.form <> b.form JOIN own ON own.code = b.form
WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.code = a.form AND found.relation = own.relation)""")
def classed_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    """Relations withheld, as only another form bears them."""
    return _walk(spark, sf)[1]


_SERIES = "CASE p_size % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'a' ELSE 'b' END"


@query(f"""WITH n AS (SELECT p_brand AS code, {_SERIES} AS series, p_name AS value FROM part WHERE p_size < 6), t AS (SELECT p_brand AS code, {_SERIES} AS series, p_type AS value FROM part WHERE p_size BETWEEN 4 AND 8),
f AS (SELECT 'name' AS k, code, series, list_sort(list_distinct(list(value))) AS v FROM n GROUP BY ALL UNION ALL SELECT 'kind', code, series, list_sort(list_distinct(list(value))) FROM t GROUP BY ALL),
b AS (SELECT k, code, arg_min(v, CASE series WHEN 'b' THEN 0 WHEN 'c' THEN 1 ELSE 2 END) AS v FROM f GROUP BY 1, 2)
SELECT c.code, x.v AS name, y.v AS kind FROM (SELECT DISTINCT p_brand AS code FROM part) c LEFT JOIN b x ON x.code = c.code AND x.k = 'name' LEFT JOIN b y ON y.code = c.code AND y.k = 'kind'""")
def about_codes(spark: SparkSession, sf: str) -> DataFrame:
    """What the first preferred series says of each code, attribute by attribute."""
    part = table(spark, sf, "part").withColumn("series", F.expr(_SERIES))
    rows = lambda where, value: part.where(where).select(F.col("p_brand").alias("code"), "series", F.col(value).alias("value"))
    return tables.about(part.select(F.col("p_brand").alias("code")), ["b", "c"], name=rows("p_size < 6", "p_name"), kind=rows("p_size BETWEEN 4 AND 8", "p_type"))


@query("""WITH r AS (SELECT DISTINCT 'n' || n_nationkey AS subject, 'in' AS predicate, 'r' || n_regionkey AS object, 'geo' AS series FROM nation UNION SELECT 'c' || c_custkey, 'of', 'n' || c_nationkey, 'people' FROM customer), a AS (SELECT 'n' || n_nationkey AS code FROM nation WHERE n_nationkey % 3 = 0)
SELECT code, 'says' AS direction, series, predicate, object AS value FROM a JOIN r ON subject = code UNION SELECT code, 'is named by', series, predicate, subject FROM a JOIN r ON object = code""")
def facts_of_codes(spark: SparkSession, sf: str) -> DataFrame:
    """All that is said of codes, and by them."""
    of = lambda df, s, p, o, g: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(g).alias("series"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    rows = of(nation, name("n", "n_nationkey"), "in", name("r", "n_regionkey"), "geo").unionByName(of(customer, name("c", "c_custkey"), "of", name("n", "c_nationkey"), "people"))
    return tables.facts(nation.where("n_nationkey % 3 = 0").select(name("n", "n_nationkey").alias("code")), rows)


@query("""SELECT p_brand AS code, array_to_string(list_sort(list_distinct(list(lower(p_name)))), chr(10)) AS names, coalesce(list_sort(list_distinct(list(p_type) FILTER (WHERE p_size < 5))), []) AS maps_to FROM part GROUP BY 1""")
def code_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Names and targets of each code."""
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_brand").alias("subject"), F.lit("label").alias("predicate"), F.col("p_name").alias("object")).unionByName(part.where("p_size < 5").select(F.col("p_brand").alias("subject"), F.lit("maps").alias("predicate"), F.col("p_type").alias("object")))
    return tables.listing(rows, ["label"], "maps")


@query("""WITH a AS (SELECT o_orderkey AS v, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 END AS gene, o_custkey AS code FROM orders), h AS (SELECT 's' || c_custkey % 3 AS s, c_custkey AS code, c_nationkey AS subject FROM customer WHERE c_custkey % 4 > 0),
c(s, gene) AS (VALUES ('s0', 1), ('s1', 2), ('s1', 1)), m AS (SELECT v, s, min(subject) AS subject FROM a JOIN h USING (code) GROUP BY 1, 2 HAVING count(DISTINCT subject) = 1), ss(s, p) AS (VALUES ('s0', 2), ('s1', 0), ('s2', 2)),
p AS (SELECT a.v, a.gene, ss.s, ss.p, m.subject, c.gene IS NOT NULL AS covers, ss.s IN ('s0', 's1') AS states FROM a CROSS JOIN ss LEFT JOIN c ON c.s = ss.s AND c.gene = a.gene LEFT JOIN m ON m.v = a.v AND m.s = ss.s),
f AS (SELECT v, gene, arg_min((s, subject), (p, s)) FILTER (WHERE covers) AS cov, arg_min((s, subject), (p, s)) FILTER (WHERE subject IS NOT NULL) AS any_, arg_min((s, subject), (p, s)) FILTER (WHERE subject IS NOT NULL AND NOT states) AS unn,
 arg_min((s, subject), (p, s)) FILTER (WHERE states) AS sta, arg_min((s, subject), (p, s)) AS fst FROM p GROUP BY 1, 2),
g AS (SELECT v, gene, cov, unn, sta, CASE WHEN gene IS NULL THEN coalesce(any_, fst) ELSE coalesce(cov, unn, sta, fst) END AS ch FROM f),
o AS (SELECT v, struct_extract_at(ch, 1) AS series, struct_extract_at(ch, 2) AS subject, CASE WHEN gene IS NOT NULL AND cov IS NULL AND unn IS NULL AND sta IS NOT NULL THEN 'not covered' WHEN struct_extract_at(ch, 2) IS NOT NULL THEN 'rows' ELSE 'not found' END AS outcome FROM g)
SELECT v AS variant, outcome, series, CASE WHEN outcome = 'rows' THEN subject END AS subject FROM o""")
def variant_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Which series classifies a variant, by genes covered and preference."""
    k = F.col("o_orderkey")
    asked = table(spark, sf, "orders").select(k.alias("variant"), F.when(k % 3 > 0, k % 6).alias("gene"), F.col("o_custkey").alias("code"))
    held = table(spark, sf, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("s"), F.col("c_custkey") % 3).alias("series"), F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("subject"))
    covers = spark.createDataFrame([("s0", 1), ("s1", 2), ("s1", 1)], "series string, gene long")
    return tables.classified(asked, held, covers, ["s1"])


@query("""SELECT c_custkey AS subject, min(c_mktsegment) AS segment, min(c_nationkey::VARCHAR) AS nation, min(c_mktsegment) AS segment_label, min(coalesce(n_name, c_nationkey::VARCHAR)) AS nation_label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey GROUP BY 1""")
def classification_row(spark: SparkSession, sf: str) -> DataFrame:
    """A row's fields with their labels, and the value where there is no label."""
    customer = table(spark, sf, "customer")
    row = lambda p, o: customer.select(F.col("c_custkey").alias("subject"), F.lit(p).alias("predicate"), F.col(o).cast("string").alias("object"))
    labels = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    return tables.pivoted(row("s", "c_mktsegment").unionByName(row("n", "c_nationkey")), {"segment": "s", "nation": "n"}, labels)


@query("""WITH RECURSIVE e(a, b) AS (SELECT DISTINCT p_brand, p_brand || '/' || p_type FROM part UNION SELECT DISTINCT p_brand || '/' || p_type, p_brand || '/' || p_type || '/' || p_size FROM part),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), res AS (SELECT p_brand || '/' || p_type || '/' || p_size AS member, p_partkey AS result FROM part WHERE p_size < 10)
SELECT a AS panel, b AS member, result FROM r LEFT JOIN res ON member = b WHERE result IS NOT NULL OR b LIKE '%/5%' OR b LIKE '%/4%'""")
def panel_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of nested panels, and required members without one."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", F.concat_ws("/", "p_brand", "p_type").alias("panel"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("member"))
    edges = part.select(F.col("p_brand").alias("a"), F.col("panel").alias("b")).unionByName(part.select(F.col("panel").alias("a"), F.col("member").alias("b")))
    nested = patterns.closure(edges, zero_length=False)
    members = nested.select(F.col("b").alias("member")).distinct().withColumn("required", F.contains("member", F.lit("/5")) | F.contains("member", F.lit("/4")))
    return tables.panel_rows(nested, members, part.where("p_size < 10").select("member", F.col("p_partkey").alias("result")))


@query("SELECT p_partkey, s || p_name AS iri, p_brand FROM part, (VALUES ('http://a.example/'), ('http://b.example/')) t(s) WHERE s = 'http://b.example/' AND p_size < 20")
def code_join_by_space(spark: SparkSession, sf: str) -> DataFrame:
    """Codes that stand in any of two URI spaces, joined with rows that name them in one."""
    part = table(spark, sf, "part")
    spread = tables.by_system(part.where("p_size < 20").select("p_partkey", "p_name"), "p_name", ["http://a.example/", "http://b.example/"])
    named = part.select(F.concat(F.lit("http://b.example/"), "p_name").alias("iri"), "p_partkey", "p_brand")
    return spread.join(named, ["iri", "p_partkey"]).select("p_partkey", "iri", "p_brand")


@query(f"SELECT notation, series, code FROM (SELECT p_brand AS notation, {_SERIES} AS series, min(p_partkey) AS code, row_number() OVER (PARTITION BY p_brand ORDER BY CASE {_SERIES} WHEN 'b' THEN 0 ELSE 1 END, {_SERIES}) AS n FROM part GROUP BY 1, 2) WHERE n = 1")
def code_named(spark: SparkSession, sf: str) -> DataFrame:
    """The first series that holds a notation."""
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("notation"), F.expr(_SERIES).alias("series")).agg(F.min("p_partkey").alias("code"))
    return tables.code_named(rows, "notation", "series", ["b"])


@query("""SELECT DISTINCT l_orderkey AS report, l_partkey AS row, l_returnflag AS origin FROM lineitem a WHERE l_quantity > 30 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)
AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = a.l_returnflag AND b.l_discount > 0.05)""")
def reports_differing(spark: SparkSession, sf: str) -> DataFrame:
    """Reports whose held row's verdict is that it differs."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("row"), F.col("l_returnflag").alias("origin"), "l_quantity", F.when(F.col("l_discount") > 0.05, "differs").otherwise("agrees").alias("verdict"))
    held = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("row")).crossJoin(spark.createDataFrame([("A",), ("N",), ("R",)], "origin string"))
    return tables.differing(rows.where("l_quantity > 30").select("report", "row", "origin").distinct(), held, rows)


@query("SELECT DISTINCT l_partkey AS version FROM lineitem WHERE l_quantity = 50 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def unheld_table_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions that are named but not held."""
    return tables.unheld(table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("version")), table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("version")), "version")


@query("SELECT o_custkey AS view, list_sort(list_distinct(list(o_orderpriority))) AS versions FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def used_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The table versions that each view was made with."""
    return filing.used_versions(table(spark, sf, "orders").select(F.col("o_custkey").alias("view"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("version")), "view", "version")


@query("""WITH v AS (SELECT o_custkey AS series, o_orderkey AS version, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS revises FROM orders),
h AS (SELECT series, version FROM v ANTI JOIN (SELECT series, revises AS version FROM v WHERE revises IS NOT NULL) r USING (series, version)) SELECT series, min(version) AS version FROM h GROUP BY 1 HAVING count(*) = 1""")
def current_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The one head of each series of versions."""
    from pyspark.sql import Window

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("version"))
    before = F.lag("version").over(Window.partitionBy("series").orderBy("version"))
    return filing.current_versions(rows.withColumn("revises", F.when(F.col("version") % 3 != 0, before)))


# Citations


@query("""WITH c AS (SELECT o_orderkey AS citation, o_custkey AS cite, o_orderkey % 3 AS line, 'status' AS kind, lower(o_orderstatus) AS given FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderkey % 3, 'priority', lower(o_orderpriority) FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT o_custkey AS cite, o_orderkey % 5 AS "at", 'status' AS kind, lower(o_orderstatus) AS given FROM orders WHERE o_totalprice > 150000 UNION SELECT o_custkey, o_orderkey % 5, 'priority', lower(o_orderpriority) FROM orders WHERE o_totalprice > 150000),
w AS (SELECT citation, cite, line, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT citation, f."at", count(*) AS held, list(c.kind) AS has FROM c JOIN f ON c.cite = f.cite AND c.kind = f.kind AND c.given = f.given GROUP BY 1, 2),
x AS (SELECT w.*, EXISTS (SELECT 1 FROM f WHERE f.cite = w.cite AND f."at" = w.line) AS there, (SELECT max(held) FROM m WHERE m.citation = w.citation AND m."at" = w.line) AS held, (SELECT count(*) FROM m WHERE m.citation = w.citation AND m."at" <> w.line AND m.held = w.n) AS elsewhere FROM w)
SELECT citation, CASE WHEN NOT there THEN 'no such record' WHEN coalesce(held, 0) = n THEN 'ok' WHEN elsewhere > 0 THEN 'not at that line' ELSE 'says otherwise' END AS verdict FROM x""")
def checked_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Whether cited records say what they are cited for."""
    k, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    claim = lambda kind, c, df: df.select(k.alias("citation"), F.col("o_custkey").alias("cite"), (k % 3).alias("line"), F.lit(kind).alias("kind"), F.concat(F.lit(" "), F.col(c)).alias("given"))
    said = lambda kind, c: orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("cite"), (k % 5).alias("line"), F.lit(kind).alias("kind"), F.col(c).alias("said"))
    claims = claim("status", "o_orderstatus", orders).unionByName(claim("priority", "o_orderpriority", orders.where("o_orderkey % 2 = 0")))
    return citations.check_citations(claims, said("status", "o_orderstatus").unionByName(said("priority", "o_orderpriority"))).select("citation", "verdict")


@query("""WITH a AS (SELECT c_custkey AS absence, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'x' END AS looked_for, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'all' END AS coverage, CASE WHEN c_custkey % 11 > 0 THEN c_custkey * 2 END AS query FROM customer),
r AS (SELECT o_custkey AS query, bool_or(o_orderstatus <> 'P') AS ok, bool_or(o_orderstatus <> 'P' AND o_totalprice > 400000) AS holds, bool_or(o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') AS whole FROM orders GROUP BY 1),
x AS (SELECT absence, CASE WHEN trim(looked_for) = '' THEN 'nothing to look for' WHEN coverage IS NULL THEN 'no coverage' WHEN a.query IS NULL THEN 'no query' WHEN ok IS NULL THEN 'query not run' WHEN NOT ok THEN 'query refused' WHEN holds THEN 'query found it' WHEN NOT whole THEN 'query cut short' END AS reason FROM a LEFT JOIN r USING (query))
SELECT absence, reason IS NULL AS backed, reason FROM x""")
def checked_absences(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what is said to be absent is backed by a query that ran and was whole."""
    k = F.col("c_custkey")
    absences = table(spark, sf, "customer").select(k.alias("absence"), F.when(k % 17 == 0, " ").otherwise("x").alias("looked_for"), F.when(k % 13 != 0, "all").alias("coverage"), F.when(k % 11 > 0, k * 2).alias("query"))
    calls = table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_totalprice") > 400_000).alias("holds"), (F.col("o_orderpriority") == "1-URGENT").alias("whole"))
    return citations.check_absences(absences, calls)


@query("""WITH n AS (SELECT o_custkey AS item, count(*) AS c FROM orders WHERE o_totalprice > 250000 GROUP BY 1), r AS (SELECT DISTINCT c_custkey AS item FROM customer WHERE c_acctbal > 0)
SELECT item, 'given twice' AS fault FROM n WHERE c > 1 UNION ALL SELECT item, 'no such item' FROM r ANTI JOIN n USING (item) UNION ALL SELECT item, 'not referred to' FROM n ANTI JOIN r USING (item)""")
def reply_references(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of a reply's numbering."""
    return citations.check_references(table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("item")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("item")))


@query("SELECT o_orderpriority AS arm, o_orderstatus AS verdict, count(*) AS n FROM orders GROUP BY 1, 2")
def verdicts_per_arm(spark: SparkSession, sf: str) -> DataFrame:
    """How often each arm got each verdict."""
    return citations.per_arm(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("verdict")), "arm", "verdict")


# Derivations, views, pages and shapes


@query("""WITH e AS (SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS n FROM customer), r AS (SELECT DISTINCT e.s, 'region/' || n_regionkey AS o FROM e JOIN nation ON e.n = 'nation/' || n_nationkey)
SELECT s, 'inRegion' AS p, o, 'regions' AS g FROM r UNION ALL SELECT DISTINCT o, 'hasCustomers', 'yes', 'busy' FROM r""")
def derived_triples(spark: SparkSession, sf: str) -> DataFrame:
    """What two derivations add, the second to what the first did."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("inRegion"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("inNation"))
    graph = patterns.union_graph(quads.quads_of(nation, "n_nationkey", "nation", "geo", {"inRegion": "region"}).unionByName(quads.quads_of(customer, "c_custkey", "customer", "people", {"inNation": "nation"})), disjoint=True)

    def regions(g: DataFrame) -> DataFrame:
        met = patterns.join(patterns.pattern(g, "?s", "<inNation>", "?n"), patterns.pattern(g, "?n", "<inRegion>", "?o"))
        return met.select("s", F.lit("<inRegion>").alias("p"), "o")

    def busy(g: DataFrame) -> DataFrame:
        return patterns.pattern(g, "?s", "<inRegion>", "?o").where("startswith(s, '<customer/')").select(F.col("o").alias("s"), F.lit("<hasCustomers>").alias("p"), F.lit("<yes>").alias("o"))

    found = filing.derived(graph, {"regions": regions, "busy": busy})
    return found.select(*(F.translate(c, "<>", "").alias(c) for c in ("s", "p", "o")), "g")


@query("SELECT 'pod/orders#' || sha256(min(o_orderkey)::VARCHAR) AS entry, o_custkey FROM orders GROUP BY 2")
def entries_in_view(spark: SparkSession, sf: str) -> DataFrame:
    """Entries named within a view."""
    least = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("entry"))
    return filing.in_view(least, "entry", "pod/orders")


@query("""WITH RECURSIVE t AS (SELECT doc_id % 50 AS s, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n, doc_id, length(text) AS size FROM documents),
p AS (SELECT s, n, doc_id, size AS used, 1 AS page FROM t WHERE n = 1 UNION ALL SELECT t.s, t.n, t.doc_id, CASE WHEN p.used + t.size <= 3000 THEN p.used + t.size ELSE t.size END, CASE WHEN p.used + t.size <= 3000 THEN p.page ELSE p.page + 1 END FROM p JOIN t ON t.s = p.s AND t.n = p.n + 1)
SELECT doc_id, page::BIGINT AS page FROM p""")
def sized_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of as many rows as fit a budget of characters."""
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("s"), "doc_id", F.length("text").alias("size"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("doc_id")))
    return paging.sized_pages(rows, ["s"], "n", "size", 3000).select("doc_id", F.col("page").cast("long").alias("page"))


@query("SELECT conv_id, sum(hi - lo) = max(hi) AND min(lo) = 0 AS whole FROM (SELECT conv_id, turn % 4 AS k, min(turn) AS lo, max(turn) + 1 AS hi FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn < 1) GROUP BY 1, 2) GROUP BY 1")
def covered_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pages of a conversation that were read cover it from its first turn on."""
    read = table(spark, sf, "conversations").where("turn < 1").select("conv_id", F.col("turn").cast("long").alias("s"), (F.col("turn") + 1).cast("long").alias("e")).distinct()
    return paging.covers(read, read.groupBy("conv_id").agg(F.max("e").alias("total")), ["conv_id"], "s", "e", F.floor(F.col("s") / 1024))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderpriority, o_orderkey LIMIT 50")
def rendering_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows in the order in which dated rows are shown."""
    rows = table(spark, sf, "orders").withColumn("day", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")))
    return rows.orderBy(*paging.rendering_order(F.col("day"), F.col("o_orderpriority"), F.col("o_orderkey"))).limit(50).select("o_orderkey", "o_orderpriority")


@query("""SELECT DISTINCT 'customer/' || c_custkey AS node FROM customer UNION SELECT 'nation/' || c_nationkey FROM customer UNION SELECT 'region/2'""")
def shape_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that are subjects or objects of a predicate, and a named one."""
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("inNation"))
    graph = quads.quads_of(customer, "c_custkey", "customer", "people", {"inNation": "nation"}).select("s", "p", "o")
    return shapes.focus_nodes(graph, subjects_of=["<inNation>"], objects_of=["<inNation>"], nodes=["<region/2>"]).select(F.translate("node", "<>", "").alias("node"))


@query("""SELECT o_custkey AS node, 'order ' || o_orderkey || ' costs ' || (floor(o_totalprice)::BIGINT) AS message FROM orders WHERE o_totalprice > 400000""")
def shape_query(spark: SparkSession, sf: str) -> DataFrame:
    """A constraint that is a query, with a message for each row it finds."""
    orders = table(spark, sf, "orders")
    nodes = orders.select(F.col("o_custkey").alias("node"))
    rows = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("order"), F.floor("o_totalprice").cast("long").alias("price"))
    return shapes.query_violations(nodes, rows, "order {order} costs {price}").select("node", "message")


@query("""WITH RECURSIVE c AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE event_type = 'purchase'), r(a, b) AS (SELECT event_id, previous FROM c WHERE previous IS NOT NULL UNION SELECT r.a, c.previous FROM r JOIN c ON c.event_id = r.b WHERE c.previous IS NOT NULL)
SELECT event_id AS snapshot, count(b) AS place FROM c LEFT JOIN r ON r.a = c.event_id GROUP BY 1""")
def parents_first(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with the number of their ancestors: an order in which parents come first."""
    from pyspark.sql import Window

    events = table(spark, sf, "events").where("event_type = 'purchase'")
    chain = events.select(F.col("event_id").alias("a"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    ancestors = patterns.closure(chain.where("b is not null"), zero_length=False).groupBy("a").agg(F.count("*").alias("n"))
    return chain.join(ancestors, "a", "left").select(F.col("a").alias("snapshot"), F.coalesce("n", F.lit(0)).alias("place"))


@query("SELECT 'customer/' || c_custkey AS s, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer")
def select_json(spark: SparkSession, sf: str) -> DataFrame:
    """Query results in JSON as rows, unbound variables null."""
    uri = F.struct(F.lit("uri").alias("type"), F.concat(F.lit("customer/"), F.col("c_custkey")).alias("value"))
    text = lambda c: F.struct(F.lit("literal").alias("type"), F.col(c).alias("value"))
    bound = F.struct(uri.alias("s"), text("c_name").alias("name"), F.when(F.col("c_custkey") % 4 > 0, text("c_mktsegment")).alias("segment"))
    answers = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.struct(F.collect_list(bound).alias("bindings")).alias("results"))).alias("answer"))
    found = quads.select_json(answers, "answer", ["s", "name", "segment"])
    return found.select(F.translate("s", "<>", "").alias("s"), *(quads.value(F.col(c)).alias(c) for c in ("name", "segment")))
