"""Registered queries of scalar functions, each with its SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .functions import literals, terms, texts
from .registry import query, table


@query(r"SELECT p_partkey, regexp_replace(p_name, '([a-z]+)[^a-z0-9]*([0-9]*)', '<\2|\1>', 'g') AS replaced, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'xbx' END AS empty_matches FROM part")
def replaced_text(spark: SparkSession, sf: str) -> DataFrame:
    """Replacement with groups, and of matches that may be empty."""
    sample = F.when(F.col("p_size") % 2 == 0, "aaa").otherwise("aba")
    return table(spark, sf, "part").select("p_partkey", texts.sparql_replace(F.col("p_name"), "([a-z]+)[^a-z0-9]*([0-9]*)", "<$2|${1}>").alias("replaced"), texts.sparql_replace(sample, "a*", "x").alias("empty_matches"))


_TRIMMED = "rtrim(rtrim(({})::VARCHAR, '0'), '.')"


@query(f"""SELECT o_orderkey, {_TRIMMED.format("o_totalprice::DECIMAL(18,2) + o_custkey::DECIMAL(18,2)")} AS added, {_TRIMMED.format("o_totalprice::DECIMAL(18,2) - 1000000::DECIMAL(18,2)")} AS less, {_TRIMMED.format("o_totalprice::DECIMAL(18,2) * o_custkey::DECIMAL(18,2)")} AS times,
floor(o_totalprice::DECIMAL(18,2))::BIGINT::VARCHAR AS floored, CASE WHEN o_custkey % 4 > 0 THEN {_TRIMMED.format("o_orderkey // 8 || '.' || lpad((o_orderkey % 8 * 125)::VARCHAR, 3, '0')")} END AS eighth FROM orders""")
def exact_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Sums, differences, products, floors and quotients of decimals; nothing divided by zero."""
    price, n = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_custkey").cast("string")
    eighth = texts.sparql_decimal("/", F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 4 > 0, "8").otherwise("0"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        texts.sparql_decimal("+", price, n).alias("added"),
        texts.sparql_decimal("-", price, F.lit("1000000")).alias("less"),
        texts.sparql_decimal("*", price, n).alias("times"),
        texts.sparql_decimal("floor", price).alias("floored"),
        eighth.alias("eighth"),
    )


@query("""SELECT a.event_id, CASE WHEN a.event_id % 2 = b.user_id % 2 THEN CASE WHEN a.ts < b.o THEN -1 WHEN a.ts > b.o THEN 1 ELSE 0 END WHEN abs(epoch_us(date_trunc('second', a.ts)) - epoch_us(date_trunc('second', b.o))) > 50400000000 THEN CASE WHEN a.ts < b.o THEN -1 ELSE 1 END END AS times,
CASE WHEN a.value < a.user_id THEN -1 WHEN a.value > a.user_id THEN 1 ELSE 0 END AS numbers, CASE WHEN a.event_type < 'login' THEN -1 WHEN a.event_type > 'login' THEN 1 ELSE 0 END AS words
FROM events a JOIN (SELECT user_id, min(ts) AS o FROM events GROUP BY 1) b USING (user_id)""")
def typed_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Order of times with and without a zone, of numbers of different types, and of texts."""
    events = table(spark, sf, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("o"))
    written = lambda c, zoned: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(zoned % 2 == 1, "Z").otherwise(""))
    met = events.join(first, "user_id")
    date_time, string = F.lit("dateTime"), F.lit("string")
    return met.select(
        "event_id",
        terms.typed_compare(written("ts", F.col("event_id")), date_time, written("o", F.col("user_id")), date_time).alias("times"),
        terms.typed_compare(F.col("value").cast("string"), F.lit("double"), F.col("user_id").cast("string"), F.lit("integer")).alias("numbers"),
        terms.typed_compare(F.col("event_type"), string, F.lit("login"), string).alias("words"),
    )


@query("""SELECT event_id, strftime(ts - to_minutes((event_id % 27 - 13) * 60), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z' AS utc,
event_id % 27 - 13 > 0 AS earlier FROM events""")
def moved_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Times of many zones in UTC, and whether each is before the same clock's time in UTC."""
    hours = (F.col("event_id") % 27 - 13).cast("int")
    zone = F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    time = F.concat(clock, zone)
    return table(spark, sf, "events").select("event_id", terms.in_utc(time).alias("utc"), terms.earlier_in_utc(time, F.concat(clock, F.lit("Z"))).alias("earlier"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS time FROM events")
def health_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of digits as a day, or with a zone in UTC."""
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-0500")))
    return table(spark, sf, "events").select("event_id", terms.health_time(text).alias("time"))


@query("SELECT page_id, lower(regexp_extract(url, '^(.*?://[^/?#]*)', 1)) || CASE WHEN page_id % 2 = 0 THEN '/a/%C3%A9~b' ELSE '/' END AS url, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/[^/]*/[^/]*$', '') AS base FROM pages")
def normal_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs in normal form, and the server each names."""
    host = F.regexp_extract("url", "^(.*?://[^/?#]*)", 1)
    port = F.when(F.startswith("url", F.lit("https")), ":443").otherwise(":80")
    written = F.concat(F.upper(host), port, F.when(F.col("page_id") % 2 == 0, "/x/../a/./%c3%a9%7Eb").otherwise(""))
    return table(spark, sf, "pages").select("page_id", texts.normal_url(written).alias("url"), terms.base_url(F.regexp_extract("url", "^([^?#]*)", 1)).alias("base"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'loinc:' || p_partkey || '-1, then ' ELSE 'snomed:' || p_partkey || ', then ' END || p_name AS short, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'urn:x:' || p_name END AS notation FROM part")
def short_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Codes' IRIs as system and code, and codes without their URI space."""
    iri = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("http://loinc.org/rdf/"), "p_partkey", F.lit("-1"))).otherwise(F.concat(F.lit("http://snomed.info/id/"), "p_partkey"))
    code = F.concat(F.when(F.col("p_size") % 2 == 0, "http://b.example/").otherwise("urn:x:"), "p_name")
    return table(spark, sf, "part").select("p_partkey", terms.short_form(F.concat(iri, F.lit(", then "), "p_name")).alias("short"), terms.notation_in(code, ["http://a.example/", "http://b.example/"]).alias("notation"))


@query("SELECT conv_id, turn, text || chr(9) || '\"' || chr(10) || '\\' AS text FROM conversations")
def escapes_undone(spark: SparkSession, sf: str) -> DataFrame:
    """Texts escaped for N-Triples and back."""
    text = F.concat("text", F.lit('\t"\n\\'))
    return table(spark, sf, "conversations").select("conv_id", "turn", texts.unescaped(texts.escaped(text)).alias("text"))


@query("SELECT p_partkey, 'Finds ' || p_name || ' by size' AS prose, p_size % 2 = 0 AS same FROM part")
def query_prose(spark: SparkSession, sf: str) -> DataFrame:
    """The comment that a query begins with, and whether two inputs are the same."""
    text = F.concat(F.lit("# Finds "), "p_name", F.lit("\n#  by size\nSELECT * WHERE { ?s ?p 1 } # no prose\n"))
    one = F.concat(F.lit('{"a": '), "p_partkey", F.lit(', "b": [1, "x"]}'))
    two = F.concat(F.lit('{"b": [1, '), F.when(F.col("p_size") % 2 == 0, '"x"').otherwise('"y"'), F.lit('], "a": '), "p_partkey", F.lit("}"))
    return table(spark, sf, "part").select("p_partkey", terms.prose(text).alias("prose"), texts.same_input(one, two).alias("same"))


@query(r"SELECT p_partkey, regexp_matches(lower('code X' || p_size || ' and z'), '(^|[^\w.-])x1($|[^\w-])') AS named FROM part")
def code_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text has a code as a whole code."""
    return table(spark, sf, "part").select("p_partkey", terms.mentions_code(F.concat(F.lit("code X"), "p_size", F.lit(" and z")), "X1").alias("named"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderkey % 7 AS k FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k = 0 THEN '' ELSE '.' || k END || 'Z' AS time, strftime(o_orderdate, '%Y-%m-%d') || 'Z' AS day, strftime(o_orderdate, '%Y-%m') AS month,
  'P' || CASE WHEN o_orderkey // 12 > 0 THEN (o_orderkey // 12) || 'Y' ELSE '' END || CASE WHEN o_orderkey % 12 > 0 OR o_orderkey = 0 THEN (o_orderkey % 12) || 'M' ELSE '' END AS span,
  regexp_replace(o_totalprice::DECIMAL(18, 2)::VARCHAR, '[.]?0+$', '') AS price,
  strftime(o_orderdate - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.' || k || repeat('0', 17) AS instant, strftime(o_orderdate, '%Y-%m-%d') AS written FROM o""")
def canonical_values(spark: SparkSession, sf: str) -> DataFrame:
    """Times, days, months, spans and floats as they are held, and the keys by which times sort and are looked up."""
    held = lambda text, kind: literals.canonical(text, kind).lex
    written = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.concat(written, F.lit("."), (F.col("o_orderkey") % 7).cast("string"))
    kind = F.lit(literals.XSD + "dateTime")
    zoned = F.concat(time, F.lit("+02:30"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        held(F.concat(time, F.lit("00-00:00")), "dateTime").alias("time"),
        held(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("+00:00")), "date").alias("day"),
        held(F.date_format("o_orderdate", "yyyy-MM"), "gYearMonth").alias("month"),
        held(F.concat(F.lit("P"), F.col("o_orderkey").cast("string"), F.lit("M")), "yearMonthDuration").alias("span"),
        held(F.concat(F.round("o_totalprice", 2).cast("string"), F.lit("e0")), "double").alias("price"),
        literals.instant_key(zoned, kind).alias("instant"),
        literals.day_key(zoned, kind).alias("written"),
    )
