"""The reference's operators: edge cases, and every registered query against DuckDB."""

import random
import re

import duckdb
import pyspark.sql.functions as F
import pytest

from tessera import queries
from tessera.functions import terms, texts
from tessera.operators import changes, citations, entries, filing, paging, tables
from tessera.plans import patterns
from tessera.sources import clinical, quads, turtle
from tessera.streaming import arrivals

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    show = lambda v: repr(round(float(v), 6) + 0.0) if type(v).__name__ in ("float", "Decimal") else str(v)
    return sorted(tuple(show(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf)
    told = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(found.collect(), sorted(names)) == plain([dict(zip(names, r, strict=True)) for r in told.fetchall()], sorted(names))


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", f"y{i}") for i in range(9)] + [("p", "q"), ("q", "r"), ("r", "p"), ("s", "s")]
    found = dict(entries.components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert {found[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert {found[k] for k in found if k[0] in "xy"} == {"x"}
    assert {found[k] for k in "pqr"} == {"p"} and "s" not in found
    assert entries.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "a string, b string")
    assert {tuple(r) for r in patterns.closure(edges).collect()} == {("a", "b"), ("a", "a"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "c")}


def test_ntriples_round_trip(spark, tmp_path):
    (tmp_path / "in.nt").write_text('<a> <p> "x \\" y"@en .\n# note\n\n_:b <p> <a> .\n<a> <p> "x \\" y"@en .\n')
    found = quads.read_ntriples(spark, str(tmp_path / "in.nt"), "g1")
    assert found.count() == 2
    other = quads.read_ntriples(spark, str(tmp_path / "in.nt"), "g2")
    assert patterns.union_graph(found.unionByName(other)).count() == 3  # blank nodes stay apart
    quads.ntriples(found).write.text(str(tmp_path / "out"))
    assert quads.read_ntriples(spark, str(tmp_path / "out"), "g1").where("not startswith(s, '_:')").first().o == '"x \\" y"@en'
    (tmp_path / "bad.nt").write_text("<a> <p> .\n")
    with pytest.raises(Exception, match="not a triple"):
        quads.read_ntriples(spark, str(tmp_path / "bad.nt"), "g").collect()


def test_golden_change(spark):
    before, after = [160.0, 158.0, 165.0], [100.0, 98.0, 96.0]
    days = ["2024-01-01", "2024-02-01", "2024-03-04", "2024-04-01", "2024-05-01", "2024-06-01"]
    results = spark.createDataFrame([("ada", "ldl", d, v) for d, v in zip(days, before + after, strict=True)], "person string, test string, day string, value double")
    events = spark.createDataFrame([("ada", "start", "2024-03-04"), ("bob", "stop", "2024-03-04")], "person string, event string, day string")
    row = changes.scored(changes.sides(events, results, "person")).first()
    assert row.direction == "down" and row.score > 1 and row.before_n == row.after_n == 3
    assert changes.top_changes(changes.scored(changes.sides(events, results, "person"))).count() == 1


def test_minus_and_optional_with_unbound(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    right = spark.createDataFrame([(None,), ("a",)], "v string")
    assert [r.k for r in patterns.minus(left, right).collect()] == [2]
    assert patterns.minus(left, spark.createDataFrame([(1,)], "z int")).count() == 2


def test_terms(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(terms.encode_for_uri(F.lit("a b*~é/"))) == "a%20b%2A~%C3%A9%2F"
    assert value(terms.notation_of(F.lit("http://x/y#a%20b"))) == "a b" and value(terms.notation_of(F.lit("http://x/%zz"))) == "%zz"
    assert value(terms.decimal_quotient(F.lit("2"), F.lit("-3"))) == "-0.666666666666666666" and value(terms.decimal_quotient(F.lit("1"), F.lit("0"))) is None
    assert value(terms.compare(F.lit("10"), F.lit("9.5"))) == 1 and value(terms.compare(F.lit("b"), F.lit("a"))) == 1 and value(terms.compare(F.lit(None).cast("string"), F.lit("a"))) is None
    assert value(terms.day_of(F.lit("2024"))) is None and value(terms.word_tokens(F.lit("Dose 007 mg March 27, 2025 12:00 UTC"))) == ["dose", "7", "mg", "3", "27", "2025", "12", "0"]
    keys = [value(terms.sort_key(F.lit(x), "2", descending=True)) for x in ("a", "ab", "b")]
    assert keys == sorted(keys, reverse=True)


def test_pages_and_refresh(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    assert {r.v for r in paging.keyset_page(rows, "k", None, 2).collect()} == {"a", "b", "c"}
    assert paging.next_key(rows, "k", None, 2) == 2 and paging.next_key(rows, "k", 2, 2) is None
    fresh = spark.createDataFrame([(1, "z")], rows.schema)
    assert {tuple(r) for r in tables.replaced(rows, fresh, ["k"]).collect()} == {(1, "z"), (2, "c"), (3, "d")}


def test_streamed_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "2024-01-01 00:00:00"), ("r1", "2024-01-01 00:05:00"), ("r2", "2024-01-01 00:01:00")], "record string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    once = arrivals.first_arrivals(stream, ["record"], "at")
    once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    writer = arrivals.refreshing(stream, ["record"], str(tmp_path / "view"), lambda b: b.groupBy("record").agg(F.count("*").alias("n")))
    writer.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert dict(arrivals.current(spark.read.parquet(str(tmp_path / "view")), ["record"]).collect()) == {"r1": 2, "r2": 1}
    arrivals.compacted(spark.read.parquet(str(tmp_path / "view")), ["record"], str(tmp_path / "short"))
    assert dict(arrivals.current(spark.read.parquet(str(tmp_path / "short")), ["record"]).collect()) == {"r1": 2, "r2": 1}


def test_patterns_without_a_shared_variable(spark):
    one, two = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(3,)], "b int")
    for wrong in (lambda: patterns.join(one, two), lambda: patterns.optional(one, two), lambda: patterns.compatible_join(one, two, [], ["a"])):
        with pytest.raises(ValueError):
            wrong()
    assert patterns.join(one, two, cross=True).count() == 2
    assert patterns.exists(one, two).count() == 2 and patterns.exists(one, two.where("false")).count() == 0
    assert patterns.not_exists(one, two).count() == 0 and patterns.not_exists(one, two.where("false")).count() == 2


def test_values_of_several_variables(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "p string, q string")
    assert {r.p for r in patterns.values(left, ["p", "q"], [("a", "x"), ("b", "x"), (None, "y")]).collect()} == {"a", "b"}
    assert patterns.values(left, "p", []).count() == 0 and patterns.values(left, ["p", "q"], [(None, None)]).count() == 3


def test_no_column_is_lost_to_a_helpers_name(spark):
    rows = spark.createDataFrame([(1, 5, 7), (1, 4, 8), (2, 1, 9)], "k long, _place long, _n long")
    assert entries.least_of_each(rows, ["k"], [F.asc("_place")]).columns == rows.columns
    assert tables.preferred(rows.withColumn("source", F.lit("s")), ["k"], "source", ["s"]).columns == [*rows.columns, "source"]
    assert tables.holds(rows.withColumnRenamed("_n", "_there"), rows.select("k"), ["k"]).columns == ["k", "_place", "_there", "held"]
    assert set(tables.multiset_difference(rows.withColumnRenamed("_n", "_sign"), rows.withColumnRenamed("_n", "_sign").limit(0)).columns) == {"side", "k", "_place", "_sign", "n"}
    named = spark.createDataFrame([(1, 1, "a", 3), (1, 2, "a", 4), (1, 3, "b", 5)], "k long, at long, _was string, _starts long")
    found = paging.runs(named, ["k"], ["at"], "_was", F.floor(F.col("at") / 2))
    assert found.columns == [*named.columns, "run"] and [r.run for r in found.orderBy("at").collect()] == [1, 1, 2]


def test_spreads_of_large_means_don_t_cancel(spark):
    values = [1e9 + x for x in (0.1, 0.2, 0.3, 5.1, 5.2, 5.3)]
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-02-01", "2024-02-02", "2024-02-03"]
    results = spark.createDataFrame([("p", "t", d, v) for d, v in zip(days, values, strict=True)], "person string, test string, day string, value double")
    events = spark.createDataFrame([("p", "e", "2024-01-15")], "person string, event string, day string")
    row = changes.sides(events, results, "person").first()
    assert abs(row.before_squares - 0.02) < 1e-6 and abs(row.after_squares - 0.02) < 1e-6


def test_written_dates(spark):
    told = {"Mar 4, 2024": "2024-03-04", "Mar. 4, 2024": "2024-03-04", "march 14, 2024": "2024-03-14", "20240304 and more": "2024-03-04", "202403041530": "2024-03-04", "2024-03-04T10": "2024-03-04", "Foo 4, 2024": None, "2024-02-30": None, "18991231": None, "2024": None, "123456789": None}
    rows = spark.createDataFrame(list(told.items()), "t string, d string")
    assert all(r.f == r.d for r in rows.select("d", terms.iso_date(F.col("t")).alias("f")).collect())
    latest = {"on 2024-01-02 and Mar 4, 2024": "2024-03-04", "in 2024-02, no day": "2024-02-29", "20231231 then 2023-11": "2023-12-31", "none": None}
    rows = spark.createDataFrame(list(latest.items()), "t string, d string")
    assert all(r.f == r.d for r in rows.select("d", terms.latest_date(F.col("t")).alias("f")).collect())


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(texts.sparql_replace(F.lit("aaa"), "a*", "x")) == "x" and value(texts.sparql_replace(F.lit("a.b\nA"), ".", "-", "qi")) == "a-b\nA"
    assert value(texts.sparql_replace(F.lit("ab"), "(a)(b)", "$2${1}$$")) == "ba$" and value(texts.sparql_replace(F.lit("a"), "a", "b", "z")) is None
    decimal = lambda *a: value(texts.sparql_decimal(a[0], *map(F.lit, a[1:])))
    assert decimal("/", "-2", "3") == "-0.666666666666666666" and decimal("/", "1", "0") is None and decimal("+", "0.1", "0.2") == "0.3"
    assert decimal("*", "0.0000000001", "0.0000000001") is None and decimal("floor", "-1.5") == "-2" and decimal("-", "x", "1") is None
    assert value(texts.unescaped(F.lit("a\\u00e9\\U0001F600\\'\\\\n\\n"))) == "aé😀'\\n\n"
    urls = {"HTTP://Ex.ORG:80/a/../b/./%7ec?q=%c3#F": "http://ex.org/b/~c?q=%C3#F", "https://[::1]:443": "https://[::1]/", "http://a:99999/": None, "mailto:x": "mailto:x"}
    assert all(value(texts.normal_url(F.lit(u))) == w for u, w in urls.items())
    compare = lambda *a: value(terms.typed_compare(*map(F.lit, a)))
    assert compare("2", "integer", "10.0", "decimal") == -1 and compare("1e3", "double", "1000", "int") == 0 and compare("true", "boolean", "0", "boolean") == 1
    assert compare("2024-01-01T00:00:00Z", "dateTime", "2024-01-01T10:00:00", "dateTime") is None and compare("2024-01-01T00:00:00Z", "dateTime", "2024-01-02T00:00:00", "dateTime") == -1
    assert compare("a", "string", "1", "integer") is None and compare("b", "lang:en", "a", "lang:EN") == 1
    with pytest.raises(Exception, match="no order of"):
        compare("P1D", "duration", "P2D", "duration")
    assert value(terms.in_utc(F.lit("2024-01-01T24:00:00+01:00"))) == "2024-01-01T23:00:00Z" and value(terms.in_utc(F.lit("2024-02-30T00:00:00Z"))) is None


def test_turtle(spark, tmp_path):
    text = """@prefix ex: <http://e/> . PREFIX : <http://d/>
    ex:a a ex:T ; ex:p "x \\"y\\""@en, 'z'^^ex:t , 3, 4.5, 1e3, true ; ex:q [ ex:r <rel> ; ex:s _:b ] .  # note
    _:b :list ( 1 "two" ) . <> ex:says \"\"\"long "quoted"
text\"\"\" ."""
    (tmp_path / "a.ttl").write_text(text)
    found = {(r.s, r.p, r.o) for r in turtle.read_turtle(spark, str(tmp_path / "a.ttl"), "g").collect()}
    plain = {(s, p, o) for s, p, o in found if not s.startswith("_:") and not o.startswith("_:")}
    xsd, a = "http://www.w3.org/2001/XMLSchema#", "<http://e/a>"
    assert {(a, "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://e/T>"), (a, "<http://e/p>", '"x \\"y\\""@en'), (a, "<http://e/p>", '"z"^^<http://e/t>'), (a, "<http://e/p>", f'"4.5"^^<{xsd}decimal>'), (a, "<http://e/p>", f'"true"^^<{xsd}boolean>')} <= plain
    assert any(o == '"long \\"quoted\\"\\ntext"' for _, _, o in plain) and len(found) == 16
    (tmp_path / "b.ttl").write_text("<a> <p> .")
    with pytest.raises(Exception, match="b.ttl"):
        turtle.read_turtle(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")]).collect()
    assert turtle.read_turtle(spark, str(tmp_path / "a.ttl")).select("g").distinct().count() == 1
    assert [p.rsplit("/", 1)[1] for p in quads.files(spark, str(tmp_path), left_out="b[.]ttl$")] == ["a.ttl"]


def test_clinical_documents(spark, tmp_path):
    (tmp_path / "d.xml").write_text("""<ClinicalDocument xmlns="urn:hl7-org:v3"><id root="1.2" extension="d1"/><code code="34133-9"/><title>Summary</title><effectiveTime value="20240304101500-0500"/>
    <component><structuredBody><component><section><code code="30954-2" codeSystem="2.16"/><title>Results</title><text>two  words</text><entry><x/></entry><entry><y/></entry></section></component>
    <component><section><code code="48765-2"/><title>Allergies</title></section></component></structuredBody></component></ClinicalDocument>""")
    head = clinical.headers(spark, str(tmp_path / "d.xml")).first()
    assert (head.id, head.system, head.title, head.written, head.custodian) == ("d1", "1.2", "Summary", "2024-03-04T15:15:00Z", None)
    assert [(r.code, r.title, r.n_entries) for r in clinical.sections(spark, str(tmp_path / "d.xml")).orderBy("title").collect()] == [("48765-2", "Allergies", 0), ("30954-2", "Results", 2)]


def test_records_absences_and_checked_rules(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    absences = spark.createDataFrame([(1,), (2,), (3,), (4,)], "absence int")
    sources = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "absence int, file string")
    holding = spark.createDataFrame([(3, "b"), (1, "z")], "absence int, file string")
    found = {r.absence: (r.backed, r.reason, r.files) for r in citations.check_records_absences(absences, sources, files, files, holding).collect()}
    assert found == {1: (True, None, []), 2: (False, "sources leave out", ["b"]), 3: (False, "records hold it", ["b"]), 4: (True, None, [])}
    unread = citations.check_records_absences(absences, sources, files, files.where("file = 'a'"), holding.where("false"))
    assert {r.reason for r in unread.where("absence = 4").collect()} == {"source not read"}
    rules = spark.createDataFrame([("t", "j", "text")], "term string, justification string, text string").withColumn("hash", F.sha2("text", 256))
    assert filing.checked_rules(rules).count() == 1
    for wrong in (rules.unionAll(rules), rules.withColumn("hash", F.lit("0"))):
        with pytest.raises(Exception, match="rule t has"):
            filing.checked_rules(wrong).collect()


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(1)
    spans = spark.createDataFrame([(i, rng.randint(0, 2), (s := rng.randint(0, 400)) if i % 9 else None, None if i % 13 == 0 or not i % 9 else s + rng.randint(0, 9)) for i in range(150)], "r long, b long, s long, e long")
    pairs = entries.overlapping(spans.where("s is not null").fillna(10**6, ["e"]), "r", ["b"], "s", "e")
    links = entries.overlap_links(spans, "r", ["b"], "s", "e", F.floor(F.col("s") / 50))
    assert dict(entries.components(pairs.toDF("a", "b")).collect()) == dict(entries.components(links.toDF("a", "b")).collect())
    rows = spark.createDataFrame([(i, rng.randint(0, 20), rng.randint(0, 2)) for i in range(150)], "r long, b long, v long")
    one = rows.toDF("a", "k", "v").join(rows.toDF("b", "k", "w"), "k").where("a < b and v <> w").select("a", "b")
    assert dict(entries.components(one).collect()) == dict(entries.components(entries.linked_unequal(rows, "r", ["b"], "v").toDF("a", "b")).collect())


def test_queries_read_whole_tables_once(spark, sf):
    plan = queries.QUERIES["bgp_star"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan  # a pattern of one predicate is a scan of one column


def test_sharing_makes_pairs_last(spark):
    lists = {i: ([i % 3, 7] if i % 5 else [i % 3], [i % 4 * 10, i % 7, i % 4 * 10, None][: 1 + i % 4]) for i in range(40)} | {50: (None, [3, 0]), 51: (None, [0, 3]), 52: ([None], None)}
    df = spark.createDataFrame([(i, c, e) for i, (c, e) in lists.items()], "i long, c array<long>, e array<long>")
    found = changes.sharing(df, "i", "c", "e")
    inside = lambda values: {x for x in values or () if x is not None}
    expected = {(a, b, next(x for x in lists[a][1] if x in inside(lists[b][1]))) for a in lists for b in lists if a < b and inside(lists[a][1]) & inside(lists[b][1]) and not inside(lists[a][0]) & inside(lists[b][0])}
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and expected
    assert not re.search(r"Aggregate \[entry#\d+L?, other#", found._jdf.queryExecution().optimizedPlan().toString())  # pairs of entries aren't grouped


def test_filing_by_known_entries(spark, sf):
    rng = random.Random(4)
    rows = [(rng.randrange(9), 20 + (b := rng.randrange(30)), None if b % 4 == 0 else 20 + b % 3, rng.random() < 0.6) for _ in range(300)]
    once = {(a, b): (a, b, entry, apart) for a, b, entry, apart in rows}
    best = {}
    for a, b, entry, apart in once.values():
        best[a, entry or b] = min(best.get((a, entry or b), (True, 99)), (apart, b))
    found = filing.file_known(spark.createDataFrame([*once.values(), *once.values()], "a long, b long, entry long, apart boolean"))
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for (a, _), (_, b) in best.items())
    plan = queries.QUERIES["arrival_filing"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Join", plan)) == 1 and len(re.findall("Aggregate", plan)) == 2  # others that stand alike are one before they meet new records


def test_pairs_of_records_in_several_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30) if rng.random() < 0.9 else None, rng.choice("uvw") if rng.random() < 0.9 else None, rng.randrange(2), rng.choice(["x", "y", None])) for _ in range(90)]
    rows += [(100 + i, "u", 0, "z") for i in range(5)]
    df = spark.createDataFrame(rows, "record long, b string, c int, origin string")
    expected = {}
    for one in rows:
        for two in rows:
            if None not in (one[0], two[0], one[1]) and one[1:3] == two[1:3] and one[0] < two[0]:
                expected.setdefault((one[0], two[0]), set()).update({one[3]} - {None})
    found = entries.blocked_pairs(df, "record", ["b", "c"], "origin")
    assert found.columns == ["record", "other", "origins"]
    assert sorted((r.record, r.other, tuple(r.origins)) for r in found.collect()) == sorted((*k, tuple(sorted(v))) for k, v in expected.items())
    assert sorted(map(tuple, entries.blocked_pairs(df, "record", ["b", "c"]).collect())) == sorted(expected)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # not all pairs are grouped


def test_sames_still_joined_by_their_members(spark):
    rng = random.Random(6)
    sames = [(s, m) for s in range(12) for m in rng.sample(range(40), 1 + s % 5)]
    pairs = [(a, b) for a in range(40) for b in range(40) if a != b and rng.random() < 0.25] * 2
    joined = {frozenset(p) for p in pairs}
    members = {s: {m for x, m in sames if x == s} for s, _ in sames}
    expected = {s for s, ms in members.items() if len(ms) > 1 and any(all(frozenset((a, b)) in joined for b in ms - {a}) for a in ms)}
    found = filing.still_joined(spark.createDataFrame(sames + sames[:9], "same long, member long"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r.same for r in found.collect()} == expected and expected
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()  # only pairs of members that are in enough of them go on
