"""Copies, terms, canonical literals, indexes and sources on small rows."""

import json
import zipfile

import pyspark.sql.functions as F
import pytest

from tessera.functions import literals, terms
from tessera.operators import indexes, shapes
from tessera.sources import bundles, stores

X = literals.XSD
HELD = [
    ("01", "int", "1", "integer"), ("-0", "byte", "0", "integer"), ("9223372036854775808", "integer", "9223372036854775808", "integer"), ("1.5", "integer", "1.5", "integer"),
    ("+01.50", "decimal", "1.5", "decimal"), ("-.0", "decimal", "0", "decimal"), ("-0.10", "decimal", "-0.1", "decimal"), ("2.", "decimal", "2", "decimal"),
    ("1", "boolean", "true", "boolean"), ("yes", "boolean", "yes", "boolean"),
    ("2024-01-01T00:00:01.710+00:00", "dateTime", "2024-01-01T00:00:01.71Z", "dateTime"), ("2025-02-29T00:00:00Z", "dateTime", "2025-02-29T00:00:00Z", "dateTime"),
    ("2024-12-31T24:00:00Z", "dateTime", "2025-01-01T00:00:00Z", "dateTime"), ("2024-01-01T00:00:00+15:00", "dateTime", "2024-01-01T00:00:00+15:00", "dateTime"), ("x", "string", "x", "string"), (None, "int", None, "int"),
]


def test_canonical_literals(spark):
    rows = spark.createDataFrame([(i, a, X + t, b, X + u) for i, (a, t, b, u) in enumerate(HELD)], "i int, a string, t string, b string, u string")
    for r in rows.withColumn("c", literals.canonical(F.col("a"), F.col("t"))).collect():
        assert (r.c.lex, r.c.datatype) == (r.b, r.u), r.a


LEXICAL = [
    ("dateTime", "-0001-12-31T24:00:00+00:00", "0000-01-01T00:00:00Z"), ("dateTime", "2024-02-28T24:00:00.0", "2024-02-29T00:00:00"), ("dateTime", "9999-12-31T24:00:00Z", "10000-01-01T00:00:00Z"), ("dateTime", "12026-01-01T00:00:00.10Z", "12026-01-01T00:00:00.1Z"),
    ("dateTime", "02026-01-01T00:00:00.10Z", None), ("dateTime", "-0000-01-01T00:00:00.0Z", None), ("dateTime", "0000-02-29T00:00:00.10Z", "0000-02-29T00:00:00.1Z"), ("dateTime", "1900-02-29T00:00:00.10Z", None), ("dateTime", "-0004-02-29T00:00:00.10Z", "-0004-02-29T00:00:00.1Z"),
    ("dateTime", "2026-01-01T24:00:00.1Z", None), ("dateTime", "2026-01-01T00:00:60Z", None), ("dateTime", "2026-01-01T00:00:00.1234567890123456780Z", "2026-01-01T00:00:00.123456789012345678Z"), ("dateTime", "2026-01-01T00:00:00.1234567890123456789Z", None),
    ("dateTime", "2026-01-01T10:00:00.50+14:00", "2026-01-01T10:00:00.5+14:00"), ("dateTime", "2026-01-01T10:00:00.50+14:01", None), ("dateTime", "2026-01-01T25:00:00Z", None), ("dateTime", "2026-01-01T00:00:00.", None),
    ("time", "08:25:01.100Z", "08:25:01.1Z"), ("time", "08:25:01.00-00:00", "08:25:01Z"), ("time", "24:00:00", "00:00:00"), ("time", "24:00:00.5", None), ("time", "10:00:00.10+15:00", None),
    ("date", "2026-11-19-00:00", "2026-11-19Z"), ("date", "2026-02-29-00:00", None), ("date", "2026-04-31", None), ("gYear", "2026+00:00", "2026Z"), ("gYear", "-0001-00:00", "-0001Z"), ("gYear", "2026+15:00", None), ("gYearMonth", "2026-01+00:00", "2026-01Z"), ("gYearMonth", "2026-13+00:00", None),
    ("gMonth", "--12-00:00", "--12Z"), ("gMonth", "--13+00:00", None), ("gDay", "---01+00:00", "---01Z"), ("gDay", "---31", "---31"), ("gDay", "---00+00:00", None), ("gMonthDay", "--02-29+00:00", None), ("gMonthDay", "--02-28+00:00", "--02-28Z"), ("gMonthDay", "--04-31+00:00", None),
    ("double", "1.0E0", "1"), ("double", "1.0E2", "100"), ("double", "1e21", "1" + "0" * 21), ("double", "-0", "-0"), ("double", "1E400", "INF"), ("double", "-1E400", "-INF"), ("double", "abc", None), ("double", "+INF", "INF"), ("double", "NaN", "NaN"), ("double", ".5e-3", "0.0005"), ("double", "5e-324", "0." + "0" * 323 + "5"),
    ("double", "2e23", "2" + "0" * 23), ("double", "1.7976931348623157E308", "17976931348623157" + "0" * 292), ("float", "1.50", "1.5"), ("float", "16777217", "16777216"), ("float", "0.1", "0.1"), ("float", "1e-45", "0." + "0" * 44 + "1"), ("float", "3.4e39", "INF"),
    ("duration", "P1Y0M", "P1Y"), ("duration", "P1DT24H", "P2D"), ("duration", "-P13MT90S", "-P1Y1MT1M30S"), ("duration", "P0D", "PT0S"), ("duration", "P", None), ("duration", "P1YT", None), ("duration", "PT0.50S", "PT0.5S"), ("dayTimeDuration", "PT60S", "PT1M"), ("dayTimeDuration", "P1Y", None), ("dayTimeDuration", "PT1M", "PT1M"),
    ("yearMonthDuration", "P12M", "P1Y"), ("yearMonthDuration", "P0Y", "P0M"), ("yearMonthDuration", "P1D", None), ("duration", "P99999999999999999999Y", None), ("duration", "PT9007199254740993S", "P104249991374DT7H36M33S"), ("string", "2026-01-01T00:00:00.10Z", None), ("anyURI", "urn:x:a", None),
]


def test_calendar_values_floats_and_durations(spark):
    rows = spark.createDataFrame([(t, a, b or a) for t, a, b in LEXICAL] + [("double", repr(float(x)), None) for x in (1 / 3, 0.1 + 0.2, 1e22, 123456.789e-30, 2.0**60, 9007199254740993.0, 9.999999999999999e16, 99999999999999984.0)], "t string, a string, b string")
    found = rows.withColumn("c", literals.canonical(F.col("a"), F.concat(F.lit(X), "t"))).collect()
    for r in found:
        if r.b is None:
            import numpy as np

            assert r.c.lex == np.format_float_positional(float(r.a), trim="-"), r.a
        else:
            assert r.c.lex == r.b, (r.t, r.a)


def test_instant_and_day_keys(spark):
    rows = [
        ("dateTime", "2024-03-04T10:00:00.123456789012345678+05:30", "2024-03-04T04:30:00.123456789012345678", "2024-03-04"), ("dateTime", "2024-03-04T10:00:00", "2024-03-04T10:00:00." + "0" * 18, "2024-03-04"), ("dateTime", "2024-12-31T24:00:00Z", "2025-01-01T00:00:00." + "0" * 18, "2024-12-31"),
        ("date", "2024-03-04+01:00", "2024-03-03T23:00:00." + "0" * 18, "2024-03-04"), ("date", "0001-01-01+01:00", None, "0001-01-01"), ("dateTime", "9999-12-31T23:00:00-02:00", None, "9999-12-31"), ("dateTime", "10000-01-01T00:00:00+01:00", "9999-12-31T23:00:00." + "0" * 18, "10000-01-01"),
        ("date", "2025-02-29", None, None), ("gYear", "2024", None, None), ("string", "2024-03-04", None, None), ("dateTime", "x", None, None), ("date", "1500-02-28", "1500-02-28T00:00:00." + "0" * 18, "1500-02-28"),
    ]
    df = spark.createDataFrame(rows, "t string, a string, i string, d string").withColumn("kind", F.concat(F.lit(X), "t"))
    for r in df.select("*", literals.instant_key(F.col("a"), F.col("kind")).alias("ik"), literals.day_key(F.col("a"), F.col("kind")).alias("dk")).collect():
        assert (r.ik, r.dk) == (r.i, r.d), (r.t, r.a)


def test_terms_copies_and_removals(spark, tmp_path):
    rows = [("<a>", "<p>", '"x"@EN', "g1"), ("_:b", "<p>", '"1"^^<int>', "g1"), ("<a>", "<q>", '"say \\"hi\\""', "g2")]
    quads = spark.createDataFrame(rows, "s string, p string, o string, g string")
    found = {r.nt: (r.kind, r.lex, r.datatype, r.lang) for r in stores.term_table(quads).collect()}
    assert found['"x"@EN'] == (3, "x", "langString", "en") and found["_:b"] == (1, "b", None, None) and found['"1"^^<int>'] == (3, "1", "int", None)
    assert found[rows[2][2]][1] == 'say \\"hi\\"' and found["<a>"] == (2, "a", None, None)
    stores.dump(quads, str(tmp_path / "copy"))
    assert stores.restore(spark, str(tmp_path / "copy")).exceptAll(quads).count() == 0
    quads.limit(1).write.mode("append").parquet(str(tmp_path / "copy/quads"))
    with pytest.raises(ValueError, match="isn't whole"):
        stores.restore(spark, str(tmp_path / "copy"))
    assert stores.without_graphs(quads, spark.createDataFrame([("g1",)], "g string")).count() == 1
    assert stores.without_subjects(quads, spark.createDataFrame([("<a>", "g1")], "s string, g string")).count() == 2
    keys = [r.k for r in spark.createDataFrame([('"l"',), ("<i>",), (None,), ("_:z",)], "t string").select(stores.order_key(F.col("t")).alias("k")).orderBy("k").collect()]
    assert [k[0] for k in keys] == ["0", "1", "2", "3"]


def test_indexes(spark):
    held = spark.createDataFrame([(1, "abcdef0011"), (2, "abcdef0022"), (3, "ffffffff00")], "k int, digits string")
    asked = spark.createDataFrame([("abcdef00",), ("abcdef001",), ("ffff",), ("ffffffff",), (None,)], "handle string")
    assert {(r.handle, r.k) for r in indexes.resolved(asked, "handle", held, "digits").collect()} == {("abcdef001", 1), ("ffffffff", 3)}
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    again = spark.createDataFrame([("b",), ("a",)], "t string")
    assert indexes.fingerprint(texts, "t").collect() == indexes.fingerprint(again, "t").collect()
    assert indexes.fingerprint(texts.where("false"), "t").first().fingerprint == 0
    index = indexes.by_range(indexes.inverted(spark.createDataFrame([("c", "s"), ("c", "s"), (None, "s")], "x string, y string"), "x", "y"))
    assert [tuple(r) for r in index.collect()] == [("c", "s")]
    found = spark.createDataFrame([("Patient/1", '{"a":{"reference": "Patient/1"},"b":[{"reference":"Org/2"}]}')], "name string, json string")
    assert [r.name for r in indexes.missing_references(found, "name", "json").collect()] == ["Org/2"]
    order = [r.t for r in spark.createDataFrame([("a10",), ("a9",), ("a010",), ("b1",)], "t string").orderBy(terms.natural_key(F.col("t")), "t").collect()]
    assert order == ["a9", "a010", "a10", "b1"]


def test_bundles_exports_and_archives(spark, tmp_path):
    lab = {"coding": [{"code": "laboratory"}]}
    document = {"format": {"system": bundles.FORMAT_SYSTEMS[0], "code": bundles.STRUCTURED + "2.1"}}
    held = [
        {"resourceType": "Observation", "id": "1", "category": [lab]}, {"resourceType": "Observation", "id": "2", "category": [lab], "hasMember": [{"reference": "Observation/1"}]},
        {"resourceType": "DocumentReference", "id": "3", "content": [document]}, {"resourceType": "DocumentReference", "id": "4"}, {"resourceType": "AllergyIntolerance", "id": "5", "category": ["food"]}, {"resourceType": "Basic", "id": "6"},
    ]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/bundle.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"fullUrl": "u", "resource": r} for r in held]}, indent=1))
    kinds = spark.createDataFrame([("Observation", "laboratory", "lab"), ("DocumentReference", None, "note"), ("AllergyIntolerance", None, "allergy")], "type string, category string, kind string")
    found = bundles.resources(spark, str(tmp_path / "b"))
    assert found.count() == 6
    assert {(r.id, r.kind) for r in bundles.records(found, kinds).collect()} == {("1", "lab"), ("4", "note"), ("5", "allergy")}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="not a bundle"):
        bundles.resources(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "clinical").mkdir()
    (tmp_path / "clinical/a.json").write_text("{}")
    one = '<ClinicalRecord type="T" sourceName="S" receivedDate="2024-01-01 02:00:00 +0200" resourceFilePath="/clinical/{}.json"/>'
    (tmp_path / "export.xml").write_text(f"<HealthData>{one.format('a')}{one.format('b')}</HealthData>")
    rows = {r.path: r for r in bundles.exported(spark, str(tmp_path / "export.xml"), str(tmp_path / "clinical")).collect()}
    assert rows["clinical/a.json"].json == "{}" and rows["clinical/b.json"].json is None and str(rows["clinical/a.json"].received).startswith("2024-01-01")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.txt", "")
    assert {(r.name, bytes(r.content)) for r in bundles.archived(spark, str(tmp_path / "x.zip")).collect()} == {("d/one.txt", b"1"), ("two.txt", b"")}


def test_shapes_and_written_texts(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "nan")], "k int, v string")
    found = shapes.value_violations(rows, "k", {"number": ("v", F.when(F.col("v") == "nan", None).otherwise(F.col("v") == "y"))})
    assert {tuple(r) for r in found.collect()} == {(1, "number", "x"), (3, "number", "nan")}
    counts = shapes.count_violations(rows, spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "k int, v string"), "k", least=1, most=1)
    assert {tuple(r) for r in counts.collect()} == {(2, 2), (3, 0)}
    types = spark.createDataFrame([("n", "dog"), ("m", "cat"), ("o", "animal")], "node string, class string")
    below = spark.createDataFrame([("dog", "animal"), ("animal", "animal")], "a string, b string")
    assert sorted(r.node for r in shapes.targets(types, below, "animal").collect()) == ["n", "o"]
    days = {"20240304": "2024-03-04", "202403041530+0100": "2024-03-04", "2024-03-04T00:00Z": "2024-03-04", "march 4, 2024": "2024-03-04", "2023-02-29": None, "18991231": None, "Smarch 4, 2024": None, "": None}
    for r in spark.createDataFrame(list(days.items()), "t string, d string").withColumn("f", terms.iso_date(F.col("t"))).collect():
        assert r.f == r.d, r.t
    one = spark.range(1).select(terms.mentions(F.lit("Take ASPIRIN-81 daily"), "aspirin-81").alias("a"), terms.mentions(F.lit("aspirins"), "aspirin").alias("b"), terms.restated(F.lit("Low dose 007"), F.lit("a low dose: 7")).alias("c"), terms.restated(F.lit("low"), F.lit("low")).alias("d")).first()
    assert tuple(one) == (True, False, True, False)
