"""Refreshes against whole builds on random steps, and places of records against Python's own parsers."""

import json
import random

import pyspark.sql.functions as F
import pytest

from tessera.operators import refresh
from tessera.sources import record_spans


def _degree(graph, keys):
    found = graph.where("p = 'to'").select(F.col("s").alias("key")).join(keys, "key", "left_semi").groupBy("key").count()
    return found.select("key", F.col("key").alias("s"), F.lit("degree").alias("p"), F.col("count").cast("string").alias("o"))


def _large(graph, keys):
    found = graph.where("p = 'degree' and cast(o as int) >= 3").select(F.col("s").alias("key")).join(keys, "key", "left_semi")
    return found.select("key", F.col("key").alias("s"), F.lit("is").alias("p"), F.lit("large").alias("o"))


def _near_large(graph, keys):
    to = graph.where("p = 'to'").select(F.col("s").alias("key"), F.col("o").alias("other")).join(keys, "key", "left_semi")
    large = graph.where("p = 'is'").select(F.col("s").alias("other"))
    return to.join(large, "other").select("key", F.lit("somewhere").alias("s"), F.lit("near").alias("p"), F.col("other").alias("o"))


def _before(changed, graph):
    touched = changed.where("p = 'is'").select(F.col("s").alias("o"))
    return changed.where("p = 'to'").select(F.col("s").alias("key")).unionByName(graph.where("p = 'to'").join(touched, "o", "left_semi").select(F.col("s").alias("key")))


STEPS = [
    refresh.Derivation("near", _before, _near_large),
    refresh.Derivation("large", lambda c, g: c.where("p = 'degree'").select(F.col("s").alias("key")), _large),
    refresh.Derivation("degree", lambda c, g: c.where("p = 'to'").select(F.col("s").alias("key")), _degree),
]


def by_hand(edges):
    degree = {a: sum(x == a for x, _ in edges) for a, _ in edges}
    large = {a for a, n in degree.items() if n >= 3}
    found = {("degree", a, a, "degree", str(n)) for a, n in degree.items()} | {("large", a, a, "is", "large") for a in large}
    return sorted(found | {("near", a, "somewhere", "near", b) for a, b in edges if b in large})


def test_random_steps_equal_whole_builds(spark):
    pick = random.Random(4)
    edges = {(f"n{pick.randrange(12)}", f"n{pick.randrange(12)}") for _ in range(30)}
    graph = lambda e: spark.createDataFrame([(a, "to", b) for a, b in sorted(e)], "s string, p string, o string")
    kept = refresh.whole(graph(edges), STEPS)
    assert sorted(tuple(r) for r in kept.collect()) == by_hand(edges)
    for _ in range(2):
        newer = {e for e in edges if pick.random() < 0.8} | {(f"n{pick.randrange(12)}", f"n{pick.randrange(12)}") for _ in range(5)}
        kept = refresh.refresh(graph(edges), graph(newer), kept, STEPS)
        assert sorted(tuple(r) for r in kept.collect()) == by_hand(newer)
        edges = newer
    assert refresh.agrees(kept, graph(edges), STEPS) and not refresh.agrees(kept.limit(3), graph(edges), STEPS)
    endless = refresh.Derivation("more", lambda c, g: c.select(F.lit("k").alias("key")), lambda g, k: k.select("key", F.lit("s").alias("s"), F.lit("p").alias("p"), F.lit("p").alias("p2")).crossJoin(g.agg(F.max("o").alias("m"))).select("key", "s", "p", F.concat(F.lit("z"), "m").alias("o")))
    with pytest.raises(ValueError, match="still change"):
        refresh.refresh(graph(set()), graph(edges), kept.limit(0), [endless], most_rounds=3)


def test_what_was_named_before(spark):
    graph = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    old = graph([("a", "p", "b"), ("a", "p", "c"), ("c", "p", "x")])
    assert [r.name for r in refresh.named_before(old, old.unionByName(graph([("b", "q", "y"), ("z", "q", "y")]))).collect()] == ["b"]


def test_json_spans_equal_the_parser(spark):
    pick = random.Random(7)

    def value(depth):
        kind = pick.randrange(6 if depth < 4 else 3)
        if kind < 3:
            return pick.choice([1, None, True, 'x "y" {', "}]\\", "😀,\n", ""])
        return [value(depth + 1) for _ in range(pick.randrange(4))] if kind == 3 else {pick.choice(["a", "b", "c:", "{"]) + str(k): value(depth + 1) for k in range(pick.randrange(4))}

    def paths(v, path):
        inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        for k, x in inner:
            yield from paths(x, [*path, str(k)])
        if isinstance(v, dict | list):
            yield "/".join(path), v

    for k in range(60):
        whole = {"root": value(0), "list": [value(1), {"r": value(1)}]}
        text = json.dumps(whole, indent=pick.choice([None, 2]), ensure_ascii=False)
        found = {p: json.loads(text[a:b]) for p, a, b in record_spans.json_spans(text)}
        assert found == dict(paths(whole, [])), k
    text = '{"entry": [\n{"resource": {"a": 1}},\n{"resource": {\n"b": "}"}}\n]}'
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, '{"entry": [{"resource": {', "x"), (4, "]}", "x")], "id long, text string, path string")
    assert [tuple(r)[:6] for r in record_spans.json_records(df, "id", "text").orderBy("start").collect()] == [(1, "entry/0/resource", 25, 33, 2, 2), (1, "entry/1/resource", 49, 60, 3, 4)]


def test_xml_spans(spark):
    text = '<?xml version="1.0"?>\n<d><h:entry a="/>">\n<entry/><b>x</entry>\n<!-- <entry> --><![CDATA[</entry>]]><entry>open'
    df = spark.createDataFrame([(1, text)], "k long, xml string")
    found = [(r.first_line, r.last_line, r.record) for r in record_spans.xml_elements(df, "k", "xml", "entry").orderBy("start").collect()]
    assert found == [(2, 3, '<h:entry a="/>">\n<entry/><b>x</entry>'), (3, 3, "<entry/>")]
    assert [n for n, _, _ in record_spans.xml_spans("<a><b></a></b><c/>")] == ["a", "c"]
