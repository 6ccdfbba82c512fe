"""Compiled shapes against checking node by node in plain Python."""

import random
import re

import pytest

from tessera.operators import shape_plan
from tessera.operators.shape_plan import TYPE, Check, Shape

SHAPES = {
    "one": Shape("class", "<C>", (Check("<p>", least=1, most=2), Check("<q>", datatype="http://x/int", pattern="^[0-9]+$"), Check("<p>", inverse=True, least=1, kind="iri"))),
    "two": Shape("subjects", "<q>", (Check("<p>", kind="literal", among=('"a"', '"b"@en')), Check("<r>", of_class="<D>"))),
    "three": Shape("objects", "<r>", (Check("<p>", most=0), Check("<q>", pattern="^x"))),
    "four": Shape("node", "<gone>", (Check("<p>", least=1), Check("<q>", least=0, datatype=shape_plan.XSD_STRING))),
    "none": Shape("class", "<Nobody>", (Check("<p>", least=1),)),
}


def by_hand(triples):
    found = set()
    kind = lambda t: "iri" if t[0] == "<" else "blank" if t[:2] == "_:" else "literal"
    for name, shape in SHAPES.items():
        focus = {"class": {s for s, p, o in triples if p == TYPE and o == shape.term}, "subjects": {s for s, p, _ in triples if p == shape.term}, "objects": {o for _, p, o in triples if p == shape.term}, "node": {shape.term}}[shape.target]
        for f in focus:
            for c in shape.checks:
                values = {s for s, p, o in triples if p == c.path and o == f} if c.inverse else {o for s, p, o in triples if p == c.path and s == f}
                if c.least is not None and len(values) < c.least:
                    found.add((name, f, c.path, "least", None))
                if c.most is not None and len(values) > c.most:
                    found.add((name, f, c.path, "most", None))
                for v in values:
                    literal = re.fullmatch(r'"(.*)"(?:@([a-z]+)|\^\^<(.*)>)?', v, re.S)
                    datatype = None if not literal else literal[3] or (shape_plan.LANG_STRING if literal[2] else shape_plan.XSD_STRING)
                    said = literal[1] if literal else v[1:-1] if kind(v) == "iri" else None
                    broken = {"datatype": c.datatype is not None and datatype != c.datatype, "kind": c.kind is not None and kind(v) != c.kind, "pattern": c.pattern is not None and not (said is not None and re.search(c.pattern, said)), "among": c.among is not None and v not in c.among, "of_class": c.of_class is not None and (v, TYPE, c.of_class) not in triples}
                    found |= {(name, f, c.path, k, v) for k, b in broken.items() if b}
    return sorted(found, key=str)


def test_one_plan_equals_node_by_node(spark):
    pick = random.Random(3)
    nodes = ["<a>", "<b>", "<xc>", "_:d", "<gone>", '"a"', '"b"@en', '"7"^^<http://x/int>', '"x7"^^<http://x/int>', '"line\nend"']
    triples = {(pick.choice(nodes[:5]), pick.choice(["<p>", "<q>", "<r>"]), pick.choice(nodes)) for _ in range(60)} | {(n, TYPE, pick.choice(["<C>", "<D>"])) for n in nodes[:4]}
    df = spark.createDataFrame([*triples, *triples], "s string, p string, o string")
    got = sorted((tuple(r) for r in shape_plan.violations(df, SHAPES).collect()), key=str)
    assert got == by_hand(triples) and {"most", "datatype", "kind", "pattern", "among", "of_class"} <= {r[3] for r in got}
    counts = {r["shape"]: (r.n_focus, r.n_broken) for r in shape_plan.broken_nodes(df, SHAPES).collect()}
    assert all(counts[n][1] == len({f for s, f, *_ in got if s == n}) for n in counts) and "none" not in counts
    assert [tuple(r) for r in shape_plan.violations(df.where("false"), SHAPES).collect()] == [("four", "<gone>", "<p>", "least", None)]
    with pytest.raises(ValueError, match="are more than"):
        shape_plan.violations(df, {"x": Shape("class", "<C>", [Check("<p>")] * 10_001)})
