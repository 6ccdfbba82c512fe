"""Graph isomorphism against all relabellings, and filing in order against filing record by record."""

import itertools
import random

import pytest

from tessera.operators import ordered_filing
from tessera.plans import isomorphism


def alike(one, two):
    """Whether any relabelling of blank nodes makes one graph the other."""
    nodes = [sorted({t for s, _, o in g for t in (s, o) if t.startswith("_:")}) for g in (one, two)]
    if len(nodes[0]) != len(nodes[1]) or len(one) != len(two):
        return False
    for way in itertools.permutations(nodes[1]):
        to = dict(zip(nodes[0], way, strict=True))
        if {(to.get(s, s), p, to.get(o, o)) for s, p, o in one} == two:
            return True
    return False


def made(pick):
    n = pick.randrange(1, 6)
    shape = pick.randrange(4)
    blank = [f"_:{k}" for k in range(n)]
    if shape == 0:
        return {(a, "<p>", b) for a in blank for b in blank if a != b}
    if shape == 1:
        return {(blank[k], "<p>", blank[(k + 1) % n]) for k in range(n)}
    if shape == 2:
        half = blank + [f"_:x{k}" for k in range(n)] if n < 4 else blank
        return {(half[k], "<p>", half[k ^ 1]) for k in range(len(half) - len(half) % 2)} | {(half[0], "<p>", '"v"')}
    return {(pick.choice([*blank, "<a>"]), pick.choice(["<p>", "<q>"]), pick.choice([*blank, '"v"'])) for _ in range(pick.randrange(1, 9))}


def test_forms_equal_all_relabellings(spark):
    pick = random.Random(11)
    graphs = [made(pick) for _ in range(40)]
    for g in list(graphs[:20]):  # the same under other labels, and nearly the same
        names = sorted({t for s, _, o in g for t in (s, o) if t.startswith("_:")})
        other = [f"_:n{k}" for k in range(len(names))]
        pick.shuffle(other)
        to = dict(zip(names, other, strict=True))
        graphs.append({(to.get(s, s), p, to.get(o, o)) for s, p, o in g})
        graphs.append({*list(graphs[-1])[1:], (pick.choice([*other, "<a>"]), "<p>", pick.choice([*other, "<a>"]))})
    two_threes = {(f"_:{k}", "<p>", f"_:{3 * (k // 3) + (k + 1) % 3}") for k in range(6)}
    six = {(f"_:{k}", "<p>", f"_:{(k + 1) % 6}") for k in range(6)}
    graphs += [two_threes, six]
    df = spark.createDataFrame([(g, s, p, o) for g, rows in enumerate(graphs) for s, p, o in rows], "g int, s string, p string, o string")
    forms = {r.g: r.form for r in isomorphism.canonical_forms(df.unionByName(df)).collect()}
    for a, b in itertools.combinations(range(len(graphs)), 2):
        assert (forms.get(a) == forms.get(b)) == alike(graphs[a], graphs[b]), (graphs[a], graphs[b])


def test_large_symmetric_parts_are_searched_once():
    n = 24
    whole = [(f"_:{a}", "c", "<p>", f"_:{b}", "c") for a in range(n) for b in range(n) if a != b]
    shuffled = [(f"_:x{n - int(s[2:])}", c, p, f"_:x{n - int(o[2:])}", d) for s, c, p, o, d in reversed(whole)]
    assert isomorphism.form(whole) == isomorphism.form(shuffled) != isomorphism.form(whole[1:])
    cube = [(f"_:{a}", "c", "<p>", f"_:{a ^ (1 << k)}", "c") for a in range(32) for k in range(5)]
    turn = random.Random(2).sample(range(32), 32)
    assert isomorphism.form(cube) == isomorphism.form([(f"_:{turn[int(s[2:])]}", c, p, f"_:{turn[int(o[2:])]}", d) for s, c, p, o, d in cube])


def test_two_graphs_and_empty_ones(spark):
    graph = lambda a, b, end: spark.createDataFrame([(a, "<p>", b), (b, "<p>", a), (a, "<name>", '"x"'), (b, "<name>", end)], "s string, p string, o string")
    assert isomorphism.isomorphic(graph("_:1", "_:2", '"y"'), graph("_:z", "_:k", '"y"'))
    assert not isomorphism.isomorphic(graph("_:1", "_:2", '"y"'), graph("_:1", "_:2", '"z"'))
    assert isomorphism.isomorphic(graph("_:1", "_:2", '"x"'), graph("_:2", "_:9", '"x"'))
    none = graph("_:1", "_:2", '"x"').where("false")
    assert isomorphism.isomorphic(none, none) and not isomorphism.isomorphic(none, graph("_:1", "_:2", '"x"'))


def one_by_one(records, matches, sames, different):
    """Each record by itself: entries are worked out anew from the Sames whose members all arrived before it."""
    order = {name: (arrived, name) for name, arrived, _ in records}
    apart = {frozenset(d) for d in different}
    counting = [(max((order[m] for m in members if m in order), default=None), members) for members in sames.values()]
    filed = []
    for name, _, taken in sorted(records, key=lambda r: (r[1], r[0])):
        if not taken:
            continue
        group = {}
        root = lambda x: x if group.get(x, x) == x else root(group[x])  # noqa: B023, E731
        for latest, members in counting:
            if latest is None or latest < order[name]:
                split = any(frozenset((a, b)) in apart for a in members for b in members)
                for a in members:
                    for b in members if split else [min(members)]:
                        if a != b and frozenset((a, b)) not in apart:
                            group[root(a)] = root(b)
        new = []
        for rule, origin in sorted({(r, o) for r, o, a, b in matches if name in (a, b)}, key=str):
            found = {b if a == name else a for r, o, a, b in matches if (r, o) == (rule, origin) and name in (a, b)} - {name}
            found = [m for m in found if m in order and order[m] < order[name]]
            for entry in {root(m) for m in found}:
                new.append((rule, origin, min((frozenset((name, m)) in apart, m) for m in found if root(m) == entry)[1]))
        filed += [(name, *x) for x in new]
        for rule, origin in {x[:2] for x in new}:
            counting.append((order[name], [name, *(m for r, o, m in new if (r, o) == (rule, origin))]))
    return sorted(filed, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_filing_in_order_is_filing_one_by_one(spark, seed):
    pick = random.Random(seed)
    names = [f"r{k:03d}" for k in range(160)]
    records = [(n, pick.randrange(60), pick.random() < 0.9) for n in names]
    near = lambda: (k := pick.randrange(160), min(159, max(0, k + pick.randrange(-9, 10))))
    matches = [(pick.choice(["one", "two"]), pick.choice([None, "t1", "t2"]), names[a], names[b]) for a, b in (near() for _ in range(260))] + [("one", None, "gone", names[3])]
    sames = {f"s{k}": list(dict.fromkeys([names[a], names[b], names[pick.randrange(160)]])) for k, (a, b) in enumerate(near() for _ in range(12))} | {"s99": ["gone", "away"], "s98": ["gone", names[5], names[9]]}
    different = [(names[a], names[b]) for a, b in (near() for _ in range(90)) if a != b]
    if seed == 2:
        different = []
    found = ordered_filing.file_in_order(
        spark.createDataFrame(records, "record string, arrived long, taken boolean").repartition(5),
        spark.createDataFrame(matches, "rule string, origin string, a string, b string").repartition(3),
        spark.createDataFrame([(s, m) for s, members in sames.items() for m in members], "same string, member string"),
        spark.createDataFrame(different, "a string, b string"),
    )
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == one_by_one(records, matches, sames, different) and len(got) > 100


def test_filing_of_nothing(spark):
    records = spark.createDataFrame([("a", 1, True), (None, 2, True), ("b", None, True)], "record string, arrived long, taken boolean")
    matches = spark.createDataFrame([("r", None, "a", "b"), ("r", None, "a", "a"), ("r", None, None, "b")], "rule string, origin string, a string, b string")
    none = lambda schema: spark.createDataFrame([], schema)
    assert [tuple(r) for r in ordered_filing.file_in_order(records, matches, none("same string, member string"), none("a string, b string")).collect()] == [("a", "r", None, "b")]
    assert ordered_filing.file_in_order(records.where("false"), matches, none("same string, member string"), none("a string, b string")).count() == 0
