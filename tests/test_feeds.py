"""Feeds against walking revisions by hand."""

import hashlib
import random

from tessera.operators import feeds


def test_descent_equals_walking_back(spark):
    pick = random.Random(5)
    revisions = [(f"v{a}", f"v{pick.randrange(max(0, a - 4), 60)}") for a in range(60) for _ in range(pick.randrange(3))] + [(f"c{k}", f"c{k - 1}") for k in range(1, 30)] + [("v1", None)]
    pairs = [(f"v{pick.randrange(60)}", f"v{pick.randrange(60)}") for _ in range(50)] + [("c29", "c0"), ("c0", "c29"), ("z", "z"), ("z", None)]

    def goes_back(a, b):
        reached, work = {a}, [a]
        while work:
            x = work.pop()
            for v, r in revisions:
                if v == x and r is not None and r not in reached:
                    reached.add(r)
                    work.append(r)
        return b in reached

    found = feeds.descends(spark.createDataFrame(pairs, "version string, held string"), spark.createDataFrame(revisions, "version string, revises string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted({p for p in pairs if p[1] is not None and goes_back(*p)})


def test_outcomes(spark):
    sha = lambda t: hashlib.sha256(t).hexdigest()
    series = spark.createDataFrame([("a", "k", "a2"), ("b", "k", "b2"), ("c", "k", "c1"), ("d", "k", "d1"), ("e", "other", "e1"), ("f", "k", None), ("g", "k", "g1"), ("h", "k", "h1"), ("i", "k", "i1")], "series string, kind string, current string")
    revisions = spark.createDataFrame([("a2", "a1"), ("a1", "a0"), ("b2", "b1")], "version string, revises string")
    places = spark.createDataFrame([("a2", "ua", sha(b"a").upper()), ("b2", "ub", sha(b"b")), ("c1", "uc", sha(b"x")), ("d1", "ud", None), ("g1", "ug", sha(b"g")), ("i1", "ui", sha(b"i"))], "version string, url string, checksum string")
    held = spark.createDataFrame([("a", "a0"), ("b", "b0"), (None, "h1")], "series string, version string")
    files = spark.createDataFrame([("ua", b"a"), ("ub", b"b"), ("uc", b"c"), ("ug", None)], "url string, content binary")
    got = {r.version: (r.outcome, r.reason) for r in feeds.checked(series, revisions, places, held, files, kinds=["k"]).collect()}
    assert got == {
        "a2": ("kept", None), "b2": ("refused", "it doesn't descend from b0, which is held"), "c1": ("refused", "another checksum than the feed gives"), "d1": ("refused", "no download and checksum"),
        "g1": ("later", "ug wasn't answered"), "i1": ("later", "ui wasn't answered"),
    }
    assert feeds.checked(series.where("false"), revisions, places, held, files, kinds=["k"]).count() == 0
