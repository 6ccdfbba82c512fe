"""Interval pairs and grown notes against all pairs in plain Python."""

import datetime as dt
import random

import pyspark.sql.functions as F

from tessera.operators import intervals, notes

DAY = dt.timedelta(days=1)


def spans_of(pick, n):
    rows = []
    for k in range(n):
        start = None if pick.random() < 0.05 else dt.datetime(2020, 1, 1) + pick.randrange(900) * DAY + dt.timedelta(hours=pick.choice([0, 0, 7]))
        long = pick.choice([0, 3, 40, 700, 200_000])
        end = None if pick.random() < 0.1 or start is None else start + dt.timedelta(hours=pick.randrange(-5, 24 * min(long, 3000) + 1))
        rows.append((f"r{pick.randrange(n):03d}", pick.choice([1, 1, 1, 2, None]), pick.choice("xy"), start, end))
    return [*rows, ("old", 1, "x", dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31)), ("late", 1, "y", dt.datetime(9000, 1, 1), None)]


def meet(a, b):
    (_, g, _, s, e), (_, h, _, t, f) = a, b
    if g is None or g != h or s is None or t is None or (e is not None and e < s) or (f is not None and f < t):
        return False
    return (f is None or s <= f) and (e is None or t <= e)


def test_overlaps_equal_all_pairs(spark):
    pick = random.Random(6)
    rows = spans_of(pick, 150)
    df = spark.createDataFrame(rows, "name string, block int, side string, begun timestamp, done timestamp").repartition(5)
    found = sorted(tuple(r) for r in intervals.overlap_pairs(df, "name", ["block"], "begun", "done").collect())
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b)}
    assert found == sorted(pairs) and len(found) > 500
    sides = sorted(tuple(r) for r in intervals.overlap_pairs(df, "name", ["block"], "begun", "done", differing="side").collect())
    assert sides == sorted({(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b) and a[2] != b[2]})
    assert intervals.overlap_pairs(df.where("false"), "name", ["block"], "begun", "done").count() == 0


def test_a_hot_block_is_many_groups(spark):
    """Short intervals of one block meet in groups of their days, not in one."""
    df = spark.range(20_000).select("id", F.lit(1).alias("block"), F.timestamp_seconds(F.col("id") * 86_400).alias("s"), F.timestamp_seconds(F.col("id") * 86_400 + 90_000).alias("e"))
    assert intervals.overlap_pairs(df, "id", ["block"], "s", "e").count() == 19_999


def test_codes_in_common(spark):
    exposures = spark.createDataFrame([(k, c, dt.datetime(2024, 1, 1), None) for k, c in ((1, "a"), (2, "b"), (3, "b"), (3, "z"), (4, "c"), (5, "a"))], "record int, code string, start timestamp, end timestamp")
    near = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a")], "code string, other string")
    codes = exposures.select("record", "code").unionByName(spark.createDataFrame([(1, "n"), (3, "n"), (9, None)], "record int, code string"))
    assert sorted(tuple(r) for r in intervals.brand_generic(exposures, near, codes).collect()) == [(1, 2), (2, 5), (3, 5)]
    once = spark.createDataFrame([(1, "l"), (2, "l"), (4, "m")], "record int, found string")
    assert [tuple(r) for r in intervals.product_code(exposures, once).collect()] == [(1, 2)]


def grown_by_hand(rows):
    extends = lambda s, t: t.startswith(s + "\n") or t.endswith("\n" + s)
    texts = {(r[1], r[4]) for r in rows if r[4] and r[1]}
    found = set()
    for kind, s in texts:
        longer = [t for k, t in texts if k == kind and extends(s, t)]
        for t in longer:
            if any(w != t and not extends(w, t) and not extends(t, w) for w in longer):
                continue
            for org in {r[2] for r in rows if r[2] is not None}:
                one = [r for r in rows if r[1:3] == (kind, org) and r[4] == s]
                two = [r for r in rows if r[1:3] == (kind, org) and r[4] == t]
                if not one or not two:
                    continue
                first = min(one, key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
                last = min(two, key=lambda r: (r[3] is not None, -(r[3] or 0), r[0]))
                fits = lambda a, b: a[3] is None or b[3] is None or b[3] >= a[3]
                found |= {(first[0], r[0]) for r in two if fits(first, r)} | {(r[0], last[0]) for r in one if fits(r, last)}
    return sorted(found)


def test_grown_notes(spark):
    pick = random.Random(9)
    rows = []
    for k in range(160):
        text = "\n".join(pick.choice(["a", "b", "", "a b"]) for _ in range(pick.randrange(5)))
        rows.append((k, pick.choice(["t", "t", "u", None]), pick.choice(["o", "o", "p", None]), pick.choice([None, 1, 2, 3]), pick.choice([text, text, text, None])))
    rows += [(900 + k, "t", "o", k, "\n".join(f"line {i}" for i in range(k))) for k in range(40)]
    df = spark.createDataFrame(rows, "note int, type string, organization string, date int, text string").repartition(4)
    found = sorted(tuple(r) for r in notes.grown(df).collect())
    assert found == grown_by_hand(rows) and len(found) > 100
    assert notes.grown(df.where("false")).count() == 0


def test_long_notes(spark):
    long = "\n".join(f"line {k}" for k in range(50_000))
    df = spark.createDataFrame([(1, "t", "o", 1, long), (2, "t", "o", 2, long + "\nmore"), (3, "t", "o", 0, long[7:])], "note int, type string, organization string, date int, text string")
    assert sorted(tuple(r) for r in notes.extensions(df.select("type", F.col("note").alias("id"), "text")).select("short", "long").collect()) == [(1, 2), (3, 1)]
