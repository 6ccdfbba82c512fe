"""Filing in strict order of arrival: each record joins what it matches among the records before it, by the entries as they are then.

Each filed Same changes the entries that later records see, so the order counts, but only among records that matches and Sames connect.
Connected components are found first, in parallel; each is then one pass in order of arrival over its rows, sorted by Spark and read as a stream. A task
holds what the order is about and no more: one parent a record, the pairs judged different, and the matches of the one record it is at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .entries import components

#: Kinds of rows of a component, in the order in which those of one moment are read.
APART, MATCH, SAME = 0, 1, 2
_ROW = ("component", "record", "kind", "rule", "origin", "other")


class Entries:
    """The entries of a component's records: union-find, and the pairs judged different."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.different: set[tuple[str, str]] = set()

    def root(self, name: str) -> str:
        at = name
        while (up := self.parent.get(at)) is not None:
            at = up
        while name != at:
            self.parent[name], name = at, self.parent[name]
        return at

    def apart(self, a: str, b: str) -> bool:
        return (a, b) in self.different

    def join(self, members: list[str]) -> None:
        """What a Same joins: each member with the least; if any two are different, every pair that isn't."""
        own = set(members)
        split = any(a in own and b in own for a, b in self.different) if len(own) ** 2 > len(self.different) else any(self.apart(a, b) for a in own for b in own)
        least = min(own)
        for a in own:
            for b in own if split else (least,):
                if a != b and not self.apart(a, b) and self.root(a) != self.root(b):
                    self.parent[self.root(a)] = self.root(b)

    def star(self, record: str, matched: list[str]) -> list[str]:
        """Of the records matched one of each entry, the least of those not judged different from the record, or the least of all."""
        kept: dict[str, tuple[bool, str]] = {}
        for other in matched:
            entry, mine = self.root(other), (self.apart(record, other), other)
            kept[entry] = min(kept.get(entry, mine), mine)
        return sorted(other for _, other in kept.values())


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Sames of rows in order: component, arrival, record, kind, rule, origin, other."""
    entries, component, record = Entries(), None, None
    matched: dict[tuple[str, str | None], list[str]] = {}
    held: dict[str, list[str]] = {}  # Sames from before, whose latest member is the record
    out: list[tuple[str, str, str | None, str]] = []

    def ended() -> None:
        """The record's stars, by the entries before it, then what they and the Sames that end with it join."""
        stars = [(rule, origin, entries.star(record, others)) for (rule, origin), others in matched.items()]
        out.extend((record, rule, origin, other) for rule, origin, star in stars for other in star)
        for _, _, star in stars:
            entries.join([record, *star])
        for members in held.values():
            entries.join(members)
        matched.clear()
        held.clear()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["record", "rule", "origin", "other"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in _ROW]
        for of, name, kind, rule, origin, other in zip(*columns, strict=True):
            if of != component or name != record:
                ended()
            if of != component:
                entries, component = Entries(), of
            record = name
            if kind == APART:
                entries.different |= {(rule, other), (other, rule)}
            elif kind == MATCH:
                matched.setdefault((rule, origin), []).append(other)
            else:
                held.setdefault(rule, []).append(other)
        if out:
            yield rows()
            out = []
    ended()
    if out:
        yield rows()


def file_in_order(records: DataFrame, matches: DataFrame, sames: DataFrame, different: DataFrame) -> DataFrame:
    """`record, rule, origin, other`: the Sames that records are filed with, each a star of the record and one earlier record of each entry it matches.

    records: `record, arrived` and `taken`, whether the record is to be filed; order is by arrival, then name. matches: `rule, origin, a, b`, either way round, origin perhaps null.
    sames: `same, member` of the Sames from before, which count once their latest member has arrived. different: `a, b`.
    Rules and origins of one record see the same entries, those before it, and join afterwards. Names are compared as texts. A match with a record that isn't there, or with itself, is none; members
    of Sames that aren't there don't hold a Same back. Null names match nothing.
    """
    text = lambda c: F.col(c).cast("string")
    there = records.select(text("record").alias("record"), "arrived", "taken").dropna(subset=["record"]).dropDuplicates(["record"])
    pairs = matches.select(text("rule").alias("rule"), text("origin").alias("origin"), text("a").alias("a"), text("b").alias("b"))
    both = pairs.unionByName(pairs.select("rule", "origin", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    moment = F.struct("arrived", "record")
    mine = there.where("taken").select(F.col("record").alias("a"), moment.alias("now"))
    other = there.select(F.col("record").alias("b"), moment.alias("then"))
    met = both.join(mine, "a").join(other, "b").where(F.col("then") < F.col("now"))

    members = sames.select(text("same").alias("same"), text("member").alias("member")).dropna().distinct()
    latest = members.join(there.select(F.col("record").alias("member"), moment.alias("m")), "member", "left").groupBy("same").agg(F.max("m").alias("now"), F.min("member").alias("least"))
    held = members.join(latest, "same")

    edges = met.select("a", "b").unionByName(held.select(F.col("least").alias("a"), F.col("member").alias("b")))
    of = components(edges).select("node", F.col("root").alias("component"))
    rows = met.select(F.col("a").alias("node"), F.col("now.arrived").alias("arrived"), F.col("a").alias("record"), F.lit(MATCH).alias("kind"), "rule", "origin", F.col("b").alias("other"))
    rows = rows.unionByName(held.where("same is not null").select(F.col("member").alias("node"), F.col("now.arrived").alias("arrived"), F.col("now.record").alias("record"), F.lit(SAME).alias("kind"), F.col("same").alias("rule"), F.lit(None).cast("string").alias("origin"), F.col("member").alias("other")))
    kept = rows.join(of, "node").drop("node")
    judged = different.select(text("a").alias("a"), text("b").alias("b")).where("a <> b").distinct()
    inside = judged.join(of.select(F.col("node").alias("a"), "component"), "a").join(of.select(F.col("node").alias("b"), "component"), ["b", "component"])
    apart = inside.select(F.lit(None).cast(records.schema["arrived"].dataType).alias("arrived"), F.lit(None).cast("string").alias("record"), F.lit(APART).alias("kind"), F.col("a").alias("rule"), F.lit(None).cast("string").alias("origin"), F.col("b").alias("other"), "component")
    ordered = kept.unionByName(apart).repartition("component").sortWithinPartitions("component", "arrived", "record", "kind", "rule", "origin", "other")
    return ordered.select(*_ROW).mapInArrow(_filed, "record string, rule string, origin string, other string")
