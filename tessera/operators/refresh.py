"""Derived triples kept up to date: what changed, whom it concerns, what they derive now, until nothing changes any more.

A derivation says which keys a changed triple concerns and builds the triples of given keys from the graph. A round takes what changed in
the round before, builds the keys concerned anew, replaces what they had, and passes on only the triples that came or went. So only what a change reaches is derived again;
what was kept is copied. The whole build is the refresh of nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .lineage import forget, stored

_TRIPLE = ["s", "p", "o"]


class Derivation(NamedTuple):
    """keys: from changed triples `s, p, o` and the graph the keys `key` whose triples may be others now; build: from the graph and keys their triples `key, s, p, o`.

    A derivation may read what others derive, in any order, but not its own triples, unless a key holds all that feed one another: what only supports itself would never go.
    """

    name: str
    keys: Callable[[DataFrame, DataFrame], DataFrame]
    build: Callable[[DataFrame, DataFrame], DataFrame]


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The triples that are in just one of two graphs."""
    sides = old.select(*_TRIPLE, F.lit(1).alias("_side")).unionByName(new.select(*_TRIPLE, F.lit(2).alias("_side")))
    return sides.groupBy(*_TRIPLE).agg(F.min("_side").alias("_one"), F.max("_side").alias("_two")).where("_one = _two").select(*_TRIPLE)


def refresh(old: DataFrame, new: DataFrame, kept: DataFrame, derivations: Sequence[Derivation], *, most_rounds: int = 100) -> DataFrame:
    """`name, key, s, p, o` that the derivations make of the graph `new`, from what they made (`kept`, the same columns) of the graph `old`. Rounds that don't end are an error."""
    texts = ["name", "key", *_TRIPLE]
    kept = stored(kept.select(*(F.col(c).cast("string").alias(c) for c in texts)))
    changed = stored(difference(old, new))
    for _ in range(most_rounds):
        if changed.isEmpty():
            forget(changed)
            return kept
        graph = new.select(*_TRIPLE).unionByName(kept.select(*_TRIPLE)).distinct()
        fresh, concerned = None, None
        for d in derivations:
            keys = d.keys(changed, graph).select(F.col("key").cast("string").alias("key")).dropna().distinct()
            built = d.build(graph, keys).select(F.lit(d.name).alias("name"), F.col("key").cast("string").alias("key"), *_TRIPLE).join(keys, "key", "left_semi").select(*texts)
            named = keys.select(F.lit(d.name).alias("name"), "key")
            fresh = built if fresh is None else fresh.unionByName(built)
            concerned = named if concerned is None else concerned.unionByName(named)
        if fresh is None:
            break
        concerned, fresh = stored(concerned), stored(fresh.distinct())
        newer = stored(kept.join(concerned, ["name", "key"], "left_anti").unionByName(fresh))
        now = stored(difference(kept, newer))  # what another key or derivation still has is still there
        forget(changed, kept, concerned, fresh)
        changed, kept = now, newer
    if not derivations:
        return kept
    raise ValueError("derivations still change after the most rounds")


def whole(graph: DataFrame, derivations: Sequence[Derivation]) -> DataFrame:
    """What the derivations make of a graph from nothing."""
    nothing = graph.select(*_TRIPLE).where("false")
    return refresh(nothing, graph, nothing.select(F.lit("").alias("name"), F.lit("").alias("key"), *_TRIPLE), derivations)


def agrees(kept: DataFrame, graph: DataFrame, derivations: Sequence[Derivation]) -> bool:
    """Whether what was kept is what a whole build makes."""
    built = whole(graph, derivations)
    return kept.select("name", "key", *_TRIPLE).exceptAll(built).isEmpty() and built.exceptAll(kept.select("name", "key", *_TRIPLE)).isEmpty()


def named_before(old: DataFrame, new: DataFrame) -> DataFrame:
    """`name`: what only the new graph describes, but the old one named as an object already. Whoever said so then may derive something else now."""
    described = lambda g: g.select(F.col("s").alias("name")).distinct()
    fresh = described(new).join(described(old), "name", "left_anti")
    return fresh.join(old.select(F.col("o").alias("name")), "name", "left_semi")
