"""Graph patterns as DataFrame plans.

A graph is a DataFrame `s, p, o, g` of term texts (N-Triples syntax); solutions are DataFrames with a column for each
variable, null where unbound. Every function only declares a plan, so Catalyst chooses join strategies,
pushes constants to the scan and prunes columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..operators.lineage import forget, stored


def union_graph(quads: DataFrame, graphs: Sequence[str] | None = None, *, disjoint: bool = False) -> DataFrame:
    """The default graph `s, p, o`: the set union of the chosen graphs (all by default).

    disjoint: no triple is in two of them or twice in one, as where each is a table of its own; then nothing has to be made distinct.
    """
    chosen = quads if graphs is None else quads.where(F.col("g").isin(list(graphs)))
    triples = chosen.select("s", "p", "o")
    return triples if disjoint else triples.distinct()


def pattern(triples: DataFrame, s: str, p: str, o: str, g: str | None = None) -> DataFrame:
    """Solutions of one triple pattern: `?x` is a variable, other text a constant term; a variable that comes twice asks for equal terms."""
    bound: dict[str, str] = {}
    rows = triples
    for column, term in zip("spog", (s, p, o, g), strict=True):
        if term is None:
            continue
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term[1:] in bound:
            rows = rows.where(F.col(column) == F.col(bound[term[1:]]))
        else:
            bound[term[1:]] = column
    return rows.select(*(F.col(c).alias(v) for v, c in bound.items()))


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    """Variables of both."""
    return [c for c in left.columns if c in right.columns]


def join(*solutions: DataFrame, cross: bool = False) -> DataFrame:
    """Inner joins on the shared variables, all of them surely bound. Patterns that share none are an error, or with `cross` each meets each."""
    found = solutions[0]
    for more in solutions[1:]:
        keys = shared(found, more)
        if not keys and not cross:
            raise ValueError(f"no variable of {found.columns} is one of {more.columns}; every solution would meet every other")
        found = found.join(more, keys) if keys else found.crossJoin(more)
    return found


def compatible_join(left: DataFrame, right: DataFrame, certain: Sequence[str], maybe: Sequence[str]) -> DataFrame:
    """Join on `certain` variables; a `maybe` variable that is unbound on one side fits anything and takes the other side's term. Without a certain variable there is nothing to join on, which is an error."""
    if not certain:
        raise ValueError("a join needs a variable that is bound on both sides; every solution could meet every other")
    other = right.withColumnsRenamed({v: f"_{v}" for v in maybe})
    met = left.join(other, list(certain))
    for v in maybe:
        met = met.where(F.col(v).isNull() | F.col(f"_{v}").isNull() | (F.col(v) == F.col(f"_{v}"))).withColumn(v, F.coalesce(v, f"_{v}")).drop(f"_{v}")
    return met


def optional(left: DataFrame, right: DataFrame, where: F.Column | None = None) -> DataFrame:
    """Left join on the shared variables, at least one; a filter inside the optional part is part of the join's condition, so it never drops a left row.

    `where` names columns of the right side as `r.x` and of the left as `l.x`.
    """
    keys = shared(left, right)
    if not keys:
        raise ValueError(f"no variable of {left.columns} is one of {right.columns}; every solution would meet every other")
    on = F.lit(True) if where is None else where
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *(f"r.{c}" for c in right.columns if c not in keys))


def _any_of(right: DataFrame) -> DataFrame:
    """One row if there is any."""
    return F.broadcast(right.limit(1).select(F.lit(1).alias("_any")))


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """The solutions that some solution of `right` agrees with; where no variable is shared, any agrees."""
    keys = shared(left, right)
    return left.join(right, keys, "left_semi") if keys else left.join(_any_of(right), F.lit(True), "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """The solutions that no solution of `right` agrees with; where no variable is shared, any agrees."""
    keys = shared(left, right)
    return left.join(right, keys, "left_anti") if keys else left.join(_any_of(right), F.lit(True), "left_anti")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """As `not_exists`, but a solution that shares no variable with `right`, or has none of them bound, stays."""
    keys = shared(left, right)
    return left.join(right.dropna(how="all", subset=keys), keys, "left_anti") if keys else left


def union(*solutions: DataFrame) -> DataFrame:
    """All solutions with repeats; variables that one side lacks are unbound there."""
    found = solutions[0]
    for more in solutions[1:]:
        found = found.unionByName(more, allowMissingColumns=True)
    return found


def values(left: DataFrame, variables: str | Sequence[str], terms: Iterable[str | Sequence[str | None]]) -> DataFrame:
    """The solutions whose variables are one of the rows of terms; a list of any length is a join, not a long condition. None in a row (UNDEF) fits any term."""
    names = [variables] if isinstance(variables, str) else list(variables)
    rows = {(t,) if isinstance(t, str) else tuple(t) for t in terms}
    found = None
    for bound in sorted({tuple(i for i, t in enumerate(r) if t is not None) for r in rows}):  # the rows with the same terms left open are one join
        some = [tuple(r[i] for i in bound) for r in rows if tuple(i for i, t in enumerate(r) if t is not None) == bound]
        keys = [names[i] for i in bound]
        fit = left.join(left.sparkSession.createDataFrame(some, ", ".join(f"`{k}` string" for k in keys)), keys, "left_semi") if keys else left
        found = fit if found is None else found.unionByName(fit)
    return left.where("false") if found is None else found


def closure(edges: DataFrame, *, zero_length: bool = True, most_rounds: int = 1000) -> DataFrame:
    """`a, b` for every `b` that `a` reaches over the edges `a, b`; with `zero_length` every node reaches itself too.

    Each round joins only the paths that were new in the round before with all that are known: paths double in length, so rounds grow with the logarithm
    of the longest path. Rows are as many as the answer has; cycles end where nothing new is reached.
    """
    edges = edges.select("a", "b").distinct()
    reach = new = stored(edges)
    rounds = [reach]
    for _ in range(most_rounds):
        hop = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        longer = new.join(hop, "b").select("a", F.col("c").alias("b")).distinct()
        new = stored(longer.join(reach, ["a", "b"], "left_anti"))
        if new.isEmpty():
            forget(new)
            break
        reach = reach.unionByName(new)
        rounds.append(new)
    if len(rounds) > 1:
        reach = stored(reach)
        forget(*rounds)
    if zero_length:
        nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a")))
        reach = reach.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
    return reach
