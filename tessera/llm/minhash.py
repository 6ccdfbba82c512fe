"""Near-duplicates at a Jaccard similarity of 0.8: SimHash by deletion-variant signatures first, then min-wise fingerprints for what is still apart.

The operator `simhash` links sets of five-word shingles by their SimHash: equal fingerprints, those two bits apart or fewer, and of those
up to `MOST_BITS` apart what meets under a deletion variant. The exact similarity verifies each link, and their components are where the rest begins.

64 sign bits alone can't tell a similarity of 0.8 (about ten of them differ, spread over both segments), so pairs of different components are looked for by
the same scheme over another alphabet: here a fingerprint has 30 symbols, each the least value of the text's five-word shingles under another permutation; two texts agree in a symbol with
the probability of their similarity. The fingerprint is cut into six segments of five symbols. A segment of two similar texts often differs in one symbol at
most, so each is indexed by its five variants with one symbol made a wildcard. An equality join of these keys finds candidates and the exact
Jaccard similarity of the shingle sets verifies them. A pair at 0.8 shares no key with a probability of 0.0003, a more similar one with less.

Texts of equal sets are one row before any join. Among sets that SimHash leaves apart every one first meets the least under each of its min-wise keys; components of the verified
links follow. Then, under each key, the sets outside its largest component meet all of the key's sets in other components. Where those are more than `FULL_BUCKET`,
all of the key's sets meet the one with the smallest share of shingles of its own, which is what others were copied from if any was; and a
prefix join takes the key's place for sets that are still apart. It is exact: of two sets at 0.8 the rarest shingles, a fifth of each, have one in common, and what follows it in both is long enough.
So a full key loses no link.

Cases: a null text counts as empty; fewer than five words are one shingle; texts without words are copies of each other.
A null doc_id comes after all others. Of rows with the same doc_id and the same text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from ..operators.entries import components
from . import simhash
from .common import forget, parts_of, spread_join, stored, unused

WIDTH, SIMILAR, SEED = 5, 0.8, 42
SEGMENTS, SYMBOLS = 6, 5
#: Sets of other components than the largest under one key beyond which the exact prefix join takes the key's place.
FULL_BUCKET = 16
#: Bits in which SimHashes of sets at 0.8 may differ: ten are expected, with a deviation of three.
MOST_BITS = 22
#: Hashes permuted at once, and words whose hashes a worker remembers.
PERMUTED_AT_ONCE, CACHED_WORDS = 4096, 100_000

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, SEGMENTS * SYMBOLS, 1), np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all `width`-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    rows = np.full(n, width, np.uint64)
    for k in range(width):
        rows = rows * _STEP + hashed[k : k + n]
    return np.unique(_mixed(rows))


def symbols(hashes: np.ndarray) -> np.ndarray:
    """The min-wise fingerprint of a set that isn't empty."""
    least = np.full(SEGMENTS * SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), PERMUTED_AT_ONCE):
        least = np.minimum(least, (hashes[None, start : start + PERMUTED_AT_ONCE] * _FACTORS + _SHIFTS).min(1))
    return least


def variant_keys(fingerprints: np.ndarray) -> np.ndarray:
    """One row of keys for each fingerprint: of every segment its variants with one symbol left out."""
    cut = fingerprints.reshape(-1, SEGMENTS, SYMBOLS)
    found = np.empty(cut.shape, np.uint64)
    for wild in range(SYMBOLS):
        rows = np.arange(SEGMENTS, dtype=np.uint64)[None, :] * np.uint64(SYMBOLS) + np.uint64(wild) + np.zeros((len(cut), 1), np.uint64)
        for k in range(SYMBOLS):
            if k != wild:
                rows = rows * _STEP + cut[:, :, k]
        found[:, :, wild] = _mixed(rows)
    return found.reshape(len(cut), SEGMENTS * SYMBOLS).view(np.int64)


def _signed_long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _named(hashes: np.ndarray) -> int:
    """A set's own 64 bits, as a signed long."""
    return _signed_long(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, "text"):
            texts = part.column("text")
            sets = [shingles(texts[i].as_py()) for i in range(part.num_rows)]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = variant_keys(np.array([symbols(s) for s in sets if len(s)], np.uint64).reshape(-1, SEGMENTS * SYMBOLS))
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * keys.shape[1])]).astype(np.int32)
            fps = pa.array([_signed_long(simhash.of_hashes(s)) for s in sets], pa.int64())
            columns = [pa.array([_named(s) for s in sets], pa.int64()), pa.array(sizes), fps, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), *columns], names=["doc_id", "digest", "set", "n", "fp", "keys"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, "text"):
            texts = part.column("text")
            sets = [shingles(texts[i].as_py()) for i in range(part.num_rows)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_named(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["set", "hashes"])


def _fits(pairs: DataFrame) -> DataFrame:
    """Distinct `a, b`, the smaller first, whose sizes `n_a` and `n_b` don't rule the similarity out."""
    fit = pairs.where("a <> b").where(F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs `a, b` of sets that are similar, by the exact Jaccard similarity of their hashes."""
    one, two = sets.select(F.col("set").alias("a"), F.col("hashes").alias("one")), sets.select(F.col("set").alias("b"), F.col("hashes").alias("two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("one", "two")).alias("m"), (F.size("one") + F.size("two")).alias("n"))
    return both.where(F.col("m") >= SIMILAR * (F.col("n") - F.col("m"))).select("a", "b")


def _by_simhash(sets: DataFrame) -> DataFrame:
    """Pairs `a, b` of the sets `set, n, fp` that SimHash links: sets of one fingerprint with its least, and the least sets of linked fingerprints."""
    some = sets.where("n > 0")
    least = stored(some.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("low"), F.count("*").alias("held")).select("fp", F.col("low.set").alias("a"), F.col("low.n").alias("n_a"), "held"))
    equal = spread_join(some.select("fp", F.col("set").alias("b"), F.col("n").alias("n_b")), least.where("held > 1"), "fp", "held").drop("fp")
    linked = simhash.links(least.select("fp"), distance=MOST_BITS).withColumnsRenamed({"a": "fp", "b": "fp_b"})
    other = least.select(F.col("fp").alias("fp_b"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    found = stored(_fits(equal.unionByName(linked.join(least.drop("held"), "fp").join(other, "fp_b").drop("fp", "fp_b"))))
    forget(least)
    return found


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs `a, b` whose sets are of different components `node, root`."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").select("a", "b")


def _under_keys(members: DataFrame, found: DataFrame, full_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components under the keys where few sets are outside the largest component, and `key, set, n, root` of the sets under the other mixed keys.

    members: `key, set, n`; found: `node, root` of the components so far.
    """
    rooted = members.join(found, members.set == found.node, "left").select("key", "set", "n", F.coalesce("root", "set").alias("root"))
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("held"))
    mixed = counts.groupBy("key").agg(F.sum("held").alias("all"), F.max(F.struct("held", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    rows = stored(rooted.join(mixed.select("key", F.col("largest.root").alias("main"), (F.col("all") - F.col("largest.held")).alias("others")), "key"))
    few = rows.where(F.col("others") <= full_bucket)
    one = few.where("root <> main").select("key", F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    two = few.select("key", F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    return _fits(one.join(two, "key").where("root_a <> root_b")), rows.where(F.col("others") > full_bucket).select("key", "set", "n", "root")


def _ranked(full: DataFrame, sets: DataFrame) -> DataFrame:
    """`set, n, often` of sets `set, n`: the shingles that others of them have too, the rarest first."""
    every = full.join(sets, "set").select("set", "n", F.explode("hashes").alias("shingle"))
    frequent = every.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    ranked = every.join(frequent, "shingle").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("often"))
    return ranked.select("set", "n", F.transform("often", lambda x: x.shingle).alias("often"))


def _centred(full: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pairs of each key's sets with the one of which others share the largest part."""
    known = full.join(ranked.select("set", (F.size("often") / F.col("n")).alias("share")), "set")
    centre = known.groupBy("key").agg(F.max(F.struct("share", "set", "n", "root")).alias("c"))
    met = known.join(centre, "key").where("root <> c.root")
    return _fits(met.select(F.col("c.set").alias("a"), F.col("c.n").alias("n_a"), F.col("set").alias("b"), F.col("n").alias("n_b")))


def _by_prefix(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs `a, b` of different components that can be similar among the sets `set, n, often`.

    The rarest shingles, a fifth and one of each set, have one in common, and the first of these is followed in both by as many as the overlap needs. Shingles of one set only come first and meet nothing: what is left of
    that fifth is of the others.
    """
    rooted = ranked.join(found, ranked.set == found.node, "left").select("set", "n", "often", F.coalesce("root", "set").alias("root"))
    left = F.floor(F.col("n") * (1 - SIMILAR) + 1e-9) + 1 - (F.col("n") - F.size("often"))
    entry = rooted.where(left > 0).select("set", "n", "root", F.size("often").alias("e"), F.posexplode(F.slice("often", F.lit(1), left.cast("int"))).alias("at", "shingle"))
    prefix = entry.select("shingle", "set", "n", "root", (F.col("e") - F.col("at")).alias("rest"))
    side = lambda k: prefix.select("shingle", F.col("set").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "root", "rest")))
    enough = (1 + SIMILAR) * F.least("rest_a", "rest_b") + 1e-6 >= SIMILAR * (F.col("n_a") + F.col("n_b"))
    return _fits(side("a").join(side("b"), "shingle").where("a < b and root_a <> root_b").where(enough))


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components `node, root` with further links `a, b`: the components themselves are the nodes that these join."""
    if more.isEmpty():
        return found
    ends = more
    for end in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    whole = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).withColumnsRenamed({"node": "part", "root": "whole"})
    nodes = found.unionByName(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").withColumn("root", F.col("node")))
    return stored(nodes.join(whole, nodes.root == whole.part, "left").select("node", F.coalesce("whole", "root").alias("root")))


def keepers(rows: DataFrame, *, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """`doc_id, digest, copies` of the first row of each group of near-duplicates among rows `doc_id, digest, text`; copies: how many rows have this doc_id and digest."""
    schema = rows.schema["doc_id"].dataType.simpleString()
    docs = stored(rows.mapInArrow(_signed, f"doc_id {schema}, digest bigint, set bigint, n bigint, fp bigint, keys array<bigint>"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    alike = stored(docs.groupBy("set").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    repeated = stored(docs.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")).where("copies > 1"))
    forget(docs)

    index = alike.select("set", "n", F.explode("keys").alias("key"))
    met = index.groupBy("key").agg(F.count("*").alias("n_key"), F.min(F.struct("set", "n")).alias("low")).where("n_key > 1")
    members = stored(index.join(met.select("key", F.col("low.set").alias("a"), F.col("low.n").alias("n_a")), "key"))
    alike_by_signs = _by_simhash(alike.select("set", "n", "fp"))
    compared = members.select("set").unionByName(alike_by_signs.select(F.explode(F.array("a", "b")).alias("set"))).distinct()
    needed = compared.join(alike, "set").select(F.col("least.doc_id").alias("doc_id"), F.col("least.digest").alias("digest"))
    own = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.digest") == F.col("s.digest"))
    texts = rows.alias("r").join(needed.alias("s"), own, "left_semi").select("text")
    sets = stored(texts.mapInArrow(_hashed, "set bigint, hashes array<bigint>").dropDuplicates(["set"]))

    links = stored(_verified(alike_by_signs, sets))
    found = stored(components(links))
    first = _fits(members.select("a", "n_a", F.col("set").alias("b"), F.col("n").alias("n_b")))
    found = _joined(found, stored(_verified(_apart(first, found), sets)))
    pairs, full = _under_keys(members.select("key", "set", "n"), found, full_bucket)
    found = _joined(found, stored(_verified(pairs, sets)))
    if not full.isEmpty():
        ranked = stored(_ranked(full.select("set", "n").distinct(), sets))
        found = _joined(found, stored(_verified(_centred(full, ranked), sets)))
        found = _joined(found, stored(_verified(_by_prefix(ranked, found), sets)))
        forget(ranked)
    forget(members, sets, links, alike_by_signs)
    rooted = alike.join(found, alike.set == found.node, "left").select("least", F.coalesce("root", "set").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.digest")
    return first.alias("r").join(repeated.alias("s"), own, "left").select("r.doc_id", "r.digest", F.coalesce("s.copies", F.lit(1)).alias("copies"))


def first_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", full_bucket: int = FULL_BUCKET) -> DataFrame:
    """The rows of `df`, all columns, that come first in their group of near-duplicates, by doc_id and then by a digest of the text."""
    name, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.xxhash64(text)
    stay = stored(keepers(df.select(name.alias("doc_id"), digest.alias("digest"), F.col(f"`{text_col}`").alias("text")), full_bucket=full_bucket))
    one, two = unused(df, "stays_id"), unused(df, "stays_digest")

    def kept(chosen: DataFrame) -> DataFrame:
        these = chosen.select(F.col("doc_id").alias(one), F.col("digest").alias(two))
        return df.join(these, name.eqNullSafe(F.col(one)) & (digest == F.col(two)), "left_semi")

    again = stay.where("copies > 1")
    if again.isEmpty():
        return kept(stay)
    return kept(stay.where("copies = 1")).unionByName(kept(again).withColumn(two, digest).dropDuplicates([id_col, two]).drop(two))
