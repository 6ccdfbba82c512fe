"""SimHash near-duplicate detection by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Of two fingerprints that differ in two bits or
fewer, one segment differs in one bit at most. So each fingerprint is indexed, for each segment, by
the segment itself and by its 32 variants with one bit made a wildcard; an equality join of these
keys finds every link and the other bits verify it. Under a wildcard only fingerprints that do
differ in that bit are joined, since equal segments meet under the whole segment already.

Copies and equal fingerprints are one row before any join. No plan may broadcast the index, whose rows Spark underestimates 66 times: keys
that several fingerprints share are found and stored first, and these few are what is broadcast, or merged if they are many. A key that more than `FULL_BUCKET`
fingerprints share isn't joined with itself: there the other segment gets wildcards too, two below
a whole segment and one below a variant. Up to four fingerprints share such a key, all within two
bits of each other, so one link from each to the smallest is enough. Links and rows thus grow with the
number of fingerprints, not with the square of a group's size, and no link between groups is lost.

Cases: a null text counts as empty; no words give fingerprint zero, linked like any other; fewer
than three words are one shingle. Repeated rows give a row each. A null doc_id keeps its row and
never names a component unless the whole component has none. An empty table gives no rows. Only
the named columns take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from ..operators.entries import components
from .common import forget, named, spread_join, stored

SEED = 42
#: Shingles whose bits are counted at once: bounds the memory of very long texts.
COUNTED_AT_ONCE = 1 << 16
#: Fingerprints whose index entries one task makes: the index has 66 rows for each.
INDEXED_AT_ONCE = 20_000
#: Fingerprints under one key beyond which the other segment is refined instead of joined.
FULL_BUCKET = 64
#: Shared keys up to which all of them are broadcast; beyond that only the most frequent are.
BROADCAST_KEYS = 100_000

_LOW = 0xFFFFFFFF


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes set each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _signs(counts: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes: a bit is set if over half of them set it; zero if there are none."""
    return _signs(sum((_bits(hashes[k : k + COUNTED_AT_ONCE]) for k in range(0, len(hashes), COUNTED_AT_ONCE)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the XXH64 of all `width`-word shingles: a bit is set if over half of the hashes set it."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, COUNTED_AT_ONCE):
        shingles = zip(*(words[start + k : min(start + COUNTED_AT_ONCE, n) + k] for k in range(width)), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], np.uint64)
        counts += _bits(hashes)
    return _signs(counts, n)


def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = np.fromiter((fingerprint(texts[i].as_py(), width) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """`doc_id, fp` of every whole text; fp holds the 64 bits as a signed long."""
    rows = named(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(lambda b: _fingerprints(width, b), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _segments(fp: F.Column) -> tuple[F.Column, F.Column]:
    return fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 32)


def _index(fps: DataFrame) -> DataFrame:
    """`key, bit, fp`: 33 keys for each of the two segments; a key holds the segment's number, the wildcard's place (32: none) and the rest of the bits. bit: what stands under the wildcard."""
    entries = []
    for number, segment in enumerate(_segments(F.col("fp"))):
        entries += [F.struct((segment * 128 + (number * 64 + 32)).alias("key"), F.lit(None).cast("int").alias("bit"))]
        entries += [
            F.struct(
                (segment.bitwiseAND(F.lit(_LOW ^ (1 << p))) * 128 + (number * 64 + p)).alias("key"),
                F.shiftrightunsigned(segment, p).bitwiseAND(F.lit(1)).cast("int").alias("bit"),
            )
            for p in range(32)
        ]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.key", "e.bit", "fp")


def _shared(index: DataFrame, met: DataFrame) -> DataFrame:
    """The index's rows under the keys of the stored table `met` (`key, n`), and n. Only `met` or its most frequent keys are ever broadcast."""
    if met.count() <= BROADCAST_KEYS:
        return index.join(F.broadcast(met), "key")
    return spread_join(index, met.withColumn("held", F.col("n")), "key", "held")


def links(fps: DataFrame, *, full_bucket: int = FULL_BUCKET, distance: int = 2) -> DataFrame:
    """Distinct `a, b` (a below b) of the column `fp` of distinct fingerprints: pairs two bits apart or fewer that connect all that are linked.

    Every linked pair is there, save that in full buckets a chain through the smallest of up to
    four fingerprints stands for them. distance: beyond two bits, up to so many, each fingerprint is
    also paired with the smallest under each of its keys, full or not.
    """
    index = _index(fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() // INDEXED_AT_ONCE + 1), "fp"))
    met = index.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"), *([F.min("fp").alias("low")] if distance > 2 else []))
    met = stored(met.where("n > 1 and (ones is null or ones between 1 and n - 1)").drop("ones"))
    rows = stored(_shared(index, met))
    forget(met)

    some = rows.where(F.col("n") <= full_bucket)
    one, two = some.select("key", "bit", F.col("fp").alias("a")), some.select("key", F.col("bit").alias("bit_b"), F.col("fp").alias("b"))
    other_way = F.coalesce(F.col("bit") < F.col("bit_b"), F.col("a") < F.col("b"))
    joined = one.join(two, (one.key == two.key) & other_way & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")

    full = rows.where(F.col("n") > full_bucket)
    low, high = _segments(F.col("fp"))
    other = F.when(F.col("key").bitwiseAND(F.lit(64)) == 0, high).otherwise(low)
    pairs = [(1 << p) | (1 << q) for p in range(32) for q in range(p)]
    masks = F.when(F.col("bit").isNull(), F.array(*map(F.lit, pairs))).otherwise(F.array(*(F.lit(1 << p).cast("bigint") for p in range(32))))
    refined = full.select("key", "fp", other.alias("other"), F.explode(masks).alias("mask"))
    refined = refined.groupBy("key", "mask", F.col("other").bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(F.collect_set("fp").alias("fps"))  # of four at most
    starred = refined.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")

    found = joined.unionByName(starred)
    if distance > 2:
        found = found.unionByName(rows.select(F.col("low").alias("a"), F.col("fp").alias("b")).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", full_bucket: int = FULL_BUCKET) -> DataFrame:
    """`doc_id, fp, component_id` of every document: component_id is the smallest doc_id reachable over links of two bits or fewer."""
    docs = stored(fingerprints(df, id_col=id_col, text_col=text_col))
    alike = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    found = components(links(alike.select("fp"), full_bucket=full_bucket))
    rooted = alike.join(found, alike.fp == found.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named_roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named_fps = stored(spread_join(rooted, named_roots, "root", "n").select("fp", "component_id", "copies"))
    forget(alike)
    return spread_join(docs, named_fps, "fp", "copies").select("doc_id", "fp", "component_id")
