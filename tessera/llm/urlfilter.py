"""URL filters by a sorted digest array.

Every entry of a list, written `host/path`, becomes the XXH64 of its text; the sorted 64-bit keys and
the full texts are one file in the shared folder, which each executor fetches and memory-maps. So are the entries' hosts, each
with the lengths of its paths. A URL is probed first with every suffix of its host; only where that is a host of the list are the suffix and the
beginnings of the URL's path, of that host's lengths, probed. The keys of a batch are looked up by one vectorised binary search, and a hit
counts only if the stored full text is equal, so keys that collide change nothing.

A file of over `MOST_BYTES` isn't sent: then hosts and entries are joined as tables, with the same result. Hosts that many URLs end in, such as `com`, are spread over `SALTS` tasks each.

Cases: a null URL, or one without `://`, has an empty host and path and fits no entry. Of entries that fit,
the longest wins, and of those of equal length the one with the longer host. Repeated rows give a row each. An empty list
lets everything pass. Only the named columns take part.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession

from .common import shared_folder, stored

SEED = 42
#: Bound of a digest file that is sent to every executor.
MOST_BYTES = 64 << 20
#: Tasks among which the URLs of one host of a joined list are dealt.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, A-Z lower-cased, and path of a URL column; empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def keys_of(texts: Sequence[str]) -> np.ndarray:
    """XXH64 of texts."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts), np.uint64, len(texts))


def digest_file(entries: Sequence[str], lengths: Sequence[Sequence[int]] | None = None) -> bytes:
    """Count, sorted keys, places and texts of the distinct entries, and the places and values of the lengths that go with each (none by default)."""
    distinct = list(dict(zip(entries, lengths or [()] * len(entries), strict=True)).items())
    order = np.argsort(keys_of([e for e, _ in distinct]), kind="stable")
    keyed = [(distinct[i][0].encode(), sorted(distinct[i][1])) for i in order]
    keys = keys_of([e.decode() for e, _ in keyed])
    ends = np.cumsum([0, *(len(e) for e, _ in keyed)], dtype=np.int64)
    length_ends = np.cumsum([0, *(len(n) for _, n in keyed)], dtype=np.int64)
    numbers = np.array([n for _, own in keyed for n in own], np.int64)
    return struct.pack("<q", len(keyed)) + keys.tobytes() + ends.tobytes() + length_ends.tobytes() + numbers.tobytes() + b"".join(e for e, _ in keyed)


class DigestArray:
    """A memory-mapped digest file, from `start` on."""

    def __init__(self, whole: np.ndarray):
        n = int(whole[:8].view(np.int64)[0])
        self.keys, self.ends, self.length_ends = whole[8 : 8 + 8 * n].view(np.uint64), whole[8 + 8 * n : 16 + 16 * n].view(np.int64), whole[16 + 16 * n : 24 + 24 * n].view(np.int64)
        at = 24 + 24 * n + 8 * int(self.length_ends[-1])
        self.lengths, self.texts = whole[24 + 24 * n : at].view(np.int64), whole[at:]

    def places(self, keys: np.ndarray, texts: Sequence[str]) -> np.ndarray:
        """The place of each text among the entries, -1 for what is none; keys are the texts' XXH64. Entries of equal keys stand side by side and are all compared."""
        first, after = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(first < after):
            text = texts[i].encode()
            for j in range(first[i], after[i]):
                if self.texts[self.ends[j] : self.ends[j + 1]].tobytes() == text:
                    found[i] = j
        return found

    def lengths_at(self, place: int) -> list[int]:
        return self.lengths[self.length_ends[place] : self.length_ends[place + 1]].tolist()


def suffixes(host: str) -> list[str]:
    """A host and what is left of it after each dot."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


class UrlList:
    """The hosts and the entries of a list."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        cut = int(whole[:8].view(np.int64)[0])
        self.hosts, self.entries = DigestArray(whole[8:cut]), DigestArray(whole[cut:])

    def matches(self, hosts: Sequence[str], paths: Sequence[str]) -> list[list[str]]:
        """The entries that fit each URL of a batch: one search for all host suffixes, one for the entries that these leave."""
        at, asked = [], []
        for i, host in enumerate(hosts):
            for s in suffixes(host):
                at.append(i)
                asked.append(s)
        rows, probes = [], []
        for k in np.flatnonzero((places := self.hosts.places(keys_of(asked), asked)) >= 0):
            path = paths[at[k]]
            for n in self.hosts.lengths_at(places[k]):
                if n <= len(path):
                    rows.append(at[k])
                    probes.append(asked[k] + path[:n])
        found: list[list[str]] = [[] for _ in hosts]
        for k in np.flatnonzero(self.entries.places(keys_of(probes), probes) >= 0):
            found[rows[k]].append(probes[k])
        return found


_lists: dict[str, UrlList] = {}


def _matched(name: str) -> Callable[[Column, Column], Column]:
    """A column function: the entries of the shared file that fit a host and path."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if name not in _lists:
            _lists.clear()
            _lists[name] = UrlList(SparkFiles.get(name))
        for hosts, paths in batches:
            yield pa.array(_lists[name].matches(hosts.to_pylist(), paths.to_pylist()), pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def _share(spark: SparkSession, content: bytes) -> str:
    """Write the file to the shared folder and have every executor fetch it; its name."""
    context = spark.sparkContext
    name = f"digests-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    for start in range(0, len(content), 1 << 20):
        out.write(bytearray(content[start : start + (1 << 20)]))
    out.close()
    context.addFile(path.toString())
    return name


def _joined(rows: DataFrame, hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """`row, host, path, found` by joins, for a list that is too large to send. hosts: `suffix, lengths`; listed: `entry`."""
    numbered = stored(rows.withColumn("number", F.monotonically_increasing_id()))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    salt = F.pmod(F.xxhash64("number"), F.lit(SALTS)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    asked = numbered.where("host <> ''").select("number", "path", salt, F.explode(ends).alias("suffix"))
    at_hosts = asked.join(salted(hosts), ["suffix", "salt"]).select("number", "salt", "suffix", "path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    probes = at_hosts.select("number", "salt", F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("n").cast("int"))).alias("entry"))
    met = probes.join(salted(listed), ["entry", "salt"]).groupBy("number").agg(F.collect_list("entry").alias("found"))
    return numbered.join(met, "number", "left").select("row", "host", "path", F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def matching_entries(df: DataFrame, entries: DataFrame, *, url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """`row, host, path, found`: every row of `df` as a struct, its host and path, and the entries (column `entry`) that fit it."""
    spark = df.sparkSession
    listed = entries.select("entry").where("entry is not null").distinct()
    cut = F.instr("entry", "/")
    hosts = listed.select(F.substring(F.col("entry"), F.lit(1), cut - 1).alias("suffix"), (F.length("entry") - cut + 1).cast("long").alias("n")).groupBy("suffix").agg(F.collect_set("n").alias("lengths"))
    size = listed.agg(F.sum(2 * F.octet_length("entry") + 64)).first()[0] or 0
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col(f"`{url_col}`")), strict=True)))
    if size > most_bytes:
        return _joined(rows, hosts, listed)
    by_host = hosts.toArrow()  # `most_bytes` at most, as the list itself
    first = digest_file(by_host.column("suffix").to_pylist(), by_host.column("lengths").to_pylist())
    first += bytes(-len(first) % 8)  # so that the second array's numbers are aligned
    name = _share(spark, struct.pack("<q", 8 + len(first)) + first + digest_file(listed.toArrow().column("entry").to_pylist()))
    return rows.withColumn("found", _matched(name)(F.col("host"), F.col("path")))


def judge(df: DataFrame, rules: DataFrame, blocked: DataFrame, *, url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of `df` as a struct `row`, with `host`, `path`, `rule` and `verdict`.

    rules: `entry, verdict` (allow or block). blocked: `entry`, a list of what is blocked where no rule fits; all else passes.
    Both have entries `host/path`; the verdicts of the rules are a small table.
    """
    both = rules.select("entry").unionByName(blocked.select("entry"))
    found = matching_entries(df, both, url_col=url_col, most_bytes=most_bytes)
    verdicts = F.create_map(*(F.lit(x) for r in rules.select("entry", "verdict").collect() for x in r)).cast("map<string,string>")
    ruled = F.filter("found", lambda e: F.map_contains_key(verdicts, e))
    longest = F.array_max(F.transform(ruled, lambda e: F.struct(F.length(e).alias("n"), F.instr(e, "/").alias("host"), e.alias("entry"))))
    out = found.select("row", "host", "path", "found", longest["entry"].alias("rule"))
    method = F.when(F.size("found") > 0, "block").otherwise("allow")
    return out.select("row", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.try_element_at(verdicts, F.col("rule"))).otherwise(method).alias("verdict"))
