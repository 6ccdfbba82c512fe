"""State per record over several batches of a stream."""

import datetime as dt

from tessera.streaming import arrivals, histories

DAY = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, make):
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / f"{k:02d}"))
    paths = sorted(p for p in source.rglob("part-*.json"))
    for k, p in enumerate(paths):  # one file a batch, in order
        p.rename(source / f"{k:02d}.json")
        import os

        os.utime(source / f"{k:02d}.json", (1_000_000 + k * 10, 1_000_000 + k * 10))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source / "*.json"))
    out, check = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_late_changed_and_silent_records(spark, tmp_path):
    at = lambda day, hour=0: DAY + dt.timedelta(days=day, hours=hour)
    batches = [
        [("a", "v1", at(0)), ("b", "x", at(0)), ("a", "v2", at(1)), ("a", "v1", at(0, 1)), (None, "x", at(1)), ("c", None, at(1))],
        [("a", "v1", at(2)), ("a", "v9", at(1, 12)), ("a", "v1", at(3)), ("a", "v0", at(0, 2))],
        [("z", "q", at(40))],
        [("z", "q", at(41)), ("b", "x", at(2))],
        [("b", "y", at(42))],
    ]
    rows = run(spark, tmp_path, batches, "record string, version string, time timestamp", lambda s: histories.histories(s, "record", "version", "time", delay="2 days", quiet_seconds=10 * 86_400))
    found = sorted((r.record, r.kind, r.version, r.was) for r in rows)
    assert found == [
        ("a", "changed", "v2", "v1"), ("a", "changed", "v9", "v2"), ("a", "first", "v1", None), ("a", "late", "v0", "v2"), ("a", "quiet", "v1", None), ("a", "went back", "v1", "v9"),
        ("b", "first", "x", None), ("b", "first", "y", None), ("b", "quiet", "x", None), ("z", "first", "q", None),
    ]


def test_counts_of_windows(spark, tmp_path):
    at = lambda day: DAY + dt.timedelta(days=day)
    batches = [[("a", at(0)), ("a", at(0)), ("b", at(1))], [("a", at(20))], [("a", at(40))], [("a", at(0)), ("a", at(60))]]  # late ones are told by the watermark of the batch before
    rows = run(spark, tmp_path, batches, "kind string, time timestamp", lambda s: arrivals.counts_by_window(s, "time", "kind", "7 days", "3 days"))
    counts = {(r.start, r.kind): r.n for r in rows}
    assert sum(n for (_, k), n in counts.items() if k == "a") == 4 and sum(n for (_, k), n in counts.items() if k == "b") == 1
