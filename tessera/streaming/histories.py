"""State per record in a stream: what each record's versions become as they arrive, late ones in their place, and when it falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "latest bigint, version string, seen array<string>"


def histories(stream: DataFrame, record: str, version: str, time: str, *, delay: str = "1 day", quiet_seconds: int = 30 * 86_400) -> DataFrame:
    """`record, time, version, was, kind` of each arrival of a stream that says something new: `first`, `changed`, `went back` to a version the record had before, or `late` where a newer one is
    known already; and `quiet`, once, when no version has come for the time given after the last.

    The same version again says nothing. A batch's arrivals of a record are taken in order of time, then version. A record's state is its last time and version and the versions it had; it goes when the record falls silent, and one that comes
    later begins anew. Arrivals further behind than the delay, and those without a record, version or time, are left out.
    """
    rows = stream.select(F.col(record).cast("string").alias("record"), F.col(version).cast("string").alias("version"), F.col(time).cast("timestamp").alias("time")).dropna()
    rows = rows.withWatermark("time", delay).withColumn("micros", F.unix_micros("time"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, held, seen = state.get if state.exists else (None, None, [])
        mark = state.getCurrentWatermarkMs()
        arrived = sorted((m, v) for b in batches for m, v in zip(b["micros"].tolist(), b["version"].tolist(), strict=True) if m >= mark * 1000)
        said, seen = [], list(seen)
        if latest is not None and latest // 1000 + quiet_seconds * 1000 <= mark:
            said.append((key[0], latest, held, None, "quiet"))
            latest, held, seen = None, None, []
        if latest is None and not arrived:
            if state.exists:
                state.remove()
            if said:
                yield _rows(said)
            return
        for micros, now in arrived:
            if latest is None:
                said.append((key[0], micros, now, None, "first"))
            elif micros < latest:
                if now not in seen:
                    said.append((key[0], micros, now, held, "late"))
            elif now != held:
                said.append((key[0], micros, now, held, "went back" if now in seen else "changed"))
            if latest is None or micros >= latest:
                latest, held = micros, now
            if now not in seen:
                seen.append(now)
        state.update((latest, held, seen))
        state.setTimeoutTimestamp(max(latest // 1000 + quiet_seconds * 1000, mark + 1))
        if said:
            yield _rows(said)

    out = "record string, micros bigint, version string, was string, kind string"
    found = rows.groupBy("record").applyInPandasWithState(update, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("record", F.timestamp_micros("micros").alias("time"), "version", "was", "kind")


def _rows(said: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(said, columns=["record", "micros", "version", "was", "kind"])
