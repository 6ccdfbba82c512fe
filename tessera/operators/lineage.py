"""Cutting lineage in iterative operators with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the session's `spark.checkpoint.dir`.

    Only a local session may name none; it gets a temporary one. On a cluster that is an error, as executors don't share the driver's disk.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: a plan of one scan, whatever made them. `forget` deletes them."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Delete what `stored` wrote for these; nothing may read them afterwards."""
    for df in tables:
        if df is None or not (path := df.__dict__.get("_stored_at")):
            continue
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, the wish itself if it is free."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
