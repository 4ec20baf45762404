"""Sinks: tables, and feeds of snapshots that have changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Write a Parquet table. An overwrite is written beside the table and then takes its place, so that a table may be
    made from itself, and a failed write leaves the old one. Between its two renames a reader finds no table:
    turnscale.sources.versions.write_version makes tables that are always there."""
    if mode == "append":
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
        return
    if mode != "overwrite":
        raise ValueError("mode is overwrite or append")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    files = target.getFileSystem(conf)
    df.write.partitionBy(*partition_by).parquet(staged.toString())
    there = files.exists(target)
    if there and not files.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not files.rename(staged, target):
        raise OSError(f"can't move the new table to {path}")
    if there:
        files.delete(old, True)


def fingerprint(row: DataFrame) -> str:
    """MD5 of a one-row frame as JSON with sorted keys."""
    return row.select(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(row.columns)])))).head()[0]


def write_change_feed(snapshot: Callable[[], DataFrame], emit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that emits the snapshot, a frame of one row, when it isn't what was emitted last."""
    last: list[str] = []

    def on_batch(_: DataFrame, __: int) -> None:
        row = snapshot()
        if last[-1:] != [mark := fingerprint(row)]:
            last[:] = [mark]
            emit(row)

    return on_batch
