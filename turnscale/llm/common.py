"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as characters to trim.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of texts that go to Python at once; a single longer text goes alone.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, in local mode alone, one of our own."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="turnscale-"))
        base = context.getCheckpointDir()
    return base


#: The paths that scratch has given out, for clear_scratch.
_GIVEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _GIVEN.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process's operators have put under the shared folder, and say how many paths that were.

    For when their results are written: a frame that reads such a table can't be computed after it.
    """
    count = len(_GIVEN)
    while _GIVEN:
        delete(spark, _GIVEN[-1])
    return count


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; this cuts its lineage."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As saved, and the path, for `delete` when a later table has taken its place."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _GIVEN:
        _GIVEN.remove(path)


def marked() -> int:
    """How many paths there are now: what comes later is what `delete_since` deletes."""
    return len(_GIVEN)


def delete_since(spark: SparkSession, mark: int, keep: list[DataFrame]) -> None:
    """Delete the tables written since the mark, but for those that a frame of keep reads; nothing else may read one."""
    read = [f for df in keep for f in df.inputFiles()]
    for path in list(_GIVEN[mark:]):
        plain = path.split(":", 1)[-1].replace("//", "/").rstrip("/")
        if not any(f"{plain}/" in f.replace("//", "/") for f in read):
            delete(spark, path)


def free_name(df: DataFrame, base: str) -> str:
    """A name that no column of df has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_BYTES: a batch of long texts would else take what 10,000 rows do.

    The setting is the session's, and stays; a smaller one is left as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: 128 bits, so that no two keys of any real corpus share both."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
