"""Sessions and shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veladura")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what is started inside, put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# Parquet keeps no statistics of times in Spark's default format, so no search by time could skip anything
TIMES_WITH_STATISTICS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where tables that other tasks must be able to read may be written.

    The folder that the cluster names in ``spark.checkpoint.dir``; where that is
    unset, a temporary one, but only if all tasks run on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.conf.get("spark.app.id")
    if application not in _own_folder:
        _own_folder[application] = tempfile.mkdtemp(prefix="veladura-")
    return _own_folder[application]


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path for a table that later steps read; ``delete_scratch`` removes them all."""
    _made.append(f"{shared_folder(spark)}/veladura/{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def delete_scratch(spark: SparkSession) -> None:
    """Remove what was written under fresh paths so far.  Nothing may still read it.

    Such tables may hold personal data in clear; call this when a job's result is stored.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _made:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under a fresh path and read it again: computed once, and lineage ends here."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
