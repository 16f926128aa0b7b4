"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: str | None = None


def build_session(app: str = "pairloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of its own: on a cluster the executors
    could not see it, so an unset folder is an error there.
    """
    global _LOCAL_FOLDER
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _LOCAL_FOLDER is None:
            _LOCAL_FOLDER = tempfile.mkdtemp(prefix="pairloom-")
        base = _LOCAL_FOLDER
    return f"{_scratch(base, spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(base: str, spark: SparkSession) -> str:
    return f"{base.rstrip('/')}/pairloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of `shared_path` that nothing will read again."""
    _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by `materialise` that nothing will read again."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            _delete(table.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application has written below the shared folder.

    Results that are not yet computed may still need it: call this when a job is done.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_FOLDER
    if base:
        _delete(spark, _scratch(base, spark))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver
    happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(
    df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    A written table survives lost executors, cuts the lineage, and later reads still prune
    columns and partitions. `discard` deletes it, `clear_scratch` all of them. What was
    shuffled to write it is deleted at once.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", compression) if compression else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table
