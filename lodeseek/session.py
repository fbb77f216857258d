"""Session helpers: local test sessions, table reading, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeseek")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a session on this machine alone may go without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "lodeseek-shared")


#: Folders below the shared one that this process has written and not yet given back.
_WRITTEN: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A path of its own below the shared folder, removed by release()."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def release() -> None:
    """Remove what scratch() gave out. Frames that read it can't be used afterwards. Called when the process ends; a long session may call it between jobs."""
    while _TABLES:
        spark, name = _TABLES.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001
            pass
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  a session that has ended can't reach the folder any more
            pass


atexit.register(release)


def stored(df: DataFrame, buckets: int = 0, by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder as a Parquet table and read again: columns compressed, so for wide or repetitive rows smaller than a
    checkpoint. With buckets the table is laid out by the hash of `by`, and a group-by or join on these columns needs no shuffle of it."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    writer = df.write.format("parquet").option("path", path)
    if not buckets:
        writer.save()
        return spark.read.schema(df.schema).parquet(path)
    name = f"lodeseek_{uuid.uuid4().hex}"
    writer.bucketBy(buckets, *by).saveAsTable(name)
    _TABLES.append((spark, name))
    return spark.table(name)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder, so that later stages survive the loss of any executor. The layout of its partitions stays known."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
