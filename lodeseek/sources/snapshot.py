"""Snapshots: a folder of versions, each a folder of Parquet tables with a manifest written last, and a pointer to the one that holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMAT, VERSION = "lodeseek-collection", 2


class SnapshotError(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return None
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8", "replace")
    finally:
        source.close()


def save(tables: dict[str, DataFrame], path: str, config: dict) -> None:
    """Write a new version beside those present, then switch the pointer, one small file. Until then a reader sees the old version, also
    when the writer dies; the old versions are removed afterwards."""
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    manifest = {"format": FORMAT, "version": VERSION, "tables": sorted(tables), "config": config}
    _write_text(spark, f"{path}/{version}/manifest.json", json.dumps(manifest))
    # written aside and renamed over the old pointer, which file systems of Hadoop do in one step
    _write_text(spark, f"{path}/CURRENT.new", version)
    fs, fresh = _fs(spark, f"{path}/CURRENT.new")
    fresh = fs.makeQualified(fresh)
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, fs.makeQualified(_fs(spark, f"{path}/CURRENT")[1]), options)
    fs, folder = _fs(spark, path)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version-") and name != version:
            fs.delete(status.getPath(), True)


def root(spark: SparkSession, path: str) -> str:
    """The folder of the version that holds."""
    name = _read_text(spark, f"{path.rstrip('/')}/CURRENT")
    if name is None:
        raise SnapshotError(f"no snapshot in {path}")
    return f"{path.rstrip('/')}/{name.strip()}"


def manifest(spark: SparkSession, path: str) -> dict:
    text = _read_text(spark, f"{root(spark, path)}/manifest.json")
    if text is None:
        raise SnapshotError(f"no manifest in {path}")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SnapshotError("the manifest is broken") from e
    if not isinstance(found, dict) or found.get("format") != FORMAT:
        raise SnapshotError("this is no snapshot of a collection")
    if found.get("version") != VERSION:
        raise SnapshotError(f"unsupported version {found.get('version')}")
    base = root(spark, path)
    for name in found.get("tables", []):
        fs, p = _fs(spark, f"{base}/{name}/_SUCCESS")
        if not fs.exists(p):
            raise SnapshotError(f"table {name} is missing or incomplete")
    return found


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    found = manifest(spark, path)
    base = root(spark, path)
    return {name: spark.read.parquet(f"{base}/{name}") for name in found["tables"]}, found["config"]
