"""Corpus scan and vector cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_corpus(spark: SparkSession, path: str, docs: int | None = None) -> DataFrame:
    """Texts of a JSON array of objects; objects without a string `text` are passed over. `docs` stops after so many."""
    found = spark.read.schema("text string").json(path, multiLine=True).where(F.col("text").isNotNull())
    return found if docs is None else found.limit(docs)


def cached_vectors(df: DataFrame, path: str, make, rebuild: bool = False) -> DataFrame:
    """make(df) written to path, or what lies there already."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    if rebuild or not there:
        make(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
