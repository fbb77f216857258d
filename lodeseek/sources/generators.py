"""Seeded synthetic vectors; every row depends only on the seed and its id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = "node_id long, v array<float>"


def _generate(spark: SparkSession, n: int, dim: int, seed: int, center, partitions: int | None) -> DataFrame:
    def rows(batches):
        for b in batches:
            ids = np.asarray(b["id"])
            x = np.empty((len(ids), dim), dtype=np.float32)
            for i, node in enumerate(ids):
                x[i] = center(int(node), np.random.default_rng([seed, int(node)]).standard_normal(dim)) / np.sqrt(dim)
            v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], v], ["node_id", "v"])

    return spark.range(0, n, 1, partitions).mapInArrow(rows, ROWS)


def uniform(spark: SparkSession, n: int, dim: int, seed: int, partitions: int | None = None) -> DataFrame:
    """Gaussian components over sqrt(dim)."""
    return _generate(spark, n, dim, seed, lambda node, g: g, partitions)


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, seed: int, partitions: int | None = None, spread: float = 0.35) -> DataFrame:
    """Row i lies around center i mod clusters. Queries of the same data: ask for ids beyond n with another call's range."""
    centers = np.random.default_rng([seed, 1 << 40]).standard_normal((clusters, dim))
    return _generate(spark, n, dim, seed, lambda node, g: centers[node % clusters] + spread * g, partitions)
