"""Recall, percentiles and timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lodeseek.operators.topk import positions
from lodeseek.session import cut


def recall(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, matches, wanted, recall) for each query of truth."""
    wanted = truth.groupBy("query_id").agg(F.count("*").alias("wanted"))
    found = hits.join(truth.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("matches"))
    out = wanted.join(found, "query_id", "left").select("query_id", F.coalesce("matches", F.lit(0)).alias("matches"), "wanted")
    return out.withColumn("recall", F.col("matches") / F.greatest("wanted", F.lit(1)))


def mean_recall(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return recall(hits, truth).agg(F.round(F.avg("recall"), 6).alias("recall"))


def percentile_rank(df: DataFrame, value: str, fractions: list[float], by: list[str]) -> DataFrame:
    """sorted[round(p * (n - 1))] without interpolation, one row a group and fraction.

    Values are counted first, so a group shrinks to its distinct values; these are cumulated in ranges, so a group of any size spreads over tasks.
    """
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c")))
    sizes = counted.groupBy(*by).agg(F.sum("__c").alias("__n"))
    upto = positions(counted, by, [(value, True)], "__prior", weight="__c")
    groups = sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "__n", F.explode(F.array(*[F.lit(float(p)) for p in fractions])).alias("p"))
    groups = groups.withColumn("__pos", F.round(F.col("p") * (F.col("__n") - 1)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], F.lit(True))
    hit = upto.join(groups, same & (F.col("__prior") <= F.col("__pos")) & (F.col("__pos") < F.col("__prior") + F.col("__c")))
    return hit.select(*by, "p", F.col(value).alias("value"))


def latencies(df: DataFrame, micros: str, by: list[str]) -> DataFrame:
    """(by.., queries, mean_us, qps, p50, p95, p99) of times in microseconds, one row a group of at most a few."""
    parts = percentile_rank(df, micros, [0.5, 0.95, 0.99], by).groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    means = df.where(F.col(micros).isNotNull()).groupBy(*by).agg(F.count("*").alias("queries"), F.avg(micros).alias("mean_us"), (F.lit(1e6) * F.count("*") / F.sum(micros)).alias("qps"))
    return means.join(parts, by)


def index_stats(docs: DataFrame, bytes_per_component: int = 4) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(F.sum(F.size("v") * bytes_per_component), F.lit(0)).alias("vector_bytes"))
