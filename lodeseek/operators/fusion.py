"""Weighted reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodeseek.operators.topk import top_k

RRF_K = 60


def contribution(weight: Column | float, rank: Column) -> Column:
    """weight / (60 + rank) with ranks from 1."""
    return F.lit(weight) / (F.lit(float(RRF_K)) + rank)


def fuse(lists: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """(query_id, rank, node_id, score) from lists (query_id, node_id, rank). A list of weight 0 still brings its nodes, with score 0."""
    both = None
    for ranked, weight in lists:
        part = ranked.select("query_id", "node_id", contribution(float(weight), F.col("rank")).alias("w"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy("query_id", "node_id").agg(F.round(F.sum("w"), 9).alias("score"))
    return top_k(fused, ["query_id"], [F.col("score").desc(), F.col("node_id")], k).select("query_id", "rank", "node_id", "score")


def rerank(ranked: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Keep the nodes of `allowed`, then number the rest anew from 1."""
    if allowed is None:
        return ranked
    kept = ranked.join(allowed.select("node_id"), "node_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def fetch_size(k: int, n: int, filtered: bool) -> int:
    """Candidates to draw from each list: four times k, at least 16, four times that under a filter, at most n."""
    fetch = max(16, 4 * k)
    return min(4 * fetch if filtered else fetch, n)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Fuse vector and keyword candidates with weights alpha and 1 - alpha. A filter is applied to both lists before ranks are given."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must lie in 0..1")
    return fuse([(rerank(vector_hits, allowed), alpha), (rerank(keyword_hits, allowed), 1.0 - alpha)], k)
