"""The benchmark of vector searches: build rate, then recall, throughput and time a query for each way and beam width."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeseek.operators import evaluate, exact, graph, quantized
from lodeseek.session import stored
from lodeseek.sources import generators


def sweep(spark: SparkSession, n: int, dim: int, queries: int, k: int = 10, efs: tuple[int, ...] = (32, 128), filtered: int = 20, seed: int = 7, shard_rows: int = 20_000) -> dict:
    """{"build": .., "runs": [..]}: seeded clustered vectors, `queries` of them asked as one batch. Times are of the second of two runs, which stores its hits;
    a run's mean time a query is that of the batch over its size. filtered: a further run at the widest beam among ids with id % 100 < filtered."""
    docs = stored(generators.clustered(spark, n, dim, max(1, n // 200), seed))
    asked = stored(docs.where(F.pmod(F.xxhash64("node_id"), F.lit(max(1, n // queries))) == 0).select(F.col("node_id").alias("query_id"), "v"))
    count = asked.count()
    config = graph.GraphConfig(m=16, ef_construction=128, shard_rows=shard_rows)
    began = time.time()
    packed = stored(graph.build_packed(docs, config))
    build = {"nodes": n, "graph_seconds": round(time.time() - began, 2), "graph_docs_per_second": round(n / (time.time() - began))}
    began = time.time()
    qrange = quantized.calibrate(docs).first()["qrange"]
    tier = stored(quantized.build_tier(docs, qrange))
    build["codes_seconds"] = round(time.time() - began, 2)
    some = docs.where(F.col("node_id") % 100 < filtered)
    truth = stored(exact.exact_top_k(docs, asked, k))
    truth_some = stored(exact.exact_top_k(some, asked, k))
    ways: list[tuple[str, int, DataFrame, DataFrame]] = [("exact", 0, exact.exact_top_k(docs, asked, k), truth)]
    ways += [("codes", ef, quantized.tier_top_k(tier, docs, asked, k, ef, qrange), truth) for ef in efs]
    ways += [("graph", ef, graph.search_packed(packed, asked, k, ef, config), truth) for ef in efs]
    ways.append((f"graph, {filtered} % allowed", efs[-1], graph.search_packed(packed, asked, k, efs[-1], config, some), truth_some))
    runs = []
    for way, ef, df, want in ways:
        df.write.format("noop").mode("overwrite").save()
        began = time.time()
        found = stored(df)
        took = time.time() - began
        runs.append({"way": way, "ef": ef, "queries": count, "seconds": round(took, 3), "ms_per_query": round(1000 * took / count, 3), "qps": round(count / took), "recall": evaluate.mean_recall(found, want).first()["recall"]})
    return {"build": build, "runs": runs}


def live(collection, texts: list[str], k: int = 5, efs: tuple[int, ...] = (32, 128), warm: int = 3, rounds: int = 10, mode: str = "graph") -> list[dict]:
    """One text a search, as a caller sees it: for each beam width the recall against the exact search, taken from the first round, and percentiles, mean
    and rate of the measured times after `warm` rounds. A Spark job a query: for latency, not for throughput."""
    asked = list(enumerate(texts))
    ids = lambda found: {r["id"] for r in found}
    truth = {i: ids(collection.search(t, k, mode="exact")) for i, t in asked}
    out = []
    for ef in efs:
        times, hit = [], 0
        for turn in range(warm + rounds):
            for i, t in asked:
                began = time.perf_counter()
                found = collection.search(t, k, ef=ef, mode=mode)
                if turn >= warm:
                    times.append((time.perf_counter() - began) * 1e6)
                if turn == 0:
                    hit += len(ids(found) & truth[i]) / max(len(truth[i]), 1)
        about = evaluate.latencies(collection.spark.createDataFrame([("e2e", t) for t in times], "way string, us double"), "us", ["way"]).first().asDict()
        out.append({"ef": ef, "recall": round(hit / max(len(asked), 1), 4), **{c: about[c] for c in ("queries", "mean_us", "qps", "p50", "p95", "p99")}})
    return out
