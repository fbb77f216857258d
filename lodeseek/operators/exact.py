"""Exact query-by-document top-k: as Catalyst expressions, or as blocked matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.functions.vectors import distance, parse_metric
from lodeseek.operators.topk import top_k

#: A query set of at most so many bytes (as doubles) travels with the tasks; a larger one is split in blocks.
QUERY_BYTES = 32 << 20
#: Distances held at a time (64 MB), and documents of one block of them.
PRODUCTS, DOC_ROWS = 8_000_000, 8_192
HITS = "query_id long, node_id long, dist double"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a dense float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    if len(array) == 0:
        return np.zeros((0, 0))
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def distances(metric: str, queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    products = queries @ docs.T
    if metric == "dot":
        return 1.0 - products
    return np.maximum((queries * queries).sum(1)[:, None] + (docs * docs).sum(1)[None, :] - 2 * products, 0.0)


def best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k nearest, ties at 9 decimals by smaller id."""
    keyed = np.round(dist, 9)
    if keyed.shape[1] > k:
        edge = np.partition(keyed, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(keyed <= edge[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(keyed, dtype=bool))
    order = np.lexsort((ids[cols], keyed[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def nearest_rows(metric: str, k: int, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, document row, distance) of each query's k nearest documents; score(queries, docs) replaces the metric, an infinite one drops the
    pair. However many there are, at most about PRODUCTS distances are held at a time."""
    score = score or (lambda a, b: distances(metric, a, b))
    out = []
    width = max(1, min(len(docs), DOC_ROWS))
    step = max(1, PRODUCTS // width)
    for q in range(0, len(queries), step):
        found = []
        for at in range(0, len(docs), width):
            dist = score(queries[q : q + step], docs[at : at + width])
            rows, cols = best(dist, ids[at : at + width], k)
            d = dist[rows, cols]
            good = np.isfinite(d)
            found.append((rows[good] + q, cols[good] + at, d[good]))
        rows, cols, d = (np.concatenate(c) for c in zip(*found))
        if len(found) > 1:
            order = np.lexsort((ids[cols], np.round(d, 9), rows))
            rows, cols, d = rows[order], cols[order], d[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols, d = rows[keep], cols[keep], d[keep]
        out.append((rows, cols, d))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _batch(metric: str, k: int, qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    rows, cols, dist = nearest_rows(metric, k, queries, ids, docs)
    return pa.RecordBatch.from_arrays([pa.array(qids[rows], pa.int64()), pa.array(ids[cols], pa.int64()), pa.array(dist)], ["query_id", "node_id", "dist"])


def query_blocks(queries: DataFrame, most: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries(query_id, v) in blocks of about `most` bytes; counted before any of them comes to the driver."""
    queries = queries.select(F.col("query_id").cast("long"), "v").where("v is not null")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = -(-size["n"] * 8 * max(size["d"] or 1, 1) // most)
    for i in range(blocks):
        block = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).orderBy("query_id").toArrow()
        if block.num_rows:
            yield np.asarray(block["query_id"]), matrix(block["v"])


def exact_top_k(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", where: Column | None = None, query_bytes: int = QUERY_BYTES, doc_block: int = 100_000) -> DataFrame:
    """(query_id, rank, node_id, dist): the k nearest documents of each query, ties at 9 decimals by node_id.

    docs(node_id, v), queries(query_id, v); `where` filters docs before scoring. Vectors must be free of nulls
    and of one length. The query set is counted: up to query_bytes it travels with the tasks and documents
    are only scanned; beyond, queries and documents meet in a grid of blocks, each task holding one block
    of either. k < 1 or an empty side gives no rows.
    """
    parse_metric(metric)
    spark = docs.sparkSession
    docs = (docs if where is None else docs.where(where)).select(F.col("node_id").cast("long"), "v").where("v is not null")
    queries = queries.select(F.col("query_id").cast("long"), "v").where("v is not null")
    if k < 1:
        return spark.createDataFrame([], "query_id long, rank int, node_id long, dist double")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, node_id long, dist double")
    per_block = max(1, query_bytes // (8 * size["d"]))
    if size["n"] <= per_block:
        block = queries.orderBy("query_id").toArrow()
        qids, qs = np.asarray(block["query_id"]), matrix(block["v"])

        def scan(batches):
            for b in batches:
                if b.num_rows:
                    yield _batch(metric, k, qids, qs, np.asarray(b["node_id"]), matrix(b["v"]))

        scored = docs.mapInArrow(scan, HITS)
    else:
        n_docs = docs.count()
        nq, nd = -(-size["n"] // per_block), max(1, -(-n_docs // doc_block))
        left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("long").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("db"), F.col("query_id").alias("qid"), F.col("v").alias("qv"))
        right = docs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("node_id"), F.lit(nd)).cast("int").alias("db"), F.col("node_id").alias("did"), F.col("v").alias("dv"))

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "node_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
            return pa.Table.from_batches([_batch(metric, k, np.asarray(a["qid"]), matrix(a["qv"]), np.asarray(b["did"]), matrix(b["dv"]))])

        scored = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(cell, HITS)
    return top_k(scored, ["query_id"], [F.round("dist", 9), F.col("node_id")], k).select("query_id", "rank", "node_id", "dist")


def native_top_k(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """The same result as Catalyst expressions only. The join is a nested loop over the queries, which are broadcast, so more than QUERY_BYTES of them
    are refused."""
    size = queries.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    if size * 8 > QUERY_BYTES:
        raise ValueError("too many queries to broadcast; use exact_top_k")
    pairs = docs.select("node_id", F.col("v").alias("dv")).crossJoin(F.broadcast(queries.select("query_id", F.col("v").alias("qv"))))
    scored = pairs.select("query_id", "node_id", distance(metric, F.col("qv"), F.col("dv")).alias("dist"))
    return top_k(scored, ["query_id"], [F.round("dist", 9), F.col("node_id")], k).select("query_id", "rank", "node_id", "dist")
