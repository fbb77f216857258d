"""Scan cascade: sign bits, then int8 codes, then full precision of the candidates only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.functions.vectors import HAMMING_LIMIT, distance, hyperplanes, max_abs, pack_signs, parse_metric, popcount, quantize
from lodeseek.operators.exact import HITS, matrix, nearest_rows, query_blocks
from lodeseek.operators.topk import top_k

SIGNATURE_SEED = 20_111
#: Pairs whose vectors are gathered at once.
GATHER = 200_000


def calibrate(docs: DataFrame, v: str = "v") -> DataFrame:
    """One row (qrange): the largest absolute component, at least 1e-9."""
    return docs.agg(F.greatest(F.coalesce(F.max(max_abs(F.col(v))), F.lit(1e-9)), F.lit(1e-9)).alias("qrange"))


def with_codes(docs: DataFrame, qrange: float, v: str = "v", out: str = "code") -> DataFrame:
    return docs.withColumn(out, quantize(F.col(v), qrange).cast("array<tinyint>"))


def with_signatures(docs: DataFrame, seed: int = SIGNATURE_SEED) -> DataFrame:
    """docs(node_id, v) plus sig ARRAY<BIGINT>: 256 sign bits in four lanes."""

    def sign(batches):
        planes = None
        for b in batches:
            if b.num_rows:
                x = matrix(b["v"])
                planes = hyperplanes(seed, x.shape[1]) if planes is None else planes
                lanes = pack_signs(x, planes)
                sig = pa.ListArray.from_arrays(np.arange(0, 4 * len(x) + 1, 4, dtype=np.int32), pa.array(lanes.ravel()))
                yield pa.RecordBatch.from_arrays([b["node_id"], b["v"], sig], ["node_id", "v", "sig"])

    return docs.select("node_id", "v").mapInArrow(sign, "node_id long, v array<float>, sig array<bigint>")


def _codes(x: np.ndarray, qrange: float) -> np.ndarray:
    return np.clip(np.floor(np.abs(x) * (127.0 / qrange) + 0.5) * np.sign(x), -127, 127)


def build_tier(docs: DataFrame, qrange: float, seed: int = SIGNATURE_SEED, planes: np.ndarray | None = None) -> DataFrame:
    """(node_id, code BINARY, sig BINARY) of docs(node_id, v): a byte a component, and the sign bits. To be stored; a search reads a quarter
    of the vectors' bytes."""

    def run(batches):
        side = planes
        for b in batches:
            if b.num_rows:
                x = matrix(b["v"])
                side = hyperplanes(seed, x.shape[1]) if side is None else side
                code = np.nan_to_num(_codes(x, qrange)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b["node_id"], pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in pack_signs(x, side)], pa.binary())], ["node_id", "code", "sig"])

    return docs.select(F.col("node_id").cast("long"), "v").where("v is not null").mapInArrow(run, "node_id long, code binary, sig binary")


def _tier_score(metric: str, qrange: float, prefilter: bool, limit: int) -> Callable:
    """Distance of queries (code, signature) to documents (code, signature), infinite beyond the limit of differing signs."""
    scale = (qrange / 127.0) ** 2

    def score(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        # products of codes stay below 2 ** 24 up to 1,040 dimensions, so single precision is exact there
        kind = np.float32 if q["code"].shape[1] <= 1_040 else np.float64
        a, b = q["code"].astype(kind), d["code"].astype(kind)
        if prefilter:
            bits = sum(popcount(q["sig"][:, None, i] ^ d["sig"][None, :, i]) for i in range(q["sig"].shape[1]))
            near = bits <= limit
            if near.mean() < 0.05:
                # few are left: only their products are taken
                i, j = np.nonzero(near)
                out = np.full(near.shape, np.inf)
                out[i, j] = 1.0 - (a[i] * b[j]).sum(1, dtype=np.float64) * scale if metric == "dot" else ((a[i] - b[j]) ** 2).sum(1, dtype=np.float64) * scale
                return out
        product = (a @ b.T).astype(np.float64)
        if metric == "dot":
            out = 1.0 - product * scale
        else:
            out = ((a.astype(np.float64) ** 2).sum(1)[:, None] + (b.astype(np.float64) ** 2).sum(1)[None, :] - 2 * product) * scale
        return np.where(near, out, np.inf) if prefilter else out

    return score


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column of one width, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def _records(code: np.ndarray, sig: np.ndarray) -> np.ndarray:
    out = np.empty(len(code), dtype=[("code", np.int8, (code.shape[1],)), ("sig", np.int64, (sig.shape[1],))])
    out["code"], out["sig"] = code, sig
    return out


def tier_top_k(tier: DataFrame, docs: DataFrame | None, queries: DataFrame, k: int, ef: int, qrange: float, metric: str = "dot", prefilter: bool = False, seed: int = SIGNATURE_SEED, planes: np.ndarray | None = None, limit: int = HAMMING_LIMIT) -> DataFrame:
    """(query_id, rank, node_id, dist): the ef nearest codes of a stored tier for each query, then, if docs(node_id, v) is given, the k best of them in full
    precision; only those vectors are fetched. Without docs the int8 distances rank.

    prefilter drops documents whose sign bits differ from the query's in more than `limit` places before any distance is taken. Queries travel with
    the tasks in blocks of QUERY_BYTES; equal distances (9 decimals) go by node_id.
    """
    parse_metric(metric)
    ef = max(ef, k) if docs is not None else k
    score = _tier_score(metric, qrange, prefilter, limit)
    found, asked = None, queries.select(F.col("query_id").cast("long"), "v").where("v is not null")
    for qids, qs in query_blocks(queries) if k > 0 else ():
        side = hyperplanes(seed, qs.shape[1]) if planes is None else planes
        mine = _records(np.nan_to_num(_codes(qs, qrange)).astype(np.int8), pack_signs(qs, side))

        def scan(batches, qids=qids, mine=mine):
            for b in batches:
                if b.num_rows:
                    ids = np.asarray(b["node_id"])
                    stored = _records(_fixed(b["code"], np.int8), _fixed(b["sig"], np.int64))
                    rows, cols, near = nearest_rows(metric, ef, mine, ids, stored, score)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(ids[cols]), pa.array(near)], ["query_id", "node_id", "dist"])

        part = tier.select("node_id", "code", "sig").mapInArrow(scan, HITS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return tier.sparkSession.createDataFrame([], "query_id long, rank int, node_id long, dist double")
    order = [F.round("dist", 9), F.col("node_id")]
    kept = top_k(found, ["query_id"], order, ef)
    if docs is None:
        return kept.select("query_id", "rank", "node_id", "dist")
    full = kept.select("query_id", "node_id").join(asked.select("query_id", F.col("v").alias("qv")), "query_id").join(docs.select(F.col("node_id").cast("long"), "v"), "node_id")
    return top_k(full.select("query_id", "node_id", distance(metric, F.col("qv"), F.col("v")).alias("dist")), ["query_id"], order, k).select("query_id", "rank", "node_id", "dist")


def cascade_top_k(docs: DataFrame, queries: DataFrame, k: int, ef: int, metric: str = "dot", qrange: float | None = None, rerank: bool = True, prefilter: bool = False, seed: int = SIGNATURE_SEED, planes: np.ndarray | None = None, limit: int = HAMMING_LIMIT) -> DataFrame:
    """The same of docs(node_id, v) without a stored tier: codes and signs are made in passing, qrange is calibrated on docs when not given."""
    if qrange is None:
        qrange = calibrate(docs).first()["qrange"]
    docs = docs.where("v is not null")
    return tier_top_k(build_tier(docs, qrange, seed, planes), docs if rerank else None, queries, k, ef, qrange, metric, prefilter, seed, planes, limit)


def signed_top_k(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", seed: int = SIGNATURE_SEED, planes: np.ndarray | None = None, limit: int = HAMMING_LIMIT) -> DataFrame:
    """(query_id, rank, node_id, dist): the k nearest in full precision among the documents whose signs differ from the query's in at most `limit`
    places. Each block of documents keeps k rows a query."""
    parse_metric(metric)

    def records(x: np.ndarray) -> np.ndarray:
        sig = pack_signs(x, hyperplanes(seed, x.shape[1]) if planes is None else planes)
        out = np.empty(len(x), dtype=[("x", np.float64, (x.shape[1],)), ("sig", np.int64, (sig.shape[1],))])
        out["x"], out["sig"] = x, sig
        return out

    def score(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        bits = sum(popcount(q["sig"][:, None, i] ^ d["sig"][None, :, i]) for i in range(q["sig"].shape[1]))
        i, j = np.nonzero(bits <= limit)
        out = np.full(bits.shape, np.inf)
        for at in range(0, len(i), GATHER):
            a, b = i[at : at + GATHER], j[at : at + GATHER]
            x, y = q["x"][a], d["x"][b]
            out[a, b] = 1.0 - np.einsum("ij,ij->i", x, y) if metric == "dot" else ((x - y) ** 2).sum(1)
        return out

    found = None
    for qids, qs in query_blocks(queries) if k > 0 else ():
        mine = records(qs)

        def scan(batches, qids=qids, mine=mine):
            for b in batches:
                if b.num_rows:
                    ids = np.asarray(b["node_id"])
                    rows, cols, dist = nearest_rows(metric, k, mine, ids, records(matrix(b["v"])), score)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(ids[cols]), pa.array(dist)], ["query_id", "node_id", "dist"])

        part = docs.select(F.col("node_id").cast("long"), "v").where("v is not null").mapInArrow(scan, HITS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, node_id long, dist double")
    return top_k(found, ["query_id"], [F.round("dist", 9), F.col("node_id")], k).select("query_id", "rank", "node_id", "dist")
