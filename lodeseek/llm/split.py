"""Splitting oversized items at natural boundaries: dynamic programming over boundary positions.

A state is the start of a piece, an edge a permitted end: every boundary in the upper half of the window, and the hard cut. Edges cost by the kind of
the cut and by the piece's deviation from full size. Objective "balanced" minimises the sum over the whole text; "leading" minimises the costs in
order, first piece first, each cost being (kind, slack). There a table holds the best edge of every state that a boundary leads to: no two
edges of a state cost the same, so the first one settles the comparison and what follows need not be compared.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFAULT_LENGTH, DEFAULT_OVERLAP = 512, 0
#: Penalty of a cut at a blank line, a sentence end, white space, and within a word, in shares of a full piece's imbalance.
PENALTIES = (0.0, 0.1, 0.4, 2.0)

_BLANK = re.compile(r"\n[ \t\r]*(?=\n)")
_SENTENCE = re.compile(r"[.!?](?=[ \t\r\n])|[。！？]")
_SPACE = re.compile(r"[ \t\r\n]")


def boundaries(text: str) -> list[np.ndarray]:
    """Ends just after a blank line's line feed, a sentence, white space: three sorted arrays of offsets in code points."""
    blank = [m.end() + 1 for m in _BLANK.finditer(text)]
    return [np.array(blank, dtype=np.int64), np.array([m.end() for m in _SENTENCE.finditer(text)], dtype=np.int64), np.array([m.end() for m in _SPACE.finditer(text)], dtype=np.int64)]


def _best_ends(starts: np.ndarray, ends: list[np.ndarray], limit: int) -> np.ndarray:
    """For each state the end of its cheapest edge by (kind, slack) among all boundaries in (s + limit / 2, s + limit] and the hard cut."""
    best = starts + limit
    for kind in reversed(ends):
        if len(kind):
            at = np.searchsorted(kind, starts + limit, side="right") - 1
            e = kind[np.maximum(at, 0)]
            best = np.where((at >= 0) & (2 * (e - starts) > limit), e, best)
    return best


def _leading(n: int, ends: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    starts = np.unique(np.concatenate([np.zeros(1, np.int64), *[b - overlap for b in ends]]))
    starts = starts[(starts >= 0) & (starts < n - limit)]
    table = dict(zip(starts.tolist(), _best_ends(starts, ends, limit).tolist()))
    pieces, s = [], 0
    while n - s > limit:
        # a hard cut leads to a state of its own
        e = table[s] if s in table else int(_best_ends(np.array([s]), ends, limit)[0])
        pieces.append((s, e))
        s = max(e - overlap, s + 1)
    return [*pieces, (s, n)]


def _balanced(n: int, ends: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Cheapest chain from 0 to n, exactly. Edges of a state: every boundary in its window, and the hard cut. A boundary of several kinds
    counts as the cheapest."""
    at = np.concatenate(ends[::-1])
    at, first = np.unique(at[::-1], return_index=True)
    penalty = np.repeat(PENALTIES[:3][::-1], [len(x) for x in ends[::-1]])[::-1][first]
    penalty, at = penalty[at <= n], at[at <= n]
    # numbers of the boundaries up to each offset
    upto = np.searchsorted(at, np.arange(n + 1), side="right").tolist()
    cost, come, stop = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    cost[0] = 0.0
    # the slack of each possible length
    slack = (1 - np.arange(limit + 1) / limit) ** 2
    for s in range(n - limit):
        c = cost[s]
        if c == np.inf:
            continue
        low, high = upto[s + limit // 2], upto[s + limit]
        e = at[low:high]
        total = c + penalty[low:high] + slack[e - s]
        t = np.maximum(e - overlap, s + 1)
        better = np.nonzero(total < cost[t])[0]
        if 2 * overlap > limit:
            # several ends may lead to one start: the cheapest is written last
            better = better[np.argsort(-total[better], kind="stable")]
        t = t[better]
        cost[t], come[t], stop[t] = total[better], s, e[better]
        t = max(s + limit - overlap, s + 1)
        if c + PENALTIES[3] < cost[t]:
            cost[t], come[t], stop[t] = c + PENALTIES[3], s, s + limit
    last = np.arange(n - limit, n)
    s = int(last[np.argmin(cost[n - limit : n] + slack[n - last])])
    pieces = [(s, n)]
    while s:
        pieces.append((int(come[s]), int(stop[s])))
        s = int(come[s])
    return pieces[::-1]


def pieces(text: str, limit: int, overlap: int = 0, objective: str = "leading") -> list[tuple[int, int]]:
    """(start, end) of each piece in code points; none for a text within the limit. An overlap of more than half of the limit may not let a piece
    move on; it then starts one character after the one before. A limit below 1 counts as 1, a negative overlap as none."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return []
    return (_leading if objective == "leading" else _balanced)(len(text), boundaries(text), limit, overlap)


def split(docs: DataFrame, config: DataFrame, objective: str = "leading", key: str = "node_id") -> DataFrame:
    """(key, start_pos, end_pos) for the pieces of each text longer than its collection's limit.

    Null limits mean 512, null overlaps and unknown collections no overlap. Null keys and texts give no rows. Repeated rows count
    once: the latest added_at holds (equal times: the longer, then by content). Texts never travel: the pieces are
    found beside the scan, and only offsets are shuffled. config is one row a collection and is broadcast up to Spark's size limit.
    """
    limits = config.where("coll is not null").groupBy("coll").agg(F.max("max_len").alias("__limit"), F.max("overlap_len").alias("__overlap"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), "coll", "text", "added_at").join(limits, "coll", "left")
    rows = rows.select("__key", "text", "added_at", F.coalesce("__limit", F.lit(DEFAULT_LENGTH)).cast("int").alias("limit"), F.coalesce("__overlap", F.lit(DEFAULT_OVERLAP)).cast("int").alias("overlap"))

    def run(batches):
        for b in batches:
            cuts = [pieces(t or "", n, o, objective) for t, n, o in zip(b["text"].to_pylist(), b["limit"].to_pylist(), b["overlap"].to_pylist())]
            flat = pa.array([[x for p in c for x in p] for c in cuts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["__key"], b["added_at"], b["size"], b["hash"], flat], ["key", "at", "size", "hash", "cuts"])

    kind = docs.schema[key].dataType.simpleString()
    size = F.coalesce(F.length("text"), F.lit(-1))
    rows = rows.select("__key", F.when(size > F.col("limit"), F.col("text")).alias("text"), "added_at", "limit", "overlap", size.alias("size"), F.xxhash64("text").alias("hash"))
    found = rows.mapInArrow(run, f"key {kind}, at timestamp, size int, hash long, cuts array<int>")
    held = found.groupBy("key").agg(F.max(F.struct("at", "size", "hash", "cuts")).alias("m")).where(F.size("m.cuts") > 0)
    cut = held.select("key", F.explode(F.sequence(F.lit(1), F.size("m.cuts"), F.lit(2))).alias("i"), F.col("m.cuts").alias("cuts"))
    return cut.select(F.col("key").alias(key), F.element_at("cuts", F.col("i")).alias("start_pos"), F.element_at("cuts", F.col("i") + 1).alias("end_pos"))
