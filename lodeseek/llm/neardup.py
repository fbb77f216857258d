"""Near-duplicate records: a chosen-path set similarity join.

Records are sets of distinct terms. Each tree starts with all records in one node and branches a node by a minwise token
that the node itself draws: records go on together if they agree in it. Nodes that have become small are compared
exhaustively by sketches; the rest branch on. Records that are still in a large node at a depth go through a further stage
of deeper trees, up to a depth where only near-copies are left together, which are compared exhaustively at any size. Each
stage has as many independent trees as its depth needs for the target recall, and every candidate is
verified on the whole sets. Equal sets are joined by their hash and take part once, as a class.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.functions.text import distinct_terms
from lodeseek.llm.common import join_unique, latest, pieces
from lodeseek.session import cut

#: Minwise tokens of a sketch.
TOKENS = 128
#: Probability to find a pair at the threshold, asked of the trees of each stage.
RECALL = 0.999
#: Branches before a node's members meet in one task, and at most in each stage.
ROOT_DEPTH, DEPTHS = 4, (6, 8, 10, 12)
#: A node of so many records is compared exhaustively.
LEAF = 96
#: Rows (record and tree) of one task.
TASK_ROWS = 500_000
#: Sketch agreement asked of a candidate: four standard errors below a similarity of 0.8.
SLACK = 4.0
#: Rows that are held before complete nodes are compared.
HELD_ROWS = 100_000
#: Ids that travel in one row on their way to all pairs, about.
IDS = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def term_sets(docs: DataFrame, least: int = 30, key: str = "id") -> DataFrame:
    """(key, terms): sorted hashes of the distinct terms of each record with at least `least`. Repeated rows count once, null keys and texts don't."""
    hashed = F.array_sort(F.array_distinct(F.transform(distinct_terms(F.col("text")), lambda t: F.xxhash64(t))))
    rows = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key), "added_at", hashed.alias("terms"))
    return latest(rows, [key], ["terms"], "added_at").where(F.size("terms") >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minwise(values: np.ndarray, offsets: np.ndarray, n: int = TOKENS, seed: int = 1) -> np.ndarray:
    """(sets, n) minwise tokens as uint64; the sets are slices of values and must not be empty."""
    out = np.empty((len(offsets) - 1, n), dtype=np.uint64)
    values = values.astype(np.uint64, copy=False)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(_mixed(values ^ _mixed(np.full(1, seed * 1_000_003 + i, dtype=np.uint64) * _MIX)), offsets[:-1])
    return out


def drawn(values: np.ndarray, offsets: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A minwise token of each set by a function that its node draws (no other node, level or tree has the same)."""
    values = values.astype(np.uint64, copy=False)
    lengths = np.diff(offsets)
    return lambda path: np.minimum.reduceat(_mixed(values ^ np.repeat(_mixed(path ^ _MIX), lengths)), offsets[:-1])


def trees_for(depth: int, similarity: float, recall: float = RECALL) -> int:
    """Trees that find a pair of that similarity with probability `recall` if it must agree in `depth` tokens."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(similarity**depth))) if similarity < 1 else 1


def chosen(tokens: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """As drawn, but the node chooses among given tokens."""
    return lambda path: tokens[np.arange(len(tokens)), (path % np.uint64(tokens.shape[1])).astype(np.int64)]


def paths(tokens: np.ndarray | Callable[[np.ndarray], np.ndarray], tree: int, depth: int = DEPTHS[-1], n: int | None = None) -> np.ndarray:
    """(sets, depth): the nodes a record passes in a tree. The node before decides which token counts: of given ones, or as `drawn` for n sets."""
    token, n = (tokens, n) if callable(tokens) else (chosen(tokens), len(tokens))
    path = np.full(n, _mixed(np.full(1, tree + 1, dtype=np.uint64) * _MIX)[0])
    out = np.empty((n, depth), dtype=np.uint64)
    for level in range(depth):
        path = _mixed(path * _MIX ^ token(path))
        out[:, level] = path
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Two bits of each minwise token in two planes: (sets, 2 * TOKENS / 64) lanes."""
    planes = [np.packbits(((_mixed(tokens) >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1) for b in (7, 23)]
    return np.concatenate(planes, axis=1).view(np.uint64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    half = a.shape[1] // 2
    differ = (a[:, :half] ^ b[:, :half]) | (a[:, half:] ^ b[:, half:])
    return half * 64 - np.bitwise_count(differ).sum(1, dtype=np.int64)


def needed(similarity: float, tokens: int = TOKENS, slack: float = SLACK) -> int:
    p = similarity + (1 - similarity) / 4
    return int(tokens * p - slack * (tokens * p * (1 - p)) ** 0.5)


def leaf_pairs(root: np.ndarray, tail: np.ndarray, sketches: np.ndarray, size: np.ndarray, similarity: float, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) among rows sorted by (root, tail), and the rows without a leaf: each row belongs to the highest node of
    its path that is a leaf (at most LEAF rows, or if `last` the last level)."""
    n = len(root)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = root[1:] != root[:-1]
    start, end, open_ = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for level in range(tail.shape[1] + 1):
        if level:
            fresh[1:] |= tail[1:, level - 1] != tail[:-1, level - 1]
        first = np.nonzero(fresh)[0]
        number = np.cumsum(fresh) - 1
        s = first[number]
        e = np.append(first[1:], n)[number]
        now = open_ & ((e - s <= LEAF) | (last and level == tail.shape[1]))
        start[now], end[now] = s[now], e[now]
        open_ &= ~now
        if not open_.any():
            break
    most = needed(similarity)
    left, right = [], []
    rows = np.arange(n)
    step = 1
    live = rows[rows + 1 < end]
    while len(live):
        other = live + step
        fits = np.minimum(size[live], size[other]) >= similarity * np.maximum(size[live], size[other]) - 1e-9
        a, b = live[fits], other[fits]
        good = agreement(sketches[a], sketches[b]) >= most
        left.append(a[good])
        right.append(b[good])
        step += 1
        live = live[live + step < end[live]]
    return (*((np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])), rows[open_])


def candidates(sets: DataFrame, similarity: float = 0.8, trees: int | None = None) -> DataFrame:
    """(a, b) with a < b, distinct, of sets(cid, terms): the pairs that some leaf's sketches suggest.

    A pair of which one record has leaves in all trees of a stage meets in each of them with probability similarity ** depth at least; pairs
    of records that both lack a leaf somewhere go on to the next stage. trees: for each stage, instead of trees_for().
    """
    found = None
    for number, depth in enumerate(DEPTHS):
        last = number == len(DEPTHS) - 1
        met = cut(stage(sets, similarity, 1000 * number, trees or trees_for(depth, similarity), depth, last))
        pairs = met.where("a <> b")
        found = pairs if found is None else found.unionByName(pairs)
        left = met.where("b is null").select(F.col("a").alias("cid")).distinct()
        if last or left.isEmpty():
            return found.distinct()
        sets = cut(sets.join(left, "cid"))


def stage(sets: DataFrame, similarity: float, start: int, trees: int, depth: int, last: bool) -> DataFrame:
    """(a, b) with a <= b as often as a task meets the pair in trees start.. of that depth, and (a, null) for records without a leaf."""

    def walk(batches):
        for b in batches:
            if not b.num_rows:
                continue
            offsets = b["terms"].offsets.to_numpy().astype(np.int64)
            values = b["terms"].values.to_numpy(zero_copy_only=False).view(np.uint64)
            tokens = minwise(values[: offsets[-1]], offsets)
            lanes = sketch(tokens)
            lane_bytes = pa.array([r.tobytes() for r in lanes], pa.binary())
            size = pa.array(np.diff(offsets).astype(np.int32))
            draw = drawn(values[: offsets[-1]], offsets)
            for t in range(start, start + trees):
                way = paths(draw, t, depth, b.num_rows)
                tail = np.ascontiguousarray((way[:, ROOT_DEPTH:] & np.uint64(0xFFFFFFFF)).astype(">u4"))
                yield pa.RecordBatch.from_arrays([pa.array(way[:, ROOT_DEPTH - 1].view(np.int64)), pa.array([r.tobytes() for r in tail], pa.binary()), lane_bytes, size, b["cid"]], ["root", "tail", "lanes", "size", "cid"])

    def compare(t: pa.Table) -> pa.RecordBatch:
        width = depth - ROOT_DEPTH
        root = t["root"].to_numpy()
        tail = np.frombuffer(b"".join(t["tail"].to_pylist()), dtype=">u4").reshape(len(root), width)
        lanes = np.frombuffer(b"".join(t["lanes"].to_pylist()), dtype=np.uint64).reshape(len(root), -1)
        i, j, open_ = leaf_pairs(root, tail, lanes, t["size"].to_numpy(), similarity, last)
        cid = t["cid"].to_numpy()
        pairs = np.unique(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        deeper = pa.array(np.unique(cid[open_]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pairs[:, 0]), deeper]), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(deeper), pa.int64())])], ["a", "b"])

    def complete(t: pa.Table) -> int:
        """Rows at the start of t (sorted by root and tail) that belong to nodes which no later row can join. Where all rows share a node, that
        node is no leaf and its children are looked at, down to the last level; rows of one last node stay together if they must be compared."""
        root = t["root"].to_numpy()
        stop = int(np.searchsorted(root, root[-1], side="left"))
        if stop or len(t) <= LEAF:
            return stop
        tail = np.frombuffer(b"".join(t["tail"].to_pylist()), dtype=">u4").reshape(len(root), depth - ROOT_DEPTH)
        for level in range(tail.shape[1]):
            stop = int(np.argmax((tail[:, level] == tail[-1, level])))
            if stop:
                return stop
        return 0 if last else len(t)

    def nodes(batches):
        held: list[pa.Table] = []
        rows, most = 0, HELD_ROWS
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= most:
                t = pa.concat_tables(held)
                stop = complete(t)
                if stop:
                    yield compare(t.slice(0, stop))
                held, rows = [t.slice(stop)] if stop < len(t) else [], t.num_rows - stop
                # a node of the last level that fills the buffer is looked at again when it has doubled
                most = max(HELD_ROWS, 2 * rows)
        if rows:
            yield compare(pa.concat_tables(held))

    walked = sets.select("cid", "terms").mapInArrow(walk, "root long, tail binary, lanes binary, size int, cid long")
    sorted_ = walked.repartition(pieces(sets, TASK_ROWS, trees * sets.count()), "root").sortWithinPartitions("root", "tail")
    return sorted_.mapInArrow(nodes, "a long, b long")


def similar_classes(sets: DataFrame, similarity: tuple[int, int] = (8, 10), trees: int | None = None) -> DataFrame:
    """(a, b): pairs of classes whose shared terms are at least similarity of the terms of both together, verified on whole sets."""
    num, den = similarity
    found = candidates(sets, num / den, trees)
    left = sets.select(F.col("cid").alias("a"), F.col("terms").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("terms").alias("tb"))
    both = found.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("shared") * den >= (F.size("ta") + F.size("tb") - F.col("shared")) * num).select("a", "b")


def _classes(docs: DataFrame, least: int, similarity: tuple[int, int], key: str, trees: int | None) -> tuple[DataFrame, DataFrame]:
    """(cid, rid) of every record, a class being the records of one set of terms (told apart by a 64-bit hash of the sorted terms), and the pairs (a, b)
    of similar classes."""
    rows = cut(term_sets(docs, least, key).select(F.col(key).alias("rid"), F.xxhash64("terms").alias("cid"), "terms"))
    sets = cut(rows.select("cid", "terms").dropDuplicates(["cid"]))
    return rows.select("cid", "rid"), similar_classes(sets, similarity, trees)


def linked(docs: DataFrame, least: int = 30, similarity: tuple[int, int] = (8, 10), key: str = "id", trees: int | None = None) -> DataFrame:
    """(id, class_id, links), one row a record: the smallest id of its class, and how many records it is linked with, those of its class and of
    all similar classes. The same form whatever the size of a class; nothing is expanded."""
    members, pairs = _classes(docs, least, similarity, key, trees)
    pairs = cut(pairs)
    sizes = cut(members.groupBy("cid").agg(F.count("*").alias("n"), F.min("rid").alias("class_id")))
    ends = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    beside = ends.join(sizes.select(F.col("cid").alias("other"), F.col("n").alias("m")), "other").groupBy("cid").agg(F.sum("m").alias("m"))
    about = sizes.join(beside, "cid", "left").withColumn("links", F.col("n") - 1 + F.coalesce("m", F.lit(0)))
    return join_unique(members, about, ["cid"], "n", members.count()).select(F.col("rid").alias(key), "class_id", "links")


def near_duplicates(docs: DataFrame, least: int = 30, similarity: tuple[int, int] = (8, 10), key: str = "id", trees: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records whose sets of distinct terms are that similar.

    Classes of one set are expanded to all pairs at any size, in blocks of about IDS ids that spread over the tasks. linked() gives the same links
    without expanding them.
    """
    members, pairs = _classes(docs, least, similarity, key, trees)
    counts = members.groupBy("cid").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / IDS)).cast("int")
    blocks = join_unique(members, counts, ["cid"], "n", members.count()).withColumn("block", block).groupBy("cid", "n", "block").agg(F.collect_list("rid").alias("ids"))
    blocks = cut(blocks)
    left = blocks.select(F.col("cid").alias("a"), "n", F.col("block").alias("ba"), F.col("ids").alias("ia"))
    right = blocks.select(F.col("cid").alias("b"), F.col("block").alias("bb"), F.col("ids").alias("ib"))
    across = pairs.join(left, "a").join(right, "b").select("ia", "ib", F.lit(False).alias("same"))
    within = left.where("n > 1").join(right, (F.col("a") == F.col("b")) & (F.col("ba") <= F.col("bb"))).select("ia", "ib", (F.col("ba") == F.col("bb")).alias("same"))
    # a hot class's pairs of blocks leave the task that made them before they become pairs of ids
    met = across.unionByName(within).repartition(F.xxhash64("ia", "ib"))
    out = met.select("same", "ib", F.explode("ia").alias("x")).select("same", "x", F.explode("ib").alias("y")).where("not same or x < y").select("x", "y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
