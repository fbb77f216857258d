"""Most similar vectors for every vector: adaptive dimension scan within probed lists.

Unit vectors are laid out in inverted lists around centroids of a bounded sample. Every vector first scans its own list, which
bounds the distance of its k-th neighbour; then it visits, in waves and without a limit on their number, those of the other lists that under this
bound neither their radius rules out nor a test on the distance to the plane between the two centroids. A scan reads randomly rotated vectors
in column blocks: after each block, a candidate whose partial distance is too large for the bound (a hypothesis test on the rotation's
distribution) is abandoned, and only survivors are read further. Survivors are re-scored in double precision. Vectors of one direction take
part once, as a class. In exact mode both tests give way to the bounds that no neighbour can break: the plane itself and the partial distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import join_unique, latest, pieces
from lodeseek.operators.exact import matrix
from lodeseek.operators.topk import top_k
from lodeseek.session import cut, stored

#: Vectors a list holds on average; there are at most MAX_LISTS lists, whose centroids travel with the tasks.
LIST_ROWS, MAX_LISTS = 500, 16_384
#: Lists besides the own one that the first waves choose among, nearest first (each wave tightens the bound for the next); the last wave looks at all
#: others. And how far beyond the plane to its own list a vector still looks, in shares of its bound: a
#: neighbour lies in some direction of many, so its component across one plane is small. PLANE is divided by the root of the dimensions.
WAVES, PLANE = (8, 64), 2.64
#: Vectors of the sample on which centroids are fitted: at least, and for each list.
SAMPLE, SAMPLE_PER_LIST, ROUNDS = 20_000, 32, 6
#: Columns read between two tests, and how many deviations a partial distance may exceed its share of the bound.
COLUMNS, DEVIATIONS = 16, 2.5
#: One task scans at most about so many asking vectors against so many stored ones.
ASK_BLOCK, ROW_BLOCK = 8_192, 16_384
#: Vectors of one task where they are laid out by id.
TASK_ROWS = 500_000
#: Pairs of which a scan gathers columns at once, and numbers of one block of products in a probe.
GATHER, PRODUCTS = 500_000, 8_000_000
DECIMALS = 6
SEED = 271_828


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from a seeded choice of the sample."""
    x = sample.astype(np.float32)
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(len(c)))
        held = np.bincount(near, minlength=len(c))
        some = held > 0
        sums = np.add.reduceat(x[order], first[some], axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = c.copy()
        c[some] = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), c[some])
    return c


def scan(ask_ids: np.ndarray, asks: np.ndarray, bound: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = 512, kinds: np.ndarray | None = None, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking number, id, similarity) of up to k most similar rows each, equal to DECIMALS by smaller id, never itself: the row of an asking vector's
    own id unless its kind is not 0.

    bound: a similarity that the k-th neighbour is known to reach (-1 if none); rows below it may be left out.
    """
    dim = asks.shape[1]
    r = rotation(dim)
    q_all, x = (asks @ r).astype(np.float32), (rows @ r).astype(np.float32)
    edges = [*range(COLUMNS, dim, COLUMNS), dim]
    slack = [1.0 if exact or e == dim else e / dim * (1 + DEVIATIONS / e**0.5) ** 2 for e in edges]
    head = x[:, : edges[0]]
    head_sq = (head * head).sum(1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    by_id = np.argsort(ids)
    for at in range(0, len(q_all), step):
        q, mine = q_all[at : at + step], ask_ids[at : at + step]
        stored = np.ones(len(mine), dtype=bool) if kinds is None else kinds[at : at + step] == 0
        part = np.maximum((q[:, : edges[0]] ** 2).sum(1)[:, None] + head_sq[None, :] - 2 * (q[:, : edges[0]] @ head.T), 0)
        where = np.searchsorted(ids, mine, sorter=by_id)
        self_col = by_id[np.minimum(where, len(ids) - 1)]
        self_row = np.nonzero((ids[self_col] == mine) & stored)[0]
        part[self_row, self_col[self_row]] = np.inf
        limit = 2 - 2 * bound[at : at + step].astype(np.float64)
        if part.shape[1] > k:
            # the k nearest by the first block give a bound at once
            first = np.argpartition(part, k - 1, axis=1)[:, :k]
            full = ((q[:, None, :] - x[first]) ** 2).sum(2).max(1)
            limit = np.where(np.isinf(np.take_along_axis(part, first, 1)).any(1), limit, np.minimum(limit, full))
        limit = (limit + 1e-5).astype(np.float32)
        first_i, first_j = np.nonzero(part <= (limit * np.float32(slack[0]))[:, None])
        first_d = part[first_i, first_j]
        left = []
        for p in range(0, len(first_i), GATHER):
            i, j, d = first_i[p : p + GATHER], first_j[p : p + GATHER], first_d[p : p + GATHER]
            for lo, hi, s in zip(edges, edges[1:], slack[1:]):
                diff = q[i, lo:hi] - x[j, lo:hi]
                d = d + np.einsum("ij,ij->i", diff, diff)
                keep = d <= limit[i] * np.float32(s)
                i, j, d = i[keep], j[keep], d[keep]
            left.append((i, j, np.einsum("ij,ij->i", asks[at + i], rows[j])))
        if not left:
            continue
        i, j, similarity = (np.concatenate(c) for c in zip(*left))
        order = np.lexsort((ids[j], -np.round(similarity, DECIMALS), i))
        i, j, similarity = i[order], j[order], similarity[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[keep], ids[j[keep]], similarity[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))


def prepare(records: DataFrame, dim: int) -> DataFrame:
    """Usable rows of records(id, kind, v) plus two hashes of their direction. Usable: dim finite components, not all zeros."""

    def run(batches):
        rng = np.random.default_rng(SEED)
        odd = rng.integers(1, 1 << 63, (2, dim), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            b = b.filter(pa.compute.and_(pa.compute.is_valid(b["v"]), pa.compute.equal(pa.compute.list_value_length(b["v"]), dim)))
            if not b.num_rows:
                continue
            x = matrix(b["v"])
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            b, x = b.filter(pa.array(good)), x[good]
            if not len(x):
                continue
            # scaled first, so that no square overflows or vanishes
            u = unit(x / np.abs(x).max(1, keepdims=True))
            digits = np.round(u * 1e9).astype(np.int64).view(np.uint64)
            h = [(digits * o).sum(1, dtype=np.uint64).view(np.int64) for o in odd]
            yield pa.RecordBatch.from_arrays([b["id"], b["kind"], _vectors(x), pa.array(h[0]), pa.array(h[1])], ["id", "kind", "v", "h1", "h2"])

    return records.mapInArrow(run, "id long, kind int, v array<float>, h1 long, h2 long")


def _unit_rows(column) -> np.ndarray:
    x = matrix(column)
    return unit(x / np.abs(x).max(1, keepdims=True)) if len(x) else x


def _assign(records: DataFrame, c: np.ndarray) -> DataFrame:
    """(list, off, id, kind, v): the nearest centroid and the distance to it."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                u = _unit_rows(b["v"])
                s = u.astype(np.float32) @ c.T
                near = np.argmax(s, axis=1)
                off = np.sqrt(np.maximum(0, 2 - 2 * (u * c[near]).sum(1))) + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(off), b["id"], b["kind"], b["v"]], ["list", "off", "id", "kind", "v"])

    return records.select("id", "kind", "v").mapInArrow(run, "list int, off double, id long, kind int, v array<float>")


def _probe(asks: DataFrame, c: np.ndarray, radius: np.ndarray, past: int, upto: int, exact: bool) -> DataFrame:
    """(list, id, kind, bound): of each row of asks(list, id, kind, bound, v) the lists it must visit among its past + 1st to upto-th nearest, not
    counting its own."""

    def run(batches):
        between = c @ c.T
        share = 0.0 if exact else min(1.0, PLANE / c.shape[1] ** 0.5)
        n = min(upto + 1, len(c))
        step = max(1, PRODUCTS // len(c))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                u, home, bound = _unit_rows(b["v"]), np.asarray(b["list"]), np.asarray(b["bound"])
                s = u.astype(np.float32) @ c.T
                s[np.arange(len(u)), home] = 3.0
                near = np.argpartition(-s, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)[:, past + 1 :]
                square = np.maximum(0, 2 - 2 * np.take_along_axis(s, near, 1).astype(np.float64))
                own = np.maximum(0, 2 - 2 * (u * c[home]).sum(1))
                # whatever lies in a list lies within its radius, and beyond the plane between its centroid and one's own
                apart = np.sqrt(np.maximum(1e-6, 2 - 2 * between[home[:, None], near].astype(np.float64)))
                plane = (square - own[:, None]) / (2 * apart)
                reach = np.sqrt(2 - 2 * bound)[:, None]
                go = (radius[near] >= 0) & (np.sqrt(square) - radius[near] <= reach + 1e-4) & (exact | (plane <= share * reach + 1e-4))
                i, j = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([pa.array(near[i, j].astype(np.int32)), b["id"].take(pa.array(i)), b["kind"].take(pa.array(i)), pa.array(bound[i])], ["list", "id", "kind", "bound"])

    return asks.select("list", "id", "kind", "bound", "v").mapInArrow(run, "list int, id long, kind int, bound double")


def _scan_lists(asks: DataFrame, counts: dict[int, int], rows: DataFrame, row_counts: dict[int, int], k: int, exact: bool) -> DataFrame:
    """(id, kind, near, similarity) of asks(list, id, kind, bound, v) within the rows(list, id, v) of their list, in blocks of bounded size."""
    spark = asks.sparkSession
    grid = [(n, -(-counts[n] // ASK_BLOCK), -(-row_counts[n] // ROW_BLOCK)) for n in counts if row_counts.get(n)]
    blocks = F.broadcast(spark.createDataFrame(grid, "list int, nq int, nd int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asks.join(blocks, "list").select(F.col("list").alias("la"), part("nq").alias("qa"), upto("nd").alias("da"), F.col("id").alias("ia"), "kind", "bound", F.col("v").alias("va"))
    right = rows.join(blocks, "list").select(F.col("list").alias("lb"), upto("nq").alias("qb"), part("nd").alias("db"), F.col("id").alias("ib"), F.col("v").alias("vb"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            row, near, similarity = scan(np.asarray(a["ia"]), _unit_rows(a["va"]), np.asarray(a["bound"]), np.asarray(b["ib"]), _unit_rows(b["vb"]), k, kinds=np.asarray(a["kind"]), exact=exact)
        else:
            row, near, similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"id": a["ia"].take(pa.array(row)), "kind": a["kind"].take(pa.array(row)), "near": pa.array(near), "similarity": pa.array(similarity)})

    return left.groupBy("la", "qa", "da").cogroup(right.groupBy("lb", "qb", "db")).applyInArrow(cell, "id long, kind int, near long, similarity double")


def nearest(records: DataFrame, k: int, lists: int | None = None, exact: bool = False) -> DataFrame:
    """(id, kind, near, similarity): the k most similar rows of kind 0 for every row of records(id, kind, v), itself excluded. A row of another kind
    may have the id of one of kind 0.

    v must be usable. This is the operator without classes of one direction; equal similarities (6 decimals) go by smaller id. exact: with
    bounds instead of tests, so nothing is lost.
    """
    spark = records.sparkSession
    n = records.where("kind = 0").count()
    if not n or k < 1:
        return spark.createDataFrame([], "id long, kind int, near long, similarity double")
    lists = lists or max(1, min(MAX_LISTS, n // LIST_ROWS))
    target = max(SAMPLE, SAMPLE_PER_LIST * lists)
    share = min(1.0, 1.05 * target / n)
    chosen = records.where("kind = 0").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("id", "v").limit(2 * target)
    sample = chosen.toArrow()
    if not sample.num_rows:
        sample = records.where("kind = 0").select("id", "v").limit(target).toArrow()
    sample = sample.sort_by("id")
    c = centroids(_unit_rows(sample["v"]), lists)
    # laid out by id once, so the joins of all waves move only ids and bounds
    tasks = pieces(records, TASK_ROWS)
    placed = stored(_assign(records, c).repartition(tasks, "id", "kind"), tasks, ["id", "kind"])
    base = placed.where("kind = 0")
    tally = lambda df: {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}
    about = base.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("r")).collect()
    radius, row_counts = np.full(len(c), -1.0), {r["list"]: r["n"] for r in about}
    for r in about:
        radius[r["list"]] = r["r"]
    hits = cut(_scan_lists(placed.select("list", "id", "kind", F.lit(-1.0).alias("bound"), "v"), tally(placed), base, row_counts, k, exact))
    for past, upto in zip((0, *WAVES), (*WAVES, len(c))):
        if past + 1 >= len(c):
            break
        reached = hits.groupBy("id", "kind").agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("s"))
        bound = reached.select("id", "kind", F.when(F.size("s") >= k, F.element_at("s", k)).otherwise(F.lit(-1.0)).alias("bound"))
        asks = placed.join(bound, ["id", "kind"], "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
        # only ids are kept; the vectors join them on the way to the lists
        probes = cut(_probe(asks, c, radius, past, upto, exact))
        counts = tally(probes)
        if counts:
            hits = hits.unionByName(cut(_scan_lists(probes.join(placed.select("id", "kind", "v"), ["id", "kind"]), counts, base, row_counts, k, exact)))
    ordered = [F.round("similarity", DECIMALS).desc(), F.col("near")]
    return top_k(hits, ["id", "kind"], ordered, k).select("id", "kind", "near", "similarity")


def similar_pairs(vectors: DataFrame, queries: DataFrame, k: int = 5, dim: int = 64, exact: bool = False) -> DataFrame:
    """(id_a, id_b): pairs of which at least one side has the other among its k most similar, each once.

    vectors(node_id, v, added_at) are searched for themselves and for queries(query_id, v, asked_at). Of repeated rows the latest holds;
    null ids and unusable vectors don't count. For a query id_a is the query, whose id may also be that of a vector; among vectors id_a < id_b.
    A class is the vectors of one direction (to 9 decimals). The smallest id stands for it in the search, and its k + 1 smallest ids are
    all that can be anyone's neighbours, so classes of any size are never paired within.
    """
    v = latest(vectors.where("node_id is not null").select(F.col("node_id").cast("long").alias("id"), "v", "added_at"), ["id"], ["v"], "added_at").withColumn("kind", F.lit(0))
    q = latest(queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("id"), "v", "asked_at"), ["id"], ["v"], "asked_at").withColumn("kind", F.lit(1))
    records = cut(prepare(v.unionByName(q).select("id", "kind", "v"), dim))
    stored = records.where("kind = 0")
    classes = stored.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = cut(join_unique(stored.select("h1", "h2", "id"), classes, ["h1", "h2"], "n", stored.count()).select("rep", "id", "n"))
    copies = members.where("id <> rep")
    searched = records.join(copies.select("id", F.lit(0).alias("kind")), ["id", "kind"], "left_anti").select("id", "kind", "v")
    found = cut(nearest(searched, k, exact=exact))
    # each class by its smallest members, then the best k + 1 for every asking row
    smallest = top_k(members, ["rep"], [F.col("id")], k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("n").alias("n"))
    value = F.round("similarity", DECIMALS)
    known = found.join(smallest.select(F.col("rep").alias("near"), "ids"), "near", "left").select("id", "kind", value.alias("s"), F.explode(F.coalesce("ids", F.array("near"))).alias("near"))
    own = smallest.select(F.col("rep").alias("id"), F.lit(0).alias("kind"), F.lit(1.0).alias("s"), F.explode("ids").alias("near"))
    mine = top_k(known.unionByName(own), ["id", "kind"], [F.col("s").desc(), F.col("near")], k + 1).groupBy("id", "kind").agg(F.sort_array(F.collect_list(F.struct("rank", "near"))).alias("best"))
    shared = mine.where("kind = 0").select(F.col("id").alias("rep"), "best").join(smallest.select("rep", "n"), "rep")
    theirs = join_unique(copies.select("rep", "id"), shared, ["rep"], "n", records.count()).select("id", F.lit(0).alias("kind"), "best")
    others = F.when(F.col("kind") == 0, F.filter("best", lambda x: x["near"] != F.col("id"))).otherwise(F.col("best"))
    chosen = mine.unionByName(theirs).select("id", "kind", F.explode(F.slice(others, 1, k)).alias("b"))
    first = F.when((F.col("kind") == 1) | (F.col("id") < F.col("b.near")), F.col("id")).otherwise(F.col("b.near"))
    second = F.when((F.col("kind") == 1) | (F.col("id") < F.col("b.near")), F.col("b.near")).otherwise(F.col("id"))
    return chosen.select(first.alias("id_a"), second.alias("id_b")).distinct()
