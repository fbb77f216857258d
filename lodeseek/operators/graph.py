"""Navigable small-world graphs, one per shard: built in grouped Arrow tasks, searched in all shards at once.

All work inside a shard is on blocks of queries (or of rows to insert): each step of a walk takes the next node of every query of the block,
gathers its neighbours as one array and merges them. A packed shard is a single row, so a search reads the index where it lies and moves only
the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.functions.vectors import HAMMING_LIMIT, hyperplanes, pack_signs, parse_metric, popcount
from lodeseek.operators.exact import HITS, matrix, query_blocks
from lodeseek.operators.topk import top_k

SEED = 0x5EED5EED
NODES = "shard int, node_id long, level int, v array<float>, links array<array<int>>"
PACKED = "shard int, n int, dim int, ids binary, levels binary, v binary, starts binary, links binary"
#: Rows inserted at once at most; walks of one block, and bytes of their marks.
INSERT_ROWS, WALK_ROWS, WALK_BYTES = 256, 512, 32 << 20
#: Bytes of a block of queries that travels with the tasks.
QUERY_BYTES = 32 << 20
#: A node id in, whether it may be returned out.
Predicate = Callable[[int], bool]


class GraphConfig:
    def __init__(self, m: int = 16, ef_construction: int = 200, metric: str = "dot", seed: int = SEED, cascade: bool = False, int8: bool = False, rerank: bool = True, qrange: float = 0.3, shard_rows: int = 20_000):
        if m < 2:
            raise ValueError("m must be at least 2")
        self.m, self.m0, self.efc, self.metric, self.seed = m, 2 * m, max(ef_construction, m), parse_metric(metric), seed
        self.cascade, self.int8, self.rerank, self.qrange, self.shard_rows = cascade, int8, rerank and int8, max(qrange, 1e-9), shard_rows

    def cap(self, level: int) -> int:
        return self.m0 if level == 0 else self.m

    def as_dict(self) -> dict:
        return {"m": self.m, "ef_construction": self.efc, "metric": self.metric, "seed": self.seed, "cascade": self.cascade, "int8": self.int8, "rerank": self.rerank, "qrange": self.qrange, "shard_rows": self.shard_rows}


class Graph:
    """A graph over the rows of x. adj[level] is (rows, cap), -1 where there is no link; levels[row] is -1 before the row is inserted."""

    def __init__(self, config: GraphConfig, x: np.ndarray):
        self.c, self.x = config, x
        self.walk = (self._codes(x) if config.int8 else x).astype(np.float32)
        self.planes = hyperplanes(config.seed, x.shape[1]) if config.cascade and len(x) else None
        self.sig = None if self.planes is None else pack_signs(x, self.planes)
        self.levels = np.full(len(x), -1, dtype=np.int32)
        self.adj: list[np.ndarray] = []
        self.entry, self.top = -1, -1

    def _codes(self, x: np.ndarray) -> np.ndarray:
        step = 127.0 / self.c.qrange
        return np.clip(np.floor(np.abs(x) * step + 0.5) * np.sign(x), -127, 127) / step

    def _dist(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of q (a, dim) to rows (a, b); those to row -1 are infinite."""
        y = self.walk[np.maximum(rows, 0)]
        d = 1.0 - np.matmul(y, q[:, :, None])[:, :, 0] if self.c.metric == "dot" else ((y - q[:, None, :]) ** 2).sum(2)
        return np.where(rows < 0, np.float32(np.inf), d)

    def _near_signs(self, qsig: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
        if qsig is None:
            return rows >= 0
        return (rows >= 0) & (popcount(self.sig[np.maximum(rows, 0)] ^ qsig[:, None, :]).sum(2) <= HAMMING_LIMIT)

    def _greedy(self, q: np.ndarray, at: np.ndarray, level: int, qsig: np.ndarray | None) -> np.ndarray:
        d = self._dist(q, at[:, None])[:, 0]
        live = np.arange(len(q))
        while len(live):
            near = self.adj[level][at[live]]
            near = np.where(self._near_signs(None if qsig is None else qsig[live], near), near, -1)
            dn = self._dist(q[live], near)
            best = dn.argmin(1)
            found = dn[np.arange(len(live)), best]
            better = found < d[live]
            live, near, best, found = live[better], near[better], best[better], found[better]
            at[live], d[live] = near[np.arange(len(live)), best], found
        return at

    def _beam(self, q: np.ndarray, starts: np.ndarray, ef: int, level: int, qsig: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances), (queries, ef) from the nearest on, of the rows reachable from the starts; -1 and infinite where there are fewer."""
        a, n = len(q), len(self.x)
        seen = np.zeros((a, n), dtype=bool)
        lines = np.arange(a)
        seen[np.repeat(lines, starts.shape[1])[starts.ravel() >= 0], starts[starts >= 0]] = True
        rows, dist = starts, self._dist(q, starts)
        if rows.shape[1] < ef:
            pad = ef - rows.shape[1]
            rows, dist = np.pad(rows, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
        rows, dist = np.take_along_axis(rows, order, 1), np.take_along_axis(dist, order, 1)
        done = np.isinf(dist)
        live = lines
        while True:
            live = live[~done[live].all(1)]
            if not len(live):
                return rows, dist
            # pools are sorted, so the first open entry is the nearest
            pick = (~done[live]).argmax(1)
            done[live, pick] = True
            near = self.adj[level][rows[live, pick]]
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            i, j = np.nonzero(fresh)
            seen[live[i], near[i, j]] = True
            near = np.where(fresh, near, -1)
            if qsig is not None:
                near = np.where(self._near_signs(qsig[live], near), near, -1)
            d = self._dist(q[live], near)
            gain = (d < dist[live, -1:]).any(1)
            at = live[gain]
            if len(at):
                all_d = np.concatenate([dist[at], d[gain]], axis=1)
                order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
                dist[at] = np.take_along_axis(all_d, order, 1)
                rows[at] = np.take_along_axis(np.concatenate([rows[at], near[gain]], axis=1), order, 1)
                done[at] = np.take_along_axis(np.concatenate([done[at], np.zeros(near[gain].shape, dtype=bool)], axis=1), order, 1) | np.isinf(dist[at])

    def _beam_allowed(self, q: np.ndarray, starts: np.ndarray, ef: int, qsig: np.ndarray | None, allow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same at level 0, but rows outside `allow` are walked through and not returned."""
        a, n = len(q), len(self.x)
        seen = np.zeros((a, n), dtype=bool)
        rows, dist = np.full((a, ef), -1, dtype=np.int64), np.full((a, ef), np.inf, dtype=np.float32)
        # the open nodes of each walk in any order; a walk's next free place is in `used`
        front_d, front_r = np.full((a, 256), np.inf, dtype=np.float32), np.zeros((a, 256), dtype=np.int32)
        used = np.zeros(a, dtype=np.int64)

        def admit(at: np.ndarray, near: np.ndarray) -> None:
            nonlocal front_d, front_r
            d = self._dist(q[at], near)
            mine = (near >= 0) & allow[np.maximum(near, 0)]
            useful = (near >= 0) & (~mine | (d < dist[at, -1:]))
            if int(used[at].max()) + near.shape[1] > front_d.shape[1]:
                order = np.argsort(np.isinf(front_d), axis=1, kind="stable")
                front_d, front_r = np.take_along_axis(front_d, order, 1), np.take_along_axis(front_r, order, 1)
                used[:] = np.isfinite(front_d).sum(1)
                if 2 * (int(used.max()) + near.shape[1]) > front_d.shape[1]:
                    wider = ((0, 0), (0, front_d.shape[1]))
                    front_d, front_r = np.pad(front_d, wider, constant_values=np.inf), np.pad(front_r, wider)
            i, j = np.nonzero(useful)
            place = used[at[i]] + (np.cumsum(useful, axis=1) - 1)[i, j]
            front_d[at[i], place], front_r[at[i], place] = d[i, j], near[i, j]
            used[at] += useful.sum(1)
            d = np.where(mine, d, np.inf)
            gain = (d < dist[at, -1:]).any(1)
            at, d, near = at[gain], d[gain], near[gain]
            if len(at):
                all_d = np.concatenate([dist[at], d], axis=1)
                order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
                dist[at] = np.take_along_axis(all_d, order, 1)
                rows[at] = np.take_along_axis(np.concatenate([rows[at], near], axis=1), order, 1)

        live = np.arange(a)
        seen[live, starts[:, 0]] = True
        admit(live, starts[:, :1].astype(np.int64))
        while len(live):
            top = int(used[live].max())
            pick = front_d[live, :top].argmin(1)
            d = front_d[live, pick]
            go = np.isfinite(d) & (d <= dist[live, -1])
            live, pick = live[go], pick[go]
            if not len(live):
                break
            front_d[live, pick] = np.inf
            near = self.adj[0][front_r[live, pick]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            i, j = np.nonzero(fresh)
            seen[live[i], near[i, j]] = True
            near = np.where(fresh, near, -1)
            if qsig is not None:
                near = np.where(self._near_signs(qsig[live], near), near, -1)
            admit(live, near)
        return np.where(np.isinf(dist), -1, rows), dist

    def select(self, rows: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """(a, m) of candidates rows (a, b) in order of distance, -1 beyond their end: spread-out ones first. A candidate is kept that is nearer to
        the new point than to all kept ones; the nearest of the rest fill up."""
        a, b = rows.shape
        y = self.walk[np.maximum(rows, 0)]
        between = np.matmul(y, y.transpose(0, 2, 1))
        if self.c.metric == "dot":
            between = 1.0 - between
        else:
            sq = np.einsum("abd,abd->ab", y, y)
            between = sq[:, :, None] + sq[:, None, :] - 2 * between
        held = rows >= 0
        kept = np.zeros((a, b), dtype=bool)
        count = np.zeros(a, dtype=np.int64)
        for c in range(b):
            near = ((between[:, c, :] <= dist[:, c, None]) & kept).any(1)
            take = held[:, c] & ~near & (count < m)
            kept[:, c] = take
            count += take
        # kept ones in order, then the passed ones in order
        order = np.argsort(np.where(kept, 0, np.where(held, 1, 2)) * b + np.arange(b), axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(np.where(held, rows, -1), order, 1)
        return np.pad(out, ((0, 0), (0, max(0, m - b))), constant_values=-1)

    def _link_back(self, level: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen rows to the new ones; a row with more links than its cap selects anew."""
        cap = self.c.cap(level)
        i, j = np.nonzero(chosen >= 0)
        target, source = chosen[i, j], new[i]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        unique, first, size = np.unique(target, return_index=True, return_counts=True)
        adj = self.adj[level]
        for at in range(0, len(unique), INSERT_ROWS):
            u, f, s = unique[at : at + INSERT_ROWS], first[at : at + INSERT_ROWS], size[at : at + INSERT_ROWS]
            more = np.full((len(u), int(s.max())), -1, dtype=np.int64)
            line = np.repeat(np.arange(len(u)), s)
            place = np.arange(len(line)) - np.repeat(np.cumsum(s) - s, s)
            more[line, place] = source[np.repeat(f, s) + place]
            both = np.concatenate([adj[u].astype(np.int64), more], axis=1)
            full = (both >= 0).sum(1) > cap
            tidy = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :cap]
            adj[u] = tidy
            if full.any():
                rows = both[full]
                d = self._dist(self.walk[u[full]], rows)
                o = np.lexsort((rows, d), axis=1)
                adj[u[full]] = self.select(np.take_along_axis(rows, o, 1), np.take_along_axis(d, o, 1), cap)

    def insert(self, new: np.ndarray, levels: np.ndarray) -> None:
        """Insert rows at their levels. Rows of one call see the graph before it and those of them that come earlier."""
        self.levels[new] = levels
        while len(self.adj) <= levels.max():
            self.adj.append(np.full((len(self.x), self.c.cap(len(self.adj))), -1, dtype=np.int32))
        q = self.walk[new]
        qsig = None if self.sig is None else self.sig[new]
        beside = self._dist(q, np.broadcast_to(new, (len(new), len(new))))
        earlier = np.tri(len(new), k=-1, dtype=bool)
        if qsig is not None:
            earlier &= popcount(qsig[:, None, :] ^ qsig[None, :, :]).sum(2) <= HAMMING_LIMIT
        starts = np.full((len(new), self.c.efc), -1, dtype=np.int64)
        starts[:, 0] = self.entry
        for level in range(max(int(levels.max()), self.top), -1, -1):
            here = np.nonzero(levels >= level)[0]
            if level <= self.top and self.entry >= 0:
                above = np.nonzero(levels < level)[0]
                if len(above):
                    starts[above, 0] = self._greedy(q[above], starts[above, 0].copy(), level, None if qsig is None else qsig[above])
                if len(here):
                    starts[here] = self._beam(q[here], starts[here], self.c.efc, level, None if qsig is None else qsig[here])[0]
            if not len(here):
                continue
            reached = starts[here] if level <= self.top and self.entry >= 0 else np.full((len(here), 1), -1, dtype=np.int64)
            mates = np.where(earlier[np.ix_(here, here)], new[here][None, :], -1)
            both = np.concatenate([reached, mates], axis=1)
            d = np.concatenate([self._dist(q[here], reached), np.where(mates >= 0, beside[np.ix_(here, here)], np.inf)], axis=1)
            o = np.argsort(d, axis=1, kind="stable")[:, : self.c.efc]
            chosen = self.select(np.take_along_axis(both, o, 1), np.take_along_axis(d, o, 1), self.c.cap(level))
            self.adj[level][new[here]] = chosen
            self._link_back(level, new[here], chosen)
        if levels.max() > self.top:
            self.top, self.entry = int(levels.max()), int(new[np.argmax(levels)])

    def build(self, levels: np.ndarray) -> Graph:
        """Insert all rows in order, ever more at once while the graph grows."""
        at = 0
        while at < len(levels):
            n = max(1, min(INSERT_ROWS, at // 8))
            self.insert(np.arange(at, min(at + n, len(levels))), levels[at : at + n])
            at += n
        return self

    def search(self, queries: np.ndarray, k: int, ef: int, allow: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, row, distance) of up to k nearest rows of each query, in blocks."""
        if self.entry < 0 or k < 1:
            return
        ef = min(max(ef, k), len(self.x))
        step = max(1, min(WALK_ROWS, WALK_BYTES // len(self.x)))
        for at in range(0, len(queries), step):
            whole = queries[at : at + step]
            q = (self._codes(whole) if self.c.int8 else whole).astype(np.float32)
            qsig = None if self.planes is None else pack_signs(whole, self.planes)
            start = np.full(len(q), self.entry, dtype=np.int64)
            for level in range(self.top, 0, -1):
                start = self._greedy(q, start, level, qsig)
            rows, _ = self._beam(q, start[:, None], ef, 0, qsig) if allow is None else self._beam_allowed(q, start[:, None], ef, qsig, allow)
            i, j = np.nonzero(rows >= 0)
            row = rows[i, j]
            exact = not self.c.int8 or self.c.rerank
            y, z = (self.x[row], whole[i]) if exact else (self._codes(self.x[row]), self._codes(whole)[i])
            d = 1.0 - np.einsum("ij,ij->i", y, z) if self.c.metric == "dot" else ((y - z) ** 2).sum(1)
            order = np.lexsort((row, np.round(d, 9), i))
            i, row, d = i[order], row[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield at + i[first], row[first], d[first]


def sample_levels(seed: int, shard: int, n: int, m: int) -> np.ndarray:
    u = np.random.default_rng([seed, shard]).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-38)) / np.log(m)).astype(np.int32)


def shard_of(shards: int, key: str = "node_id") -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shards)).cast("int")


def _sharded(docs: DataFrame, config: GraphConfig, shards: int | None) -> DataFrame:
    docs = docs.select(F.col("node_id").cast("long"), F.col("v").cast("array<float>")).where("v is not null")
    if shards is None:
        shards = max(1, -(-docs.count() // config.shard_rows))
    return docs.withColumn("shard", shard_of(shards))


def _grown(t: pa.Table, config: GraphConfig) -> tuple[pa.Table, Graph]:
    t = t.sort_by("node_id")
    g = Graph(config, matrix(t["v"]))
    return t, g.build(sample_levels(config.seed, t["shard"][0].as_py(), len(g.x), config.m))


def _flat_links(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(starts, links): the links of every (row, level) in turn, rows by number and levels from 0 on; starts has one entry more than there are."""
    counts = g.levels + 1
    row, level = np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [g.adj[at][row[level == at]] for at in range(len(g.adj))]
    width = max((p.shape[1] for p in parts), default=0)
    wide = np.full((len(row), width), -1, dtype=np.int32)
    for at, p in enumerate(parts):
        wide[level == at, : p.shape[1]] = p
    held = wide >= 0
    return np.concatenate(([0], np.cumsum(held.sum(1)))).astype(np.int32), wide[held]


def build(docs: DataFrame, config: GraphConfig, shards: int | None = None) -> DataFrame:
    """Node table (shard, node_id, level, v, links) of docs(node_id, v). A shard holds about shard_rows rows and is one task.

    Rows enter in node_id order with levels drawn from the seed and the shard, so equal input gives an equal graph
    whatever the partitioning. Links are row numbers within the shard, in node_id order.
    """

    def make(t: pa.Table) -> pa.Table:
        t, g = _grown(t, config)
        starts, links = _flat_links(g)
        of_row = np.concatenate(([0], np.cumsum(g.levels + 1))).astype(np.int32)
        nested = pa.ListArray.from_arrays(pa.array(of_row), pa.ListArray.from_arrays(pa.array(starts), pa.array(links)))
        return pa.table({"shard": t["shard"], "node_id": t["node_id"], "level": pa.array(g.levels), "v": t["v"], "links": nested})

    return _sharded(docs, config, shards).groupBy("shard").applyInArrow(make, NODES)


def _pack(t: pa.Table, levels: np.ndarray, starts: np.ndarray, links: np.ndarray) -> pa.Table:
    x = matrix(t["v"]).astype("<f4")
    blob = lambda a, kind: pa.array([np.ascontiguousarray(a, dtype=kind).tobytes()], pa.binary())
    return pa.table({"shard": t["shard"][:1], "n": pa.array([len(x)], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": blob(t["node_id"].to_numpy(), "<i8"), "levels": blob(levels, "<i4"), "v": blob(x, "<f4"), "starts": blob(starts, "<i4"), "links": blob(links, "<i4")})


def build_packed(docs: DataFrame, config: GraphConfig, shards: int | None = None) -> DataFrame:
    """The graphs of build(), each packed in one row: ids and levels of its rows, vectors, and the links of every (row, level) in compressed rows."""

    def make(t: pa.Table) -> pa.Table:
        t, g = _grown(t, config)
        return _pack(t, g.levels, *_flat_links(g))

    return _sharded(docs, config, shards).groupBy("shard").applyInArrow(make, PACKED)


def pack_nodes(nodes: DataFrame) -> DataFrame:
    """A node table packed, one row a shard. Packed graphs take no further rows."""

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("node_id").combine_chunks()
        inner = t["links"].chunk(0).flatten()
        sizes = inner.value_lengths().to_numpy(zero_copy_only=False)
        return _pack(t, t["level"].to_numpy(), np.concatenate(([0], np.cumsum(sizes))), inner.flatten().to_numpy(zero_copy_only=False))

    return nodes.select("shard", "node_id", "level", "v", "links").groupBy("shard").applyInArrow(make, PACKED)


class PackedError(ValueError):
    """A packed shard whose parts don't fit together."""


def open_packed(row: dict, config: GraphConfig) -> tuple[np.ndarray, Graph]:
    """Node ids and graph of a packed row, after checking that its parts fit together."""
    n, dim = row["n"], row["dim"]
    if n < 1 or dim < 1:
        raise PackedError("a packed shard holds at least one row of one dimension")
    ids, levels, starts, links = (np.frombuffer(row[c], dtype=k) for c, k in (("ids", "<i8"), ("levels", "<i4"), ("starts", "<i4"), ("links", "<i4")))
    x = np.frombuffer(row["v"], dtype="<f4")
    if len(ids) != n or len(levels) != n or len(x) != n * dim or len(starts) != int(levels.sum()) + n + 1:
        raise PackedError("a packed shard is truncated")
    if starts[0] != 0 or starts[-1] != len(links) or (np.diff(starts) < 0).any() or len(links) and (links.min() < 0 or links.max() >= n):
        raise PackedError("the links of a packed shard are broken")
    g = Graph(config, x.reshape(n, dim).astype(np.float64))
    g.levels = levels.copy()
    counts = levels + 1
    row_of, level_of = np.repeat(np.arange(n), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.diff(starts)
    place = np.arange(len(links)) - np.repeat(starts[:-1], size)
    r, at = np.repeat(row_of, size), np.repeat(level_of, size)
    for level in range(int(levels.max()) + 1):
        mine = at == level
        adj = np.full((n, max(int(size[level_of == level].max(initial=0)), 1)), -1, dtype=np.int32)
        adj[r[mine], place[mine]] = links[mine]
        g.adj.append(adj)
    # the first row that reached the top level is the entry
    g.top, g.entry = int(levels.max()), int(np.argmax(levels))
    return ids, g



def search_packed(packed: DataFrame, queries: DataFrame, k: int, ef: int, config: GraphConfig, allowed: DataFrame | None = None, predicate: Predicate | None = None, shards: int | None = None) -> DataFrame:
    """(query_id, rank, node_id, dist): walk every packed shard for every query where it lies, and merge the shards' best.

    Queries travel with the tasks in blocks of QUERY_BYTES. allowed(node_id) and predicate(node_id) restrict results, not the walk; the ids of
    `allowed` meet their shard as one list (at most the shard's rows), for which `shards` tells their number if it is known.
    """
    spark = packed.sparkSession
    if allowed is not None:
        shards = shards or packed.agg(F.max("shard")).first()[0] + 1
        lists = allowed.select("node_id").distinct().groupBy(shard_of(shards).alias("shard")).agg(F.collect_list(F.col("node_id").cast("long")).alias("ok"))
        packed = packed.join(lists, "shard")
    scored, filtered = None, allowed is not None
    for qids, qs in query_blocks(queries, QUERY_BYTES) if k > 0 else ():

        def walk(batches, qids=qids, qs=qs):
            for b in batches:
                for row in range(b.num_rows):
                    one = {name: b[name][row].as_py() for name in b.schema.names if name != "ok"}
                    ids, g = open_packed(one, config)
                    allow = np.isin(ids, b["ok"][row].values.to_numpy()) if filtered else None
                    if predicate is not None:
                        held = np.fromiter((predicate(int(x)) for x in ids), dtype=bool, count=len(ids))
                        allow = held if allow is None else allow & held
                    if allow is not None and not allow.any():
                        continue
                    for q, r, d in g.search(qs, k, ef, allow):
                        yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[r]), pa.array(d)], ["query_id", "node_id", "dist"])

        part = packed.mapInArrow(walk, HITS)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return spark.createDataFrame([], "query_id long, rank int, node_id long, dist double")
    return top_k(scored, ["query_id"], [F.round("dist", 9), F.col("node_id")], k).select("query_id", "rank", "node_id", "dist")


def search(nodes: DataFrame, queries: DataFrame, k: int, ef: int, config: GraphConfig, allowed: DataFrame | None = None, predicate: Predicate | None = None) -> DataFrame:
    """The same on a node table, which is packed first (one shuffle of it; store a packed graph for repeated searches)."""
    return search_packed(pack_nodes(nodes), queries, k, ef, config, allowed, predicate, None if allowed is None else nodes.agg(F.max("shard")).first()[0] + 1)


def pack(nodes: DataFrame) -> DataFrame:
    """(shard, level, src, neighbours): compressed rows of the graph, node ids in link order. Each shard's ids stay in its task."""

    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("node_id").combine_chunks()
        ids, links = t["node_id"].to_numpy(), t["links"].chunk(0)
        counts = links.value_lengths().to_numpy(zero_copy_only=False)
        inner = links.flatten()
        sizes = inner.value_lengths().to_numpy(zero_copy_only=False)
        level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids[inner.flatten().to_numpy(zero_copy_only=False)]))
        return pa.table({"shard": pa.array(np.full(len(level), t["shard"][0].as_py(), np.int32)), "level": pa.array(level.astype(np.int32)), "src": pa.array(np.repeat(ids, counts)), "neighbours": near})

    return nodes.select("shard", "node_id", "links").groupBy("shard").applyInArrow(make, "shard int, level int, src long, neighbours array<long>")


def graph_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, layers, directed links."""
    links = F.aggregate("links", F.lit(0), lambda s, x: s + F.size(x))
    return nodes.agg(F.count("*").alias("nodes"), (F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("layers"), F.coalesce(F.sum(links), F.lit(0)).alias("links"))


def packed_stats(packed: DataFrame) -> DataFrame:
    """One row: nodes, shards, bytes of vectors and of links."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return packed.agg(zero(F.sum("n")).alias("nodes"), F.count("*").alias("shards"), zero(F.sum(F.octet_length("v"))).alias("vector_bytes"), zero(F.sum(F.octet_length("links") + F.octet_length("starts"))).alias("link_bytes"))
