"""Training-data operations against brute force, on small dirty tables."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import distinctive, encode, frequency, fuse, mix, neardup, neighbours, split, subjects

T0 = datetime(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def at(i):
    return None if i is None else T0 + timedelta(seconds=i)


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


# 1


def brute_pairs(vectors, queries, k=5):
    def unit(rows):
        good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows.items() if v is not None and len(v) == 4 and np.isfinite(v).all() and np.any(v)}
        return {i: v / np.linalg.norm(v) for i, v in good.items()}

    x, q, out = unit(vectors), unit(queries), set()
    for mine, kind in ((x, 0), (q, 1)):
        for i, u in mine.items():
            near = sorted((-round(float(u @ w), 6), j) for j, w in x.items() if kind or j != i)[:k]
            out |= {(i, j) if kind or i < j else (j, i) for _, j in near}
    return out


VECTORS = "node_id long, coll string, v array<float>, added_at timestamp, id string, kind string"
QUERIES = "query_id int, coll string, v array<float>, asked_at timestamp"


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 4))
    vectors = {1000 + i: (centers[i % 6] + 0.3 * rng.standard_normal(4)).astype(np.float32).tolist() for i in range(120)}
    vectors |= {2000 + i: [float(x) * 2 for x in vectors[1003]] for i in range(9)}  # one direction
    vectors |= {3000: None, 3001: [1.0], 3002: [0.0] * 4, 3003: [NAN, 1.0, 1.0, 1.0], 3004: [INF, 0.0, 0.0, 1.0], 3005: [1e-30, 0.0, 0.0, 0.0]}
    queries = {i: rng.standard_normal(4).astype(np.float32).tolist() for i in range(1, 8)} | {9: None, 10: vectors[1003]}
    rows = [(i, "c", v, at(1), "x", None) for i, v in vectors.items()] + [(1003, "c", vectors[1003], at(2), "x", None), (None, "c", [1.0] * 4, at(1), None, None)]
    asked = [(i, None, v, at(1)) for i, v in queries.items()] * 2
    a, b = spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(asked, QUERIES)
    assert pairs(neighbours.similar_pairs(a, b, dim=4)) == brute_pairs(vectors, queries)
    assert neighbours.similar_pairs(a.limit(0), b, dim=4).count() == 0
    assert {x for x, _ in pairs(neighbours.similar_pairs(a, b.limit(0), dim=4))}.isdisjoint(queries)


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(11)
    centers = rng.standard_normal((40, 64))
    x = (centers[rng.integers(0, 40, 3000)] + 0.5 * rng.standard_normal((3000, 64))).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    records = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, kind int, v array<float>")
    found = defaultdict(set)
    for r in neighbours.nearest(records, 5, lists=60).collect():
        found[r["id"]].add(r["near"])
    exact = defaultdict(list)
    for r in neighbours.nearest(records, 5, lists=60, exact=True).collect():
        exact[r["id"]].append(round(r["similarity"], 6))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :5]
    assert sum(len(found[i] & set(map(int, truth[i]))) for i in range(3000)) / 15000 >= 0.98
    for i in range(3000):
        assert sorted(exact[i]) == pytest.approx(sorted(s[i, truth[i]]), abs=2e-6)


def test_vectors_without_structure(spark):
    # uniform directions: many lists stay in reach, beyond the first two waves as well
    rng = np.random.default_rng(17)
    x = rng.standard_normal((2500, 16)).astype(np.float32)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    records = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, kind int, v array<float>").repartition(3)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = -np.sort(-s, axis=1)[:, :5]
    for exact, least in ((True, 1.0), (False, 0.95)):
        found = defaultdict(list)
        for r in neighbours.nearest(records, 5, lists=120, exact=exact).collect():
            found[r["id"]].append(r["similarity"])
        assert sum(sum(v >= truth[i, 4] - 2e-6 for v in found[i]) for i in range(2500)) >= least * 12500


def test_a_query_may_have_the_id_of_a_vector(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.standard_normal(4).astype(np.float32).tolist() for i in range(40)}
    queries = {i: rng.standard_normal(4).astype(np.float32).tolist() for i in range(0, 50, 7)} | {5: vectors[5]}
    a = spark.createDataFrame([(i, "c", v, at(1), "x", None) for i, v in vectors.items()], VECTORS)
    b = spark.createDataFrame([(i, None, v, at(1)) for i, v in queries.items()], QUERIES)
    assert pairs(neighbours.similar_pairs(a, b, dim=4)) == brute_pairs(vectors, queries)


def test_scan_abandons_without_loss():
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.standard_normal((400, 64)) + 2 * rng.standard_normal((8, 64))[rng.integers(0, 8, 400)])
    ids = rng.permutation(400)
    a, b, s = neighbours.scan(ids, x, np.full(400, -1.0), ids, x, 5)
    a = ids[a]
    full = x @ x.T
    np.fill_diagonal(full, -2)
    want = {(int(ids[i]), int(ids[j])) for i in range(400) for j in np.argsort(-full[i])[:5]}
    assert len(want & set(zip(a.tolist(), b.tolist()))) / len(want) > 0.98
    assert (s >= -1).all() and not (a == b).any()


# 2

HITS = "query_id int, coll string, leg string, node_id long, dist double, score double, logged_at timestamp, value string"


def brute_fusion(rows):
    last = {}
    for q, _, leg, n, dist, score, t, _ in rows:
        if None in (q, leg, n) or leg not in fuse.LEGS:
            continue
        good = (None if dist is None else -dist) if leg == "dense" else score
        key = (t is not None, t, good is not None, good)
        if (q, leg, n) not in last or key > last[q, leg, n]:
            last[q, leg, n] = key
    lists = defaultdict(list)
    for (q, leg, n), (_, _, _, good) in last.items():
        if good is not None and not math.isnan(good):
            lists[q, leg].append((-good, n))
    scores = defaultdict(float)
    for (q, _), found in lists.items():
        for pos, (_, n) in enumerate(sorted(found), 1):
            scores[q, n] += 1 / (60 + pos)
    best = defaultdict(list)
    for (q, n), s in scores.items():
        best[q].append((-round(s, 9), n))
    return {(q, n) for q, found in best.items() for _, n in sorted(found)[:5]}


def test_fusion_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for q in (1, 2, 3):
        for leg in ("dense", "lexical", "rerank"):
            for n in range(14):
                x = rng.choice([rng.uniform(-3, 3), 1.0, None, NAN, 1e9, -INF, INF, 0.0, -0.0])
                rows.append((q, None, leg, n, x if leg == "dense" else None, None if leg == "dense" else x, at(rng.randrange(9)), "x"))
    rows += [rows[0], (1, "c", "dense", 3, 0.001, None, at(99), None), (1, "c", "dense", 4, None, None, at(99), None), (None, "c", "dense", 4, 1.0, None, at(1), None), (1, "c", None, 4, 1.0, None, at(1), None), (1, "c", "other", 4, 1.0, 1.0, at(1), None), (4, "c", "rerank", 7, None, 1.0, None, None)]
    hits = spark.createDataFrame(rows, HITS)
    assert pairs(fuse.best(fuse.ranked(hits), "rrf").select("query_id", "node_id")) == brute_fusion(rows)
    assert fuse.best(fuse.ranked(hits.limit(0)), "rrf").count() == 0


def test_no_leg_rules_by_its_range(spark):
    rows = [(1, "c", "lexical", n, None, 1000.0 * n, at(1), None) for n in range(9)] + [(1, "c", "dense", n, 0.01 * n, None, at(1), None) for n in range(9)]
    values = {r["node_id"]: r["value"] for r in fuse.ranked(spark.createDataFrame(rows, HITS)).collect()}
    assert values[0] == pytest.approx(values[8]) and values[4] > values[0]
    shifted = [(q, c, leg, n, d, None if s is None else s * 1e6 - 5, t, v) for q, c, leg, n, d, s, t, v in rows]
    again = {r["node_id"]: r["value"] for r in fuse.ranked(spark.createDataFrame(shifted, HITS)).collect()}
    assert all(again[n] == pytest.approx(values[n]) for n in values)


def test_fusion_with_a_hot_query(spark):
    rng = random.Random(6)
    rows = [(7, "c", "lexical", n, None, float(rng.randrange(500)), at(1), None) for n in range(3000)] + [(q, "c", leg, n, 0.5 * n, 1.0 * n, at(1), None) for q in range(100, 400) for leg in fuse.LEGS for n in range(5)]
    assert pairs(fuse.best(fuse.ranked(spark.createDataFrame(rows, HITS)), "rrf").select("query_id", "node_id")) == brute_fusion(rows)


def test_spread_lists_equal_gathered_ones(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(q, "c", leg, n, x, x, at(1), None) for q in (1, 2, 3) for leg in fuse.LEGS for n in range(5 if q == 3 else 60) for x in [rng.choice([rng.uniform(-9, 9), 2.0, INF, 1e300, -0.0, 0.0])]]
    hits = spark.createDataFrame(rows, HITS)
    gathered = {tuple(r) for r in fuse.bounded(hits).select("query_id", "leg", "node_id", "value", "position").collect()}
    monkeypatch.setattr(fuse, "QUERY_ROWS", 20)
    assert {tuple(r) for r in fuse.bounded(hits).select("query_id", "leg", "node_id", "value", "position").collect()} == gathered and len(gathered) == len(rows)
    assert pairs(fuse.best(fuse.ranked(hits), "rrf").select("query_id", "node_id")) == brute_fusion(rows)


# 3 and 4

POSTINGS = "coll string, term string, node_id long, tf int, flushed_at timestamp, gram string, n int"


@pytest.fixture(scope="module")
def postings():
    rng = random.Random(9)
    rows = [("c", f"t{int(rng.paretovariate(0.7)) % 30}", rng.randrange(25), rng.choice([1, 2, 3, 5, 0, -1, None]), at(rng.choice([1, 2, 3, None])), "x", 1) for _ in range(500)]
    return [*rows, *rows[:20], ("c", None, 3, 1, at(1), None, None), ("c", "t1", None, 1, at(1), None, None), ("c", "solo", 1, 9, at(1), None, None), ("c", "", 1, 2, at(1), None, None)]


def clean(rows):
    last = {}
    for _, term, node, tf, t, _, _ in rows:
        if term is not None and node is not None:
            key = (t is not None, t or T0, -1 if tf is None else tf)
            if (term, node) not in last or key > last[term, node]:
                last[term, node] = key
    return {k: v[2] for k, v in last.items() if v[2] > 0}


def test_ppmi(spark, postings):
    held = clean(postings)
    terms, nodes = Counter(), Counter()
    for (t, n), tf in held.items():
        terms[t] += tf
        nodes[n] += tf
    smooth = sum(x**0.75 for x in nodes.values())
    want = {(n, t): max(0.0, math.log(tf * smooth / (terms[t] * nodes[n] ** 0.75))) for (t, n), tf in held.items()}
    df = spark.createDataFrame(postings, POSTINGS)
    scored = distinctive.ppmi(df)
    got = {(r["node_id"], r["term"]): r["ppmi"] for r in scored.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {(r["node_id"], r["term"]) for r in distinctive.kept_to_few(scored).collect()} == {(n, t) for (t, n), tf in held.items() if tf >= 3 and tf * 10 >= terms[t] * 3}
    assert distinctive.ppmi(df.limit(0)).count() == 0


def test_frequencies_and_marks(spark, postings):
    held = clean(postings)
    uses, nodes = Counter(), Counter()
    for (t, _), tf in held.items():
        uses[t] += tf
        nodes[t] += 1
    df = spark.createDataFrame(postings, POSTINGS)
    counts = frequency.count_postings(df)
    assert pairs(counts) == {(t, uses[t], nodes[t]) for t in uses}
    lengths = spark.createDataFrame([(i, None) for i in range(5)] + [(1, 3), (None, 1)], "node_id long, dl int")
    marks = frequency.marked(counts, frequency.records(lengths)).select("term", "mark")
    assert pairs(marks) == {(t, "rare") for t in uses if nodes[t] <= 2} | {(t, "common") for t in uses if nodes[t] * 3 > 5}
    assert frequency.marked(frequency.count_postings(df.limit(0)), frequency.records(lengths.limit(0))).count() == 0


def test_ngrams_against_counting(spark, monkeypatch):
    texts = ["a b a b a", "b a b", None, "", "A-b a!", "c", "a b a b a"]
    rows = [(i, t, at(1), "x") for i, t in enumerate(texts)] + [(0, "a b a b a", at(2), None), (None, "z", at(1), None)]
    df = spark.createDataFrame(rows, "node_id long, text string, added_at timestamp, gram string")
    monkeypatch.setattr(frequency, "BLOCK", 4)
    uses, held = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        for n in (1, 2, 3):
            for j in range(len(w) - n + 1):
                uses[n, " ".join(w[j : j + n])] += 1
                held[n, " ".join(w[j : j + n])].add(i)
    assert pairs(frequency.count_texts(df, width=3)) == {(n, g, c, len(held[n, g])) for (n, g), c in uses.items()}


@pytest.mark.parametrize("depth", [None, 1, 2, 3])
def test_suffix_arrays_and_intervals(depth):
    rng = np.random.default_rng(1)
    for _ in range(60):
        recs = [rng.integers(0, 3, rng.integers(1, 12)) for _ in range(rng.integers(1, 6))]
        recs += recs[:1]
        codes, size = np.concatenate(recs), np.array([len(r) for r in recs])
        left, rec = np.repeat(np.cumsum(size), size) - np.arange(size.sum()), np.repeat(np.arange(len(size)), size)
        suffix = [tuple(codes[i : i + left[i]]) for i in range(len(codes))]
        order, common = frequency.suffix_array(codes, left, depth)
        cut = [suffix[i][:depth] for i in order]
        assert cut == sorted(cut)
        for j in range(1, len(order)):
            a, b = suffix[order[j - 1]], suffix[order[j]]
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[j] == shared if depth is None else min(common[j], depth) == min(shared, depth)
        uses, held = Counter(), defaultdict(set)
        for i, x in enumerate(suffix):
            for n in range(1, len(x) + 1 if depth is None else min(len(x), depth) + 1):
                uses[x[:n]] += 1
                held[x[:n]].add(rec[i])
        got = {suffix[r][:n]: (a, b) for n, row, oc, rc in frequency.intervals(codes, rec, left, depth) for r, a, b in zip(row, oc, rc)}
        assert got == {g: (c, len(held[g])) for g, c in uses.items()}


def test_ngrams_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(frequency, "BLOCK", 5)
    texts = ["a b c a b c", "b c a b", "c", None]
    uses, held = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for n in range(1, len(w) + 1):
            for j in range(len(w) - n + 1):
                uses[n, " ".join(w[j : j + n])] += 1
                held[n, " ".join(w[j : j + n])].add(i)
    df = spark.createDataFrame([(i, t, at(1)) for i, t in enumerate(texts)], "node_id long, text string, added_at timestamp")
    assert pairs(frequency.count_texts(df, width=None)) == {(n, g, c, len(held[n, g])) for (n, g), c in uses.items()}


# 5


def naive_pieces(t, limit, overlap):
    def kind(e):
        if t[e - 1] == "\n" and (j := t.rfind("\n", 0, e - 1)) >= 0 and not t[j + 1 : e - 1].strip(" \t\r"):
            return 0
        if t[e - 1] in "。！？" or t[e - 1] in ".!?" and e < len(t) and t[e] in " \t\r\n":
            return 1
        return 2 if t[e - 1] in " \t\r\n" else 3

    out, s = [], 0
    while len(t) - s > limit:
        ends = [e for e in range(s + limit, s, -1) if e > s + limit / 2]
        e = next((e for k in range(3) for e in ends if kind(e) == k), s + limit)
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(t))] if out else []


def test_split_against_the_rule():
    rng = random.Random(7)
    for _ in range(600):
        t = "".join(rng.choice("ab🙂 .!?。\n\n\r\t") if rng.random() < 0.5 else "x" for _ in range(rng.randrange(1, 160)))
        limit = rng.choice([7, 10, 31])
        overlap = rng.randrange(0, limit // 2 + 1)
        assert split.pieces(t, limit, overlap) == naive_pieces(t, limit, overlap), (t, limit, overlap)
        found = split.pieces(t, limit, overlap, "balanced")
        for (a, b), (c, _) in zip(found, found[1:]):
            assert 0 < b - a <= limit and b - c == overlap
        assert not found or found[0][0] == 0 and found[-1][1] == len(t)
    assert len(split.pieces("y" * 200_000, 100, 10)) == math.ceil((200_000 - 100) / 90) + 1
    assert split.pieces("abcdefghij", 4, 99) and split.pieces("abc", 0)  # still moves on


def test_balanced_split_is_the_cheapest():
    def cost(found, ends, limit):
        total = 0.0
        for a, e in found[:-1]:
            kinds = [k for k in range(3) if e in ends[k]]
            total += split.PENALTIES[min(kinds, default=3)] + (1 - (e - a) / limit) ** 2
        return total + (1 - (found[-1][1] - found[-1][0]) / limit) ** 2

    def cheapest(n, ends, limit, overlap):
        best = {}
        for s in range(n - 1, -1, -1):
            if n - s <= limit:
                best[s] = (1 - (n - s) / limit) ** 2
                continue
            best[s] = min(best[e - overlap] + split.PENALTIES[min((k for k in range(3) if e in ends[k]), default=3)] + (1 - (e - s) / limit) ** 2 for e in range(s + 1, s + limit + 1) if e > s + limit / 2 and (e == s + limit or any(e in x for x in ends)))
        return best[0]

    rng = random.Random(11)
    for _ in range(120):
        t = "".join(rng.choice(["x" * rng.randrange(1, 9), " ", " ", ". ", "\n\n"]) for _ in range(rng.randrange(40, 160)))
        limit = rng.choice([20, 41, 64])
        overlap = rng.choice([0, 0, 3, 9])
        found = split.pieces(t, limit, overlap, "balanced")
        if found:
            ends = [set(map(int, x)) for x in split.boundaries(t)]
            assert all(e - a > limit / 2 for a, e in found[:-1])
            assert cost(found, ends, limit) == pytest.approx(cheapest(len(t), ends, limit, overlap), abs=1e-9), (t, limit, overlap)


def test_leading_split_is_the_least_in_order():
    def least(n, ends, limit, overlap):
        best = {}
        for s in range(n - 1, -1, -1):
            if n - s <= limit:
                best[s] = [(-1, n - s)]
                continue
            found = [(min((k for k in range(3) if e in ends[k]), default=3), s + limit - e, e) for e in range(s + 1, s + limit + 1) if e > s + limit / 2 and (e == s + limit or any(e in x for x in ends))]
            best[s] = min([(k, slack), *best[max(e - overlap, s + 1)]] for k, slack, e in found)
        return best[0]

    rng = random.Random(13)
    for _ in range(80):
        t = "".join(rng.choice(["x" * rng.randrange(1, 9), " ", " ", ". ", "\n\n"]) for _ in range(rng.randrange(40, 120)))
        limit = rng.choice([20, 41, 64])
        overlap = rng.choice([0, 3, limit // 2, limit - 5, limit - 1])
        found = split.pieces(t, limit, overlap)
        if found:
            ends = [set(map(int, x)) for x in split.boundaries(t)]
            assert [(min((k for k in range(3) if e in ends[k]), default=3), limit - (e - s)) for s, e in found[:-1]] == least(len(t), ends, limit, overlap)[:-1], (t, limit, overlap)
            balanced = split.pieces(t, limit, overlap, "balanced")
            assert balanced[0][0] == 0 and balanced[-1][1] == len(t) and all(c == max(b - overlap, a + 1) and limit / 2 < b - a <= limit for (a, b), (c, _) in zip(balanced, balanced[1:]))


def test_split_tables(spark):
    long = "word " * 300
    docs = spark.createDataFrame([(1, "a", long, at(1), 5), (1, "a", long, at(2), 5), (2, "b", long, None, 5), (3, "zz", long, at(1), 5), (4, None, "short", at(1), 5), (5, "a", None, at(1), 5), (None, "a", long, at(1), 5), (6, "a", "now short", at(3), 5), (6, "a", long, at(1), 5)], "node_id long, coll string, text string, added_at timestamp, size int")
    config = spark.createDataFrame([("a", 100, 10), ("b", None, None), (None, 1, 1)], "coll string, max_len int, overlap_len int")
    got = defaultdict(list)
    for r in split.split(docs, config).orderBy("node_id", "start_pos").collect():
        got[r["node_id"]].append((r["start_pos"], r["end_pos"]))
    assert dict(got) == {1: split.pieces(long, 100, 10), 2: split.pieces(long, 512, 0), 3: split.pieces(long, 512, 0)}
    assert split.split(docs.limit(0), config).count() == 0 and split.split(docs, config.limit(0)).count() > 0


# 6


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(150):
        base = rng.sample(vocabulary, rng.randrange(25, 60))
        texts[f"d{i}"] = base
        for j in range(rng.randrange(0, 4)):
            edited = list(base)
            for _ in range(rng.randrange(0, 8)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rng.shuffle(edited)
            texts[f"e{i}-{j}"] = edited
    monkeypatch.setattr(neardup, "LEAF", 8)
    rows = [(k, " ".join(v), at(1), "x") for k, v in texts.items()] + [("d0", " ".join(texts["d0"]), at(2), "x"), ("n", None, at(1), "x"), (None, "a b", at(1), None), ("e", "", at(1), None)]
    df = spark.createDataFrame(rows, "id string, text string, added_at timestamp, cid string").repartition(3)
    sets = {k: set(v) for k, v in texts.items() if len(set(v)) >= 30}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 8}
    got = pairs(neardup.near_duplicates(df))
    assert got <= want and len(got) >= 0.99 * len(want)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 64, 65])
def test_classes_of_any_size_take_one_form(spark, monkeypatch, n):
    monkeypatch.setattr(neardup, "IDS", 7)
    words, rng = [f"w{i}" for i in range(40)], random.Random(2)
    rows = []
    for i in range(n):  # one set of terms in many orders, copies of the first, and a class that is similar to it
        rng.shuffle(words)
        rows += [(f"r{i:02}", " ".join(words), at(1)), (f"s{i:02}", " ".join([*words, "more"]), at(1))]
    rows += [(f"c{i}", rows[0][1], at(1)) for i in range(5)]
    df = spark.createDataFrame([*rows, ("far", " ".join(f"v{i}" for i in range(40)), at(1))], "id string, text string, added_at timestamp")
    ids = [r[0] for r in rows]
    assert pairs(neardup.near_duplicates(df)) == {(a, b) for a in ids for b in ids if a < b}
    assert pairs(neardup.linked(df)) == {(i, "s00" if i[0] == "s" else "c0", len(ids) - 1) for i in ids} | {("far", "far", 0)}
    assert neardup.linked(df.limit(0)).count() == 0


def test_crowded_nodes_are_compared_in_parts(spark, monkeypatch):
    # a few rows are held at a time, so one node of templated records fills the buffer again and again
    rng = random.Random(5)
    core = [f"w{i}" for i in range(60)]
    texts = {f"d{i:03}": [*core, *rng.sample([f"x{j}" for j in range(60)], 12)] for i in range(160)}
    df = spark.createDataFrame([(k, " ".join(v), at(1)) for k, v in texts.items()], "id string, text string, added_at timestamp")
    want = {(a, b) for a in texts for b in texts if a < b and len({*texts[a]} & {*texts[b]}) * 10 >= len({*texts[a]} | {*texts[b]}) * 8}
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "HELD_ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = pairs(neardup.near_duplicates(df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 1000


def test_dense_families_keep_their_recall(spark):
    # one family, every pair at exactly 0.8: nodes become small at ten levels or so only
    core, n = " ".join(f"w{i}" for i in range(80)), 900
    df = spark.createDataFrame([(f"d{i:03}", f"{core} " + " ".join(f"x{i}y{j}" for j in range(10)), at(1)) for i in range(n)], "id string, text string, added_at timestamp")
    found = neardup.near_duplicates(df)
    assert found.distinct().count() >= 0.995 * n * (n - 1) / 2


def test_paths_split_by_agreement():
    x = neardup.minwise(np.arange(200, dtype=np.uint64), np.array([0, 100, 200]))
    assert (x[0] != x[1]).mean() > 0.9 and neardup.agreement(neardup.sketch(x[:1]), neardup.sketch(x[:1]))[0] == neardup.TOKENS
    p = neardup.paths(np.stack([x[0], x[0], x[1]]), 3)
    assert (p[0] == p[1]).all() and (p[0] != p[2]).any()


# 7


@pytest.fixture(scope="module")
def reference_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_public_library(spark, reference_tokenizer):
    rng = random.Random(3)
    pool = "ab AB  \t\n.'s'll0123é漢字🙂​\x1c\x85\xa0ß<|endoftext|>_-"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(1500)] + ["   ", "\n", "a" * 20_000, " " * 9_999 + "x", "unbelievable unbelievably", "<|endoftext|>"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(9001, None, "x"), (9002, "", "x"), (None, "ab", None)]
    got = {r["doc_id"]: r["ids"] for r in encode.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)).collect()}
    assert got[9001] == [] and got[9002] == [] and len(got) == len(rows)
    for i, t in enumerate(texts):
        assert got[i] == reference_tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_prefixes_are_shared():
    e = encode.encoder(encode.VOCABULARY)
    words = {" internationalisation", " internationalise", " internationally", " international"}
    seen = []
    original = e._extend
    e._extend = lambda w, last: (seen.append(len(w) + 1 - len(last)), original(w, last))[1]
    try:
        e.learn(words)
    finally:
        del e._extend
    assert sum(seen) < 0.6 * sum(map(len, words))


# 8


@pytest.mark.parametrize("counts", [{"a": 5, "b": 3, "c": 2}, {"a": 1}, {"a": 997, "b": 2, "c": 1}, {"a": 7, "b": 7, "c": 0}])
def test_pfair_stays_within_a_block(counts):
    slots = mix.pfair(counts)
    total, used = sum(counts.values()), Counter()
    assert len(slots) == total
    for t, s in enumerate(slots, 1):
        used[s] += 1
        assert all(abs(used[x] - n * t / total) < 1 for x, n in counts.items())


def test_fill():
    assert mix.fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 10}, 40) == {"a": 30.0, "b": 10.0}
    assert sum(mix.fill({"a": 0.5, "b": 0.5}, {"a": 5, "b": 10}, 40).values()) == 15


def test_mix(spark):
    rows = [(i, "word " * (1 + i % 7), "big", "x") for i in range(300)] + [(1000 + i, "word word", "small", "x") for i in range(10)] + [(2000, None, "small", "x"), (2001, "x", None, "x"), (2002, "x", "other", "x"), (None, "x", "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.6, 3), ("small", 0.3, 2), ("absent", 0.1, 5), (None, 0.1, 1), ("zero", 0.0, None)], "source string, target_weight double, max_repeats int")
    sized = mix.sizes(docs, targets)
    caps = mix.capacities(sized, targets)
    assert {r["source"] for r in caps.where("short").collect()} == {"small", "absent"}
    mixed = mix.schedule(sized, caps, block=16).cache()
    uses = Counter((r["source"], r["doc_id"]) for r in mixed.collect())
    assert max(uses.values()) <= 3 and {n for (s, _), n in uses.items() if s == "small"} == {2} and len([1 for s, _ in uses if s == "small"]) == 11
    rows = mixed.orderBy("slot").collect()
    assert len({(r["source"], r["doc_id"], r["repeat"]) for r in rows}) == len(rows)
    share = {r["source"]: r for r in mix.shares(mixed, caps).collect()}
    total = sum(r["used"] for r in share.values())
    assert share["absent"]["used"] == 0 and share["small"]["actual_share"] == pytest.approx(share["small"]["used"] / total) and sum(r["actual_share"] for r in share.values()) == pytest.approx(1)
    assert mix.schedule(sized.limit(0), mix.capacities(sized.limit(0), targets)).count() == 0


def test_long_schedules_stay_within_a_block(spark):
    # one-token documents and blocks of one token: a slot holds one document
    n, weight = 40_003, {"a": 0.6137, "b": 0.2871, "c": 0.0641, "d": 0.0351}
    sized = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, weight)), (F.col("id") % 4 + 1).cast("int")).alias("source"), F.lit(1).cast("long").alias("tokens"))
    targets = spark.createDataFrame([(s, w, 3) for s, w in weight.items()], "source string, target_weight double, max_repeats int")
    rows = sorted((r["slot"], r["source"]) for r in mix.schedule(sized, mix.capacities(sized, targets), block=1).select("slot", "source").collect())
    total = Counter(s for _, s in rows)
    assert [t for t, _ in rows] == list(range(len(rows))) and len(rows) > 40_000
    used = Counter()
    for t, s in rows:
        used[s] += 1
        assert all(abs(used[x] - total[x] * (t + 1) / len(rows)) < 1 for x in total)


def test_schedule_decides_which_sources_are_short(spark, tmp_path, monkeypatch):
    from lodeseek.llm.queries import QUERIES as known

    size = {"a": 30, "b": 50, "c": 20, "empty": 0, "few": 1}
    texts = {s: [" word" * 10] * (n // 10) if n > 1 else [" word"] * n for s, n in size.items()}
    texts["empty"] = [None, ""]
    rows = [(t, s) for s, ts in texts.items() for t in ts] + [("x", "other"), ("x", None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    unlimited, total = 2**31 - 1, sum(size.values())
    tables = [
        {"a": (0.4, 1), "b": (0.3, 1), "c": (0.2, 1), "empty": (0.05, 9), "few": (0.05, unlimited), "absent": (0.0, None)},
        {"a": (0.6, 2), "b": (0.1, 3), "c": (0.2, 1), "few": (0.05, 5), "absent": (0.05, unlimited)},
        {"a": (0.9, 3), "b": (0.9, 1), "c": (0.9, 5), "empty": (0.9, unlimited), "few": (90.0, unlimited)},  # more than the whole
        {"a": (30 / 101, 1), "b": (51 / 101, 1), "c": (None, 2), "few": (0.0, -1), "empty": (0.1, -1)},
    ]
    slots, pfair, schedule = [], mix.pfair, mix.schedule
    monkeypatch.setattr(mix, "pfair", lambda counts: slots.append(pfair(counts)) or slots[-1])
    for i, targets in enumerate(tables):
        d = tmp_path / str(i)
        d.mkdir()
        (d / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame([(s, *x) for s, x in targets.items()], "source string, target_weight double, max_repeats int").write.parquet(f"{d}/mix_targets.parquet")
        whole = sum(size.get(s, 0) for s in targets)
        short = {s for s, (w, n) in targets.items() if size.get(s, 0) * max(n or 0, 0) < (w or 0) * whole}
        assert whole == total and {r["source"] for r in known["p8_found"](spark, str(d)).collect()} == short and len(slots) == i + 1
    # what the schedule doesn't hold is missed, whatever the capacities say
    monkeypatch.setattr(mix, "schedule", lambda *args, **kw: schedule(*args, **kw).where("source <> 'b'"))
    assert {r["source"] for r in known["p8_found"](spark, f"{tmp_path}/1").collect()} == {"a", "absent", "b", "c", "few"}


def test_schedule_of_targets_leaves_missed_slots_empty(spark):
    sized = spark.createDataFrame([(i, "ab"[i % 2], 1) for i in range(40)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], "source string, target_weight double, max_repeats int")
    caps = mix.capacities(sized, targets)
    rows = mix.schedule(sized, caps, block=2, spread=False).collect()
    # a can fill 10 of its 15 slots and is asked for 11, b fills its 5
    assert Counter(r["source"] for r in rows) == {"a": 20, "b": 10}
    assert {r["slot"] for r in rows if r["source"] == "b"} == {t for t, s in enumerate(mix.pfair({"a": 11, "b": 5})) if s == "b"}
    assert len({r["slot"] for r in rows}) == 15 and [r["source"] for r in mix.missed(sized, caps, block=2).collect()] == ["a"]


def test_small_sources_of_any_number_of_uses(spark):
    sized = spark.createDataFrame([(1, "one", 1), (2, "big", 60_000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("one", 0.5, 2**31 - 1), ("big", 0.5, 2**31 - 1)], "source string, target_weight double, max_repeats int")
    caps = mix.capacities(sized, targets)
    rows = mix.schedule(sized, caps).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("start").alias("m"), F.max("repeat").alias("last")).collect()
    assert {(r["source"], r["n"], r["m"], r["last"]) for r in rows} == {("one", 30_001, 30_001, 30_000), ("big", 1, 1, 0)}
    assert mix.missed(sized, caps).count() == 0


# 9


def test_sentences():
    assert subjects.sentences("One two. Three<br/>four\\nfive! [note 3] Six-seven 0.5 x") == [["one", "two"], ["three"], ["four"], ["five"], ["six-seven", "x"]]
    assert subjects.sentences(None) == [] and subjects.sentences("let a = f(b)[c];(d)") == []
    assert subjects.sentences("WÃ¤rme d\\u00edas") == [["wärme", "días"]]


def test_prose_with_markup_or_code_keeps_its_words():
    of = lambda s: subjects.sentences(s)
    assert of("Every hurdle was measured at the old site f(x)=x**2;//ok 44 times; the midfielder (a guest) was measured once.") == ["every hurdle was measured at the old site times midfielder a guest once".split()]
    assert of("** pinned ** the judge read the verdict") == ["pinned the judge read verdict".split()]
    assert of("Most f(x)=x**2;//ok budgets rose.") == [["most", "budgets", "rose"]]
    assert of("===== Verdict =====") == [["verdict"]]
    assert of("The <b>court</b> heard the <i>appeal</i> again") == ["the court heard appeal again".split()]
    for code in ("for (int i = 0; i < n; i++) {", "const total = items.reduce((a, b) => a + b, 0);", "if (a == b && c != d) { return; }"):
        assert of(code) == []


def test_subject_areas(spark):
    rng = random.Random(8)
    nouns = {"law": "judge court verdict statute appeal clause".split(), "sport": "goal court striker league medal referee".split(), "food": "oven dough spice broth garlic yeast".split()}

    def sentence(s):
        a, b = rng.sample(nouns[s], 2)
        return rng.choice(["The {} was moved near the {}.", "Nobody expected the {} and the {} today.", "Why does the {} need a {}?"]).format(a, b)

    general = ["Nothing else changed.", "Please read the report before noon."]
    docs, truth, labels = [], {}, []
    for i in range(600):
        mine = rng.sample(sorted(nouns), rng.choice([0, 1, 1, 1, 2]))
        body = [sentence(s) for s in mine for _ in range(4)] + [rng.choice(general) for _ in range(2)]
        if mine and rng.random() < 0.2 and len(mine) == 1:
            body.append(sentence(rng.choice([s for s in nouns if s not in mine])))  # a passing mention
        rng.shuffle(body)
        docs.append((i, " ".join(body), "en"))
        truth[i] = set(mine)
        if i % 4 == 0:
            labels += [(i, s if rng.random() < 0.95 else "food", "a", at(1)) for s in mine]
    docs += [(9000, None, "en"), (9001, "", "en"), (9002, "  ", None), (None, "The judge and the verdict.", "en")]
    labels += [(None, "law", "a", at(1)), (1, None, "a", at(1)), (2, "unknown", "a", at(1)), (88_888, "law", "a", at(1)), *labels[:5]]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labeller string, labelled_at timestamp")
    known = spark.createDataFrame([(s, "") for s in nouns] + [(None, "")], "subject string, description string")
    got = defaultdict(set)
    for r in subjects.subject_areas(d, lab, known).collect():
        got[r["doc_id"]].add(r["subject"])
    held_out = [i for i in truth if i % 4]
    assert sum(got[i] == truth[i] for i in held_out) / len(held_out) > 0.95
    assert not got.keys() & {9000, 9001, 9002}
    assert subjects.subject_areas(d, lab.limit(0), known).count() == 0 and subjects.subject_areas(d.limit(0), lab, known).count() == 0


def test_words_that_tell_a_subject_only_together(spark):
    # the subject is the parity of three marks: no word and no pair tells anything
    rng = random.Random(4)
    docs, truth = [], {}
    for i in range(800):
        marks = [rng.randrange(2) for _ in range(3)]
        truth[i] = "odd" if sum(marks) % 2 else "even"
        words = [f"{'xyz'[j]}{'ab'[m]}" for j, m in enumerate(marks)] + rng.sample("one two three four five six".split(), 2)
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(0, 800, 2)], "doc_id long, subject string")
    got = pairs(subjects.subject_areas(d, labels, spark.createDataFrame([("odd", ""), ("even", "")], "subject string, description string")))
    assert got == {(i, s) for i, s in truth.items()}


def test_all_matching_rules_count():
    gain = {"a": 1.0, "b": -1.0}
    rules = subjects.Rules({"a": 0.5, "b": 0.5}, {"u": gain, "v": gain}, {"u": [(frozenset("uv"), gain), (frozenset("uw"), gain)], "x": [(frozenset("xy"), gain)], "u2": []})
    assert rules.evidence(["u", "v", "w", "x", "y"]) == pytest.approx({"a": 2.5, "b": -2.5})
    assert rules.evidence(["u", "x"]) == gain and rules.evidence(["w", "y"]) == {}
