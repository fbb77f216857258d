"""The engine's own operators against brute force, truth tables and round trips."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import register, text as tx, vectors as vx
from lodeseek.operators import embed, evaluate, exact, filters, fusion, graph, keyword, quantized
from lodeseek.operators.topk import positions, top_k
from lodeseek.plans.collection import Collection
from lodeseek.plans import sweep
from lodeseek.plans.queries import QUERIES
from lodeseek.sources import corpus, generators, snapshot
from lodeseek.streaming import ingest

RECORDS = {
    "m1": {"n": 1, "s": "b", "t": ["x", "y"], "z": None},
    "m2": {"n": 1.0, "s": "a"},
    "m3": {"n": "1"},
    "m4": {"n": True},
    "m5": {},
    "m6": None,
}
TRUTH = [
    ({"n": 1}, "m1 m2"),
    ({"n": {"$ne": 1}}, "m3 m4 m5 m6"),
    ({"n": {"$gte": 1}}, "m1 m2"),
    ({"s": {"$gt": "a"}}, "m1"),
    ({"t": "x"}, "m1"),
    ({"t": ["x", "y"]}, ""),
    ({"t": {"$in": ["q", "y"]}}, "m1"),
    ({"t": {"$nin": ["y"]}}, "m2 m3 m4 m5 m6"),
    ({"z": None}, "m1"),
    ({"z": {"$exists": True}}, "m1"),
    ({"s": {"$exists": False}}, "m3 m4 m5 m6"),
    ({"$nor": [{"n": 1}, {"s": "a"}]}, "m3 m4 m5 m6"),
    ({"$or": [{"n": True}, {"s": "a"}], "n": {"$exists": True}}, "m2 m4"),
    ({}, "m1 m2 m3 m4 m5 m6"),
]


@pytest.fixture(scope="module")
def metas(spark):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in RECORDS.items()] + [("broken", "{oops"), ("none", None)], "k string, m string").cache()


@pytest.mark.parametrize("spec, want", TRUTH)
def test_variant_filters(metas, spec, want):
    got = {r["k"] for r in metas.where(filters.compile_json(spec, F.col("m"))).collect()} - {"broken", "none"}
    assert got == set(want.split()) == {k for k, v in RECORDS.items() if filters.matches(spec, v)}


@pytest.mark.parametrize("spec", ["x", {"n": {"$foo": 1}}, {"$foo": []}, {"$and": []}, {"n": {"$in": 1}}, {"n": {"$exists": 1}}, {"n": {}}, {"n": {"$gt": 1, "b": 2}}])
def test_filter_errors(spec):
    with pytest.raises(ValueError):
        filters.parse(spec)


def test_typed_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (3, "b", ["y", "z"])], "n long, s string, t array<string>")
    run = lambda spec: [r["n"] for r in df.where(filters.compile_typed(spec, df.schema)).orderBy("n").collect()]
    assert run({"s": {"$ne": "a"}}) == [2, 3]
    assert run({"t": "z"}) == [3]
    assert run({"n": {"$gt": 1.5}}) == [2, 3]
    assert run({"n": 1.0}) == [1]
    assert run({"s": 1}) == []
    assert run({"gone": {"$nin": [1]}}) == [1, 2, 3]


def brute(docs, queries, k, metric="dot"):
    out = []
    for q, v in queries:
        d = [(round(1 - float(np.dot(v, x)) if metric == "dot" else float(((v - x) ** 2).sum()), 9), i) for i, x in docs]
        out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(d)[:k])]
    return out


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("query_bytes", [1 << 20, 64])
def test_exact_against_brute_force(spark, metric, query_bytes):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 4)).astype(np.float32)
    x[7] = x[3]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "node_id long, v array<float>").repartition(3)
    qs = [(i, x[i].astype(float)) for i in (3, 7, 20)]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in qs], "query_id long, v array<float>")
    want = brute([(i, v.astype(float)) for i, v in enumerate(x)], qs, 5, metric)
    for got in (exact.exact_top_k(docs, queries, 5, metric, query_bytes=query_bytes, doc_block=7), exact.native_top_k(docs.where("v is not null"), queries, 5, metric)):
        assert sorted((r["query_id"], r["rank"], r["node_id"]) for r in got.collect()) == want
    assert exact.exact_top_k(docs, queries, 0).count() == 0
    assert exact.exact_top_k(docs, queries.limit(0), 3).count() == 0


def test_blocks_of_bounded_size_lose_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    x, q = rng.integers(-3, 4, (900, 5)).astype(float), rng.integers(-3, 4, (70, 5)).astype(float)
    ids = rng.permutation(900)
    want = exact.nearest_rows("l2", 6, q, ids, x)
    held = []
    monkeypatch.setattr(exact, "PRODUCTS", 500)
    monkeypatch.setattr(exact, "DOC_ROWS", 64)
    got = exact.nearest_rows("l2", 6, q, ids, x, lambda a, b: (held.append(len(a) * len(b)), exact.distances("l2", a, b))[1])
    assert max(held) <= 500 and [ids[got[1]].tolist(), got[0].tolist()] == [ids[want[1]].tolist(), want[0].tolist()]


def test_many_queries_in_blocks(spark):
    # 65,000 queries in one block against batches of rows: more than a task could hold at once
    docs = generators.uniform(spark, 3_000, 4, 1, 2)
    queries = generators.uniform(spark, 65_000, 4, 2, 4).select(F.col("node_id").alias("query_id"), "v")
    got = exact.exact_top_k(docs, queries, 1).where("query_id % 1000 = 0").collect()
    x, q = (np.array([r["v"] for r in df.orderBy(c).collect()], dtype=float) for df, c in ((docs, "node_id"), (queries.where("query_id % 1000 = 0"), "query_id")))
    assert {r["query_id"] // 1000: r["node_id"] for r in got} == dict(enumerate((1 - q @ x.T).argmin(1).tolist()))


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i % 5}", i / 2) for i in range(50)], "n long, s string, x double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for spec, pushed in (({"s": "s1"}, "EqualTo(s,s1)"), ({"n": {"$gte": 10, "$lt": 20}}, "GreaterThanOrEqual(n,10)"), ({"n": {"$gt": 9.5}}, "GreaterThan(n,9)"), ({"s": {"$in": ["s1", "s2", 3]}}, "In(s, [s1,s2])"), ({"$or": [{"x": {"$lt": 3}}, {"n": 7.0}]}, "Or(")):
        found = df.where(filters.compile_typed(spec, df.schema))
        assert pushed in found._jdf.queryExecution().executedPlan().toString().replace("\n", " "), spec
        assert {r["n"] for r in found.collect()} == {r["n"] for r in df.collect() if filters.matches(spec, r.asDict())}
    for spec in ({"n": 2.5}, {"n": {"$lte": 2.5}}, {"n": {"$lt": float("inf")}}, {"n": 1e30}, {"$nor": [{"s": "s1"}, {"n": {"$gt": 30}}]}):
        assert {r["n"] for r in df.where(filters.compile_typed(spec, df.schema)).collect()} == {r["n"] for r in df.collect() if filters.matches(spec, r.asDict())}, spec


def test_quantize_clamps_and_rounds_half_away(spark):
    df = spark.createDataFrame([([-0.3, 0.0, 0.29, -0.15, 0.3, 5.0, float("nan")],)], "v array<float>")
    code = df.select(vx.quantize(F.col("v"), 0.3).alias("c")).first()["c"]
    assert code == [-127, 0, 123, -64, 127, 127, 0]


def test_hamming_counts_the_sign_bit(spark):
    assert spark.createDataFrame([([-1, 5], [0, 5])], "a array<bigint>, b array<bigint>").select(vx.hamming(F.col("a"), F.col("b")).alias("h")).first()["h"] == 64
    assert vx.popcount(np.array([-1])).tolist() == [64]


def test_usable(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), (None,), ([None, 1.0],)]
    got = [r["u"] for r in spark.createDataFrame(rows, "v array<float>").select(vx.usable(F.col("v"), 2).alias("u")).collect()]
    assert got == [True] + [False] * 6


def test_tokens_are_ascii_only(spark):
    got = spark.createDataFrame([("Où Kelvin \u212a!",), (None,), ("",)], "t string").select(tx.tokens(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == [["o", "kelvin"], [], []]


def test_bm25(spark):
    texts = ["a lodestone points north", "sailors read charts by lamplight", "the chart shows a reef north of the reef", None]
    docs = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "node_id long, text string")
    qs = spark.createDataFrame([(1, "Reef, NORTH?"), (2, "zzz"), (3, None)], "query_id long, text string")
    got = keyword.search(keyword.postings(docs), keyword.doc_lengths(docs), qs, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["node_id"]) for r in got] == [(1, 12), (1, 10)]
    avg = (4 + 5 + 9) / 4
    weight = lambda df, tf, dl: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got[0]["score"] == pytest.approx(weight(1, 2, 9) + weight(2, 1, 9)) and got[1]["score"] == pytest.approx(weight(2, 1, 4))


def test_bm25_beyond_the_literal_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 17}" for j in range(9))) for i in range(40)], "node_id long, text string")
    qs = spark.createDataFrame([(i, f"t{i} t{i + 3}") for i in range(12)], "query_id long, text string")
    run = lambda: {tuple(r) for r in keyword.search(keyword.postings(docs), keyword.doc_lengths(docs), qs, 4).select("query_id", "rank", "node_id").collect()}
    few = run()
    monkeypatch.setattr(keyword, "FEW_TERMS", 3)
    assert run() == few and len(few) == 48


def test_rrf(spark):
    rows = "query_id long, node_id long, rank int"
    a = spark.createDataFrame([(7, 40, 1), (7, 41, 2), (7, 42, 3)], rows)
    b = spark.createDataFrame([(7, 42, 1), (7, 43, 2)], rows)
    got = [(r["node_id"], r["score"]) for r in fusion.fuse([(a, 1), (b, 2)], 9).orderBy("rank").collect()]
    assert got == [(42, round(1 / 63 + 2 / 61, 9)), (43, round(2 / 62, 9)), (40, round(1 / 61, 9)), (41, round(1 / 62, 9))]
    # a list of weight 0 still pads the tail
    assert [(r["node_id"], r["score"]) for r in fusion.hybrid(a, b, 1.0, 9).orderBy("rank").collect()][3] == (43, 0.0)
    assert fusion.fetch_size(5, 1000, False) == 20 and fusion.fetch_size(5, 1000, True) == 80 and fusion.fetch_size(5, 30, True) == 30


def test_positions_of_a_hot_group(spark):
    rows = [(0, float(i % 7), i) for i in range(500)] + [(1, 1.0, 1)]
    df = spark.createDataFrame(rows, "g long, x double, i long")
    got = {(r["g"], r["i"]): r["position"] for r in positions(df, ["g"], [("x", False), ("i", True)]).collect()}
    want = sorted((-x, i) for g, x, i in rows if g == 0)
    assert got == {(0, i): n + 1 for n, (_, i) in enumerate(want)} | {(1, 1): 1}
    sums = {r["i"]: r["before"] for r in positions(df.where("g = 0"), ["g"], [("i", True)], "before", weight="i").collect()}
    assert sums == {i: sum(range(i)) for i in range(500)}


@pytest.mark.parametrize("over, floor", [({}, 0.95), ({"metric": "l2"}, 0.95), ({"int8": True, "qrange": 1.0}, 0.93), ({"cascade": True}, 0.8)])
def test_graph_recall(spark, over, floor):
    docs = generators.clustered(spark, 1200, 16, 16, 7, 4).cache()
    queries = docs.where("node_id % 40 = 0").select(F.col("node_id").alias("query_id"), "v")
    config = graph.GraphConfig(m=8, ef_construction=48, shard_rows=600, **over)
    nodes = graph.build(docs, config).cache()
    truth = exact.exact_top_k(docs, queries, 10, config.metric)
    assert evaluate.mean_recall(graph.search(nodes, queries, 10, 64, config), truth).first()["recall"] >= floor
    if not over:
        even = docs.where("node_id % 2 = 0")
        found = graph.search(nodes, queries, 10, 64, config, even)
        assert found.where("node_id % 2 = 1").count() == 0
        assert evaluate.mean_recall(found, exact.exact_top_k(even, queries, 10)).first()["recall"] >= 0.9
        again = graph.build(docs.repartition(3), config)
        assert nodes.select("node_id", "level", "links").exceptAll(again.select("node_id", "level", "links")).count() == 0
        stats = graph.graph_stats(nodes).first()
        assert stats["nodes"] == 1200 and graph.pack(nodes).agg(F.sum(F.size("neighbours"))).first()[0] == stats["links"]


def test_packed_graphs(spark):
    docs = generators.clustered(spark, 900, 16, 9, 3, 3).cache()
    config = graph.GraphConfig(m=6, ef_construction=40, shard_rows=300)
    queries = docs.where("node_id % 30 = 0").select(F.col("node_id").alias("query_id"), "v")
    nodes, packed = graph.build(docs, config, 3).cache(), graph.build_packed(docs, config, 3).cache()
    rows = lambda df: sorted((r["query_id"], r["rank"], r["node_id"]) for r in df.collect())
    assert rows(graph.search_packed(packed, queries, 5, 40, config)) == rows(graph.search(nodes, queries, 5, 40, config))
    third = graph.search_packed(packed, queries, 5, 60, config, predicate=lambda i: i % 3 == 0)
    assert rows(third) == rows(graph.search_packed(packed, queries, 5, 60, config, docs.where("node_id % 3 = 0"), shards=3)) and {r["node_id"] % 3 for r in third.collect()} == {0}
    assert graph.packed_stats(packed).first()["nodes"] == 900
    degrees = graph.pack(nodes).groupBy("level").agg(F.max(F.size("neighbours")).alias("d")).collect()
    assert all(r["d"] <= config.cap(r["level"]) for r in degrees) and max(r["d"] for r in degrees) > config.m
    row = packed.first().asDict()
    for broken in ({"n": row["n"] + 1}, {"links": bytes(row["links"])[:-4]}, {"starts": b"\xff" * len(row["starts"])}, {"dim": 0}, {"v": b""}):
        with pytest.raises(graph.PackedError):
            graph.open_packed(row | broken, config)
    assert graph.search_packed(packed, queries.limit(0), 5, 40, config).count() == 0 and graph.search_packed(packed, queries, 0, 40, config).count() == 0


def test_stored_tier(spark):
    docs = generators.uniform(spark, 800, 24, 5).cache()
    queries = docs.where("node_id % 80 = 0").select(F.col("node_id").alias("query_id"), "v")
    qrange = quantized.calibrate(docs).first()["qrange"]
    tier = quantized.build_tier(docs, qrange).cache()
    rows = lambda df: [(r["query_id"], r["rank"], r["node_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(quantized.tier_top_k(tier, docs, queries, 5, 30, qrange)) == rows(quantized.cascade_top_k(docs, queries, 5, 30))
    near = quantized.tier_top_k(tier, None, queries, 5, 5, qrange, "l2")
    code = docs.select("node_id", vx.quantize(F.col("v"), qrange).alias("c"))
    native = code.join(code.where("node_id % 80 = 0").select(F.col("node_id").alias("query_id"), F.col("c").alias("q"))).select("query_id", "node_id", vx.distance_i8("l2", F.col("q"), F.col("c"), qrange).alias("dist"))
    assert rows(near) == rows(top_k(native, ["query_id"], [F.round("dist", 9), F.col("node_id")], 5))
    signed = rows(quantized.tier_top_k(tier, None, queries, 3, 3, qrange, prefilter=True, limit=60))
    assert signed and {q for q, _, _ in signed} == {r["query_id"] for r in queries.collect()}  # few pass, itself among them
    assert quantized.tier_top_k(tier, docs, queries.limit(0), 5, 30, qrange).count() == 0


def test_cascade_recall(spark):
    docs = generators.uniform(spark, 1500, 32, 5).cache()
    queries = docs.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), "v")
    truth = exact.exact_top_k(docs, queries, 10)
    assert evaluate.mean_recall(quantized.cascade_top_k(docs, queries, 10, 64), truth).first()["recall"] >= 0.99
    assert quantized.with_signatures(docs).select(F.size("sig")).distinct().collect()[0][0] == 4


def test_generators_ignore_partitioning(spark):
    a, b = generators.uniform(spark, 50, 8, 1, 2), generators.uniform(spark, 50, 8, 1, 5)
    assert a.exceptAll(b).count() == 0


def test_embedders():
    e = embed.HashEmbedder(dim=16)
    x = e.embed([" ".join(map(str, range(200))), "", None])
    assert np.linalg.norm(x[0]) == pytest.approx(1) and not x[1:].any()
    with pytest.raises(ValueError):
        embed.HashEmbedder(dim=300)
    pooled = embed.mean_pool(np.array([[[2.0, 4.0], [9.0, 9.0]]]), np.array([[1, 0]]))
    assert embed.finish(pooled, None, 1).tolist() == [[1.0]]


def test_collection_life(spark, tmp_path):
    c = Collection(spark)
    with pytest.raises(ValueError):
        c.search("x")
    with pytest.raises(ValueError):
        c.save(str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        c.add_batch(["a"], ["x"], [{"n": float("nan")}])
    assert c.add_batch([], []) == 0
    c.add_batch(["a", "b", "a"], ["cats purr", "dogs bark loudly", "birds sing"], [{"topic": "cat"}, {"topic": "dog", "year": 2020}, None])
    assert c.add("d", "cats sleep", {"topic": "cat", "year": 2021}) == 4 and len(c) == 4
    assert c.get("a")["text"] == "cats purr"
    with pytest.raises(KeyError):
        c.get("zz")
    assert {r["id"] for r in c.search("cats", 4, where={"topic": "cat"})} == {"a", "d"}
    assert c.search("dogs bark", 2, alpha=0.3)[0]["id"] == "b"
    assert len(c.search("cats", 3, alpha=0.5, where={"year": {"$gte": 2021}})) == 1
    for bad in ({"k": 0}, {"k": 9}, {"alpha": 2.0, "k": 1}):
        with pytest.raises(ValueError):
            c.search("cats", **bad)
    path = str(tmp_path / "snap")
    c.save(path)
    d = Collection.load(spark, path)
    assert d.search("cats purr", 2) == c.search("cats purr", 2)
    assert d.add("e", "fish swim") == 5 and d.get("e")["text"] == "fish swim" and d.info()["docs"] == 5
    (tmp_path / "junk").mkdir()
    with pytest.raises(snapshot.SnapshotError):
        Collection.load(spark, str(tmp_path / "junk"))


def test_modes_filters_and_callables(spark, tmp_path):
    e = embed.HashEmbedder(dim=256)
    c = Collection(spark, e, mode="exact", config=graph.GraphConfig(m=8, ef_construction=40, qrange=1.0))
    words = "ant bee cat dog eel fox gnu hen".split()
    c.add_batch([f"d{i}" for i in range(40)], [f"{words[i % 8]} {words[(i * 3) % 8]} item{i}" for i in range(40)], [{"n": i, "a.b": i % 2} for i in range(40)])
    ids = lambda **more: [r["id"] for r in c.search("cat item2", 5, **more)]
    exact_ids = ids()
    assert ids(mode="graph", ef=40) == exact_ids == ids(mode="codes", ef=40)
    low = ids(where=lambda i: i < 20)
    for mode in ("graph", "codes", "exact"):
        assert ids(mode=mode, ef=40, where={"n": {"$lt": 20}}) == low
    assert all(int(i[1:]) % 2 for i in ids(where={"a.b": 1}))
    c.add("late", "cat item2 cat item2")
    assert "late" in ids(mode="graph") and len(c._indexes["graph"][0]) == 2
    assert c.statistics()["nodes"] == 41 and c.statistics()["code_bytes"] > 0
    c.save(str(tmp_path / "s"))
    d = Collection.load(spark, str(tmp_path / "s"), e, read_only=True)
    assert len(d._indexes["graph"][0]) == 1 and [r["id"] for r in d.search("cat item2", 5, mode="graph")] == [r["id"] for r in c.search("cat item2", 5, mode="graph")]
    with pytest.raises(ValueError):
        d.add("x", "y")
    with pytest.raises(ValueError):
        c.search("cat", mode="guess")
    # a second save switches to a new version; a broken or truncated one is refused
    c.save(str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("version-*"))) == 1
    import shutil

    manifest = next((tmp_path / "s").glob("version-*/manifest.json"))
    text = manifest.read_text()
    (manifest.parent / ".manifest.json.crc").unlink(missing_ok=True)
    for broken in ("{", text.replace('"version": 2', '"version": 9'), text.replace('"metric": "dot"', '"metric": "cosine"'), text.replace('"docs": 41', '"docs": 42'), "[]"):
        manifest.write_text(broken)
        with pytest.raises(snapshot.SnapshotError):
            Collection.load(spark, str(tmp_path / "s"), e)
    manifest.write_text(text)
    shutil.rmtree(manifest.parent / "postings")
    with pytest.raises(snapshot.SnapshotError):
        Collection.load(spark, str(tmp_path / "s"), e)


def test_batches_delivered_twice_are_stored_once(spark, tmp_path):
    schema = "node_id long, id string, text string, metadata string"
    c = Collection(spark)
    batch = spark.createDataFrame([(1, "a", "one", None), (2, "b", "two", "{broken")], schema)
    c.add_frame(batch, part="stream-000000000")
    c.index()
    c.add_frame(batch, part="stream-000000000")
    assert len(c) == 2 == c.docs.count() and c.search("one", 1)[0]["id"] == "a"
    rows = [(2, "b", "again", None), (2, "b", "again", None), (3, "c", "three", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    ingest.append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["node_id"], r["text"]) for r in c.docs.collect()) in ([(1, "one"), (2, "two"), (3, "three")], [(2, "again"), (3, "three")])


def test_embedder_errors(tmp_path):
    with pytest.raises(embed.EmbedError) as e:
        embed.OnnxEmbedder(str(tmp_path / "no.onnx"), str(tmp_path / "no.json"))
    assert e.value.kind == "io"
    for name in ("m.onnx", "t.json"):
        (tmp_path / name).write_text("{}")
    paths = str(tmp_path / "m.onnx"), str(tmp_path / "t.json")
    with pytest.raises(embed.EmbedError):
        embed.OnnxEmbedder(*paths, dense=(np.zeros((4, 3)), np.zeros(5)))
    with pytest.raises(ValueError):
        embed.OnnxEmbedder(*paths, dim=9, dense=(np.zeros((4, 3)), np.zeros(4)))
    with pytest.raises(embed.EmbedError) as e:
        embed.OnnxEmbedder(*paths).embed(["x"])
    assert e.value.kind == "runtime"
    with pytest.raises(embed.EmbedError):
        embed.finish(np.zeros((1, 3)), None, 4)
    assert embed.finish(np.array([[1.0, 2.0]]), (np.array([[3.0, 0.0], [0.0, 1.0]]), np.array([1.0, 0.0])), 1).tolist() == [[1.0]]
    with pytest.raises(embed.EmbedError):
        embed.PrecomputedEmbedder(4).embed(["x"])


def test_corpus_and_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"text": "one"}, {"text": 5, "x": 1}, {"no": 1}, {"text": "two"}, {"text": None}]))
    got = corpus.read_corpus(spark, str(tmp_path / "c.json"))
    assert {r["text"] for r in got.collect()} >= {"one", "two"} and corpus.read_corpus(spark, str(tmp_path / "c.json"), 1).count() == 1
    made = []
    make = lambda df: (made.append(1), df.select(F.col("id").alias("node_id"), F.array(F.lit(1.0)).alias("v")))[1]
    for rebuild, times in ((False, 1), (False, 1), (True, 2)):
        assert corpus.cached_vectors(spark.range(3), str(tmp_path / "v"), make, rebuild).count() == 3 and len(made) == times


def test_append_query_stores_every_document(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}" if i % 5 else None, [None, "forum", "wiki"][i % 3]) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    held, add = [], Collection.add_frame
    monkeypatch.setattr(Collection, "add_frame", lambda self, df, n=None: (held.append(self), add(self, df, n))[1])
    counted = QUERIES["append_batch"](spark, str(tmp_path)).collect()
    assert len(held) == 2 and held[0] is held[1] and len(held[0]) == 30
    assert sorted((r["node_id"], r["text"]) for r in held[0].docs.collect()) == [(i, t) for i, t, _ in rows]
    assert [tuple(r) for r in counted] == [(20, 20)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"d{i}", f"text number {i}", None) for i in range(6)]
    schema = "node_id long, id string, text string, metadata string"
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = Collection(spark)
    ingest.append_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), c, str(tmp_path / "cp")).awaitTermination()
    assert len(c) == 6 and c.docs.count() == 6 and c.postings.where("term = 'number'").count() == 6


def test_sql_functions(spark):
    assert "vec_dot" in register.register(spark)
    row = spark.sql("SELECT vec_dot(array(1f, 2f), array(3f, 4f)) d, vec_l2sq(array(1f), array(3f)) l, vec_norm(array(3f, 4f)) n, vec_quantize(array(0.3f), 0.3D) q, sig_hamming(array(-1L), array(0L)) h, keyword_tokens('A-b') t").first()
    assert tuple(row) == (11.0, 4.0, 5.0, [127], 64, ["a", "b"])


def test_percentile_is_not_interpolated(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 9)], "g string, x double")
    got = {r["p"]: r["value"] for r in evaluate.percentile_rank(df, "x", [0.0, 0.5, 1.0], ["g"]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 1.0: 9.0}


def test_benchmarks_report(spark):
    got = sweep.sweep(spark, 300, 8, 10, 3, (20,), shard_rows=300)
    assert got["build"]["nodes"] == 300 and {r["way"] for r in got["runs"]} == {"exact", "codes", "graph", "graph, 20 % allowed"}
    assert all(r["recall"] >= 0.9 for r in got["runs"])
    c = Collection(spark, embed.HashEmbedder(dim=256))
    c.add_batch(["a", "b", "c"], ["red kite", "blue whale", "green fern"])
    rows = sweep.live(c, ["whale"], 1, (8,), 0, 2)
    assert rows[0]["recall"] == 1.0 and rows[0]["queries"] == 2 and rows[0]["p50"] > 0
