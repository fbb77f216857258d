"""The engine's own operators as queries over the fixture tables, each with its SQL twin where SQL can say it.

Searches take as queries the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeseek.functions import text as tx, vectors as vx
from lodeseek.operators import embed, evaluate, exact, filters, fusion, graph, keyword, quantized
from lodeseek.plans.collection import Collection
from lodeseek.session import cut, scratch, stored, table
from lodeseek.sources import generators, snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 10
#: Stated query texts of the keyword searches: rare and frequent terms, several languages, an unknown word, none at all.
TEXTS = [(1, "hybrid query vector"), (2, "The court and the JURY!"), (3, "Turbine, grid & heat pump"), (4, "die Narkose"), (5, "qqqqzzzz"), (6, "  ")]
GRAPH = graph.GraphConfig(m=8, ef_construction=64, shard_rows=5_000)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"))


def _asked(docs: DataFrame) -> DataFrame:
    return docs.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "v")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text")


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "node_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


# vectors

DOT = "1 - list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
L2 = "pow(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 2)"


def _topk_sql(dist: str, where: str = "true", k: int = K, order: str | None = None) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, {dist} AS dist FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), node_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, node_id, round(dist, 6) + 0 AS dist FROM r WHERE rank <= {k}"""


@query("exact_topk_dot", _topk_sql(DOT))
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(exact.exact_top_k(docs, _asked(docs), K))


@query("exact_topk_l2", _topk_sql(L2))
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(exact.exact_top_k(docs, _asked(docs), K, "l2"))


@query("exact_topk_native", _topk_sql(DOT))
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(exact.native_top_k(docs, _asked(docs), K))


@query("exact_topk_blocks", _topk_sql(DOT))
def _(spark, d):
    """The grid of blocks that a large query set takes."""
    docs = _docs(spark, d)
    return _hits(exact.exact_top_k(docs, _asked(docs), K, query_bytes=2048, doc_block=400))


@query("exact_topk_filtered", _topk_sql(DOT, "e.label IN (1, 3, 5)"))
def _(spark, d):
    e = table(spark, d, "embeddings")
    docs = e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"), "label")
    return _hits(exact.exact_top_k(docs, _asked(docs), K, where=filters.compile_typed({"label": {"$in": [1, 3, 5]}}, docs.schema)))


@query("filter_modulo", _topk_sql(DOT, "e.vec_id % 100 < 20"))
def _(spark, d):
    """The selectivity predicate of the filtered-search benchmark."""
    docs = _docs(spark, d)
    return _hits(exact.exact_top_k(docs, _asked(docs), K, where=F.col("node_id") % 100 < 20))


@query("similarity_score", _topk_sql(DOT).replace("round(dist, 6) + 0 AS dist", "round(1 - dist, 6) AS score"))
def _(spark, d):
    docs = _docs(spark, d)
    return exact.exact_top_k(docs, _asked(docs), K).select("query_id", "rank", "node_id", F.round(1 - F.col("dist"), 6).alias("score"))


def _elements(df: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.select(key, F.posexplode("v").alias("i", "x")).select(key, "i", F.round("x", 6).alias("x"))


NORMALIZE = "SELECT vec_id, unnest(range(len(v)))::INT AS i, round(unnest(list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))), 6) AS x FROM (SELECT vec_id, {} AS v FROM embeddings)"


@query("l2_normalize", NORMALIZE.format("list_transform(embedding, lambda y: y::DOUBLE * 3)"))
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda y: y.cast("double") * 3).alias("w"))
    return _elements(e.select("vec_id", vx.normalize(F.col("w")).alias("v")))


@query("mrl_truncate", NORMALIZE.format("embedding[1:16]::DOUBLE[]"))
def _(spark, d):
    return _elements(table(spark, d, "embeddings").select("vec_id", vx.truncate(F.col("embedding"), 16).alias("v")))


@query("vector_norms", "SELECT vec_id, len(embedding)::INT AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings")
def _(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(v).alias("dim"), F.round(vx.norm(v), 6).alias("norm"), F.round(F.element_at(v, 1).cast("double"), 6).alias("head"))


@query(
    "mean_pool",
    """WITH f AS (SELECT label, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY ALL),
n AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM m GROUP BY label) SELECT m.label, i, round(x / n, 6) AS x FROM m JOIN n ON m.label = n.label""",
)
def _(spark, d):
    return _elements(embed.pool_groups(table(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "label"), "label")


@query("embed_texts")
def _(spark, d):
    """Every document embedded by feature hashing; rows-only, the hash is Python's."""
    return embed.embed_column(table(spark, d, "documents"), embed.HashEmbedder(), "doc_id").select("doc_id", F.size("v").alias("dim"), F.round(vx.norm(F.col("v")), 4).alias("norm"))


@query("query_prompt", f"SELECT query_id, concat('{embed.QUERY_PROMPT}', coalesce(query_text, '')) AS prompted FROM queries")
def _(spark, d):
    return table(spark, d, "queries").select("query_id", embed.prompted(F.col("query_text")).alias("prompted"))


# quantization

QRANGE = "(SELECT greatest(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 1e-9) FROM embeddings)"
CODES = f"""r AS (SELECT {QRANGE} AS r), c AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * (127.0::DOUBLE / r)))))::INT[] AS code, r FROM embeddings, r)"""


@query("calibrate_range", f"SELECT round({QRANGE}, 9) AS qrange")
def _(spark, d):
    return quantized.calibrate(_docs(spark, d)).select(F.round("qrange", 9).alias("qrange"))


@query("quantize_int8", f"WITH {CODES} SELECT vec_id, unnest(range(len(code)))::INT AS i, unnest(code) AS code FROM c")
def _(spark, d):
    docs = _docs(spark, d)
    coded = docs.crossJoin(F.broadcast(quantized.calibrate(docs))).select("node_id", vx.quantize(F.col("v"), F.col("qrange")).alias("code"))
    return coded.select(F.col("node_id").alias("vec_id"), F.posexplode("code").alias("i", "code"))


I8_DOT = "1 - list_inner_product(q.code::DOUBLE[], e.code::DOUBLE[]) * (e.r / 127) * (e.r / 127)"
I8_L2 = "pow(list_distance(q.code::DOUBLE[], e.code::DOUBLE[]), 2) * (e.r / 127) * (e.r / 127)"


def _int8_sql(dist: str) -> str:
    return f"""WITH {CODES}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, {dist} AS dist FROM c q, c e WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), node_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, node_id, round(dist, 6) + 0 AS dist FROM k WHERE rank <= {K}"""


@query("int8_dot_topk", _int8_sql(I8_DOT))
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(quantized.cascade_top_k(docs, _asked(docs), K, K, rerank=False))


@query("int8_l2_topk", _int8_sql(I8_L2))
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(quantized.cascade_top_k(docs, _asked(docs), K, K, "l2", rerank=False))


@query(
    "int8_rerank",
    f"""WITH {CODES}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, {I8_DOT} AS near, {DOT} AS dist FROM c q, c e WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(near, 9), node_id) AS a FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), node_id) AS rank FROM k WHERE a <= 40)
SELECT query_id, rank::INT AS rank, node_id, round(dist, 6) + 0 AS dist FROM f WHERE rank <= {K}""",
)
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(quantized.cascade_top_k(docs, _asked(docs), K, 40))


@query("cascade_topk")
def _(spark, d):
    """Sign bits, int8 codes, full precision; the planes are random, so rows only."""
    docs = _docs(spark, d)
    return _hits(quantized.cascade_top_k(docs, _asked(docs), K, 40, prefilter=True))


WALSH = "[list_sum([CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * embedding[j + 1] for j in range(64)]) >= 0 for i in range(64)]"


@query(
    "hamming_prefilter",
    f"""WITH s AS (SELECT vec_id, embedding, {WALSH} AS sig FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id, list_sum([(x[1] <> x[2])::INT for x in list_zip(q.sig, e.sig)]) AS bits, {DOT} AS dist FROM s q, s e WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), node_id) AS rank FROM p WHERE bits <= 28) SELECT query_id, rank::INT AS rank, node_id, round(dist, 6) + 0 AS dist FROM k WHERE rank <= {K}""",
)
def _(spark, d):
    """Documents whose signs against the 64 Walsh rows differ from the query's in at most 28 places."""
    docs = _docs(spark, d)
    return _hits(quantized.signed_top_k(docs, _asked(docs), K, planes=vx.walsh_planes(64), limit=28))


@query("walsh_signatures", f"WITH s AS (SELECT vec_id, {WALSH}[1:16] AS b FROM embeddings) SELECT vec_id, list_sum([(b[i + 1]::INT << i)::BIGINT for i in range(16)])::BIGINT AS sig FROM s")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vx.walsh_signature(F.col("embedding"), 16).alias("sig"))


# keyword index

TOKENS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
TOKS = TOKENS.format("text")
INDEX_SQL = f"""tk AS (SELECT doc_id AS node_id, coalesce({TOKS}, []) AS toks FROM documents), tf AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(toks) AS term FROM tk) GROUP BY ALL),
dl AS (SELECT node_id, len(toks) AS dl FROM tk), st AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""
BM25 = "sum(ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / st.avgdl)))"


def _bm25_sql(queries: str) -> str:
    return f"""{INDEX_SQL}, qs AS ({queries}), qt AS (SELECT DISTINCT query_id, unnest({TOKENS.format('qtext')}) AS term FROM qs),
sc AS (SELECT qt.query_id, tf.node_id, {BM25} AS score FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = qt.term JOIN dl ON dl.node_id = tf.node_id CROSS JOIN st GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM sc)"""


@query("bm25_tokens", f"SELECT doc_id, len(coalesce({TOKS}, []))::INT AS n, array_to_string(coalesce({TOKS}, []), ' ') AS terms FROM documents")
def _(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("terms"))


@query("bm25_tf", f"WITH {INDEX_SQL} SELECT term, node_id, tf::INT AS tf FROM tf")
def _(spark, d):
    return keyword.postings(_texts(spark, d))


@query("bm25_df", f"WITH {INDEX_SQL} SELECT term, df FROM df")
def _(spark, d):
    return keyword.doc_frequency(keyword.postings(_texts(spark, d)))


@query("bm25_stats", f"WITH {INDEX_SQL} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def _(spark, d):
    return keyword.stats(keyword.doc_lengths(_texts(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_idf", f"WITH {INDEX_SQL} SELECT term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st")
def _(spark, d):
    docs = _texts(spark, d)
    df = keyword.doc_frequency(keyword.postings(docs)).crossJoin(F.broadcast(keyword.stats(keyword.doc_lengths(docs))))
    return df.select("term", F.round(keyword.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "node_id", F.round("score", 6).alias("score"))


SCORED = "SELECT query_id, rank::INT AS rank, node_id, round(score, 6) AS score FROM "
LITERALS = "SELECT unnest([{}]) AS query_id, unnest([{}]) AS qtext".format(", ".join(f"{i}::BIGINT" for i, _ in TEXTS), ", ".join("'" + t + "'" for _, t in TEXTS))


@query("bm25_search", f"WITH {_bm25_sql(LITERALS)} {SCORED} kr WHERE rank <= {K}")
def _(spark, d):
    docs = _texts(spark, d)
    return _scored(keyword.search(keyword.postings(docs), keyword.doc_lengths(docs), spark.createDataFrame(TEXTS, "query_id long, text string"), K))


@query("bm25_search_batch", f"WITH {_bm25_sql('SELECT DISTINCT query_id::BIGINT AS query_id, query_text AS qtext FROM queries WHERE query_id % 100 = 0')} {SCORED} kr WHERE rank <= {K}")
def _(spark, d):
    docs = _texts(spark, d)
    asked = table(spark, d, "queries").where("query_id % 100 = 0").select(F.col("query_id").cast("long"), F.col("query_text").alias("text")).distinct()
    return _scored(keyword.search(keyword.postings(docs), keyword.doc_lengths(docs), asked, K))


# fusion: documents and embeddings share ids where doc_id = vec_id; the text of a query document is its keyword query

FETCH, ALPHA = 64, 0.4
BOTH = "b AS (SELECT d.doc_id AS node_id, d.text, d.lang, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
HYBRID = f"""{BOTH}, {_bm25_sql("SELECT node_id AS query_id, text AS qtext FROM b WHERE node_id % 100 = 0").replace("FROM documents)", "FROM b)").replace("doc_id AS node_id", "node_id")},
vs AS (SELECT q.node_id AS query_id, e.node_id, {DOT} AS dist FROM b q, b e WHERE q.node_id % 100 = 0), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), node_id) AS rank FROM vs)"""
FUSED = f"""fu AS (SELECT query_id, node_id, round(sum(w), 9) AS score FROM (SELECT query_id, node_id, {ALPHA}::DOUBLE / (60 + rank) AS w FROM {{0}} UNION ALL SELECT query_id, node_id, {1 - ALPHA}::DOUBLE / (60 + rank) FROM {{1}}) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM fu) {SCORED} fr WHERE rank <= {K}"""


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    both = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("node_id"), "text", "lang", F.col("embedding").alias("v"))
    asked = both.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "text", "v")
    vectors = exact.exact_top_k(both, asked, FETCH)
    words = keyword.search(keyword.postings(both), keyword.doc_lengths(both), asked, FETCH)
    return vectors, words, both


@query("rrf_fuse", f"WITH {HYBRID}, {FUSED.format(f'(SELECT * FROM vr WHERE rank <= {K})', f'(SELECT * FROM kr WHERE rank <= {K})')}")
def _(spark, d):
    vectors, words, _ = _candidates(spark, d)
    return _scored(fusion.fuse([(vectors.where(F.col("rank") <= K), ALPHA), (words.where(F.col("rank") <= K), 1 - ALPHA)], K))


@query("hybrid_search", f"WITH {HYBRID}, {FUSED.format(f'(SELECT * FROM vr WHERE rank <= {FETCH})', f'(SELECT * FROM kr WHERE rank <= {FETCH})')}")
def _(spark, d):
    vectors, words, _ = _candidates(spark, d)
    return _scored(fusion.hybrid(vectors, words, ALPHA, K))


_KEPT = "(SELECT t.query_id, t.node_id, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank) AS rank FROM {} t JOIN b ON b.node_id = t.node_id WHERE t.rank <= %d AND b.lang = 'en')" % FETCH


@query("hybrid_filtered", f"WITH {HYBRID}, {FUSED.format(_KEPT.format('vr'), _KEPT.format('kr'))}")
def _(spark, d):
    vectors, words, both = _candidates(spark, d)
    return _scored(fusion.hybrid(vectors, words, ALPHA, K, both.where(filters.compile_typed({"lang": "en"}, both.schema))))


# predicates

TYPED = {
    "filter_eq": ({"lang": "de"}, "lang = 'de'"),
    "filter_ne": ({"lang": {"$ne": "de"}}, "lang IS DISTINCT FROM 'de'"),
    "filter_range": ({"n_chars": {"$gte": 100, "$lt": 300}}, "n_chars >= 100 AND n_chars < 300"),
    "filter_in": ({"source": {"$in": ["wiki", "forum", 3]}}, "source IN ('wiki', 'forum')"),
    "filter_nin": ({"source": {"$nin": ["wiki", "forum"]}}, "source IS NULL OR source NOT IN ('wiki', 'forum')"),
    "filter_exists": ({"n_chars": {"$exists": False}}, "n_chars IS NULL"),
    "filter_and_or_nor": ({"$or": [{"lang": "fr"}, {"$and": [{"lang": "es"}, {"n_chars": {"$gt": 200}}]}], "$nor": [{"source": "wiki"}, {"source": {"$exists": False}}]}, "(coalesce(lang = 'fr', false) OR coalesce(lang = 'es' AND n_chars > 200, false)) AND NOT (coalesce(source = 'wiki', false) OR source IS NULL)"),
    "filter_missing_field": ({"no_such": {"$ne": 1}, "lang": "en"}, "lang = 'en'"),
}


def _typed(spec: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents")
        return docs.where(filters.compile_typed(spec, docs.schema)).select("doc_id")

    return run


for _name, (_spec, _sql) in TYPED.items():
    query(_name, f"SELECT doc_id FROM documents WHERE {_sql}")(_typed(_spec))


@query("filter_array", "SELECT doc_id FROM documents WHERE (list_contains([lang, source], 'en')) AND NOT list_contains([lang, source], 'wiki')")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return docs.where(filters.compile_typed({"tags": {"$eq": "en", "$nin": ["wiki"]}}, docs.schema)).select("doc_id")


PROPS = {
    "filter_variant_eq": ({"k": 69}, "coalesce(k = 69, false)"),
    "filter_variant_ne": ({"k": {"$ne": 69}}, "NOT coalesce(k = 69, false)"),
    "filter_variant_range": ({"k": {"$gt": 20, "$lte": 40.5}}, "coalesce(k > 20 AND k <= 40.5, false)"),
    "filter_variant_in": ({"k": {"$in": [1, 2, "3"]}}, "coalesce(k IN (1, 2), false)"),
    "filter_variant_nin": ({"k": {"$nin": [1, 2]}}, "NOT coalesce(k IN (1, 2), false)"),
    "filter_variant_exists": ({"k": {"$exists": True}, "z": {"$exists": False}}, "k IS NOT NULL"),
    "filter_variant_nested": ({"$or": [{"k": 1}, {"$nor": [{"k": {"$gte": 5}}]}]}, "coalesce(k = 1, false) OR NOT coalesce(k >= 5, false)"),
}


def _variant(spec: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "events").where(filters.compile_json(spec, F.col("props"))).select("event_id")

    return run


for _name, (_spec, _sql) in PROPS.items():
    query(_name, f"SELECT event_id FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE {_sql}")(_variant(_spec))


# collection, snapshots, evaluation


def _held(spark: SparkSession, d: str) -> Collection:
    """The documents as a collection."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").cast("string").alias("id"), "text", F.to_json(F.struct("lang", "source")).alias("metadata"))
    held = Collection(spark)
    held.add_frame(docs)
    return held


@query("get_by_id", "SELECT doc_id, text FROM documents WHERE doc_id = 7 ORDER BY doc_id LIMIT 1")
def _(spark, d):
    return _held(spark, d).by_id("7").select(F.col("node_id").alias("doc_id"), "text")


@query("hydrate_hits", f"WITH t AS ({_topk_sql(DOT)}) SELECT t.query_id, t.rank, t.node_id, d.lang, d.source FROM t JOIN documents d ON d.doc_id = t.node_id")
def _(spark, d):
    docs = _docs(spark, d)
    found = _held(spark, d).hydrate(exact.exact_top_k(docs, _asked(docs), K))
    return found.select("query_id", "rank", "node_id", F.get_json_object("metadata", "$.lang").alias("lang"), F.get_json_object("metadata", "$.source").alias("source"))


@query(
    "collection_search",
    """SELECT count(*) AS asked, count(*) AS first_is_itself FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)""",
)
def _(spark, d):
    """Every hundredth vector asked of a collection through its graph: the nearest document is the one itself."""
    held = Collection(spark)
    held.add_frame(_docs(spark, d).select("node_id", F.col("node_id").cast("string").alias("id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("metadata"), "v"))
    found = held.search_batch(_asked(_docs(spark, d)).withColumn("text", F.lit("")), 1)
    return found.agg(F.count("*").alias("asked"), F.sum((F.col("id") == F.col("query_id").cast("string")).cast("long")).alias("first_is_itself"))


@query("collection_count", "SELECT count(*) AS docs, max(len(embedding))::INT AS dim, sum(len(embedding) * 4)::BIGINT AS vector_bytes FROM embeddings")
def _(spark, d):
    return evaluate.index_stats(_docs(spark, d)).select(F.col("n").alias("docs"), "dim", F.col("vector_bytes").cast("long"))


@query("append_batch", "SELECT count(*) AS docs, count(DISTINCT doc_id) AS ids FROM documents WHERE source IS NOT NULL")
def _(spark, d):
    # every document is appended; the SQL counts those with a source
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").cast("string").alias("id"), "text", F.to_json(F.struct("source")).alias("metadata"))
    forum = F.coalesce(F.get_json_object("metadata", "$.source") == "forum", F.lit(False))
    held = Collection(spark)
    held.add_frame(docs.where(forum))
    held.add_frame(docs.where(~forum))
    return held.docs.where(F.get_json_object("metadata", "$.source").isNotNull()).agg(F.count("*").alias("docs"), F.countDistinct("id").alias("ids"))


@query("snapshot_roundtrip", "SELECT vec_id AS node_id, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings")
def _(spark, d):
    path = scratch(spark, "snapshot")
    snapshot.save({"docs": _docs(spark, d)}, path, {"dim": 64})
    return snapshot.load(spark, path)[0]["docs"].select("node_id", F.round(F.element_at("v", 1).cast("double"), 6).alias("head"))


@query(
    "recall_at_k",
    f"""WITH t AS ({_topk_sql(DOT)}), i AS ({_int8_sql(I8_DOT)}), m AS (SELECT t.query_id, count(i.node_id) / count(*) AS r FROM t LEFT JOIN i ON t.query_id = i.query_id AND t.node_id = i.node_id GROUP BY ALL) SELECT round(avg(r), 6) AS recall FROM m""",
)
def _(spark, d):
    docs = _docs(spark, d)
    return evaluate.mean_recall(quantized.cascade_top_k(docs, _asked(docs), K, K, rerank=False), exact.exact_top_k(docs, _asked(docs), K))


@query(
    "percentile_rank",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), p AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p)
SELECT event_type, p, value FROM s, p WHERE i = round(p * (n - 1))""",
)
def _(spark, d):
    return evaluate.percentile_rank(table(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


@query(
    "latency_summary",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0)
SELECT event_type, count(*) AS queries, round(avg(value), 6) AS mean_us, round(1e6::DOUBLE * count(*) / sum(value), 3) AS qps, max(CASE WHEN i = round(0.5::DOUBLE * (n - 1)) THEN value END) AS p50, max(CASE WHEN i = round(0.95::DOUBLE * (n - 1)) THEN value END) AS p95, max(CASE WHEN i = round(0.99::DOUBLE * (n - 1)) THEN value END) AS p99 FROM s GROUP BY event_type""",
)
def _(spark, d):
    return evaluate.latencies(table(spark, d, "events").where("value > 0"), "value", ["event_type"]).withColumn("mean_us", F.round("mean_us", 6)).withColumn("qps", F.round("qps", 3))


@query("generator_checks", "SELECT 2000::BIGINT AS nodes, true AS uniform_has_unit_length, true AS clusters_are_tight")
def _(spark, d):
    """What the two generators promise: a mean squared length of 1, and rows that lie nearer to their own cluster's than to others."""
    mean = generators.uniform(spark, 2_000, 32, 7).agg(F.avg(F.pow(vx.norm(F.col("v")), 2)).alias("m"))
    rows = generators.clustered(spark, 2_000, 32, 16, 7).withColumn("g", F.col("node_id") % 16)
    first = rows.where("node_id < 16").select(F.col("g").alias("c"), F.col("v").alias("w"))
    near = rows.join(F.broadcast(first)).select("g", "c", vx.l2sq(F.col("v"), F.col("w")).alias("x")).agg(F.avg(F.when(F.col("g") == F.col("c"), F.col("x"))).alias("own"), F.avg(F.when(F.col("g") != F.col("c"), F.col("x"))).alias("other"))
    return rows.agg(F.count("*").alias("nodes")).join(mean).join(near).select("nodes", (F.abs(F.col("m") - 1) < 0.05).alias("uniform_has_unit_length"), (F.col("own") * 4 < F.col("other")).alias("clusters_are_tight"))


@query("uniform_vectors")
def _(spark, d):
    return generators.uniform(spark, 2_000, 32, 7).select("node_id", F.round(vx.norm(F.col("v")), 4).alias("norm"))


@query("clustered_vectors")
def _(spark, d):
    return generators.clustered(spark, 2_000, 32, 16, 7).select("node_id", F.round(vx.norm(F.col("v")), 4).alias("norm"))


# graph: rows only


@query("hnsw_search")
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(graph.search(cut(graph.build(docs, GRAPH)), _asked(docs), K, 64, GRAPH))


@query("hnsw_filtered")
def _(spark, d):
    docs = _docs(spark, d)
    return _hits(graph.search(cut(graph.build(docs, GRAPH)), _asked(docs), K, 64, GRAPH, docs.where("node_id % 2 = 0")))


@query("hnsw_graph_stats")
def _(spark, d):
    return graph.graph_stats(graph.build(_docs(spark, d), GRAPH))


@query("hnsw_packed")
def _(spark, d):
    packed = graph.pack(cut(graph.build(_docs(spark, d), GRAPH)))
    return packed.groupBy("level").agg(F.count("*").alias("rows"), F.sum(F.size("neighbours")).alias("links"))


RECALL = "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


def _enough(found: DataFrame, truth: DataFrame, least: float = 0.95) -> DataFrame:
    return evaluate.recall(found, truth).agg(F.count("*").alias("asked"), (F.avg("recall") >= least).alias("enough"))


@query("hnsw_recall", RECALL)
def _(spark, d):
    """Recall of the graph walk at least 0.95."""
    docs = _docs(spark, d)
    return _enough(graph.search_packed(stored(graph.build_packed(docs, GRAPH)), _asked(docs), K, 64, GRAPH), exact.exact_top_k(docs, _asked(docs), K))


@query("hnsw_filtered_recall", RECALL)
def _(spark, d):
    """The same among even ids, which the walk takes into account."""
    docs = _docs(spark, d)
    even = docs.where("node_id % 2 = 0")
    found = graph.search_packed(stored(graph.build_packed(docs, GRAPH)), _asked(docs), K, 64, GRAPH, even)
    return _enough(found.where("node_id % 2 = 0"), exact.exact_top_k(even, _asked(docs), K))


@query("hnsw_int8_recall", RECALL)
def _(spark, d):
    """Walk on int8 codes behind sign bits, results re-scored."""
    docs = _docs(spark, d)
    config = graph.GraphConfig(m=8, ef_construction=64, shard_rows=5_000, int8=True, qrange=0.6)
    return _enough(graph.search_packed(stored(graph.build_packed(docs, config)), _asked(docs), K, 64, config), exact.exact_top_k(docs, _asked(docs), K))


@query("hnsw_invariants", "SELECT count(*) AS nodes, true AS within_caps, true AS links_hold, true AS no_link_to_itself FROM embeddings")
def _(spark, d):
    """Degree caps, links to rows that exist and reach the level, none to the row itself."""
    nodes = cut(graph.build(_docs(spark, d), GRAPH))
    links = graph.pack(nodes).select("level", "src", F.size("neighbours").alias("degree"), F.explode_outer("neighbours").alias("dst"))
    ends = links.join(nodes.select(F.col("node_id").alias("dst"), F.col("level").alias("top")), "dst", "left")
    about = ends.agg(
        F.min(F.col("degree") <= F.when(F.col("level") == 0, GRAPH.m0).otherwise(GRAPH.m)).alias("within_caps"),
        F.min(F.coalesce(F.col("top") >= F.col("level"), F.col("dst").isNull())).alias("links_hold"),
        F.min(F.coalesce(F.col("dst") != F.col("src"), F.lit(True))).alias("no_link_to_itself"),
    )
    return graph.graph_stats(nodes).select("nodes").join(about)


@query("hnsw_snapshot", "SELECT count(*) * 10 AS hits, 0::BIGINT AS differing FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    """A saved and loaded collection answers as before, through its stored graph and without building one."""
    held = Collection(spark, config=GRAPH)
    held.add_frame(_docs(spark, d).select("node_id", F.col("node_id").cast("string").alias("id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("metadata"), "v"))
    held.index()
    path = scratch(spark, "snapshot")
    held.save(path)
    asked = _asked(_docs(spark, d)).withColumn("text", F.lit(""))
    before = cut(held.search_batch(asked, K).select("query_id", "rank", "id", F.round("score", 9).alias("score")))
    after = cut(Collection.load(spark, path, read_only=True).search_batch(asked, K).select("query_id", "rank", "id", F.round("score", 9).alias("score")))
    return before.agg(F.count("*").alias("hits")).join(before.exceptAll(after).unionByName(after.exceptAll(before)).agg(F.count("*").alias("differing")))


@query(
    "int8_stored_rerank",
    ORACLES["int8_rerank"],
)
def _(spark, d):
    """int8_rerank from stored codes, fetching the vectors of the candidates only."""
    docs = _docs(spark, d)
    qrange = quantized.calibrate(docs).first()["qrange"]
    return _hits(quantized.tier_top_k(stored(quantized.build_tier(docs, qrange)), docs, _asked(docs), K, 40, qrange))


@query("int8_kernels", f"WITH {CODES} SELECT q.vec_id AS query_id, e.vec_id AS node_id, list_inner_product(q.code::DOUBLE[], e.code::DOUBLE[])::INT AS dot, pow(list_distance(q.code::DOUBLE[], e.code::DOUBLE[]), 2).round()::INT AS l2sq, round(1 - list_inner_product(q.code::DOUBLE[], e.code::DOUBLE[]) * (e.r / 127) * (e.r / 127), 6) + 0 AS dist FROM c q, c e WHERE q.vec_id % 100 = 0")
def _(spark, d):
    """Integer products and distances of codes as expressions, for the stated queries against all rows."""
    docs = _docs(spark, d)
    qrange = quantized.calibrate(docs).first()["qrange"]
    coded = docs.select("node_id", vx.quantize(F.col("v"), qrange).alias("code"))
    asked = coded.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), F.col("code").alias("q"))
    pairs = coded.join(F.broadcast(asked))
    return pairs.select("query_id", "node_id", vx.dot_i8(F.col("q"), F.col("code")).alias("dot"), vx.l2sq_i8(F.col("q"), F.col("code")).alias("l2sq"), (F.round(vx.distance_i8("dot", F.col("q"), F.col("code"), qrange), 6) + F.lit(0.0)).alias("dist"))
