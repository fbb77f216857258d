"""A collection: append-only documents with vectors and an inverted index, searched by meaning, by words or by both."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeseek.operators import exact, filters, fusion, graph, keyword, quantized
from lodeseek.operators.embed import Embedder, HashEmbedder, embed_column, prompted
from lodeseek.operators.topk import top_k
from lodeseek.plans.planner import beam, mode_of
from lodeseek.session import scratch
from lodeseek.sources import snapshot

DOCS = "node_id long, id string, text string, metadata string, fields variant, v array<float>"
INDEX = "term string, node_id long, tf int"
LENGTHS = "node_id long, dl int"
CODES = "node_id long, code binary, sig binary"
TABLES = {"docs": DOCS, "postings": INDEX, "lengths": LENGTHS, "graph": graph.PACKED, "codes": CODES}
#: Metadata is stored as JSON text and, for predicates, as a VARIANT.
QRANGE = 0.3


class Collection:
    """Documents live in Parquet folders below `path`; each batch adds a folder, nothing is rewritten.

    Vector searches walk a graph by default (mode "graph"), scan int8 codes ("codes") or all vectors ("exact"); the mode is an argument, not
    a matter of size. Graphs and codes of a batch are built when they are first needed, or by index(); each index folder covers the batches that
    had none, and index(rebuild=True) makes one graph of all.
    """

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, path: str | None = None, config: graph.GraphConfig | None = None, mode: str = "graph"):
        self.spark = spark
        self.embedder = embedder or HashEmbedder()
        self.path = path or scratch(spark, "collection")
        self.config = config or graph.GraphConfig(qrange=QRANGE)
        self.mode = mode_of(mode)
        self.read_only = False
        self._parts: list[str] = []
        self._n = 0
        #: name of an index -> (folders, batches covered)
        self._indexes: dict[str, tuple[list[str], int]] = {"graph": ([], 0), "codes": ([], 0)}

    # tables

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    @property
    def docs(self) -> DataFrame:
        return self._read("docs", [f"{p}/docs" for p in self._parts])

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", [f"{p}/postings" for p in self._parts])

    @property
    def lengths(self) -> DataFrame:
        return self._read("lengths", [f"{p}/lengths" for p in self._parts])

    @property
    def dim(self) -> int:
        return self.embedder.dim

    def __len__(self) -> int:
        return self._n

    def __repr__(self) -> str:
        return f"Collection(docs={self._n}, dim={self.dim})"

    def info(self) -> dict:
        return {"docs": self._n, "dim": self.dim, "model_dir": getattr(self.embedder, "model_dir", None), "hybrid": True, "filter_ops": [*filters.OPS, *filters.COMBINE]}

    def statistics(self) -> dict:
        """Metric, storage, documents, layers, links and bytes of the stored graphs and codes."""
        packed = graph.packed_stats(self._read("graph", self._indexes["graph"][0])).first()
        codes = self._read("codes", self._indexes["codes"][0]).agg(F.coalesce(F.sum(F.octet_length("code") + F.octet_length("sig")), F.lit(0)).alias("b")).first()["b"]
        return {"docs": self._n, "dim": self.dim, "is_empty": not self._n, "metric": self.config.metric, "storage": "int8" if self.config.int8 else "f32", **packed.asDict(), "code_bytes": codes}

    # ingest

    def add_batch(self, ids: list[str], texts: list[str], metadatas: list | None = None) -> int:
        """Append documents; everything is checked before anything is stored. Returns the new number of documents."""
        if len(ids) != len(texts) or metadatas is not None and len(metadatas) != len(ids):
            raise ValueError("ids, texts and metadatas must have one length")
        metadatas = metadatas or [None] * len(ids)
        for m in metadatas:
            filters.check_metadata(m)
        if not ids:
            return self._n
        rows = [(self._n + i, str(d), t, json.dumps(m)) for i, (d, t, m) in enumerate(zip(ids, texts, metadatas))]
        return self.add_frame(self.spark.createDataFrame(rows, "node_id long, id string, text string, metadata string"), len(rows))

    def add(self, id: str, text: str, metadata: object = None) -> int:
        return self.add_batch([id], [text], [metadata])

    def add_frame(self, df: DataFrame, n: int | None = None, part: str | None = None) -> int:
        """Append rows (node_id, id, text, metadata JSON text) with node_id beyond those present; v is computed unless it is there. part names the folder:
        a batch that comes again under the name of an earlier one replaces it."""
        if self.read_only:
            raise ValueError("the collection is read-only")
        df = df if "v" in df.columns else embed_column(df.select("node_id", "id", "text", "metadata"), self.embedder, None)
        folder = f"{self.path}/part-{part or format(len(self._parts), '06d')}"
        known = folder in self._parts
        if known:
            self._n -= self.spark.read.schema(DOCS).parquet(f"{folder}/docs").count()
            self._forget(self._parts.index(folder))
        rows = df.select(F.col("node_id").cast("long"), "id", "text", "metadata", F.try_parse_json("metadata").alias("fields"), F.col("v").cast("array<float>"))
        rows.write.mode("overwrite").parquet(f"{folder}/docs")
        stored = self.spark.read.schema(DOCS).parquet(f"{folder}/docs")
        # sorted by term, so that a search reads only the row groups of its terms
        keyword.postings(stored).repartitionByRange("term").sortWithinPartitions("term", "node_id").write.mode("overwrite").parquet(f"{folder}/postings")
        keyword.doc_lengths(stored).write.mode("overwrite").parquet(f"{folder}/lengths")
        if not known:
            self._parts.append(folder)
        self._n += stored.count() if n is None else n
        return self._n

    def _forget(self, batch: int) -> None:
        for name, (_, covered) in self._indexes.items():
            if covered > batch:
                self._indexes[name] = ([], 0)

    # indexes

    def index(self, name: str = "graph", rebuild: bool = False) -> None:
        """Build the graph or the codes of the batches that have none; rebuild: of all batches as one."""
        if rebuild:
            self._indexes[name] = ([], 0)
        folders, covered = self._indexes[name]
        if covered == len(self._parts):
            return
        fresh = self._read("docs", [f"{p}/docs" for p in self._parts[covered:]]).select("node_id", "v").where("v is not null")
        path = scratch(self.spark, f"{name}-index") if self.read_only else f"{self.path}/{name}-{covered:06d}-{len(self._parts):06d}"
        if name == "graph":
            shards = max(1, -(-fresh.count() // self.config.shard_rows))
            built = graph.build_packed(fresh, self.config, shards)
        else:
            built = quantized.build_tier(fresh, self.config.qrange, self.config.seed)
        built.write.mode("overwrite").parquet(path)
        self._indexes[name] = ([*folders, path], len(self._parts))

    # access

    def get(self, id: str) -> dict:
        """The first document of that id."""
        found = self.by_id(id).collect()
        if not found:
            raise KeyError(id)
        return {"id": found[0]["id"], "text": found[0]["text"], "metadata": None if found[0]["metadata"] is None else json.loads(found[0]["metadata"])}

    def by_id(self, id: str) -> DataFrame:
        """(node_id, id, text, metadata) of the first document of that id, or no row."""
        return self.docs.where(F.col("id") == id).orderBy("node_id").select("node_id", "id", "text", "metadata").limit(1)

    def hydrate(self, hits: DataFrame) -> DataFrame:
        """Ids, texts and metadata of hits, joined after the cut to k."""
        return hits.join(self.docs.select("node_id", "id", "text", "metadata"), "node_id").orderBy("query_id", "rank")

    # search

    def search_batch(self, queries: DataFrame, k: int = 5, ef: int | None = None, where: dict | Column | Callable[[int], bool] | None = None, alpha: float | None = None, mode: str | None = None) -> DataFrame:
        """(query_id, rank, id, score, text, metadata) for queries(query_id, text[, v]).

        Without alpha by meaning, score = 1 - dist; a filter restricts the results, not the walk of the graph. With alpha in 0..1 both lists are drawn
        unfiltered, filtered, ranked anew and fused; fewer than k rows may be left. where: a predicate in document-store notation, a column over
        docs, or a function of node_id (the slow path: Python for every row).
        """
        if not self._n:
            raise ValueError("the collection is empty")
        if not 1 <= k <= self._n:
            raise ValueError(f"k must lie in 1..{self._n}")
        if isinstance(where, dict):
            where = filters.compile_variant(where, F.col("fields"))
        elif where is not None and not isinstance(where, Column):
            where = F.pandas_udf(lambda ids, f=where: ids.map(f).astype(bool), "boolean")(F.col("node_id"))
        if alpha is not None and not 0.0 <= alpha <= 1.0:
            raise ValueError("alpha must lie in 0..1")
        if "v" in queries.columns:
            vectors = queries.select("query_id", "v")
        else:
            vectors = embed_column(queries.select("query_id", prompted(F.col("text"), getattr(self.embedder, "query_prompt", "")).alias("text")), self.embedder, "query_id")
        mode = mode_of(mode or self.mode)
        if alpha is None:
            hits = self._vector_hits(vectors, k, beam(k, ef), where, mode).withColumn("score", 1.0 - F.col("dist"))
        else:
            fetch = fusion.fetch_size(k, self._n, where is not None)
            allowed = None if where is None else self.docs.where(where).select("node_id")
            hits = fusion.hybrid(self._vector_hits(vectors, fetch, max(ef or 2 * fetch, fetch), None, mode), keyword.search(self.postings, self.lengths, queries, fetch), alpha, k, allowed)
        return self.hydrate(hits).select("query_id", "rank", "id", "score", "text", "metadata")

    def _vector_hits(self, vectors: DataFrame, k: int, ef: int, where: Column | None, mode: str) -> DataFrame:
        if mode == "exact":
            return exact.exact_top_k(self.docs, vectors, k, self.config.metric, where=where)
        self.index(mode)
        if mode == "codes":
            tier = self._read("codes", self._indexes["codes"][0])
            if where is not None:
                tier = tier.join(self.docs.where(where).select("node_id"), "node_id", "left_semi")
            c = self.config
            return quantized.tier_top_k(tier, self.docs, vectors, k, ef, c.qrange, c.metric, c.cascade, c.seed)
        allowed = None if where is None else self.docs.where(where).select("node_id")
        found = None
        for path in self._indexes["graph"][0]:
            part = graph.search_packed(self._read("graph", [path]), vectors, k, ef, self.config, allowed)
            found = part if found is None else found.unionByName(part)
        return top_k(found.drop("rank"), ["query_id"], [F.round("dist", 9), F.col("node_id")], k).select("query_id", "rank", "node_id", "dist")

    def search(self, query: str, k: int = 5, ef: int | None = None, where: dict | None = None, alpha: float | None = None, mode: str | None = None) -> list[dict]:
        """One query; a list of results."""
        rows = self.search_batch(self.spark.createDataFrame([(0, query)], "query_id long, text string"), k, ef, where, alpha, mode).collect()
        return [{"id": r["id"], "score": r["score"], "text": r["text"], "metadata": None if r["metadata"] is None else json.loads(r["metadata"])} for r in rows]

    # persistence

    def save(self, path: str) -> None:
        """Documents, keyword index, and whatever graphs and codes are built, with the configuration."""
        if not self._n:
            raise ValueError("an empty collection cannot be saved")
        tables = {"docs": self.docs, "postings": self.postings.repartitionByRange("term").sortWithinPartitions("term", "node_id"), "lengths": self.lengths}
        done = [name for name, (_, covered) in self._indexes.items() if covered == len(self._parts)]
        for name in done:
            tables[name] = self._read(name, self._indexes[name][0])
        # graphs of several indexes have shards of one number, so only a single one is stored
        if "graph" in done and len(self._indexes["graph"][0]) > 1:
            self.index("graph", rebuild=True)
            tables["graph"] = self._read("graph", self._indexes["graph"][0])
        snapshot.save(tables, path, {"dim": self.dim, "docs": self._n, "graph": self.config.as_dict(), "mode": self.mode})

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None, read_only: bool = False) -> Collection:
        """A collection over a snapshot. It stays open for appends, which go to a folder of their own; read_only refuses them."""
        found = snapshot.manifest(spark, path)
        config = found["config"]
        try:
            settings = graph.GraphConfig(**config["graph"])
        except (KeyError, TypeError, ValueError) as e:
            raise snapshot.SnapshotError(f"bad configuration: {e}") from e
        if config["dim"] < 1 or config["docs"] < 1:
            raise snapshot.SnapshotError("a snapshot holds at least one document of one dimension")
        out = cls(spark, embedder or HashEmbedder(dim=config["dim"]), config=settings, mode=config.get("mode", "graph"))
        if out.dim != config["dim"]:
            raise snapshot.SnapshotError(f"the snapshot has {config['dim']} dimensions, the embedder {out.dim}")
        root = snapshot.root(spark, path)
        out._parts, out._n, out.read_only = [root], config["docs"], read_only
        held = out.docs.count()
        if held != config["docs"]:
            raise snapshot.SnapshotError(f"the snapshot is truncated: {held} of {config['docs']} documents")
        for name in out._indexes:
            if name in found["tables"]:
                out._indexes[name] = ([f"{root}/{name}"], 1)
        return out
