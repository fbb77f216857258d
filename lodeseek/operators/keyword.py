"""Inverted index and BM25 as group-bys and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeseek.functions.text import distinct_terms, tokens
from lodeseek.operators.topk import top_k

K1, B = 1.2, 0.75
#: Terms that a scan takes as literals.
FEW_TERMS = 200


def postings(docs: DataFrame) -> DataFrame:
    """(term, node_id, tf) of docs(node_id, text)."""
    return docs.select("node_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "node_id").agg(F.count("*").cast("int").alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("node_id", F.size(tokens(F.col("text"))).alias("dl"))


def doc_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl). Documents without terms count; the average is at least 1."""
    return lengths.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))


def idf(n, df):
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def term_weight(idf_, tf, dl, avgdl):
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): each distinct term of a query once."""
    return queries.select("query_id", F.explode(distinct_terms(F.col("text"))).alias("term"))


def score(index: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, score) for every document with at least one term of the query. Up to FEW_TERMS different terms are given to the scan as
    literals, so an index that is sorted by term is read only where they are; the result is the same beyond."""
    terms = query_terms(queries)
    few = terms.select("term").distinct().limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        index = index.where(F.col("term").isin([r["term"] for r in few]))
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = doc_frequency(wanted)
    hits = terms.join(df, "term").join(wanted, "term").join(lengths, "node_id").crossJoin(F.broadcast(stats(lengths)))
    weight = term_weight(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.groupBy("query_id", "node_id").agg(F.sum(weight).alias("score"))


def search(index: DataFrame, lengths: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, node_id, score): the k best per query, ties at 9 decimals by node_id."""
    scored = score(index, lengths, queries)
    return top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("node_id")], k).select("query_id", "rank", "node_id", "score")
