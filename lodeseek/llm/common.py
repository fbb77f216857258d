"""Shared pieces: latest record, and joins that a hot key cannot overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one key are spread over so many tasks wherever a table is laid out by that key.
SALTS = 16
#: A key counts as hot from this share of all rows on, so there are at most HOT keys.
HOT = 1000


def salt(by: str, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")


def pieces(df: DataFrame, rows: int, n: int | None = None) -> int:
    """Tasks for a shuffle of df's rows (counted, unless n tells) with about `rows` rows each, at least as many as the session shuffles into."""
    n = df.count() if n is None else n
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))


def latest(df: DataFrame, keys: list[str], values: list[str], at: str) -> DataFrame:
    """One row a key: the values of its latest row by `at` (null is earliest; among equal times the larger values, null last)."""
    best = F.max(F.struct(F.col(at), *values))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{v}").alias(v) for v in values])


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """Rows of counts whose n exceeds total / HOT: fewer than HOT of them whatever the data, so they may be broadcast."""
    return counts.where(F.col(n) > total / HOT)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right, which is unique by keys and holds in `weight` the number of left rows of its key.

    Hot keys meet their rows in a broadcast join (fewer than HOT rows), the others in a shuffled one.
    """
    hot = F.broadcast(hot_keys(right, weight, total))
    rest = right.where(F.col(weight) <= total / HOT)
    cold = left.join(hot.select(*keys), keys, "left_anti").join(rest, keys)
    return left.join(hot, keys).unionByName(cold)
