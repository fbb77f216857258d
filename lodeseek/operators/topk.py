"""Per-group top-k and distributed positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodeseek.session import cut, parallelism


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group. WindowGroupLimit cuts to k rows per task before the shuffle, so a hot group stays small."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Rows of one range of positions(), about.
RANGE_ROWS = 1_000_000


def positions(df: DataFrame, by: list[str], order: list[tuple[str, bool]], name: str = "position", weight: str | None = None, rows: int | None = None) -> DataFrame:
    """1-based positions within each group of any size, or with weight the sum of it over the earlier rows (exclusive).

    order: (column, ascending). One range shuffle over (group, order), whose outcome is written to the shared
    folder; each piece numbers its own rows and adds what earlier pieces hold of the same group. No task
    holds more than a range of rows, whatever the size of a group. Null groups count as one. Rows equal in all these columns
    come in any order among themselves: let the last column be unique within its group. The range shuffle samples df, so df is read twice
    (thrice without `rows`, its number of rows): hand over a frame that is read from storage, not one that is costly to compute.
    """
    n = max(parallelism(df.sparkSession), -(-(df.count() if rows is None else rows) // RANGE_ROWS))
    piece, before = "__piece", "__before"
    keys = [F.col(c) for c in by] + [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    ranged = cut(df.repartitionByRange(n, *keys).withColumn(piece, F.spark_partition_id()))
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    held = ranged.groupBy(*by, piece).agg(amount.alias("__held"))
    earlier = W.partitionBy(*by).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    starts = held.withColumn(before, F.coalesce(F.sum("__held").over(earlier), F.lit(0))).where(F.col(before) > 0)
    starts = starts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(piece).alias("__at"), before)
    same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    joined = ranged.join(starts, reduce(lambda a, b: a & b, same, F.col(piece) == F.col("__at")), "left").drop("__at", *[f"__by{i}" for i in range(len(by))])
    local = W.partitionBy(*by, piece).orderBy(*keys[len(by) :])
    if weight is None:
        here = F.row_number().over(local)
    else:
        here = F.coalesce(F.sum(weight).over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(name, here + F.coalesce(F.col(before), F.lit(0))).drop(piece, before)
