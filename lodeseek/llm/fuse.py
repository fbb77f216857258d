"""One ranking from several differently-scaled scores.

Method: within each list (query, leg) readings are standardised by median and median absolute deviation, squashed
by the logistic function, and a node's bounded values are combined as a weighted geometric mean.

All lists of a query lie in one task, so a single shuffle by query carries cleaning, standardising, positions and fusion. Queries too large
for a task go through range shuffles instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.llm.common import join_unique, latest, pieces
from lodeseek.operators.topk import positions, top_k
from lodeseek.session import cut

#: Leg -> (column of its reading, whether larger is better).
LEGS = {"dense": ("dist", False), "lexical": ("score", True), "rerank": ("score", True)}
#: A deviation of the normal distribution is 1.4826 median absolute deviations.
MAD_SCALE = 1.4826
#: Bounded value that a leg without the node counts in the mean, and at least counted for one that holds it.
FLOOR = 0.01
RRF_K = 60
#: Rows of one task; the lists of a query with more rows than QUERY_ROWS are spread over tasks.
TASK_ROWS, QUERY_ROWS = 500_000, 100_000
_LIST = ["query_id", "leg"]
_BIG = 1e300


def _raw(hits: DataFrame, legs: dict[str, tuple[str, bool]] = LEGS) -> DataFrame:
    """(query_id, leg, node_id, good, logged_at): readings turned so that larger is better."""
    value = None
    for leg, (column, up) in legs.items():
        x = F.col(column).cast("double")
        value = (F.when if value is None else value.when)(F.col("leg") == leg, x if up else -x)
    return hits.where(F.col("leg").isin(*legs)).select("query_id", "leg", "node_id", value.alias("good"), "logged_at").dropna(subset=["query_id", "leg", "node_id"])


def _held(raw: DataFrame) -> DataFrame:
    found = latest(raw, [*_LIST, "node_id"], ["good"], "logged_at")
    # 0.0 and -0.0 are one reading
    return found.where(F.col("good").isNotNull() & ~F.isnan("good")).withColumn("good", F.col("good") + F.lit(0.0))


def readings(hits: DataFrame, legs: dict[str, tuple[str, bool]] = LEGS) -> DataFrame:
    """(query_id, leg, node_id, good): one valid reading a node and list, turned so that larger is better.

    The latest logged_at of a (query, leg, node) holds, even if it is null or NaN, which means no reading. Rows with a null
    key or an unknown leg don't count. Infinite readings are valid; they are standardised as the largest number.
    """
    return _held(_raw(hits, legs))


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), x))


def _squashed(off: Column, mad: Column) -> Column:
    """Logistic value in (0, 1) of a deviation; a list whose MAD is zero is standardised by 1."""
    z = off / F.when(mad > 0, mad * MAD_SCALE).otherwise(F.lit(1.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def _gathered(rows: DataFrame) -> DataFrame:
    """rows(query_id, leg, node_id, good) plus value and position, each list gathered in one task. rows must lie there by query."""
    middle = lambda s: F.element_at(s, ((F.size(s) + 1) / 2).cast("int"))
    lists = rows.groupBy(*_LIST).agg(F.collect_list(F.struct("good", "node_id")).alias("all"))
    lists = lists.withColumn("median", middle(F.sort_array(F.transform("all", lambda r: _clipped(r["good"])))))
    lists = lists.withColumn("mad", middle(F.sort_array(F.transform("all", lambda r: F.abs(_clipped(_clipped(r["good"]) - F.col("median")))))))
    # best value first; where squashing makes two equal the reading decides, then the id
    ordered = F.sort_array(F.transform("all", lambda r: F.struct((-_squashed(_clipped(_clipped(r["good"]) - F.col("median")), F.col("mad"))).alias("down"), (-r["good"]).alias("less"), r["node_id"].alias("node_id"))))
    placed = lists.select(*_LIST, F.posexplode(ordered).alias("at", "r"))
    return placed.select(*_LIST, F.col("r.node_id").alias("node_id"), (-F.col("r.down")).alias("value"), (F.col("at") + 1).alias("position"))


def _spread(rows: DataFrame) -> DataFrame:
    """The same for lists of any size, by range shuffles. A value never falls as its reading rises, so positions by reading are positions by value."""
    rows = cut(rows)
    total = rows.count()
    sizes = rows.groupBy(*_LIST).agg(F.count("*").alias("__n"))
    placed = cut(positions(rows, _LIST, [("good", False), ("node_id", True)], rows=total))
    lower = lambda c: F.ceil(F.col("__n") / 2) == F.col(c)
    # the lower median is as far from the worst end as it is in ascending order
    median = placed.join(sizes, _LIST).where(F.col("__n") + 1 - F.col("position") == F.ceil(F.col("__n") / 2)).select(*_LIST, "__n", _clipped(F.col("good")).alias("__median"))
    off = cut(join_unique(placed, median, _LIST, "__n", total).withColumn("__off", _clipped(_clipped(F.col("good")) - F.col("__median"))).withColumn("__far", F.abs("__off")).drop("__median", "__n"))
    mad = positions(off, _LIST, [("__far", True), ("node_id", True)], "__at", rows=total).join(sizes, _LIST).where(lower("__at")).select(*_LIST, "__n", F.col("__far").alias("__mad"))
    return join_unique(off, mad, _LIST, "__n", total).select(*_LIST, "node_id", _squashed(F.col("__off"), F.col("__mad")).alias("value"), F.col("position").cast("long").alias("position"))


def bounded(hits: DataFrame) -> DataFrame:
    """(query_id, leg, node_id, value, position) of the valid readings of hits: value = logistic of (good - median) / (1.4826 MAD) in (0, 1), the
    (lower) medians exact at any size of a list, and positions from the best value on, equal readings by node_id."""
    raw = _raw(hits)
    large = cut(raw.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > QUERY_ROWS).select("query_id"))
    none = large.isEmpty()
    small = raw if none else raw.join(large, "query_id", "left_anti")
    out = _gathered(_held(small.repartition(pieces(hits, TASK_ROWS), "query_id")))
    return out if none else out.unionByName(_spread(_held(raw.join(large, "query_id", "left_semi"))))


def ranked(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, node_id, value, rrf): the operator. value is the weighted geometric mean of a node's bounded values,
    rrf the sum of 1 / (60 + position) over its lists, rounded to 9 decimals.

    Positions follow the bounded values; where squashing makes different readings equal, the readings decide, and
    equal readings go by node_id. A leg that misses a node counts FLOOR in the mean and nothing in rrf.
    """
    weights = weights or {leg: 1.0 for leg in LEGS}
    total = sum(weights.values())
    placed = bounded(hits)
    weight = F.coalesce(*[F.when(F.col("leg") == leg, F.lit(float(w))) for leg, w in weights.items()], F.lit(0.0))
    log_floor = F.log(F.lit(FLOOR))
    # a missing leg contributes w log(FLOOR): start from all legs missing, then replace those present
    gain = weight * (F.log(F.greatest(F.col("value"), F.lit(FLOOR))) - log_floor)
    nodes = placed.groupBy("query_id", "node_id").agg(F.sum(gain).alias("gain"), F.round(F.sum(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("position"))), 9).alias("rrf"))
    return nodes.select("query_id", "node_id", F.exp(F.col("gain") / total + log_floor).alias("value"), "rrf")


def best(scored: DataFrame, by: str, k: int = 5, decimals: int = 9) -> DataFrame:
    """(query_id, node_id, rank, by): the k largest of each query, equal ones by node_id."""
    return top_k(scored.withColumn(by, F.round(by, decimals)), ["query_id"], [F.col(by).desc(), F.col("node_id")], k).select("query_id", "node_id", "rank", by)
