"""How distinctive a term is per record: positive pointwise mutual information from joint and marginal counts.

The context (record) counts are smoothed by a fractional exponent. Group-bys and joins only. The cleaned postings are stored once, laid out
by term, so the counts by term and the join with them need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.llm.common import join_unique, pieces, salt
from lodeseek.session import stored

#: Postings of one task.
TASK_ROWS = 1_000_000
#: Exponent of the context counts.
ALPHA = 0.75
#: Rounding that two ways to one quantity may differ by.
EPSILON = 1e-9


def clean_postings(postings: DataFrame, tasks: int | None = None) -> DataFrame:
    """(term, __salt, node_id, tf), one row a (term, node_id) that occurs.

    Null terms and nodes don't count. The row with the latest flushed_at holds (null is earliest; equal times: the larger
    tf); a tf that is null, zero or negative means that the term does not occur. The one shuffle lays rows
    out by (term, salt of the node), so that a term with a third of all rows lies in SALTS tasks, and every
    later step by term starts from there.
    """
    rows = postings.where("term is not null and node_id is not null").select("term", salt("node_id").alias("__salt"), "node_id", "tf", F.coalesce(F.unix_micros("flushed_at"), F.lit(-(1 << 62))).alias("__at"))
    laid = rows.repartition(tasks or pieces(postings, TASK_ROWS), "term", "__salt")
    once = laid.groupBy("term", "__salt", "node_id", "__at").agg(F.max(F.coalesce("tf", F.lit(-1))).alias("tf"))
    held = once.groupBy("term", "__salt", "node_id").agg(F.max_by("tf", "__at").alias("tf"))
    return held.where("tf > 0")


def _pmi(tf: Column, term_total: Column, node_total: Column, smooth: Column, alpha: float) -> Column:
    return F.log(tf * smooth / (term_total * F.pow(node_total.cast("double"), F.lit(alpha))))


def ppmi(postings: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(node_id, term, tf, term_total, node_total, smooth, ppmi) for every (term, node_id) that occurs.

    ppmi = max(0, ln(P(term, node) / (P(term) P_alpha(node)))), with P_alpha proportional to the node's total to the
    power alpha; smooth is the sum of those powers. An empty table gives no rows. A node with more than a thousandth of all rows meets its
    total in a broadcast join.
    """
    tasks = pieces(postings, TASK_ROWS)
    rows = stored(clean_postings(postings, tasks), tasks, ["term", "__salt"])
    by_salt = rows.groupBy("term", "__salt").agg(F.sum("tf").alias("__part"))
    by_term = by_salt.groupBy("term").agg(F.sum("__part").alias("term_total"), F.collect_list("__salt").alias("__salts"))
    totals = by_term.select("term", F.explode("__salts").alias("__salt"), "term_total")
    nodes = stored(rows.groupBy("node_id").agg(F.sum("tf").alias("node_total"), F.count("*").alias("__n")))
    whole = nodes.agg(F.sum(F.pow(F.col("node_total").cast("double"), F.lit(alpha))).alias("smooth"), F.sum("__n").alias("n")).first()
    if not whole["n"]:
        return rows.select("node_id", "term", "tf", F.lit(0).cast("long").alias("term_total"), F.lit(0).cast("long").alias("node_total"), F.lit(0.0).alias("smooth"), F.lit(0.0).alias("ppmi"))
    joined = join_unique(rows.join(totals, ["term", "__salt"]), nodes, ["node_id"], "__n", whole["n"]).withColumn("smooth", F.lit(whole["smooth"]))
    value = F.greatest(F.lit(0.0), _pmi(F.col("tf"), F.col("term_total"), F.col("node_total"), F.col("smooth"), alpha))
    return joined.select("node_id", "term", "tf", "term_total", "node_total", "smooth", value.alias("ppmi"))


def kept_to_few(scored: DataFrame, uses: int = 3, tenths: int = 3, alpha: float = ALPHA) -> DataFrame:
    """Terms used at least `uses` times by a node which has at least `tenths` tenths of all uses.

    A node with that share of a term's uses has at least the ppmi that this share gives for a node of its size, so rows are found by their
    ppmi; the share itself is then checked in whole numbers.
    """
    bound = F.greatest(F.lit(0.0), F.log(F.lit(tenths / 10) * F.col("smooth") / F.pow(F.col("node_total").cast("double"), F.lit(alpha))))
    found = scored.where((F.col("tf") >= uses) & (F.col("ppmi") >= bound - EPSILON))
    return found.where(F.col("tf") * 10 >= F.col("term_total") * tenths)
