"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form a stream that is cut into blocks of equal size. Block j of a source with weight w is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); the released block due earliest takes each slot. At every slot
each source then lies less than one block from its share. The weights are the exact block counts, so the schedule repeats after
the slots divided by the counts' common divisor; one such period is computed on the driver, and every block finds its
slot by arithmetic.

Two schedules are made this way. The mix gives what short sources leave open to the others. The schedule of the targets asks every
source for its own target; a source whose documents run out leaves slots of its own empty, and so it is found to be short.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.encode import VOCABULARY, count_tokens
from lodeseek.operators.topk import positions
from lodeseek.session import cut

BLOCK_TOKENS = 2048
#: Uses of one document that are listed at once.
LISTED = 10_000


def pfair(counts: dict[str, int]) -> list[str]:
    """The owners of sum(counts) slots, each name as often as its count."""
    period = sum(counts.values())
    waiting = [(0, name, 0) for name, n in sorted(counts.items()) if n > 0]  # (release, name, j)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: list[str] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // counts[name]), name, j))
        _, name, j = heapq.heappop(ready)
        slots.append(name)
        if j + 1 < counts[name]:
            heapq.heappush(waiting, ((j + 1) * period // counts[name], name, j + 1))
    return slots


def fill(targets: dict[str, float], capacity: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source: its target of the total, at most its capacity; what short sources leave open goes to the others in
    proportion to their targets, until all is given or all are full."""
    given = dict.fromkeys(targets, 0.0)
    free = {s for s, w in targets.items() if w > 0 and capacity[s] > 0}
    left = total
    while free and left > 1e-6:
        weight = sum(targets[s] for s in free)
        full = {s for s in free if capacity[s] <= left * targets[s] / weight}
        if not full:
            for s in free:
                given[s] = left * targets[s] / weight
            break
        for s in full:
            given[s] = float(capacity[s])
        left -= sum(given[s] for s in full)
        free -= full
    return given


def sizes(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source has a target; null ids and sources don't count. Read once, kept in the shared folder.
    targets has one row a source and comes to the driver for the schedule in any case, so it may be broadcast: a source with most rows isn't shuffled."""
    wanted = targets.where("source is not null").select("source").distinct()
    return cut(count_tokens(docs.where("doc_id is not null").join(F.broadcast(wanted), "source", "left_semi"), ["doc_id", "source"], "text", vocabulary))


def capacities(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, tokens, capacity, wanted, short): one row a target. A repeated target counts once (the largest);
    a null weight or repeat count means 0, a negative count gives no capacity. short: even max_repeats uses of each document stay below
    weight * T, T being all tokens once; a forecast, missed() sees what a schedule really holds."""
    goals = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_weight"), F.lit(0.0)).alias("target_weight"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("__t"))
    rows = goals.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).crossJoin(F.broadcast(whole))
    capacity = F.col("tokens") * F.greatest("max_repeats", F.lit(0))
    wanted = F.col("target_weight") * F.col("__t")
    return rows.select("source", "target_weight", "max_repeats", "tokens", capacity.alias("capacity"), wanted.alias("wanted"), (capacity < wanted).alias("short"))


def schedule(sized: DataFrame, caps: DataFrame, block: int = BLOCK_TOKENS, spread: bool = True) -> DataFrame:
    """(slot, source, doc_id, repeat, start, tokens): every use of every document in mixed order (by slot, source, start).

    A source's stream is its documents in hashed order, pass after pass; a use belongs to the mix if it starts within the source's
    budget, so a source exceeds it by less than one document. The budget comes from fill(); without spread it is the source's own
    target, and slots that its stream doesn't reach stay empty (one block of them at most is planned). Only the targets (one row a
    source) come to the driver, which computes the slots (8 bytes a block) and sends them to each task's process once. The running
    sum over a source runs in ranges of rows, so a source of any size is never gathered.
    """
    rows = caps.collect()
    if spread:
        total = sum(r["tokens"] for r in rows)
        budget = fill({r["source"]: r["target_weight"] for r in rows}, {r["source"]: r["capacity"] for r in rows}, total)
    else:
        budget = {r["source"]: min(float(r["capacity"] + block), r["wanted"]) for r in rows}
    # a use starts at a whole token before its source's budget
    blocks = {s: (math.ceil(b) - 1) // block + 1 for s, b in budget.items() if b > 0}
    spark = sized.sparkSession
    out = "slot long, source string, doc_id long, repeat int, start long, tokens long"
    if not blocks:
        return spark.createDataFrame([], out)
    common = math.gcd(*blocks.values())
    counts = {s: n // common for s, n in blocks.items()}
    cycle = sum(counts.values())
    place, filled = {s: np.empty(n, dtype=np.int64) for s, n in counts.items()}, dict.fromkeys(counts, 0)
    for slot, s in enumerate(pfair(counts)):
        place[s][filled[s]] = slot
        filled[s] += 1
    shared = spark.sparkContext.broadcast(place)
    order = positions(sized.withColumn("__h", F.xxhash64("doc_id")), ["source"], [("__h", True), ("doc_id", True)], "prior", "tokens")
    plan = [(r["source"], int(r["tokens"]), int(r["max_repeats"]), float(budget[r["source"]])) for r in rows if r["capacity"] > 0 and r["source"] in blocks]
    uses = order.join(F.broadcast(spark.createDataFrame(plan, "source string, __size long, __most int, __budget double")), "source")
    # the last use that can start within the budget; listed in parts, as a small source may be allowed any number of uses
    last = F.greatest(F.lit(0), F.least(F.col("__most") - 1, F.floor((F.col("__budget") - F.col("prior")) / F.col("__size")))).cast("int")
    uses = uses.withColumn("__last", last).withColumn("__from", F.explode(F.sequence(F.lit(0), "__last", F.lit(LISTED))))
    uses = uses.withColumn("repeat", F.explode(F.sequence("__from", F.least(F.col("__last"), F.col("__from") + (LISTED - 1)))))
    uses = uses.withColumn("start", F.col("repeat") * F.col("__size") + F.col("prior")).where("start < __budget")

    def assign(batches):
        place = shared.value
        for b in batches:
            if b.num_rows:
                got = [(s, x // block) for s, x in zip(b["source"].to_pylist(), b["start"].to_pylist())]
                slot = [j // len(place[s]) * cycle + int(place[s][j % len(place[s])]) for s, j in got]
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), b["source"], b["doc_id"], b["repeat"], b["start"], b["tokens"]], ["slot", "source", "doc_id", "repeat", "start", "tokens"])

    return uses.select("source", F.col("doc_id").cast("long"), "repeat", F.col("start").cast("long"), "tokens").mapInArrow(assign, out)


def missed(sized: DataFrame, caps: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(source): the sources that miss slots in the schedule of the targets, where each is asked for weight * T and nothing is spread.
    What counts is the tokens that the schedule holds. Targets may sum to any number; a source without documents misses all its slots."""
    caps = cut(caps)
    used = schedule(sized, caps, block, spread=False).groupBy("source").agg(F.sum("tokens").alias("used"))
    return caps.join(used, "source", "left").where(F.coalesce("used", F.lit(0)) < F.col("wanted")).select("source")


def shares(mixed: DataFrame, caps: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, tokens, short, used, documents, uses, actual_share): what the mix really holds."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"))
    whole = used.agg(F.sum("used").alias("__all"))
    rows = caps.join(used, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.when(F.col("__all") > 0, F.coalesce(F.col("used"), F.lit(0)) / F.col("__all")).otherwise(F.lit(0.0))
    return rows.select("source", "target_weight", "max_repeats", "tokens", "short", zero("used"), zero("documents"), zero("uses"), share.alias("actual_share"))
