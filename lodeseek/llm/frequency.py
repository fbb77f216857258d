"""Frequency of every distinct value or term, by suffix arrays with common-prefix intervals.

Each task builds the suffix array of its block of records by prefix doubling, and from the ranks of the doublings the length of the common prefix of
every two neighbours. Suffixes between two neighbours with fewer than n common tokens form the interval of one n-gram: its occurrences are the
interval's entries, its records those less the adjacencies of entries of one record within the interval. So one array gives the counts
for every n. Records lie wholly in one block, so both numbers add up over blocks: the shuffle carries one row a block and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.functions.text import tokens
from lodeseek.llm.common import latest
from lodeseek.llm.distinctive import clean_postings

#: Terms in so few records are rare; those in more than a third of all records are common.
RARE = 2
#: Tokens of one suffix array; a block ends with the record that passes it.
BLOCK = 1 << 20


def suffix_array(codes: np.ndarray, left: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): positions of codes in the order of their suffixes, and how many tokens each shares with the one before it.

    left: tokens from a position to its record's end, where its suffix ends. With depth, suffixes are sorted by that many tokens at least, and
    longer common prefixes may be counted short (never below depth).
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    ranks, h = [rank], 1
    upto = int(left.max()) if depth is None else min(depth, int(left.max()))
    while h < upto and (rank.max() < n):
        # a suffix that ends within h tokens comes before all that go on
        after = np.zeros(n, dtype=np.int64)
        on = np.nonzero(left > h)[0]
        after[on] = rank[on + h]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        ranks.append(rank)
        h *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    so_far = common[1:]
    for i in range(len(ranks) - 1, -1, -1):
        on = (so_far < left[a]) & (so_far < left[b])
        x, y = np.where(on, a + so_far, 0), np.where(on, b + so_far, 0)
        same = on & (ranks[i][x] == ranks[i][y])
        so_far += np.where(same, np.minimum(1 << i, left[x]), 0)
        if i == len(ranks) - 1:
            # equal at the deepest rank: the same as far as was sorted
            same_deep = same
    if depth is None and len(ranks) and rank.max() < n:
        # suffixes equal to their ends share all of it
        so_far[:] = np.where(same_deep, np.minimum(left[a], left[b]), so_far)
    return order, common


def intervals(codes: np.ndarray, record: np.ndarray, left: np.ndarray, width: int | None = None, weight: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1.. up to width (or the longest record): n, a position where each n-gram stands, its occurrences and its records.
    weight: how often a record of one token stands in a row (default once)."""
    order, common = suffix_array(codes, left, width)
    n = len(order)
    if not n:
        return
    record, left = record[order], left[order]
    weight = np.ones(n, dtype=np.int64) if weight is None else weight[order].astype(np.int64)
    # the previous entry of the same record in suffix order
    by_record = np.argsort(record, kind="stable")
    previous = np.full(n, -1, dtype=np.int64)
    same = record[by_record][1:] == record[by_record][:-1]
    previous[by_record[1:][same]] = by_record[:-1][same]
    for at in range(1, (int(left.max()) if width is None else width) + 1):
        fresh = common < at
        fresh[0] = True
        number = np.cumsum(fresh) - 1
        starts = np.nonzero(fresh)[0]
        occurrences = np.add.reduceat(weight, starts)
        # entries of weight w stand w times: w - 1 adjacencies, and one more with the record's previous entry
        linked = (previous >= 0) & (number[np.maximum(previous, 0)] == number)
        repeats = np.add.reduceat(weight - 1 + linked, starts)
        held = left[starts] >= at
        yield at, order[starts[held]], occurrences[held], (occurrences - repeats)[held]


def _frame(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, ["n", "gram", "occurrences", "records"])


COUNTS = "n int, gram string, occurrences long, records long"


def count_postings(postings: DataFrame) -> DataFrame:
    """(term, occurrences, records) from postings (see clean_postings): a posting is a record of one token that stands tf times."""

    def block(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        coded = t["term"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for n, row, occurrences, records in intervals(codes, np.asarray(t["node_id"]), np.ones(len(codes), np.int64), 1, np.asarray(t["tf"])):
            yield _frame([pa.array(np.full(len(row), n, np.int32)), coded.dictionary.take(coded.indices.take(pa.array(row))), pa.array(occurrences), pa.array(records)])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= BLOCK:
                yield from block(held)
                held, size = [], 0
        if held:
            yield from block(held)

    # one row a (term, node) is left, so a block may end anywhere
    parts = clean_postings(postings).select("term", "node_id", "tf").mapInArrow(run, COUNTS)
    return parts.groupBy(F.col("gram").alias("term")).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def count_texts(docs: DataFrame, key: str = "node_id", text: str = "text", at: str = "added_at", width: int | None = 2) -> DataFrame:
    """(n, gram, occurrences, records) of all n-grams of up to `width` terms, or of every length with width None (a record of m terms then has
    m(m + 1) / 2 of them). Null texts hold nothing; repeated rows count once (the latest by `at`)."""
    rows = latest(docs.where(F.col(key).isNotNull()), [key], [text], at).select(tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)

    def block(words: list[pa.Array], lengths: list[np.ndarray]):
        flat = pa.concat_arrays(words).dictionary_encode()
        size = np.concatenate(lengths)
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        record = np.repeat(np.arange(len(size)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
        names = np.asarray(flat.dictionary.to_pylist(), dtype=object)
        for n, row, occurrences, records in intervals(codes, record, left, width):
            gram = names[codes[row]]
            for j in range(1, n):
                gram = gram + " " + names[codes[row + j]]
            yield _frame([pa.array(np.full(len(row), n, np.int32)), pa.array(gram.tolist(), pa.string()), pa.array(occurrences), pa.array(records)])

    def run(batches):
        words: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held = 0
        for b in batches:
            if b.num_rows:
                words.append(b["tokens"].flatten())
                lengths.append(b["tokens"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                held += len(words[-1])
            if held >= BLOCK:
                yield from block(words, lengths)
                words, lengths, held = [], [], 0
        if held:
            yield from block(words, lengths)

    parts = rows.select("tokens").mapInArrow(run, COUNTS)
    return parts.groupBy("n", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def records(lengths: DataFrame, key: str = "node_id") -> DataFrame:
    """One row (total): distinct records."""
    return lengths.agg(F.countDistinct(key).alias("total"))


def marked(counts: DataFrame, total: DataFrame, rare: int = RARE) -> DataFrame:
    """counts plus mark: one row for 'rare' (at most `rare` records), one for 'common' (more than a third of the total); a term
    that is both has two rows, one that is neither none."""
    marks = F.array_compact(F.array(F.when(F.col("records") <= rare, F.lit("rare")), F.when(F.col("records") * 3 > F.col("total"), F.lit("common"))))
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", F.explode(marks)).drop("total")
