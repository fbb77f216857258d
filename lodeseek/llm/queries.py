"""The queries of the training-data operations, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.llm import distinctive, encode, frequency, fuse, mix, neardup, neighbours, split, subjects
from lodeseek.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# 1: most similar vectors

USABLE = "SELECT {0} AS id, v::DOUBLE[] AS v FROM (SELECT {0}, v, row_number() OVER (PARTITION BY {0} ORDER BY {1} DESC NULLS LAST) AS i FROM {2}) WHERE i = 1 AND len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0"
UNIT = "SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM {}"


@query(
    "p1_found",
    f"""WITH a AS ({USABLE.format('node_id', 'added_at', 'vectors')}), b AS ({USABLE.format('query_id', 'asked_at', 'queries')}), x AS ({UNIT.format('a')}), y AS ({UNIT.format('b')}),
s AS (SELECT p.id AS id, r.id AS near, round(list_inner_product(p.u, r.u), 6) AS s, 0 AS kind FROM x p JOIN x r ON p.id <> r.id UNION ALL SELECT p.id, r.id, round(list_inner_product(p.u, r.u), 6), 1 FROM y p, x r),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY s DESC, near) AS i FROM s) SELECT DISTINCT CASE WHEN kind = 1 THEN id ELSE least(id, near) END AS id_a, CASE WHEN kind = 1 THEN near ELSE greatest(id, near) END AS id_b FROM k WHERE i <= 5""",
)
def _(spark, d):
    return neighbours.similar_pairs(table(spark, d, "vectors"), table(spark, d, "queries"))


# 2: one ranking

READINGS = """c AS (SELECT query_id, leg, node_id, CASE leg WHEN 'dense' THEN -dist WHEN 'lexical' THEN score WHEN 'rerank' THEN score END AS good, logged_at FROM hits WHERE leg IN ('dense', 'lexical', 'rerank')),
l AS (SELECT query_id, leg, node_id, good, row_number() OVER (PARTITION BY query_id, leg, node_id ORDER BY logged_at DESC NULLS LAST, good DESC NULLS LAST) AS i FROM c WHERE query_id IS NOT NULL AND leg IS NOT NULL AND node_id IS NOT NULL),
v AS (SELECT query_id, leg, node_id, good FROM l WHERE i = 1 AND good IS NOT NULL AND NOT isnan(good))"""


@query(
    "p2_found",
    f"""WITH {READINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY good DESC, node_id) AS pos FROM v),
s AS (SELECT query_id, node_id, round(sum(1 / (60 + pos)::DOUBLE), 9) AS score FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS i FROM s) SELECT query_id, node_id FROM r WHERE i <= 5""",
)
def _(spark, d):
    return fuse.best(fuse.ranked(table(spark, d, "hits")), "rrf").select("query_id", "node_id")


@query(
    "p2_blend",
    f"""WITH {READINGS}, m AS (SELECT query_id, leg, quantile_disc(good, 0.5) AS med FROM v GROUP BY ALL), o AS (SELECT v.*, good - med AS off FROM v JOIN m USING (query_id, leg)),
d AS (SELECT query_id, leg, quantile_disc(abs(off), 0.5) AS mad FROM o GROUP BY ALL), z AS (SELECT o.*, off / CASE WHEN mad > 0 THEN mad * 1.4826::DOUBLE ELSE 1 END AS z FROM o JOIN d USING (query_id, leg)),
s AS (SELECT query_id, node_id, round(exp((sum(ln(greatest(1 / (1 + exp(-greatest(-700, least(700, z)))), 0.01::DOUBLE))) + (3 - count(*)) * ln(0.01::DOUBLE)) / 3), 6) AS value FROM z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, node_id) AS rank FROM s) SELECT query_id, node_id, rank::INT AS rank, value FROM r WHERE rank <= 5""",
)
def _(spark, d):
    """The same operator's weighted geometric mean."""
    return fuse.best(fuse.ranked(table(spark, d, "hits")), "value", decimals=6)


# 3 and 4: terms

POSTINGS = """l AS (SELECT term, node_id, tf, row_number() OVER (PARTITION BY term, node_id ORDER BY flushed_at DESC NULLS LAST, coalesce(tf, -1) DESC) AS i FROM postings WHERE term IS NOT NULL AND node_id IS NOT NULL),
c AS (SELECT term, node_id, tf FROM l WHERE i = 1 AND tf > 0)"""


@query("p3_found", f"WITH {POSTINGS}, t AS (SELECT term, sum(tf) AS n FROM c GROUP BY ALL) SELECT node_id, c.term FROM c JOIN t ON c.term = t.term WHERE tf >= 3 AND tf * 10 >= n * 3")
def _(spark, d):
    return distinctive.kept_to_few(distinctive.ppmi(table(spark, d, "postings"))).select("node_id", "term")


@query(
    "p3_ppmi",
    f"""WITH {POSTINGS}, t AS (SELECT term, sum(tf) AS tt FROM c GROUP BY ALL), n AS (SELECT node_id, sum(tf) AS nt FROM c GROUP BY ALL), s AS (SELECT sum(pow(nt::DOUBLE, 0.75)) AS z FROM n)
SELECT c.node_id, c.term, tf::INT AS tf, tt::BIGINT AS term_total, round(greatest(0, ln(tf * z / (tt * pow(nt::DOUBLE, 0.75)))), 6) + 0 AS ppmi FROM c JOIN t ON c.term = t.term JOIN n ON c.node_id = n.node_id, s""",
)
def _(spark, d):
    return distinctive.ppmi(table(spark, d, "postings")).select("node_id", "term", "tf", "term_total", (F.round("ppmi", 6) + F.lit(0.0)).alias("ppmi"))


MARKED = """SELECT {0}, 'rare' AS mark FROM {1} WHERE records <= 2 UNION ALL SELECT {0}, 'common' FROM {1} WHERE records * 3 > (SELECT count(DISTINCT node_id) FROM doc_len)"""


@query("p4_found", f"WITH {POSTINGS}, f AS (SELECT term, count(*) AS records FROM c GROUP BY ALL) {MARKED.format('term', 'f')}")
def _(spark, d):
    counts = frequency.count_postings(table(spark, d, "postings"))
    return frequency.marked(counts, frequency.records(table(spark, d, "doc_len"))).select("term", "mark")


@query("p4_terms", f"WITH {POSTINGS} SELECT term, sum(tf)::BIGINT AS occurrences, count(*)::BIGINT AS records FROM c GROUP BY ALL")
def _(spark, d):
    return frequency.count_postings(table(spark, d, "postings"))


@query(
    "p4_ngrams",
    """WITH o AS (SELECT node_id, text, row_number() OVER (PARTITION BY node_id ORDER BY added_at DESC NULLS LAST, text DESC NULLS LAST) AS i FROM docs), k AS (SELECT node_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS t FROM o WHERE i = 1 AND text IS NOT NULL),
g AS (SELECT node_id, 1 AS n, unnest(t) AS gram FROM k UNION ALL SELECT node_id, 2, unnest([x[1] || ' ' || x[2] for x in list_zip(t[1:-2], t[2:])]) FROM k WHERE len(t) > 1)
SELECT n::INT AS n, gram, count(*) AS occurrences, count(DISTINCT node_id) AS records FROM g GROUP BY ALL""",
)
def _(spark, d):
    return frequency.count_texts(table(spark, d, "docs"))


def _grams(n: int) -> str:
    return " UNION ALL ".join(f"SELECT node_id, {i}, unnest(list_transform(range(1, len(t) - {i - 2}), lambda i: array_to_string(t[i:i + {i - 1}], ' '))) AS gram FROM k WHERE len(t) >= {i}" for i in range(2, n + 1))


@query(
    "p4_ngrams4",
    f"""WITH o AS (SELECT node_id, text, row_number() OVER (PARTITION BY node_id ORDER BY added_at DESC NULLS LAST, text DESC NULLS LAST) AS i FROM docs), k AS (SELECT node_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS t FROM o WHERE i = 1 AND text IS NOT NULL),
g AS (SELECT node_id, 1 AS n, unnest(t) AS gram FROM k UNION ALL {_grams(4)})
SELECT n::INT AS n, gram, count(*) AS occurrences, count(DISTINCT node_id) AS records FROM g GROUP BY ALL""",
)
def _(spark, d):
    """The same of up to four terms."""
    return frequency.count_texts(table(spark, d, "docs"), width=4)


# 5: splitting


PIECES = """WITH RECURSIVE o AS (SELECT node_id, coll, text, row_number() OVER (PARTITION BY node_id ORDER BY added_at DESC NULLS LAST, length(text) DESC NULLS LAST) AS i FROM docs WHERE node_id IS NOT NULL),
d AS (SELECT node_id, text, length(text) AS n, coalesce(max_len, 512)::INT AS l, coalesce(overlap_len, 0)::INT AS v FROM o LEFT JOIN (SELECT coll, max(max_len) AS max_len, max(overlap_len) AS overlap_len FROM coll_config GROUP BY coll) c ON o.coll = c.coll WHERE i = 1 AND length(text) > coalesce(max_len, 512)),
x AS (SELECT node_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d),
y AS (SELECT node_id, i, ch, lead(ch) OVER w AS following, last_value(CASE WHEN ch NOT IN (' ', chr(9), chr(13)) THEN ch END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM x WINDOW w AS (PARTITION BY node_id ORDER BY i)),
z AS (SELECT node_id, list(i) FILTER (WHERE ch = chr(10) AND held = chr(10)) AS a, list(i) FILTER (WHERE ch IN ('。', '！', '？') OR ch IN ('.', '!', '?') AND following IN (' ', chr(9), chr(10), chr(13))) AS b, list(i) FILTER (WHERE ch IN (' ', chr(9), chr(10), chr(13))) AS c FROM y GROUP BY node_id),
p AS (SELECT node_id, 0 AS s, 0 AS e, 0 AS again, n, l, v, a, b, c FROM d JOIN z USING (node_id)
UNION ALL SELECT node_id, again, t, t - v, n, l, v, a, b, c FROM (SELECT *, CASE WHEN n - again <= l THEN n ELSE coalesce(list_max(list_filter(a, lambda k: k > again + l / 2.0 AND k <= again + l)), list_max(list_filter(b, lambda k: k > again + l / 2.0 AND k <= again + l)), list_max(list_filter(c, lambda k: k > again + l / 2.0 AND k <= again + l)), again + l) END AS t FROM p WHERE e < n))
SELECT node_id, s AS start_pos, e AS end_pos FROM p WHERE e > 0"""


@query("p5_found", PIECES)
def _(spark, d):
    return split.split(table(spark, d, "docs"), table(spark, d, "coll_config"))


@query("p5_balanced")
def _(spark, d):
    return split.split(table(spark, d, "docs"), table(spark, d, "coll_config"), "balanced")


# 6: near-duplicates


SIMILAR = """WITH o AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY added_at DESC NULLS LAST) AS i FROM docs WHERE id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS t FROM o WHERE i = 1), b AS (SELECT id, t, len(t) AS n FROM t WHERE len(t) >= 30),
w AS (SELECT id, n, unnest(t) AS term FROM b), s AS (SELECT x.id AS id_a, y.id AS id_b, x.n AS n, y.n AS m, count(*) AS c FROM w x JOIN w y ON x.term = y.term AND x.id < y.id AND x.n * 10 >= y.n * 8 AND y.n * 10 >= x.n * 8 GROUP BY ALL)"""


@query("p6_found", f"{SIMILAR} SELECT id_a, id_b FROM s WHERE c * 10 >= (n + m - c) * 8")
def _(spark, d):
    return neardup.near_duplicates(table(spark, d, "docs"))


@query(
    "p6_links",
    f"""{SIMILAR}, p AS (SELECT id_a, id_b FROM s WHERE c * 10 >= (n + m - c) * 8), e AS (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p), l AS (SELECT id, count(*) AS links FROM e GROUP BY ALL)
SELECT b.id, min(b.id) OVER (PARTITION BY list_sort(b.t)) AS class_id, coalesce(l.links, 0)::BIGINT AS links FROM b LEFT JOIN l ON b.id = l.id""",
)
def _(spark, d):
    """One row a record: its class of equal term sets and the number of its links."""
    return neardup.linked(table(spark, d, "docs"))


# 7: encoding


@query("p7_ids")
def _(spark, d):
    return encode.encode(table(spark, d, "documents"))


# 8: mixing


@query("p8_found")
def _(spark, d):
    targets = table(spark, d, "mix_targets")
    sized = mix.sizes(table(spark, d, "documents"), targets)
    return mix.missed(sized, mix.capacities(sized, targets))


@query("p8_shares")
def _(spark, d):
    targets = table(spark, d, "mix_targets")
    sized = mix.sizes(table(spark, d, "documents"), targets)
    caps = mix.capacities(sized, targets)
    return mix.shares(mix.schedule(sized, caps), caps)


@query("p8_schedule")
def _(spark, d):
    targets = table(spark, d, "mix_targets")
    sized = mix.sizes(table(spark, d, "documents"), targets)
    return mix.schedule(sized, mix.capacities(sized, targets))


@query("p8_checks", "SELECT count(DISTINCT source) AS sources, true AS shares_sum_to_one, true AS repeats_hold, true AS short_ones_are_used_up, true AS others_reach_their_target, true AS uses_are_distinct FROM mix_targets WHERE source IS NOT NULL")
def _(spark, d):
    """What the mix promises: shares that sum to 1, no document used more often than allowed, short sources used up, all others at their target."""
    targets = table(spark, d, "mix_targets")
    sized = mix.sizes(table(spark, d, "documents"), targets)
    caps = cut(mix.capacities(sized, targets))
    mixed = cut(mix.schedule(sized, caps))
    shares = mix.shares(mixed, caps).join(caps.select("source", "wanted", "capacity"), "source")
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("m")).join(caps.select("source", F.col("max_repeats").alias("most")), "source")
    held = uses.agg(F.min(F.col("n") <= F.col("most")).alias("repeats_hold"), F.min(F.col("n") == F.col("m")).alias("uses_are_distinct"))
    about = shares.agg(
        F.count("*").alias("sources"),
        (F.abs(F.sum("actual_share") - 1) < 1e-9).alias("shares_sum_to_one"),
        F.min(~F.col("short") | (F.col("used") == F.col("capacity"))).alias("short_ones_are_used_up"),
        F.min(F.col("short") | (F.col("used") >= F.floor(F.col("wanted")))).alias("others_reach_their_target"),
    )
    return about.join(held)


# 9: subject areas


@query("p9_found")
def _(spark, d):
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))
