"""Subject areas of documents by class-association rules.

Rules "words -> subject" are mined from a labelled sample by parallel frequent-pattern growth: item counts first, then for every
item the conditional set of its sentences, each grown in its own group, set by set, to bodies of any length. Bodies end only where
their counts can't make a rule any more or every rule they could make is redundant. Rules that a shorter rule explains as
well are pruned. Every sentence of every document then belongs to the subject for which its matching
rules give the most calibrated evidence; a document is about the subjects that hold at least a quarter of its sentences that
have one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled documents that rules are mined from at most (chosen by hash of their id).
LABELLED = 20_000
#: Documents that must hold a body.
LEAST_DOCS = 2
#: A word is a rule if the lower bound of its best subject's share, or of its best two or three together, reaches these values, with a
#: ratio of the best's odds to its prior odds of at least ODDS and a share of at least CONFIDENCE.
BOUNDS = (0.45, 0.72, 0.82)
CONFIDENCE, ODDS = 0.3, 2.5
#: A longer body must raise the confidence by so much, with this lower bound.
GAIN, LONGER = 0.15, 0.7
#: Standard errors of the lower bounds for single words and for longer bodies, of which very many are tested.
ERRORS, ERRORS_LONGER = 1.0, 2.5
#: Rows of the prior that are mixed into a body's counts (calibration of small counts).
SHRINK = 1.5
#: Log-evidence from which a sentence has a subject.
EVIDENCE = 0.6

#: Two-byte characters that were read as one byte each, and escaped characters.
_BROKEN, _ESCAPED = re.compile("[\u00c2\u00c3][\u0080-\u00bf]"), re.compile(r"\\u([0-9a-fA-F]{4})")
#: Notes in brackets ("[note 3]", "[12]"), at most 80 characters on one line, belong to no sentence.
_BRACKETS = re.compile(r"\[[^\]\n]{0,80}\]")
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?。！？])[\"'’”)\]]*(?:\s+|$)")
#: A line with so many of these characters, and with this share of them besides markup and code spans, is code and has no subject.
_CODE, CODE_MARKS, CODE_SHARE = frozenset("();={}&|*<>"), 4, 0.12
#: Tags, emphasis and rules in text; a run of characters with code marks within it.
_MARKUP, _SPAN = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|\*{2,}|={3,}"), re.compile(r"\S*[^\s();={}&|*<>][();={}&|*<>]+[^\s();={}&|*<>.,:!?]\S*")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def prose(s: str) -> str:
    """A sentence without its markup and code spans; nothing of a line of code."""
    if sum(map(s.count, _CODE)) < CODE_MARKS:
        return s
    s = _SPAN.sub(" ", _MARKUP.sub(" ", s))
    return s if sum(map(s.count, _CODE)) < CODE_SHARE * len("".join(s.split())) else ""


def parts(text: str | None) -> list[str]:
    """The sentences of a text in lower case. Line breaks end sentences, also escaped and marked-up ones; lines of code and code spans are left out."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "\\u" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    text = _BROKEN.sub(lambda m: m[0].encode("latin-1").decode(), text)
    text = text.replace("\\r", "\n").replace("\\n", "\n").replace("<br/>", "\n").replace("<br>", "\n").replace("­", "").replace("​", "")
    found = _BREAK.split(_BRACKETS.sub(" ", text).lower())
    return found if sum(map(text.count, _CODE)) < CODE_MARKS else [prose(s) for s in found if s]


def sentences(text: str | None) -> list[list[str]]:
    """The distinct words of each sentence, hyphenated words whole."""
    return [w for s in parts(text) if (w := list(dict.fromkeys(_WORD.findall(s))))]


@dataclass
class Rules:
    """Log-evidence per subject of single words and of longer bodies (kept under their first word)."""

    prior: dict[str, float]
    single: dict[str, dict[str, float]] = field(default_factory=dict)
    longer: dict[str, list[tuple[frozenset[str], dict[str, float]]]] = field(default_factory=dict)

    def evidence(self, words: list[str]) -> dict[str, float]:
        """Sum over all matching rules, without those whose body is part of a longer matching body. Bodies that share a word share its weight."""
        total: dict[str, float] = {}
        held = set(words)
        matching = [r for w in words for r in self.longer.get(w, ()) if r[0] <= held]
        matching = [r for r in matching if not any(r[0] < other for other, _ in matching)]
        bodies = Counter(w for body, _ in matching for w in body)
        found = [(1.0, self.single[w]) for w in words if w in self.single and w not in bodies]
        for weight, gain in [*found, *((sum(1 / bodies[w] for w in body) / len(body), gain) for body, gain in matching)]:
            for s, x in gain.items():
                total[s] = total.get(s, 0.0) + weight * x
        return total

    def about(self, texts: list[str | None]) -> list[list[str]]:
        """For each text the subjects with at least a quarter of its sentences that have one. A sentence has a subject from EVIDENCE on; sentences
        in doubt follow the rest of the document."""
        names = sorted(self.prior)
        if not names:
            return [[] for _ in texts]
        joint = {w for bodies in self.longer.values() for body, _ in bodies for w in body}
        known = [*self.single, *sorted(joint - self.single.keys())]
        code = {w: i for i, w in enumerate(known)}
        table = np.array([[self.single[w][x] if w in self.single else 0.0 for x in names] for w in known]).reshape(-1, len(names))
        in_joint = {code[w] for w in joint}
        get = code.get
        flat: list[int] = []
        starts, owner, odd = [], [], []
        for i, t in enumerate(texts):
            for s in parts(t):
                held = set(map(get, _WORD.findall(s)))
                held.discard(None)
                if held:
                    if in_joint and not in_joint.isdisjoint(held):
                        odd.append((len(starts), held))
                    starts.append(len(flat))
                    owner.append(i)
                    flat.extend(held)
        if not starts:
            return [[] for _ in texts]
        evidence = np.add.reduceat(table[flat], starts, axis=0)
        for row, held in odd:
            e = self.evidence([known[c] for c in sorted(held)])
            evidence[row] = [e.get(x, 0.0) for x in names]
        top = evidence.max(axis=1)
        told = top >= EVIDENCE
        evidence, owner_ = evidence[told], np.array(owner)[told]
        out: list[list[str]] = [[] for _ in texts]
        if not len(evidence):
            return out
        p = np.array([self.prior[x] for x in names]) * np.exp(evidence - top[told][:, None])
        p /= p.sum(axis=1, keepdims=True)
        first = np.nonzero(np.concatenate(([True], owner_[1:] != owner_[:-1])))[0]
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        mass = np.add.reduceat(p, first, axis=0)
        chosen = (p * (mass[number] - p + 0.25)).argmax(axis=1)
        held = np.zeros((len(first), len(names)), dtype=np.int64)
        np.add.at(held, (number, chosen), 1)
        for d, x in zip(*np.nonzero(4 * held >= held.sum(axis=1, keepdims=True))):
            if held[d, x]:
                out[owner_[first[d]]].append(names[x])
        return out


def gains(counts: dict[str, float], prior: dict[str, float]) -> dict[str, float]:
    """Calibrated log-lift of each subject from a body's counts."""
    n = sum(counts.values())
    return {s: math.log((counts.get(s, 0.0) + SHRINK * p) / (n + SHRINK) / p) for s, p in prior.items()}


def settled(counts: dict[str, float], prior: dict[str, float]) -> tuple[str, float, float]:
    """Best subject by lift, its calibrated confidence and lift."""
    g = gains(counts, prior)
    s = max(sorted(g), key=g.get)
    return s, prior[s] * math.exp(g[s]), math.exp(g[s])


def lower(share: float, n: float, z: float) -> float:
    """Wilson's lower bound of a share among n."""
    if n <= 0:
        return 0.0
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def is_rule(counts: dict[str, float], prior: dict[str, float]) -> bool:
    """Whether the counts tell one subject, or two or three, from all others."""
    n = sum(counts.values())
    top = sorted(counts.values(), reverse=True)
    best = max(sorted(counts), key=counts.get)
    if top[0] < CONFIDENCE * n or top[0] * (1 - prior[best]) < ODDS * prior[best] * (n - top[0]):
        return False
    return any(lower(min(1.0, sum(top[: i + 1]) / n), n, ERRORS) >= b for i, b in enumerate(BOUNDS))


def least_weight() -> float:
    """Weight of one subject below which no longer body can reach the lower bound LONGER, even if it has no other subject."""
    return ERRORS_LONGER**2 * LONGER / (1 - LONGER)


def grow(items: np.ndarray, rows: np.ndarray, n_rows: int, doc: np.ndarray, shares: np.ndarray, prior: np.ndarray, known: np.ndarray, best: np.ndarray) -> list[tuple[list[int], int, np.ndarray]]:
    """(words besides the first, subject, counts) of the rules in a conditional set, whose words (items) stand in n_rows sentences (rows).

    doc: document of a sentence, shares: its subjects, known: confidence of each word that is a rule, best: that of the body so far. A word that
    is in all sentences of a body changes none of its counts, nor of what grows from it, so it is left out; so is one without a subject of
    enough weight. A body is grown while a subject of enough weight can still gain on what its words and parts tell.
    """
    out: list[tuple[list[int], int, np.ndarray]] = []
    least = least_weight()

    def visit(body: list[int], items: np.ndarray, rows: np.ndarray, n_rows: int, best: np.ndarray) -> None:
        # a document once a word
        pairs = np.unique(items.astype(np.int64) * len(shares) + doc[rows])
        word = pairs // len(shares)
        first = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0]
        words, counts = word[first], np.add.reduceat(shares[pairs % len(shares)], first)
        live = (counts.max(1) >= least) & (np.bincount(items, minlength=len(known))[words] < n_rows)
        kept = np.zeros(len(known), dtype=bool)
        kept[words[live]] = True
        inside = kept[items]
        items, rows = items[inside], rows[inside]
        for w, c in zip(words[live], counts[live]):
            n = c.sum()
            confidence = (c + SHRINK * prior) / (n + SHRINK)
            told = np.maximum(best, known[w])
            s = int(c.argmax())
            if confidence[s] >= told[s] + GAIN and lower(c[s] / n, n, ERRORS_LONGER) >= LONGER:
                out.append(([*body, int(w)], s, c))
                told[s] = confidence[s]
            if not ((c >= least) & (told + GAIN <= 1)).any():
                continue
            having = np.zeros(len(doc), dtype=bool)
            having[rows[items == w]] = True
            # only words before w: every body is met once
            on = having[rows] & (items < w)
            if on.any():
                visit([*body, int(w)], items[on], rows[on], int(having.sum()), told)

    if len(items):
        visit([], items, rows, n_rows, best)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, subjects: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, text, subjects): labelled documents, at most about `bound`. Null, unknown and repeated labels don't count."""
    known = subjects.where("subject is not null").select("subject").distinct()
    clean = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").join(known, "subject").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    n = max(1, clean.count())
    some = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(min(1.0, bound / n) * (1 << 20)))
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(some, "doc_id")


def mine(sample: DataFrame) -> Rules:
    """Rules of a labelled sample. Only counts of bodies that occur in LEAST_DOCS documents come to the driver;
    the sample is bounded, so they are."""

    def cut_up(frames):
        for f in frames:
            rows = [(d, w, list(s)) for d, t, s in zip(f["doc_id"], f["text"], f["subjects"]) for w in sentences(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "words", "subjects"])

    sample = sample.persist()
    try:
        weight = 1.0 / F.size("subjects")
        prior_rows = sample.select("doc_id", F.explode("subjects").alias("s"), weight.alias("w")).groupBy("s").agg(F.sum("w").alias("w")).collect()
        whole = sum(r["w"] for r in prior_rows)
        prior = {r["s"]: r["w"] / whole for r in prior_rows}
        rules = Rules(prior)
        if not prior:
            return rules
        transactions = sample.mapInPandas(cut_up, "doc_id long, words array<string>, subjects array<string>").persist()
        # item counts, a document once
        per_doc = transactions.select("doc_id", "subjects", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.first("subjects").alias("subjects"))
        items = per_doc.select("word", F.explode("subjects").alias("s"), weight.alias("w")).groupBy("word", "s").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        counts: dict[str, dict[str, float]] = defaultdict(dict)
        docs: Counter[str] = Counter()
        for r in items.collect():
            counts[r["word"]][r["s"]] = r["w"]
            docs[r["word"]] += r["n"]
        frequent = {w: c for w, c in counts.items() if docs[w] >= LEAST_DOCS}
        single = {w: c for w, c in frequent.items() if is_rule(c, prior)}
        rules.single = {w: gains(c, prior) for w, c in single.items()}
        # growth; a word is part of a longer rule only if a subject of enough weight can still gain on what the word tells by itself
        names = sorted(prior)
        share = np.array([prior[x] for x in names])
        weights = {w: np.array([c.get(x, 0.0) for x in names]) for w, c in frequent.items()}
        told = {w: (c + SHRINK * share) / (c.sum() + SHRINK) if w in single else np.zeros(len(names)) for w, c in weights.items()}
        open_ = sorted((w for w, c in weights.items() if ((c >= least_weight()) & (told[w] + GAIN <= 1)).any()), key=lambda w: (-docs[w], w))
        if open_:
            code, number = {w: i for i, w in enumerate(open_)}, {x: i for i, x in enumerate(names)}
            known = np.stack([told[w] for w in open_])

            def conditional(batches):
                """Each word with the more frequent ones of its sentence."""
                for b in batches:
                    item, doc, before, of = [], [], [], []
                    for d, words, subjects in zip(b["doc_id"].to_pylist(), b["words"].to_pylist(), b["subjects"].to_pylist()):
                        held = sorted(code[w] for w in words if w in code)
                        item += held
                        doc += [d] * len(held)
                        before += [held[:i] for i in range(len(held))]
                        of += [[number[x] for x in subjects]] * len(held)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(before, pa.list_(pa.int32())), pa.array(of, pa.list_(pa.int32()))], ["item", "doc_id", "before", "of"])

            def grown(t: pa.Table) -> pa.Table:
                flat = lambda c: (c.flatten().to_numpy(), c.value_lengths().to_numpy())
                t = t.combine_chunks()
                column = lambda name: t[name].chunk(0)
                ids, doc = np.unique(column("doc_id").to_numpy(), return_inverse=True)
                before, n_before = flat(column("before"))
                of, n_of = flat(column("of"))
                shares = np.zeros((len(ids), len(names)))
                shares[np.repeat(doc, n_of), of] = np.repeat(1 / n_of, n_of)
                item = column("item")[0].as_py()
                found = grow(before.astype(np.int64), np.repeat(np.arange(len(doc)), n_before), len(doc), doc, shares, share, known, known[item])
                columns = list(zip(*found)) or [(), (), ()]
                bodies = pa.array([[item, *more] for more in columns[0]], pa.list_(pa.int32()))
                return pa.table({"body": bodies, "subject": pa.array(columns[1], pa.int32()), "held": pa.array([c.tolist() for c in columns[2]], pa.list_(pa.float64()))})

            sets = transactions.mapInArrow(conditional, "item int, doc_id long, before array<int>, of array<int>")
            mined = sets.groupBy("item").applyInArrow(grown, "body array<int>, subject int, held array<double>").collect()
            kept: dict[str, list[tuple[frozenset[str], int, float]]] = defaultdict(list)
            for r in sorted(mined, key=lambda r: (len(r["body"]), r["body"])):
                body, c, s = frozenset(open_[w] for w in r["body"]), np.array(r["held"]), r["subject"]
                confidence = (c[s] + SHRINK * share[s]) / (c.sum() + SHRINK)
                if any(t == s and part < body and x > confidence - GAIN for w in body for part, t, x in kept[w]):
                    continue
                kept[min(body)].append((body, s, confidence))
                rules.longer.setdefault(min(body), []).append((body, gains(dict(zip(names, r["held"])), prior)))
        transactions.unpersist()
        return rules
    finally:
        sample.unpersist()


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, bound: int = LABELLED) -> Rules:
    return mine(labelled_sample(docs, labels, subjects, bound))


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, subject): one row for each subject a document is about; none for null, blank and general texts. Without usable labels no rows."""
    rules = fit(docs, labels, subjects, bound)
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def score(batches):
        for b in batches:
            found = shared.value.about(b["text"].to_pylist())
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows)), pa.array([s for x in found for s in x], pa.string())], ["doc_id", "subject"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, subject string")
