"""Operator 9: toxicity by the nearest labelled examples under TF-IDF cosine, found exactly in a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import about, map_arrow

#: Labelled rows that are learned from, about (those whose id has a small hash); the examples of the index are among them.
EXAMPLES = 20_000
#: Terms of the index, at most: those whose presence tells most about the label: a significance that chance doesn't reach,
#: and a share of toxic documents among those with the term of so many times the share among all.
TERMS, SIGNIFICANT, LIFT = 256, 45.0, 3.0
NEAREST = 15
BLOCK = 64

_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the stems that are terms besides the whole words (a stem ends in a star), and the counts from which a term is another one, too ("x@4").
STEMS, LEVELS = (4, 5, 6, 7), (2, 4, 8, 16)


def _levels(counts: Counter) -> dict[str, int]:
    """The terms that occur, and those terms at the levels that their counts reach."""
    return counts | {f"{t}@{k}": n for t, n in counts.items() if n > 1 for k in LEVELS if n >= k}


def all_terms(text: str | None) -> dict[str, int]:
    """Words (runs of letters) and stems of the whole lower-cased text, with levels."""
    words = Counter(_WORD.findall((text or "").lower()))
    found = words.copy()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                found[w[:k] + "*"] += n
    return _levels(found)


def _alike(a: str, b: str) -> bool:
    """Whether one is a stem of the other."""
    return (a.endswith("*") and b.startswith(a[:-1])) or (b.endswith("*") and a.startswith(b[:-1]))


class Vocabulary:
    """Counts the occurrences of given words and stems in a text."""

    def __init__(self, terms) -> None:
        self.terms = set(terms)
        bare = {t.partition("@")[0] for t in terms}
        self.words = {t for t in bare if not t.endswith("*")}
        self.stems = [(k, {t[:-1] for t in bare if t.endswith("*") and len(t) == k + 1}) for k in STEMS]

    def counts(self, text: str | None) -> dict[str, int]:
        words = _WORD.findall((text or "").lower())
        found = Counter(w for w in words if w in self.words)
        for k, stems in self.stems:
            if stems:
                found.update(w[:k] + "*" for w in words if w[:k] in stems and len(w) > k)
        return {t: n for t, n in _levels(found).items() if t in self.terms}


@dataclass
class Index:
    """Examples as rows of unit length over the chosen terms, dealt to blocks of BLOCK rows; equal examples are one row with counts."""

    terms: dict[str, int]
    idf: np.ndarray
    weights: np.ndarray  # terms x rows
    block_max: np.ndarray  # terms x blocks
    positive: np.ndarray  # of each row: toxic examples
    total: np.ndarray  # of each row: examples
    ids: list[list[int]]  # of each row: some ids, as evidence
    prior: float  # share of toxic examples
    calibration: np.ndarray  # slope and offset of the logistic curve over the vote's log odds
    bare: float  # score of a text without any of the terms

    def vector(self, counts: Counter | dict) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit weights of the terms that occur."""
        found = sorted((self.terms[t], n) for t, n in counts.items() if t in self.terms)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        t, n = np.array(found, np.int64).T
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k nearest examples and their cosines, exactly; examples count, not rows. ``skip``: a row with one example less.

        A block's bound is the sum over the terms of the query's weight times the block's largest. Blocks are opened by falling bound and no more
        once k examples are found whose cosine no bound exceeds. Ties go to the row with the lower number.
        """
        bounds = w @ self.block_max[t]
        order = np.argsort(-bounds, kind="stable")
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        limit = 0.0
        for b in order:
            if bounds[b] <= 0 or bounds[b] < limit - 1e-12:
                break
            at = slice(b * BLOCK, min((b + 1) * BLOCK, len(self.total)))
            c = w @ self.weights[t, at]
            keep = c > max(0.0, limit - 1e-12)
            rows, cosines = np.concatenate([rows, np.arange(at.start, at.stop)[keep]]), np.concatenate([cosines, c[keep]])
            best = np.lexsort((rows, -np.round(cosines, 12)))
            rows, cosines = rows[best], cosines[best]
            reached = np.cumsum(self.total[rows] - (rows == skip)) >= k
            if reached.any():
                end = int(np.argmax(reached)) + 1
                rows, cosines, limit = rows[:end], cosines[:end], cosines[end - 1]
        return rows, cosines

    def vote(self, rows: np.ndarray, cosines: np.ndarray, skip: int = -1, skip_label: int = 0) -> float:
        """Log odds of the labels of the nearest, each weighted by its squared cosine; the prior counts as one example."""
        n, p = self.total[rows].astype(float), self.positive[rows].astype(float)
        if skip >= 0:
            n, p = n - (rows == skip), p - skip_label * (rows == skip)
        w = cosines**2
        yes, no = (w * p).sum() + self.prior, (w * (n - p)).sum() + 1 - self.prior
        return float(np.log(yes) - np.log(no))

    def score(self, counts: Counter | dict) -> tuple[float, np.ndarray, np.ndarray]:
        """Calibrated chance that the label is 1; rows and cosines of the nearest examples."""
        t, w = self.vector(counts)
        if not len(t):
            return self.bare, np.zeros(0, np.int64), np.zeros(0)
        rows, cosines = self.nearest(t, w)
        a, b = self.calibration
        return float(1 / (1 + np.exp(-(a * self.vote(rows, cosines) + b)))), rows, cosines


def build_index(examples: list[tuple[int, Counter, int]], idf: dict[str, float]) -> Index:
    """The index of (id, counts of the chosen terms, label) and its calibration, by leave-one-out votes of the examples themselves."""
    terms = {t: i for i, t in enumerate(sorted(idf))}
    prior = (sum(y for *_, y in examples) + 0.5) / (len(examples) + 1)
    index = Index(terms, np.array([idf[t] for t in sorted(idf)]), *(np.zeros((len(terms), 0)),) * 2, np.zeros(0), np.zeros(0), [], prior, np.array([1.0, 0.0]), prior)
    rows: dict[tuple, list] = {}
    bare = [0, 0]
    for i, counts, y in examples:
        t, w = index.vector(counts)
        if not len(t):
            bare[0] += y
            bare[1] += 1
            continue
        held = rows.setdefault((tuple(t), tuple(np.round(w, 9))), [0, 0, []])
        held[0] += y
        held[1] += 1
        held[2] = [*held[2], i][:4]
    index.bare = (bare[0] + prior) / (bare[1] + 1)
    keys = sorted(rows)  # like examples come into one block, so that bounds are tight
    index.weights = np.zeros((len(terms), len(keys)))
    for r, (t, w) in enumerate(keys):
        index.weights[list(t), r] = w
    starts = np.arange(0, len(keys), BLOCK)
    index.block_max = np.maximum.reduceat(index.weights, starts, axis=1) if len(keys) else np.zeros((len(terms), 0))
    index.positive, index.total, index.ids = np.array([rows[k][0] for k in keys], int), np.array([rows[k][1] for k in keys], int), [rows[k][2] for k in keys]
    votes, labels, sizes = [], [], []
    for r, key in enumerate(keys):
        for y, n in ((1, rows[key][0]), (0, rows[key][1] - rows[key][0])):
            if n:
                near = index.nearest(np.array(key[0]), np.array(key[1]), skip=r)
                votes.append(index.vote(*near, skip=r, skip_label=y))
                labels.append(y)
                sizes.append(n)
    index.calibration = _logistic(np.array(votes), np.array(labels, float), np.array(sizes, float))
    return index


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slope and offset by Newton steps on the weighted log likelihood with a weak pull to (1, 0)."""
    at = np.array([1.0, 0.0])
    if not len(x):
        return at
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        grad = design.T @ (n * (y - p)) - (at - [1.0, 0.0])
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2), grad)
        at = at + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return np.array([max(at[0], 0.05), at[1]])


def learn(docs: DataFrame, labels: DataFrame, max_examples: int = EXAMPLES, max_terms: int = TERMS, significant: float = SIGNIFICANT) -> Index:
    """The index from the labelled rows given (the caller leaves out what is held out).

    Terms are those most dependent on the label (chi-squared of presence, ``significant`` at least), so that the cosine isn't ruled by words that
    two texts share by chance. Document frequencies and labels are of the examples. What comes to the driver is bounded by ``max_examples`` and ``max_terms``.
    Null ids, null labels and labels without a document are left out; of repeated labels of an id the largest counts, of repeated documents the first text.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    chosen = F.broadcast(about(labels, "_id", max_examples))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(chosen, "_id").groupBy("_id").agg(F.min("_toxic").alias("_toxic"), F.min("_text").alias("_text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[int(y == 1)].update(all_terms(text.as_py()))
                seen[int(y == 1)][""] += 1  # documents; no term is empty
            both = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array([seen[1][t] for t in both], pa.int64()), pa.array([seen[0][t] for t in both], pa.int64())], ["term", "yes", "no"])

    counts = map_arrow(rows.select("_toxic", "_text"), words, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    total = counts.where("term = ''").collect()
    n_yes, n_no = (total[0]["yes"], total[0]["no"]) if total else (0, 0)
    n = n_yes + n_no
    a, b = F.col("yes"), F.col("no")
    chi = F.try_divide(F.lit(float(n)) * F.pow(a * F.lit(float(n_no)) - b * F.lit(float(n_yes)), F.lit(2.0)), (a + b).cast("double") * (F.lit(float(n)) - a - b) * F.lit(float(n_yes)) * F.lit(float(n_no)))
    top = counts.where("term <> ''").withColumn("chi", chi).where((F.col("chi") >= significant) & (a * F.lit(float(n)) >= (a + b) * F.lit(LIFT * n_yes))).orderBy(F.desc("chi"), F.desc(F.length("term")), "term").limit(16 * max_terms).collect()
    best: dict[str, float] = {}
    for r in top:  # of words and stems that begin alike, the most telling one, with its levels
        term, _, level = r["term"].partition("@")
        if len(best) < max_terms and (term in {t.partition("@")[0] for t in best} or not any(_alike(term, t.partition("@")[0]) for t in best)):
            best[r["term"]] = float(np.log((n + 1) / (r["yes"] + r["no"] + 0.5)))
    idf = best

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(idf)
        for b in batches:
            held = [sorted(vocabulary.counts(text.as_py()).items()) for text in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[t for t, _ in h] for h in held], pa.list_(pa.string())), pa.array([[n for _, n in h] for h in held], pa.list_(pa.int64()))], ["id", "toxic", "terms", "counts"])

    examples = map_arrow(rows.select(F.col("_id").cast("long").alias("id"), F.col("_toxic").alias("toxic"), "_text"), picked, "id long, toxic int, terms array<string>, counts array<long>")
    got = sorted((r["id"], r["toxic"], r["terms"], r["counts"]) for r in examples.toLocalIterator())
    return build_index([(i, Counter(dict(zip(t, c, strict=True))), int(y == 1)) for i, y, t, c in got], idf)


def score(docs: DataFrame, index: Index, columns: list[str] | None = None, text: str = "text", below: float | None = None) -> DataFrame:
    """``columns`` (default: all), score, evidence (ids of nearest examples) and matched (their terms in the text), or with ``below`` only the rows of a lower score and only ``columns``.

    A null or empty text, or one without any term of the index, has the score that such examples have. The index is bounded by EXAMPLES rows and TERMS terms.
    """
    columns = docs.columns if columns is None else columns
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.select(columns).schema
    out = schema if below is not None else f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, score double, evidence array<long>, matched array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        vocabulary = Vocabulary(index.terms)
        for b in batches:
            found = []
            for x in b.column(b.num_columns - 1):
                counts = vocabulary.counts(x.as_py())
                s, rows, _ = index.score(counts)
                found.append((s, [i for r in rows[:5] for i in index.ids[r][:1]], sorted(counts)))
            kept = b.columns[:-1]
            if below is not None:
                mask = pa.array([s < below for s, *_ in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in kept], names=columns)
            else:
                yield pa.RecordBatch.from_arrays([*kept, pa.array([s for s, *_ in found], pa.float64()), pa.array([e for _, e, _ in found], pa.list_(pa.int64())), pa.array([m for *_, m in found], pa.list_(pa.string()))], names=[*columns, "score", "evidence", "matched"])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).cast("string").alias("_text_of_score")), run, out)
