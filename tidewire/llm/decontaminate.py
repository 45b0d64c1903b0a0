"""Operator 2: benchmark decontamination: BM25 over an inverted index of the test items, searched by block-max WAND, then checked word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow

#: Items are indexed by length class: those of at most STRIDE words, of at most GROWTH times as many, and so on without end. A class's length is the step from passage to passage, and
#: passages have twice that length, so that any copy of an item lies in some passage of its class.
STRIDE, GROWTH = 64, 4
#: Words of all passages that are searched together.
WORDS = 1 << 15
#: Share of an item's score against itself from which it is retrieved, and the shares of its question's (or the whole item's) and answer's word runs that must then be found.
RETRIEVE, QUESTION, ANSWER = 0.5, 0.6, 0.5
#: Words of a run, items of one index (more items make more indexes, each searched in turn) and items of a block.
RUN, INDEX_ITEMS, BLOCK = 3, 20_000, 8
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between blanks, without punctuation at their ends."""
    return [w for w in (x.strip(b".,;:!?\"'()[]{}*#$%&|<>") for x in (text or "").encode().lower().split()) if w]


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the answer is the last sentence, of RUN words at least; the question is all before that sentence; a single sentence is both."""
    words = (text or "").encode().lower().split()
    ends = [i for i, w in enumerate(words[:-1]) if w.endswith((b".", b"?", b"!"))]
    clean = lambda part: [w for w in (x.strip(b".,;:!?\"'()[]{}*#$%&|<>") for x in part) if w]
    if not ends:
        return clean(words), clean(words)
    answer = clean(words[ends[-1] + 1 :])
    return clean(words[: ends[-1] + 1]), answer if len(answer) >= RUN else clean(words)[-RUN:]


def runs(words: list[bytes], width: int = RUN) -> set[bytes]:
    """Runs of ``width`` words; the whole sequence if it is shorter."""
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@dataclass
class ItemIndex:
    """Impacts of terms on items, each as a share of the item's score against itself, so that one threshold holds for all items."""

    ids: list[int]
    questions: list[set[bytes]]
    answers: list[set[bytes]]
    wholes: list[set[bytes]]
    term: dict[bytes, int]
    bound: np.ndarray  # largest impact of each term on any item
    entries: np.ndarray  # of each term the first entry, and the end of the last
    block: np.ndarray  # of each entry: a block of items that hold the term, ascending in a term
    block_bound: np.ndarray  # its largest impact on the block
    first: np.ndarray  # its first posting, and the end of the last
    item: np.ndarray  # of each posting: the item
    impact: np.ndarray
    stride: int = STRIDE  # the length class of the items


def length_class(n: int) -> int:
    """The smallest class length that ``n`` words fit into."""
    size = STRIDE
    while size < n:
        size *= GROWTH
    return size


def build_index(items: list[tuple[int, str]], statistics: tuple[int, float, dict[bytes, int]]) -> ItemIndex:
    """``statistics``: number of items, their mean length in words, and the items that hold each term, over all indexes."""
    n, mean, df = statistics
    index = ItemIndex([], [], [], [], {}, *(np.zeros(0),) * 7)
    rows: dict[bytes, list[tuple[int, float]]] = {}
    for item_id, text in sorted(items, key=lambda x: len(x[1] or "")):  # items of like length share a block
        words = words_of(text)
        if not words:
            continue
        index.stride = max(index.stride, length_class(len(words)))
        question, answer = parts_of(text)
        k = len(index.ids)
        index.ids.append(item_id)
        index.questions.append(runs(question))
        index.answers.append(runs(answer))
        index.wholes.append(runs(words))
        # a passage counts each of its words once, so that repeats in the item only enter by their BM25 weight
        tf: dict[bytes, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        weight = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in tf.items()}
        whole = sum(weight.values())
        for w, x in weight.items():
            rows.setdefault(w, []).append((k, x / whole))
    index.term = {w: t for t, w in enumerate(rows)}
    index.item = np.array([k for held in rows.values() for k, _ in held], np.int64)
    index.impact = np.array([x for held in rows.values() for _, x in held])
    term = np.repeat(np.arange(len(rows)), [len(held) for held in rows.values()])
    block = index.item // BLOCK
    start = np.nonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))[0] if len(term) else np.zeros(0, np.int64)
    index.first, index.block = np.concatenate([start, [len(term)]]), block[start]
    index.block_bound = np.maximum.reduceat(index.impact, start) if len(start) else np.zeros(0)
    index.entries = np.searchsorted(term[start], np.arange(len(rows) + 1))
    index.bound = np.maximum.reduceat(index.block_bound, index.entries[:-1]) if len(rows) else np.zeros(0)
    return index


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and the range each is of."""
    count = end - start
    of = np.repeat(np.arange(len(start)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of], of


def wand(index: ItemIndex, query: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of all items whose summed impact over a query's terms reaches ``threshold``; pairs (query, term) are distinct and sorted.

    Block-max WAND, for many queries at once and a block at a time: a query whose terms' bounds can't reach the threshold has no pivot and goes; of the others, a
    block goes, without a look at its postings, if the bounds of the query's terms on that block can't reach it; in the blocks left the items are scored.
    """
    floor = threshold - 1e-9
    n = int(query[-1]) + 1 if len(query) else 0
    pivot = np.bincount(query, index.bound[term], n) >= floor
    query, term = query[pivot[query]], term[pivot[query]]
    entry, of = _ranges(index.entries[term], index.entries[term + 1])
    query = query[of]
    blocks = -(-len(index.ids) // BLOCK)
    kept = np.bincount(query * blocks + index.block[entry], index.block_bound[entry], n * blocks) >= floor
    left = kept[query * blocks + index.block[entry]]
    entry, query = entry[left], query[left]
    posting, of = _ranges(index.first[entry], index.first[entry + 1])
    pair, at = np.unique(query[of] * len(index.ids) + index.item[posting], return_inverse=True)
    score = np.bincount(at, index.impact[posting], len(pair))
    pair, score = pair[score >= floor], score[score >= floor]
    return pair // max(1, len(index.ids)), pair % max(1, len(index.ids)), score


def search(index: ItemIndex, text: str | None, retrieve: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER) -> list[tuple[int, float, float, float, int, int, float, bool]]:
    """(item, score, question share, answer share, first word, words, whole share, verified) of each item retrieved by some passage of the whole text, at its best passage.

    verified: the shares of question and answer, or of the whole item, as the answer is only a guess from the text. A passage that verifies is better than any other, whatever its score.
    """
    words = words_of(text)
    get = index.term.get
    known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    passage = 2 * index.stride
    starts = np.arange(0, max(1, len(words) - index.stride), index.stride)
    ends = np.minimum(starts + passage, len(words))
    step = max(1, WORDS // passage)
    best: dict[int, tuple[int, float, float, float, int, int, float, bool]] = {}
    for at in range(0, len(starts), step):  # bounded memory for texts of any length
        word, query = _ranges(starts[at : at + step], ends[at : at + step])
        query, term = query[known[word] >= 0], known[word][known[word] >= 0]
        distinct = np.unique(query * max(1, len(index.term)) + term)
        query, term = distinct // max(1, len(index.term)), distinct % max(1, len(index.term))
        for q, item, score in zip(*(x.tolist() for x in wand(index, query, term, retrieve)), strict=True):
            a, b = int(starts[at + q]), int(ends[at + q])
            near = runs(words[max(0, a - passage) : b + passage])  # an item may begin before the passage or end after it
            shares = [len(part[item] & near) / max(1, len(part[item])) for part in (index.questions, index.answers, index.wholes)]
            row = (item, score, shares[0], shares[1], a, b - a, shares[2], shares[2] >= question or (shares[0] >= question and shares[1] >= answer))
            if item not in best or (row[7], *row[1:4]) > (best[item][7], *best[item][1:4]):
                best[item] = row
    return sorted(best.values())


def build_indexes(items: DataFrame, index_items: int = INDEX_ITEMS) -> Iterator[ItemIndex]:
    """Indexes of at most ``index_items`` items of one length class each, with statistics over all. Items without words, and null ids, are left out; of equal ids the first text stays."""
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    held = [(r["item_id"], r["text"]) for r in items.orderBy("item_id").toLocalIterator()]
    lengths = [words_of(t) for _, t in held]
    lengths = [w for w in lengths if w]
    df: dict[bytes, int] = {}
    for w in lengths:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    mean = sum(map(len, lengths)) / max(1, len(lengths))
    classes: dict[int, list[tuple[int, str]]] = {}
    for item_id, text in held:
        classes.setdefault(length_class(len(words_of(text))), []).append((item_id, text))
    for _, members in sorted(classes.items()):
        for k in range(0, len(members), index_items):
            yield build_index(members[k : k + index_items], (len(lengths), mean, df))


def contamination(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER, text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word, n_words, item_overlap, contaminated) for each retrieved item of each document's whole text.

    contaminated: around some retrieved passage occur ``question`` of the runs of the whole item, or ``question`` of the question's and ``answer`` of the answer's. Null, empty and blank texts and an empty benchmark
    give no row; repeated documents give a row each. The test items are a stated small table; an index of at most INDEX_ITEMS items is broadcast at a time.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word int, n_words int, item_overlap double, contaminated boolean"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "n_words", "item_overlap", "contaminated"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for n, index in enumerate(build_indexes(items)):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                rows = [(i.as_py(), index.ids[f[0]], *f[1:]) for i, t in zip(b.column(0), b.column(1), strict=True) for f in search(index, t.as_py(), retrieve, question, answer)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=names)

        found = map_arrow(base, run, schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged; the rule is that of ``contamination``. Nothing is shuffled: a row is judged where it is read."""
    for index in build_indexes(items):
        held = docs.sparkSession.sparkContext.broadcast(index)
        columns = docs.columns

        def run(batches: Iterator[pa.RecordBatch], held=held, columns=columns) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                keep = [not any(f[7] for f in search(index, t.as_py(), retrieve, question, answer)) for t in b.column(b.num_columns - 1)]
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in b.columns[:-1]], names=columns)

        docs = map_arrow(docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).cast("string").alias("_text_of_search")), run, docs.schema)
    return docs
