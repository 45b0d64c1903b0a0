"""Operator 4: a log-bilinear neural language model, trained in numpy by noise-contrastive estimation on counts over the whole training corpus."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import batch_of, map_arrow, stored

#: Frequent words that each task looks up by itself; the counts of all other words reach their tokens by a join.
HEAD = 1 << 18
#: Different words whose counts a task holds before it hands them on.
WORDS_HELD = 300_000
#: Output classes: words that are a class of their own (the end is one), and classes of spellings for all other words.
OWN, SPELLINGS = 1024, 1024
#: Contexts: classes of the word before (frequent words, spellings) and of the one before that.
NEAR_WORDS, NEAR_SPELLINGS, FAR = 128, 128, 8
#: Size of the vectors, noise words for each word, passes over the counts, contexts of a step, its rate.
SIZE, NOISE, PASSES, STEP, RATE = 48, 10, 24, 128, 0.03


def tokens(text: str | None) -> list[bytes]:
    """Words between blanks, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def spelling(word: bytes) -> int:
    """Class of the spelling: of the first two and the last two bytes."""
    return zlib.crc32(word[:2] + word[-2:]) % SPELLINGS


@dataclass
class Lexicon:
    """What the tasks know of words: the end is number 0, then the head by falling count."""

    number: dict[bytes, int]
    count: np.ndarray  # of each number
    out: np.ndarray  # output class of each number
    near: np.ndarray  # near class of each output class
    far: np.ndarray  # far class of each output class
    total: int  # training tokens
    distinct: int

    def classes(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of the texts' tokens, ends included, one text after the other: numbers (-1: not in the head), output classes, contexts; and the words not in the head."""
        flat = [x for w in words for x in (*w, b"")]
        get = self.number.get
        number = np.fromiter((get(x, -1) for x in flat), np.int64, len(flat))
        out = self.out[number]
        strange = np.nonzero(number < 0)[0]
        ends = np.cumsum([len(w) + 1 for w in words]) if words else np.zeros(0, np.int64)
        tail = [flat[i] for i in strange.tolist()]
        memo: dict[bytes, int] = {}
        out[strange] = [memo[x] if x in memo else memo.setdefault(x, OWN + spelling(x)) for x in tail]
        before = np.concatenate([[0], out[:-1]])  # the token before a text's first is the end of the one before it
        second = np.concatenate([[0], before[:-1]])
        starts = ends[:-1]
        second[starts] = 0  # two tokens before a text's first there is an end, too
        return number, out, self.near[before] * FAR + self.far[second], tail


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, class, rank key) over all training texts: exact counts of every word, and of the end as the empty word."""

    def rows(found: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(found.keys()), list(found.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                found.update(tokens(t.as_py()))
            found[b""] += b.num_rows
            if len(found) > WORDS_HELD:
                yield from rows(found)
                found = Counter()
        yield from rows(found)

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def build_lexicon(words: DataFrame) -> Lexicon:
    """``words`` (word, c). HEAD words come to the driver, whatever the corpus."""
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the head: counts from a bound on, found in a histogram by powers of 2 ** (1/16), so that HEAD words at most are ever sent
    level = F.floor(F.log2("c") * 16)
    held, bound = 0, None
    for r in words.where("word <> X''").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > HEAD:
            break
        bound = r["level"]
    top = words.where("word <> X''").where(level >= bound if bound is not None else F.lit(False)).toArrow()
    order = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    heads, counts = [w for _, w in order], np.array([c for c, _ in order], np.int64)
    end = words.where("word = X''").collect()
    number = {b"": 0} | {w: i + 1 for i, w in enumerate(heads)}
    shape = np.array([0, *(spelling(w) for w in heads)], np.int64)
    out = np.where(np.arange(len(shape)) < OWN, np.arange(len(shape)), OWN + shape)
    own = np.zeros(OWN, np.int64)
    own[: min(OWN, len(shape))] = shape[:OWN]
    shapes = np.concatenate([own, np.arange(SPELLINGS)])
    near = np.where(np.arange(OWN + SPELLINGS) < NEAR_WORDS, np.arange(OWN + SPELLINGS), NEAR_WORDS + shapes % NEAR_SPELLINGS)
    return Lexicon(number, np.concatenate([[end[0]["c"] if end else 0], counts]).astype(np.int64), out, near, shapes // NEAR_SPELLINGS % FAR, total, distinct)


def count_contexts(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Matrix (contexts x output classes) of counts over all training tokens. Its size is fixed by the parameters, not by the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    width = OWN + SPELLINGS
    height = (NEAR_WORDS + NEAR_SPELLINGS) * FAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(height * width, np.int32)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                _, out, context, _ = held.value.classes([tokens(t) for t in b.column(0).slice(at, 512).to_pylist()])
                np.add.at(sums, context * width + out, 1)
        cells = np.nonzero(sums)[0]
        for at in range(0, len(cells), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + 100_000], pa.int32()), pa.array(sums[cells[at : at + 100_000]], pa.int64())], names=["cell", "n"])

    found = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(height * width)
    got = found.toArrow()
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(height, width)


def train(counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Log probabilities (contexts x output classes) of the log-bilinear model that noise-contrastive estimation fits to ``counts``.

    The predicted vector is the sum of a position's matrix times the vector of the class there; its product with a class's vector, plus the class's bias, is
    the score. Words count against NOISE words drawn by frequency; the expectation over the draws is taken exactly. Steps are batches of contexts, with
    Adam. At the end the scores are normalised over all classes, in batches of matrix products.
    """
    rng = np.random.default_rng(seed)
    height, width = counts.shape
    total = max(1.0, counts.sum())
    noise = (counts.sum(0) + 0.5) / (total + 0.5 * width)
    offset = np.log(NOISE * noise).astype(np.float32)
    near, far = np.arange(height) // FAR, np.arange(height) % FAR
    p = {
        "near": rng.normal(0, 0.1, (NEAR_WORDS + NEAR_SPELLINGS, SIZE)), "far": rng.normal(0, 0.1, (FAR, SIZE)), "c1": np.eye(SIZE), "c2": np.eye(SIZE),
        "q": rng.normal(0, 0.1, (width, SIZE)), "b": np.log(noise),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    live = np.nonzero(counts.sum(1))[0]
    step = 0
    for done in range(PASSES):
        rate = RATE * (1 - done / PASSES) + 0.001
        order = rng.permutation(live)
        for at in range(0, len(order), STEP):
            rows = order[at : at + STEP]
            n = counts[rows].astype(np.float32)
            n_row = n.sum(1, keepdims=True)
            scale = 1 / max(1.0, float(n_row.sum()))
            a, c = p["near"][near[rows]], p["far"][far[rows]]
            r = a @ p["c1"].T + c @ p["c2"].T
            s = 1 / (1 + np.exp(-np.clip(r @ p["q"].T + p["b"] - offset, -30, 30)))
            g = (n * (1 - s) - NOISE * n_row * noise.astype(np.float32) * s) * scale
            dr = g @ p["q"]
            grad = {"q": g.T @ r, "b": g.sum(0), "c1": dr.T @ a, "c2": dr.T @ c, "near": np.zeros_like(p["near"]), "far": np.zeros_like(p["far"])}
            np.add.at(grad["near"], near[rows], dr @ p["c1"])
            np.add.at(grad["far"], far[rows], dr @ p["c2"])
            step += 1
            for k, x in grad.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.001 * (x * x - v[k])
                p[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    out = np.zeros((height, width), np.float32)
    for at in range(0, height, 256):
        rows = np.arange(at, min(at + 256, height))
        s = (p["near"][near[rows]] @ p["c1"].T + p["far"][far[rows]] @ p["c2"].T) @ p["q"].T + p["b"]
        top = s.max(1, keepdims=True)
        out[rows] = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
    return out


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))])


def score(docs: DataFrame, training: DataFrame, label: str = "language-model") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``, learned from the texts of ``training``.

    P(token) is P(class | two tokens before) of the neural model times P(word | class): its share of the class's training tokens, after the class has given the share of its
    words that were seen once to the event "a word never seen". Scores are log10 sums over the whole text and its end. A null or empty text is the end alone.
    Words, contexts and classes are counted over all training texts. Words outside the head are joined with their counts; a word that frequent that it
    could be skewed is in the head. Repeated rows and null ids are scored row by row.
    """
    sc = docs.sparkSession.sparkContext
    words = stored(count_words(training), f"{label}-words")
    lexicon = build_lexicon(words)
    log_p = train(count_contexts(training, lexicon)) / np.float32(np.log(10))
    known = lexicon.number

    # shares of the classes of spellings: tokens, and words seen once
    head_class = lexicon.out
    own = F.broadcast(docs.sparkSession.createDataFrame([(w, 1) for w, i in known.items() if i < OWN], "word binary, _own int"))
    shape = F.lit(OWN) + F.pmod(F.crc32(F.concat(F.substring("word", 1, 2), F.substring(F.col("word"), F.greatest(F.octet_length("word") - 1, F.lit(1)), F.lit(2)))), F.lit(SPELLINGS))
    classed = words.where("word <> X''").join(own, "word", "left_anti").withColumn("class", shape.cast("int"))
    stats = classed.groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()  # SPELLINGS rows at most
    mass, unseen = np.zeros(OWN + SPELLINGS), np.ones(OWN + SPELLINGS)
    for r in stats:
        mass[r["class"]], unseen[r["class"]] = r["n"], min(0.9, (r["once"] + 0.5) / (r["n"] + 1))
    denominator = lexicon.total + 0.5 * (lexicon.distinct + 1)
    inside = np.zeros(len(head_class))  # log10 P(word | class) of the head
    shared = np.arange(len(head_class)) >= OWN
    k = head_class[shared]
    inside[shared] = np.log10((1 - unseen[k]) * lexicon.count[shared] / np.maximum(mass[k], 1))
    base = np.log10((lexicon.count + 0.5) / denominator)
    held = sc.broadcast((lexicon, log_p, inside, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, log_p, inside, base = held.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [tokens(t) for t in part.column(2).to_pylist()]
                number, out, context, tail = lexicon.classes(texts)
                head = number >= 0
                lengths = np.array([len(w) + 1 for w in texts], np.int64)
                starts = np.cumsum(lengths) - lengths
                s = log_p[context, out].astype(np.float64) + np.where(head, inside[number], 0)
                strange = np.add.reduceat((~head).astype(np.int64), starts)
                ends = np.concatenate([[0], np.cumsum(strange)]).tolist()
                words, times, cuts = [], [], [0]  # distinct words of each text and how often they occur
                for a, e in zip(ends, ends[1:]):
                    found = Counter(tail[a:e])
                    words += found.keys()
                    times += found.values()
                    cuts.append(len(words))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "k"]))
                met = np.add.reduceat((head & (lexicon.count[number] > 0)).astype(np.int64), starts)
                yield batch_of(_SCORED, part.column(0), part.column(1), lengths, met, np.add.reduceat(np.where(head, base[number], 0), starts), np.add.reduceat(s, starts), lists)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = stored(map_arrow(rows, run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,k:bigint>>"), f"{label}-scored")
    per_class = F.broadcast(docs.sparkSession.createDataFrame([(i, float(mass[i]), float(unseen[i])) for i in range(OWN, OWN + SPELLINGS)], "class int, _mass double, _unseen double"))
    tail = scored.select("row", F.inline("tail"))
    met = tail.join(words, "word", "left").withColumn("class", shape.cast("int")).join(per_class, "class")
    c = F.col("c")
    share = F.when(c.isNull(), F.log10("_unseen")).otherwise(F.log10((1 - F.col("_unseen")) * c / F.col("_mass")))
    sums = met.groupBy("row").agg(
        F.sum(F.when(c.isNotNull(), F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * F.log10((F.coalesce(c, F.lit(0)) + 0.5) / denominator)).alias("_base"), F.sum(F.col("k") * share).alias("_score")
    )
    joined = scored.drop("tail").join(sums, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select("doc_id", "n_tokens", add("n_known", "_known").alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), add("base", "_base").alias("base_score"), add("score", "_score").alias("score"))
