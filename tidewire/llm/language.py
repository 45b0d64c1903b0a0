"""Operator 5: language by hyperdimensional profiles: letters bound into trigrams, trigrams bundled, documents compared with prototypes by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a vector; letters of a text that are worked on together; trigrams that are multiplied together.
DIMENSIONS, CHUNK, SLICE = 1024, 1 << 20, 1 << 14
#: Letters whose vectors are kept from batch to batch, and kinds of trigrams whose counts are kept in learning; beyond that they are computed again.
KEPT, KINDS = 8192, 1 << 18
SEED = 7
_MASK = (1 << 21) - 1


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # languages x DIMENSIONS, of unit length


def letter_vector(c: str) -> np.ndarray:
    """The vector of a letter, 1 and -1, from hashes of its code point; every code point has its own."""
    point = ord(c).to_bytes(4, "little")
    bits = np.array([xxhash.xxh64_intdigest(point, SEED + k) for k in range(DIMENSIONS // 64)], np.uint64)
    return np.unpackbits(bits.view(np.uint8)).astype(np.int8) * np.int8(2) - np.int8(1)


class Coder:
    """Trigrams of letters and their vectors. Letters are numbered as they are met; number 0 is the gap between words; a trigram of three gaps doesn't occur."""

    def __init__(self, letters: str = ""):
        self.letters = letters
        self.forget()

    def forget(self) -> None:
        """Only the first letters have numbers; trigrams found before have no meaning any more."""
        self.classes = np.zeros(0x110000, np.int32)
        self.own: dict[str, int] = {}
        self.known = np.zeros(0x110000, bool)  # code points that have been looked up
        base = letter_vector("\0")[None]
        # the first letter's vector is permuted twice, the second's once: the order of the letters counts
        self.at = [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]
        self.add(self.letters)

    def add(self, letters: str) -> None:
        for c in letters:
            self.own[c] = self.classes[ord(c)] = len(self.own) + 1
            self.known[ord(c)] = True
        if letters:
            base = np.stack([letter_vector(c) for c in letters])
            self.at = [np.concatenate([old, np.roll(base, k, axis=1)]) for old, k in zip(self.at, (2, 1, 0), strict=True)]

    def vectors(self, trigrams: np.ndarray) -> np.ndarray:
        """Bound vectors: the product of the three letters' permuted ones."""
        return self.at[0][trigrams >> 42] * self.at[1][trigrams >> 21 & _MASK] * self.at[2][trigrams & _MASK]

    def trigrams(self, text: str) -> np.ndarray:
        """The trigrams of a text, lower-cased, with a gap at both ends and one gap for any run of other characters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        fresh = points[~self.known[points]]
        if len(fresh):
            new = np.unique(fresh)
            self.add("".join(c for c in map(chr, new.tolist()) if c.isalpha()))
            self.known[new] = True
        x = np.concatenate([[0], self.classes[points], [0]])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])].astype(np.int64)
        return x[:-2] << 42 | x[1:-1] << 21 | x[2:] if len(x) > 2 else np.zeros(0, np.int64)

    def kinds(self, trigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams, ascending, and the place of each trigram among them; without a sort while letters are few."""
        n = len(self.own) + 1
        if n > 128:
            return np.unique(trigrams, return_inverse=True)
        small = ((trigrams >> 42) * n + (trigrams >> 21 & _MASK)) * n + (trigrams & _MASK)
        held = np.bincount(small, minlength=1) > 0
        k = np.nonzero(held)[0]
        return k // (n * n) << 42 | k // n % n << 21 | k % n, (np.cumsum(held) - 1)[small]

    def of_text(self, text: str | None) -> Iterator[np.ndarray]:
        """The trigrams of a whole text, part by part; the two letters before a part go with it, so that no trigram is lost."""
        for at in range(0, len(text or ""), CHUNK):
            yield self.trigrams(text[at : at + CHUNK] if at == 0 else text[at - 2 : at + CHUNK])

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The sum of the vectors of all trigrams of each whole text, a row each; zero for a text without a letter.

        Counts of the trigrams that occur in the texts, times their vectors, is one matrix product for many texts and a slice of the trigrams.
        """
        if len(self.own) > KEPT:
            self.forget()
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        rows, found = [], []
        for i, t in enumerate(texts):
            for x in self.of_text(t):
                rows.append(np.full(len(x), i, np.int64))
                found.append(x)
        if not found:
            return out
        row, tri = np.concatenate(rows), np.concatenate(found)
        for at in range(0, len(texts), 256):
            a, b = np.searchsorted(row, [at, at + 256])
            m = min(256, len(texts) - at)
            kinds, number = self.kinds(tri[a:b])
            for lo in range(0, len(kinds), SLICE):
                width = min(SLICE, len(kinds) - lo)
                inside = slice(None) if width == len(kinds) else (number >= lo) & (number < lo + width)
                counts = np.bincount((row[a:b][inside] - at) * width + number[inside] - lo, minlength=m * width).reshape(m, -1).astype(np.float32)
                out[at : at + m] += counts @ self.vectors(kinds[lo : lo + width]).astype(np.float32)
        return out


class _Sums:
    """Counts of the trigrams of one language, and the sum of the vectors of those that are no longer counted."""

    def __init__(self):
        self.kinds, self.counts, self.parts, self.waiting, self.sum = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, np.zeros(DIMENSIONS)

    def add(self, coder: Coder, trigrams: np.ndarray) -> None:
        self.parts.append(trigrams)
        self.waiting += len(trigrams)
        if self.waiting >= CHUNK:
            self.count(coder)
            if len(self.kinds) > KINDS:
                self.bundle(coder)

    def count(self, coder: Coder) -> None:
        if self.parts:
            kinds, number = coder.kinds(np.concatenate(self.parts))
            counts = np.bincount(number, minlength=len(kinds))
            self.kinds, at = np.unique(np.concatenate([self.kinds, kinds]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(self.kinds)).astype(np.int64)
            self.parts, self.waiting = [], 0

    def bundle(self, coder: Coder) -> np.ndarray:
        self.count(coder)
        for at in range(0, len(self.kinds), 4096):
            self.sum += self.counts[at : at + 4096].astype(np.float64) @ coder.vectors(self.kinds[at : at + 4096]).astype(np.float64)
        self.kinds, self.counts = self.kinds[:0], self.counts[:0]
        return self.sum


def learn(docs: DataFrame) -> Profiles:
    """Profiles of the languages of ``docs`` (text, lang), which the caller has cleared of what is held out.

    Every training text counts with its whole length, and every letter with its own vector. What comes to the driver is bounded by languages x DIMENSIONS numbers.
    Rows with a null text or language are left out.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = Coder(), {}
        for b in batches:
            # trigram counts are summed first: bundling is linear
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for x in coder.of_text(t.as_py()):
                    total.setdefault(lang, _Sums()).add(coder, x)
            if len(coder.own) > KEPT:
                for held in total.values():
                    held.bundle(coder)
                coder.forget()
        for lang, held in total.items():
            v = held.bundle(coder)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(v.astype(np.int64))], names=["lang", "d", "v"])

    found = known.mapInArrow(sums, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).collect()
    languages = sorted({r["lang"] for r in found})
    at = {x: i for i, x in enumerate(languages)}
    prototypes = np.zeros((len(languages), DIMENSIONS))
    for r in found:
        prototypes[at[r["lang"]], r["d"]] = r["v"]
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return Profiles(languages, prototypes.astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, columns: list[str], text: str = "text") -> DataFrame:
    """``columns``, lang_pred and score, from the whole text alone: the language of the prototype with the highest cosine, and that cosine between 0 and 1.

    A null text, one without a letter, or no learned language: `und` and 0. Ties go to the first language in alphabetical order.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    base = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = held.value
        coder = Coder()
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = coder.bundle(part.column(part.num_columns - 1).to_pylist())
                norm = np.linalg.norm(x, axis=1)
                if profiles.languages:
                    cos = np.round(x @ profiles.prototypes.T / np.maximum(norm, 1e-12)[:, None], 6)
                    best = cos.argmax(1)
                    names += [profiles.languages[k] if n > 0 else "und" for k, n in zip(best.tolist(), norm.tolist(), strict=True)]
                    scores += np.where(norm > 0, np.clip(cos.max(1), 0, 1), 0).tolist()
                else:
                    names += ["und"] * len(x)
                    scores += [0.0] * len(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    return docs.select(*columns, F.col(text).cast("string").alias("_text_of_language")).mapInArrow(run, f"{schema}, lang_pred string, score double")
