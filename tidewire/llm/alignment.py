"""Operator 13: two tokenizers' ids of a text, aligned by the byte offsets where tokens of both end.

A text is cut before each single space between two marks that aren't white space: no token of either tokenizer crosses such a place (one splits there by its pattern, the other has no piece with a
space inside). The parts repeat, so that a worker remembers what it has found for them. The ends of the tokens of all new parts are keys of two dictionaries; the keys in both, sorted,
slice the ids into groups, and the links of a group are expanded slice by slice. Links are counted over the whole corpus by their pair of ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewire.llm.common import BROADCAST_ROWS, batch_of, map_arrow, stored

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Parts that a worker remembers (about 300 bytes each), and pairs that it counts before it hands them on.
PARTS, PAIRS = 300_000, 1_000_000
#: Fixed value: the pattern by which the first tokenizer splits a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE_MARK = "▁"  # stands for a space in the second tokenizer's pieces


def _byte_of_mark() -> dict[str, int]:
    """The byte that each mark of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """Ids by a byte-level vocabulary of the tokenizers library; texts of Latin letters go through an equal but faster encoder."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            stated = json.load(f)
        vocabulary, marks = stated["model"]["vocab"], _byte_of_mark()
        special = {t["content"] for t in stated["added_tokens"]}
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        spelled = {i: bytes(marks[c] for c in t) for t, i in plain.items()}
        self.bytes_of = [spelled.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        # ids that follow the order of the merges are ranks
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in stated["model"]["merges"]]
        ordered = all(vocabulary[m] == 256 + k for k, m in enumerate(merges))
        self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in spelled.items()}, special_tokens={}) if ordered else None

    def encode(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or max(text) < "ɐ"):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids by a sentencepiece model; it adds the space that ``text`` begins with."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]
        self.cuts = not any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", self.model.id_to_piece(i)) for i in range(n))

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


def group_slices(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of the tokens of each group: the ends that both have, found as keys of two dictionaries, cut the lists."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    out, a, b = [], 0, 0
    for end in sorted(at_a.keys() & at_b.keys()):
        to_a, to_b = at_a[end], at_b[end]
        out.append((a, to_a, b, to_b))
        a, b = to_a, to_b
    return out


def links_of(a: int, to_a: int, b: int, to_b: int, ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Places of the pairs of tokens of a slice whose bytes overlap: a step goes on at the side whose token ends first."""
    out = []
    while a < to_a and b < to_b:
        out.append((a, b))
        end_a, end_b = ends_a[a], ends_b[b]
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
    return out


class Aligner:
    """Groups and links of texts, remembered by part."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.width = len(self.a.bytes_of)  # a pair's number is its second id times this, plus the first
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.names_a, self.names_b = ([str(i) for i in range(len(t.bytes_of))] for t in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts, self.links, self.link_ends = array("q"), array("q"), array("q", [0])  # counts: ids of both, groups, 1 if the bytes agree

    def cut(self, text: str) -> list[str]:
        """Parts of ``text``, which begins with a space."""
        return _CUT.split(text) if self.b.cuts and _SPACE_MARK not in text else [text]

    def learn(self, parts: list[str]) -> None:
        """Work out parts that aren't known: at once those that may follow one another, alone those that end in white space, stand whole or aren't Latin."""
        together = [p for p in parts if not p[-1].isspace() and _SPACE_MARK not in p and (p.isascii() or max(p) < "ɐ")]
        if together:
            self._learn("".join(together), together)
        one = set(together)
        for p in parts:
            if p not in one:
                self._learn(p, [p])

    def _learn(self, text: str, parts: list[str]) -> None:
        ids_a, ids_b = self.a.encode(text), self.b.encode(text)
        data = text.encode()
        agree = b"".join([self.b.bytes_of[i] for i in ids_b]) == data and b"".join([self.a.bytes_of[i] for i in ids_a]) == data
        if not agree:
            for p in parts if len(parts) > 1 else ():
                self._learn(p, [p])
            if len(parts) == 1:
                self._add(parts[0], "", (0, 0, 0, 0))
            return
        ends_a, ends_b = self.size_a[ids_a].cumsum().tolist(), self.size_b[ids_b].cumsum().tolist()
        width, names_a, names_b, links = self.width, self.names_a, self.names_b, self.links
        slices = iter(group_slices(ends_a, ends_b))
        end = 0
        for p in parts:
            end += len(p.encode())
            first, groups = None, []
            for s in slices:
                a, to_a, b, to_b = s
                first = first or s
                if to_a - a == 1:
                    groups.append(f"{names_a[ids_a[a]]}|{','.join([names_b[i] for i in ids_b[b:to_b]])}")
                    links.extend([i * width + ids_a[a] for i in ids_b[b:to_b]])
                elif to_b - b == 1:
                    groups.append(f"{','.join([names_a[i] for i in ids_a[a:to_a]])}|{names_b[ids_b[b]]}")
                    links.extend([ids_b[b] * width + i for i in ids_a[a:to_a]])
                else:
                    groups.append(f"{','.join([names_a[i] for i in ids_a[a:to_a]])}|{','.join([names_b[i] for i in ids_b[b:to_b]])}")
                    links.extend([ids_b[y] * width + ids_a[x] for x, y in links_of(a, to_a, b, to_b, ends_a, ends_b)])
                if ends_a[to_a - 1] >= end:
                    break
            self._add(p, ";".join(groups), (to_a - first[0], to_b - first[2], len(groups), 1))

    def _add(self, part: str, groups: str, counts: tuple[int, int, int, int]) -> None:
        self.known[part] = len(self.groups)
        self.groups.append(groups)
        self.counts.extend(counts)
        self.link_ends.append(len(self.links))

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(ids of each tokenizer, groups, links, groups as text, pairs, how often each) of each text; nothing where a text has no tokens."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        known = self.known
        new = list(dict.fromkeys(p for parts in cut for p in parts if p not in known))
        if new and len(known) + len(new) > PARTS:
            self.forget()
            known = self.known
            new = list(dict.fromkeys(p for parts in cut for p in parts))
        if new:
            self.learn(new)
        counts, ends = np.frombuffer(self.counts, np.int64).reshape(-1, 4), np.frombuffer(self.link_ends, np.int64)
        links = np.frombuffer(self.links, np.int64) if len(self.links) else np.empty(0, np.int64)
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        out = []
        for parts in cut:
            if not parts:
                out.append(nothing)
                continue
            at = np.array([known[p] for p in parts])
            total = counts[at].sum(0).tolist()
            if total[3] < len(parts):  # the bytes of a part differ
                out.append(nothing)
                continue
            begin, n = ends[at], ends[at + 1] - ends[at]
            own = links[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs, times = np.unique(own, return_counts=True)
            out.append((total[0], total[1], total[2], len(own), ";".join([self.groups[k] for k in at.tolist()]), pairs, times))
        return out


def sha256_of(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(paths: tuple[str, str] | None) -> Aligner:
    """The aligner of this worker process: what it remembers serves its later tasks, too."""
    if paths is None:
        import public_tokenizers

        paths = tuple(map(public_tokenizers.path, VOCABULARIES))
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def groups_of(docs: DataFrame, paths: tuple[str, str] | None = None, outcome: Callable[[str], str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times): for each row, the numbers of ids, groups and links, the groups as `a1,a2|b1;a3|b2,b3` or what ``outcome`` makes of that text, and its
    pairs of ids (second id times the first vocabulary's size, plus first id) with the links that hold them. A text without tokens has zeros and an empty text."""
    kinds = [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    schema = pa.schema([*kinds, ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(paths)
        for b in batches:
            for begin in range(0, b.num_rows, 128):
                part = b.slice(begin, 128)
                rows = list(zip(*aligner.align([t or "" for t in part.column(1).to_pylist()]), strict=True))
                groups = [outcome(g) if outcome and g else g for g in rows[4]]
                yield batch_of(schema, part.column(0), *rows[:4], groups, lists(list(rows[5]), pa.int64()), lists(list(rows[6]), pa.int32()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): the links of the whole corpus that hold a pair, and 1 if no pair with its second id has more. Tasks add up their own rows first."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            more, times = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            pairs, at = np.unique(np.r_[pairs, more], return_inverse=True)
            n = np.bincount(at, np.r_[n, times], len(pairs)).astype(np.int64)
            if len(pairs) > PAIRS:
                yield batch_of(schema, pairs, n)
                pairs, n = pairs[:0], n[:0]
        yield batch_of(schema, pairs, n)

    counts = map_arrow(aligned.select("pairs", "times"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width)))  # of the pairs of one id, as many as the other vocabulary has at most
    return counts.select("pair", "n", (F.col("n") == most).cast("int").alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, outcome: Callable[[str], str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of ``docs`` (doc_id, text).

    ``paths``: the vocabulary files on the workers, by default the public ones installed there. ``groups`` is the text of the groups, or what ``outcome`` makes of it.
    Null and empty texts, and those whose tokens don't give back a space and the text, have zeros, and '' as groups. Null ids stay null; each repeated row is counted and has a row of its own.
    Very long texts are handled whole. An empty table gives an empty one. Other columns, whatever their names, are not read. Pair counts are joined by broadcast if they are few, else by a shuffle.
    """
    aligned = stored(groups_of(docs, paths, outcome).withColumn("row", F.monotonically_increasing_id()), "alignment")
    width = len(aligner_of(paths).a.bytes_of)
    counts = stored(pair_counts(aligned, width), "alignment-pairs")
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = each.join(F.broadcast(counts) if few else counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
