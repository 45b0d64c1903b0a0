"""Operator 3: best-fit packing of token pieces, planned on the counts of lengths and carried out by ranks."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewire.llm.common import batch_of, map_arrow, stored

CAPACITY, END_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Parts of each length for the ranking, so that one very common length is not one task.
PARTS = 64
#: Parts of texts that a worker's encoder remembers: about 150 MB at most.
PARTS_KNOWN = 600_000

#: White space of Python that the tokenizer doesn't take for white space, and marks of its special tokens: such texts are encoded whole.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: The tokenizer's pattern (a fixed value) as it reads on Latin-1 texts without the numerals below, which Python's letters would include.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_NUMERALS = "²³¹¼½¾"


class Merges:
    """The ids of word parts by the merges of a byte-level vocabulary with word ends, for very many parts at once.

    A row of symbols for each part; in every step the merge that ranks first in a row, the leftmost if it is there twice, is carried out in all rows together. A merge's product never takes part
    in one that ranks before it, so that this is the tokenizer's own order.
    """

    END, LONGEST, NONE = "</w>", 24, np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        self.usable = model.get("end_of_word_suffix") == self.END and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
        if not self.usable:
            return
        vocabulary = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves; the others follow from 256 on
        others = [b for b in range(256) if b not in printable]
        marks = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.inner, self.last = (np.array([vocabulary.get(marks[b] + end, -1) for b in range(256)], np.int32) for end in ("", self.END))
        self.usable = min(self.inner.min(), self.last.min()) >= 0
        self.width = np.int64(max(vocabulary.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * int(self.width) + vocabulary[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.product = np.array([vocabulary[a + b] for a, b in pairs], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two symbols; NONE where there is none, or no symbol."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.order[at], self.NONE)

    def ids(self, parts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of parts of 1 to LONGEST bytes."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for low, high in ((0, 6), (6, 10), (10, 15), (15, self.LONGEST)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                self._merge([parts[k] for k in rows.tolist()], sizes[rows], rows, out)
        return out

    def _merge(self, parts: list[bytes], size: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        width = int(size.max())
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(-1, width)
        place = np.arange(width)
        symbols = np.where(place < size[:, None] - 1, self.inner[raw], np.where(place == size[:, None] - 1, self.last[raw], np.int32(-1))).astype(np.int64)
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:]) if width > 1 else np.full((len(parts), 1), self.NONE)
        while len(rows):
            best = ranks.argmin(1)
            every = np.arange(len(rows))
            least = ranks[every, best]
            done = least == self.NONE
            if done.any():
                for k, n, ids in zip(rows[done].tolist(), size[done].tolist(), symbols[done].astype("<u4"), strict=True):
                    out[k] = ids[:n].tobytes()
                go = ~done
                rows, size, symbols, ranks, best, least = rows[go], size[go], symbols[go], ranks[go], best[go], least[go]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            symbols[every, best] = self.product[least]
            later = place[None, :-1] > best[:, None]
            symbols[:, :-1] = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            size = size - 1
            later = place[None, : width - 2] > best[:, None]
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.NONE
            for at in (best - 1, best):  # only the pairs with the new symbol are looked up again
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                ranks[ok, at[ok]] = self._ranks(symbols[ok, at[ok]], symbols[ok, at[ok] + 1])


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers; those of each part are worked out once.

    A Latin-1 text in lower case is split into parts by the tokenizer's own pattern; a text's ids are those of its parts, one after the other. In other texts words between white space take the
    place of parts: the tokenizer drops white space and never joins letters across it. Texts with special tokens' marks, or control characters that Python takes for white space, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    @staticmethod
    def _parts(text: str) -> list[str] | None:
        if any(x in text for x in _WHOLE):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.split() if any(x in text for x in _NUMERALS) else _LATIN.findall(text.lower())

    def _learn(self, new: set[str]) -> None:
        short = [p for p in new if p.isalpha() and len(p) <= Merges.LONGEST // 2 and p.islower()] if self.merges.usable else []  # letters of at most LONGEST bytes
        latin = [p for p in short if max(p) < "\u0100"]
        self.known.update(zip(latin, self.merges.ids([p.encode() for p in latin]) if latin else [], strict=True))
        rest = list(new.difference(latin))
        self.known.update(zip(rest, self._ids(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a few hundred texts at a time keep the memory bounded."""
        parts = [self._parts(t) for t in texts]
        known = self.known
        met = set().union(*[p for p in parts if p])
        new = met - known.keys()
        if len(known) + len(new) > PARTS_KNOWN:
            known.clear()
            new = met
        if new:
            self._learn(new)
        of = known.__getitem__
        return [self._ids([t])[0] if p is None else b"".join(map(of, p)) for t, p in zip(texts, parts, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process: its words serve its later tasks, too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of each whole text and END_ID, cut at ``capacity`` if there are more.

    ``vocabulary``: path of a tokenizer file on the workers; by default the public one that is installed there. A null or empty text is END_ID alone. A null id stays null;
    each repeated row has its own pieces.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        encoder = encoder_of(path)
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), *([np.frombuffer(piece, "<u4").tolist()] if with_ids else [])))
            yield batch_of(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, first rank, pieces, first sequence, pieces side by side, offset) that place ``counts`` pieces of each length; number of sequences.

    Pieces above a third of the capacity are at most two to a sequence: by falling length, each is matched with the longest such piece that fits beside it.
    Shorter pieces then go, by falling length, into the smallest gap that holds them, as many as fit; new sequences are begun only if there is no such gap.
    Sequences with the same content are handled together, so that the work depends on the lengths that occur, not on the number of pieces.
    """
    left = {length: n for length, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    order: list[int] = []  # gaps that occur, ascending
    total = 0

    def place(length: int, n: int, first: int, beside: int, offset: int) -> None:
        steps.append((length, rank[length], n, first, beside, offset))
        rank[length] += n
        left[length] -= n

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while k >= 0 and not left[large[k]]:
                k -= 1
            if k < 0 or (large[k] == a and left[a] < 2):
                if k >= 0:  # a alone is left of its length: the next shorter one
                    k -= 1
                    while k >= 0 and not left[large[k]]:
                        k -= 1
                if k < 0:
                    n = left[a]
                    place(a, n, total, 1, 0)
                    open_gap(capacity - a, total, n)
                    total += n
                    continue
            b = large[k]
            n = left[a] // 2 if b == a else min(left[a], left[b])
            place(a, n, total, 1, 0)
            place(b, n, total, 1, a)
            open_gap(capacity - a - b, total, n)
            total += n
    for a in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[a]:
            k = bisect.bisect_left(order, a)
            if k == len(order):
                n = -(-left[a] // (capacity // a))
                gaps.setdefault(capacity, []).append((total, n))
                order.append(capacity)
                total += n
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            beside = gap // a
            full = min(n, left[a] // beside)
            if full:
                place(a, full * beside, first, beside, capacity - gap)
                open_gap(gap - beside * a, first, full)
            rest = left[a] if full < n else 0  # fewer than ``beside``: one sequence more
            if rest:
                place(a, rest, first + full, rest, capacity - gap)
                open_gap(gap - rest * a, first + full, 1)
            used = full + (1 if rest else 0)
            open_gap(gap, first + used, n - used)
    return steps, total


def pack(pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS, label: str = "packing") -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...) with sequence_id and offset.

    The counts of the lengths, ``capacity`` numbers, are all that the driver sees. A piece's rank among those of its length (by part, then by id and piece) tells its place in the
    plan. Lengths are split into ``parts`` by a hash of the piece, so that a length that a third of all pieces share is ranked in as many tasks. Equal rows tie and take any order.
    """
    rows = stored(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")), label)
    counts = rows.groupBy("length", "_part").agg(F.count("*").alias("_n")).collect()  # capacity x parts numbers at most
    n = np.zeros((capacity + 1, parts + 1), np.int64)
    for r in counts:
        n[r["length"], r["_part"] + 1] = r["_n"]
    before = n.cumsum(1)
    steps, _ = plan({k: int(x) for k, x in enumerate(before[:, -1]) if x}, capacity)
    steps.sort()
    table = np.array(steps, np.int64).reshape(-1, 6)
    held = pieces.sparkSession.sparkContext.broadcast((before, table))
    by = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = rows.withColumn("_rank", F.row_number().over(by) - 1)
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = held.value
        wide = np.int64(1) << np.int64(44)
        keys = table[:, 0] * wide + table[:, 1]
        for b in batches:
            length, part, rank = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "_part", "_rank"))
            rank = rank + before[length, part]
            s = table[np.searchsorted(keys, length * wide + rank, side="right") - 1] if len(keys) else np.zeros((len(rank), 6), np.int64)
            j = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in columns], pa.array(s[:, 3] + j // s[:, 4]), pa.array(s[:, 5] + j % s[:, 4] * length)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_arrow(ranked, run, f"{schema}, sequence_id long, offset long")
