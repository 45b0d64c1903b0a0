"""Operator 11: byte strings that occur earlier are cut out, found by suffix arrays of shards.

Every string of ``length`` bytes holds an anchor, the least hash of the 32-byte strings inside, so that equal strings have equal anchors. Neighbouring starts with one anchor form a
segment. Segments whose anchor occurs once are left alone; of equal segments the first stays; different ones with one anchor, and those that hold it twice, meet in a shard, whose suffix array tells which of their
strings are equal. The copies of a whole text are set aside before, and an anchor with very many different segments is dealt to several shards, whose first strings are then compared by
their 128-bit hashes. Nothing of this is a cap: every string that occurs twice is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import batch_of, map_arrow, only, stored, without
from tidewire.llm.suffix_arrays import common_prefixes, suffix_array

LENGTH, ANCHOR = 100, 32
#: Starts in a segment, bytes of segments in a shard, different segments of an anchor in a shard.
SEGMENT_STARTS, SHARD_BYTES, SHARD_SEGMENTS = 512, 1 << 20, 2000
#: Bits of the filter of repeated anchors; its size is fixed, and where it fills up more anchors are looked at in vain.
FILTER_BITS = 1 << 26
_BLOCK, _BREAK = 1 << 17, b"\xff"  # a byte that no UTF-8 text holds
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)]


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on; the length is doubled step by step."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    h ^= h >> np.uint64(29)
    width, by = 1, int(_MIX[1])
    while width < ANCHOR:
        h = h[:-width] * np.uint64(by) + h[width:]
        by = by * by % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each place on."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: len(values) - (width - k)], values[width - k :]) if k < width else values


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each place, anchor of the string at each start, places that are the anchor of some start)."""
    hashes = _hashes(data)
    width = length - ANCHOR + 1
    anchor = _least(hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    most = ~_least(~np.r_[edge, anchor, edge], width)  # the greatest anchor among the starts that see a place
    return hashes, anchor, np.flatnonzero(most == hashes)


def _segments(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(number of the text, first start, starts, anchor) of each segment of texts of ``length`` bytes or more, and a function that tells which of some segments hold their anchor twice."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    hashes, anchor, places = _anchors(np.frombuffer(b"".join(texts), np.uint8), length)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[ends - sizes] = True
    new[ends[:-1] - length + 1] = True  # starts whose string would reach into the next text
    first = np.flatnonzero(new)
    starts = np.diff(np.r_[first, len(anchor)])
    pieces = -(-starts // SEGMENT_STARTS)
    if len(pieces) and pieces.max() > 1:  # runs of one anchor in repetitive text
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, starts = np.repeat(first, pieces) + nth * SEGMENT_STARTS, np.minimum(SEGMENT_STARTS, np.repeat(starts, pieces) - nth * SEGMENT_STARTS)
    of = np.searchsorted(ends, first, side="right")
    inside = first + length <= ends[of]
    first, starts, of = first[inside], starts[inside], of[inside]

    def twice(which: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(places, first[which]), np.searchsorted(places, first[which] + starts[which] + length - ANCHOR)
        n = high - low
        seen = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        own = hashes[places[seen]] == np.repeat(anchor[first[which]], n)
        return np.bincount(np.repeat(np.arange(len(which)), n)[own], minlength=len(which)) > 1

    return of, first - (ends - sizes)[of], starts, anchor[first].view(np.int64), twice


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and texts of ``length`` bytes or more, a block at a time."""
    rows, texts, size = [], [], 0
    column = batch.column(batch.schema.get_field_index("text"))
    for k in range(batch.num_rows):
        text = (column[k].as_py() or "").encode()
        if len(text) >= length:
            rows.append(k)
            texts.append(text)
            size += len(text)
        if size > _BLOCK:
            yield rows, texts
            rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def _anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, n): each anchor of some texts, n is 2 where it is at several places."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, texts in _blocks(b, length):
                hashes, _, places = _anchors(np.frombuffer(b"".join(texts), np.uint8), length)
                found.append(hashes[places].view(np.int64))
            anchors, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield batch_of(schema, anchors, np.minimum(n, 2))

    return map_arrow(docs.select("text"), run, "anchor long, n int")


def _filter_of(anchors: DataFrame) -> np.ndarray:
    """Bits of the anchors, FILTER_BITS in all: words are put together by sums in tasks, then stretches of 1,024 words, and the driver gets those, of a fixed size in all."""
    words = anchors.select(F.pmod("anchor", F.lit(FILTER_BITS)).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))

    def stretch(rows: pa.Table) -> pa.Table:
        out = np.zeros(1024, np.int64)
        word = rows.column("word").to_numpy()
        out[word & 1023] = rows.column("bits").to_numpy()
        return pa.table({"at": pa.array([word[0] >> 10], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words.groupBy(F.shiftright("word", 10).alias("_at")).applyInArrow(stretch, "at long, bits binary").toLocalIterator():
        bits[r["at"] << 10 : (r["at"] + 1) << 10] = np.frombuffer(r["bits"], np.uint64)
    return bits


def _repeated_segments(docs: DataFrame, bits, length: int) -> DataFrame:
    """(anchor, print, doc_id, tie, start, n, twice, body) of each segment whose anchor is in the filter."""
    schema = pa.schema([("anchor", pa.int64()), ("print", pa.binary()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("twice", pa.int32()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for b in batches:
            ids, ties = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "tie"))
            for rows, texts in _blocks(b, length):
                of, first, starts, anchor, twice = _segments(texts, length)
                bit = np.mod(anchor, FILTER_BITS)
                hit = np.flatnonzero((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                double = twice(hit).astype(np.int32)
                of, first, starts, anchor = of[hit], first[hit], starts[hit], anchor[hit]
                body = [texts[k][a : a + m + length - 1] for k, a, m in zip(of.tolist(), first.tolist(), starts.tolist(), strict=True)]
                at = pa.array(np.array(rows, np.int64)[of])
                yield batch_of(schema, anchor, [xxhash.xxh3_128_digest(x) for x in body], ids.take(at), ties.take(at), first.astype(np.int32), starts.astype(np.int32), double, body)

    return map_arrow(docs.select("doc_id", "tie", "text"), run, "anchor long, print binary, doc_id long, tie long, start int, n int, twice int, body binary")


def _at() -> Column:
    return F.struct("doc_id", "tie", "start")


def _later(rows: DataFrame, firsts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(doc_id, tie, start, n) of the rows that are not the first of their keys."""
    other = firsts.select(*[F.col(k).alias(f"_{k}") for k in keys], "at")
    met = rows.join(other, [F.col(k) == F.col(f"_{k}") for k in keys])
    return met.where(~(_at().eqNullSafe(F.col("at")))).select("doc_id", "tie", "start", F.expr(n).alias("n"))


def _search(segments: DataFrame, length: int) -> DataFrame:
    """For the segments of each shard: (doc_id, tie, start, n, print). Without a print: n starts from there on whose strings begin earlier in the shard; with it: a start of an anchor that
    has several shards, the first of its string here."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("print", pa.binary())])

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("known", "ascending"), ("doc_id", "ascending"), ("tie", "ascending"), ("start", "ascending")])
        bodies = shard.column("body").to_pylist()
        starts = shard.column("n").to_numpy().astype(np.int64)
        whole = _BREAK.join(bodies)
        data = np.frombuffer(whole, np.uint8)
        order = suffix_array(np.r_[data.astype(np.int16) + 1, 0].astype(np.int16))[1:]
        common, before = common_prefixes(data, order)
        begin = np.cumsum(starts + length) - (starts + length)  # a segment's bytes and the break behind it
        of = np.repeat(np.arange(len(starts)), starts)
        place = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[of]
        is_start = np.zeros(len(data), bool)
        is_start[place] = True
        run_of = np.cumsum(common[order] < length) - 1  # suffixes with equal strings stand together
        least = np.full(run_of[-1] + 1, len(data))
        own = is_start[order]
        np.minimum.at(least, run_of[own], order[own])
        first = np.zeros(len(data), bool)
        first[order[own]] = least[run_of[own]] == order[own]
        later = ~first[place]
        # runs of later starts of a segment
        edge = np.flatnonzero(np.r_[True, (later[1:] != later[:-1]) | (of[1:] != of[:-1])])
        size = np.diff(np.r_[edge, len(later)])
        edge, size = edge[later[edge]], size[later[edge]]
        hot = np.flatnonzero(~later & shard.column("hot").to_numpy(zero_copy_only=False)[of])
        at = np.r_[edge, hot]
        prints = [None] * len(edge) + [xxhash.xxh3_128_digest(whole[p : p + length]) for p in place[hot].tolist()]
        rows = pa.array(of[at])
        offset = shard.column("start").to_numpy()[of[at]] + place[at] - begin[of[at]]
        ids, ties = (shard.column(c).combine_chunks().take(rows) for c in ("doc_id", "tie"))
        return pa.Table.from_batches([batch_of(schema, ids, ties, offset.astype(np.int32), np.r_[size, np.ones(len(hot), np.int64)].astype(np.int32), prints)])

    return segments.groupBy("shard").applyInArrow(run, "doc_id long, tie long, start int, n int, print binary")


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tie, start, n): n starts from ``start`` on whose strings of ``length`` bytes also begin earlier. ``docs``: (doc_id, tie, text), texts all different."""
    counts = _anchor_counts(docs, length).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(counts))
    segments = stored(_repeated_segments(docs, bits, length), "repeats-segments")
    firsts = stored(segments.groupBy("anchor", "print").agg(F.min(_at()).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("twice").alias("twice"), F.first("body").alias("body")), "repeats-firsts")
    copies = _later(segments.select("anchor", "print", "doc_id", "tie", "start", "n"), firsts.where("copies > 1"), ["anchor", "print"], "n")
    shared = stored(firsts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("twice").alias("twice"), F.sum(F.col("n") + length).alias("bytes")).where("kinds + twice > 1").drop("twice"), "repeats-shared")
    shards = -(-(shared.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES) + 1
    hot = F.col("kinds") > SHARD_SEGMENTS
    part = F.when(hot, F.pmod(F.xxhash64("print"), F.ceil(F.col("kinds") / SHARD_SEGMENTS))).otherwise(0)
    dealt = firsts.join(shared, "anchor").select(F.pmod(F.xxhash64("anchor", part), F.lit(shards)).alias("shard"), F.col("at.doc_id").isNotNull().alias("known"), "at.doc_id", "at.tie", "at.start", "n", "body", hot.alias("hot"))
    found = stored(_search(dealt, length), "repeats-found")
    strings = found.where("print IS NOT NULL")
    first_strings = strings.groupBy("print").agg(F.min(_at()).alias("at"), F.count("*").alias("copies")).where("copies > 1")
    across = _later(strings, stored(first_strings, "repeats-strings"), ["print"], "1")
    return copies.unionByName(found.where("print IS NULL").select("doc_id", "tie", "start", "n")).unionByName(across)


def cut(text: bytes, starts: list[tuple[int, int]], length: int = LENGTH) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs (begin, end) and the bytes that stay."""
    spans: list[list[int]] = []
    for start, n in sorted(starts):
        end = start + n - 1 + length
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at:begin])
        at = end
    return [(a, b) for a, b in spans], b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, text_sha256), a row for each row of ``docs`` (doc_id, text): the byte ranges removed, the bytes left, the digest of the whole text.

    A byte goes if a string of ``length`` bytes over it also begins earlier: in a row with a smaller id, or further left in the same text. ``kept`` is null where nothing goes.
    A null text is empty, a null id comes before all others. Rows with one id are ordered by a hash of the text; of wholly equal rows one is the first. Texts shorter than ``length`` stay whole,
    and an empty table gives an empty one. Further columns are left out, so that their names don't matter. Very long texts are cut into segments like others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = stored(docs.select("doc_id", "tie", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes")).groupBy("doc_id", "tie", "text_sha256", "n_bytes").agg(F.count("*").alias("equal")), "repeats-rows")
    first = stored(rows.groupBy("text_sha256").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "repeats-copied")
    rows = stored(rows.join(first, "text_sha256", "left").withColumn("is_first", F.col("first").isNull() | F.struct("doc_id").eqNullSafe(F.col("first"))).drop("first"), "repeats-rows")
    copies = rows.where("NOT is_first").select(F.struct("doc_id", "tie").alias("row"))
    texts = without(docs.where(F.octet_length("text") >= length).withColumn("row", F.struct("doc_id", "tie")), copies, "row")
    starts = stored(repeated_starts(texts, length).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("starts")), "repeats-starts")

    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [cut(t.encode(), [(x["start"], x["n"]) for x in s], length) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield batch_of(schema, b.column(0), b.column(1), [[{"begin": x, "end": y} for x, y in spans] for spans, _ in done], [kept for _, kept in done])

    by_row = starts.select(F.struct("doc_id", "tie").alias("row"), "starts")
    one = only(docs.withColumn("row", F.struct("doc_id", "tie")), by_row.select("row"), "row").join(by_row, "row")  # only texts that lose something are dealt out
    kinds = "doc_id long, tie long, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    done = map_arrow(one.select("doc_id", "tie", "text", "starts"), run, kinds).dropDuplicates(["doc_id", "tie"])
    done = done.select(F.struct("doc_id", "tie").alias("row"), "spans", "kept")
    out = rows.withColumn("row", F.struct("doc_id", "tie")).join(done, "row", "left")
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal"))))
    stays = (F.col("n_bytes") < length) | (F.col("is_first") & (F.col("nth") == 1))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    nothing = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")
    return out.select("doc_id", "n_bytes", F.when(stays, F.coalesce("spans", nothing)).otherwise(everything).alias("spans"), F.when(stays, F.col("kept")).otherwise(F.lit(b"")).alias("kept"), "text_sha256")


def by_brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple[int | None, int, list[tuple[int, int]], str]]:
    """(doc_id, n_bytes, spans, digest of what stays) by a dictionary of all strings, for tests: rows with different ids."""
    seen: set[bytes] = set()
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        starts = []
        for k in range(len(data) - length + 1):
            string = data[k : k + length]
            if string in seen:
                starts.append((k, 1))
            seen.add(string)
        spans, kept = cut(data, starts, length)
        out.append((doc_id, len(data), spans, hashlib.sha256(kept).hexdigest()))
    return out
