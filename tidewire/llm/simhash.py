"""Operator 1: SimHash fingerprints joined with themselves through binary tries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import BROADCAST_ROWS, batch_of, map_arrow, stored
from tidewire.llm.components import components

#: Fingerprints that own a subtree of the top of the trie, about; tasks grow in number, not in size.
SUBTREE = 8192
#: Node pairs that are expanded together.
CHUNK = 1 << 18
#: Samples in a sketch: one minimum for each of so many classes of shingle hashes.
SAMPLES = 256
#: Bands of min-hashes for near copies, and the min-hashes in each: at a similarity of 0.8 all bands differ with a chance of (1 - 0.8 ** 7) ** 36 = 0.0002.
BANDS, BAND_ROWS = 36, 7
#: Words of a shingle of the fingerprints, the bits in which linked ones differ at most, and the parts of a fingerprint with a trie of their own.
PRINT_WIDTH, PRINT_DISTANCE, PRINT_SEGMENTS = 4, 4, 2
#: Nodes of a band up to which all its pairs are compared, and pairs from which a set of shingles is copied to further tasks.
FEW_OF_A_BAND, PAIRS_OF_A_SET = 8, 1000

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary())])


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)), np.uint64, k)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half the hashes; signed 64-bit."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """One byte for each of SAMPLES classes of shingles: from the smallest hash of the class, 0 if the class is empty (one-permutation min-hash)."""
    least = np.full(SAMPLES, np.uint64(2**64 - 1))
    np.minimum.at(least, (hashes % np.uint64(SAMPLES)).astype(np.int64), hashes >> np.uint64(8))
    return np.where(least == np.uint64(2**64 - 1), 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, sketch_width: int | None = None) -> DataFrame:
    """(doc_id, fp, sketch): the fingerprint of the whole text over ``width``-word shingles, repeats included, and a min-hash sketch over others if asked for.

    Words are runs of bytes other than blanks, A-Z lower-cased. A null, empty or blank text has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sketches = [], []
            for text in b.column(1):
                words = (text.as_py() or "").encode().lower().split()
                prints.append(fingerprint(shingle_hashes(words, width)))
                sketches.append(sketch(shingle_hashes(words, sketch_width)) if sketch_width else None)
            yield batch_of(_PRINTS, b.column(0), prints, sketches)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long, sketch binary")


class _Classes:
    """Union-find with the smallest index as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            further = self.up[self.up]
            if np.array_equal(further, self.up):
                return self.up
            self.up = further

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that joined two classes."""
        up, kept = self.up, []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = x, y
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            while up[j] != j:
                up[j] = up[up[j]]
                j = up[j]
            if i != j:
                up[max(i, j)] = min(i, j)
                kept.append((x, y))
        return kept


def similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of two sketch matrices have an estimated Jaccard similarity of ``least``: equal samples among the classes not empty in both, less chance hits."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 4096):
        x, y = a[at : at + 4096], b[at : at + 4096]
        held = ((x != 0) | (y != 0)).sum(1)
        same = ((x == y) & (x != 0)).sum(1)
        out[at : at + 4096] = (same - held / 255) / np.maximum(held * (1 - 1 / 255), 1) >= least - 1e-9
    return out


def trie_links(bits: np.ndarray, owned: np.ndarray, budgets: list[int], sketches: np.ndarray | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """Links that join the classes of all pairs within the budget, of which at least one owns the subtree; a forest, not all pairs.

    ``bits`` is sorted. The trie over it is never built: a node is an interval of it, and a node's children lie on both sides of the first number
    with the next bit set. Pairs of nodes are traversed together from (root, root); a pair carries the bits in which its paths differ, and goes
    once they are more than ``budgets[depth]``, or once all numbers below both nodes are of one class.
    """
    n = len(bits)
    classes, forest = _Classes(n), []
    total = budgets[-1]
    # numbers that differ in nothing: neighbours in the order; with sketches each is compared with the one before it, the rest is left to the traversal
    zeros = {}
    own_before = np.concatenate([[0], np.cumsum(owned)])
    changed = np.zeros(n, np.int64)

    def relabel() -> None:
        nonlocal changed
        roots = classes.roots()
        changed = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])]) if n else np.zeros(0, np.int64)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(bits[a] ^ bits[b]) <= total
        near &= (owned[a] | owned[b]) & (a != b)
        a, b = a[near], b[near]
        if len(a):
            roots = classes.roots()
            apart = roots[a] != roots[b]
            a, b = a[apart], b[apart]
        if len(a) and sketches is not None:
            good = similar(sketches[a], sketches[b], least)
            a, b = a[good], b[good]
        if len(a):
            forest.extend(classes.join(a, b))
            relabel()

    def zero(d: int) -> np.ndarray:
        if d not in zeros:
            zeros[d] = np.concatenate([[0], np.cumsum((bits >> np.uint64(63 - d)) & np.uint64(1) == 0)])
        return zeros[d]

    relabel()
    if n > 1:
        link(np.arange(n - 1), np.arange(1, n))
    stack = [(0, np.array([[0, n, 0, n, 0]], np.int64))] if n else []
    while stack:
        d, f = stack.pop()
        if len(f) > CHUNK:
            stack += [(d, f[CHUNK:]), (d, f[:CHUNK])]
            continue
        al, ah, bl, bh, cost = f.T
        roots = classes.roots()
        one = (changed[ah - 1] == changed[al]) & (changed[bh - 1] == changed[bl]) & (roots[al] == roots[bl])
        some = (own_before[ah] > own_before[al]) | (own_before[bh] > own_before[bl])
        f = f[~one & some]
        al, ah, bl, bh, cost = f.T
        small = ((ah - al) * (bh - bl) <= 16) | (d == 64)
        if small.any():
            g = f[small]
            if d < 64:
                _leaves(g, link)
            else:
                for row in g:  # equal numbers with different sketches: in blocks
                    for i in range(row[0], row[1]):
                        link(np.full(row[3] - row[2], i), np.arange(row[2], row[3]))
            f = f[~small]
            al, ah, bl, bh, cost = f.T
        if not len(f):
            continue
        z = zero(d)
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        self_pair = al == bl
        parts = []
        for a0, a1, b0, b1, extra, keep in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~self_pair)):
            c = cost + extra
            ok = (a1 > a0) & (b1 > b0) & (c <= budgets[d])
            ok = ok & keep if keep is not None else ok
            parts.append(np.stack([a0, a1, b0, b1, c], 1)[ok])
        stack.append((d + 1, np.concatenate(parts)))
    return forest


def _leaves(f: np.ndarray, link) -> None:
    """All pairs below node pairs that hold at most 16 of them."""
    al, ah, bl, bh, _ = f.T
    count = (ah - al) * (bh - bl)
    for at in range(0, len(f), CHUNK):
        c = count[at : at + CHUNK]
        k = np.repeat(np.arange(at, at + len(c)), c)
        i = np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c)
        width = (bh - bl)[k]
        link(al[k] + i // width, bl[k] + i % width)


def links(nodes: DataFrame, distance: int, segments: int, least: float | None = None, expected: int | None = None) -> DataFrame:
    """(src, dst): a forest that joins all nodes (node, fp[, sketch]) within ``distance`` bits, directly or by others.

    Of two such fingerprints, at least one of ``segments`` equal parts differs in distance / segments bits at most; so there is one trie for each
    part, in which the part's bits come first and have that smaller budget. A top node of a trie (a prefix that about SUBTREE
    fingerprints share) is one group, with the nodes of those larger prefixes that its budget allows. ``least``: the sketches must also agree.
    """
    n = nodes.count() if expected is None else expected
    width = 64 // segments
    top = min(max(0, math.ceil(math.log2(max(1, n) / SUBTREE))), width)
    part = distance // segments
    budgets = [part if d < width else distance for d in range(64)] + [distance]
    masks = [m for k in range(part + 1) for m in _masks(top, k)]
    rotated = lambda s: F.col("fp") if s == 0 else F.shiftleft("fp", s * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - s * width))
    per_trie = F.inline(F.array(*[F.struct(F.lit(s).alias("trie"), rotated(s).alias("bits")) for s in range(segments)]))
    prefix = F.shiftrightunsigned("bits", 64 - top) if top else F.lit(0).cast("long")
    rows = nodes.select("node", "sketch", per_trie).withColumn("prefix", prefix)
    at = F.explode(F.filter(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.col("prefix").bitwiseXOR(m)), lambda p: p <= F.col("prefix")))
    dealt = rows.withColumn("owner", at).withColumn("owned", F.col("owner") == F.col("prefix"))

    def run(group: pa.Table) -> pa.Table:
        bits = group["bits"].to_numpy().view(np.uint64)
        order = np.argsort(bits, kind="stable")
        node = group["node"].to_numpy()[order]
        sketches = None
        if least is not None:  # the bytes of the sketches, without an object for each
            flat = group["sketch"].cast(pa.binary(SAMPLES)).combine_chunks()
            sketches = np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * SAMPLES : (flat.offset + len(flat)) * SAMPLES].reshape(-1, SAMPLES)[order]
        found = trie_links(bits[order], group["owned"].to_numpy(zero_copy_only=False)[order], budgets, sketches, least or 0.0)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"src": node[a], "dst": node[b]})

    columns = ["trie", "owner", "node", "bits", "owned", "sketch"] if least is not None else ["trie", "owner", "node", "bits", "owned"]
    return dealt.select(columns).groupBy("trie", "owner").applyInArrow(run, "src long, dst long")


def _masks(width: int, ones: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << i for i in c) for c in combinations(range(width), ones)]


def near_duplicates(docs: DataFrame, distance: int = PRINT_DISTANCE, width: int = PRINT_WIDTH, segments: int = PRINT_SEGMENTS, label: str = "simhash") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies): every document with its class under links of at most ``distance`` differing bits.

    component_id is the smallest doc_id of the class; n_copies counts the documents with the same fingerprint. Each row of ``docs`` gives one row; a row
    with a null id has the class of its fingerprint, and a class in which all ids are null has a null component_id.
    Texts without a word share fingerprint 0, which links like any other. Extra columns are not read.
    """
    prints = stored(fingerprints(docs, width).select("doc_id", "fp"), f"{label}-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), f"{label}-nodes")
    found = links(nodes.select(F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("sketch")), distance, segments)
    roots = components(found, label)
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n_copies", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "root").select("fp", "n_copies", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def _multipliers() -> np.ndarray:
    """Odd numbers, fixed by a seed: two rows for the hash functions, one for the band keys."""
    return np.random.default_rng(11).integers(0, 2**64, (3, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A key for each of BANDS bands of BAND_ROWS min-hashes each; sets of Jaccard similarity j share a band with probability j ** BAND_ROWS."""
    times, plus, mix = multipliers
    least = np.full(len(times), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * times + plus).min(0))
    return ((least ^ (least >> np.uint64(29))) * mix).reshape(BANDS, BAND_ROWS).sum(1, dtype=np.uint64)


def row_tie() -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _shingle_sets(docs: DataFrame, width: int, keys: bool) -> DataFrame:
    """(doc_id, tie, node, then keys and fp, or shingles): tie is a hash of the text, node one of its set of shingles, fp its fingerprint as in ``fingerprints``; no keys for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("node", pa.int64()), ("x", pa.list_(pa.int64())), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()
        for b in batches:
            nodes, held, prints = [], [], []
            for text in b.column(1):
                words = (text.as_py() or "").encode().lower().split()
                shingles = np.unique(shingle_hashes(words, width))
                prints.append(fingerprint(shingle_hashes(words, PRINT_WIDTH)) if keys else None)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), 42) - (1 << 63))
                held.append((band_keys(shingles, multipliers) if keys and len(shingles) else shingles).view(np.int64))
            yield batch_of(schema, b.column(0), b.column(2), nodes, held, prints)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_tie().alias("tie"))
    made = map_arrow(base, run, "doc_id long, tie long, node long, x array<long>, fp long")
    return made.withColumnRenamed("x", "keys") if keys else made.withColumnRenamed("x", "shingles").drop("fp")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets of src and dst as _a and _b. A set that many pairs have as src is copied to several tasks."""
    heavy = F.broadcast(pairs.groupBy(F.col("src").alias("node")).count().where(F.col("count") > PAIRS_OF_A_SET).select("node", F.ceil(F.col("count") / PAIRS_OF_A_SET).cast("int").alias("parts")))
    left = sets.join(pairs.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(heavy, "node", "left")
    left = left.select(F.col("node").alias("src"), F.col("shingles").alias("_a"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("_part"))
    dealt = pairs.join(heavy.withColumnRenamed("node", "src"), "src", "left").withColumn("_part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("_b")), "dst").join(left, ["src", "_part"]).drop("_part")


def _linked(a: Column, b: Column, common: Column, similarity: float) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with ``common`` members in common have a Jaccard similarity of ``similarity`` or more."""
    return common >= similarity * (a + b - common) - 1e-9


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose sets have a Jaccard similarity of ``similarity`` or more, counted exactly."""
    both = _with_sets(pairs, sets).select("src", "dst", F.size("_a").alias("a"), F.size("_b").alias("b"), F.size(F.array_intersect("_a", "_b")).alias("c"))
    return both.where(_linked(F.col("a"), F.col("b"), F.col("c"), similarity)).select("src", "dst")


def _mixed(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` (node, key and others) with the class of the node, of the keys that hold several classes."""
    named = rows.withColumn("class", F.col("node")) if roots is None else rows.join(roots, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("class"))
    ends = named.groupBy("key").agg(F.min("class").alias("_low"), F.max("class").alias("_high"))
    return named.join(ends.where("_low <> _high").select("key"), "key", "left_semi")


def _pairs_around_centres(arms: DataFrame, sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """(src, dst): all pairs of nodes with one centre but of different classes that can have a Jaccard similarity of ``similarity`` or more, and few others.

    ``arms`` has (src, dst, class): centre, node and the node's class; a node linked to its centre must be of its class. What is compared are not the sets, which have nearly all in common, but
    their differences from the centre's: x and y differ in as many shingles as these do. With t = (1 - similarity) / (1 + similarity), linked sets x and y differ in t * (|x| + |y|) shingles at most, so
    their differences of sizes d and e share (d + e - t * (|x| + |y|)) / 2 at least. One of the two is not linked to the centre (else both are of its class) and differs from it in more than t * (|x| + |centre|): so
    a difference shares about half of itself, and what is not linked, with one that is, (d - t * (|x| + |centre|)) / (1 + t). In one order of all shingles two sets that share o hold a common one
    among their first d - o + 1 and e - o + 1. The order begins with what few classes hold; what a single class holds counts, but joins nothing, so that copies in a class meet no square.
    """
    t = (1 - similarity) / (1 + similarity)
    k, a, d = F.col("k"), F.col("a"), F.col("d")
    least = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-6).cast("int"))
    apart = _with_sets(arms, sets).select(
        F.col("src").alias("centre"), F.col("dst").alias("node"), "class", F.size("_a").alias("k"), F.size("_b").alias("a"), F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a")).alias("apart")
    )
    apart = apart.withColumn("d", F.size("apart")).withColumn("near", _linked(k, a, (k + a - d) / 2, similarity)).withColumn("half", d + 1 - least((d + t * (k - a)) / 2))
    first = F.when(F.col("near"), F.col("half")).otherwise(F.greatest(F.col("half"), d + 1 - least((d - t * (a + k)) / (1 + t))))
    apart = stored(apart.withColumn("first", first), f"{label}-apart")
    shingles = apart.withColumn("shingle", F.explode("apart")).drop("apart", "k")
    held = shingles.select("centre", "shingle", "class").distinct().groupBy("centre", "shingle").agg(F.count("*").alias("classes")).where("classes > 1")
    of = Window.partitionBy("centre", "node")
    placed = shingles.join(held, ["centre", "shingle"]).withColumn("place", (d - F.count("*").over(of) + F.row_number().over(of.orderBy("classes", "shingle"))).cast("int"))
    placed = stored(placed.where("place <= first").select("centre", "shingle", "node", "class", "a", "d", "near", "half", "place"), f"{label}-placed")
    other = placed.where("place <= half").select("centre", "shingle", *[F.col(c).alias(f"_{c}") for c in placed.columns[2:]])
    may = F.col("_near") | ((F.col("place") <= F.col("half")) & (F.col("node") < F.col("_node")))
    share = F.least(d - F.col("place"), F.col("_d") - F.col("_place")) + 1 >= (d + F.col("_d") - t * (a + F.col("_a"))) / 2 - 1e-6
    met = placed.where("NOT near").join(other, ["centre", "shingle"]).where((F.col("class") != F.col("_class")) & may & share)
    return met.select(F.least("node", "_node").alias("src"), F.greatest("node", "_node").alias("dst")).distinct()


def _print_pairs(nodes: DataFrame, label: str) -> DataFrame:
    """(src, dst): the links of operator 1 between nodes (node, fp). Nodes of one fingerprint are paired with its smallest, and fingerprints within PRINT_DISTANCE bits by the forest of their tries."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), f"{label}-fps")
    near = links(prints.select(F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("sketch")), PRINT_DISTANCE, PRINT_SEGMENTS)
    ends = [prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")) for end in ("src", "dst")]
    between = near.join(ends[0], "src").join(ends[1], "dst").select("src_node", "dst_node")
    within = nodes.join(prints, "fp").where("node <> first").select(F.col("first").alias("src_node"), F.col("node").alias("dst_node"))
    both = between.unionByName(within)
    return both.select(F.least("src_node", "dst_node").alias("src"), F.greatest("src_node", "dst_node").alias("dst")).distinct()


def _further(found: DataFrame, roots: DataFrame | None, pairs: DataFrame, sets: DataFrame, similarity: float, label: str) -> tuple[DataFrame, DataFrame | None]:
    """The links and their classes after the links among ``pairs`` have come to those of before."""
    new = stored(_alike(pairs, sets, similarity), f"{label}-links")
    if new.isEmpty():
        return found, roots
    found = found.unionByName(new)
    return found, components(found, label)


def near_duplicate_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, label: str = "copies") -> DataFrame:
    """(doc_id, component_id) of ``near_duplicate_rows``."""
    return near_duplicate_rows(docs, similarity, width, label).select("doc_id", "component_id")


def near_duplicate_rows(docs: DataFrame, similarity: float = 0.8, width: int = 5, label: str = "copies") -> DataFrame:
    """(doc_id, tie, component_id, is_first): classes of documents whose five-word shingles have a Jaccard similarity of ``similarity`` or more, directly or by others.

    Documents with the same set of shingles are one node. The first candidates are the links of ``near_duplicates``: nodes whose fingerprints differ in a few bits at most. What those leave
    apart is sought among the nodes that share a band of min-hashes, wherever their texts differ: of the pairs at a similarity of 0.8 one in 5,000 shares none. Each candidate is decided on the sets of shingles themselves.
    In a band of a few nodes all pairs of different classes are compared. In a larger one all are compared with its centre, the node with the most bands; the pairs that are left there
    are those whose differences from the centre share enough (``_pairs_around_centres``), so that a dense group of copies costs no square and no pair that could be linked is left out.

    Only documents that have an id are grouped. Documents without words are one class. component_id is the class's smallest id. ``is_first`` marks the class's smallest row by id and ``tie``
    (``row_tie``), so that rows with one id and different texts are told apart; wholly equal rows are all marked or none.
    """
    docs = docs.where("doc_id IS NOT NULL")
    prints = stored(_shingle_sets(docs, width, keys=True), f"{label}-prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.min("fp").alias("fp"))
    first = stored(_print_pairs(nodes.select("node", "fp"), label), f"{label}-pairs0")
    rows = stored(prints.groupBy("node").agg(F.any_value("keys").alias("keys")).select("node", F.explode("keys").alias("key")), f"{label}-bands")
    rows = stored(rows.join(rows.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"), f"{label}-shared")
    ends = first.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(rows.select("node")).distinct()
    some = nodes.join(ends, "node", "left_semi").select(F.col("least.doc_id").alias("doc_id")).distinct()
    few = some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = _shingle_sets(docs.join(F.broadcast(some) if few else some, "doc_id", "left_semi"), width, keys=False)
    sets = stored(sets.select("node", "shingles").dropDuplicates(["node"]), f"{label}-sets")
    found = stored(_alike(first, sets, similarity), f"{label}-links0")
    roots = None if found.isEmpty() else components(found, f"{label}-round0")
    named = stored(_mixed(rows, roots), f"{label}-named")
    centres = named.join(named.groupBy("node").agg(F.count("*").alias("bands")), "node").groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("bands", "node", "class")).alias("centre"))
    dealt = stored(named.join(centres, "key").select("node", "key", "class", "n", F.col("centre.node").alias("centre"), (F.col("centre.class") == F.col("class")).alias("joined")), f"{label}-dealt")
    small, large = dealt.where(F.col("n") <= FEW_OF_A_BAND), dealt.where(F.col("n") > FEW_OF_A_BAND)
    other = small.select("key", F.col("node").alias("_node"), F.col("class").alias("_class"))
    direct = small.join(other, "key").where("node < _node AND class <> _class").select(F.col("node").alias("src"), F.col("_node").alias("dst"))
    pairs = stored(direct.unionByName(large.where("NOT joined").select(F.col("centre").alias("src"), F.col("node").alias("dst"))).distinct(), f"{label}-pairs1")
    found, roots = _further(found, roots, pairs, sets, similarity, f"{label}-round1")
    arms = _mixed(large.select("node", "key", "centre"), roots).where("node <> centre")
    arms = stored(arms.select(F.col("centre").alias("src"), F.col("node").alias("dst"), "class").distinct(), f"{label}-arms")
    if not arms.isEmpty():
        pairs = stored(_pairs_around_centres(arms, sets, similarity, label), f"{label}-pairs2")
        found, roots = _further(found, roots, pairs, sets, similarity, f"{label}-round2")
    classes = nodes.select("node", "least", F.col("node").alias("root")) if roots is None else nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("first"))
    named = prints.select("doc_id", "tie", "node").join(classes.join(smallest, "root").select("node", "first"), "node")
    return named.select("doc_id", "tie", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "tie") == F.col("first")).alias("is_first"))
