"""Operator 12: a Merkle manifest of a table, with proofs and folding from kept hash states.

Rows are leaves; every group's leaves, in order, are hashed in runs of sixteen, level by level, to a subroot, and the subroots likewise to the root. A task takes a block of 16 ** 3 nodes,
that is three levels, at once. While it builds a parent it keeps a copy of the hash state before each child; a changed child is then folded by resuming the state before its slot with
the new digest and the digests to its right only. Above the block all its leaves share one path, whose states are made once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewire.llm.common import batch_of, stored

FANOUT, LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK_BITS = 12  # a block has FANOUT ** LEVELS nodes
#: Rows of an Arrow batch of proofs.
_SLICE = 256


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the values one after the other: each is `-` if null, else its UTF-8 byte count, `:` and itself; integers are decimal."""
    fields = []
    for v in values:
        text = v.cast("string")
        fields.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*fields), 256)


def ranked(leaves: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``leaves`` with rank (from 0 on within ``grp``, by the columns ``order``, nulls first) and total.

    Rows are dealt out by sampled ranges of group and order, so that a group that holds most of the rows is many tasks; a number that each row has got before breaks ties, so that equal rows
    are dealt out, too. A rank is the place in the range plus the rows of the group in earlier ranges.
    """
    numbered = stored(leaves.withColumn("_tie", F.monotonically_increasing_id()), f"{label}-numbered")
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "_tie")]
    placed = stored(numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), f"{label}-placed")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("grp", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("grp")
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("grp", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_group).alias("total"))
    met = placed.withColumn("_part", part).join(counts, ["grp", "_part"])
    return met.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def grow(digests: list[bytes], total: int) -> list[tuple[list[bytes], list]]:
    """(nodes, hash state before each node in its parent) of each level above a block of a group with ``total`` nodes, and at last (root,)."""
    levels, nodes = [], digests
    while (len(levels) < LEVELS) if total > FANOUT**LEVELS else len(nodes) > 1:
        states, above = [], []
        for at in range(0, len(nodes), FANOUT):
            state = hashlib.sha256()
            for child in nodes[at : at + FANOUT]:
                states.append(state.copy())
                state.update(child)
            above.append(state.hexdigest().encode())
        levels.append((nodes, states))
        nodes = above
    return [*levels, (nodes, [])]


def _sorted(block: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    block = block.sort_by("rank")
    return block, [d.encode() for d in block.column("digest").to_pylist()], block.column("total")[0].as_py()


_NODE = "grp string, rank long, total long, digest string"
_NODE_SCHEMA = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])


def climb(leaves: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round, (grp, digest) of each group's root) above ``leaves`` (grp, rank, total, digest): a round takes three levels."""

    def run(block: pa.Table) -> pa.Table:
        block, digests, total = _sorted(block)
        root = grow(digests, total)[-1][0][0].decode()
        at = block.column("rank")[0].as_py() >> _BLOCK_BITS
        return pa.Table.from_batches([batch_of(_NODE_SCHEMA, block.column("grp").combine_chunks()[:1], [at], [-(-total // FANOUT**LEVELS)], [root])])

    nodes, rounds, roots = leaves, [], []
    while True:
        rounds.append(nodes)
        roots.append(nodes.where("total = 1").select("grp", "digest"))
        if nodes.where("total > 1").isEmpty():
            break
        blocks = nodes.where("total > 1").select("grp", "rank", "total", "digest", F.shiftright("rank", _BLOCK_BITS).alias("block"))
        nodes = stored(blocks.groupBy("grp", "block").applyInArrow(run, _NODE), f"{label}-round{len(rounds)}")
    root = roots[0]
    for more in roots[1:]:
        root = root.unionByName(more)
    return rounds, root


def _path(levels: list[tuple[list[bytes], list]], k: int) -> tuple[list[int], list[str]]:
    """Slot and siblings of a block's node ``k`` by level."""
    slots, siblings = [], []
    for nodes, _ in levels[:-1]:
        slot = k % FANOUT
        run = nodes[k - slot : k - slot + FANOUT]
        slots.append(slot)
        siblings.append(b"".join(run[:slot] + run[slot + 1 :]).decode())
        k //= FANOUT
    return slots, siblings


def _folded(levels: list[tuple[list[bytes], list]], k: int, node: bytes, above: list[tuple[object, bytes]]) -> str:
    """The root with ``node`` in place of a block's node ``k``: kept states, resumed with the node and what stands to its right."""
    for nodes, states in levels[:-1]:
        state = states[k].copy()
        state.update(b"".join([node, *nodes[k + 1 : k - k % FANOUT + FANOUT]]))
        node = state.hexdigest().encode()
        k //= FANOUT
    for before, right in above:
        state = before.copy()
        state.update(node + right)
        node = state.hexdigest().encode()
    return node.decode()


def fold(digest: Column, slots: Column, siblings: Column) -> Column:
    """The root that follows from a digest and its path alone, as who holds nothing else checks it: siblings to the left, the digest, siblings to the right, level by level."""
    steps = F.arrays_zip(slots.alias("slot"), siblings.alias("others"))
    return F.aggregate(steps, digest, lambda n, s: F.sha2(F.concat(F.left(s["others"], 64 * s["slot"]), n, F.substr(s["others"], 64 * s["slot"] + 1)), 256))


_PATH = "slots array<int>, siblings array<string>, subroot string, root string, folded_root string"


def descend(rounds: list[DataFrame], tops: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(grp, rank, digest, the columns ``keep``, slots, siblings, subroot, root, folded_root) of each leaf of ``rounds``; ``tops``: (grp, slots, siblings, subroot, root) of each group's root.

    ``folded_root`` is worked out from the leaves' column ``changed``, or from the digest if they have none. A block's nodes meet the one path of the node above them.
    """
    found = None
    for k in range(len(rounds) - 1, -1, -1):
        nodes = rounds[k] if "changed" in rounds[k].columns else rounds[k].withColumn("changed", F.col("digest"))
        names = ["grp", "rank", "digest", *(keep if k == 0 else ())]
        fields = [f for f in nodes.schema if f.name in names]
        single = nodes.where("total = 1").join(tops, "grp").withColumn("folded_root", fold(F.col("changed"), F.col("slots"), F.col("siblings")))
        below = single.select(*[f.name for f in fields], "slots", "siblings", "subroot", "root", "folded_root")
        if found is not None:
            blocks = nodes.where("total > 1").withColumn("block", F.shiftright("rank", _BLOCK_BITS))
            above = found.select("grp", F.col("rank").alias("block"), "slots", "siblings", "subroot", "root")
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
            met = blocks.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_paths([f.name for f in fields]), f"{kinds}, {_PATH}")
            below = met.unionByName(below)
        found = stored(below, f"{label}-paths{k}") if k else below
    return found


def _paths(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block's nodes and the path above it: the paths of the nodes, and the roots folded from their changed digests."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        kinds = [block.schema.field(c) for c in names]
        kinds += [("slots", pa.list_(pa.int32())), ("siblings", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string()), ("folded_root", pa.string())]
        schema = pa.schema(kinds)
        if not block.num_rows:
            return schema.empty_table()
        block, digests, total = _sorted(block)
        levels = grow(digests, total)
        top = above.to_pylist()[0]
        up = [(hashlib.sha256(s[: 64 * slot].encode()), s[64 * slot :].encode()) for slot, s in zip(top["slots"], top["siblings"], strict=True)]
        changed = block.column("changed").to_pylist()
        out = []
        for begin in range(0, block.num_rows, _SLICE):
            part = block.slice(begin, _SLICE).combine_chunks()
            nodes = range(begin, begin + part.num_rows)
            paths = [_path(levels, k) for k in nodes]
            folded = [_folded(levels, k, changed[k].encode(), up) for k in nodes]
            ends = [[top[c]] * len(nodes) for c in ("subroot", "root")]
            out.append(batch_of(schema, *[part.column(c).combine_chunks() for c in names], [a + top["slots"] for a, _ in paths], [b + top["siblings"] for _, b in paths], *ends, folded))
        return pa.Table.from_batches(out)

    return run


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "source", replaced: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, group, leaf, slots, siblings, subroot, root, folded_root): a row for each row of ``docs``.

    ``slots`` and ``siblings`` are its proof: by level, up to the root, its place in the run and the digests of the others, from left to right. ``folded_root`` is the root recomputed with the
    leaf that has ``replaced`` values, where ``where`` holds, else with its own. A null value is a mark of its own and differs from the empty text; null keys and groups come first. Rows
    with one key stand in the order of their digests; each repeated row is a leaf. A group of one row has its leaf as subroot, and one group's subroot is the root. An empty table has no row.
    Other columns, whatever their names, are not read.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    changed = F.when(where, leaf_digest([replaced.get(c, F.col(c)) for c in columns])).otherwise(leaf) if replaced else leaf
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # nulls before the empty name
    leaves = docs.select(name.alias("grp"), F.col(key).alias("key"), F.col(group).alias("of"), leaf.alias("digest"), changed.alias("changed"))
    leaves = stored(ranked(leaves, ["key", "digest"], "merkle-leaves"), "merkle-leaves")
    rounds, roots = climb(leaves, "merkle")
    groups = roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    upper, root = climb(stored(ranked(groups, ["name"], "merkle-groups"), "merkle-groups"), "merkle-groups")
    nothing = F.expr("cast(array() as array<int>)").alias("slots"), F.expr("cast(array() as array<string>)").alias("siblings")
    ends = descend(upper, root.select("grp", *nothing, F.col("digest").alias("subroot"), F.col("digest").alias("root")), "merkle-groups", ["name"])
    tops = stored(ends.select(F.col("name").alias("grp"), "slots", "siblings", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    found = descend(rounds, tops, "merkle", ["key", "of"])
    return found.select(F.col("key").alias(key), F.col("of").alias(group), F.col("digest").alias("leaf"), "slots", "siblings", "subroot", "root", "folded_root")
