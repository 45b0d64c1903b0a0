"""Connected components of an edge table by repeated contraction; every step is a join or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst; bigint): root is the smallest node reachable.

    Each round hooks a node to its smallest neighbour, follows the pointers twice and renames the edges' ends; edges inside a class vanish.
    A node that isn't the smallest among its neighbours is hooked to a smaller one, so that the graph shrinks until no edge is left.
    Rows with a null end and loops are left out. Groupings are minima, which are combined before the shuffle; joins are on unique keys and are split if skewed.
    """
    edges = stored(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{label}-edges")
    roots = None
    round_no = 0
    while not edges.isEmpty():
        round_no += 1
        ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("node"), F.col("src").alias("next")))))
        hooks = stored(ends.groupBy("node").agg(F.min("next").alias("root")).select("node", F.least("node", "root").alias("root")), f"{label}-hooks{round_no}")
        step = _renamed(hooks, hooks, "root")
        step = stored(_renamed(step, step, "root"), f"{label}-jumps{round_no}")
        roots = step if roots is None else stored(_renamed(roots, step, "root").unionByName(step.join(roots.select("node"), "node", "left_anti")), f"{label}-roots{round_no}")
        left = _renamed(_renamed(edges, step, "src"), step, "dst").where("src <> dst")
        edges = stored(left.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{label}-edges{round_no}")
    if roots is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots


def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root in ``names``; unchanged where it has none."""
    to = names.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rest = [c for c in df.columns if c != column]
    return df.join(to, df[column] == to["_node"], "left").select(*rest, F.coalesce("_root", column).alias(column)).select(df.columns)
