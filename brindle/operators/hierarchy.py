"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

The trees are walked from the roots by frontier joins. In a round of stride s all
levels below s have been reached; one join of that frontier with the rows still
open, each linked to its ancestor s levels up, reaches levels s to 2s - 1 and
extends their paths. A second join doubles the stride of what is still open. So a
tree of depth d takes log2(d) rounds, not d jobs. The join key is (group, node): a
group that holds a third of all rows is spread like any other. Every round writes
its rows to the shared folder, and the open part shrinks from round to round.

Nodes that no round reaches lie on a cycle or under one. Following their links in
ever longer strides, the set of nodes arrived at shrinks to exactly the nodes on
cycles, those met again and again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.scratch import Scratch

STATES = ("tree", "cycle", "under_cycle")


def distinct_nodes(rows: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """One row (g, n, p) for each node: repeated rows count once.

    Rows without a group or node id are no nodes and are left out. Of two rows of
    one node that name different parents the smaller parent holds; a named parent
    goes before a null one.
    """
    return (
        rows.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(parent).alias("p"))
        .where(F.col("g").isNotNull() & F.col("n").isNotNull())
        .groupBy("g", "n")
        .agg(F.min("p").alias("p"))
    )


def _double(jumps: DataFrame) -> DataFrame:
    """Links twice as long, for nodes whose link ends at a node that has one; `seg` is the path below the end."""
    upper = jumps.select("g", F.col("n").alias("far"), F.col("far").alias("farther"), F.col("seg").alias("upper"))
    return jumps.where("root is null").join(upper, ["g", "far"]).select(
        "g", "n", "p", "inner", F.col("farther").alias("far"), F.concat_ws("/", "upper", "seg").alias("seg")
    )


def _on_cycles(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(g, n) of the nodes on cycles, among nodes of which every one is linked to one of them.

    Links of stride s lead to a set that always holds the cycles; once twice the
    stride leads to as many nodes, nothing but cycles is left.
    """
    jumps = links.select("g", "n", "far")
    image = scratch.keep(jumps.select("g", F.col("far").alias("n")).distinct())
    size = image.count()
    while True:
        hop = jumps.select("g", F.col("n").alias("far"), F.col("far").alias("farther"))
        jumps = scratch.keep(jumps.join(hop, ["g", "far"]).select("g", "n", F.col("farther").alias("far")))
        image = scratch.keep(jumps.select("g", F.col("far").alias("n")).distinct())
        now = image.count()
        if now == size:
            return image
        size = now


def hierarchies(rows: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(g, n, p, root, depth, path, state) of every node.

    A root has a null parent or one that doesn't exist in its group; its depth is 0
    and its path its own id. Nodes on a cycle (a node that is its own parent is one)
    have state `cycle`, nodes below them `under_cycle`; both have root and depth -1
    and an empty path. An empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "hierarchy")
    nodes = distinct_nodes(rows, group, node, parent)
    parents = nodes.where(F.col("p").isNotNull()).select("g", F.col("p").alias("n")).distinct().withColumn("inner", F.lit(True))
    nodes = scratch.keep(
        nodes.join(parents, ["g", "n"], "left").select("g", "n", "p", F.col("inner").isNotNull().alias("inner"))
    )
    known = nodes.where("inner").select("g", F.col("n").alias("p"), F.lit(True).alias("known"))
    linked = scratch.keep(nodes.join(known, ["g", "p"], "left"))
    front = linked.where("known is null").select(
        "g", "n", "p", F.col("n").alias("root"), F.lit(0).alias("depth"), F.col("n").cast("string").alias("path"), "inner"
    )
    reached = [front]
    jumps = linked.where("known").select(
        "g", "n", "p", "inner", F.col("p").alias("far"), F.col("n").cast("string").alias("seg")
    )
    stride = 1
    while True:
        inner = reduce(DataFrame.unionByName, reached).where("inner")
        starts = inner.select("g", F.col("n").alias("far"), "root", F.col("depth").alias("above"), "path")
        # One join tells the rows reached in this round from those still open.
        step = scratch.keep(jumps.join(starts, ["g", "far"], "left"))
        new = step.where(F.col("root").isNotNull()).select(
            "g", "n", "p", "root",
            (F.col("above") + stride).alias("depth"),
            F.concat_ws("/", "path", "seg").alias("path"),
            "inner",
        )
        if not new.take(1):
            break
        reached.append(new)
        jumps = scratch.keep(_double(step))
        stride *= 2
    tree = reduce(DataFrame.unionByName, reached).select(
        "g", "n", "p", "root", "depth", "path", F.lit("tree").alias("state")
    )
    rest = step
    if not rest.take(1):
        return tree
    cyclic = _on_cycles(scratch, rest).withColumn("hit", F.lit(True))
    rest = rest.join(cyclic, ["g", "n"], "left").select(
        "g", "n", "p",
        F.lit(-1).cast(nodes.schema["n"].dataType).alias("root"),
        F.lit(-1).alias("depth"),
        F.lit("").alias("path"),
        F.when(F.col("hit"), "cycle").otherwise("under_cycle").alias("state"),
    )
    return tree.unionByName(rest)


def ancestor_pairs(tree: DataFrame, id_type: str = "int") -> DataFrame:
    """(g, ancestor, descendant, distance) of every pair in the trees, from the paths.

    Each node has as many pairs as its depth, taken from its own path: no pairs
    are made within a group. Nodes of cycles have none.
    """
    steps = F.split("path", "/")
    return (
        tree.where(F.col("state") == "tree")
        .select("g", F.col("n").alias("descendant"), "depth", F.posexplode(F.slice(steps, 1, F.col("depth"))))
        .select("g", F.col("col").cast(id_type).alias("ancestor"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )


def descendant_counts(tree: DataFrame, id_type: str = "int") -> DataFrame:
    """(g, n, descendants, height) of every node of a tree; leaves have 0 and 0."""
    pairs = ancestor_pairs(tree, id_type)
    counts = pairs.groupBy("g", F.col("ancestor").alias("n")).agg(
        F.count("*").alias("descendants"), F.max("distance").alias("height")
    )
    zero: Column = F.lit(0)
    return (
        tree.where(F.col("state") == "tree")
        .select("g", "n")
        .join(counts, ["g", "n"], "left")
        .select("g", "n", F.coalesce("descendants", zero.cast("long")).alias("descendants"), F.coalesce("height", zero).alias("height"))
    )
