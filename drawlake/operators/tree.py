"""Hierarchies as edge tables ``nodes(tree, node, parent, divt)``: leaves above 0, internal nodes below 0, root's parent 0.

Most questions go through a tour that enters and leaves every node once: sums along it, found by pointer doubling, give
places, depths, leaves below and sums along paths, with two rows a node and log2(nodes) rounds, whatever the depth. The table of
all ancestors grows with nodes times depth and is for those who ask for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.functions.numeric import EULER
from drawlake.operators.pairing import MOST_ROWS
from drawlake.sources.tables import written

#: Children of a node of the table of minima.
FAN = 32


def _written(df: DataFrame) -> DataFrame:
    return written(df, "tree")


def _side(df: DataFrame) -> DataFrame:
    """``df`` as the right side of a join: broadcast by its rows, as written files are far smaller than what they hold."""
    few = df.select("tree").limit(MOST_ROWS + 1).count() <= MOST_ROWS
    return F.broadcast(df) if few else df.hint("merge")


def tour(nodes: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """``(tree, node, parent, divt, place, depth, size, leaves, ...)`` of each node.

    ``place`` numbers the nodes of a tree in the order in which a tour enters them, from the last (1) to the root;
    ``depth`` counts a node's ancestors, ``size`` and ``leaves`` the nodes and leaves of its subtree, itself included.
    ``sums`` adds, by name, the sum of a column of ``nodes`` over the path from the root to each node, both included.
    """
    sums = sums or {}
    own = nodes.select("tree", "node", "parent", *[c.alias(n) for n, c in sums.items()])
    first = own.where("parent <> 0").groupBy("tree", F.col("parent").alias("node")).agg(F.min("node").alias("_first"))
    own = own.withColumn("_next", F.lead("node").over(Window.partitionBy("tree", "parent").orderBy("node"))).join(_side(first), ["tree", "node"], "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    node = F.col("node").cast("long")
    # entering a node has an even number, leaving it the odd one above
    enter = own.select("tree", (2 * node).alias("arc"), F.coalesce(2 * F.col("_first"), 2 * node + 1).cast("long").alias("to"), one.alias("place"), one.alias("depth"), (F.col("node") > 0).cast("long").alias("leaves"), *sums)
    after = F.when(F.col("_next").isNotNull(), 2 * F.col("_next")).when(F.col("parent") != 0, 2 * F.col("parent") + 1).cast("long")
    leave = own.select("tree", (2 * node + 1).alias("arc"), after.alias("to"), none.alias("place"), (-one).alias("depth"), none.alias("leaves"), *[(-F.col(n)).alias(n) for n in sums])
    names = ["place", "depth", "leaves", *sums]
    arcs = _written(enter.unionByName(leave))
    few = arcs.limit(MOST_ROWS + 1).count() <= MOST_ROWS  # each round has as many
    while not arcs.where("to is not null").isEmpty():
        there = arcs.select("tree", F.col("arc").alias("to"), F.col("to").alias("_to"), *[F.col(n).alias(f"_{n}") for n in names])
        arcs = _written(arcs.join(F.broadcast(there) if few else there.hint("merge"), ["tree", "to"], "left").select("tree", "arc", F.col("_to").alias("to"), *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]))
    inside = F.pmod("arc", F.lit(2)) == 0
    value = lambda n, entered: F.max(F.when(inside == entered, F.col(n)))
    at = arcs.groupBy("tree", F.floor(F.col("arc") / 2).alias("node")).agg(value("place", True).alias("place"), (-value("depth", True)).alias("depth"), (value("place", True) - value("place", False)).alias("size"), (value("leaves", True) - value("leaves", False)).alias("leaves"), *[(-value(n, True)).alias(f"_{n}") for n in sums])
    kept = nodes.select("tree", "node", "parent", "divt", *[c.alias(n) for n, c in sums.items()])
    out = kept.join(F.broadcast(at) if few else at.hint("merge"), ["tree", "node"])
    return out.select("tree", "node", "parent", "divt", "place", "depth", "size", "leaves", *[(F.col(f"_{n}") + F.col(n)).alias(n) for n in sums])


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(tree, node, ancestor, hops)`` for all nodes, by pointer doubling: log2(depth) rounds, each written out."""
    closure = nodes.where("parent <> 0").select("tree", "node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("hops"))
    closure, reach = _written(closure), 1
    while True:
        top = closure.select("tree", F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("hops").alias("more"))
        longer = closure.where(F.col("hops") == reach).join(top, ["tree", "ancestor"]).select("tree", "node", F.col("above").alias("ancestor"), (F.col("hops") + F.col("more")).alias("hops"))
        longer = _written(longer)
        if longer.isEmpty():
            return closure
        closure, reach = _written(closure.unionByName(longer)), reach * 2


def node_table(tours: DataFrame) -> DataFrame:
    """Internal nodes with their number of children and of leaves below, and the leaves below each child, in order of their numbers."""
    each = F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), "leaves")))
    return tours.where("parent <> 0").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), each.alias("by_child"))


def invalid_trees(nodes: DataFrame) -> DataFrame:
    """Trees that have not one root, or internal nodes without two children."""
    children = nodes.where("parent <> 0").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    odd = nodes.where("node < 0").join(children, ["tree", "node"], "left").where("n is null or n <> 2").select("tree")
    roots = nodes.groupBy("tree").agg(F.sum((F.col("parent") == 0).cast("int")).alias("r")).where("r <> 1").select("tree")
    return odd.union(roots).distinct()


def leaf_depths(tours: DataFrame) -> DataFrame:
    """Number of internal ancestors of each leaf, the root included."""
    return tours.where("node > 0").select("tree", F.col("node").alias("leaf"), "depth")


def depth_summary(depths: DataFrame) -> DataFrame:
    """Average and largest depth of the leaves of each tree."""
    return depths.groupBy("tree").agg(F.avg("depth").alias("average"), F.max("depth").alias("deepest"))


def divergence_summary(nodes: DataFrame, k: int) -> DataFrame:
    """Mean divergence time and the k earliest of each tree."""
    inner = nodes.where("node < 0")
    w = Window.partitionBy("tree").orderBy("divt", "node")
    first = inner.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("tree").agg(F.sort_array(F.collect_list("divt")).alias("earliest"))
    return inner.groupBy("tree").agg(F.avg("divt").alias("mean_divt")).join(first, "tree")


def _minima(tours: DataFrame) -> tuple[DataFrame, int]:
    """The least (depth, parent) of places cell * FAN**level on, FAN**level of them, and the number of levels."""
    rows = tours.select("tree", F.lit(0).alias("level"), F.col("place").alias("cell"), F.struct("depth", "parent").alias("least"))
    found, most, level = [rows], tours.agg(F.max("place")).first()[0] or 0, 0
    while most >= 2 * FAN:
        most, level = most // FAN, level + 1
        rows = rows.groupBy("tree", F.floor(F.col("cell") / FAN).alias("cell")).agg(F.min("least").alias("least")).select("tree", F.lit(level).alias("level"), "cell", "least")
        found.append(rows)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out, level + 1


def _cells(low: Column, high: Column, levels: int) -> Column:
    """(level, cell) of the cells that make up the places ``low`` to ``high``: whole larger ones in the middle, smaller ones at both ends."""
    empty = F.array().cast("array<struct<level:int,cell:bigint>>")
    first = lambda level: F.ceil(low / FAN**level).cast("long")  # noqa: E731  the first whole cell
    behind = lambda level: F.floor((high + 1) / FAN**level).cast("long")  # noqa: E731  the cell after the last whole one

    def cells(level: int, a: Column, b: Column) -> Column:
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))).otherwise(empty)

    parts = []
    for level in range(levels - 1):
        inner = first(level + 1) < behind(level + 1)
        parts.append(cells(level, first(level), F.when(inner, first(level + 1) * FAN - 1).otherwise(behind(level) - 1)))
        parts.append(F.when(inner, cells(level, behind(level + 1) * FAN, behind(level) - 1)).otherwise(empty))
    parts.append(cells(levels - 1, first(levels - 1), behind(levels - 1) - 1))
    return F.concat(*parts)


def common_ancestor(pairs: DataFrame, tours: DataFrame) -> DataFrame:
    """Time of the last common ancestor of each requested (tree, a, b); 1 if a is b.

    Of the nodes that the tour enters behind the first of the two, up to the second, one of the least depth is a child of
    the ancestor. Minima of ranges of places are kept by cells of ``FAN``, of ``FAN`` cells, and so on: in all little more
    than a row a node, and some dozen rows a pair.
    """
    place = lambda n: tours.select("tree", F.col("node").alias(n), F.col("place").alias(f"_{n}"))
    tours = _written(tours)
    minima, levels = _minima(tours)
    both = pairs.where("a <> b").select("tree", "a", "b").distinct().join(_side(place("a")), ["tree", "a"]).join(_side(place("b")), ["tree", "b"])
    both = both.withColumn("_low", F.least("_a", "_b")).withColumn("_high", F.greatest("_a", "_b") - 1)
    asked = both.select("tree", "a", "b", F.explode(_cells(F.col("_low"), F.col("_high"), levels)).alias("_c")).select("tree", "a", "b", "_c.level", "_c.cell")
    top = asked.join(_side(minima), ["tree", "level", "cell"]).groupBy("tree", "a", "b").agg(F.min("least").alias("_t")).select("tree", "a", "b", F.col("_t.parent").alias("node"))
    found = top.join(_side(tours.select("tree", "node", "divt")), ["tree", "node"])
    return found.select("tree", "a", "b", "divt").unionByName(pairs.where("a = b").select("tree", "a", "b", F.lit(1.0).alias("divt")).distinct())


def triples(asked: DataFrame, tours: DataFrame) -> DataFrame:
    """Whether a and b (of (tree, a, b, c)) have a strictly later common ancestor than a and c."""
    every = asked.select("tree", "a", "b").union(asked.select("tree", "a", F.col("c").alias("b"))).distinct()
    times = _written(common_ancestor(every, tours))
    one, two = (times.select("tree", "a", F.col("b").alias(n), F.col("divt").alias(t)) for n, t in (("b", "ab"), ("c", "ac")))
    return asked.join(_side(one), ["tree", "a", "b"]).join(_side(two), ["tree", "a", "c"]).select("tree", "a", "b", "c", (F.col("ab") > F.col("ac")).alias("closer"))


def cut(nodes: DataFrame, time: float) -> DataFrame:
    """Clusters of leaves: the earliest ancestor that diverged after ``time``, or the leaf itself.

    A path from the root passes one top of a cluster only, so the sum of the tops' numbers along it names the leaf's.
    """
    above = nodes.select("tree", F.col("node").alias("parent"), F.col("divt").alias("_up"))
    late = (F.col("node") > 0) | (F.col("divt") > time)
    marked = nodes.join(_side(above), ["tree", "parent"], "left").withColumn("_top", F.when(late & (F.coalesce("_up", F.lit(float("-inf"))) <= time), F.col("node")).otherwise(0).cast("long"))
    return tour(marked, {"cluster": F.col("_top")}).where("node > 0").select("tree", F.col("node").alias("leaf"), "cluster")


def divergence_rate(t: Column, c0: float, c1: float, c2: float) -> Column:
    return c0 + c1 / (1 - t) + c2 / (1 - t) ** 2


def cumulative_divergence(t: Column, c0: float, c1: float, c2: float) -> Column:
    return c0 * t - c1 * F.log(1 - t) + c2 * (1 / (1 - t) - 1)


def inverse_divergence(e: Column, c0: float, c1: float, c2: float) -> Column:
    """Time at which the cumulative function is e: closed forms for one term, else bisection."""
    if c1 == c2 == 0:
        return e / c0
    if c0 == c2 == 0:
        return 1 - F.exp(-e / c1)
    if c0 == c1 == 0:
        return 1 - 1 / (1 + e / c2)

    @F.pandas_udf(T.DoubleType())
    def bisect(x: pd.Series) -> pd.Series:
        import numpy as np

        lo, hi = np.zeros(len(x)), np.ones(len(x))
        for _ in range(40):
            t = (lo + hi) / 2
            low = c0 * t - c1 * np.log1p(-t) + c2 * (1 / (1 - t) - 1) < x.to_numpy()
            lo, hi = np.where(low, t, lo), np.where(low, hi, t)
        return pd.Series((lo + hi) / 2)

    return bisect(e)


#: Harmonic numbers up to which a table is used.
_TABLE = 64


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; from ``_TABLE`` on by an expansion that is right to 14 places."""
    held, table = 0.0, [0.0]
    for i in range(1, _TABLE):
        held += 1 / i
        table.append(held)
    small = F.get(F.array(*map(F.lit, table)), F.least(n, F.lit(_TABLE - 1)).cast("int"))
    return F.when(n < _TABLE, small).otherwise(F.log(n) + EULER + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4))


def divergence_log_prob(tours: DataFrame, c0: float, c1: float, c2: float) -> DataFrame:
    """Sum over internal nodes of log a(t) - H(n - 1) (A(t) - A(parent's t)); a term with no time passed is 0."""
    up = tours.select("tree", F.col("node").alias("parent"), F.col("divt").alias("t0"))
    rows = tours.where("node < 0").join(_side(up), ["tree", "parent"], "left").withColumn("t0", F.coalesce("t0", F.lit(0.0)))
    t = F.col("divt")
    passed = cumulative_divergence(t, c0, c1, c2) - cumulative_divergence(F.col("t0"), c0, c1, c2)
    term = F.log(divergence_rate(t, c0, c1, c2)) - harmonic(F.col("leaves") - 1) * passed
    return rows.groupBy("tree").agg(F.sum(F.when(t == F.col("t0"), 0.0).otherwise(term)).alias("log_prob"))


def path_log_prob(nodes: DataFrame, tours: DataFrame) -> DataFrame:
    """log probability of following the path from the root to each leaf, children chosen by their leaves."""
    above = tours.select("tree", F.col("node").alias("parent"), F.col("leaves").alias("_m"))
    steps = tours.join(_side(above), ["tree", "parent"], "left").withColumn("_l", F.coalesce(F.log(F.col("leaves") / F.col("_m")), F.lit(0.0)))
    return tour(steps, {"log_prob": F.col("_l")}).where("node > 0").select("tree", F.col("node").alias("leaf"), "log_prob")
