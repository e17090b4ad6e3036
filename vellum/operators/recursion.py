"""Inheritance and nesting, by joins that double their reach.

Each round joins a stored table of jumps with itself, so a chain of n links
takes about log2(n) rounds whatever the number of rows is, and no round holds
more than the rows of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import tables

#: Levels that a chain can have.
DEPTH = 32


def _jumps(df: DataFrame, by: list[str], node: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Every node once, and its first jump: (by, n, to) where the parent is
    another node that is there. Of a node that stands several times the least
    parent counts."""
    nodes = df.select(*by, F.col(node).cast("long").alias("n"), F.col(parent).cast("long").alias("to"))
    nodes = tables.stored(nodes.where(F.col("n").isNotNull()).groupBy(*by, "n").agg(F.min("to").alias("to")), "nodes")
    there = nodes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__n"))
    jumps = nodes.where(F.col("to") != F.col("n")).join(there, [*_same(by), F.col("to") == F.col("__n")], "left_semi")
    return nodes, tables.stored(jumps, "jumps")


def _same(by: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]


def _behind(df: DataFrame, by: list[str], node: str) -> DataFrame:
    """``df`` with its keys marked, to be joined to where a jump leads."""
    return df.withColumnsRenamed({**{c: f"__{c}" for c in by}, node: "__n"})


def _longer(jumps: DataFrame, by: list[str]) -> DataFrame:
    """Jumps of twice the length."""
    more = _behind(jumps, by, "n").withColumnRenamed("to", "__to")
    return jumps.join(more, [*_same(by), F.col("to") == F.col("__n")]).select(*by, "n", F.col("__to").alias("to"))


def chains(df: DataFrame, by: list[str], node: str, parent: str, depth: int = DEPTH) -> DataFrame:
    """(by, node, ancestor, distance): every node with itself and all its
    ancestors up to ``depth`` links away. A chain ends at a null or missing
    parent, at a node that is its own parent, and where it would come back to a
    node it has. Rows without a node are left out."""
    nodes, jumps = _jumps(df, by, node, parent)
    reach = nodes.select(*by, F.col("n").alias("node"), F.col("n").alias("ancestor"), F.lit(0).alias("distance"))
    for k in range(math.ceil(math.log2(depth + 1))):
        if jumps.isEmpty():
            break
        step = _behind(reach, by, "node").withColumnsRenamed({"ancestor": "__ancestor", "distance": "__distance"})
        met = jumps.join(step, [*_same(by), F.col("to") == F.col("__n")])
        met = met.select(*by, F.col("n").alias("node"), F.col("__ancestor").alias("ancestor"), (F.col("__distance") + (1 << k)).alias("distance"))
        past, reach = reach, tables.stored(reach.unionByName(met), "reach")
        used, jumps = jumps, tables.stored(_longer(jumps, by), "jumps")
        tables.drop(past, used)
    out = reach.where(F.col("distance") <= depth).groupBy(*by, "node", "ancestor").agg(F.min("distance").alias("distance"))
    return out.select(*by, "node", "ancestor", "distance")


def inherit(styles: DataFrame, by: list[str], node: str, parent: str, props: list[str], depth: int = DEPTH) -> DataFrame:
    """Each style with the nearest value that is not null of every property
    along its chain, ``depth`` links or more. The table keeps its size: a round
    fills what is missing from where the jumps lead."""
    nodes, jumps = _jumps(styles, by, node, parent)
    values = styles.select(*by, F.col(node).cast("long").alias(node), *props).where(F.col(node).isNotNull())
    values = values.groupBy(*by, node).agg(*(F.first(p, ignorenulls=True).alias(p) for p in props))
    for _ in range(math.ceil(math.log2(depth + 1))):
        if jumps.isEmpty():
            break
        far = _behind(values, by, node).withColumnsRenamed({p: f"__v_{p}" for p in props})
        found = jumps.join(far, [*_same(by), F.col("to") == F.col("__n")]).select(*by, F.col("n").alias(node), *[f"__v_{p}" for p in props])
        on = [values[c].eqNullSafe(found[c]) for c in [*by, node]]
        past = values
        values = tables.stored(values.join(found, on, "left").select(*[values[c] for c in [*by, node]], *[F.coalesce(values[p], found[f"__v_{p}"]).alias(p) for p in props]), "inherited")
        used, jumps = jumps, tables.stored(_longer(jumps, by), "jumps")
        tables.drop(past, used)
    tables.drop(nodes)
    return values


def nested_boxes(boxes: DataFrame, by: list[str], depth: int = DEPTH) -> DataFrame:
    """Boxes of nested groups in the outermost coordinates.

    Columns: id, parent, the box in its parent's coordinates (x, y, w, h) and,
    for groups, the inner coordinates of their own (gx, gy, gw, gh). A child's
    place is scaled by box over inner size, cut towards zero at each level; a
    group of inner size zero leaves its children as they are. Boxes whose chain
    doesn't end at one without a parent, within ``depth`` groups, are left out.

    Each group's chain of groups, ``depth`` at most, is gathered and folded
    from the outside in; boxes then take one step from their own group.
    """
    cols = ("x", "y", "w", "h", "gx", "gy", "gw", "gh")
    keyed = boxes.withColumns({"id": F.col("id").cast("long"), "parent": F.col("parent").cast("long")})
    inner = keyed.join(_behind(keyed.where(F.col("parent").isNotNull()).select(*by, "parent").distinct(), by, "parent"), [*_same(by), F.col("id") == F.col("__n")], "left_semi")
    inner = tables.stored(inner, "groups")
    own = inner.groupBy(*by, "id").agg(F.first(F.struct("parent", *cols)).alias("box"))
    chain = chains(inner, by, "id", "parent", depth)
    met = chain.join(_behind(own, by, "id"), [*_same(by), F.col("ancestor") == F.col("__n")])
    path = met.groupBy(*by, "node").agg(F.sort_array(F.collect_list(F.struct("distance", "box")), asc=False).alias("__chain"))
    path = path.where(F.col("__chain")[0]["box"]["parent"].isNull())

    def placed(t: Column, b) -> list[Column]:
        """A box b inside the placed group t."""
        flat = (t["gw"] == 0) | (t["gh"] == 0)
        cut = lambda n, d: F.call_function("div", n, F.when(d != 0, d))
        move = lambda v, o, g, s, p: F.when(flat, b[v]).otherwise(t[p] + cut((b[v] - t[o]) * t[s], t[g]))
        size = lambda v, g, s: F.when(flat, b[v]).otherwise(cut(b[v] * t[s], t[g]))
        return [move("x", "gx", "gw", "w", "x"), move("y", "gy", "gh", "h", "y"), size("w", "gw", "w"), size("h", "gh", "h")]

    as_long = lambda b: F.struct(*[b[c].cast("long").alias(c) for c in cols])

    def step(t: Column, entry: Column) -> Column:
        b = entry["box"]
        return F.struct(*[v.cast("long").alias(c) for c, v in zip(cols, placed(t, b))], *[b[c].cast("long").alias(c) for c in cols[4:]])

    folded = F.aggregate(F.slice("__chain", 2, depth + 1), as_long(F.col("__chain")[0]["box"]), step)
    groups = tables.stored(path.select(*by, F.col("node"), folded.alias("__t"), F.size("__chain").alias("__level")), "placed")
    groups = _behind(groups, by, "node")
    inside = keyed.join(groups, [*_same(by), F.col("parent") == F.col("__n")])
    b = {c: F.col(c) for c in cols}
    moved = inside.select(*by, "id", F.col("__level").alias("level"), *[v.cast("long").alias(c) for c, v in zip(cols, placed(F.col("__t"), b))])
    top = keyed.where(F.col("parent").isNull()).select(*by, "id", F.lit(0).alias("level"), *[F.col(c).cast("long").alias(c) for c in cols[:4]])
    return top.unionByName(moved.where(F.col("level") <= depth))
