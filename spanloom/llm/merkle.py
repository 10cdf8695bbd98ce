"""Merkle manifest of a dataset, with nested intervals as labels.

Leaves stand in one order, and every node carries the interval of leaf ranks it
covers. A node's ancestors are those whose intervals contain its own; as all
intervals of a level are cut at multiples of the level's width, each level has
one bucket that can hold the ancestor, and the containment join meets on that
bucket. A node's siblings are the children of its parent whose intervals lie in
what remains of the parent's interval without the node's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import groups_for
from spanloom.operators.scale import join_small
from spanloom.session import written

FAN_OUT = 8
ROWS_PER_RANGE = 250_000
NODE = ("tree", "lo", "hi", "i", "n", "digest")
PATH = "array<struct<left:string,right:string>>"
_LOCAL = (1 << 33) - 1


def tagged(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value: no two lists of values read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[tagged(v) for v in values]), 256)


@dataclass
class Manifest:
    """A tree per group over its leaves, and one tree over the groups' roots.

    `leaves`: a row per row of the dataset, with the carried columns in `row`;
    `levels[k]`: the nodes k + 1 steps above, with their `kids`; `top`: the
    groups' roots as leaves of the upper tree, `upper`: the levels above them.
    All have tree (the rank of the first leaf), the interval lo to hi, the place
    i among the n nodes of tree and level, and the digest.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    top: DataFrame
    upper: list[DataFrame]


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (_none, _group, _order, digest, row) as leaves: groups ascend, null first, rows inside by _order and digest.

    Rows are range-partitioned and sorted once, numbered inside the range by
    their place, and shifted by the counts of the ranges before: no task sees a
    whole group.
    """
    by = [F.col("_none").desc(), "_group", "_order", "digest"]
    ranges = groups_for(rows.count(), ROWS_PER_RANGE)
    placed = written(
        rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ranked"
    ).withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(_LOCAL))})
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    # A row per range, ROWS_PER_RANGE times fewer than leaves; a group's first and last leaf likewise need no sort.
    numbered = join_small(placed, shifts, ["_range"], "_at").withColumn("lo", F.col("_at") + F.col("_shift"))
    groups = written(
        numbered.groupBy("_none", "_group").agg(F.min("lo").alias("tree"), (F.max("lo") - F.min("lo") + 1).alias("n")), "groups"
    )
    return join_small(numbered, groups, ["_none", "_group"], "lo").select(
        "tree", "lo", F.col("lo").alias("hi"), (F.col("lo") - F.col("tree")).alias("i"), "n", "digest", "row",
    )


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Level after level above `nodes` until every tree has one node.

    A node hashes up to eight neighbours; `kids` holds their intervals and digests.
    """
    levels, now = [], nodes
    while not (many := now.filter("n > 1")).isEmpty():
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "i", "digest")))
        now = written(
            many.groupBy("tree", F.floor(F.col("i") / FAN_OUT).alias("i")).agg(F.ceil(F.max("n") / FAN_OUT).alias("n"), kids.alias("kids")).select(
                "tree", F.get("kids", F.lit(0))["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "i", "n",
                F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), "kids",
            ), "level"
        )
        levels.append(now)
    return levels


def built(rows: DataFrame, group: str, order: str, digest: Column, carry: Sequence[str | Column]) -> Manifest:
    """The manifest of `rows`: a leaf per row with the given digest, `carry` kept beside it.

    Leaves ascend by `order` (null first) and digest inside their group, groups
    ascend by code point with null first. Repeated rows are leaves of their own,
    and equal leaves are interchangeable. Columns not carried are left out.
    Without rows there are no nodes and no root.
    """
    flat = rows.select(
        F.col(group).isNull().alias("_none"), F.coalesce(F.col(group), F.lit("")).alias("_group"), F.col(order).alias("_order"),
        digest.alias("digest"), F.struct(*carry).alias("row"),
    )
    leaves = written(ranked(written(flat, "digests")), "leaves")
    levels = grown(leaves.select(*NODE))
    subroots = reduce(DataFrame.union, [x.filter("n = 1").select("tree", "lo", "hi", "digest") for x in (leaves, *levels)])
    everything = Window.partitionBy(F.lit(0))
    top = written(subroots.select(
        F.lit(0).cast("long").alias("tree"), "lo", "hi", (F.row_number().over(everything.orderBy("lo")) - 1).cast("long").alias("i"),
        F.count("*").over(everything).alias("n"), "digest",
    ), "subroots")
    return Manifest(leaves, levels, top, grown(top))


def attached(nodes: DataFrame, parents: DataFrame | None, tops: DataFrame) -> DataFrame:
    """`nodes` with root, subroot and the way there: their siblings' digests, left and right, level by level.

    `parents` have kids and their own way. `tops` (tree, root, subroot, path)
    give it to the only node of a tree.
    """
    shown = ["root", "subroot", "path"]
    alone = nodes.filter("n = 1").join(tops.select("tree", *shown), "tree").select(*nodes.columns, *shown)
    if parents is None:
        return alone
    above = parents.select(
        F.col("tree").alias("_tree"), F.col("i").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.col("kids").alias("_kids"), *shown,
    )
    contained = (F.col("tree") == F.col("_tree")) & (F.floor(F.col("i") / FAN_OUT) == F.col("_bucket")) & (
        F.col("_lo") <= F.col("lo")
    ) & (F.col("hi") <= F.col("_hi"))
    def digests(test):
        return F.array_join(F.transform(F.filter("_kids", test), lambda k: k["digest"]), "")
    step = F.struct(digests(lambda k: k["hi"] < F.col("lo")).alias("left"), digests(lambda k: k["lo"] > F.col("hi")).alias("right"))
    below = nodes.filter("n > 1").join(above, contained).withColumn("path", F.concat(F.array(step), "path"))
    return below.select(*nodes.columns, *shown).union(alone)


def ancestry(leaves: DataFrame, levels: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """`leaves` with root, subroot and path, handed down from the highest level."""
    held = None
    for nodes in reversed([leaves, *levels]):
        held = attached(nodes, None if held is None else written(held, "ways"), tops)
    return held


def proved(manifest: Manifest) -> DataFrame:
    """The leaves with subroot, root and path. A leaf's path is what it takes to compute the root again from its digest."""
    root = (manifest.upper[-1] if manifest.upper else manifest.top).select(
        "tree", F.col("digest").alias("root"), F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"),
    )
    ways = ancestry(manifest.top, manifest.upper, root)
    tops = written(ways.select(F.col("lo").alias("tree"), "root", F.col("digest").alias("subroot"), "path"), "tops")
    return ancestry(manifest.leaves, manifest.levels, tops)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in order, from the leaf's run up to the root's."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
