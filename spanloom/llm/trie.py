"""Prefix trie of conversations by ROLLUP over positional turn ids.

A conversation is cut into blocks of eight turns, a row per block with a column
per position. ROLLUP over these columns aggregates all prefixes of a block at
once, and grouping_id tells how long each is. A block is grouped by the node that
the block before ends at, so long conversations go on in further blocks without
a step per block: that node's id is the XOR of position-salted turn hashes, 128
bits, and follows from the turns alone.

Subtree sums need no walk either. Each node belongs to the least conversation
through it, so a conversation owns the end of its path from some depth on. A
subtree's sum is that of all its members, less what its own least member owns
above it: a second ROLLUP of the members' sums, and a running sum per owner.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import hash128
from spanloom.session import written

WIDTH = 8
#: Turn numbers that are ranked together, and conversation ids that are joined to one piece of text.
TURNS_PER_PART, IDS_PER_PIECE = 1024, 4096
#: A parent with more than a thousandth of all nodes as children is hot: there are at most a thousand such.
HOT_SHARE = 1000
#: Stands for a null conversation id inside; below all others, as null comes first.
NONE = -(2**63)


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, bytes) per turn, places from 1 by turn (null first), ties by the hash of role and text.

    A null role or text is empty, a null conversation is one conversation. The
    texts are left behind. Turn numbers are ranked in ranges that are shifted by
    the counts of the ranges before.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    ids = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv"), F.col("turn").cast("long").alias("_turn"),
        *hash128(F.struct(role, text)), F.octet_length(text).cast("long").alias("bytes"),
    ).withColumn("_part", F.coalesce(F.shiftright("_turn", TURNS_PER_PART.bit_length() - 1), F.lit(NONE)))
    inside = Window.partitionBy("conv", "_part").orderBy("_turn", "h1", "h2", "bytes")
    earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("conv", "_part").agg(F.count("*").alias("_n"))
    shifts = counts.select("conv", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    return ids.withColumn("_at", F.row_number().over(inside)).join(shifts, ["conv", "_part"]).select(
        "conv", (F.col("_at") + F.col("_shift")).alias("place"), "h1", "h2", "bytes",
    )


def _salted(lane: int, place: Column, h1: Column, h2: Column) -> Column:
    return F.xxhash64(F.lit(lane), place.cast("long"), h1, h2)


def blocked(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block: the node it starts from (p1, p2), the XOR of its turns (x1, x2), ids t0 to t7.

    Conversations without turns have an empty first block.
    """
    at = F.col("place") - 1
    cut = turns.withColumns({
        "block": F.floor(at / WIDTH), "_k": (at % WIDTH).cast("int"),
        "_x1": _salted(1, F.col("place"), F.col("h1"), F.col("h2")), "_x2": _salted(2, F.col("place"), F.col("h1"), F.col("h2")),
    })
    parts = [
        F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"_{c}{k}") for k in range(WIDTH) for c in ("h1", "h2", "bytes")
    ]
    grouped = cut.groupBy("conv", "block").agg(F.bit_xor("_x1").alias("x1"), F.bit_xor("_x2").alias("x2"), *parts)
    every = convs.select(F.col("conv").alias("_conv")).distinct().join(grouped, F.col("_conv") == F.col("conv"), "left")
    before = Window.partitionBy("_conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ids = [
        F.when(F.col(f"_h1{k}").isNotNull(), F.struct(*[F.col(f"_{c}{k}").alias(c) for c in ("h1", "h2", "bytes")])).alias(f"t{k}")
        for k in range(WIDTH)
    ]
    return every.select(
        F.col("_conv").alias("conv"), F.coalesce("block", zero).alias("block"),
        *[F.coalesce(F.bit_xor(f"x{lane}").over(before), zero).alias(f"p{lane}") for lane in (1, 2)],
        *[F.coalesce(f"x{lane}", zero).alias(f"x{lane}") for lane in (1, 2)], *ids,
    )


def rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """`aggregates` for every prefix of every block: p1, p2, block, t0 to t7 and `size`, the prefix's turns in this block.

    A prefix past a conversation's end and, after the first block, the empty
    prefix (the last of the block before) are left out.
    """
    turns = [f"t{k}" for k in range(WIDTH)]
    out = blocks.sparkSession.sql(
        f"SELECT p1, p2, block, {', '.join(turns)}, grouping_id() AS _rolled, {aggregates} "
        f"FROM {{blocks}} GROUP BY p1, p2, block, ROLLUP({', '.join(turns)})",
        blocks=blocks,
    ).withColumn("size", F.lit(WIDTH) - F.bit_count("_rolled")).drop("_rolled")
    held = [(F.col("size") == k + 1) & F.col(f"t{k}").isNotNull() for k in range(WIDTH)]
    return out.filter(reduce(lambda a, b: a | b, held, (F.col("size") == 0) & (F.col("block") == 0)))


def _ids(out: DataFrame) -> dict[str, Column]:
    """Of a rolled row: its node (n1, n2), the parent (m1, m2) and the last turn's bytes."""
    found = {}
    for lane in (1, 2):
        salts = [
            F.when(F.col(f"t{k}").isNotNull(), _salted(lane, F.col("block") * WIDTH + k + 1, F.col(f"t{k}.h1"), F.col(f"t{k}.h2")))
            for k in range(WIDTH)
        ]
        node = reduce(lambda a, s: a.bitwiseXOR(F.coalesce(s, F.lit(0))), salts, F.col(f"p{lane}"))
        last = F.coalesce(*reversed(salts), F.lit(0))
        found |= {f"n{lane}": node, f"m{lane}": node.bitwiseXOR(last)}
    return found | {"bytes": F.coalesce(*[F.col(f"t{k}.bytes") for k in reversed(range(WIDTH))], F.lit(0))}


def ends(blocks: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) per node where conversations end: of their decimal ids, ascending, comma-joined.

    Ids are joined in pieces first. A node's pieces come sorted and are hashed as
    they pass, so a node may have any number of members.
    """
    last = blocks.groupBy("conv").agg(F.bit_xor("x1").alias("n1"), F.bit_xor("x2").alias("n2"))
    shown = lambda c: F.when(c == NONE, "").otherwise(c.cast("string"))
    pieces = last.groupBy("n1", "n2", F.shiftright("conv", IDS_PER_PIECE.bit_length() - 1).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), shown), ",").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for n1, n2, ids in zip(*[batch.column(c).to_pylist() for c in ("n1", "n2", "ids")]):
                if (n1, n2) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (n1, n2), sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield _batch(done)
                done = []
        if node:
            yield _batch([*done, (*node, state.hexdigest())])

    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece").select("n1", "n2", "ids").mapInArrow(
        hashed, "n1 long, n2 long, ends_sha256 string"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["n1", "n2", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of `turns` (conv, place, h1, h2, bytes; see `numbered`), with the root.

    Per node: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (see the columns' sums in the module's
    text: (n_convs - 1) x bytes of the last turn, over the subtree), ends_sha256,
    and its id node_1, node_2. `convs` (conv) names all conversations, those
    without turns too. No conversations give no nodes. A null conversation id
    is shown as null, and as an empty text in the digest of ends.
    """
    blocks = written(blocked(turns, convs), "blocks")
    first = rolled(blocks, "count(*) AS n_convs, min(conv) AS conv")
    nodes = written(first.select(
        *[c.alias(n) for n, c in _ids(first).items()], (F.col("block") * WIDTH + F.col("size")).alias("depth"), "conv", "n_convs",
    ).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("m1").alias("n1"), F.col("m2").alias("n2")).agg(F.count("*").alias("n_children"))
    above = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    valued = written(nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn(
        "leaf", (F.col("n_children") == 0).cast("long")
    ).withColumns({f"{c}_above": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("saved", "leaf")}), "valued")
    owned = valued.groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    second = rolled(
        blocks.join(owned, "conv", "left"), "sum(coalesce(saved, 0)) AS all_saved, sum(coalesce(leaves, 0)) AS all_leaves"
    )
    own = _ids(second)
    sums = second.select(own["n1"].alias("n1"), own["n2"].alias("n2"), "all_saved", "all_leaves")
    total = valued.count()
    parents = valued.filter("n_children > 0").select(
        F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("conv").alias("parent"), "n_children"
    )
    is_hot = F.col("n_children") > max(HOT_SHARE, total // HOT_SHARE)
    hot = parents.filter(is_hot).select("m1", "m2", F.col("parent").alias("hot"))
    cold = parents.filter(~is_hot).select("m1", "m2", "parent")
    # At most a thousand rows by their definition. A child of a hot parent asks for its own node instead, to no effect.
    split = valued.join(F.broadcast(hot), ["m1", "m2"], "left").withColumns({
        f"m{k}": F.when(F.col("hot").isNull(), F.col(f"m{k}")).otherwise(F.col(f"n{k}")) for k in (1, 2)
    })
    named = split.join(cold, ["m1", "m2"], "left").drop("m1", "m2")
    nothing = sha256(b"").hexdigest()
    shown = lambda c: F.when(c != NONE, c)
    return named.join(sums, ["n1", "n2"]).join(ends(blocks), ["n1", "n2"], "left").select(
        shown(F.col("conv")).alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, shown(F.coalesce("hot", "parent"))).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("all_leaves") - F.col("leaf_above")).alias("n_leaves"), (F.col("all_saved") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), F.col("n1").alias("node_1"), F.col("n2").alias("node_2"),
    )
