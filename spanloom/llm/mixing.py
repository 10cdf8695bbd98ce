"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, passes after the
first shuffled anew. Documents are cut into packets of a few hundred words. A
packet's virtual finish time is the number of words its source has queued up to
its end, divided by the source's target, so that all sources reach their target
at virtual time 1. The packets of all sources are sorted by virtual finish time
and cut where the total budget is spent.

In virtual time all sources together send words at an even rate. Equal slices of
it hold about equally many words, so the global sort needs no sampled bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import groups_for, words
from spanloom.operators.scale import join_small
from spanloom.session import written

PACKET_WORDS = 256
ROWS_PER_GROUP = 10_000
#: Copies of a repeated row that are listed at a time.
COPIES = 1024
#: A source that is null, and its name: equal for rows of one source, nulls included.
SOURCE = ("_none", "_name")


def _sequence(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)


def cycled(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """`sizes` with a weight per source: the given ones in turn, sources by code point, null last. One row per source in one task."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))


def targets(sizes: DataFrame, share: float, most: int) -> DataFrame:
    """`sizes` (source, source_size, weight > 0) with each source's target.

    The targets add up to `share` of all sizes and are in the ratio of the
    weights, but none exceeds `most` times its source's size: what is above goes
    to the others by weight. Sources are filled up in the order of size to
    weight, so those that overflow come first. One row per source in one task.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = sizes.withColumn("_cap", F.col("source_size") * most).select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("_budget"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_used"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_left"),
    ).withColumn("_full", F.col("_cap") * F.col("_left") <= (F.col("_budget") - F.col("_used")) * F.col("weight"))
    level = F.min(F.when(~F.col("_full"), F.struct("_used", ((F.col("_budget") - F.col("_used")) / F.col("_left")).alias("level"))))
    return filled.withColumn("_level", level.over(everything)["level"]).select(
        *sizes.columns, F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("weight")).alias("target"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): equal rows together. A null text has no words."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")).groupBy(
        "doc_id", "source", "size"
    ).agg(F.count("*").alias("copies"))


def queued(rows: DataFrame, goals: DataFrame, most: int, seed: int, packet: int) -> DataFrame:
    """The packets up to virtual time 1, when a source has sent its target; the last of each ends there.

    Rows of a source are put in order by a hash, in runs that are summed on their
    own and shifted by the runs before, so a source may have any share of the rows.
    """
    runs = groups_for(rows.count(), ROWS_PER_GROUP)
    shown = rows.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    known = goals.select(
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), "source_size", "target",
    ).filter("target > 0")
    passes = F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(most))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = join_small(shown.filter("size > 0"), known, SOURCE, "doc_id").withColumn(
        "round", F.explode(_sequence(passes))
    ).withColumn("_key", key).withColumn(
        "_run", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * runs / F.lit(1 << 32))
    ).withColumn("_words", F.col("size") * F.col("copies"))
    run = [*SOURCE, "round", "_run"]
    inside = Window.partitionBy(*run).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*SOURCE).orderBy("round", "_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*run).agg(F.sum("_words").alias("_total"))
    shifts = totals.select(*run, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    placed = dealt.withColumn("_at", F.coalesce(F.sum("_words").over(inside), F.lit(0))).join(shifts, run).withColumn(
        "_at", F.col("_at") + F.col("_shift")
    ).filter("_at < target")
    copies = placed.withColumn("_block", F.explode(_sequence(F.ceil(F.col("copies") / COPIES)))).withColumn(
        "copy", F.explode(_sequence(F.least(F.lit(COPIES), F.col("copies") - F.col("_block") * COPIES)))
    ).withColumn("copy", F.col("copy") + F.col("_block") * COPIES).withColumn("_at", F.col("_at") + F.col("copy") * F.col("size"))
    return copies.filter("_at < target").withColumn("_part", F.explode(_sequence(F.ceil(F.col("size") / packet)))).select(
        "doc_id", "source", "size", "round", "copy", (F.col("_part") * packet).alias("first_word"),
        (F.col("_at") + F.col("_part") * packet).alias("_at"), "target",
    ).filter("_at < target").withColumn(
        "words", F.least(F.lit(packet), F.col("size") - F.col("first_word"), F.ceil("target") - F.col("_at"))
    ).withColumn("finish", (F.col("_at") + F.col("words")) / F.col("target")).drop("_at", "target")


def served(packets: DataFrame, budget: int) -> DataFrame:
    """The packets that fit the budget, in the order of virtual finish time: `place` is the word they start at.

    The last one is cut short. `words` is what is taken of each.
    """
    slices = groups_for(packets.count(), ROWS_PER_GROUP)
    order = ["finish", F.col("source").asc_nulls_last(), "round", "doc_id", "size", "copy", "first_word"]
    sliced = packets.withColumn("_slice", F.least(F.floor(F.col("finish") * slices), F.lit(slices - 1)))
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_slice").agg(F.sum("words").alias("_total"))
    shifts = totals.select("_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    place = F.coalesce(F.sum("words").over(inside), F.lit(0))
    return sliced.withColumn("_before", place).join(shifts, "_slice").withColumn(
        "place", F.col("_before") + F.col("_shift")
    ).withColumn("words", F.least("words", F.lit(budget) - F.col("place"))).filter("words > 0").drop("_slice", "_before", "_shift")


def mix(
    docs: DataFrame, weights: Sequence[float] | DataFrame, share: float = 1.5, most: int = 2, seed: int = 13,
    packet: int = PACKET_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Every row of `docs` with what the mix takes of it, and the mix itself.

    First table: doc_id, source, size, source_size, target (its source's) and
    taken, a row per row of `docs`; nothing is taken more than `most` times.
    Second: the packets in mixing order (see `served`), what a writer would
    cut out of the texts. `weights` are dealt to the sources in turn (see
    `cycled`) or a table (source, weight > 0) with every source once.

    A null text has no words; a null source is a source of its own, the last; a
    null doc_id is a value like others. Repeated rows are queued as the copies
    they are, one after the other. Other columns are left out. An empty table
    gives no rows. Ties in virtual time go by source, pass, id, size and place
    in the text, so reruns agree.
    """
    rows = written(sized(docs), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    if isinstance(weights, DataFrame):
        wanted = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(wanted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    else:
        sizes = cycled(sizes, weights)
    goals = written(targets(sizes, share, most), "targets")
    budget = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    packets = written(queued(rows, goals, most, seed, packet), "packets")
    # Words are whole: half a word too many is left out, and so is what sums of fractions are off by.
    sent = served(packets, math.floor(budget + 0.25))
    copies = rows.withColumn("_block", F.explode(_sequence(F.ceil(F.col("copies") / COPIES)))).select(
        "doc_id", "source", "size", "_block",
        F.explode(_sequence(F.least(F.lit(COPIES), F.col("copies") - F.col("_block") * COPIES))).alias("copy"),
    )
    every = copies.select("doc_id", "source", "size", (F.col("copy") + F.col("_block") * COPIES).alias("copy"), F.lit(0).cast("long").alias("words"))
    taken = every.union(sent.select(*every.columns)).groupBy("doc_id", "source", "size", "copy").agg(F.sum("words").alias("taken"))
    shown = taken.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    known = goals.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), "source_size", "target")
    out = join_small(shown, known, SOURCE, "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken")
    return out, sent
