"""Sharding over fixed virtual slots.

Records hash into thousands of slots for good; only the small slot-to-shard map
changes. Its versions are kept as a table, and rebalancing or growing edits the
map, so that no more rows move than the moved slots hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import rank_in
from spanloom.session import written
from spanloom.sources.versions import VersionedTable

VIRTUAL_SLOTS = 4096
MAP_TYPE = "version int, virtual_slot int, shard int, bytes long"


def virtual_slot(slots: int = VIRTUAL_SLOTS) -> Column:
    """The slot of a record, by its id and text; null ids spread by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def slot_bytes(sized: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Bytes per slot, empty slots included: `slots` rows. From rows (virtual_slot, size)."""
    spark = sized.sparkSession
    everyone = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.lit(0).cast("long").alias("size"))
    return sized.select("virtual_slot", "size").union(everyone).groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, shards: int, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn, no bytes known."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(0).alias("version"), slot.alias("virtual_slot"), (slot % shards).alias("shard"), F.lit(0).cast("long").alias("bytes")
    )


def rebalanced(current: DataFrame, measured: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, edited so that the shards' bytes come out near equal.

    A shard keeps its slots, largest first, while they fit its fair share, and
    releases the rest; released slots go, largest first, to the shard that has
    least by then. `current` is one version of the map and has one row per slot,
    so the whole edit is one row of arrays of that bounded length.
    """
    fresh = current.drop("bytes").join(measured, "virtual_slot")
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    share = F.sum("bytes").over(Window.partitionBy("version")) / shards
    marked = fresh.select(
        "version", "virtual_slot", "shard", "bytes",
        (F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0)) <= share).alias("keeps"),
    )
    one = marked.groupBy((F.col("version") + 1).alias("version")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("bytes"), F.col("virtual_slot"), F.col("shard"), F.col("keeps"))), False).alias("slots")
    )
    kept, released = F.filter("slots", lambda s: s["keeps"]), F.filter("slots", lambda s: ~s["keeps"])
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.aggregate(
            F.filter(kept, lambda s: s["shard"] == i), F.lit(0).cast("long"), lambda n, s: n + s["bytes"]
        ),
    )
    nothing = F.array().cast("array<struct<virtual_slot:int,shard:int,bytes:bigint>>")

    def place(state: Column, slot: Column) -> Column:
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda n, i: F.when(i == least, n + slot["bytes"]).otherwise(n)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(
                slot["virtual_slot"].alias("virtual_slot"), least.alias("shard"), slot["bytes"].alias("bytes")
            ))).alias("placed"),
        )

    placed = F.aggregate(released, F.struct(loads.alias("loads"), nothing.alias("placed")), place, lambda s: s["placed"])
    stay = F.transform(kept, lambda s: F.struct(
        s["virtual_slot"].alias("virtual_slot"), s["shard"].alias("shard"), s["bytes"].alias("bytes")
    ))
    return one.select("version", F.explode(F.concat(stay, placed)).alias("s")).select("version", "s.*")


def grown(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map with one shard more, which alone takes slots: each `shards + 1`-th of a shard's slots."""
    order = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    takes = F.row_number().over(order) % (shards + 1) == 0
    return current.withColumn("_takes", takes).select(
        (F.col("version") + 1).alias("version"), "virtual_slot",
        F.when(F.col("_takes"), shards).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes",
    )


def moved_bytes(before: DataFrame, after: DataFrame) -> int:
    """Bytes of the slots that two versions of a map put into different shards: what a move from one to the other copies."""
    old = before.select("virtual_slot", F.col("shard").alias("_shard"))
    return after.join(F.broadcast(old), "virtual_slot").filter("shard <> _shard").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def _edited(sized: DataFrame, shards: int, slots: int, store: VersionedTable | None) -> tuple[DataFrame, DataFrame]:
    """The map's version before and after this load. With a store both are versions of it, else the first is a fresh one."""
    spark = sized.sparkSession
    base = store.current() if store else None
    start = first_map(spark, shards, slots) if base is None else store.read(base)
    if base is not None and start.count() != slots:
        raise ValueError(f"the stored map has other slots than {slots}")
    after = rebalanced(start, slot_bytes(sized, slots), shards).select(*start.columns)
    if store is None:
        versions = written(start.unionByName(after), "slot-map")
        return versions.filter("version = 0"), versions.filter("version = 1")
    if base is None:
        base = store.write(start, None)
    return store.read(base), store.read(store.write(after, base))


def shard(
    docs: DataFrame, shards: int, slots: int = VIRTUAL_SLOTS, store: VersionedTable | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every document with its shard and place there, and the map's versions before and after.

    Rows: doc_id, size (UTF-8 bytes of the text plus 8; null text: 8),
    text_crc32 (null text: of no bytes), virtual_slot, shard, slot (its place in
    the shard, gapless from 0: by virtual slot, then id, checksum and size).
    Rows that repeat are records of their own; a row that repeats very often
    stays in one virtual slot, as any record does. Equal texts with different
    ids scatter over the slots. Ties between equal rows are dealt in any order.
    Other columns are ignored; an empty table gives no rows.

    `store` holds the map: its newest version is edited for these documents and
    the result added to it, refused if another load was quicker. Without it the
    edit is of a map that deals the slots in turn.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = written(docs.select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        virtual_slot(slots).alias("virtual_slot"),
    ), "sharding")
    before, newest = _edited(sized, shards, slots, store)
    # The map has one row per virtual slot, a fixed number.
    mapped = sized.join(F.broadcast(newest.select("virtual_slot", "shard")), "virtual_slot")
    return rank_in(mapped, "shard", ["doc_id", "text_crc32", "size"], "virtual_slot", "slot"), before.unionByName(newest)
