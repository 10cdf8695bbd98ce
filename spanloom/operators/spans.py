"""Containment, coverage and overlap of byte spans.

A span table has `file`, `chunk_index`, `byte_start`, `byte_end` (exclusive) and
`node_type`. No operator here compares the spans of a file pair by pair, and
none needs a file to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanloom.config import (
    CONTEXT_NODE_TYPES, EXAMPLE_CHILD_TYPES, PRIMARY_NODE_TYPES, RETAINED_NODE_TYPES,
)
from spanloom.operators.scale import BROADCAST_ROWS, at_most, join_small, running, top_rows
from spanloom.session import written

# Above every chunk index.
INDEX_RANGE = "CAST('10000000000000000000' AS DECIMAL(20,0))"
# Byte positions per bucket of the running aggregates.
WIDTH = 1 << 18
# Spans of a file, or of a range of it, that one task may hold.
FILE_ROWS = 1 << 17


def size() -> Column:
    return F.col("byte_end") - F.col("byte_start")


def distinct_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, start, end) with its number of spans and first chunk."""
    return spans.groupBy(*keys, "byte_start", "byte_end").agg(
        F.count("*").alias("copies"), F.min("chunk_index").alias("first_index")
    )


def nested_spans(spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH) -> DataFrame:
    """Spans that a strictly larger span of their file contains.

    A span [s, e) is nested iff some span that starts before s ends at or after
    e, or one that starts at s ends after e. Both follow from the largest end
    per start and its running maximum.
    """
    keys = list(keys)
    by_start = spans.groupBy(*keys, "byte_start").agg(F.max("byte_end").alias("far_end"))
    reach = running(by_start, keys, "byte_start", width, max_of={"earlier_end": "far_end"})
    contained = (F.col("far_end") > F.col("byte_end")) | F.coalesce(
        F.col("earlier_end") >= F.col("byte_end"), F.lit(False)
    )
    return spans.join(reach, [*keys, "byte_start"]).filter(contained).select(*spans.columns)


def outermost_spans(spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH) -> DataFrame:
    """Spans that no strictly larger span of their file contains.

    Dropping spans greedily, largest first, when a kept one contains them gives
    the same result, as strict containment is transitive.
    """
    nested = nested_spans(distinct_spans(spans, keys), keys, width).select(*keys, "byte_start", "byte_end")
    return spans.join(nested, [*keys, "byte_start", "byte_end"], "left_anti")


def coverage(spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH) -> DataFrame:
    """Length of the union of the spans per key; touching spans merge.

    Ordered by start, a span adds what lies beyond the furthest end before it.
    Spans with one start are replaced by the longest of them first.
    """
    keys = list(keys)
    by_start = spans.groupBy(*keys, "byte_start").agg(F.max("byte_end").alias("far_end"))
    reach = running(by_start, keys, "byte_start", width, max_of={"earlier_end": "far_end"})
    gain = F.greatest(F.lit(0), F.col("far_end") - F.greatest("byte_start", "earlier_end"))
    return reach.groupBy(*keys).agg(F.sum(gain).alias("unique_covered_bytes"))


def overlap_metrics(spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH) -> DataFrame:
    """Nested and top-level counts, summed and unique bytes, redundancy per key.

    With further keys, such as a policy, every metric is taken per key; sums
    over files add the unions per file.
    """
    keys = list(keys)
    distinct = distinct_spans(spans, keys)
    nested = (
        nested_spans(distinct, keys, width).groupBy(*keys)
        .agg(F.sum("copies").alias("nested_chunk_count"),
             F.sum(F.col("copies") * size()).alias("nested_chunk_bytes_sum"))
    )
    totals = spans.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"), F.sum(size()).alias("total_chunk_bytes_sum")
    )
    unique = F.col("unique_covered_bytes")
    return (
        totals.join(coverage(spans, keys, width), keys).join(nested, keys, "left")
        .na.fill(0, ["nested_chunk_count", "nested_chunk_bytes_sum"])
        .withColumn("top_level_chunk_count", F.col("chunk_count") - F.col("nested_chunk_count"))
        .withColumn("redundancy_bytes", F.col("total_chunk_bytes_sum") - unique)
        .withColumn("duplication_factor",
                    F.when(unique > 0, F.col("total_chunk_bytes_sum") / unique).otherwise(0.0))
    )


def _dominated(end: np.ndarray, copies: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row how many earlier rows end at or after it, and the least place among them.

    A row looks at the even block before its own at every power of two of row
    numbers, as in `containers`; a block is a running sum and minimum over the
    ends, from the far side.
    """
    n = len(end)
    counts, least = np.zeros(n, np.int64), np.full(n, n, np.int64)
    numbers = np.arange(n)
    for level in range(max(n - 1, 0).bit_length()):
        block = numbers >> level
        entry = block % 2 == 0
        # At the same end the entries come first, so that they count.
        order = np.lexsort((~entry, -end, block >> 1))
        pair, first = (block >> 1)[order], entry[order]
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        part = np.cumsum(fresh) - 1
        total = np.cumsum(np.where(first, copies[order], 0))
        base = (total - np.where(first, copies[order], 0))[fresh]
        # Later parts lie lower, so the running minimum starts anew with each.
        lift = (part[-1] - part) * (n + 1)
        small = np.minimum.accumulate(np.where(first, place[order], n) + lift) - lift
        asked = ~first
        counts[order[asked]] += (total - base[part])[asked]
        least[order[asked]] = np.minimum(least[order[asked]], small[asked])
    return counts, least


def _nested_in(table: pa.Table, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one file that some row strictly contains: their numbers, counts and containers' row numbers.

    Copies of a span are one distinct span; `weighted` rows are distinct already.
    A container without an index counts, but is never the smallest (-1).
    """
    start, end = (table.column(c).to_numpy() for c in ("byte_start", "byte_end"))
    index = table.column("chunk_index")
    unknown = index.is_null().to_numpy()
    index = index.fill_null(0).to_numpy()
    by_span = np.lexsort((index, unknown, -end, start))
    s, e = start[by_span], end[by_span]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])]
    span = np.cumsum(fresh) - 1
    copies = table.column("copies").to_numpy()[by_span] if weighted else np.ones(len(s), np.int64)
    head = by_span[fresh]
    per_span = np.bincount(span, weights=copies).astype(np.int64)
    by_size = np.lexsort((index[head], end[head] - start[head], unknown[head]))
    place = np.empty(len(head), np.int64)
    place[by_size] = np.arange(len(head))
    known = int(len(head) - unknown[head].sum())
    place = np.where(place < known, place, len(head))
    counts, least = _dominated(end[head], per_span, place)
    nested = counts[span] > 0
    parent = np.where(least < len(head), head[by_size[np.minimum(least, len(head) - 1)]], -1)
    return by_span[nested], counts[span][nested], parent[span][nested]


def _parents_of_file(table: pa.Table) -> pa.Table:
    rows, counts, parents = _nested_in(table, weighted=False)
    kept = parents >= 0
    rows, counts, parents = rows[kept], counts[kept], parents[kept]
    child, parent = table.take(pa.array(rows)), table.take(pa.array(parents))
    child = child.append_column("containing_chunk_count", pa.array(counts, pa.int64()))
    for name in ("chunk_index", "node_type", "byte_start", "byte_end"):
        child = child.append_column(_PARENT_COLUMNS[name], parent.column(name))
    return child


def _containers_of_range(table: pa.Table) -> pa.Table:
    rows, counts, parents = _nested_in(table, weighted=True)
    parent = table.take(pa.array(np.where(parents < 0, None, parents), pa.int64()))
    size_ = pc.subtract(parent.column("byte_end"), parent.column("byte_start"))
    best = pc.if_else(pc.is_valid(parent.column("chunk_index")), size_, pa.scalar(None, pa.int64()))
    return table.drop_columns(["copies", "chunk_index", "range"]).take(pa.array(rows)).append_column(
        "containing", pa.array(counts, pa.int64())
    ).append_column("smallest_size", best).append_column("smallest_index", parent.column("chunk_index"))


_PARENT_COLUMNS = {"chunk_index": "parent_index", "node_type": "parent_node_type",
                   "byte_start": "parent_byte_start", "byte_end": "parent_byte_end"}


def containers(spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH, rows: int = FILE_ROWS) -> DataFrame:
    """Per nested distinct span: how many spans contain it, and the smallest one.

    Ordered by start and, from the far side, by end, a span's containers come
    before it. The distinct spans are cut into ranges of about `rows` in that
    order. What contains a span within its range is found in one task. The
    ranges before split into at most one block per bit of the range's number:
    aligned blocks whose length is a power of two. Each span enters the block it
    lies in at every level, each question goes to the blocks that make up its
    prefix, and inside a block the containing spans are a running aggregate over
    the ends, from the far side. That costs a row per span and level of ranges,
    where pairs would cost the square of a file.

    The smallest container is the first by (size, chunk_index).
    """
    keys = list(keys)
    place = [*keys, "byte_start", "byte_end"]
    distinct = distinct_spans(spans.dropna(subset=place), keys).withColumn("_far", -F.col("byte_end"))
    ranges = max(1, -(-distinct.count() // rows))
    # Written: sampled bounds may differ from run to run.
    ranged = written(
        distinct.repartitionByRange(ranges, *keys, "byte_start", "_far").drop("_far")
        .withColumn("range", F.spark_partition_id().cast("long")), "ranges"
    ).withColumnRenamed("first_index", "chunk_index")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.select(*place).schema)
    inside = ranged.groupBy(*keys, "range").applyInArrow(
        _containers_of_range, f"{fields}, containing long, smallest_size long, smallest_index long"
    ).withColumn("smallest", _best(F.col("smallest_size"), F.col("smallest_index"))).select(*place, "containing", "smallest")
    found = inside if ranges == 1 else inside.unionByName(_containers_before(ranged, keys, width, ranges))
    return found.groupBy(*place).agg(
        F.sum("containing").alias("containing_chunk_count"),
        (F.min("smallest") % F.expr(INDEX_RANGE)).cast("long").alias("parent_index"))


def _best(size_: Column, index: Column) -> Column:
    """Size, then index, as one number: a hash aggregate cannot hold a struct."""
    return (size_.cast("decimal(19,0)") * F.expr(INDEX_RANGE) + index).cast("decimal(38,0)")


def _containers_before(ranged: DataFrame, keys: list[str], width: int, ranges: int) -> DataFrame:
    """Containers of each span in the ranges before its own, a row per block that holds some."""
    extent = ranged.agg(F.coalesce(F.max("byte_end"), F.lit(0)).alias("end"), F.min("byte_end").alias("low")).first()
    level = F.explode(F.sequence(F.lit(0), F.lit((ranges - 1).bit_length() - 1)))
    # Only files that go over into another range have ranges before.
    crossing = ranged.groupBy(*keys).agg(F.min("range").alias("_a"), F.max("range").alias("_b")).filter("_a < _b")
    crossing = crossing.select(*keys)
    leveled = join_small(ranged, crossing, keys, spread_by="byte_start").withColumn("level", level).withColumn(
        "block", F.expr("shiftright(range, level)"))
    # Spans enter even blocks, questions ask the even block just before their own.
    entries = leveled.filter("block % 2 = 0").select(
        *keys, "level", "block", F.col("byte_end").alias("at"), "copies",
        _best(F.col("byte_end") - F.col("byte_start"), F.col("chunk_index")).alias("best"))
    questions = leveled.filter("block % 2 = 1").select(
        *keys, "level", (F.col("block") - 1).alias("block"), F.col("byte_end").alias("at"), "byte_start", "byte_end")
    group = [*keys, "level", "block"]
    asked = questions.select(*group, "at", F.lit(0).cast("long").alias("copies"))
    # One row per place, ordered from the far end.
    at_end = (
        entries.unionByName(asked, allowMissingColumns=True)
        .groupBy(*group, "at").agg(F.sum("copies").alias("n"), F.min("best").alias("best"))
        .withColumn("from_end", -F.col("at"))
    )
    answers = running(
        at_end, group, "from_end", width, sum_of={"containing": "n"}, min_of={"smallest": "best"}, inclusive=True,
        fits=extent["end"] - (extent["low"] or 0) < width,
    ).filter("containing > 0")
    return questions.join(answers.select(*group, "at", "containing", "smallest"), [*group, "at"]).select(
        *keys, "byte_start", "byte_end", "containing", "smallest")


def direct_parents(
    spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH, rows: int = FILE_ROWS
) -> DataFrame:
    """Each nested span with its container count and smallest container.

    Files of at most `rows` spans are shuffled once and answered whole, several
    to a task; larger ones go by ranges of their distinct spans (`containers`).
    """
    keys = list(keys)
    needed = [*keys, "byte_start", "byte_end", "chunk_index", "node_type"]
    usable = spans.dropna(subset=[*keys, "byte_start", "byte_end"])
    large = written(usable.groupBy(*keys).count().filter(F.col("count") > rows).select(*keys), "files")
    any_large = not large.isEmpty()
    if any_large:
        few = at_most(large, BROADCAST_ROWS)
        listed = F.broadcast(large) if few else large
        hot, usable = usable.join(listed, keys, "left_semi"), usable.join(listed, keys, "left_anti")
    core = usable.select(*needed)
    core = core.select(*[F.col(c).cast("long").alias(c) if c in ("byte_start", "byte_end", "chunk_index") else c for c in needed])
    answer = StructType([
        *core.schema.fields, StructField("containing_chunk_count", LongType()), StructField("parent_index", LongType()),
        StructField("parent_node_type", StringType()), StructField("parent_byte_start", LongType()),
        StructField("parent_byte_end", LongType()),
    ])
    small = core.groupBy(*keys).applyInArrow(_parents_of_file, answer)
    others = [c for c in spans.columns if c not in needed]
    if others:
        small = small.join(usable.select(*keys, "chunk_index", *others), [*keys, "chunk_index"])
    if not any_large:
        return small
    child = hot.join(containers(hot, keys, width, rows), [*keys, "byte_start", "byte_end"])
    parent = hot.select(*keys, *[F.col(c).alias(name) for c, name in _PARENT_COLUMNS.items()])
    return small.unionByName(child.join(parent, [*keys, "parent_index"]).select(*small.columns))


def example_relations(relations: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Up to twelve relations per file, members of types and templates first.

    Three largest children of each type in a fixed type order; a file without
    such children shows its first relations by chunk index instead.
    """
    keys = list(keys)
    place = F.array_position(F.array(*[F.lit(t) for t in EXAMPLE_CHILD_TYPES]), F.col("node_type"))
    # Type 0: no member. Such rows count only in files without members, where they are all rows.
    kind = F.when(F.col("parent_node_type").isin(*CONTEXT_NODE_TYPES) & (place > 0), place).otherwise(0)
    order = [F.when(F.col("type_place") > 0, size()).desc(), F.col("chunk_index")]
    ranked = top_rows(relations.withColumn("type_place", kind), [*keys, "type_place"], order, 12, "type_rank").filter(
        "type_place = 0 OR type_rank <= 3"
    )
    members = F.max("type_place").over(Window.partitionBy(*keys)) > 0
    picked = ranked.withColumn("_members", members).filter("_members = (type_place > 0)")
    return top_rows(picked, keys, [F.col("type_place"), F.col("type_rank")], 12, "place").drop(
        "type_place", "type_rank", "_members"
    )


def retained(spans: DataFrame) -> DataFrame:
    """Policy B: structural node types only."""
    return spans.filter(F.col("node_type").isin(*RETAINED_NODE_TYPES))


def primary(spans: DataFrame) -> DataFrame:
    """Policy D: functions and methods as retrieval units."""
    return spans.filter(F.col("node_type").isin(*PRIMARY_NODE_TYPES))


def context_only(spans: DataFrame) -> DataFrame:
    """Policy D: types and templates kept as context."""
    return spans.filter(F.col("node_type").isin(*CONTEXT_NODE_TYPES))


def policy_counts(spans: DataFrame, keys: Sequence[str] = ("file",), width: int = WIDTH) -> DataFrame:
    """(keys, policy, selection, node_type, chunks) for the four selection policies.

    A keeps all, B the retained types, C those of B that no larger one of B
    contains, D functions and methods with types as context. Nesting is found
    once and each span then counts in all its policies.
    """
    keys = list(keys)
    place = [*keys, "byte_start", "byte_end"]
    nested = nested_spans(distinct_spans(retained(spans), keys), keys, width).select(
        *place, F.lit(True).alias("nested")
    )
    kind = F.col("node_type")
    is_retained = kind.isin(*RETAINED_NODE_TYPES)

    def entry(policy: str, selection: Column, when: Column | None = None) -> Column:
        row = F.struct(F.lit(policy).alias("policy"), selection.alias("selection"))
        return row if when is None else F.when(when, row)

    retrieval = F.lit("retrieval")
    entries = F.array_compact(F.array(
        entry("A", retrieval),
        entry("B", retrieval, is_retained),
        entry("C", F.when(F.col("nested"), "removed").otherwise(retrieval), is_retained),
        entry("D", F.when(kind.isin(*PRIMARY_NODE_TYPES), retrieval).otherwise("context"), is_retained),
    ))
    return (
        spans.join(nested, place, "left").select(*keys, "node_type", F.explode(entries).alias("e"))
        .groupBy(*keys, "e.policy", "e.selection", "node_type").agg(F.count("*").alias("chunks"))
    )


def points_inside(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], width: int = WIDTH, unique: bool = False
) -> DataFrame:
    """Points with whether they lie strictly inside some span of their key.

    `points` has the keys and `point`. A point is inside iff the furthest end of
    the spans that start before it lies beyond it.

    `unique` says that no two points share their keys and place: they then stay
    on the axis with what else they hold, and are not joined to it.
    """
    keys = list(keys)
    if unique:
        others = [c for c in points.columns if c not in (*keys, "point")]
        starts = spans.select(*keys, F.col("byte_start").alias("at"), F.col("byte_end").alias("end"))
        places = points.withColumnRenamed("point", "at").withColumn("_asked", F.lit(True))
        # One row at most of a key and place has more than an end.
        axis = starts.unionByName(places, allowMissingColumns=True).groupBy(*keys, "at").agg(
            F.max("end").alias("end"), *[F.first(c, ignorenulls=True).alias(c) for c in ("_asked", *others)]
        )
        reach = running(axis, keys, "at", width, max_of={"earlier_end": "end"}).filter("_asked")
        inside = F.coalesce(F.col("earlier_end") > F.col("point"), F.lit(False)).alias("inside")
        return reach.withColumnRenamed("at", "point").select(*points.columns, inside)
    starts = spans.groupBy(*keys, F.col("byte_start").alias("at")).agg(F.max("byte_end").alias("end"))
    places = points.select(*keys, F.col("point").alias("at")).distinct()
    axis = starts.unionByName(places, allowMissingColumns=True).groupBy(*keys, "at").agg(F.max("end").alias("end"))
    reach = running(axis, keys, "at", width, max_of={"earlier_end": "end"}).select(
        *keys, F.col("at").alias("point"), "earlier_end"
    )
    inside = F.coalesce(F.col("earlier_end") > F.col("point"), F.lit(False))
    return points.join(reach, [*keys, "point"]).withColumn("inside", inside).drop("earlier_end")


def node_types_in(ranges: DataFrame, nodes: DataFrame, keys: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Sorted node types that overlap each range [range_start, range_end).

    Per node type, some node overlaps iff the furthest end of those that start
    before the range's end lies beyond the range's start. A file has few node
    types, so a range is asked once per type and never once per node.
    """
    keys = list(keys)
    typed = [*keys, "node_type"]
    starts = nodes.groupBy(*typed, F.col("byte_start").alias("at")).agg(F.max("byte_end").alias("end"))
    # A hot file's ranges stay spread: its few types come to them.
    asked = join_small(ranges, nodes.select(*typed).distinct(), keys, spread_by="range_start")
    axis = (
        starts.unionByName(asked.select(*typed, F.col("range_end").alias("at")).distinct(), allowMissingColumns=True)
        .groupBy(*typed, "at").agg(F.max("end").alias("end"))
    )
    reach = running(axis, typed, "at", width, max_of={"earlier_end": "end"}).select(
        *typed, F.col("at").alias("range_end"), "earlier_end"
    )
    return (
        asked.join(reach, [*typed, "range_end"]).filter(F.col("earlier_end") > F.col("range_start"))
        .groupBy(*ranges.columns).agg(F.array_sort(F.collect_set("node_type")).alias("node_types"))
    )


def main_functions(chunks: DataFrame) -> DataFrame:
    """First function of each file whose content calls or defines `main(`."""
    hits = chunks.filter((F.col("node_type") == "function_definition") & F.col("content").rlike(r"\bmain\s*\("))
    return top_rows(hits, ["file"], [F.col("chunk_index")], 1, "_first").drop("_first")


def main_children(chunks: DataFrame) -> DataFrame:
    """Chunks strictly inside the main function of their file, with that function's index.

    One main function per file meets the file's chunks: a row per chunk at most.
    """
    mains = main_functions(chunks).select(
        "file", F.col("chunk_index").alias("main_index"), F.col("byte_start").alias("main_start"),
        F.col("byte_end").alias("main_end"),
    )
    inside = (F.col("main_start") <= F.col("byte_start")) & (F.col("byte_end") <= F.col("main_end"))
    larger = (F.col("main_end") - F.col("main_start")) > size()
    return join_small(chunks, mains, ["file"], spread_by="chunk_index").filter(inside & larger).select(
        "file", "main_index", "chunk_index", "node_type", "byte_start", "byte_end"
    )


def exact_span_matches(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Syntax nodes per file and type, and how many have a chunk of their exact span.

    A function node may also be matched by a method chunk.
    """
    usable = spans.select(
        "file", "byte_start", "byte_end",
        F.when(F.col("node_type") == "method_declaration", "function_definition")
        .otherwise(F.col("node_type")).alias("node_type"),
    ).distinct()
    matched = nodes.join(usable.withColumn("hit", F.lit(1)), ["file", "byte_start", "byte_end", "node_type"], "left")
    return (
        matched.groupBy("file", "node_type")
        .agg(F.count("*").alias("ast_count"), F.count("hit").alias("raw_chunk_exact_span_count"))
        .withColumn("all_intact", F.col("ast_count") == F.col("raw_chunk_exact_span_count"))
    )
