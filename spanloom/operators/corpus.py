"""Corpus assembly, invariants and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import CORPUS_REQUIRED_FIELDS, ChunkConfig
from spanloom.functions import jsontext as J
from spanloom.functions import text as T
from spanloom.operators.scale import running


def combine(*corpora: DataFrame) -> DataFrame:
    """All rows of all corpora; columns a corpus lacks are null."""
    result = corpora[0]
    for part in corpora[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def incomplete_lines(lines: DataFrame, required: Sequence[str] = CORPUS_REQUIRED_FIELDS) -> DataFrame:
    """JSON lines that lack a required key, with the missing names."""
    missing = J.missing_fields(F.col("value"), required)
    return lines.withColumn("missing", missing).filter(F.size("missing") > 0)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Values of `key` that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def require_valid(lines: DataFrame, chunks: DataFrame) -> None:
    """Fail unless every line has its required fields and chunk ids are unique."""
    gaps = incomplete_lines(lines).limit(10).collect()
    repeated = duplicates(chunks, "chunk_id").limit(10).collect()
    if gaps or repeated:
        raise ValueError(
            f"Combined corpus validation failed: missing={[r['missing'] for r in gaps]}, "
            f"repeated={[r['chunk_id'] for r in repeated]}"
        )


def group_counts(chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, chunks): counts by each column, in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        chunks.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value")
        .agg(F.count("*").alias("chunks"))
    )


def distribution(rows: DataFrame, value: str, keys: Sequence[str] = (), width: int = 1 << 16) -> DataFrame:
    """Exact count, min, max, mean and median of an integer column per key.

    The median comes from the histogram of distinct values and its running
    count, so no group's values are gathered anywhere.
    """
    keys = list(keys) or ["_all"]
    base = rows if keys != ["_all"] else rows.withColumn("_all", F.lit(0))
    histogram = base.groupBy(*keys, value).agg(F.count("*").alias("n"))
    placed = running(histogram, keys, value, width, sum_of={"before": "n"})
    totals = histogram.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
    )
    low, high = F.floor((F.col("count") - 1) / 2), F.floor(F.col("count") / 2)
    until = F.col("before") + F.col("n")

    def holds(position):
        return (F.col("before") <= position) & (position < until)

    middle = (
        placed.join(totals.select(*keys, "count"), keys)
        .filter(holds(low) | holds(high))
        .groupBy(*keys)
        .agg((F.sum(F.col(value) * (holds(low).cast("int") + holds(high).cast("int"))) / 2.0).alias("median"))
    )
    return totals.join(middle, keys).drop("_all")


def threshold_counts(rows: DataFrame, size: Column, keys: Sequence[str], below: Sequence[int],
                     above: Sequence[int]) -> DataFrame:
    """Per key, how many sizes lie under or over each threshold."""
    return rows.groupBy(*keys).agg(
        *[F.count_if(size < n).alias(f"lt_{n}_bytes") for n in below],
        *[F.count_if(size > n).alias(f"gt_{n}_bytes") for n in above],
    )


def file_summaries(chunks: DataFrame) -> DataFrame:
    """Per file: chunk count, sorted node types, and smallest, largest and mean size."""
    size = F.col("byte_end") - F.col("byte_start")
    return chunks.groupBy("file").agg(
        F.count("*").alias("total_chunks"), F.array_sort(F.collect_set("node_type")).alias("node_types"),
        F.min(size).alias("minimum_bytes"), F.max(size).alias("maximum_bytes"), F.avg(size).alias("average_bytes"),
    )


def file_checks(files: DataFrame, chunks: DataFrame, intact: DataFrame) -> DataFrame:
    """One validation row per listed file.

    `files` has file, language, content and purpose; `chunks` the raw chunks;
    `intact` counts of syntax nodes with exact chunks per file and type. Files
    that are not source code are listed but not checked.
    """
    checked = F.col("language").isin("python", "cpp")
    size = F.col("byte_end") - F.col("byte_start")
    sizes = distribution(chunks.withColumn("size", size), "size", ["file"]).withColumnRenamed("count", "raw_chunk_count")
    extremes = threshold_counts(chunks, size, ["file"], [100], [5000])
    whole = intact.groupBy("file").agg(F.bool_and("all_intact").alias("all_intact"))
    rows = files.withColumn("line_count", T.line_count(F.col("content"))).drop("content")
    for part in (sizes, extremes, whole):
        rows = rows.join(part, "file", "left")
    numbers = ["raw_chunk_count", "min", "max", "mean", "median", "lt_100_bytes", "gt_5000_bytes"]
    for name in numbers:
        rows = rows.withColumn(name, F.when(checked, F.coalesce(name, F.lit(0))))
    return rows.withColumn("chunking_checked", checked).withColumn(
        "all_intact", F.when(checked, F.coalesce("all_intact", F.lit(True)))
    )


def most_common(chunks: DataFrame) -> DataFrame:
    """Node types per file with their place by count, ties by name."""
    counts = chunks.groupBy("file", "node_type").agg(F.count("*").alias("chunks"))
    order = Window.partitionBy("file").orderBy(F.col("chunks").desc(), "node_type")
    # One row per node type of a file.
    return counts.withColumn("place", F.row_number().over(order))


def summary(chunks: DataFrame, config: ChunkConfig = ChunkConfig()) -> dict:
    """The corpus summary: counts by role, repository and type, and byte sizes."""
    sized = chunks.select("source_role", "repository", "chunk_type",
                          (F.col("byte_end") - F.col("byte_start")).alias("size"))
    groups: dict[str, dict] = {"source_role": {}, "repository": {}, "chunk_type": {}}
    # One row per role, repository and type: the vocabulary of the corpus.
    for row in group_counts(sized, list(groups)).sort("dimension", "value").toLocalIterator():
        groups[row["dimension"]][row["value"]] = row["chunks"]
    stats = distribution(sized, "size").first()
    large = sized.filter(F.col("size") > config.oversized_bytes).count()
    return {
        "total_chunk_count": stats["count"] if stats else 0,
        "counts_by_source_role": groups["source_role"],
        "counts_by_repository": groups["repository"],
        "counts_by_chunk_type": groups["chunk_type"],
        "chunk_size_bytes": {
            name: (stats[name] if stats else 0) for name in ("min", "max", "mean", "median")
        },
        f"oversized_chunks_remaining_gt_{config.oversized_bytes}_bytes": large,
    }


def inventory(files: DataFrame) -> DataFrame:
    """File counts by scope root, extension and role, in one pass."""
    return group_counts(files, ["directory", "extension", "source_role"])
