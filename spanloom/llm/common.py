"""What several operators share: column names, words, hashes and numbering."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The six ASCII white-space characters, as a regular expression and as themselves.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text: what lies between ASCII white space. Null or blank text has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"[{SPACE}]+"))


def hash128(key: Column) -> list[Column]:
    """Two independent 64-bit hashes: what stands for a key where billions of them meet."""
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def groups_for(rows: int, per_group: int) -> int:
    """How many groups keep each near `per_group` rows."""
    return max(1, -(-rows // per_group))


def rank_in(df: DataFrame, key: str, order: Sequence[str], group: str, out: str) -> DataFrame:
    """0-based rank of each row among those of its key, however many share the key.

    `group` splits the rows evenly and independently of the key. Rows are
    numbered inside (group, key) and shifted by the counts of the groups before.
    """
    local = Window.partitionBy(group, key).orderBy(*order)
    before = Window.partitionBy(key).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, key).agg(F.count("*").alias("_n"))
    shifts = counts.select(group, key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (
        df.withColumn(out, F.row_number().over(local).cast("long") - 1)
        .join(shifts, [group, key])
        .withColumn(out, F.col(out) + F.col("_shift"))
        .drop("_shift")
    )


def batches_of(rows: Iterable[tuple], size: Iterable[int], limit: int) -> Iterable[list[tuple]]:
    """Rows in lists whose sizes add up to about `limit`; one larger row makes a list of its own."""
    held, total = [], 0
    for row, n in zip(rows, size):
        held.append(row)
        total += n
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def slices_of(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts add up to about `limit` bytes; one larger row makes a slice of its own.

    A slice's texts become Python values one slice at a time, and memory that
    Arrow, numpy and Python have freed goes back after each batch: workers are
    reused, and would keep the peak of every stage they ran.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = min(len(ends), int(np.searchsorted(ends, before + limit)) + 1)
            yield batch.slice(at, end - at)
            at = end
        del batch, ends
        give_back()


def give_back() -> None:
    """Freed memory of this process goes back to the system, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
