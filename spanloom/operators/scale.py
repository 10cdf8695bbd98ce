"""Joins and running aggregates that hold when one key owns most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import written

# Rows and bytes that may be broadcast, and the copies made of a side that may not.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SALTS = 64
# Estimated size up to which an input is spread over the cores.
SMALL_BYTES = 256 << 20


def at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` is proven to hold at most `rows` rows and `size` bytes. Reads no more rows than that."""
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return n <= rows and total <= size


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, nested values by that of their JSON."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        elif kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
    return total


def spread(scan: DataFrame) -> DataFrame:
    """A small input over all cores, even when it is read in one split.

    By the optimizer's size estimate; a large input has splits enough and is
    left alone, so nothing large is shuffled for this.
    """
    estimate = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism) if estimate <= SMALL_BYTES else scan


def join_small(
    large: DataFrame, small: DataFrame, on: Sequence[str], spread_by: str,
    max_rows: int = BROADCAST_ROWS, salts: int = SALTS, proven: bool | None = None,
) -> DataFrame:
    """Inner join of a skewed side with a side that is usually small.

    The small side is broadcast once its row count is known to be in bounds,
    from a caller's check (`proven`) or from one made here. Otherwise the rows of a hot key are spread over `salts` tasks by a hash of
    `spread_by`, and the other side is copied once per salt.
    """
    if at_most(small, max_rows) if proven is None else proven:
        return large.join(F.broadcast(small), list(on))
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str) -> DataFrame:
    """First `limit` rows of each group with their 1-based rank.

    Spark limits each group inside every map task before the shuffle while
    `limit` stays under its window-group-limit threshold; above it the same is
    done here by ranking within hash shards first.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if limit > threshold:
        shard = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(SALTS))
        local = Window.partitionBy(*keys, "_shard").orderBy(*order)
        df = (
            df.withColumn("_shard", shard)
            .withColumn(rank, F.row_number().over(local))
            .filter(F.col(rank) <= limit)
            .drop("_shard", rank)
        )
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= limit)


def top_tied(df: DataFrame, keys: Sequence[str], order: Column, limit: int) -> DataFrame:
    """Rows of each group that fewer than `limit` others come before; all that tie with the last are kept.

    Spark limits each group by rank inside every map task before the shuffle,
    as in `top_rows`.
    """
    ranked = df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def running(
    df: DataFrame, keys: Sequence[str], order: str, width: int,
    max_of: Mapping[str, str] | None = None, min_of: Mapping[str, str] | None = None,
    sum_of: Mapping[str, str] | None = None, last_of: Mapping[str, str] | None = None,
    inclusive: bool = False, fits: bool = False,
) -> DataFrame:
    """Running max, min, sum and last value that is not null, over an integer order column, per key.

    `df` must hold one row per key and order value. The order axis is cut into
    buckets of `width` values: bucket totals are aggregated first, then carried
    into each bucket, so that no task sees more than `width` rows of a key, nor
    more than one total per bucket, however many rows the key has. Exclusive
    results are null (sums: 0) where nothing comes before.

    `fits` says that the order values are known to span less than one bucket.
    """
    specs = [
        (kind, out, src)
        for kind, items in (("max", max_of), ("min", min_of), ("sum", sum_of), ("last", last_of))
        for out, src in (items or {}).items()
    ]
    call = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda src: F.last(src, ignorenulls=True)}

    def total(kind: str, src: str) -> Column:
        """Over rows in no order."""
        return F.max_by(src, F.when(F.col(src).isNotNull(), F.col(order))) if kind == "last" else call[kind](src)

    last = 0 if inclusive else -1
    if fits:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        plain = [call[kind](src).over(frame) for kind, _, src in specs]
        return df.select(*df.columns, *[
            (F.coalesce(value, F.lit(0)) if kind == "sum" else value).alias(out)
            for value, (kind, out, _) in zip(plain, specs)
        ])
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)))
    by_bucket = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*by_bucket).agg(
        *[total(kind, src).alias(f"_t{i}") for i, (kind, _, src) in enumerate(specs)]
    )
    carried = totals.select(
        *by_bucket, *[call[kind](f"_t{i}").over(before).alias(f"_c{i}") for i, (kind, _, _) in enumerate(specs)]
    )
    inside = Window.partitionBy(*by_bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    # The window comes before the join: its order serves both, so that rows are sorted once.
    local_results = bucketed.select("*", *[call[kind](src).over(inside).alias(f"_l{i}") for i, (kind, _, src) in enumerate(specs)])
    joined = local_results.join(carried, by_bucket)
    results = []
    for i, (kind, out, _) in enumerate(specs):
        local, before_it = F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind == "sum":
            merged = F.coalesce(local, F.lit(0)) + F.coalesce(before_it, F.lit(0))
        elif kind == "last":
            merged = F.coalesce(local, before_it)
        else:
            merged = (F.greatest if kind == "max" else F.least)(local, before_it)
        results.append(merged.alias(out))
    return joined.select(*df.columns, *results)


def numbered(df: DataFrame, order: Sequence[str], out: str, rows_per_range: int = 1_000_000) -> DataFrame:
    """Global 1-based row number in the order of `order`, ties not allowed.

    The keys alone are sorted into ranges, as many as the rows need, and written;
    each range is numbered on its own and shifted by the counts of those before.
    The numbers are joined to the rows by the key, null parts included.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    sorted_keys = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys)])
    ranges = max(1, -(-df.count() // rows_per_range))
    placed = written(
        sorted_keys.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "numbers"
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    numbers = placed.withColumn("_n", local).join(offsets, "_range").select(*keys, (F.col("_n") + F.col("_offset")).alias(out))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(order, keys)]
    return df.join(numbers, reduce(lambda a, b: a & b, same)).drop(*keys)
