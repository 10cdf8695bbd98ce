"""Line dedup on levelled sorted runs of line hashes.

`LineRuns` keeps what is known of every line key in runs: Parquet tables split
and sorted by the key's hash. A batch is merge-anti-joined with the runs, which
tells its new keys from those seen before, and becomes a run itself; when a
level is full, its runs are merged into one of the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import SPACES, groups_for
from spanloom.session import new_table_path, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_IN = 3
KEYS_PER_BUCKET = 2_000_000
# Columns of a result, and those in between.
RESULTS = ("n_lines", "n_dropped", "_doc", "_drops")


def line_key(line: str) -> bytes:
    """The line stripped of ASCII white space, with A-Z in lower case."""
    return line.strip(SPACES).encode().lower()


def _digest(key: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): each document's distinct line keys of `min_chars` code points or more, as 128-bit hashes."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = {line_key(x) for x in (text.as_py() or "").split("\n") if len(x.strip(SPACES)) >= min_chars}
                ids += [doc_id] * len(own)
                found += map(_digest, own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(keys, "doc_id long, key binary")


class LineRuns:
    """Runs of (key, n_docs, keeper): in how many documents a key was found, and the one that keeps it.

    All runs are bucketed by key alike and sorted in each bucket, so that joins
    and merges between them move nothing. A key is in as many runs as batches
    held it, its keeper in the first of them only.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = FAN_IN) -> None:
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.select("key", "n_docs", "keeper").write.bucketBy(self.buckets, "key").sortBy("key")
            .option("path", new_table_path(self.spark, name)).saveAsTable(name)
        )
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key of these runs: full merge joins, one run at a time."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).toDF("key", "_n", "_keeper")
            merged = merged.join(other, "key", "full").select(
                "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"),
                F.coalesce("keeper", "_keeper").alias("keeper"),
            )
        return merged

    def runs(self) -> list[str]:
        return [name for level in reversed(self.levels) for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of `batch` whose key is in no run."""
        for name in self.runs():
            batch = batch.join(self.spark.table(name), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Adds rows (key, n_docs, keeper), one per key: keepers of keys seen before are dropped."""
        rows = batch.select("key", "n_docs", "keeper").repartition(self.buckets, "key")
        if self.levels:
            staged = self.spark.table(self._write(rows))
            new = self.unseen(staged).select("key", F.lit(True).alias("_new"))
            rows = staged.join(new, "key", "left").select("key", "n_docs", F.when(F.col("_new"), F.col("keeper")).alias("keeper"))
        self._push(0, self._write(rows))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_in:
            names, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(names)))

    def merged(self) -> DataFrame:
        """Everything known, one row per key. Needs a batch added before."""
        return self._merged(self.runs())


def repeated_lines(keys: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(key, keeper) of the keys found in `min_docs` documents or more.

    Batches are ranges of doc_id, the largest ids first, so the first batch that
    holds a key has its keeper, the largest doc_id. Null ids count as one
    document that comes last.
    """
    spark = keys.sparkSession
    rows, low, high = keys.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    runs = LineRuns(spark, groups_for(max(rows, 1), KEYS_PER_BUCKET))
    least = -(2**63)
    doc = F.coalesce("doc_id", F.lit(least))
    width = -(-((high or 0) - (low or 0) + 1) // batches)
    for i in range(batches):
        top = (high or 0) - i * width
        inside = (doc <= top) if i else F.lit(True)
        if i < batches - 1:
            inside = inside & (doc > top - width)
        runs.add(keys.filter(inside).groupBy("key").agg(F.countDistinct(doc).alias("n_docs"), F.max(doc).alias("keeper")))
    return runs.merged().filter(F.col("n_docs") >= min_docs).select("key", "keeper")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows of `docs` with `text` less its repeated lines, and n_lines (before) and n_dropped.

    A line whose key has `min_chars` code points or more and is in `min_docs`
    documents or more goes, except in the largest doc_id that holds it; there
    every such line stays. Null and empty texts are one empty line and come out
    empty. Rows with the same doc_id are one document; null ids are one too, the
    smallest. Other columns are kept as they are but for those named like a result,
    which gives way; an empty table stays empty.
    """
    least = -(2**63)
    kept = [c for c in docs.columns if c not in ("text", *RESULTS)]
    docs = docs.select(*kept, "text")
    keys = written(line_keys(docs, min_chars), "line-keys")
    repeated = written(repeated_lines(keys, min_docs), "repeated-lines")
    # Hot keys are on one side only, with one row per key on the other: adaptive execution may split them.
    drops = (
        keys.select(F.coalesce("doc_id", F.lit(least)).alias("_doc"), "key").join(repeated, "key")
        .filter(F.col("_doc") != F.col("keeper"))
        .groupBy("_doc").agg(F.collect_set("key").alias("_drops"))
    )
    joined = docs.withColumn("_doc", F.coalesce("doc_id", F.lit(least))).join(drops, "_doc", "left").drop("_doc")
    out = joined.select(*kept, "text", "_drops")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drops in zip(batch.column("text"), batch.column("_drops")):
                split = (text.as_py() or "").split("\n")
                drop = set(drops.as_py() or ())
                stay = split if not drop else [
                    x for x in split if len(x.strip(SPACES)) < min_chars or _digest(line_key(x)) not in drop
                ]
                texts.append("\n".join(stay))
                lines.append(len(split))
                dropped.append(len(split) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*kept, "text", "n_lines", "n_dropped"],
            )

    return out.mapInArrow(cut, f"{schema + ', ' if kept else ''}text string, n_lines long, n_dropped long")
