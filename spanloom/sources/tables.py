"""The benchmark tables, and the chunk, query and interaction tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.scale import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts take long per row, over all cores even when read in one split."""
    return spread(table(spark, sf_dir, name))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a corpus: source is the repository, language the role.

    Every third document has no symbol; its first line is its section title.
    """
    docs = table(spark, sf_dir, "documents")
    head = F.regexp_extract("text", r"^([^.\n]*)", 1)
    keyed = F.col("doc_id") % 3 != 0
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"),
        F.col("source").alias("repository"),
        F.col("lang").alias("source_role"),
        F.concat(F.lit("corpus/"), "source", F.lit("/"), "lang", F.lit("/"),
                 F.regexp_extract("text", r"^([A-Za-z]*)", 1), F.lit(".txt")).alias("source_path"),
        F.lit("document").alias("chunk_type"),
        F.lit("document").alias("node_type"),
        F.when(keyed, head).alias("symbol"),
        F.when(~keyed, head).alias("section_title"),
        F.lit(1).cast("long").alias("start_line"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("end_line"),
        F.lit(0).cast("long").alias("byte_start"),
        F.octet_length("text").cast("long").alias("byte_end"),
        F.concat(F.lit('{"parent": "'), "lang", F.lit('", "route": null}')).alias("parent_context"),
        F.col("text").alias("content"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every `benchmark` passage as one query."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
