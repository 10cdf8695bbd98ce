"""Evidence blocks under a character budget, prompts and their fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import TRUNCATION_MARKER, PackingConfig
from spanloom.functions import text as T

# Characters of a block header whose fields are all empty, and of the separator.
SHORTEST_HEADER = len("[Evidence 1]\nRepository: \nRole: \nPath: \nSymbol/Section: x\nLines: 1-1\nContent:\n")
SEPARATOR = "\n\n"


def source_columns() -> list[Column]:
    """The six source fields shown for a result."""
    return [
        F.col("repository"), F.col("source_role"), F.col("source_path"),
        F.col("label").alias("symbol_or_section_title"), F.col("start_line"), F.col("end_line"),
    ]


def block_header() -> Column:
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    return F.concat(
        F.lit("[Evidence "), F.col("rank").cast("string"), F.lit("]\nRepository: "), shown("repository"),
        F.lit("\nRole: "), shown("source_role"), F.lit("\nPath: "), shown("source_path"),
        F.lit("\nSymbol/Section: "), F.coalesce(F.col("label"), F.lit("(unnamed chunk)")),
        F.lit("\nLines: "), shown("start_line"), F.lit("-"), shown("end_line"), F.lit("\nContent:\n"),
    )


def with_content(results: DataFrame, corpus: DataFrame, few: bool = False) -> DataFrame:
    """Results joined with the content of their chunks.

    With `few`, the results are known to be small enough to broadcast, so that
    the content of the corpus is never shuffled.
    """
    return corpus.select("chunk_id", "content").join(F.broadcast(results) if few else results, "chunk_id")


def pack_evidence(results: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """Results of each query that fit the budget, with their block text.

    `results` has one row per (query_id, rank) with a chunk's content. Blocks
    are taken in rank order while their header is shorter than what is left; the
    content is cut at the per-block limit or at what is left. A block cut below
    its natural size uses up the budget, so the set of kept blocks is a prefix
    that two running windows find: what the blocks before cost at their natural
    size, and whether every header so far fitted.

    A block costs at least its header, so no more rows of a query than the
    budget has room for reach the window.
    """
    room = config.total_chars // (SHORTEST_HEADER + len(SEPARATOR)) + 1
    marker = len(TRUNCATION_MARKER)
    ordered = Window.partitionBy("query_id").orderBy("rank")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    header_size, size = F.length("header"), F.length("content")
    natural = (
        header_size + F.least(size, F.lit(config.block_chars))
        + F.when(size > config.block_chars, marker).otherwise(0) + len(SEPARATOR)
    )
    left = F.lit(config.total_chars) - F.coalesce(F.sum("natural").over(before), F.lit(0))
    limit = F.least(F.lit(config.block_chars).cast("long"), F.col("left") - header_size).cast("int")
    body = F.concat(
        F.left("content", limit), F.when(size > limit, TRUNCATION_MARKER).otherwise("")
    )
    return (
        results.filter(F.col("rank") <= room)
        .withColumn("header", block_header())
        .withColumn("natural", natural)
        .withColumn("left", left)
        .withColumn("kept", F.min((header_size < F.col("left")).cast("int")).over(so_far) == 1)
        .filter("kept")
        .withColumn("block", F.concat("header", body))
        .drop("header", "natural", "left", "kept")
    )


def evidence_text(packed: DataFrame) -> DataFrame:
    """(query_id, evidence, sources): the blocks of each query joined in rank order.

    The blocks of one query together stay within the budget.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "block", F.struct(*source_columns()).alias("source"))))
    return (
        packed.groupBy("query_id").agg(rows.alias("rows"))
        .select(
            "query_id",
            F.array_join(F.transform("rows", lambda r: r["block"]), SEPARATOR).alias("evidence"),
            F.transform("rows", lambda r: r["source"]).alias("sources"),
        )
    )


def prompts(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Prompt, sources and fingerprints of every query, also of those without evidence."""
    prompt = F.concat(
        F.lit("Question:\n"), F.col("query"), F.lit("\n\nRepository evidence:\n"),
        F.coalesce(F.col("evidence"), F.lit("")),
    )
    return (
        queries.select("query_id", "query").join(evidence, "query_id", "left")
        .withColumn("prompt", prompt)
        .select(
            "query_id", "query", "prompt", "sources",
            T.fingerprint(F.col("query")).alias("query_sha256"),
            F.length("query").alias("query_len"),
            T.fingerprint(F.col("prompt")).alias("prompt_sha256"),
            F.length("prompt").alias("prompt_len"),
            F.coalesce(F.get("sources", F.lit(0))["source_path"], F.lit("(none)")).alias("first_source"),
            F.col("evidence").isNotNull().alias("has_evidence"),
        )
    )


def evidence_metadata(sources: Column) -> Column:
    """Sources with their 1-based rank, as an interaction record keeps them."""
    return F.transform(
        sources,
        lambda s, i: F.struct(
            (i + 1).alias("rank"), s["repository"].alias("repository"),
            s["source_path"].alias("source_path"), s["source_role"].alias("source_role"),
            s["symbol_or_section_title"].alias("symbol_or_section_title"),
            s["start_line"].alias("line_start"), s["end_line"].alias("line_end"),
        ),
    )
