"""Training-data pipeline over `documents`: language, repeated lines, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept. All but the last return the columns of `documents`; n_chars
follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, language, linededup, neardup, packing
from spanloom.llm.common import table
from spanloom.llm.queries import TOKENIZER
from spanloom.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document's words that its language must have; the rest is taken as mixed or noise.
LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, and mostly that one; texts without letters and null texts go.

    Rows with one doc_id stay while any of their texts does.
    """
    found = language.labelled(docs, language.learned(docs))
    rejected = found.groupBy("doc_id").agg(
        F.max((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).alias("keep")
    ).filter(~F.col("keep")).select(F.col("doc_id").alias("_d"))
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that five or more share; those with no word left go if they lost lines."""
    cut = linededup.deduplicated(docs.select(*COLUMNS))
    return cut.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn(
        "n_chars", F.length("text").cast("long")
    ).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates: that of the least doc_id. Repeated rows of it become one."""
    classes = written(
        neardup.linked(docs).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")), "classes"
    )
    others = classes.filter(~F.col("class_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_d"))
    kept = docs.join(others, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti").select(*COLUMNS)
    # Texts are compared only where an id comes more than once.
    return kept if classes.filter("n > 1").isEmpty() else kept.dropDuplicates()


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a hit of fewer tokens in a row than REMOVAL_TOKENS is no reason to go."""
    hits = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.col("n_tokens") >= decontam.REMOVAL_TOKENS)
    found = hits.select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row per piece."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Models, hashes of other engines and tokenizers are outside SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
