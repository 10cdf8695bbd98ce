"""From source trees to chunk tables with their summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import PRIMARY_NODE_TYPES, PYTHON_PRIMARY_NODE_TYPES, ChunkConfig
from spanloom.functions import jsontext as J
from spanloom.functions import paths as P
from spanloom.functions import text as T
from spanloom.operators.corpus import combine, require_valid, summary
from spanloom.operators.sections import header_blocks, issues, section_chunks
from spanloom.session import written
from spanloom.sources.corpus import (
    DOUBTED, SECTION, SKIPPED, conform_chunks, decoded, json_lines, library_files, package_files, problem, read_corpus, read_files,
    undecodable, write_corpus,
)
from spanloom.sources.parsing import parse_files


def symbol_of(signature_name: Column, route: Column) -> Column:
    """Signature name, else the last route element's name; generated names give null."""
    last = F.try_element_at(route, F.lit(-1))
    name = F.regexp_replace(last, "^[^:]*:", "")
    named = signature_name.isNotNull() & (signature_name != "") & ~signature_name.startswith("anon@")
    return F.when(named, signature_name).when(~name.startswith("anon@"), name)


def context_json(parent_context: Column, parent_route: Column, qualified_route: Column) -> Column:
    """Parent context of a structural chunk; an empty route falls back to the parent's."""
    empty = F.array().cast("array<string>")
    route = F.when(F.size(qualified_route) > 0, qualified_route).when(F.size(parent_route) > 0, parent_route).otherwise(empty)
    return F.to_json(F.struct(
        F.coalesce(parent_context, F.lit("")).alias("parent_context"),
        F.coalesce(parent_route, empty).alias("parent_route"), route.alias("qualified_route"),
    ), {"ignoreNullFields": "false"})


def is_primary(node_type: Column, language: Column) -> Column:
    return F.when(language == "python", node_type.isin(*PYTHON_PRIMARY_NODE_TYPES)).otherwise(
        node_type.isin(*PRIMARY_NODE_TYPES)
    )


def chunks_from_raw(raw: DataFrame, repository: str, source_role: Column) -> DataFrame:
    """Corpus chunks from a chunker's raw rows."""
    return conform_chunks(raw.select(
        "chunk_id", F.lit(repository).alias("repository"), source_role.alias("source_role"),
        F.col("file_path").alias("source_path"), F.col("node_type").alias("chunk_type"), "node_type",
        symbol_of(F.col("metadata.signature.name"), F.col("qualified_route")).alias("symbol"),
        "start_line", "end_line", "byte_start", "byte_end",
        context_json(F.col("parent_context"), F.col("parent_route"), F.col("qualified_route")).alias("parent_context"),
        "content",
        F.to_json(F.struct("parent_chunk_id", "symbol_id", "definition_id", "metadata"),
                  {"ignoreNullFields": "false"}).alias("structural_metadata"),
    ))


def structural_chunks(parsed: DataFrame, repository: str) -> DataFrame:
    own = F.concat("parent_route", F.array(F.concat_ws(":", "node_type", "symbol")))
    return conform_chunks(
        parsed.withColumn("repository", F.lit(repository)).withColumn("source_path", F.col("path"))
        .withColumn("chunk_type", F.col("node_type"))
        .withColumn("parent_context", context_json(F.col("parent_context"), F.col("parent_route"), own))
    )


def config_documents(files: DataFrame, repository: str) -> DataFrame:
    """One chunk per JSON file, valid or not."""
    content, path = F.col("content"), F.col("path")
    lines = F.size(T.lines(content))
    return conform_chunks(files.select(
        F.sha1(F.concat_ws(":", F.lit(repository), F.lit("config_document"), path, F.sha1(content))).alias("chunk_id"),
        F.lit(repository).alias("repository"), F.lit("config_or_schema").alias("source_role"),
        path.alias("source_path"), F.lit("config_document").alias("chunk_type"),
        F.lit("json_document").alias("node_type"), P.stem(path).alias("symbol"),
        F.lit(1).alias("start_line"), F.greatest(lines, F.lit(1)).alias("end_line"),
        F.lit(0).alias("byte_start"), F.octet_length(content).alias("byte_end"),
        F.lit('{"configuration_role": "atomic_json_document"}').alias("parent_context"), "content",
        F.to_json(F.struct(J.is_valid(content).alias("json_parse_success"))).alias("structural_metadata"),
    ))


def library_corpus(spark: SparkSession, root: str, repository: str, config: ChunkConfig = ChunkConfig()):
    """Chunks of a library: functions, and sections of commented simulation cases.

    The parse is written once and read by the branches. Returns the chunks and
    the files that could not be parsed.
    """
    files = library_files(read_files(spark, root))
    parsed = written(parse_files(decoded(files), repository), "parsed")
    primary = parsed.filter(F.col("node_type").isin(*PRIMARY_NODE_TYPES))
    cases = primary.filter("source_role = 'simulation_case'").withColumnRenamed("path", "source_path")
    sections = section_chunks(cases, config)
    sectioned = sections.select(F.col("original_function_chunk_id").alias("chunk_id")).distinct()
    whole = structural_chunks(primary.join(sectioned, "chunk_id", "left_anti"), repository)
    parts = sections.withColumn("repository", F.lit(repository)).withColumn(
        "source_role", F.lit("simulation_case")
    ).withColumn("symbol", F.col("section_title")).withColumn("node_type", F.lit("semantic_section")).withColumn(
        "parent_context", F.to_json(F.struct(
            "original_function_chunk_id", F.col("section_index").alias("semantic_section_index"),
            F.col("subchunk_index").alias("subchunk_index_within_section"),
            F.col("node_types").alias("tree_sitter_node_types_contained"),
        ))
    )
    problems = parse_problems(parsed, repository).unionByName(undecodable(files, repository)).unionByName(
        section_problems(cases, repository)
    )
    return whole.unionByName(conform_chunks(parts)), problems


def package_corpus(spark: SparkSession, root: str, repository: str, package: str, excluded=()):
    """Chunks of a package: functions, classes and whole JSON documents."""
    listed = package_files(read_files(spark, root), package, excluded)
    files = decoded(listed)
    parsed = written(parse_files(files, repository), "parsed")
    primary = parsed.filter(is_primary(F.col("node_type"), F.col("language")))
    documents = files.filter("language = 'json'")
    broken = documents.filter(~J.is_valid(F.col("content"))).select(
        *problem(repository, F.col("path"), DOUBTED, F.lit("invalid JSON"))
    )
    chunks = structural_chunks(primary, repository).unionByName(config_documents(documents, repository))
    return chunks, parse_problems(parsed, repository).unionByName(broken).unionByName(undecodable(listed, repository))


def parse_problems(parsed: DataFrame, repository: str) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select(*problem(repository, F.col("path"), SKIPPED, F.col("error"))).distinct()


def section_problems(functions: DataFrame, repository: str | Column) -> DataFrame:
    """The separator blocks of functions (source_path, start_line, content) that open no section, with their lines."""
    found = functions.withColumn("_b", F.explode(issues(header_blocks(F.col("content")))))
    return found.select(*problem(
        repository, F.col("source_path"), SECTION, F.col("_b.issue"), F.col("start_line") + F.col("_b.relative_line") - 1
    ))


def problem_counts(problems: DataFrame) -> DataFrame:
    """(repository, kind, files, problems): how many problems of each kind, in how many files."""
    return problems.groupBy("repository", "kind").agg(
        F.count_distinct("source_path").alias("files"), F.count("*").alias("problems")
    )


def write_report(spark: SparkSession, chunks: DataFrame, problems: DataFrame, output: str) -> None:
    """The problems as JSON lines, and the summary with their counts beside them.

    The summary is written last: where there is one, the problems are whole.
    """
    problems.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{output}_problems")
    counts = problem_counts(read_problems(spark, output))
    report = summary(chunks)
    # A row per repository and kind.
    report["problems"] = [r.asDict() for r in counts.sort("repository", "kind").collect()]
    write_summary(spark, report, f"{output}_summary.json")


def read_problems(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PROBLEM).json(f"{output}_problems")


def read_summary(spark: SparkSession, output: str) -> DataFrame:
    """The summary as one row; `problems` is a list of their counts."""
    return spark.read.schema(SUMMARY).option("multiLine", "true").json(f"{output}_summary.json")


PROBLEM = "repository string, source_path string, kind string, problem string, line long"
SUMMARY = (
    "total_chunk_count long, counts_by_source_role map<string,long>, counts_by_repository map<string,long>, "
    "counts_by_chunk_type map<string,long>, chunk_size_bytes struct<min:long,max:long,mean:double,median:double>, "
    "problems array<struct<repository:string,kind:string,files:long,problems:long>>"
)


def write_summary(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON file, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray((json.dumps(report, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()


def combined_corpus(spark: SparkSession, inputs: list[str], output: str) -> dict:
    """Union of JSON-lines corpora, written only when every invariant holds."""
    chunks = combine(*[read_corpus(spark, path) for path in inputs])
    lines = combine(*[json_lines(spark, path) for path in inputs])
    require_valid(lines, chunks)
    write_corpus(chunks, output)
    return summary(chunks)
