"""Corpora as JSON lines and source trees as files."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import CPP_EXTENSIONS
from spanloom.functions import paths as P
from spanloom.schemas import CHUNK, RAW_PAYLOAD

PACKAGE_SCOPE = (
    "{package}/bindings", "{package}/config", "{package}/llm", "{package}/sph_simulation",
    "{package}/visualization", "examples", "tests",
)


# Columns of the chunk schema whose text is JSON.
NESTED = ("parent_context", "structural_metadata")
# Kinds of problems: files that are left out, files taken with a parser's doubts, and separator blocks that open no section.
SKIPPED, DOUBTED, SECTION = "skipped_file", "parse_warning", "section_warning"


def problem(repository: str | Column, path: Column, kind: str, text: Column, line: Column | None = None) -> list[Column]:
    """The columns of a problem of a corpus build: what it is, in which file, and at which line where known."""
    return [
        (F.lit(repository) if isinstance(repository, str) else repository).alias("repository"), path.alias("source_path"),
        F.lit(kind).alias("kind"), text.alias("problem"), (F.lit(None) if line is None else line).cast("long").alias("line"),
    ]


def conform_chunks(chunks: DataFrame) -> DataFrame:
    """Columns of the chunk schema, in its order; absent ones are null."""
    return chunks.select(*[
        (F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK
    ])


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw non-empty lines as `value`; lines end at a newline only."""
    return spark.read.option("lineSep", "\n").text(path).filter("value <> ''")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines. A malformed line or an empty corpus is an error."""
    chunks = spark.read.schema(CHUNK).option("lineSep", "\n").option("mode", "FAILFAST").json(path)
    if chunks.isEmpty():
        raise ValueError(f"Corpus is empty: {path}")
    return chunks


def write_corpus(chunks: DataFrame, path: str) -> None:
    """JSON lines with null fields kept, keys in sorted order.

    Objects and arrays that a column holds as text leave as such, not as an
    escaped string; `read_corpus` gives the same text again, line ends inside
    it as spaces and without spaces around it. What is neither leaves as a string.
    """
    parts = []
    for nested, names in groupby(sorted(chunks.columns), key=NESTED.__contains__):
        if nested:
            parts += [F.concat(F.lit(f'"{c}":'), _json_value(F.col(c))) for c in names]
        else:
            fields = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
            parts.append(F.substr(fields, F.lit(2), F.length(fields) - 2))
    chunks.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value")).write.text(path)


def _json_value(text: Column) -> Column:
    """A text as it stands inside a JSON line: itself where it is an object or array, else a string."""
    inside = text.rlike(r"^\s*[{\[]") & F.try_parse_json(text).isNotNull()
    # A string alone can't be written as JSON; one in an array can.
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).when(inside, F.regexp_replace(text, r"[\r\n]", " ")).otherwise(
        F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    )


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under `root`: path relative to it, length and bytes.

    The bytes are read only where they are used.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    prefix = F.lit(base.rstrip("/") + "/")
    prefix = F.regexp_replace(prefix, "^file:/+", "file:/")
    return files.select(F.replace(plain, prefix, F.lit("")).alias("path"), "length", "content")


def library_files(files: DataFrame) -> DataFrame:
    """C and C++ files under src/ and tests/ with their role."""
    path = F.col("path")
    inside = path.startswith("src/") | path.startswith("tests/")
    return files.filter(inside & P.extension(path).isin(*CPP_EXTENSIONS)).withColumn("source_role", P.library_role(path))


def package_files(files: DataFrame, package: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Source and JSON files of the package's scope with their role."""
    path = F.col("path")
    scope = F.lit(False)
    for root in PACKAGE_SCOPE:
        scope = scope | path.startswith(root.format(package=package) + "/")
    for root in excluded:
        scope = scope & ~path.startswith(root.rstrip("/") + "/")
    known = P.extension(path).isin(*P.LANGUAGES)
    return files.filter(scope & known).withColumn("source_role", P.package_role(path, package))


def decoded(files: DataFrame) -> DataFrame:
    """Files as text with their language; those that are not UTF-8 are left to `undecodable`."""
    return files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select(
        "path", "source_role", P.language(F.col("path")).alias("language"),
        F.decode("content", "UTF-8").alias("content"),
    )


def undecodable(files: DataFrame, repository: str | Column) -> DataFrame:
    """Files whose bytes are no UTF-8 text, as problems: they are skipped."""
    return files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select(
        *problem(repository, F.col("path"), SKIPPED, F.lit("not UTF-8 text"))
    )


def inventory_files(files: DataFrame, package: str) -> DataFrame:
    """Directory, extension and role of every file in scope."""
    rules = P.for_package(P.INVENTORY_ROLE_RULES, package)
    root = P.inventory_root(F.col("path"), rules)
    return files.withColumn("directory", root).filter("directory IS NOT NULL").select(
        "path", "directory",
        F.coalesce(F.nullif(P.extension(F.col("path")), F.lit("")), F.lit("[no extension]")).alias("extension"),
        P.inventory_role(F.col("path"), rules).alias("source_role"),
    )


def raw_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Chunker output, one pretty-printed JSON document per source file, as rows."""
    documents = spark.read.schema(RAW_PAYLOAD).option("multiLine", "true").json(path)
    return documents.select("file", "language", F.posexplode("chunks").alias("position", "c")).select(
        "file", "language", F.coalesce("c.chunk_index", "position").cast("long").alias("chunk_index"),
        *[F.col(f"c.{f.name}").alias(f.name) for f in RAW_PAYLOAD["chunks"].dataType.elementType
          if f.name not in ("chunk_index", "language")],
    )
