"""Corpus assembly, invariants and summaries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.config import CORPUS_REQUIRED_FIELDS
from spanloom.functions import jsontext as J
from spanloom.functions import paths as P
from spanloom.operators import corpus as C
from spanloom.plans.corpus_build import config_documents, context_json, is_primary, symbol_of
from spanloom.session import new_table_path
from spanloom.sources.corpus import (
    inventory_files, json_lines, library_files, package_files, read_corpus, write_corpus,
)
from spanloom.sources.tables import document_chunks, table
from spanloom.workloads.texts import _PATHS_SQL, PACKAGE, _page_paths

_written: dict[tuple[str, str], str] = {}


def _corpus_lines(spark, sf_dir):
    """`documents` written once as JSON lines."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = new_table_path(spark, "corpus")
        write_corpus(document_chunks(spark, sf_dir), path)
        _written[key] = path
    return _written[key]


def jsonl_scan(spark, sf_dir):
    """Written as JSON lines and read back with the corpus schema."""
    chunks = read_corpus(spark, _corpus_lines(spark, sf_dir))
    return chunks.select("chunk_id", "repository", "source_role", "symbol", "section_title", "byte_end", "end_line",
                         F.sha2("content", 256).alias("content_sha"), "parent_context")


def raw_line_scan(spark, sf_dir):
    """Raw lines: each an object with every key, nulls included."""
    lines = json_lines(spark, _corpus_lines(spark, sf_dir))
    return lines.select(
        F.get_json_object("value", "$.chunk_id").alias("chunk_id"),
        F.size(F.json_object_keys("value")).cast("long").alias("keys"),
        F.size(J.missing_fields(F.col("value"), ("symbol", "section_title"))).cast("long").alias("missing"))


def _page_documents(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".json")).alias("path"), F.col("html").alias("content"))
    return config_documents(pages, "pages")


def corpus_union(spark, sf_dir):
    """Documents and pages as one corpus, counted per repository, role and type."""
    both = C.combine(document_chunks(spark, sf_dir), _page_documents(spark, sf_dir))
    return both.groupBy("repository", "source_role", "chunk_type").agg(
        F.count("*").alias("chunks"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"),
        F.count("section_title").alias("titled"))


def grouping_counts(spark, sf_dir):
    return C.group_counts(document_chunks(spark, sf_dir), ["source_role", "repository", "chunk_type"])


def size_distribution(spark, sf_dir):
    sized = document_chunks(spark, sf_dir).select("source_role", (F.col("byte_end") - F.col("byte_start")).alias("size"))
    return C.distribution(sized, "size", ["source_role"]).withColumn("mean", F.round("mean", 6))


def size_distribution_all(spark, sf_dir):
    sized = document_chunks(spark, sf_dir).select((F.col("byte_end") - F.col("byte_start")).alias("size"))
    return C.distribution(sized, "size").withColumn("mean", F.round("mean", 6))


def oversized(spark, sf_dir):
    size = F.col("byte_end") - F.col("byte_start")
    return C.threshold_counts(document_chunks(spark, sf_dir), size, ["repository"], [50, 100, 200], [2000, 5000, 10000])


def _damaged_lines(spark, sf_dir):
    """Corpus lines of which some lack a field or hold a null."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(
        F.lit('{"chunk_id": "'), n, F.lit('"'),
        F.when(n % 5 != 0, ', "repository": "r"').otherwise(""),
        F.when(n % 7 != 0, ', "source_role": null').otherwise(""),
        F.lit(', "source_path": "p", "content": '), F.to_json(F.array("text")), F.lit("}")).alias("value"))


def required_fields(spark, sf_dir):
    bad = C.incomplete_lines(_damaged_lines(spark, sf_dir), CORPUS_REQUIRED_FIELDS)
    return bad.select(F.get_json_object("value", "$.chunk_id").alias("chunk_id"), F.array_join("missing", ",").alias("missing"))


def duplicate_ids(spark, sf_dir):
    """Ids made of the content: exact copies collide."""
    ids = table(spark, sf_dir, "documents").select(F.sha1("text").alias("chunk_id"))
    return C.duplicates(ids, "chunk_id")


def config_document_chunks(spark, sf_dir):
    """Event properties as JSON files, some cut short."""
    body = F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("\n"))).when(
        F.col("event_id") % 4 == 1, F.left("props", F.lit(5))).otherwise(F.col("props"))
    files = table(spark, sf_dir, "events").select(
        F.concat(F.lit("conf/"), "event_type", F.lit("_"), F.col("event_id"), F.lit(".json")).alias("path"), body.alias("content"))
    return config_documents(files, "conf").select(
        "chunk_id", "source_path", "symbol", "end_line", "byte_end",
        F.get_json_object("structural_metadata", "$.json_parse_success").alias("parses"))


def file_inventory(spark, sf_dir):
    files = inventory_files(_page_paths(spark, sf_dir), PACKAGE)
    return C.inventory(files)


def source_scope(spark, sf_dir):
    """Files that the two corpus builds take, with their roles."""
    paths = _page_paths(spark, sf_dir)
    library = library_files(paths).withColumn("build", F.lit("library"))
    package = package_files(paths, PACKAGE, [f"{PACKAGE}/visualization"]).withColumn("build", F.lit("package"))
    return library.unionByName(package).select("build", "path", "source_role", P.language(F.col("path")).alias("language"))


def tagged_warnings(spark, sf_dir):
    """Parse warnings of two corpora as one list with their repository."""
    docs = table(spark, sf_dir, "documents")
    first = docs.filter(F.col("text").contains("&")).select(
        F.col("doc_id").cast("string").alias("source_path")).withColumn("repository", F.lit("documents"))
    pages = table(spark, sf_dir, "pages").filter(~J.is_valid(F.col("html"))).select(
        F.col("page_id").cast("string").alias("source_path")).withColumn("repository", F.lit("pages"))
    return C.combine(first, pages)


def _raw(spark, sf_dir):
    """Order lines as raw chunks with signatures and routes of every kind."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(n % 4 == 0, F.concat(F.lit("fn"), F.col("l_partkey"))).when(n % 4 == 1, F.concat(F.lit("anon@"), n)).when(
            n % 4 == 2, F.lit("")).alias("signature"),
        F.when(n % 3 == 0, F.array(F.lit("class:A"), F.concat(F.lit("function:m:"), n))).when(
            n % 3 == 1, F.array(F.concat(F.lit("function:anon@"), n))).otherwise(empty).alias("qualified_route"),
        F.when(n % 2 == 0, F.array(F.lit("namespace:N"))).otherwise(empty).alias("parent_route"),
        F.when(n % 5 == 0, "class_definition").when(n % 5 == 1, "method_declaration").otherwise("function_definition").alias("node_type"),
        F.when(n % 2 == 0, "python").otherwise("cpp").alias("language"))


def raw_symbols(spark, sf_dir):
    """Symbol, parent context and primary flag of raw chunks, counted."""
    rows = _raw(spark, sf_dir).select(
        symbol_of(F.col("signature"), F.col("qualified_route")).alias("symbol"),
        context_json(F.lit("ctx"), F.col("parent_route"), F.col("qualified_route")).alias("context"),
        is_primary(F.col("node_type"), F.col("language")).alias("is_primary"))
    return rows.groupBy(F.coalesce("symbol", F.lit("(none)")).alias("symbol"), "context", "is_primary").agg(F.count("*").alias("chunks"))


_DOCS = """d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_id, source AS repository, lang AS source_role, 'document' AS chunk_type,
  regexp_extract(text, '^([^.\\n]*)', 1) AS head, doc_id % 3 <> 0 AS keyed, strlen(text) AS size,
  length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, text FROM documents)"""

WORKLOADS = {
    "jsonl_scan": (jsonl_scan, f"""WITH {_DOCS} SELECT chunk_id, repository, source_role, CASE WHEN keyed THEN head END AS symbol, CASE WHEN NOT keyed THEN head END AS section_title,
        size AS byte_end, end_line, sha256(text) AS content_sha, '{{"parent": "' || source_role || '", "route": null}}' AS parent_context FROM d"""),
    "raw_line_scan": (raw_line_scan, f"WITH {_DOCS} SELECT chunk_id, CAST(14 AS BIGINT) AS keys, CAST(0 AS BIGINT) AS missing FROM d"),
    "corpus_union": (corpus_union, f"""WITH {_DOCS}, u AS (SELECT repository, source_role, chunk_type, size, NOT keyed AS titled FROM d
        UNION ALL SELECT 'pages', 'config_or_schema', 'config_document', strlen(html), false FROM pages)
        SELECT repository, source_role, chunk_type, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (titled) AS titled FROM u GROUP BY ALL"""),
    "corpus_grouping_sets": (grouping_counts, f"""WITH {_DOCS} SELECT CASE WHEN source_role IS NOT NULL THEN 'source_role' WHEN repository IS NOT NULL THEN 'repository' ELSE 'chunk_type' END AS dimension,
        coalesce(source_role, repository, chunk_type) AS value, count(*) AS chunks FROM d GROUP BY GROUPING SETS ((source_role), (repository), (chunk_type))"""),
    "size_distribution": (size_distribution, f"WITH {_DOCS} SELECT source_role, count(*) AS count, min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean, median(size) AS median FROM d GROUP BY 1"),
    "size_distribution_all": (size_distribution_all, f"WITH {_DOCS} SELECT count(*) AS count, min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean, median(size) AS median FROM d"),
    "oversized_counts": (oversized, f"""WITH {_DOCS} SELECT repository, count(*) FILTER (size < 50) AS lt_50_bytes, count(*) FILTER (size < 100) AS lt_100_bytes, count(*) FILTER (size < 200) AS lt_200_bytes,
        count(*) FILTER (size > 2000) AS gt_2000_bytes, count(*) FILTER (size > 5000) AS gt_5000_bytes, count(*) FILTER (size > 10000) AS gt_10000_bytes FROM d GROUP BY 1"""),
    "corpus_required_fields": (required_fields, """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, array_to_string(list_concat(CASE WHEN doc_id % 5 = 0 THEN ['repository'] ELSE [] END,
        CASE WHEN doc_id % 7 = 0 THEN ['source_role'] ELSE [] END), ',') AS missing FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0"""),
    "duplicate_ids": (duplicate_ids, "SELECT sha1(text) AS chunk_id, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "config_documents": (config_document_chunks, """WITH f AS (SELECT event_id, 'conf/' || event_type || '_' || event_id || '.json' AS path, event_type || '_' || event_id AS symbol,
          CASE event_id % 4 WHEN 0 THEN props || chr(10) WHEN 1 THEN left(props, 5) ELSE props END AS content FROM events)
        SELECT sha1('conf:config_document:' || path || ':' || sha1(content)) AS chunk_id, path AS source_path, symbol, CAST(1 AS BIGINT) AS end_line, strlen(content) AS byte_end,
          CASE WHEN event_id % 4 = 1 THEN 'false' ELSE 'true' END AS parses FROM f"""),
    "file_inventory": (file_inventory, f"""WITH {_PATHS_SQL}, s AS (SELECT regexp_extract(path, '^(sim/[a-z_]+|examples|tests)/', 1) AS directory, coalesce(nullif(extension, ''), '[no extension]') AS extension FROM parts
          WHERE regexp_matches(path, '^(sim/[a-z_]+|examples|tests)/')),
        r AS (SELECT *, CASE directory WHEN 'sim/bindings' THEN 'simulator_library' WHEN 'sim/config' THEN 'config/schema' WHEN 'sim/llm' THEN 'llm_support' WHEN 'sim/sph_simulation' THEN 'simulator_library'
          WHEN 'sim/visualization' THEN 'visualization' WHEN 'examples' THEN 'simulation_example' ELSE 'test' END AS role FROM s)
        SELECT 'directory' AS dimension, directory AS value, count(*) AS chunks FROM r GROUP BY 2 UNION ALL SELECT 'extension', extension, count(*) FROM r GROUP BY 2
        UNION ALL SELECT 'source_role', role, count(*) FROM r GROUP BY 2"""),
    "source_scope": (source_scope, f"""WITH {_PATHS_SQL}, t AS (SELECT *, CASE extension WHEN '.cpp' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.json' THEN 'json' WHEN '.py' THEN 'python' END AS language FROM parts)
        SELECT 'library' AS build, path, CASE WHEN path LIKE 'src/%' THEN 'core_library' WHEN starts_with(path, 'tests/unit_tests_src/') THEN 'unit_test'
             WHEN starts_with(path, 'tests/optimization/') THEN 'optimization_case' WHEN starts_with(path, 'tests/tests_sycl/') THEN 'sycl_case'
             WHEN starts_with(path, 'tests/extra_source_and_tests/') THEN 'extra_source_or_test' ELSE 'simulation_case' END AS source_role, language
          FROM t WHERE language = 'cpp' AND regexp_matches(path, '^(src|tests)/')
        UNION ALL SELECT 'package', path, CASE WHEN extension = '.json' THEN 'config_or_schema' WHEN starts_with(path, 'sim/bindings/') THEN 'binding' WHEN starts_with(path, 'sim/config/') THEN 'config_or_schema'
             WHEN starts_with(path, 'sim/llm/') THEN 'llm_support' WHEN starts_with(path, 'sim/sph_simulation/') THEN 'simulator_library' WHEN starts_with(path, 'examples/') THEN 'simulation_example' ELSE 'test' END, language
          FROM t WHERE language IS NOT NULL AND regexp_matches(path, '^(sim|examples|tests)/') AND NOT starts_with(path, 'sim/visualization/')"""),
    "corpus_warnings": (tagged_warnings, """SELECT CAST(doc_id AS VARCHAR) AS source_path, 'documents' AS repository FROM documents WHERE contains(text, '&')
        UNION ALL SELECT CAST(page_id AS VARCHAR), 'pages' FROM pages WHERE NOT json_valid(html)"""),
    "raw_symbols": (raw_symbols, """WITH r AS (SELECT l_orderkey + l_linenumber AS n, l_partkey FROM lineitem),
        s AS (SELECT coalesce(CASE WHEN n % 4 = 0 THEN 'fn' || l_partkey WHEN n % 3 = 0 THEN 'm:' || n END, '(none)') AS symbol,
          '{"parent_context":"ctx","parent_route":' || CASE WHEN n % 2 = 0 THEN '["namespace:N"]' ELSE '[]' END || ',"qualified_route":'
            || CASE WHEN n % 3 = 0 THEN '["class:A","function:m:' || n || '"]' WHEN n % 3 = 1 THEN '["function:anon@' || n || '"]'
                    WHEN n % 2 = 0 THEN '["namespace:N"]' ELSE '[]' END || '}' AS context,
          CASE WHEN n % 2 = 0 THEN n % 5 <> 1 ELSE n % 5 <> 0 END AS is_primary FROM r)
        SELECT symbol, context, is_primary, count(*) AS chunks FROM s GROUP BY ALL"""),
}
