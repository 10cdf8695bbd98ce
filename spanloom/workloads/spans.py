"""Span analytics: order lines as byte spans of their supplier's file."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.render import table_row, two_decimals
from spanloom.operators import corpus as C
from spanloom.operators import spans as S
from spanloom.operators.corpus import distribution, threshold_counts
from spanloom.session import new_table_path
from spanloom.sources import fileoutputs as O
from spanloom.sources.tables import table

_TYPES = {
    ("A", "F"): "function_definition", ("A", "O"): "method_declaration", ("N", "F"): "class_specifier",
    ("N", "O"): "struct_specifier", ("R", "F"): "template_declaration",
}


def span_table(spark, sf_dir, file_key: str = "l_suppkey"):
    """A span per order line; the index is unique as key, line and part together are."""
    kind = F.lit("field_declaration")
    for (flag, status), name in _TYPES.items():
        kind = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), name).otherwise(kind)
    start = F.col("l_partkey") % 997
    return table(spark, sf_dir, "lineitem").select(
        F.col(file_key).alias("file"),
        (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("chunk_index"),
        start.alias("byte_start"), (start + F.col("l_quantity").cast("long")).alias("byte_end"), kind.alias("node_type"))


_SPANS_SQL = """spans AS (SELECT l_suppkey AS file, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS chunk_index,
  l_partkey % 997 AS byte_start, l_partkey % 997 + CAST(l_quantity AS BIGINT) AS byte_end,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'function_definition' WHEN 'AO' THEN 'method_declaration' WHEN 'NF' THEN 'class_specifier'
    WHEN 'NO' THEN 'struct_specifier' WHEN 'RF' THEN 'template_declaration' ELSE 'field_declaration' END AS node_type FROM lineitem)"""
_CONTAINS = """p.file = c.file AND p.byte_start <= c.byte_start AND c.byte_end <= p.byte_end
  AND p.byte_end - p.byte_start > c.byte_end - c.byte_start"""
_RETAINED = "('class_specifier','struct_specifier','template_declaration','function_definition','method_declaration')"
_UNION_SQL = """SELECT file, CAST(sum(greatest(0, byte_end - greatest(byte_start, coalesce(prior, byte_start)))) AS BIGINT) AS unique_covered_bytes FROM (
  SELECT *, max(byte_end) OVER (PARTITION BY file ORDER BY byte_start, byte_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {t}) GROUP BY file"""
_PARENT_SQL = f"""parents AS (SELECT c.file, c.chunk_index, c.node_type, c.byte_start, c.byte_end, count(*) AS containing_chunk_count,
  arg_min(p.chunk_index, (p.byte_end - p.byte_start, p.chunk_index)) AS parent_index FROM spans c JOIN spans p ON {_CONTAINS} GROUP BY ALL)"""


def nested_spans(spark, sf_dir):
    return S.nested_spans(span_table(spark, sf_dir))


def outermost(spark, sf_dir):
    return S.outermost_spans(S.retained(span_table(spark, sf_dir)))


def interval_union(spark, sf_dir):
    return S.coverage(span_table(spark, sf_dir))


def overlap_metrics(spark, sf_dir):
    return S.overlap_metrics(span_table(spark, sf_dir)).withColumn(
        "duplication_factor", F.round("duplication_factor", 6))


def overlap_by_policy(spark, sf_dir):
    """Overlap per policy and file with a total per policy: the sum of the files."""
    spans = span_table(spark, sf_dir)
    policies = spans.withColumn("policy", F.lit("A")).unionByName(
        S.retained(spans).withColumn("policy", F.lit("B"))).unionByName(S.primary(spans).withColumn("policy", F.lit("D")))
    per_file = S.overlap_metrics(policies, ["policy", "file"])
    sums = ["chunk_count", "nested_chunk_count", "total_chunk_bytes_sum", "unique_covered_bytes", "redundancy_bytes"]
    rolled = per_file.rollup("policy", "file").agg(*[F.sum(c).alias(c) for c in sums])
    factor = F.round(F.col("total_chunk_bytes_sum") / F.col("unique_covered_bytes"), 6)
    return rolled.filter("policy IS NOT NULL").withColumn("duplication_factor", factor).withColumn(
        "file", F.coalesce(F.col("file").cast("string"), F.lit("(all)")))


def direct_parent(spark, sf_dir):
    return S.direct_parents(span_table(spark, sf_dir)).select(
        "file", "chunk_index", "node_type", "containing_chunk_count", "parent_index", "parent_node_type",
        (F.col("parent_byte_end") - F.col("parent_byte_start")).alias("parent_size"))


def examples(spark, sf_dir):
    found = S.example_relations(S.direct_parents(span_table(spark, sf_dir)))
    return found.select("file", F.col("place").cast("long").alias("place"), "chunk_index", "node_type", "parent_index")


def policy_counts(spark, sf_dir):
    return S.policy_counts(span_table(spark, sf_dir))


def policy_b_types(spark, sf_dir):
    return S.retained(span_table(spark, sf_dir)).groupBy("node_type").agg(F.count("*").alias("chunks"))


def policy_d_split(spark, sf_dir):
    spans = span_table(spark, sf_dir)
    return S.primary(spans).withColumn("use", F.lit("retrieval")).unionByName(
        S.context_only(spans).withColumn("use", F.lit("context"))).groupBy("file", "use").agg(
        F.count("*").alias("chunks"), F.sum(S.size()).alias("bytes"))


def exact_spans(spark, sf_dir):
    """All order lines as syntax nodes, matched with all spans, of which a third end a byte later."""
    spans = span_table(spark, sf_dir)
    nodes = spans.withColumn(
        "node_type", F.when(F.col("node_type").isin("function_definition", "method_declaration"), "function_definition").otherwise("class_specifier"))
    moved = spans.withColumn("byte_end", F.col("byte_end") + (F.col("chunk_index") % 3 == 0).cast("int"))
    return S.exact_span_matches(nodes, moved)


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("point_id"), "l_linenumber",
        (F.col("l_orderkey") % 1050).alias("point"))


def points_inside(spark, sf_dir):
    """Headers that fall strictly inside a function or method, against all others."""
    points = _points(spark, sf_dir).groupBy("file", "point").agg(F.count("*").alias("points"))
    found = S.points_inside(points, S.primary(span_table(spark, sf_dir)), ["file"], unique=True)
    return found.select("file", "point", "inside", "points")


def overlapping_types(spark, sf_dir):
    """Node types that overlap each hundred-byte section of a file."""
    spans = span_table(spark, sf_dir)
    ranges = spans.select("file", (F.floor(F.col("byte_start") / 100) * 100).alias("range_start")).distinct().withColumn(
        "range_end", F.col("range_start") + 100)
    return S.node_types_in(ranges, spans, ["file"]).select(
        "file", "range_start", "range_end", F.array_join("node_types", ",").alias("node_types"))


def main_function(spark, sf_dir):
    """First document of each source that calls main(, with the documents' sizes."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").alias("chunk_index"), F.lit("function_definition").alias("node_type"),
        F.regexp_replace("text", r"\bwith ", "main (").alias("content"))
    return S.main_functions(docs).select("file", "chunk_index", F.length("content").cast("long").alias("chars"))


def _documents_as_chunks(spark, sf_dir):
    start = F.col("doc_id") % 50
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").alias("chunk_index"), start.alias("byte_start"),
        (start + F.octet_length("text") % 400).alias("byte_end"),
        F.when(F.col("doc_id") % 3 == 0, "function_definition").otherwise("declaration").alias("node_type"),
        F.regexp_replace("text", r"\bwith ", "main (").alias("content"))


def main_children(spark, sf_dir):
    return S.main_children(_documents_as_chunks(spark, sf_dir))


def file_summaries(spark, sf_dir):
    return C.file_summaries(span_table(spark, sf_dir)).select(
        "file", "total_chunks", F.array_join("node_types", ",").alias("node_types"), "minimum_bytes", "maximum_bytes",
        F.round("average_bytes", 6).alias("average_bytes"))


def file_round_trip(spark, sf_dir, named=None):
    """Payload and summary of every file, or of the named ones, written, read back and matched."""
    root = new_table_path(spark, "files")
    spans = span_table(spark, sf_dir).withColumn("file", F.concat(F.lit("src/file "), "file", F.lit(".cpp")))
    O.write_file_outputs(spans, root)
    summaries = O.read_summaries(spark, root, named)
    return O.matched(O.read_payloads(spark, root, spans.schema, named), summaries).join(
        summaries.select("file", "minimum_bytes", "maximum_bytes"), "file", "left")


def most_common_types(spark, sf_dir):
    return C.most_common(span_table(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


def file_checks(spark, sf_dir):
    """Suppliers as listed files: source files checked against their spans, others listed."""
    files = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("file"), F.col("s_name").alias("purpose"), F.concat("s_name", F.lit("\nx")).alias("content"),
        F.element_at(F.array(F.lit("cpp"), F.lit("python"), F.lit("json")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("language"))
    spans = span_table(spark, sf_dir)
    nodes = spans.withColumn(
        "node_type", F.when(F.col("node_type") == "method_declaration", "function_definition").otherwise(F.col("node_type")))
    intact = S.exact_span_matches(nodes, spans.withColumn(
        "byte_end", F.col("byte_end") + (F.col("chunk_index") % 97 == 0).cast("int")))
    return C.file_checks(files, spans, intact).select(
        "file", "purpose", "language", "chunking_checked", F.col("line_count").cast("long").alias("line_count"),
        F.coalesce("raw_chunk_count", F.lit(-1)).alias("raw_chunk_count"), F.coalesce("median", F.lit(-1.0)).alias("median"),
        F.coalesce("lt_100_bytes", F.lit(-1)).alias("tiny"), F.coalesce("gt_5000_bytes", F.lit(-1)).alias("oversized"),
        F.coalesce(F.col("all_intact").cast("string"), F.lit("not checked")).alias("intact"))


def file_sizes(spark, sf_dir):
    """Size distribution per file."""
    sized = span_table(spark, sf_dir).withColumn("size", S.size())
    return distribution(sized, "size", ["file"]).withColumn("mean", F.round("mean", 6))


def type_histogram(spark, sf_dir):
    return span_table(spark, sf_dir).groupBy("file", "node_type").agg(F.count("*").alias("chunks"))


def tiny_and_large(spark, sf_dir):
    return threshold_counts(span_table(spark, sf_dir), S.size(), ["file"], [5, 10, 20], [20, 40])


def overview_rows(spark, sf_dir):
    """The overlap table of a report, one Markdown row per file."""
    m = S.overlap_metrics(span_table(spark, sf_dir))
    return m.select("file", table_row(
        F.col("file").cast("string"), F.col("chunk_count").cast("string"), F.col("nested_chunk_count").cast("string"),
        two_decimals(F.col("duplication_factor"))).alias("row"))


def _metrics_sql(table_name: str, keys: str) -> str:
    join = " AND ".join(f"p.{k} = c.{k}" for k in keys.split(", "))
    contains = _CONTAINS.replace("p.file = c.file", join)
    return f"""(SELECT {keys}, count(*) AS chunk_count, CAST(sum(byte_end - byte_start) AS BIGINT) AS total_chunk_bytes_sum,
      CAST(coalesce(sum(byte_end - byte_start) FILTER (nested), 0) AS BIGINT) AS nested_chunk_bytes_sum, count(*) FILTER (nested) AS nested_chunk_count
      FROM (SELECT c.*, EXISTS (SELECT 1 FROM {table_name} p WHERE {contains}) AS nested FROM {table_name} c) GROUP BY {keys})"""


_OVERLAP_SQL = f"""m AS (SELECT * FROM {_metrics_sql('spans', 'file')} JOIN ({_UNION_SQL.format(t='spans')}) USING (file))"""

WORKLOADS = {
    "nested_semi": (nested_spans, f"WITH {_SPANS_SQL} SELECT * FROM spans c WHERE EXISTS (SELECT 1 FROM spans p WHERE {_CONTAINS})"),
    "policy_c_anti": (outermost, f"WITH {_SPANS_SQL}, kept AS (SELECT * FROM spans WHERE node_type IN {_RETAINED}) SELECT * FROM kept c WHERE NOT EXISTS (SELECT 1 FROM kept p WHERE {_CONTAINS})"),
    "interval_union": (interval_union, f"WITH {_SPANS_SQL} {_UNION_SQL.format(t='spans')}"),
    "overlap_metrics": (overlap_metrics, f"""WITH {_SPANS_SQL}, {_OVERLAP_SQL} SELECT *, chunk_count - nested_chunk_count AS top_level_chunk_count,
        total_chunk_bytes_sum - unique_covered_bytes AS redundancy_bytes, round(total_chunk_bytes_sum / unique_covered_bytes, 6) AS duplication_factor FROM m"""),
    "overlap_by_policy": (overlap_by_policy, f"""WITH {_SPANS_SQL}, named AS (SELECT *, 'A' AS policy FROM spans UNION ALL SELECT *, 'B' FROM spans WHERE node_type IN {_RETAINED}
          UNION ALL SELECT *, 'D' FROM spans WHERE node_type IN ('function_definition','method_declaration')),
        u AS ({_UNION_SQL.format(t='named').replace('SELECT file,', 'SELECT policy, file,').replace('PARTITION BY file', 'PARTITION BY policy, file').replace('GROUP BY file', 'GROUP BY policy, file')}),
        m AS (SELECT * FROM {_metrics_sql('named', 'policy, file')} JOIN u USING (policy, file))
        SELECT policy, coalesce(CAST(file AS VARCHAR), '(all)') AS file, CAST(sum(chunk_count) AS BIGINT) AS chunk_count, CAST(sum(nested_chunk_count) AS BIGINT) AS nested_chunk_count,
          CAST(sum(total_chunk_bytes_sum) AS BIGINT) AS total_chunk_bytes_sum, CAST(sum(unique_covered_bytes) AS BIGINT) AS unique_covered_bytes,
          CAST(sum(total_chunk_bytes_sum - unique_covered_bytes) AS BIGINT) AS redundancy_bytes,
          round(sum(total_chunk_bytes_sum) / sum(unique_covered_bytes), 6) AS duplication_factor FROM m GROUP BY GROUPING SETS ((policy, file), (policy))"""),
    "direct_parent": (direct_parent, f"""WITH {_SPANS_SQL}, {_PARENT_SQL} SELECT n.file, n.chunk_index, n.node_type, containing_chunk_count, parent_index,
        p.node_type AS parent_node_type, p.byte_end - p.byte_start AS parent_size FROM parents n JOIN spans p ON p.file = n.file AND p.chunk_index = n.parent_index"""),
    "top3_per_type": (examples, f"""WITH {_SPANS_SQL}, {_PARENT_SQL}, rel AS (SELECT n.*, p.node_type AS parent_type, list_position(['function_definition','method_declaration',
          'template_declaration','field_declaration','class_specifier','struct_specifier'], n.node_type) AS tp FROM parents n JOIN spans p ON p.file = n.file AND p.chunk_index = n.parent_index),
        pick AS (SELECT *, row_number() OVER (PARTITION BY file, tp ORDER BY byte_end - byte_start DESC, chunk_index) AS r FROM rel
          WHERE parent_type IN ('class_specifier','struct_specifier','template_declaration') QUALIFY r <= 3),
        chosen AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY tp, r) AS place FROM pick QUALIFY place <= 12),
        rest AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunk_index) AS place FROM rel WHERE file NOT IN (SELECT file FROM chosen) QUALIFY place <= 12)
        SELECT file, place, chunk_index, node_type, parent_index FROM chosen UNION ALL SELECT file, place, chunk_index, node_type, parent_index FROM rest"""),
    "policy_counts": (policy_counts, f"""WITH {_SPANS_SQL}, kept AS (SELECT *, EXISTS (SELECT 1 FROM spans p WHERE p.node_type IN {_RETAINED} AND {_CONTAINS}) AS nested FROM spans c WHERE node_type IN {_RETAINED}),
        r AS (SELECT file, 'A' AS policy, 'retrieval' AS selection, node_type FROM spans UNION ALL SELECT file, 'B', 'retrieval', node_type FROM kept
          UNION ALL SELECT file, 'C', CASE WHEN nested THEN 'removed' ELSE 'retrieval' END, node_type FROM kept
          UNION ALL SELECT file, 'D', CASE WHEN node_type IN ('function_definition','method_declaration') THEN 'retrieval' ELSE 'context' END, node_type FROM kept)
        SELECT file, policy, selection, node_type, count(*) AS chunks FROM r GROUP BY ALL"""),
    "policy_b_types": (policy_b_types, f"WITH {_SPANS_SQL} SELECT node_type, count(*) AS chunks FROM spans WHERE node_type IN {_RETAINED} GROUP BY 1"),
    "policy_d_split": (policy_d_split, f"""WITH {_SPANS_SQL} SELECT file, CASE WHEN node_type IN ('function_definition','method_declaration') THEN 'retrieval' ELSE 'context' END AS use,
        count(*) AS chunks, CAST(sum(byte_end - byte_start) AS BIGINT) AS bytes FROM spans WHERE node_type IN {_RETAINED} GROUP BY ALL"""),
    "exact_span_semi": (exact_spans, f"""WITH {_SPANS_SQL}, nodes AS (SELECT file, byte_start, byte_end, CASE WHEN node_type IN ('function_definition','method_declaration')
          THEN 'function_definition' ELSE 'class_specifier' END AS node_type FROM spans),
        hit AS (SELECT DISTINCT file, byte_start, byte_end + CASE WHEN chunk_index % 3 = 0 THEN 1 ELSE 0 END AS byte_end, CASE WHEN node_type = 'method_declaration' THEN 'function_definition' ELSE node_type END AS node_type FROM spans),
        j AS (SELECT n.file, n.node_type, h.file IS NOT NULL AS hit FROM nodes n LEFT JOIN hit h USING (file, byte_start, byte_end, node_type))
        SELECT file, node_type, count(*) AS ast_count, count(*) FILTER (hit) AS raw_chunk_exact_span_count, count(*) = count(*) FILTER (hit) AS all_intact FROM j GROUP BY ALL"""),
    "points_inside": (points_inside, f"""WITH {_SPANS_SQL}, pts AS (SELECT l_suppkey AS file, l_orderkey % 1050 AS point, count(*) AS points FROM lineitem GROUP BY ALL)
        SELECT file, point, EXISTS (SELECT 1 FROM spans s WHERE s.file = pts.file AND s.node_type IN ('function_definition','method_declaration')
          AND s.byte_start < pts.point AND pts.point < s.byte_end) AS inside, points FROM pts"""),
    "overlapping_types": (overlapping_types, f"""WITH {_SPANS_SQL}, ranges AS (SELECT DISTINCT file, byte_start // 100 * 100 AS range_start, byte_start // 100 * 100 + 100 AS range_end FROM spans)
        SELECT r.file, range_start, range_end, string_agg(DISTINCT node_type, ',' ORDER BY node_type) AS node_types FROM ranges r JOIN spans s
          ON r.file = s.file AND s.byte_start < range_end AND range_start < s.byte_end GROUP BY ALL"""),
    "find_main": (main_function, r"""SELECT source AS file, doc_id AS chunk_index, length(regexp_replace(text, '\bwith ', 'main (', 'g')) AS chars FROM documents
        WHERE regexp_matches(regexp_replace(text, '\bwith ', 'main (', 'g'), '\bmain\s*\(') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1"""),
    "main_children": (main_children, r"""WITH c AS (SELECT source AS file, doc_id AS chunk_index, doc_id % 50 AS byte_start, doc_id % 50 + strlen(text) % 400 AS byte_end,
          CASE WHEN doc_id % 3 = 0 THEN 'function_definition' ELSE 'declaration' END AS node_type, regexp_replace(text, '\bwith ', 'main (', 'g') AS content FROM documents),
        m AS (SELECT * FROM c WHERE node_type = 'function_definition' AND regexp_matches(content, '\bmain\s*\(') QUALIFY row_number() OVER (PARTITION BY file ORDER BY chunk_index) = 1)
        SELECT c.file, m.chunk_index AS main_index, c.chunk_index, c.node_type, c.byte_start, c.byte_end FROM c JOIN m ON m.file = c.file AND m.byte_start <= c.byte_start
          AND c.byte_end <= m.byte_end AND m.byte_end - m.byte_start > c.byte_end - c.byte_start""".replace("\\", "\\")),
    "file_summaries": (file_summaries, f"""WITH {_SPANS_SQL} SELECT file, count(*) AS total_chunks, string_agg(DISTINCT node_type, ',' ORDER BY node_type) AS node_types,
        min(byte_end - byte_start) AS minimum_bytes, max(byte_end - byte_start) AS maximum_bytes, round(avg(byte_end - byte_start), 6) AS average_bytes FROM spans GROUP BY file"""),
    "file_round_trip": (file_round_trip, f"""WITH {_SPANS_SQL} SELECT 'src/file ' || file || '.cpp' AS file, count(*) AS chunks, count(*) AS total_chunks, 'matched' AS status,
        min(byte_end - byte_start) AS minimum_bytes, max(byte_end - byte_start) AS maximum_bytes FROM spans GROUP BY file"""),
    "most_common_types": (most_common_types, f"""WITH {_SPANS_SQL}, g AS (SELECT file, node_type, count(*) AS chunks FROM spans GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunks DESC, node_type) AS place FROM g"""),
    "file_checks": (file_checks, f"""WITH {_SPANS_SQL}, nodes AS (SELECT file, byte_start, byte_end, CASE WHEN node_type = 'method_declaration' THEN 'function_definition' ELSE node_type END AS node_type
          FROM spans),
        hit AS (SELECT DISTINCT file, byte_start, byte_end + CASE WHEN chunk_index % 97 = 0 THEN 1 ELSE 0 END AS byte_end, CASE WHEN node_type = 'method_declaration' THEN 'function_definition' ELSE node_type END AS node_type FROM spans),
        i AS (SELECT n.file, bool_and(h.file IS NOT NULL) AS ok FROM nodes n LEFT JOIN hit h USING (file, byte_start, byte_end, node_type) GROUP BY 1),
        z AS (SELECT file, count(*) AS n, median(byte_end - byte_start) AS med, count(*) FILTER (byte_end - byte_start < 100) AS tiny, count(*) FILTER (byte_end - byte_start > 5000) AS big FROM spans GROUP BY 1),
        f AS (SELECT s_suppkey AS file, s_name AS purpose, ['cpp','python','json'][s_suppkey % 3 + 1] AS language, s_suppkey % 3 <> 2 AS checked FROM supplier)
        SELECT f.file, purpose, language, checked AS chunking_checked, CAST(2 AS BIGINT) AS line_count, CASE WHEN checked THEN coalesce(n, 0) ELSE -1 END AS raw_chunk_count,
          CASE WHEN checked THEN coalesce(med, 0) ELSE -1.0::DOUBLE END AS median, CASE WHEN checked THEN coalesce(tiny, 0) ELSE -1 END AS tiny, CASE WHEN checked THEN coalesce(big, 0) ELSE -1 END AS oversized,
          CASE WHEN checked THEN CASE WHEN coalesce(ok, true) THEN 'true' ELSE 'false' END ELSE 'not checked' END AS intact FROM f LEFT JOIN z USING (file) LEFT JOIN i USING (file)"""),
    "span_size_distribution": (file_sizes, f"""WITH {_SPANS_SQL} SELECT file, count(*) AS count, min(byte_end - byte_start) AS min, max(byte_end - byte_start) AS max,
        round(avg(byte_end - byte_start), 6) AS mean, median(byte_end - byte_start) AS median FROM spans GROUP BY file"""),
    "node_type_histogram": (type_histogram, f"WITH {_SPANS_SQL} SELECT file, node_type, count(*) AS chunks FROM spans GROUP BY ALL"),
    "size_thresholds": (tiny_and_large, f"""WITH {_SPANS_SQL}, z AS (SELECT file, byte_end - byte_start AS s FROM spans) SELECT file, count(*) FILTER (s < 5) AS lt_5_bytes,
        count(*) FILTER (s < 10) AS lt_10_bytes, count(*) FILTER (s < 20) AS lt_20_bytes, count(*) FILTER (s > 20) AS gt_20_bytes, count(*) FILTER (s > 40) AS gt_40_bytes FROM z GROUP BY file"""),
    "overview_rows": (overview_rows, f"""WITH {_SPANS_SQL}, {_OVERLAP_SQL} SELECT file, '| ' || file || ' | ' || chunk_count || ' | ' || nested_chunk_count || ' | '
        || printf('%.2f', total_chunk_bytes_sum / unique_covered_bytes) || ' |' AS row FROM m"""),
}
