"""Section, window and statement splitting: documents as commented functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from spanloom.config import PREAMBLE_TITLE, ChunkConfig
from spanloom.functions import text as T
from spanloom.functions.binding import let
from spanloom.functions.scan import scanned
from spanloom.operators import sections as S
from spanloom.operators.corpus import distribution, threshold_counts
from spanloom.plans import corpus_build as B
from spanloom.session import new_table_path, written
from spanloom.sources.corpus import undecodable
from spanloom.sources.tables import texts

# Smaller limits than the default ones, so that most documents are oversized.
CONFIG = ChunkConfig(oversized_bytes=600, window_lines=4)


def functions(spark, sf_dir):
    """Documents whose lines become separators, comment titles and statements.

    Of every nine lines the first and third are separators and the second is a
    title, except where a document's number makes the title plain text.
    """
    lines = F.split("text", "\n")

    def shaped(line, i):
        return (
            F.when((i % 9 == 0) | (i % 9 == 2), "    //----------------")
            .when((i % 9 == 1) & (F.col("doc_id") % 4 != 3), F.concat(F.lit("// "), line)).otherwise(line)
        )

    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), F.col("source").alias("source_path"),
        F.array_join(F.transform(lines, shaped), "\n").alias("content"),
        F.lit(10).cast("long").alias("start_line"), (F.size(lines) + 9).cast("long").alias("end_line"),
        F.lit(100).cast("long").alias("byte_start"))


def with_nodes(spark, sf_dir):
    """Every line that is no comment is a statement; its type follows its length."""
    def node(line, start, end):
        kind = F.when(line.rlike(r"^\s*//"), "comment").when(F.length(line) % 2 == 0, "declaration").otherwise("expression_statement")
        return F.struct(kind.alias("type"), start.alias("start"), end.alias("end"))

    def nodes(lines):
        sizes = F.transform(lines, lambda line: F.octet_length(line).cast("long"))
        return let(scanned(sizes, F.lit(0).cast("long"), lambda a, b: a + b), lambda ends: F.transform(
            lines, lambda line, i: node(line, F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long")), F.get(ends, i))))

    # A text's lines lie in its row, so nothing is shuffled for them.
    return functions(spark, sf_dir).filter("content <> ''").withColumn("nodes", let(T.lines(F.col("content")), nodes))


def line_table(spark, sf_dir):
    return S.line_table(functions(spark, sf_dir)).select(
        "chunk_id", "line_index", "byte_start", "byte_end", F.sha2("line", 256).alias("line_sha"))


def header_blocks(spark, sf_dir):
    blocks = functions(spark, sf_dir).select("chunk_id", F.explode(S.header_blocks(F.col("content"))).alias("b"))
    return blocks.select("chunk_id", F.when(F.col("b.issue").isNull(), F.col("b.title")).alias("title"),
                         F.col("b.local_byte_start").alias("local_byte_start"),
                         F.col("b.relative_line").cast("long").alias("relative_line"), F.col("b.issue").alias("issue"))


def safe_headers(spark, sf_dir):
    """Headers against nodes that span two lines, so that some fall inside one."""
    rows = _wide_nodes(spark, sf_dir).select(
        "chunk_id", S.safe_headers(S.headers(S.header_blocks(F.col("content"))), F.col("nodes")).alias("safe"))
    return rows.select("chunk_id", F.explode("safe").alias("h")).select(
        "chunk_id", F.col("h.local_byte_start").alias("local_byte_start"))


def _wide_nodes(spark, sf_dir):
    """Every line as a node, and every fifth of them reaches into the next one."""
    base = with_nodes(spark, sf_dir)
    wide = F.transform("nodes", lambda n, i: F.struct(
        F.when(i % 5 == 0, "for_statement").otherwise(n["type"]).alias("type"), n["start"].alias("start"),
        (n["end"] + F.when(i % 5 == 0, 2).otherwise(0)).alias("end")))
    return base.withColumn("nodes", wide)


def header_conflicts(spark, sf_dir):
    return S.header_conflicts(_wide_nodes(spark, sf_dir)).withColumn("relative_line", F.col("relative_line").cast("long"))


def section_spans(spark, sf_dir):
    """Section chunks before any size subdivision."""
    config = ChunkConfig(oversized_bytes=1 << 30)
    found = S.section_chunks(with_nodes(spark, sf_dir), config)
    return found.select(
        F.col("original_function_chunk_id").alias("function"), F.col("section_index").cast("long").alias("section_index"),
        "section_title", "chunk_type", "chunk_id", "start_line", "end_line", "byte_start", "byte_end",
        F.array_join("node_types", ",").alias("node_types"), F.sha2("content", 256).alias("content_sha"))


def section_pieces(spark, sf_dir, config=CONFIG):
    """Section chunks with oversized sections packed at statements."""
    found = S.section_chunks(with_nodes(spark, sf_dir), config)
    return found.select(
        F.col("original_function_chunk_id").alias("function"), F.col("section_index").cast("long").alias("section_index"),
        F.col("subchunk_index").cast("long").alias("subchunk_index"), "chunk_type", "chunk_id", "byte_start", "byte_end")


def greedy_pack(spark, sf_dir):
    """Whole documents packed at their line starts."""
    rows = S.line_table(functions(spark, sf_dir))
    edges = rows.groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.concat(
        F.collect_list("byte_start"), F.array(F.max("byte_end"))))).alias("edges"))
    spans = edges.select("chunk_id", F.posexplode(S.pack_boundaries(F.col("edges"), CONFIG.oversized_bytes)).alias("piece", "s"))
    return spans.select("chunk_id", "piece", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def line_windows(spark, sf_dir, config=ChunkConfig()):
    return S.window_chunks(functions(spark, sf_dir), config).select(
        F.col("parent_chunk_id").alias("chunk_id"), F.col("subchunk_index").cast("long").alias("subchunk_index"),
        "start_line", "end_line", "byte_start", "byte_end", F.sha2("content", 256).alias("content_sha"))


def statement_segments(spark, sf_dir, config=CONFIG):
    return S.statement_chunks(with_nodes(spark, sf_dir), config).select(
        F.col("parent_chunk_id").alias("chunk_id"), F.col("subchunk_index").cast("long").alias("subchunk_index"),
        "start_line", "byte_start", "byte_end", "boundary_start", "boundary_end", F.sha2("content", 256).alias("content_sha"))


def _policy_rows(spark, sf_dir):
    base = with_nodes(spark, sf_dir)
    rows = None
    for policy in ("D1", "D2", "D3"):
        part = S.policy_chunks(base, policy, CONFIG).withColumn("policy", F.lit(policy))
        rows = part if rows is None else rows.unionByName(part)
    # Read by several aggregates: the texts are cut once.
    return written(rows.select("policy", "file", "byte_start", "byte_end"), "policies")


def policy_totals(spark, sf_dir):
    """Chunks, bytes and median size of each splitting policy over all files."""
    rows = _policy_rows(spark, sf_dir).select("policy", "file", (F.col("byte_end") - F.col("byte_start")).alias("size"))
    totals = rows.groupBy("policy").agg(F.countDistinct("file").alias("files"), F.sum("size").alias("bytes"))
    return distribution(rows, "size", ["policy"]).select("policy", F.col("count").alias("chunks"), "median").join(totals, "policy")


def pieces_by_parent(spark, sf_dir):
    """Every function with how many line windows it was cut into and how many bytes these cover."""
    parents = functions(spark, sf_dir)
    pieces = S.window_chunks(parents, CONFIG).groupBy("parent_chunk_id").agg(
        F.count("*").alias("pieces"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    return parents.join(pieces, F.col("chunk_id") == F.col("parent_chunk_id"), "left").select(
        "chunk_id", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def policy_comparison(spark, sf_dir):
    """Chunk counts and sizes of the three splitting policies per file."""
    rows = _policy_rows(spark, sf_dir)
    size = F.col("byte_end") - F.col("byte_start")
    counts = rows.groupBy("policy", "file").agg(
        F.count("*").alias("chunks"), F.min(size).alias("min"), F.max(size).alias("max"), F.round(F.avg(size), 6).alias("mean"))
    return counts.join(threshold_counts(rows, size, ["policy", "file"], [], [600]), ["policy", "file"])


def byte_line_numbers(spark, sf_dir):
    """Lines at the first, middle and last third of each text's bytes."""
    size = F.octet_length("text").cast("long")
    offsets = F.array(F.lit(0).cast("long"), (size / 3).cast("long"), (size * 2 / 3).cast("long"), size)
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.explode(S.line_numbers(F.col("text"), offsets)).alias("x"))
    return docs.select("doc_id", "x.*")


def byte_slices(spark, sf_dir):
    """Every line of each text cut out by its byte range."""
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    lines = S.line_table(docs)
    return lines.join(docs, "chunk_id").select(
        "chunk_id", "byte_start", "byte_end",
        F.sha2(S.slice_text(F.col("content"), F.col("byte_start"), F.col("byte_end")), 256).alias("slice_sha"))


def corpus_problems(spark, sf_dir):
    """Documents as case files, one of fifty no text at all: chunks, problems and summary are written and read back."""
    files = functions(spark, sf_dir).withColumn("path", F.concat("file", F.lit("/"), "chunk_id", F.lit(".cpp")))
    raw = files.withColumn("content", F.when(F.col("chunk_id") % 50 == 0, F.unhex(F.lit("ff"))).otherwise(F.encode("content", "UTF-8")))
    repository = F.col("file")
    texts_only = raw.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.decode("content", "UTF-8"))
    chunks = texts_only.select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.lit("simulation_case").alias("source_role"), repository.alias("repository"),
        F.lit("function_definition").alias("chunk_type"), F.lit(0).cast("long").alias("byte_start"),
        F.octet_length("content").cast("long").alias("byte_end"))
    problems = B.section_problems(texts_only.withColumn("source_path", F.col("path")), repository).unionByName(undecodable(raw, repository))
    output = new_table_path(spark, "corpus")
    B.write_report(spark, chunks, problems, output)
    counted = B.read_summary(spark, output).select("counts_by_repository", F.explode("problems").alias("p"))
    lines = B.read_problems(spark, output).groupBy("repository", "kind").agg(F.sum("line").alias("line_sum"))
    return counted.select("p.*", F.try_element_at("counts_by_repository", F.col("p.repository")).alias("chunks")).join(
        lines, ["repository", "kind"])


_FUNCTIONS = """raw AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
shaped AS (SELECT doc_id, source, list_transform(range(1, len(parts) + 1), lambda j: CASE WHEN (j - 1) % 9 IN (0, 2) THEN '    //----------------'
    WHEN (j - 1) % 9 = 1 AND doc_id % 4 <> 3 THEN '// ' || parts[j] ELSE parts[j] END) AS parts FROM raw),
texts AS (SELECT doc_id AS chunk_id, source AS file, array_to_string(parts, chr(10)) AS content, parts FROM shaped),
listed AS (SELECT chunk_id, file, content, len(parts) AS n, unnest(range(0, len(parts))) AS line_index, unnest(parts) AS body FROM texts),
lines AS (SELECT *, CAST(byte_end - strlen(line) AS BIGINT) AS byte_start FROM (
  SELECT *, CAST(sum(strlen(line)) OVER (PARTITION BY chunk_id ORDER BY line_index) AS BIGINT) AS byte_end FROM (
    SELECT chunk_id, file, content, n, line_index, body, body || CASE WHEN line_index < n - 1 THEN chr(10) ELSE '' END AS line FROM listed) WHERE line <> '')),
nodes AS (SELECT chunk_id, line_index, byte_start AS s, byte_end AS e, CASE WHEN regexp_matches(line, '^\\s*//') THEN 'comment'
   WHEN length(line) % 2 = 0 THEN 'declaration' ELSE 'expression_statement' END AS t FROM lines),
seps AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY line_index) AS k, lead(line_index) OVER (PARTITION BY chunk_id ORDER BY line_index) AS closing
   FROM lines WHERE regexp_matches(body, '^\\s*//-{10,}\\s*$')),
blocks AS (SELECT s.chunk_id, s.byte_start AS local_byte_start, s.line_index + 1 AS relative_line, closing,
   (SELECT coalesce(bool_and(regexp_matches(l.body, '^\\s*//\\s?(.*)$')), true) FROM lines l WHERE l.chunk_id = s.chunk_id AND l.line_index > s.line_index AND l.line_index < s.closing) AS comments,
   (SELECT string_agg(trim(regexp_extract(l.body, '^\\s*//\\s?(.*)$', 1)), ' ' ORDER BY l.line_index) FROM lines l WHERE l.chunk_id = s.chunk_id AND l.line_index > s.line_index
      AND l.line_index < s.closing AND trim(regexp_extract(l.body, '^\\s*//\\s?(.*)$', 1)) <> '') AS title FROM seps s WHERE k % 2 = 1),
judged AS (SELECT *, CASE WHEN closing IS NULL THEN 'missing closing separator' WHEN NOT comments OR title IS NULL THEN 'separator block has no usable comment title' END AS issue FROM blocks),
heads AS (SELECT * FROM judged WHERE issue IS NULL)"""
_SECTIONS = _FUNCTIONS + f""",
starts AS (SELECT chunk_id, local_byte_start AS s, title FROM heads UNION ALL SELECT DISTINCT chunk_id, 0, '{PREAMBLE_TITLE}' FROM heads),
sections AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY s, title <> '{PREAMBLE_TITLE}') - 1 AS section_index,
   coalesce(lead(s) OVER (PARTITION BY chunk_id ORDER BY s, title <> '{PREAMBLE_TITLE}'), (SELECT strlen(content) FROM texts x WHERE x.chunk_id = starts.chunk_id)) AS e FROM starts)"""


def _pack(edges: str, key: str) -> str:
    """Recursive packing of `edges` (key columns, i, pos) into spans of at most 600 bytes."""
    same = " AND ".join(f"x.{k} = p.{k}" for k in key.split(", "))
    return f"""fold AS (
  SELECT {key}, i, pos AS opened, pos AS prior, NULL::BIGINT AS cut_start, NULL::BIGINT AS cut_end FROM {edges} WHERE i = 1
  UNION ALL SELECT {', '.join('p.' + k for k in key.split(', '))}, x.i, CASE WHEN p.prior > p.opened AND x.pos - p.opened > 600 THEN p.prior ELSE p.opened END, x.pos,
    CASE WHEN p.prior > p.opened AND x.pos - p.opened > 600 THEN p.opened END, CASE WHEN p.prior > p.opened AND x.pos - p.opened > 600 THEN p.prior END
  FROM fold p JOIN {edges} x ON {same} AND x.i = p.i + 1),
pieces AS (SELECT {key}, cut_start AS a, cut_end AS b FROM fold WHERE cut_start IS NOT NULL
  UNION ALL SELECT {key}, opened, prior FROM fold QUALIFY i = max(i) OVER (PARTITION BY {key}))"""


_NL = "(length({t}) - length(replace({t}, chr(10), '')))"
_LINE = "1 + coalesce((SELECT count(*) FROM lines l WHERE l.chunk_id = {c} AND l.line LIKE '%' || chr(10) AND l.byte_end <= {o}), 0)"
_LAST = "greatest(1, (SELECT max(l.line_index) + 1 FROM lines l WHERE l.chunk_id = {c} AND l.byte_start < {o}))"
_SEGMENT_EDGES = """edges AS (SELECT chunk_id, pos, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS i FROM (
  SELECT DISTINCT chunk_id, s AS pos FROM nodes WHERE t <> 'comment' UNION SELECT chunk_id, 0 FROM texts UNION SELECT chunk_id, strlen(content) FROM texts))"""
_D_ROWS = f"""sized AS (SELECT chunk_id, file, strlen(content) AS size FROM texts),
w AS (SELECT chunk_id, file, line_index // 4 AS piece, min(byte_start) AS a, max(byte_end) AS b FROM lines GROUP BY ALL),
rows AS (SELECT 'D1' AS policy, file, size FROM sized UNION ALL SELECT 'D2', file, size FROM sized WHERE size <= 600 UNION ALL SELECT 'D3', file, size FROM sized WHERE size <= 600
  UNION ALL SELECT 'D2', w.file, b - a FROM w JOIN sized USING (chunk_id) WHERE size > 600
  UNION ALL SELECT 'D3', file, b - a FROM pieces JOIN sized USING (chunk_id) WHERE size > 600)"""

WORKLOADS = {
    "line_table": (line_table, f"WITH {_FUNCTIONS} SELECT chunk_id, CAST(line_index AS INTEGER) AS line_index, byte_start, byte_end, sha256(line) AS line_sha FROM lines"),
    "section_headers": (header_blocks, f"WITH {_FUNCTIONS} SELECT chunk_id, CASE WHEN issue IS NULL THEN title END AS title, local_byte_start, relative_line, issue FROM judged"),
    "safe_headers": (safe_headers, f"""WITH {_FUNCTIONS}, wide AS (SELECT chunk_id, s, e + CASE WHEN (row_number() OVER (PARTITION BY chunk_id ORDER BY s) - 1) % 5 = 0 THEN 2 ELSE 0 END AS e FROM nodes)
        SELECT chunk_id, local_byte_start FROM heads h WHERE NOT EXISTS (SELECT 1 FROM wide n WHERE n.chunk_id = h.chunk_id AND n.s < h.local_byte_start AND h.local_byte_start < n.e)"""),
    "header_conflicts": (header_conflicts, f"""WITH {_FUNCTIONS}, wide AS (SELECT chunk_id, s, e + CASE WHEN (row_number() OVER (PARTITION BY chunk_id ORDER BY s) - 1) % 5 = 0 THEN 2 ELSE 0 END AS e FROM nodes)
        SELECT h.chunk_id, title, relative_line, 'for_statement' AS containing_node_type FROM heads h JOIN wide n ON n.chunk_id = h.chunk_id AND n.s < h.local_byte_start AND h.local_byte_start < n.e"""),
    "section_spans": (section_spans, f"""WITH {_SECTIONS} SELECT chunk_id AS function, section_index, title AS section_title, 'semantic_section' AS chunk_type,
        sha1(chunk_id || ':e1:' || section_index || ':0:' || s || ':' || e) AS chunk_id, 9 + {_LINE.format(c='sections.chunk_id', o='s')} AS start_line,
        CASE WHEN e = 0 THEN 10 ELSE 9 + {_LAST.format(c='sections.chunk_id', o='e')} END AS end_line, 100 + s AS byte_start, 100 + e AS byte_end,
        coalesce((SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM nodes n WHERE n.chunk_id = sections.chunk_id AND n.s < sections.e AND sections.s < n.e), '') AS node_types,
        sha256(coalesce((SELECT string_agg(line, '' ORDER BY line_index) FROM lines l WHERE l.chunk_id = sections.chunk_id AND l.byte_start >= sections.s AND l.byte_end <= sections.e), '')) AS content_sha FROM sections"""),
    "section_pieces": (section_pieces, f"""WITH RECURSIVE {_SECTIONS}, edges AS (SELECT chunk_id, section_index, pos, row_number() OVER (PARTITION BY chunk_id, section_index ORDER BY pos) AS i FROM (
          SELECT chunk_id, section_index, s AS pos FROM sections UNION SELECT chunk_id, section_index, e FROM sections
          UNION SELECT x.chunk_id, section_index, n.s FROM sections x JOIN nodes n ON n.chunk_id = x.chunk_id AND n.s > x.s AND n.s < x.e AND n.t <> 'comment' WHERE x.e - x.s > 600)),
        {_pack('edges', 'chunk_id, section_index')},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, section_index ORDER BY a, b) - 1 AS j FROM pieces)
        SELECT n.chunk_id AS function, n.section_index, j AS subchunk_index, CASE WHEN a = s AND b = e THEN 'semantic_section' ELSE 'semantic_section_tree_sitter_subchunk' END AS chunk_type,
          sha1(n.chunk_id || ':e1:' || n.section_index || ':' || j || ':' || a || ':' || b) AS chunk_id, 100 + a AS byte_start, 100 + b AS byte_end
        FROM numbered n JOIN sections x ON x.chunk_id = n.chunk_id AND x.section_index = n.section_index"""),
    "greedy_pack": (greedy_pack, f"""WITH RECURSIVE {_FUNCTIONS}, edges AS (SELECT chunk_id, pos, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS i FROM (
          SELECT chunk_id, byte_start AS pos FROM lines UNION SELECT chunk_id, max(byte_end) FROM lines GROUP BY 1)), {_pack('edges', 'chunk_id')}
        SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY a) - 1 AS INTEGER) AS piece, a AS start, b AS end FROM pieces"""),
    "line_windows_50": (line_windows, f"""WITH {_FUNCTIONS}, w AS (SELECT chunk_id, line_index // 50 AS subchunk_index, 10 + min(line_index) AS start_line, 10 + max(line_index) AS end_line,
          100 + min(byte_start) AS byte_start, 100 + max(byte_end) AS byte_end, sha256(string_agg(line, '' ORDER BY line_index)) AS content_sha FROM lines GROUP BY 1, 2) SELECT * FROM w"""),
    "statement_segments": (statement_segments, f"""WITH RECURSIVE {_FUNCTIONS}, {_SEGMENT_EDGES}, {_pack('edges', 'chunk_id')},
        n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY a) - 1 AS j FROM pieces),
        m AS (SELECT n.*, strlen(x.content) AS total FROM n JOIN texts x USING (chunk_id))
        SELECT m.chunk_id, j AS subchunk_index, 9 + {_LINE.format(c='m.chunk_id', o='a')} AS start_line, 100 + a AS byte_start, 100 + b AS byte_end,
          CASE WHEN a = 0 THEN 'function_signature_and_opening_brace' WHEN a = total THEN 'function_closing_brace' ELSE (SELECT any_value(t) FROM nodes d WHERE d.chunk_id = m.chunk_id AND d.s = a) END AS boundary_start,
          CASE WHEN b = 0 THEN 'function_signature_and_opening_brace' WHEN b = total THEN 'function_closing_brace' ELSE (SELECT any_value(t) FROM nodes d WHERE d.chunk_id = m.chunk_id AND d.s = b) END AS boundary_end,
          sha256(coalesce((SELECT string_agg(line, '' ORDER BY line_index) FROM lines l WHERE l.chunk_id = m.chunk_id AND l.byte_start >= a AND l.byte_end <= b), '')) AS content_sha FROM m"""),
    "policy_comparison": (policy_comparison, f"""WITH RECURSIVE {_FUNCTIONS}, {_SEGMENT_EDGES}, {_pack('edges', 'chunk_id')}, {_D_ROWS}
        SELECT policy, file, count(*) AS chunks, min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean, count(*) FILTER (size > 600) AS gt_600_bytes FROM rows GROUP BY 1, 2"""),
    "policy_totals": (policy_totals, f"""WITH RECURSIVE {_FUNCTIONS}, {_SEGMENT_EDGES}, {_pack('edges', 'chunk_id')}, {_D_ROWS}
        SELECT policy, count(*) AS chunks, median(size) AS median, count(DISTINCT file) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM rows GROUP BY 1"""),
    "pieces_by_parent": (pieces_by_parent, f"""WITH {_FUNCTIONS} SELECT t.chunk_id, count(DISTINCT l.line_index // 4) AS pieces, CAST(coalesce(sum(strlen(l.line)), 0) AS BIGINT) AS bytes
        FROM texts t LEFT JOIN lines l USING (chunk_id) GROUP BY 1"""),
    "byte_line_numbers": (byte_line_numbers, """WITH o AS (SELECT doc_id, text, unnest([0, CAST(floor(strlen(text) / 3) AS BIGINT), CAST(floor(strlen(text) * 2 / 3) AS BIGINT), strlen(text)]) AS "offset" FROM documents),
        cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
        ends AS (SELECT doc_id, sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM cut)
        SELECT doc_id, "offset", 1 + (SELECT count(*) FROM ends WHERE ends.doc_id = o.doc_id AND e <= "offset") AS line,
          1 + (SELECT count(*) FROM ends WHERE ends.doc_id = o.doc_id AND e < "offset") AS last_line FROM o"""),
    "byte_slices": (byte_slices, """WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(0, len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents),
        lines AS (SELECT doc_id, i, n, part || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END AS line FROM cut),
        kept AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM lines WHERE line <> '')
        SELECT doc_id AS chunk_id, CAST(e - strlen(line) AS BIGINT) AS byte_start, CAST(e AS BIGINT) AS byte_end, sha256(line) AS slice_sha FROM kept"""),
}

WORKLOADS["corpus_problems"] = (corpus_problems, f"""WITH {_FUNCTIONS},
  found AS (SELECT x.file AS repository, 'section_warning' AS kind, j.chunk_id, 9 + relative_line AS line FROM judged j JOIN texts x USING (chunk_id) WHERE issue IS NOT NULL AND j.chunk_id % 50 <> 0
    UNION ALL SELECT file, 'skipped_file', chunk_id, NULL FROM texts WHERE chunk_id % 50 = 0)
  SELECT repository, kind, count(DISTINCT chunk_id) AS files, count(*) AS problems, CAST(sum(line) AS BIGINT) AS line_sum,
    (SELECT nullif(count(*), 0) FROM texts t WHERE t.file = repository AND t.chunk_id % 50 <> 0) AS chunks FROM found GROUP BY 1, 2""")

# The same with windows of four lines, and with the default limit of 5,000 bytes.
_DEFAULT = ChunkConfig()
WORKLOADS |= {
    "line_windows_4": (partial(line_windows, config=CONFIG), WORKLOADS["line_windows_50"][1].replace("// 50", "// 4")),
    "section_pieces_5000": (partial(section_pieces, config=_DEFAULT), WORKLOADS["section_pieces"][1].replace("> 600", "> 5000")),
    "statement_segments_5000": (partial(statement_segments, config=_DEFAULT), WORKLOADS["statement_segments"][1].replace("> 600", "> 5000")),
}
