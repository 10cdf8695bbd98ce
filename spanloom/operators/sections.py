"""Splitting long texts: comment-title sections, statement packing, line windows.

A text and its syntax nodes lie in one row, and so do the pieces cut from them:
these operators are expressions over the row and shuffle nothing. Offsets of
lines, reaches of nodes and sections are running results over sorted arrays, and
a piece finds its lines and nodes in them by binary search, so a long text costs
little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import PREAMBLE_TITLE, ChunkConfig
from spanloom.functions import text as T
from spanloom.functions.binding import let
from spanloom.functions.scan import count_below, scanned

# --------------------------------------------------------------------------
# Separator and comment lines, issue texts and boundary labels.
# --------------------------------------------------------------------------
SEPARATOR_LINE = f"^{T.SPACE}*//-{{10,}}{T.SPACE}*$"
COMMENT_LINE = f"^{T.SPACE}*//{T.SPACE}?(.*)$"
ISSUE_OPEN = "missing closing separator"
ISSUE_TITLE = "separator block has no usable comment title"
LABEL_START = "function_signature_and_opening_brace"
LABEL_END = "function_closing_brace"
LABEL_OTHER = "tree_sitter_statement_boundary"


def _body(line: Column) -> Column:
    """A line without its terminator."""
    return F.regexp_replace(line, f"{T.LINE_END}$", "")


def _summed(sizes: Column) -> Column:
    return scanned(sizes, F.lit(0).cast("long"), lambda a, b: a + b)


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


def header_blocks(content: Column) -> Column:
    """Every separator block of a text, as an array of structs in text order.

    Separator lines pair up as opener and closer. A block is a header when all
    lines between are comments and one has words; `issue` says why it is not.
    """

    def blocks(lines: Column) -> Column:
        bodies = F.transform(lines, _body)
        sizes = F.transform(lines, lambda line: F.octet_length(line).cast("long"))
        return let(bodies, lambda rows: let(_summed(sizes), lambda ends: paired(rows, ends)))

    def paired(rows: Column, ends: Column) -> Column:
        def with_bodies(rows: Column) -> Column:
            marks = F.filter(
                F.transform(rows, lambda row, i: F.when(row.rlike(SEPARATOR_LINE), i)), lambda i: i.isNotNull()
            )

            def with_marks(at: Column) -> Column:
                openers = F.filter(F.transform(at, lambda i, n: F.when(n % 2 == 0, F.struct(
                    i.alias("open"), F.get(at, n + 1).alias("close")
                ))), lambda p: p.isNotNull())

                def block(pair: Column) -> Column:
                    inner = F.slice(rows, pair["open"] + 2, F.coalesce(pair["close"] - pair["open"] - 1, F.lit(0)))
                    titles = F.filter(
                        F.transform(inner, lambda r: T.strip(F.regexp_extract(r, COMMENT_LINE, 1))),
                        lambda t: t != "",
                    )
                    usable = F.forall(inner, lambda r: r.rlike(COMMENT_LINE)) & (F.size(titles) > 0)
                    return F.struct(
                        F.array_join(titles, " ").alias("title"),
                        F.coalesce(F.get(ends, pair["open"] - 1), F.lit(0)).cast("long").alias("local_byte_start"),
                        (pair["open"] + 1).alias("relative_line"),
                        F.when(pair["close"].isNull(), ISSUE_OPEN).when(~usable, ISSUE_TITLE).alias("issue"),
                    )

                return F.transform(openers, block)

            return let(marks, with_marks)

        return with_bodies(rows)

    return let(T.lines(content), blocks)


def headers(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["issue"].isNull())


def issues(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["issue"].isNotNull())


def ordered_nodes(nodes: Column, skip_comments: bool = False) -> Column:
    """A struct of arrays over the nodes by start: `starts`, `reach` (the furthest end so far), and `nodes` (start, end, type)."""
    kept = F.filter(nodes, lambda n: n["type"] != "comment") if skip_comments else nodes
    sorted_nodes = F.array_sort(F.transform(kept, lambda n: F.struct(
        n["start"].cast("long").alias("start"), n["end"].cast("long").alias("end"), n["type"].alias("type")
    )))
    return let(sorted_nodes, lambda rows: F.struct(
        F.transform(rows, lambda n: n["start"]).alias("starts"),
        scanned(F.transform(rows, lambda n: n["end"]), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b)).alias("reach"),
        rows.alias("nodes"),
    ))


def safe_headers(found: Column, nodes: Column) -> Column:
    """Headers that do not fall strictly inside a syntax node other than a comment.

    A header is inside iff the furthest end of the nodes that start before it
    lies beyond it.
    """
    def safe(code: Column) -> Column:
        def reached(at: Column) -> Column:
            return F.coalesce(F.get(code["reach"], count_below(code["starts"], at) - 1), F.lit(-1))

        return F.filter(found, lambda h: reached(h["local_byte_start"]) <= h["local_byte_start"])

    return let(ordered_nodes(nodes, skip_comments=True), safe)


def pack_boundaries(boundaries: Column, limit: int) -> Column:
    """Spans cut at sorted boundaries so that none passes `limit` where avoidable.

    A span is closed at the last boundary before the one that would take it past
    the limit. A single piece longer than the limit stays whole. The fold keeps
    the open span's start and the boundary before; finished spans are added only
    at a cut.
    """
    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))),
                    lambda s: F.lit(False))
    first = F.get(boundaries, F.lit(0)).cast("long")
    state = F.struct(first.alias("open"), first.alias("last"), none.alias("done"))

    def step(acc: Column, edge: Column) -> Column:
        edge = edge.cast("long")
        cut = (acc["last"] > acc["open"]) & (edge - acc["open"] > limit)
        return F.struct(
            F.when(cut, acc["last"]).otherwise(acc["open"]).alias("open"),
            edge.alias("last"),
            F.when(cut, F.concat(acc["done"], F.array(
                F.struct(acc["open"].alias("start"), acc["last"].alias("end"))
            ))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["open"].alias("start"), acc["last"].alias("end"))))

    return F.aggregate(F.slice(boundaries, F.lit(2), F.size(boundaries)), state, step, finish)


def section_pieces(found: Column, nodes: Column, total: Column, config: ChunkConfig) -> Column:
    """Pieces of the sections that start at the text's start and at each header.

    A section within the size limit is one piece; a longer one is packed at the
    starts of its statements.
    """
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(found, lambda h: h["local_byte_start"]))
    titles = F.concat(F.array(F.lit(PREAMBLE_TITLE)), F.transform(found, lambda h: h["title"]))
    statements = F.array_sort(F.array_distinct(
        F.transform(F.filter(nodes, lambda n: n["type"] != "comment"), lambda n: n["start"].cast("long"))
    ))

    def section(title: Column, i: Column, at: Column, inner: Column) -> Column:
        start = F.get(at, i)
        end = F.coalesce(F.get(at, i + 1), total).cast("long")
        first = count_below(inner, start, inclusive=True)
        own = F.slice(inner, first + 1, F.greatest(count_below(inner, end) - first, F.lit(0)))
        edges = F.array_distinct(F.concat(F.array(start), own, F.array(end)))
        whole = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(end - start <= config.oversized_bytes, whole).otherwise(
            pack_boundaries(edges, config.oversized_bytes)
        )
        return F.transform(spans, lambda s, j: F.struct(
            i.alias("section_index"), j.alias("subchunk_index"), title.alias("title"),
            s["start"].alias("start"), s["end"].alias("end"),
            ((s["start"] == start) & (s["end"] == end)).alias("whole_section"),
        ))

    return let(starts, lambda at: let(
        statements, lambda inner: F.flatten(F.transform(titles, lambda t, i: section(t, i, at, inner)))
    ))


def text_bytes(content: Column) -> Column:
    return F.encode(content, "UTF-8")


def slice_text(content: Column, start: Column, end: Column) -> Column:
    """Text of the byte range [start, end)."""
    return F.decode(F.substring(text_bytes(content), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def _cut(data: Column, start: Column, end: Column) -> Column:
    """Text of the byte range [start, end) of a text's bytes."""
    return F.decode(F.substring(data, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def break_ends(content: Column) -> Column:
    """The offsets after every newline, ascending, and at last one beyond the text."""
    return _summed(F.transform(F.split(content, "\n"), lambda part: F.octet_length(part).cast("long") + 1))


def line_of(breaks: Column, offset: Column) -> Column:
    """1-based line that holds a byte offset, which may lie inside a character."""
    return (count_below(breaks, offset, inclusive=True) + 1).cast("long")


def last_line_of(breaks: Column, end: Column) -> Column:
    """1-based line of the last byte before an exclusive end."""
    return (count_below(breaks, end) + 1).cast("long")


def line_numbers(content: Column, offsets: Column) -> Column:
    """(offset, line, last_line) of every offset in an array."""
    return let(break_ends(content), lambda breaks: F.transform(offsets, lambda at: F.struct(
        at.alias("offset"), line_of(breaks, at).alias("line"), last_line_of(breaks, at).alias("last_line")
    )))


def line_at(content: Column, offset: Column) -> Column:
    """1-based line that holds a byte offset. For one offset of a text; see `line_numbers` for many."""
    return let(break_ends(content), lambda breaks: line_of(breaks, offset))


def last_line_before(content: Column, end: Column) -> Column:
    """1-based line of the last byte before an exclusive end. For one offset of a text."""
    return let(break_ends(content), lambda breaks: last_line_of(breaks, end))


def node_types_within(ordered: Column, start: Column, end: Column) -> Column:
    """Sorted types of the nodes (see `ordered_nodes`) that overlap [start, end)."""
    first = count_below(ordered["reach"], start, inclusive=True)
    near = F.slice(ordered["nodes"], first + 1, F.greatest(count_below(ordered["starts"], end) - first, F.lit(0)))
    hit = F.filter(near, lambda n: n["end"] > start)
    return F.array_sort(F.array_distinct(F.transform(hit, lambda n: n["type"])))


def line_windows(content: Column, window: int) -> Column:
    """Consecutive windows of `window` lines with byte offsets, as an array."""

    def windows(rows: Column) -> Column:
        count = F.ceil(F.size(rows) / F.lit(window)).cast("int")
        parts = F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count),
            lambda i: F.struct(
                i.alias("index"),
                F.array_join(F.slice(rows, i * window + 1, F.lit(window)), "").alias("content"),
                F.least(F.lit(window), F.size(rows) - i * window).alias("line_count"),
            ),
        )

        def placed(chunks: Column) -> Column:
            sizes = F.transform(chunks, lambda part: F.octet_length(part["content"]).cast("long"))
            return let(_summed(sizes), lambda ends: F.transform(chunks, lambda part, i: F.struct(
                part["index"].alias("index"), part["content"].alias("content"), part["line_count"].alias("line_count"),
                F.coalesce(F.get(ends, i - 1), F.lit(0)).cast("long").alias("start"), F.get(ends, i).alias("end"),
            )))

        return let(parts, placed)

    return let(T.lines(content), windows)


def statement_segments(content: Column, nodes: Column, config: ChunkConfig) -> Column:
    """Segments of an oversized text, cut at the line starts of its statements.

    Each segment carries its text, its first line and the labels of its two
    boundaries. A statement that starts inside a line is cut at that line's
    start. Of the statements that share a line start, the last one names it.
    """
    total = F.octet_length(content).cast("long")
    code = F.filter(nodes, lambda n: n["type"] != "comment")

    def segments(breaks: Column, data: Column) -> Column:
        def snapped(node: Column, i: Column) -> Column:
            begun = F.coalesce(F.get(breaks, count_below(breaks, node["start"], inclusive=True) - 1), F.lit(0))
            return F.struct(begun.cast("long").alias("at"), i.alias("i"), node["type"].alias("type"))

        def named(places: Column) -> Column:
            return let(F.transform(places, lambda p: p["at"]), lambda at: cut(places, at))

        def cut(places: Column, at: Column) -> Column:
            edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), total), at)))

            def name(position: Column) -> Column:
                place = F.get(places, count_below(at, position, inclusive=True) - 1)
                return (
                    F.when(position == 0, LABEL_START).when(position == total, LABEL_END)
                    .otherwise(F.coalesce(F.when(place["at"] == position, place["type"]), F.lit(LABEL_OTHER)))
                )

            return F.transform(pack_boundaries(edges, config.oversized_bytes), lambda s, i: F.struct(
                i.alias("index"), s["start"].alias("start"), s["end"].alias("end"),
                name(s["start"]).alias("boundary_start"), name(s["end"]).alias("boundary_end"),
                line_of(breaks, s["start"]).alias("line"), _cut(data, s["start"], s["end"]).alias("content"),
            ))

        return let(F.array_sort(F.transform(code, snapped)), named)

    return let(break_ends(content), lambda breaks: let(text_bytes(content), lambda data: segments(breaks, data)))


def line_table(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per line with its byte range. A key is one text, so its lines are bounded."""
    rows = chunks.select(key, F.posexplode(T.lines(F.col("content"))).alias("line_index", "line"))
    before = Window.partitionBy(key).orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("bytes", F.octet_length("line").cast("long"))
    start = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    return sized.withColumn("byte_start", start).withColumn(
        "byte_end", F.col("byte_start") + F.col("bytes")
    ).drop("bytes")


def header_conflicts(functions: DataFrame) -> DataFrame:
    """Headers strictly inside a node other than a comment, with that node's type."""
    def conflicts(found: Column, code: Column) -> Column:
        def around(h: Column) -> Column:
            at = h["local_byte_start"]
            first = count_below(code["reach"], at, inclusive=True)
            near = F.slice(code["nodes"], first + 1, F.greatest(count_below(code["starts"], at) - first, F.lit(0)))
            return F.transform(F.filter(near, lambda n: n["end"] > at), lambda n: F.struct(
                h["title"].alias("title"), h["relative_line"].alias("relative_line"), n["type"].alias("containing_node_type")
            ))

        return F.flatten(F.transform(found, around))

    found = let(headers(header_blocks(F.col("content"))), lambda h: let(
        ordered_nodes(F.col("nodes"), skip_comments=True), lambda code: conflicts(h, code)
    ))
    return functions.select("chunk_id", F.explode(found).alias("c")).select("chunk_id", "c.*")


def section_chunks(functions: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Section chunks of functions that have usable headers.

    `functions` has chunk_id, source_path, content, start_line, byte_start and
    `nodes`, the top-level syntax nodes of the body (type, start, end).
    """
    # A text without headers has no pieces, so the explode drops it. What is used
    # more than once is a column of its own, which Spark doesn't copy; the bytes
    # are used once per piece, so they are bound inside.
    content, nodes, found = F.col("content"), F.col("nodes"), F.col("_found")
    ready = functions.withColumn("_found", safe_headers(headers(header_blocks(content)), nodes)).withColumn(
        "_pieces", F.when(F.size(found) > 0, section_pieces(found, nodes, F.octet_length("content"), config))
    ).withColumns({"_breaks": break_ends(content), "_ordered": ordered_nodes(nodes)})

    def shown(p: Column, data: Column) -> Column:
        return F.struct(
            *[p[c].alias(c) for c in ("section_index", "subchunk_index", "title", "start", "end", "whole_section")],
            line_of(F.col("_breaks"), p["start"]).alias("line"), last_line_of(F.col("_breaks"), p["end"]).alias("last_line"),
            node_types_within(F.col("_ordered"), p["start"], p["end"]).alias("node_types"),
            _cut(data, p["start"], p["end"]).alias("content"),
        )

    whole = let(text_bytes(content), lambda data: F.transform("_pieces", lambda p: shown(p, data)))
    # Neither text nor nodes are carried beside the pieces.
    cut = ready.select("chunk_id", "source_path", "start_line", "byte_start", F.explode(whole).alias("piece"))
    start, end = F.col("piece.start"), F.col("piece.end")
    return cut.select(
        F.col("chunk_id").alias("original_function_chunk_id"), "source_path",
        F.sha1(F.concat_ws(
            ":", "chunk_id", F.lit("e1"), F.col("piece.section_index").cast("string"),
            F.col("piece.subchunk_index").cast("string"), start.cast("string"), end.cast("string"),
        )).alias("chunk_id"),
        F.when(F.col("piece.whole_section"), "semantic_section")
        .otherwise("semantic_section_tree_sitter_subchunk").alias("chunk_type"),
        F.col("piece.title").alias("section_title"),
        F.col("piece.section_index").alias("section_index"),
        F.col("piece.subchunk_index").alias("subchunk_index"),
        (F.col("start_line") + F.col("piece.line") - 1).alias("start_line"),
        (F.col("start_line") + F.col("piece.last_line") - 1).alias("end_line"),
        (F.col("byte_start") + start).alias("byte_start"),
        (F.col("byte_start") + end).alias("byte_end"),
        F.col("piece.node_types").alias("node_types"), F.col("piece.content").alias("content"),
    )


def _parent_fields(name: str) -> list[Column]:
    """The function a piece is from, with its whole span."""
    return [
        F.col("chunk_id").alias("parent_chunk_id"), F.lit(name).alias("selection_kind"),
        F.col("start_line").alias("parent_start_line"), F.col("end_line").cast("long").alias("parent_end_line"),
        F.col("byte_start").alias("parent_byte_start"),
        (F.col("byte_start") + F.octet_length("content")).alias("parent_byte_end"),
    ]


def whole_chunks(functions: DataFrame) -> DataFrame:
    """Functions as they are."""
    end = F.col("byte_start") + F.octet_length("content")
    return functions.select(
        "file", *_parent_fields("original_function_or_method"), F.lit(0).alias("subchunk_index"),
        "start_line", F.col("end_line").cast("long").alias("end_line"), "byte_start", end.alias("byte_end"),
        F.lit(None).cast("string").alias("boundary_start"), F.lit(None).cast("string").alias("boundary_end"),
        "content",
    )


def _cut_from(functions: DataFrame, kind: str, pieces: Column) -> DataFrame:
    """A row per piece with the fields of its function, whose text and nodes are left behind."""
    return functions.select(
        "file", *_parent_fields(kind), F.col("start_line").alias("_line"), F.col("byte_start").alias("_byte"),
        F.explode(pieces).alias("piece"),
    )


_PARENT = ("file", "parent_chunk_id", "selection_kind", "parent_start_line", "parent_end_line", "parent_byte_start", "parent_byte_end")


def window_chunks(functions: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Functions as windows of a fixed number of lines."""
    cut = _cut_from(
        functions, f"fixed_{config.window_lines}_line_window", line_windows(F.col("content"), config.window_lines)
    )
    first = F.col("_line") + F.col("piece.index") * config.window_lines
    label = F.lit("fixed_line_window")
    return cut.select(
        *_PARENT, F.col("piece.index").alias("subchunk_index"),
        first.alias("start_line"), (first + F.col("piece.line_count") - 1).alias("end_line"),
        (F.col("_byte") + F.col("piece.start")).alias("byte_start"), (F.col("_byte") + F.col("piece.end")).alias("byte_end"),
        label.alias("boundary_start"), label.alias("boundary_end"), F.col("piece.content").alias("content"),
    )


def statement_chunks(functions: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Functions as segments cut at statements."""
    cut = _cut_from(
        functions, "tree_sitter_top_level_statement_boundary", statement_segments(F.col("content"), F.col("nodes"), config)
    )
    first = F.col("_line") + F.col("piece.line") - 1
    inner = T.newline_count(F.regexp_replace("piece.content", "\n+$", ""))
    return cut.select(
        *_PARENT, F.col("piece.index").alias("subchunk_index"),
        first.alias("start_line"), (first + inner).alias("end_line"),
        (F.col("_byte") + F.col("piece.start")).alias("byte_start"), (F.col("_byte") + F.col("piece.end")).alias("byte_end"),
        F.col("piece.boundary_start").alias("boundary_start"), F.col("piece.boundary_end").alias("boundary_end"),
        F.col("piece.content").alias("content"),
    )


def policy_chunks(functions: DataFrame, policy: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Small functions whole; oversized ones whole (D1), in windows (D2) or segments (D3)."""
    oversized = F.octet_length("content") > config.oversized_bytes
    if policy == "D1":
        return whole_chunks(functions)
    split = {"D2": window_chunks, "D3": statement_chunks}[policy]
    return whole_chunks(functions.filter(~oversized)).unionByName(split(functions.filter(oversized), config))
