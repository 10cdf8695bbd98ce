"""Sections, packing and windows on hand-made functions."""

import itertools
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from spanloom.config import PREAMBLE_TITLE, ChunkConfig
from spanloom.functions.scan import count_below, scanned
from spanloom.operators import sections as S

SEP = "  //----------------------\n"


def blocks(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(S.header_blocks(F.col("t")).alias("b")).first()["b"]


def test_header_pairs(spark):
    text = "int f() {\n" + SEP + "// One é\n//\n//  two \n" + SEP + "a();\n" + SEP + "x = 1;\n" + SEP + SEP + "//  \n" + SEP + SEP
    found = blocks(spark, text)
    assert [(b["title"] if b["issue"] is None else None, b["relative_line"], b["issue"]) for b in found] == [
        ("One é two", 2, None), (None, 8, S.ISSUE_TITLE), (None, 11, S.ISSUE_TITLE), (None, 14, S.ISSUE_OPEN)]
    assert found[0]["local_byte_start"] == 10
    assert found[1]["local_byte_start"] == len(text.split("x = 1")[0].encode()) - len(SEP)


def test_windows_line_ends(spark):
    found = blocks(spark, "//----------\r\n// T\r\n//----------\r\nx\r\n")
    assert [(b["title"], b["issue"]) for b in found] == [("T", None)]


def pack(spark, edges, limit):
    df = spark.createDataFrame([(edges,)], "e array<long>")
    return [tuple(s) for s in df.select(S.pack_boundaries(F.col("e"), limit).alias("p")).first()["p"]]


def test_packing(spark):
    assert pack(spark, [0, 3000, 5000, 5001, 9000], 5000) == [(0, 5000), (5000, 9000)]
    assert pack(spark, [0, 7000], 5000) == [(0, 7000)]
    assert pack(spark, [0, 7000, 7100], 5000) == [(0, 7000), (7000, 7100)]
    assert pack(spark, [10, 20, 9000, 9010], 5000) == [(10, 20), (20, 9000), (9000, 9010)]


def test_section_chunks_cover_the_function(spark):
    head, body = "int main() {\n", SEP + "// Setup\n" + SEP + "a();\n" * 30 + SEP + "// Run é\n" + SEP + "b();\n}\n"
    text = head + body
    starts = [i for i in range(len(text)) if text.startswith(("a();", "b();"), i)]
    nodes = [("expression_statement", len(text[:i].encode()), len(text[:i].encode()) + 4) for i in starts]
    df = spark.createDataFrame([("id", "p.cpp", text, 5, 100, nodes)],
                               "chunk_id string, source_path string, content string, start_line long, byte_start long, "
                               "nodes array<struct<type:string,start:long,end:long>>")
    rows = S.section_chunks(df, ChunkConfig(oversized_bytes=120)).sort("byte_start").collect()
    assert "".join(r["content"] for r in rows) == text
    assert rows[0]["section_title"] == PREAMBLE_TITLE and rows[0]["start_line"] == 5 and rows[0]["end_line"] == 5
    assert {r["section_title"] for r in rows[1:]} == {"Setup", "Run é"}
    assert [r["chunk_type"] for r in rows].count("semantic_section_tree_sitter_subchunk") >= 2
    assert rows[-1]["byte_end"] == 100 + len(text.encode())
    inside = [("for_statement", 5, 300)]
    df = df.withColumn("nodes", F.array(*[F.struct(F.lit(t).alias("type"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for t, a, b in inside]))
    assert S.section_chunks(df).filter("section_title = 'Setup'").count() == 0


def test_windows_and_offsets(spark):
    text = "é\n" * 5 + "last"
    df = spark.createDataFrame([("id", "f", text, 1, 6, 0)],
                               "chunk_id string, file string, content string, start_line long, end_line long, byte_start long")
    rows = S.window_chunks(df, ChunkConfig(window_lines=2)).sort("subchunk_index").collect()
    assert [(r["start_line"], r["end_line"], r["byte_start"], r["byte_end"]) for r in rows] == [
        (1, 2, 0, 6), (3, 4, 6, 12), (5, 6, 12, 19)]
    assert S.policy_chunks(df.withColumn("nodes", F.array().cast("array<struct<type:string,start:long,end:long>>")), "D3").count() == 1
    line, last = df.select(S.line_at(F.col("content"), F.lit(4)), S.last_line_before(F.col("content"), F.lit(3))).first()
    assert (line, last) == (2, 1)


NODES = "nodes array<struct<type:string,start:long,end:long>>"


def test_running_results_and_searches(spark):
    rng = random.Random(4)
    rows = [([rng.randint(-5, 9) for _ in range(n)],) for n in (0, 1, 2, 255, 256, 257, 700)]
    df = spark.createDataFrame(rows, "a array<long>")
    ascending = F.array_sort("a")
    out = df.select(
        "a", scanned(F.col("a"), F.lit(0).cast("long"), lambda x, y: x + y).alias("sums"),
        scanned(F.col("a"), F.lit(-9).cast("long"), lambda x, y: F.greatest(x, y)).alias("tops"),
        *[count_below(ascending, F.lit(k)).alias(f"b{k}") for k in (-6, 0, 4, 9)], count_below(ascending, F.lit(4), inclusive=True).alias("until"),
    ).collect()
    for r in out:
        assert r.sums == list(itertools.accumulate(r.a)) and r.tops == list(itertools.accumulate(r.a, max))
        assert all(r[f"b{k}"] == sum(x < k for x in r.a) for k in (-6, 0, 4, 9)) and r.until == sum(x <= 4 for x in r.a)


def test_statements_inside_lines(spark):
    """A statement is cut at the start of its line; the last of a line names the boundary."""
    text = "f() {\na(); é(); b();\n" + "c();\n" * 4 + "}\n"
    starts = [text.index(x) for x in ("a();", "é();", "b();")] + [i for i in range(len(text)) if text.startswith("c();", i)]
    nodes = [(f"type_{i}", len(text[:s].encode()), len(text[:s].encode()) + 4) for i, s in enumerate(starts)]
    df = spark.createDataFrame([("id", "f", text, 1, 7, 0, nodes)], f"chunk_id string, file string, content string, start_line long, end_line long, byte_start long, {NODES}")
    rows = S.statement_chunks(df, ChunkConfig(oversized_bytes=20)).sort("byte_start").collect()
    assert "".join(r.content for r in rows) == text
    assert [(r.start_line, r.boundary_start, r.boundary_end) for r in rows][:2] == [(1, S.LABEL_START, "type_2"), (2, "type_2", "type_3")]
    assert [r.byte_end for r in rows][:2] == [len(x.encode()) for x in ("f() {\n", "f() {\na(); é(); b();\n")]


def test_headers_among_nested_nodes(spark):
    """Against every pair of header and node, nodes in any order and inside each other."""
    rng = random.Random(7)
    text = "".join(SEP + f"// T{i}\n" + SEP + "x();\n" for i in range(40))
    places = [i for i in range(len(text)) if text.startswith(SEP, i)][::2]
    nodes = [(rng.choice(["comment", "for_statement"]), a := rng.randrange(len(text)), a + rng.choice([1, 9, 200])) for _ in range(60)]
    df = spark.createDataFrame([("id", text, nodes)], f"chunk_id string, content string, {NODES}")
    found = S.headers(S.header_blocks(F.col("content")))
    safe = df.select(S.safe_headers(found, F.col("nodes")).alias("s")).first()["s"]
    around = {p: [t for t, a, b in nodes if t != "comment" and a < p < b] for p in places}
    assert [h["local_byte_start"] for h in safe] == [p for p in places if not around[p]]
    got = Counter((r.title, r.containing_node_type) for r in S.header_conflicts(df).collect())
    assert got == Counter((f"T{i}", t) for i, p in enumerate(places) for t in around[p])


def test_one_long_text(spark):
    """A hundred thousand lines and statements in one text: what takes the square of that would not end here."""
    body = "".join((SEP + f"// Part {i}\n" + SEP) if i % 50 == 0 else f"call_{i}();\n" for i in range(98_000))
    starts, at = [], 0
    for line in body.splitlines(keepends=True):
        if not line.lstrip().startswith("//"):
            starts.append(("expression_statement", at, at + len(line)))
        at += len(line)
    df = spark.createDataFrame([("id", "f", "p", body, 1, 100_000, 0, starts)], f"chunk_id string, file string, source_path string, content string, start_line long, end_line long, byte_start long, {NODES}")
    began = time.monotonic()
    windows = S.window_chunks(df).agg(F.sum(F.octet_length("content")), F.max("end_line")).first()
    assert tuple(windows) == (len(body), body.count("\n"))
    segments = S.statement_chunks(df).agg(F.sum(F.octet_length("content")), F.max("byte_end")).first()
    assert tuple(segments) == (len(body), len(body))
    sections = S.section_chunks(df).agg(F.sum(F.octet_length("content")), F.countDistinct("section_title"), F.max("end_line")).first()
    assert tuple(sections) == (len(body), 1961, body.count("\n"))
    assert time.monotonic() - began < 300


def test_nodes_of_a_text_need_no_shuffle(spark):
    """The nodes of a document are its lines with their byte ranges, as the line table has them."""
    from spanloom.workloads.sections import functions, with_nodes

    folder = "/root/testdata/sf0.001"
    nodes = with_nodes(spark, folder)
    assert "Exchange hashpartitioning" not in nodes._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: [(n["start"], n["end"], n["type"] == "comment") for n in r["nodes"]] for r in nodes.collect()}
    want = {}
    for r in S.line_table(functions(spark, folder)).sort("chunk_id", "line_index").collect():
        want.setdefault(r["chunk_id"], []).append((r["byte_start"], r["byte_end"], r["line"].lstrip().startswith("//")))
    assert got == want
