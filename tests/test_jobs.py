"""Whole jobs on small folders: corpus builds, review batches, reports, streams, commands."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spanloom.operators import interactions as I
from spanloom.plans import corpus_build as B
from spanloom.plans import review as V
from spanloom.plans.review import merge_version
from spanloom.schemas import FEEDBACK
from spanloom.sources import corpus as C
from spanloom.sources import fileoutputs as O
from spanloom.sources import sessions as S
from spanloom.sources.corpus import undecodable
from spanloom.sources.versions import StaleBase, VersionedTable
from spanloom.streaming.ingest import run_available

CASE = """#include "x.h"
int main(int ac, char *av[])
{
    //----------------------
    //  Build up {the} domain
    //----------------------
    Domain d(1);
    if (ac > 1) { d.load("}"); }
    //----------------------
    //  Run
    //----------------------
    d.run();
}
"""


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(root)


def test_library_corpus(spark, tmp_path):
    root = tree(tmp_path, {
        "src/a/solver.h": "namespace N { class Solver {\npublic:\n  int step(int n) { return n; }\n}; }\n",
        "tests/2d_examples/dam.cpp": CASE, "tests/2d_examples/plain.cpp": "void f() { g(); }\n",
        "src/readme.md": "no", "docs/x.cpp": "void no() {}",
    })
    chunks, problems = B.library_corpus(spark, root, "Lib")
    rows = chunks.collect()
    assert problems.count() == 0
    assert {(r["source_role"], r["symbol"]) for r in rows} == {
        ("core_library", "step"), ("simulation_case", "f"), ("simulation_case", "Function preamble (before first semantic section)"),
        ("simulation_case", "Build up {the} domain"), ("simulation_case", "Run")}
    for r in rows:
        data = (tmp_path / r["source_path"]).read_bytes()
        assert data[r["byte_start"]:r["byte_end"]].decode() == r["content"]
        assert data[: r["byte_start"]].count(b"\n") + 1 == r["start_line"]
    step = next(r for r in rows if r["symbol"] == "step")
    assert json.loads(step["parent_context"])["qualified_route"] == [
        "namespace_definition:N", "class_specifier:Solver", "function_definition:step"]


def test_package_and_combined_corpus(spark, tmp_path):
    root = tree(tmp_path / "r", {
        "pkg/config/schema.py": "class A:\n    def f(self):\n        return 'é'\n", "pkg/config/bad.py": "def (:\n",
        "examples/c.json": '{"a": 1}\n', "tests/broken.json": "{", "pkg/embedded/z.py": "def no(): pass\n",
        "other/y.py": "def no(): pass\n",
    })
    (tmp_path / "r/pkg/config/latin.py").write_bytes("x = 'é'".encode("latin-1"))
    chunks, problems = B.package_corpus(spark, root, "Pkg", "pkg")
    rows = chunks.collect()
    assert {(r["symbol"], r["chunk_type"], r["source_role"]) for r in rows} == {
        ("A", "class_definition", "config_or_schema"), ("f", "function_definition", "config_or_schema"),
        ("c", "config_document", "config_or_schema"), ("broken", "config_document", "config_or_schema")}
    assert {r["source_path"] for r in problems.collect()} == {
        "pkg/config/bad.py", "tests/broken.json", "pkg/config/latin.py"}
    one, two, both = (str(tmp_path / n) for n in ("one", "two", "both"))
    C.write_corpus(chunks, one)
    C.write_corpus(chunks.withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id")), two)
    report = B.combined_corpus(spark, [one, two], both)
    assert report["total_chunk_count"] == 8 and report["counts_by_repository"] == {"Pkg": 8}
    sizes = sorted(r["byte_end"] - r["byte_start"] for r in rows for _ in range(2))
    assert report["chunk_size_bytes"]["median"] == (sizes[3] + sizes[4]) / 2
    with pytest.raises(ValueError, match="validation failed"):
        B.combined_corpus(spark, [one, one], str(tmp_path / "dup"))
    B.write_summary(spark, report, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["total_chunk_count"] == 8


def test_nested_values_leave_as_objects_and_come_back_as_their_text(spark, tmp_path):
    texts = ['{"b": 1.50, "a": ["x", null]}', None, "no json", "[]", '"t"', "{broken", '{"a":\n 1}', "12", "", ' {"ü\\"": "\\n"}']
    rows = [(str(i), t, t, 7, "a\nb\"") for i, t in enumerate(texts)]
    chunks = C.conform_chunks(spark.createDataFrame(
        rows, "chunk_id string, parent_context string, structural_metadata string, start_line long, content string"))
    C.write_corpus(chunks, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in C.json_lines(spark, str(tmp_path / "out")).collect()]
    assert all(list(x) == sorted(chunks.columns) and x["symbol"] is None and x["content"] == "a\nb\"" for x in lines)
    written = {x["chunk_id"]: x["parent_context"] for x in lines}
    assert written["0"] == {"b": 1.5, "a": ["x", None]} and written["3"] == [] and written["6"] == {"a": 1}
    assert [written[str(i)] for i in (1, 2, 4, 5, 7, 8)] == [texts[i] for i in (1, 2, 4, 5, 7, 8)]
    back = {r.chunk_id: (r.parent_context, r.structural_metadata, r.start_line) for r in C.read_corpus(spark, str(tmp_path / "out")).collect()}
    assert back == {str(i): (*[t and t.replace("\n", " ").lstrip()] * 2, 7) for i, t in enumerate(texts)}


def test_raw_payloads(spark, tmp_path):
    body = {"file": "f.cpp", "language": "cpp", "chunks": [
        {"chunk_id": "1", "file_path": "f.cpp", "node_type": "function_definition", "content": "int a(){}", "start_line": 1,
         "end_line": 1, "byte_start": 0, "byte_end": 9, "parent_route": [], "qualified_route": ["function_definition:a"],
         "metadata": {"signature": {"name": "anon@1"}}, "references": ["x"]}]}
    (tmp_path / "f.json").write_text(json.dumps(body, indent=2))
    row = B.chunks_from_raw(C.raw_payloads(spark, str(tmp_path)), "R", F.lit("core_library")).first()
    assert (row["symbol"], row["chunk_type"], row["source_path"]) == ("a", "function_definition", "f.cpp")


def record(tester, session, number, **values):
    base = {
        "interaction_id": f"{tester}_{session}_{number:04d}", "session_id": session, "tester_id": tester,
        "timestamp": f"2026-01-01T00:00:0{number}Z", "query": "q", "raw_answer": "a", "sources": [], "status": "successful",
        "rating": None, "feedback_category": None, "suggested_correction": None, "review_status": "unreviewed",
        "top_k": 5, "model": "m", "prompt_version": "v", "repository_commits": {"Lib": "abc"},
    }
    return json.dumps({**base, **values})


def sessions(root, extra=None):
    files = {
        "amy/session_1.jsonl": "\n".join([
            record("amy", "session_1", 1, rating="helpful"),
            "", record("amy", "session_1", 2, rating="needs_review", feedback_category="unclear", raw_answer="```\nopen"),
            record("amy", "session_1", 3, suggested_correction=" fix ")]) + "\n",
        "bob/session_2.jsonl": record("bob", "session_2", 1, rating="needs_review", timestamp=None) + "\n",
        "local_tester/session_3.jsonl": record("local_tester", "session_3", 1) + "\n",
        "empty/session_9.jsonl": "",
        "review_batches/session_old.jsonl": "{broken\n",
    }
    return tree(root, {**files, **(extra or {})})


def test_review_batch(spark, tmp_path):
    root = sessions(tmp_path / "log")
    out, report = V.aggregate(spark, root, "20260101T000000Z")
    rows = [json.loads(line) for p in sorted((tmp_path / "log/review_batches").glob("*_jsonl/part-*")) for line in p.read_text().splitlines()]
    assert [r["interaction_id"] for r in rows] == ["amy_session_1_0002", "amy_session_1_0003", "bob_session_2_0001"]
    assert "rendered_answer" not in rows[0] and rows[0]["source_session_file"] == "amy/session_1.jsonl"
    text = "".join(p.read_text() for p in sorted((tmp_path / "log/review_batches").glob("*_md/part-*")))
    assert "- **Session files scanned:** 4" in text and "- **Interactions scanned:** 5" in text
    assert "- `(none)`: 2" in text and "- `unclear`: 1" in text
    assert text.index("## 1. amy_session_1_0002") < text.index("## 3. bob_session_2_0001")
    assert "````text\n```\nopen\n````" in text
    with pytest.raises(Exception, match="already exists"):
        V.aggregate(spark, root, "20260101T000000Z")
    with pytest.raises(ValueError):
        V.aggregate(spark, root, "2026")


@pytest.mark.parametrize("bad, reason", [
    ("{oops", "invalid JSON"), ("[1]", "must be an object"), ('{"tester_id": "x"}', "missing required"),
    (record("amy", "session_1", 1), "Duplicate"), (record("x", "s", 1, interaction_id=" "), "non-empty"),
])
def test_review_batch_refuses_bad_logs(spark, tmp_path, bad, reason):
    root = sessions(tmp_path / "log", {"zed/session_7.jsonl": bad + "\n"})
    with pytest.raises(ValueError, match=reason):
        V.aggregate(spark, root, "20260101T000000Z")
    assert not list((tmp_path / "log/review_batches").glob("*_jsonl"))


def test_session_reports(spark, tmp_path):
    root = sessions(tmp_path / "log")
    with pytest.raises(ValueError, match="without interactions"):
        V.export(spark, root, str(tmp_path / "refused"))
    (tmp_path / "log/empty/session_9.jsonl").unlink()
    V.export(spark, root, str(tmp_path / "out"))
    made = sorted({p.parent.name for p in (tmp_path / "out").glob("*/*/part-*")})
    assert made == ["session_id=session_1", "session_id=session_2"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*/session_id=session_1/part-*")))
    assert "| Helpful | 1 |" in text and "| Unclear | 1 |" in text and "- **Lib commit:** abc" in text
    order = [text.index(x) for x in ("## Helpful", "### Interaction 1", "## Needs Review", "### Unclear", "#### Interaction 2", "## Unrated", "### Interaction 3")]
    assert order == sorted(order)
    sessions(tmp_path / "log", {"amy/session_4.jsonl": record("bob", "session_4", 1)})
    (tmp_path / "log/empty/session_9.jsonl").unlink()
    with pytest.raises(ValueError, match="tester directory"):
        V.export(spark, root, str(tmp_path / "out2"))


def test_line_numbers_in_split_files(spark, tmp_path):
    lines = [f"line {i}" for i in range(4000)]
    root = tree(tmp_path / "log", {"amy/session_1.jsonl": "\n".join(lines) + "\n", "bob/session_2.jsonl": "only\n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = S.session_lines(spark, root).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["path"], r["line_number"], r["value"]) for r in rows} == {
        *(("amy/session_1.jsonl", i + 1, v) for i, v in enumerate(lines)), ("bob/session_2.jsonl", 1, "only")}


def test_submission_check(spark, tmp_path):
    root = sessions(tmp_path / "log", {
        "amy/session_5.jsonl": record("amy", "session_other", 1), "amy/session_6.jsonl": record("amy", "session_6", 1, extra={"token": 1}),
    })
    got = {r["path"]: r["problem"] for r in V.submittable(spark, root).collect()}
    assert got["amy/session_1.jsonl"] is None
    assert got["amy/session_5.jsonl"] == "session_id does not match the session filename"
    assert got["amy/session_6.jsonl"] == "prohibited secret field: token"
    assert got["local_tester/session_3.jsonl"] == "development-only tester"


def test_feedback_groups(spark, tmp_path):
    base = S.interactions(S.session_lines(spark, sessions(tmp_path / "log"))).filter("tester_id = 'bob'")
    key = "bob_session_2_0001"
    rows = [(key, 1, "review", "incomplete", " why ", None), (key, 2, "correction", None, None, " better "),
            (key, 3, "review", "other", None, None), (key, 4, "helpful", None, None, None)]
    V.merge_feedback(base, spark.createDataFrame(rows, FEEDBACK), str(tmp_path / "snap"))
    got = spark.read.parquet(str(tmp_path / "snap")).first()
    assert (got["rating"], got["feedback_category"], got["feedback_comment"], got["suggested_correction"]) == (
        "helpful", "other", None, "better")
    with pytest.raises(ValueError, match="No single interaction"):
        V.merge_feedback(base, spark.createDataFrame([("zz", 1, "helpful", None, None, None)], FEEDBACK), str(tmp_path / "s2"))
    with pytest.raises(ValueError, match="refused"):
        V.merge_feedback(base, spark.createDataFrame([(key, 1, "review", "bad", None, None)], FEEDBACK), str(tmp_path / "s3"))


def test_append_and_resume(spark, tmp_path):
    """A stream over a growing folder appends each file's rows once."""
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    assert run_available(stream, spark, "t").count() == 5
    answers = spark.createDataFrame(
        [("t x", "session_a", 1, "2026", "q", "answer", [("R", "r", "p", None, 1, 2)], "m", "u", 5), ("t x", "session_a", 2, "2026", "q", "  ", [], "m", "u", 5)],
        "tester_id string, session_id string, sequence long, timestamp string, query string, raw_answer string, sources array<struct<"
        "repository:string,source_role:string,source_path:string,symbol_or_section_title:string,start_line:long,end_line:long>>, "
        "model string, base_url string, top_k int")
    made = I.build_interactions(answers, {"Lib": "abc"})
    S.append_interactions(made, str(tmp_path / "log"))
    S.append_interactions(made.withColumn("interaction_id", F.lit("other")), str(tmp_path / "log"))
    tree(tmp_path / "log", {"amy é#+ x/session_1.jsonl": record("amy é#+ x", "session_1", 1, alpha_commit="c1", repository_commits=None)})
    # All files get one time, as in a store that keeps seconds: the appends keep their order.
    for part in (tmp_path / "log").glob("tester=*/session=*/append=*/part-*"):
        os.utime(part, (1_700_000_000, 1_700_000_000))
    lines = S.session_lines(spark, str(tmp_path / "log"))
    back = S.interactions(lines).collect()
    assert {(r["interaction_id"], r["source_session_file"], r["sequence"]) for r in back} == {
        ("t_x_session_a_0001", "t_x/session_a.jsonl", 1), ("other", "t_x/session_a.jsonl", 2),
        ("amy é#+ x_session_1_0001", "amy é#+ x/session_1.jsonl", 1)}
    assert {str(r["repository_commits"]) for r in back} == {"{'Lib': 'abc'}", "{'alpha': 'c1'}"}
    assert not S.empty_sessions(spark, str(tmp_path / "log")).count() and not I.session_violations(lines).count()


def test_small_sessions_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('t', id % 3) AS tester_id", "concat('session_', id) AS session_id", "concat('i', id) AS interaction_id")
    S.append_interactions(rows, str(tmp_path / "log"))
    parts = [p.name.split("-")[1] for p in (tmp_path / "log").glob("tester=*/session=*/append=*/part-*")]
    assert len(parts) == 40 and len(set(parts)) > 2


def test_commands(spark, tmp_path, capsys):
    from spanloom.__main__ import main

    root = tree(tmp_path / "r", {"src/solver.cpp": "int getPressure(int n) { return n; }\n", "tests/2d_examples/dam.cpp": CASE})
    out = str(tmp_path / "corpus")
    assert main(["corpus", "--root", root, "--repository", "Lib", "--output", out]) == 0
    assert json.loads((tmp_path / "corpus_summary.json").read_text())["total_chunk_count"] == 4
    assert main(["index", "--corpus", out, "--output", str(tmp_path / "index")]) == 0
    assert main(["retrieve", "--corpus", out, "--index", str(tmp_path / "index"), "--query", "getPressure in lib",
                 "--repository", "Lib", "--debug"]) == 0
    shown = capsys.readouterr().out
    assert "#1 " in shown and "src/solver.cpp" in shown and "symbol_boost=24.0" in shown and "repository_boost=1.5" in shown
    asked = tree(tmp_path / "q", {"a.json": '{"query_id": "a", "query": "run the domain"}\n{"query_id": 2, "query": "run"}\n'})
    assert main(["retrieve", "--corpus", out, "--queries", asked, "--output", str(tmp_path / "report")]) == 0
    assert main(["prompts", "--corpus", out, "--queries", asked, "--output", str(tmp_path / "prompts")]) == 0
    found = {r["query_id"]: r["has_evidence"] for r in spark.read.json(str(tmp_path / "prompts")).collect()}
    assert found == {"a": True, "2": True}
    log = sessions(tmp_path / "log")
    assert main(["review", "--root", log, "--timestamp-suffix", "bad"]) == 1
    assert main(["check", "--root", log, "--output", str(tmp_path / "check")]) == 0


def test_versions_are_whole_and_ordered(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    with pytest.raises(ValueError, match="no version yet"):
        table.read()
    rows = spark.createDataFrame([("i1", None, None, None, None), ("i2", "helpful", None, None, None)], "interaction_id string, rating string, feedback_category string, feedback_comment string, suggested_correction string")
    assert table.write(rows, None) == 0
    kind = "interaction_id string, sequence long, action string, category string, comment string, correction string"
    first = spark.createDataFrame([("i1", 1, "review", "unclear", " why ", None)], kind)
    other = spark.createDataFrame([("i1", 2, "helpful", None, None, None)], kind)
    assert merge_version(table, first, 0) == 1
    with pytest.raises(StaleBase):
        merge_version(table, other, 0)
    assert table.current() == 1 and table.read(0).filter("interaction_id = 'i1'").first()["rating"] is None
    assert table.read().filter("interaction_id = 'i1'").first()["feedback_comment"] == "why"
    assert merge_version(table, other, 1) == 2
    row = table.read().filter("interaction_id = 'i1'").first()
    assert (row["rating"], row["feedback_category"]) == ("helpful", "unclear")
    with pytest.raises(ValueError, match="No single interaction"):
        merge_version(table, spark.createDataFrame([("zzz", 3, "helpful", None, None, None)], kind), 2)
    # A writer that came last finds the manifest there, though it read the same base before.
    late = VersionedTable(spark, str(tmp_path / "t"))
    seen = iter([2, 3])
    object.__setattr__(late, "_require", lambda base: None if next(seen) == base else (_ for _ in ()).throw(StaleBase("moved")))
    table.write(rows, 2)
    with pytest.raises(StaleBase):
        late.write(rows, 2)
    assert table.current() == 3


def test_problems_reach_the_summary(spark, tmp_path):
    cases = spark.createDataFrame([
        ("a.cpp", 5, "f() {\n//----------\n// T\n//----------\n//----------\nx();\n//----------\n//----------\n}\n"), ("b.cpp", 1, "g() {}\n"),
    ], "source_path string, start_line long, content string")
    raw = spark.createDataFrame([("c.cpp", bytearray(b"\xff")), ("d.cpp", bytearray(b"fine"))], "path string, content binary")
    problems = B.section_problems(cases, "R").unionByName(undecodable(raw, "R"))
    chunks = spark.createDataFrame([("core", "R", "function_definition", 0, 10)], "source_role string, repository string, chunk_type string, byte_start long, byte_end long")
    B.write_report(spark, chunks, problems, str(tmp_path / "out"))
    got = {(r["source_path"], r["kind"], r["line"]) for r in B.read_problems(spark, str(tmp_path / "out")).collect()}
    assert got == {("a.cpp", "section_warning", 9), ("a.cpp", "section_warning", 12), ("c.cpp", "skipped_file", None)}
    row = B.read_summary(spark, str(tmp_path / "out")).first()
    assert [tuple(p) for p in row["problems"]] == [("R", "section_warning", 1, 2), ("R", "skipped_file", 1, 1)]
    assert row["total_chunk_count"] == 1 and row["counts_by_repository"] == {"R": 1}
    none = problems.filter("false")
    B.write_report(spark, chunks, none, str(tmp_path / "clean"))
    assert B.read_problems(spark, str(tmp_path / "clean")).count() == 0
    assert B.read_summary(spark, str(tmp_path / "clean")).first()["problems"] == []


def test_file_outputs_are_matched(spark, tmp_path):
    kind = "file string, chunk_index long, node_type string, byte_start long, byte_end long"
    rows = [("src/a b.cpp", i, "x", i, i + 2) for i in range(5)] + [("1", 0, "y", 0, 9), ("only.cpp", 0, "z", 0, 1), ("more.cpp", 0, "z", 0, 1)]
    chunks, root = spark.createDataFrame(rows, kind), str(tmp_path / "files")
    O.write_file_outputs(chunks, root)
    back = O.read_payloads(spark, root, chunks.schema)
    assert sorted(map(tuple, back.select(*chunks.columns).collect())) == sorted(rows)
    summaries = O.read_summaries(spark, root)
    assert {r["status"] for r in O.matched(back, summaries).collect()} == {O.MATCHED}
    some = summaries.filter("file <> 'only.cpp'").withColumn("total_chunks", F.when(F.col("file") == "1", 3).otherwise(F.col("total_chunks")))
    got = {r["file"]: r["status"] for r in O.matched(back.filter("file <> 'more.cpp'"), some).collect()}
    assert got == {"src/a b.cpp": O.MATCHED, "1": O.DIFFERENT, "only.cpp": O.NO_SUMMARY, "more.cpp": O.NO_PAYLOAD}
    named = O.read_payloads(spark, root, chunks.schema, ["src/a b.cpp", "absent"])
    assert named.count() == 5 and "PartitionFilters: [file" in named._jdf.queryExecution().executedPlan().toString()


def test_many_files_share_folders(spark, tmp_path, monkeypatch):
    """A thousand sources of three chunks do not become a thousand folders; odd names keep to theirs."""
    monkeypatch.setattr(O, "FOLDERS", 16)
    names = [f"src/{i}.cpp" for i in range(1000)] + ["007", "ä/ö.cpp", "a=b/c%20.cpp", ""]
    kind = "file string, chunk_index long, node_type string, byte_start long, byte_end long"
    chunks = spark.createDataFrame([(n, i, "x", i, i + 3) for n in names for i in range(3)], kind)
    root = str(tmp_path / "files")
    O.write_file_outputs(chunks, root)
    for part in (O.PAYLOADS, O.SUMMARIES):
        assert len([p for p in (tmp_path / "files" / part).iterdir() if p.is_dir()]) <= 16
    found = O.matched(O.read_payloads(spark, root, chunks.schema), O.read_summaries(spark, root)).collect()
    assert {r["file"]: (r["chunks"], r["total_chunks"], r["status"]) for r in found} == {n: (3, 3, O.MATCHED) for n in names}
    asked = ["007", "ä/ö.cpp", "a=b/c%20.cpp", "", "src/5.cpp", "absent"]
    some = O.read_payloads(spark, root, chunks.schema, asked)
    assert sorted((r["file"], r["chunk_index"]) for r in some.collect()) == sorted((n, i) for n in asked[:-1] for i in range(3))
