"""Tokens, fences, identifiers and JSON-text checks on hand-made inputs."""

import random

from pyspark.sql import functions as F

from spanloom.functions import jsontext as J
from spanloom.functions import paths as P
from spanloom.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_token_forms(spark):
    got = one(spark, T.tokenize(F.lit("configured HTTPServer2 get_Pressure classes glass 42 x")))
    assert got == [
        "configured", "config", "httpserver2", "http", "server", "2", "get_pressure", "get", "pressure",
        "classes", "classe", "glass", "42", "x",
    ]


def test_bag_holds_the_same_tokens(spark):
    rng = random.Random(3)
    alphabet = "abAB_s9 .-éüK٣\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["configuration configured CONFIGURED_x", "", "ABc ABC_d aBC x1Y22 __a__ classes buses ass"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.array_sort(T.tokenize(F.col("t"))).alias("a"), F.array_sort(T.token_bag(F.col("t"))).alias("b"))
    assert [r for r in df.collect() if r["a"] != r["b"]] == []


def test_unicode_white_space(spark):
    assert one(spark, T.preview(F.lit("  a \x1cb \n"), 10)) == "a b"
    assert one(spark, T.preview(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, T.is_blank(F.lit(" \t")))


def test_lines_end_at_every_kind_of_break(spark):
    got = one(spark, T.lines(F.lit("a\r\nb\x0bc d\x85\n")))
    assert got == ["a\r\n", "b\x0b", "c ", "d\x85", "\n"]
    assert one(spark, T.line_count(F.lit("a\nb"))) == 2
    assert one(spark, T.line_count(F.lit(""))) == 0


def test_fences(spark):
    for run, width in ((0, 3), (2, 3), (3, 4), (5, 6)):
        value = "x" + "`" * run
        assert one(spark, T.fenced(F.lit(value))) == f"{'`' * width}text\n{value}\n{'`' * width}"
    assert one(spark, T.inline_code(F.lit(""))) == "`Not recorded`"
    assert one(spark, T.balanced_markdown(F.lit("```\na\n```"))) == "```\na\n```"
    assert one(spark, T.balanced_markdown(F.lit("a\n  `````\nb"))).startswith("``````text\n")


def test_tester_ids(spark):
    for raw, want in (("  A b/c ", "A_b_c"), ("__--", "d"), (None, "d"), ("x" * 70, "x" * 64), ("-é-", "d")):
        assert one(spark, T.safe_tester_id(F.lit(raw).cast("string"), "d")) == want


def test_secret_keys_at_any_depth(spark):
    cases = {
        '{"a": [{"b": {"Access-Token": 1}}]}': "Access-Token",
        '{"text": "\\"token\\": 1", "tokens": 2}': None,
        '{"a\\\\": "x", "pass\\u0077ord": 1}': "password",
        '{"x": "secret", " SECRET ": {"token": 1}}': " SECRET ",
    }
    for line, want in cases.items():
        assert one(spark, J.first_secret_key(F.lit(line))) == want, line


def test_missing_is_not_null(spark):
    got = one(spark, J.missing_fields(F.lit('{"a": null}'), ("a", "b")))
    assert got == ["b"]
    assert not one(spark, J.is_object(F.lit("[1]")))
    assert one(spark, J.field_type(F.lit('{"a": null}'), "a")) == "VOID"


def test_redaction(spark):
    text = "Authorization: Bearer abc, api-key=xyz; ok"
    assert one(spark, J.redact_text(F.lit(text))) == "Authorization: [redacted] [redacted], api-key=[redacted]; ok"
    assert one(spark, J.safe_message(F.lit("{}"))) is None
    body = '{"X-Token": {"deep": 1}, "list": [{"password": "p"}], "ok": 1}'
    assert one(spark, J.redact_body(F.lit(body))) == (
        '{"X-Token": "[redacted]", "list": [{"password": "[redacted]"}], "ok": 1}')
    deep = '{"a":' * 400 + '{"api_token" : [1, {"x": "}"}], "b": "q\\"{", "c": null}' + "}" * 400
    assert one(spark, J.redact_body(F.lit(deep))).replace('{"a": ', "").rstrip("}") == '{"api_token": "[redacted]", "b": "q\\"{", "c": null'
    assert one(spark, J.redact_body(F.lit("not json {"))) == "not json {"
    assert one(spark, J.safe_message(J.redact_body(F.lit('{"secret": 1, "m": "token=abc x"}')))) == '{"secret": "[redacted]", "m": "token=[redacted] x"}'


def test_paths(spark):
    assert one(spark, P.extension(F.lit("a.b/.hidden"))) == ""
    assert one(spark, P.extension(F.lit("a/B.CPP"))) == ".cpp"
    assert one(spark, P.stem(F.lit("a/x.tar.gz"))) == "x.tar"
    assert one(spark, P.package_role(F.lit("pkg/llm/x.json"), "pkg")) == "config_or_schema"
    for url, ok in (("http://a", True), ("https:///x", False), ("ftp://a", False), ("a.b", False)):
        assert one(spark, P.is_http_url(F.lit(url))) is ok


def test_lines_of_every_line_end_and_without_backtracking(spark):
    """As a plain scan finds them, for every character about a line end and for a long line; no position is tried twice."""
    ends = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
    near = "\x00\t\x0e\x1b\x1f \x84\x86\u2027\u202a\ud7ff\uffff\U00010000\U0010ffff"
    samples = ["", "x", "a\r\nb\n\rc\r", "y" * 200_000, *[f"a{c}b{c}{c}\r\n{c}" for c in ends + near]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["x"] for r in df.select("i", T.lines(F.col("s")).alias("x")).collect()}
    assert got == {i: s.splitlines(keepends=True) for i, s in enumerate(samples)}
    assert "++" in df.select(T.lines(F.col("s")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
