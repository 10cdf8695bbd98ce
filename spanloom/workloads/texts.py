"""Scalar functions over whole texts, paths and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.config import DEFAULT_TESTER
from spanloom.functions import jsontext as J
from spanloom.functions import paths as P
from spanloom.functions import render as R
from spanloom.functions import text as T
from spanloom.operators.interactions import category_heading, category_place
from spanloom.sources.tables import table, texts
from spanloom.workloads.retrieval import preview_sql

PACKAGE = "sim"


def content_preview(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", T.preview(text).alias("short"), T.preview(text, 300).alias("long"))


def canonical_symbol(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.sha2(T.canonical(F.col("text")), 256).alias("canonical_sha"))


def sanitize_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.safe_tester_id(F.col("url"), DEFAULT_TESTER).alias("from_url"),
        T.safe_tester_id(F.regexp_replace("url", "[a-z]", "-"), DEFAULT_TESTER).alias("from_dashes"))


def fence_width(spark, sf_dir):
    """Vowels become backticks, so that texts hold runs of several lengths."""
    ticks = F.regexp_replace("text", "[aeiou]", "`")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", T.longest_backtick_run(ticks).cast("long").alias("longest_run"),
        F.sha2(T.fenced(ticks), 256).alias("fenced_sha"), F.sha2(T.inline_code(ticks), 256).alias("inline_sha"))


def answer_markdown(spark, sf_dir):
    """Some lines become fences, so that texts hold even and odd numbers of them."""
    marked = F.regexp_replace("text", "(?m)^[AET][a-z]", "````")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(T.balanced_markdown(marked), 256).alias("markdown_sha"),
        F.length(T.balanced_markdown(marked)).cast("long").alias("chars"))


def category_headings(spark, sf_dir):
    known = F.element_at(F.array(*[F.lit(c) for c in ("unclear", "other", "wrong_source")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    key = F.when(F.col("p_partkey") % 2 == 0, known).otherwise(F.lower(F.concat_ws("_", "p_type", "p_name")))
    parts = table(spark, sf_dir, "part").select(key.alias("category"))
    return parts.groupBy("category").agg(F.count("*").alias("parts")).select(
        "category", "parts", category_heading(F.col("category")).alias("heading"),
        category_place(F.col("category")).alias("place"))


def _page_paths(spark, sf_dir):
    """Paths under several roots with several extensions, from page URLs."""
    n = F.col("page_id")
    roots = [
        "src/shared/", "tests/unit_tests_src/", "tests/2d_examples/", "tests/3d_examples/", "tests/optimization/",
        "tests/tests_sycl/", "tests/extra_source_and_tests/", "tests/other/", f"{PACKAGE}/bindings/", f"{PACKAGE}/config/",
        f"{PACKAGE}/llm/", f"{PACKAGE}/sph_simulation/", f"{PACKAGE}/visualization/", "examples/", "docs/",
    ]
    tails = [".cpp", ".H", ".json", ".py", "", ".txt"]
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(
        F.element_at(F.array(*[F.lit(r) for r in roots]), (n % len(roots) + 1).cast("int")),
        F.replace(host, F.lit("."), F.lit("_")),
        F.element_at(F.array(*[F.lit(t) for t in tails]), (n % len(tails) + 1).cast("int")),
    ).alias("path"))


def source_roles(spark, sf_dir):
    path, rules = F.col("path"), P.for_package(P.INVENTORY_ROLE_RULES, PACKAGE)
    return _page_paths(spark, sf_dir).select(
        "path", P.library_role(path).alias("library_role"), P.package_role(path, PACKAGE).alias("package_role"),
        P.inventory_role(path, rules, strict=False).alias("inventory_role"))


def path_parts(spark, sf_dir):
    path = F.col("path")
    return _page_paths(spark, sf_dir).select(
        "path", P.file_name(path).alias("file_name"), P.directory(path).alias("directory"),
        P.extension(path).alias("extension"), P.stem(path).alias("stem"), P.language(path).alias("language"))


def url_validity(spark, sf_dir):
    n = F.col("page_id")
    url = F.when(n % 5 == 1, F.regexp_replace("url", "^https?:", "ftp:")).when(
        n % 5 == 2, F.regexp_replace("url", "^https?://[^/]*", "http://")).when(
        n % 5 == 3, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", P.is_http_url(url).alias("valid"))


def time_stamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    token = F.left(F.sha2(F.col("event_id").cast("string"), 256), F.lit(6))
    return table(spark, sf_dir, "events").select(
        "event_id", T.utc_stamp(ts).alias("stamp"), T.batch_suffix(ts).alias("suffix"),
        T.session_name(ts, token).alias("session"))


def line_counts(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", T.newline_count(text).cast("long").alias("newlines"), T.line_count(text).cast("long").alias("lines"),
        F.size(T.lines(text)).cast("long").alias("split_lines"))


def fingerprints(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", T.fingerprint(text).alias("sha256_12"), F.sha1(F.concat_ws(":", "source", text)).alias("chunk_sha1"))


def redact_text(spark, sf_dir):
    """Whole texts with credentials planted after some of their words."""
    planted = F.regexp_replace("text", r"\b(the|der|les) ", r"Bearer $1 api-key=$1 password: $1; ")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(J.redact_text(planted), 256).alias("redacted_sha"),
        (J.redact_text(F.col("text")) != F.col("text")).alias("changed"),
        J.safe_message(planted).alias("message"))


_BODY_KEYS = ("Auth-Token", "note", "db_PASSWORD", "page", "x_api_key", "kind")


def _body():
    key = F.element_at(F.array(*[F.lit(k) for k in _BODY_KEYS]), (F.col("event_id") % len(_BODY_KEYS) + 1).cast("int"))
    return F.concat(
        F.lit('{"'), key, F.lit('": "v'), F.col("event_id"), F.lit('", "inner": [{"'), key,
        F.lit('": 1, "ok": true}], "props": '), "props", F.lit("}"))


def redact_body(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.redact_body(_body()).alias("body"))


def error_messages(spark, sf_dir):
    """The whole way of an error body: its fields, then its text redacted, cut at 600; one of eleven is no JSON, one empty."""
    n = F.col("event_id")
    long = F.concat(F.lit("api_key=k"), n, F.lit(" because "), F.repeat(F.concat("event_type", F.lit(" ")), (n % 200).cast("int")))
    body = F.when(n % 11 == 0, long).when(n % 11 == 1, "{}").otherwise(
        F.concat(F.substring(_body(), F.lit(1), F.length(_body()) - 1), F.lit(', "text": "'), long, F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", J.safe_message(J.redact_body(body)).alias("message"))


def secret_key_scan(spark, sf_dir):
    """JSON with keys in several spellings at several depths, and look-alikes in values."""
    names = ("token", "API-Key", "tokens", " Authorization ", "password", "note")
    key = F.element_at(F.array(*[F.lit(k) for k in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    line = F.concat(F.lit('{"id": 1, "text": "say \\"secret\\": now", "list": [{"deep": {"'), key,
                    F.lit('" : 1}}], "props": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", J.first_secret_key(line).alias("secret_key"))


def status_texts(spark, sf_dir):
    n = F.col("doc_id")
    rows = texts(spark, sf_dir, "documents").select(
        "doc_id", (n % 3 == 0).alias("success"),
        F.when(n % 3 == 1, F.col("text")).alias("error"), F.when(n % 2 == 0, F.col("lang")).alias("model"),
        F.when(n % 4 == 0, F.col("source")).alias("base_url"), F.lit(5).alias("top_k"),
        F.col("source").alias("query"), F.col("lang").alias("timestamp"), F.col("text").alias("answer"))
    return rows.select("doc_id", R.status_line().alias("status"), F.sha2(R.technical_details(), 256).alias("details_sha"),
                       F.sha2(R.history_entry(n), 256).alias("history_sha"))


def _longest(text: str) -> str:
    return f"coalesce(list_max([length(r) for r in regexp_extract_all({text}, '`+')]), 0)"


_PATHS_SQL = """paths AS (SELECT page_id, url, ['src/shared/','tests/unit_tests_src/','tests/2d_examples/','tests/3d_examples/','tests/optimization/',
  'tests/tests_sycl/','tests/extra_source_and_tests/','tests/other/','sim/bindings/','sim/config/','sim/llm/','sim/sph_simulation/',
  'sim/visualization/','examples/','docs/'][page_id % 15 + 1] || replace(regexp_extract(url, '^https?://([^/]*)', 1), '.', '_')
  || ['.cpp','.H','.json','.py','','.txt'][page_id % 6 + 1] AS path FROM pages),
parts AS (SELECT *, regexp_extract(path, '[^/]*$') AS file_name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS extension FROM paths)"""
_PLANTED = r"regexp_replace(text, '\b(the|der|les) ', 'Bearer \1 api-key=\1 password: \1; ', 'g')"


def _redacted(text: str) -> str:
    once = f"regexp_replace({text}, '(?i)(bearer\\s+)[^\\s,;]+', '\\1[redacted]', 'g')"
    return (
        f"regexp_replace({once}, '(?i)((?:api[_-]?key|authorization|token|secret|password)\\s*[:=]\\s*)"
        "[^\\s,;\"'']+', '\\1[redacted]', 'g')"
    )


_MARKED = "regexp_replace(text, '(?m)^[AET][a-z]', '````', 'g')"

WORKLOADS = {
    "content_preview": (content_preview, f"SELECT doc_id, {preview_sql('text', 220)} AS short, {preview_sql('text', 300)} AS long FROM documents"),
    "canonical_symbol": (canonical_symbol, "SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS canonical_sha FROM documents"),
    "sanitize_ids": (sanitize_ids, """WITH r AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') AS a,
        regexp_replace(regexp_replace(regexp_replace(url, '[a-z]', '-', 'g'), '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') AS b FROM pages)
        SELECT page_id, coalesce(nullif(left(a, 64), ''), 'local_tester') AS from_url, coalesce(nullif(left(b, 64), ''), 'local_tester') AS from_dashes FROM r"""),
    "fence_width": (fence_width, f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[aeiou]', '`', 'g') AS v FROM documents),
        w AS (SELECT *, {_longest('v')} AS longest_run FROM t)
        SELECT doc_id, longest_run, sha256(repeat('`', greatest(3, longest_run + 1)) || 'text' || chr(10) || v || chr(10) || repeat('`', greatest(3, longest_run + 1))) AS fenced_sha,
        sha256(repeat('`', longest_run + 1) || v || repeat('`', longest_run + 1)) AS inline_sha FROM w"""),
    "answer_markdown": (answer_markdown, f"""WITH t AS (SELECT doc_id, {_MARKED} AS v FROM documents),
        f AS (SELECT *, regexp_extract_all(v, '(?m)^\\s*(`{{3,}})', 1) AS marks FROM t),
        o AS (SELECT doc_id, CASE WHEN len(marks) % 2 = 0 THEN v ELSE repeat('`', greatest(4, list_max([length(m) for m in marks]) + 1)) || 'text' || chr(10) || v
              || chr(10) || repeat('`', greatest(4, list_max([length(m) for m in marks]) + 1)) END AS shown FROM f)
        SELECT doc_id, sha256(shown) AS markdown_sha, length(shown) AS chars FROM o"""),
    "category_headings": (category_headings, """WITH k AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN ['unclear','other','wrong_source'][p_partkey % 3 + 1]
        ELSE lower(p_type || '_' || p_name) END AS category FROM part), g AS (SELECT category, count(*) AS parts FROM k GROUP BY 1)
        SELECT category, parts, CASE category WHEN 'unclear' THEN 'Unclear' WHEN 'other' THEN 'Other' WHEN 'wrong_source' THEN 'Wrong Source'
          ELSE array_to_string([upper(left(r, 1)) || lower(substring(r, 2)) for r in regexp_extract_all(replace(category, '_', ' '), '\\p{L}+|\\P{L}+')], '') END AS heading,
          CAST(CASE category WHEN 'unclear' THEN 6 WHEN 'other' THEN 8 WHEN 'wrong_source' THEN 5 ELSE 10 END AS BIGINT) AS place FROM g"""),
    "source_role_case": (source_roles, f"""WITH {_PATHS_SQL} SELECT path,
        CASE WHEN path LIKE 'src/%' THEN 'core_library' WHEN starts_with(path, 'tests/unit_tests_src/') THEN 'unit_test'
             WHEN starts_with(path, 'tests/2d_examples/') OR starts_with(path, 'tests/3d_examples/') THEN 'simulation_case'
             WHEN starts_with(path, 'tests/optimization/') THEN 'optimization_case' WHEN starts_with(path, 'tests/tests_sycl/') THEN 'sycl_case'
             WHEN starts_with(path, 'tests/extra_source_and_tests/') THEN 'extra_source_or_test' ELSE 'simulation_case' END AS library_role,
        CASE WHEN extension = '.json' THEN 'config_or_schema' WHEN starts_with(path, 'sim/bindings/') THEN 'binding'
             WHEN starts_with(path, 'sim/config/') THEN 'config_or_schema' WHEN starts_with(path, 'sim/llm/') THEN 'llm_support'
             WHEN starts_with(path, 'sim/sph_simulation/') THEN 'simulator_library' WHEN starts_with(path, 'sim/visualization/') THEN 'visualization'
             WHEN starts_with(path, 'examples/') THEN 'simulation_example' ELSE 'test' END AS package_role,
        CASE WHEN starts_with(path, 'sim/bindings/') THEN 'simulator_library' WHEN starts_with(path, 'sim/config/') THEN 'config/schema'
             WHEN starts_with(path, 'sim/llm/') THEN 'llm_support' WHEN starts_with(path, 'sim/sph_simulation/') THEN 'simulator_library'
             WHEN starts_with(path, 'sim/visualization/') THEN 'visualization' WHEN starts_with(path, 'examples/') THEN 'simulation_example'
             WHEN starts_with(path, 'tests/') THEN 'test' END AS inventory_role FROM parts"""),
    "path_parts": (path_parts, f"""WITH {_PATHS_SQL} SELECT path, file_name, regexp_replace(path, '/[^/]*$', '') AS directory, extension,
        CASE WHEN extension = '' THEN file_name ELSE left(file_name, length(file_name) - length(extension)) END AS stem,
        CASE extension WHEN '.cpp' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.json' THEN 'json' WHEN '.py' THEN 'python' END AS language FROM parts"""),
    "url_validity": (url_validity, "SELECT page_id, page_id % 5 IN (0, 4) AS valid FROM pages"),
    "time_stamps": (time_stamps, """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y%m%dT%H%M%SZ') AS suffix,
        'session_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS session FROM events"""),
    "line_counts": (line_counts, """SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines,
        length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines,
        len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS split_lines FROM documents"""),
    "text_fingerprints": (fingerprints, "SELECT doc_id, left(sha256(text), 12) AS sha256_12, sha1(source || ':' || text) AS chunk_sha1 FROM documents"),
    "redact_text": (redact_text, f"""SELECT doc_id, sha256({_redacted(_PLANTED)}) AS redacted_sha, {_redacted('text')} <> text AS changed,
        nullif(left({_redacted(_PLANTED)}, 600), '') AS message FROM documents"""),
    "redact_body": (redact_body, """WITH k AS (SELECT event_id, props, ['Auth-Token','note','db_PASSWORD','page','x_api_key','kind'][event_id % 6 + 1] AS key FROM events)
        SELECT event_id, '{"' || key || '": ' || CASE WHEN event_id % 2 = 0 THEN '"[redacted]"' ELSE '"v' || event_id || '"' END || ', "inner": [{"' || key || '": '
        || CASE WHEN event_id % 2 = 0 THEN '"[redacted]"' ELSE '1' END || ', "ok": true}], "props": ' || props || '}' AS body FROM k"""),
    "error_messages": (error_messages, f"""WITH k AS (SELECT event_id, props, event_type, ['Auth-Token','note','db_PASSWORD','page','x_api_key','kind'][event_id % 6 + 1] AS key,
          'api_key=k' || event_id || ' because ' || repeat(event_type || ' ', event_id % 200) AS long FROM events),
        b AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN long WHEN 1 THEN '{{}}' ELSE '{{"' || key || '": ' || CASE WHEN event_id % 2 = 0 THEN '"[redacted]"' ELSE '"v' || event_id || '"' END
          || ', "inner": [{{"' || key || '": ' || CASE WHEN event_id % 2 = 0 THEN '"[redacted]"' ELSE '1' END || ', "ok": true}}], "props": ' || props || ', "text": "' || long || '"}}' END AS body FROM k),
        r AS (SELECT event_id, {_redacted('body')} AS body FROM b)
        SELECT event_id, CASE WHEN body NOT IN ('', '{{}}', '[]', 'null') THEN left(body, 600) END AS message FROM r"""),
    "secret_key_scan": (secret_key_scan, """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'token' WHEN 1 THEN 'API-Key' WHEN 3 THEN ' Authorization '
        WHEN 4 THEN 'password' END AS secret_key FROM events"""),
    "status_texts": (status_texts, """WITH r AS (SELECT *, doc_id % 3 = 0 AS success, CASE WHEN doc_id % 3 = 1 THEN text END AS error,
          coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '(not configured)') AS model,
          coalesce(CASE WHEN doc_id % 4 = 0 THEN source END, 'OpenAI SDK default') AS base_url FROM documents)
        SELECT doc_id, CASE WHEN success THEN '**Status:** Completed' ELSE '**Status:** ' || left(coalesce(nullif(error, ''), 'LLM returned no displayable answer.'), 240) END AS status,
          sha256('- **LLM model:** `' || model || '`' || chr(10) || '- **LLM base URL:** `' || base_url || '`' || chr(10) || '- **Top-K:** 5' || chr(10)
            || CASE WHEN nullif(error, '') IS NOT NULL THEN '- **Warning/error:** ' || error ELSE '- **Status:** successful' END) AS details_sha,
          sha256('## Interaction ' || doc_id || chr(10) || chr(10) || '**Question:** ' || source || chr(10) || chr(10) || '**Timestamp:** ' || lang || chr(10) || chr(10)
            || '**Model:** `' || model || '`' || chr(10) || chr(10) || '**Status:** ' || CASE WHEN success THEN 'success' ELSE 'warning: ' || coalesce(error, 'None') END
            || CASE WHEN success THEN chr(10) || chr(10) || '### Final answer' || chr(10) || chr(10) || coalesce(nullif(text, ''), '_No answer returned._') ELSE '' END
            || chr(10) || chr(10) || '---') AS history_sha FROM r"""),
}
