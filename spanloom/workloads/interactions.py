"""Interaction logs: conversations as sessions, labels and events as feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.config import FEEDBACK_CATEGORIES
from spanloom.functions import render as R
from spanloom.functions import text as T
from spanloom.operators import interactions as I
from spanloom.plans.review import merge_version, review_blocks, review_header, session_blocks
from spanloom.schemas import SOURCE
from spanloom.session import new_table_path
from spanloom.sources.sessions import (
    append_interactions, excluded_testers, exportable, interactions, next_session, path_problem, session_lines,
    sessions_of,
)
from spanloom.sources.tables import table
from spanloom.sources.versions import StaleBase, VersionedTable


def answers(spark, sf_dir):
    """User turns followed by an assistant turn, with a source per label row.

    The follow-up is found by (conversation, turn), so one long conversation is
    no hot key.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    replied = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("raw_answer"))
    pairs = asked.join(replied, ["conv_id", "turn"])
    numbered = I.numbered_in_session(pairs, "conv_id", "turn")
    n = F.col("conv_id") + F.col("turn")
    source = F.struct(
        F.concat(F.lit("repo"), n % 2).alias("repository"), F.lit("core_library").alias("source_role"),
        F.concat(F.lit("src/file"), n, F.lit(".cpp")).alias("source_path"),
        F.when(n % 3 != 0, F.concat(F.lit("sym"), n)).alias("symbol_or_section_title"),
        (n + 1).cast("long").alias("start_line"), F.when(n % 5 != 0, (n + 9).cast("long")).alias("end_line"))
    bare = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in SOURCE])
    return numbered.select(
        F.concat(F.lit("tester "), F.col("conv_id") % 7).alias("tester_id"),
        F.concat(F.lit("session_"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("session_id"),
        "sequence", T.utc_stamp(F.expr(
            "TIMESTAMP_NTZ'2023-11-14 22:13:20' + make_dt_interval(0, 0, CAST(conv_id AS INT), turn)")).alias("timestamp"),
        "query", "raw_answer",
        F.when(n % 4 == 0, F.array().cast(f"array<{SOURCE.simpleString()}>")).when(n % 4 == 1, F.array(source, bare))
        .otherwise(F.array(source)).alias("sources"),
        F.lit("model-x").alias("model"), F.lit("https://host.example/v1").alias("base_url"), F.lit(5).alias("top_k"),
        "conv_id", "turn")


def built(spark, sf_dir):
    """Interaction records with their order in the session and their session file."""
    rows = answers(spark, sf_dir)
    made = I.build_interactions(rows, {"alpha": "a1b2", "beta": "c3d4"})
    order = F.regexp_extract("interaction_id", "_([0-9]+)$", 1).cast("long")
    path = F.concat_ws("/", "tester_id", F.concat("session_id", F.lit(".jsonl")))
    return made.withColumn("sequence", order).withColumn("source_session_file", path)


def rated(spark, sf_dir):
    """Records with feedback fields derived from the lengths of query and answer."""
    n, m = F.length("query"), F.length("raw_answer")
    cats = F.array(*[F.lit(c) for c in FEEDBACK_CATEGORIES], F.lit("odd_category"))
    return (
        built(spark, sf_dir)
        .withColumn("rating", F.when(n % 3 == 0, "helpful").when(n % 3 == 1, "needs_review"))
        .withColumn("feedback_category", F.when((n % 3 == 1) & (m % 4 != 0), F.element_at(cats, (m % 9 + 1).cast("int"))))
        .withColumn("feedback_comment", F.when(n % 5 == 0, F.left("query", F.lit(20))))
        .withColumn("suggested_correction", F.when(m % 7 == 0, F.left("raw_answer", F.lit(30))).when(m % 7 == 1, " \t"))
        .withColumn("review_status", F.when(m % 5 == 0, "reviewed").otherwise("unreviewed"))
        .withColumn("timestamp", F.when(m % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("timestamp")))
    )


def session_log_round_trip(spark, sf_dir):
    """All interactions appended to a log, read back from its files and checked."""
    root = new_table_path(spark, "log")
    append_interactions(built(spark, sf_dir), root)
    lines = session_lines(spark, root)
    bad = I.session_violations(lines).select("path", F.lit(1).alias("bad")).distinct()
    return interactions(lines).join(bad, F.col("source_session_file") == F.col("path"), "left").select(
        "interaction_id", F.col("source_session_file").alias("file"), F.col("sequence").cast("long").alias("sequence"),
        F.sha2("query", 256).alias("query_sha"), F.sha2("raw_answer", 256).alias("answer_sha"),
        F.element_at("repository_commits", F.lit("alpha")).alias("alpha"), F.col("bad").isNotNull().alias("bad"))


def log_records(events):
    """Events as records of sixteen logs, one of fifty with a session of its own."""
    event = F.col("event_id")
    return events.select(
        (event % 16).alias("log"), event.alias("place"), F.col("event_type").alias("tester_id"),
        F.when(event % 50 == 0, F.concat(F.lit("given"), event)).alias("session_id"))


def session_assignment(spark, sf_dir):
    return next_session(log_records(table(spark, sf_dir, "events")), F.concat(F.lit("s"), "place"))


def interactions_from_turns(spark, sf_dir):
    rows = built(spark, sf_dir)
    return rows.select(
        "interaction_id", "session_id", "tester_id", "timestamp", F.sha2("query", 256).alias("query_sha"),
        F.sha2("raw_answer", 256).alias("answer_sha"), F.size("sources").cast("long").alias("sources"),
        "prompt_version", "status", "review_status", "top_k")


def evidence_metadata(spark, sf_dir):
    rows = built(spark, sf_dir).select("interaction_id", F.explode("retrieved_evidence_metadata").alias("e"))
    return rows.select("interaction_id", "e.*")


def rating_buckets(spark, sf_dir):
    return I.session_buckets(rated(spark, sf_dir))


def category_counts(spark, sf_dir):
    return I.category_counts(I.select_for_review(rated(spark, sf_dir)))


def review_batch_head(spark, sf_dir):
    """The counts at the head of a review batch, block by block in their order."""
    head = review_header(I.select_for_review(rated(spark, sf_dir)), 0, 0, "2026-01-01T00:00:00Z", False)
    return head.filter("place.part > 0").select(
        F.col("place.part").cast("long").alias("part"), F.col("place.text").alias("text"), "block")


def review_categories(spark, sf_dir):
    return I.review_category_table(rated(spark, sf_dir))


def needs_review_select(spark, sf_dir):
    chosen = I.select_for_review(rated(spark, sf_dir), only_unreviewed=True)
    return chosen.select("interaction_id", "sort_time", "rating", "review_status")


def review_projection(spark, sf_dir):
    kept = I.review_records(I.select_for_review(rated(spark, sf_dir)))
    return kept.select("interaction_id", "session_id", "timestamp", "rating", "feedback_category", "feedback_comment",
                       "suggested_correction", "review_status", "source_session_file",
                       F.map_keys("repository_commits")[0].alias("first_repository"))


def session_first_metadata(spark, sf_dir):
    return I.first_of_session(rated(spark, sf_dir), ["timestamp", "model", "top_k", "prompt_version"])


def scan_counters(spark, sf_dir):
    rows = rated(spark, sf_dir)
    return rows.agg(F.count_distinct("source_session_file").alias("files"), F.count("*").alias("interactions"),
                    F.count_if(I.needs_review()).alias("selected"))


def review_report(spark, sf_dir):
    blocks = review_blocks(I.select_for_review(rated(spark, sf_dir)))
    return blocks.select(F.col("place").cast("long").alias("place"), "block")


def session_report(spark, sf_dir):
    blocks = session_blocks(rated(spark, sf_dir))
    return blocks.select(
        "tester_id", "session_id", F.col("place.group").cast("long").alias("group"), F.col("place.order").alias("order"),
        F.col("place.category").alias("category"), F.col("place.sequence").alias("sequence"), "block")


def source_listings(spark, sf_dir):
    rows = built(spark, sf_dir)
    return rows.select("interaction_id", R.review_source_lines(F.col("sources")).alias("review"),
                       R.export_source_lines(F.col("sources")).alias("export"))


# --------------------------------------------------------------------------
# Raw session lines with planted faults
# --------------------------------------------------------------------------
def raw_lines(spark, sf_dir):
    """A session line per turn. The text's length decides which fault it has."""
    n, c, t = F.length("text"), F.col("conv_id"), F.col("turn")
    path = F.concat(F.lit("t"), c % 5, F.lit("/session_"), c, F.lit(".jsonl"))
    tester = F.when((c % 6 == 1) & (t == 1), F.lit("t9")).otherwise(F.concat(F.lit("t"), c % 5))
    session = F.when((c % 6 == 2) & (t == 1), F.lit("session_x")).otherwise(F.concat(F.lit("session_"), c))
    number = F.when((c % 8 == 3) & (t > 0), F.lit(0).cast("long")).otherwise(t)
    body = F.concat(
        F.lit('{"interaction_id": '), F.when(n % 13 == 1, F.lit('" "')).when(n % 13 == 2, F.lit("7")).otherwise(
            F.concat(F.lit('"i'), c, F.lit("_"), number, F.lit('"'))),
        F.when(n % 17 != 3, F.concat(F.lit(', "session_id": "'), session, F.lit('"'))).otherwise(""),
        F.lit(', "tester_id": "'), tester, F.lit('", "timestamp": null, "query": "q", "status": "successful"'),
        F.when(n % 19 != 4, F.concat(F.lit(', "raw_answer": '), F.to_json(F.array("text")))).otherwise(""),
        F.lit(', "review_status": "unreviewed", "rating": '),
        F.when(n % 7 == 0, F.lit('"great"')).when(n % 7 == 1, F.lit('"helpful"')).when(n % 7 == 2, F.lit("3")).otherwise("null"),
        F.when(n % 23 == 5, F.lit(', "extra": [{"Access-Token": 1}]')).otherwise(""), F.lit("}"))
    value = F.when(n % 29 == 6, F.lit("   ")).when(n % 29 == 7, F.lit("{not json")).when(n % 29 == 8, F.lit("[1, 2]")).otherwise(body)
    return table(spark, sf_dir, "conversations").select(path.alias("path"), (t + 1).alias("line_number"), value.alias("value"))


def session_paths(spark, sf_dir):
    """Customer names as file paths of several shapes under the log root."""
    n = F.col("c_custkey")
    path = F.element_at(F.array(
        F.concat(F.lit("amy/session_"), n, F.lit(".jsonl")), F.concat(F.lit("amy/notes_"), n, F.lit(".jsonl")),
        F.concat(F.lit("review_batches/session_"), n, F.lit(".jsonl")), F.concat(F.lit("../x/session_"), n, F.lit(".jsonl")),
        F.concat(F.lit("a/b/session_"), n, F.lit(".jsonl")), F.concat(F.lit("/session_"), n, F.lit(".jsonl"))), (n % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(path.alias("path"), path_problem(path).alias("problem"))


def tester_sessions(spark, sf_dir):
    """Session files of one tester in the order of their paths."""
    n = F.col("c_custkey")
    lines = table(spark, sf_dir, "customer").select(
        F.concat(F.element_at(F.array(F.lit("amy"), F.lit("bob")), (n % 2 + 1).cast("int")), F.lit("/session_"), n % 90, F.lit(".jsonl")).alias("path"))
    return sessions_of(lines, "bob").select("path", F.col("place").cast("long").alias("place"))


def exportable_sessions(spark, sf_dir):
    """Session files kept for export, and the development tester left out."""
    n = F.col("c_custkey")
    tester = F.element_at(F.array(*[F.lit(t) for t in ("amy", "local_tester", ".hidden", "markdown_exports", "bob/deep")]), (n % 5 + 1).cast("int"))
    lines = table(spark, sf_dir, "customer").select(
        F.concat(tester, F.lit("/session_"), n % 40, F.lit(".jsonl")).alias("path"), n.alias("line_number"), F.col("c_name").alias("value"))
    kept = exportable(lines).groupBy("path").agg(F.count("*").alias("lines"))
    out = excluded_testers(lines).select(F.concat(F.lit("excluded: "), "tester_id").alias("path"), F.lit(0).cast("long").alias("lines"))
    return kept.unionByName(out)


def review_violations(spark, sf_dir):
    return I.review_violations(raw_lines(spark, sf_dir))


def session_violations(spark, sf_dir):
    return I.session_violations(raw_lines(spark, sf_dir))


def submission_violations(spark, sf_dir):
    return I.session_violations(raw_lines(spark, sf_dir), submission=True)


def repeated_interactions(spark, sf_dir):
    return I.repeated_interactions(raw_lines(spark, sf_dir)).select("interaction_id", "rows", "first_path", "last_path")


def session_consistency(spark, sf_dir):
    return I.session_consistency(raw_lines(spark, sf_dir)).select("path", "interactions", "problem")


# --------------------------------------------------------------------------
# Feedback
# --------------------------------------------------------------------------
def feedback(spark, sf_dir):
    return as_feedback(table(spark, sf_dir, "events"))


def as_feedback(events):
    """Events as feedback on interactions; the event number orders them."""
    kind, n = F.col("event_type"), F.col("event_id")
    cats = F.array(*[F.lit(c) for c in FEEDBACK_CATEGORIES], F.lit("bogus"))
    return events.select(
        F.concat(F.lit("i"), "user_id").alias("interaction_id"), n.alias("sequence"),
        F.when(kind == "click", "helpful").when(kind == "error", "review").when(kind == "purchase", "correction")
        .when(kind == "signup", "review").otherwise("unknown").alias("action"),
        F.when(kind.isin("error", "signup"), F.element_at(cats, (n % 9 + 1).cast("int"))).alias("category"),
        F.when(kind == "error", F.concat(F.lit("  note "), n, F.lit(" "))).alias("comment"),
        F.when(kind == "purchase", F.when(n % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit("fix "), n))).alias("correction"))


def feedback_latest_wins(spark, sf_dir):
    return I.feedback_state(feedback(spark, sf_dir))


def feedback_refused(spark, sf_dir):
    bad = feedback(spark, sf_dir).withColumn("problem", I.feedback_problem()).filter("problem IS NOT NULL")
    return bad.groupBy("problem").agg(F.count("*").alias("rows"))


def _unrated(spark, sf_dir):
    """Interactions, one per event user, before any feedback."""
    return table(spark, sf_dir, "events").select(F.col("user_id")).distinct().select(
        F.concat(F.lit("i"), "user_id").alias("interaction_id"), F.lit("unrated").alias("rating"),
        F.lit("before").alias("feedback_category"), F.lit("before").alias("feedback_comment"),
        F.lit("before").alias("suggested_correction"))


def feedback_applied(spark, sf_dir):
    """Interactions, one per event user, with all feedback merged in."""
    return I.apply_feedback(_unrated(spark, sf_dir), I.feedback_state(feedback(spark, sf_dir)))


def feedback_versions(spark, sf_dir):
    """The same by two merges into a versioned table; one more from the first base is refused in between."""
    versions = VersionedTable(spark, new_table_path(spark, "versions"))
    rows = feedback(spark, sf_dir).filter(I.feedback_problem().isNull())
    # Earlier feedback first: what a later merge brings must be newer.
    middle = rows.agg(F.expr("percentile_approx(sequence, 0.5)")).first()[0] or 0
    first, later = rows.filter(F.col("sequence") <= middle), rows.filter(F.col("sequence") > middle)
    start = versions.write(_unrated(spark, sf_dir), None)
    merged = merge_version(versions, first, start)
    try:
        merge_version(versions, later, start)
    except StaleBase:
        merge_version(versions, later, merged)
    return versions.read()


def feedback_unmatched(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    # Two of forty rows own the id of their user, the others ids that nothing refers to.
    owners = rows.select(F.when(F.col("sequence") % 40 < 2, F.col("interaction_id")).otherwise(F.concat(F.lit("o"), "sequence")).alias("interaction_id"))
    return I.unmatched_feedback(owners, rows).groupBy("interaction_id", "owners").agg(F.count("*").alias("updates"))


_ANSWERS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS query, b.text AS raw_answer, a.conv_id + a.turn AS n,
  row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS seq FROM conversations a JOIN conversations b
  ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'),
made AS (SELECT *, 'tester_' || conv_id % 7 AS tester_id, 'session_' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS session_id,
  strftime(make_timestamp((1700000000 + conv_id * 60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM pairs WHERE trim(raw_answer) <> ''),
built AS (SELECT *, tester_id || '_' || session_id || '_' || lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS interaction_id,
  tester_id || '/' || session_id || '.jsonl' AS file, length(query) AS ql, length(raw_answer) AS al, n % 4 = 1 AS bare FROM made),
rated AS (SELECT *, CASE WHEN ql % 3 = 0 THEN 'helpful' WHEN ql % 3 = 1 THEN 'needs_review' END AS rating,
  CASE WHEN ql % 3 = 1 AND al % 4 <> 0 THEN ['incorrect','unsupported_claim','incomplete','irrelevant','wrong_source','unclear','formatting','other','odd_category'][al % 9 + 1] END AS category,
  CASE WHEN ql % 5 = 0 THEN left(query, 20) END AS comment, CASE WHEN al % 7 = 0 THEN left(raw_answer, 30) WHEN al % 7 = 1 THEN ' ' || chr(9) END AS correction,
  CASE WHEN al % 5 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS review, CASE WHEN al % 11 <> 0 THEN stamp END AS ts FROM built),
selected AS (SELECT *, coalesce(ts, 'None') AS sort_time FROM rated WHERE rating = 'needs_review' OR trim(correction, ' ' || chr(9) || chr(10)) <> ''),
labels_ AS (SELECT * FROM (VALUES ('unsupported_claim','Unsupported Claim',CAST(1 AS BIGINT)),('incomplete','Incomplete',2),('irrelevant','Irrelevant',3),('incorrect','Incorrect',4),('wrong_source','Wrong Source',5),
  ('unclear','Unclear',6),('formatting','Formatting',7),('other','Other',8),('__uncategorized__','Uncategorized',9),('odd_category','Odd Category',10)) t(category, heading, place)),
cats AS (SELECT tester_id, session_id, coalesce(category, '__uncategorized__') AS category, count(*) AS interactions FROM rated WHERE rating = 'needs_review' GROUP BY ALL)"""
_REVIEW_SOURCES = """CASE WHEN n % 4 = 0 THEN '- No compact source metadata available.' ELSE '- repo' || n % 2 || ' | core_library | `src/file' || n || '.cpp` | '
  || CASE WHEN n % 3 <> 0 THEN 'sym' || n ELSE '(unnamed)' END || ' | lines ' || (n + 1) || '-' || CASE WHEN n % 5 <> 0 THEN CAST(n + 9 AS VARCHAR) ELSE 'None' END
  || CASE WHEN bare THEN chr(10) || '- (repository unavailable) | (role unavailable) | `(path unavailable)` | (unnamed) | lines (line range unavailable)' ELSE '' END END"""
_EXPORT_SOURCES = """CASE WHEN n % 4 = 0 THEN '- Not recorded' ELSE '- repo' || n % 2 || ' — `src/file' || n || '.cpp`'
  || CASE WHEN n % 3 <> 0 THEN ' — `sym' || n || '`' ELSE '' END || ' — lines ' || (n + 1) || '–' || CASE WHEN n % 5 <> 0 THEN CAST(n + 9 AS VARCHAR) ELSE 'Not recorded' END
  || CASE WHEN bare THEN chr(10) || '- Not recorded — `Not recorded`' ELSE '' END END"""


def _fenced(text: str) -> str:
    width = f"greatest(3, coalesce(list_max([length(r) for r in regexp_extract_all({text}, '`+')]), 0) + 1)"
    return f"repeat('`', {width}) || 'text' || chr(10) || {text} || chr(10) || repeat('`', {width})"


_NL = "chr(10)"
_REVIEW_BLOCK = " || ".join([
    f"{_NL} || '## ' || place || '. ' || interaction_id || {_NL} || {_NL}", f"'- **Tester:** ' || tester_id || {_NL}",
    f"'- **Timestamp:** ' || coalesce(ts, 'None') || {_NL}", f"'- **Rating:** ' || coalesce(rating, 'None') || {_NL}",
    f"'- **Feedback category:** ' || coalesce(category, 'None') || {_NL}", f"'- **Feedback comment:** ' || coalesce(comment, 'None') || {_NL}",
    f"'- **Suggested correction:** ' || coalesce(correction, 'None') || {_NL}", f"'- **Review status:** ' || review || {_NL}",
    f"'- **Model / Top-K:** model-x / 5' || {_NL}", f"'- **alpha commit:** a1b2' || {_NL} || '- **beta commit:** c3d4' || {_NL}",
    f"'- **Source session file:** `' || file || '`' || {_NL} || {_NL} || '### Query' || {_NL}", _fenced("query"),
    f"{_NL} || {_NL} || '### Compact sources' || {_NL}", _REVIEW_SOURCES, f"{_NL} || {_NL} || '### Raw answer' || {_NL}", _fenced("raw_answer"),
])


def _part(label: str, value: str) -> str:
    return f"{_NL} || {_NL} || '**{label}**' || {_NL} || {_NL} || {value}"


def _block(review: bool) -> str:
    parts = [f"{_NL} || '{'####' if review else '###'} Interaction ' || seq", _part("Interaction ID", "'`' || interaction_id || '`'"),
             _part("Question", "coalesce(nullif(query, ''), 'Not recorded')"), _part("Answer", "raw_answer")]
    if review:
        parts += [_part("Feedback category", "coalesce(category, 'Not recorded')"), _part("Feedback comment", "coalesce(nullif(comment, ''), 'Not recorded')"),
                  _part("Suggested correction", "coalesce(nullif(correction, ''), 'Not recorded')")]
    parts += [_part("Sources", _EXPORT_SOURCES), _part("Review status", "review"), f"{_NL} || {_NL} || '---'"]
    return " || ".join(parts)


_HEAD = " || ".join([
    f"'# User Testing Session' || {_NL} || {_NL} || '> Tester feedback and suggested corrections are unreviewed evaluation input and must not be treated as approved repository knowledge.'",
    f"{_NL} || {_NL} || '## Session Metadata' || {_NL}", f"{_NL} || '- **Tester:** ' || tester_id", f"{_NL} || '- **Session:** ' || session_id",
    f"{_NL} || '- **Number of interactions:** ' || count(*)", f"{_NL} || '- **Model:** model-x' || {_NL} || '- **Top-K:** 5'",
    f"{_NL} || '- **Prompt version:** grounded_answer_v1' || {_NL} || '- **Retrieval version:** Not recorded' || {_NL} || '- **Chunking version:** Not recorded'",
    f"{_NL} || '- **alpha commit:** a1b2' || {_NL} || '- **beta commit:** c3d4'", f"{_NL} || {_NL} || '## Summary' || {_NL} || {_NL} || '| Rating | Count |' || {_NL} || '|---|---:|'",
    f"{_NL} || '| Helpful | ' || count(*) FILTER (rating = 'helpful') || ' |'", f"{_NL} || '| Needs review | ' || count(*) FILTER (rating = 'needs_review') || ' |'",
    f"{_NL} || '| Unrated | ' || count(*) FILTER (rating IS NULL) || ' |'",
])
_REPORT = f"""WITH {_ANSWERS}, g AS (SELECT *, CASE rating WHEN 'helpful' THEN 2 WHEN 'needs_review' THEN 3 ELSE 4 END AS grp FROM rated)
SELECT tester_id, session_id, CAST(0 AS BIGINT) AS "group", CAST(-1 AS BIGINT) AS "order", '' AS category, CAST(0 AS BIGINT) AS sequence, {_HEAD} AS block FROM rated GROUP BY tester_id, session_id
UNION ALL SELECT DISTINCT tester_id, session_id, 1, -1, '', 0, {_NL} || '### Needs-review categories' || {_NL} || {_NL} || '| Category | Count |' || {_NL} || '|---|---:' FROM cats
UNION ALL SELECT tester_id, session_id, 1, place, category, 0, '| ' || heading || ' | ' || interactions || ' |' FROM cats JOIN labels_ USING (category)
UNION ALL SELECT DISTINCT tester_id, session_id, grp, -1, '', 0, {_NL} || CASE grp WHEN 2 THEN '## Helpful' WHEN 3 THEN '## Needs Review' ELSE '## Unrated' END FROM g
UNION ALL SELECT tester_id, session_id, 3, place, category, 0, {_NL} || '### ' || heading FROM cats JOIN labels_ USING (category)
UNION ALL SELECT tester_id, session_id, grp, 0, '', seq, {_block(False)} FROM g WHERE grp <> 3
UNION ALL SELECT tester_id, session_id, 3, place, l.category, seq, {_block(True).replace("coalesce(category,", "coalesce(g.category,")} FROM g JOIN labels_ l ON l.category = coalesce(g.category, '__uncategorized__') WHERE grp = 3"""

_LINES = """l AS (SELECT conv_id AS c, turn AS t, length(text) AS n, 't' || conv_id % 5 || '/session_' || conv_id || '.jsonl' AS path, turn + 1 AS line_number FROM conversations),
x AS (SELECT *, CASE WHEN n % 29 = 6 THEN 'blank' WHEN n % 29 = 7 THEN 'bad' WHEN n % 29 = 8 THEN 'array' ELSE 'object' END AS kind,
  CASE WHEN n % 13 = 1 THEN ' ' WHEN n % 13 = 2 THEN '7' ELSE 'i' || c || '_' || CASE WHEN c % 8 = 3 AND t > 0 THEN 0 ELSE t END END AS interaction_id,
  CASE WHEN c % 6 = 1 AND t = 1 THEN 't9' ELSE 't' || c % 5 END AS tester_id,
  CASE WHEN n % 17 <> 3 THEN CASE WHEN c % 6 = 2 AND t = 1 THEN 'session_x' ELSE 'session_' || c END END AS session_id,
  array_to_string(list_concat(CASE WHEN n % 17 = 3 THEN ['session_id'] ELSE [] END, CASE WHEN n % 19 = 4 THEN ['raw_answer'] ELSE [] END), ', ') AS gaps FROM l)"""
_SESSION_CASE = """CASE WHEN kind = 'bad' THEN 'invalid JSON' WHEN kind = 'array' THEN 'JSONL value must be an object' WHEN gaps <> '' THEN 'missing required field(s): ' || gaps
  WHEN n % 13 = 2 THEN 'interaction_id must be a non-empty string' WHEN {last} END AS problem"""
_FEEDBACK = """f AS (SELECT 'i' || user_id AS interaction_id, event_id AS sequence, CASE event_type WHEN 'click' THEN 'helpful' WHEN 'error' THEN 'review' WHEN 'purchase' THEN 'correction'
    WHEN 'signup' THEN 'review' ELSE 'unknown' END AS action,
  CASE WHEN event_type IN ('error','signup') THEN ['incorrect','unsupported_claim','incomplete','irrelevant','wrong_source','unclear','formatting','other','bogus'][event_id % 9 + 1] END AS category,
  CASE WHEN event_type = 'error' THEN 'note ' || event_id END AS comment, CASE WHEN event_type = 'purchase' AND event_id % 6 <> 0 THEN 'fix ' || event_id END AS correction FROM events),
p AS (SELECT *, CASE WHEN action = 'unknown' THEN 'unknown action' WHEN action = 'review' AND category = 'bogus' THEN 'Select a valid feedback category before saving.'
    WHEN action = 'correction' AND correction IS NULL THEN 'Enter a correction before saving.' END AS problem FROM f),
v AS (SELECT * FROM p WHERE problem IS NULL)"""
_STATE = """SELECT interaction_id, count(*) AS updates, arg_max(CASE WHEN action = 'helpful' THEN 'helpful' ELSE 'needs_review' END, sequence) AS rating,
  arg_max(category, sequence) FILTER (action = 'review') AS feedback_category,
  arg_max(coalesce(comment, ''), sequence) FILTER (action = 'review') AS c0, coalesce(bool_or(action = 'review'), false) AS reviewed,
  arg_max(correction, sequence) FILTER (action = 'correction') AS suggested_correction FROM v {where} GROUP BY interaction_id"""

WORKLOADS = {
    "interactions_from_turns": (interactions_from_turns, f"""WITH {_ANSWERS} SELECT interaction_id, session_id, tester_id, stamp AS timestamp, sha256(query) AS query_sha, sha256(raw_answer) AS answer_sha,
        CAST(CASE WHEN n % 4 = 0 THEN 0 WHEN bare THEN 2 ELSE 1 END AS BIGINT) AS sources, 'grounded_answer_v1' AS prompt_version, 'successful' AS status, 'unreviewed' AS review_status, 5 AS top_k FROM built"""),
    "session_log_round_trip": (session_log_round_trip, f"""WITH {_ANSWERS} SELECT interaction_id, file, row_number() OVER (PARTITION BY file ORDER BY seq) AS sequence,
        sha256(query) AS query_sha, sha256(raw_answer) AS answer_sha, 'a1b2' AS alpha, false AS bad FROM built"""),
    "session_assignment": (session_assignment, """WITH r AS (SELECT event_id % 16 AS log, event_id AS place, event_type AS tester_id, CASE WHEN event_id % 50 = 0 THEN 'given' || event_id END AS given FROM events),
        m AS (SELECT *, CASE WHEN given IS NOT NULL OR coalesce(lag(tester_id) OVER (PARTITION BY log ORDER BY place) <> tester_id, true) THEN coalesce(given, 's' || place) END AS started FROM r)
        SELECT log, place, tester_id, last_value(started IGNORE NULLS) OVER (PARTITION BY log ORDER BY place) AS session_id FROM m"""),
    "evidence_metadata": (evidence_metadata, f"""WITH {_ANSWERS} SELECT interaction_id, 1 AS rank, 'repo' || n % 2 AS repository, 'src/file' || n || '.cpp' AS source_path, 'core_library' AS source_role,
          CASE WHEN n % 3 <> 0 THEN 'sym' || n END AS symbol_or_section_title, n + 1 AS line_start, CASE WHEN n % 5 <> 0 THEN n + 9 END AS line_end FROM built WHERE n % 4 <> 0
        UNION ALL SELECT interaction_id, 2, NULL, NULL, NULL, NULL, NULL, NULL FROM built WHERE bare"""),
    "rating_buckets": (rating_buckets, f"""WITH {_ANSWERS} SELECT tester_id, session_id, count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'needs_review') AS needs_review,
        count(*) FILTER (rating IS NULL) AS unrated FROM rated GROUP BY ALL"""),
    "category_counts": (category_counts, f"""WITH {_ANSWERS} SELECT 'feedback_category' AS dimension, coalesce(category, '(none)') AS value, count(*) AS interactions FROM selected GROUP BY 2
        UNION ALL SELECT 'tester', tester_id, count(*) FROM selected GROUP BY 2"""),
    "review_batch_head": (review_batch_head, f"""WITH {_ANSWERS} SELECT 1 AS part, coalesce(category, '(none)') AS text, '- `' || coalesce(category, '(none)') || '`: ' || count(*) AS block FROM selected GROUP BY 2
        UNION ALL SELECT 2, '', chr(10) || '## Counts by tester' || chr(10)
        UNION ALL SELECT 3, tester_id, '- `' || tester_id || '`: ' || count(*) FROM selected GROUP BY 2"""),
    "review_categories": (review_categories, f"WITH {_ANSWERS} SELECT tester_id, session_id, category, interactions, heading, place FROM cats JOIN labels_ USING (category)"),
    "needs_review_select": (needs_review_select, f"WITH {_ANSWERS} SELECT interaction_id, sort_time, rating, review AS review_status FROM selected WHERE review = 'unreviewed'"),
    "review_projection": (review_projection, f"""WITH {_ANSWERS} SELECT interaction_id, session_id, ts AS timestamp, rating, category AS feedback_category, comment AS feedback_comment,
        correction AS suggested_correction, review AS review_status, file AS source_session_file, 'alpha' AS first_repository FROM selected"""),
    "session_first_metadata": (session_first_metadata, f"""WITH {_ANSWERS} SELECT tester_id, session_id, count(*) AS interactions, arg_min(coalesce(ts, ''), seq) AS t0 , 'model-x' AS model, 5 AS top_k,
        'grounded_answer_v1' AS prompt_version FROM rated GROUP BY ALL""".replace("arg_min(coalesce(ts, ''), seq) AS t0 ", "nullif(arg_min(coalesce(ts, ''), seq), '') AS timestamp")),
    "scan_counters": (scan_counters, f"WITH {_ANSWERS} SELECT count(DISTINCT file) AS files, count(*) AS interactions, (SELECT count(*) FROM selected) AS selected FROM rated"),
    "review_report": (review_report, f"""WITH {_ANSWERS}, o AS (SELECT *, row_number() OVER (ORDER BY sort_time, tester_id, interaction_id) AS place FROM selected)
        SELECT place, {_REVIEW_BLOCK} AS block FROM o"""),
    "session_report": (session_report, _REPORT),
    "source_listings": (source_listings, f"WITH {_ANSWERS} SELECT interaction_id, {_REVIEW_SOURCES} AS review, {_EXPORT_SOURCES} AS export FROM built"),
    "session_paths": (session_paths, """SELECT ['amy/session_','amy/notes_','review_batches/session_','../x/session_','a/b/session_','/session_'][c_custkey % 6 + 1] || c_custkey || '.jsonl' AS path,
        [NULL, 'Session filename must match session_*.jsonl.', 'Session file must be directly inside a tester directory.', 'Session path must be inside the log root.',
         'Session file must be directly inside a tester directory.', 'Session path must be inside the log root.'][c_custkey % 6 + 1] AS problem FROM customer"""),
    "tester_sessions": (tester_sessions, """SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place
        FROM (SELECT DISTINCT 'bob/session_' || c_custkey % 90 || '.jsonl' AS path FROM customer WHERE c_custkey % 2 = 1)"""),
    "exportable_sessions": (exportable_sessions, """SELECT 'amy/session_' || c_custkey % 40 || '.jsonl' AS path, count(*) AS lines FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1
        UNION ALL SELECT DISTINCT 'excluded: local_tester', CAST(0 AS BIGINT) FROM customer WHERE c_custkey % 5 = 1"""),
    "review_violations": (review_violations, f"""WITH {_LINES} SELECT path, line_number, problem FROM (SELECT *, CASE WHEN kind = 'bad' THEN 'invalid JSON' WHEN kind = 'array' THEN 'JSONL value must be an object'
        WHEN n % 19 = 4 THEN 'missing required field(s): raw_answer' WHEN n % 13 IN (1, 2) THEN 'interaction_id must be a non-empty string' END AS problem FROM x WHERE kind <> 'blank') WHERE problem IS NOT NULL"""),
    "session_violations": (session_violations, f"""WITH {_LINES} SELECT path, line_number, problem FROM (SELECT *, {_SESSION_CASE.format(last="n % 7 IN (0, 2) THEN 'unsupported rating value'")}
        FROM x WHERE kind <> 'blank') WHERE problem IS NOT NULL"""),
    "submission_violations": (submission_violations, f"""WITH {_LINES} SELECT path, line_number, problem FROM (SELECT *, {_SESSION_CASE.format(last="n % 23 = 5 THEN 'prohibited secret field: Access-Token'")}
        FROM x WHERE kind <> 'blank') WHERE problem IS NOT NULL"""),
    "repeated_interactions": (repeated_interactions, f"""WITH {_LINES} SELECT interaction_id, count(*) AS rows, min(path) AS first_path, max(path) AS last_path FROM x WHERE kind = 'object' GROUP BY 1 HAVING count(*) > 1"""),
    "session_consistency": (session_consistency, f"""WITH {_LINES} SELECT path, count(*) AS interactions, CASE WHEN count(DISTINCT tester_id) FILTER (kind = 'object') > 1 THEN 'inconsistent tester_id'
        WHEN count(DISTINCT session_id) FILTER (kind = 'object') > 1 THEN 'inconsistent session_id' WHEN min(tester_id) FILTER (kind = 'object') <> regexp_extract(path, '^([^/]*)', 1) THEN 'tester_id does not match tester directory'
        END AS problem FROM x WHERE kind <> 'blank' GROUP BY path"""),
    "feedback_latest_wins": (feedback_latest_wins, f"WITH {_FEEDBACK} SELECT interaction_id, updates, rating, feedback_category, nullif(c0, '') AS feedback_comment, reviewed, suggested_correction FROM ({_STATE.format(where='')})"),
    "feedback_refused": (feedback_refused, f"WITH {_FEEDBACK} SELECT problem, count(*) AS rows FROM p WHERE problem IS NOT NULL GROUP BY 1"),
    "feedback_applied": (feedback_applied, f"""WITH {_FEEDBACK}, s AS ({_STATE.format(where='')}), b AS (SELECT DISTINCT 'i' || user_id AS interaction_id FROM events)
        SELECT b.interaction_id, coalesce(s.rating, 'unrated') AS rating, CASE WHEN reviewed THEN feedback_category ELSE 'before' END AS feedback_category,
          CASE WHEN reviewed THEN nullif(c0, '') ELSE 'before' END AS feedback_comment, coalesce(s.suggested_correction, 'before') AS suggested_correction FROM b LEFT JOIN s USING (interaction_id)"""),
    "feedback_unmatched": (feedback_unmatched, f"""WITH {_FEEDBACK}, o AS (SELECT CASE WHEN sequence % 40 < 2 THEN interaction_id ELSE 'o' || sequence END AS interaction_id, count(*) AS owners FROM f GROUP BY 1)
        SELECT interaction_id, coalesce(owners, 0) AS owners, count(*) AS updates FROM f LEFT JOIN o USING (interaction_id) WHERE coalesce(owners, 0) <> 1 GROUP BY ALL"""),
}

WORKLOADS["feedback_versions"] = (feedback_versions, WORKLOADS["feedback_applied"][1])
