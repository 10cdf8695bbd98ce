"""Markdown lines and blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.config import DEFAULT_ENDPOINT_LABEL
from spanloom.functions import text as T

NO_SOURCES = "- No compact source metadata available."


def _or(value: Column, fallback: str) -> Column:
    return F.coalesce(F.when(value != "", value), F.lit(fallback))


def _printed(value: Column) -> Column:
    """A value as text, null as the word None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def review_source_lines(sources: Column) -> Column:
    """One bullet per source for a review batch."""

    def line(s: Column) -> Column:
        no_range = s["start_line"].isNull() & s["end_line"].isNull()
        span = F.when(no_range, "(line range unavailable)").otherwise(
            F.concat(_printed(s["start_line"]), F.lit("-"), _printed(s["end_line"]))
        )
        return F.concat(
            F.lit("- "), _or(s["repository"], "(repository unavailable)"), F.lit(" | "),
            _or(s["source_role"], "(role unavailable)"), F.lit(" | `"),
            _or(s["source_path"], "(path unavailable)"), F.lit("` | "),
            _or(s["symbol_or_section_title"], "(unnamed)"), F.lit(" | lines "), span,
        )

    lines = F.transform(F.filter(sources, lambda s: s.isNotNull()), line)
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(NO_SOURCES)


def export_source_lines(sources: Column) -> Column:
    """One bullet per source for a session report."""

    def line(s: Column) -> Column:
        label = T.first_filled(s["symbol_or_section_title"])
        ranged = s["start_line"].isNotNull() | s["end_line"].isNotNull()
        return F.concat(F.lit("- "), F.concat_ws(
            " — ", T.or_not_recorded(s["repository"]), T.inline_code(s["source_path"]),
            F.when(label.isNotNull(), T.inline_code(label)),
            F.when(ranged, F.concat(
                F.lit("lines "), T.or_not_recorded(s["start_line"].cast("string")), F.lit("–"),
                T.or_not_recorded(s["end_line"].cast("string")),
            )),
        ))

    lines = F.transform(F.filter(sources, lambda s: s.isNotNull()), line)
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("- Not recorded")


def numbered_sources(sources: Column) -> Column:
    """Sources of an answer as a numbered list."""
    lines = F.transform(sources, lambda s, i: F.concat(
        (i + 1).cast("string"), F.lit(". **"), _printed(s["repository"]), F.lit("** | `"),
        _printed(s["source_role"]), F.lit("`\n   `"), _printed(s["source_path"]), F.lit("`\n   lines "),
        _printed(s["start_line"]), F.lit("-"), _printed(s["end_line"]), F.lit(" | "),
        _or(s["symbol_or_section_title"], "(unnamed chunk)"),
    ))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(
        "No retrieval evidence was returned."
    )


def evidence_preview() -> Column:
    """One result with its content preview."""
    return F.concat(
        F.lit("**"), F.col("rank").cast("string"), F.lit(". "), _printed(F.col("repository")), F.lit(" | "),
        _printed(F.col("source_role")), F.lit("**\n`"), _printed(F.col("source_path")), F.lit("`\nLines "),
        _printed(F.col("start_line")), F.lit("-"), _printed(F.col("end_line")), F.lit(" | "),
        F.coalesce("label", F.lit("(unnamed chunk)")), F.lit("\n"), T.preview(F.col("content"), 300),
    )


def technical_details() -> Column:
    """Model, endpoint, top-k and outcome of an answer."""
    outcome = F.when(T.first_filled(F.col("error")).isNotNull(), F.concat(F.lit("- **Warning/error:** "), F.col("error")))
    return F.concat(
        F.lit("- **LLM model:** `"), _or(F.col("model"), "(not configured)"),
        F.lit("`\n- **LLM base URL:** `"), _or(F.col("base_url"), DEFAULT_ENDPOINT_LABEL),
        F.lit("`\n- **Top-K:** "), F.col("top_k").cast("string"), F.lit("\n"),
        outcome.otherwise("- **Status:** successful"),
    )


def history_entry(number: Column) -> Column:
    """One past interaction."""
    status = F.when(F.col("success"), "success").otherwise(F.concat(F.lit("warning: "), _printed(F.col("error"))))
    answer = F.when(
        F.col("success"),
        F.concat(F.lit("\n\n### Final answer\n\n"), _or(F.col("answer"), "_No answer returned._")),
    ).otherwise("")
    return F.concat(
        F.lit("## Interaction "), number.cast("string"), F.lit("\n\n**Question:** "), F.col("query"),
        F.lit("\n\n**Timestamp:** "), F.col("timestamp"), F.lit("\n\n**Model:** `"),
        _or(F.col("model"), "(not configured)"), F.lit("`\n\n**Status:** "), status, answer, F.lit("\n\n---"),
    )


def status_line() -> Column:
    message = F.left(_or(F.col("error"), "LLM returned no displayable answer."), F.lit(240))
    return F.when(F.col("success"), "**Status:** Completed").otherwise(F.concat(F.lit("**Status:** "), message))


def _commit_lines(label: str = "commit") -> Column:
    """A line per indexed repository, in map order."""
    entries = F.map_entries(F.coalesce("repository_commits", F.create_map().cast("map<string,string>")))
    return F.array_join(F.transform(
        F.array_sort(entries),
        lambda e: F.concat(F.lit("- **"), e["key"], F.lit(f" {label}:** "), _printed(e["value"]), F.lit("\n")),
    ), "")


def review_block(number: Column) -> Column:
    """One selected interaction of a review batch."""

    def item(label: str, name: str) -> Column:
        return F.concat(F.lit(f"- **{label}:** "), _printed(F.col(name)), F.lit("\n"))

    return F.concat(
        F.lit("\n## "), number.cast("string"), F.lit(". "), F.col("interaction_id"), F.lit("\n\n"),
        item("Tester", "tester_id"), item("Timestamp", "timestamp"), item("Rating", "rating"),
        item("Feedback category", "feedback_category"), item("Feedback comment", "feedback_comment"),
        item("Suggested correction", "suggested_correction"), item("Review status", "review_status"),
        F.lit("- **Model / Top-K:** "), _printed(F.col("model")), F.lit(" / "), _printed(F.col("top_k")), F.lit("\n"),
        _commit_lines(), F.lit("- **Source session file:** `"), F.col("source_session_file"), F.lit("`\n\n### Query\n"),
        T.fenced(F.col("query")), F.lit("\n\n### Compact sources\n"), review_source_lines(F.col("sources")),
        F.lit("\n\n### Raw answer\n"), T.fenced(F.col("raw_answer")),
    )


def interaction_block(sequence: Column, needs_review: bool) -> Column:
    """One interaction of a session report."""

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"\n\n**{label}**\n\n"), value)

    heading = "####" if needs_review else "###"
    parts = [
        F.lit(f"{heading} Interaction "), sequence.cast("string"),
        part("Interaction ID", T.inline_code(F.col("interaction_id"))),
        part("Question", T.or_not_recorded(F.col("query"))),
        part("Answer", T.balanced_markdown(F.col("raw_answer"))),
    ]
    if needs_review:
        parts += [
            part("Feedback category", T.or_not_recorded(F.col("feedback_category"))),
            part("Feedback comment", T.or_not_recorded(F.col("feedback_comment"))),
            part("Suggested correction", T.or_not_recorded(F.col("suggested_correction"))),
        ]
    parts += [
        part("Sources", export_source_lines(F.col("sources"))),
        part("Review status", T.or_not_recorded(F.col("review_status"))),
    ]
    return F.concat(*parts)


def session_header() -> Column:
    """Title, metadata and rating counts of a session report."""

    def item(label: str, name: str) -> Column:
        return F.concat(F.lit(f"\n- **{label}:** "), T.or_not_recorded(F.col(name).cast("string")))

    def row(label: str, name: str) -> Column:
        return F.concat(F.lit(f"\n| {label} | "), F.col(name).cast("string"), F.lit(" |"))

    commits = F.regexp_replace(_commit_lines(), "\n$", "")
    return F.concat(
        F.lit(
            "# User Testing Session\n\n> Tester feedback and suggested corrections are unreviewed evaluation "
            "input and must not be treated as approved repository knowledge.\n\n## Session Metadata\n"
        ),
        item("Tester", "tester_id"), item("Session", "session_id"),
        item("Number of interactions", "interactions"), item("Model", "model"), item("Top-K", "top_k"),
        item("Prompt version", "prompt_version"), item("Retrieval version", "retrieval_version"),
        item("Chunking version", "chunking_version"),
        F.when(commits != "", F.concat(F.lit("\n"), commits)).otherwise(""),
        F.lit("\n\n## Summary\n\n| Rating | Count |\n|---|---:|"),
        row("Helpful", "helpful"), row("Needs review", "needs_review"), row("Unrated", "unrated"),
    )


def table_row(*cells: Column) -> Column:
    """A Markdown table row; fractions with two decimals."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)
