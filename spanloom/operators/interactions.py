"""Interaction records: building, validating, selecting, merging feedback."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import (
    CATEGORY_LABELS, DEFAULT_TESTER, FEEDBACK_CATEGORIES, PROMPT_VERSION, RATINGS,
    REVIEW_REQUIRED_FIELDS, SESSION_REQUIRED_FIELDS,
)
from spanloom.functions import jsontext as J
from spanloom.functions import text as T
from spanloom.operators.evidence import evidence_metadata
from spanloom.operators.scale import running
from spanloom.schemas import INTERACTION

# --------------------------------------------------------------------------
# What users read about records that are refused.
# --------------------------------------------------------------------------
NOT_JSON = "invalid JSON"
NOT_OBJECT = "JSONL value must be an object"
MISSING = "missing required field(s): "
EMPTY = "{} must be a non-empty string"
SECRET = "prohibited secret field: "
BAD_RATING = "unsupported rating value"
MIXED_TESTERS = "inconsistent tester_id"
MIXED_SESSIONS = "inconsistent session_id"
OTHER_TESTER = "tester_id does not match tester directory"
DEVELOPMENT_TESTER = "development-only tester"
BAD_TESTER = "tester directory name is not valid"
OTHER_SESSION = "session_id does not match the session filename"
BAD_ACTION = "unknown action"
BAD_CATEGORY = "Select a valid feedback category before saving."
NO_CORRECTION = "Enter a correction before saving."

UNCATEGORIZED = "__uncategorized__"


def numbered_in_session(rows: DataFrame, session: str, order: str, width: int = 1 << 16) -> DataFrame:
    """1-based `sequence` of each row in its session by a unique integer order.

    A running count in buckets: one session may hold any share of the rows.
    """
    placed = running(rows.withColumn("_one", F.lit(1)), [session], order, width, sum_of={"sequence": "_one"},
                     inclusive=True)
    return placed.drop("_one")


def interaction_id(tester: Column, session: Column, sequence: Column) -> Column:
    return F.concat_ws("_", tester, session, F.format_string("%04d", sequence))


def build_interactions(answers: DataFrame, commits: Mapping[str, str]) -> DataFrame:
    """Interaction records of successful answers with their initial feedback fields.

    `answers` has tester_id, session_id, sequence, timestamp, query, raw_answer,
    sources, model, base_url and top_k. Blank answers are not logged.
    """
    tester = T.safe_tester_id(F.col("tester_id"), DEFAULT_TESTER)
    pairs = [x for name, commit in commits.items() for x in (F.lit(name), F.lit(commit))]
    fixed = {
        "rendered_answer": None, "retrieval_version": None, "chunking_version": None,
        "prompt_version": PROMPT_VERSION, "status": "successful", "rating": None,
        "feedback_category": None, "feedback_comment": None, "suggested_correction": None,
        "review_status": "unreviewed",
    }
    kept = answers.filter(~T.is_blank(F.col("raw_answer"))).withColumn("tester_id", tester)
    made = kept.withColumn(
        "interaction_id", interaction_id(F.col("tester_id"), F.col("session_id"), F.col("sequence"))
    ).withColumn("retrieved_evidence_metadata", evidence_metadata(F.col("sources"))).withColumn(
        "repository_commits",
        F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"),
    )
    for name, value in fixed.items():
        made = made.withColumn(name, F.lit(value))
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INTERACTION])


# --------------------------------------------------------------------------
# Validation of raw JSON lines: (path, line_number, value)
# --------------------------------------------------------------------------
def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their checks' inputs; blank lines are skipped."""
    value = F.col("value")
    return (
        lines.filter(~T.is_blank(value))
        .withColumn("is_json", J.is_valid(value))
        .withColumn("is_object", J.is_object(value))
        .withColumn("interaction_id", F.get_json_object(value, "$.interaction_id"))
        .withColumn("tester_id", F.get_json_object(value, "$.tester_id"))
        .withColumn("session_id", F.get_json_object(value, "$.session_id"))
        .withColumn("rating", F.get_json_object(value, "$.rating"))
    )


def _bad_text(name: str, blank_counts: bool) -> Column:
    """A field that is not a string, or is empty (or blank, if blank counts as empty)."""
    column = F.col(name)
    empty = T.is_blank(column) if blank_counts else column.isNull() | (column == "")
    return (F.coalesce(J.field_type(F.col("value"), name), F.lit("VOID")) != "STRING") | empty


def review_violations(lines: DataFrame) -> DataFrame:
    """Lines that an aggregation may not read: (path, line_number, problem)."""
    missing = J.missing_fields(F.col("value"), REVIEW_REQUIRED_FIELDS)
    problem = (
        F.when(~F.col("is_json"), NOT_JSON)
        .when(~F.col("is_object"), NOT_OBJECT)
        .when(F.size(missing) > 0, F.concat(F.lit(MISSING), F.array_join(missing, ", ")))
        .when(_bad_text("interaction_id", True), EMPTY.format("interaction_id"))
        .when(_bad_text("tester_id", True), EMPTY.format("tester_id"))
    )
    return parsed(lines).select("path", "line_number", problem.alias("problem")).filter("problem IS NOT NULL")


def repeated_interactions(lines: DataFrame, per_file: bool = False) -> DataFrame:
    """Interaction ids that occur more than once, over all files or within one."""
    keys = ["path", "interaction_id"] if per_file else ["interaction_id"]
    return (
        parsed(lines).filter("interaction_id IS NOT NULL").groupBy(*keys)
        .agg(F.count("*").alias("rows"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .filter("rows > 1")
    )


def session_violations(lines: DataFrame, submission: bool = False) -> DataFrame:
    """Lines that an export, or the stricter submission, may not read."""
    value, missing = F.col("value"), J.missing_fields(F.col("value"), SESSION_REQUIRED_FIELDS)
    rating_type = F.coalesce(J.field_type(value, "rating"), F.lit("VOID"))
    bad_rating = (rating_type != "VOID") & ~((rating_type == "STRING") & F.col("rating").isin(*RATINGS))
    problem = (
        F.when(~F.col("is_json"), NOT_JSON)
        .when(~F.col("is_object"), NOT_OBJECT)
        .when(F.size(missing) > 0, F.concat(F.lit(MISSING), F.array_join(missing, ", ")))
    )
    for name in ("tester_id", "session_id", "interaction_id"):
        problem = problem.when(_bad_text(name, False), EMPTY.format(name))
    if submission:
        secret = J.first_secret_key(value)
        problem = problem.when(secret.isNotNull(), F.concat(F.lit(SECRET), secret))
    else:
        problem = problem.when(bad_rating, BAD_RATING)
    return parsed(lines).select("path", "line_number", problem.alias("problem")).filter("problem IS NOT NULL")


def session_consistency(lines: DataFrame, submission: bool = False) -> DataFrame:
    """Per session file, the first rule about the file as a whole that it breaks.

    One tester and one session per file, the tester being the directory; for a
    submission the session is the file's stem and the tester is not the
    development one.
    """
    directory = F.element_at(F.split("path", "/"), -2)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl$", "")
    per_file = parsed(lines).groupBy("path").agg(
        F.count("*").alias("interactions"),
        F.min("tester_id").alias("tester_id"), F.max("tester_id").alias("other_tester"),
        F.min("session_id").alias("session_id"), F.max("session_id").alias("other_session"),
    )
    problem = (
        F.when(F.col("tester_id") != F.col("other_tester"), MIXED_TESTERS)
        .when(F.col("session_id") != F.col("other_session"), MIXED_SESSIONS)
        .when(F.col("tester_id") != directory, OTHER_TESTER)
    )
    if submission:
        problem = (
            problem.when(directory == DEFAULT_TESTER, DEVELOPMENT_TESTER)
            .when(~directory.rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"), BAD_TESTER)
            .when(F.col("session_id") != stem, OTHER_SESSION)
        )
    return per_file.select("path", "tester_id", "session_id", "interactions", problem.alias("problem"))


# --------------------------------------------------------------------------
# Review selection and counts
# --------------------------------------------------------------------------
def needs_review(only_unreviewed: bool = False) -> Column:
    """Rated for review, or carrying a correction that is not blank."""
    selected = F.coalesce(F.col("rating") == "needs_review", F.lit(False)) | ~T.is_blank(F.col("suggested_correction"))
    if only_unreviewed:
        selected = selected & F.coalesce(F.col("review_status") == "unreviewed", F.lit(False))
    return selected


def review_order() -> list[str]:
    """Timestamps sort as text; a null one sorts as the word it would print as."""
    return ["sort_time", "tester_id", "interaction_id"]


def select_for_review(interactions: DataFrame, only_unreviewed: bool = False) -> DataFrame:
    return interactions.filter(needs_review(only_unreviewed)).withColumn(
        "sort_time", F.coalesce("timestamp", F.lit("None"))
    )


REVIEW_COLUMNS = tuple(
    f.name for f in INTERACTION if f.name not in ("rendered_answer", "status")
)


def review_records(selected: DataFrame) -> DataFrame:
    """The columns a review batch keeps, with the session file each row is from."""
    return selected.select(*REVIEW_COLUMNS, "source_session_file")


def category_counts(selected: DataFrame) -> DataFrame:
    """Counts by feedback category and by tester, in one pass."""
    category = F.coalesce(T.first_filled(F.col("feedback_category")), F.lit("(none)"))
    pairs = F.array(
        F.struct(F.lit("feedback_category").alias("dimension"), category.alias("value")),
        F.struct(F.lit("tester").alias("dimension"), F.col("tester_id").alias("value")),
    )
    return (
        selected.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value")
        .agg(F.count("*").alias("interactions"))
    )


def rating_bucket() -> Column:
    return F.when(F.col("rating").isin(*RATINGS), F.col("rating")).otherwise("unrated")


def category_key() -> Column:
    return F.coalesce(T.first_filled(F.col("feedback_category")), F.lit(UNCATEGORIZED))


def category_place(key: Column) -> Column:
    """Place in the fixed report order; unknown categories come last."""
    known = F.array(*[F.lit(c) for c in CATEGORY_LABELS])
    return F.coalesce(F.nullif(F.array_position(known, key), F.lit(0).cast("long")),
                      F.lit(len(CATEGORY_LABELS) + 1).cast("long"))


def category_heading(key: Column) -> Column:
    """Heading of a category; an unknown one is shown in title case."""
    labels = F.create_map(*[x for k, v in CATEGORY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    spaced = F.replace(key, F.lit("_"), F.lit(" "))
    # Capital after every non-letter, not only after spaces.
    runs = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    return F.coalesce(F.try_element_at(labels, key), titled)


def session_buckets(interactions: DataFrame) -> DataFrame:
    """Helpful, needs-review and unrated counts per session."""
    return interactions.groupBy("tester_id", "session_id").agg(
        F.count_if(rating_bucket() == "helpful").alias("helpful"),
        F.count_if(rating_bucket() == "needs_review").alias("needs_review"),
        F.count_if(rating_bucket() == "unrated").alias("unrated"),
    )


def review_category_table(interactions: DataFrame) -> DataFrame:
    """Needs-review counts per session and category with heading and report order."""
    return (
        interactions.filter(rating_bucket() == "needs_review")
        .groupBy("tester_id", "session_id", category_key().alias("category"))
        .agg(F.count("*").alias("interactions"))
        .withColumn("heading", category_heading(F.col("category")))
        .withColumn("place", category_place(F.col("category")))
    )


def first_of_session(interactions: DataFrame, columns: list[str]) -> DataFrame:
    """Session size with the first interaction's values."""
    return (
        interactions.groupBy("tester_id", "session_id")
        .agg(F.count("*").alias("interactions"), F.min_by(F.struct(*columns), "sequence").alias("first"))
        .select("tester_id", "session_id", "interactions", *[F.col(f"first.{c}").alias(c) for c in columns])
    )


# --------------------------------------------------------------------------
# Feedback
# --------------------------------------------------------------------------
def feedback_problem() -> Column:
    """Why a feedback row is refused, or null."""
    return (
        F.when(~F.col("action").isin("helpful", "review", "correction"), BAD_ACTION)
        .when((F.col("action") == "review") & ~F.coalesce(F.col("category").isin(*FEEDBACK_CATEGORIES), F.lit(False)),
              BAD_CATEGORY)
        .when((F.col("action") == "correction") & T.is_blank(F.col("correction")), NO_CORRECTION)
    )


def feedback_state(feedback: DataFrame) -> DataFrame:
    """Latest value of each field group per interaction.

    A helpful mark sets the rating only; a review sets rating, category and
    comment, the comment possibly back to null; a correction sets rating and
    correction. The latest row that touches a group decides it, found by an
    aggregate that combines before the shuffle.
    """
    valid = feedback.filter(feedback_problem().isNull())

    def trimmed(name: str) -> Column:
        return F.when(~T.is_blank(F.col(name)), T.strip(F.col(name)))

    review = F.when(F.col("action") == "review", F.col("sequence"))
    correction = F.when(F.col("action") == "correction", F.col("sequence"))
    return (
        valid.groupBy("interaction_id").agg(
            F.count("*").alias("updates"),
            F.max_by(F.when(F.col("action") == "helpful", "helpful").otherwise("needs_review"), "sequence").alias("rating"),
            F.max_by(F.struct("category", trimmed("comment").alias("comment")), review).alias("review"),
            F.max_by(trimmed("correction"), correction).alias("suggested_correction"),
        )
        .select(
            "interaction_id", "updates", "rating",
            F.col("review.category").alias("feedback_category"),
            F.col("review.comment").alias("feedback_comment"),
            F.col("review").isNotNull().alias("reviewed"),
            F.col("suggested_correction"),
        )
    )


def apply_feedback(interactions: DataFrame, state: DataFrame) -> DataFrame:
    """Interactions with the latest feedback; untouched groups keep their values."""
    new = state.select(
        "interaction_id", F.col("rating").alias("_rating"), F.col("feedback_category").alias("_category"),
        F.col("feedback_comment").alias("_comment"), F.col("reviewed").alias("_reviewed"),
        F.col("suggested_correction").alias("_correction"),
    )
    joined = interactions.join(new, "interaction_id", "left")
    reviewed = F.coalesce("_reviewed", F.lit(False))
    return (
        joined.withColumn("rating", F.coalesce("_rating", "rating"))
        .withColumn("feedback_category", F.when(reviewed, F.col("_category")).otherwise(F.col("feedback_category")))
        .withColumn("feedback_comment", F.when(reviewed, F.col("_comment")).otherwise(F.col("feedback_comment")))
        .withColumn("suggested_correction", F.coalesce("_correction", "suggested_correction"))
        .select(*interactions.columns)
    )


def unmatched_feedback(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback whose interaction is missing or occurs more than once."""
    owners = interactions.groupBy("interaction_id").agg(F.count("*").alias("owners"))
    return (
        feedback.join(owners, "interaction_id", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
        .filter("owners <> 1")
    )
