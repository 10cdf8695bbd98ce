"""Review batches, session reports, submissions and feedback snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import render as R
from spanloom.operators import interactions as I
from spanloom.operators.scale import numbered, top_rows
from spanloom.sources import sessions as S
from spanloom.sources.versions import VersionedTable

SUFFIX = re.compile(r"^\d{8}T\d{6}Z$")
REPORT_COLUMNS = [
    "model", "top_k", "prompt_version", "retrieval_version", "chunking_version", "repository_commits",
]


def _stop_on(problems: DataFrame, what: str) -> None:
    found = problems.limit(5).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))


def review_blocks(selected: DataFrame) -> DataFrame:
    """(place, block): numbered Markdown blocks of selected interactions in review order."""
    return numbered(selected, I.review_order(), "place").select("place", R.review_block(F.col("place")).alias("block"))


def review_header(selected: DataFrame, files: int, scanned: int, stamp: str, only_unreviewed: bool) -> DataFrame:
    """(place, block): the head of a review batch. Counts are a row per category and tester, in the order of their names."""
    spark = selected.sparkSession
    total = selected.count()
    head = "\n".join([
        "# User-Testing Review Batch", "", f"- **Generated (UTC):** {stamp}", f"- **Session files scanned:** {files}",
        f"- **Interactions scanned:** {scanned}", f"- **Selected for review:** {total}",
        f"- **Only unreviewed:** {'yes' if only_unreviewed else 'no'}", "", "## Counts by feedback category", "",
    ])
    fixed = [(0, head), (2, "\n## Counts by tester\n")] + ([] if total else [(1, "- None"), (3, "- None")])
    titles = spark.createDataFrame(fixed, "part int, block string").select(_place(F.col("part")), "block")
    counts = I.category_counts(selected).select(
        _place(F.when(F.col("dimension") == "tester", 3).otherwise(1), text=F.col("value")),
        F.concat(F.lit("- `"), F.coalesce("value", F.lit("None")), F.lit("`: "), F.col("interactions").cast("string")).alias("block"),
    )
    return titles.unionByName(counts)


def _place(part: Column, number: Column | None = None, text: Column | None = None) -> Column:
    """Where a block of a batch stands: head, categories, title, testers, then the interactions by number."""
    return F.struct(
        part.cast("int").alias("part"), (F.lit(0) if number is None else number).cast("long").alias("number"),
        (F.lit("") if text is None else text).alias("text"),
    ).alias("place")


def write_blocks(blocks: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Markdown as text part files whose names follow the block order."""
    keys = by or []
    ordered = blocks.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place")
    writer = ordered.select(*keys, F.col("block").alias("value")).write.mode("errorifexists")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def aggregate(spark: SparkSession, root: str, suffix: str, only_unreviewed: bool = False) -> tuple[str, str]:
    """Write a review batch as JSON lines and Markdown; refuse to overwrite one.

    Every line of every session is checked before anything is written.
    """
    if not SUFFIX.fullmatch(suffix):
        raise ValueError("Timestamp suffix must use UTC format YYYYMMDDTHHMMSSZ.")
    lines = S.session_lines(spark, root)
    _stop_on(I.review_violations(lines), "Aggregation failed")
    _stop_on(I.repeated_interactions(lines), "Duplicate interaction_id")
    records = S.interactions(lines)
    selected = I.select_for_review(records, only_unreviewed)
    base = f"{root.rstrip('/')}/review_batches/review_batch_{suffix}"
    ordered = selected.sort(*I.review_order())
    I.review_records(ordered).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{base}_jsonl")
    files = S.session_file_count(spark, root)
    stamp = f"{suffix[:4]}-{suffix[4:6]}-{suffix[6:8]}T{suffix[9:11]}:{suffix[11:13]}:{suffix[13:15]}Z"
    head = review_header(selected, files, records.count(), stamp, only_unreviewed)
    body = review_blocks(selected).select(_place(F.lit(4), F.col("place")), "block")
    write_blocks(head.unionByName(body), f"{base}_md")
    return f"{base}_jsonl", f"{base}_md"


def session_blocks(records: DataFrame) -> DataFrame:
    """(tester_id, session_id, place, block): the report of every session, block by block.

    Place orders the head, the category table, then helpful, needs-review (by
    category) and unrated interactions. Blocks stay rows, so a session of any
    length is never one value or one task.
    """
    keys = ["tester_id", "session_id"]
    bucket = I.rating_bucket()
    group = F.when(bucket == "helpful", 2).when(bucket == "needs_review", 3).otherwise(4)
    category = F.when(bucket == "needs_review", I.category_key()).otherwise("")
    place = F.struct(
        group.alias("group"),
        F.when(bucket == "needs_review", I.category_place(I.category_key())).otherwise(F.lit(0).cast("long")).alias("order"),
        category.alias("category"), F.col("sequence").cast("long").alias("sequence"),
    )
    body = F.when(bucket == "needs_review", R.interaction_block(F.col("sequence"), True)).otherwise(
        R.interaction_block(F.col("sequence"), False))
    blocks = records.select(*keys, place.alias("place"), F.concat(F.lit("\n"), body, F.lit("\n\n---")).alias("block"))

    def titled(frame: DataFrame, order, sub) -> DataFrame:
        return frame.select(*keys, F.struct(
            F.col("group").alias("group"), order.alias("order"), sub.alias("category"),
            F.lit(0).cast("long").alias("sequence")).alias("place"), F.col("block"))

    titles = {2: "\n## Helpful", 3: "\n## Needs Review", 4: "\n## Unrated"}
    groups = records.select(*keys, group.alias("group")).distinct()
    text = F.create_map(*[x for k, v in titles.items() for x in (F.lit(k), F.lit(v))])
    sections = titled(groups.withColumn("block", text[F.col("group")]), F.lit(-1).cast("long"), F.lit(""))
    table = I.review_category_table(records)
    categories = titled(
        table.withColumn("group", F.lit(3)).withColumn("block", F.concat(F.lit("\n### "), "heading")),
        F.col("place"), F.col("category"))
    rows = titled(
        table.withColumn("group", F.lit(1)).withColumn(
            "block", R.table_row(F.col("heading"), F.col("interactions").cast("string"))),
        F.col("place"), F.col("category"))
    table_head = titled(
        table.select(*keys).distinct().withColumn("group", F.lit(1)).withColumn(
            "block", F.lit("\n### Needs-review categories\n\n| Category | Count |\n|---|---:")),
        F.lit(-1).cast("long"), F.lit(""))
    head = I.first_of_session(records, REPORT_COLUMNS).join(I.session_buckets(records), keys)
    heads = titled(head.withColumn("group", F.lit(0)).withColumn("block", R.session_header()),
                   F.lit(-1).cast("long"), F.lit(""))
    result = heads
    for part in (table_head, rows, sections, categories, blocks):
        result = result.unionByName(part)
    return result


def export(spark: SparkSession, root: str, output: str) -> None:
    """Reports of all exportable sessions; every session is checked first."""
    lines = S.exportable(S.session_lines(spark, root))
    _stop_on(S.exportable(S.empty_sessions(spark, root)), "Session without interactions")
    _stop_on(I.session_violations(lines), "Export failed")
    _stop_on(I.repeated_interactions(lines, per_file=True), "Duplicate interaction_id")
    _stop_on(I.session_consistency(lines).filter("problem IS NOT NULL"), "Export failed")
    write_blocks(session_blocks(S.interactions(lines)), output, ["tester_id", "session_id"])


def submittable(spark: SparkSession, root: str) -> DataFrame:
    """(path, tester_id, session_id, interactions, problem): what may be submitted.

    Committing and pushing are left to git.
    """
    lines = S.session_lines(spark, root)
    bad = top_rows(I.session_violations(lines, submission=True), ["path"], [F.col("line_number")], 1, "n")
    repeated = I.repeated_interactions(lines, per_file=True).select("path").distinct().withColumn(
        "repeated", F.lit("Duplicate interaction_id found in the session file"))
    files = I.session_consistency(lines, submission=True)
    return (
        files.join(bad.select("path", F.col("problem").alias("line_problem")), "path", "left")
        .join(repeated, "path", "left")
        .withColumn("problem", F.coalesce("line_problem", "repeated", "problem"))
        .drop("line_problem", "repeated")
    )


def with_feedback(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """The interactions with all feedback applied, once every row of it is found to be in order."""
    _stop_on(I.unmatched_feedback(interactions, feedback), "No single interaction for feedback")
    _stop_on(feedback.filter(I.feedback_problem().isNotNull()), "Feedback refused")
    return I.apply_feedback(interactions, I.feedback_state(feedback))


def merge_feedback(interactions: DataFrame, feedback: DataFrame, output: str) -> None:
    """Write a snapshot of the interactions with all feedback applied.

    The log itself stays as it is; a reader switches to the new snapshot whole.
    """
    with_feedback(interactions, feedback).write.mode("errorifexists").parquet(output)


def merge_version(table: VersionedTable, feedback: DataFrame, base: int) -> int:
    """The next version of the interactions: those of `base` with later feedback applied; refused where the base has moved on."""
    return table.write(with_feedback(table.read(base), feedback), base)
