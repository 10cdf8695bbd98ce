"""Session logs: one JSON-lines file per session under a tester directory."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.config import DEFAULT_TESTER, EXPORT_DIRECTORY, REVIEW_DIRECTORY
from spanloom.functions.text import is_blank
from spanloom.operators.interactions import numbered_in_session
from spanloom.operators.scale import numbered, running
from spanloom.schemas import INTERACTION
from spanloom.session import written

# What users read about paths that are no sessions.
OUTSIDE = "Session path must be inside the log root."
NOT_DIRECT = "Session file must be directly inside a tester directory."
BAD_NAME = "Session filename must match session_*.jsonl."

# Whole session files, and the part files of appended ones.
FILES = "{session_*.jsonl,part-*}"
APPENDED = r"^tester=([^/]*)/session=([^/]*)/(?:append=(\d+)/)?part-[^/]*$"
COMMIT_SUFFIX = "_commit"
# Places of a log that are looked at together.
PLACES = 10_000
# Tasks of an append for each core, as sessions differ in length.
TASKS_PER_CORE = 4


def _relative(root: str, file: Column | None = None) -> Column:
    """The file's path under the root as `tester/session_x.jsonl`, decoded; part files of an appended session share one."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    # A plus sign is itself in a path.
    file = F.col("_metadata.file_path") if file is None else file
    full = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    inside = F.element_at(F.split(full, f"/{re.escape(name)}/"), -1)
    appended = F.regexp_extract(inside, APPENDED, 0) != ""
    # Spark escapes what a folder name may not hold, so these names are decoded once more.
    decoded = F.url_decode(F.replace(F.regexp_replace(inside, APPENDED, "$1/$2.jsonl"), F.lit("+"), F.lit("%2B")))
    return F.when(appended, decoded).otherwise(inside)


def _append_number(root: str) -> Column:
    """Which append wrote a part file; 0 for other files."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    inside = F.element_at(F.split(F.col("_metadata.file_path"), f"/{re.escape(name)}/"), -1)
    return F.coalesce(F.nullif(F.regexp_extract(inside, APPENDED, 3), F.lit("")).cast("long"), F.lit(0))


def _scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", FILES).option("lineSep", "\n").text(root)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every session in the scan's own file listing, those of empty files too, which no scan has a row for."""
    listed = spark.createDataFrame([(f,) for f in _scan(spark, root).inputFiles()], "file string")
    return listed.select(_relative(root, F.col("file")).alias("path")).distinct().filter(_is_session())


def _is_session() -> Column:
    """Review batches are no sessions, nor are part files other than those of appended ones."""
    return ~F.col("path").startswith(REVIEW_DIRECTORY + "/") & F.col("path").endswith(".jsonl")


def session_file_count(spark: SparkSession, root: str) -> int:
    """Sessions in the listing; one without a line counts too."""
    return _files(spark, root).count()


def empty_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Paths of sessions that hold no interaction: nothing but blank lines, or nothing at all."""
    filled = session_lines(spark, root).filter(~is_blank(F.col("value"))).select("path").distinct()
    return _files(spark, root).join(filled, "path", "left_anti")


def session_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_number, value) of every session file, review batches left out.

    A line's number is its place in its split plus the lines of the splits
    before it: those of the same file, and of the files that earlier appends
    left in its session. The lines are written once, as their numbers rely on one scan.
    """
    rows = written(
        _scan(spark, root).select(
            _relative(root).alias("path"), _append_number(root).alias("append"), F.col("_metadata.file_modification_time").alias("time"),
            F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"), "value",
        ).filter(_is_session()), "session-lines"
    )
    split = ["path", "append", "time", "file", "block"]
    earlier = Window.partitionBy("path").orderBy("append", "time", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(*split).agg(F.min("place").alias("first"), F.count("*").alias("lines")).select(
        *split, "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before")
    )
    return rows.join(splits, split).select(
        "path", (F.col("place") - F.col("first") + F.col("before") + 1).alias("line_number"), "value"
    )


def path_problem(path: Column) -> Column:
    """Why a path under the log root is no session file, or null."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return (
        F.when(path.startswith("/") | F.array_contains(parts, "..") | F.array_contains(parts, ""),
               OUTSIDE)
        .when((F.size(parts) != 2) | parts[0].isin(REVIEW_DIRECTORY, EXPORT_DIRECTORY),
              NOT_DIRECT)
        .when(~(name.startswith("session_") & name.endswith(".jsonl")), BAD_NAME)
    )


def exportable(lines: DataFrame) -> DataFrame:
    """Sessions directly inside a tester directory that may be exported."""
    parts = F.split("path", "/")
    tester = parts[0]
    return lines.filter(
        (F.size(parts) == 2) & ~tester.isin(REVIEW_DIRECTORY, EXPORT_DIRECTORY, DEFAULT_TESTER)
        & ~tester.startswith(".")
    )


def sessions_of(lines: DataFrame, tester: str) -> DataFrame:
    """(path, place): the session files of one tester, placed by the parts of their paths, not by their texts."""
    found = exportable(lines).filter(F.split("path", "/")[0] == tester).select("path").distinct()
    return numbered(found.withColumn("_parts", F.split("path", "/")), ["_parts"], "place").select("path", "place")


def excluded_testers(lines: DataFrame) -> DataFrame:
    return lines.filter(F.split("path", "/")[0] == DEFAULT_TESTER).select(F.lit(DEFAULT_TESTER).alias("tester_id")).distinct()


def interactions(lines: DataFrame) -> DataFrame:
    """Typed interaction records of validated lines, numbered per file as `sequence`.

    Commits written as fields of their own (`alpha_commit`) join the map of
    commits under the repository's name; the map's own entries come first.
    """
    filled = lines.filter(~is_blank(F.col("value")))
    fields = F.from_json("value", "map<string,string>")
    single = F.map_from_entries(F.transform(
        F.filter(F.map_entries(fields), lambda e: e["key"].endswith(COMMIT_SUFFIX) & e["value"].isNotNull()),
        lambda e: F.struct(F.regexp_replace(e["key"], f"{COMMIT_SUFFIX}$", "").alias("key"), e["value"].alias("value")),
    ))
    own = F.col("r.repository_commits")
    commits = F.when(own.isNull(), single).otherwise(F.map_concat(
        F.map_filter(single, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own
    ))
    others = [f"r.{f.name}" for f in INTERACTION if f.name != "repository_commits"]
    return (
        numbered_in_session(filled, "path", "line_number").withColumn("r", F.from_json("value", INTERACTION))
        .select(*others, F.when(F.size(commits) > 0, commits).alias("repository_commits"),
                F.col("path").alias("source_session_file"), "sequence")
    )


def append_interactions(records: DataFrame, root: str) -> None:
    """Append records as JSON lines to their sessions, where `session_lines` finds them.

    Folders carry tester and session, and each record keeps both. A session's
    lines go into one part file per append, in the order of their sequence if
    they have one, else of their ids. The append's number, in nanoseconds of the
    driver's clock, is a folder below: stores keep times of files in seconds.
    Sessions cost a file each, however small, so the number of tasks is given:
    adaptive execution goes by bytes and would let one or two write them all.
    """
    order = "sequence" if "sequence" in records.columns else "interaction_id"
    placed = records.withColumns({
        "tester": F.col("tester_id"), "session": F.col("session_id"), "append": F.lit(time.time_ns()).cast("long"),
    })
    tasks = TASKS_PER_CORE * records.sparkSession.sparkContext.defaultParallelism
    (
        placed.repartition(tasks, "tester", "session").sortWithinPartitions("tester", "session", order)
        .drop("sequence", "source_session_file")
        .write.mode("append").partitionBy("tester", "session", "append").option("ignoreNullFields", "false").json(root)
    )


def next_session(records: DataFrame, session_id: Column, width: int = PLACES) -> DataFrame:
    """Records (log, place, tester_id) that lack a session id get one.

    In the order of `place`, a whole number, a record of the same tester as the
    one before goes on with its session; a change of tester starts a new one,
    named by `session_id` of the record that starts it. Given session ids stay.
    The last tester and the running session are carried from one range of places
    to the next, so a log may be of any length.
    """
    asked = records.withColumn("_who", F.struct("tester_id"))
    before = running(asked, ["log"], "place", width, last_of={"_before": "_who"})
    same = F.coalesce(F.col("_before.tester_id") == F.col("tester_id"), F.lit(False)) & F.col("session_id").isNull()
    named = before.withColumn("_start", F.when(~same, F.coalesce("session_id", session_id)))
    whole = running(named, ["log"], "place", width, last_of={"_session": "_start"}, inclusive=True)
    return whole.withColumn("session_id", F.col("_session")).select(*records.columns)
