"""Append-only ingest, idempotent identity and feedback state on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.interactions import feedback_state
from spanloom.session import new_table_path


def read_table_stream(spark: SparkSession, folder: str, file_name: str) -> DataFrame:
    """A table's files as a stream; the schema is the stored one."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", file_name)
        .option("maxFilesPerTrigger", 64).parquet(folder)
    )


def run_available(stream: DataFrame, spark: SparkSession, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available into a table and read it back.

    Table and checkpoint lie in the shared folder, so a lost executor or a
    restarted driver resumes without loss or repetition.
    """
    path = new_table_path(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.option("checkpointLocation", f"{path}-state").option("path", path).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark on a column that may be stored without a time zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def first_arrivals(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by it."""
    return with_event_time(stream, event_time, delay).dropDuplicatesWithinWatermark([key])


def fold_feedback(stream: DataFrame, spark: SparkSession, name: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feedback rows appended as they arrive, and the state folded from all of them.

    The log is the record: each batch appends its valid rows once, under its
    batch number, so that a repeated batch replaces itself.
    """
    path = new_table_path(spark, name)

    def append(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return feedback_state(spark.read.parquet(path).drop("batch"))


SESSION_TYPE = "log long, place long, tester_id string, session_id string"


def assign_sessions(stream: DataFrame, name_of: Callable[[int], str]) -> DataFrame:
    """`next_session` on a stream of (log, place, tester_id, session_id): the last tester and session of a log are its state.

    Arrivals of a log are taken in the order of `place` inside a micro-batch,
    and batches as they come. `name_of` names the session that a place starts.
    Only one batch's share of a log is in memory at a time.
    """

    def assign(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("place", kind="stable")
        known, tester, session = state.get if state.exists else (False, None, None)
        given = []
        for place, who, own in zip(rows["place"], rows["tester_id"], rows["session_id"]):
            who, own = (None if pd.isna(x) else x for x in (who, own))
            if own is not None or not known or who is None or who != tester:
                session = own if own is not None else name_of(int(place))
            known, tester = True, who
            given.append(session)
        state.update((known, tester, session))
        rows["session_id"] = given
        yield rows[["log", "place", "tester_id", "session_id"]]

    return stream.groupBy("log").applyInPandasWithState(
        assign, SESSION_TYPE, "known boolean, tester string, session string", "append", GroupStateTimeout.NoTimeout
    )
