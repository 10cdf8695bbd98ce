"""Streams over events: append-only ingest, first arrivals and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.streaming.ingest import assign_sessions, first_arrivals, fold_feedback, read_table_stream, run_available
from spanloom.workloads import interactions as W


def stream_append_counts(spark, sf_dir):
    """Events appended to a log as they arrive; the log counted per kind."""
    log = run_available(read_table_stream(spark, sf_dir, "events.parquet"), spark, "log")
    return log.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))


def stream_first_arrivals(spark, sf_dir):
    """Every event read twice; repeated ids are dropped within the watermark."""
    once = read_table_stream(spark, sf_dir, "events.parquet")
    twice = once.unionByName(read_table_stream(spark, sf_dir, "events.parquet"))
    kept = run_available(first_arrivals(twice, "event_id", "ts", "40 days"), spark, "unique")
    return kept.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("id_sum"))


def stream_feedback(spark, sf_dir):
    """Feedback folded from a stream equals the batch fold."""

    def prepare(batch):
        return W.as_feedback(batch)

    return fold_feedback(read_table_stream(spark, sf_dir, "events.parquet"), spark, "feedback", prepare)


def stream_session_window(spark, sf_dir):
    """Sessions of sixteen logs given as the events arrive, one of fifty with a session of its own."""
    rows = W.log_records(read_table_stream(spark, sf_dir, "events.parquet"))
    return run_available(assign_sessions(rows, lambda place: f"s{place}"), spark, "sessions")


WORKLOADS = {
    "stream_append_counts": (stream_append_counts, """SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events GROUP BY 1"""),
    "stream_dedupe": (stream_first_arrivals, "SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1"),
    "stream_session_window": (stream_session_window, W.WORKLOADS["session_assignment"][1]),
    "stream_feedback": (stream_feedback, W.WORKLOADS["feedback_latest_wins"][1]),
}
