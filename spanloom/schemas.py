"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = T.StructType([
    T.StructField("repository", T.StringType()),
    T.StructField("source_role", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("symbol_or_section_title", T.StringType()),
    T.StructField("start_line", T.LongType()),
    T.StructField("end_line", T.LongType()),
])
EVIDENCE = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("repository", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("source_role", T.StringType()),
    T.StructField("symbol_or_section_title", T.StringType()),
    T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()),
])
# `repository_commits` maps each indexed repository to the commit in use.
INTERACTION = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("interaction_id", T.StringType()), ("session_id", T.StringType()), ("tester_id", T.StringType()),
        ("timestamp", T.StringType()), ("query", T.StringType()), ("raw_answer", T.StringType()),
        ("rendered_answer", T.StringType()), ("sources", T.ArrayType(SOURCE)),
        ("retrieved_evidence_metadata", T.ArrayType(EVIDENCE)), ("model", T.StringType()),
        ("base_url", T.StringType()), ("top_k", T.IntegerType()), ("prompt_version", T.StringType()),
        ("retrieval_version", T.StringType()), ("chunking_version", T.StringType()),
        ("status", T.StringType()), ("rating", T.StringType()), ("feedback_category", T.StringType()),
        ("feedback_comment", T.StringType()), ("suggested_correction", T.StringType()),
        ("review_status", T.StringType()),
        ("repository_commits", T.MapType(T.StringType(), T.StringType())),
    )
])
FEEDBACK = T.StructType([
    T.StructField("interaction_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("correction", T.StringType()),
])
# Parent contexts and structural metadata have several shapes: kept as JSON text.
CHUNK = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("chunk_id", T.StringType()), ("repository", T.StringType()), ("source_role", T.StringType()),
        ("source_path", T.StringType()), ("chunk_type", T.StringType()), ("node_type", T.StringType()),
        ("symbol", T.StringType()), ("section_title", T.StringType()), ("start_line", T.LongType()),
        ("end_line", T.LongType()), ("byte_start", T.LongType()), ("byte_end", T.LongType()),
        ("parent_context", T.StringType()), ("content", T.StringType()),
        ("structural_metadata", T.StringType()),
    )
])
RAW_CHUNK = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("chunk_index", T.LongType()), ("chunk_id", T.StringType()), ("file_path", T.StringType()),
        ("language", T.StringType()), ("node_type", T.StringType()), ("content", T.StringType()),
        ("start_line", T.LongType()), ("end_line", T.LongType()), ("byte_start", T.LongType()),
        ("byte_end", T.LongType()), ("parent_context", T.StringType()),
        ("parent_route", T.ArrayType(T.StringType())), ("qualified_route", T.ArrayType(T.StringType())),
        ("parent_chunk_id", T.StringType()), ("symbol_id", T.StringType()), ("definition_id", T.StringType()),
        ("metadata", T.StructType([T.StructField("signature", T.StructType([
            T.StructField("name", T.StringType())
        ]))])),
    )
])
RAW_PAYLOAD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("chunks", T.ArrayType(RAW_CHUNK)),
])
