"""Budget packing against a sequential model."""

import random

from pyspark.sql import functions as F

from spanloom.config import TRUNCATION_MARKER, PackingConfig
from spanloom.operators.evidence import evidence_metadata, evidence_text, pack_evidence, prompts


def sequential(rows, config):
    left, kept = config.total_chars, []
    for r in sorted(rows, key=lambda r: r["rank"]):
        header = (f"[Evidence {r['rank']}]\nRepository: {r['repository']}\nRole: {r['source_role']}\nPath: {r['source_path']}\n"
                  f"Symbol/Section: {r['label'] or '(unnamed chunk)'}\nLines: {r['start_line']}-{r['end_line']}\nContent:\n")
        if len(header) >= left:
            break
        limit = min(config.block_chars, left - len(header))
        block = header + r["content"][:limit] + (TRUNCATION_MARKER if len(r["content"]) > limit else "")
        kept.append((r["rank"], block))
        left -= len(block) + 2
        if left <= 0:
            break
    return kept


def test_packing_equals_the_sequential_rule(spark):
    rng, rows = random.Random(9), []
    for query in range(150):
        for rank in range(1, rng.randint(2, 12)):
            rows.append({"query_id": query, "rank": rank, "repository": "é" * rng.randint(0, 9), "source_role": "r",
                         "source_path": "p" * rng.choice([1, 5, 400]), "label": rng.choice([None, "sym"]), "start_line": 1,
                         "end_line": rank, "content": "ü" * rng.choice([0, 3, 90, 199, 200, 201, 900])})
    config = PackingConfig(total_chars=1000, block_chars=200)
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "query_id long, rank int, repository string, source_role string, source_path string, label string, start_line long, "
        "end_line long, content string")
    got: dict = {}
    for r in pack_evidence(df, config).sort("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["block"]))
    for query in range(150):
        assert got.get(query, []) == sequential([r for r in rows if r["query_id"] == query], config)


def test_prompts_cover_queries_without_evidence(spark):
    df = spark.createDataFrame([(0, 1, "R", "r", "p", None, 1, 2, "text")],
                               "query_id long, rank int, repository string, source_role string, source_path string, label string, "
                               "start_line long, end_line long, content string")
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, query string")
    rows = {r["query_id"]: r for r in prompts(queries, evidence_text(pack_evidence(df))).collect()}
    assert rows[0]["prompt"].startswith("Question:\na\n\nRepository evidence:\n[Evidence 1]")
    assert rows[1]["prompt"].endswith("Repository evidence:\n") and rows[1]["first_source"] == "(none)"
    ranked = evidence_text(pack_evidence(df)).select(evidence_metadata(F.col("sources")).alias("m")).first()["m"]
    assert ranked[0]["rank"] == 1 and ranked[0]["line_end"] == 2
