"""Retrieval and grounded answering over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import DEFAULT_ENDPOINT_LABEL, PackingConfig, RankingConfig
from spanloom.operators.evidence import evidence_text, pack_evidence, prompts, with_content
from spanloom.operators.index import LexicalIndex, build_index
from spanloom.operators.ranking import result_rows, results_are_few, search
from spanloom.functions import jsontext as J
from spanloom.session import new_table_path, written

SYSTEM_PROMPT = (
    "You answer questions about source repositories. Use only the evidence given with the question and "
    "say so when it is not enough. Keep repositories apart, cite the paths you rely on, and do not guess "
    "names, fields, lines or intent that the evidence does not show."
)
NO_EVIDENCE = "No retrieval evidence was found for the query."
NO_CLIENT = "No answer client is configured."
EMPTY_ANSWER = "LLM returned an empty response."
FAILED = "The answer client failed."


class Retriever:
    """Ranked search over an indexed corpus."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, config: RankingConfig = RankingConfig(),
                 index: LexicalIndex | None = None):
        self.spark, self.chunks, self.config = spark, chunks, config
        self.index = index or build_index(chunks, new_table_path(spark, "index"), config)

    def batch(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """Results of every (query_id, query) row."""
        return search(self.index, queries, self.config, top_k)

    def search(self, query: str, top_k: int = 5, debug: bool = False) -> DataFrame:
        """Results of one query in rank order."""
        one = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return result_rows(self.batch(one, top_k), debug).drop("query_id").sort("rank")

    def prompts(self, queries: DataFrame, top_k: int = 5, packing: PackingConfig = PackingConfig()) -> DataFrame:
        """Prompts with packed evidence, sources and fingerprints."""
        found = with_content(self.batch(queries, top_k), self.chunks, results_are_few(queries, top_k))
        packed = pack_evidence(found, packing)
        return prompts(queries, evidence_text(packed))

    def answer(self, queries: DataFrame, top_k: int = 5, client: Callable[[str, str], str] | None = None,
               model: str | None = None, base_url: str | None = None) -> DataFrame:
        """Answer rows: query, answer, model, base_url, sources, success, error.

        `client(system_prompt, prompt)` runs inside tasks. Without evidence it is
        not called; without a client the prompt itself is the product.
        """
        asked = self.prompts(queries, top_k)
        labels = [F.lit(model).cast("string").alias("model"),
                  F.lit(base_url or DEFAULT_ENDPOINT_LABEL).alias("base_url")]
        base = asked.select("query_id", "query", "prompt", "sources", "has_evidence", *labels)
        if client is None:
            error = F.when(~F.col("has_evidence"), NO_EVIDENCE).otherwise(NO_CLIENT)
            return base.withColumn("answer", F.lit(None).cast("string")).withColumn(
                "success", F.lit(False)).withColumn("error", error).drop("prompt", "has_evidence")

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [_asked(client, prompt) if known else (None, NO_EVIDENCE) for prompt, known in zip(batch.prompt, batch.has_evidence)]
                yield pd.DataFrame({
                    "place": batch.place, "answer": [a for a, _ in found], "success": [a is not None for a, _ in found],
                    "error": [e for _, e in found],
                })

        # Prompts and answers are written: a retry of later work neither searches nor calls again.
        numbered = written(base.withColumn("place", F.monotonically_increasing_id()), "prompts")
        answers = written(numbered.select("place", "prompt", "has_evidence").mapInPandas(
            call, "place long, answer string, success boolean, error string"
        ), "answers")
        shown = answers.withColumn("error", F.coalesce(J.safe_message(J.redact_body(F.col("error"))), F.when(~F.col("success"), FAILED)))
        return numbered.drop("prompt", "has_evidence").join(shown, "place").drop("place")


def _asked(client: Callable[[str, str], str], prompt: str) -> tuple[str | None, str | None]:
    """The client's answer, or why there is none: a failed call is a result, not a failed job."""
    try:
        answer = (client(SYSTEM_PROMPT, prompt) or "").strip()
    except Exception as problem:
        return None, str(problem) or FAILED
    return (answer, None) if answer else (None, EMPTY_ANSWER)
