"""Index statistics, ranked search, evidence and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import TRUNCATION_MARKER, RankingConfig
from spanloom.functions import render as R
from spanloom.functions import text as T
from spanloom.operators.evidence import evidence_text, pack_evidence, prompts, with_content
from spanloom.operators.index import LexicalIndex, build_index, idf
from spanloom.operators.ranking import (
    UNITS, best_evidence, lexical_search, result_report, result_rows, results_are_few, scored, search,
)
from spanloom.plans.retrieval import Retriever
from spanloom.session import new_table_path
from spanloom.sources.tables import benchmark_queries, document_chunks

# Hints over the vocabulary of the benchmark texts, one for each rule.
CONFIG = RankingConfig(
    role_hints={"the": ("en",), "der": ("de",), "les": ("fr", "es")},
    repository_hints={"that": "src3", "und": "src1"},
    generic_path_terms=RankingConfig().generic_path_terms + ("than",),
    schema_intent_terms=("und", "los"), schema_role="de", demoted_role="es",
)
ONE_QUERY = "the nation of threading, und der que"
TOP_K = 5

_built: dict[tuple[str, str], LexicalIndex] = {}


def index_of(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index over `documents`, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build_index(document_chunks(spark, sf_dir), new_table_path(spark, "index"), CONFIG)
    return _built[key]


def one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(ONE_QUERY).alias("query"))


def postings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    ids = index.table(spark, "chunks").select("chunk_no", "chunk_id")
    # The ids of a shard's chunks are few beside its postings, which stay as they are: no sort.
    return index.table(spark, "postings").filter("tf > 0").join(ids.hint("shuffle_hash"), "chunk_no")


def token_counts(spark, sf_dir):
    found = index_of(spark, sf_dir).table(spark, "postings").filter("tf > 0")
    return found.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("chunks"))


def query_tokens(spark, sf_dir):
    tokens = F.posexplode(T.tokenize(F.col("query"))).alias("position", "term")
    return benchmark_queries(spark, sf_dir).select("query_id", tokens)


def doc_term_freq(spark, sf_dir):
    return postings_table(spark, sf_dir).select("chunk_id", "term", F.col("tf").cast("long").alias("tf"))


def doc_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).table(spark, "chunks").select(
        "chunk_id", F.size("tokens").cast("long").alias("length"))


def corpus_statistics(spark, sf_dir):
    return index_of(spark, sf_dir).table(spark, "statistics").select(
        "chunks", F.round("avg_length", 6).alias("avg_length"))


def term_idf(spark, sf_dir):
    index = index_of(spark, sf_dir)
    total = index.table(spark, "statistics").first()["chunks"]
    return index.table(spark, "terms").select(
        "term", "df", F.round(idf(F.lit(total), F.col("df")), 6).alias("idf"))


def _lexical(index: LexicalIndex, queries: DataFrame, top_k: int) -> DataFrame:
    """Chunks ranked by their BM25 score alone."""
    return lexical_search(index, queries, CONFIG, top_k).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round(F.col("units") / UNITS, 6).alias("score"))


def bm25_topk(spark, sf_dir):
    return _lexical(index_of(spark, sf_dir), one_query(spark), 10)


def bm25_batch_topk(spark, sf_dir):
    return _lexical(index_of(spark, sf_dir), benchmark_queries(spark, sf_dir), TOP_K)


def _boost(name: str):
    def run(spark, sf_dir):
        rows = scored(index_of(spark, sf_dir), benchmark_queries(spark, sf_dir), CONFIG)
        kept = rows.filter(F.col(name) != 0)
        return kept.select("query_id", "chunk_id", F.round(name, 6).alias(name))

    return run


def ranked_search_debug(spark, sf_dir):
    found = result_rows(search(index_of(spark, sf_dir), benchmark_queries(spark, sf_dir), CONFIG, TOP_K), debug=True)
    return found.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "score", "repository", "source_role", "source_path",
        "symbol_or_section_title", F.col("score_components.lexical").alias("lexical"),
        *[F.round(F.col(f"score_components.{b}"), 6).alias(b)
          for b in ("symbol_boost", "path_boost", "role_boost", "repository_boost")])


def evidence_dedupe(spark, sf_dir):
    rows = scored(index_of(spark, sf_dir), benchmark_queries(spark, sf_dir), CONFIG)
    return best_evidence(rows).groupBy("query_id").agg(
        F.count("*").alias("evidence_keys"), F.round(F.sum("score"), 3).alias("score_sum"))


def sparse_search(spark, sf_dir):
    """Queries of one hint each, so that most results come from the role alone."""
    words = spark.range(3).select(
        F.col("id").alias("query_id"),
        F.element_at(F.array(F.lit("xyzzy les"), F.lit("und qqqq"), F.lit("zzzz that")), (F.col("id") + 1).cast("int"))
        .alias("query"))
    found = search(index_of(spark, sf_dir), words, CONFIG, 25)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id",
                        F.round("score", 6).alias("score"))


def _packed(spark, sf_dir, top_k=TOP_K):
    queries = benchmark_queries(spark, sf_dir)
    results = search(index_of(spark, sf_dir), queries, CONFIG, top_k)
    return pack_evidence(with_content(results, document_chunks(spark, sf_dir), results_are_few(queries, top_k)))


def evidence_packing(spark, sf_dir):
    return _packed(spark, sf_dir, 10).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id",
        F.length("block").cast("long").alias("block_chars"), F.sha2("block", 256).alias("block_sha256"))


def _prompts(spark, sf_dir):
    return prompts(benchmark_queries(spark, sf_dir), evidence_text(_packed(spark, sf_dir)))


def prompt_fingerprint(spark, sf_dir):
    return _prompts(spark, sf_dir).select(
        "query_id", "query_sha256", F.col("query_len").cast("long").alias("query_len"), "prompt_sha256",
        F.col("prompt_len").cast("long").alias("prompt_len"), "first_source")


def numbered_sources(spark, sf_dir):
    return _prompts(spark, sf_dir).select("query_id", R.numbered_sources(F.col("sources")).alias("listing"))


def evidence_preview(spark, sf_dir):
    queries = benchmark_queries(spark, sf_dir)
    results = search(index_of(spark, sf_dir), queries, CONFIG, TOP_K)
    return with_content(results, document_chunks(spark, sf_dir), results_are_few(queries, TOP_K)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), R.evidence_preview().alias("preview"))


def search_report(spark, sf_dir):
    """Per query, its ranked results as one value."""
    report = result_report(search(index_of(spark, sf_dir), benchmark_queries(spark, sf_dir), CONFIG, TOP_K))
    return report.select("query_id", F.array_join(F.transform(
        "top_k_results", lambda r: F.concat_ws("|", r["rank"].cast("string"), r["source_path"], r["end_line"].cast("string"))), ";").alias("results"))


def answer_records(spark, sf_dir):
    retriever = Retriever(spark, document_chunks(spark, sf_dir), CONFIG, index_of(spark, sf_dir))
    return retriever.answer(benchmark_queries(spark, sf_dir), TOP_K, model="none").select(
        "query_id", "answer", "model", "base_url", "success", "error", F.size("sources").cast("long").alias("sources"))


# --------------------------------------------------------------------------
# DuckDB equivalents
# --------------------------------------------------------------------------
def tokens_sql(text: str) -> str:
    return (
        "flatten([list_concat(list_concat(list_concat([lower(w)], "
        "CASE WHEN lower(w) IN ('configuration','configured') THEN ['config'] ELSE [] END), "
        "CASE WHEN length(w) > 4 AND lower(w) LIKE '%s' AND lower(w) NOT LIKE '%ss' "
        "THEN [left(lower(w), length(w) - 1)] ELSE [] END), "
        "[lower(p) for p in regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), "
        "'[A-Z]?[a-z]+|[A-Z]+|[0-9]+') if lower(p) <> lower(w)]) "
        f"for w in regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_]*|\\p{{Nd}}+')])"
    )


CHUNKS_SQL = """
chunks AS (
  SELECT *, CASE WHEN has_symbol THEN head END AS symbol, CASE WHEN NOT has_symbol THEN head END AS section_title,
         nullif(head, '') AS label, regexp_replace(lower(head), '[^a-z0-9]', '', 'g') AS canonical
  FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_id, source AS repository, lang AS source_role,
               'corpus/' || source || '/' || lang || '/' || regexp_extract(text, '^([A-Za-z]*)', 1) || '.txt' AS source_path,
               doc_id % 3 <> 0 AS has_symbol, regexp_extract(text, '^([^.\\n]*)', 1) AS head,
               text AS content, 1 AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line,
               '{"parent": "' || lang || '", "route": null}' AS parent_context
        FROM documents)
)"""
INDEX_SQL = CHUNKS_SQL + f""",
bags AS (
  SELECT chunk_id, {tokens_sql("content || chr(10) || coalesce(symbol, 'None') || chr(10) || source_path || chr(10) || source_role || chr(10) || repository || chr(10) || coalesce(section_title, '') || chr(10) || parent_context")} AS tokens
  FROM chunks
),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM bags) GROUP BY ALL),
lengths AS (SELECT chunk_id, len(tokens) AS length FROM bags),
stats AS (SELECT count(*) AS n, avg(length) AS avg_length FROM lengths),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def queries_sql(source: str) -> str:
    return INDEX_SQL + f""",
queries AS ({source}),
qtok AS (SELECT query_id, query, {tokens_sql("query")} AS all_terms,
                [regexp_replace(lower(w), '[^a-z0-9]', '', 'g')
                 for w in regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_]*|\\p{{Nd}}+')
                 if regexp_matches(w, '_|[a-z][A-Z]')] AS explicit
         FROM queries),
qterms AS (SELECT query_id, unnest(list_distinct(all_terms)) AS term FROM qtok),
lexical AS (
  SELECT query_id, chunk_id, CAST(sum(CAST(floor(
           ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))
           * 1e12 + 0.5) AS BIGINT)) AS BIGINT) AS units
  FROM qterms JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_id), stats
  GROUP BY ALL
)"""


BENCHMARK_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"
_generic_symbols = ", ".join(f"'{t}'" for t in CONFIG.generic_symbol_terms)
_generic_paths = ", ".join(f"'{t}'" for t in CONFIG.generic_path_terms)


def scored_sql(source: str) -> str:
    return queries_sql(source) + f""",
features AS (
  SELECT query_id, list_distinct(all_terms) AS terms, explicit,
         [t for t in list_distinct(all_terms) if length(t) >= 4] AS path_intent,
         [t for t in list_distinct(all_terms) if length(t) >= 4 AND t NOT IN ({_generic_paths})] AS path_names,
         list_has_any(all_terms, ['und', 'los']) AS schema_intent,
         list_concat(list_concat(CASE WHEN list_contains(all_terms, 'the') THEN ['en'] ELSE [] END,
                     CASE WHEN list_contains(all_terms, 'der') THEN ['de'] ELSE [] END),
                     CASE WHEN list_contains(all_terms, 'les') THEN ['fr', 'es'] ELSE [] END) AS roles,
         [CASE WHEN t = 'that' THEN 'src3' ELSE 'src1' END for t in all_terms if t IN ('that', 'und')][1] AS target
  FROM qtok
),
named AS (
  SELECT chunk_id, repository, source_role, source_path, label, canonical, content, start_line, end_line,
         list_distinct([t for t in {tokens_sql("head")} if length(t) >= 3 AND t <> canonical]) AS words,
         list_distinct({tokens_sql("source_path")}) AS path_terms
  FROM chunks
),
parts AS (
  SELECT query_id, c.*, coalesce(units, 0) / 1e12 AS lexical,
         CASE WHEN length(canonical) >= 4 AND canonical NOT IN ({_generic_symbols}) AND list_contains(terms, canonical)
              THEN CASE WHEN list_contains(explicit, canonical) THEN 24.0::DOUBLE ELSE 12.0::DOUBLE END
              WHEN len(words) >= 2 AND list_has_all(terms, words) THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS symbol_boost,
         least(8.25::DOUBLE, 2.75::DOUBLE * len(list_intersect(path_terms, path_intent)))
         + least(6.0::DOUBLE, 6.0::DOUBLE * len(list_intersect(path_terms, path_names))) AS path_boost,
         CASE WHEN schema_intent AND source_role = 'de' THEN 14.0::DOUBLE WHEN schema_intent AND source_role = 'es' THEN -1.0::DOUBLE
              WHEN list_contains(roles, source_role) THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS role_boost,
         CASE WHEN target = repository THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS repository_boost
  FROM features CROSS JOIN named c LEFT JOIN lexical USING (query_id, chunk_id)
),
scored AS (SELECT *, lexical + symbol_boost + path_boost + role_boost + repository_boost AS score FROM parts),
best AS (
  SELECT * FROM scored WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY query_id, repository, source_path, label ORDER BY score DESC, chunk_id) = 1
)"""


def ranked_sql(source: str, top_k: int) -> str:
    return scored_sql(source) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best
           QUALIFY rank <= {top_k})"""


def packed_sql(top_k: int) -> str:
    marker = TRUNCATION_MARKER.replace("\n", "' || chr(10) || '")
    return ranked_sql(BENCHMARK_SQL, top_k) + f""",
headed AS (
  SELECT *, '[Evidence ' || rank || ']' || chr(10) || 'Repository: ' || repository || chr(10) || 'Role: ' || source_role
            || chr(10) || 'Path: ' || source_path || chr(10) || 'Symbol/Section: ' || coalesce(label, '(unnamed chunk)')
            || chr(10) || 'Lines: ' || start_line || '-' || end_line || chr(10) || 'Content:' || chr(10) AS header
  FROM ranked
),
costed AS (
  SELECT *, length(header) + least(length(content), 4000) + CASE WHEN length(content) > 4000 THEN {len(TRUNCATION_MARKER)} ELSE 0 END + 2 AS cost
  FROM headed
),
placed AS (
  SELECT *, 18000 - coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM costed
),
kept AS (
  SELECT *, CAST(least(4000, room - length(header)) AS BIGINT) AS cut FROM placed
  QUALIFY min(CASE WHEN length(header) < room THEN 1 ELSE 0 END)
          OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) = 1
),
packed AS (
  SELECT *, header || left(content, cut) || CASE WHEN length(content) > cut THEN '{marker}' ELSE '' END AS block FROM kept
)"""


def prompts_sql() -> str:
    return packed_sql(TOP_K) + """,
evidence AS (
  SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS evidence, arg_min(source_path, rank) AS first_source,
         count(*) AS sources,
         string_agg(rank || '. **' || repository || '** | `' || source_role || '`' || chr(10) || '   `' || source_path || '`'
                    || chr(10) || '   lines ' || start_line || '-' || end_line || ' | ' || coalesce(label, '(unnamed chunk)'),
                    chr(10) ORDER BY rank) AS listing
  FROM packed GROUP BY query_id
),
prompts AS (
  SELECT query_id, query, 'Question:' || chr(10) || query || chr(10) || chr(10) || 'Repository evidence:' || chr(10)
         || coalesce(evidence, '') AS prompt, first_source, sources, listing
  FROM queries LEFT JOIN evidence USING (query_id)
)"""


def preview_sql(text: str, limit: int) -> str:
    flat = f"regexp_replace(regexp_replace({text}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE left({flat}, {limit - 1}) || '…' END"


def _boost_sql(name: str) -> str:
    return f"WITH {scored_sql(BENCHMARK_SQL)} SELECT query_id, chunk_id, round({name}, 6) AS {name} FROM scored WHERE score > 0 AND {name} <> 0"


_ONE_SQL = f"SELECT CAST(0 AS BIGINT) AS query_id, '{ONE_QUERY}' AS query"
_LEX_SQL = """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, chunk_id) AS rank, chunk_id,
  round(units / 1e12, 6) AS score FROM lexical WHERE units > 0 QUALIFY rank <= {k}"""
_SPARSE_SQL = "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'xyzzy les'), (1, 'und qqqq'), (2, 'zzzz that')) t(query_id, query)"

WORKLOADS = {
    "tokenize_terms": (token_counts, f"WITH {INDEX_SQL} SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS chunks FROM postings GROUP BY term"),
    "query_tokens": (query_tokens, f"""WITH t AS (SELECT item_id AS query_id, {tokens_sql("text")} AS tokens FROM benchmark)
        SELECT query_id, CAST(i - 1 AS INTEGER) AS position, tokens[i] AS term FROM (SELECT query_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM t)"""),
    "doc_term_freq": (doc_term_freq, f"WITH {INDEX_SQL} SELECT chunk_id, term, tf FROM postings"),
    "doc_length_stats": (doc_lengths, f"WITH {INDEX_SQL} SELECT chunk_id, length FROM lengths"),
    "corpus_statistics": (corpus_statistics, f"WITH {INDEX_SQL} SELECT n AS chunks, round(avg_length, 6) AS avg_length FROM stats"),
    "term_idf": (term_idf, f"WITH {INDEX_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms, stats"),
    "bm25_topk": (bm25_topk, f"WITH {queries_sql(_ONE_SQL)} " + _LEX_SQL.format(k=10)),
    "bm25_batch_topk": (bm25_batch_topk, f"WITH {queries_sql(BENCHMARK_SQL)} " + _LEX_SQL.format(k=TOP_K)),
    **{name: (_boost(name), _boost_sql(name)) for name in ("symbol_boost", "path_boost", "role_boost", "repository_boost")},
    "ranked_search_debug": (ranked_search_debug, f"""WITH {ranked_sql(BENCHMARK_SQL, TOP_K)}
        SELECT query_id, rank, round(score, 6) AS score, repository, source_role, source_path, label AS symbol_or_section_title,
               round(lexical, 6) AS lexical, round(symbol_boost, 6) AS symbol_boost, round(path_boost, 6) AS path_boost,
               round(role_boost, 6) AS role_boost, round(repository_boost, 6) AS repository_boost FROM ranked"""),
    "sparse_search": (sparse_search, f"WITH {ranked_sql(_SPARSE_SQL, 25)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked"),
    "evidence_dedupe": (evidence_dedupe, f"""WITH {scored_sql(BENCHMARK_SQL)}, keyed AS (
        SELECT * FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY query_id, repository, source_path, label ORDER BY score DESC, chunk_id) = 1)
        SELECT query_id, count(*) AS evidence_keys, round(sum(score), 3) AS score_sum FROM keyed GROUP BY query_id"""),
    "evidence_packing": (evidence_packing, f"""WITH {packed_sql(10)}
        SELECT query_id, rank, chunk_id, length(block) AS block_chars, sha256(block) AS block_sha256 FROM packed"""),
    "prompt_fingerprint": (prompt_fingerprint, f"""WITH {prompts_sql()}
        SELECT query_id, left(sha256(query), 12) AS query_sha256, length(query) AS query_len,
               left(sha256(prompt), 12) AS prompt_sha256, length(prompt) AS prompt_len,
               coalesce(first_source, '(none)') AS first_source FROM prompts"""),
    "numbered_sources": (numbered_sources, f"WITH {prompts_sql()} SELECT query_id, coalesce(listing, 'No retrieval evidence was returned.') AS listing FROM prompts"),
    "evidence_preview": (evidence_preview, f"""WITH {ranked_sql(BENCHMARK_SQL, TOP_K)}
        SELECT query_id, rank, '**' || rank || '. ' || repository || ' | ' || source_role || '**' || chr(10) || '`' || source_path || '`'
               || chr(10) || 'Lines ' || start_line || '-' || end_line || ' | ' || coalesce(label, '(unnamed chunk)') || chr(10)
               || {preview_sql("content", 300)} AS preview FROM ranked"""),
    "search_report": (search_report, f"""WITH {ranked_sql(BENCHMARK_SQL, TOP_K)}
        SELECT query_id, string_agg(rank || '|' || source_path || '|' || end_line, ';' ORDER BY rank) AS results FROM ranked GROUP BY query_id"""),
    "answer_records": (answer_records, f"""WITH {prompts_sql()}
        SELECT query_id, NULL::VARCHAR AS answer, 'none' AS model, 'OpenAI SDK default' AS base_url, false AS success,
               CASE WHEN sources IS NULL THEN 'No retrieval evidence was found for the query.' ELSE 'No answer client is configured.' END AS error,
               coalesce(sources, -1) AS sources FROM prompts"""),
}
