"""BM25 with symbol, path, role and repository boosts, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import RankingConfig
from spanloom.functions import text as T
from spanloom.operators.index import HEAD_ROWS, LexicalIndex, bm25, bucket_of, evidence_heads, idf, part_of, role_heads
from spanloom.operators.scale import at_most, join_small, top_rows, top_tied
from spanloom.session import written

# Lexical scores are summed in units of 1e-12. Integer sums do not depend on the
# order in which tasks finish, so equal chunks tie exactly and reruns agree.
UNITS = 1e12
# Distinct query terms up to which the scans get the terms themselves as a filter.
LITERAL_TERMS = 2_000
# Candidates per query that are looked at first, for each result asked for.
DEPTH = 80
QUERY_TERMS = 1_000_000
# Queries up to which their features are broadcast. A query has at most one row
# per role in them, so this bounds those rows too.
QUERY_ROWS = 20_000
# Result rows that may be broadcast to fetch what belongs to them.
RESULT_ROWS = 100_000

BOOSTS = ("symbol_boost", "path_boost", "role_boost", "repository_boost")


def _literal_map(values, kind: str) -> Column:
    if not values:
        return F.create_map().cast(kind)
    return F.create_map(*[x for key, value in values.items() for x in (F.lit(key), value)])


def query_features(queries: DataFrame, config: RankingConfig) -> DataFrame:
    """(query_id, query) with its terms, intents and hints."""
    roles = {t: F.array(*[F.lit(r) for r in names]) for t, names in config.role_hints.items()}
    hints = _literal_map(roles, "map<string,array<string>>")
    targets = _literal_map({t: F.lit(n) for t, n in config.repository_hints.items()}, "map<string,string>")
    identifiers = F.filter(T.words(F.col("query")), lambda w: w.rlike(T.IDENTIFIER))
    return (
        queries.select(
            "query_id", "query",
            T.tokenize(F.col("query")).alias("all_terms"),
            F.transform(identifiers, T.canonical).alias("explicit"),
        )
        .withColumn("terms", F.array_distinct("all_terms"))
        .withColumn("schema_intent", F.exists("terms", lambda t: t.isin(*config.schema_intent_terms)))
        .withColumn("hinted_roles", F.array_distinct(F.flatten(
            F.filter(F.transform("terms", lambda t: F.try_element_at(hints, t)), lambda r: r.isNotNull())
        )))
        # The first term with a hint decides.
        .withColumn("target_repository", F.get(
            F.filter(F.transform("all_terms", lambda t: F.try_element_at(targets, t)), lambda r: r.isNotNull()),
            F.lit(0),
        ))
    )


def query_terms(features: DataFrame, config: RankingConfig) -> DataFrame:
    """Distinct terms of each query with what a match of the term counts for."""
    term = F.col("term")
    return features.select("query_id", "explicit", F.explode("terms").alias("term")).select(
        "query_id", "term",
        F.when(term.isin(*config.generic_symbol_terms) | (F.length(term) < 4), 0)
        .when(F.array_contains("explicit", term), 2).otherwise(1).alias("symbol_class"),
        (F.length(term) >= 4).cast("int").alias("path_intent"),
        ((F.length(term) >= 4) & ~term.isin(*config.generic_path_terms)).cast("int").alias("path_identifier"),
    )


def symbol_boost(config: RankingConfig) -> Column:
    """Whole symbol named (as an identifier or as a word), or all of its words."""
    return (
        F.when(F.col("symbol_class") == 2, config.explicit_symbol_boost)
        .when(F.col("symbol_class") == 1, config.symbol_boost)
        .when((F.col("symbol_words") >= 2) & (F.col("words_named") == F.col("symbol_words")),
              config.symbol_words_boost)
        .otherwise(0.0)
    )


def path_boost(config: RankingConfig) -> Column:
    return F.least(
        F.lit(config.path_term_cap), config.path_term_boost * F.col("path_terms_named")
    ) + F.least(
        F.lit(config.path_identifier_cap), config.path_identifier_boost * F.col("path_identifiers_named")
    )


def role_boost(config: RankingConfig) -> Column:
    role = F.col("source_role")
    return (
        F.when(F.col("schema_intent") & (role == config.schema_role), config.schema_role_boost)
        .when(F.col("schema_intent") & (role == config.demoted_role), config.demoted_role_boost)
        .when(F.array_contains("hinted_roles", role), config.hinted_role_boost)
        .otherwise(0.0)
    )


def repository_boost(config: RankingConfig) -> Column:
    return F.when(F.col("target_repository") == F.col("repository"), config.repository_boost).otherwise(0.0)


def lexical_units(contribution: Column) -> Column:
    return F.floor(contribution * UNITS + 0.5)


# What one posting adds to a (query, chunk) candidate; every part adds up in any order.
_PARTS = ("units", "symbol_class", "words_named", "path_terms_named", "path_identifiers_named")


def weighted_terms(index: LexicalIndex, terms: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The terms with their weight, and the distinct ones where these are few.

    The vocabulary is opened at the buckets of the terms only.
    """
    spark = terms.sparkSession
    keyed = terms.withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    weights = index.table(spark, "terms")
    rows = [r["term"] for r in keyed.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    few = sorted(rows) if len(rows) <= LITERAL_TERMS else None
    if few is not None:
        weights = weights.filter(F.col("term").isin(few))
    # One number per bucket of the vocabulary at most.
    weights = weights.filter(F.col("bucket").isin(sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect())))
    stats = index.table(spark, "statistics").first()
    return (
        # A term without a frequency may still be the whole symbol of a chunk.
        keyed.join(weights, ["bucket", "term"], "left")
        .withColumn("weight", idf(F.lit(stats["chunks"]), F.coalesce("df", F.lit(0))))
        .drop("df", "bucket").withColumn("avg_length", F.lit(stats["avg_length"]))
    ), few


def term_hits(index: LexicalIndex, terms: DataFrame, config: RankingConfig) -> DataFrame:
    """One row per query term found in a chunk, with its lexical part and boost counts.

    The shards are sorted by term: with few distinct terms the scan skips what
    holds none of them. While the terms fit a broadcast, the postings stay where
    they are, and a sum per chunk needs no shuffle either; else they are salted.
    """
    weighted, few = weighted_terms(index, terms)
    found = index.table(terms.sparkSession, "postings")
    if few is not None:
        found = found.filter(F.col("term").isin(few))
    joined = join_small(found, weighted, ["term"], spread_by="chunk_no", max_rows=QUERY_TERMS)
    part = bm25(F.col("tf"), F.col("length"), F.col("avg_length"), F.col("weight"), config)
    return joined.select(
        "query_id", "chunk_no", lexical_units(part).alias("units"),
        F.when(F.col("is_symbol"), F.col("symbol_class")).otherwise(0).alias("symbol_class"),
        F.col("in_symbol").cast("int").alias("words_named"),
        F.when(F.col("in_path"), F.col("path_intent")).otherwise(0).alias("path_terms_named"),
        F.when(F.col("in_path"), F.col("path_identifier")).otherwise(0).alias("path_identifiers_named"),
    )


def summed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "chunk_no").agg(*[F.sum(name).alias(name) for name in _PARTS])


def favoured(index: LexicalIndex, features: DataFrame, config: RankingConfig, few: bool, top_k: int | None = None) -> DataFrame:
    """(query_id, chunk_no) that a query's roles or its repository favour, with parts of nothing.

    For a ranking cut to `top_k` the stored heads hold enough of these; without
    it all of them are listed.
    """
    spark = features.sparkSession
    if top_k is None:
        pairs = roles = index.table(spark, "chunks").select(
            "chunk_no", "source_role", "repository", F.lit(0).alias("head_rank")
        )
    elif top_k <= HEAD_ROWS:
        pairs, roles = index.table(spark, "heads"), index.table(spark, "role_heads")
    else:
        pairs = evidence_heads(index.table(spark, "chunks"), top_k)
        roles = role_heads(pairs, top_k)
    schema = F.when(F.col("schema_intent"), F.array(F.lit(config.schema_role))).otherwise(
        F.array().cast("array<string>")
    )
    by_role = features.select(
        "query_id", F.explode(F.array_union("hinted_roles", schema)).alias("source_role")
    )
    by_repository = features.filter("target_repository IS NOT NULL").select(
        "query_id", F.col("target_repository").alias("repository")
    )
    deep = F.col("head_rank") <= (0 if top_k is None else top_k)
    nothing = [F.lit(0).alias(name) for name in _PARTS]
    return join_small(roles.filter(deep), by_role, ["source_role"], "chunk_no", proven=few).select(
        "query_id", "chunk_no", *nothing
    ).unionByName(
        join_small(pairs.filter(deep), by_repository, ["repository"], "chunk_no", proven=few).select("query_id", "chunk_no", *nothing)
    )


def candidates(
    index: LexicalIndex, features: DataFrame, config: RankingConfig, few: bool, top_k: int | None = None
) -> DataFrame:
    """Every (query, chunk) that some part of the score favours, with its summed parts.

    A path or symbol-word match implies a term match, and a whole-symbol match
    has a posting of its own, so term hits bring all chunks but those that only
    their role or repository favours.
    """
    hits = term_hits(index, query_terms(features, config), config)
    return summed(hits.unionByName(favoured(index, features, config, few, top_k)))


def _with_scores(found: DataFrame, features: DataFrame, config: RankingConfig, few: bool, *shown: str) -> DataFrame:
    """Candidates joined to their chunks, with the score components and the score."""
    asked = features.select("query_id", "schema_intent", "hinted_roles", "target_repository")
    rows = join_small(found, asked, ["query_id"], spread_by="chunk_no", proven=few)
    parts = rows.select(
        "query_id", "chunk_no", "chunk_id", "evidence_key", *shown, (F.col("units") / F.lit(UNITS)).alias("lexical"),
        symbol_boost(config).alias("symbol_boost"), path_boost(config).alias("path_boost"),
        role_boost(config).alias("role_boost"), repository_boost(config).alias("repository_boost"),
    )
    score = F.col("lexical")
    for name in BOOSTS:
        score = score + F.col(name)
    return parts.withColumn("score", score).filter("score > 0")


def scored(index: LexicalIndex, queries: DataFrame, config: RankingConfig, top_k: int | None = None) -> DataFrame:
    """Every chunk of positive score per query, with its five score components.

    With `top_k`, only what may have a place in a ranking of that length is
    listed: chunks that a role or repository alone favours come from the stored
    heads. Of the chunk table only what the boosts and the ranking look at takes
    part; `described` adds the rest to the few rows that are kept.
    """
    features = query_features(queries, config)
    few = at_most(queries, QUERY_ROWS)
    chunks = index.table(queries.sparkSession, "chunks").select(
        "chunk_no", "chunk_id", "evidence_key", "repository", "source_role", "symbol_words",
    )
    found = candidates(index, features, config, few, top_k).join(chunks, "chunk_no")
    return _with_scores(found, features, config, few)


def best_evidence(scored_rows: DataFrame) -> DataFrame:
    """Best chunk of each (repository, path, label) per query; a null label is a label."""
    return top_rows(
        scored_rows, ["query_id", "evidence_key"],
        [F.col("score").desc(), F.col("chunk_id")], 1, "_best",
    ).drop("_best")


def results_are_few(queries: DataFrame, top_k: int) -> bool:
    """Whether the results of all queries together are proven to be few."""
    return at_most(queries, RESULT_ROWS // top_k)


def chunks_of(rows: DataFrame, index: LexicalIndex, few: bool, *columns: str) -> DataFrame:
    """Rows with columns of their chunks; few rows open only the folders of the chunk table that hold them."""
    chunks = index.table(rows.sparkSession, "chunks").select("part", "chunk_no", *columns)
    keyed = rows.withColumn("part", part_of(F.col("chunk_no")))
    return chunks.join(F.broadcast(keyed) if few else keyed, ["part", "chunk_no"]).drop("part")


SHOWN = ("source_path", "label", "chunk_type", "start_line", "end_line")


def described(rows: DataFrame, index: LexicalIndex, few: bool) -> DataFrame:
    """Rows with the shown fields of their chunks."""
    return chunks_of(rows, index, few, "repository", "source_role", *SHOWN).drop("chunk_no", "evidence_key")


def most_extra(config: RankingConfig) -> Column:
    """The most that role and repository can add to a chunk of this query."""
    return F.greatest(
        F.lit(0.0), F.when(F.col("schema_intent"), F.greatest(F.lit(config.schema_role_boost), F.lit(config.demoted_role_boost))),
        F.when(F.size("hinted_roles") > 0, config.hinted_role_boost),
    ) + F.when(F.col("target_repository").isNotNull(), F.greatest(F.lit(0.0), F.lit(config.repository_boost))).otherwise(0.0)


def _most(config: RankingConfig) -> Column:
    """The most that a candidate's own parts can come to; how many words its symbol has is not known yet."""
    own = (
        F.when(F.col("symbol_class") == 2, config.explicit_symbol_boost).when(F.col("symbol_class") == 1, config.symbol_boost)
        .when(F.col("words_named") >= 2, config.symbol_words_boost).otherwise(0.0)
    )
    return F.col("units") / F.lit(UNITS) + own + path_boost(config)


def _fully(index: LexicalIndex, queries: DataFrame, config: RankingConfig, top_k: int) -> DataFrame:
    """`search` by way of every candidate's score."""
    order = [F.col("score").desc(), F.col("chunk_id")]
    best = best_evidence(scored(index, queries, config, top_k))
    return described(top_rows(best, ["query_id"], order, top_k, "rank"), index, results_are_few(queries, top_k))


def search(index: LexicalIndex, queries: DataFrame, config: RankingConfig, top_k: int = 5) -> DataFrame:
    """Ranked results of every query: best evidence per key, cut to `top_k`.

    Each query's candidates are first cut to the most promising ones by what
    their postings alone allow them at most, and only the chunks of these are
    opened. That settles a query where the last candidate kept could not reach
    the last result even with all that role and repository can add. Queries for
    which it doesn't, say of many chunks with one evidence key, are run again
    over all their candidates.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    features = query_features(queries, config)
    few = at_most(queries, QUERY_ROWS)
    depth = DEPTH * top_k
    hits = summed(term_hits(index, query_terms(features, config), config)).withColumn("most", _most(config))
    first = top_rows(hits, ["query_id"], [F.col("most").desc(), F.col("chunk_no")], depth, "_place")
    flat = favoured(index, features, config, few, top_k).distinct().withColumns({"most": F.lit(0.0), "_place": F.lit(None).cast("int")})
    # A chunk of both kinds scores no less by its hits, so of its two rows that one is kept as the best evidence.
    found = written(first.unionByName(flat), "candidates")
    near = results_are_few(queries, depth)
    rows = _with_scores(
        chunks_of(found, index, near, "chunk_id", "evidence_key", "repository", "source_role", "symbol_words", *SHOWN),
        features, config, few, "repository", "source_role", *SHOWN,
    )
    order = [F.col("score").desc(), F.col("chunk_id")]
    results = written(top_rows(best_evidence(rows), ["query_id"], order, top_k, "rank"), "results").drop("chunk_no", "evidence_key")
    last = results.filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("last"))
    cut = found.filter(F.col("_place") == depth).select("query_id", "most")
    open_ = features.select("query_id", most_extra(config).alias("extra")).join(cut, "query_id").join(last, "query_id", "left").filter(
        F.col("last").isNull() | (F.col("most") + F.col("extra") >= F.col("last"))
    ).select("query_id").distinct()
    again = written(open_, "open-queries")
    if again.isEmpty():
        return results
    rest = _fully(index, queries.join(again, "query_id", "left_semi"), config, top_k)
    return results.join(again, "query_id", "left_anti").unionByName(rest)


def lexical_search(index: LexicalIndex, queries: DataFrame, config: RankingConfig, top_k: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, units) by the BM25 score alone, ties by chunk id."""
    hits = term_hits(index, query_terms(query_features(queries, config), config), config).filter("units > 0")
    sums = hits.groupBy("query_id", "chunk_no").agg(F.sum("units").alias("units"))
    few = results_are_few(queries, DEPTH * top_k)
    # Ties at the cut are all kept: the rank counts the chunks that score more.
    first = top_tied(sums, ["query_id"], F.col("units").desc(), top_k)
    named = chunks_of(first, index, few, "chunk_id")
    return top_rows(named, ["query_id"], [F.col("units").desc(), F.col("chunk_id")], top_k, "rank").drop("chunk_no")


def result_rows(results: DataFrame, debug: bool = False) -> DataFrame:
    """The reported form of search results: scores to six places."""
    columns = [
        F.col("query_id"), F.col("rank"), F.round("score", 6).alias("score"),
        F.col("repository"), F.col("source_role"), F.col("source_path"), F.col("chunk_type"),
        F.col("label").alias("symbol_or_section_title"), F.col("start_line"), F.col("end_line"),
    ]
    if debug:
        columns.append(F.struct(
            F.round("lexical", 6).alias("lexical"), *[F.col(b) for b in BOOSTS],
            F.round("score", 6).alias("final"),
        ).alias("score_components"))
    return results.select(*columns)


def result_report(results: DataFrame) -> DataFrame:
    """Results of each query as one array in rank order; at most top_k rows each."""
    rows = F.array_sort(F.collect_list(F.struct(
        "rank", F.round("score", 6).alias("score"), "repository", "source_role", "source_path", "chunk_type",
        F.col("label").alias("symbol_or_section_title"), "start_line", "end_line",
    )))
    return results.groupBy("query_id").agg(rows.alias("top_k_results"))
