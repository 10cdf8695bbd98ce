"""Ranked search against a plain model, on corpora made to hit every rule."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.config import RankingConfig
from spanloom.functions import text as T
from spanloom.operators import index as X
from spanloom.operators.index import build_index
from spanloom.operators.ranking import lexical_search, scored, search
from spanloom.plans.retrieval import Retriever
from spanloom.session import new_table_path
from spanloom.sources.corpus import conform_chunks

CONFIG = RankingConfig().for_repositories(["Alpha", "Beta"])
ROLES = ["core_library", "simulation_case", "test", "config_or_schema", "unit_test"]
WORDS = "pressure getPressure get_pressure fluid test schema class heat solver none Alpha beta function with config".split()


def model_tokens(spark, texts):
    """Tokens of each text, from the column expression that test_text checks."""
    from spanloom.functions.text import tokenize

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tokenize(F.col("t")).alias("k"))
    return {r["i"]: r["k"] for r in rows.collect()}


def canonical(text):
    return re.sub("[^a-z0-9]", "", text.lower())


def model_search(spark, chunks, query, k):
    names = [c["symbol"] or c["section_title"] or "" for c in chunks]
    texts = ["\n".join([c["content"], "None" if c["symbol"] is None else c["symbol"], c["source_path"], c["source_role"],
                        c["repository"], c["section_title"] or "", "{}"]) for c in chunks]
    toks = model_tokens(spark, texts + names + [c["source_path"] for c in chunks] + [query])
    n = len(chunks)
    bags = [Counter(toks[i]) for i in range(n)]
    average = sum(sum(b.values()) for b in bags) / n
    df = Counter(t for b in bags for t in b)
    terms = toks[3 * n]
    explicit = {canonical(w) for w in re.findall(r"[A-Za-z][A-Za-z0-9_]*|\d+", query) if re.search("_|[a-z][A-Z]", w)}
    long = {t for t in terms if len(t) >= 4}
    hinted = {r for t in terms for r in CONFIG.role_hints.get(t, ())}
    target = next((CONFIG.repository_hints[t] for t in terms if t in CONFIG.repository_hints), None)
    schema = bool(set(terms) & set(CONFIG.schema_intent_terms))
    found = []
    for i, c in enumerate(chunks):
        length = sum(bags[i].values())
        lexical = sum(
            math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bags[i][t] * 2.5
            / (bags[i][t] + 1.5 * (0.25 + 0.75 * length / average))
            for t in sorted(set(terms)) if t in bags[i])
        name = canonical(names[i])
        words = {t for t in toks[n + i] if len(t) >= 3 and t != name}
        if len(name) >= 4 and name not in CONFIG.generic_symbol_terms and name in terms:
            symbol = 24.0 if name in explicit else 12.0
        else:
            symbol = 10.0 if len(words) >= 2 and words <= set(terms) else 0.0
        path = set(toks[2 * n + i])
        boost = min(8.25, 2.75 * len(path & long)) + min(6.0, 6.0 * len(path & (long - set(CONFIG.generic_path_terms))))
        role = c["source_role"]
        if schema and role in ("config_or_schema", "test"):
            role_boost = 14.0 if role == "config_or_schema" else -1.0
        else:
            role_boost = 2.5 if role in hinted else 0.0
        score = lexical + symbol + boost + role_boost + (1.5 if target == c["repository"] else 0.0)
        if score > 0:
            found.append((-round(score, 9), c["chunk_id"], (c["repository"], c["source_path"], names[i] or None)))
    seen, kept = set(), []
    for score, chunk_id, key in sorted(found):
        if key not in seen:
            seen.add(key)
            kept.append((chunk_id, -score))
    return kept[:k]


def corpus(rng, size):
    rows = []
    for i in range(size):
        hot = rng.random() < 0.4
        rows.append({
            "chunk_id": f"c{i:04d}", "repository": "Alpha" if hot else rng.choice(["Alpha", "Beta"]),
            "source_role": rng.choice(ROLES), "source_path": "src/hot.cpp" if hot else f"src/{rng.choice(WORDS)}_{i % 9}.cpp",
            "symbol": rng.choice([None, "GetPressure", "get_pressure", "FluidSolver", "with", "", "heat transfer"]),
            "section_title": rng.choice([None, "Heat Solver", ""]),
            "content": " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))),
        })
    return rows


def frame(spark, rows):
    return conform_chunks(spark.createDataFrame(
        [(r["chunk_id"], r["repository"], r["source_role"], r["source_path"], r["symbol"], r["section_title"], r["content"])
         for r in rows],
        "chunk_id string, repository string, source_role string, source_path string, symbol string, section_title string, content string"))


QUERIES = [
    "getPressure fluid", "get_pressure", "get pressure of the solver", "schema for test config", "class", "zzz example",
    "what is with", "none", "beta heat transfer", "json", "function qqq api", "nothing here",
]


@pytest.mark.parametrize("seed, depth", [(1, 80), (2, 1)])
def test_search_matches_the_model(spark, monkeypatch, seed, depth):
    """With a depth of 1 few queries are settled by their first candidates; the others run over all of them."""
    monkeypatch.setattr("spanloom.operators.ranking.DEPTH", depth)
    rows = corpus(random.Random(seed), 120)
    index = build_index(frame(spark, rows), new_table_path(spark, "t"), CONFIG)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    for k in (1, 7):
        got: dict = {}
        for r in search(index, queries, CONFIG, k).sort("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
        for i, query in enumerate(QUERIES):
            want = [(c, round(s, 6)) for c, s in model_search(spark, rows, query, k)]
            assert got.get(i, []) == want, query


def chunk(**values):
    base = {"chunk_id": "a", "repository": "R", "source_role": "x", "source_path": "p", "symbol": "s", "section_title": None,
            "content": ""}
    return {**base, **values}


def find(spark, rows, query, k=10):
    retriever = Retriever(spark, frame(spark, rows), RankingConfig())
    one = spark.createDataFrame([(0, query)], "query_id long, query string")
    return retriever, retriever.batch(one, k).sort("rank").collect()


def test_identifier_spelling_decides_the_boost(spark):
    rows = [chunk(chunk_id="a", symbol="get_pressure"), chunk(chunk_id="b", symbol="GetPressure", source_path="q")]
    _, hits = find(spark, rows, "getPressure")
    assert {h["symbol_boost"] for h in hits} == {24.0}
    _, hits = find(spark, rows, "get_pressure")
    assert {h["symbol_boost"] for h in hits} == {10.0}


def test_null_symbol_is_a_word_and_a_key(spark):
    rows = [chunk(chunk_id=i, symbol=None, content="w") for i in "ab"] + [chunk(chunk_id="c", symbol="z")]
    _, hits = find(spark, rows, "none")
    assert [h["chunk_id"] for h in hits] == ["a"]


def test_demoted_role_can_vanish(spark):
    rows = [chunk(chunk_id="a", source_role="test", content="schema " * 3)] + [
        chunk(chunk_id=f"z{i}", source_path=f"p{i}", content="schema") for i in range(9)]
    _, hits = find(spark, rows, "schema", 20)
    assert "a" not in {h["chunk_id"] for h in hits}


def test_ties_go_by_chunk_id_and_overloads_collapse(spark):
    rows = [chunk(chunk_id="b", source_path="p1", content="word"), chunk(chunk_id="a", source_path="p2", content="word"),
            chunk(chunk_id="c", source_path="p2", content="word")]
    _, hits = find(spark, rows, "word")
    assert [h["chunk_id"] for h in hits] == ["a", "b"]


def test_empty_corpus_and_bad_top_k(spark):
    with pytest.raises(ValueError):
        Retriever(spark, frame(spark, [chunk()]).filter("false"), RankingConfig())
    retriever, _ = find(spark, [chunk(content="word")], "word")
    with pytest.raises(ValueError):
        retriever.search("word", 0)
    assert retriever.search("...", 5).count() == 0


def test_many_terms_join_instead_of_filter(spark, monkeypatch):
    from spanloom.operators import ranking

    rows = corpus(random.Random(4), 60)
    index = build_index(frame(spark, rows), new_table_path(spark, "t"), CONFIG)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    want = sorted(map(tuple, scored(index, queries, CONFIG, 5).select("query_id", "chunk_id", "score").collect()))
    monkeypatch.setattr(ranking, "LITERAL_TERMS", 1)
    monkeypatch.setattr(ranking, "QUERY_TERMS", 1)
    monkeypatch.setattr(ranking, "QUERY_ROWS", 1)
    got = sorted(map(tuple, scored(index, queries, CONFIG, 5).select("query_id", "chunk_id", "score").collect()))
    assert got == want


def test_answers(spark):
    retriever, _ = find(spark, [chunk(content="word here")], "word")
    queries = spark.createDataFrame([(0, "word"), (1, "absent"), (2, "here")], "query_id long, query string")

    def client(system, prompt):
        if "here" in prompt.splitlines()[1]:
            raise RuntimeError('{"api_key": "k1", "why": "token=k2 down"}')
        return "  answer  "

    rows = {r["query_id"]: r for r in retriever.answer(queries, client=client, model="m").collect()}
    assert rows[0]["success"] and rows[0]["answer"] == "answer"
    assert rows[1]["error"] == "No retrieval evidence was found for the query."
    assert rows[2]["error"] == '{"api_key": "[redacted]", "why": "token=[redacted] down"}'


def test_search_opens_what_it_needs(spark):
    from spanloom.operators import ranking
    from spanloom.operators.index import open_index

    rows = corpus(random.Random(6), 60)
    path = new_table_path(spark, "t")
    built = build_index(frame(spark, rows), path, CONFIG)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    terms = ranking.query_terms(ranking.query_features(queries, CONFIG), CONFIG)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    # The postings of a chunk are summed where they lie, and its row is looked for in its folder only.
    sums = plan(ranking.summed(ranking.term_hits(built, terms, CONFIG)))
    assert "Bucketed: true" in sums and "hashpartitioning(query_id" not in sums
    few = ranking.top_rows(ranking.summed(ranking.term_hits(built, terms, CONFIG)), ["query_id"], [F.col("units").desc()], 1, "place")
    assert "dynamicpruning" in plan(ranking.chunks_of(few, built, True, "chunk_id"))
    spark.sql(f"DROP TABLE {built.postings_name}")
    again = open_index(spark, path)
    assert again == built
    found = [sorted(map(tuple, search(x, queries, CONFIG, 3).select("query_id", "rank", "chunk_id").collect())) for x in (built, again)]
    assert found[0] == found[1]


def test_lexical_ties_go_by_chunk_id(spark):
    rows = [chunk(chunk_id=f"c{i % 10}{i}", content="same words here") for i in range(30)]
    index = build_index(frame(spark, rows), new_table_path(spark, "t"), CONFIG)
    queries = spark.createDataFrame([(0, "words")], "query_id long, query string")
    got = lexical_search(index, queries, CONFIG, 4).sort("rank").collect()
    assert [r.chunk_id for r in got] == sorted(r["chunk_id"] for r in rows)[:4] and [r["rank"] for r in got] == [1, 2, 3, 4]


def test_words_of_a_chunk_are_taken_once(spark):
    """The regular expression over the whole text stands once in the plan of the analysis, not once for each use."""
    chunks = spark.createDataFrame(
        [("c", "r", "core", "a/b.cpp", "function", "f", None, 1, 2, "{}", "SolverConfig configured boxes x")],
        "chunk_id string, repository string, source_role string, source_path string, chunk_type string, symbol string, "
        "section_title string, start_line long, end_line long, parent_context string, content string")
    found = X.analyzed(chunks, RankingConfig()).select("tokens")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") == 1
    text = T.searchable_text(*[F.col(c) for c in ("content", "symbol", "source_path", "source_role", "repository", "section_title", "parent_context")])
    assert found.first()[0] == sorted(chunks.select(T.tokenize(text)).first()[0])


def test_postings_take_their_ids_unsorted(spark):
    """A join of all postings with their chunks' ids neither shuffles nor sorts the postings."""
    from spanloom.workloads.retrieval import doc_term_freq

    plan = doc_term_freq(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Sort " not in plan
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
