"""Span operators against pairwise models, with buckets small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import spans as S

TYPES = ["function_definition", "class_specifier", "field_declaration", "template_declaration"]


def random_spans(seed, files=3, count=60, top=90):
    rng, rows = random.Random(seed), []
    for f in range(files):
        for i in range(count):
            start = rng.randrange(top)
            rows.append((f"f{f}", i, start, start + rng.choice([0, 1, 2, 5, 20, 60]), rng.choice(TYPES)))
        rows.append((f"f{f}", count, 10, 30, TYPES[0]))
        rows.append((f"f{f}", count + 1, 10, 30, TYPES[1]))
    return rows


def contains(p, c):
    return p[0] == c[0] and p[2] <= c[2] and c[3] <= p[3] and p[3] - p[2] > c[3] - c[2]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file string, chunk_index long, byte_start long, byte_end long, node_type string")


@pytest.mark.parametrize("width", [8, 1 << 18])
def test_containment(spark, width):
    rows = random_spans(1)
    df = frame(spark, rows)
    nested = {r[:2] for r in rows if any(contains(p, r) for p in rows)}
    assert {tuple(r) for r in S.nested_spans(df, width=width).select("file", "chunk_index").collect()} == nested
    outer = {tuple(r) for r in S.outermost_spans(df, width=width).select("file", "chunk_index").collect()}
    assert outer == {r[:2] for r in rows} - nested
    # Largest first, dropping what a kept span contains.
    kept = []
    for r in sorted(rows, key=lambda r: -(r[3] - r[2])):
        if not any(contains(k, r) for k in kept):
            kept.append(r)
    assert outer == {r[:2] for r in kept}
    got = {(r["file"], r["chunk_index"]): (r["containing_chunk_count"], r["parent_index"])
           for r in S.direct_parents(df, width=width).collect()}
    want = {}
    for r in rows:
        parents = [p for p in rows if contains(p, r)]
        if parents:
            want[r[:2]] = (len(parents), min(parents, key=lambda p: (p[3] - p[2], p[1]))[1])
    assert got == want


@pytest.mark.parametrize("width", [8, 1 << 18])
def test_coverage_and_overlap(spark, width):
    rows = random_spans(2)
    got = {r["file"]: r for r in S.overlap_metrics(frame(spark, rows), width=width).collect()}
    for f in ("f0", "f1", "f2"):
        mine = [r for r in rows if r[0] == f]
        covered = len({b for r in mine for b in range(r[2], r[3])})
        assert got[f]["unique_covered_bytes"] == covered
        assert got[f]["nested_chunk_count"] == sum(any(contains(p, r) for p in mine) for r in mine)
        assert got[f]["total_chunk_bytes_sum"] == sum(r[3] - r[2] for r in mine)


@pytest.mark.parametrize("width", [8, 1 << 18])
def test_points_and_types(spark, width):
    rows, rng = random_spans(3, count=15), random.Random(3)
    df = frame(spark, rows)
    points = [(f"f{i % 3}", rng.randrange(120)) for i in range(80)]
    found = S.points_inside(spark.createDataFrame(points, "file string, point long"), df, ["file"], width).collect()
    assert len(found) == len(points)
    for r in found:
        assert r["inside"] == any(s[0] == r["file"] and s[2] < r["point"] < s[3] for s in rows)
    ranges = [(f"f{i % 3}", i, i + rng.randint(1, 30)) for i in range(60)]
    typed = S.node_types_in(spark.createDataFrame(ranges, "file string, range_start long, range_end long"), df, ["file"], width)
    got = {(r["file"], r["range_start"]): r["node_types"] for r in typed.collect()}
    for f, a, b in ranges:
        want = sorted({s[4] for s in rows if s[0] == f and s[2] < b and a < s[3]})
        assert got.get((f, a), []) == want


@pytest.mark.parametrize("width", [8, 1 << 18])
def test_unique_points_keep_their_columns_without_a_join(spark, width):
    rows, rng = random_spans(4, count=15), random.Random(4)
    points = sorted({(f"f{i % 4}", rng.randrange(120)) for i in range(80)})
    asked = spark.createDataFrame([(*p, i if i % 3 else None, f"t{i}") for i, p in enumerate(points)], "file string, point long, n long, note string")
    found = S.points_inside(asked, frame(spark, rows), ["file"], width, unique=True)
    assert [tuple(r) for r in found.select(*asked.columns, "inside").orderBy("file", "point").collect()] == [
        (*p, i if i % 3 else None, f"t{i}", any(s[0] == p[0] and s[2] < p[1] < s[3] for s in rows)) for i, p in enumerate(points)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1, "only what earlier ranges carry is joined"


def test_one_file_with_most_spans_is_spread(spark):
    """All spans in one file: no partition may get them all."""
    df = spark.range(0, 40_000).select(
        F.lit("hot").alias("file"), F.col("id").alias("chunk_index"), (F.col("id") * 7 % 40_000).alias("byte_start"),
        (F.col("id") * 7 % 40_000 + 3).alias("byte_end"), F.lit("x").alias("node_type"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by_start = df.groupBy("file", "byte_start").agg(F.max("byte_end").alias("e"))
        out = S.running(by_start, ["file"], "byte_start", 1000, max_of={"m": "e"})
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_examples_fall_back_to_first_relations(spark):
    rows = [("f", 0, 0, 100, "namespace")] + [("f", i, i, i + 2, "field_declaration") for i in range(1, 20)]
    got = S.example_relations(S.direct_parents(frame(spark, rows))).sort("place").collect()
    assert [r["chunk_index"] for r in got] == list(range(1, 13))


def test_types_in_ranges_of_a_hot_file(spark, monkeypatch):
    """Half of all nodes lie in one file, whose ranges are salted; compared with every pair."""
    rng = random.Random(3)
    nodes = [(0 if i % 2 else rng.randint(1, 9), at := rng.randint(0, 900), at + rng.randint(1, 60), rng.choice("abcd")) for i in range(600)]
    ranges = [(f, at, at + 50) for f in range(10) for at in range(0, 1000, 50)]
    monkeypatch.setattr("spanloom.operators.scale.BROADCAST_BYTES", 0)
    found = S.node_types_in(
        spark.createDataFrame(ranges, "file int, range_start long, range_end long"),
        spark.createDataFrame(nodes, "file int, byte_start long, byte_end long, node_type string"), ["file"], width=64,
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["file"], r["range_start"]): r["node_types"] for r in found.collect()}
    want = {}
    for f, a, b in ranges:
        kinds = sorted({t for g, x, y, t in nodes if g == f and x < b and a < y})
        if kinds:
            want[f, a] = kinds
    assert got == want


@pytest.mark.parametrize("rows", [7, 60, 1 << 17])
def test_direct_parents_of_files_in_one_range_or_many(spark, rows):
    """Copies, equal starts, equal ends and a file of one span; compared with every pair."""
    data = random_spans(5, files=2, count=50, top=20) + random_spans(6, files=4, count=30)[64:] + [("alone", 0, 1, 9, TYPES[0])]
    data = [(f, i, s, e, t) for (f, i), (s, e, t) in {(r[0], r[1]): r[2:] for r in data}.items()]
    got = {(r["file"], r["chunk_index"]): (r["containing_chunk_count"], r["parent_index"], r["parent_node_type"], r["parent_byte_end"])
           for r in S.direct_parents(frame(spark, data), width=16, rows=rows).collect()}
    want = {}
    for r in data:
        parents = [p for p in data if contains(p, r)]
        if parents:
            best = min(parents, key=lambda p: (p[3] - p[2], p[1]))
            want[r[:2]] = (len(parents), best[1], best[4], best[3])
    assert got == want


def test_direct_parents_shuffle_a_small_file_once(spark):
    """A row per span goes to its file: no rows per level, no join back."""
    plan = S.direct_parents(frame(spark, random_spans(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_examples_read_the_relations_once(spark):
    """Three largest members per type, in type order; the relations are one branch of the plan."""
    rows = random_spans(7, files=4, count=80, top=60)
    rows += [("plain", i, 0, 40 - i, "namespace") for i in range(20)]
    relations = S.direct_parents(frame(spark, rows))
    found = S.example_relations(relations)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    want = []
    every = relations.collect()
    for f in {r["file"] for r in every}:
        mine = sorted((r for r in every if r["file"] == f), key=lambda r: r["chunk_index"])
        chosen = []
        for t in S.EXAMPLE_CHILD_TYPES:
            of_type = [r for r in mine if r["node_type"] == t and r["parent_node_type"] in S.CONTEXT_NODE_TYPES]
            chosen += sorted(of_type, key=lambda r: (r["byte_start"] - r["byte_end"], r["chunk_index"]))[:3]
        want += [(f, i + 1, r["chunk_index"]) for i, r in enumerate((chosen or mine)[:12])]
    assert sorted((r["file"], r["place"], r["chunk_index"]) for r in found.collect()) == sorted(want)
