"""The building blocks that keep hot keys apart, on their large-data branches."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import scale
from spanloom.sources.sessions import next_session
from spanloom.streaming.ingest import assign_sessions, run_available


def test_running_over_buckets(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.randint(-9, 9)) for k in range(3) for o in rng.sample(range(-50, 200), 60)]
    df = spark.createDataFrame(rows, "k int, o long, v long")
    for width in (7, 1000):
        for inclusive in (False, True):
            got = scale.running(df, ["k"], "o", width, max_of={"hi": "v"}, min_of={"lo": "v"}, sum_of={"total": "v"},
                                inclusive=inclusive).collect()
            for r in got:
                seen = [v for k, o, v in rows if k == r["k"] and (o < r["o"] or (inclusive and o == r["o"]))]
                assert r["total"] == sum(seen)
                assert r["hi"] == (max(seen) if seen else None)
                assert r["lo"] == (min(seen) if seen else None)


def test_last_value_over_buckets(spark):
    rng = random.Random(8)
    rows = [(k, o, rng.choice([None, None, "a", "b", "c"])) for k in range(3) for o in rng.sample(range(-50, 200), 60)]
    df = spark.createDataFrame(rows, "k int, o long, v string")
    for width in (7, 1000):
        for inclusive in (False, True):
            for r in scale.running(df, ["k"], "o", width, last_of={"last": "v"}, inclusive=inclusive).collect():
                seen = [(o, v) for k, o, v in rows if k == r["k"] and v is not None and (o < r["o"] or (inclusive and o == r["o"]))]
                assert r["last"] == (max(seen)[1] if seen else None)


def assigned(rows):
    """(log, place) -> session by a plain loop."""
    out, known = {}, {}
    for log, place, tester, given in sorted(rows):
        before = known.get(log)
        session = given if given is not None else before[1] if before and tester is not None and before[0] == tester else f"s{place}"
        known[log], out[log, place] = (tester, session), session
    return out


def session_rows():
    rng = random.Random(9)
    return [(log, place, rng.choice(["amy", "amy", "bob", None]), f"given{place}" if rng.random() < 0.1 else None)
            for log, many in ((0, 300), (1, 5), (2, 60)) for place in rng.sample(range(1000), many)]


def test_sessions_over_ranges_of_places(spark):
    rows = session_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "log long, place long, tester_id string, session_id string, extra int")
    for width in (10, 10_000):
        got = next_session(df, F.concat(F.lit("s"), "place"), width)
        assert got.columns == df.columns
        assert {(r["log"], r["place"]): r["session_id"] for r in got.collect()} == assigned(rows)


def test_sessions_of_a_stream(spark, tmp_path):
    """Batches in the order of their places, rows inside in any order; state goes from one to the next."""
    rows = sorted(session_rows(), key=lambda r: r[1])
    kind = "log long, place long, tester_id string, session_id string"
    for i, at in enumerate(range(0, len(rows), 80)):
        part = rows[at : at + 80]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_available(assign_sessions(stream, lambda place: f"s{place}"), spark, "sessions").collect()
    assert {(r["log"], r["place"]): r["session_id"] for r in got} == assigned(rows)


def test_numbering_in_ranges(spark):
    rows = [(i % 7, f"id{i:05d}") for i in range(2000)] + [(3, None)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(6)
    got = scale.numbered(df, ["a", "b"], "n", rows_per_range=150).collect()
    want = {row: i + 1 for i, row in enumerate(sorted(rows, key=lambda r: (r[0], r[1] or "")))}
    assert {(r["a"], r["b"]): r["n"] for r in got} == want


def test_salted_join(spark):
    large = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1)], "k string, i long")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("none", 3)], "k string, w long")
    plain = scale.join_small(large, small, ["k"], "i").groupBy().agg(F.count("*"), F.sum("w")).first()
    salted = scale.join_small(large, small, ["k"], "i", max_rows=1, salts=8).groupBy().agg(F.count("*"), F.sum("w")).first()
    assert tuple(plain) == tuple(salted) == (1000, 1500)


def test_deep_top_rows(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = scale.top_rows(df, ["g"], [F.col("v").desc()], 1500, "r")
    assert got.count() == 3000
    assert got.filter("g = 0 AND r = 1500").first()["v"] == 4998 - 2 * 1499


def test_small_scan_is_spread(spark):
    assert scale.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert scale.spread(spark.range(0, 10**9, 1, 40)).rdd.getNumPartitions() == 40


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from spanloom import session

    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="scratch"):
        session.shared_folder(fake)
    conf["spark.checkpoint.dir"] = "hdfs://x"
    assert session.shared_folder(fake) == "hdfs://x"
    conf[session.SCRATCH_KEY] = "hdfs://own"
    assert session.shared_folder(fake) == "hdfs://own"
    conf.clear()
    fake.sparkContext.master = "local[4]"
    assert session.shared_folder(fake) == session.shared_folder(fake)
