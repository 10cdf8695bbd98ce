"""Manifest, prefix trie and mixing against plain Python, with odd rows, ties, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle, mixing, trie
from spanloom.llm.queries import spliced

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Levels from the leaves up, eight to a run."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def expected_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = climb([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], i) + way(top, place)
            now = x[2]
            for left, right in path:
                now = digest(left, now, right)
            assert now == top[-1][0]
            out.append((x[3][0], x[2], trees[g][-1][0], now, digest(*[a + b for a, b in path])))
    return out


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 9, None: 1}, {"en": 70, "": 8, None: 3, "é": 65, "z": 1}])
def test_manifest(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 20)
    rng = random.Random(len(sizes))
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.choice([None, rng.randint(-9, 10**12), 5]), rng.choice([None, "s"]), lang, rng.choice([None, 3]), rng.choice([None, "", "Ünï\n", "word " * 3000])) for _ in range(n)]
    rows += rows[:2]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], KIND + ", tree long, i long, digest string")
    fields = [F.col(c.split()[0]) for c in KIND.split(", ")]
    built = merkle.built(docs, "lang", "doc_id", merkle.leaf_digest(*fields), ["doc_id", "tree"])
    proofs = merkle.proved(built).select(
        "row.doc_id", "digest", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof"),
        merkle.folded(F.col("digest"), F.col("path")).alias("again"),
    ).collect()
    assert Counter(tuple(r)[:5] for r in proofs) == Counter(expected_manifest(rows))
    assert all(r.again == r.root for r in proofs)


def expected_trie(convs):
    """{prefix: (least member, n_convs, n_children, n_leaves, saved, ends)} by plain loops."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    low = lambda c: -(2**63) if c is None else c
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted((c for c in own if len(convs[c]) == len(p)), key=low)
        parent = min(members[p[:-1]], key=low) if p else None
        out.append((
            min(own, key=low), len(p), parent, len(own), kids[p], sum(not kids[q] for q in below), saved,
            sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest(),
        ))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, conv long, place string")


def told(rows):
    """Turns per conversation in order; null turn first."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in out.items()}


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, convs), None]:
        for t in range(rng.randint(1, longest)):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t * 700 - 900, rng.choice(["user", None, "assistant"][: 1 + t % 3]), rng.choice(["a", "é", None, "b"][: 1 + t % 4])))
    return rows


@pytest.mark.parametrize("seed, convs, longest", [(1, 60, 5), (2, 25, 30)])
def test_trie(spark, monkeypatch, seed, convs, longest):
    monkeypatch.setattr(trie, "HOT_SHARE", 3)
    monkeypatch.setattr(trie, "IDS_PER_PIECE", 4)
    rows = random_rows(seed, convs, longest)
    turns = trie.numbered(conversations(spark, rows))
    got = trie.prefix_trie(turns, turns.select("conv")).drop("node_1", "node_2").collect()
    assert Counter(map(tuple, got)) == Counter(expected_trie(told(rows)))
    empty = conversations(spark, [])
    assert trie.prefix_trie(*spliced(trie.numbered(empty))).count() == 0


def test_rebuilt_conversations(spark):
    rows = random_rows(3, 40, 12) + [(103, 1, "user", "no base")]
    told_ = told(rows)
    want = {}
    for c, own in told_.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 9
        base = c if c is None else c - (abs(c) % 5 * (1 if c > 0 else -1))
        want[c] = told_.get(base, [])[:h] + own[h:]
    got = trie.prefix_trie(*spliced(trie.numbered(conversations(spark, rows)))).drop("node_1", "node_2").collect()
    assert Counter(map(tuple, got)) == Counter(expected_trie(want))


def test_one_hot_turn_and_repeated_rows(spark):
    rows = [(c, 1, "user", "same") for c in range(300)] + [(c, 2, "user", f"own {c}") for c in range(300)] + [(0, 1, "user", "same")]
    turns = trie.numbered(conversations(spark, rows))
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(turns, turns.select("conv")).collect()}
    assert got[0, 1].n_convs == 300 and got[0, 1].n_children == 300 and got[0, 0].n_leaves == 300
    assert got[0, 0].saved_tokens == 299 * 4 and got[0, 2].parent_conv_id == 0


def expected_mix(rows, weights, share, most, packet=256):
    """Targets by repeated resharing in fractions, packets sorted in one list."""
    docs = [(d, s, len((t or "").encode().split())) for d, t, s in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    budget, full = Fraction(share) * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        target = {s: Fraction(most * sizes[s]) if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return sizes, {s: float(t) for s, t in target.items()}, docs
        full |= set(above)


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 40)])
def test_mix(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_GROUP", 50)
    monkeypatch.setattr(mixing, "COPIES", 4)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 900)), rng.choice(["hot", "hot", "a", "b", None, "é"])) for i in range(240)]
    rows += [(7, "again " * 300, "b")] * 11 + [(None, "lost words here", None), (None, None, "a"), (999, "", "empty"), (5, "x " * 20_000, "long")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, size long, copies int, target int")
    sizes, target, plain = expected_mix(rows, weights, 1.5, 2)
    out, sent = mixing.mix(docs, weights)
    got = out.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(plain)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= len(sizes) for s in sizes)
    assert sum(taken.values()) == int(sum(target.values()) + 0.25)
    assert Counter(map(tuple, mixing.mix(docs, weights)[0].collect())) == Counter(map(tuple, got))
    # The mix lies gapless in order, each source's share is even along it, and every packet lies inside its text.
    parts = sorted(sent.collect(), key=lambda r: r.place)
    at, seen = 0, Counter()
    total = sum(target.values())
    for r in parts:
        assert r.place == at and 0 <= r.first_word and r.first_word + r.words <= r.size
        at += r.words
        seen[r.source] += r.words
    half = Counter()
    for r in parts:
        if r.place < at / 2:
            half[r.source] += r.words
    assert all(abs(half[s] - target[s] * (at / 2) / total) <= 3 * mixing.PACKET_WORDS for s in sizes)
    # The first pass follows the order of the ids' hashes.
    first = [r.doc_id for r in parts if r.source == "hot" and r.round == 0 and r.first_word == 0]
    assert first == sorted(first, key=lambda d: md5(f"13:0:{d}".encode()).hexdigest())


def test_mix_of_few_rows(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind), (5, 2, 1))[0].count() == 0
    only = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], kind), (5, 2, 1))[0].collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in only) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    table = spark.createDataFrame([("a", 1.0), (None, 3.0)], "source string, weight double")
    rows = spark.createDataFrame([(1, "w " * 400, "a"), (2, "w " * 400, None)], kind)
    assert {r.doc_id: r.taken for r in mixing.mix(rows, table, share=0.5)[0].collect()} == {1: 100, 2: 300}
