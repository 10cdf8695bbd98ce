"""Packing, line dedup, language models, near duplicates, language labels and decontamination on small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import components, decontam, language, linededup, maxent, neardup, packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "doc_id long, text string, lang string, _doc int, n_lines int, key int, node int, chunk int, h int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[1] * 7)[:2] + ((r[2] if len(r) > 2 else None),) + (1,) * 6 for r in rows], EXTRA)


ODD = [(1, None), (2, ""), (3, " \n\t\n"), (None, "Lone text here"), (5, "word " * 4000), (6, "Same."), (6, "Same."), (7, "###"), (8, "é <|endoftext|> İx y\x1cz")]


@pytest.mark.parametrize("window", [8, 33, 64])
def test_plan_is_best_fit_decreasing(window):
    rng = random.Random(window)
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, window - 1), window // 3, 2]) for _ in range(rng.randint(0, 90))]
        left = []
        for s in sorted(sizes, reverse=True):
            fit = [(c, i) for i, c in enumerate(left) if c >= s]
            if fit:
                left[min(fit)[1]] -= s
            else:
                left.append(window - s)
        plan, windows = packing.planned(Counter(sizes), window)
        held = defaultdict(list)
        for size, _, pieces, first, each, offset in plan:
            for k in range(pieces):
                held[first + k // each].append((offset + k % each * size, size))
        for own in held.values():
            assert all(o == sum(s for _, s in sorted(own)[:i]) for i, (o, _) in enumerate(sorted(own)))
        assert sorted(window - sum(s for _, s in own) for own in held.values()) == sorted(left) and windows == len(left)


def test_words_encode_as_whole_texts():
    rng = random.Random(9)
    alphabet = list("aZ09 .,'!<|>\n\té\u00d7ßÜÿ") + ["'s", "'ll", "e\u0301", "Σ", "İ", "\u00a0", "\x1c", "\x01", "字", "<|endoftext|>", "½", "²", "ª"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encoder = packing.WordEncoder(TOKENIZER)
    assert encoder.splits
    for text, ids in zip(texts, encoder.encode([t.encode().split() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_are_encoded_once_and_a_full_cache_is_emptied(monkeypatch):
    encoder, seen = packing.WordEncoder(TOKENIZER), []
    learn = packing.WordEncoder.__missing__
    monkeypatch.setattr(packing.WordEncoder, "__missing__", lambda self, word: (seen.append(word), learn(self, word))[1])
    texts = [[b"Alpha", b"alpha.", b"x'll"], [], [b"alpha", b"Alpha"]]
    want = [np.array(encoder.tokenizer.encode(b" ".join(t).decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want
    assert len(seen) == len(set(seen)), "pieces are words, each is encoded once"
    monkeypatch.setattr(packing, "CACHED_WORDS", 2)
    assert encoder.encode(texts) == want and len(seen) == 2 * len(set(seen))


def test_packing(spark):
    rng = random.Random(1)
    rows = ODD + [(i, " ".join(rng.choice(["alpha", "Béta", "12,5", "x'll"]) for _ in range(rng.randint(0, 90)))) for i in range(100, 300)]
    out = packing.packed(table(spark, rows), TOKENIZER, window=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    places = defaultdict(list)
    found = Counter()
    for r in out:
        ids = next(w for w in want[r.doc_id] if len(w) == r.doc_tokens)[r.start : r.start + r.length]
        assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id] += r.length
    assert found == Counter({d: sum(map(len, w)) for d, w in want.items()})
    for own in places.values():
        assert all(o == sum(n for _, n in sorted(own)[:i]) for i, (o, _) in enumerate(sorted(own)))
        assert sum(n for _, n in own) <= 64
    assert sorted(places) == list(range(len(places)))
    assert packing.packed(table(spark, ODD).limit(0), TOKENIZER).count() == 0


def brute_dedup(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = defaultdict(set)
    order = lambda d: -(2**63) if d is None else d
    for d, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(order(d))
    drop = lambda d, x: len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != order(d)
    return Counter((d, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not drop(d, x))) for d, t in rows)


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [f"Line {i} é" for i in range(12)] + ["ab", " LINE 1 é\t"]
    rows = ODD + [(rng.randint(10, 60), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for _ in range(60)]
    out = linededup.deduplicated(table(spark, rows), min_chars=5, min_docs=3).collect()
    assert Counter((r.doc_id, r.n_lines, r.text) for r in out) == brute_dedup(rows, 5, 3)
    assert out[0].key == 1 and linededup.deduplicated(table(spark, rows).limit(0)).count() == 0


def test_line_runs_merge(spark):
    runs = linededup.LineRuns(spark, 2, fan_in=2)
    for i in range(5):
        batch = spark.createDataFrame([(b"a", 1, 10 - i), (bytes([i]), 2, 10 - i)], "key binary, n_docs long, keeper long")
        new = {bytes(r.key) for r in (runs.unseen(batch).collect() if i else [])}
        assert not i or new == {bytes([i])}
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = {bytes(r.key): (r.n_docs, r.keeper) for r in runs.merged().collect()}
    assert merged == {b"a": (5, 10), **{bytes([i]): (2, 10 - i) for i in range(5)}}
    plan = runs.unseen(spark.table(runs.runs()[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_scores(spark):
    rng = random.Random(4)
    rows = ODD + [(i, " ".join(rng.choice(["The", "cat", "sat", "on", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(1, 40)))) for i in range(100, 200)]
    out = maxent.scored(table(spark, rows), maxent.Settings(classes=8, top_words=3, slots=64, epochs=8)).collect()
    tokens = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t))
    want = Counter((d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base(t), 6)) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert maxent.scored(table(spark, rows).limit(0)).count() == 0
    alone = maxent.scored(table(spark, [(2, "no training text")]).filter(F.crc32(F.col("doc_id").cast("string")) >= 0)).first()
    assert alone.base_score <= 0 and alone.score <= 0


def test_score_knows_words_before(spark):
    rng = random.Random(8)
    # Eight words that share an ending, so one class: each is followed by one of its own, in a corpus of noise.
    words = [f"{c}abcing" for c in "bdfgklmn"]
    follows = dict(zip(words, words[3:] + words[:3]))
    skips = dict(zip(words, words[5:] + words[:5]))
    pair = lambda: (lambda w: f"{w} {follows[w]}")(rng.choice(words))
    spaced = lambda: (lambda w: f"{w} zz{rng.randint(0, 9)}ing {skips[w]}")(rng.choice(words))
    rows = [(i, " the ".join(rng.choice([pair, spaced])() for _ in range(8))) for i in range(100, 400)]
    tried = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    a, b = words[:2]
    asked = [f"the {a} {follows[a]}", f"the {a} {follows[b]}", f"the {a} zznewing {skips[a]}", f"the {a} zznewing {skips[b]}"]
    for settings in (maxent.Settings(top_words=3, classes=8, slots=64), maxent.Settings(top_words=3, classes=8, slots=64, part_tokens=300, most_parts=4)):
        found = {r.doc_id: r for r in maxent.scored(table(spark, rows + list(zip(tried, asked))), settings).collect()}
        seen, swapped, skipped, other = (found[i].score for i in tried[:4])
        assert seen > swapped + 0.5 and skipped > other + 0.3
        texts = dict(rows)
        counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), ""])
        want = lambda t: sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in [*t.split(), ""])
        assert all(abs(found[i].base_score - want(texts[i])) < 1e-6 for i in texts)


def test_word_model_is_normalised(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(20):
        n_words, n = int(rng.integers(2, 9)), int(rng.integers(2, 120))
        word, before, skipped = rng.integers(0, n_words, n), rng.integers(0, 4, n) + 7, rng.integers(0, 4, n) + 5
        learnt = rng.random(n) < (0.8 if trial else 0)
        families, made = [], maxent._Family
        monkeypatch.setattr(maxent, "_Family", lambda *x: families.append(made(*x)) or families[-1])
        monkeypatch.setattr(maxent, "MEETINGS", 3 if trial % 2 else 1_000_000)
        counts, logs = maxent.word_model(word, before, skipped, learnt, n_words, maxent.Settings())
        monkeypatch.undo()
        weights = [dict(zip(f.keys.tolist(), f.weights)) for f in families]
        pairs = np.unique(before << 32 | skipped).tolist()
        size = counts.sum() + np.count_nonzero(counts) + 1
        for b, s, w, log in zip(before.tolist(), skipped.tolist(), word.tolist(), logs):
            contexts = b, s, pairs.index(b << 32 | s)
            mass = [(counts[v] + 1) / size * math.exp(sum(d.get(c << 32 | v, 0) for d, c in zip(weights, contexts))) for v in range(n_words)]
            total = 1 / size + sum(m for m, c in zip(mass, counts) if c)
            assert abs(math.log(mass[w] / total) - log) < 1e-9


def test_numbers_pack():
    arrays = [np.array(x, np.int64) for x in ([], [0, 255], [1 << 16, 3], [1 << 24], [1 << 39, 7], [1 << 47], [1 << 55], [5 << 32])]
    assert [x.tolist() for x in maxent._numbers(maxent._numbers_packed(arrays))] == [x.tolist() for x in arrays]


def test_ids_pack():
    for ids in (np.zeros(0, np.int32), np.array([0, 65534, 65535, 65536, 1, 3_000_000], np.int32)):
        assert maxent._ids(maxent._packed(ids)).tolist() == ids.tolist()


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    settings = maxent.Settings(classes=6, top_words=2, slots=16)
    p = np.exp(maxent.log_softmax(rng.normal(size=(16, 6)), maxent.feature_slots(settings)))
    assert np.allclose(p.sum(axis=1), 1) and p.shape == (36, 6)
    codes = maxent.contexts(np.array([3, 4, 0, 5, 0, 0]), np.array([3, 2, 1]), 6)
    assert codes.tolist() == [0, 18, 27, 0, 30, 0]


def brute_links(rows, threshold=0.8):
    grams = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        grams.setdefault(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = sorted(grams)
    near = {a: {b for b in ids if b != a and grams[a] and len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b])} for a in ids}
    root = {a: a for a in ids}
    for _ in ids:
        root = {a: min([root[a], *[root[b] for b in near[a]]]) for a in ids}
    return {a: (root[a], min([a, *[b for b in near[a] if grams[a] == grams[b]]]), len(near[a])) for a in ids}


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates(spark, monkeypatch, blocks):
    if blocks:  # components in several blocks
        monkeypatch.setattr(neardup, "BLOCK_SETS", 7)
        monkeypatch.setattr(neardup, "BLOCK_GRAMS", 900)
    rng = random.Random(6)
    rows = [r for r in ODD if r[0] not in (6, None)] + [(6, "Same."), (9, "same."), (11, "")]
    for base in range(4):
        words = [f"b{base}w{rng.randint(0, 400)}" for _ in range(150)]
        for k in range(25):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 8])):
                own[rng.randrange(150)] = f"x{rng.random()}"
            rows.append((100 + 40 * base + k, " ".join(own)))
    out = {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in neardup.linked(table(spark, rows)).collect()}
    assert out == brute_links(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    out = Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.linked(table(spark, rows)).collect())
    assert out == Counter({(4, None, 2): 2, (None, None, 2): 1, (None, None, 0): 1})
    assert neardup.linked(table(spark, rows).limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = neardup.bands_for(0.8, 0.999999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999999 and bands * rows <= neardup.MAX_HASHES
    with pytest.raises(ValueError):
        neardup.bands_for(0.1, 0.999999, 16)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)] + [(200, x) for x in range(201, 230)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{i: 200 for i in range(200, 230)}}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths, many = np.array([1, 4, 2]), 3
    scores, moves = rng.normal(size=(7, many)), rng.normal(size=(many, many))
    found, expected = language.posteriors(scores, lengths, moves, pairs=True)
    at, sums = 0, np.zeros((many, many))
    for n in lengths:
        paths = list(np.ndindex(*[many] * n))
        weight = np.array([np.exp(sum(scores[at + t, p[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            assert np.allclose(found[at + t], [weight[[p[t] == k for p in paths]].sum() for k in range(many)])
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                sums[a, b] += w
        at += n
    assert np.allclose(expected, sums)


def test_language(spark):
    rng = random.Random(8)
    stems = {"en": ["the", "thing", "house", "with"], "fr": ["été", "leçon", "eau", "très"], "de": ["über", "straße", "und", "nicht"]}
    line = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "."]) for _ in range(n))
    rows = [(i, f"{line(lang, 12)}\n{line(lang, 9)}", lang) for i, lang in enumerate(list(stems) * 30)]
    docs = table(spark, rows)
    model = language.learned(docs)
    assert model.labels == ["de", "en", "fr"]
    mixed = f"{line('en', 20)} {line('fr', 9)}"
    odd = table(spark, [(900, mixed), *ODD, *[(1000 + i, line(lang, 15)) for i, lang in enumerate(stems)]])
    out = language.labelled(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r for r in out}
    assert [by_id[1000 + i].lang_pred for i in range(3)] == list(stems)
    assert by_id[900].lang_pred == "en" and [r.lang for r in by_id[900].runs] == ["en", "fr"] and abs(by_id[900].runs[0].last - 20) <= 1
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 7))
    nothing = language.learned(docs.limit(0))
    assert {r.lang_pred for r in language.labelled(odd, nothing).collect()} == {"und"}
    assert language.labelled(docs.limit(0), model).count() == 0


def test_decontamination(spark):
    item = "A train leaves the old station at 50 km per hour while Anna waits for exactly 50 minutes near the river"
    filler = "Some other words that have nothing to do with it at all stand here and go on"
    docs = [
        *ODD, (10, f"{filler}. {item}. {filler}"), (11, item.replace("50", "75").replace("Anna", "Berta")), (12, item.replace("50 km", "75 km")),
        (13, filler), (14, item.upper()), (15, " ".join(item.split()[:9])), (None, f"{item}, {filler}"), (16, item), (16, item),
    ]
    benchmark = spark.createDataFrame([(1, item, 1), (2, "too short", 1), (3, None, 1), (None, filler.lower(), 1)], "item_id long, text string, h int")
    out = {(r.doc_id, r.item_id): r for r in decontam.leaks(table(spark, docs), benchmark).collect()}
    assert {k for k in out if k[1] == 1} == {(10, 1), (11, 1), (14, 1), (None, 1), (16, 1)}
    assert {d for d, i in out if i is None} == {10, 13, None}
    assert out[11, 1].reparameterised and not out[10, 1].reparameterised and out[10, 1].coverage > 0.8
    assert decontam.leaks(table(spark, docs).limit(0), benchmark).count() == 0
    assert decontam.leaks(table(spark, docs), benchmark.limit(0)).count() == 0


def test_canonical_tokens_match_their_values(spark):
    text = "It took Anna 3.5 km, then Bob 20 minutes; 7% of\u0001 it. Then 5km"
    clean = decontam._clean(F.lit(text))
    row = spark.range(1).select(decontam.canonical_tokens(clean).alias("t"), decontam.slot_values(clean).alias("v")).first()
    assert sum(t in "\u0001\u0002\u0003" for t in row.t) == len(row.v)
    assert list(row.v) == ["anna", "3.5", "km", "bob", "20", "minutes", "7", "5", "km"]


def test_language_sample_is_bounded(spark):
    rows = [(1, f"Zeile {i} mit eigenen Worten " + "x" * 50_000, "de") for i in range(400)] + [(2, "a line of its own", "en"), (None, "one more line", "en"), (3, None, "en")]
    seen = []
    held, language.fitted = language.fitted, lambda lines, training: seen.extend(lines)
    try:
        language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Training(documents=20))
    finally:
        language.fitted = held
    assert len([x for x in seen if x[0] == "de"]) == 20 and max(len(x[1]) for x in seen) == 10_000
    assert {x[1] for x in seen if x[0] == "en"} == {"a line of its own", "one more line"}
    many = spark.range(501).select("id", F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError, match="languages"):
        language.learned(many)
