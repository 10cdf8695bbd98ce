"""Leaks of benchmark items with conflicting placeholders, without windows and in excerpts."""

import random

from spanloom.llm import decontam

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def found(spark, docs, items):
    out = decontam.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    return {(r.doc_id, r.item_id): r for r in out}


def test_a_conflict_costs_its_own_windows_only(spark):
    rest = "while all the others keep walking along the quiet shore and talk about what they had seen there before"
    item = f"The boat goes on for 50 km and then for 50 minutes {rest}"
    out = found(spark, [(1, item.replace("50 km", "75 km")), (2, item), (3, item.replace("50", "75"))], [(1, item)])
    assert set(out) == {(1, 1), (2, 1), (3, 1)}
    # 31 tokens, so 24 windows; the first 11 hold token 6 or 11, the two numbers.
    assert [(out[d, 1].n_windows, out[d, 1].n_matched, out[d, 1].reparameterised) for d in (1, 2, 3)] == [
        (24, 13, False), (24, 24, False), (24, 24, True)
    ]


def test_items_without_a_window_are_found_whole(spark):
    sums, names = "12 + 7 = 19", "Only Anna, Berta, Carl, Dora, Emil, Frida and Gustav"
    zh = "今天天气很好我们去公园散步然后回家吃饭"
    items = [(1, "What is the Capital of France?"), (2, sums), (3, names), (4, zh), (5, "?!"), (6, None), (None, "Lone item")]
    docs = [
        (1, "He asked: what is the capital of france? Paris"), (2, f"so {sums}, and"), (3, "so 12 - 7 = 19"), (4, "so 12 + 7 = 195"),
        (5, f"so.\n{names.lower()}"), (6, names.replace("Carl", "Karl")), (7, f"他说{zh}。"), (8, "the capital of france"),
        (None, "**Lone** item"), (9, None), (10, ""), (11, zh[2:16]), (12, "stand-alone items"),
    ]
    out = found(spark, docs, items)
    assert set(out) == {(1, 1), (2, 2), (5, 3), (7, 4), (11, 4), (None, None)}
    assert (out[1, 1].n_windows, out[1, 1].n_matched, out[1, 1].coverage, out[1, 1].reparameterised) == (1, 1, 1.0, False)
    assert out[7, 4].n_windows == out[7, 4].n_matched == len(zh) - 7


def test_an_id_of_several_texts_is_one_item(spark):
    long = "all of these are plain words that make more than one window"
    out = found(spark, [(1, long), (2, "short text"), (3, f"{long} short text")], [(1, long), (1, "short text")])
    assert set(out) == {(1, 1), (2, 1), (3, 1)} and out[3, 1].n_windows == 5


def test_a_passage_of_a_long_item_is_a_leak(spark):
    words = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    item = " ".join(words)
    part = lambda first, n: " ".join(words[first : first + n])
    docs = [(1, f"so {part(20, 13)} it is"), (2, f"so {part(20, 12)} it is"), (3, f"{part(20, 10)} and {part(60, 10)}"), (4, item)]
    out = found(spark, docs, [(1, item)])
    assert set(out) == {(1, 1), (4, 1)} and (out[1, 1].n_windows, out[1, 1].n_matched) == (133, 6)


def pieces(rng, n, vocabulary):
    """Tokens as written, as placeholders and as values: numbers, units after a number, names after a word."""
    out = [("so", "so", None)]
    while len(out) < n:
        draw = rng.random()
        if draw < 0.1:
            number = str(rng.randint(1, 4))
            out.append((number, decontam.NUMBER, number))
            if rng.random() < 0.5:
                unit = rng.choice(["km", "kg"])
                out.append((unit, decontam.UNIT, unit))
        elif draw < 0.2 and out[-1][1].isalpha():
            name = rng.choice(["Anna", "Berta", "Carl"])
            out.append((name, decontam.NAME, name.lower()))
        else:
            word = rng.choice(vocabulary)
            out.append((word, word, None))
    return out


def changed(rng, tokens):
    """The tokens with some values, and sometimes one word, replaced."""
    swap = {v: rng.choice("56789") for v in "1234"} if rng.random() < 0.5 else {}
    out = [(swap.get(w, w), t, swap.get(v, v)) for w, t, v in tokens]
    if rng.random() < 0.4:
        numbers = [i for i, x in enumerate(out) if x[1] == decontam.NUMBER]
        if numbers:
            out[rng.choice(numbers)] = ("77", decontam.NUMBER, "77")
    if rng.random() < 0.5:
        words = [i for i, x in enumerate(out) if x[2] is None]
        if words:
            out[rng.choice(words)] = ("other", "other", None)
    return out


def by_force(doc, item):
    """The row of a document and an item, or none, from their tokens alone."""
    window, shape, mine = 8, [t for _, t, _ in doc], [t for _, t, _ in item]
    places = [p for p in range(len(mine) - 7) if sum(x[2] is not None for x in item[p : p + window]) <= 4]
    if not places:
        words, own = [w.lower() for w, _, _ in doc], [w.lower() for w, _, _ in item]
        held = any(words[i : i + len(own)] == own for i in range(len(words) - len(own) + 1))
        return (1, 1, 1.0, len(own), False) if held else None
    runs = {}
    for p in places:
        for at in range(len(shape) - 7):
            if shape[at : at + window] == mine[p : p + window]:
                runs.setdefault(at - p, set()).add(p)
    matched, streak, differs = set(), 0, False
    for shift, held in runs.items():
        meaning = {}
        for q in {q for p in held for q in range(p, p + window) if item[q][2] is not None}:
            meaning.setdefault(item[q][2], set()).add(doc[q + shift][2])
        good = {p for p in held if all(len(meaning[item[q][2]]) == 1 for q in range(p, p + window) if item[q][2] is not None)}
        differs |= any(item[q][2] != doc[q + shift][2] for p in good for q in range(p, p + window))
        matched |= good
        for p in good:
            n = 0
            while p + n in good:
                n += 1
            streak = max(streak, n)
    if matched and (len(matched) >= 0.3 * len(places) or streak >= 6):
        return (len(places), len(matched), len(matched) / len(places), streak + 7, differs)
    return None


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [pieces(rng, rng.choice([5, 12, 20, 45]), ["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(25)]
    boilerplate = pieces(rng, 11, ["which", "of", "these", "is", "right"])
    items += [boilerplate + pieces(rng, rng.choice([12, 30]), ["mn", "op", "qr", "st"]) for _ in range(25)]
    items += [pieces(rng, 4, ["short", "question", "here"]) for _ in range(6)]
    items += [[(str(k), decontam.NUMBER, str(k)) for k in range(i, i + 12)] for i in (3, 5)] + [items[0], items[-1]]
    docs = [boilerplate] + [pieces(rng, 6, ["uv"])[:1] + x + [("yz", "yz", None)] for x in items if len(x) < 8] + [pieces(rng, rng.choice([3, 60]), ["ab", "cd", "ef", "gh"]) for _ in range(20)]
    for _ in range(300):
        chosen = rng.choice(items)
        first = rng.randrange(max(1, len(chosen) // 2))
        part = changed(rng, chosen[first : first + rng.choice([10, 16, 60])])
        docs.append(pieces(rng, rng.randint(1, 20), ["uv", "wx"])[:-1] + [("yz", "yz", None)] + part + pieces(rng, 5, ["uv"]))
    # A name is one only after a word: cutting an item may leave it after a number, which the tokens of a document can't hold.
    sound = lambda d: all(x[1] != decontam.NAME or i and d[i - 1][1] != decontam.NUMBER for i, x in enumerate(d))
    docs = [d for d in docs if sound(d) and all(x[1] != decontam.UNIT or d[i - 1][1] == decontam.NUMBER for i, x in enumerate(d))]
    text = lambda d: " ".join(w for w, _, _ in d)
    out = found(spark, [(i, text(d)) for i, d in enumerate(docs)], [(i, text(x)) for i, x in enumerate(items)])
    wanted = {(i, k): by_force(d, x) for i, d in enumerate(docs) for k, x in enumerate(items)}
    wanted = {pair: row for pair, row in wanted.items() if row}
    assert {k: (r.n_windows, r.n_matched, r.coverage, r.n_tokens, r.reparameterised) for k, r in out.items()} == wanted
    rows = list(wanted.values())
    assert len(rows) > 100
    assert any(r[4] for r in rows) and any(r[2] < 0.3 for r in rows) and any(r[3] < 8 for r in rows)


def test_boilerplate_makes_no_pairs_by_itself(spark):
    words = lambda i, n: " ".join(f"{a}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for a in "bcdfghjklmnpqrstvwxz"[:n])
    shared = "which of the following answers is the right"
    items = spark.createDataFrame([(i, f"{shared} {words(i, 18)}") for i in range(40)], ITEM)
    windows = decontam.item_windows(items, decontam.Matching())
    common = windows.groupBy("h").count().filter("count = 40")
    assert common.count() == 1 and decontam.seeds(windows, decontam.Matching()).join(common, "h").count() == 0
    assert not found(spark, [(1, shared), (2, f"so {shared} one")], [(r.item_id, r.text) for r in items.collect()])


def test_texts_of_one_id_are_judged_apart(spark):
    item = "these are plain words of a question that goes on for twenty three words so that halves of it do not suffice at all"
    half = item.split()
    docs = [(None, " ".join(half[:9])), (None, " ".join(half[11:20])), (1, None), (2, item), (2, "other text"), (2, item)]
    out = found(spark, docs, [(1, item), (2, item), (1, item), (None, item)])
    assert set(out) == {(2, 1), (2, 2), (2, None)} and out[2, 1].n_tokens == len(half)


def test_the_stage_keeps_documents_with_a_short_answer(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "Paris", 1), (2, "What is the capital of France?", 1)]
    spark.createDataFrame(rows, "item_id long, text string, n_chars int").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(
        [(1, "He went to Paris", "en", "a", 16, 1), (2, "So what is the capital of France", "en", "a", 32, 1), (None, None, None, None, None, 1)],
        "doc_id long, text string, lang string, source string, n_chars long, item_id int",
    )
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {1, None} and kept.columns == list(corpus_pipeline.COLUMNS)
