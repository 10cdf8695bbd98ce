"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; windows of what
remains are hashed and joined with those of the benchmark, so that a question is
found under other parameters too. Where a matched run has placeholders, their
values must be consistent: one value of the item stands for one value in the
document. Windows with a value that stands for several do not count. Items that
have no window are looked for as a whole, with their own values.

Documents meet the distinct windows of the benchmark first, then items, and
those by their rarer windows only: boilerplate that many items share makes no
pairs by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.scale import at_most, join_small
from spanloom.session import written

# Placeholders, one control character each; texts are rid of these first.
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
SLOT = "[\u0001-\u0003]"
# Units that count as such after a number.
UNITS = (
    "mm cm m km kilometers miles mile feet foot ft inches inch yards mg g kg kilograms grams pounds lb lbs tons ml l liters litres "
    "seconds second s minutes minute min hours hour h days day weeks week months month years year percent dollars usd eur euros cents "
    "hz khz mhz ghz kb mb gb tb w kw v kv a j kj mph kmh degrees"
).split()
NUMBER_PATTERN = r"\p{N}+(?:[.,:/]\p{N}+)*"
# A capitalised word inside a sentence.
NAME_PATTERN = r"(?<=[\p{Ll},;] )\p{Lu}\p{L}+"
UNIT_PATTERN = rf"(?<=\p{{N}} ?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
VALUE_PATTERN = f"{NAME_PATTERN}|{UNIT_PATTERN}|{NUMBER_PATTERN}"
# Scripts without spaces between words, a token per letter: Thai, Lao, Burmese, Khmer, kana, Chinese characters, Yi.
UNSPACED = (
    r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u312F\u31A0-\u9FFF\uA000-\uA4CF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF"
    r"\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
)
WORD_PATTERN = rf"[\p{{L}}&&[^{UNSPACED}]]+|[\p{{L}}&&[{UNSPACED}]]\p{{M}}*"
# Signs beside a number tell sums apart; elsewhere they are markup.
SIGN = r"[-+*/^=<>%\u00D7\u00F7\u2212\p{Sc}]"
SIGN_PATTERN = rf"(?<=\p{{N}} ?){SIGN}|{SIGN}(?= ?\p{{N}})"
WINDOW = 8
BROADCAST_ROWS = 1_000_000
# Tokens that a hit must have in a row before a stage may remove its document: one word is an answer, not a leak.
REMOVAL_TOKENS = 5
# What stands between the tokens of a text that is searched for a whole item; no token holds it.
BETWEEN = "\u0001"


@dataclass(frozen=True)
class Matching:
    """Tokens per window, how many of them must be words, and what makes a leak: a share of an item's windows, or tokens in a row."""

    window: int = WINDOW
    words: int = 4
    coverage: float = 0.3
    passage: int = 13

    @property
    def streak(self) -> int:
        """Consecutive windows that a passage has."""
        return max(1, self.passage - self.window + 1)

    def least(self, n_windows: Column) -> Column:
        """How many windows of an item a leak has at least."""
        return F.least(F.ceil(self.coverage * n_windows), F.lit(self.streak))

    def leaked(self, windows: Column, streak: Column) -> Column:
        return (windows >= self.coverage * F.col("n_windows")) | (streak >= self.streak)


def _clean(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(SLOT), F.regexp_replace(text, SLOT, " ")).otherwise(text)


def canonical_tokens(text: Column) -> Column:
    """Lower-case words and placeholders, in order."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NAME_PATTERN, NAME), UNIT_PATTERN, UNIT), NUMBER_PATTERN, NUMBER)
    return F.regexp_extract_all(F.lower(marked), F.lit(f"{WORD_PATTERN}|{SLOT}"), F.lit(0))


def exact_tokens(text: Column) -> Column:
    """Lower-case words, numbers and their signs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{NUMBER_PATTERN}|{WORD_PATTERN}|{SIGN_PATTERN}"), F.lit(0))


def slot_values(text: Column) -> Column:
    """What the placeholders of `canonical_tokens` stand for, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(VALUE_PATTERN), F.lit(0)), F.lower)


def _windows(tokens: str, window: int) -> Column:
    last = F.size(tokens) - window
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(window)])
    ))


def _slots_in(tokens: str, start: Column, count: Column) -> Column:
    return F.size(F.filter(F.slice(tokens, start, count), lambda t: t.rlike(SLOT)))


def item_windows(benchmark: DataFrame, matching: Matching) -> DataFrame:
    """(item, item_id, place, h, n_windows, slots): windows with words enough, with the offsets and values of their placeholders.

    `item` stands for an id with one of its texts.
    """
    tokens = benchmark.select("item_id", _clean(F.col("text")).alias("text")).select(
        F.xxhash64("item_id", "text").alias("item"), "item_id",
        canonical_tokens(F.col("text")).alias("tokens"), slot_values(F.col("text")).alias("all_values"),
    ).dropDuplicates(["item"])
    placed = tokens.select("*", F.posexplode(_windows("tokens", matching.window)).alias("place", "h"))
    before = _slots_in("tokens", F.lit(1), F.col("place"))
    inside = F.filter(
        F.sequence(F.lit(0), F.lit(matching.window - 1)), lambda k: F.get("tokens", F.col("place") + k).rlike(SLOT)
    )
    kept = placed.withColumn("inside", inside).filter(matching.window - F.size("inside") >= matching.words)
    slots = F.zip_with(
        "inside", F.slice("all_values", before + 1, F.size("inside")), lambda k, v: F.struct(k.alias("offset"), v.alias("value"))
    )
    rows = kept.select("item", "item_id", "place", "h", slots.alias("slots"))
    return rows.join(rows.groupBy("item").agg(F.count("*").alias("n_windows")), "item")


def seeds(items: DataFrame, matching: Matching) -> DataFrame:
    """(h, item): the windows by which documents find an item.

    A leak has so many windows of its item that it holds one besides the most
    shared ones, which are left out, one fewer than it needs.
    """
    shared = items.groupBy("h").agg(F.countDistinct("item").alias("_shared"))
    order = Window.partitionBy("item").orderBy(F.desc("_shared"), "place")
    return items.join(shared, "h").withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_rank") >= matching.least(F.col("n_windows"))
    ).select("h", "item").distinct()


def whole_items(benchmark: DataFrame, matching: Matching) -> DataFrame:
    """(item_id, n, head, h, phrase): the items without a window, in exact tokens, by a hash of their first `head` tokens.

    Those without a token are left out.
    """
    tokens = benchmark.select("item_id", _clean(F.col("text")).alias("text")).select(
        "item_id", canonical_tokens(F.col("text")).alias("tokens"), exact_tokens(F.col("text")).alias("exact")
    )
    last = F.size("tokens") - matching.window
    windowed = F.when(last < 0, F.lit(False)).otherwise(F.exists(
        F.sequence(F.lit(0), last),
        lambda i: matching.window - _slots_in("tokens", i + 1, F.lit(matching.window)) >= matching.words,
    ))
    head = F.least(F.size("exact"), F.lit(matching.window))
    return tokens.filter(~windowed & (F.size("exact") > 0)).select(
        "item_id", F.size("exact").alias("n"), head.alias("head"), F.xxhash64(F.slice("exact", F.lit(1), head)).alias("h"),
        _phrase("exact").alias("phrase"),
    ).dropDuplicates()


def _phrase(tokens: str) -> Column:
    return F.concat(F.lit(BETWEEN), F.array_join(tokens, BETWEEN), F.lit(BETWEEN))


def whole_leaks(texts: DataFrame, whole: DataFrame, heads: list[int], matching: Matching) -> DataFrame:
    """(doc_id, item_id, n) of the documents that hold all tokens of an item of `whole` in a row, values included.

    `heads` are the distinct numbers of tokens that are hashed, none above the
    window. Longer items are searched for in the documents that hold their head.
    """
    sized = texts.select("doc", "doc_id", exact_tokens(F.col("text")).alias("exact")).select(
        "doc", "doc_id", "exact", F.explode(F.filter(F.lit(heads), lambda n: n <= F.size("exact"))).alias("head")
    )
    # Each stretch once per text.
    stretches = sized.select("doc", "doc_id", "head", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("exact") - F.col("head") + 1), lambda i: F.xxhash64(F.slice("exact", i, F.col("head")))
    ))).alias("h"))
    met = written(
        join_small(stretches, whole, ["head", "h"], "doc", BROADCAST_ROWS).select("doc", "doc_id", "item_id", "n", "phrase").distinct(),
        "whole-hits",
    )
    out = ["doc_id", "item_id", "n"]
    short, long = met.filter(F.col("n") <= matching.window).select(*out), met.filter(F.col("n") > matching.window)
    if long.isEmpty():
        return short.distinct()
    wanted = long.select("doc").distinct()
    searched = texts.join(F.broadcast(wanted) if at_most(wanted, BROADCAST_ROWS) else wanted, "doc", "left_semi").select(
        "doc", exact_tokens(F.col("text")).alias("exact")
    ).select("doc", _phrase("exact").alias("all_tokens"))
    return short.union(
        long.join(searched, "doc").filter(F.col("all_tokens").contains(F.col("phrase"))).select(*out)
    ).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """One row per document and benchmark item it contains: doc_id, item_id, n_windows, n_matched, coverage, n_tokens, reparameterised.

    n_windows are the item's, n_matched those found whose placeholders are
    consistent over their run, coverage their share. It is at least that of
    `matching`, unless a passage of as many tokens as `matching` names is found
    in a row; n_tokens are those of the longest passage in a row.
    reparameterised tells that some placeholder of a matched window
    has another value than in the item. Items of fewer tokens than a window, or
    of placeholders mostly, have no windows: those are found as a whole with the
    values they have, which counts as one window. Items without any token are
    found nowhere. A short one is found wherever its words stand; its n_tokens
    tell, and a stage should remove nothing below REMOVAL_TOKENS.

    Null and empty texts contain nothing. Each text is judged by itself: rows
    with one doc_id, null included, are one document, items of one item_id one
    item, and the row is that of the text with most coverage. Repeated rows
    change nothing; items with equal texts are each reported. Other
    columns are left out, whatever their names. Empty tables give no rows.
    """
    items = written(item_windows(benchmark.select("item_id", "text"), matching), "item-windows")
    small = at_most(items, BROADCAST_ROWS)
    texts = docs.select("doc_id", _clean(F.col("text")).alias("text")).select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    windows = texts.select("doc", "doc_id", canonical_tokens(F.col("text")).alias("tokens")).select(
        "doc", "doc_id", F.posexplode(_windows("tokens", matching.window)).alias("at", "h")
    )
    # Which windows of the benchmark a document holds, and where: no more rows than it has tokens.
    found = written(
        join_small(windows, items.select("h").distinct(), ["h"], "doc", proven=small).select("doc", "doc_id", "at", "h").distinct(),
        "window-hits",
    )
    pairs = join_small(
        found.select("doc", "h").distinct(), seeds(items, matching), ["h"], "doc", proven=small
    ).select("doc", "item").distinct()
    placed = join_small(pairs, items, ["item"], "doc", proven=small).join(found, ["doc", "h"]).select(
        "doc", "doc_id", "item", "item_id", "n_windows", "place", "slots", (F.col("at") - F.col("place")).alias("run")
    )
    held = Window.partitionBy("doc", "item")
    runs = written(
        placed.withColumn("_n", F.size(F.collect_set("place").over(held))).filter(
            matching.leaked(F.col("_n"), F.col("_n"))
        ).drop("_n"), "runs",
    )
    place = ["doc", "item", "run", "place"]
    judged = runs.join(_consistency(texts, runs), place, "left").filter(F.coalesce("consistent", F.lit(True)))
    # Places in a row differ from their rank in the run by one number.
    run = ["doc", "item", "run"]
    ranked = judged.withColumn("_row", F.col("place") - F.row_number().over(Window.partitionBy(*run).orderBy("place")))
    streaks = ranked.withColumn("_streak", F.count("*").over(Window.partitionBy(*run, "_row")))
    by_windows = (
        streaks.groupBy("doc", "doc_id", "item", "item_id", "n_windows")
        .agg(
            F.countDistinct("place").alias("n_matched"), F.max(F.coalesce("changed", F.lit(False))).alias("reparameterised"),
            F.max("_streak").alias("_streak"),
        )
        .filter(matching.leaked(F.col("n_matched"), F.col("_streak")))
        .select(
            "doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
            (F.col("_streak") + matching.window - 1).alias("n_tokens"), "reparameterised",
        )
    )
    whole = whole_items(benchmark.select("item_id", "text"), matching)
    heads = sorted(r[0] for r in whole.select("head").distinct().collect())
    if heads:
        one = F.lit(1).cast("long")
        by_windows = by_windows.unionByName(whole_leaks(texts, whole, heads, matching).select(
            "doc_id", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("coverage"),
            F.col("n").cast("long").alias("n_tokens"), F.lit(False).alias("reparameterised"),
        ))
    best = F.max(F.struct("coverage", "n_windows", "n_matched", "n_tokens", "reparameterised")).alias("r")
    return by_windows.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "r.n_windows", "r.n_matched", "r.coverage", "r.n_tokens", "r.reparameterised"
    )


def _consistency(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per window with placeholders whether each of its item values stands for one value in the whole run, and whether any differs."""
    slots = runs.select("doc", "item", "run", "place", F.explode("slots").alias("s")).select(
        "doc", "item", "run", "place", (F.col("run") + F.col("place") + F.col("s.offset")).alias("at"), F.col("s.value").alias("mine")
    )
    wanted = written(slots.select("doc").distinct(), "slot-docs")
    if wanted.isEmpty():
        return slots.select("doc", "item", "run", "place", F.lit(True).alias("consistent"), F.lit(False).alias("changed"))
    read = texts.join(F.broadcast(wanted) if at_most(wanted, BROADCAST_ROWS) else wanted, "doc", "left_semi").select(
        "doc", canonical_tokens(F.col("text")).alias("tokens"), slot_values(F.col("text")).alias("all_values")
    )
    where = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i).rlike(SLOT))
    # A row per placeholder of a text, once for repeated rows.
    theirs = read.select("doc", F.explode(F.arrays_zip(where.alias("at"), F.col("all_values").alias("value"))).alias("v")).select(
        "doc", F.col("v.at").alias("at"), F.col("v.value").alias("theirs")
    ).distinct()
    value = Window.partitionBy("doc", "item", "run", "mine")
    each = slots.join(theirs, ["doc", "at"]).withColumn(
        "one", F.min("theirs").over(value).eqNullSafe(F.max("theirs").over(value))
    )
    return each.groupBy("doc", "item", "run", "place").agg(
        F.min("one").alias("consistent"), F.max(~F.col("theirs").eqNullSafe(F.col("mine"))).alias("changed")
    )
