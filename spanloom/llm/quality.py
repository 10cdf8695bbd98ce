"""Quality rules with risk-controlled thresholds.

Every rule has a value per document and a ladder of cutoffs. A labelled holdout
tells, per stratum, how many good documents a cutoff would reject; an exact
binomial bound decides whether the true share may be claimed to lie under the
allowed risk. Cutoffs are tested from the most lenient on and the testing stops
at the first that fails (fixed-sequence testing); strata and rules share the
error probability evenly (Bonferroni). So with probability `1 - error`, no
stratum loses more than `risk` of its good documents, whatever cutoffs are used.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE, words
from spanloom.operators.scale import join_small
from spanloom.session import written

WINDOW = 5
# The bits of a place in an array; the others of a packed key are those of a hash.
PLACE = 2**31 - 1


def _per_mille(part: str, whole: str) -> Column:
    """A share in thousandths; 0 of nothing, as in a text without words (dividing by 0 is an error in Spark)."""
    return F.coalesce(F.floor(F.col(part) * 1000 / F.nullif(F.col(whole), F.lit(0))), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rules:
    """Rule values (higher is worse, in thousandths) and the ladder of cutoffs, most lenient first."""

    values: Mapping[str, tuple[str, str]] = field(default_factory=lambda: {
        "symbols": ("n_symbols", "word_chars"),
        "capitals": ("n_capitals", "word_chars"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
    })
    ladder: tuple[int, ...] = (900, 700, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)
    risk: float = 0.02
    error: float = 0.05


def with_repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words in place of `w`: the words of `w` in a five-word window that occurs twice or more.

    Only texts where two windows share a hash are looked at any further. Their
    windows are sorted by a shorter hash with their place packed in; equal
    neighbours are candidates, and those are compared by their words. Each step
    is a column of its own, since lambdas would compute an inlined one once per
    element.
    """
    others = [c for c in df.columns if c != "w"]
    starts = F.slice("w", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0)))
    hashed = df.select(*others, "w", F.transform(
        starts, lambda word, i: F.xxhash64(word, *[F.get("w", i + k) for k in range(1, WINDOW)])
    ).alias("hashes"))
    suspect = F.size(F.array_distinct("hashes")) < F.size("hashes")
    suspects = hashed.select(
        *others,
        F.when(suspect, F.col("w")).otherwise(F.array().cast("array<string>")).alias("w"),
        F.when(suspect, F.col("hashes")).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    keyed = suspects.select(*others, "w", F.sort_array(F.transform(
        "hashes", lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))
    )).alias("keys"))

    def group(key: Column) -> Column:
        return key.bitwiseAND(F.lit(~PLACE))

    likely = keyed.select(*others, "w", F.transform(
        F.filter("keys", lambda key, j: (group(key) == group(F.get("keys", j - 1))) | (group(key) == group(F.get("keys", j + 1)))),
        lambda key: key.bitwiseAND(F.lit(PLACE)),
    ).alias("places"))
    named = likely.select(*others, F.sort_array(F.transform("places", lambda place: F.struct(
        F.array_join(F.slice("w", place.cast("int") + 1, WINDOW), " ").alias("window"), place.alias("place"),
    ))).alias("windows"))

    def same(t: Column, j: Column) -> Column:
        return F.coalesce(t["window"] == F.get("windows", j)["window"], F.lit(False))

    places = F.sort_array(F.transform(
        F.filter("windows", lambda t, j: same(t, j - 1) | same(t, j + 1)), lambda t: t["place"]
    ))
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["last"])).alias("n"), p.alias("last")
        ),
        lambda s: s["n"],
    )
    return named.select(*others, covered.alias("n_repeat_words"))


def features(docs: DataFrame) -> DataFrame:
    """Counts over the whole text of each document.

    doc_id, stratum (the language, null: empty), n_words, word_chars, n_symbols,
    n_capitals, n_lines (with a word), n_dup_lines, n_repeat_words. Null text
    has none of anything; rows are kept as they are, repeated ones too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stratum = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    base = docs.select("doc_id", stratum.alias("stratum"), text.alias("text"))
    counted = base.select(
        "doc_id", "stratum", words(F.col("text")).alias("w"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    ).select(
        "doc_id", "stratum", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return with_repeat_words(counted)


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1: Stirling's series after a shift by eight. Exact to about 1e-12."""
    shift = sum((F.ln(x + k) for k in range(8)), F.lit(0.0))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to rounding.

    Summed downwards from k, where terms fall by at least the first ratio; the
    sum stops where the rest is below 1e-16 of it. At or above the mean: 1.
    """
    top = (
        log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * F.ln(p) + (n - k) * F.ln(1 - p)
    )
    odds = (1 - p) / p
    ratio = k / (n - k + 1) * odds
    needed = F.least(k, F.ceil(40 / -F.ln(F.greatest(ratio, F.lit(1e-300)))).cast("long") + 1)
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(needed, F.lit(1).cast("long"))),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, j: F.struct(
            (s["sum"] + s["term"]).alias("sum"), (s["term"] * ((k - j) / (n - k + j + 1) * odds)).alias("term")
        ),
        lambda s: s["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.exp(top) * terms, F.lit(1.0)))


def _rejected(quality: int) -> Column:
    """How many labelled documents of that quality the cutoff of a row rejects."""
    cells = F.filter("cells", lambda c: (c["quality"] == quality) & (c["top"] >= F.col("cutoff")))
    return F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c["n"])


def cutoffs(measured: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Certified cutoffs: (stratum, rule, cutoff), none where nothing can be certified.

    `measured` are rows of `features`, `labels` (doc_id, quality). A document
    labelled both ways counts as bad; null labels and ids are ignored. Of the
    certified cutoffs that reject most labelled bad documents the most lenient
    is taken: a stricter one would only cost good documents.
    """
    label = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = F.array(*[
        F.struct(F.lit(rule).alias("rule"), _per_mille(part, whole).alias("value"))
        for rule, (part, whole) in rules.values.items()
    ])
    ladder = F.array(*[F.lit(x).cast("long") for x in rules.ladder])
    histogram = (
        measured.join(label, "doc_id")
        .select("stratum", "quality", F.explode(values).alias("v"))
        .groupBy("stratum", "v.rule", "quality", F.get(F.filter(ladder, lambda t: t <= F.col("v.value")), 0).alias("_top"))
        .agg(F.count("*").alias("n"))
    )
    # From here on one row per stratum, rule and rung.
    by_rule = Window.partitionBy("stratum", "rule")
    down = by_rule.orderBy(F.desc("cutoff"))
    per_rung = (
        histogram.groupBy("stratum", "rule")
        .agg(
            F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"),
            F.collect_list(F.struct(F.col("_top").alias("top"), "quality", "n")).alias("cells"),
        )
        .withColumn("cutoff", F.explode(ladder))
        .select(
            "stratum", "rule", "good", "cutoff",
            _rejected(1).alias("lost"), _rejected(0).alias("caught"),
        )
    )
    strata = measured.select("stratum").distinct().count()
    return (
        per_rung.withColumn("level", F.lit(rules.error / max(1, strata * len(rules.values))))
        .withColumn("p", binomial_tail(F.col("lost"), F.col("good"), F.lit(rules.risk / len(rules.values))))
        .withColumn("worst", F.max("p").over(down))
        .filter(F.col("worst") <= F.col("level"))
        .withColumn("place", F.row_number().over(by_rule.orderBy(F.desc("caught"), F.desc("cutoff"))))
        .filter((F.col("place") == 1) & (F.col("caught") > 0))
        .select("stratum", "rule", "cutoff")
    )


def judged(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`features` of all documents with base_failed, failed_rules and kept.

    base_failed: fewer than ten words, or more than a fifth of them in repeated
    windows. A stratum without labels is judged by the base alone. An empty
    table gives no rows.
    """
    measured = written(features(docs), "quality")
    chosen = cutoffs(measured, labels, rules).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    strata = measured.select("stratum").distinct().join(chosen, "stratum", "left").select(
        "stratum", F.coalesce("cutoffs", F.create_map().cast("map<string,bigint>")).alias("cutoffs")
    )
    failed = F.array_compact(F.array(*[
        F.when(_per_mille(part, whole) >= F.element_at("cutoffs", F.lit(rule)), F.lit(rule))
        for rule, (part, whole) in rules.values.items()
    ]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = join_small(measured, strata, ["stratum"], "doc_id")
    return joined.select(*measured.columns, base.alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
