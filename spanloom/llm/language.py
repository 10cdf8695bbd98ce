"""Language identification with a linear-chain conditional random field.

Every word of a line gets a language. Emissions sum hashed features of the word
(affixes, character n-grams, the word itself as a lexicon entry), transitions
are learned too, and forward-backward gives each word's distribution. So text
that switches its language inside a line is labelled word by word; a document's
language is the one with most of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import slices_of

SLOTS = 1 << 16
UNKNOWN = "und"
# Kept small: workers are reused, and keep the peak of each stage they ran.
CHUNK_BYTES = 400_000
NOT_LETTERS = regex.compile(r"[^\p{L}\n]+")
STEP = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Training:
    """The bounded sample and how the model is fitted.

    At most `labels` languages, and per language `documents` rows of `lines`
    lines of `line_chars` characters go to the driver.
    """

    labels: int = 500
    documents: int = 250
    lines: int = 3
    line_chars: int = 10_000
    words: int = 40
    epochs: int = 3
    batch: int = 64
    rate: float = 0.3
    ridge: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    """Labels with their feature weights and transition scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def _slot(value: np.ndarray, kind: int) -> np.ndarray:
    """16-bit slots of feature values; `kind` keeps the kinds of features apart."""
    mixed = (value + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of every feature of many words at once; a word without a letter owns none.

    Of a word's letters in lower case: the whole, prefixes of up to three and
    suffixes of up to four, and all pairs and triples between a start and an end mark.
    """
    letters = NOT_LETTERS.sub("", "\n".join(words).lower()).split("\n")
    some = np.flatnonzero(np.fromiter(map(bool, letters), bool, len(letters)))
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join([f"^{w}$" for w in letters if w])
    code = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) for w in letters if w), np.int64, len(some)) + 2
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(some)), size)
    place = np.arange(len(code)) - start[word]
    left = size[word] - place
    power = np.cumprod(np.full(size.max(), STEP, np.uint64))
    owners, slots = [np.arange(len(some))], [_slot(np.add.reduceat(code * power[place], start), 1)]
    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        owners.append(word[at])
        slots.append(_slot(sum(code[at + j] * power[j] for j in range(k)), 1 + k))
    for kind, longest, first, way in ((10, 3, start + 1, 1), (20, 4, start + size - 2, -1)):
        value = np.zeros(len(some), np.uint64)
        for k in range(longest):
            there = size - 2 > k
            value[there] += code[first[there] + way * k] * power[k]
            owners.append(np.flatnonzero(there))
            slots.append(_slot(value[there], kind + k))
    return some[np.concatenate(owners)], np.concatenate(slots)


def posteriors(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Label distributions of all words of sequences laid end to end, none empty; with `pairs` the expected transitions.

    All sequences take a step together, the longest first, so that those still
    running are the first rows.
    """
    n, many = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max())
    running = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -50))
    move = np.exp(transitions)
    ahead, behind = np.empty((n, many)), np.ones((n, many))
    a = emit[starts] / emit[starts].sum(axis=1, keepdims=True)
    ahead[starts] = a
    for t in range(1, longest):
        at = starts[: running[t]] + t
        a = (a[: running[t]] @ move) * emit[at]
        a /= a.sum(axis=1, keepdims=True)
        ahead[at] = a
    for t in range(longest - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        b = (emit[at + 1] * behind[at + 1]) @ move.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both, None
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inner)
    joint = ahead[at][:, :, None] * move * (emit * behind)[at + 1][:, None, :]
    return both, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fitted(lines: list[tuple[str, str]], training: Training = Training()) -> Model:
    """A model from (language, line) rows.

    Lines are cut into runs of words; sequences are drawn of one to three runs,
    of any languages, so that transitions see switches too. Adagrad on the
    log-likelihood.
    """
    labels = sorted({lang for lang, _ in lines})
    model = Model(labels, np.zeros((SLOTS, len(labels))), np.zeros((len(labels), len(labels))))
    if not labels:
        return model
    rng = np.random.default_rng(training.seed)
    runs = []
    for lang, line in sorted(lines):
        words = line.split()
        runs += [(labels.index(lang), words[i : i + training.words]) for i in range(0, len(words), training.words)]
    distinct = {w: i for i, w in enumerate(sorted({w for _, run in runs for w in run}))}
    owner, slot = word_features(list(distinct))
    order = np.argsort(owner, kind="stable")
    own_slots, own_sizes = slot[order], np.bincount(owner, minlength=len(distinct))
    own_starts = np.cumsum(own_sizes) - own_sizes
    squares, moved = np.full_like(model.weights, 1e-8), np.full_like(model.transitions, 1e-8)
    for _ in range(training.epochs):
        shuffled = [runs[i] for i in rng.permutation(len(runs))]
        ends = np.cumsum(rng.integers(1, 4, len(runs)))
        sequences = [s for s in (shuffled[a:b] for a, b in zip([0, *ends], ends)) if s]
        for at in range(0, len(sequences), training.batch):
            batch = sequences[at : at + training.batch]
            words = [w for s in batch for _, run in s for w in run]
            truth = np.concatenate([np.full(len(run), label) for s in batch for label, run in s])
            lengths = np.array([sum(len(run) for _, run in s) for s in batch])
            known = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
            sizes = own_sizes[known]
            owner = np.repeat(np.arange(len(words)), sizes)
            slots = own_slots[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - own_starts[known], sizes)]
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            scores = np.zeros((len(words), len(labels)))
            np.add.at(scores, owner, model.weights[slots])
            found, expected = posteriors(scores * scale[:, None], lengths, model.transitions, pairs=True)
            miss = -found
            miss[np.arange(len(words)), truth] += 1
            used, where = np.unique(slots, return_inverse=True)
            gradient = np.zeros((len(used), len(labels)))
            np.add.at(gradient, where, (miss * scale[:, None])[owner])
            gradient -= training.ridge * model.weights[used]
            squares[used] += gradient**2
            model.weights[used] += training.rate * gradient / np.sqrt(squares[used])
            inner = np.ones(len(words), bool)
            inner[np.cumsum(lengths) - 1] = False
            pairs = np.flatnonzero(inner)
            step = -expected
            np.add.at(step, (truth[pairs], truth[pairs + 1]), 1)
            moved += step**2
            model.transitions += training.rate * step / np.sqrt(moved)
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    """Applies a model to many texts at a time; every distinct word is looked at once."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores per word, and which words have a letter."""
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        owner, slots = word_features(list(distinct))
        sizes = np.bincount(owner, minlength=len(distinct))
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        table = np.stack([
            np.bincount(owner, self.model.weights[slots, k], len(distinct)) * scale for k in range(len(self.model.labels))
        ], axis=1)
        places = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
        return table[places], (sizes > 0)[places]

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Per text its language, that one's share of the words with a letter, and the runs of words of one language."""
        lines = [[x for x in (line.split() for line in text.split("\n")) if x] for text in texts]
        words = [w for text in lines for line in text for w in line]
        counts = np.array([sum(map(len, text)) for text in lines])
        if not words or not self.model.labels:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        scores, letters = self.emissions(words)
        found, _ = posteriors(scores, np.array([len(line) for text in lines for line in text]), self.model.transitions)
        ends = np.cumsum(counts)
        best = found.argmax(axis=1)
        labels, out = self.model.labels, []
        for begin, end in zip(ends - counts, ends):
            own = letters[begin:end]
            if not own.any():
                out.append((UNKNOWN, 0.0, []))
                continue
            shares = found[begin:end][own].mean(axis=0)
            top = int(shares.argmax())
            turns = np.flatnonzero(np.diff(best[begin:end])) + 1
            runs = [(int(a), int(b), labels[best[begin + a]]) for a, b in zip([0, *turns], [*turns, end - begin])]
            out.append((labels[top], float(min(1.0, shares[top])), runs))
        return out


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds).cast("int")


def learned(docs: DataFrame, training: Training = Training()) -> Model:
    """A model from a bounded sample of rows with a language: rows by the least hash of id and text, lines by their own.

    Rows that share an id are rows like others, and repeated lines count once.
    More than `training.labels` languages are refused: each costs a column of
    weights. Without labelled rows the model has no labels.
    """
    known = docs.filter("lang is not null").select("doc_id", "lang", "text")
    labels = known.select("lang").distinct().limit(training.labels + 1).count()
    if labels > training.labels:
        raise ValueError(f"more than {training.labels} languages: raise Training.labels or clean the column")
    by_lang = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = (
        known.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
        .withColumn("_n", F.row_number().over(by_lang)).filter(F.col("_n") <= training.documents).select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), "_h")
    ).distinct()
    letters = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\p{L}"))
    hashed = F.slice(F.array_sort(F.transform(letters, lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.substring(x, 1, training.line_chars).alias("line")
    ))), 1, training.lines)
    # At most `documents` rows per language on one side; an id may have any number of rows on the other.
    found = known.join(
        F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("lang") == F.col("_l"))
    ).select("lang", "_h", F.xxhash64("text").alias("_t"), hashed.alias("lines")).distinct()
    by_hash = Window.partitionBy("lang").orderBy("_h", "_t", "lines")
    rows = found.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= training.documents).select(
        "lang", F.explode("lines.line").alias("line")
    ).distinct()
    return fitted([(r[0], r[1]) for r in rows.collect()], training)


LABEL_TYPE = "doc_id long, lang_pred string, score double, runs array<struct<first:int,last:int,lang:string>>"


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """Language, its share of the words, and the runs of words of one language, for every whole text.

    `und` with score 0 and no runs where the text is null or has no letter, or
    the model has no labels. Only the text is looked at; one row per row of
    `docs`, repeated ones too, other columns left out. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for part in slices_of(batches, "text", CHUNK_BYTES):
            found = labeller.label([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[dict(zip(("first", "last", "lang"), r)) for r in f[2]] for f in found], pa.list_(run)),
                ],
                names=["doc_id", "lang_pred", "score", "runs"],
            )

    return docs.select("doc_id", "text").mapInArrow(label, LABEL_TYPE)
