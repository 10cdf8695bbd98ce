"""Language-model scoring with a hashed maximum-entropy model.

The probability of a word is that of its class given the words before, times
that of its part of the class, times that of the word in its part. All three are
softmaxes with weights for hashed features of the two words before: the word
before, both together, and the one before that alone (a skip).

* Classes have these features for the classes of the words before, trained by
  distributed gradient steps on context counts, and on top of them for the words
  themselves, hashed to `word_slots` rows, trained by a distributed gradient step
  over all tokens. Large classes are split into parts, as many as their tokens
  need; parts have the features of the words.
* Words in a part have a slot for every n-gram and skip of the training texts, so
  slots grow with the corpus. A token goes to the task of its word's part, which
  holds all counts of its words and thus fits weights and exact normalisers of
  its own. Steps of generalised iterative scaling bring the expected count of each
  slot to its discounted count, which is training under exponential priors.

Texts are handled in chunks, each with its own small vocabulary of word hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import batches_of, give_back
from spanloom.session import written

END = b""  # no word is empty
CHUNK_BYTES = 8_000_000


@dataclass(frozen=True)
class Settings:
    """Sizes of the model. Classes: the end, the most frequent words, and the rest by hashed endings.

    Classes of endings have parts of about `part_tokens` tokens, at most `most_parts` of them.
    """

    classes: int = 64
    top_words: int = 31
    slots: int = 4096
    epochs: int = 12
    ridge: float = 1.0
    word_slots: int = 16384  # times classes² below 2^31
    word_steps: int = 3
    discount: float = 0.5
    part_tokens: int = 300_000
    most_parts: int = 512
    folds: int = 7
    held_out: int = 2

    @property
    def endings(self) -> int:
        return self.classes - 1 - self.top_words


def fold(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


CHUNK_TYPE = (
    "chunk long, doc_ids array<long>, lengths array<int>, held array<boolean>, frequent array<binary>, "
    "frequent_counts array<long>, hashes binary, trained binary, endings binary, ids binary"
)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits per word; two words of one part of a class would have to share them to be taken for one."""
    return pd.util.hash_array(np.array([*words, None], object)[:-1], categorize=False)


def chunked(docs: DataFrame, settings: Settings) -> DataFrame:
    """Documents as word ids, in chunks of about CHUNK_BYTES of text, each with its vocabulary (id 0: the end)."""
    first = 1 + settings.top_words

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            rows = zip(batch.column("doc_id").to_pylist(), texts)
            for held_rows in batches_of(rows, map(len, texts), CHUNK_BYTES):
                known: dict[bytes, int] = {END: 0}
                found = []
                for _, text in held_rows:
                    words = text.lower().split()
                    for w in set(words).difference(known):
                        known[w] = len(known)
                    found.append(np.fromiter(map(known.__getitem__, [*words, END]), np.int32, len(words) + 1))
                held = [fold(d, settings.folds) == settings.held_out for d, _ in held_rows]
                trained = [f for f, h in zip(found, held) if not h] or [np.zeros(0, np.int32)]
                ids = np.concatenate(found)
                # Frequent words get small ids, but the end keeps 0.
                counts = np.bincount(ids, minlength=len(known))
                counts[0] = len(ids) + 1
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(known), np.int32)
                rank[order] = np.arange(len(known), dtype=np.int32)
                listed = list(known)
                vocabulary = [listed[i] for i in order]
                endings = np.fromiter((first + zlib.crc32(w[-2:]) % settings.endings for w in vocabulary), np.uint8, len(known))
                endings[0] = 0
                trained = np.bincount(rank[np.concatenate(trained)], minlength=len(known)).astype("<i8")
                frequent = 1 + np.argsort(-trained[1:], kind="stable")[: 16 * settings.top_words]
                frequent = frequent[trained[frequent] > 0]
                row = {
                    "chunk": number, "doc_ids": [d for d, _ in held_rows], "lengths": [len(f) for f in found], "held": held,
                    "frequent": [vocabulary[i] for i in frequent], "frequent_counts": trained[frequent],
                    "hashes": word_hashes(vocabulary).astype("<u8").tobytes(), "trained": zlib.compress(trained.tobytes(), 1),
                    "endings": endings.tobytes(), "ids": _packed(rank[ids]),
                }
                yield pa.RecordBatch.from_pylist([row], schema=CHUNK_SCHEMA)
                number += 1

    return docs.select("doc_id", "text").mapInArrow(chunks, CHUNK_TYPE)


CHUNK_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("held", pa.list_(pa.bool_())), ("frequent", pa.list_(pa.binary())), ("frequent_counts", pa.list_(pa.int64())),
    ("hashes", pa.binary()), ("trained", pa.binary()), ("endings", pa.binary()), ("ids", pa.binary()),
])


def _packed(ids: np.ndarray) -> bytes:
    """Ids, compressed: two bytes each, and those that need more once again behind."""
    large = ids[ids >= 0xFFFF]
    return zlib.compress(len(ids).to_bytes(8, "little") + np.minimum(ids, 0xFFFF).astype("<u2").tobytes() + large.astype("<i4").tobytes(), 1)


def _ids(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:8], "little")
    ids = np.frombuffer(data, "<u2", n, 8).astype(np.int64)
    ids[ids == 0xFFFF] = np.frombuffer(data, "<i4", -1, 8 + 2 * n)
    return ids


PLANES = {1: ("u1",), 2: ("<u2",), 3: ("<u2", "u1"), 4: ("<u4",), 5: ("<u4", "u1"), 6: ("<u4", "<u2"), 8: ("<i8",)}


def _numbers_packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers from 0, each in as many bytes as its largest one needs. The shuffle compresses them."""
    out = [bytes([len(arrays)])]
    for x in arrays:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        width = 8 if width == 7 else width
        out.append(bytes([width]) + len(x).to_bytes(4, "little"))
        shift = 0
        for kind in PLANES[width]:
            out.append((x >> shift).astype(kind).tobytes())
            shift += 8 * np.dtype(kind).itemsize
    return b"".join(out)


def _numbers(data: bytes) -> list[np.ndarray]:
    found, at = [], 1
    for _ in range(data[0]):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 5], "little")
        x, shift, at = np.zeros(n, np.int64), 0, at + 5
        for kind in PLANES[width]:
            plane = np.frombuffer(data, kind, n, at).astype(np.int64)
            x |= plane << shift
            shift += 8 * np.dtype(kind).itemsize
            at += plane.size * np.dtype(kind).itemsize
        found.append(x)
    return found


def contexts(classes: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """For each token the code of the two classes before it. Before a text stands the end, twice."""
    before, skipped = preceding(classes, lengths)
    return before * n + skipped


def preceding(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one before it and the one before that; the end has id 0."""
    before = np.zeros(len(ids), np.int64)
    skipped = before.copy()
    before[1:], skipped[2:] = ids[:-1], ids[:-2]
    skipped[np.cumsum(lengths)[:-1]] = 0
    return before, skipped


def feature_slots(settings: Settings) -> np.ndarray:
    """For each context code the weight rows of its features: bias, class before, both before, skip."""
    code = np.arange(settings.classes**2, dtype=np.uint64)
    before, skipped = np.divmod(code, np.uint64(settings.classes))
    raw = np.stack([np.zeros_like(code), 1 + before, (1 << 20) + code, (1 << 40) + skipped])
    mixed = raw * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64).T % settings.slots


def log_softmax(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    logits = weights[slots].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


@dataclass
class Chunk:
    """A row of the chunk table as arrays: words and their classes, tokens as word ids."""

    lengths: np.ndarray
    held: np.ndarray
    hashes: np.ndarray
    classes: np.ndarray
    ids: np.ndarray


def chunk_arrays(batches: Iterator[pa.RecordBatch], top: np.ndarray) -> Iterator[Chunk]:
    """`top`: hashes of the words that are a class alone, by their place."""
    order = np.argsort(top)
    for batch in batches:
        for row in range(batch.num_rows):
            hashes = np.frombuffer(batch.column("hashes")[row].as_py(), "<u8")
            classes = np.frombuffer(batch.column("endings")[row].as_py(), np.uint8).astype(np.int64)
            if len(top):
                place = order[np.minimum(np.searchsorted(top, hashes, sorter=order), len(top) - 1)]
                classes = np.where((top[place] == hashes) & (classes > 0), 1 + place, classes)
            yield Chunk(
                batch.column("lengths")[row].values.to_numpy(), batch.column("held")[row].values.to_numpy(zero_copy_only=False),
                hashes, classes, _ids(batch.column("ids")[row].as_py()),
            )
            give_back()


CHUNK_COLUMNS = ("lengths", "held", "hashes", "endings", "ids")


def context_counts(chunks: DataFrame, top: np.ndarray, settings: Settings) -> DataFrame:
    """(context, class, n) over all training texts. At most classes³ rows."""
    n = settings.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n**3, np.int64)
        for c in chunk_arrays(batches, top):
            tokens = c.classes[c.ids]
            codes = contexts(tokens, c.lengths, n) * n + tokens
            total += np.bincount(codes[np.repeat(~c.held, c.lengths)], minlength=n**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((found // n).astype(np.int32)), pa.array((found % n).astype(np.int32)), pa.array(total[found])],
            names=["context", "class", "n"],
        )

    counted = chunks.select(*CHUNK_COLUMNS).mapInArrow(count, "context int, class int, n long")
    return counted.groupBy("context", "class").agg(F.sum("n").alias("n"))


def trained(counts: DataFrame, settings: Settings) -> np.ndarray:
    """Class weights after `epochs` gradient steps over all context counts.

    Each task sums gradient and curvature over its share of the contexts; the
    sums per block of weights go to the driver, as many as the model has
    weights. A step divides by the curvature times the number of features, which
    bounds the change along all of them together.
    """
    spark, n, slots = counts.sparkSession, settings.classes, feature_slots(settings)
    weights, blocks = np.zeros((settings.slots, n)), 16
    # The class frequencies as the start: the bias weights alone.
    base = np.ones(n)
    for r in counts.groupBy("class").agg(F.sum("n")).collect():
        base[r[0]] += r[1]
    weights[slots[0, 0]] = np.log(base / base.sum())
    shares = written(counts.repartition(8, "context"), "contexts")

    def gradient(weights):
        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = np.zeros((n * n, n))
            for frame in frames:
                np.add.at(seen, (frame["context"].to_numpy(), frame["class"].to_numpy()), frame["n"].to_numpy())
            rows = np.flatnonzero(seen.sum(axis=1))
            if len(rows):
                p = np.exp(log_softmax(weights.value, slots[rows]))
                total = seen[rows].sum(axis=1, keepdims=True)
                both = np.zeros((2, settings.slots, n))
                for k in range(slots.shape[1]):
                    np.add.at(both[0], slots[rows, k], seen[rows] - total * p)
                    np.add.at(both[1], slots[rows, k], total * p * (1 - p))
                parts = np.split(both, blocks, axis=1)
                yield pd.DataFrame({"block": range(blocks), "sums": [x.tobytes() for x in parts]})

        return sums

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in frame["sums"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [total.tobytes()]})

    kind = "block int, sums binary"
    for _ in range(settings.epochs):
        shared = spark.sparkContext.broadcast(weights)
        rows = shares.mapInPandas(gradient(shared), kind).groupBy("block").applyInPandas(added, kind).collect()
        shared.unpersist()
        if not rows:
            break
        both = np.concatenate([np.frombuffer(r[1]).reshape(2, -1, n) for r in sorted(rows)], axis=1)
        step = (both[0] - settings.ridge * weights) / (slots.shape[1] * both[1] + settings.ridge)
        weights = weights + np.clip(step, -1, 1)
    return weights


@dataclass
class ClassModel:
    """What the class and part factors know beside the weights of words: offsets from class contexts, and parts.

    `tables` holds the weights of words: rows by slot, for classes and for parts.
    """

    offsets: tuple[np.ndarray, np.ndarray]
    parts: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]


def part_of(hashes: np.ndarray, classes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % parts[classes].astype(np.uint64)).astype(np.int64)


def part_counts(chunks: DataFrame, top: np.ndarray, parts: np.ndarray, settings: Settings) -> np.ndarray:
    """Training tokens of each part of each class."""
    shape = (settings.classes, int(parts.max()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            trained = [np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in batch.column("trained")]
            for c, n in zip(chunk_arrays(iter([batch]), top), trained):
                np.add.at(total, (c.classes, part_of(c.hashes, c.classes, parts)), n)
        cls, part = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(part), pa.array(total[cls, part])], names=["class", "part", "n"])

    total = np.zeros(shape)
    found = chunks.select(*CHUNK_COLUMNS, "trained").mapInArrow(count, "class long, part long, n long")
    for r in found.groupBy("class", "part").agg(F.sum("n")).collect():
        total[r[0], r[1]] = r[2]
    return total


def word_slots(before: np.ndarray, skipped: np.ndarray, node: np.ndarray | int, slots: int) -> np.ndarray:
    """The weight rows of a token's features: the word before, both before, the skip. `node`: what is predicted."""
    node = np.uint64(0x9E3779B97F4A7C15) * np.asarray(node, np.uint64)
    both = before * np.uint64(0xC2B2AE3D27D4EB4F) ^ (skipped >> np.uint64(1))
    raw = np.stack([before, both + np.uint64(1), skipped * np.uint64(0x165667B19E3779F9)]) ^ node
    return ((raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % slots


BLOCK_TOKENS = 1024


def factors(c: Chunk, parts: np.ndarray, settings: Settings, of: np.ndarray):
    """For classes, then for parts: tokens among `of`, their offset rows, slots of weights and outcomes."""
    before, skipped = (c.hashes[x] for x in preceding(c.ids, c.lengths))
    tokens = c.classes[c.ids]
    yield of, contexts(tokens, c.lengths, settings.classes)[of], word_slots(before[of], skipped[of], 0, settings.word_slots), tokens[of]
    of = of[parts[tokens[of]] > 1]
    part = part_of(c.hashes, c.classes, parts)[c.ids[of]]
    yield of, tokens[of], word_slots(before[of], skipped[of], tokens[of], settings.word_slots), part


def class_logs(c: Chunk, model: ClassModel, settings: Settings) -> np.ndarray:
    """Per token the log probability of its class, plus that of its part."""
    out = np.zeros(len(c.ids))
    for (of, rows, slots, outcome), offsets, table in zip(factors(c, model.parts, settings, np.arange(len(c.ids))), model.offsets, model.tables):
        ones, places = np.ones(table.shape[1], np.float32), np.arange(BLOCK_TOKENS)
        logits, weights = np.empty((2, BLOCK_TOKENS, table.shape[1]), np.float32)
        for at in range(0, len(of), BLOCK_TOKENS):
            block, n = slice(at, at + BLOCK_TOKENS), min(BLOCK_TOKENS, len(of) - at)
            # Log probabilities plus the weights of one step: no exponential is out of range.
            sums = np.take(offsets, rows[block], axis=0, out=logits[:n], mode="clip")
            for s in slots:
                sums += np.take(table, s[block], axis=0, out=weights[:n], mode="clip")
            chosen = sums[places[:n], outcome[block]]
            out[of[block]] += chosen - np.log(np.exp(sums, out=sums) @ ones)
    return out


def with_word_weights(chunks: DataFrame, top: np.ndarray, model: ClassModel, settings: Settings) -> ClassModel:
    """The model after a gradient step for the features of words, over all training tokens.

    Each task sums what its tokens show and what the model of class contexts
    expects, per slot and outcome; the sums go to the driver, as many as the
    tables have weights. What is expected depends on offset rows alone, so
    tokens are counted by slot and row first. The expected count bounds the
    curvature; times the number of features it bounds a change along all of them.
    """
    blocks, n, size = 16, settings.classes, settings.word_slots
    widths = [t.shape[1] for t in model.tables]
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.zeros((2, size, width), np.float32) for width in widths]
        for c in chunk_arrays(batches, top):
            of = np.flatnonzero(np.repeat(~c.held, c.lengths))
            for (_, rows, slots, outcome), offsets, total in zip(factors(c, shared.value.parts, settings, of), shared.value.offsets, both):
                p, width = np.exp(offsets), total.shape[2]
                total[0] += sum(np.bincount(s * width + outcome, minlength=size * width) for s in slots).reshape(size, width)
                met = np.sort(np.concatenate([(s * len(p) + rows).astype(np.int32) for s in slots]))
                firsts = np.flatnonzero(np.diff(met, prepend=-1))
                times = np.diff(firsts, append=len(met)).astype(np.float32)
                slot, row = np.divmod(met[firsts], len(p))
                for at in range(0, len(slot), BLOCK_TOKENS):
                    block = slice(at, at + BLOCK_TOKENS)
                    starts = np.flatnonzero(np.diff(slot[block], prepend=-1))
                    total[1][slot[block][starts]] += np.add.reduceat(p[row[block]] * times[block, None], starts, axis=0)
        parts = np.array_split(np.concatenate(both, axis=2), blocks, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in parts])], names=["block", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["sums"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

    kind = "block int, sums binary"
    shares = chunks.select(*CHUNK_COLUMNS)
    shares = shares.coalesce(max(8, shares.rdd.getNumPartitions() // 4)).mapInArrow(sums, kind)
    rows = shares.groupBy("block").applyInPandas(added, kind).collect()
    shared.unpersist()
    if not rows:
        return model
    seen, expected = np.concatenate([np.frombuffer(r[1], np.float32).reshape(2, -1, sum(widths)) for r in sorted(rows)], axis=1)
    step = np.clip((seen - expected) / (3 * expected + settings.ridge), -1, 1)
    return ClassModel(model.offsets, model.parts, (step[:, :n].copy(), step[:, n:].copy()))


TOKEN_TYPE = "part long, chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, tokens binary, sums binary"
TOKEN_SCHEMA = pa.schema([
    ("part", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary()), ("sums", pa.binary()),
])


def tokens_by_part(chunks: DataFrame, top: np.ndarray, shared, alone: np.ndarray, settings: Settings) -> DataFrame:
    """A row per chunk and part of a class with the tokens of its words, and one per chunk with its documents.

    The latter (part: -1 less the chunk) has per document the log10 probability
    of all classes and parts, and the base's numbers for words that are a class
    alone. `alone` holds the counts of these.
    """
    own = np.log10(alone + 1.0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("chunk").to_pylist()
            docs = batch.column("doc_ids")
            for row, (number, c) in enumerate(zip(numbers, chunk_arrays(iter([batch]), top))):
                model, n_docs = shared.value, len(c.lengths)
                doc = np.repeat(np.arange(n_docs), c.lengths)
                tokens = c.classes[c.ids]
                score = class_logs(c, model, settings)
                single = tokens <= settings.top_words
                known = np.bincount(doc[single], alone[tokens[single]] > 0, n_docs)
                base = np.bincount(doc[single], own[tokens[single]], n_docs)
                sums = np.stack([base, known, np.bincount(doc, score, n_docs) / np.log(10)])
                yield pa.RecordBatch.from_pylist([{
                    "part": -1 - number, "chunk": number, "doc_ids": docs[row].as_py(), "held": c.held, "lengths": c.lengths, "sums": sums.tobytes(),
                }], schema=TOKEN_SCHEMA)
                before, skipped = ((c.hashes >> np.uint64(40)).astype(np.int32)[x] for x in preceding(c.ids, c.lengths))
                part = c.classes * settings.most_parts + part_of(c.hashes, c.classes, model.parts)
                rest = np.flatnonzero(~single)
                rest = rest[np.argsort(part[c.ids[rest]].astype(np.min_scalar_type(part.max())), kind="stable")]
                keys = part[c.ids[rest]]
                starts = np.flatnonzero(np.diff(keys, prepend=-1))
                for key, of in zip(keys[starts].tolist(), np.split(rest, starts[1:]) if len(rest) else []):
                    words, word = np.unique(c.ids[of], return_inverse=True)
                    firsts = np.flatnonzero(np.diff(doc[of], prepend=-1))
                    held_docs, n = doc[of[firsts]], np.diff(firsts, append=len(of))
                    blob = [np.diff(held_docs, prepend=0), 2 * n + c.held[held_docs], word, before[of], skipped[of]]
                    yield pa.RecordBatch.from_pylist([{
                        "part": key, "chunk": number, "words": c.hashes[words].tobytes(), "tokens": _numbers_packed(blob),
                    }], schema=TOKEN_SCHEMA)

    return chunks.select("chunk", "doc_ids", *CHUNK_COLUMNS).mapInArrow(split, TOKEN_TYPE)


def word_model(word: np.ndarray, before: np.ndarray, skipped: np.ndarray, learnt: np.ndarray, n_words: int, settings: Settings):
    """(counts of the words, log probability of each token's word in its part), fitted to the tokens that are `learnt`.

    Outcomes are the words seen in training and one for all others. The feature
    of a word alone is its share; on top of it stand weights for the word with
    the one before, with the skip, and with both. An outcome has its share times
    the exponential of its weights, so the normaliser of a context is 1, plus what
    the features of its two words add, each by itself, plus a correction for
    words that have both features.
    """
    counts = np.bincount(word[learnt], minlength=n_words)
    share = (counts + 1.0) / (counts.sum() + np.count_nonzero(counts) + 1.0)
    pair, context = np.unique(before << 32 | skipped, return_inverse=True)
    met = np.bincount(context[learnt], minlength=len(pair)).astype(float)
    sides = [_Family(x << 32 | word, learnt, y) for x, y in ((before, pair >> 32), (skipped, pair & 0xFFFFFFFF))]
    both = _Family(context << 32 | word, learnt, np.zeros(0, np.int64))
    at, ids = _meetings(sides, both)
    q = share[sides[0].words[ids[0]]]
    families = [*sides, both]
    for step in range(settings.word_steps + 1):
        e = [np.exp(f.weights) for f in families]
        raised = [e[0][ids[0]], e[1][ids[1]], np.append(e[2], 1.0)[ids[2]]]
        joint = q * raised[0] * raised[1] * raised[2]
        # An empty bincount is of whole numbers, so the sum starts as a float.
        total = 1.0 + np.bincount(at, joint - q * (raised[0] + raised[1] - 1), len(pair))
        for f, x in zip(sides, e):
            total += f.added(share[f.words] * (x - 1))
        if step == settings.word_steps:
            break
        rate = met / total
        expected = [share[f.words] * x * f.rates(rate) for f, x in zip(sides, e)]
        for k in range(2):
            expected[k] += np.bincount(ids[k], rate[at] * (joint - q * raised[k]), len(expected[k]))
        expected.append(np.bincount(ids[2], rate[at] * joint, len(both.keys) + 1)[:-1])
        for f, x in zip(families, expected):
            f.step(x, settings.discount)
    logs = np.log(share[word]) - np.log(total)[context]
    return counts, logs + sum(f.weights[f.ids] for f in families)


class _Family:
    """The slots of one kind of feature: contexts with words. `pairs`: the context here of each pair of words before."""

    def __init__(self, keys: np.ndarray, learnt: np.ndarray, pairs: np.ndarray):
        self.keys, self.ids = np.unique(keys, return_inverse=True)
        self.seen = np.bincount(self.ids[learnt], minlength=len(self.keys)).astype(float)
        self.words = self.keys & 0xFFFFFFFF
        heads, self.starts, self.sizes = np.unique(self.keys >> 32, return_index=True, return_counts=True)
        self.pairs = np.searchsorted(heads, pairs)  # each pair stems from a token, so its context is there
        self.weights = np.zeros(len(self.keys))

    def added(self, values: np.ndarray) -> np.ndarray:
        """Sums over the slots of a context, for each pair."""
        return np.add.reduceat(values, self.starts)[self.pairs]

    def rates(self, rate: np.ndarray) -> np.ndarray:
        """Sums over the pairs of a context, for each of its slots."""
        return np.repeat(np.bincount(self.pairs, rate, len(self.starts)), self.sizes)

    def step(self, expected: np.ndarray, discount: float) -> None:
        goal = np.maximum(self.seen - discount, 1e-9) / np.maximum(expected, 1e-9)
        self.weights = np.maximum(self.weights + np.log(goal) / 3, 0)


MEETINGS = 1_000_000


def _meetings(sides: list[_Family], both: _Family) -> tuple[np.ndarray, list[np.ndarray]]:
    """All (pair, word) where the word was seen after either word of the pair: pairs, and slots in the three families.

    Looked up from the side with fewer slots. A slot of `both` that isn't there is the one after the last.
    """
    left, right = (f.sizes[f.pairs] for f in sides)
    found = []
    for near, far, of in ((*sides, np.flatnonzero(left <= right)), (*sides[::-1], np.flatnonzero(left > right))):
        sizes = near.sizes[near.pairs[of]]
        ends = np.cumsum(sizes)
        heads = far.keys[far.starts[far.pairs]] >> 32
        first = 0
        while first < len(of):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MEETINGS, "right")))
            pairs, n = of[first:last], sizes[first:last]
            slots = np.repeat(near.starts[near.pairs[pairs]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs = np.repeat(pairs, n)
            seen = near.seen[slots] > 0
            pairs, slots = pairs[seen], slots[seen]
            wanted = heads[pairs] << 32 | near.words[slots]
            place = np.minimum(np.searchsorted(far.keys, wanted), len(far.keys) - 1)
            hit = (far.keys[place] == wanted) & (far.seen[place] > 0)
            found.append((pairs[hit], *((slots[hit], place[hit]) if near is sides[0] else (place[hit], slots[hit]))))
            first = last
    at, before, skip = (np.concatenate(x) for x in zip(*found))
    wanted = at << 32 | sides[0].words[before]
    third = np.minimum(np.searchsorted(both.keys, wanted), len(both.keys) - 1)
    return at, [before, skip, np.where(both.keys[third] == wanted, third, len(both.keys))]


PART_TYPE = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, distinct long, docs binary, base binary, sums binary"
PART_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
    ("distinct", pa.int64()), ("docs", pa.binary()), ("base", pa.binary()), ("sums", pa.binary()),
])
UNIT = 2.0**-32  # sums of the base travel as whole numbers of it


def _part_scorer(settings: Settings):
    """For all rows of a part: per chunk the sums of its documents; `distinct` words stand in one row of the part."""

    def score(rows: pa.Table) -> pa.Table:
        if rows["doc_ids"][0].is_valid:
            return pa.Table.from_pylist(rows.select(["chunk", "doc_ids", "held", "lengths", "sums"]).to_pylist(), schema=PART_SCHEMA)
        rows = rows.select(["chunk", "words", "tokens"]).sort_by("chunk")
        hashes = [np.frombuffer(x.as_py(), "<u8") for x in rows["words"]]
        known, places = np.unique(np.concatenate(hashes), return_inverse=True)
        docs, sizes, learnt, word, before, skipped = [], [], [], [], [], []
        for blob, place in zip(rows["tokens"], np.split(places, np.cumsum([len(x) for x in hashes])[:-1])):
            gaps, n, w, b, s = _numbers(blob.as_py())
            docs.append(np.cumsum(gaps))
            sizes.append(n >> 1)
            learnt.append(np.repeat(n & 1 == 0, n >> 1))
            word.append(place[w])
            before.append(b)
            skipped.append(s)
        numbers = rows["chunk"].to_pylist()
        word, before, skipped, learnt = (np.concatenate(x) for x in (word, before, skipped, learnt))
        del rows, hashes, places, blob, gaps, n, w, b, s
        give_back()
        counts, logs = word_model(word, before, skipped, learnt, len(known), settings)
        del before, skipped, learnt
        starts = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)[:-1]
        ends = np.cumsum([len(x) for x in docs])[:-1]
        own, seen, sums = (np.add.reduceat(x, starts) for x in (np.log10(counts + 1.0)[word], (counts > 0)[word].astype(np.int64), logs / np.log(10)))
        own, seen, sums = (np.split(x, ends) for x in (np.rint(own / UNIT).astype(np.int64), seen, sums))
        give_back()
        return pa.Table.from_pylist([
            {
                "chunk": number, "distinct": 0 if i else int(np.count_nonzero(counts)),
                "docs": _numbers_packed([np.diff(docs[i], prepend=0), seen[i]]), "base": _numbers_packed([own[i]]),
                "sums": sums[i].astype("<f4").tobytes(),
            } for i, number in enumerate(numbers)
        ], schema=PART_SCHEMA)

    return score


SUMS_TYPE = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, distinct long"


def scored(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The log10 probability of every whole text under a unigram base and under the model.

    Learns from the documents outside the held-out fold. Words are what lies
    between ASCII white space, A-Z in lower case, and one end per text; null and
    empty texts are the end alone. One row per row of `docs`, repeated ones too;
    with nothing to learn from, every outcome counts once. Other columns are
    left out; an empty table gives no rows.
    """
    spark, n = docs.sparkSession, settings.classes
    chunks = written(chunked(docs, settings), "chunks")
    frequent = chunks.select(F.explode(F.arrays_zip("frequent", "frequent_counts")).alias("w")).groupBy(F.col("w.frequent").alias("word"))
    listed = frequent.agg(F.sum("w.frequent_counts").alias("c")).orderBy(F.desc("c"), "word").limit(settings.top_words).collect()
    top = word_hashes([bytes(r[0]) for r in listed])
    counts = written(context_counts(chunks, top, settings), "context-counts")
    of_class = np.zeros(n)
    for r in counts.groupBy("class").agg(F.sum("n")).collect():
        of_class[r[0]] = r[1]
    alone = np.arange(n) <= settings.top_words
    parts = np.where(alone, 1, np.clip(-(-of_class // settings.part_tokens), 1, settings.most_parts)).astype(np.int64)
    shares = part_counts(chunks, top, parts, settings) + 1
    shares[np.arange(shares.shape[1]) >= parts[:, None]] = 0
    with np.errstate(divide="ignore"):
        shares = np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
    by_class = log_softmax(trained(counts, settings), feature_slots(settings)).astype(np.float32)
    tables = tuple(np.zeros((settings.word_slots, width), np.float32) for width in (n, shares.shape[1]))
    model = with_word_weights(chunks, top, ClassModel((by_class, shares), parts, tables), settings)

    tokens = tokens_by_part(chunks, top, spark.sparkContext.broadcast(model), np.where(alone, of_class, 0), settings)
    parts_done = tokens.groupBy("part").applyInArrow(_part_scorer(settings), PART_TYPE)
    sums = written(parts_done.groupBy("chunk").applyInArrow(_added_up, SUMS_TYPE), "sums")
    total = int(of_class.sum())
    distinct = (sums.agg(F.sum("distinct")).first()[0] or 0) + int(np.count_nonzero(of_class[alone]))
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"), "score",
    )


def _added_up(rows: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over all parts; `distinct` words of its parts stand in the first row."""
    rows = rows.to_pylist()
    head = next(r for r in rows if r["doc_ids"] is not None)
    base, known, score = np.frombuffer(head["sums"]).reshape(3, -1).copy()
    own, distinct = np.zeros(len(base), np.int64), np.zeros(len(base), np.int64)
    for r in sorted((r for r in rows if r is not head), key=lambda r: r["docs"] + r["sums"]):
        gaps, seen = _numbers(r["docs"])
        of = np.cumsum(gaps)
        known[of] += seen
        own[of] += _numbers(r["base"])[0]
        score[of] += np.frombuffer(r["sums"], "<f4")
        distinct[0] += r["distinct"]
    columns = [
        pa.array(head["doc_ids"], pa.int64()), pa.array(head["held"], pa.bool_()), pa.array(np.array(head["lengths"], np.int64)),
        pa.array(np.rint(known).astype(np.int64)), pa.array(base + own * UNIT), pa.array(score), pa.array(distinct),
    ]
    return pa.table(columns, names=[x.split()[0] for x in SUMS_TYPE.split(", ")])
