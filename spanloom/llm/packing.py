"""Sequence packing: best-fit decreasing over the whole corpus.

Documents longer than a window are cut into full windows first. What is left of
each is shorter than a window, so lengths take fewer values than a window has
tokens: best-fit decreasing is planned on the number of pieces per length. The
plan is exactly what placing the pieces one at a time gives, and its size
depends on the window alone. Pieces then look up their place by rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import cache
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import groups_for, rank_in, slices_of
from spanloom.session import written

WINDOW = 2048
END_ID = 1
# Words whose ids a Python worker keeps, about 0.25 KB each, and bytes of texts it takes at once.
CACHED_WORDS = 700_000
SLICE_BYTES = 4_000_000
ROWS_PER_GROUP = 100_000


class OpenWindows:
    """A segment tree over remaining capacities: which of them have open windows.

    `tightest(size)` is the smallest such capacity of at least `size`, 0 without
    one. Each capacity holds ranges (first window, count) of windows alike.
    """

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = np.zeros(2 * self.leaves, bool)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity <= 0 or count <= 0:
            return
        self.ranges.setdefault(capacity, []).append((first, count))
        node = self.leaves + capacity
        while node and not self.tree[node]:
            self.tree[node] = True
            node >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        if not self.ranges[capacity]:
            node = self.leaves + capacity
            self.tree[node] = False
            while node > 1:
                node >>= 1
                self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]
        return found

    def tightest(self, size: int) -> int:
        node = self.leaves + size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return 0
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def planned(counts: Mapping[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for `counts[size]` pieces of each size below `window`.

    Rows (size, first rank, pieces, first window, pieces per window, offset):
    pieces of that size from that rank on fill consecutive windows, so many
    each, starting at that offset. Also the number of windows.
    """
    tree, plan, windows = OpenWindows(window), [], 0
    for size in sorted((s for s, n in counts.items() if s > 0 and n > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            capacity = tree.tightest(size)
            if capacity:
                first, count = tree.take(capacity)
            else:  # as many new windows as the rest fills
                capacity, first = window, windows
                count = -(-left // (window // size))
                windows += count
            each = capacity // size  # a window that takes a piece is the tightest until it can't take another
            full = min(count, left // each)
            if full:
                plan.append((size, rank, full * each, first, each, window - capacity))
                tree.put(capacity - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # fewer than `each` pieces are left
                plan.append((size, rank, left, first + full, left, window - capacity))
                tree.put(capacity - left * size, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            tree.put(capacity, first + full, count - full)
    return np.array(plan, np.int64).reshape(-1, 6), windows


# The split pattern of the word tokenizer that PieceEncoder knows, and its parts for Latin-1 in lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordEncoder(dict):
    """The token ids of words, as little-endian unsigned 32-bit ids; each new word is encoded once, when it is looked up.

    For tokenizers that never join characters across ASCII white space and drop
    it. Words of Latin-1 letters and ASCII are split into pieces here, where the
    tokenizer splits as SPLIT does, and pieces are words too; all other words go
    through the whole tokenizer. A full cache is emptied between
    batches; results don't depend on it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        steps = json.loads(self.tokenizer.to_str())
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.splits = (
            [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": SPLIT}
            and (split[0]["behavior"], split[0]["invert"], split[1]["add_prefix_space"]) == ("Removed", True, False)
        )

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.splits and (text.isascii() and text.isprintable() or LATIN.fullmatch(text)):
            lower = text.lower()
            # Most words are letters, or letters and one more character.
            if lower.isalpha():
                pieces = [lower]
            elif lower[:-1].isalpha():
                pieces = [lower[:-1], lower[-1]]
            else:
                pieces = PIECES.findall(lower)
            if pieces == [text]:
                mapped = text if text.isascii() else "".join([self.characters[b] for b in word])
                ids = [t.id for t in self.model.tokenize(mapped)]
                found = pack(f"<{len(ids)}I", *ids)
            else:
                found = b"".join([self[p.encode()] for p in pieces])
        else:
            encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            found = np.array(encoded.ids, "<u4").tobytes()
        self[word] = found
        return found

    def encode(self, texts: list[list[bytes]] | pa.Array) -> list[bytes]:
        """The ids of each text, given as its words. Each different word is looked up once."""
        words = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.binary()))
        if len(self) > CACHED_WORDS:
            self.clear()
        coded = words.flatten().dictionary_encode()
        found = [self[w] for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        # Ends of the words in the ids of all texts, and where the ids of each begin among those of the different words.
        own = sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        begins = (np.cumsum(sizes) - sizes)[which]
        every = ids[np.repeat(begins - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        cuts = 4 * ends[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]
        return [every[i:j] for i, j in pairwise(cuts.tolist())]


@cache
def encoder_for(path: str) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    return WordEncoder(path)


PIECES_TYPE = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every document's pieces: full windows, then what is left. `with_ids` adds the ids of each as a list.

    A document is the ids of its text (null: none) and the end id, so it has at
    least one piece.
    """
    kind = PIECES_TYPE + (", ids array<int>" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(tokenizer), np.array([END_ID], "<u4").tobytes()
        names = [x.split()[0] for x in kind.split(", ")]
        types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
        for batch in slices_of(batches, "text", SLICE_BYTES):
            words = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(words)):
                ids += end
                for start in range(0, len(ids), 4 * window):
                    piece = ids[start : start + 4 * window]
                    row = [doc_id, len(ids) // 4, start // 4, len(piece) // 4, zlib.crc32(piece)]
                    rows.append(row + [np.frombuffer(piece, "<u4").astype(np.int32)] if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(encode, kind)


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence and offset there.

    Full windows are sequences of their own; the others are packed by best-fit
    decreasing over all of them, equal lengths in the order of document and
    checksum. Null and empty texts are the end id alone. Rows that repeat are
    documents of their own. Other columns are left out; an empty table has no
    pieces. Sequence ids count from 0 without gaps.
    """
    pieces = written(
        tokenized(docs, tokenizer, window, with_ids)
        .withColumn("_size", F.when(F.col("length") < window, F.col("length")).otherwise(0)), "pieces"
    )
    # At most one row per length below the window.
    counts = {r[0]: r[1] for r in pieces.groupBy("_size").count().collect()}
    full = counts.pop(0, 0)
    plan, windows = planned(counts, window)
    groups = groups_for(sum(counts.values()) + full, ROWS_PER_GROUP)
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    ranked = rank_in(grouped, "_size", ["doc_id", "start", "ids_crc32"], "_group", "_rank")
    placed = ranked.withColumn("_at", F.when(
        F.col("_size") == 0, F.struct((F.col("_rank") + windows).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ).otherwise(_place(plan)("_size", "_rank")))
    return placed.select(*[c for c in pieces.columns if c != "_size"], "_at.sequence_id", "_at.offset")


def _place(plan: np.ndarray) -> Callable:
    """Looks a piece's place up by size and rank."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        # Sizes are small; in each the rows go by first rank.
        sizes, ranks = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for s in np.unique(sizes[sizes > 0]):
            rows = plan[plan[:, 0] == s]
            mine = np.flatnonzero(sizes == s)
            at = rows[np.searchsorted(rows[:, 1], ranks[mine], side="right") - 1]
            nth = ranks[mine] - at[:, 1]
            sequence[mine] = at[:, 3] + nth // at[:, 4]
            offset[mine] = at[:, 5] + nth % at[:, 4] * s
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place
