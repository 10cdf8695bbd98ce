"""Near duplicates by the Jaccard similarity of word n-gram sets.

MinHash signatures are cut into bands; sets that agree on a band meet in a
shuffle on the band's hash. Bucket members are joined to the bucket's least
member only, never to each other, and the components of these stars hold every
candidate pair. Inside a component all pairs are verified on the full n-gram
sets, in blocks, and counted there: no pair is a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spanloom.llm.common import groups_for, slices_of
from spanloom.llm.components import components
from spanloom.operators.scale import at_most
from spanloom.session import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999999
MAX_HASHES = 128
# Bounds of a block inside a large component, and the sum of n-grams of small ones verified together.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1_000_000
BROADCAST_ROWS = 500_000
# Bytes of text turned into n-grams at a time, and counts of shared n-grams added up at a time.
PART_BYTES, PART_COUNTS = 400_000, 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which pairs at the threshold still meet with probability `recall`."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if rows * bands <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches that recall; allow more hashes")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, n: int = WORDS) -> np.ndarray:
    """The text's set of word n-grams as sorted 64-bit hashes.

    Words are what lies between ASCII white space, A-Z in lower case. Fewer
    words than `n` are one n-gram together; no words have none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    grams = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        grams = grams * _MIX + hashes[k : len(words) - n + 1 + k]
    return np.unique(_mixed(grams))


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of non-empty sets, a row per set."""
    factors = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    joined, out = np.concatenate(sets), np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(sets), band + 1, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            value = _mixed(value * _MIX + np.minimum.reduceat(joined * factor, starts))
        out[:, band] = value
    return out.view(np.int64)


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_key, n_grams, bands) per row of `docs`; set_key is null without words."""
    kind = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, "text", PART_BYTES):
            sets = [ngrams(t, n) for t in part.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            hashes = iter(_signatures(full, bands, rows) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(hashes) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ], schema=kind,
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, set_key binary, n_grams long, bands array<long>")


def shared_grams(sets: list[np.ndarray], often: int = 16) -> np.ndarray:
    """How many n-grams each two of the sets share, as a matrix.

    N-grams in few sets add one to each of their pairs; those in more are
    columns of 0/1 matrices that are multiplied.
    """
    g = len(sets)
    shared = np.zeros((g, g), np.float32)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    owner = owner[order]
    starts = np.flatnonzero(np.diff(grams[order], prepend=grams[order][:1] + np.uint64(1)))
    counts = np.diff(np.append(starts, len(owner)))
    for c in range(2, often + 1):
        first = starts[counts == c]
        for at in range(0, len(first), PART_COUNTS // c**2):
            those = owner[first[at : at + PART_COUNTS // c**2, None] + np.arange(c)]
            np.add.at(shared, (those[:, :, None], those[:, None, :]), 1)
    many = np.flatnonzero(counts > often)
    for at in range(0, len(many), 1024):
        part = many[at : at + 1024]
        column = np.repeat(np.arange(len(part)), counts[part])
        rows = np.concatenate([owner[starts[m] : starts[m] + counts[m]] for m in part])
        held = np.zeros((g, len(part)), np.float32)
        held[rows, column] = 1
        shared += held @ held.T
    return shared


def _verified(frame: pd.DataFrame, across: bool, threshold: float) -> pd.DataFrame:
    """One row per set with a link: the least set of those it hangs together with here, and its linked documents.

    `across` verifies pairs of different blocks only.
    """
    sets = [np.frombuffer(b, np.uint64) for b in frame["grams"]]
    shared = shared_grams(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    nodes = frame["node"].to_numpy()
    linked &= nodes[:, None] != nodes[None, :]
    if across:
        block = frame["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    root = nodes.copy()
    while True:
        reached = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (reached == root).all():
            break
        root = reached
    links = linked @ frame["copies"].to_numpy(np.int64)
    some = linked.any(axis=1)
    return pd.DataFrame({"node": nodes[some], "root": root[some], "links": links[some]})


def linked(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, set_id, n_links.

    class_id is the least doc_id that hangs together with it by links of at
    least `threshold`, set_id the least with the very same n-gram set, n_links
    the number of other rows linked, equal sets included. Texts without words
    are linked to nothing. Null ids count as one document below all others and
    stay null; rows with one id are one document with several texts. Repeated
    rows are links of each other. Other columns are left out; an empty table
    gives no rows.
    """
    least = -(2**63)
    bands, rows = bands_for(threshold, recall)
    signs = written(signed(docs, n, bands, rows).withColumn("doc", F.coalesce("doc_id", F.lit(least))), "signatures")
    sets = written(
        signs.filter("set_key is not null").groupBy("set_key").agg(
            F.min("doc").alias("node"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")
        ), "sets"
    )
    banded = sets.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = banded.join(buckets, ["band", "hash"]).select(F.col("node").alias("a"), "b")
    candidates = components(stars, "candidates")
    members = written(candidates.join(sets.select("node", "copies", "n_grams"), "node").withColumnRenamed("root", "comp"), "members")
    totals = members.groupBy("comp").agg(F.sum("n_grams").alias("grams"), F.count("*").alias("sets"))
    blocks = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    sized = written(totals.select("comp", "grams", blocks.alias("blocks")), "component-sizes")
    small, large = sized.agg(
        F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("grams"))), F.lit(0)),
        F.count(F.when(F.col("blocks") > 1, 1)),
    ).first()
    bins = groups_for(small, BLOCK_GRAMS // 2)
    places = members.join(sized, "comp").select(
        "node", "copies", "comp", "blocks",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")).alias("bin"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
    )
    if at_most(places, BROADCAST_ROWS):
        places = F.broadcast(places)
    # Repeated rows share a node and would verify the same set again and again.
    texts = docs.select(F.coalesce("doc_id", F.lit(least)).alias("node"), "text").join(places, "node").dropDuplicates(["node", "text"])
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")),
    )
    others = ["node", "copies", "comp", "blocks", "bin", "block"]

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, "text", PART_BYTES):
            grams = pa.array([ngrams(t, n).tobytes() for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], grams], names=[*others, "grams"])

    spread = texts.select(*others, "text").mapInArrow(
        to_sets, "node long, copies long, comp long, blocks int, bin long, block int, grams binary"
    ).withColumn("pair", F.explode(pairs))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        across = frame["pair"].iloc[0]["i"] != frame["pair"].iloc[0]["j"]
        found = [_verified(own.reset_index(drop=True), across, threshold) for _, own in frame.groupby("comp") if len(own) > 1]
        return pd.concat(found) if found else pd.DataFrame({"node": [], "root": [], "links": []}, dtype="int64")

    links = written(
        spread.groupBy(F.col("blocks") > 1, "bin", "pair").applyInPandas(verify, "node long, root long, links long"), "links"
    )
    degree = links.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if large:  # components were verified in several blocks: join what hangs together
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
        degree = degree.drop("root").join(roots, "node")
    classes = sets.select("set_key", "node", "copies").join(degree, "node", "left").select(
        "set_key", F.col("node").alias("set_id"), F.coalesce("root", "node").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    shown = lambda c: F.when(F.col(c) != least, F.col(c))
    return signs.join(classes, "set_key", "left").select(
        "doc_id", shown("class_id").alias("class_id"), shown("set_id").alias("set_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("set_key").isNull().alias("_alone"),
    ).select(
        "doc_id", *[F.when(F.col("_alone"), F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "set_id")], "n_links"
    )
