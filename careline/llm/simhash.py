"""Near duplicates by SimHash, compared in bit slices.

1. Fingerprints: a document's words, lower-cased, give 3-word shingles with repeats, each
   hashed to 64 bits (XXH64, seed 42); a bit of the fingerprint is set if more than half the
   hashes have it.
2. Candidates: 64 bits are four blocks of 16. Two fingerprints that differ in at most two bits
   agree in two blocks at least, so each distinct fingerprint goes to six groups, one per pair
   of blocks with their values. Nothing is missed and no group but those of like
   fingerprints is large. A group above ``TILE`` fingerprints is dealt out as pairs of tiles,
   so that no task holds it whole.
3. Comparison: in a group the fingerprints are stored vertically, one plane per bit, 64
   fingerprints per machine word. A query adds its 64 difference planes to two carry-save
   counters and an overflow plane, which updates the distances of 64 fingerprints at once;
   after every eight planes the words (blocks) in which all distances exceed the radius are abandoned.
4. A group reports links that connect what it found (a forest, not all pairs). Components of
   the links are found by stars that alternate between larger and smaller neighbours, each round
   written to the shared folder.

Copies share a fingerprint and are one node; the last join gives every document its
component. Nothing about single documents reaches the driver.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked as any
other; fewer than three words are one shingle; repeated rows give a row each; a null id is
not the smallest id of a component unless it has no other; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.llm.common import appended, filled, only, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a tile; a group is at most two tiles.
TILE = 512
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. ``bytes.lower`` and ``bytes.split`` know
    A-Z and ASCII white space only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(len(words) - size + 1, 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [
        b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[a:a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text) and fp of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(filled(text_col)).alias("th"),
                       F.col(text_col).alias("text"))
    return appended(rows, "text", "fp bigint", lambda texts: [[fingerprint(t) for t in texts]], ["id", "th"])


# ---- comparison in bit slices ----------------------------------------------------------

ONE = np.uint64(1)


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """64 planes of words; bit l of word w of plane k is bit k of lane 64 * w + l."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query (row) and word (column) the lanes at most ``radius`` <= 2 bits away.

    ``queries`` has a query per row and word, as each word belongs to one group.
    """
    shape = queries.shape
    flat, cols = queries.ravel(), np.tile(np.arange(shape[1]), shape[0])
    out = np.zeros(flat.size, np.uint64)
    alive = np.arange(flat.size)
    low, high, over = (np.zeros(flat.size, np.uint64) for _ in range(3))
    for k in range(64):
        differ = planes[k, cols] ^ (np.uint64(0) - ((flat >> np.uint64(k)) & ONE))
        carry = low & differ
        low ^= differ
        over |= high & carry
        high ^= carry
        if k % 8 == 7:
            beyond = over | (high & low if radius == 2 else high if radius == 1 else high | low)
            keep = np.flatnonzero(beyond != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(keep) < len(alive):
                alive, flat, cols, low, high, over = (x[keep] for x in (alive, flat, cols, low, high, over))
                if not len(alive):
                    break
    if len(alive):
        out[alive] = ~(over | (high & low if radius == 2 else high if radius == 1 else high | low))
    return out.reshape(shape)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] and b[i] in ``label``, whose values point to smaller members of a set."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def links(groups: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside each group, whatever is near each other: pairs (member, smallest
    member of its set by place). Groups are compared side by side, large ones first, so that
    small groups fill the machine words."""
    groups = sorted((g for g in groups if len(g) > 1), key=len, reverse=True)
    if not groups:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(g) for g in groups])
    words = -(-sizes // 64)
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    word0 = np.cumsum(words) - words
    place = np.repeat(word0 * 64 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    lanes[place] = np.concatenate(groups).view(np.uint64)
    real = np.zeros(len(lanes), np.uint8)
    real[place] = 1
    real = np.packbits(real, bitorder="little").view(np.uint64)
    planes = planes_of(lanes)
    group_of = np.repeat(np.arange(len(groups)), words)
    label = np.arange(len(lanes))
    rank, step = 0, 2
    while rank < sizes[0]:
        n_words = int(words[:np.searchsorted(-sizes, -rank, "left")].sum())  # groups with more members
        ranks = rank + np.arange(step)
        at = word0[group_of[:n_words]] * 64 + np.minimum(ranks[:, None], sizes[group_of[:n_words]] - 1)
        found = near(planes, lanes[at], radius) & real[:n_words]
        r, w = np.nonzero(found)
        bits = np.unpackbits(found[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        _join(label, at[r[i], w[i]], w[i] * 64 + lane)
        rank, step = rank + step, min(step * 2, 64)
    linked = np.flatnonzero((label != np.arange(len(lanes))))
    return lanes[linked].view(np.int64), lanes[label[linked]].view(np.int64)


# ---- candidates, links and components ---------------------------------------------------

def candidate_groups(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Arrays of distinct fingerprints that share two of four blocks, two tiles at most."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[(F.lit(t) * (1 << 32) + block[a] * 65536 + block[b])
                     for t, (a, b) in enumerate(combinations(range(4), 2))])
    spread = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    dealt = spread.join(sizes, "key").select("key", "fp", tiles.alias("tiles"), mine.alias("mine")).select(
        "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return dealt.groupBy("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")
                         ).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")


def near_links(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, held, n = batch.column(0), [], 0
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            for i in range(len(column)):
                held.append(values[offsets[i]:offsets[i + 1]])
                n += len(held[-1])
                if n >= 16 * TILE or i + 1 == len(column):
                    a, b = links(held, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    held, n = [], 0

    return groups.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the links with the smallest node it reaches.

    Rounds of two steps: each node tells its larger neighbours, then its smaller ones, of the
    smallest node it sees. Every round is written, so a lost executor costs one round.
    """
    now = written(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "round")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """id, th (hash of the text), fp, root (a fingerprint that names the component) and component_id (the
    smallest id in it) of every row."""
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find up to two differing bits")
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(near_links(candidate_groups(distinct), radius))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("id", "th", "fp", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the one with the smallest
    id (null ids last)."""
    found = near_duplicates(docs, id_col, text_col)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best")
    stays = written(found.groupBy("root").agg(best).select(
        F.col("best.id").alias("stays_id"), F.col("best.th").alias("stays_th")), "stays")
    return only(docs, id_col, F.xxhash64(filled(text_col)), stays, "stays_id", "stays_th")
