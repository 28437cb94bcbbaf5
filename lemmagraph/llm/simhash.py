"""SimHash near-duplicates found through tables of Hamming distances to reference fingerprints (pivots).

Fingerprint. ASCII letters are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles are runs of three words
with repeats (fewer words: the whole sequence; no word: fingerprint zero). A bit is set when it is set in over
half of the shingles' XXH64 values (seed 42).

Linking. For every distinct fingerprint a table of its distances to PIVOTS seeded reference fingerprints is
computed, kept per block of 16 bits: a distance over all 64 bits is the sum of its four block distances. Two
fingerprints that differ in at most 2 bits leave at least two of the four blocks untouched, so their block
distances to every pivot are equal there: candidates come from an equality join on the distance vectors of two
blocks (six pairs of blocks). Of a candidate pair the largest difference of any coordinate is a lower bound of
its Hamming distance: pairs above the threshold are discarded, the survivors are verified bit by bit.

Crowded keys. A key shared by more than CROWD distinct fingerprints is not paired off: its fingerprints are
instead listed under every point within one bit of them (at most 65 distinct fingerprints can share a point).
Two fingerprints are within 2 bits exactly if they share such a point, so the links to each point's smallest
member give the same components. No pair is lost and no key grows quadratically.

Defined results: null text counts as no word; equal fingerprints are linked; repeated rows stay repeated; a null
doc_id is never a component id unless nothing else is in the group; an empty table gives an empty table. Only
the id and text columns are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_hot
from .components import connected_components

SEED = 42
BITS = 64
BLOCKS = 4
PIVOTS = 16
MAX_DISTANCE = 2
CROWD = 64
PART = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = [*accumulate(len(w) + 1 for w in words)]
        starts = [0, *ends]
        shingles = [line[a : b - 1] for a, b in zip(starts, ends[2:])]
    n = len(shingles)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PART):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[at : at + PART], repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp: the fingerprint as a signed 64-bit integer."""
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=[id_col, "fp"])

    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def pivots(n: int = PIVOTS, seed: int = SEED) -> list[int]:
    draw = random.Random(seed)
    return [draw.getrandbits(BITS) for _ in range(n)]


def block_distances(fp: str, block: int, refs: list[int]) -> list[Column]:
    """Distances from the column to each reference fingerprint, over the bits of one block."""
    width = BITS // BLOCKS
    mask = ((1 << width) - 1) << (block * width)
    return [F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))) for p in refs]


def links(distinct: DataFrame) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) whose components are those of distance <= MAX_DISTANCE."""
    refs = pivots()
    tables = [block_distances("fp", b, refs) for b in range(BLOCKS)]
    whole = F.array(*[sum(t[j] for t in tables[1:]) + tables[0][j] for j in range(len(refs))]).cast("array<tinyint>")
    keys = F.array(*[F.xxhash64(F.lit(a * BLOCKS + b), *tables[a], *tables[b]) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)])
    keyed = cut(distinct.select("fp", whole.alias("table"), F.explode(keys).alias("key")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    paired = keyed.join(counts.where(F.col("n") <= CROWD).select("key"), "key")
    left = paired.select("key", F.col("fp").alias("u"), F.col("table").alias("tu"))
    right = paired.select("key", F.col("fp").alias("v"), F.col("table").alias("tv"))
    apart = F.array_max(F.zip_with("tu", "tv", lambda x, y: F.abs(x - y)))
    near = (
        left.join(right, "key").where("u < v")
        .where(apart <= MAX_DISTANCE)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
        .select("u", "v")
    )
    crowded = keyed.join(counts.where(F.col("n") > CROWD).select("key"), "key").select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])
    shared = crowded.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return near.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fingerprint (16 hex digits), component_id (smallest id reachable over links, itself included)."""
    fps = cut(fingerprints(docs, id_col, text_col))
    groups = cut(fps.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")))
    roots = connected_components(links(groups.select("fp")))
    rooted = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "first", "root")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    of_fp = with_hot(rooted, named, "root", "n").select("fp", "component_id")
    labelled = cut(groups.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"))
    return with_hot(fps, labelled, "fp", "n").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
