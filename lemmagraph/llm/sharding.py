"""Shards of near-equal bytes by histogram sort: one exchange, after the splitters are known.

Rows are ordered by (hash of the text, id), so equal texts stand together. Splitters are found without sorting:
each wanted byte position starts with the whole key range as its interval; every round counts the exact rows and
bytes of all rows that lie in an interval between PROBES evenly spaced keys of it and keeps the one gap that
holds the position, until the bytes of that gap are within the tolerance of the position, or the gap is one key.
The histogram of a round is one aggregation with a bounded number of rows, whatever the input.

Splitters between shards prefer a boundary between groups of equal texts if one lies within GROUP_TOLERANCE of
the position; otherwise the nearest boundary between rows is taken, so a group larger than the tolerance (or than
a shard) is split in order of id. Further splitters inside each shard, found in the same rounds with a wide
tolerance, cut it into buckets: rows are exchanged once, by bucket, and numbered inside their bucket from the exact
count of rows below it, so no task needs a whole shard.

Defined results: size is the UTF-8 bytes of the text plus 1, a null text has size 1 and its own hash; null ids
come first among equal texts. Rows equal in text and id are one key: they stay in one shard and get consecutive
slots in any order. An empty table gives an empty table. Other columns are passed through.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, set_aside

SHARDS = 16
#: Probes an interval: many in the first round, when all positions share one interval.
FIRST_PROBES = 4096
PROBES = 256
#: Buckets a shard: the width of the one exchange is shards * BUCKETS.
BUCKETS = 16
TOLERANCE = 0.0002
GROUP_TOLERANCE = 0.001
INNER_TOLERANCE = 0.25
HASH_BITS = 62
ROUNDS = 40


def _hash(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS)


def _below(splitter: tuple[int, int]) -> Column:
    """Is the key of a row below the splitter (hash, id)?"""
    h, i = splitter
    return (F.col("__h") < F.lit(h)) | ((F.col("__h") == F.lit(h)) & (F.col("__i") < F.lit(i)))


def _bucket(splitters: list[tuple[int, int]], low: int = 0) -> Column:
    """Number of splitters at or below the key, as a balanced tree of comparisons."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    return F.when(_below(splitters[mid]), _bucket(splitters[:mid], low)).otherwise(_bucket(splitters[mid + 1 :], low + mid + 1))


LEAST_ID = -(1 << 63)


class _Search:
    """One wanted position; the interval [low, high) of one half of the key that still holds it."""

    def __init__(self, position: float, tolerance: float, prefer_groups: float, ids: tuple[int, int]):
        self.position, self.tolerance, self.prefer_groups, self.ids = position, tolerance, prefer_groups, ids
        self.low, self.high, self.hash = 0, 1 << HASH_BITS, None  # hash: set once the search goes on inside one text
        self.bytes_below, self.rows_below = 0, 0
        self.found: tuple[int, int] | None = None

    def interval(self) -> tuple:
        return (self.hash, self.low, self.high)


def _width(low: int, high: int) -> int:
    return max(1, -(-(high - low) // (FIRST_PROBES if high - low == 1 << HASH_BITS else PROBES)))


def _count(keys: DataFrame, intervals: list[tuple]) -> dict[tuple, dict[int, tuple[int, int]]]:
    """Exact bytes and rows between the probes of every interval."""
    number, probe, wanted = F.lit(None).cast("int"), F.lit(None).cast("bigint"), []
    for n, (h, low, high) in enumerate(intervals):
        col, inside = ("__h", F.lit(True)) if h is None else ("__i", F.col("__h") == F.lit(h))
        top = F.lit(min(high - 1, (1 << 63) - 1))
        inside = inside & (F.col(col) >= F.lit(low)) & (F.col(col) <= top)
        wide = F.floor((F.col(col).cast("decimal(38,0)") - F.lit(low)) / F.lit(_width(low, high)).cast("decimal(38,0)")).cast("bigint") if h is not None else F.expr(f"(__h - {low}L) div {_width(low, high)}L")
        number, probe = F.when(inside, F.lit(n)).otherwise(number), F.when(inside, wide).otherwise(probe)
        wanted.append(inside)
    rows = keys.where(reduce(lambda a, b: a | b, wanted)).select(number.alias("n"), probe.alias("probe"), "__size")
    out: dict[tuple, dict[int, tuple[int, int]]] = {k: {} for k in intervals}
    for r in rows.groupBy("n", "probe").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows")).collect():
        out[intervals[r.n]][r.probe] = (r.bytes, r.rows)
    return out


def _advance(s: _Search, counted: dict[int, tuple[int, int]]) -> None:
    low, width, below, rows = s.low, _width(s.low, s.high), s.bytes_below, s.rows_below
    for probe in sorted(counted):
        size, n = counted[probe]
        if below + size > s.position:
            break
        below, rows = below + size, rows + n
    else:
        probe, size, n = max(counted, default=0), 0, 0
    start, end = low + probe * width, min(s.high, low + (probe + 1) * width)
    options = [(abs(below - s.position), start), (abs(below + size - s.position), end)]
    off, at = min(options)
    if off <= (s.tolerance if s.hash is not None else s.prefer_groups) or n <= 1:
        s.found = (at, LEAST_ID) if s.hash is None else (s.hash, at)
    elif width > 1:
        s.low, s.high, s.bytes_below, s.rows_below = start, end, below, rows
    elif s.hash is None:
        s.hash, (s.low, s.high), s.bytes_below, s.rows_below = start, s.ids, below, rows
    else:
        s.found = (s.hash, at)


def find_splitters(keys: DataFrame, positions: list[tuple[float, float, float]], ids: tuple[int, int]) -> list[tuple[int, int]]:
    """A splitter for each (position, tolerance, tolerance for a boundary of groups), in bytes of the key order.

    keys has the columns __h, __i, __size; ids: the least id and one more than the largest.
    """
    searches = [_Search(*p, ids) for p in positions]
    for _ in range(ROUNDS):
        open_ = [s for s in searches if s.found is None]
        if not open_:
            break
        counted = _count(keys, list(dict.fromkeys(s.interval() for s in open_)))
        for s in open_:
            _advance(s, counted[s.interval()])
    return [s.found or (s.low if s.hash is None else s.hash, LEAST_ID if s.hash is None else s.low) for s in searches]


def shard(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with size, text_crc32, law, shard, slot and grown_shard (null under this law); columns of docs with
    these names give way. Ids are whole numbers."""
    docs, back = set_aside(docs, ["__size", "__crc", "__h", "__i", "__bucket", "__n"])
    away = {name: new for new, name in back.items()}
    id_col, text_col = away.get(id_col, id_col), away.get(text_col, text_col)
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint")
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keyed = docs.select(*[c for c in docs.columns if c not in own]).withColumn("__size", size).withColumn("__crc", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).withColumn("__h", _hash(F.col(text_col))).withColumn("__i", F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST_ID)))
    keys = cut(keyed.select("__h", "__i", "__size"))
    total, least, most = keys.agg(F.sum("__size"), F.min("__i"), F.max("__i")).first()
    total = total or 0
    share = total / shards
    positions = [
        (total * k / (shards * buckets), *((share * TOLERANCE, share * GROUP_TOLERANCE) if k % buckets == 0 else (share / buckets * INNER_TOLERANCE, share / buckets * INNER_TOLERANCE)))
        for k in range(1, shards * buckets)
    ]
    splitters = [*accumulate(find_splitters(keys, positions, (least, most + 1)), max)] if total else []
    bucket = _bucket(splitters).alias("__bucket")
    counts = {r[0]: r[1] for r in keys.groupBy(bucket).count().collect()}
    before, starts = 0, []
    for b in range(shards * buckets):
        before = 0 if b % buckets == 0 else before
        starts.append(before)
        before += counts.get(b, 0)
    order = Window.partitionBy("__bucket").orderBy("__h", "__i")
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("__bucket") + 1)
    out = keyed.withColumn("__bucket", bucket).withColumn("__n", F.row_number().over(order))
    return out.select(
        *[c for c in docs.columns if c not in own],
        F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.floor(F.col("__bucket") / buckets).cast("int").alias("shard"), (start + F.col("__n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ).withColumnsRenamed(back)
