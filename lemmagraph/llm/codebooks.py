"""Vector codes: one codebook a part of the vectors, found by rounds of exact nearest search and integer means.

Every round broadcasts a kd-tree over each codebook (entries are at most ENTRIES, whatever the input). A task searches
its vectors by batches: a batch descends the tree, each vector on the near side of the cut first, and goes on to the far
side where the box there is no farther than its best entry. An equal bound is visited, too, so that of equally near
entries the one of lower index wins. Sums and counts of each entry are aggregated by Spark as integers, so no
order of addition changes them.

Components are floor(SCALE * x), integers throughout.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .common import portions, with_hot

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries a leaf of the kd-tree.
LEAF = 16
#: Components up to this are exact in 64 bits: of a part of 32 components the squared distance stays below 2^63.
LARGE = 1 << 27
#: Components up to this are exact in doubles: of a part of 32 components all sums stay below 2^53.
SMALL = 1 << 22


@dataclass
class Node:
    """A box of entries; a leaf holds their indices, another node the cut and both sides."""

    low: np.ndarray
    high: np.ndarray
    held: np.ndarray | None = None
    axis: int = 0
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def plant(entries: np.ndarray, held: np.ndarray | None = None) -> Node:
    """A kd-tree over entries: cut at the median of the widest axis."""
    held = np.arange(len(entries)) if held is None else held
    low, high = entries[held].min(axis=0), entries[held].max(axis=0)
    axis = max(range(entries.shape[1]), key=lambda d: high[d] - low[d])
    if len(held) <= LEAF or low[axis] == high[axis]:
        return Node(low, high, np.sort(held))
    order = held[np.argsort(entries[held, axis], kind="stable")]
    middle = len(order) // 2
    return Node(low, high, None, axis, entries[order[middle], axis], plant(entries, order[:middle]), plant(entries, order[middle:]))


class Nearest:
    """Exact nearest entries of a codebook, the lowest index among equals. Components up to SMALL are computed in doubles,
    which hold their sums of squares exactly, up to LARGE in 64-bit integers, beyond that as unbounded ones."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root = entries, plant(entries)
        self.most = int(np.abs(entries).max())

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each vector."""
        most = max(self.most, int(np.abs(vectors).max(initial=0)))
        kind = float if most <= SMALL else np.int64 if most <= LARGE else object
        self.vectors, self.known = vectors.astype(kind), self.entries.astype(kind)
        self.best, self.index = np.zeros(len(vectors), kind), np.full(len(vectors), -1)
        self._visit(self.root, np.arange(len(vectors)))
        return self.index, self.best if kind is object else self.best.astype(np.int64)

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        rows = rows[self._within(node, rows)]
        if not len(rows):
            return
        if node.held is not None:
            far = self._distances(self.vectors[rows], self.known[node.held])
            k = far.argmin(axis=1)  # the first of equal ones, and held ascends
            far, k = far[np.arange(len(rows)), k], node.held[k]
            seen, best = self.index[rows], self.best[rows]
            closer = ((seen < 0) | (far < best) | ((far == best) & (k < seen))).astype(bool)
            won = rows[closer]
            self.best[won], self.index[won] = far[closer], k[closer]
            return
        near = (self.vectors[rows, node.axis] < node.at).astype(bool)
        self._visit(node.left, rows[near])
        self._visit(node.right, rows[~near])
        self._visit(node.right, rows[near])
        self._visit(node.left, rows[~near])

    @staticmethod
    def _distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
        if vectors.dtype == float:
            return (vectors * vectors).sum(axis=1)[:, None] - 2 * (vectors @ entries.T) + (entries * entries).sum(axis=1)
        return np.stack([((vectors - e) * (vectors - e)).sum(axis=1) for e in entries], axis=1)

    def _within(self, node: Node, rows: np.ndarray) -> np.ndarray:
        """Where the box of the node is no farther than the best entry so far; equal bounds stay."""
        v = self.vectors[rows]
        off = np.maximum(np.maximum(node.low - v, v - node.high), 0)
        return ((self.index[rows] < 0) | ((off * off).sum(axis=1) <= self.best[rows])).astype(bool)


def integers(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that are kept, and their components as integers (a row each). A vector that is null, empty, of another length than
    dim, or holds null or non-finite components is not."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.empty(0)  # a null component is nan
    fine = np.isfinite(values)
    ends = np.cumsum(sizes)
    good = np.concatenate([[0], np.cumsum(fine)])
    whole = (good[ends] - good[ends - sizes] == sizes) & (sizes > 0)
    kept = np.flatnonzero(whole & (sizes == (dim or 0)) if dim is not None else whole)
    if not len(kept):
        return kept, np.empty((0, dim or 0), np.int64)
    rows = values[(ends - sizes)[kept][:, None] + np.arange(sizes[kept[0]])]
    scaled = np.floor(rows * SCALE)
    if np.abs(scaled).max() <= LARGE:
        return kept, scaled.astype(np.int64)
    exact = np.empty(rows.shape, object)
    for at, x in np.ndenumerate(rows):
        top, bottom = float(x).as_integer_ratio()
        exact[at] = top * SCALE // bottom
    return kept, exact


def _first(df: DataFrame, id_col: str, vector: str, parts: int, entries: int) -> list[np.ndarray]:
    """Starting codebooks: the vectors of the smallest kept ids, ascending (null ids last, equal ids by their components). The
    first of them says how many components a vector has: a multiple of parts."""
    values = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = df.where(fine).select(F.col(id_col).alias("i"), values.alias("v"))
    by = [F.col("i").asc_nulls_last(), F.col("v")]
    lead = kept.orderBy(*by).limit(1).collect()
    if not lead:
        return []
    dim = len(lead[0].v)
    chosen = kept.where(F.size("v") == dim).orderBy(*by).limit(entries).collect()  # entries rows at most
    _, whole = integers(pa.array([r.v for r in chosen], pa.list_(pa.float64())), dim)
    return np.split(whole, parts, axis=1)


def _assigned(df: DataFrame, vector: str, books: list[np.ndarray], keep: list[str], out: str, make) -> DataFrame:
    """make(kept columns, assignments and distances by part, components) of the vectors of each slice, as a record batch."""
    dim = sum(b.shape[1] for b in books)
    columns = [F.col(f"`{c}`") for c in keep]

    def run(batches):
        trees = [Nearest(b) for b in books]
        for batch in batches:
            for part in portions(batch, 0, 8192):
                at, rows = integers(part.column(0), dim)
                if len(at):
                    found = [tree(x) for tree, x in zip(trees, np.split(rows, len(trees), axis=1))]
                    beside = [part.column(k + 1).take(pa.array(at)) for k in range(len(keep))]
                    yield from make(beside, found, rows)

    return df.select(F.col(f"`{vector}`"), *columns).mapInArrow(run, out)


def _moved(df: DataFrame, vector: str, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: the floor of the mean of the parts each entry won; an entry without any stays."""
    width, entries = books[0].shape[1], len(books[0])
    sums = ", ".join(f"s{k} decimal(38,0)" for k in range(width))

    def make(_, found, rows):
        for p, ((index, _), x) in enumerate(zip(found, np.split(rows, len(found), axis=1))):
            count = np.bincount(index, minlength=entries)
            total = np.zeros((entries, width), x.dtype)
            np.add.at(total, index, x)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), *[pa.array([int(v) for v in total[used, k]], pa.decimal128(38, 0)) for k in range(width)]],
                names=["part", "entry", "n", *[f"s{k}" for k in range(width)]],
            )

    each = _assigned(df, vector, books, [], f"part int, entry int, n bigint, {sums}", make)
    moved = [b.copy() for b in books]
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect():  # entries of all books
        mean = [int(r[f"s{k}"]) // r.n for k in range(width)]
        if moved[r.part].dtype != object and max(map(abs, mean)) > LARGE:
            moved[r.part] = moved[r.part].astype(object)
        moved[r.part][r.entry] = mean
    return moved


def train(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part: arrays of integers, one row an entry. Empty where no vector is kept."""
    books = _first(df, id_col, vector, parts, entries)
    for _ in range(rounds if books else 0):
        books = _moved(df, vector, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (all by default), code (two hex digits a part) and error (sum of squared distances, 2^63 - 1 at most) of
    every vector that has as many finite components as the codebooks; the others are left out. Columns code and error
    of df give way."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("code", "error")]
    schema = StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *StructType.fromDDL("code string, error bigint").fields])
    if not books:
        return df.sparkSession.createDataFrame([], schema)
    names = schema.names

    def make(beside, found, _):
        codes = ["".join(f"{k:02x}" for k in row) for row in zip(*[index.tolist() for index, _ in found])]
        error = [min(sum(map(int, row)), (1 << 63) - 1) for row in zip(*[far.tolist() for _, far in found])]
        yield pa.RecordBatch.from_arrays([*beside, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=names)

    return _assigned(df, vector, books, keep, schema, make)


def decode(code: str, books: list[np.ndarray]) -> list[int]:
    """The components that a code stands for."""
    return [int(x) for p, b in enumerate(books) for x in b[int(code[2 * p : 2 * p + 2], 16)]]


def compressed(df: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error (sums of equal labels, nulls together; 2^63 - 1 at most), codebooks_sha256.

    Left out: vectors that are null, empty or hold null or non-finite components, and those of another length than the
    kept one of smallest id. Repeated ids are coded each, null ids come last; no kept vector: no rows.
    """
    books = train(df)
    label = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label")).alias("group")
    coded = encode(df.select("vec_id", "embedding", label), books, keep=["vec_id", "group"])
    if not books:
        return coded.select("vec_id", "code", "error", F.lit(None).cast("bigint").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    coded = cut(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    groups = cut(coded.groupBy("group").agg(total.alias("label_error"), F.count("*").alias("times")))
    return with_hot(coded, groups, "group", "times").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
