"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t have squared distance <= 2 - 2t. Vectors are rotated (principal axes of a bounded
sample) and split into low-dimensional blocks, each with a share of that squared distance in proportion to the variance
of the block. A linked pair keeps the budget of at least one block, so the union over blocks of a range join under the
block's budget holds every pair; each candidate is then verified exactly in double precision.

Distribution. Exact copies are merged first (with their count). The distinct vectors are cut into cells along the first
axis; a cell never exceeds MOST_CELL vectors, whatever the data. Cells whose strips are further apart than the radius
never meet; each other pair of cells is one bounded group, range-joined tile by tile. A group returns, for each vector,
the number of its partners (copies counted) and the smallest vector it is connected with inside the group: at
most one row a vector, so a crowd of near copies never becomes a list of pairs.

Defined results: vectors that are null, empty, zero or hold a null or a component that is not finite link with
nothing (n_links 0, component their own id, kept). Vectors of different lengths never link. Repeated ids are vectors like any
others. A null id is its own component null and kept false. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_hot
from .components import connected_components

THRESHOLD = 0.9
BLOCK_DIMS = 8
#: Rows the rotation is fitted on, at most.
SAMPLE = 4096
CELLS = 8
LEAST_CELL, MOST_CELL = 1024, 16384
TILE = 512
SLACK = 1e-4
VERIFY = 1 << 18


def _packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id, raw (components as little-endian bytes, null if the vector cannot link), dim."""
    narrow = df.select(id_col, vec_col)
    kind = "<f4" if narrow.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, dims = [], []
            for v in batch.column(1):
                x = v.values
                good = x is not None and len(x) and not x.null_count
                if good:
                    y = x.to_numpy(zero_copy_only=False).astype(kind)
                    good = np.isfinite(y).all() and y.any()
                raws.append((y + 0).tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], names=["id", "raw", "dim"])

    return narrow.mapInArrow(run, f"id {narrow.schema[id_col].dataType.simpleString()}, raw binary, dim int")


def unit(raws: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), kind).astype(np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_rotation(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes (columns, largest variance first) and the variance along each."""
    centred = sample - sample.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
    return vectors[:, ::-1], np.maximum(values[::-1], 0)


def blocks_of(variance: np.ndarray, radius2: float, dims: int = BLOCK_DIMS) -> list[tuple[np.ndarray, float]]:
    """Axes and squared-distance budget of each block; budgets sum to radius2. Axes are dealt in turn."""
    d = len(variance)
    n = max(1, d // dims)
    axes = [np.arange(b, d, n) for b in range(n)]
    share = np.array([variance[a].sum() for a in axes])
    share = share / share.sum() if share.sum() > 0 else np.full(n, 1 / n)
    share = 0.5 * share + 0.5 / n  # no block without a budget
    return [(a, radius2 * s) for a, s in zip(axes, share)]


def pairs_within(left: np.ndarray, right: np.ndarray, rotation: np.ndarray, blocks: list[tuple[np.ndarray, float]], threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold. left, right: unit rows; same: one set with itself, each pair once."""
    a, b = (left @ rotation).astype(np.float32), (right @ rotation).astype(np.float32)
    parts = [(np.ascontiguousarray(a[:, x]), np.ascontiguousarray(b[:, x]), np.float32(m + SLACK)) for x, m in blocks]
    parts = [(x, np.ascontiguousarray((-2 * y).T), (x * x).sum(axis=1), (y * y).sum(axis=1), m) for x, y, m in parts]
    for at in range(0, len(a), TILE):
        low = at if same else 0
        found = None
        for x, y2, nx, ny, most in parts:  # range join of each block
            near = x[at : at + TILE] @ y2[:, low:]
            near += ny[low:]
            hit = near <= (most - nx[at : at + TILE])[:, None]
            found = hit if found is None else np.logical_or(found, hit, out=found)
        flat = np.flatnonzero(found)
        width = found.shape[1]
        for k in range(0, len(flat), VERIFY):
            i, j = np.divmod(flat[k : k + VERIFY], width)
            i, j = i + at, j + low
            if same:
                i, j = i[i < j], j[i < j]
            sure = np.einsum("ij,ij->i", left[i], right[j]) >= threshold
            if sure.any():
                yield i[sure], j[sure]


def local_roots(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index connected with each index."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in edges:
            least = np.minimum(root[i], root[j])
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _compare(pdf: pd.DataFrame, kind: str, rotation: np.ndarray, blocks: list, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["cell", "rep"], ignore_index=True)
    x = unit(pdf["raw"].tolist(), kind)
    times, n = pdf["times"].to_numpy(), len(pdf)
    cells = pdf["cell"].to_numpy()
    split = int((cells == cells[0]).sum())
    partners, edges = np.zeros(n, np.int64), []
    pair = pdf["pair"].iat[0]
    if pair[0] == pair[1]:
        runs = pairs_within(x, x, rotation, blocks, threshold, True)
        shift = 0
    elif split == n:
        runs, shift = iter(()), 0
    else:
        runs, shift = pairs_within(x[:split], x[split:], rotation, blocks, threshold, False), split
    for i, j in runs:
        j = j + shift
        partners += np.bincount(i, times[j], n).astype(np.int64) + np.bincount(j, times[i], n).astype(np.int64)
        edges.append((i, j))
        if len(edges) > 64 or len(i) > VERIFY // 4:  # keep a forest only
            root = local_roots(n, edges)
            edges = [(root, np.arange(n))]
    root = local_roots(n, edges)
    some = partners > 0
    return pd.DataFrame({"rep": pdf["rep"][some], "partners": partners[some], "root": pdf["rep"].to_numpy()[root[some]]})


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns id, n_links, component_id, kept for every row."""
    spark = df.sparkSession
    kind = "<f4" if df.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    packed = _packed(df, id_col, vec_col)
    rows = cut(packed.select("id", "raw", "dim", F.sha2("raw", 256).alias("key")))
    # numbered by key, not by id: ids may repeat or be null
    distinct = cut(rows.where("raw is not null").groupBy("key").agg(F.first("raw").alias("raw"), F.first("dim").alias("dim"), F.min("id").alias("first"), F.count("*").alias("times")).withColumn("rep", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in distinct.groupBy("dim").count().collect()}
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    found = []
    for dim, n in sorted(sizes.items()):
        own = distinct.where(F.col("dim") == dim)
        sample = unit([bytes(r[0]) for r in own.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("raw").collect()], kind)
        rotation, variance = fit_rotation(sample)
        blocks = blocks_of(variance, radius * radius)
        strips = max(1, -(-n // min(MOST_CELL, max(LEAST_CELL, -(-n // CELLS)))))
        bounds = np.quantile(sample @ rotation[:, 0], np.arange(1, strips) / strips) if strips > 1 else np.empty(0)
        found.append(_joined(spark, own, n, kind, rotation, bounds, blocks, radius, threshold))
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    linked = found[0]
    for more in found[1:]:
        linked = linked.unionByName(more)
    linked = cut(linked)
    partners = linked.groupBy("rep").agg(F.sum("partners").alias("partners"))
    roots = connected_components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "root")
    rooted = distinct.select("rep", "first", "key").join(roots, "rep")
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of_key = (
        distinct.select("rep", "key", "first", "times").join(partners, "rep", "left")
        .join(rooted.join(named, "root").select("rep", "component"), "rep", "left")
        .select("key", "times", (F.coalesce("partners", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "first").alias("component"))
    )
    out = with_hot(rows.select("id", "key"), cut(of_key), "key", "times", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _joined(spark, own: DataFrame, n: int, kind: str, rotation: np.ndarray, bounds: np.ndarray, blocks: list, radius: float, threshold: float) -> DataFrame:
    axis = rotation[:, 0].copy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = unit(batch.column(1).to_pylist(), kind) @ axis
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(bounds, at).astype(np.int32)), pa.array(at)], names=["rep", "raw", "times", "strip", "at"])

    placed = own.select("rep", "raw", "times").mapInArrow(place, "rep bigint, raw binary, times bigint, strip int, at double")
    placed = cut(placed)
    counts = {r.strip: r for r in placed.groupBy("strip").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()}
    most = min(MOST_CELL, max(LEAST_CELL, -(-n // CELLS)) * 3 // 2)
    parts = {s: -(-r.n // most) for s, r in counts.items()}
    first = dict(zip(sorted(parts), np.cumsum([0, *[parts[s] for s in sorted(parts)]]).tolist()))
    cells = [(s, first[s] + k) for s in sorted(parts) for k in range(parts[s])]
    meets = [(s, c, t, e) for s, c in cells for t, e in cells if (counts[t].low - counts[s].high <= radius + 1e-9) and (counts[s].low - counts[t].high <= radius + 1e-9)]
    plan = spark.createDataFrame([(c, min(c, e), max(c, e)) for _, c, _, e in meets], "cell int, a int, b int").dropDuplicates()
    strip_of = spark.createDataFrame([(s, first[s], parts[s]) for s in sorted(parts)], "strip int, first int, parts int")
    celled = placed.join(strip_of, "strip").select("rep", "raw", "times", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int").alias("cell"))
    dealt = celled.join(plan, "cell").select("rep", "raw", "times", "cell", F.array("a", "b").alias("pair"))
    return dealt.groupBy("pair").applyInPandas(lambda pdf: _compare(pdf, kind, rotation, blocks, threshold), "rep bigint, partners bigint, root bigint")
