"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir

#: Words are runs of anything but these six characters: space, tab, line feed, vertical tab, form feed, return.
#: bytes.split() without an argument splits at exactly these, and bytes.lower() folds A-Z only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files of exchanges are deleted when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write a table of the shared folder and read it again; the exchanges behind it are deleted at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        fresh = df.select("*")  # a plan made under this setting
        (fresh.write.partitionBy(by) if by else fresh.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.drop(by).schema if by else df.schema).parquet(path)


#: A key with more than 1 / SHARES of all rows is hot: there are fewer than SHARES of them.
SHARES = 1024


def with_hot(rows: DataFrame, groups: DataFrame, key: str, times: str, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key, `times`: how many rows have it; not returned). Groups of hot keys, fewer
    than SHARES rows, are broadcast, so that no task meets all rows of a key; the others are joined by exchange."""
    total = groups.agg(F.sum(times)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(times) * SHARES > total).drop(times))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(times) * SHARES <= total).drop(times), key, how)
    return rest.unionByName(rows.join(hot, key))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ours from the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df without columns of these names: what was called so has another name, and the mapping gives it back."""
    away: dict[str, str] = {}
    for name in names:
        if name in df.columns:
            new = name
            while new in df.columns or new in names or new in away.values():
                new += "_"
            away[name] = new
    return df.withColumnsRenamed(away), {new: name for name, new in away.items()}


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string"))


def in_remainder(column: str, modulus: int, remainder: int) -> Column:
    """crc32(id as text) mod modulus = remainder; false where the id is null."""
    return F.coalesce(crc_of_id(column) % modulus == remainder, F.lit(False))


_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """A heavy helper (vocabulary, memos) that lives on in the Python worker, the last one asked for only: workers
    serve one operator after another, and their memory is what bounds an executor."""
    if key not in _resident:
        forget()
        _resident[key] = make()
    return _resident[key]


def forget() -> None:
    """Drop what is resident and give its memory back to the system."""
    if _resident:
        _resident.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give free memory back to the system, which the allocators alone put off."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


class TwoGenerations:
    """A memo of bounded size: when the young half is full it becomes the old half.

    Entries met again are carried over, so frequent keys stay while memory stays below 2 * size entries.
    """

    def __init__(self, make: Callable[[Any], Any], size: int = 200_000):
        self.make, self.size = make, size
        self.young: dict[Hashable, Any] = {}
        self.old: dict[Hashable, Any] = {}

    def __call__(self, key: Any) -> Any:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


#: Numbers moved at a time, so that index arrays stay small.
GATHER = 1 << 20


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every segment, one behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, flat.dtype)
    first = done = 0
    while done < total:
        last = max(first + 1, int(np.searchsorted(ends, done + GATHER, side="right")))
        upto = int(ends[last - 1])
        if last == first + 1:
            out[done:upto] = flat[start[first] : start[first] + size[first]]
        else:
            shift = start[first:last] - ends[first:last] + size[first:last]
            out[done:upto] = flat[np.arange(done, upto) + np.repeat(shift, size[first:last])]
        first, done = last, upto
    return out


class SegmentMemo:
    """A segment of integers for each string, remembered for `most` strings of KEY_BYTES at most; those that were not
    asked for the longest time go first. Works on whole chunks of distinct strings, in Arrow arrays: an entry costs
    little more than its bytes. make: new strings -> all their integers in a row, and the number of each."""

    KEY_BYTES = 64

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int, dtype: Any):
        self.make, self.most = make, most
        self.keys, self.flat, self.size = pa.array([], pa.string()), np.empty(0, dtype), np.empty(0, np.int64)

    def __call__(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integers, start and size of the segment of each of the distinct strings."""
        at = pc.index_in(keys, value_set=self.keys)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        used = at.drop_null().to_numpy()
        made, sizes = self.make(keys.filter(pa.array(~known)))
        start = np.empty(len(keys), np.int64)
        size = np.empty(len(keys), np.int64)
        size[known], size[~known] = self.size[used], sizes
        start[known] = (np.cumsum(self.size) - self.size)[used]
        start[~known] = np.cumsum(sizes) - sizes + len(self.flat)
        flat = gather(np.concatenate([self.flat, made.astype(self.flat.dtype, copy=False)]), start, size)
        rest = np.ones(len(self.keys), bool)
        rest[used] = False
        rest = np.flatnonzero(rest)[-max(self.most - len(keys), 1) :]
        short = np.flatnonzero(pc.binary_length(keys).to_numpy() <= self.KEY_BYTES)
        begins = np.cumsum(self.size) - self.size
        at_keys = np.cumsum(size) - size
        self.flat = np.concatenate([gather(self.flat, begins[rest], self.size[rest]), gather(flat, at_keys[short], size[short])])
        self.keys = pa.concat_arrays([self.keys.take(pa.array(rest)), keys.take(pa.array(short))])
        self.size = np.concatenate([self.size[rest], size[short]])
        return flat, at_keys, size


def portions(batch: pa.RecordBatch, texts: int, rows: int = 2048, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows, or fewer where the column of texts would exceed so many bytes (a row at least)."""
    column = batch.column(texts)
    sized = pa.types.is_string(column.type) or pa.types.is_binary(column.type)
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())]) if sized else np.arange(batch.num_rows + 1)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(total, total[at] + most, side="right")) - 1
        upto = max(at + 1, min(at + rows, fit))
        yield batch.slice(at, upto - at)
        at = upto


def append_columns(df: DataFrame, inputs: list[str], schema: str, start: Callable[[], Callable[..., list]], keep: list[str] | None = None, chunk: int = 512) -> DataFrame:
    """The kept columns of df (all by default) and, row by row, those of schema ("name type, ...").

    start() is called once a task and returns a function from the lists of the inputs' values to one Arrow array
    a new column. A column of df with the name of a new one gives way to it. Only kept columns and inputs are read.
    """
    from pyspark.sql.types import StructType

    new = [f.strip().split(" ")[0] for f in schema.split(", ")]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    beside = [c for c in inputs if c not in kept]
    narrow = df.select(*[F.col(f"`{c}`") for c in kept + beside])
    at = [narrow.columns.index(c) for c in inputs]
    out = StructType([narrow.schema[c] for c in kept])
    n = len(kept)

    def run(batches):
        work = start()
        for batch in batches:
            for part in portions(batch, at[0], chunk):
                made = work(*[part.column(k).to_pylist() for k in at])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=kept + new)

    return narrow.mapInArrow(run, StructType([*out.fields, *StructType.fromDDL(schema).fields]))
