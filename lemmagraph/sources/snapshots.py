"""Keyed tables in versions: an upsert writes only the buckets it touches, and becomes visible by one rename.

A table is a folder. Rows lie in buckets by a hash of their key, a file a bucket, sorted by key, with small row groups
and Bloom filters, so that a key's row is found in one row group of one file. A version is a manifest that names each bucket's
folder; the manifest of the next version is written aside and renamed to its number, which fails if the number is
taken. Files are never changed: readers of a version keep what they opened, a write that fails leaves nothing visible.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import keep_last

#: Bytes of a row group.
ROW_GROUP = 4 << 20


class Conflict(RuntimeError):
    """Another write made the next version first."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    version: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)


class Table:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the last one by default."""
        held = self.versions()
        if not held or (version is not None and version not in held):
            raise LookupError(f"no such version: {version}" if held else f"no table in {self.root}")
        version = held[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/manifests/{version:08}.json", wholetext=True).first().value
        return Snapshot(version, **json.loads(text))

    def _commit(self, made: Snapshot) -> Snapshot:
        """Write the manifest aside and rename it; of two writers of one version one fails."""
        doc = {"keys": made.keys, "buckets": made.buckets, "schema": made.schema, "folders": made.folders}
        aside, name = self._path("aside", f"{uuid.uuid4().hex}.json"), self._path("manifests", f"{made.version:08}.json")
        fs, jvm = self._fs(), self.spark._jvm
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(doc, indent=1, sort_keys=True).encode()))
        out.close()
        fs.mkdirs(name.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, name, options)
        except Exception as exc:
            fs.delete(aside, False)
            raise Conflict(f"version {made.version} of {self.root} is taken") from exc
        return made

    # --- writing
    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, keys: list[str], buckets: int, touched: int) -> dict[str, str]:
        """Write rows (one a key) by bucket; the folder of each."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self._bucket(keys, buckets)).repartition(max(1, touched), "__bucket").sortWithinPartitions("__bucket", *keys)
        writer = dealt.write.partitionBy("__bucket").option("parquet.block.size", ROW_GROUP)
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.root}/{folder}")
        fs, made = self._fs(), self._path(folder)
        names = [s.getPath().getName() for s in fs.listStatus(made) if s.isDirectory()]  # buckets at most
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def create(self, rows: DataFrame, keys: list[str], order: list[str] = (), buckets: int = 16) -> Snapshot:
        """Version 1 of a table; of rows with one key the last by order stays (any of them without an order)."""
        if self.versions():
            raise Conflict(f"there is a table in {self.root}")
        kept = keep_last(rows, keys, list(order)) if order else rows.dropDuplicates(keys)
        folders = self._written(kept, keys, buckets, buckets)
        return self._commit(Snapshot(1, list(keys), buckets, rows.schema.json(), folders))

    def upsert(self, rows: DataFrame, order: list[str] = ()) -> Snapshot:
        """The next version: rows replace those of their keys. Buckets without a row of these are taken over as they are."""
        now = self.snapshot()
        columns = StructType.fromJson(json.loads(now.schema)).names
        rows = rows.select(*columns)
        fresh = keep_last(rows, now.keys, list(order)) if order else rows.dropDuplicates(now.keys)
        touched = [str(r[0]) for r in fresh.select(self._bucket(now.keys, now.buckets)).distinct().collect()]  # buckets at most
        if not touched:
            return now
        match = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in now.keys]
        on = match[0]
        for m in match[1:]:
            on = on & m
        old = self._read(now, [b for b in touched if b in now.folders])
        kept = old.alias("o").join(fresh.select(*now.keys).alias("n"), on, "left_anti").select(*columns)
        folders = self._written(kept.unionByName(fresh), now.keys, now.buckets, len(touched))
        return self._commit(Snapshot(now.version + 1, now.keys, now.buckets, now.schema, now.folders | folders))

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the last versions and the folders that none of the rest names; how many folders went."""
        held = self.versions()
        named = {f.split("/")[1] for v in held[-keep:] for f in self.snapshot(v).folders.values()}
        fs = self._fs()
        for v in held[:-keep]:
            fs.delete(self._path("manifests", f"{v:08}.json"), False)
        gone = [s.getPath() for s in fs.listStatus(self._path("data")) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    # --- reading
    def _read(self, held: Snapshot, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(held.schema))
        paths = [f"{self.root}/{held.folders[b]}" for b in sorted(buckets, key=int)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        held = self.snapshot(version)
        return self._read(held, list(held.folders))

    def lookup(self, version: int | None = None, **key: object) -> DataFrame:
        """The row of a key: one bucket is read, its row groups by statistics and Bloom filters."""
        held = self.snapshot(version)
        types = {f.name: f.dataType for f in StructType.fromJson(json.loads(held.schema)).fields}
        values = {k: F.lit(key[k]).cast(types[k]) for k in held.keys}
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*values.values()), F.lit(held.buckets)).cast("int")).first()[0]
        rows = self._read(held, [str(bucket)] if str(bucket) in held.folders else [])
        for k in held.keys:
            rows = rows.where(F.col(k) == values[k]) if key[k] is not None else rows.where(F.col(k).isNull())
        return rows
