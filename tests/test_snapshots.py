"""Versions of a table: what readers see, what writes touch, what a failure leaves."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lemmagraph.sources.snapshots import Conflict, Table

SCHEMA = "key string, n int, text string, seq int"


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"k{i:03}", i, f"text {i}", 0) for i in range(300)] + [("k001", 1, "later", 1), (None, -1, "no key", 0)]
    t = Table(spark, f"file://{tmp_path}/t")
    t.create(spark.createDataFrame(rows, SCHEMA), ["key"], ["seq"], buckets=8)
    return t


def test_the_last_row_of_a_key_stays_and_an_upsert_replaces_it(spark, table):
    assert table.read().count() == 301 and table.lookup(key="k001").first().text == "later" and table.lookup(key=None).first().text == "no key"
    before = table.read()
    old = table.snapshot()
    new = table.upsert(spark.createDataFrame([("k007", 7, "new", 2), ("k007", 7, "newer", 3), ("zzz", 0, "added", 0), (None, -2, "still none", 0)], SCHEMA), ["seq"])
    assert new.version == 2 and table.read().count() == 302 and table.lookup(key="k007").first().text == "newer" and table.lookup(key=None).first().n == -2
    assert before.count() == 301 and table.read(1).where("key = 'k007'").first().text == "text 7"
    same = [b for b in old.folders if old.folders[b] == new.folders[b]]
    assert len(same) >= 5  # three keys touch three buckets at most
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == new


def test_a_failed_write_leaves_the_old_version(spark, table):
    bad = spark.createDataFrame([("k001", 1, "x", 9)], SCHEMA).withColumn("text", F.when(F.col("n") == 1, F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    assert table.versions() == [1] and table.lookup(key="k001").first().text == "later"


def test_of_two_writers_of_one_version_one_fails(spark, table):
    rows = spark.createDataFrame([("k002", 2, "mine", 5)], SCHEMA)
    other = Table(spark, table.root)
    held = table.snapshot()
    table.snapshot = lambda version=None: held  # read before the other one commits
    other.upsert(rows.withColumn("text", F.lit("theirs")))
    with pytest.raises(Conflict):
        table.upsert(rows)
    assert other.versions() == [1, 2] and other.lookup(key="k002").first().text == "theirs"
    with pytest.raises(Conflict):
        other.create(rows, ["key"])


def digests(table):
    root = table.root.removeprefix("file://")
    return {b: sorted(hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root, f).glob("*.parquet")) for b, f in table.snapshot().folders.items()}


def test_equal_rows_leave_equal_bytes_and_vacuum_keeps_what_is_named(spark, table):
    rows = spark.createDataFrame([(f"k{i:03}", i, "again", 1) for i in range(0, 300, 7)], SCHEMA)
    table.upsert(rows.repartition(3))
    once = digests(table)
    table.upsert(rows.repartition(5))
    assert digests(table) == once
    assert table.vacuum(keep=1) > 0 and table.versions() == [3] and table.read().count() == 301


def test_a_key_reads_one_file(table):
    found = table.lookup(key="k042")
    assert len(found.inputFiles()) == 1 and found.first().n == 42
    assert "EqualTo(key,k042)" in found._jdf.queryExecution().executedPlan().toString()
    assert table.lookup(key="nobody").count() == 0
    with pytest.raises(LookupError):
        table.read(9)
