"""Positions in whole sources, and sums over blocks of rows."""

import random

import pytest

from lemmagraph.operators import scans
from lemmagraph.plans import catalog


@pytest.fixture
def blocks(spark):
    """Small tables keep their partitions, so that a document has several blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _sources(spark, data):
    return {r.source for r in spark.read.parquet(f"{data}/documents.parquet").select("source").distinct().collect()}


def test_ranges_are_those_of_sources(spark, data):
    assert {r.doc for r in catalog.QUERIES["mapped_ranges"](spark, data).select("doc").distinct().collect()} <= _sources(spark, data)


def test_sums_over_blocks(spark, blocks):
    rng = random.Random(4)
    rows = [(doc, i, rng.choice([None, 0, 1, 5])) for doc, n in (("x", 150), ("y", 5), (None, 9)) for i in range(n)]
    want = {(d, i, v, sum(w or 0 for e, j, w in rows if e == d and j < i)) for d, i, v in rows}
    assert {tuple(r) for r in scans.summed_before(spark.createDataFrame(rows, "doc string, i bigint, v bigint"), "doc", ["i"], "v", "before").collect()} == want
