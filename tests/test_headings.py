"""Headings of whole sources, over blocks of rows."""

import random

import pytest

from lemmagraph.operators import intervals, scans
from lemmagraph.plans import catalog


@pytest.fixture
def blocks(spark):
    """Small tables keep their partitions, so that a document has several blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _sources(spark, data):
    return {r.source for r in spark.read.parquet(f"{data}/documents.parquet").select("source").distinct().collect()}


def test_headings_are_those_of_sources(spark, data):
    assert {r.doc for r in catalog.QUERIES["heading_intervals"](spark, data).select("doc").distinct().collect()} == _sources(spark, data)


def test_headings_over_blocks(spark, blocks):
    rng = random.Random(4)
    rows = [(doc, 3 * i, rng.choice([0, 1, 2, 2, 3, 3, 3, 7]) if i % 40 else 3) for doc, n in (("x", 150), ("y", 5), (None, 9)) for i in range(n)]
    want = {(d, s, v, min((t for e, t, w in rows if e == d and t > s and w <= v < 4), default=None), max((t for e, t, w in rows if e == d and t < s and w < v < 4), default=None)) for d, s, v in rows}
    df = spark.createDataFrame(rows, "doc string, start bigint, level int")
    assert scans.in_blocks(df, "doc", ["start"], "b").where("doc = 'x'").select("b").distinct().count() > 1
    assert {tuple(r) for r in intervals.heading_intervals(df, "doc", 4).collect()} == want
