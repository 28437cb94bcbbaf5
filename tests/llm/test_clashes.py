"""Columns of documents that are called as the operators call their own."""

import pytest

from lemmagraph.llm import mixing, sharding

NAMES = ["__size", "__crc", "__h", "__i", "__bucket", "__n", "__key", "__pattern", "__members", "__whole", "__cut", "__besides", "__copy", "row", "size", "__h_"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"words of text {i % 7}", "s" if i % 3 else None, *[f"{n} {i}" for n in NAMES]) for i in range(60)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])


def held(df, but=()):
    names = [n for n in NAMES if n not in but]
    return sorted((r.doc_id, *[r[n] for n in names]) for r in df.collect())


def test_shards_pass_columns_through(clashing):
    out = sharding.shard(clashing)
    assert held(out, ["size"]) == held(clashing, ["size"]) and [c for c in out.columns if out.columns.count(c) > 1] == []


def test_the_mix_passes_columns_through(clashing):
    assert held(mixing.mix(clashing), ["size"]) == held(clashing, ["size"])
    once = {r[0]: r for r in held(clashing)}
    taken = mixing.apply_mix(clashing)
    assert taken.columns == clashing.columns and taken.count() > 60 and all(once[r[0]] == r for r in held(taken))
