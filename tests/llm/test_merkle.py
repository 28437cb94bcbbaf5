"""The manifest against trees built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lemmagraph.llm import merkle, queries

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        yield level[i ^ 1] if i ^ 1 < len(level) else None, i & 1
        i >>= 1


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees.append((mine, levels([brute_leaf(r) for r in mine])))
    top = levels([t[-1][0] for _, t in trees])
    for g, (mine, tree) in enumerate(trees):
        for i, r in enumerate(mine):
            steps = [*path(tree, i), *path(top, g)]
            more = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            acc = brute_leaf(r, int(more))
            for sibling, left in steps:
                acc = h(acc if sibling is None else sibling + acc if left else acc + sibling)
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], h("".join(s or "" for s, _ in steps)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, documents, data):
    assert rows_of(queries.op12_merkle_manifest(spark, data)) == brute([r.asDict() for r in documents.collect()])


def test_odd_rows(spark, odd, none):
    assert rows_of(merkle.verified_documents(odd)) == brute([r.asDict() for r in odd.collect()])
    assert rows_of(merkle.verified_documents(none)) == []
    one = odd.where("doc_id = 2")
    assert rows_of(merkle.verified_documents(one)) == brute([r.asDict() for r in one.collect()])
    assert merkle.proofs(one).first().proof == []


@pytest.mark.parametrize("first,more,partitions", [(0, 1, 13), (1, 2, 7), (-3, 1, 16)])
def test_many_partitions_and_rounds(spark, monkeypatch, first, more, partitions):
    monkeypatch.setattr(merkle, "FIRST", first)
    monkeypatch.setattr(merkle, "MORE", more)
    rng = random.Random(first)
    rows = [(rng.choice([None, *range(400)]), rng.choice(["a", "b"]), rng.choice(["x", "x", "x", "x", "y", None, "é", "\U0001f600", "z%d" % (i % 5)]), None, 2**63 - 1 if i % 50 == 0 else i) for i in range(700)]
    rows += [(5, "same", "x", "s", 1)] * 300
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = rows_of(merkle.verified_documents(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute([r.asDict() for r in docs.collect()])


def test_proofs_of_the_operator(spark, documents):
    found = merkle.proofs(documents)
    assert found.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof"]
    assert found.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert found.where(F.exists("proof", lambda p: ~F.length(p["digest"]).isin(0, 64))).count() == 0
