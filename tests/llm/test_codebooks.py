"""Codebooks against the definition, by plain loops over unbounded integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmagraph.llm import codebooks, queries

COLUMNS = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    kept = [(i, [math.floor(Fraction(float(np.float32(x))) * 1024) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    w = dim // 4
    cut = lambda v: [v[w * p : w * p + w] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        won = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                won[p][near(p, x)[1]].append(x)
        books = [[[sum(c) // len(c) for c in zip(*xs)] if xs else e for e, xs in zip(b, ws)] for b, ws in zip(books, won)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, lab in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        error = sum(f for f, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    return sorted(((i, c, e, sums[lab], sha) for i, c, e, lab in out), key=repr)


def rows_of(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_definition_on_a_table(spark, data):
    some = spark.read.parquet(f"{data}/embeddings.parquet")
    whole = [tuple(r) for r in some.select("vec_id", "embedding", "label").collect()]
    assert rows_of(queries.op13_kd_tree_codebooks(spark, data)) == brute(whole)


def test_nearest_is_exact_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(1)
    for dim, n, span in [(1, 40, 3), (2, 200, 4), (5, 256, 3), (16, 256, 600), (3, 5, 2)]:
        entries = rng.integers(-span, span + 1, (n, dim))
        vectors = rng.integers(-span - 1, span + 2, (700, dim))
        far = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = codebooks.Nearest(entries)(vectors)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        index, best = codebooks.Nearest(entries.astype(object))(vectors)
        assert (index == far.argmin(axis=1)).all()


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-0.5, 0.001, 0.25, 1.0]) for _ in range(8)], rng.choice([None, 0, 1, 1, 1])) for k in range(300)]
    rows += [(None, None, 1), (None, [0.5] * 8, None), (7, [0.5] * 8, 0), (7, [0.5] * 8, 0), (1, [], 0), (2, [float("nan")] + [0.0] * 7, 1), (3, [float("inf")] * 8, 1), (-5, [None] + [0.1] * 7, 2)]
    rows += [(8, [1.0] * 4, 0), (9, [0.0] * 8, 3), (10, [-0.0] * 8, 3)]
    got = rows_of(codebooks.compressed(spark.createDataFrame(rows, COLUMNS)))
    assert got == brute(rows)
    assert rows_of(codebooks.compressed(spark.createDataFrame([], COLUMNS))) == []
    assert rows_of(codebooks.compressed(spark.createDataFrame([(1, None, 1), (2, [], 1)], COLUMNS))) == []


def test_large_components(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([1.0, 3e5, -2.5e6, 0.125]) for _ in range(4)], None) for k in range(270)]
    assert rows_of(codebooks.compressed(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_codes_stand_for_entries(spark, data):
    some = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("code", F.lit("mine")).withColumn("n", F.lit(1))
    books = codebooks.train(some, parts=8, entries=16, rounds=2)
    got = codebooks.encode(some, books).collect()
    assert len(books) == 8 and len(got) == some.count()
    for r in got[:40]:
        away = sum((math.floor(x * 1024) - y) ** 2 for x, y in zip(r.embedding, codebooks.decode(r.code, books)))
        assert away == r.error and len(r.code) == 16 and r.n == 1


def test_sums_do_not_depend_on_partitions(spark, data):
    some = spark.read.parquet(f"{data}/embeddings.parquet")
    one, many = (codebooks.digest(codebooks.train(some.repartition(n))) for n in (1, 7))
    assert one == many


@pytest.mark.parametrize("entries", [1, 3])
def test_fewer_vectors_than_entries(spark, entries):
    rows = [(k, [float(k)] * 4, 0) for k in range(entries)]
    assert rows_of(codebooks.compressed(spark.createDataFrame(rows, COLUMNS))) == brute(rows)
