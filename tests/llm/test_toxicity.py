"""Toxic passages against brute force, planted insults and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lemmagraph.llm import queries, toxicity


def brute_segments(scores):
    """The best segment (least before it, shortest), then those of what is left of it and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            total = sum(scores[a : b + 1])
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    right = [(s, x + b + 1, y + b + 1) for s, x, y in brute_segments(scores[b + 1 :])]
    return [*brute_segments(scores[:a]), best, *right]


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        n, other = rng.randint(0, 40), -rng.uniform(0.1, 1.5)
        scored = [(i, rng.uniform(0.1, 3)) for i in range(n) if rng.random() < 0.4]
        full = [other] * n
        for i, s in scored:
            full[i] = s
        got = toxicity.maximal_segments(scored, other)
        want = brute_segments(full)
        assert [x[1:] for x in got] == [x[1:] for x in want] and [x[0] for x in got] == pytest.approx([x[0] for x in want])


def test_scan_is_linear():
    from time import process_time

    def took(n):
        rng = random.Random(1)
        scored = [(2 * i, rng.uniform(0.5, 1.5)) for i in range(n)]
        began = process_time()
        toxicity.maximal_segments(scored, -1.0)
        return process_time() - began

    took(1000)
    assert took(160_000) < 30 * max(took(16_000), 1e-3)


@pytest.fixture(scope="module")
def planted(spark):
    """Insults in a third of the documents, copies of one insulting text, a harmless word that copies repeat."""
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]
    rows, marks = [], []
    for i in range(1500):
        words = rng.choices(plain, k=rng.randint(20, 200))
        toxic = i % 3 == 0
        for _ in range(rng.randint(3, 6) if toxic else rng.random() < 0.05):
            words.insert(rng.randrange(len(words)), rng.choice(["zonk", "zonkers", "quop", "quopsel"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    rows += [(2000 + i, "copied " * 3 + "innocent phrase of a licence " + rows[0][1]) for i in range(300)]
    marks += [(2000 + i, 1, 1) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_planted_insults_are_found(spark, planted):
    docs, labels = planted
    model = toxicity.learn(docs, labels)
    assert {"zon", "zonk$", "quo", "quop$"} <= set(model.weights) and "innocent$" not in model.weights and model.other < 0
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out and doc_id < 2000").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 200 and right >= 0.98 * len(got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    text = "abc, fine\nzonk of a quop zonkers, then " + "fine " * 900 + "quop quopsel zonk zonkers quop"
    row = toxicity.detect(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    spans = [text[p.start : p.end] for p in row.passages]
    assert spans[0].startswith("zonk of") and spans[-1].startswith("quop quopsel") and row.predicted == 1


def test_labels_of_held_out_documents_teach_nothing(planted):
    docs, labels = planted
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, turned)


def test_accuracy_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op11_segment_toxicity(spark, d).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_odd_rows(spark, odd, none, planted):
    labels = spark.createDataFrame([(2, 1, 1), (2, 1, 0), (4, 0, 1), (None, 1, 1), (5, 1, None), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(odd, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 6)}) == 1
    assert toxicity.score_documents(none, labels).collect() == [] and len(toxicity.score_documents(odd, labels.limit(0)).collect()) == len(rows)
    model = toxicity.learn(*planted)
    whole = toxicity.detect(odd, model)
    assert "passages" in whole.columns and whole.columns.count("score") == 1 and "kept" in whole.columns and whole.count() == len(rows)
    long = "word " * 200_000 + "zonk quop zonkers quopsel"
    n, segments = toxicity.Scanner(model).segments(long)
    assert n == 200_004 and segments[-1][1:] == (200_000, 200_003)
