"""Queries whose whole job SQL cannot finish, and operators below them, against brute force."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lemmagraph.functions import identifiers
from lemmagraph.operators import intervals
from lemmagraph.plans import catalog
from lemmagraph.plans.bridge import view


def pieces(ranges, segments):
    out = []
    for doc, a, b in ranges:
        for other, file, start, length in segments:
            if None not in (doc, a, b, start, length) and doc == other and max(a, start) < min(b, start + length):
                out.append((doc, a, b, file, max(a, start) - start, min(b, start + length) - start))
    return sorted(out)


def test_ranges_of_all_lengths(spark):
    rng = random.Random(2)
    spans = lambda n: [(rng.choice("xy"), rng.randint(-500, 5000), int(2 ** rng.uniform(0, 13)) - 1) for _ in range(n)]
    ranges = [(d, a, a + n) for d, a, n in spans(300)] + [(None, 0, 9), ("x", None, 9), ("x", 9, 4), ("y", 5, None)]
    segments = [(d, f"f{i}", a, n) for i, (d, a, n) in enumerate(spans(300))] + [("x", "n", None, 3), (None, "o", 0, 9)]
    r, s = spark.createDataFrame(ranges, "doc string, a bigint, b bigint"), spark.createDataFrame(segments, "doc string, file string, start bigint, length bigint")
    got = sorted(tuple(x) for x in intervals.map_ranges(r, s, "doc").collect())
    assert got == pieces(ranges, segments)
    assert intervals.map_ranges(r.limit(0), s, "doc").collect() == [] == intervals.map_ranges(r, s.limit(0), "doc").collect()


def test_ranges_of_one_document_do_not_meet_all_segments(spark):
    """Every join is on the position bucket, too."""
    n = 2000
    r = spark.range(n).select(F.lit("x").alias("doc"), (F.col("id") * 50).alias("a"), (F.col("id") * 50 + 300).alias("b"))
    s = spark.range(n).select(F.lit("x").alias("doc"), F.col("id").cast("string").alias("file"), (F.col("id") * 100).alias("start"), F.lit(100).alias("length"))
    df = intervals.map_ranges(r, s, "doc")
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("__bucket" in line and "__level" in line for line in joins)
    assert df.count() == sum(1 for i in range(n) for k in range(i // 2, (50 * i + 299) // 100 + 1) if k < n)


def test_ranges_of_every_document(spark, data):
    got = sorted(tuple(x) for x in catalog.QUERIES["mapped_ranges"](spark, data).collect())
    docs = [tuple(x) for x in spark.read.parquet(f"{data}/documents.parquet").select("source", "doc_id", "n_chars").collect()]
    segments, end = [], {}
    for source, doc, n in sorted(docs, key=lambda x: x[1]):
        segments.append((source, f"f{doc}", end.get(source, 0), n))
        end[source] = end.get(source, 0) + n
    want = pieces([(source, doc * 50, doc * 50 + 3000) for source, doc, _ in docs], segments)
    assert got == want and len({x[1] for x in got}) > len(docs) / 20


def test_entities_of_all_works_and_identifiers(spark, data):
    works = view(spark, data, "b_works").select("key", F.transform("ids", identifiers.norm).alias("ids")).collect()
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for key, ids in works:
        for i in ids:
            up[root(("id", i))] = root(("key", key))
    least = {}
    for key, _ in works:
        least[root(("key", key))] = min(key, least.get(root(("key", key)), key))
    got = {r.key: r.entity for r in catalog.QUERIES["same_entity"](spark, data).collect()}
    assert got == {key: least[root(("key", key))] for key, _ in works}
    assert len(set(got.values())) < len(got) == len(works)


def test_titles_of_every_document(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}

    def fold(text):
        flat = "".join(c for c in unicodedata.normalize("NFD", re.sub("--+", "-", re.sub(r"[{}$]", "", text.split("\n")[0]))) if not unicodedata.combining(c)).lower()
        return re.sub("[^a-z0-9]+", " ", flat).strip()

    got = {r.doc_id: r.folded for r in catalog.QUERIES["folded_titles"](spark, data).collect()}
    assert set(got) == set(docs) and {"de", "fr"} <= {r.lang for r in docs.values()}
    plain = {d for d, r in docs.items() if not set("ßæœøłđ") & set(r.text.split("\n")[0].lower())}
    assert len(plain) > len(docs) / 2 and all(got[d] == fold(docs[d].text) for d in plain)


def test_candidates_are_all_documents_with_whole_titles(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert catalog.QUERIES["candidate_scores"](spark, data).count() == docs.count()
    got = catalog._candidates(spark, data)
    assert got.count() == got.where("qt = title").count() == docs.count()
