"""Records merged by group against a plain reading, with groups of any size."""

import threading

from pyspark.sql import functions as F

from lemmagraph.operators import upsert

COLUMNS = "g string, seq bigint, ids array<string>, authors array<string>, msc array<string>, reached_from array<string>, title string, year string, arxiv_category string, depth int, provenance string"


def test_a_large_group_is_merged_in_time(spark):
    """Identifiers of a group were compared with each other: 9,000 of them took minutes."""
    n = 3000
    rows = spark.range(n).select(
        F.lit("x").alias("g"), F.col("id").alias("seq"), F.expr("array(concat('DOI:10.1/X', id % 700), concat('work:', id), concat('arXiv:2401.', id, 'v', id % 3))").alias("ids"), F.expr("array(concat('A', id % 900), '')").alias("authors"),
        F.expr("array('14-02', concat('c', id))").alias("msc"), F.expr("array(concat('w', id % 11))").alias("reached_from"), F.lit("").alias("title"), F.lit("1950").alias("year"), F.lit("").alias("arxiv_category"), F.lit(0).alias("depth"), F.lit("declared").alias("provenance"),
    )
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        (r,) = upsert.merge_records(rows, "g", "seq").collect()
    finally:
        late.cancel()
    assert r.ids == [f"DOI:10.1/X{i}" for i in range(700)] + [f"arXiv:2401.{i}v{i % 3}" for i in range(n)] + [f"work:{i}" for i in range(n)]
    assert r.authors == [f"A{i}" for i in range(900)] and r.msc == ["14-02", *[f"c{i}" for i in range(n)]] and r.reached_from == [f"w{i}" for i in range(11)]


def test_odd_records(spark):
    rows = [
        ("a", 2, ["doi:10.1/B", None, "arXiv:1v2"], None, ["", "m2"], ["q"], None, "", "x", 0, "declared"),
        ("a", 1, ["arxiv:1", "DOI:10.1/b", "DOI:10.48550/arXiv.1"], ["Z", "Z", None], [], [], "", "1999", None, 3, "declared"),
        ("a", 3, ["mr:7", "DOI:10.48550/arXiv.2v1", "arxiv:2"], ["Y", "Z"], ["m1", "m2"], ["p", "q"], "T", "2000", "y", 2, "found"),
        ("b", 1, [], [], None, None, None, None, None, None, "declared"),
        (None, 1, ["work:1", "https:x"], ["N"], [], [], "", "", "", -1, "imported"),
    ]
    got = {r.g: tuple(r)[1:] for r in upsert.merge_records(spark.createDataFrame(rows, COLUMNS), "g", "seq").collect()}
    assert got == {
        "a": (["DOI:10.1/b", "DOI:10.48550/arXiv.2v1", "arxiv:1", "mr:7"], "T", "1999", ["Z", "Y"], ["m2", "m1"], "x", 2, ["q", "p"], "found"),
        "b": ([], "", "", [], [], "", 0, [], "declared"),
        None: (["work:1", "https:x"], "", "", ["N"], [], "", 0, [], "imported"),
    }
    assert upsert.merge_records(spark.createDataFrame([], COLUMNS), "g", "seq").collect() == []
