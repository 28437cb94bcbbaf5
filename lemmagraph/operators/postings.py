"""A stored inverted index of titles and authors, and a top-k search that reads few of its blocks.

Works are dealt into ranges by a hash of their key, about RANGE works each. A block holds the postings of one token in
one range, with their number and the best score any of them can add. The table is sorted by token and range, so that the
statistics of its files and row groups leave a question only its own tokens' rows; bounds are read without postings.

A question adds up the bounds of each range that has all its tokens, reads the ranges of highest bound first, and then
only those whose bound reaches the score of the last hit so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .search import B, K1

#: Works a range, about; ranges read before the first comparison with bounds.
RANGE, FIRST = 1024, 16


def tokens(title: Column, authors: Column) -> Column:
    return T.tokens(F.concat_ws(" ", title, F.array_join(authors, " ")))


def _part(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _range_of(key: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")


def build(works: DataFrame, path: str, per_range: int = RANGE) -> None:
    """Store the index of works (key, title, authors) below path. A null title or author is empty; works without tokens count."""
    spark = works.sparkSession
    listed = works.select("key", tokens(F.col("title"), F.coalesce("authors", F.array().cast("array<string>"))).alias("tokens"))
    totals = listed.agg(F.count("*").alias("works"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean")).first()
    ranges = max(1, -(-totals.works // per_range))
    spark.createDataFrame([(totals.works, totals.mean, ranges)], "works bigint, mean double, ranges int").coalesce(1).write.parquet(f"{path}/totals")
    each = listed.select("key", _range_of(F.col("key"), ranges).alias("range"), F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("key", "range", "length", "token").agg(F.count("*").alias("tf"))
    post = F.struct("key", F.col("tf").cast("int").alias("tf"), "length")
    best = F.max(_part(F.col("tf"), F.col("length"), F.lit(totals.mean)))
    blocks = each.groupBy("token", "range").agg(F.count("*").alias("n"), best.alias("best"), F.collect_list(post).alias("posts"))  # a block is at most a range of works
    blocks.repartitionByRange("token", "range").sortWithinPartitions("token", "range").write.parquet(f"{path}/blocks")


def search(spark: SparkSession, path: str, text: str, limit: int = 50, report: dict | None = None) -> DataFrame:
    """(key, score): the works that hold every token of the text, best first by BM25, ties by key; the same as a scan.

    report, if given, is told how many blocks the tokens have and how many were read.
    """
    asked = T.query_tokens(text)
    nothing = spark.createDataFrame([], "key string, score double")
    if report is not None:
        report |= {"blocks": 0, "read": 0}
    if not asked or limit <= 0:
        return nothing
    totals = spark.read.parquet(f"{path}/totals").first()
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("token").isin(*asked))
    held = {r.token: (r.df, r.blocks) for r in blocks.groupBy("token").agg(F.sum("n").alias("df"), F.count("*").alias("blocks")).collect()}  # a row a token of the question
    if report is not None:
        report["blocks"] = sum(n for _, n in held.values())
    if len(held) < len(asked):
        return nothing
    idf = F.ln((F.lit(totals.works) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weigh = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    weights = spark.createDataFrame([(t, n) for t, (n, _) in held.items()], "token string, df bigint").select("token", weigh.alias("weight"))
    bounded = blocks.select("token", "range", "best").join(F.broadcast(weights), "token")  # as many weights as tokens asked
    bounds = cut(bounded.groupBy("range").agg(F.count("*").alias("hit"), F.sum(F.col("weight") * F.col("best")).alias("bound")).where(F.col("hit") == len(asked)).select("range", "bound"))

    def scored(ranges: DataFrame) -> DataFrame:
        posts = blocks.select("token", "range", "posts").join(ranges.select("range"), "range").select("token", F.explode("posts").alias("p")).join(F.broadcast(weights), "token")
        part = F.col("weight") * _part(F.col("p.tf"), F.col("p.length"), F.lit(totals.mean))
        by_work = posts.groupBy(F.col("p.key").alias("key")).agg(F.count("*").alias("hit"), F.sum(part).alias("score"))
        return by_work.where(F.col("hit") == len(asked)).select("key", "score")

    order = [F.desc("score"), F.col("key")]
    first = cut(bounds.orderBy(F.desc("bound"), "range").limit(FIRST))
    top = cut(scored(first).orderBy(*order).limit(limit))
    least = top.agg(F.when(F.count("*") == limit, F.min("score"))).first()[0]
    rest = bounds.join(first.select("range"), "range", "left_anti")
    if least is not None:
        rest = rest.where(F.col("bound") >= least - 1e-9)
    rest = cut(rest)
    if report is not None:
        report["read"] = (first.count() + rest.count()) * len(asked)
    if rest.isEmpty():
        return top.orderBy(*order)
    return top.unionByName(scored(rest)).orderBy(*order).limit(limit)
