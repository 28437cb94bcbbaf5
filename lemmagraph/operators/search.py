"""Word search over titles and authors: substring mode and ranked token mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Parameters of the ranking function (fixed values).
K1, B = 1.2, 0.75


def query_terms(text: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", text.casefold()) if t]


def substring(works: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Works whose title or authors contain every term, in order of key."""
    terms = query_terms(text)
    if not terms or limit <= 0:
        return works.limit(0)
    authors = F.lower(F.to_json("authors"))
    for t in terms:
        works = works.where(F.contains(F.lower("title"), F.lit(t)) | F.contains(authors, F.lit(t)))
    return works.orderBy("key").limit(limit)


def token_table(works: DataFrame) -> DataFrame:
    """(work, token, tf, length): the inverted index of title and authors."""
    tokens = T.tokens(F.concat_ws(" ", "title", F.array_join("authors", " ")))
    listed = works.select(F.col("key").alias("work"), tokens.alias("tokens")).withColumn("length", F.size("tokens"))
    return listed.select("work", "length", F.explode("tokens").alias("token")).groupBy("work", "length", "token").agg(F.count("*").alias("tf"))


def ranked(works: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """(key, score): works holding every term as a whole token, marks and case apart, best first by BM25, ties by key.

    Reads all works; a stored index (postings) answers the same with few of its blocks."""
    terms = T.query_tokens(text)
    if not terms or limit <= 0:
        return works.select("key", F.lit(0.0).alias("score")).limit(0)
    index = token_table(works)
    # lengths count works without tokens, too
    length = F.size(T.tokens(F.concat_ws(" ", "title", F.array_join("authors", " "))))
    totals = works.agg(F.count("*").alias("n"), F.avg(length).alias("mean"))
    hits = index.where(F.col("token").isin(*terms))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    # df has a row a query term and totals one row: both are bounded by the query
    scored = hits.join(F.broadcast(df), "token").join(F.broadcast(totals), F.lit(True))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    by_work = scored.withColumn("part", part).groupBy(F.col("work").alias("key")).agg(F.count("*").alias("hit"), F.sum("part").alias("score"))
    return by_work.where(F.col("hit") == len(terms)).select("key", "score").orderBy(F.desc("score"), "key").limit(limit)
