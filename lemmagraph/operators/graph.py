"""Questions about the graph of results and works, for all roots at once: frontier joins, never one node at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..session import cut

MAX_DEPTH = 6


def closure(roots: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, key, hops): all a root reaches over edges that name a result, within depth steps; roots is (root).

    Each level is one join of the last level with the edges and one anti join with what is known; lineage is cut
    each level. The root itself is not listed.
    """
    followed = cut(edges.where(F.col("origin") != "unspecified").select("src", "dst").distinct())  # made once, read by every level
    known = roots.select("root", F.col("root").alias("key"), F.lit(0).alias("hops")).distinct()
    level, found = known, []
    for hop in range(1, depth + 1):
        fresh = level.join(followed, level["key"] == followed["src"]).select("root", F.col("dst").alias("key")).distinct()
        level = cut(fresh.join(known.select("root", "key"), ["root", "key"], "left_anti").withColumn("hops", F.lit(hop)))
        if level.isEmpty():
            break
        found.append(level)
        known = known.unionByName(level)
    return known.where("hops > 0")


def unresolved(roots: DataFrame, reached: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, src, dst): citations of whole works from every node that was expanded, once an edge and root."""
    expanded = roots.select("root", F.col("root").alias("key")).unionByName(reached.where(F.col("hops") < depth).select("root", "key")) if depth > 0 else roots.select("root", F.col("root").alias("key")).limit(0)
    ends = edges.where(F.col("origin") == "unspecified").select("src", "dst")
    return expanded.distinct().join(ends, expanded["key"] == ends["src"]).select("root", "src", "dst").distinct()


def with_results(reached: DataFrame, results: DataFrame) -> DataFrame:
    """(root, key, hops, missing): missing where the index holds no such result."""
    have = results.select("key").distinct().withColumn("have", F.lit(True))
    return reached.join(have, "key", "left").select("root", "key", "hops", F.col("have").isNull().alias("missing"))


def dependents(edges: DataFrame, results: DataFrame) -> DataFrame:
    """Edges into every key with the result they come from (null where the index has none)."""
    source = results.select(F.col("key").alias("src"), F.col("taxon").alias("src_taxon"), F.col("number").alias("src_number"))
    return edges.join(source, "src", "left").select(F.col("dst").alias("key"), "src", "origin", "src_taxon", "src_number")


def result_view(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Every result with the sorted keys it uses and is used by."""
    out = edges.groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_set("dst")).alias("uses"))
    into = edges.groupBy(F.col("dst").alias("key")).agg(F.array_sort(F.collect_set("src")).alias("used_by"))
    none = F.array().cast("array<string>")
    return results.join(out, "key", "left").join(into, "key", "left").withColumns({c: F.coalesce(c, none) for c in ("uses", "used_by")})


def cited_works(edges: DataFrame, results: DataFrame, versions: DataFrame) -> DataFrame:
    """(work, cited): works that the results of a work's versions lead to, the work's own versions left out."""
    of_version = versions.select(F.col("id").alias("version"), "work")
    mine = results.select(F.col("key").alias("src"), "version").join(of_version, "version").select("src", "work")
    target = F.split_part("dst", F.lit("#"), F.lit(1))
    led = mine.join(edges.select("src", "dst"), "src").select("work", target.alias("target")).distinct()
    other = led.join(of_version.select(F.col("version").alias("target"), F.col("work").alias("target_work")), "target", "left")
    return other.where(F.col("target_work").isNull() | (F.col("target_work") != F.col("work"))).select("work", F.coalesce(F.nullif("target_work", F.lit("")), "target").alias("cited")).distinct()


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column key) of the same root."""
    a, b = nodes.select("root", F.col("key").alias("src")), nodes.select("root", F.col("key").alias("dst"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, ["root", "dst"]).select("root", "src", "dst")


def distinct_labels(df: DataFrame, label: str) -> Column:
    """The label, with the key added where a label occurs more than once."""
    from pyspark.sql import Window

    return F.when(F.count("*").over(Window.partitionBy(label)) > 1, F.concat(F.col(label), F.lit(" ("), F.col("key"), F.lit(")"))).otherwise(F.col(label))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an edge list (u, v): the least node each node is connected with.

    Rounds of large-star and small-star steps; each is an aggregation combined before the shuffle and a join that
    adaptive execution may split at a hub.
    """
    e = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    tips = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return tips.unionByName(tips.select(F.col("root").alias("node"), "root").distinct())


def entities(records: DataFrame, key: str = "key", ids_col: str = "ids") -> DataFrame:
    """(key, entity): records that share any normal identifier, transitively, are one entity, named by its least key."""
    held = records.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.transform(ids_col, ids.norm))).alias("id"))
    leads = held.groupBy("id").agg(F.min("key").alias("u"))
    links = held.join(leads, "id").where(F.col("key") != F.col("u")).select("u", F.col("key").alias("v")).distinct()
    roots = components(links)
    return records.select(F.col(key).alias("key")).distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("entity"))
