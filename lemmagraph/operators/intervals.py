"""Positions in expanded sources: segments, ranges, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def locate(offsets: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    """(doc, offset, file, at): the segment each offset falls in, as an as-of join without a range join.

    Segments and offsets of a document are merged in one window and every offset takes the last segment before it.
    offsets: doc, offset; segments: doc, file, start, length.
    """
    s = segments.select(doc, F.col("start").alias("__x"), F.lit(0).alias("__o"), F.struct("file", "start", "length").alias("__s"))
    o = offsets.select(doc, F.col("offset").alias("__x"), F.lit(1).alias("__o"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s"))
    last = F.last("__s", ignorenulls=True).over(Window.partitionBy(doc).orderBy("__x", "__o").rowsBetween(Window.unboundedPreceding, 0))
    at = s.unionByName(o).withColumn("__s", last).where("__o = 1")
    return at.where(F.col("__s").isNotNull() & (F.col("__x") < F.col("__s.start") + F.col("__s.length"))).select(doc, F.col("__x").alias("offset"), F.col("__s.file").alias("file"), (F.col("__x") - F.col("__s.start")).alias("at"))


def _home(df: DataFrame, low: str, high: str) -> DataFrame:
    """Intervals that hold something, with the level of their length: at most 2 ** level, so at most two buckets."""
    held = df.where(F.expr(f"{low} < {high}"))
    return held.withColumn("__home", F.length(F.bin(F.expr(f"{high} - {low} - 1"))))


def _bucketed(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.withColumn("__bucket", F.explode(F.expr(f"sequence(shiftright({low}, __level), shiftright({high} - 1, __level))")))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("__home").distinct().collect())


def map_ranges(ranges: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    """(doc, a, b, file, low, high): the pieces of each range, in the offsets of their files.

    An equality join on position buckets: two intervals meet at the level of the longer one, whose buckets are about
    as long as itself, in the first bucket they share; candidates keep in proportion to the pieces. A range or
    segment without both ends, or with nothing between them, has no pieces. Segments may overlap.
    """
    r = _home(ranges.select(doc, F.col("a").cast("bigint"), F.col("b").cast("bigint")), "a", "b")
    s = _home(segments.select(doc, "file", F.col("start").cast("bigint"), (F.col("start") + F.col("length")).cast("bigint").alias("__end")), "start", "__end")

    def visits(df: DataFrame, levels: list[int], least: str) -> DataFrame:
        return df.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.expr(least))))

    at_home = lambda df: df.withColumn("__level", F.col("__home"))
    pairs = [(at_home(r), visits(s, _levels(r), "__home")), (visits(r, _levels(s), "__home + 1"), at_home(s))]
    pieces = []
    for x, y in pairs:
        j = _bucketed(x, "a", "b").drop("__home").join(_bucketed(y, "start", "__end").drop("__home"), [doc, "__level", "__bucket"])
        low, high = F.greatest("a", "start"), F.least("b", "__end")
        first = F.col("__bucket") == F.expr("shiftright(greatest(a, start), __level)")
        pieces.append(j.where((low < high) & first).select(doc, "a", "b", "file", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high")))
    return pieces[0].unionByName(pieces[1])


def heading_intervals(headings: DataFrame, doc: str, levels: int = 6) -> DataFrame:
    """(doc, start, level, end, parent): a heading lasts to the next of its level or above; its parent is the last
    of a lower level before it. start is unique in a document.

    A document of any size is cut into blocks of headings in a row: running windows in a block, read from its end for what comes
    after, and what a block's neighbours have, a row a block.
    """
    rows = scans.in_blocks(headings.select(doc, "start", "level"), doc, ["start"], "__block")
    block = Window.partitionBy(doc, "__block")
    before = block.orderBy("start", "__block_tie").rowsBetween(Window.unboundedPreceding, -1)
    after = block.orderBy(F.desc("start"), F.desc("__block_tie")).rowsBetween(Window.unboundedPreceding, -1)
    ending = [F.when(F.col("level") <= n, F.col("start")) for n in range(levels)]
    holding = [F.when(F.col("level") < n, F.col("start")) for n in range(levels)]

    def own(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.col("level") == n, v) for n, v in enumerate(values)], F.lit(None).cast("bigint"))

    rows = rows.withColumn("__parent", own([F.max(x).over(before) for x in holding])).withColumn("__end", own([F.min(x).over(after) for x in ending]))
    whole = rows.groupBy(F.col(doc).alias("__doc"), F.col("__block").alias("__b")).agg(*[F.min(x).alias(f"__e{n}") for n, x in enumerate(ending)], *[F.max(x).alias(f"__p{n}") for n, x in enumerate(holding)])
    earlier = Window.partitionBy("__doc").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("__doc").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("__doc", "__b", *[F.min(f"__e{n}").over(later).alias(f"__e{n}") for n in range(levels)], *[F.max(f"__p{n}").over(earlier).alias(f"__p{n}") for n in range(levels)])
    both = rows.join(carried, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__block") == F.col("__b")))
    end, parent = F.coalesce("__end", own([F.col(f"__e{n}") for n in range(levels)])), F.coalesce("__parent", own([F.col(f"__p{n}") for n in range(levels)]))
    return both.select(doc, "start", "level", end.alias("end"), parent.alias("parent"))


def attach_adjacent(items: DataFrame, doc: str) -> DataFrame:
    """(doc, at, statement): for each proof the statement just before it, through proofs in between, with only blank
    gaps. items: doc, at, kind ('statement', 'proof' or other), blank (is the gap before it blank?)."""
    order = Window.partitionBy(doc).orderBy("at")
    broken = F.when((F.col("kind") != "proof") | ~F.col("blank"), 1).otherwise(0)
    run = F.sum(broken).over(order)  # a run: one item and the proofs that follow without a break
    grouped = items.withColumn("__run", run)
    inside = Window.partitionBy(doc, "__run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.first(F.struct("at", "kind")).over(inside)
    return grouped.withColumn("__lead", lead).where("kind = 'proof'").select(doc, "at", F.when(F.col("__lead.kind") == "statement", F.col("__lead.at")).alias("statement"))
