"""Scans over ordered rows as windows: pacing of requests, nested counters, matched brackets. Nothing leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def in_blocks(rows: DataFrame, key: str, order: list[str], block: str) -> DataFrame:
    """Rows sorted by key and order and dealt by range, so that a key of any size fills as many tasks as it needs; block: the
    number of the task, ascending in that order. Rows equal in key and order stay in an order of their own."""
    tie = f"{block}_tie"
    placed = cut(rows).withColumn(tie, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(key, *order, tie).sortWithinPartitions(key, *order, tie)
    return cut(placed.withColumn(block, F.spark_partition_id()))


def summed_before(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Rows with name: the sum of value over the rows of their key that come before in order, 0 for none. Sums are found in each
    block of a key and carried over to its next blocks, a row a block."""
    held = in_blocks(rows, key, order, "__block")
    inside = Window.partitionBy(key, "__block").orderBy(*order, "__block_tie").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = held.groupBy(key, "__block").agg(F.sum(value).alias("__n"))
    carried = whole.select(F.col(key).alias("__key"), F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__carried"))
    both = held.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    return cut(both.select(*rows.columns, (F.col("__carried") + F.col("__here")).cast("bigint").alias(name)))


def paced(requests: DataFrame, host: str, arrival: str, order: list[str], spacing: Mapping[str, int], least: int) -> DataFrame:
    """Requests with start: when each may begin if a host is asked in order of arrival (ties by order), spacing apart (least for
    hosts that are not named). Times and spacings are whole numbers of one unit.

    start(i) = max over j <= i of arrival(j) + spacing * (i - j): a running maximum of arrival less spacing times place.
    Places and maxima are found in each block of a host and carried over to its next blocks, a row a block.
    """
    gap = F.lit(least)
    for name, units in spacing.items():
        gap = F.when(F.col(host) == name, units).otherwise(gap)
    keys = [arrival, *order]
    rows = in_blocks(requests.withColumn("__gap", gap.cast("bigint")), host, keys, "__block")
    inside = Window.partitionBy(host, "__block").orderBy(*keys, "__block_tie")
    rows = rows.withColumn("__at", F.row_number().over(inside).cast("bigint")).withColumn("__free", F.col(arrival) - F.col("__gap") * F.col("__at"))
    whole = rows.groupBy(host, "__block").agg(F.count("*").alias("__n"), F.max("__free").alias("__most"), F.max("__gap").alias("__g"))
    before = Window.partitionBy(host).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    placed = placed.withColumn("__carried", F.max(F.col("__most") - F.col("__g") * F.col("__before")).over(before)).select(F.col(host).alias("__host"), F.col("__block").alias("__b"), "__before", "__carried")
    both = rows.join(placed, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__block") == F.col("__b")))
    here = F.max("__free").over(inside) - F.col("__gap") * F.col("__before")
    start = F.greatest(here, "__carried") + F.col("__gap") * (F.col("__before") + F.col("__at"))
    return both.withColumn("start", start).select(*requests.columns, "start")


#: Events that a task of a scan over documents gets, about.
EVENTS = 1 << 18


def _spread(events: DataFrame, doc: str) -> DataFrame:
    """Events dealt by document to as many tasks as they fill, where the session's number of partitions is too small for that."""
    spark = events.sparkSession
    tasks = math.ceil(events.count() / EVENTS)
    return events.repartition(tasks, doc) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) or tasks > spark.sparkContext.defaultParallelism else events


#: Sectioning levels that count: section, subsection, and so on (fixed values).
LEVELS = 5


def _character(point: Column) -> Column:
    """The character of a code point, null where there is none; Spark's own char takes it modulo 256."""
    some = point.between(0, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return F.when(some, F.decode(F.unhex(F.lpad(F.hex(point.cast("bigint")), 8, "0")), "UTF-32"))


def numbered(events: DataFrame, doc: str = "doc", at: str = "at") -> DataFrame:
    """Events with number: what headings and items of a document are called.

    events: kind (`heading`, `appendix`, `item`, else nothing), level (of a heading, 1 to LEVELS), counter and within (of
    an item: its counter and the level it restarts with, 0 for never; the same for all items of a counter), recorded
    (of an item: a number known from elsewhere, else empty). A heading steps its level and restarts those below and the
    counters within it or a level below it; an appendix restarts all levels and letters the first one (the code points from A
    on; a number where there is no such character); a recorded number is the item's own, and counting goes on from its parts. Order is by `at`, which should be unique in a document; null numbers
    are those of other kinds.
    """
    order = Window.partitionBy(doc).orderBy(at)
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    heading, appendix, item = F.col("kind") == "heading", F.col("kind") == "appendix", F.col("kind") == "item"
    told = item & (F.coalesce("recorded", F.lit("")) != "")
    parts = F.when(told, F.split("recorded", "[.]"))
    # parts before the last one set levels, if the item's counter is within one
    levels = F.when(F.coalesce("within", F.lit(0)) > 0, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))

    def digits(text: Column) -> Column:
        return F.when(text.rlike("^[0-9]+$"), text.cast("bigint"))

    def shown_part(level: int) -> Column:
        part = F.get(levels, F.lit(level - 1))
        return F.coalesce(digits(part), F.when(part.rlike("^[A-Z]$"), F.ascii(part) - 64) if level == 1 else F.lit(None)).cast("bigint")

    letter = told & F.coalesce(F.get(levels, F.lit(0)).rlike("^[A-Z]$"), F.lit(False))
    level, within = F.col("level"), F.col("within")
    steps = {n: F.sum((heading & (level == n)).cast("bigint")).over(so_far) for n in range(1, LEVELS + 1)}
    # headings that restart a counter within a level
    restart = F.lit(0)
    for n in range(1, LEVELS + 1):
        restart = F.when(item & (within == n), F.sum((heading & (level <= n)).cast("bigint")).over(so_far)).otherwise(restart)
    rows = _spread(events, doc).withColumns({f"__n{n}": steps[n] for n in steps} | {
        "__letters": F.coalesce(F.max(F.when(appendix, 1)).over(so_far), F.max(F.when(letter, 1)).over(earlier), F.lit(0)) == 1,
        "__restart": restart,
    })
    # what a level is after an event: the value it was last set to, and the headings of that level since
    value = {}
    for n in range(1, LEVELS + 1):
        part = shown_part(n)
        to = F.when((heading & (level < n)) | appendix, F.lit(0).cast("bigint")).when(part.isNotNull(), part)
        value[n] = F.coalesce(F.last(to - F.col(f"__n{n}"), ignorenulls=True).over(so_far), F.lit(0)) + F.col(f"__n{n}")
    rows = rows.withColumns({f"__s{n}": value[n] for n in value})

    def level_text(n: int) -> Column:
        s = F.col(f"__s{n}")
        return F.when(F.col("__letters"), F.coalesce(_character(F.lit(64) + F.greatest(s, F.lit(1))), s.cast("string"))).otherwise(s.cast("string")) if n == 1 else s.cast("string")

    def prefix(depth: Column) -> Column:
        return F.concat_ws(".", *[F.when(depth >= n, level_text(n)) for n in range(1, LEVELS + 1)])

    # from here on a row has its text so far, not the levels: the next sort holds little
    shown = F.when(heading & level.between(1, LEVELS), prefix(level)).when(item & (within > 0), prefix(within))
    rows = rows.select(*events.columns, shown.alias("__shown"), F.when(item, F.col("__restart")).alias("__restart"), F.when(item, F.col("counter")).alias("__counter"))
    own = Window.partitionBy(doc, "__counter", "__restart").orderBy(at)
    rows = rows.withColumn("__place", F.row_number().over(own).cast("bigint"))
    # a counter goes on from the last number told before
    last = digits(F.element_at(parts, -1))
    base = F.coalesce(F.last(last - F.col("__place"), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__value", (base + F.col("__place")).cast("string"))
    counted = F.when(within > 0, F.concat_ws(".", "__shown", "__value")).otherwise(F.col("__value"))
    number = F.when(heading, F.col("__shown")).when(told, F.col("recorded")).when(item, counted)
    return rows.withColumn("number", number).select(*events.columns, "number")


def matched(marks: DataFrame, doc: str = "doc", at: str = "at") -> DataFrame:
    """(doc, at, name, close, depth, parent, problem): begins with their ends and the begin they stand in, and ends without a begin.

    marks: kind (`begin` or `end`), name, at (unique in a document). Depth is a running sum of begins less ends that
    never falls under zero: a begin and the first later end at its depth belong together, whatever their names, and a begin stands in
    the last one before it at the depth above. Problems: `unclosed`, `stray end` (nothing is open), `mismatched` (the end has
    another name).
    """
    order = Window.partitionBy(doc).orderBy(at)
    step = F.when(F.col("kind") == "begin", 1).otherwise(-1)
    rows = marks.where(F.col("kind").isin("begin", "end")).withColumn("__sum", F.sum(step).over(order))
    under = F.least(F.min("__sum").over(order), F.lit(0))
    rows = rows.withColumn("__under", under).withColumn("__depth", F.col("__sum") - F.col("__under"))
    was = F.coalesce(F.lag("__under").over(order), F.lit(0))
    stray = (F.col("kind") == "end") & (F.col("__under") < was)
    rows = rows.withColumn("__stray", stray).withColumn("__level", F.when(F.col("kind") == "begin", F.col("__depth")).otherwise(F.col("__depth") + 1))
    level = Window.partitionBy(doc, "__stray", "__level").orderBy(at)
    rows = rows.withColumn("__next", F.lead(F.struct("kind", "name", at)).over(level))
    closed = F.when(F.col("__next.kind") == "end", F.col("__next"))
    begins = rows.where("kind = 'begin'")
    found = begins.select(doc, at, "name", closed.alias("__end"), "__level")
    # each begin counts at its own depth, and asks at the depth above
    own, above = F.struct(F.col("__level").alias("depth"), F.lit(True).alias("counts")), F.struct((F.col("__level") - 1).alias("depth"), F.lit(False).alias("counts"))
    each = found.withColumn("__as", F.explode(F.array(own, above)))
    met = F.last(F.when(F.col("__as.counts"), F.col(at)), ignorenulls=True).over(Window.partitionBy(doc, "__as.depth").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("parent", met).where("not __as.counts")
    problem = F.when(F.col("__end").isNull(), "unclosed").when(~F.col("__end.name").eqNullSafe(F.col("name")), "mismatched").otherwise("")
    out = found.select(doc, at, "name", F.col(f"__end.{at}").alias("close"), F.col("__level").cast("int").alias("depth"), "parent", problem.alias("problem"))
    lost = rows.where("__stray").select(doc, at, "name", F.lit(None).cast(begins.schema[at].dataType).alias("close"), F.lit(0).alias("depth"), F.lit(None).cast(begins.schema[at].dataType).alias("parent"), F.lit("stray end").alias("problem"))
    return out.unionByName(lost)
