"""Upserts as keep-last: the latest row of a key replaces the earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row a key: the last in order. max_by aggregates before the shuffle, so a key with many rows costs no sort."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.max_by(F.struct(*rest), at)
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in order (min_by; combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The table after rows: replaced where a key occurs, added where it does not."""
    latest = keep_last(rows, keys, order).select(*table.columns)
    return table.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest)


def alias_table(works: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """(id, work): every identifier of every work and the key itself; the last writer of an identifier holds it."""
    own = F.array_distinct(F.filter(F.concat(F.array("key"), "ids"), lambda x: x != ""))
    exploded = works.select(F.explode(own).alias("id"), F.col("key").alias("work"), *[F.col(o) if isinstance(o, str) else o for o in order])
    names = [o for o in order if isinstance(o, str)]
    return keep_last(exploded, ["id"], [*names, "work"]).select("id", "work")


def merge_versions(versions: DataFrame, seq: str) -> DataFrame:
    """One row an id: flags or-ed, the first text that is not empty wins."""
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(seq))), F.lit("")).alias(c)
    return versions.groupBy("id").agg(F.bool_or("has_source").alias("has_source"), F.bool_or("has_pdf").alias("has_pdf"), *[first(c) for c in ("work", "method", "numbering", "extracted_at")])


def merge_references(refs: DataFrame, work: str, seq: str) -> DataFrame:
    """One entry a normal identifier; entries known as text only are one a text. The first in order stays."""
    identity = F.when(F.col("cited") != "", F.concat(F.lit("i:"), ids.norm(F.col("cited")))).otherwise(F.concat(F.lit("t:"), F.col("text")))
    return keep_first(refs.withColumn("identity", identity), [work, "identity"], [F.col(seq)])


def merge_records(records: DataFrame, group: str, seq: str) -> DataFrame:
    """Records of one group as one: first texts that are not empty, least depth that is set, unions in order, a
    provenance other than declared preferred.

    Unions are aggregated before they are lists: a value of a group is one row, that of its first place, so that the work grows
    with the values. seq is unique in a group. Identifiers are one by their normal form.
    """
    unions = ("ids", "authors", "msc", "reached_from")
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(seq))), F.lit("")).alias(c)
    found = F.col("provenance") != "declared"
    single = records.groupBy(group).agg(
        first("title"), first("year"), first("arxiv_category"),
        F.coalesce(F.min(F.when(F.col("depth") > 0, F.col("depth"))), F.lit(0)).alias("depth"),
        F.coalesce(F.min_by(F.when(found, F.col("provenance")), F.when(found, F.col(seq))), F.lit("declared")).alias("provenance"),
    )

    none = F.array().cast("array<struct<of:string,at:int,value:string>>")
    placed = lambda c: F.coalesce(F.transform(c, lambda x, i: F.struct(F.lit(c).alias("of"), i.alias("at"), x.alias("value"))), none)
    of, value, is_id = F.col("x.of"), F.col("x.value"), F.col("x.of") == "ids"
    each = records.select(group, seq, F.explode(F.concat(*map(placed, unions))).alias("x")).where(value.isNotNull() & (is_id | (value != "")))
    keyed = each.select(group, of.alias("__of"), F.when(is_id, ids.norm(value)).otherwise(value).alias("__key"), F.struct(F.col(seq).alias("seq"), F.col("x.at").alias("at"), value.alias("value")).alias("__at"))
    once = keyed.groupBy(group, "__of", "__key").agg(F.min("__at").alias("__at"))
    # identifiers by rank first, all else by place only
    rank = F.when(F.col("__of") == "ids", ids.rank(F.col("__at.value"))).otherwise(0)
    once = once.select(F.col(group).alias("__group"), "__of", F.struct(rank.alias("rank"), "__at").alias("__at"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("__of") == c, F.col("__at")))), lambda x: x["__at"]["value"]).alias(c)
    lists = once.groupBy("__group").agg(*map(listed, unions))

    both = single.join(lists, F.col(group).eqNullSafe(F.col("__group")), "left")
    held = {c: F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in unions}
    return both.select(group, held["ids"], "title", "year", held["authors"], held["msc"], "arxiv_category", "depth", held["reached_from"], "provenance")


def section_windows(df: DataFrame, document: str, at: str) -> DataFrame:
    """Section and statement numbers of the plain case (no appendix, no recorded numbers): counts over windows.

    Columns kind ('section', 'subsection' or a counter's name). A counter restarts in each section.
    """
    order = Window.partitionBy(document).orderBy(at)
    section = F.sum(F.when(F.col("kind") == "section", 1).otherwise(0)).over(order)
    numbered = df.withColumn("section", section)
    inner = Window.partitionBy(document, "section", "kind").orderBy(at)
    place = F.row_number().over(inner)
    number = F.when(F.col("kind") == "section", F.col("section").cast("string")).otherwise(F.concat_ws(".", F.col("section").cast("string"), place.cast("string")))
    return numbered.withColumn("number", number)
