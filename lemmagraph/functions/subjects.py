"""Subject codes and the subject filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a subject code: two digits, then perhaps a letter or a dash (fixed value).
CODE = r"^(\d\d)([A-Z-])?"


def family(code: Column) -> Column:
    """First three characters of a code, a missing third one read as a dash."""
    code = F.trim(code)
    letter = F.regexp_extract(code, CODE, 2)
    return F.when(code.rlike(CODE), F.concat(F.regexp_extract(code, CODE, 1), F.when(letter == "", "-").otherwise(letter))).otherwise(code.substr(1, 3))


def families(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(codes, lambda c: F.trim(c).rlike(CODE)), family)))


def passes(codes: Column, category: Column, wanted: list[str], categories: list[str]) -> Column:
    """By codes where there are any, else by category, null where there is neither."""
    chosen, named = F.array(*map(F.lit, wanted)).cast("array<string>"), F.array(*map(F.lit, categories)).cast("array<string>")
    return F.when(F.size(codes) > 0, F.exists(codes, lambda c: F.array_contains(chosen, family(c)))).when(category != "", F.array_contains(named, category))
