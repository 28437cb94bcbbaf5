"""Text functions: search terms, folding, markup, cached-answer paths."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@cache
def _bases() -> tuple[str, str]:
    """Letters with marks that are one character, and their bases, by the canonical decomposition of every letter."""
    letters = (c for c in map(chr, range(0xC0, min(sys.maxunicode, 0x2000))) if c.isalpha())
    pairs = [(c, d[0]) for c in letters if len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case, without marks; runs in the JVM."""
    return F.regexp_replace(F.translate(F.lower(text), *_bases()), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """Distinct tokens of a question, folded as texts are."""
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.category(c).startswith("M"))
    return sorted({t for t in re.split(r"[^\w]|_", plain) if t})


#: Bibliography markup removed, in order: accents before a letter, commands, math signs and braces (fixed values).
_PLAIN = [(r"\\[`'^\"~=.uvHck]\s*\{?\s*([A-Za-z])\s*\}?", r"\1"), (r"\\[A-Za-z]+\*?\s*", " "), (r"[{}$]", ""), ("--+", "-")]


def plain_text(text: str) -> str:
    for pattern, by in _PLAIN:
        text = re.sub(pattern, by, text)
    return text


def fold_text(text: str) -> str:
    """Without markup, compatibility-decomposed, without marks, lower case, all but a-z and 0-9 one blank, trimmed."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain_text(text)) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", plain.lower()).strip()


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def plain(text: Column) -> Column:
    """Text without bibliography markup; ties and lone backslashes are blanks."""
    for pattern, by in [*_PLAIN, (r"[~\\\s]+", " ")]:
        text = F.regexp_replace(text, pattern, by.replace("\\", "$"))
    return F.trim(text)


def surname(name: Column) -> Column:
    """Before the comma, else the last word."""
    return F.when(F.contains(name, F.lit(",")), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def entry_surnames(authors: Column) -> Column:
    """Surnames of an entry's author field, `others` left out."""
    names = F.transform(F.split(F.coalesce(authors, F.lit("")), r"\s+and\s+"), plain)
    return F.transform(F.filter(names, lambda n: (n != "") & (F.lower(n) != "others")), surname)


def entry_query(title: Column, authors: Column, year: Column, date: Column) -> Column:
    """struct(title, surnames, year): what an entry is looked up by; a date serves where there is no year."""
    when = F.coalesce(F.nullif(F.coalesce(year, F.lit("")), F.lit("")), date, F.lit(""))
    return F.struct(plain(F.coalesce(title, F.lit(""))).alias("title"), entry_surnames(authors).alias("surnames"), F.trim(when).substr(1, 4).alias("year"))


def bibliographic(query: Column, text: Column) -> Column:
    """One free text of what a query knows: the text itself where there is one."""
    known = F.filter(F.array(F.array_join(query["surnames"], " "), query["title"], query["year"]), lambda x: x != "")
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.array_join(known, " "))


def without_labels(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\label\s*\{[^}]*\}[ \t]*\n?", ""), r"^\n+|\n+$", "")


def norm_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(label, r"\s+", " "))


def answer_path(service: Column, url: Column) -> Column:
    return F.concat(service, F.lit("/"), F.sha2(url, 256).substr(1, 32), F.lit(".json"))


def prefix_slug(ident: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(ident, "[^A-Za-z0-9.-]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "work").otherwise(slug)


def last_year(text: Column) -> Column:
    """The last year a text mentions, null if none."""
    return F.element_at(F.nullif(F.regexp_extract_all(text, F.lit(r"\b((?:1[5-9]|20)\d\d)\b"), F.lit(1)), F.array().cast("array<string>")), -1)


def synthetic(surnames: Column, title: Column, year: Column) -> Column:
    """`work:` and eight hex digits of what an entry without identifier states."""
    raw = F.concat_ws("|", F.array_join(surnames, "+"), title, year)
    return F.concat(F.lit("work:"), F.sha2(_squash(raw), 256).substr(1, 8))


@F.pandas_udf(StringType())
def _squash(raw: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        marks = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9|+]+", "", marks.lower())

    return raw.map(one, na_action="ignore")


#: Typesetting programs that may be named; others are read as the first (fixed values).
ENGINES = ("pdflatex", "xelatex", "lualatex", "latex")


def engine(name: Column, default: str = "pdflatex") -> Column:
    name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(name.isin(*ENGINES), name).otherwise(default)
