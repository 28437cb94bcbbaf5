"""Language identification by rank-order n-gram profiles.

A profile is the list of the PROFILE most frequent n-grams (1 to MAX_N letters, words padded with a blank on
both sides) in order of frequency, ties in code point order. A document's profile is compared with each
language's: every n-gram adds the difference of its two ranks, or PROFILE if the language lacks it, and the
smallest sum (the out-of-place distance) wins, ties by the name of the language. An n-gram is one integer that holds
its code points, so a document is counted by one sort of integers, without a memo that grows with the vocabulary.

Learning reads only text and language of the rows it is given: about `sample_rows` rows of each language,
taken by a hash of the id. That bound is the only one; prediction reads every whole text.

Defined results: a null text, or one without letters, is `und` with score 0. Rows whose language is null
teach nothing. Without any labelled row every text is `und`. Repeated rows give repeated rows, an empty table
an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, in_remainder, resident

MAX_N = 3
PROFILE = 300
SAMPLE_ROWS = 1000
UNKNOWN = "und"
#: Bits of a code point in the number of an n-gram: numbers compare as the n-grams do in code point order.
WIDTH = 21
BLANK = 0x20
#: Characters counted at a time.
PART = 1 << 20


@cache
def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_number(gram: str) -> int:
    return sum(ord(c) << WIDTH * (MAX_N - 1 - i) for i, c in enumerate(gram))


def _runs(text: str) -> np.ndarray:
    """Code points of the letter runs in lower case, a blank before, between and behind; empty if there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[code]
    code = np.where(is_letter, code, BLANK)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of the signs behind a letter the first one stays, as the blank
    code = code[keep].astype(np.int64)
    return np.pad(code, (1, int(code[-1] != BLANK)), constant_values=BLANK) if len(code) else code


def count_ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (ascending) and counts of the n-grams of the letter runs, each run padded with blanks; lone blanks are
    left out, and so are n-grams that reach from one run into the next."""
    code = _runs(text or "")
    numbers, counts = [], []
    for at in range(0, max(len(code) - 1, 0), PART):
        part = code[at : at + PART + 2]
        one = part[:-1] << 2 * WIDTH
        two = one + (part[1:] << WIDTH)
        letter = part != BLANK
        own = min(PART, len(part) - 1)  # n-grams that begin in this part
        middle = letter[1:-1]
        grams = [one[:own][letter[:own]], two[:own][letter[:own] | letter[1 : own + 1]], (two[:-1] + part[2:])[:own][middle[:own]]]
        n, c = np.unique(np.concatenate(grams), return_counts=True)
        numbers.append(n)
        counts.append(c)
    if len(numbers) < 2:
        return (numbers[0], counts[0]) if numbers else (code, code)
    n, back = np.unique(np.concatenate(numbers), return_inverse=True)
    return n, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def profiles(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Learn a profile (numbers of n-grams) for every language. The driver receives PROFILE n-grams a language."""
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return {}
    spread = 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(spread, -(-sample_rows * spread // n)))])
    sample = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(spread)) < share[F.col(lang_col)]).select(lang_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang: dict[str, list] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of_lang[lang].append(count_ngrams(text))
            for lang, counted in of_lang.items():
                grams, back = np.unique(np.concatenate([n for n, _ in counted]), return_inverse=True)
                times = np.bincount(back, np.concatenate([c for _, c in counted]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(times)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "place", "gram").collect()
    out: dict[str, list[int]] = {lang: [] for lang in sorted(sizes)}
    for lang, _, gram in sorted(tuple(r) for r in top):
        out[lang].append(gram)
    return {lang: grams for lang, grams in out.items() if grams}


class Ranker:
    """Compares texts with profiles: the n-grams of all profiles in order, and their ranks in each (PROFILE or more: none)."""

    def __init__(self, learned: dict[str, list[int]]):
        self.langs = sorted(learned)
        self.grams = np.array(sorted({g for grams in learned.values() for g in grams}), np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, learned[lang]), k] = np.arange(len(learned[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = count_ngrams(text)
        if not self.langs or not len(grams):
            return UNKNOWN, 0.0
        if len(grams) > PROFILE:
            often = counts >= -np.partition(-counts, PROFILE - 1)[PROFILE - 1]
            grams, counts = grams[often], counts[often]
        grams = grams[np.argsort(-counts, kind="stable")[:PROFILE]]
        at = np.searchsorted(self.grams, grams)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != grams] = len(self.grams)
        ranks = self.rank[at]
        off = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (PROFILE * len(grams)))


def predict(docs: DataFrame, learned: dict[str, list[int]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the kept columns) with lang_pred and score: 1 less the out-of-place distance as a share of the largest."""

    def start():
        ranker = resident(("profiles", tuple((lang, *grams) for lang, grams in sorted(learned.items()))), lambda: Ranker(learned))

        def work(texts: list) -> list:
            found = [ranker.predict(t) for t in texts]
            return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

        return work

    return append_columns(docs, [text_col], "lang_pred string, score double", start, keep)


def held_out() -> Column:
    return in_remainder("doc_id", 4, 2)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    learned = profiles(docs.where(~held_out()))
    return predict(docs, learned, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
