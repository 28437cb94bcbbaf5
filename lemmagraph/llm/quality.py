"""Quality rules from tokeniser fertility.

Two public vocabularies tell how familiar a text looks. By one with byte fallback: characters per token, the share of
tokens that are single fallback bytes, and the entropy of the token distribution. By a byte-level one for many
languages: characters per token, and the share of tokens that are a part of a character alone. Texts of one language or
script keep to a band of each; a text outside the band of its language (or, where the language is unknown, of
its script) is rejected. Base counts and the base rule come with it.

Words never share a piece (pieces do not cross white space), so each distinct word is tokenised once, and remembered.

Defined results: a null or empty text has no words, all counts are zero and it fails the base rule (under 50
words). Repeated rows give repeated rows, an empty table an empty one, other columns are not looked at.
"""

from __future__ import annotations

import base64
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentMemo, append_columns, gather, resident

MIN_WORDS = 50
#: Bits of entropy that longer texts are compared with.
MOST_EVEN = 9.0
REPEATED_PERCENT = 50
#: ASCII symbols that count as such (fixed values of the rule).
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"


class Band(NamedTuple):
    """Least and most characters a token, most fallback-byte share, least and most bits of entropy by length.

    Entropy is compared with the entropy an even distribution over the text's tokens would have: a text of n
    tokens can't exceed log2(n) bits, so the limits are shares of that (of 9 bits at most).
    """

    chars_low: float
    chars_high: float
    byte_share: float
    entropy_share: float
    entropy_high: float = float("inf")
    #: By the second vocabulary.
    chars_low_2: float = 0.0
    chars_high_2: float = float("inf")
    byte_share_2: float = 1.0


#: Of the documents that bands are fitted on, the share beyond either end of a limit; the most fallback bytes.
OUTSIDE, BYTE_SHARE = 0.001, 0.01
#: Times as many lie below the least entropy, which tells junk best; and by the second vocabulary, much like the first.
OUTSIDE_ENTROPY, OUTSIDE_2 = 5, 0.5
#: Bands by language, then by script; parameters of the operator. All but `other` are fit_bands of the documents of
#: even id labelled good at sf0.1. No table has another script: the limits of `other` are not fitted.
BANDS = {
    "en": Band(1.988, 2.394, BYTE_SHARE, 0.715, 0.877, 2.022, 2.445, 0.010),
    "de": Band(2.053, 2.418, BYTE_SHARE, 0.701, 0.849, 2.163, 2.466, 0.027),
    "fr": Band(1.724, 2.149, BYTE_SHARE, 0.696, 0.847, 1.865, 2.168, 0.015),
    "es": Band(1.801, 2.075, BYTE_SHARE, 0.704, 0.831, 1.919, 2.186, 0.024),
    "latin": Band(1.777, 2.407, BYTE_SHARE, 0.700, 0.870, 1.880, 2.461, 0.027),
    "other": Band(0.3, 6.0, 0.90, 0.40),
}


class Fertility(NamedTuple):
    chars_per_token: float
    byte_share: float
    entropy: float
    n_tokens: int
    chars_per_token_2: float = 1.0
    byte_share_2: float = 0.0


class Measurer:
    def __init__(self, model: str, second: str, memo: int = 300_000):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=model)
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        with open(second, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts = frozenset(rank for token, rank in ranks.items() if len(token) == 1 and token[0] > 0x7F)
        #: Of each word: tokens and lone bytes by the second vocabulary, then the pieces of the first.
        self.words = SegmentMemo(self._learn, memo, np.int32)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.to_pylist()
        flat: list[int] = []
        sizes = []
        for word, pieces in zip(words, self.sp.encode(words, num_threads=1) if words else []):
            tokens = self.second.encode_ordinary(" " + word)
            flat += (len(tokens), len(self.parts.intersection(tokens)) and sum(t in self.parts for t in tokens), *pieces)
            sizes.append(len(pieces) + 2)
        return np.array(flat, np.int32), np.array(sizes, np.int64)

    def measure(self, texts: list[str], chars: list[int]) -> tuple[list[np.ndarray], list[Fertility]]:
        """Of each text its words, as numbers, and its fertility. chars: code points of its words."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        flat, start, size = self.words(coded.dictionary)
        word = coded.indices.to_numpy()
        some = (pc.binary_length(coded.dictionary).to_numpy() > 0)[word] if len(word) else np.empty(0, bool)  # white space at an end splits off nothing
        bounds = np.concatenate([[0], np.cumsum(some)])[split.offsets.to_numpy()]
        word = word[some]
        head = np.zeros((len(start), 2), np.int64) if not len(flat) else np.stack([flat[start], flat[start + 1]], 1)
        seconds = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(head[word], axis=0)])[bounds]
        pieces = gather(flat, start[word] + 2, size[word] - 2)
        ends = np.concatenate([[0], np.cumsum(size[word] - 2)])[bounds]
        numbers, found = [], []
        for k, n_chars in enumerate(chars):
            numbers.append(word[bounds[k] : bounds[k + 1]])
            own = pieces[ends[k] : ends[k + 1]]
            n, (n_2, bytes_2) = len(own), (seconds[k + 1] - seconds[k]).tolist()
            if not n:
                found.append(Fertility(0.0, 0.0, 0.0, 0, 0.0, 0.0))
                continue
            counts = np.bincount(own)
            kinds = np.flatnonzero(counts)
            counts = counts[kinds]
            share = counts / n
            found.append(Fertility(n_chars / n, float(counts[self.fallback[kinds]].sum() / n), float(-(share * np.log2(share)).sum()) + 0.0, n, n_chars / n_2, bytes_2 / n_2))
        return numbers, found


def measurer(model: str, second: str) -> Measurer:
    return resident(("quality", model, second), lambda: Measurer(model, second))


def repeated_words(words: np.ndarray) -> int:
    """Positions inside a window of three words (numbers) that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    if int(words.max()) + 1 > 1 << 20:
        words = np.unique(words, return_inverse=True)[1]
    words = words.astype(np.int64)
    span = int(words.max()) + 1
    pairs = words[:-1] * span + words[1:]
    if span > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, times = np.unique(pairs[:-1] * span + words[2:], return_inverse=True, return_counts=True)
    again = times[where] > 1
    held = np.zeros(n, bool)
    for shift in range(3):
        held[shift : n - 2 + shift] |= again
    return int(held.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """`latin` if most letters are Latin, else `other`; without letters `latin`."""
    letters = [c for c in text if c.isalpha()]
    return "latin" if 2 * sum(c < "ɐ" or "Ḁ" <= c < "ἀ" for c in letters) >= len(letters) else "other"


def within(f: Fertility, band: Band) -> bool:
    even = float(np.log2(f.n_tokens)) if f.n_tokens > 1 else 0.0
    first = band.chars_low <= f.chars_per_token <= band.chars_high and f.byte_share <= band.byte_share and band.entropy_share * min(even, MOST_EVEN) <= f.entropy <= band.entropy_high * min(even, MOST_EVEN)
    return first and band.chars_low_2 <= f.chars_per_token_2 <= band.chars_high_2 and f.byte_share_2 <= band.byte_share_2


def assess_all(texts: list[str | None], langs: list[str | None], m: Measurer, bands: dict[str, Band]) -> list[tuple]:
    whole = [t or "" for t in texts]
    chars = [len(t) - sum(map(t.count, SPACES)) for t in whole]
    out = []
    for text, lang, word_chars, words, f in zip(whole, langs, chars, *m.measure(whole, chars)):
        raw = text.encode()
        n, n_repeat = len(words), repeated_words(words)
        band = bands.get(lang or "") or bands[script_of(text)]
        base_failed = n < MIN_WORDS or 100 * n_repeat > REPEATED_PERCENT * n
        kept = not base_failed and within(f, band)
        out.append((n, word_chars, sum(raw.count(bytes([c])) for c in SYMBOLS), duplicate_lines(raw), n_repeat, base_failed, kept, f.chars_per_token, f.byte_share, f.entropy, f.chars_per_token_2, f.byte_share_2))
    return out


def assess(text: str | None, lang: str | None, m: Measurer, bands: dict[str, Band]) -> tuple:
    return assess_all([text], [lang], m, bands)[0]


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, chars_per_token_2 double, byte_share_2 double"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_second() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def measure(docs: DataFrame, model: str | None = None, bands: dict[str, Band] = BANDS, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, second: str | None = None) -> DataFrame:
    """docs (or the kept columns) with base counts, verdict and fertility of every whole text."""
    path, path_2 = model or default_model(), second or default_second()
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[f.split(" ")[1]] for f in SCHEMA.split(", ")]

    def start():
        m = measurer(path, path_2)
        return lambda texts, langs: [pa.array(c, t) for c, t in zip(zip(*assess_all(texts, langs, m, bands)), types)]

    return append_columns(docs, [text_col, lang_col], SCHEMA, start, keep, 1024)


def fit_bands(docs: DataFrame, good: DataFrame, outside: float = OUTSIDE, byte_share: float = BYTE_SHARE, model: str | None = None) -> dict[str, Band]:
    """A band a language, and `latin` over all of them, from the documents whose doc_id is in good and that pass the
    base rule: the share `outside` of them lies beyond either end of a limit, OUTSIDE_ENTROPY times that below the least
    entropy, OUTSIDE_2 times that beyond those by the second vocabulary. All languages must be of Latin script."""
    measured = measure(docs, model).where(~F.col("base_failed") & (F.col("chars_per_token") > 0)).join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    n_tokens = F.round(F.col("word_chars") / F.col("chars_per_token"))
    share = F.col("token_entropy") / F.least(F.log2(n_tokens), F.lit(MOST_EVEN))
    ends = F.array(F.lit(outside), F.lit(1 - outside))
    ends_entropy = F.array(F.lit(OUTSIDE_ENTROPY * outside), F.lit(1 - outside))
    ends_2 = F.array(F.lit(OUTSIDE_2 * outside), F.lit(1 - OUTSIDE_2 * outside))
    limits = [F.percentile("chars_per_token", ends).alias("chars"), F.percentile(share, ends_entropy).alias("share"), F.percentile("chars_per_token_2", ends_2).alias("chars_2"), F.max("byte_share_2").alias("bytes_2")]
    rows = measured.where(F.col("lang").isNotNull()).groupBy("lang").agg(*limits).collect() + measured.agg(F.lit("latin").alias("lang"), *limits).collect()
    return {r.lang: Band(r.chars[0], r.chars[1], byte_share, r.share[0], r.share[1], r.chars_2[0], r.chars_2[1], r.bytes_2 + byte_share) for r in rows if r.chars}
