"""Language-model scores from Elias-Fano tries of any order, trained on the documents that are not held out.

The model grows with the corpus and never sits in one place: its levels are cut into shards of contexts, and
documents never meet the whole of it. Documents are read once into blocks of BLOCK_TOKENS tokens; a block asks only
for the distinct words and the distinct windows it holds, with how often its own training documents have them. A
word or pair that fills a third of the corpus is therefore one entry a block, and a context is cut by its successors
into one part for each CROWD occurrences, whatever the cluster. There are as many shards of contexts as SHARD_TOKENS goes into the
tokens, whatever the partitions: what a task holds of them does not grow with the corpus.

1. tokenise: blocks, and for each shard of words the distinct words of the block;
2. words: exact training counts of a shard of words, ids by shard and rank, handed back to the blocks;
3. pairs: base scores, and for each shard of contexts the distinct pairs of the block;
4. trie: training counts of a shard of contexts, the trie built (smoothed, quantised), memory-mapped, searched for
   every pair asked, and the codes handed back;
5. for each order above 2: the windows whose context was met in training are asked of the shards of the order's
   contexts, as in 3 and 4. A context that only this block holds is not sent: the block has all its counts, and builds
   the trie of such contexts itself;
6. scores: the sum of the codes of the highest order over each document; of the windows that are not asked at that
   order only their sum over each document is kept.

Ids are given by frequency and a request's windows are sorted by them, so that they are sent as steps. A shard that has
all of a context counts it; only the counts of crowded contexts are sent.

A phase ends with a table in the shared folder; its exchanges and the tables it was made of are deleted then. What is sent is sorted and packed;
counts and ids may exceed 32 bits.

Smoothing, by absolute discounting: p(w | v) = (c(vw) - D(c(vw))) / c(v) + b(v) p(w) with D of DISCOUNTS for counts of
1, 2, and more, b(v) the sum of the discounts of v's successors by c(v), and the base unigram p(w): a proper
distribution for every context, equal to the base where a context was never seen. Longer contexts are smoothed the same
way with the order below as their base; a window reaches back to the end token that opens its document, no further. A
context of more than CROWD occurrences takes b from the part of its successors that the window belongs to, times the
number of parts. log10 p and log10 b are kept to 1 / STEP at every order, down to 10^-16.

Defined results: a null or empty text is the end token alone. A null id is not held out. Repeated rows count and
score each. An empty table gives an empty table. Without training tokens N is 0. Other columns are not looked at.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_remainder, portions, remove, scratch_path, stored, trim
from .eliasfano import Trie, build_trie

BLOCK_TOKENS = 1 << 21
STEP = 4096
#: What entries of count 1, 2 and more give to shorter contexts.
DISCOUNTS = (0.9, 1.1, 1.3)
#: Occurrences of a context that one shard takes together.
CROWD = 1 << 20
#: Tokens of the whole table for each shard of contexts: it is asked for no more windows than that, about.
SHARD_TOKENS = 1 << 21
END = ""
#: Kinds of rows between blocks and shards.
WINDOWS, BASE, IDS, CODES, SUMS = range(5)
#: What a block is told of a window: never met in training, met, met in no other block (nor held out there).
UNMET, MET, ALONE = range(3)
#: Windows searched at a time: what a search needs beside them stays small.
SEARCH = 1 << 18
ROW = ["block", "shard", "kind", "a", "b"]
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return in_remainder("doc_id", 10, 0)


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart, compressed; the first byte is their width, 8 if one needs over 32 bits."""
    width = 8 if len(a) and int(a.max()) >> 32 else 4
    a = np.ascontiguousarray(a, f"<u{width}")
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(-1, width).T.tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _log10(code: np.ndarray) -> np.ndarray:
    return -code / STEP


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype(np.uint16)


def base_log10(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))


def discount(c: np.ndarray) -> np.ndarray:
    return np.where(c == 1, DISCOUNTS[0], np.where(c == 2, DISCOUNTS[1], DISCOUNTS[2]))


def parts_of(c: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-c.astype(np.int64) // CROWD))


def tokenise(docs: DataFrame, shards: int, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Rows (block, shard, n, ids, held, a, b): shard -1 holds the tokens (n of them, a) and lengths (b) of the block's documents,
    the others its distinct words (a), their training counts and places (b)."""
    narrow = docs.select(id_col, held.alias("held"), F.col(text_col).cast("string"))
    id_type = narrow.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        number: dict[str, int] = {}
        kind = None

        def fresh():
            nonlocal number
            number = defaultdict(count().__next__)
            number[END]
            return [], [], [], [], 0

        ids, outs, tokens, lengths, total = fresh()

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(tokens)
            sizes = np.array(lengths, np.int64)
            often = np.bincount(stream)
            often[0] = len(stream)  # the end token stays 0; frequent words get small numbers, which pack well
            order = np.argsort(-often, kind="stable")
            renamed = np.empty_like(order)
            renamed[order] = np.arange(len(order))
            stream = renamed[stream]
            train = np.repeat(~np.array(outs, bool), sizes)
            times = np.bincount(stream[train], minlength=len(number))
            words = list(number)
            words = [words[i] for i in order]
            part = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(shards + 1))
            rows = [(-1, ids, outs, squeeze(stream), squeeze(sizes))]
            pack = zstandard.ZstdCompressor(1).compress
            for s in range(shards):
                own = order[cuts[s] : cuts[s + 1]]
                if len(own):
                    rows.append((s, None, None, pack(" ".join([words[i] for i in own]).encode()), squeeze(np.concatenate([times[own], np.diff(own, prepend=0)]))))
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([len(stream)] + [None] * (len(rows) - 1), pa.int64()), pa.array([r[1] for r in rows], pa.list_(kind)), pa.array([r[2] for r in rows], pa.list_(pa.bool_())), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary())],
                names=["block", "shard", "n", "ids", "held", "a", "b"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in portions(batch, 2, 512, 1 << 22):
                split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(2), "")))
                coded = split.flatten().dictionary_encode()
                words = np.fromiter(map(number.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                word = words[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
                some = word > 0  # white space at the ends of a text splits off empty words
                ends = np.concatenate([[0], np.cumsum(some)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
                tokens.append(np.insert(word[some], ends[1:], 0))
                sizes = np.diff(ends) + 1
                lengths += sizes.tolist()
                ids += part.column(0).to_pylist()
                outs += part.column(1).to_pylist()
                total += int(sizes.sum())
                if total >= BLOCK_TOKENS:
                    yield flush()
                    block += 1
                    ids, outs, tokens, lengths, total = fresh()
        if ids:
            yield flush()

    return narrow.mapInArrow(run, f"block bigint, shard int, n bigint, ids array<{id_type}>, held array<boolean>, a binary, b binary")


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard of words: for each block (a) the rank and (b) the training count of its words; block -1: totals."""
    unpack = zstandard.ZstdDecompressor().decompress
    rank: dict[bytes, int] = defaultdict(count().__next__)
    asked = []
    for block, a, b in sorted(zip(pdf["block"], pdf["a"], pdf["b"])):
        words = unpack(a).split(b" ")
        asked.append((block, np.fromiter(map(rank.__getitem__, words), np.int64, len(words)), *unsqueeze(b).reshape(2, -1)))
    total = np.zeros(len(rank), np.int64)
    for _, r, times, _ in asked:
        total[r] += times  # words of a block are distinct
    often = np.argsort(-total, kind="stable")
    by_count = np.empty_like(often)
    by_count[often] = np.arange(len(often))  # frequent words get small ids, which pack well
    asked = [(block, by_count[r], total[r], place) for block, r, _, place in asked]
    shard = int(pdf["shard"].iat[0])
    rows = [(block, shard, squeeze(np.concatenate([r, c, place.astype(np.int64)])), 0, 0, 0) for block, r, c, place in asked]
    rows.append((-1, shard, b"", len(rank), int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(rows, columns=["block", "shard", "a", "words", "known", "tokens"])


def _stream(tokens: pd.DataFrame, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, numbered in the order of the words' ids (0 is the end token); place of each document's first token and
    its length; whether each token is of training; the ids by number. gid: the id of each word as the block numbers it."""
    row = tokens.iloc[0]
    order = np.argsort(gid)
    renamed = np.empty(len(order), np.int32)
    renamed[order] = np.arange(len(order), dtype=np.int32)
    sizes = unsqueeze(row["b"]).astype(np.int64)
    train = np.repeat(~np.asarray(list(row["held"]), bool), sizes)
    return renamed[unsqueeze(row["a"])], np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, train, gid[order]


def _split_counts(number: np.ndarray, train: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of `size` numbers occurs in training and held out."""
    times = np.bincount(number[train], minlength=size)
    return times.astype(np.int32), (np.bincount(number, minlength=size) - times).astype(np.int32)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A sorting of the keys, where each distinct one starts in it, its number for every key, and a place of each."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]])
    del ordered
    small = np.int32 if len(keys) < 1 << 31 else np.int64
    number = np.empty(len(keys), small)
    number[order] = np.cumsum(new, dtype=small) - small(1)
    starts = np.flatnonzero(new)
    return order, starts, number, order[starts]


def _keys(before: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """One number for each token and what is before it; 0 is the end token: it opens each document, too."""
    keys = np.zeros(len(stream), np.int64)
    keys[1:] = before[:-1]
    keys *= int(stream.max()) + 1
    keys += stream
    return keys


def _windows(stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of `order` words: the number of the distinct one at each token, and that of a word less; a place of
    each. A window that would reach before its document is the shorter one."""
    lower = stream
    number, place = distinct(_keys(stream, stream))[2:]
    for n in range(3, order + 1):
        lower = number
        keys = _keys(lower, stream)
        for k in range(n - 2):
            short = starts[sizes > k] + k
            keys[short] = -1 - lower[short]
        number, place = distinct(keys)[2:]
    return number, lower, place


def _home(block: int, shards: int) -> int:
    """The shard that what a block keeps passes through; numbers of blocks are far apart, so their remainders are few."""
    return (block * int(MIX) >> 33 & 0x7FFFFFFF) % shards


def ask_pairs(tokens: pd.DataFrame, words: pd.DataFrame, n: int, v: int, of_words: int, shards: int) -> pd.DataFrame:
    """Rows (block, shard, kind, a, b): the pairs asked of each shard, and in rows of any shard what the block keeps:
    base results, ids of its words. of_words: how many shards of words there are."""
    block = int(tokens["block"].iat[0])
    found = [(shard, *unsqueeze(a).reshape(3, -1)) for shard, a in zip(words["shard"], words["a"])]
    size = sum(len(x[1]) for x in found)
    ids, c = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    for shard, rank, times, place in found:
        place = np.cumsum(place.astype(np.int64))
        ids[place], c[place] = rank.astype(np.uint64) * np.uint64(of_words) + np.uint64(shard + 1), times
    ids[0] = 0  # the end token
    stream, starts, sizes, train, gid = _stream(tokens, ids)
    c = c[np.argsort(ids)]
    p1 = base_log10(c, n, v)
    base = np.add.reduceat(p1[stream], starts)
    known = np.add.reduceat((c > 0)[stream], starts, dtype=np.int64)
    number, _, place = _windows(stream, starts, sizes, 2)
    times, outs = _split_counts(number, train, len(place))
    word = stream[place]
    context = np.where(place > 0, stream[place - 1], 0)
    home = _home(block, shards)
    rows = [(block, home, BASE, base.tobytes(), known.astype("<i8").tobytes()), (block, home, IDS, squeeze(ids), b"")]
    rows += _asked(block, shards, np.arange(len(place)), (gid[context],), c[context], gid[word], times, outs, _code(p1)[word])
    return pd.DataFrame(rows, columns=ROW)


def _asked(block: int, shards: int, own: np.ndarray, names: tuple[np.ndarray, ...], c: np.ndarray, word: np.ndarray, times: np.ndarray, outs: np.ndarray, code: np.ndarray) -> list[tuple]:
    """Requests for windows: number in the block, name of the context (one or two ids), its count if it is crowded (a
    shard that has all of a context counts it), id of the word, own training and held-out counts, code of the base.
    The windows of a context come together, by ascending word."""
    mixed = word % parts_of(c).astype(np.uint64)
    for name in names:
        mixed = (mixed ^ name) * MIX
        mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    mixed >>= np.uint64(33)
    shard_of = (mixed % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
    del mixed
    order = np.argsort(shard_of, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(shard_of, minlength=shards))])
    rows = []
    for s in range(shards):
        at = order[edges[s] : edges[s + 1]]
        if len(at):
            new = np.concatenate([[True], np.any([x[at[1:]] != x[at[:-1]] for x in names], axis=0)])
            first = at[new]
            runs = np.diff(np.append(np.flatnonzero(new), len(at)))
            high = names[0][first].astype(np.int64)
            apart = np.concatenate([[True], high[1:] != high[:-1]])
            name = [_zigzag(np.diff(high, prepend=0)), *(_zigzag(_steps(x[first].astype(np.int64), apart)) for x in names[1:])]
            crowded = np.where(c[first] > CROWD, c[first], 0)
            rows.append((block, s, WINDOWS, pickle.dumps([squeeze(x) for x in (np.diff(own[at], prepend=0), _steps(word[at].astype(np.int64), new), times[at], outs[at], code[at])]), pickle.dumps([squeeze(x) for x in (runs, crowded, *name)])))
    return rows


def _steps(a: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each number less the one before it; where something new begins, the number."""
    return np.where(new, a, np.diff(a, prepend=0))


def _unsteps(d: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inverse of _steps; starts: where something new begins."""
    total = np.cumsum(d, dtype=np.int64)
    return total - np.repeat(total[starts] - d[starts], np.diff(np.append(starts, len(d))))


def _zigzag(a: np.ndarray) -> np.ndarray:
    return np.where(a < 0, -2 * a - 1, 2 * a)


def _unzigzag(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return np.where(a & 1, -(a + 1) // 2, a // 2)


def _ids(answers: pd.DataFrame) -> np.ndarray:
    return unsqueeze(answers.loc[answers["kind"] == IDS, "a"].iat[0]).astype(np.uint64)


def _codes(answers: pd.DataFrame, size: int) -> np.ndarray:
    """Code of each of `size` windows of a block."""
    codes = answers.loc[answers["kind"] == CODES, "a"]
    code = unsqueeze(codes.iat[0]).astype(np.uint16) if len(codes) else np.zeros(size, np.uint16)
    for a in answers.loc[answers["kind"] == WINDOWS, "a"]:
        place, found = map(unsqueeze, pickle.loads(a))
        code[np.cumsum(place, dtype=np.int64)] = found
    return code


def _told(answers: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of `size` windows of a block whether it was met, its count if it is crowded (else 0), and the two numbers
    that name its entry (0 if entries have no names)."""
    told = answers[answers["kind"] == WINDOWS]
    met, c, shard_of, rank = np.zeros(size, np.uint8), np.zeros(size, np.int64), np.zeros(size, np.uint32), np.zeros(size, np.uint64)
    for shard, a, b in zip(told["shard"], told["a"], told["b"]):
        place = np.cumsum(unsqueeze(pickle.loads(a)[0]), dtype=np.int64)
        met[place], c[place], rank[place] = map(unsqueeze, pickle.loads(b))
        shard_of[place] = shard
    return met, c, shard_of, rank


def ask_windows(tokens: pd.DataFrame, answers: pd.DataFrame, order: int, shards: int, last: bool) -> pd.DataFrame:
    """Requests for the windows of `order` words whose context was met in training, from the answers a level below."""
    block = int(tokens["block"].iat[0])
    stream, starts, sizes, train, gid = _stream(tokens, _ids(answers))
    number, lower, first = _windows(stream, starts, sizes, order)
    size = int(lower.max()) + 1
    times, outs = _split_counts(number, train, len(first))
    below = _split_counts(lower, train, size)[0]
    met, c, *name = _told(answers, size)
    base = _codes(answers, size)[lower[first]]
    context = lower[np.maximum(first - 1, 0)]
    asked = (first - starts[np.searchsorted(starts, first, "right") - 1] >= order - 2) & (met[context] != UNMET)
    word = stream[first]
    # the levels above need a name of every entry, which shards give: then all is asked
    own = asked & (met[context] == ALONE) if last else np.zeros(len(first), bool)
    at = np.flatnonzero(own)
    base[at] = fit(context[at], gid[word[at]], times[at], below[context[at]].astype(np.int64), base[at])[0]
    at = np.flatnonzero(asked & ~own)
    x, word = context[at], gid[word[at]]
    if order == 3:  # a pair is named by its words
        before = first[at] - 1
        names = (gid[np.where(before > 0, stream[before - 1], 0)], gid[stream[before]])
    else:
        names = tuple(n[x].astype(np.uint64) for n in name)
    asked_code = base[at]
    rows = [*answers.loc[answers["kind"].isin([BASE, IDS]), ROW].itertuples(index=False, name=None)]
    if last:  # nobody above asks for them: all that is wanted of what is known now is its sum over each document
        base[at] = 0
        rows.append((block, _home(block, shards), SUMS, np.add.reduceat(base[number], starts, dtype=np.int64).astype("<i8").tobytes(), b""))
    else:
        rows.append((block, _home(block, shards), CODES, squeeze(base), b""))
    times, outs, c = times[at], outs[at], c[x]
    del stream, number, lower, first, context, asked, own, base, train, met, name, below, x
    return pd.DataFrame(rows + _asked(block, shards, at, names, c, word, times, outs, asked_code), columns=ROW)


def fit(context: np.ndarray, word: np.ndarray, times: np.ndarray, c: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Build the trie of the windows met in training and search it for all: code, index and count of each one's entry
    (-1 and 0: none). context: numbers; c: counts of the contexts; code: of the order below."""
    parts = parts_of(c)
    if len(parts) and (most := int(parts.max())) > 1:
        context = context.astype(np.int64) * most + (word % parts.astype(np.uint64)).astype(np.int64)
    key = _together(context, word.astype(np.int64))
    order, starts, number, place = distinct(key)
    del key
    counted = np.add.reduceat(times[order], starts, dtype=np.int64) if len(starts) else np.empty(0, np.int64)
    del order, starts
    own = place[counted > 0]
    counted = counted[counted > 0]
    new = np.concatenate([np.ones(min(1, len(own)), bool), context[own][1:] != context[own][:-1]])
    firsts = np.flatnonzero(new)
    whole = c[own].astype(np.float64)
    d = discount(counted)
    given = sum(x * np.add.reduceat(np.minimum(counted, 3) == k, firsts, dtype=np.int64) for k, x in enumerate(DISCOUNTS, 1)) if len(own) else np.empty(0)
    left = np.minimum(given * parts[own[firsts]] / whole[firsts], 1.0)
    stored = _code(np.log10((counted - d) / whole + left[np.cumsum(new) - 1] * 10 ** _log10(code[own].astype(np.float64))))
    levels = build_trie(context[own], word[own], stored, _code(np.log10(left)))
    del own, new, whole, d, stored, parts
    out, at = np.empty(len(place), np.uint16), np.empty(len(place), np.int64)
    with tempfile.TemporaryFile() as f:  # the levels are read where they lie
        f.write(levels)
        del levels
        f.flush()
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
            trie = Trie(mapped)
            codes, of_contexts = np.append(trie.codes, 0), np.append(trie.of_context, 0)
            for some in (slice(i, i + SEARCH) for i in range(0, len(place), SEARCH)):
                asked = place[some]
                at[some], of_context = trie.find(context[asked], word[asked])
                down = np.minimum(code[asked] + np.where(of_context >= 0, of_contexts[of_context], 0).astype(np.int64), 65535)
                out[some] = np.where(at[some] >= 0, codes[at[some]], down)
            del trie
    return out[number], at[number], np.where(at >= 0, np.append(counted, 0)[at], 0)[number]


def _together(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for each pair, in the order of the pairs."""
    high = high.astype(np.int64)
    span = int(low.max()) + 1 if len(low) else 1
    if len(high) and (int(high.max()) + 1) * span >> 63:
        high, low = distinct(high)[2].astype(np.int64), distinct(low)[2]
        span = int(low.max()) + 1
    return high * span + low


def answer_windows(pdf: pd.DataFrame, last: bool, named: bool) -> pd.DataFrame:
    """One shard of contexts: the trie from the training counts of all blocks, searched for each block.

    What blocks keep passes through. Unless this is the last order, it is told, too, whether an entry was met and whether
    the block has all of it, the count of a crowded one, and the entries' ranks if they are to name contexts.
    """
    through = pdf[pdf["kind"] != WINDOWS][ROW]
    pdf = pdf[pdf["kind"] == WINDOWS]
    if pdf.empty:
        return through
    blocks, asked = [], []
    for block, a, b in sorted(zip(pdf["block"], pdf["a"], pdf["b"])):
        place, word, times, outs, code = map(unsqueeze, pickle.loads(a))
        runs, c, high, *low = map(unsqueeze, pickle.loads(b))
        runs = runs.astype(np.int64)
        starts = np.cumsum(runs) - runs
        high = np.cumsum(_unzigzag(high))
        apart = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        blocks.append((block, place))
        asked.append((high, _unsteps(_unzigzag(low[0]), apart) if low else np.zeros(len(runs), np.int64), c, runs, np.add.reduceat(times, starts, dtype=np.int64), _unsteps(word.astype(np.int64), starts), times, outs, code.astype(np.uint16)))
    high, low, c, runs, seen, word, times, outs, code = map(np.concatenate, zip(*asked))
    del asked
    context = distinct(_together(high, low))[2]
    seen = np.bincount(context, seen).astype(np.int64)[context]
    c = np.repeat(np.where(c > 0, c.astype(np.int64), seen), runs)
    context = np.repeat(context, runs)
    del high, low, runs, seen
    code, entry, count = fit(context, word.astype(np.uint64), times, c, code)
    del context, word, c
    if not last:
        out = np.bincount(np.maximum(entry, 0), np.where(entry >= 0, outs, 0))[np.maximum(entry, 0)].astype(np.int64)
        met = np.where(entry < 0, UNMET, np.where((count == times) & (out == outs), ALONE, MET))
        count[count <= CROWD] = 0
    rows, at, shard = [], 0, int(pdf["shard"].iat[0])
    for block, place in blocks:
        own = slice(at, at + len(place))
        told = b"" if last else pickle.dumps([squeeze(met[own]), squeeze(count[own]), squeeze(np.maximum(entry[own], 0) if named else np.zeros(len(place), np.uint64))])
        rows.append((block, shard, WINDOWS, pickle.dumps([squeeze(place), squeeze(code[own])]), told))
        at = own.stop
    return pd.concat([through, pd.DataFrame(rows, columns=ROW)])


def sum_scores(tokens: pd.DataFrame, answers: pd.DataFrame, order: int) -> pd.DataFrame:
    row = tokens.iloc[0]
    stream, starts, sizes, _, _ = _stream(tokens, _ids(answers))
    number = _windows(stream, starts, sizes, order)[0]
    total = np.add.reduceat(_codes(answers, int(number.max()) + 1)[number], starts, dtype=np.int64)
    for a in answers.loc[answers["kind"] == SUMS, "a"]:
        total += np.frombuffer(a, "<i8")
    (a, b), = answers.loc[answers["kind"] == BASE, ["a", "b"]].itertuples(index=False, name=None)
    return pd.DataFrame({"id": list(row["ids"]), "held_out": list(row["held"]), "n_tokens": sizes, "n_known": np.frombuffer(b, "<i8"), "base_score": np.frombuffer(a, np.float64), "score": _log10(total)})


def _settled(made: pd.DataFrame) -> pd.DataFrame:
    """What a group needed goes back to the system: the workers of an executor share its memory with the JVM."""
    trim()
    return made


def score_documents(docs: DataFrame, held: Column | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Columns id, held_out, n_tokens, n_known, train_tokens, base_score, score (of that order, 2 or more)."""
    if order < 2:
        raise ValueError("order is 2 or more")
    held = held_out() if held is None else held
    of_words = shards or max(16, 2 * docs.select(text_col).rdd.getNumPartitions())
    spark = docs.sparkSession
    base = scratch_path(spark, "language-model")
    rows = tokenise(docs, of_words, id_col, text_col, held).withColumn("words", F.col("shard") >= 0)
    stored(rows, f"{base}/blocks", "words")
    tokens = spark.read.schema(rows.schema).parquet(f"{base}/blocks").where("not words").select("block", "n", "ids", "held", "a", "b")
    shards = shards or max(of_words, -(-(tokens.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))
    tokens = tokens.drop("n")
    words = spark.read.schema(rows.schema).parquet(f"{base}/blocks").where("words").select("block", "shard", "a", "b")
    words = stored(words.groupBy("shard").applyInPandas(count_words, "block bigint, shard int, a binary, words bigint, known bigint, tokens bigint"), f"{base}/words")
    remove(spark, f"{base}/blocks/words=true")
    totals = words.where("block < 0").select("known", "tokens").collect()
    n, v = sum(r.tokens for r in totals), sum(r.known for r in totals)
    of_blocks = words.where("block >= 0").select("block", "shard", "a")
    schema = "block bigint, shard int, kind int, a binary, b binary"

    def answered(asked: DataFrame, level: int) -> DataFrame:
        return asked.groupBy("shard").applyInPandas(lambda x: _settled(answer_windows(x, level == order, level > 2)), schema)

    def above(answers: DataFrame, level: int) -> DataFrame:
        return tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda t, x: _settled(ask_windows(t, x, level, shards, level == order)), schema)

    answers = answered(tokens.groupBy("block").cogroup(of_blocks.groupBy("block")).applyInPandas(lambda t, w: _settled(ask_pairs(t, w, n, v, of_words, shards)), schema), 2)
    for level in range(3, order + 1):
        answers = stored(answers, f"{base}/answers-{level}")
        remove(spark, f"{base}/words" if level == 3 else f"{base}/answers-{level - 1}")
        answers = answered(above(answers, level), level)
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda t, x: _settled(sum_scores(t, x, order)), f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
