"""Elias-Fano sequences and a two-level n-gram trie over them, as bytes that can be memory-mapped.

A monotone sequence of n values below u is kept as low bits, packed, and high bits in unary: 2 + log2(u / n) bits a
value, with random access by a select of ones over a directory of bit counts. The successor of a value is found by two
selects of zeros, which bound the few values that share its high bits, and a search among their low bits. All queries
are vectorised over numpy arrays.

The trie: contexts in ascending order, for each the start of its range of successors (monotone pointers), and
the successors of all contexts as one monotone sequence: each context's successor ids are shifted by the total of
the ranges before. A word is looked for among the successors of its context only.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQBxxxxxxx")
U = np.uint64
#: Words that repeat a byte: its highest bit, one, and the lower half of each 2, 4 and 8 bits.
EVERY = {0: U(0x8080808080808080), 1: U(0x0101010101010101), 2: U(0x5555555555555555), 4: U(0x3333333333333333), 8: U(0x0F0F0F0F0F0F0F0F)}
#: Place of the k-th set bit of each byte.
PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint64)


def encode(values: np.ndarray) -> bytes:
    """Monotone unsigned values to bytes: count, universe, low width; low words; high words; counts of ones before each."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    u = int(v[-1]) + 1 if n else 1
    width = max(0, (u // max(n, 1)).bit_length() - 1)
    ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(ones[-1]) + 64) // 64 * 64 if n else 64, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    low = _pack(v & np.uint64((1 << width) - 1), width)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype("<u8")
    return HEAD.pack(n, len(high), width) + struct.pack("<Q", len(low)) + low.tobytes() + high.tobytes() + before.tobytes()


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """The values' low bits one behind the other: 64 values fill as many words as a value has bits."""
    groups = -(-len(v) // 64)
    v = np.pad(v, (0, groups * 64 - len(v))).reshape(groups, 64)
    out = np.zeros((groups, width + 1), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return np.append(out[:, :width].ravel(), np.uint64(0)).astype("<u8")


class Sequence:
    """Reads an encoded sequence from a buffer, in place."""

    def __init__(self, buffer, at: int = 0):
        self.n, n_high, self.width = HEAD.unpack_from(buffer, at)
        at += HEAD.size
        (n_low,) = struct.unpack_from("<Q", buffer, at)
        at += 8
        take = lambda n, at: np.frombuffer(buffer, "<u8", n, at)
        self.low = take(n_low, at)
        self.high = take(n_high, at + 8 * n_low)
        self.before = take(n_high + 1, at + 8 * (n_low + n_high))
        self.end = at + 8 * (n_low + 2 * n_high + 1)
        self.zeros: np.ndarray | None = None  # before each word; made at the first search

    def _select(self, bits: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Place of the left-th set bit of each word of bits."""
        k = left.astype(np.uint64)
        pairs = bits - (bits >> U(1) & EVERY[2])
        nibbles = (pairs & EVERY[4]) + (pairs >> U(2) & EVERY[4])
        upto = (nibbles + (nibbles >> U(4)) & EVERY[8]) * EVERY[1]  # in each byte the ones up to its end
        shift = np.bitwise_count((k * EVERY[1] | EVERY[0]) - upto & EVERY[0]).astype(np.uint64) << U(3)
        k -= (upto << U(8)) >> shift & U(255)
        return (shift + PLACE[(bits >> shift & U(255)).astype(np.int64), k.astype(np.int64)]).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        start = i * self.width
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        low = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (low | spill) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i.astype(np.uint64), side="right") - 1
        place = word * 64 + self._select(self.high[word], i - self.before[word].astype(np.int64))
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def _begin(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high bits are below h."""
        if self.zeros is None:
            self.zeros = 64 * np.arange(len(self.before), dtype=np.int64) - self.before.astype(np.int64)
        out = np.full(len(h), self.n, np.int64)
        inside = np.flatnonzero(h <= self.zeros[-1])
        k = h[inside] - 1  # the zero that ends the group before
        word = np.searchsorted(self.zeros, np.maximum(k, 0), side="right") - 1
        place = word * 64 + self._select(~self.high[word], np.maximum(k, 0) - self.zeros[word])
        out[inside] = np.where(k < 0, 0, place - k)
        return out

    def successor(self, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each wanted value the first index in [low, high) whose value is at least it (high if none), and whether
        it is that value."""
        h, rest = (wanted >> np.uint64(self.width)).astype(np.int64), wanted & np.uint64((1 << self.width) - 1)
        at = np.clip(self._begin(h), low, high)
        group = end = np.clip(self._begin(h + 1), at, high)
        end = end.copy()
        while len(open_ := np.flatnonzero(at < end)):
            mid = (at[open_] + end[open_]) >> 1
            under = self._low(mid) < rest[open_]
            at[open_] = np.where(under, mid + 1, at[open_])
            end[open_] = np.where(under, end[open_], mid)
        found = at < group
        found[found] = self._low(at[found]) == rest[found]
        return at, found


def build_trie(context: np.ndarray, word: np.ndarray, code: np.ndarray, of_context: np.ndarray) -> bytes:
    """Entries sorted by (context, word), distinct; code: a 16-bit quantised probability of each; of_context: one a
    context, the quantised weight of what it leaves to shorter contexts."""
    contexts, starts = np.unique(context, return_index=True)
    if not len(contexts):
        return b"".join(encode(np.empty(0, np.uint64)) for _ in range(4))
    ends = np.append(starts[1:], len(context))
    base = np.concatenate([[0], np.cumsum(word[ends - 1].astype(np.uint64) + np.uint64(1))[:-1]]).astype(np.uint64)
    shifted = word.astype(np.uint64) + np.repeat(base, ends - starts)
    parts = [encode(contexts), encode(np.append(starts, len(context))), encode(base), encode(shifted)]
    return b"".join(parts) + code.astype("<u2").tobytes() + of_context.astype("<u2").tobytes()


class Trie:
    def __init__(self, buffer):
        self.contexts = Sequence(buffer)
        self.pointers = Sequence(buffer, self.contexts.end)
        self.base = Sequence(buffer, self.pointers.end)
        self.words = Sequence(buffer, self.base.end)
        self.codes = np.frombuffer(buffer, "<u2", self.words.n, self.words.end)
        self.of_context = np.frombuffer(buffer, "<u2", self.contexts.n, self.words.end + 2 * self.words.n)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each (context, word) among the entries, and of its context; -1 where the trie has none."""
        out = np.full(len(context), -1, np.int64)
        n = self.contexts.n
        if not n or not len(context):
            return out, out.copy()
        context, word = context.astype(np.uint64), word.astype(np.uint64)
        new = np.concatenate([[True], context[1:] != context[:-1]])  # each run of a context is looked up once
        asked, back = context[new], np.cumsum(new) - 1
        at, known = self.contexts.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), n))
        held = np.where(known, at, 0)
        low, high, base = self.pointers[held].astype(np.int64), self.pointers[held + 1].astype(np.int64), self.base[held]
        some = np.flatnonzero(known[back])
        b = back[some]
        place, hit = self.words.successor(word[some] + base[b], low[b], high[b])
        out[some[hit]] = place[hit]
        return out, np.where(known, at, -1)[back]
