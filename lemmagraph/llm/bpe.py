"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation.

Encoding keeps the symbols of one pre-token in a doubly linked list (two index arrays) and every adjacent
pair that has a merge in a heap ordered by (rank, position). A popped entry is stale when its left symbol
is gone or when the pair that now stands there merges into something else; stale entries are skipped, so a
pre-token of n symbols costs O(n log n) however long it is.

Decoding concatenates the byte strings of the vocabulary and reads the whole as UTF-8 (malformed sequences
become U+FFFD, as in a lossy decode).

Defined results: a null text is encoded as the empty text (no ids, digest of the empty string). Added
tokens of the vocabulary file that occur in a text become their own id. Repeated rows give repeated rows.
An empty table gives an empty table. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import SegmentMemo, TwoGenerations, append_columns, gather, resident

#: Pre-tokens longer than this are encoded without being remembered.
MEMO_CHARS = 64
#: Documents encoded together.
CHUNK = 1024
#: A cut before a single space between two characters that are not white space never changes the pre-tokens:
#: no alternative of the byte-level pattern holds a space after a character that is not white space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Blocks whose letters and digits are the same in every Unicode version in use: up to Latin Extended-B.
SETTLED = re.compile("[\x00-\u024f]*")
SETTLED_RE2 = r"^[\x00-\x{24f}]*$"
#: Code points that may mark cuts, none of them white space: one that no text of the chunk holds is taken.
MARKS = [*range(9), *range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE)]
#: The byte-level pre-token pattern (a fixed value of the vocabulary's format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", regex.V0)
#: Bits of a position in an entry of the queue; short pre-tokens keep entries small integers.
SHORT_BITS, POSITION_BITS = 12, 32
#: ASCII signs that are neither letters, digits nor white space: a run of them is one pre-token, its own byte alphabet.
SIGNS = string.punctuation
LOOSE_SPACE = re.compile(r" \s|\s | \Z|\A ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelBPE:
    """Encoder and decoder over a vocabulary file in the JSON format of public tokenizers."""

    def __init__(self, path: str, pieces: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.symbol = {c: vocab[c] for c in byte_alphabet() if c in vocab}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank_of: dict[tuple[int, int], int] = {}
        self.result_of: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.rank_of[vocab[a], vocab[b]] = rank
            self.result_of.append(vocab[a + b])
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.added = added
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        alphabet = byte_alphabet()
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in added.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.stems = SegmentMemo(self._learn, pieces, np.int32)
        self.tails = SegmentMemo(self._learn, 10_000, np.int32)
        self.pretoken = TwoGenerations(self._merge, 50_000)

    def _merge(self, pretoken: str) -> tuple[int, ...]:
        """Queue entries are single integers, rank above the bits of a position: they compare as pairs. `held` has for
        each symbol the rank of the pair it begins now, if any: a popped entry of another rank is stale."""
        ids = list(map(self.symbol.__getitem__, pretoken))
        n = len(ids)
        if n < 2:
            return tuple(ids)
        rank_of, result_of = self.rank_of.get, self.result_of
        held = list(map(rank_of, zip(ids, ids[1:])))
        bits = SHORT_BITS if n <= 1 << SHORT_BITS else POSITION_BITS
        queue = [rank << bits | i for i, rank in enumerate(held) if rank is not None]
        if not queue:
            return tuple(ids)
        heapify(queue)
        held.append(None)
        after = [*range(1, n + 1)]
        before = [*range(-1, n)]
        mask = (1 << bits) - 1
        while queue:
            entry = heappop(queue)
            left = entry & mask
            rank = entry >> bits
            if held[left] != rank:
                continue  # stale: another merge has taken one of the two
            ids[left] = merged = result_of[rank]
            right = after[left]
            after[left] = beyond = after[right]
            ids[right] = held[right] = None
            before[beyond] = left
            if beyond < n:
                held[left] = rank = rank_of((merged, ids[beyond]))
                if rank is not None:
                    heappush(queue, rank << bits | left)
            else:
                held[left] = None
            earlier = before[left]
            if earlier >= 0:
                held[earlier] = rank = rank_of((ids[earlier], merged))
                if rank is not None:
                    heappush(queue, rank << bits | earlier)
        return tuple([i for i in ids if i is not None])

    def _pretokens(self, piece: str) -> list[str]:
        """Pre-tokens in the byte alphabet. Outside the blocks that no Unicode version has changed, the
        library itself splits, so that its tables of letters and digits count."""
        if SETTLED.fullmatch(piece):
            return [p.encode().decode("latin-1").translate(self.stand_in) for p in PATTERN.findall(piece)]
        return [p for p, _ in self.split(piece)]

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces. A piece of letters is one pre-token, with the space before it."""
        out, sizes = [], []
        for piece in pieces.to_pylist():
            if piece in self.added:
                ids = [self.added[piece]]
            elif (piece[1:] if piece[:1] == " " else piece).isalpha() and SETTLED.fullmatch(piece):
                ids = self._merge(piece.encode().decode("latin-1").translate(self.stand_in))
            else:
                ids = [i for p in self._pretokens(piece) for i in (self.pretoken(p) if len(p) <= MEMO_CHARS else self._merge(p))]
            out += ids
            sizes.append(len(ids))
        return np.array(out, np.int32), np.array(sizes, np.int64)

    def _cut(self, text: str, mark: str) -> str:
        """The text with the mark where it may be cut: around added tokens, and before single spaces."""
        if self.added_pattern is not None and self.added_pattern.search(text):
            text = self.added_pattern.sub(lambda m: mark + m.group() + mark, text)
        return SAFE_CUT.sub(mark + " ", text) if LOOSE_SPACE.search(text) else text.replace(" ", mark + " ")

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each.

        Every distinct piece is encoded once. Signs behind a run of letters are a pre-token of their own, so pieces that
        differ in them only share the rest.
        """
        mark = next(c for c in map(chr, MARKS) if not any(c in t for t in texts))
        split = pc.split_pattern(pa.array([self._cut(t, mark) for t in texts], pa.string()), mark)
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary
        stem = pc.utf8_rtrim(pieces, SIGNS)
        easy = pc.and_(pc.match_substring_regex(stem, r"^ ?\pL+$"), pc.match_substring_regex(pieces, SETTLED_RE2))
        stem = pc.if_else(easy, stem, pieces).dictionary_encode()
        tail = pc.if_else(easy, pc.replace_substring_regex(pieces, r"^(?s:.*)\pL", ""), "").dictionary_encode()
        flat, start, size = self.stems(stem.dictionary)
        more, more_start, more_size = self.tails(tail.dictionary)
        stem, tail, piece = stem.indices.to_numpy(), tail.indices.to_numpy(), coded.indices.to_numpy()
        start = np.stack([start[stem], more_start[tail] + len(flat)], 1)[piece].ravel()
        size = np.stack([size[stem], more_size[tail]], 1)[piece].ravel()
        place = np.concatenate([[0], np.cumsum(size)])
        return gather(np.concatenate([flat, more]), start, size), np.diff(place[2 * split.offsets.to_numpy()])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def loaded(path: str) -> ByteLevelBPE:
    return resident(("bpe", path), lambda: ByteLevelBPE(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _start(vocabulary: str | None, work):
    path = vocabulary or default_vocabulary()
    return lambda: lambda values: work(loaded(path), values)


def _rows(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the kept columns) with ids array<int>: the token ids of every whole text."""
    work = lambda bpe, texts: [_rows(*bpe.encode_all([t or "" for t in texts]))]
    return append_columns(docs, [text_col], "ids array<int>", _start(vocabulary, work), keep, CHUNK)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """encoded (or the kept columns) with text: the text of every row of ids (null: null)."""
    work = lambda bpe, rows: [pa.array([None if r is None else bpe.decode(r) for r in rows], pa.string())]
    return append_columns(encoded, [ids_col], "text string", _start(vocabulary, work), keep)


def _digests(bpe: ByteLevelBPE, texts: list[str | None], with_ids: bool = False) -> list[pa.Array]:
    of_ids, of_text = [], []
    flat, sizes = bpe.encode_all([t or "" for t in texts])
    for ids in np.split(flat, np.cumsum(sizes)[:-1]):
        ids = ids.tolist()
        of_ids.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
        back = bpe.decode_bytes(ids)
        try:
            back.decode("utf-8")
        except UnicodeDecodeError:
            back = back.decode("utf-8", errors="replace").encode()
        of_text.append(hashlib.sha256(back).hexdigest())
    out = [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
    return out + [_rows(flat, sizes)] * with_ids


def roundtrip_digests(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """docs (or the kept columns): every whole text encoded and its ids decoded again; length, digests of both, ids if wanted."""
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return append_columns(docs, [text_col], schema, _start(vocabulary, lambda bpe, texts: _digests(bpe, texts, with_ids)), keep, CHUNK)
