"""Token ids of documents in files compressed by Re-Pair grammars.

Documents are encoded with a public vocabulary, an end id is appended to each, and they are written in ascending
order of id. Rows of ids are dealt into shards of id ranges by one exchange; each shard is cut into segments of about
SEGMENT_IDS ids and every segment gets a grammar of its own: in rounds, pairs of neighbouring symbols that occur
often are replaced by nonterminals (never across the end of a document), until no pair is frequent. Of overlapping places
every second one from the left is taken: with the more frequent pair first, 4.9M ids of documents took 5.14 MB, not 4.78.

File format. A folder of Parquet files, which any store holds and Spark's commit protocol protects, one row a segment:
shard, segment, doc_ids, n_ids, and `grammar`, little-endian:
    magic b"RPG1" | u32 first nonterminal | u32 rules | u32 symbols | u32 documents | u32 rounds
    then, each as u32 size and a zstandard frame of u32 byte planes: left and right of the rules, the rules of each
    round, expansion length of each rule, ids of each document, symbols of each document, the symbols.
Expansion lengths and the symbols of each document give random access: a document's symbols are found by a prefix sum
and only they are expanded; a range inside it skips symbols by their lengths.

Defined results: a null text is empty (the end id alone). Null ids come first. Rows equal in id stand in any order
of their ids. An empty table writes no segment. Other columns are not looked at.
"""

from __future__ import annotations

import json
import string
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SegmentMemo, forget, gather, portions, resident, scratch_path

END_ID = 2
SEGMENT_IDS = 1 << 21
#: A pair is frequent among n symbols (those left in the round) if it occurs at least max(LEAST, n / PORTION) times.
LEAST, PORTION = 8, 1 << 17
TABLE_BITS = 20
#: So few places are counted by a sort.
FEW = 1 << 17
#: ASCII signs that are neither letters nor digits, the apostrophe of contractions left out.
SIGNS = string.punctuation.replace("'", "")
#: Characters whose lower case every Unicode version agrees on, the dotted capital I left out.
SETTLED = r"^[\x00-\x{12f}\x{131}-\x{17e}]*$"
#: All up to the last letter of a piece.
LAST_LETTER = r"^(?s:.*)\pL"
#: Words handed to the library together.
LEARN = 1000
HEAD = struct.Struct("<4sIIIII")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Whole texts with the tokenizers library, through a memo of the pieces between spaces and line feeds.

    The vocabulary drops white space and never joins across it, so pieces can be encoded one by one: of the pieces that
    differ in capitals and closing signs their common core once, and remembered.
    """

    def __init__(self, path: str, memo: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.type = ids_type(path)
        model = _model(path)
        ending = model.get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)  # the ids that end a word
        self.ends[[i for token, i in model["vocab"].items() if ending and token.endswith(ending)]] = True
        self.cores = SegmentMemo(self._learn, memo, self.type)
        self.tails = SegmentMemo(self._alone, 10_000, self.type)

    def _split(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """What decides the ids of a piece: the vocabulary is lower case, and a run of signs after a letter is cut off
        before merging. Only where lower case is beyond doubt; other pieces are a core as they stand."""
        low = pc.utf8_lower(pieces)
        core = pc.utf8_rtrim(low, SIGNS)
        easy = pc.and_(pc.and_(pc.match_substring_regex(pieces, SETTLED), pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, -1))), pc.invert(pc.match_substring(pieces, "<|")))
        return pc.if_else(easy, core, pieces), pc.if_else(easy, pc.replace_substring_regex(low, LAST_LETTER, ""), "")

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.type), np.array([len(x) for x in ids], np.int64)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: many in one call where each is letters alone, one word to the vocabulary, whose end shows."""
        single = pc.and_(pc.utf8_is_alpha(words), pc.match_substring_regex(words, SETTLED)).to_numpy(zero_copy_only=False)
        flats, sizes = [], np.empty(len(words), np.int64)
        begins = np.empty(len(words), np.int64)
        alone, done = [np.flatnonzero(~single)], 0
        rows = np.flatnonzero(single)
        for at in range(0, len(rows), LEARN):
            own = rows[at : at + LEARN]
            (e,) = self.tok.encode_batch_fast([" ".join(words.take(pa.array(own)).to_pylist())], add_special_tokens=False)
            ids = np.array(e.ids, self.type)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(own):
                alone.append(own)
                continue
            sizes[own] = np.diff(ends, prepend=0)
            begins[own] = ends - sizes[own] + done
            flats.append(ids)
            done += len(ids)
        own = np.concatenate(alone)
        ids, n = self._alone(words.take(pa.array(own)))
        sizes[own] = n
        begins[own] = np.cumsum(n) - n + done
        return gather(np.concatenate([*flats, ids]), begins, sizes), sizes

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id behind (if any), and the number of ids of each."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        core, tail = (x.dictionary_encode() for x in self._split(coded.dictionary))
        flat, start, size = self.cores(core.dictionary)
        more, more_start, more_size = self.tails(tail.dictionary)
        core, tail, piece = core.indices.to_numpy(), tail.indices.to_numpy(), coded.indices.to_numpy()
        ends = np.array([] if end_id is None else [end_id], self.type)
        # two segments a piece: core and signs
        start = np.stack([start[core], more_start[tail] + len(flat)], 1)[piece].ravel()
        size = np.stack([size[core], more_size[tail]], 1)[piece].ravel()
        if end_id is not None:
            start = np.insert(start, 2 * bounds[1:], len(flat) + len(more))
            size = np.insert(size, 2 * bounds[1:], 1)
        out = gather(np.concatenate([flat, more, ends]), start, size)
        place = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(place[2 * bounds + (np.arange(len(bounds)) if end_id is not None else 0)])


def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]


@cache
def ids_type(path: str) -> np.dtype:
    return np.dtype("<u2" if max(_model(path)["vocab"].values()) < (1 << 16) - 256 else "<u4")


def encoder(path: str) -> WordEncoder:
    return resident(("words", path), lambda: WordEncoder(path))


def encode(docs: DataFrame, vocabulary: str, end_id: int, bounds: list, id_col: str, text_col: str) -> DataFrame:
    """Columns id, shard (the number of bounds at or below the id; nulls come first), ids: every text's ids and the end
    id, as packed little-endian integers."""
    narrow = docs.select(id_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in portions(batch, 1, 4096, 1 << 25):
                flat, sizes = enc.encode(part.column(1), end_id)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * enc.type.itemsize
                ids = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                shards = pa.array([0 if i is None else bisect_right(bounds, i) for i in part.column(0).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), shards, ids], names=["id", "shard", "ids"])

    return narrow.mapInArrow(run, f"id {narrow.schema[id_col].dataType.simpleString()}, shard int, ids binary")


def _pack(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a, "<u4")
    body = zstandard.ZstdCompressor(3).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes())
    return struct.pack("<I", len(body)) + body


def _unpack(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    (size,) = struct.unpack_from("<I", blob, at)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 4 : at + 4 + size]), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel(), at + 4 + size


def _sorted(seq: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _frequent, by a sort: no pair waits for another."""
    _, which, times = np.unique(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], return_inverse=True, return_counts=True)
    often = times[which]
    may = often >= LEAST
    at, which, often = at[may], which[may], often[may]
    return at[often >= least], which[often >= least], at


def _frequent(seq: np.ndarray, places: np.ndarray, least: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places given: those of frequent pairs, a number for the pair at each, and the places that can still
    become frequent; exact counts.

    Pairs are hashed into a table of counts. Of a slot that is full enough one pair is looked at, all its places
    are counted; a pair that shares a slot with another has its turn in a later round, hashed otherwise. Only a
    sort decides that no pair is left.
    """
    if len(places) <= FEW:
        return _sorted(seq, places, least)
    odd = np.uint32(0x9E3779B1 + 0x3C6EF372 * turn & 0xFFFFFFFF | 1)
    slot = (seq[places] * odd + seq[places + 1] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)
    often = np.bincount(slot, minlength=1 << TABLE_BITS)[slot]
    may = often >= LEAST
    places, slot, often = places[may], slot[may], often[may]
    at, which = places[often >= least], slot[often >= least]
    one = np.zeros(1 << TABLE_BITS, np.int64)
    one[which] = at
    its = one[which]
    same = (seq[at] == seq[its]) & (seq[at + 1] == seq[its + 1])
    at, which = at[same], which[same]
    enough = np.bincount(which, minlength=1 << TABLE_BITS)[which] >= least
    return (at[enough], which[enough], places) if enough.any() else _sorted(seq, places, least)


def compress(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The grammar of a segment: ids of all documents in a row, sizes of the documents (none is empty).

    A pair of old symbols never gains places, and a new pair holds a symbol of the last round: after a round only
    places that could be frequent before, and those beside the new symbols, are counted.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes) - 1] = True
    first = int(seq.max()) + 1 if len(seq) else 1
    lefts, rights, made, following = [], [], [], first
    places = np.flatnonzero(~last)
    while len(places):
        at, which, places = _frequent(seq, places, max(LEAST, len(seq) // PORTION), len(made))
        if not len(at):
            break
        fresh = np.concatenate([[True], np.diff(at) > 1])  # of overlapping pairs, every second one from the left
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - start) % 2 == 0
        at, which = at[take], which[take]
        taken = np.zeros(int(which.max()) + 1, bool)
        taken[which] = True
        names = np.flatnonzero(taken)
        number = np.zeros(len(taken), np.int64)
        number[names] = np.arange(len(names))
        where = number[which]
        one = np.empty(len(names), np.int64)
        one[where] = at
        lefts.append(seq[one])
        rights.append(seq[one + 1])
        made.append(len(names))
        seq[at] = (following + where).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        open_ = np.zeros(len(seq), bool)
        open_[places] = True
        open_[at] = True
        open_[at[at > 0] - 1] = True
        open_ &= ~last
        seq, last, places = seq[keep], last[keep], np.flatnonzero(open_[keep])
        following += len(names)
    left = np.concatenate(lefts) if lefts else np.empty(0, np.uint32)
    right = np.concatenate(rights) if rights else np.empty(0, np.uint32)
    length = np.ones(following, np.int64)
    at = first
    for n, a, b in zip(made, lefts, rights):
        length[at : at + n] = length[a] + length[b]
        at += n
    symbols = np.diff(np.flatnonzero(last), prepend=-1)
    head = HEAD.pack(b"RPG1", first, len(left), len(seq), len(sizes), len(made))
    return head + b"".join(map(_pack, (left, right, np.array(made), length[first:], sizes, symbols, seq)))


class Grammar:
    """Reads one segment; expands all of it, one document, or a range inside a document."""

    def __init__(self, blob: bytes):
        magic, self.first, _, _, _, _ = HEAD.unpack_from(blob)
        if magic != b"RPG1":
            raise ValueError("not a grammar segment")
        at, parts = HEAD.size, []
        for _ in range(7):
            part, at = _unpack(blob, at)
            parts.append(part)
        self.left, self.right, self.made, self.length, self.sizes, self.symbols, self.seq = parts
        self.before = np.concatenate([[0], np.cumsum(self.symbols, dtype=np.int64)])

    def _lengths(self, seq: np.ndarray) -> np.ndarray:
        out = np.ones(len(seq), np.int64)
        is_rule = seq >= self.first
        out[is_rule] = self.length[seq[is_rule] - self.first]
        return out

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Every symbol goes to its place in the result, level by level; only rules are looked at again."""
        lengths = self._lengths(seq)
        at = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), seq.dtype)
        while len(seq):
            is_rule = seq >= self.first
            out[at[~is_rule]] = seq[~is_rule]
            rule, at = seq[is_rule] - self.first, at[is_rule]
            left = self.left[rule]
            seq, at = np.concatenate([left, self.right[rule]]), np.concatenate([at, at + self._lengths(left)])
        return out

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        seq = self.seq[self.before[k] : self.before[k + 1]]
        stop = int(self.sizes[k]) if stop is None else min(stop, int(self.sizes[k]))
        ends = np.cumsum(self._lengths(seq))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(seq[a:b])[start - skipped : max(start, stop) - skipped]


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents and write their segments in ascending order of id."""
    vocabulary = vocabulary or default_vocabulary()
    shards = shards or max(8, docs.select(id_col).rdd.getNumPartitions())
    ranks = F.lit(max(10_000, 20 * shards))
    bounds = docs.select(F.percentile_approx(id_col, [k / shards for k in range(1, shards)], ranks).alias("b")).first()["b"] if shards > 1 else []
    encoded = encode(docs, vocabulary, end_id, sorted(set(bounds or [])), id_col, text_col)
    dealt = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("id"), "ids")
    kind = dealt.schema["id"].dataType.simpleString()
    packed = dealt.select("shard", "id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the memory of an encoder that served in this worker before
        width = ids_type(vocabulary)
        id_kind = None

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blobs), width)
            grammar = compress(ids, np.array([len(b) // width.itemsize for b in blobs]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([names], pa.list_(id_kind)), pa.array([len(ids)], pa.int64()), pa.array([grammar], pa.binary())], names=["shard", "segment", "doc_ids", "n_ids", "grammar"])

        shard, number, names, blobs, total = None, 0, [], [], 0
        for batch in batches:
            id_kind = batch.schema.field(1).type
            for s, name, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if blobs and (s != shard or total >= SEGMENT_IDS * width.itemsize):
                    yield segment()
                    number += 1
                    names, blobs, total = [], [], 0
                if s != shard:
                    shard, number = s, 0
                names.append(name)
                blobs.append(ids)
                total += len(ids)
        if blobs:
            yield segment()

    packed.mapInArrow(run, f"shard int, segment int, doc_ids array<{kind}>, n_ids bigint, grammar binary").write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Columns id, start, n_tokens, ids (array<int>) of every document in the files."""
    return _documents(spark, path, "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Columns id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return _documents(spark, path, "ids_crc32 bigint", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _documents(spark: SparkSession, path: str, column: str, work) -> DataFrame:
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                g = Grammar(row.column(3)[0].as_py())
                sizes = g.sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                flat = g.expand(g.seq)
                docs = np.split(flat, ends[:-1])
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.column(0)[0].as_py()] * n, pa.int32()), pa.array([row.column(1)[0].as_py()] * n, pa.int32()), row.column(2).flatten(), pa.array(ends - sizes), pa.array(sizes), work(docs)],
                    names=["shard", "segment", "id", "inside", "n_tokens", column.split(" ")[0]],
                )

    decoded = files.select("shard", "segment", "doc_ids", "grammar").mapInArrow(run, f"shard int, segment int, id {kind}, inside bigint, n_tokens bigint, {column}")
    sizes = files.groupBy("shard", "segment").agg(F.sum("n_ids").alias("n"))
    shards = sorted((r[0], r[1]) for r in sizes.groupBy("shard").agg(F.sum("n")).collect())
    offsets = [(s, before) for (s, _), before in zip(shards, accumulate([0, *(n for _, n in shards)]))]
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")
    starts = sizes.join(spark.createDataFrame(offsets, "shard int, before bigint"), "shard").select("shard", "segment", (F.col("before") + inside).alias("before"))
    return decoded.join(starts, ["shard", "segment"]).select("id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", column.split(" ")[0])


def roundtrip_digests(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    spark = docs.sparkSession
    path = write(docs, scratch_path(spark, "token-ids"), id_col=id_col, **how)
    return read_digests(spark, path).withColumnRenamed("id", id_col)
