"""A Merkle manifest of a dataset: one tree a group of rows, one tree over their roots, a proof for every row.

Leaves are sorted by range once. A count a partition and group gives every partition the place of its first leaf (only
a partition's first group can have begun before it, only its last one can go on after it: two rows a partition go to
the driver). Each partition builds all subtrees that lie in it whole; what is left of it, a few nodes a level at
either end, goes by coordinate to tasks that finish blocks of the upper levels. The paths from these nodes to the root
go back to the partitions, which are zipped with them and complete the proofs of their leaves. Leaves are exchanged
once, texts never.

A proof is a text of steps, STEP characters each, from the leaf upwards: `L` or `R` and the sibling that is left or right,
or hyphens where a node is alone in its run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut

STEP = 65
ALONE = "-" * STEP
#: A block of the first round of upper levels spans about 2^FIRST partitions, one of a later round 2^MORE blocks.
FIRST, MORE = 7, 12

Node = tuple[int, int, str]


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def document_leaf(n_chars: Column | None = None) -> Column:
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))


def size_at(total: int, level: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    return -(-total >> level)


def height(total: int) -> int:
    return (total - 1).bit_length()


def push(stack: list[Node], node: Node, made: dict[tuple[int, int], str] | None = None) -> None:
    """Put the next node to the right; pairs become their parent (all nodes met are noted in made)."""
    level, index, digest = node
    while True:
        if made is not None:
            made[level, index] = digest
        if not (index & 1 and stack and stack[-1][:2] == (level, index - 1)):
            break
        level, index, digest = level + 1, index >> 1, h(stack.pop()[2], digest)
    stack.append((level, index, digest))


def close(stack: list[Node], total: int, upto: int, made: dict[tuple[int, int], str] | None = None) -> None:
    """No more leaves follow: the last node of a level is alone unless its left sibling is here; none goes above upto."""
    while stack:
        level, index, digest = stack[-1]
        if level >= upto or size_at(total, level) == 1 or index & 1:
            return
        stack.pop()
        push(stack, (level + 1, index >> 1, h(digest)), made)


class Place:
    """Where the runs (leaves of one group) of a partition begin and end in their groups."""

    def __init__(self, split: list[tuple[int, int, int]]):
        self.start = next((s for s, _, _ in split if s > 0), 0)
        self.open = next((total for s, n, total in split if s + n < total), None)

    def of(self, run: int, n: int, last: bool) -> tuple[int, int, bool]:
        """Start and size of the group of a run, and whether the run holds its end."""
        start = self.start if run == 0 else 0
        return (start, self.open, False) if last and self.open is not None else (start, start + n, True)


@dataclass
class Forest:
    """leaves: sorted by group, dealt by range; split: the runs of groups that partitions share, by partition; nodes: (pid,
    run, key, level, index, path, top) of the largest subtrees in each partition; roots: (name, key, total, top)."""

    leaves: DataFrame
    split: dict[int, list[tuple[int, int, int]]]
    nodes: DataFrame
    roots: DataFrame


NODE = "pid int, run int, name string, key string, total bigint, height int, level int, index bigint, digest string"
LINK = "pid int, run int, name string, key string, total bigint, height int, level int, index bigint, path string, up_level int, up_index bigint, up string, first boolean"


def _local_nodes(leaves: DataFrame, split: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """The largest whole subtrees of each partition, a few a run and level."""

    def run(batches):
        pid = TaskContext.get().partitionId()
        place = Place(split.get(pid, []))
        stack: list[Node] = []
        out: list[tuple] = []
        number, n, name = -1, 0, None

        def end(last: bool) -> None:
            start, total, whole = place.of(number, n, last)
            if whole:
                close(stack, total, height(total))
            key = "-" if name is None else "=" + name
            out.extend((pid, number, name, key, total, height(total), level, index, digest) for level, index, digest in stack)
            stack.clear()

        for batch in batches:
            for group, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number < 0 or group != name:
                    if number >= 0:
                        end(False)
                    number, n, name = number + 1, 0, group
                push(stack, (0, (place.start if number == 0 else 0) + n, digest))
                n += 1
            yield _batch(out, NODE)
            out.clear()
        if number >= 0:
            end(True)
        yield _batch(out, NODE)

    return leaves.select("group", "leaf").mapInArrow(run, NODE)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def step(index: int, size: int, sibling: str | None) -> str:
    if index ^ 1 >= size:
        return ALONE
    return ("L" if index & 1 else "R") + sibling


def _finished(upto: int):
    """Nodes of one block, which spans 2^upto leaves: the root of the block and the path of each node to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: r["index"] << r["level"])
        total, top = rows[0]["total"], min(upto, rows[0]["height"])
        stack: list[Node] = []
        made: dict[tuple[int, int], str] = {}
        for r in rows:
            push(stack, (r["level"], r["index"], r["digest"]), made)
        if (rows[-1]["index"] + 1) << rows[-1]["level"] >= total:
            close(stack, total, top, made)
        ((up_level, up_index, up),) = stack
        out = []
        for k, r in enumerate(rows):
            path, index = "", r["index"]
            for level in range(r["level"], up_level):
                path += step(index, size_at(total, level), made.get((level, index ^ 1)))
                index >>= 1
            out.append((r["pid"], r["run"], r["name"], r["key"], total, r["height"], r["level"], r["index"], path, up_level, up_index, up, k == 0))
        yield _batch(out, LINK)

    return run


def grow(leaves: DataFrame) -> Forest:
    """A tree for each group of leaves (group string, at: the order in it, leaf; further columns are carried). Null groups are
    one group, nulls come first; rows equal in group and `at` follow their digests."""
    keys = ["group", "at", "leaf"]
    placed = cut(leaves).withColumn("__tie", F.monotonically_increasing_id())  # equal rows are split, too
    placed = cut(placed.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie"))
    runs = placed.select(F.spark_partition_id().alias("pid"), "group").groupBy("pid", "group").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("group")
    runs = runs.select("pid", "n", (F.sum("n").over(by_group.orderBy("pid")) - F.col("n")).alias("start"), F.sum("n").over(by_group).alias("total"))
    split: dict[int, list[tuple[int, int, int]]] = {}
    for r in runs.where("n < total").collect():  # two a partition at most
        split.setdefault(r.pid, []).append((r.start, r.n, r.total))
    nodes = cut(_local_nodes(placed, split))
    rows, most = nodes.agg(F.sum(F.when(F.col("level") >= 0, F.lit(1))), F.max("height")).first()
    partitions = max(placed.rdd.getNumPartitions(), 1)
    each = max((max((total for of in split.values() for _, _, total in of), default=0)) // partitions, 1).bit_length()

    def at_top(df):
        return df.where("level = height")

    tops = at_top(nodes).select("pid", "run", "name", "key", "total", "level", "index", F.lit("").alias("path"), F.col("digest").alias("top"))
    roots = tops.select("name", "key", "total", "top")
    pending, upto, rounds = nodes.where("level < height"), each + FIRST, []
    while split:
        block = F.expr(f"shiftright(index, {upto} - level)")
        ready = pending.where(F.col("level") <= upto)
        linked = cut(ready.groupBy("key", block.alias("block")).applyInArrow(_whole_group(_finished(upto)), LINK))
        rounds.append(linked)
        done = linked.where("first and up_level = height").select("name", "key", "total", F.col("up").alias("top"))
        roots = roots.unionByName(done)
        if upto >= most:
            break
        fresh = linked.where("first and up_level < height").select(
            F.lit(None).cast("int").alias("pid"), F.lit(None).cast("int").alias("run"), "name", "key", "total", "height", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up").alias("digest")
        )
        pending = pending.where(F.col("level") > upto).unionByName(fresh)
        upto += MORE
    known = None
    for linked in reversed(rounds):
        shape = ["pid", "run", "name", "key", "total", "level", "index", "path", "top"]
        full = linked.where("up_level = height").withColumn("top", F.col("up")).select(*shape)
        if known is not None:
            above = known.select("key", F.col("level").alias("up_level"), F.col("index").alias("up_index"), F.col("path").alias("rest"), "top")
            lower = linked.where("up_level < height").join(above, ["key", "up_level", "up_index"])
            full = full.unionByName(lower.withColumn("path", F.concat("path", "rest")).select(*shape)).unionByName(known)
        known = full
    if known is not None:
        tops = tops.unionByName(known.where("pid is not null"))
    return Forest(placed, split, tops, roots)


def _whole_group(run):
    """An applyInArrow function of a group's table from one of its batches."""
    return lambda table: pa.Table.from_batches(list(run(iter(table.to_batches()))))


def _leaf_paths(digests: list[str], start: int, total: int, whole: bool, tops: dict[tuple[int, int], str]) -> Iterator[str]:
    """Path of every leaf of a run, in order; tops: those of its largest whole subtrees."""
    levels: list[tuple[int, list[str]]] = [(start, digests)]
    while size_at(total, len(levels) - 1) > 1:
        low, here = levels[-1]
        first = (low + 1) >> 1
        at = 2 * first - low
        up = [h(here[k], here[k + 1]) for k in range(at, len(here) - 1, 2)]
        if whole and (low + len(here) - 1) % 2 == 0 and len(here) > at:
            up.append(h(here[-1]))
        if not up:
            break
        levels.append((first, up))
    todo = [(level, index, path) for (level, index), path in sorted(tops.items(), key=lambda x: -(x[0][1] << x[0][0]))]
    while todo:
        level, index, path = todo.pop()
        if level == 0:
            yield path
            continue
        low, here = levels[level - 1]
        left, size = 2 * index, size_at(total, level - 1)
        if left + 1 < size:
            todo.append((level - 1, left + 1, step(left + 1, size, here[left - low]) + path))
            todo.append((level - 1, left, step(left, size, here[left + 1 - low]) + path))
        else:
            todo.append((level - 1, left, ALONE + path))


def opened(forest: Forest, nodes: DataFrame) -> DataFrame:
    """The columns of the forest's leaves with `path` and the further columns of nodes (pid, run, level, index, path, ...),
    which are the same for all leaves below a node. Partitions are zipped with their nodes: leaves stay where they are."""
    more = [c for c in nodes.columns if c not in ("pid", "run", "level", "index", "path", "key", "name", "total")]
    leaves, split = forest.leaves, forest.split
    out = StructType([*leaves.schema.fields, *StructType.fromDDL("path string").fields, *[nodes.schema[c] for c in more]])
    n = leaves.rdd.getNumPartitions()
    if n == 0:
        return leaves.sparkSession.createDataFrame([], out)
    group, digest = leaves.columns.index("group"), leaves.columns.index("leaf")

    def complete(pid, pairs):
        for rows, (_, held) in pairs:
            place = Place(split.get(pid, []))
            bounds = [0, *[i for i in range(1, len(rows)) if rows[i][group] != rows[i - 1][group]], len(rows)]
            of_run: dict[int, dict] = {}
            for r in held:
                of_run.setdefault(r["run"], {})[r["level"], r["index"]] = r
            for run, (a, b) in enumerate(zip(bounds, bounds[1:])):
                start, total, whole = place.of(run, b - a, b == len(rows))
                said = tuple(next(iter(of_run[run].values()))[c] for c in more)
                paths = _leaf_paths([r[digest] for r in rows[a:b]], start, total, whole, {k: r["path"] for k, r in of_run[run].items()})
                yield from ((*row, path, *said) for row, path in zip(rows[a:b], paths))

    # an element a partition on either side, none where a partition is empty
    left = leaves.rdd.mapPartitions(lambda it: [held] if (held := [tuple(r) for r in it]) else [])
    by_partition = nodes.groupBy("pid").agg(F.collect_list(F.struct("run", "level", "index", "path", *more)).alias("held"))
    right = by_partition.repartitionById(n, "pid").rdd
    return leaves.sparkSession.createDataFrame(left.zip(right).mapPartitionsWithIndex(complete), out, verifySchema=False)


def proofs(docs: DataFrame, digest: Column | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per document: doc_id, lang, leaf, subroot, root and proof array<struct<side,digest>>, from the leaf upwards (side `-`: no
    sibling, the digest is empty); keep: further columns by name.

    A tree a lang (null is one), leaves by doc_id (null first), equal ids by digest; equal rows have proofs of their own.
    No documents: no rows. Columns of other names are not read; texts are hashed where they lie.
    """
    keep = keep or {}
    kept = F.struct(F.col("doc_id"), F.col("lang"), *[c.alias(name) for name, c in keep.items()])
    made = docs.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").alias("at"), (document_leaf() if digest is None else digest).alias("leaf"), kept.alias("kept"))
    forest = grow(made)
    langs = grow(forest.roots.select(F.lit(None).cast("string").alias("group"), F.col("name").alias("at"), F.col("top").alias("leaf"), "key"))
    above = opened(langs, langs.nodes.withColumnRenamed("top", "root")).select("key", F.col("path").alias("rest"), "root")
    nodes = forest.nodes.join(above, "key").withColumn("path", F.concat("path", "rest")).drop("rest").withColumnRenamed("top", "subroot")
    found = opened(forest, nodes)
    steps = F.sequence(F.lit(0), (F.length("path") / STEP).cast("int") - 1)
    one = lambda k: F.struct(F.substring("path", k * STEP + 1, F.lit(1)).alias("side"), F.trim(F.translate(F.substring("path", k * STEP + 2, F.lit(STEP - 1)), "-", " ")).alias("digest"))
    proof = F.when(F.length("path") > 0, F.transform(steps, one)).otherwise(F.array().cast("array<struct<side:string,digest:string>>"))
    return found.select("kept.doc_id", "kept.lang", "leaf", "subroot", "root", proof.alias("proof"), *[F.col(f"kept.{c}") for c in keep])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    up = lambda acc, p: F.sha2(F.when(p["side"] == "L", F.concat(p["digest"], acc)).when(p["side"] == "R", F.concat(acc, p["digest"])).otherwise(acc), 256)
    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["digest"]), ""), 256)


def verified_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256 of the documents as they are; folded_root of the documents where
    those whose crc32(doc_id) 7 divides claim one character more (a null id or null n_chars stays), and whether it is the root."""
    changed = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    found = proofs(docs, keep={"claimed": F.when(tampered, document_leaf(changed))})
    out = found.select("doc_id", "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("claimed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
