"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources; documents with the same set of sources form a pattern. Only sums per
pattern leave the executors: the driver routes the words of each pattern to the quotas of its sources by a
min-cost flow, where the first copy of a word is free and every further copy costs more than all before it
(convex repetition costs), so nothing is repeated while something fresh is left. A pattern whose flow is k times
its words and a rest takes every document k times and, once more, the documents that come first in a seeded
order up to the rest, but that some WINDOW documents on each side of that cut are chosen so that the sum is
nearest to the rest. The cut is found by rounds of exact histograms, one bounded aggregation each.

Targets: sources by code point (null last) weigh `weights` in turn and share `budget` times all words; a
target stops at `most` times its source's words and the excess is shared again by weight.

Defined results: a null text has no words; a null source is a source of its own, the last; an empty membership
takes nothing. Rows equal in id and text are decided alike. An empty table gives an empty table. Other columns are
passed through. The number of sources and patterns is that of a configuration, not of the corpus: their sums are
held on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, set_aside

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = 20_240_229
KEY_BITS = 62
PROBE_BITS = 8
#: Documents expected on each side of the cut among which the last choice is made.
WINDOW = 24
SUM_PARTS = 1 << 20
#: Rows of a table of patterns that may be broadcast (under 1 kB each).
MOST_BROADCAST = 10_000


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight, none above most * size; what is cut off is shared among the others."""
    caps = [most * s for s in sizes]
    out = [0.0] * len(sizes)
    left, open_ = budget * sum(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > caps[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        open_ -= over
    return out


class Flow:
    """Min-cost flow by successive shortest paths; integer capacities and costs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        at = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        self.arcs[a].append(at)
        self.arcs[b].append(at + 1)
        return at

    def run(self, source: int, sink: int) -> None:
        while True:
            far: dict[int, int] = {source: 0}
            came: dict[int, int] = {}
            queue, waiting = deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.arcs[a]:
                    b = self.to[e]
                    if self.room[e] and (b not in far or far[a] + self.cost[e] < far[b]):
                        far[b], came[b] = far[a] + self.cost[e], e
                        if b not in waiting:
                            queue.append(b)
                            waiting.add(b)
            if sink not in far:
                return
            path, b = [], sink
            while b != source:
                path.append(came[b])
                b = self.to[came[b] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most


def route(patterns: Sequence[tuple[frozenset[int], int]], quotas: Sequence[int], most: int) -> list[dict[int, int]]:
    """Words of each pattern routed to each of its sources. patterns: (sources, words)."""
    n, m = len(patterns), len(quotas)
    flow = Flow(n + m + 2)
    source, sink = n + m, n + m + 1
    for i, (_, words) in enumerate(patterns):
        for copy in range(most):
            flow.arc(source, i, words, copy * copy)
    through = [{s: flow.arc(i, n + s, most * words, 0) for s in sorted(members)} for i, (members, words) in enumerate(patterns)]
    for s, quota in enumerate(quotas):
        flow.arc(n + s, sink, quota, 0)
    flow.run(source, sink)
    return [{s: flow.room[e ^ 1] for s, e in arcs.items() if flow.room[e ^ 1]} for arcs in through]


def _beside(df: DataFrame, n: int) -> DataFrame:
    """A table of n rows, one a pattern, for a join that must not gather a hot pattern: broadcast while n is checked to be
    small, joined as Spark sees fit beyond."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _cuts(keys: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, list[int]]]:
    """For each pattern the key below which documents are taken once more, and the keys of a few documents besides."""
    spark = keys.sparkSession
    state = {p: (0, 0, 0) for p, r in rest.items() if r > 0}  # pattern: (prefix, bits known, words below)
    out: dict[str, tuple[int, int]] = {}  # pattern: (cut, words below)
    for bits in range(PROBE_BITS, KEY_BITS + PROBE_BITS, PROBE_BITS):
        if not state:
            break
        bits = min(bits, KEY_BITS)
        known = bits - PROBE_BITS if bits < KEY_BITS else (KEY_BITS - 1) // PROBE_BITS * PROBE_BITS
        open_ = spark.createDataFrame([(p, prefix) for p, (prefix, _, _) in state.items()], "__pattern string, __prefix bigint")
        found = (
            keys.join(_beside(open_, len(state)), "__pattern")
            .where(F.shiftrightunsigned("__key", KEY_BITS - known) == F.col("__prefix"))
            .groupBy("__pattern", F.shiftrightunsigned("__key", KEY_BITS - bits).alias("bin"))
            .agg(F.sum("size").alias("words"), F.count_distinct("__key").alias("n") if bits < KEY_BITS else F.lit(1).alias("n"))
            .collect()
        )
        by: dict[str, list] = {}
        for r in found:
            by.setdefault(r[0], []).append((r.bin, r.words, r.n))
        for p, bins in by.items():
            below, wanted = state[p][2], rest[p]
            for b, words, n in sorted(bins):
                if below + words >= wanted:
                    break
                below += words
            else:
                b, words, n = b + 1, 0, 0
            if n <= 1:
                out[p] = (b << (KEY_BITS - bits), below)
                del state[p]
            else:
                state[p] = (b, bits, below)
    # documents next to the cut, on both sides, can be taken or left: the choice whose sum is nearest to the rest
    n = dict(keys.groupBy("__pattern").count().collect())
    near = {p: (max(0, c - (w := (WINDOW << KEY_BITS) // max(n[p], 1))), min(1 << KEY_BITS, c + w)) for p, (c, _) in out.items()}
    ranges = spark.createDataFrame([(p, *x) for p, x in near.items()], "__pattern string, __low bigint, __high bigint")
    beside: dict[str, list] = {p: [] for p in rest}
    inside = keys.join(_beside(ranges, len(near)), "__pattern").where("__key >= __low and __key < __high and size > 0")
    for r in inside.groupBy("__pattern", "__key").agg(F.sum("size").alias("words")).collect():
        beside[r[0]].append((r["__key"], r["words"]))
    found = {p: (0, []) for p in rest}
    for p, (cut_, below) in out.items():
        items = sorted(beside[p])
        left = rest[p] - below + sum(s for k, s in items if k < cut_)
        found[p] = (near[p][0], [items[i][0] for i in nearest([s for _, s in items], left)])
    return found


def nearest(sizes: Sequence[int], wanted: int) -> list[int]:
    """Places of a choice of sizes whose sum is nearest to the wanted one (to one part in SUM_PARTS of all), by the
    sums that can be reached, as bits; earlier places are preferred."""
    unit = max(1, -(-sum(sizes) // SUM_PARTS))
    steps = [max(1, round(s / unit)) for s in sizes]
    reached = [1]
    for s in reversed(steps):
        reached.append(reached[-1] | reached[-1] << s)
    goal, sums = max(0, round(wanted / unit)), reached[-1]
    under = (sums & (1 << goal + 1) - 1).bit_length() - 1
    over = sums >> goal
    up = goal + (over & -over).bit_length() - 1 if over else under
    at = up if up - goal < goal - under else under
    chosen = []
    for i, s in enumerate(steps):
        if at >= s and reached[len(steps) - i - 1] >> (at - s) & 1:
            chosen.append(i)
            at -= s
    return chosen


def mix(docs: DataFrame, membership: Column | None = None, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with size, repeats, taken = size * repeats, and of the document's first source
    source_size and target; columns of docs with these names give way."""
    docs, back = set_aside(docs, ["__pattern", "__key", "__members", "__whole", "__cut", "__besides"])
    away = {name: new for new, name in back.items()}
    id_col, text_col = away.get(id_col, id_col), away.get(text_col, text_col)
    own = ["size", "repeats", "taken", "source_size", "target"]
    kept = [c for c in docs.columns if c not in own]
    members = F.array("source") if membership is None else membership
    members = F.array_sort(F.array_distinct(members))  # nulls last
    keyed = docs.select(
        *kept, words_in(F.col(text_col)).alias("size"),
        F.to_json(F.transform(members, lambda s: F.struct(s.alias("s"))), {"ignoreNullFields": "false"}).alias("__pattern"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 64 - KEY_BITS).alias("__key"),
        members.alias("__members"),
    )
    keys = cut(keyed.select("__pattern", "__members", "size", "__key"))
    rows = keys.groupBy("__pattern").agg(F.first("__members").alias("members"), F.sum("size").alias("words")).collect()
    names = sorted({s for r in rows for s in r.members or []}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.words for r in rows if s in (r.members or [])) for s in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], budget, most)
    number = {s: i for i, s in enumerate(names)}
    routed = route([(frozenset(number[s] for s in r.members or []), r.words) for r in rows], [round(t) for t in wanted], most)
    flow = {r["__pattern"]: sum(x.values()) for r, x in zip(rows, routed)}
    words = {r["__pattern"]: r.words for r in rows}
    whole = {p: f // words[p] if words[p] else 0 for p, f in flow.items()}
    cuts = _cuts(keys.select("__pattern", "size", "__key"), {p: f - whole[p] * words[p] for p, f in flow.items()})
    first = {r["__pattern"]: number[r.members[0]] if r.members else None for r in rows}
    plan = [(p, whole[p], *cuts[p], sizes[first[p]] if first[p] is not None else 0, wanted[first[p]] if first[p] is not None else 0.0) for p in flow]
    plan_df = docs.sparkSession.createDataFrame(plan, "__pattern string, __whole bigint, __cut bigint, __besides array<bigint>, source_size bigint, target double")
    joined = keyed.join(_beside(plan_df, len(plan)), "__pattern")
    again = (F.col("__key") < F.col("__cut")) | F.array_contains("__besides", F.col("__key"))
    return joined.withColumn("repeats", F.least(F.col("__whole") + again.cast("int"), F.lit(most))).select(*kept, "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats").withColumnsRenamed(back)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: a document taken twice comes twice."""
    aside = {c: f"__own_{c}" for c in ("size", "repeats", "taken", "source_size", "target") if c in docs.columns}
    mixed = mix(docs.withColumnsRenamed(aside), **how)
    twice = F.array_repeat(F.struct(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]), F.col("repeats").cast("int"))
    return mixed.where("repeats > 0").select(F.explode(twice).alias("row")).select("row.*")
