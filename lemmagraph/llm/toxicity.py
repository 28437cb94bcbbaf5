"""Toxic passages: maximum-scoring segments of token log-odds, weighed by extreme-value statistics.

Learning reads a bounded sample of labelled documents: about SAMPLE_ROWS ids a class, chosen by a hash of the id. A token is a run of
letters; what is counted are distinct contexts (the token between its two neighbours), so that exact copies, near
copies, shared passages and repeated lines count once. The units of evidence are a whole token and its prefixes; each
has log-odds under Dirichlet priors that follow its share of all contexts. A token carries the log-odds of its most
significant unit, any other token a small negative score, so that log-odds of a text without toxic passages fall.

Scoring is one linear scan a text: all maximal scoring segments, each with the number of equally good ones that a
clean text of the same length holds by chance (E-value, Gumbel tail fitted to clean documents). Segments of small
E-value are passages; their evidence is added up and mapped to a probability by a logistic curve fitted to the labels
of documents that the weights were not learned from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import TwoGenerations, append_columns, in_remainder

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled documents of each class that learning reads, about (a hash of the id decides).
SAMPLE_ROWS = 4096
#: Of ten parts of the sample, so many teach the weights; the others fit the tail and the curve.
TAUGHT = 7
#: Prefixes from SHORTEST to LONGEST letters are units besides the whole token.
SHORTEST, LONGEST = 3, 8
#: Contexts that the Dirichlet prior of a class is worth.
PRIOR = 1000.0
#: Log-odds under this make no evidence, however sure: words of a language that toxic documents happen to prefer.
LEAST_ODDS = 1.5
#: Segments of an E-value up to this are passages.
SIGNIFICANT = 0.1
#: Bits of the hash that chooses the sample.
BITS = 30


@dataclass
class Model:
    """weights: log-odds of units (a whole token ends with `$`); other: score of any other token; tail: lambda and K of
    the E-value K * tokens * exp(-lambda * score); curve: intercept and slope of the logistic curve."""

    weights: dict[str, tuple[float, float]]
    other: float
    tail: tuple[float, float]
    curve: tuple[float, float]


def units(token: str) -> list[str]:
    return [token[:k] for k in range(SHORTEST, min(len(token), LONGEST + 1))] + [token + "$"]


class Scanner:
    """Scores texts by a model; lives in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.weight = TwoGenerations(self._weight, 100_000)

    def _weight(self, token: str) -> float:
        found = [self.model.weights[u] for u in units(token.lower()) if u in self.model.weights]
        return max(found)[1] if found else 0.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens, and all maximal scoring segments: (score, first token, last token), in text order."""
        tokens = TOKEN.findall(text or "")
        held = {t: w for t in set(tokens) if (w := self.weight(t)) > 0}
        if not held:
            return len(tokens), []
        met: set[tuple[str, str, str]] = set()
        scored = []
        for i, t in enumerate(tokens):
            if t in held:
                context = (tokens[i - 1].lower() if i else "", t.lower(), tokens[i + 1].lower() if i + 1 < len(tokens) else "")
                if context not in met:  # a context counts once, as in learning
                    met.add(context)
                    scored.append((i, held[t]))
        return len(tokens), maximal_segments(scored, self.model.other)

    def evidence(self, n: int, scores: list[float]) -> float:
        """The surprise (minus log E-value) of the best segment, and that of every other one that has any. No segment: that
        of a score of zero, less one."""
        rate, scale = self.model.tail
        surprise = sorted((rate * s - math.log(max(scale * n, 1e-9)) for s in scores), reverse=True)
        return surprise[0] + sum(s for s in surprise[1:] if s > 0) if surprise else -math.log(max(scale * max(n, 1), 1e-9)) - 1

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of label 1; passages: start and end in code points, score, E-value."""
        n, found = self.segments(text)
        rate, scale = self.model.tail
        start, slope = self.model.curve
        p = logistic(start + slope * self.evidence(n, [s for s, _, _ in found]))
        passages = []
        sure = [(s, a, b, e) for s, a, b in found if (e := scale * n * math.exp(-rate * s)) <= SIGNIFICANT]
        if sure:
            spans = [m.span() for m in TOKEN.finditer(text)]
            passages = [(spans[a][0], spans[b][1], s, e) for s, a, b, e in sure]
        return p, passages


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -700.0), 700.0)))


def maximal_segments(scored: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence: scored has position and (positive) score of some, ascending; every
    other place scores `other` (negative). A candidate is (sum before it, sum after it, first, last, the candidate it was
    compared with); comparing along these links makes the scan linear."""
    kept: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for i, s in scored:
        total += (i - at) * other
        before, first = total, i
        total, at = total + s, i + 1
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= total:
                kept.append((before, total, first, i, j))
                break
            before, first = kept[j][0], kept[j][2]
            link = kept[j][4]
            del kept[j:]
            j = link
    return [(after - before, first, last) for before, after, first, last, _ in kept]


def held_out(column: str = "doc_id") -> Column:
    return in_remainder(column, 5, 0)


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[bool, int]]:
    """(id, text, toxic, taught) of about SAMPLE_ROWS ids a class, and the ids of each class; a repeated id with any label
    1 is toxic."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.where(~held_out()).select("doc_id", "toxic")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for toxic, rows in n.items():
        part = F.when(F.col("toxic") == toxic, SAMPLE_ROWS / rows).otherwise(part)
    drawn = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = known.where(F.pmod(drawn, F.lit(1 << BITS)) < part * (1 << BITS))
    taught = F.pmod(F.xxhash64(F.lit("taught"), "doc_id"), F.lit(10)) < TAUGHT
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # about 2 * SAMPLE_ROWS ids
    return rows.select(F.col("doc_id").alias("id"), "text", "toxic", taught.alias("taught")), n


def _contexts(sample: DataFrame) -> DataFrame:
    """(token, clean, toxic): distinct contexts of each token by class."""

    def run(batches):
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = ["", *(t.lower() for t in TOKEN.findall(text)), ""]
                seen.update(zip([toxic] * len(tokens), tokens, tokens[1:], tokens[2:]))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows], pa.string()), pa.array([f"{r[1]} {r[3]}" for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.bool_())], names=["token", "beside", "toxic"]
            )

    each = sample.where("taught").select("text", "toxic").mapInArrow(run, "token string, beside string, toxic boolean")
    each = each.groupBy("token", F.xxhash64("token", "beside"), "toxic").agg(F.lit(1).alias("one"))
    return each.groupBy("token").agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic"))


def _weights(contexts: DataFrame) -> dict[str, tuple[float, float]]:
    """Significance and log-odds of every unit that a class prefers for sure: its signed likelihood ratio exceeds what
    the best of so many units reaches by chance."""
    contexts = cut(contexts)
    totals = contexts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not totals.clean or not totals.toxic:
        return {}
    n = totals.clean + totals.toxic
    prefixes = F.when(F.length("token") > SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("token") - 1, F.lit(LONGEST))), lambda k: F.substring("token", F.lit(1), k)))
    all_units = F.concat(F.coalesce(prefixes, F.array().cast("array<string>")), F.array(F.concat("token", F.lit("$"))))
    by_unit = cut(contexts.select(F.explode(all_units).alias("unit"), "clean", "toxic").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    chance = math.sqrt(2 * math.log(max(by_unit.count(), 2)))
    both, t, k = F.col("clean") + F.col("toxic"), F.col("toxic"), F.col("clean")
    share = totals.toxic / n
    ratio = F.sqrt(2 * F.greatest(t * F.log(t / both / share) + F.when(k > 0, k * F.log(k / both / (1 - share))).otherwise(0.0), F.lit(0.0)))
    prior = both * (PRIOR / n)
    odds = F.log((t + prior) / (totals.toxic + PRIOR - t - prior)) - F.log((k + prior) / (totals.clean + PRIOR - k - prior))
    sure = by_unit.where(t / both > share).select("unit", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= chance) & (F.col("odds") >= LEAST_ODDS))
    return {r.unit: (r.ratio, r.odds) for r in sure.collect()}


def _measured(sample: DataFrame, model: Model, wanted: str) -> DataFrame:
    """(toxic, n, marks, scores) of sampled documents: tokens, scored tokens, scores of their segments."""

    def start():
        scanner = Scanner(model)

        def work(texts):
            found = [scanner.segments(t) for t in texts]
            marks = [sum(scanner.weight(w) > 0 for w in TOKEN.findall(t)) for t in texts]
            return [pa.array([n for n, _ in found], pa.int64()), pa.array(marks, pa.int64()), pa.array([[s for s, _, _ in segs] for _, segs in found], pa.list_(pa.float64()))]

        return work

    return append_columns(sample.where(wanted), ["text"], "n bigint, marks bigint, scores array<double>", start, keep=["toxic"])


def _tail(rows: list) -> tuple[float, float]:
    """Rate and scale of the tail of best scores of clean documents: beyond a threshold the excess is exponential, and as
    many documents exceed it as sum(1 - exp(-E)) says. The highest twentieth of the excesses counts as the least of it,
    for labels that are wrong."""
    best = np.array([max(r.scores, default=0.0) for r in rows])
    n = np.array([r.n for r in rows], float)
    over = np.sort(best[best > LEAST_ODDS] - LEAST_ODDS)
    if not len(over):
        return 1.0, 1e-3
    over = np.minimum(over, over[int(0.95 * (len(over) - 1))])
    rate = 1 / max(float(over.mean()), 0.1)
    low, high = -40.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - np.exp(-np.exp(mid) * n)).sum() < len(over) else (low, mid)
    return rate, math.exp(low + rate * LEAST_ODDS)


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve, by Newton steps on the weighted likelihood less a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 1e-3 * a, (w * (y - p) * x).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), but those of the held-out remainder. Rows without
    id, text or label teach nothing. Without labels, or without a sure difference of the classes, the model gives every text the
    share of label 1 (less than a half)."""
    sample, n = _sample(docs, labels)
    sample = cut(sample)
    base = (n.get(True, 0) + 0.5) / (sum(n.values()) + 2)
    flat = math.log(base / (1 - base)) if base < 0.5 else -1e-9
    model = Model(_weights(_contexts(sample)), 0.0, (1.0, 1e-3), (flat, 0.0))
    if not model.weights:
        return model
    sums = {r.toxic: r for r in _measured(sample, model, "taught").groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("marks").alias("marks")).collect()}
    toxic, clean = ((sums[k].marks + 1) / (sums[k].n + 2) for k in (True, False))
    model.other = math.log((1 - toxic) / (1 - clean)) if toxic > clean else -1e-3
    rows = _measured(sample, model, "not taught").collect()  # of the bounded sample
    model.tail = _tail([r for r in rows if not r.toxic])
    seen = {k: sum(r.toxic == k for r in rows) for k in (True, False)}
    if not all(seen.values()):
        return model
    scanner = Scanner(model)
    x = np.array([scanner.evidence(r.n, r.scores) for r in rows])
    y = np.array([float(r.toxic) for r in rows])
    w = np.array([n[r.toxic] / sum(n.values()) / seen[r.toxic] * len(rows) for r in rows])  # classes weigh as in all labels
    start, slope = _curve(x, y, w)
    model.curve = (start, slope) if slope > 0 else (flat, 0.0)
    return model


def detect(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns, all by default) with score double, predicted int, passages array<struct<start,end,score,e_value>>
    (code points of the text, in text order). Null and empty texts get the score of no evidence and no passages; columns
    of these names in docs give way. One pass, no exchange."""

    def start():
        scanner = Scanner(model)
        passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

        def work(texts):
            found = [scanner.score(t) for t in texts]
            spans = [[dict(zip(("start", "end", "score", "e_value"), p)) for p in ps] for _, ps in found]
            return [pa.array([p for p, _ in found], pa.float64()), pa.array([int(p >= 0.5) for p, _ in found], pa.int32()), pa.array(spans, passage)]

        return work

    return append_columns(docs, ["text"], "score double, predicted int, passages array<struct<start:bigint,end:bigint,score:double,e_value:double>>", start, keep)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, passages (how many, n_passages). Repeated rows are scored each;
    a null id is not held out."""
    found = detect(docs, learn(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
