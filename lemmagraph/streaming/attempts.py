"""Attempts at services as a stream: who is refused too often, who has used up its slots.

A service is asked until it has refused `most` times in a row, and until it has answered `cap` times. Rows may come out
of order by as much as the watermark allows: a service keeps what came in its state and decides about a row when the
watermark has passed it, in order of time and number, so that the stream decides as a batch over the same rows does. Rows that come
after the watermark has passed their time are late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED = "service string, seq bigint, at timestamp, ok boolean, made boolean, in_row int, left int"
STATE = "waiting array<struct<at:bigint,seq:bigint,ok:boolean>>, in_row int, used int"


@dataclass
class Standing:
    """Refusals since the last answer, and answers so far."""

    in_row: int = 0
    used: int = 0

    def decide(self, ok: bool, most: int, cap: int) -> tuple[bool, int, int]:
        """Is the attempt made? Refusals in a row and slots left after it."""
        made = self.in_row < most and self.used < cap
        if made:
            self.in_row, self.used = (0, self.used + 1) if ok else (self.in_row + 1, self.used)
        return made, self.in_row, cap - self.used


def batch(attempts: DataFrame, most: int, cap: int) -> DataFrame:
    """The same decisions over a bounded table, as windows: an attempt is made if no run of refusals before it is as long as
    `most` and fewer than `cap` were answered."""
    order = Window.partitionBy("service").orderBy("at", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("ok").cast("int")
    rows = attempts.withColumn("__run", F.sum(ok).over(order)).withColumn("__used", F.coalesce(F.sum(ok).over(before), F.lit(0)))
    in_row = F.sum(1 - ok).over(Window.partitionBy("service", "__run").orderBy("at", "seq"))
    rows = rows.withColumn("__in_row", in_row).withColumn("__stopped", F.coalesce(F.max((F.col("__in_row") >= most).cast("int")).over(before), F.lit(0)))
    made = (F.col("__stopped") == 0) & (F.col("__used") < cap)
    rows = rows.withColumn("made", made)
    # what stands after the attempts made so far
    last = F.last(F.when(made, F.struct(F.when(F.col("ok"), 0).otherwise(F.col("__in_row")).cast("int").alias("r"), (F.col("__used") + ok).cast("int").alias("u"))), ignorenulls=True).over(order)
    return rows.select("service", "seq", "at", "ok", "made", F.coalesce(last["r"], F.lit(0)).alias("in_row"), (F.lit(cap) - F.coalesce(last["u"], F.lit(0))).alias("left"))


def decided(attempts: DataFrame, most: int, cap: int, late: str = "1 hour") -> DataFrame:
    """Decisions about a stream of attempts (service, seq, at, ok), each made once the watermark has passed it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, in_row, used = state.get if state.exists else ([], 0, 0)
        standing = Standing(in_row, used)
        rows = [(int(r[0]), int(r[1]), bool(r[2])) for r in waiting]
        for pdf in batches:
            rows += [(at.value // 1000, int(seq), bool(ok)) for at, seq, ok in zip(pdf["at"], pdf["seq"], pdf["ok"])]
        rows.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        n = sum(at <= passed for at, _, _ in rows)
        out = [(key[0], seq, pd.Timestamp(at, unit="us"), ok, *standing.decide(ok, most, cap)) for at, seq, ok in rows[:n]]
        rest = rows[n:]
        state.update((rest, *asdict(standing).values()))
        if rest:  # woken when the watermark has passed the first of them
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["service", "seq", "at", "ok", "made", "in_row", "left"])

    timed = attempts.withWatermark("at", late)
    return timed.groupBy("service").applyInPandasWithState(step, DECIDED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
