"""Attempts at services: the stream, the windows and a loop decide alike."""

import random
from datetime import datetime, timedelta

from lemmagraph.streaming import attempts

SCHEMA = "service string, seq bigint, at timestamp, ok boolean"
START = datetime(2024, 1, 1)


def loop(rows, most, cap):
    standing, out = {}, {}
    for service, seq, _, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        out[service, seq] = standing.setdefault(service, attempts.Standing()).decide(ok, most, cap)
    return out


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aab"), i, START + timedelta(minutes=rng.randint(0, 300)), rng.random() < 0.6) for i in range(n)]


def of(df):
    return {(r.service, r.seq): (r.made, r.in_row, r.left) for r in df.collect()}


def test_windows_decide_as_a_loop_does(spark):
    for seed, most, cap in [(1, 2, 100), (2, 3, 9), (3, 1, 5), (4, 99, 7)]:
        rows = made(120, seed)
        assert of(attempts.batch(spark.createDataFrame(rows, SCHEMA), most, cap)) == loop(rows, most, cap)
    assert of(attempts.batch(spark.createDataFrame([], SCHEMA), 2, 3)) == {}


def test_the_stream_decides_as_the_windows_do_and_leaves_late_rows_out(spark, tmp_path):
    rows = sorted(made(90, 5), key=lambda r: r[2])
    rng = random.Random(6)
    parts = [rows[i : i + 30] for i in range(0, 90, 30)]
    for a, b in zip(parts, parts[1:]):  # out of order within the hour that is waited
        swapped = [r for r in a if (a[-1][2] - r[2]) < timedelta(minutes=20)][:2]
        for r in swapped:
            a.remove(r)
            b.append(r)
    late = ("a", 900, START - timedelta(hours=9), False)  # comes when its time has long passed
    end = [("z", 901, START + timedelta(days=9), True)], [("z", 902, START + timedelta(days=10), True)]  # moves the watermark over all others
    for k, part in enumerate([*parts, [late], *end]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = attempts.decided(stream, 2, 12).writeStream.outputMode("append").format("memory").queryName("decisions").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = of(spark.table("decisions").where("service <> 'z'"))
    assert got == loop([r for p in parts for r in p if r[0] != "z" and r[1] != 900], 2, 12)
    assert ("a", 900) not in got
