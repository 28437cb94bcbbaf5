"""Scans against plain loops, and the stored search index against a scan of all works."""

import random

import pytest
from pyspark.sql import functions as F

from lemmagraph.operators import postings, scans, search


# pacing
def test_pacing_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(0, 4000)) for i in range(1200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.start for r in scans.paced(spark.createDataFrame(rows, "id bigint, host string, arrival bigint"), "host", "arrival", ["id"], {"hot": 7}, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, want = {}, {}
    for i, host, arrival in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last[host] = max(arrival, last.get(host, -(10**9)) + (7 if host == "hot" else 3))
    assert got == want
    assert scans.paced(spark.createDataFrame([], "id bigint, host string, arrival bigint"), "host", "arrival", ["id"], {}, 3).collect() == []


# counters
class Loop:
    """Counters of one document, stepped one event after another."""

    def __init__(self):
        self.sec, self.counters, self.letters = [0] * 6, {}, False

    def prefix(self, depth):
        first = chr(64 + max(self.sec[1], 1)) if self.letters else str(self.sec[1])
        return ".".join([first, *map(str, self.sec[2 : depth + 1])])

    def step(self, kind, level, counter, within, recorded):
        if kind == "heading":
            self.sec[level] += 1
            self.sec[level + 1 :] = [0] * (5 - level)
            for c, (w, _) in self.counters.items():
                if w and level <= w:
                    self.counters[c] = (w, 0)
            return self.prefix(level)
        if kind == "appendix":
            self.letters, self.sec = True, [0] * 6
        if kind == "item":
            n = self.counters.get(counter, (within, 0))[1] + 1
            number = f"{self.prefix(within)}.{n}" if within else str(n)
            if recorded:
                *parts, last = recorded.split(".")
                n = int(last) if last.isdigit() else n
                for i, p in enumerate(parts if within else []):
                    if p.isdigit():
                        self.sec[i + 1] = int(p)
                    elif i == 0 and p.isupper() and len(p) == 1:
                        self.letters, self.sec[1] = True, ord(p) - 64
                number = recorded
            self.counters[counter] = (within, n)
            return number


def test_numbers_of_random_documents(spark):
    rng = random.Random(7)
    within = {"theorem": 2, "lemma": 1, "remark": 0, "deep": 5}
    rows = []
    for doc in range(60):
        for at in range(rng.randint(0, 60)):
            kind = rng.choices(["heading", "item", "appendix", "text"], [4, 8, 0.3, 1])[0]
            counter = rng.choice(sorted(within)) if kind == "item" else None
            recorded = rng.choice(["", "", "", "2.3.9", "4", "B.7", "1.x", "3.1"]) if kind == "item" else rng.choice(["", None])
            rows.append((doc, at, kind, rng.randint(1, 5) if kind == "heading" else None, counter, within.get(counter), recorded))
    got = {(r.doc, r.at): r.number for r in scans.numbered(spark.createDataFrame(rows, "doc int, at int, kind string, level int, counter string, within int, recorded string").repartition(5)).collect()}
    loops = {}
    for doc, at, *event in rows:
        assert got[doc, at] == loops.setdefault(doc, Loop()).step(*event), (doc, at)


def test_three_levels_an_appendix_and_recorded_numbers(spark):
    events = [("heading", 1, None, None, ""), ("heading", 2, None, None, ""), ("item", None, "thm", 2, ""), ("item", None, "thm", 2, "1.1.7"), ("item", None, "thm", 2, ""), ("heading", 3, None, None, ""), ("item", None, "thm", 2, ""), ("heading", 2, None, None, ""), ("item", None, "thm", 2, ""), ("appendix", None, None, None, ""), ("heading", 1, None, None, ""), ("item", None, "thm", 2, ""), ("item", None, "rem", 0, "")]
    rows = spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], "doc int, at int, kind string, level int, counter string, within int, recorded string")
    got = [r.number for r in scans.numbered(rows).orderBy("at").collect()]
    assert got == ["1", "1.1", "1.1.1", "1.1.7", "1.1.8", "1.1.1", "1.1.9", "1.2", "1.2.1", None, "A", "A.0.1", "1"]


def test_letters_beyond_one_byte(spark):
    """Spark's char begins anew at 256: the 192nd section of an appendix was called NUL, the 257th A."""
    events = [(0, "appendix", None, "", None, 0), *((i, "heading", 1, "", None, 0) for i in range(1, 300)), (300, "item", None, "55232.1", "thm", 1), (301, "heading", 1, "", None, 0)]
    rows = spark.createDataFrame([(1, *e) for e in events], "doc int, at int, kind string, level int, recorded string, counter string, within int")
    got = [r.number for r in scans.numbered(rows).orderBy("at").collect()]
    assert got == [None, *(chr(64 + i) for i in range(1, 300)), "55232.1", "55233"]


# brackets
def stack_of(marks):
    out, stack = {}, []
    for at, kind, name in marks:
        if kind == "begin":
            out[at] = [name, None, len(stack) + 1, stack[-1][0] if stack else None, "unclosed"]
            stack.append((at, name))
        elif stack:
            b, n = stack.pop()
            out[b][1], out[b][4] = at, "" if n == name else "mismatched"
        else:
            out[at] = [name, None, 0, None, "stray end"]
    return out


@pytest.mark.parametrize("begins", [0.35, 0.5, 0.65])
def test_brackets_of_random_documents(spark, begins):
    rng = random.Random(begins)
    rows = [(doc, at, "begin" if rng.random() < begins else "end", rng.choice("ab")) for doc in range(40) for at in range(rng.randint(0, 30))] + [(1, 99, "other", "a")]
    got = {(r.doc, r.at): [r.name, r.close, r.depth, r.parent, r.problem] for r in scans.matched(spark.createDataFrame(rows, "doc int, at int, kind string, name string").repartition(4)).collect()}
    want = {(doc, at): v for doc in range(40) for at, v in stack_of([r[1:] for r in rows if r[0] == doc and r[2] != "other"]).items()}
    assert got == want


# stored search
@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"k{i:04}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 12))), [rng.choice(["Ana Lía", "Bo"])]) for i in range(900)]
    rows += [("de", "Die Schrödinger Gleichung, 2. Teil", ["Erwin S."]), ("fr", "L'éclair_bleu", ["É. Ő"]), ("none", None, None), ("empty", "", []), ("nulls", "w1", [None, "Bo"])]
    works = spark.createDataFrame(rows, "key string, title string, authors array<string>")
    path = f"file://{tmp_path_factory.mktemp('search')}/index"
    postings.build(works, path, per_range=8)
    return works, path


def test_marks_are_folded_in_titles_and_questions(spark, stored):
    found = lambda text, **kw: [r.key for r in postings.search(spark, stored[1], text, **kw).collect()]
    assert found("schrodinger") == found("SCHRÖDINGER gleichung") == found("schö schrodinger".split()[1]) == ["de"]
    assert found("eclair") == found("Éclair -bleu") == found("o") == ["fr"]
    assert found("") == found("%") == found("unheard of") == found("w1", limit=0) == []
    assert len(found("lia", limit=7)) == 7


@pytest.mark.parametrize("text", ["w0", "w3 w1", "w20 lia", "w0 w1 w2", "w39", "bo w5 w6"])
def test_few_blocks_are_read_and_hits_are_those_of_a_scan(spark, stored, text):
    works, path = stored
    clean = works.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    want = [(r.key, round(r.score, 9)) for r in search.ranked(clean, text, 10).collect()]
    report = {}
    got = [(r.key, round(r.score, 9)) for r in postings.search(spark, path, text, 10, report).collect()]
    assert got == want
    assert 0 < report["read"] <= report["blocks"]
    if text == "w0":
        assert report["read"] < report["blocks"] / 2


def test_a_question_reads_the_rows_of_its_tokens_only(spark, stored):
    blocks = spark.read.parquet(f"{stored[1]}/blocks").where(F.col("token").isin("w3", "w1")).select("token", "range", "best")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "In(token" in plan and "posts" not in plan
