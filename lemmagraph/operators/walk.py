"""The bounded walk of a citation network: levels, subject filter, exclusion reasons, order, cap, estimate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import subjects as S
from ..session import cut

#: Why a work is left out (fixed values).
OUTSIDE = "outside the subjects"
CATEGORY = "arXiv category not in categories"
NEITHER = "no MSC code and no arXiv category"
#: Planning sizes and pacing until real downloads are known (fixed values).
AVERAGE_BYTES = {"source": 3_000_000, "pdf": 1_000_000}
SECONDS = {"source": 3.0, "pdf": 1.0}


class Refused(ValueError):
    """The walk's parameters do not allow a plan."""


def reason(msc: Column, category: Column) -> Column:
    return F.when(F.size(msc) > 0, OUTSIDE).when(category != "", CATEGORY).otherwise(NEITHER)


def walk(works: DataFrame, refs: DataFrame, seeds: DataFrame, depth: int, subjects: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """(key, depth, kept, why, cited_by): every work met within depth levels.

    works: key, msc, category; refs: src, dst (canonical keys); seeds: key. Seeds are kept at depth 1. A level is the
    works that kept works of the level before cite and no earlier level met, kept if the subject filter passes. A
    work left out stays out; cited_by counts the distinct kept works that cite it, from the level before it on.
    """
    if depth < 1:
        raise Refused("depth must be at least 1: depth 1 is the seeds")
    if depth > 1 and not subjects:
        raise Refused("a walk past depth 1 needs subjects")
    links = cut(refs.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())  # made once, read by every level
    verdict = F.coalesce(S.passes(F.col("msc"), F.col("category"), list(subjects), list(categories)), F.lit(False))
    judged = works.select("key", verdict.alias("kept"), reason(F.col("msc"), F.col("category")).alias("why"))
    met = cut(seeds.select("key").distinct().select("key", F.lit(1).alias("depth"), F.lit(True).alias("kept"), F.lit("").alias("why")))
    frontier = met.select("key")
    levels = [met]
    for d in range(2, depth + 1):
        fresh = links.join(frontier.select(F.col("key").alias("src")), "src").select(F.col("dst").alias("key")).distinct().join(met.select("key"), "key", "left_anti")
        level = fresh.join(judged, "key").select("key", F.lit(d).alias("depth"), "kept", F.when(F.col("kept"), "").otherwise(F.col("why")).alias("why"))
        level = cut(level)
        levels.append(level)
        met = met.unionByName(level)
        frontier = level.where("kept").select("key")
    kept = met.where("kept").select(F.col("key").alias("src"), F.col("depth").alias("src_depth"))
    # the last level's references are not read
    citing = links.join(kept.where(F.col("src_depth") < depth), "src").groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("cited_by"))
    return met.join(citing, "key", "left").select("key", "depth", "kept", "why", F.coalesce("cited_by", F.lit(0)).cast("bigint").alias("cited_by"))


def order(walked: DataFrame) -> list[Column]:
    return [F.col("depth"), F.desc("cited_by"), F.col("key")]


def select(walked: DataFrame, kinds: DataFrame, cap: int) -> DataFrame:
    """Kept works with their kind of download and whether the cap selects them.

    kinds: key, kind ('source', 'pdf' or ''). The first cap downloadable works in plan order are selected, found by a
    top-k, not by numbering all works in one task.
    """
    kept = walked.where("kept").join(kinds, "key", "left").withColumn("kind", F.coalesce("kind", F.lit("")))
    chosen = kept.where("kind <> ''").orderBy(*order(kept)).limit(max(0, cap)).select("key", F.lit(True).alias("selected"))
    return kept.join(chosen, "key", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def plan_counts(walked: DataFrame, selected: DataFrame, cap: int) -> DataFrame:
    """(what, n): the counts of a plan."""
    out = selected.agg(
        F.count("*").alias("works"),
        F.count_if(F.col("kind") != "").alias("downloadable"),
        F.count_if(F.col("kind") == "source").alias("from_arxiv"),
        F.count_if(F.col("kind") == "pdf").alias("open_copies"),
        F.count_if(F.col("kind") == "").alias("metadata_only"),
        F.count_if("selected").alias("selected"),
    ).join(walked.agg(F.count_if(~F.col("kept")).alias("excluded")))
    names = out.columns
    over = F.greatest(F.lit(0), F.col("downloadable") - max(0, cap)).alias("over_cap")
    return out.select(*names, over).unpivot([], [*names, "over_cap"], "what", "n")


def estimate(selected: DataFrame, downloads: DataFrame) -> DataFrame:
    """(bytes, seconds) the selected works that are not fetched yet will take: mean sizes of what was fetched, else the
    planning sizes. selected: kind, selected, done (false for all if it is missing)."""
    mean = lambda kind: F.coalesce(F.avg(F.when((F.col("kind") == kind) & (F.col("bytes") > 0), F.col("bytes"))), F.lit(float(AVERAGE_BYTES[kind])))
    means = downloads.agg(mean("source").alias("source"), mean("pdf").alias("pdf"))
    waiting = selected.where(F.col("selected") & ~F.coalesce("done", F.lit(False))) if "done" in selected.columns else selected.where("selected")
    n = waiting.agg(F.count_if(F.col("kind") == "source").alias("ns"), F.count_if(F.col("kind") == "pdf").alias("np"))
    return n.join(means).select((F.col("ns") * F.col("source") + F.col("np") * F.col("pdf")).alias("bytes"), (F.col("ns") * SECONDS["source"] + F.col("np") * SECONDS["pdf"]).alias("seconds"))


def tally(works: DataFrame, msc: str = "msc", category: str = "category") -> DataFrame:
    """(kind, value, n): primary families, families of any code, categories of works without codes, works with neither."""
    none = F.size(msc) == 0
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    primary = F.when(~none, F.array(pair("primary", S.family(F.get(msc, F.lit(0))))))
    every = F.transform(S.families(F.col(msc)), lambda f: pair("any", f))
    rest = F.when(none & (F.col(category) != ""), F.array(pair("categories", F.col(category)))).when(none, F.array(pair("neither", F.lit("works"))))
    rows = F.concat(F.coalesce(primary, F.array().cast("array<struct<kind:string,value:string>>")), every, F.coalesce(rest, F.array().cast("array<struct<kind:string,value:string>>")))
    return works.select(F.explode(rows).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def status(downloads: DataFrame, cap: int) -> DataFrame:
    """One row: works, downloaded, failed, to_fetch under the cap, beyond_cap, metadata_only.

    downloads: kind ('' if not downloadable), done, error.
    """
    waiting = F.count_if((F.col("kind") != "") & ~F.col("done"))
    done = F.count_if("done")
    fetch = F.least(waiting, F.greatest(F.lit(0), F.lit(max(0, cap)) - done))
    return downloads.agg(F.count("*").alias("works"), done.alias("downloaded"), F.count_if(F.col("error") != "").alias("failed"), fetch.alias("to_fetch"), (waiting - fetch).alias("beyond_cap"), F.count_if(F.col("kind") == "").alias("metadata_only"))


def most_common(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def first_successes(attempts: DataFrame, partition: list[str], at: list, ok: str, cap: int) -> DataFrame:
    """Attempts a capped, resumable fetch makes: those before the cap of successes is reached; failures take no slot."""
    before = F.coalesce(F.sum(F.col(ok).cast("int")).over(Window.partitionBy(*partition).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return attempts.withColumn("successes_before", before).where(F.col("successes_before") < cap)


def fill(works: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """Works with what an answer adds: title and year where they are empty, authors where there are none, codes at the end.

    Both have title, year, authors, msc; answers has at most one row a key.
    """
    a = answers.select(key, *[F.col(c).alias(f"__{c}") for c in ("title", "year", "authors", "msc")])
    j = works.join(a, key, "left")
    text = {c: F.when(F.col(c) != "", F.col(c)).otherwise(F.coalesce(f"__{c}", F.lit(""))) for c in ("title", "year")}
    none = F.array().cast("array<string>")
    j = j.withColumns({**text, "authors": F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("__authors", none)), "msc": F.array_union("msc", F.coalesce("__msc", none))})
    return j.select(*works.columns)


def classify(works: DataFrame, sources: list[DataFrame], key: str = "key") -> DataFrame:
    """msc and category of works that have neither, from the first source that knows the work.

    sources: key, msc, category, at most one row a key, in order of authority.
    """
    out = works
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col("msc").alias(f"__m{i}"), F.col("category").alias(f"__c{i}")), key, "left")
    told = lambda i: (F.size(F.coalesce(f"__m{i}", F.array().cast("array<string>"))) > 0) | (F.coalesce(f"__c{i}", F.lit("")) != "")
    msc, category = F.col("msc"), F.col("category")
    unknown = (F.size("msc") == 0) & (F.col("category") == "")
    for i in reversed(range(len(sources))):
        msc = F.when(unknown & told(i), F.coalesce(f"__m{i}", F.array().cast("array<string>"))).otherwise(msc)
        category = F.when(unknown & told(i), F.coalesce(f"__c{i}", F.lit(""))).otherwise(category)
    return out.withColumns({"__msc": msc, "__category": category}).select(*[F.col(f"__{c}").alias(c) if c in ("msc", "category") else F.col(c) for c in works.columns])


def bind(candidates: DataFrame, strong: float = 0.9) -> DataFrame:
    """(query_id, id, confidence, why): the best candidate where it is strong, else why the query stays unidentified.

    candidates: query_id, id (null: the service had nothing), confidence; ties by id.
    """
    best = candidates.groupBy("query_id").agg(F.min_by(F.struct("id", "confidence"), F.struct(-F.coalesce("confidence", F.lit(-1.0)), "id")).alias("b"))
    good = F.col("b.confidence") >= strong
    why = F.when(good, "").when(F.col("b.id").isNull(), "no match").otherwise("no strong match")
    return best.select("query_id", F.when(good, F.col("b.id")).alias("id"), "b.confidence", why.alias("why"))


def remap_citing(works: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, reached_from): citing keys as they are called now, distinct in order, without the work itself.

    works: key, reached_from; aliases: id (normal form), key.
    """
    from ..functions.identifiers import norm

    each = works.select("key", F.posexplode("reached_from").alias("pos", "citing"))
    now = each.join(aliases.select(F.col("id"), F.col("key").alias("__now")), norm(F.col("citing")) == F.col("id"), "left").withColumn("citing", F.coalesce("__now", "citing"))
    first = now.where(F.col("citing") != F.col("key")).groupBy("key", "citing").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "citing"))), lambda x: x["citing"]).alias("reached_from"))
    return works.select("key").join(listed, "key", "left").select("key", F.coalesce("reached_from", F.array().cast("array<string>")).alias("reached_from"))


def until_refused(attempts: DataFrame, partition: list[str], at: list, most: int = 3) -> DataFrame:
    """Attempts made before a service has refused `most` times in a row.

    attempts: kind ('source' attempts count, others neither count nor reset), ok. A run is the source attempts since the
    last success.
    """
    order = Window.partitionBy(*partition).orderBy(*at)
    source = F.col("kind") == "source"
    run = F.sum(F.when(source & F.col("ok"), 1).otherwise(0)).over(order)
    failed = attempts.withColumn("__run", run).withColumn("__bad", F.when(source & ~F.col("ok"), 1).otherwise(0))
    in_row = F.sum("__bad").over(Window.partitionBy(*partition, "__run").orderBy(*at))
    stops = failed.withColumn("__stop", F.when(in_row >= most, 1).otherwise(0))
    before = F.coalesce(F.max("__stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stops.withColumn("__before", before).where("__before = 0").select(*attempts.columns)


def holding_any(works: DataFrame, idents: list[str]) -> DataFrame:
    """Works that carry any of the identifiers, in any spelling; all works if none is asked."""
    from ..functions.identifiers import norm

    if not idents:
        return works
    wanted = F.array(*[norm(F.lit(i)) for i in idents])
    return works.where(F.arrays_overlap(F.transform("ids", norm), wanted))


def extraction_report(extracted: DataFrame) -> DataFrame:
    """(status, versions, results, proofs) of an extraction."""
    return extracted.groupBy("status").agg(F.count_distinct("version").alias("versions"), F.count("local").alias("results"), F.count_if(F.coalesce("proof", F.lit("")) != "").alias("proofs"))


def save_plan(path: str, selected: DataFrame, walked: DataFrame, fingerprint: str) -> dict:
    """Write the plan of a walk as one document; it is the size of the selection."""
    import json

    doc = {
        "plan": 1, "fingerprint": fingerprint,
        "order": [r.key for r in selected.orderBy(*order(selected)).select("key").collect()],
        "selected": [r.key for r in selected.where("selected").orderBy(*order(selected)).select("key").collect()],
        "excluded": [r.asDict() for r in walked.where("not kept").orderBy("depth", F.desc("cited_by"), "key").select("key", "depth", "why", "cited_by").collect()],
    }
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, sort_keys=True)
    return doc


def load_plan(path: str, fingerprint: str | None = None) -> dict | None:
    """The plan, or None if there is none or it was made under other settings."""
    import json
    import os

    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    return doc if fingerprint is None or doc.get("fingerprint") == fingerprint else None


def rendered(counts: dict, limit: int = 12) -> str:
    return " · ".join(f"{k} {n}" for k, n in list(counts.items())[:limit]) or "none"
