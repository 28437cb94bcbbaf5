"""Works met under several names: a walk whose identities grow, and lookups that ask one service after another.

An identity is a class of identifiers. A source, asked for one identifier, tells others of the same work; classes that
turn out to be one are contracted. Contraction is incremental: a level's answers link new identifiers with labels of
classes, connected components are found among these labels only, and the classes they name are relabelled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import subjects as S
from ..functions import text as T
from ..session import cut
from .graph import components
from .walk import CATEGORY, NEITHER, OUTSIDE, Refused


def asked_of(answers: DataFrame) -> DataFrame:
    """(id, other): what an answer to a question for an identifier tells about its names, in normal form."""
    told = answers.select(I.norm(F.col("asked")).alias("id"), F.explode("ids").alias("other"))
    return told.select("id", I.norm(F.col("other")).alias("other")).where("id is not null and other is not null").distinct()


def grow(members: DataFrame, fresh: DataFrame, told: DataFrame) -> DataFrame:
    """members (id, label) with fresh identifiers (id) and all that sources tell of them, each gained one asked in turn.

    A round asks only what the round before gained. Identifiers of known classes end a chain: they were asked before.
    """
    found = ask = cut(fresh.join(members, "id", "left_anti"))
    links = None
    while not ask.isEmpty():
        got = cut(ask.join(told, "id"))
        links = got if links is None else links.unionByName(got)
        ask = cut(got.select(F.col("other").alias("id")).distinct().join(members, "id", "left_anti").join(found, "id", "left_anti"))
        found = found.unionByName(ask)
    every = members.unionByName(found.select("id", F.col("id").alias("label")))
    if links is None:
        return cut(every)
    known = members.select(F.col("id").alias("other"), "label")
    edges = links.join(known, "other", "left").select(F.col("id").alias("u"), F.coalesce("label", "other").alias("v"))
    moved = components(edges).select(F.col("node").alias("label"), "root")
    return cut(every.join(moved, "label", "left").select("id", F.coalesce("root", "label").alias("label")))


def _verdicts(classes: DataFrame, members: DataFrame, answers: DataFrame, subjects: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(label, kept, why) of classes (label), by all that sources tell about their identifiers: codes, else a category."""
    told = classes.join(members, "label").join(answers, "id")
    coded = F.size("msc") > 0
    inside = F.coalesce(S.passes(F.col("msc"), F.lit(""), list(subjects), []), F.lit(False))
    seen = told.groupBy("label").agg(F.max(coded).alias("coded"), F.max(inside).alias("inside"), F.min(F.nullif("category", F.lit(""))).alias("named"))
    seen = classes.join(seen, "label", "left")
    coded, inside = F.coalesce("coded", F.lit(False)), F.coalesce("inside", F.lit(False))
    kept = F.when(coded, inside).otherwise(F.coalesce(F.col("named").isin(*categories), F.lit(False)) if categories else F.lit(False))
    why = F.when(kept, "").when(coded, OUTSIDE).when(F.col("named").isNotNull(), CATEGORY).otherwise(NEITHER)
    return seen.select("label", kept.alias("kept"), why.alias("why"))


def walk(answers: DataFrame, refs: DataFrame, seeds: DataFrame, depth: int, subjects: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """(key, home, depth, kept, why, names, cited_by): every work met within depth levels, each once whatever it was called.

    answers: asked, ids, msc, category (what a source says when asked for an identifier; several rows may answer one);
    refs: asked, dst (identifiers that the work found under `asked` cites); seeds: id. Seeds are kept at depth 1. A
    level reads the references of the works kept one level before, asks for every identifier not met so far, and judges
    those that do not turn out to be works met earlier; a work left out stays out. Works that an answer shows to be one
    are one from then on: the record of least depth remains, and an exclusion ends where a kept work takes its name.
    key: the most useful name; home: the name it was first kept (or left out) under; names: how many it has; cited_by:
    distinct kept works that cite it. Identifiers compare in normal form, null ones are none.
    """
    if depth < 1:
        raise Refused("depth must be at least 1: depth 1 is the seeds")
    if depth > 1 and not subjects:
        raise Refused("a walk past depth 1 needs subjects")
    told = cut(asked_of(answers))
    said = answers.select(I.norm(F.col("asked")).alias("id"), F.coalesce("msc", F.array().cast("array<string>")).alias("msc"), F.coalesce("category", F.lit("")).alias("category"))
    cites = cut(refs.select(I.norm(F.col("asked")).alias("id"), I.norm(F.col("dst")).alias("dst")).where("id is not null and dst is not null").distinct())
    first = seeds.select(I.norm(F.col("id")).alias("id")).where("id is not null").distinct()
    members = grow(first.select("id", F.col("id").alias("label")).limit(0), first, told)
    kept = cut(first.select("id", F.lit(1).alias("depth")))
    out = cut(first.limit(0).select("id", F.lit(1).alias("depth"), F.lit("").alias("why")))
    citing = None
    for d in range(2, depth + 1):
        at = kept.join(members, "id").groupBy("label").agg(F.min("depth").alias("depth"))
        frontier = at.where(F.col("depth") == d - 1).select("label")
        read = frontier.join(members, "label").join(cites, "id").select("label", "dst").distinct()
        own = members.select(F.col("id").alias("dst"), F.col("label").alias("own"))
        read = cut(read.join(own, "dst", "left").where("own is null or own <> label").select("label", "dst"))
        citing = read if citing is None else citing.unionByName(read)
        fresh = cut(read.select(F.col("dst").alias("id")).distinct().join(members, "id", "left_anti"))
        members = grow(members, fresh, told)
        met = kept.select("id").unionByName(out.select("id")).join(members, "id").select("label").distinct()
        candidates = cut(fresh.join(members, "id").join(met, "label", "left_anti"))
        judged = cut(candidates.join(_verdicts(candidates.select("label").distinct(), members, said, subjects, categories), "label"))
        kept = kept.unionByName(judged.where("kept").select("id", F.lit(d).alias("depth")))
        out = out.unionByName(judged.where("not kept").select("id", F.lit(d).alias("depth"), "why"))
    return _met(members, kept, out, citing)


def _met(members: DataFrame, kept: DataFrame, out: DataFrame, citing: DataFrame | None) -> DataFrame:
    """The works of a walk as they are called at its end."""
    rows = kept.select("id", "depth", F.lit(True).alias("kept"), F.lit("").alias("why")).unionByName(out.select("id", "depth", F.lit(False).alias("kept"), "why"))
    first = F.struct(~F.col("kept"), "depth", "id")
    works = rows.join(members, "id").groupBy("label").agg(F.min_by(F.struct("id", "depth", "kept", "why"), first).alias("w"))
    names = members.join(works.select("label"), "label").groupBy("label").agg(F.min_by("id", F.struct(I.rank(F.col("id")), "id")).alias("key"), F.count("*").alias("names"))
    done = works.join(names, "label").select("label", "key", F.col("w.id").alias("home"), "w.depth", "w.kept", "w.why", "names")
    if citing is None:
        return done.withColumn("cited_by", F.lit(0).cast("bigint")).drop("label")
    label = lambda of, as_: members.select(F.col("id").alias(of), F.col("label").alias(as_))
    pairs = citing.withColumnRenamed("label", "src").join(label("src", "by"), "src").join(label("dst", "label"), "dst").where(F.col("by") != F.col("label"))
    n = pairs.select("by", "label").distinct().groupBy("label").agg(F.count("*").alias("cited_by"))
    return done.join(n, "label", "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)).cast("bigint")).drop("label")


# --- services asked in order ---------------------------------------------------------------------------------------
def first_hit(rows: DataFrame, answers: DataFrame, schemes: Sequence[str], key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, answer): for every row the answer to the first of its identifiers, in their order, that has one.

    answers: asked and what is told, at most one row an identifier. Only keys and identifiers are exchanged with the
    answers; a row without a hit is not returned.
    """
    wanted = F.filter(F.transform(ids, I.norm), lambda x: I.scheme_of(x).isin(*schemes))
    each = rows.select(F.col(key), F.posexplode(wanted).alias("pos", "asked"))
    told = answers.select(I.norm(F.col("asked")).alias("asked"), F.struct(*[c for c in answers.columns if c != "asked"]).alias("answer"))
    return each.join(told, "asked").groupBy(key).agg(F.min_by("answer", "pos").alias("answer"))


def learn(rows: DataFrame, hits: DataFrame, key: str = "key") -> DataFrame:
    """Rows with what their answers add: identifiers (ranked, known spellings stay), title and year where empty, authors where
    there are none, codes at the end, the open copy where none is known. An answer need not have all of these."""
    told = [f.name for f in hits.schema["answer"].dataType.fields]
    both = rows.join(hits, key, "left")
    none = F.array().cast("array<string>")
    new: dict[str, Column] = {}
    if "ids" in told:
        new["ids"] = I.ranked(F.concat("ids", F.coalesce("answer.ids", none)))
    for c in ("title", "year", "open_pdf"):
        if c in told:
            new[c] = F.when(F.col(c) != "", F.col(c)).otherwise(F.coalesce(f"answer.{c}", F.lit("")))
    if "authors" in told:
        new["authors"] = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("answer.authors", none))
    if "msc" in told:
        new["msc"] = F.array_union("msc", F.coalesce("answer.msc", none))
    return both.withColumns(new).select(*rows.columns)


def enrich(works: DataFrame, index: DataFrame, graph: DataFrame) -> DataFrame:
    """Works filled from an index of reviews, then from a citation graph that is asked for what the index told, too."""
    works = learn(works, first_hit(works, index, ("doi", "arxiv", "zbl")))
    return learn(works, first_hit(works, graph, ("doi", "arxiv")))


def title_question(title: Column, authors: Column) -> Column:
    """How a title is asked for: folded, with the folded surname of the first author; null without either."""
    who = T.fold(T.surname(F.get(authors, F.lit(0))))
    return F.when((title != "") & (F.size(authors) > 0), F.concat(T.fold(title), F.lit("|"), who))


def classified(works: DataFrame, index: DataFrame, graph: DataFrame, titles: DataFrame, preprints: DataFrame) -> DataFrame:
    """Works with codes or a category where any source has them, in four steps that feed each other.

    Works without codes ask the index for each of their names. Those still without, and without a preprint number, ask
    the graph for their DOI: it may tell a title, authors, a preprint number. Those with title and authors then ask the index by
    title (titles: asked as title_question says, ids, msc, ...). Works with a preprint number ask the preprint server
    (preprints: asked, category, version): for a category where there are no codes, for a version where none is known.
    """
    uncoded = works.where(F.size("msc") == 0)
    works = learn(works, first_hit(uncoded, index, ("doi", "arxiv", "zbl")))
    arxiv = F.exists("ids", lambda x: I.scheme_of(x) == "arxiv")
    unplaced = works.where((F.size("msc") == 0) & ~arxiv)
    dois = unplaced.withColumn("ids", F.slice(F.filter("ids", lambda x: I.scheme_of(I.norm(x)) == "doi"), 1, 1))
    pending = unplaced.select("key", F.lit(True).alias("pending"))
    works = cut(learn(works, first_hit(dois, graph, ("doi",))).join(pending, "key", "left"))
    asking = works.where("pending").select("key", title_question(F.col("title"), F.col("authors")).alias("asked")).where("asked is not null")
    by_title = asking.join(titles.select("asked", F.struct(*[c for c in titles.columns if c != "asked"]).alias("answer")), "asked").select("key", "answer")
    works = learn(works.drop("pending"), by_title)
    named = first_hit(works.where((F.size("msc") == 0) & (F.col("category") == "") | (F.col("version") == "")), preprints, ("arxiv",))
    both = works.join(named, "key", "left")
    category = F.when((F.size("msc") == 0) & (F.col("category") == ""), F.coalesce("answer.category", F.lit(""))).otherwise(F.col("category"))
    version = F.when(F.col("version") == "", F.coalesce("answer.version", F.lit(""))).otherwise(F.col("version"))
    return both.withColumns({"category": category, "version": version}).select(*works.columns)
