"""The links that papers state: references to labels, citations with and without a locator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import locators as L

#: Citation and reference commands (fixed values).
CITE = r"\\(?:cite|parencite|textcite|autocite|citep|citet|footcite)\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}"
REF = r"\\(?:ref|eqref|cref|Cref|autoref)\s*\{([^}]*)\}"


def text_of(results: DataFrame):
    return F.concat_ws("\n", F.coalesce("statement", F.lit("")), F.coalesce("proof", F.lit("")))


def references(results: DataFrame) -> DataFrame:
    """(src, version, pos, label): every label a result's text refers to."""
    return results.select(F.col("key").alias("src"), "version", F.posexplode(F.regexp_extract_all(text_of(results), F.lit(REF), F.lit(1))).alias("pos", "label")).withColumn("label", F.trim("label"))


def citations(results: DataFrame) -> DataFrame:
    """(src, version, pos, postnote, citekey): every key of every citation, in order."""
    text = text_of(results)
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)).alias("note"), F.regexp_extract_all(text, F.lit(CITE), F.lit(2)).alias("keys"))
    each = results.select(F.col("key").alias("src"), "version", F.posexplode(both).alias("pos", "c"))
    listed = each.select("src", "version", "pos", F.col("c.note").alias("postnote"), F.explode(F.split("c.keys", ",")).alias("citekey"))
    return listed.withColumn("citekey", F.trim("citekey")).where("citekey <> ''")


def labels(results: DataFrame) -> DataFrame:
    """(version, label, key): the first result of a version that carries a label, by order of key."""
    each = results.select("version", "key", "seq", F.explode(F.concat(F.array("local"), "aliases")).alias("label")).where("label <> ''")
    return each.groupBy("version", "label").agg(F.min_by("key", F.struct("seq", "key")).alias("key"))


def internal_edges(results: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(src, dst, evidence): labels that name another result of the same version, read with or without its prefix."""
    refs = references(results)
    refs = refs.join(prefixes, "version", "left") if prefixes is not None else refs.withColumn("prefix", F.lit(""))
    lead = F.concat(F.col("prefix"), F.lit("-"))
    bare = F.when((F.coalesce("prefix", F.lit("")) != "") & F.startswith("label", lead), F.col("label").substr(F.length(lead) + 1, F.length("label"))).otherwise(F.col("label"))
    known = labels(results)
    one = refs.withColumn("bare", bare).join(known.select("version", F.col("label").alias("bare"), F.col("key").alias("by_bare")), ["version", "bare"], "left")
    two = one.join(known.select("version", "label", F.col("key").alias("by_name")), ["version", "label"], "left")
    dst = F.coalesce("by_bare", "by_name")
    return two.where(dst.isNotNull() & (dst != F.col("src"))).select("src", dst.alias("dst"), F.concat(F.lit("\\ref{"), F.col("label"), F.lit("}")).alias("evidence"))


def citekeys(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(work, citekey, cited): the canonical work a citekey names in a work's bibliography; the last entry wins.

    refs: work, citekey, cited, seq. aliases: id (normal form), key.
    """
    named = refs.where((F.col("citekey") != "") & (F.col("cited") != "")).withColumn("id", ids.norm(F.col("cited")))
    joined = named.join(aliases, "id", "left").withColumn("target", F.coalesce("key", "cited"))
    return joined.groupBy("work", "citekey").agg(F.max_by("target", "seq").alias("cited"))


def located(results: DataFrame, versions: DataFrame, keyed: DataFrame) -> dict[str, DataFrame]:
    """Citations resolved: edges to works without locator, edges by locator, ambiguities and misses.

    results: key, version, local, taxon, number, aliases, statement, proof, seq; versions: id, work; keyed: of citekeys().
    """
    of_version = versions.select(F.col("id").alias("version"), "work")
    cites = citations(results).join(of_version, "version").join(keyed, ["work", "citekey"]).select("src", "pos", "postnote", "citekey", "cited")
    bare = F.trim("postnote") == ""
    whole = cites.where(bare).select("src", F.col("cited").alias("dst"), F.concat(F.lit("\\cite{"), F.col("citekey"), F.lit("}")).alias("evidence"))
    # distinct spellings are normalised once, however often they are cited
    notes = cites.where(~bare).select("postnote").distinct().select("postnote", L.wanted(F.col("postnote")).alias("wanted"), F.size(L.wanted(F.col("postnote"))).alias("n_parts"))
    asked = cites.where(~bare).join(notes, "postnote").select("src", "pos", "postnote", "citekey", "cited", "n_parts", F.posexplode("wanted").alias("part_pos", "part"))
    answering = results.join(of_version, "version").select(F.col("work").alias("cited"), "key", "local", F.explode(L.forms(F.col("local"), F.col("taxon"), F.col("number"), F.col("aliases"))).alias("part"))
    # one row a work and part: how many different results answer, and the last key among them
    found = answering.groupBy("cited", "part").agg(F.count_distinct("local").alias("n"), F.max("key").alias("dst"), F.array_sort(F.collect_set("key")).alias("matched"))
    met = asked.join(found, ["cited", "part"], "left")
    return {
        "unspecified": whole,
        "locator": met.where("n = 1").select("src", "dst", F.col("part").alias("evidence")),
        "ambiguous": met.where("n > 1").select("src", "cited", F.trim("postnote").alias("postnote"), "matched", F.when(F.col("n_parts") == 1, "several").otherwise("partial").alias("kind")),
        "unmatched": met.where("n is null").select("src", "cited", "part"),
    }


def link(results: DataFrame, versions: DataFrame, keyed: DataFrame, prefixes: DataFrame | None = None) -> dict[str, DataFrame]:
    """All edges (src, dst, origin, evidence; repeats kept), ambiguities, misses."""
    out = located(results, versions, keyed)
    own = internal_edges(results, prefixes)
    edges = [df.select("src", "dst", F.lit(origin).alias("origin"), "evidence") for origin, df in (("internal", own), ("locator", out["locator"]), ("unspecified", out["unspecified"]))]
    return {"edges": edges[0].unionByName(edges[1]).unionByName(edges[2]), "ambiguous": out["ambiguous"], "unmatched": out["unmatched"]}


def report(linked: dict[str, DataFrame]) -> DataFrame:
    """(what, n): edges by origin, unmatched parts, ambiguities."""
    by_origin = linked["edges"].groupBy(F.col("origin").alias("what")).agg(F.count("*").alias("n"))
    rest = [linked[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k in ("unmatched", "ambiguous")]
    return by_origin.unionByName(rest[0]).unionByName(rest[1])


def shown_note(note):
    """A postnote or a locator in the form in which they are compared."""
    plain = F.regexp_replace(F.regexp_replace(note, r"[~{}]", " "), r"\\S|§", "section")
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"[.]$", ""))


def pieces(results: DataFrame, edges: DataFrame, text: str = "statement") -> DataFrame:
    """(src, pos, kind, raw, shown, postnote, citekey, dst): a result's text cut at its citations; the raw pieces joined in
    order give the text back.

    edges: src, seq, dst, origin, evidence. The n-th citation of a locator or key leads where the n-th edge with that evidence
    leads (by seq), the last one where there are fewer edges than citations; a citation without an edge has no dst. A
    locator goes before a bare key. Empty texts have no pieces.
    """
    body = F.coalesce(text, F.lit(""))
    cut = lambda group: F.regexp_extract_all(body, F.lit(CITE), F.lit(group))
    between = F.transform(F.split(body, CITE, -1), lambda t: F.struct(t.alias("raw"), F.lit("").alias("note"), F.lit("").alias("citekey"), F.lit("text").alias("kind")))
    cites = F.transform(F.arrays_zip(cut(0).alias("raw"), cut(1).alias("note"), cut(2).alias("citekey")), lambda c: F.struct(c["raw"].alias("raw"), F.trim(F.coalesce(c["note"], F.lit(""))).alias("note"), F.trim(c["citekey"]).alias("citekey"), F.lit("cite").alias("kind")))
    woven = F.flatten(F.transform(between, lambda t, i: F.filter(F.array(t, F.get(cites, i)), lambda x: x.isNotNull())))
    each = results.select(F.col("key").alias("src"), F.posexplode(woven).alias("pos", "x")).where("x.raw <> ''")
    rows = each.select("src", "pos", "x.kind", "x.raw", F.when(F.col("x.kind") == "text", F.col("x.raw")).otherwise(F.coalesce(F.nullif("x.note", F.lit("")), "x.citekey")).alias("shown"), F.col("x.note").alias("postnote"), "x.citekey")
    told = edges.select("src", "seq", "dst", F.when(F.col("origin") == "locator", F.concat(F.lit("l:"), shown_note(F.col("evidence")))).otherwise(F.concat(F.lit("k:"), F.regexp_extract("evidence", r"^\\cite\{(.+)\}$", 1))).alias("evidence"))
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("src", "evidence").orderBy("seq", "dst"))).withColumn("last", F.max("n").over(Window.partitionBy("src", "evidence")))

    def aligned(rows: DataFrame, evidence, name: str) -> DataFrame:
        """rows with the end of the edge that their evidence has at their occurrence."""
        order = Window.partitionBy("src", "__e").orderBy("pos")
        numbered = rows.withColumn("__e", F.when(F.col("kind") == "cite", evidence)).withColumn("__n", F.row_number().over(order))
        ends = told.select("src", F.col("evidence").alias("__e"), F.col("n").alias("__at"), "last", F.col("dst").alias(name))
        lasts = ends.where("__at = last").select("src", "__e", "last", F.col(name).alias("__l"))
        exact = numbered.join(ends.select("src", "__e", F.col("__at").alias("__n"), name), ["src", "__e", "__n"], "left")
        return exact.join(lasts, ["src", "__e"], "left").withColumn(name, F.when(F.col("__n") > F.col("last"), F.col("__l")).otherwise(F.col(name))).drop("__e", "__n", "last", "__l")

    rows = aligned(rows, F.when(F.col("postnote") != "", F.concat(F.lit("l:"), shown_note(F.col("postnote")))), "__by_note")
    rows = aligned(rows, F.concat(F.lit("k:"), F.col("citekey")), "__by_key")
    return rows.select("src", F.row_number().over(Window.partitionBy("src").orderBy("pos")).alias("pos"), "kind", "raw", "shown", "postnote", "citekey", F.coalesce("__by_note", "__by_key").alias("dst"))


def ranked_by(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def ambiguity_log(ambiguous: DataFrame, when: str) -> DataFrame:
    """(row): lines of the log decisions are later taken from."""
    cells = [F.lit(when), F.col("src"), F.col("cited"), F.col("postnote"), L.normalize(F.col("postnote")), F.array_join("matched", ", "), F.col("kind")]
    return ambiguous.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))
