"""Recorded answers of literature services, read as rows. Jobs stay offline: an answer is joined, never fetched.

Fetching itself is a driver-side task that fills the folder of recorded answers; see Budget for its pacing.
"""

from __future__ import annotations

import threading
import time
from urllib.parse import urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I

#: Sentence a service puts where a licence forbids the value (fixed value).
WITHHELD = "contents unavailable due to conflicting licenses"
#: Seconds between requests to one host (fixed values).
SPACING = {"arxiv": 3.0, "zbmath": 1.0, "crossref": 1.0, "openalex": 0.2}
ATOM = "{http://www.w3.org/2005/Atom}"
ARXIV = "{http://arxiv.org/schemas/atom}"

ZBMATH = "STRUCT<result: STRUCT<id: STRING, identifier: STRING, title: STRUCT<title: STRING, original: STRING>, contributors: STRUCT<authors: ARRAY<STRUCT<name: STRING>>>, year: STRING, msc: ARRAY<STRUCT<code: STRING>>, links: ARRAY<STRUCT<type: STRING, identifier: STRING>>, references: ARRAY<STRUCT<text: STRING, doi: STRING, zbmath: STRUCT<document_id: BIGINT, msc: ARRAY<STRING>>>>>>"
OPENALEX = "STRUCT<id: STRING, doi: STRING, display_name: STRING, publication_year: INT, authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, referenced_works: ARRAY<STRING>, locations: ARRAY<STRUCT<landing_page_url: STRING>>, open_access: STRUCT<oa_url: STRING>, best_oa_location: STRUCT<pdf_url: STRING>>"
CROSSREF = "STRUCT<message: STRUCT<items: ARRAY<STRUCT<DOI: STRING, title: ARRAY<STRING>, author: ARRAY<STRUCT<given: STRING, family: STRING>>, issued: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>>>>>"


def shown(value: Column) -> Column:
    """A withheld value is no value."""
    return F.when(F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(WITHHELD)), "").otherwise(F.coalesce(value, F.lit("")))


def read_answers(spark: SparkSession, root: str) -> DataFrame:
    """(service, name, value): recorded answers, one a file, named by the digest of their address."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).selectExpr("_metadata.file_path as path", "value")
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("service"), F.regexp_extract("path", "([^/]+)[.]json$", 1).alias("name"), "value")


def answered(asked: DataFrame, answers: DataFrame, strict: bool = False) -> DataFrame:
    """asked (service, url, ...) with the recorded answer; strict: a missing one is an error that names its file."""
    name = F.sha2("url", 256).substr(1, 32)
    joined = asked.withColumn("name", name).join(answers, ["service", "name"], "left")
    if not strict:
        return joined
    missing = F.raise_error(F.concat(F.lit("no recorded answer: "), "service", F.lit("/"), "name", F.lit(".json")))
    return joined.withColumn("value", F.when(F.col("value").isNull(), missing.cast("string")).otherwise(F.col("value")))


def zbmath(value: Column) -> Column:
    """struct(ids, title, original, authors, year, msc, references) of one record."""
    r = F.from_json(value, ZBMATH)["result"]
    links = F.coalesce(r["links"], F.array().cast("array<struct<type:string,identifier:string>>"))
    linked = lambda kind, scheme: F.transform(F.filter(links, lambda x: F.lower(x["type"]) == kind), lambda x: F.concat(F.lit(f"{scheme}:"), x["identifier"]))
    dois = F.filter(linked("doi", "doi"), lambda x: I.is_doi(I.value_of(x)))
    own = F.when(shown(r["identifier"]) != "", F.array(F.concat(F.lit("zbl:"), r["identifier"]))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.concat(dois, linked("arxiv", "arxiv"), own).alias("ids"), shown(r["title"]["title"]).alias("title"), shown(r["title"]["original"]).alias("original"),
        F.filter(F.transform(r["contributors"]["authors"], lambda a: shown(a["name"])), lambda x: x != "").alias("authors"), shown(r["year"]).alias("year"),
        F.filter(F.transform(r["msc"], lambda m: shown(m["code"])), lambda x: x != "").alias("msc"),
        F.transform(r["references"], lambda x: F.struct(F.when(I.is_doi(x["doi"]), F.concat(F.lit("doi:"), x["doi"])).otherwise("").alias("work"), shown(x["text"]).alias("text"), x["zbmath"]["document_id"].alias("document"), x["zbmath"]["msc"].alias("msc"))).alias("references"),
    )


def openalex(value: Column) -> Column:
    """struct(openalex, ids, title, authors, year, references, open_pdf) of one record."""
    w = F.from_json(value, OPENALEX)
    doi = F.regexp_replace(F.coalesce(w["doi"], F.lit("")), "(?i)^https?://(dx[.])?doi[.]org/", "")
    found = F.filter(F.transform(w["locations"], lambda x: F.regexp_extract(F.coalesce(x["landing_page_url"], F.lit("")), I.ARXIV_URL, 1)), lambda x: x != "")
    arxiv = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
    ids = F.filter(F.array(F.when(I.is_doi(doi), F.concat(F.lit("doi:"), doi)), F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv))), lambda x: x.isNotNull())
    pdf = F.coalesce(w["best_oa_location"]["pdf_url"], w["open_access"]["oa_url"], F.lit(""))
    return F.struct(
        F.regexp_extract(w["id"], "([^/]*)$", 1).alias("openalex"), ids.alias("ids"), F.coalesce(w["display_name"], F.lit("")).alias("title"),
        F.transform(w["authorships"], lambda a: a["author"]["display_name"]).alias("authors"), F.coalesce(w["publication_year"].cast("string"), F.lit("")).alias("year"),
        F.transform(w["referenced_works"], lambda x: F.regexp_extract(x, "([^/]*)$", 1)).alias("references"), F.when(F.contains(pdf, F.lit("arxiv.org")), "").otherwise(pdf).alias("open_pdf"),
    )


def crossref(value: Column) -> Column:
    """array<struct(id, title, authors, year)> of the items that carry a DOI."""
    found = F.filter(F.from_json(value, CROSSREF)["message"]["items"], lambda x: I.is_doi(x["DOI"]))
    return F.transform(found, lambda x: F.struct(F.concat(F.lit("doi:"), x["DOI"]).alias("id"), F.coalesce(F.get(x["title"], F.lit(0)), F.lit("")).alias("title"), F.transform(x["author"], lambda a: F.concat_ws(", ", a["family"], a["given"])).alias("authors"), F.coalesce(F.get(F.get(x["issued"]["date-parts"], F.lit(0)), F.lit(0)).cast("string"), F.lit("")).alias("year")))


def arxiv_feed(text: str) -> dict[str, tuple[str, str]]:
    """id: (primary category, latest version) of an Atom feed."""
    out = {}
    for entry in ElementTree.fromstring(text).iter(f"{ATOM}entry"):
        ident, _, version = (entry.findtext(f"{ATOM}id") or "").rsplit("/abs/", 1)[-1].partition("v")
        primary = entry.find(f"{ARXIV}primary_category")
        if ident:
            out[ident] = (primary.get("term", "") if primary is not None else "", f"v{version}" if version else "")
    return out


class Budget:
    """Spacing of requests by host, for the driver-side task that records answers."""

    def __init__(self, clock=time.monotonic, sleep=time.sleep):
        self.clock, self.sleep, self.last, self.lock = clock, sleep, {}, threading.Lock()

    @staticmethod
    def host(url: str) -> str:
        name = urlsplit(url).hostname or ""
        return next((h for h in SPACING if h in name), name)

    def take(self, url: str, least: float = 0.0) -> float:
        """Wait until the host may be asked again; the seconds waited."""
        with self.lock:
            host = self.host(url)
            wait = max(0.0, self.last.get(host, float("-inf")) + max(SPACING.get(host, 1.0), least) - self.clock())
            if wait:
                self.sleep(wait)
            self.last[host] = self.clock()
            return wait


def same_work(asked: DataFrame, records: DataFrame) -> DataFrame:
    """Records that carry the identifier they were asked by, in any spelling. asked: id; records: id (as asked), ids."""
    both = asked.select("id").join(records, "id")
    return both.where(F.array_contains(F.transform("ids", I.norm), I.norm(F.col("id"))))


def by_title(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each query by title, where it is strong: the higher of the scores of both its titles.

    asked: query_id, title, surnames, year; candidates: query_id, id, title, original, authors, year.
    """
    from ..functions.similarity import STRONG, score

    c = candidates.select("query_id", "id", F.col("title").alias("c_title"), "original", "authors", F.col("year").alias("c_year"))
    j = asked.where((F.col("title") != "") & (F.size("surnames") > 0)).join(c, "query_id")
    one = lambda t: score("title", "surnames", "year", F.lit(""), t, "authors", "c_year")
    scored = j.withColumn("confidence", F.greatest(one("c_title"), one("original")))
    return scored.groupBy("query_id").agg(F.min_by(F.struct("id", "confidence"), F.struct(-F.col("confidence"), "id")).alias("b")).where(F.col("b.confidence") >= STRONG).select("query_id", "b.id", "b.confidence")


def found_anywhere(first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidates of the first service, and of the second where the best of the first is not strong or is not named by a DOI.

    Both: query_id, id, also, confidence, ...; of equally good ones the least id is the best.
    """
    from ..functions.similarity import STRONG

    best = first.groupBy("query_id").agg(F.min_by(F.struct("id", "confidence"), F.struct(-F.col("confidence"), "id")).alias("b"))
    settled = best.where((F.col("b.confidence") >= STRONG) & F.startswith("b.id", F.lit("doi:"))).select("query_id")
    return first.unionByName(second.join(settled, "query_id", "left_anti"))
