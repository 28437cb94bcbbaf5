"""Identifiers of works, versions and results as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of identifiers, most useful first (fixed values).
SCHEMES = ("doi", "arxiv", "mr", "zbl", "work")
#: Shapes of identifiers (fixed values).
DOI_SHAPE = r"^10\.\d+/\S+$"
ARXIV_DOI = r"(?i)^10\.48550/arxiv\.(\S+)$"
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf|e-print)/([^\s?#]+)"
DOI_URL = r"(?i)(?:doi\.org/|dx\.doi\.org/)(10\.[^\s?#]+)"
VERSION_SUFFIX = r"v\d+$"


def scheme_of(ident: Column) -> Column:
    return F.lower(F.split_part(ident, F.lit(":"), F.lit(1)))


def value_of(ident: Column) -> Column:
    """What follows the first colon; empty without one."""
    at = F.instr(ident, ":")
    return F.when(at > 0, ident.substr(at + 1, F.length(ident))).otherwise("")


def norm(ident: Column) -> Column:
    """One spelling an identifier: lower-case scheme and DOI, no resolver address, arXiv without its version."""
    ident = F.trim(ident)
    scheme, value = scheme_of(ident), F.trim(value_of(ident))
    doi = F.lower(F.regexp_replace(value, r"(?i)^https?://(dx\.)?doi\.org/", ""))
    named = F.regexp_extract(doi, r"^10\.48550/arxiv\.(.+)$", 1)
    bare = lambda v: F.regexp_replace(v, VERSION_SUFFIX, "")
    return (
        F.when((scheme == "doi") & (named != ""), F.concat(F.lit("arxiv:"), bare(named)))
        .when(scheme == "doi", F.concat(F.lit("doi:"), doi))
        .when(scheme == "arxiv", F.concat(F.lit("arxiv:"), bare(value)))
        .otherwise(F.concat(scheme, F.lit(":"), value))
    )


def rank(ident: Column) -> Column:
    scheme = scheme_of(ident)
    out = F.lit(9)
    for i, s in reversed(list(enumerate(SCHEMES))):
        out = F.when(scheme == s, i).otherwise(out)
    return out


def ranked(ids: Column) -> Column:
    """Distinct by normal form (first spelling kept), most useful scheme first, order kept within a scheme."""
    keyed = F.transform(ids, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("at"), norm(x).alias("norm"), x.alias("id")))
    first = F.filter(keyed, lambda x: ~F.exists(keyed, lambda y: (y["norm"] == x["norm"]) & (y["at"] < x["at"])))
    return F.transform(F.array_sort(first), lambda x: x["id"])


def unique(values: Column) -> Column:
    """Distinct in order, without empty strings and nulls."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def sanitise(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"[^A-Za-z0-9._-]", "_")


def home_of(ident: Column) -> Column:
    return F.concat(scheme_of(ident), F.lit("/"), sanitise(value_of(ident)))


def version_local(home: Column, ident: Column) -> Column:
    """The folder of a version under its work's home: what the identifier adds to it, `main` if nothing."""
    scheme = F.split_part(ident, F.lit(":"), F.lit(1))
    local = sanitise(value_of(ident))
    home_scheme, home_value = F.split_part(home, F.lit("/"), F.lit(1)), F.regexp_extract(home, r"^[^/]*/(.*)$", 1)
    rest = local.substr(F.length(home_value) + 1, F.length(local))
    own = (scheme == home_scheme) & F.startswith(local, home_value)
    return F.when(own, F.when(rest == "", "main").otherwise(rest)).otherwise(F.concat(scheme, F.lit("-"), local))


def version_from_local(home: Column, local: Column) -> Column:
    """The identifier whose version_local under the home is given."""
    base = F.regexp_replace(home, "^([^/]*)/", "$1:")
    other = F.regexp_extract(local, r"^(doi|arxiv|mr|zbl|work)-(.*)$", 1)
    return F.when(local == "main", base).when(other != "", F.regexp_replace(local, r"^([a-z]+)-", "$1:")).otherwise(F.concat(base, local))


def is_doi(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")).rlike(DOI_SHAPE)


def parse(text: Column) -> Column:
    """struct(scheme, value), or null unless text is `scheme:value` with a known scheme."""
    text = F.trim(text)
    scheme, value = F.trim(scheme_of(text)), F.trim(value_of(text))
    return F.when(F.contains(text, F.lit(":")) & scheme.isin(*SCHEMES) & (value != ""), F.struct(scheme.alias("scheme"), value.alias("value")))


def first_of(ids: Column, scheme: str) -> Column:
    """Value of the first identifier of a scheme, null if none."""
    return value_of(F.get(F.filter(ids, lambda x: F.startswith(F.lower(x), F.lit(f"{scheme}:"))), F.lit(0)))


def result_key(version: Column, local: Column) -> Column:
    return F.concat_ws("#", version, local)


def parse_key(text: Column) -> Column:
    """struct(version, local) of `version#local`; an error if either is empty."""
    version, local = F.split_part(text, F.lit("#"), F.lit(1)), F.regexp_extract(text, r"(?s)^[^#]*#(.*)$", 1)
    return F.when((version != "") & (local != ""), F.struct(version.alias("version"), local.alias("local"))).otherwise(F.raise_error(F.concat(F.lit("not a result key: "), text)))


def work_of_version(version: Column) -> Column:
    """An arXiv version's work; other versions name their work themselves."""
    named = F.regexp_extract(version, r"^(arxiv:.+?)(v\d+)$", 1)
    return F.when(named != "", named).otherwise(version)


def downloadable(arxiv: Column, open_pdf: Column) -> Column:
    return F.when(F.coalesce(arxiv, F.lit("")) != "", "source").when(F.coalesce(open_pdf, F.lit("")) != "", "pdf").otherwise("")


def downloaded(kind: Column, error: Column) -> Column:
    return (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(error, F.lit("")) == "")


def citekey(ident: Column) -> Column:
    return F.regexp_replace(ident, "[^A-Za-z0-9]", "")


def eprint_url(value: Column) -> Column:
    return F.concat(F.lit("https://export.arxiv.org/e-print/"), value)


def bib_identifiers(key: Column, ids: Column) -> Column:
    """Identifiers for a bibliography entry: arXiv DOIs read as arXiv, exact repeats dropped, by rank."""
    ids = F.when(F.size(ids) > 0, ids).otherwise(F.array(key))

    def one(x: Column) -> Column:
        scheme, value = F.trim(scheme_of(x)), F.trim(value_of(x))
        named = F.regexp_extract(value, ARXIV_DOI, 1)
        return F.when((scheme == "doi") & (named != ""), F.concat(F.lit("arxiv:"), named)).when(value != "", F.concat(scheme, F.lit(":"), value)).otherwise("")

    found = unique(F.transform(ids, one))
    keyed = F.transform(found, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("at"), x.alias("id")))
    return F.transform(F.array_sort(keyed), lambda x: x["id"])


#: Fields of an entry in writing order (fixed values).
ENTRY_FIELDS = ("title", "author", "year", "doi", "eprint", "eprinttype", "mrnumber", "zbl")


def entry_fields(key: Column, ids: Column, title: Column, authors: Column, year: Column) -> Column:
    """array<struct(name, value)> of the entry's fields that are not empty."""
    found = bib_identifiers(key, ids)
    first = lambda s: F.coalesce(first_of(found, s), F.lit(""))
    values = {
        "title": title,
        "author": F.array_join(F.filter(authors, lambda a: a != ""), " and "),
        "year": year,
        "doi": first("doi"),
        "eprint": first("arxiv"),
        "eprinttype": F.when(first("arxiv") != "", "arXiv").otherwise(""),
        "mrnumber": first("mr"),
        "zbl": first("zbl"),
    }
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), values[n].alias("value")) for n in ENTRY_FIELDS]), lambda f: f["value"] != "")


def bibtex_entry(key: Column, ids: Column, title: Column, authors: Column, year: Column) -> Column:
    head = F.concat(F.lit("@"), F.when(year != "", "article").otherwise("misc"), F.lit("{"), citekey(F.element_at(bib_identifiers(key, ids), 1)), F.lit(","))
    lines = F.transform(entry_fields(key, ids, title, authors, year), lambda f: F.concat(F.lit("  "), f["name"], F.lit(" = {"), f["value"], F.lit("},")))
    return F.concat(F.array_join(F.concat(F.array(head), lines, F.array(F.lit("}"))), "\n"), F.lit("\n"))
