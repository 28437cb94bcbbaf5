"""Registered queries over the bridge views, each with the SQL another engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import locators as L
from ..functions import subjects as S
from ..functions import text as T
from ..operators import graph, intervals, link, scans, search, upsert, walk
from .bridge import duck_cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str = "", *views: str):
    """Register a query under its function's name; views are defined before the oracle's text."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            head = f"with recursive {duck_cte(*views)}" if views else ""
            rest = oracle.strip()
            ORACLES[f.__name__] = f"{head}, {rest[5:].strip()}" if rest.startswith("with ") and views else f"{head} {rest}".strip()
        return f

    return add


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the other engine for functions used in several oracles
def duck_norm(x: str) -> str:
    value = f"trim(case when instr({x}, ':') = 0 then '' else substr({x}, instr({x}, ':') + 1) end)"
    scheme = f"lower(split_part({x}, ':', 1))"
    bare = f"regexp_replace({value}, 'v[0-9]+$', '')"
    doi = f"lower(regexp_replace({value}, '^https?://(dx[.])?doi[.]org/', '', 'i'))"
    return f"case when {scheme} = 'doi' and {doi} like '10.48550/arxiv.%' then 'arxiv:' || regexp_replace(substr({doi}, 16), 'v[0-9]+$', '') when {scheme} = 'doi' then 'doi:' || {doi} when {scheme} = 'arxiv' then 'arxiv:' || {bare} else {scheme} || ':' || {value} end"


def duck_rank(x: str) -> str:
    return f"case lower(split_part({x}, ':', 1)) when 'doi' then 0 when 'arxiv' then 1 when 'mr' then 2 when 'zbl' then 3 when 'work' then 4 else 9 end"


def duck_family(c: str) -> str:
    return f"case when regexp_matches({c}, '^[0-9][0-9]') then substr({c}, 1, 2) || coalesce(nullif(regexp_extract({c}, '^[0-9][0-9]([A-Z-])', 1), ''), '-') else substr({c}, 1, 3) end"


KIND_CASE = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in L.KIND_OF.items()) + " else w end"
KIND_LIST = ", ".join(f"'{k}'" for k in L.KINDS)
ROMAN_CASE = "case w " + " ".join(f"when '{r}' then '{i}'" for i, r in enumerate(L.ROMAN, 1)) + " else w end"
FILLER_LIST = ", ".join(f"'{w}'" for w in L.FILLERS)


def duck_normalize(source: str, out: str) -> str:
    """CTEs that normalise distinct texts: source(t) to out(t, n)."""
    bs = "chr(92)"
    steps = [
        f"regexp_replace(t, {bs}||{bs}||'href[ ]*[{{][^}}]*[}}][ ]*[{{]([^}}]*)[}}]', {bs}||'1', 'g')",
        f"regexp_replace(s, {bs}||{bs}||'S\\b|§', ' section ', 'g')",
        f"regexp_replace(s, {bs}||{bs}||'[A-Za-z@]+[*]?\\s*', ' ', 'g')",
        f"lower(replace(replace(replace(replace(s, '~', ' '), '{{', ''), '}}', ''), {bs}, ' '))",
        r"regexp_replace(s, '\b(?:pp?|pages?)\.?\s*\d+\s*(?:--?|–|—)?\s*\d*', ' ', 'g')",
        r"regexp_replace(s, '\s*\((?:\d+|[ivxl]+|[a-z])\)', ' ', 'g')",
        "replace(replace(s, '(', ' '), ')', ' ')",
        r"regexp_replace(s, '([a-z])\.(\s|$)', '\1\2', 'g')",
        "regexp_replace(s, '[,;:]+', ' ', 'g')",
    ]
    ctes, last = [], source
    for i, step in enumerate(steps):
        ctes.append(f"{out}_{i} as (select distinct t, {step} as s from {last})")
        last = f"{out}_{i}"
    ctes.append(f"{out}_w as (select t, unnest(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '' and x not in ({FILLER_LIST}))) as w, generate_subscripts(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '' and x not in ({FILLER_LIST})), 1) as i from {last})")
    ctes.append(f"{out}_k as (select t, i, {KIND_CASE} as w from {out}_w)")
    ctes.append(f"{out}_r as (select t, i, case when lag(w) over (partition by t order by i) in ({KIND_LIST}) then {ROMAN_CASE} else w end as w from {out}_k)")
    ctes.append(f"{out} as (select s.t, coalesce(string_agg(r.w, ' ' order by r.i), '') as n from (select distinct t from {source}) s left join {out}_r r on r.t = s.t group by s.t)")
    return ", ".join(ctes)


# --- identifiers -------------------------------------------------------------------------------------------------
@query(f"select doc_id, pos, id, {duck_norm('id')} as norm, {duck_rank('id')} as rank from (select doc_id, unnest(ids) as id, generate_subscripts(ids, 1) - 1 as pos from b_works) x", "b_works")
def norm_identifiers(spark, d):
    each = view(spark, d, "b_works").select("doc_id", F.posexplode("ids").alias("pos", "id"))
    return each.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "id", I.norm(F.col("id")).alias("norm"), I.rank(F.col("id")).alias("rank"))


@query(
    f"""with x as (select doc_id, unnest(ids) as id, generate_subscripts(ids, 1) as pos from b_works),
n as (select *, {duck_norm('id')} as norm from x), f as (select *, row_number() over (partition by doc_id, norm order by pos) as k from n)
select doc_id, string_agg(id, ' ' order by {duck_rank('id')}, pos) as ids from f where k = 1 group by doc_id""",
    "b_works",
)
def ranked_identifiers(spark, d):
    return view(spark, d, "b_works").select("doc_id", F.array_join(I.ranked(F.col("ids")), " ").alias("ids"))


@query(
    """select doc_id, id, lower(split_part(id, ':', 1)) || '/' || regexp_replace(trim(substr(id, instr(id, ':') + 1)), '[^A-Za-z0-9._-]', '_', 'g') as home,
case when split_part(id, ':', 1) = 'arxiv' then regexp_replace(substr(id, 7), '^[0-9.]+', '') else split_part(id, ':', 1) || '-' || regexp_replace(trim(substr(id, instr(id, ':') + 1)), '[^A-Za-z0-9._-]', '_', 'g') end as local
from (select doc_id, case when doc_id % 2 = 0 then 'arxiv:2401.' || doc_id || 'v' || (1 + doc_id % 3) else 'doi:10.1/a(' || doc_id || ')' end as id from documents) x"""
)
def homes_and_locals(spark, d):
    ident = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("arxiv:2401."), "doc_id", F.lit("v"), 1 + F.col("doc_id") % 3)).otherwise(F.concat(F.lit("doi:10.1/a("), "doc_id", F.lit(")")))
    rows = base(spark, d, "documents").select("doc_id", ident.alias("id"))
    return rows.select("doc_id", "id", I.home_of(F.col("id")).alias("home"), I.version_local(F.concat(F.lit("arxiv/2401."), F.col("doc_id").cast("string")), F.col("id")).alias("local"))


@query("select l_orderkey, l_linenumber, v, regexp_matches(trim(v), '^10[.][0-9]+/[^ ]+$') as is_doi, regexp_replace(trim(v), '[^A-Za-z0-9._-]', '_', 'g') as safe from (select l_orderkey, l_linenumber, case l_linenumber when 1 then ' 10.' || l_partkey || '/x ' when 2 then '10.1/a b' when 3 then '11.2/c' else '10.' || l_partkey end as v from lineitem) x")
def doi_shapes(spark, d):
    part, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    v = F.when(n == 1, F.concat(F.lit(" 10."), part, F.lit("/x "))).when(n == 2, "10.1/a b").when(n == 3, "11.2/c").otherwise(F.concat(F.lit("10."), part))
    return base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", "v", I.is_doi(F.col("v")).alias("is_doi"), I.sanitise(F.col("v")).alias("safe"))


@query("select doc_id, id, case when lower(split_part(id, ':', 1)) in ('doi', 'arxiv', 'mr', 'zbl', 'work') then lower(split_part(id, ':', 1)) end as scheme, case when lower(split_part(id, ':', 1)) in ('doi', 'arxiv', 'mr', 'zbl', 'work') then substr(id, instr(id, ':') + 1) end as value from (select doc_id, unnest(ids) as id from b_works) x", "b_works")
def parsed_identifiers(spark, d):
    each = view(spark, d, "b_works").select("doc_id", F.explode("ids").alias("id"))
    return each.select("doc_id", "id", I.parse(F.col("id"))["scheme"].alias("scheme"), I.parse(F.col("id"))["value"].alias("value"))


@query(
    """select doc_id, 'work:' || substr(sha256(regexp_replace(lower(source || '+' || 'Smith' || doc_id || '|' || 'On Rings ' || n_chars || '|' || (1950 + doc_id % 70)), '[^a-z0-9|+]+', '', 'g')), 1, 8) as id from documents"""
)
def synthetic_identifiers(spark, d):
    rows = base(spark, d, "documents")
    made = T.synthetic(F.array("source", F.concat(F.lit("Smith"), "doc_id")), F.concat(F.lit("On Rings "), "n_chars"), (1950 + F.col("doc_id") % 70).cast("string"))
    return rows.select("doc_id", made.alias("id"))


@query("select key, split_part(key, '#', 1) as version, split_part(key, '#', 2) as local from b_results", "b_results")
def result_keys(spark, d):
    k = I.parse_key(F.col("key"))
    return view(spark, d, "b_results").select("key", k["version"].alias("version"), k["local"].alias("local"))


@query(
    """select doc_id, '@article{101X' || doc_id % 700 || ',' || chr(10) || '  title = {' || title || '},' || chr(10) || '  author = {' || authors[1] || ' and ' || authors[2] || '},' || chr(10) || '  year = {' || year || '},' || chr(10)
|| '  doi = {10.1/X' || doc_id % 700 || '},' || chr(10) || '  eprint = {2401.' || lpad(cast(doc_id % 450 as varchar), 5, '0') || 'v' || (1 + doc_id % 3) || '},' || chr(10) || '  eprinttype = {arXiv},' || chr(10) || '}' || chr(10) as entry
from b_works where title <> ''""".replace("@article{101X", "@article{doi101X"),
    "b_works",
)
def bibtex_entries(spark, d):
    w = view(spark, d, "b_works").where("title <> ''")
    return w.select("doc_id", I.bibtex_entry(*[F.col(c) for c in ("key", "ids", "title", "authors", "year")]).alias("entry"))


# --- subjects ----------------------------------------------------------------------------------------------------
@query(f"select doc_id, code, {duck_family('code')} as family from (select doc_id, unnest(msc) as code from b_works) x", "b_works")
def subject_families(spark, d):
    return view(spark, d, "b_works").select("doc_id", F.explode("msc").alias("code")).select("doc_id", "code", S.family(F.col("code")).alias("family"))


@query(f"select doc_id, case when len(msc) > 0 then len(list_filter(msc, lambda c: {duck_family('c')} in ('14-', '03D', '10A'))) > 0 when category <> '' then category in ('en', 'fr') end as passes from b_works", "b_works")
def subject_filter(spark, d):
    return view(spark, d, "b_works").select("doc_id", S.passes(F.col("msc"), F.col("category"), ["14-", "03D", "10A"], ["en", "fr"]).alias("passes"))


@query(
    f"""with p as (select 'primary' as kind, {duck_family('msc[1]')} as value from b_works where len(msc) > 0),
a as (select distinct doc_id, 'any' as kind, {duck_family('c')} as value from (select doc_id, unnest(msc) as c from b_works) x),
r as (select 'categories' as kind, category as value from b_works where len(msc) = 0 and category <> ''), z as (select 'neither' as kind, 'works' as value from b_works where len(msc) = 0 and category = '')
select kind, value, cast(count(*) as bigint) as n from (select * from p union all select kind, value from a union all select * from r union all select * from z) x group by all""",
    "b_works",
)
def subject_tally(spark, d):
    return walk.tally(view(spark, d, "b_works"))


# --- locators and links ------------------------------------------------------------------------------------------
NOTES = "select distinct conv_id, turn, case cast(turn % 8 as int) when 0 then 'Thm.~'||turn||'.'||conv_id % 7 when 1 then 'see Theorem iv and Lemma '||conv_id % 5 when 2 then 'pp.~3--4' when 3 then chr(92)||'S '||turn||', Cor. 2(ii)' when 4 then 'Prop. a.'||conv_id % 31 when 5 then 'Theorems 1.1, 2.'||turn||'; and '||conv_id % 9 when 6 then chr(92)||'href'||chr(123)||'http://x'||chr(125)||chr(123)||'Definition '||turn||chr(125)||', p. 7' else 'the proof of lem. x' end as t from {conversations}"


@query(f"with x as ({NOTES.replace('{conversations}', 'conversations')}), {duck_normalize('x', 'z')} select x.conv_id, x.turn, x.t, z.n from x join z on z.t = x.t")
def normalized_locators(spark, d):
    x = spark.sql(NOTES, conversations=base(spark, d, "conversations"))
    return x.select("conv_id", "turn", "t", L.normalize(F.col("t")).alias("n"))


PARTS = r"""s as (select distinct t as note, unnest(string_split_regex(regexp_replace(t, '\b(?:pp?|pages?)\.?\s*\d+\s*(?:--?|–|—)?\s*\d*', ' ', 'g'), '\s*(?:;|,|\band\b|&)\s*')) as t, generate_subscripts(string_split_regex(regexp_replace(t, '\b(?:pp?|pages?)\.?\s*\d+\s*(?:--?|–|—)?\s*\d*', ' ', 'g'), '\s*(?:;|,|\band\b|&)\s*'), 1) as pos from x), """


def duck_parts(of: str) -> str:
    """CTEs after x(t): y(note, pos, part)."""
    return (
        PARTS + duck_normalize("s", "z") + f""", h as (select s.note, s.pos, z.n, split_part(z.n, ' ', 1) in ({KIND_LIST}) as kinded from s join z on z.t = s.t where z.n <> ''),
k as (select *, last_value(case when kinded then split_part(n, ' ', 1) end ignore nulls) over (partition by note order by pos rows between unbounded preceding and current row) as kind from h),
{of} as (select note, pos, case when not kinded and kind is not null and regexp_matches(split_part(n, ' ', 1), '^[a-z]?[0-9]') then kind || ' ' || n else n end as part from k)"""
    )


@query(f"with x as ({NOTES.replace('{conversations}', 'conversations')}), {duck_parts('y')} select x.conv_id, x.turn, coalesce(string_agg(y.part, '|' order by y.pos), '') as parts from x left join y on y.note = x.t group by all")
def locator_parts(spark, d):
    x = spark.sql(NOTES, conversations=base(spark, d, "conversations"))
    return x.select("conv_id", "turn", F.array_join(L.parts(F.col("t")), "|").alias("parts"))


FORMS = """f as (select distinct version, key, local, seq, part from (
 select version, key, local, seq, 'theorem ' || number as part from b_tex union all select version, key, local, seq, 'theorem ' || cast(seq as varchar) from b_tex) q)"""


@query(f"with {FORMS} select key, string_agg(part, '|' order by part) as forms from f group by key", "b_tex")
def result_forms(spark, d):
    forms = L.forms(*[F.col(c) for c in ("local", "taxon", "number", "aliases")])
    return view(spark, d, "b_tex").select("key", F.array_join(F.array_sort(forms), "|").alias("forms"))


CITED = r"""c as (select key as src, version, unnest(regexp_extract_all(statement, '\\cite\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}', 1)) as postnote, unnest(regexp_extract_all(statement, '\\cite\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}', 2)) as citekey, generate_subscripts(regexp_extract_all(statement, '\\cite\s*(?:\[([^\]]*)\])?\s*\{([^}]*)\}', 2), 1) - 1 as pos from b_tex)"""


@query(f"with {CITED} select src, cast(pos as bigint) as pos, coalesce(postnote, '') as postnote, citekey from c", "b_tex")
def citations_in_text(spark, d):
    return link.citations(view(spark, d, "b_tex")).select("src", F.col("pos").cast("bigint").alias("pos"), "postnote", "citekey")


@query(r"select src, cast(pos as bigint) as pos, label from (select key as src, unnest(regexp_extract_all(statement, '\\ref\s*\{([^}]*)\}', 1)) as label, generate_subscripts(regexp_extract_all(statement, '\\ref\s*\{([^}]*)\}', 1), 1) - 1 as pos from b_tex) q", "b_tex")
def references_in_text(spark, d):
    return link.references(view(spark, d, "b_tex")).select("src", F.col("pos").cast("bigint").alias("pos"), "label")


LINKED = f"""with {CITED}, {FORMS}, j as (select c.src, c.pos, coalesce(c.postnote, '') as t, c.citekey, e.cited from c join b_versions v on v.id = c.version join b_citekeys e on e.work = v.work and e.citekey = c.citekey),
x as (select distinct t from j where trim(t) <> ''), {duck_parts('y')},
w0 as (select note, pos as ppos, part from y union all select x.t, 1, zz.n from x left join y on y.note = x.t join (select note as t, '' as n from y where false) zz on zz.t = x.t),
w as (select *, count(*) over (partition by note) as n_parts from w0),
a as (select j.src, j.pos, j.t as postnote, j.cited, w.part, w.n_parts from j join w on w.note = j.t where trim(j.t) <> ''),
g as (select v.work as cited, f.part, count(distinct f.local) as n, max(f.key) as dst, string_agg(distinct f.key, ' ' order by f.key) as matched from f join b_versions v on v.id = f.version group by all),
m as (select a.*, g.n, g.dst, g.matched from a left join g on g.cited = a.cited and g.part = a.part)"""


@query(
    LINKED + r""", own as (select r.src, r.label, b.key as dst from (select key as src, version, unnest(regexp_extract_all(statement, '\\ref\s*\{([^}]*)\}', 1)) as label from b_tex) r join b_tex b on b.version = r.version and list_contains(b.aliases, r.label) where b.key <> r.src)
select src, dst, 'internal' as origin, chr(92) || 'ref{' || label || '}' as evidence from own union all select src, dst, 'locator', part from m where n = 1 union all select src, cited, 'unspecified', chr(92) || 'cite{' || citekey || '}' from j where trim(t) = ''""",
    "b_tex", "b_versions", "b_citekeys",
)
def link_edges(spark, d):
    return _linked(spark, d)["edges"]


def _linked(spark, d):
    return link.link(view(spark, d, "b_tex"), view(spark, d, "b_versions"), view(spark, d, "b_citekeys"))


@query(LINKED + " select src, cited, trim(postnote) as postnote, matched, case when n_parts = 1 then 'several' else 'partial' end as kind from m where n > 1", "b_tex", "b_versions", "b_citekeys")
def link_ambiguities(spark, d):
    return _linked(spark, d)["ambiguous"].withColumn("matched", F.array_join("matched", " "))


@query(
    LINKED + r""", own as (select r.src, r.label, b.key as dst from (select key as src, version, unnest(regexp_extract_all(statement, '\\ref\s*\{([^}]*)\}', 1)) as label from b_tex) r join b_tex b on b.version = r.version and list_contains(b.aliases, r.label) where b.key <> r.src)
select 'internal' as what, cast(count(*) as bigint) as n from own union all select 'locator', count(*) from m where n = 1 union all select 'unspecified', count(*) from j where trim(t) = '' union all select 'unmatched', count(*) from m where n is null union all select 'ambiguous', count(*) from m where n > 1""",
    "b_tex", "b_versions", "b_citekeys",
)
def link_report(spark, d):
    return link.report(_linked(spark, d))


@query(
    f"""with a as (select distinct {duck_norm('id')} as id, key from (select key, unnest(ids) as id from b_works) x), a1 as (select id, min(key) as key from a group by id),
r as (select 'work:' || doc_id % 17 as work, 'k' || doc_id % 5 as citekey, ids[1 + cast(doc_id % 4 as int)] as cited, doc_id as seq from b_works),
t as (select r.work, r.citekey, coalesce(a1.key, r.cited) as cited, row_number() over (partition by r.work, r.citekey order by seq desc) as k from r left join a1 on a1.id = {duck_norm('r.cited')})
select work, citekey, cited from t where k = 1""",
    "b_works",
)
def citekey_targets(spark, d):
    w = view(spark, d, "b_works")
    aliases = w.select(F.explode(F.transform("ids", I.norm)).alias("id"), "key").groupBy("id").agg(F.min("key").alias("key"))
    refs = w.select(F.concat(F.lit("work:"), F.col("doc_id") % 17).alias("work"), F.concat(F.lit("k"), F.col("doc_id") % 5).alias("citekey"), F.element_at("ids", (1 + F.col("doc_id") % 4).cast("int")).alias("cited"), F.col("doc_id").alias("seq"))
    return link.citekeys(refs, aliases)


# --- index reads -------------------------------------------------------------------------------------------------
@query("select depth, key, title, year from b_works where depth = 2", "b_works")
def works_at_depth(spark, d):
    return view(spark, d, "b_works").where("depth = 2").select("depth", "key", "title", "year").orderBy("key")


@query(
    """with q as (select distinct k from (select key as k from b_works union all select ids[1] from b_works union all select 'nothing') x),
al as (select id, max(struct_pack(d := doc_id, k := key)).k as work from (select doc_id, key, unnest(ids) as id from b_works) x group by id)
select q.k as asked, coalesce(w.key, al.work) as work from q left join b_works w on w.key = q.k left join al on al.id = q.k""",
    "b_works",
)
def work_by_key_or_alias(spark, d):
    w = view(spark, d, "b_works")
    asked = w.select(F.explode(F.array("key", F.element_at("ids", 1))).alias("asked")).unionByName(spark.sql("select 'nothing' as asked")).distinct()
    aliases = upsert.alias_table(w, ["doc_id"]).select(F.col("id").alias("asked"), F.col("work").alias("by_alias"))
    own = w.select(F.col("key").alias("asked"), F.col("key").alias("own"))
    return asked.join(own, "asked", "left").join(aliases, "asked", "left").select("asked", F.coalesce("own", "by_alias").alias("work"))


@query(
    "select e.dst as key, e.src, e.origin, r.taxon as src_taxon, r.number as src_number from b_edges e left join b_results r on r.key = e.src",
    "b_edges", "b_results",
)
def dependents(spark, d):
    return graph.dependents(view(spark, d, "b_edges"), view(spark, d, "b_results"))


@query(
    "select r.key, r.taxon, r.number, coalesce((select string_agg(distinct dst, ' ' order by dst) from b_edges e where e.src = r.key), '') as uses, coalesce((select string_agg(distinct src, ' ' order by src) from b_edges e where e.dst = r.key), '') as used_by from b_results r",
    "b_edges", "b_results",
)
def results_with_edges(spark, d):
    out = graph.result_view(view(spark, d, "b_results"), view(spark, d, "b_edges"))
    return out.select("key", "taxon", "number", F.array_join("uses", " ").alias("uses"), F.array_join("used_by", " ").alias("used_by"))


@query(
    "select v.id, v.work, v.numbering, v.extracted_at, string_agg(r.local || ':' || r.taxon || ':' || r.number, ' ' order by r.local) as results from b_versions v join b_results r on r.version = v.id group by all",
    "b_versions", "b_results",
)
def versions_with_results(spark, d):
    r = view(spark, d, "b_results").groupBy("version").agg(F.array_sort(F.collect_list(F.struct("local", "taxon", "number"))).alias("rs"))
    text = F.array_join(F.transform("rs", lambda x: F.concat_ws(":", x["local"], x["taxon"], x["number"])), " ")
    return view(spark, d, "b_versions").join(r, F.col("id") == F.col("version")).select("id", "work", "numbering", "extracted_at", text.alias("results"))


@query(
    "select distinct v.work, coalesce(t.work, split_part(e.dst, '#', 1)) as cited from b_edges e join b_results r on r.key = e.src join b_versions v on v.id = r.version left join b_versions t on t.id = split_part(e.dst, '#', 1) where t.work is null or t.work <> v.work",
    "b_edges", "b_results", "b_versions",
)
def neighbourhood_cites(spark, d):
    return graph.cited_works(view(spark, d, "b_edges"), view(spark, d, "b_results"), view(spark, d, "b_versions"))


@query("select 'works' as name, cast(count(*) as bigint) as n from b_works union all select 'versions', count(*) from b_versions union all select 'results', count(*) from b_results union all select 'edges', count(*) from b_edges union all select 'references', count(*) from b_refs", "b_works", "b_versions", "b_results", "b_edges", "b_refs")
def index_counts(spark, d):
    out = None
    for name, v in (("works", "b_works"), ("versions", "b_versions"), ("results", "b_results"), ("edges", "b_edges"), ("references", "b_refs")):
        one = view(spark, d, v).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select key, title from b_works where (contains(lower(title), 'the') or contains(lower(cast(to_json(authors) as varchar)), 'the')) and (contains(lower(title), 'src1') or contains(lower(cast(to_json(authors) as varchar)), 'src1')) order by key limit 50", "b_works")
def search_substring(spark, d):
    return search.substring(view(spark, d, "b_works"), "The src1").select("key", "title")


@query(
    r"""with t as (select key, list_filter(string_split_regex(strip_accents(lower(title || ' ' || authors[1] || ' ' || authors[2])), '[^\p{L}\p{N}]+'), lambda x: x <> '') as tokens from b_works), n as (select count(*) as n, avg(len(tokens)) as mean from t),
h as (select key, len(tokens) as length, tok, count(*) as tf from (select key, tokens, unnest(tokens) as tok from t) x where tok in ('the', 'author') group by key, tokens, tok), df as (select tok, count(*) as df from h group by tok),
s as (select key, count(*) as hit, sum(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from h join df using (tok) cross join n group by key)
select key, round(score, 6) as score from s where hit = 2 order by s.score desc, key limit 50""",
    "b_works",
)
def search_ranked(spark, d):
    return search.ranked(view(spark, d, "b_works"), "The, author").select("key", F.round("score", 6).alias("score"))


# --- graph -------------------------------------------------------------------------------------------------------
CLOSURE = """with c(root, k, d) as (select distinct src, src, 0 from b_edges union select c.root, e.dst, c.d + 1 from c join b_edges e on e.src = c.k where c.d < 6 and e.origin <> 'unspecified'),
cl as (select root, k as key, cast(min(d) as int) as hops from c where k <> root group by root, k)"""


def _reached(spark, d):
    edges = view(spark, d, "b_edges")
    roots = edges.select(F.col("src").alias("root")).distinct()
    return roots, graph.closure(roots, edges), edges


@query(CLOSURE + " select root, cl.key, hops, r.key is null as missing from cl left join b_results r on r.key = cl.key", "b_edges", "b_results")
def closure(spark, d):
    return graph.with_results(_reached(spark, d)[1], view(spark, d, "b_results"))


@query(CLOSURE + ", x as (select distinct root, root as key, 0 as hops from c union all select * from cl) select distinct x.root, e.src, e.dst from x join b_edges e on e.src = x.key where e.origin = 'unspecified' and x.hops < 6", "b_edges")
def closure_unresolved(spark, d):
    return graph.unresolved(*_reached(spark, d))


@query(CLOSURE + ", x as (select distinct root, root as key from c union all select root, key from cl) select distinct a.root, e.src, e.dst from x a join b_edges e on e.src = a.key join x b on b.root = a.root and b.key = e.dst", "b_edges")
def closure_subgraph(spark, d):
    roots, reached, edges = _reached(spark, d)
    nodes = roots.select("root", F.col("root").alias("key")).unionByName(reached.select("root", "key"))
    return graph.induced(nodes, edges)


def _spread(rounds: int) -> str:
    """Least keys handed from works to identifiers and back, so many times: more than the components here are deep."""
    step = "l{k} as materialized (select a.key, min(m.label) as label from a join (select a.id, min(l.label) as label from a join l{p} l on l.key = a.key group by a.id) m on m.id = a.id group by a.key)"
    return ", ".join(step.format(k=k, p=k - 1) for k in range(1, rounds + 1))


@query(f"with a as materialized (select distinct key, {duck_norm('id')} as id from (select key, unnest(ids) as id from b_works) x), l0 as (select distinct key, key as label from a), {_spread(12)} select key, label as entity from l12", "b_works")
def same_entity(spark, d):
    return graph.entities(view(spark, d, "b_works").select("key", "ids"))


MERGED = """select doc_id % 97 as g, doc_id, ids, case when doc_id % 3 = 0 then '' else title end as title, case when doc_id % 5 = 0 then '' else year end as year, authors, msc, case when doc_id % 2 = 0 then '' else category end as arxiv_category,
 cast(doc_id % 4 as int) as depth, case doc_id % 6 when 0 then 'resolved' when 1 then 'imported' else 'declared' end as provenance, concat('work:', doc_id % 11) as citing from {b_works}"""


def _first_of(c: str, when: str) -> str:
    return f"coalesce(arg_min({c}, doc_id) filter ({when}), '')"


def _in_order(c: str) -> str:
    """Distinct values of a list column by group, in order of rows and places."""
    return f"(select string_agg(v, ';' order by d, p) from (select v, min(d) as d, arg_min(p, d * 1000 + p) as p from (select doc_id as d, unnest({c}) as v, generate_subscripts({c}, 1) as p from x where x.g = o.g) y where v <> '' group by v) z)"


@query(
    f"""with x as ({MERGED.replace('{b_works}', 'b_works')}), n as (select g, doc_id as d, p, id, {duck_norm('id')} as norm from (select g, doc_id, unnest(ids) as id, generate_subscripts(ids, 1) as p from x) y),
f as (select *, row_number() over (partition by g, norm order by d, p) as k from n), i as (select g, string_agg(id, ';' order by {duck_rank('id')}, d, p) as ids from f where k = 1 group by g)
select o.g, i.ids, {_first_of('title', "title <> ''")} as title, {_first_of('year', "year <> ''")} as year, coalesce({_in_order('authors')}, '') as authors, coalesce({_in_order('msc')}, '') as msc, {_first_of('arxiv_category', "arxiv_category <> ''")} as arxiv_category,
 coalesce(min(depth) filter (depth > 0), 0) as depth, string_agg(distinct citing, ';' order by citing) as reached_from, coalesce(arg_min(provenance, doc_id) filter (provenance <> 'declared'), 'declared') as provenance from x o join i on i.g = o.g group by o.g, i.ids""",
    "b_works",
)
def merged_records(spark, d):
    w = spark.sql(MERGED, b_works=view(spark, d, "b_works")).withColumn("reached_from", F.array("citing"))
    out = upsert.merge_records(w, "g", "doc_id")
    joined = [F.array_join(c, ";").alias(c) for c in ("ids", "authors", "msc")]
    return out.select("g", *joined, "title", "year", "arxiv_category", "depth", F.array_join(F.array_sort("reached_from"), ";").alias("reached_from"), "provenance")


# --- upserts -----------------------------------------------------------------------------------------------------
@query("select version, citekey, text, work, cast(seq as bigint) as seq from (select *, row_number() over (partition by version, citekey, text order by seq desc, work desc) as k from b_refs) x where k = 1", "b_refs")
def keep_last_references(spark, d):
    return upsert.keep_last(view(spark, d, "b_refs").select("version", "citekey", "text", "work", "seq"), ["version", "citekey", "text"], ["seq", "work"])


@query("select src, dst, origin, cast(case when conv = 0 then 2 else 1 end as int) as confidence from (select src, dst, origin, length(src) % 2 as conv from (select distinct src, dst, origin from b_edges) e) x", "b_edges")
def upserted_edges(spark, d):
    e = view(spark, d, "b_edges").distinct().withColumn("confidence", F.lit(1)).withColumn("seq", F.lit(0))
    return upsert.upsert(e, e.where("length(src) % 2 = 0").withColumns({"confidence": F.lit(2), "seq": F.lit(1)}), ["src", "dst", "origin"], ["seq"]).drop("seq")


@query("select id, max(struct_pack(d := doc_id, k := key)).k as work from (select doc_id, key, unnest(list_append(ids, key)) as id from b_works) x group by id", "b_works")
def identifier_table(spark, d):
    return upsert.alias_table(view(spark, d, "b_works"), ["doc_id"])


@query("select 'v' || l_orderkey % 500 as id, bool_or(l_returnflag = 'R') as has_source, bool_or(l_linestatus = 'O') as has_pdf, coalesce(arg_min(case when l_linenumber > 2 then l_returnflag end, case when l_linenumber > 2 then (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 10 + l_suppkey % 10 end), '') as method from lineitem group by 1")
def merged_versions(spark, d):
    li = base(spark, d, "lineitem")
    v = li.select(F.concat(F.lit("v"), F.col("l_orderkey") % 500).alias("id"), (F.col("l_returnflag") == "R").alias("has_source"), (F.col("l_linestatus") == "O").alias("has_pdf"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).otherwise("").alias("method"), F.lit("").alias("work"), F.lit("").alias("numbering"), F.lit("").alias("extracted_at"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("seq"))
    return upsert.merge_versions(v, "seq").select("id", "has_source", "has_pdf", "method")


@query(
    """with rows as (select *, 0 as z from b_versions union all select id, 'w0', has_source, has_pdf, 'again', numbering, extracted_at, 1 from b_versions where has_pdf union all select id || 'x', work, has_source, has_pdf, 'new', numbering, extracted_at, 1 from b_versions where has_source)
select id, work, has_source, has_pdf, method, numbering from (select *, row_number() over (partition by id order by z desc) as k from rows) x where k = 1""",
    "b_versions",
)
def upserted_versions(spark, d):
    v = view(spark, d, "b_versions")
    again = v.where("has_pdf").withColumns({"work": F.lit("w0"), "method": F.lit("again")})
    new = v.where("has_source").withColumns({"id": F.concat("id", F.lit("x")), "method": F.lit("new")})
    return upsert.upsert(v, again.unionByName(new), ["id"], ["extracted_at"]).drop("extracted_at")


@query(
    """with rows as (select *, 0 as z from b_results union all select key, version, local, taxon, '9.' || seq, 'again', proof, seq, conv_id, aliases, 1 from b_results where seq % 2 = 0)
select key, taxon, "number", statement, list_aggregate(aliases, 'string_agg', ' ') as aliases from (select *, row_number() over (partition by key order by z desc) as k from rows) x where k = 1""",
    "b_results",
)
def upserted_results(spark, d):
    r = view(spark, d, "b_results")
    again = r.where("seq % 2 = 0").withColumns({"number": F.concat(F.lit("9."), "seq"), "statement": F.lit("again")})
    return upsert.upsert(r, again, ["key"], ["seq"]).select("key", "taxon", "number", "statement", F.array_join("aliases", " ").alias("aliases"))


@query(
    """with pairs as (select 'work:' || (doc_id % 40) as l, 'work:' || (doc_id % 60) as r, doc_id as seq, source as evidence from documents)
select l as "left", r as "right", evidence from (select *, row_number() over (partition by l, r order by seq desc) as k from pairs) x where k = 1""",
)
def upserted_same_as(spark, d):
    pairs = base(spark, d, "documents").select(F.concat(F.lit("work:"), F.col("doc_id") % 40).alias("left"), F.concat(F.lit("work:"), F.col("doc_id") % 60).alias("right"), F.col("source").alias("evidence"), F.col("doc_id").alias("seq"))
    return upsert.upsert(pairs.limit(0), pairs, ["left", "right"], ["seq"]).drop("seq")


@query("select version, string_agg(citekey, ' ' order by seq, citekey) as citekeys, count(*) as n from b_refs group by version", "b_refs")
def references_of_versions(spark, d):
    refs = view(spark, d, "b_refs").groupBy("version").agg(F.array_sort(F.collect_list(F.struct("seq", "citekey"))).alias("refs"))
    return refs.select("version", F.array_join(F.transform("refs", lambda r: r["citekey"]), " ").alias("citekeys"), F.size("refs").cast("bigint").alias("n"))


@query(
    r"""with t as (select conv_id, turn, chr(10) || '\label{t:' || turn || '}  ' || chr(10) || text || '\label {x}' || chr(10) || chr(10) as raw from conversations)
select conv_id, turn, regexp_replace(regexp_replace(raw, '\\label\s*\{[^}]*\}[ \t]*\n?', '', 'g'), '^\n+|\n+$', '', 'g') as statement from t"""
)
def statements_without_labels(spark, d):
    raw = F.concat(F.lit("\n\\label{t:"), F.col("turn"), F.lit("}  \n"), F.col("text"), F.lit("\\label {x}\n\n"))
    return base(spark, d, "conversations").select("conv_id", "turn", T.without_labels(raw).alias("statement"))


@query(
    r"""with t as (select doc_id, case cast(doc_id % 4 as int) when 0 then 'Schr{\"o}dinger and ' when 1 then '{{Gromov}}--{{Witten}} ' when 2 then '$K$-theory~of \emph{' else '\''Etale ' end || split_part(text, chr(10), 1) as raw from documents)
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\[`''^"~=.uvHck]\s*\{?\s*([A-Za-z])\s*\}?', '\1', 'g'), '\\[A-Za-z]+\*?\s*', ' ', 'g'), '[{}$]', '', 'g'), '--+', '-', 'g'), '[~\\\s]+', ' ', 'g'), ' ') as title from t"""
)
def plain_titles(spark, d):
    k = F.col("doc_id") % 4
    lead = F.when(k == 0, 'Schr{\\"o}dinger and ').when(k == 1, "{{Gromov}}--{{Witten}} ").when(k == 2, "$K$-theory~of \\emph{").otherwise("\\'Etale ")
    return base(spark, d, "documents").select("doc_id", T.plain(F.concat(lead, F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title"))


@query(f"select version, identity, cast(seq as bigint) as seq from (select *, row_number() over (partition by version, identity order by seq) as k from (select *, case when work <> '' then 'i:' || {duck_norm('work')} else 't:' || text end as identity from b_refs) y) x where k = 1", "b_refs")
def merged_references(spark, d):
    refs = view(spark, d, "b_refs").withColumnRenamed("work", "cited")
    return upsert.merge_references(refs, "version", "seq").select("version", "identity", "seq")


# --- walk --------------------------------------------------------------------------------------------------------
DEPTH, SUBJECTS, CATEGORIES, CAP = 4, ["14N", "01N", "02N", "03N"], ["SMALL", "PROMO"], 40
WALK = f"""with verdict as (select key, kind, case when len(msc) > 0 then len(list_filter(msc, lambda c: {duck_family('c')} in ('14N', '01N', '02N', '03N'))) > 0 when category <> '' then category in ('SMALL', 'PROMO') else false end as kept,
 case when len(msc) > 0 then 'outside the subjects' when category <> '' then 'arXiv category not in categories' else 'no MSC code and no arXiv category' end as why from b_walk_works),
links as (select distinct src, dst from b_walk_refs where src <> dst), l1 as (select distinct key, true as kept from b_walk_seeds),
l2 as (select distinct v.key, v.kept from l1 join links on src = l1.key join verdict v on v.key = dst where v.key not in (select key from l1)),
l3 as (select distinct v.key, v.kept from l2 join links on src = l2.key join verdict v on v.key = dst where l2.kept and v.key not in (select key from l1 union all select key from l2)),
l4 as (select distinct v.key, v.kept from l3 join links on src = l3.key join verdict v on v.key = dst where l3.kept and v.key not in (select key from l1 union all select key from l2 union all select key from l3)),
met as (select key, 1 as depth, kept from l1 union all select key, 2, kept from l2 union all select key, 3, kept from l3 union all select key, 4, kept from l4),
cb as (select dst as key, count(*) as n from links join met on met.key = src where kept and depth < 4 group by dst),
walked as (select m.key, cast(m.depth as int) as depth, m.kept, case when m.kept then '' else v.why end as why, cast(coalesce(cb.n, 0) as bigint) as cited_by, v.kind from met m left join verdict v on v.key = m.key left join cb on cb.key = m.key),
kept as (select *, row_number() over (order by case when kind <> '' then 0 else 1 end, depth, cited_by desc, key) as place from walked where kept), sel as (select *, kind <> '' and place <= 40 as selected from kept)"""
WALK_VIEWS = ("b_walk_works", "b_walk_refs", "b_walk_seeds")


def _walked(spark, d):
    works = view(spark, d, "b_walk_works")
    return works, walk.walk(works, view(spark, d, "b_walk_refs"), view(spark, d, "b_walk_seeds"), DEPTH, SUBJECTS, CATEGORIES)


@query(WALK + " select key, depth, kept, why, cited_by from walked", *WALK_VIEWS)
def walk_decisions(spark, d):
    return _walked(spark, d)[1]


@query(WALK + " select key, depth, cited_by, kind, selected from sel", *WALK_VIEWS)
def walk_selection(spark, d):
    works, walked = _walked(spark, d)
    return walk.select(walked, works.select("key", "kind"), CAP).select("key", "depth", "cited_by", "kind", "selected")


@query(
    WALK + """ select 'works' as what, cast(count(*) as bigint) as n from sel union all select 'downloadable', count(*) from sel where kind <> '' union all select 'from_arxiv', count(*) from sel where kind = 'source' union all select 'open_copies', count(*) from sel where kind = 'pdf'
union all select 'metadata_only', count(*) from sel where kind = '' union all select 'selected', count(*) from sel where selected union all select 'excluded', count(*) from walked where not kept union all select 'over_cap', greatest(0, count(*) - 40) from sel where kind <> ''""",
    *WALK_VIEWS,
)
def walk_counts(spark, d):
    works, walked = _walked(spark, d)
    walked = walked.persist()
    return walk.plan_counts(walked, walk.select(walked, works.select("key", "kind"), CAP), CAP).select("what", F.col("n").cast("bigint").alias("n"))


@query(WALK + " select why, depth, cast(count(*) as bigint) as n from walked where not kept group by all", *WALK_VIEWS)
def walk_exclusions(spark, d):
    return _walked(spark, d)[1].where("not kept").groupBy("why", "depth").agg(F.count("*").alias("n"))


@query(
    f"""with links as (select distinct src, dst from b_walk_refs where src <> dst), l2 as (select distinct w.* from b_walk_seeds s join links on src = s.key join b_walk_works w on w.key = dst where w.key not in (select key from b_walk_seeds))
select 'primary' as kind, {duck_family('msc[1]')} as value, cast(count(*) as bigint) as n from l2 where len(msc) > 0 group by all union all select 'any', {duck_family('c')}, count(*) from (select unnest(msc) as c from l2) q group by all""",
    *WALK_VIEWS,
)
def survey(spark, d):
    works = view(spark, d, "b_walk_works")
    met = walk.walk(works, view(spark, d, "b_walk_refs"), view(spark, d, "b_walk_seeds"), 2, SUBJECTS, CATEGORIES)
    return walk.tally(met.where("depth = 2").select("key").join(works, "key"))


@query("select cast(count(*) as bigint) as works, cast(count(*) filter (done) as bigint) as downloaded, cast(count(*) filter (error <> '') as bigint) as failed, cast(least(count(*) filter (kind <> '' and not done), greatest(0, 6000 - count(*) filter (done))) as bigint) as to_fetch, cast(count(*) filter (kind <> '' and not done) - least(count(*) filter (kind <> '' and not done), greatest(0, 6000 - count(*) filter (done))) as bigint) as beyond_cap, cast(count(*) filter (kind = '') as bigint) as metadata_only from b_downloads", "b_downloads")
def download_status(spark, d):
    return walk.status(view(spark, d, "b_downloads"), 6000)


@query("select round(count(*) filter (kind = 'source' and o_orderkey % 2 = 0 and not done) * coalesce(avg(bytes) filter (kind = 'source' and bytes > 0 and done), 3e6) + count(*) filter (kind = 'pdf' and o_orderkey % 2 = 0 and not done) * coalesce(avg(bytes) filter (kind = 'pdf' and bytes > 0 and done), 1e6), 2) as bytes, count(*) filter (kind = 'source' and o_orderkey % 2 = 0 and not done) * 3.0::double + count(*) filter (kind = 'pdf' and o_orderkey % 2 = 0 and not done) * 1.0::double as seconds from b_downloads", "b_downloads")
def download_estimate(spark, d):
    x = view(spark, d, "b_downloads")
    return walk.estimate(x.withColumn("selected", F.col("o_orderkey") % 2 == 0), x.where("done")).select(F.round("bytes", 2).alias("bytes"), "seconds")


@query("select o_custkey, o_orderkey, cast(before as bigint) as successes_before from (select *, coalesce(sum(case when error = '' then 1 else 0 end) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from b_downloads) x where before < 3", "b_downloads")
def fetch_attempts(spark, d):
    x = view(spark, d, "b_downloads").withColumn("ok", F.col("error") == "")
    return walk.first_successes(x, ["o_custkey"], ["o_orderkey"], "ok", 3).select("o_custkey", "o_orderkey", "successes_before")


@query("select l_shipmode as reason, n from (select l_returnflag || l_linestatus as l_shipmode, cast(count(*) as bigint) as n from lineitem group by 1) x order by n desc, reason limit 8")
def most_common_reasons(spark, d):
    return walk.most_common(base(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("reason")), "reason", 8)


# --- positions ---------------------------------------------------------------------------------------------------
@query("select s.doc, o.offset as \"offset\", s.file, o.offset - s.start as \"at\" from b_segments s join (select doc_id - doc_id % 20 as doc, cast(doc_id % 20 * 1900 as bigint) as offset from documents) o on o.doc = s.doc and o.offset >= s.start and o.offset < s.start + s.length", "b_segments")
def located_offsets(spark, d):
    offsets = base(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 20).alias("doc"), (F.col("doc_id") % 20 * 1900).alias("offset"))
    return intervals.locate(offsets, view(spark, d, "b_segments"), "doc")


@query("select s.doc, r.a, r.b, s.file, greatest(r.a, s.start) - s.start as low, least(r.b, s.start + s.length) - s.start as high from b_source_segments s join (select source as doc, doc_id * 50 as a, doc_id * 50 + 3000 as b from documents) r on r.doc = s.doc where greatest(r.a, s.start) < least(r.b, s.start + s.length)", "b_source_segments")
def mapped_ranges(spark, d):
    docs = base(spark, d, "documents").select(F.col("source").alias("doc"), "doc_id", "n_chars")
    placed = scans.summed_before(docs, "doc", ["doc_id"], "n_chars", "start")
    segments = placed.select("doc", F.concat(F.lit("f"), "doc_id").alias("file"), "start", F.col("n_chars").alias("length"))
    return intervals.map_ranges(docs.select("doc", (F.col("doc_id") * 50).alias("a"), (F.col("doc_id") * 50 + 3000).alias("b")), segments, "doc")


@query("select h.doc, h.start, h.level, (select min(n.start) from b_headings n where n.doc = h.doc and n.start > h.start and n.level <= h.level) as \"end\", (select max(n.start) from b_headings n where n.doc = h.doc and n.start < h.start and n.level < h.level) as parent from b_headings h", "b_headings")
def heading_intervals(spark, d):
    return intervals.heading_intervals(view(spark, d, "b_headings"), "doc", 4)


@query(
    """with x as (select doc_id - doc_id % 20 as doc, doc_id as p, case cast(n_chars % 5 as int) when 0 then 'section' when 1 then 'theorem' when 2 then 'lemma' else 'remark' end as kind from documents), s as (select *, cast(sum(case when kind = 'section' then 1 else 0 end) over (partition by doc order by p) as bigint) as section from x)
select doc, p as "at", kind, case when kind = 'section' then cast(section as varchar) else section || '.' || row_number() over (partition by doc, section, kind order by p) end as number from s"""
)
def statement_numbers(spark, d):
    n = F.col("n_chars") % 5
    items = base(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 20).alias("doc"), F.col("doc_id").alias("at"), F.when(n == 0, "section").when(n == 1, "theorem").when(n == 2, "lemma").otherwise("remark").alias("kind"))
    return upsert.section_windows(items, "doc", "at").select("doc", "at", "kind", "number")


@query(
    """with x as (select doc_id - doc_id % 20 as doc, doc_id as p, case cast(n_chars % 3 as int) when 0 then 'statement' when 1 then 'proof' else 'other' end as kind, n_chars % 7 <> 0 as blank from documents), r as (select *, sum(case when kind <> 'proof' or not blank then 1 else 0 end) over (partition by doc order by p) as run from x)
select p.doc, p.p as "at", case when l.kind = 'statement' then l.p end as statement from r p join (select doc, run, arg_min(kind, p) as kind, min(p) as p from r group by all) l on l.doc = p.doc and l.run = p.run where p.kind = 'proof'"""
)
def attached_proofs(spark, d):
    n = F.col("n_chars") % 3
    items = base(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 20).alias("doc"), F.col("doc_id").alias("at"), F.when(n == 0, "statement").when(n == 1, "proof").otherwise("other").alias("kind"), (F.col("n_chars") % 7 != 0).alias("blank"))
    return intervals.attach_adjacent(items, "doc")


# --- text --------------------------------------------------------------------------------------------------------
@query("select page_id, cast(pos as bigint) as pos, href from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 as pos from pages) x")
def page_links(spark, d):
    return base(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query(r"select doc_id, cast(len(t) as bigint) as n, coalesce(t[1], '') as first from (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents) x")
def search_terms(spark, d):
    return base(spark, d, "documents").select("doc_id", T.terms(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


@query("select doc_id, 'zb/' || substr(sha256('https://x/' || doc_id), 1, 32) || '.json' as path from documents")
def answer_paths(spark, d):
    return base(spark, d, "documents").select("doc_id", T.answer_path(F.lit("zb"), F.concat(F.lit("https://x/"), "doc_id")).alias("path"))


@query("select doc_id, case when slug = '' then 'work' else slug end as slug from (select doc_id, regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9.-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents) x")
def prefix_slugs(spark, d):
    return base(spark, d, "documents").select("doc_id", T.prefix_slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query("select page_id, list_last(regexp_extract_all(html, '\\b((?:1[5-9]|20)\\d\\d)\\b', 1)) as year from pages")
def last_years(spark, d):
    return base(spark, d, "pages").select("page_id", T.last_year(F.col("html")).alias("year"))


@query("select event_id, cast(json_extract(props, '$.k') as double) as confidence, list_distinct(case when event_type <> '' then [event_type] else [] end)[1] as tag from events")
def json_confidence(spark, d):
    e = base(spark, d, "events")
    v = F.try_parse_json("props")
    return e.select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "double"), F.lit(1.0)).alias("confidence"), F.get(I.unique(F.array("event_type")), F.lit(0)).alias("tag"))


@query("select citekey, case when contains(name, ',') then trim(split_part(name, ',', 1)) else list_last(string_split_regex(trim(name), '\\s+')) end as surname from (select c_custkey as citekey, case when c_custkey % 2 = 0 then c_mktsegment || ', Ann' else 'Ann  ' || c_name end as name from customer) x")
def surnames(spark, d):
    c = base(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(", Ann"))).otherwise(F.concat(F.lit("Ann  "), "c_name"))
    return c.select(F.col("c_custkey").alias("citekey"), T.surname(name).alias("surname"))


@query("select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as label from conversations")
def normal_labels(spark, d):
    return base(spark, d, "conversations").select("conv_id", "turn", T.norm_label(F.col("text")).alias("label"))


# --- event windows -----------------------------------------------------------------------------------------------
@query("select time_bucket(interval 1 hour, ts) as start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    from ..streaming import tumbling

    return tumbling(base(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", cast(count(*) as bigint) as n from s group by user_id, k"""
)
def event_sessions(spark, d):
    from ..streaming import sessions

    return sessions(base(spark, d, "events"))


# --- record linkage ----------------------------------------------------------------------------------------------
def _candidates(spark, d):
    docs = base(spark, d, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select((F.col("doc_id") % 97).alias("query_id"), title.alias("qt"), "doc_id", title.alias("title"), "source")


@query()
def candidate_scores(spark, d):
    """Likelihood of each candidate: a sequence-matching ratio SQL has no equivalent of."""
    from ..functions.similarity import score, strength

    c = _candidates(spark, d)
    s = score(F.col("qt"), F.array("source"), F.lit("1990"), F.lit(""), F.col("title"), F.array(F.concat("source", F.lit(", X"))), (1985 + F.col("doc_id") % 10).cast("string"))
    return c.select("query_id", "doc_id", s.alias("score")).withColumn("strength", strength(F.col("score")))


@query()
def candidate_works(spark, d):
    """Candidates pooled greedily, one a work: depends on the order of the candidates of a query."""
    from ..functions.similarity import merge_candidates

    c = _candidates(spark, d).select("query_id", F.concat(F.lit("doi:10.1/"), F.col("doc_id") % 300).alias("id"), F.array(F.concat(F.lit("zbl:"), F.col("doc_id") % 250)).alias("also"), "source", (1 - (F.col("doc_id") % 10) / 20.0).cast("double").alias("confidence"), "title", F.lit("1990").alias("year"))
    return merge_candidates(c)


@query(r"select doc_id, trim(regexp_replace(lower(strip_accents(nfc_normalize(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[{}$]', '', 'g'), '--+', '-', 'g')))), '[^a-z0-9]+', ' ', 'g')) as folded from documents")
def folded_titles(spark, d):
    return base(spark, d, "documents").select("doc_id", T.fold(F.split_part("text", F.lit("\n"), F.lit(1))).alias("folded"))


@query()
def extracted_statements(spark, d):
    """Statements of LaTeX papers made from conversations, one paper a conversation, through the extractor."""
    from ..sources.latex import extract_corpus

    turn = F.concat(F.lit("\\begin{"), F.when(F.col("turn") % 2 == 0, "theorem").otherwise("lemma"), F.lit("}\\label{t:"), "turn", F.lit("} "), F.regexp_replace("text", r"[\\{}%$]", " "), F.lit("\\end{"), F.when(F.col("turn") % 2 == 0, "theorem").otherwise("lemma"), F.lit("}\n\\begin{proof} By \\ref{t:0}. \\end{proof}\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda s: s["x"]), "\n")
    head = "\\documentclass{article}\\newtheorem{theorem}{Theorem}[section]\\newtheorem{lemma}[theorem]{Lemma}\\begin{document}\\section{A}\n"
    papers = base(spark, d, "conversations").groupBy(F.concat(F.lit("c"), "conv_id").alias("version")).agg(F.concat(F.lit(head), body, F.lit("\\end{document}")).cast("binary").alias("content"))
    return extract_corpus(papers.select("version", F.lit("main.tex").alias("path"), "content")).select("version", "status", "local", "number", F.size("aliases").alias("n_aliases"), F.array_join("uses", " ").alias("uses"))


# --- more of the walk --------------------------------------------------------------------------------------------
@query(
    "select doc_id, case when len(msc) > 0 or category <> '' then len(msc) else case when doc_id % 3 = 0 then 1 else 0 end end as n_msc, case when len(msc) > 0 or category <> '' then category else case when doc_id % 3 = 0 then '' when doc_id % 2 = 0 then 'math.AG' else '' end end as category from b_works",
    "b_works",
)
def classified_works(spark, d):
    w = view(spark, d, "b_works").select("doc_id", "key", "msc", "category")
    one = w.where("doc_id % 3 = 0").select("key", F.array(F.lit("14N35")).alias("msc"), F.lit("").alias("category"))
    two = w.where("doc_id % 2 = 0").select("key", F.array().cast("array<string>").alias("msc"), F.lit("math.AG").alias("category"))
    return walk.classify(w, [one, two]).select("doc_id", F.size("msc").alias("n_msc"), "category")


@query(
    """with c as (select doc_id % 211 as query_id, case when doc_id % 13 = 5 then null else 'doi:10.1/' || doc_id end as id, case when doc_id % 13 = 5 then null else (doc_id % 40) / 40.0::double end as confidence from documents),
b as (select query_id, id, confidence, row_number() over (partition by query_id order by coalesce(confidence, -1) desc, id) as k from c)
select query_id, case when confidence >= 0.9 then id end as id, confidence, case when confidence >= 0.9 then '' when id is null then 'no match' else 'no strong match' end as why from b where k = 1"""
)
def bound_queries(spark, d):
    gone = F.col("doc_id") % 13 == 5
    c = base(spark, d, "documents").select((F.col("doc_id") % 211).alias("query_id"), F.when(~gone, F.concat(F.lit("doi:10.1/"), "doc_id")).alias("id"), F.when(~gone, (F.col("doc_id") % 40) / 40).alias("confidence"))
    return walk.bind(c)


@query(
    f"""with a as (select {duck_norm('id')} as id, min(key) as key from (select key, ids[1] as id from b_works) x group by 1), r as (select key, ids[1:2] as f from b_works),
e as (select r.key, unnest(f) as citing, generate_subscripts(f, 1) as pos from r), n as (select e.key, e.pos, coalesce(a.key, e.citing) as citing from e left join a on a.id = {duck_norm('e.citing')}),
g as (select key, citing, min(pos) as pos from n where citing <> key group by all) select r.key, coalesce((select string_agg(citing, ' ' order by pos) from g where g.key = r.key), '') as reached_from from r""",
    "b_works",
)
def citing_works_renamed(spark, d):
    w = view(spark, d, "b_works")
    aliases = w.select(I.norm(F.element_at("ids", 1)).alias("id"), "key").groupBy("id").agg(F.min("key").alias("key"))
    return walk.remap_citing(w.select("key", F.slice("ids", 1, 2).alias("reached_from")), aliases).withColumn("reached_from", F.array_join("reached_from", " "))


@query(
    """with x as (select *, case when kind = 'source' and error = '' then 1 else 0 end as good from b_downloads), r as (select *, sum(good) over (partition by o_custkey % 50 order by o_orderkey) as run from x),
b as (select *, sum(case when kind = 'source' and error <> '' then 1 else 0 end) over (partition by o_custkey % 50, run order by o_orderkey) as row_ from r),
s as (select *, coalesce(max(case when row_ >= 2 then 1 else 0 end) over (partition by o_custkey % 50 order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as stopped from b) select o_custkey % 50 as service, o_orderkey from s where stopped = 0""",
    "b_downloads",
)
def attempts_before_refusal(spark, d):
    x = view(spark, d, "b_downloads").select((F.col("o_custkey") % 50).alias("service"), "o_orderkey", "kind", (F.col("error") == "").alias("ok"))
    return walk.until_refused(x, ["service"], ["o_orderkey"], 2).select("service", "o_orderkey")


@query(f"select key from b_works where list_contains(list_transform(ids, lambda i: {duck_norm('i')}), 'doi:10.1/x5') or list_contains(list_transform(ids, lambda i: {duck_norm('i')}), 'arxiv:2401.00007')", "b_works")
def works_holding(spark, d):
    return walk.holding_any(view(spark, d, "b_works"), ["DOI:10.1/X5", "doi:10.48550/arXiv.2401.00007v3"]).select("key")


from . import crawling, reading, scanning  # noqa: E402, F401  more queries, registered as they are read
