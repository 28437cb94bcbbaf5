"""Queries over identities that grow and services that are asked in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import identity
from .bridge import view
from .catalog import duck_family, duck_norm, duck_rank, query

SUBJECTS, CATEGORIES, LEVELS = ["14A", "14B", "14C"], ["en", "fr"], 3


def _identity_sql() -> str:
    """The walk computed anew at every level: identifiers asked so far, classes by reachability, verdicts by class."""
    wanted = ", ".join(f"'{s}'" for s in SUBJECTS)
    named = ", ".join(f"'{c}'" for c in CATEGORIES)
    ctes = [
        f"an as (select asked, list_transform(ids, lambda x: {duck_norm('x')}) as ids, msc, category from b_answers)",
        f"rf as (select distinct asked, {duck_norm('dst')} as dst from b_citing)",
        "t as (select distinct asked as id, unnest(ids) as other from an)",
        f"sd as (select asked as id, len(msc) > 0 as coded, len(list_filter(msc, lambda c: {duck_family('c')} in ({wanted}))) > 0 as inside, nullif(category, '') as named from an)",
        "f1 as (select id from b_seed_ids)",
        "k1 as (select id, 1 as depth from b_seed_ids)",
        "o1 as (select id, 1 as depth, '' as why from b_seed_ids where false)",
    ]

    def classes(d: int, start: str) -> list[str]:
        return [
            f"g{d}(id) as ({start} union select t.other from g{d} join t on t.id = g{d}.id)",
            f"e{d} as (select t.id as u, t.other as v from t join g{d} on g{d}.id = t.id union select t.other, t.id from t join g{d} on g{d}.id = t.id)",
            f"r{d}(id, other) as (select id, id from g{d} union select r{d}.id, e{d}.v from r{d} join e{d} on e{d}.u = r{d}.other)",
            f"m{d} as materialized (select id, min(other) as label from r{d} group by id)",
        ]

    ctes += classes(1, "select id from f1")
    for d in range(2, LEVELS + 1):
        p = d - 1
        ctes += [
            f"fr{d} as (select m.label from k{p} k join m{p} m on m.id = k.id group by m.label having min(k.depth) = {p})",
            f"c{d} as materialized (select distinct m.label, rf.dst from fr{d} join m{p} m on m.label = fr{d}.label join rf on rf.asked = m.id left join m{p} own on own.id = rf.dst where own.label is null or own.label <> m.label)",
            f"f{d} as materialized (select distinct dst as id from c{d} where dst not in (select id from m{p}))",
            *classes(d, f"select id from f{d} union select id from m{p}"),
            f"b{d} as (select m.label from (select id from k{p} union all select id from o{p}) x join m{d} m on m.id = x.id)",
            f"n{d} as (select f.id, m.label from f{d} f join m{d} m on m.id = f.id where m.label not in (select label from b{d}))",
            f"v{d} as (select l.label, coalesce(bool_or(sd.coded), false) as coded, coalesce(bool_or(sd.inside), false) as inside, min(sd.named) as named from (select distinct label from n{d}) l join m{d} m on m.label = l.label left join sd on sd.id = m.id group by l.label)",
            f"j{d} as materialized (select n.id, case when coded then inside else coalesce(named in ({named}), false) end as kept, case when coded then 'outside the subjects' when named is not null then 'arXiv category not in categories' else 'no MSC code and no arXiv category' end as why from n{d} n join v{d} v on v.label = n.label)",
            f"k{d} as materialized (select * from k{p} union all select id, {d} from j{d} where kept)",
            f"o{d} as materialized (select * from o{p} union all select id, {d}, why from j{d} where not kept)",
        ]
    z = LEVELS
    ctes += [
        f"w as (select m.label, x.*, row_number() over (partition by m.label order by kept desc, depth, x.id) as k from (select id, depth, true as kept, '' as why from k{z} union all select id, depth, false, why from o{z}) x join m{z} m on m.id = x.id)",
        f"q as (select label, count(*) as names, min(struct_pack(r := {duck_rank('id')}, id := id)).id as key from m{z} group by label)",
        f"ci as ({' union all '.join(f'select label as src, dst from c{d}' for d in range(2, z + 1))})",
        f"cb as (select b.label, count(distinct a.label) as n from ci join m{z} a on a.id = ci.src join m{z} b on b.id = ci.dst where a.label <> b.label group by b.label)",
    ]
    return f"with {', '.join(ctes)} select q.key, w.id as home, w.depth, w.kept, w.why, q.names, coalesce(cb.n, 0) as cited_by from w join q on q.label = w.label left join cb on cb.label = w.label where w.k = 1"


@query(_identity_sql(), "b_answers", "b_citing", "b_seed_ids")
def identity_walk(spark, d):
    return identity.walk(view(spark, d, "b_answers"), view(spark, d, "b_citing"), view(spark, d, "b_seed_ids"), LEVELS, SUBJECTS, CATEGORIES)


def _first(step: int, state: str, table: str, schemes: str, only: str = "true", at: str = "ids") -> str:
    """CTE h<step>: the answer to the first identifier of each work that has one."""
    return f"""h{step} as (select * from (select x.key as k, a.*, row_number() over (partition by x.key order by {duck_rank('x.id')}, x.pos) as nth
from (select key, unnest({at}) as id, generate_subscripts({at}, 1) as pos from {state} where {only}) x join {table} a on a.asked = {duck_norm('x.id')} where split_part({duck_norm('x.id')}, ':', 1) in ({schemes})) y where nth = 1)"""


def _fill(step: int, state: str, *told: str) -> str:
    """CTE s<step>: the works of a state with what h<step> adds."""
    has = lambda c: c in told
    text = lambda c: f"case when s.{c} <> '' then s.{c} else coalesce(h.{c}, '') end" if has(c) else f"s.{c}"
    ids = "list_concat(s.ids, coalesce(h.ids, []))" if has("ids") else "s.ids"
    authors = "case when len(s.authors) > 0 then s.authors else coalesce(h.authors, []) end" if has("authors") else "s.authors"
    msc = "list_concat(s.msc, coalesce(h.msc, []))" if has("msc") else "s.msc"
    return f"s{step} as materialized (select s.key, {ids} as ids, {text('title')} as title, {authors} as authors, {text('year')} as year, {msc} as msc, s.category, s.version, {text('open_pdf')} as open_pdf, s.pending from {state} s left join h{step} h on h.k = s.key)"


SHOWN = f"key, array_to_string(list_sort(list_distinct(list_transform(ids, lambda x: {duck_norm('x')}))), ' ') as ids, title, array_to_string(authors, ';') as authors, year, array_to_string(list_sort(list_distinct(msc)), ' ') as msc, category, version, open_pdf"
STATE = "s0 as (select *, false as pending from b_asking)"
ENRICHED = [_first(1, "s0", "b_index", "'doi', 'arxiv', 'zbl'"), _fill(1, "s0", "ids", "title", "authors", "year", "msc"), _first(2, "s1", "b_graph", "'doi', 'arxiv'"), _fill(2, "s1", "ids", "title", "authors", "year", "open_pdf")]


def _shown(works):
    return works.select("key", F.array_join(F.array_sort(F.array_distinct(F.transform("ids", I.norm))), " ").alias("ids"), "title", F.array_join("authors", ";").alias("authors"), "year", F.array_join(F.array_sort("msc"), " ").alias("msc"), "category", "version", "open_pdf")


@query(f"with {STATE}, {', '.join(ENRICHED)} select {SHOWN} from s2", "b_asking", "b_index", "b_graph")
def enriched_works(spark, d):
    return _shown(identity.enrich(view(spark, d, "b_asking"), view(spark, d, "b_index"), view(spark, d, "b_graph")))


PENDING = "len(msc) = 0 and len(list_filter(ids, lambda x: lower(split_part(x, ':', 1)) = 'arxiv')) = 0"
FOUR = [
    _first(1, "s0", "b_index", "'doi', 'arxiv', 'zbl'"),
    _fill(1, "s0", "ids", "title", "authors", "year", "msc"),
    f"p as materialized (select * exclude (pending), {PENDING} as pending, list_filter(ids, lambda x: lower(split_part(x, ':', 1)) = 'doi')[1:1] as one from s1)",
    _first(2, "p", "b_graph", "'doi'", "pending", "one"),
    _fill(2, "p", "ids", "title", "authors", "year", "open_pdf"),
    "h3 as (select s.key as k, t.ids, t.msc from s2 s join b_titles t on t.asked = regexp_replace(lower(s.title), '[^a-z0-9]+', ' ', 'g') || '|' || lower(case when contains(s.authors[1], ',') then split_part(s.authors[1], ',', 1) else list_last(string_split(s.authors[1], ' ')) end) where s.pending and s.title <> '' and len(s.authors) > 0)",
    _fill(3, "s2", "ids", "msc"),
    _first(4, "s3", "b_preprints", "'arxiv'", "(len(msc) = 0 and category = '') or version = ''"),
    "s4 as (select s.* exclude (category, version), case when len(s.msc) = 0 and s.category = '' then coalesce(h.category, '') else s.category end as category, case when s.version = '' then coalesce(h.version, '') else s.version end as version from s3 s left join h4 h on h.k = s.key)",
]


@query(f"with {STATE}, {', '.join(FOUR)} select {SHOWN} from s4", "b_asking", "b_index", "b_graph", "b_titles", "b_preprints")
def service_chain(spark, d):
    return _shown(identity.classified(*[view(spark, d, v) for v in ("b_asking", "b_index", "b_graph", "b_titles", "b_preprints")]))
