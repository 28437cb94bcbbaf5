"""Queries of scans over ordered rows and of the stored search index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import postings, scans
from ..session import shared_dir
from .bridge import view
from .catalog import base, query

#: Milliseconds between requests to a host (fixed values).
SPACING, LEAST = {"export.example": 3000, "api.example": 100}, 1000
GAP = "case host when 'export.example' then 3000 when 'api.example' then 100 else 1000 end"
REQUESTS = "select o_orderkey as id, case when o_orderkey % 3 = 0 then 'export.example' when o_custkey % 2 = 0 then 'api.example' else 'other.example' end as host, o_orderkey * 7919 % 60000000 as arrival from {orders}"


@query(f"with x as ({REQUESTS.replace('{orders}', 'orders')}), y as (select *, {GAP} as gap, row_number() over (partition by host order by arrival, id) as i from x) select id, host, arrival, cast(gap * i + max(arrival - gap * i) over (partition by host order by i) as bigint) as start from y")
def paced_requests(spark, d):
    asked = spark.sql(REQUESTS, orders=base(spark, d, "orders"))
    return scans.paced(asked, "host", "arrival", ["id"], SPACING, LEAST)


#: Lines of documents as headings, appendices and items, by their length.
NUMBERED = """with recursive e as materialized (select doc_id as doc, pos as "at", length(line) as n, row_number() over (partition by doc_id order by pos) as i from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) x),
k as materialized (select *, case when n % 12 < 3 then n % 12 + 1 else 0 end as lv, n % 60 = 3 as ap, case when n % 12 in (4, 5, 9) then 't' when n % 12 in (6, 7) then 'l' when n % 12 = 8 then 'r' else '' end as it,
  case n % 36 when 9 then (n % 4 + 1) || '.' || n % 3 || '.' || n % 9 when 21 then 'C.1.' || n % 9 when 33 then cast(n % 9 as varchar) else '' end as rec from e),
st(doc, i, s1, s2, s3, t, l, r, app, number) as (select distinct doc, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), false, cast(null as varchar) from k
 union all select doc, i, s1, s2, s3, t, l, r, app, case lv when 1 then a1 when 2 then a1 || '.' || s2 when 3 then a1 || '.' || s2 || '.' || s3 else case when rec <> '' then rec when it = 't' then a1 || '.' || s2 || '.' || t when it = 'l' then a1 || '.' || l when it = 'r' then cast(r as varchar) end end
 from (select *, case when app then chr(cast(64 + greatest(s1, 1) as int)) else cast(s1 as varchar) end as a1 from (select k.doc, k.i, k.lv, k.it, k.rec,
  case when k.lv = 1 then st.s1 + 1 when k.ap then 0 when k.rec like 'C.%' then 3 when k.rec like '%.%' then cast(split_part(k.rec, '.', 1) as bigint) else st.s1 end as s1,
  case when k.lv = 1 or k.ap then 0 when k.lv = 2 then st.s2 + 1 when k.rec like '%.%' then cast(split_part(k.rec, '.', 2) as bigint) else st.s2 end as s2,
  case when k.lv in (1, 2) or k.ap then 0 when k.lv = 3 then st.s3 + 1 else st.s3 end as s3,
  case when k.lv in (1, 2) then 0 when k.rec <> '' then cast(list_last(string_split(k.rec, '.')) as bigint) when k.it = 't' then st.t + 1 else st.t end as t,
  case when k.lv = 1 then 0 when k.it = 'l' then st.l + 1 else st.l end as l, case when k.it = 'r' then st.r + 1 else st.r end as r, st.app or k.ap or k.rec like 'C.%' as app
  from st join k on k.doc = st.doc and k.i = st.i + 1) q) q2)
select k.doc, cast(k."at" as bigint) as "at", st.number from st join k on k.doc = st.doc and k.i = st.i where st.number is not null"""


def _line_events(spark, d):
    lines = base(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    n = F.length("line")
    kind = F.when(n % 12 < 3, "heading").when(n % 60 == 3, "appendix").when((n % 12).isin(4, 5, 6, 7, 8, 9), "item").otherwise("")
    counter = F.when((n % 12).isin(4, 5, 9), "theorem").when((n % 12).isin(6, 7), "lemma").when(n % 12 == 8, "remark")
    three = F.concat_ws(".", n % 4 + 1, n % 3, n % 9)
    recorded = F.when(n % 36 == 9, three).when(n % 36 == 21, F.concat(F.lit("C.1."), n % 9)).when(n % 36 == 33, (n % 9).cast("string")).otherwise("")
    within = F.when(counter == "theorem", 2).when(counter == "lemma", 1).otherwise(0)
    return lines.select("doc", F.col("at").cast("bigint").alias("at"), kind.alias("kind"), F.when(n % 12 < 3, n % 12 + 1).alias("level"), counter.alias("counter"), within.alias("within"), recorded.alias("recorded"))


@query(NUMBERED)
def nested_numbers(spark, d):
    # other lines have no number and change none
    return scans.numbered(_line_events(spark, d).where("kind <> ''")).where("number is not null").select("doc", "at", "number")


MARKS = "select conv_id as doc, turn as at_, case when length(text) % 5 < 3 then 'begin' else 'end' end as kind, concat(role, length(text) % 2) as name from {conversations}"
#: An explicit stack, a row a step.
STACK = f"""with recursive m as materialized (select doc, at_, kind, name, row_number() over (partition by doc order by at_) as i from ({MARKS.replace('{conversations}', 'conversations')}) x),
s(doc, i, stack, b, c) as (select distinct doc, cast(0 as bigint), cast([] as struct(at_ bigint, name varchar)[]), cast(null as bigint), cast(null as bigint) from m
 union all select m.doc, m.i, case when m.kind = 'begin' then list_append(s.stack, struct_pack(at_ := m.at_, name := m.name)) when len(s.stack) = 0 then s.stack else s.stack[:-2] end,
  case when m.kind = 'end' and len(s.stack) > 0 then s.stack[-1].at_ end, case when m.kind = 'end' and len(s.stack) > 0 then m.at_ end from s join m on m.doc = s.doc and m.i = s.i + 1),
o as (select m.*, p.stack, len(p.stack) as open from m join s p on p.doc = m.doc and p.i = m.i - 1)
select o.doc, o.at_ as "at", o.name, e.at_ as close, cast(o.open + 1 as int) as depth, o.stack[-1].at_ as parent, case when e.at_ is null then 'unclosed' when e.name <> o.name then 'mismatched' else '' end as problem
 from o left join s on s.doc = o.doc and s.b = o.at_ left join m e on e.doc = s.doc and e.at_ = s.c where o.kind = 'begin'
union all select doc, at_, name, null, 0, null, 'stray end' from o where kind = 'end' and open = 0"""


@query(STACK)
def matched_brackets(spark, d):
    marks = spark.sql(MARKS, conversations=base(spark, d, "conversations")).withColumnRenamed("at_", "at")
    return scans.matched(marks)


ASKED = "É, author de"


@query(
    r"""with t as (select key, list_filter(string_split_regex(strip_accents(lower(title || ' ' || authors[1] || ' ' || authors[2])), '[^\p{L}\p{N}]+'), lambda x: x <> '') as tokens from b_works), n as (select count(*) as n, avg(len(tokens)) as mean from t),
h as (select key, len(tokens) as length, tok, count(*) as tf from (select key, tokens, unnest(tokens) as tok from t) x where tok in ('e', 'author', 'de') group by key, tokens, tok), df as (select tok, count(*) as df from h group by tok),
s as (select key, count(*) as hit, sum(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score from h join df using (tok) cross join n group by key)
select key, round(score, 6) as score from s where hit = 3 order by s.score desc, key limit 50""",
    "b_works",
)
def search_stored(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    postings.build(view(spark, d, "b_works"), path)
    return postings.search(spark, path, ASKED).select("key", F.round("score", 6).alias("score"))


ATTEMPTS = "select concat('s', o_custkey % 50) as service, o_orderkey as seq, o_orderdate as at_, o_orderkey % 7 not in (1, 2, 4) as ok from {orders}"
#: One attempt a step, with the standing of its service.
ATTEMPTED = f"""with recursive x as materialized (select *, row_number() over (partition by service order by at_, seq) as i from ({ATTEMPTS.replace('{orders}', 'orders')}) q),
s(service, i, seq, made, in_row, used) as (select distinct service, cast(0 as bigint), cast(null as bigint), false, 0, 0 from x
 union all select x.service, x.i, x.seq, s.in_row < 3 and s.used < 12, case when s.in_row < 3 and s.used < 12 then case when x.ok then 0 else s.in_row + 1 end else s.in_row end, case when s.in_row < 3 and s.used < 12 and x.ok then s.used + 1 else s.used end from s join x on x.service = s.service and x.i = s.i + 1)
select service, seq, made, cast(in_row as int) as in_row, cast(12 - used as int) as "left" from s where seq is not null"""


@query(ATTEMPTED)
def attempt_decisions(spark, d):
    from ..streaming import attempts

    rows = spark.sql(ATTEMPTS, orders=base(spark, d, "orders")).withColumnRenamed("at_", "at")
    return attempts.batch(rows, 3, 12).select("service", "seq", "made", "in_row", "left")
