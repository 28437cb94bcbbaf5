"""Views of the general tables in the shape of a results library, as SQL text both engines read.

`{name}` stands for a table. Only portable functions are used; the array and JSON spellings that differ are named
placeholders: DIALECT holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Placeholder: (Spark, DuckDB).
DIALECT = {
    "ARRAY": ("array", "list_value"),
    "NONE": ("cast(array() as array<string>)", "cast([] as varchar[])"),
    "STR": ("string", "varchar"),
    "FIRST_LINE": ("split_part(text, chr(10), 1)", "split_part(text, chr(10), 1)"),
}

VIEWS = {
    # one result a turn of a conversation, one version a conversation
    "b_results": """
select concat('c', conv_id, '#', turn) as key, concat('c', conv_id) as version, cast(turn as @STR) as local, role as taxon,
  cast(turn as @STR) as number, text as statement, '' as proof, turn as seq, conv_id, @ARRAY(concat(role, '-', turn), concat('thm-', turn, '.', conv_id % 7)) as aliases
from {conversations}""",
    "b_versions": """
select concat('c', conv_id) as id, concat('w', conv_id % 9) as work, conv_id % 2 = 0 as has_source, conv_id % 3 = 0 as has_pdf,
  'latex' as method, case when conv_id % 4 = 0 then 'compiled' else 'emulated' end as numbering, cast(conv_id as @STR) as extracted_at
from (select distinct conv_id from {conversations}) as c""",
    "b_edges": """
select concat('c', conv_id, '#', turn) as src, concat('c', conv_id, '#', turn - 1) as dst, 'internal' as origin from {conversations} where turn > 0
union all select concat('c', conv_id, '#0'), concat('c', (conv_id * 7 + 3) % n, '#1'), 'locator'
  from {conversations} cross join (select max(conv_id) + 1 as n from {conversations}) as m where turn = 0 and conv_id % 3 = 0
union all select concat('c', conv_id, '#', turn), concat('w', conv_id % 5), 'unspecified' from {conversations} where turn = 1""",
    "b_works": """
select concat('work:', doc_id) as key, doc_id, @FIRST_LINE as title, @ARRAY(source, concat('Author ', doc_id % 7)) as authors, cast(1950 + doc_id % 70 as @STR) as year,
  case when doc_id % 4 = 0 then @NONE when doc_id % 4 = 1 then @ARRAY(concat(lpad(cast(doc_id % 100 as @STR), 2, '0'), chr(cast(65 + doc_id % 5 as int)), '10'))
    else @ARRAY(concat(lpad(cast(doc_id % 100 as @STR), 2, '0'), chr(cast(65 + doc_id % 5 as int)), '10'), '14-02', concat(lpad(cast(doc_id % 13 as @STR), 2, '0'))) end as msc,
  case when doc_id % 8 = 0 then '' else lang end as category, cast(1 + doc_id % 3 as int) as depth,
  @ARRAY(concat('DOI:10.1/X', doc_id % 700), concat('arXiv:2401.', lpad(cast(doc_id % 450 as @STR), 5, '0'), 'v', 1 + doc_id % 3), concat('work:', doc_id), concat('doi:10.48550/arXiv.2401.', lpad(cast(doc_id % 450 as @STR), 5, '0')), concat('https:', doc_id % 11)) as ids
from {documents}""",
    "b_refs": """
select concat('o', l_orderkey) as version, case when l_linenumber % 10 = 3 then '' else concat('p', l_partkey) end as work, concat('k', l_suppkey) as citekey,
  concat(l_returnflag, l_linestatus) as text, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 10 + l_suppkey % 10 as seq, l_quantity as quantity
from {lineitem}""",
    "b_tex": """
select concat('c', conv_id, '#', turn) as key, concat('c', conv_id) as version, concat('theorem-', turn) as local, 'theorem' as taxon, concat(case when conv_id % 4 = 0 then turn + 1 else turn end, '.', conv_id % 3) as number,
  turn as seq, conv_id, @ARRAY(concat('thm:', turn)) as aliases, '' as proof,
  concat('By ', chr(92), 'cite[', case cast(conv_id % 6 as int) when 0 then concat('Theorem ', turn, '.', conv_id % 3, ' and Lemma 2') when 1 then concat('Thm.~', turn, '.1') when 2 then concat('see Theorems ', turn, '.0, ', turn + 1, '.2')
      when 3 then 'pp.~3--4' when 4 then concat('Theorem ', turn, '.2(ii)') else '' end, ']', chr(123), 'k', conv_id % 11, chr(125), ' and ', chr(92), 'ref', chr(123), 'thm:', turn - 1, chr(125), ', ', chr(92), 'cite', chr(123), 'k', turn % 3, chr(125), '.') as statement
from {conversations}""",
    "b_citekeys": """
select concat('w', w.i) as work, concat('k', k.i) as citekey, concat('w', (w.i * 5 + k.i) % 9) as cited
from (select distinct conv_id % 9 as i from {conversations}) as w cross join (select distinct conv_id % 11 as i from {conversations} where conv_id % 11 < 8) as k""",
    "b_walk_works": """
select concat('c', c_custkey) as key, @ARRAY('14N10') as msc, '' as category, '' as kind from {customer}
union all select concat('o', o_orderkey), @ARRAY(concat('14', chr(cast(78 + o_orderkey % 2 as int)), '05')), '', case when o_orderstatus = 'F' then 'pdf' else '' end from {orders}
union all select concat('p', p_partkey), case when p_partkey % 4 = 0 then @NONE else @ARRAY(concat(lpad(cast(p_partkey % 40 as @STR), 2, '0'), 'N20')) end, case when p_partkey % 8 = 0 then '' else p_type end, 'source' from {part}
union all select concat('s', s_suppkey), case when s_suppkey % 3 = 0 then @NONE else @ARRAY('14N99') end, case when s_suppkey % 6 = 0 then 'SMALL' else '' end, case when s_suppkey % 2 = 0 then 'source' else '' end from {supplier}""",
    "b_walk_refs": """
select concat('c', o_custkey) as src, concat('o', o_orderkey) as dst from {orders}
union all select concat('o', l_orderkey), concat('p', l_partkey) from {lineitem}
union all select concat('p', l_partkey), concat('s', l_suppkey) from {lineitem} where l_linenumber = 1""",
    "b_walk_seeds": "select concat('c', c_custkey) as key from {customer} where c_custkey % 50 = 0",
    "b_downloads": """
select o_orderkey, case o_orderstatus when 'F' then 'source' when 'O' then 'pdf' else '' end as kind, o_orderkey % 3 = 0 and o_orderstatus in ('F', 'O') as done,
  case when o_orderkey % 7 = 1 then 'refused' else '' end as error, case when o_orderkey % 5 = 0 then 0 else cast(floor(o_totalprice) as bigint) end as bytes, o_custkey
from {orders}""",
    "b_segments": """
select doc_id - doc_id % 20 as doc, concat('f', doc_id) as file, cast(coalesce(sum(n_chars) over (partition by doc_id - doc_id % 20 order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start, n_chars as length, doc_id
from {documents}""",
    "b_source_segments": """
select source as doc, concat('f', doc_id) as file, cast(coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start, n_chars as length, doc_id
from {documents}""",
    # what sources say when asked for an identifier; some names lead back to works of the first level
    "b_answers": """
select concat('doi:d', doc_id) as asked, @ARRAY(concat('doi:D', doc_id), concat('arxiv:a', doc_id)) as ids, case when doc_id % 7 = 2 then @NONE else @ARRAY(concat('14', chr(cast(65 + doc_id % 4 as int)), '10'), '14-02') end as msc, '' as category from {documents} where doc_id % 3 <> 0
union all select concat('arxiv:a', doc_id), @ARRAY(concat('arXiv:a', doc_id, 'v2'), concat('zbl:z', doc_id)), @NONE, lang from {documents} where doc_id % 4 = 0
union all select concat('zbl:z', doc_id), @ARRAY(concat('zbl:z', doc_id), concat('doi:d', 40 * (doc_id % 25) + 1)), case when doc_id % 2 = 0 then @NONE else @ARRAY('14B05') end, '' from {documents} where doc_id % 5 = 0""",
    "b_citing": """
select concat('doi:d', doc_id) as asked, concat('doi:d', (doc_id * 3 + 1) % n) as dst from {documents} cross join (select max(doc_id) + 1 as n from {documents}) as m
union all select concat('doi:d', doc_id), concat('arXiv:a', (doc_id * 5 + 2) % n, 'v1') from {documents} cross join (select max(doc_id) + 1 as n from {documents}) as m
union all select concat('doi:d', doc_id), concat('zbl:z', (doc_id * 7 + 3) % n) from {documents} cross join (select max(doc_id) + 1 as n from {documents}) as m
union all select concat('arxiv:a', doc_id), concat('doi:D', (doc_id * 11 + 5) % n) from {documents} cross join (select max(doc_id) + 1 as n from {documents}) as m
union all select concat('zbl:z', doc_id), concat('arxiv:a', (doc_id * 13 + 7) % n) from {documents} cross join (select max(doc_id) + 1 as n from {documents}) as m""",
    "b_seed_ids": "select concat('doi:d', doc_id) as id from {documents} where doc_id % 40 = 1",
    "b_asking": """
select concat('work:', doc_id) as key, case doc_id % 4 when 0 then @ARRAY(concat('arXiv:', doc_id, 'v1')) when 1 then @ARRAY(concat('DOI:10.1/D', doc_id)) when 2 then @ARRAY(concat('doi:10.1/x', doc_id), concat('zbl:z', doc_id)) else @ARRAY(concat('doi:10.1/d', doc_id), concat('mr:', doc_id)) end as ids,
  case when doc_id % 3 = 0 then '' else @FIRST_LINE end as title, case when doc_id % 3 = 0 then @NONE else @ARRAY(concat('Author', doc_id % 7, ', A.')) end as authors, '' as year, @NONE as msc, '' as category,
  case when doc_id % 10 = 0 then 'v9' else '' end as version, '' as open_pdf
from {documents}""",
    "b_index": """
select concat('doi:10.1/d', doc_id) as asked, @ARRAY(concat('doi:10.1/d', doc_id), concat('arxiv:', doc_id)) as ids, concat('Index Title ', doc_id) as title, @ARRAY(concat('Index', doc_id % 5, ', I.')) as authors, cast(1950 + doc_id % 70 as @STR) as year,
  case when doc_id % 7 < 4 then @ARRAY(concat('1', doc_id % 10, 'A05')) else @NONE end as msc from {documents} where doc_id % 5 <> 0
union all select concat('zbl:z', doc_id), @ARRAY(concat('zbl:z', doc_id)), '', @NONE, '', @ARRAY('14N35') from {documents} where doc_id % 6 = 2
union all select concat('arxiv:', doc_id), @ARRAY(concat('arxiv:', doc_id), concat('doi:10.1/d', doc_id)), concat('By Number ', doc_id), @ARRAY('Nul, M.'), '1999', @NONE from {documents} where doc_id % 8 = 0""",
    "b_graph": """
select concat('doi:10.1/d', doc_id) as asked, @ARRAY(concat('doi:10.1/d', doc_id)) as ids, concat('Graph Title ', doc_id) as title, @ARRAY(concat('Given Graph', doc_id % 5)) as authors, '2001' as year, concat('https://open.example/', doc_id) as open_pdf from {documents} where doc_id % 3 <> 1
union all select concat('doi:10.1/x', doc_id), case when doc_id % 9 = 0 then @ARRAY(concat('arxiv:', doc_id)) else @ARRAY(concat('doi:10.1/x', doc_id)) end, concat('Graph Title ', doc_id), @ARRAY(concat('Given Graph', doc_id % 5)), '2002', '' from {documents} where doc_id % 4 = 2""",
    "b_titles": "select concat('graph title ', doc_id, '|graph', doc_id % 5) as asked, @ARRAY(concat('zbl:t', doc_id)) as ids, @ARRAY('05C10') as msc from {documents} where doc_id % 12 < 7",
    "b_preprints": "select concat('arxiv:', doc_id) as asked, lang as category, concat('v', 1 + doc_id % 4) as version from {documents} where doc_id % 11 <> 0",
    # where citations of a result lead, in order: two for a bare key, one for a locator
    "b_cite_edges": """
select concat('c', conv_id, '#', turn) as src, 1 as seq, concat('w', conv_id % 5) as dst, 'unspecified' as origin, concat(chr(92), 'cite', chr(123), 'k', conv_id % 11, chr(125)) as evidence from {conversations}
union all select concat('c', conv_id, '#', turn), 2, concat('c', conv_id, '#', turn + 1), 'unspecified', concat(chr(92), 'cite', chr(123), 'k', turn % 3, chr(125)) from {conversations} where turn % 2 = 0
union all select concat('c', conv_id, '#', turn), 3, concat('c', conv_id % 4, '#', turn), 'locator', concat('Theorem ', turn, '.2(II)') from {conversations}""",
    "b_headings": "select source as doc, doc_id as start, cast(n_chars % 4 as int) as level from {documents}",
}


def spark_sql(name: str) -> str:
    return _text(name, 0)


def duck_cte(*names: str) -> str:
    """A WITH clause (without `with`) that defines views for the other engine."""
    return ", ".join(f"{n} as ({_text(n, 1).replace('{', '').replace('}', '')})" for n in names)


def _text(name: str, which: int) -> str:
    text = VIEWS[name]
    for k, v in DIALECT.items():
        text = text.replace(f"@{k}", v[which])
    return text.strip()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    text = spark_sql(name)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)
