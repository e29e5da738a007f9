"""The queries of this folder and the SQL they must agree with."""

from __future__ import annotations

from censusloom.llm import (
    bpe, languages, middles, minhash, packing, pages, periods, personal, quality, repeats, secrets, tokenfiles, vectors,
)

QUERIES = {
    f.__name__: f
    for f in (
        vectors.op1_collision_counting, minhash.op2_minhash, packing.op3_pack, quality.op4_quality_rules, secrets.op5_secret_scan,
        personal.op6_personal_data, pages.op7_page_text, repeats.op8_repeated_passages, tokenfiles.op9_token_files, bpe.op10_byte_bpe,
        periods.op11_periodic_runs, middles.op12_fill_in_middle, languages.op13_language_id,
    )
}

_REACHABLE = """
  reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
"""
#: Words as the contract cuts them; list positions count from 1.
_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = {
    "op1_collision_counting": f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null
), link as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id
  where list_cosine_similarity(x.e, y.e) >= 0.93
), {_REACHABLE}
select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links,
  least(e.vec_id, coalesce(m.low, e.vec_id)) as component_id, e.vec_id <= coalesce(m.low, e.vec_id) as kept
from embeddings e left join (select a, min(b) as low from reach group by a) m on m.a = e.vec_id
""",
    "op2_minhash": f"""
with recursive w as (
  select doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w
), one as (select doc_id, len(s) as n, unnest(s) as g from s),
pair as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c
  from one x join one y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id
), half as (select a, b from pair where 100 * c >= 85 * (na + nb - c)),
link as (select a, b from half union all select b, a from half), {_REACHABLE}
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) as component_id,
  s.doc_id <= coalesce(m.low, s.doc_id) as kept
from s left join (select a, min(b) as low from reach group by a) m on m.a = s.doc_id
""",
    "op8_repeated_passages": f"""
with w as (select doc_id, {_WORDS.format(text="text")} as w from documents),
win as (
  select doc_id, i, array_to_string(w[i : i + 19], ' ') as p
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)
), late as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by p order by doc_id, i) as r from win) where r > 1
), gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from late),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
kept as (
  select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n
  from word where not exists (select 1 from gone g where g.doc_id = word.doc_id and g.i = word.i) group by doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(len(w.w) - coalesce(k.n, 0) as bigint) as n_removed,
  sha256(coalesce(k.t, '')) as kept_sha256
from w left join kept k on k.doc_id = w.doc_id
""",
    "op12_fill_in_middle": r"""
with t as (
  select doc_id, coalesce(text, '') as x, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w from documents
), h as (
  select *, len(w) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
    cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain'
         when h4 % 100 < 80 then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(w[1:a], '') as pre, array_to_string(w[a + 1:b], '') as mid, array_to_string(w[b + 1:n], '') as suf from c
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(x) as restored_sha256
from p
""",
}
