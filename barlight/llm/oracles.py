"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

import string

WORD = r"[^\x20\x09-\x0D]+"

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 20"""

JOIN = f"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') as w from documents),
s as (select rid, doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) end as sh from d),
u as (select rid, len(sh) as n, unnest(sh) as x from s),
e as (select a.rid as a, b.rid as b from u a join u b on a.x = b.x and a.rid < b.rid group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l as (select a, b from e union select b, a from e),
r(a, b) as (select rid, rid from s union select r.a, l.b from r join l on l.a = r.b)
select s.doc_id, len(s.sh)::bigint as n_shingles, min(o.doc_id) as component_id from s join r on r.a = s.rid join s o on o.rid = r.b group by s.rid, s.doc_id, s.sh"""

RULES = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from documents),
p as (select rid, i, count(*) over (partition by rid, g) as n from (select rid, unnest(range(1, len(w) - 1)) as i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from d where len(w) > 2)),
c as (select rid, count(distinct i + k) as n from p, (select unnest([0, 1, 2]) as k) where n > 1 group by rid),
f as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, len(lines) as n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) as letters,
    len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$'))) as shouted
  from d left join c using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * n_symbols <= 25 * n_words and 100 * n_dup_lines <= 40 * n_lines and 10 * word_chars >= 25 * n_words and word_chars <= 15 * n_words
    and 100 * letters >= 70 * n_words and 100 * shouted <= 50 * n_words as kept from b"""

ARCHIVES = """
with p as (select page_id, url, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from p)
select page_id, url, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < top then top end as refers_to from m"""

ORACLE_SQL = {"op2_exact_top_k": TOP_K, "op4_ngram_jaccard_join": JOIN, "op7_quality_rules": RULES, "op8_warc_archives": ARCHIVES}
