"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id is not distinct from min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

DECONTAMINATION = r"""
with words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item_words as (
  select cast(item_id as varchar) as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as t
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item_words where len(w) > 0)
), lengths as (select distinct n from item_windows),
windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)
), met as (select doc_id, i, d.n, item from windows d join item_windows using (t)),
hit as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + n)) from met) group by 1),
items as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as all_items
  from (select distinct doc_id, item from met) group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
  sha256(coalesce(all_items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from words left join hit using (doc_id) left join items using (doc_id)
"""

WARC = """
with p as (
  select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages
), d as (
  select page_id, strlen(h) as payload_bytes, min(page_id) over (partition by h) as first,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((cast('0x' || substr(x, cast((i // 4) * 5 + 1 as bigint), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1, 1)
      for i in range(0, 32)], '')
      as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d
"""


#: crc32 bit by bit: every byte of the text is mixed in, then eight steps of the polynomial.
CRC32 = """xor(list_reduce(
    [4294967295::bigint] || flatten(list_transform(string_split({}, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda state, step: case when step >= 0 then xor(state, step)
      when state & 1 = 1 then xor(state >> 1, 3988292384) else state >> 1 end), 4294967295)"""

MERKLE = rf"""
with recursive d as (
  select doc_id, lang, text, n_chars, {CRC32.format("cast(doc_id as varchar)")} % 7 = 0 as tampered,
    case when doc_id is null then '-' else strlen(cast(doc_id as varchar)) || ':' || doc_id end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end as head,
    case when text is null then '-' else strlen(text) || ':' || text end as tail
  from documents
), leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || tail) as leaf,
    case when tampered then
      sha256(head || coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') || tail) end as changed
  from d
), numbered as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from leaves
), levels as (
  select lang, 0 as level, list(leaf order by i) as nodes from numbered group by lang
  union all
  select lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
    lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))
  from levels where len(nodes) > 1
), subroots as (
  select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as t from levels where len(nodes) = 1
), above as (
  select 0 as level, list(subroot order by t) as nodes from subroots
  union all
  select level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
    lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))
  from above where len(nodes) > 1
), walk as (
  select doc_id, n.lang, t, subroot, leaf, 0 as step, false as up, i as pos, coalesce(changed, leaf) as node, '' as siblings
  from numbered n join subroots s on n.lang is not distinct from s.lang
  union all
  select doc_id, lang, t, subroot, leaf, case when len(nodes) = 1 then 0 else step + 1 end, len(nodes) = 1 or up,
    case when len(nodes) = 1 then t else pos // 2 end,
    case when len(nodes) = 1 then node
      when pos % 2 = 1 then sha256(nodes[pos] || node) else sha256(node || coalesce(nodes[pos + 2], '')) end,
    case when len(nodes) = 1 then siblings
      when pos % 2 = 1 then siblings || nodes[pos] else siblings || coalesce(nodes[pos + 2], '') end
  from (
    select walk.*, case when up then above.nodes else levels.nodes end as nodes
    from walk left join levels on not up and levels.lang is not distinct from walk.lang and levels.level = step
      left join above on up and above.level = step
  ) where not (up and len(nodes) = 1)
), ends as (select * from walk where up qualify row_number() over (partition by doc_id, lang, leaf order by step desc) = 1)
select doc_id, leaf, subroot, nodes[1] as root, sha256(siblings) as proof_sha256, node as folded_root, node = nodes[1] as verified
from ends, above where len(nodes) = 1
"""

COLLOCATIONS = r"""
with lowered as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from lowered),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::hugeint as n from words group by 1),
runs as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase
  from words, (select unnest(range(1, 6)) as k) where len(w) >= k
), f as (select lang, k, phrase, count(*) as a from runs group by all having count(*) >= 100),
cuts as (
  select lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') as head,
    array_to_string(string_split(phrase, ' ')[c + 1 :], ' ') as tail
  from f, (select unnest(range(1, 5)) as c) where c < k
), scored as (
  select cuts.lang, cuts.phrase, cuts.a, c, x.a as l, y.a as r, n,
    (1000 * cuts.a::hugeint * n) // (x.a::hugeint * y.a::hugeint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = head join f y on y.lang = cuts.lang and y.phrase = tail
    join totals on totals.lang = cuts.lang
), lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
kept as (
  select * from lowest where not exists (
    select 1 from f where f.lang = lowest.lang and f.k > 2 and f.phrase <> lowest.phrase
      and contains(' ' || f.phrase || ' ', ' ' || lowest.phrase || ' ') and 100 * f.a >= 100 * lowest.a)
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": EXACT_DEDUP,
        "op2_decontamination": DECONTAMINATION,
        "op9_warc": WARC,
        "op12_merkle_manifest": MERKLE,
        "op13_collocations": COLLOCATIONS,
    }
