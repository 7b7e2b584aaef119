"""SQL twins of the registered queries of this subpackage."""

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
sizes as (select distinct k from win),
hit as (
  select s.doc_id, s.i, s.k, win.item_id
  from (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') g
        from (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)) s
  join win using (k, g)),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from hit)) group by doc_id),
items as (select doc_id, count(*) n, string_agg(s, ',' order by s) l from (select distinct doc_id, cast(item_id as varchar) s from hit) group by doc_id)
select d.doc_id, len(w) n_words, coalesce(c.n, 0) n_hit, coalesce(i.n, 0) n_items, sha256(coalesce(i.l, '')) items_sha256, coalesce(c.n, 0) > 0 contaminated
from d left join covered c using (doc_id) left join items i using (doc_id)
"""

SQL["op8_repeats"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) g from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) p from again),
kept as (
  select w.doc_id, string_agg(x, ' ' order by w.p) s
  from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d where len(w) > 0) w anti join gone on w.doc_id = gone.doc_id and w.p = gone.p
  group by w.doc_id)
select d.doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(s, '')) kept_sha256
from d left join kept using (doc_id) left join (select doc_id, count(*) n from gone group by doc_id) using (doc_id)
"""

SQL["op3_jaccard"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
grams as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
size as (select doc_id, count(*) n from grams group by doc_id),
links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) k from grams x join grams y using (g) where x.doc_id < y.doc_id group by 1, 2)
  join size p on p.doc_id = a join size q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
reach as (
  select doc_id c, doc_id r from size
  union
  select r.c, case when l.a = r.r then l.b else l.a end from reach r join links l on l.a = r.r or l.b = r.r)
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(m, d.doc_id) component_id
from d left join size using (doc_id) left join (select c doc_id, min(r) m from reach group by c) using (doc_id)
"""

SQL["op4_fixity"] = r"""
with r as (
  select page_id, coalesce(html, '') b, page_id % 50 = 7 changed, page_id % 50 = 31 lost,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) h,
    chr(13) || chr(10) || chr(13) || chr(10) e
  from pages),
leaf as (
  select *, (pos - 1) // 4096 f, (pos - 1) % 4096 n, coalesce(sum(l) over (partition by (pos - 1) // 4096 order by pos rows between unbounded preceding and 1 preceding), 0) o
  from (select row_number() over (order by page_id, d) pos, * from (
    select page_id, strlen(h || b || e) l, sha256(h || b || e) d, case when lost then null when changed then sha256(h || '~' || substring(b, 2) || e) else sha256(h || b || e) end x from r))),
a1 as (select f, n // 16 n, min(o) o, max(o + l) t, sha256(min(o) || ':' || max(o + l) || ':' || string_agg(d, '' order by n)) d from leaf group by 1, leaf.n // 16),
a2 as (select f, n // 16 n, min(o) o, max(t) t, sha256(min(o) || ':' || max(t) || ':' || string_agg(d, '' order by n)) d from a1 group by 1, a1.n // 16),
a3 as (select f, sha256(min(o) || ':' || max(t) || ':' || string_agg(d, '' order by n)) d from a2 group by 1),
b1 as (select f, n // 16 n, min(o) o, max(o + l) t, sha256(min(o) || ':' || max(o + l) || ':' || string_agg(x, '' order by n)) d from leaf where x is not null group by 1, leaf.n // 16),
b2 as (select f, n // 16 n, min(o) o, max(t) t, sha256(min(o) || ':' || max(t) || ':' || string_agg(d, '' order by n)) d from b1 group by 1, b1.n // 16),
b3 as (select f, sha256(min(o) || ':' || max(t) || ':' || string_agg(d, '' order by n)) d from b2 group by 1),
files as (select f, count(*) c, sum(l) s from leaf group by 1)
select f.f::bigint file, c n_records, s::bigint n_bytes, a3.d root, b3.d replica_root, n::int no, o::bigint "offset", l::bigint length, case when x is null and n is not null then 'missing' when n is not null then 'changed' end kind
from files f left join a3 on a3.f = f.f left join b3 on b3.f = f.f left join (select * from leaf where x is distinct from d) m on m.f = f.f
"""

SQL["op13_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) n from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
keys as (
  select doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
shared as (select k, max(doc_id) last from keys where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*) n_lines, count(*) filter (where last <> doc_id) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (where last is null or last = doc_id), '')) kept_sha256
from keys left join shared using (k) group by doc_id
"""

# crc32 runs bit by bit. States of a repair: 0 start, 1 after system, 2 after user, 3 after assistant;
# a weight is the cost in nine digits and the audit after it, so that the least text is the lightest.
SQL["op12_conversation_repair"] = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ord(c)::bigint) codes
  from conversations),
fated as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], codes),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda b, y: xor(b >> 1, (b & 1) * 3988292384::bigint))), 4294967295::bigint) % 20 fate from keyed),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when fate = 3 then 2 else 1 end)) copy
  from fated where fate <> 0),
placed as (
  select conv_id, turn, role, text, left(role, 1) c, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) i,
    not regexp_matches(text, '[^\x20\x09-\x0D]') blank,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') unfinished
  from damaged),
met as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 again from placed),
messages as (select *, blank or again must, case when unfinished then 3 else 0 end more from met),
follows(st, nx) as (values (0, 2), (1, 2), (2, 3), (3, 2)),
kept(st, c, nx) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ways as (
  select conv_id, 0::bigint i, unnest([0, 2, 3]) st, unnest(['000000000', '000000003I', '000000006II']) v from (select distinct conv_id from messages)
  union all
  select conv_id, i, st, min(v) v from (
    select conv_id, i, unnest([x.st, n1.nx, n2.nx]) st,
      unnest([lpad(cost::varchar, 9, '0') || audit, lpad((cost + 3)::varchar, 9, '0') || audit || 'I', lpad((cost + 6)::varchar, 9, '0') || audit || 'II']) v
    from (
      select w.conv_id, m.i, case e.e when 'D' then w.st when 'K' then k.nx else n.nx end st,
        left(w.v, 9)::bigint + case e.e when 'D' then 4 when 'K' then m.more else m.more + 3 end cost, substr(w.v, 10) || e.e audit
      from ways w join messages m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1
        join follows n on n.st = w.st left join kept k on k.st = w.st and k.c = m.c, (values ('D'), ('K'), ('R')) e(e)
      where e.e = 'D' or not m.must and (e.e = 'R' or k.nx is not null)) x
    join follows n1 on n1.st = x.st join follows n2 on n2.st = n1.nx) y
  group by conv_id, i, st),
size as (select conv_id, count(*) n, sum(blank::int) blank, sum((again and not blank)::int) duplicate, sum((unfinished and not must)::int) truncated,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps from messages group by conv_id),
crossed as (
  select conv_id, sum((before || c not in ('su', 'ua', 'au'))::int) illegal
  from (select conv_id, c, lag(c) over (partition by conv_id order by i) before from messages) where before is not null group by conv_id),
best as (
  select s.conv_id, min(v) v from ways w join size s on s.conv_id is not distinct from w.conv_id and s.n = w.i where st in (0, 3) group by s.conv_id),
edits as (
  select conv_id, k, e, count(*) filter (where e <> 'I') over p i, count(*) filter (where e <> 'D') over p m
  from (select conv_id, unnest(string_split(substr(v, 10), '')) e, unnest(range(1, length(v) - 8)) k from best where length(v) > 9) window p as (partition by conv_id order by k)),
written as (
  select e.conv_id, e.k, e.m, case when e.e = 'K' then r.role end as role, case when e.e = 'I' then '' else r.text end as text,
    max((e.m = 1 and e.e = 'K' and r.c = 's')::int) over (partition by e.conv_id) led
  from edits e left join messages r on r.conv_id is not distinct from e.conv_id and r.i = e.i where e.e <> 'D'),
lines as (
  select conv_id, string_agg(coalesce(role, case when (m - led) % 2 = 1 then 'user' else 'assistant' end) || ':' || text, chr(10) order by k) s from written group by conv_id)
select c.conv_id, coalesce(s.gaps, 0)::bigint gaps, coalesce(s.blank, 0)::bigint blank, coalesce(s.duplicate, 0)::bigint duplicate, coalesce(s.truncated, 0)::bigint truncated,
  coalesce(x.illegal, 0)::bigint illegal, coalesce(left(b.v, 9)::bigint, 0) "cost", coalesce(substr(b.v, 10), '') audit, sha256(coalesce(l.s, '')) repaired_sha256
from (select distinct conv_id from conversations) c
left join size s on s.conv_id is not distinct from c.conv_id left join crossed x on x.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id
"""
