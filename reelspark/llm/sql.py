"""Queries of this subpackage as DuckDB SQL, where SQL can state them."""

from __future__ import annotations

from reelspark.llm.chat import CHUNK_ROWS, CHUNK_TURNS
from reelspark.llm.license_scan import APART, BASE, GRAM, OTHERS, WORD

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
with d as (select doc_id, sha256({LOWER}) as s from documents)
select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
 doc_id = max(doc_id) over (partition by s) as kept, s as text_sha256 from d"""

#: Ids with the smallest id that links (a, b; both directions) lead to.
REACH = """reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
 low as (select a, min(b) as b from reach group by a)"""

NEAR = f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') as w from documents),
 s as (select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i:i + 3], ' ') else array_to_string(w, ' ') end as g from w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) where len(w) > 0),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
 links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
 {REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) as component_id, d.doc_id <= coalesce(low.b, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join low on low.a = d.doc_id"""

EMBEDDINGS = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.93),
 {REACH},
 n as (select a, count(*) as n from links group by a)
select m.vec_id, coalesce(n.n, 0) as n_links, least(m.vec_id, coalesce(low.b, m.vec_id)) as component_id, m.vec_id <= coalesce(low.b, m.vec_id) as kept
from embeddings m left join n on n.a = m.vec_id left join low on low.a = m.vec_id"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {str(p in BASE).lower()}, string_split('{p}', ' '))" for i, (p, label) in enumerate([*BASE.items(), *OTHERS.items()]))
_GRAM = " || ' ' || ".join(f"w[i + {k}]" for k in range(1, GRAM + 1))

LICENSES = f"""
with t(template, label, base, w) as (values {_TEMPLATES}),
 d as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents),
 tg as (select template, i as t_pos, {_GRAM} as gram from t, unnest(range(0, len(w) - {GRAM - 1})) u(i)),
 dg as (select doc_id, i as pos, {_GRAM} as gram from d, unnest(range(0, greatest(len(w) - {GRAM - 1}, 0))) u(i)),
 hit as (select distinct doc_id, template, pos - t_pos as diagonal from dg join tg on dg.gram = tg.gram),
 voted as (select h.doc_id, h.template, t.label, t.base, len(t.w) as size, diagonal, list_filter(range(0, len(t.w)), lambda i: diagonal + i >= 0 and d.w[diagonal + i + 1] = t.w[i + 1]) as equal
  from hit h join t on h.template = t.template join d on h.doc_id = d.doc_id),
 marked as (select *, case when not base and diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {APART} then 0 else 1 end as m from voted),
 islands as (select *, sum(m) over (partition by doc_id, template order by diagonal) as island from marked),
 spans as (select doc_id, template, label, base, size, min(diagonal) as start, max(len(equal)) as agree, cast(len(list_distinct(flatten(list(equal)))) as double) / greatest(size, coalesce(max(diagonal + list_max(equal)) - min(diagonal + list_min(equal)) + 1, 0)) as share from islands group by doc_id, template, label, base, size, island),
 found as (select *, base and agree = size as place, (base and agree = size) or (not base and share >= 0.7) as found from spans)
select d.doc_id, cast(any_value(len(d.w)) as bigint) as n_words, count(*) filter (where place) as n_base, cast(min(start) filter (where place) as bigint) as first_word, cast(max(start) filter (where place) as bigint) as last_word,
 coalesce(string_agg(distinct label, ',' order by label) filter (where place), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label) filter (where found), '') as labels, coalesce(max(share), 0) as score
from d left join found f on f.doc_id = d.doc_id group by d.doc_id"""

CHATS = f"""
with r as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
 c as (select *, cast(coalesce(floor(turn / {CHUNK_TURNS}), -1) as bigint) as chunk from r),
 o as (select *, cast((row_number() over (partition by conv_id, chunk order by turn nulls first, role, text) - 1) // {CHUNK_ROWS} as integer) as slot from c),
 s as (select distinct conv_id, role as speaker from r),
 p as (select o.conv_id, speaker, chunk, slot, turn, role, text, role = speaker as own,
  case when role = speaker then '<|assistant|>' || chr(10) else '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) end as head, replace(text, '<|', '< |') || '<|end|>' as body from o join s on o.conv_id = s.conv_id),
 q as (select *, cast(coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, chunk, slot order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as bigint) + length(head) as place from p)
select conv_id, speaker, chunk, slot, count(*) as n_turns, count(*) filter (where own) as n_own, string_agg(head || body || chr(10), '' order by turn nulls first, role, text) as text,
 coalesce(string_agg(cast(place as varchar) || '-' || cast(place + length(body) as varchar), ',' order by turn nulls first, role, text) filter (where own), '') as mask
from q group by conv_id, speaker, chunk, slot"""

RANKED = f"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
 whole as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_all from d where len(w) > 0),
 b as (select distinct item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where item_id is not null),
 tf as (select doc_id, any_value(n) as n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from b) group by doc_id, term),
 idf as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, whole group by term, n_docs),
 s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_all)))) as bigint) as score from b join tf using (term) join idf using (term), whole where doc_id is not null group by item_id, doc_id),
 r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50"""

_SHARE = lambda n, total, v: f"(1 + (1000000000 * ({n} + 5)) // ({total} + 5 * {v}))"

AUDIT = f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
 g as (select distinct lang, source from d),
 t as (select lang, source, doc_id, unnest(w) as term from d),
 kept as (select lang, term from t group by lang, term having count(distinct doc_id) >= 30),
 size as (select lang, (select count(*) from kept k where k.lang = l.lang) as v from (select distinct lang from g) l),
 own as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by lang, source, term),
 c as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n from g join kept k on k.lang = g.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
 p as (select c.*, cast({_SHARE("n", "sum(n) over (partition by c.lang, source)", "v")} as bigint) as p from c join size on size.lang = c.lang),
 lc as (select lang, term, sum(n) as n from own group by lang, term),
 q as (select lc.lang, term, cast({_SHARE("n", "sum(n) over (partition by lc.lang)", "v")} as bigint) as q from lc join size on size.lang = lc.lang),
 diff as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
 pairs as (select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(value, 0) as bigint) as value from g x join g y on x.lang = y.lang and x.source <> y.source left join diff d on d.lang = x.lang and d.source = x.source and d.item = y.source),
 more as (select p.lang, p.source, 'term' as part, p.term as item, p.p - q.q as value from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p.p > q.q),
 r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pairs union all select * from more))
select * from r where part = 'pair' or rank <= 50"""

TOP_PRODUCTS = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
 r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 20"""
