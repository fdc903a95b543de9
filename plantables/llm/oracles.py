"""DuckDB SQL for the operators' queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = "replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"

OP2 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')) v(conv_id, turn, role, text)
),
u as (select *, length({_ESCAPED.format(c="text")}) + length(replace({_ESCAPED.format(c="role")}, chr(10), '\\n')) + length('<|im_start|>') + length('<|im_end|>') + 2 as chars from t)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from u group by conv_id
"""

OP5 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
w as (select doc_id, unnest(range(1, len(l) + 1)) as j, unnest(l) as word from d),
p as (select doc_id, i, md5(array_to_string(l[i:i + 34], ' ')) as k from (select doc_id, l, unnest(range(1, len(l) - 33)) as i from d where len(l) >= 35)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from p) where n > 1),
m as (select w.doc_id, w.j, w.word, max(r.i) over (partition by w.doc_id order by w.j rows unbounded preceding) as last from w left join r on r.doc_id = w.doc_id and r.i = w.j),
k as (select doc_id, count(*) as n_words, cast(count(*) filter (j - last <= 34) as bigint) as n_removed, string_agg(word, ' ' order by j) filter (last is null or j - last > 34) as kept from m group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
with d as (select doc_id, {_WORDS} as l from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as l from benchmark),
g as (select distinct item, n, array_to_string(l[i:i + n - 1], ' ') as k from (select item, l, least(len(l), 10) as n, unnest(range(1, len(l) - least(len(l), 10) + 2)) as i from b where len(l) > 0)),
p as (select doc_id, i, n, array_to_string(l[i:i + n - 1], ' ') as k from (select doc_id, l, n, unnest(range(1, len(l) - n + 2)) as i from d, (select distinct n from g) where len(l) >= n)),
h as (select doc_id, i, n, item from p join g using (n, k)),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from h)) group by doc_id),
s as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list_distinct(list(item))), ',') as items from h group by doc_id)
select doc_id, cast(len(l) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join s using (doc_id)
"""

_ASSIGN = """
p{i} as materialized (select id, c, d from (select id, c, d, row_number() over (partition by id order by d, c) as r from (select v.id, m.c, sum((v.x - m.x) * (v.x - m.x)) as d from v join m{i} m using (i) group by v.id, m.c)) where r = 1)"""
_MOVE = """
s{i} as (select c, i, cast(sum(x) as bigint) as s, count(*) as n from v join p{i} using (id) group by c, i),
m{j} as materialized (select m.c, m.i, case when n is null then m.x else cast((s - ((s % n) + n) % n) // n as bigint) end as x from m{i} m left join s{i} s on s.c = m.c and s.i = m.i)"""

OP13 = f"""
with k as (select vec_id as id, embedding as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select id, i, cast(floor(64 * cast(e[i] as double)) as bigint) as x from (select id, e, unnest(range(1, 65)) as i from k)),
f as (select id, cast(row_number() over (order by sha256('1:' || id)) - 1 as integer) as c from k qualify c < 16),
m0 as materialized (select c, i, x from v join f using (id)),
{",".join(_ASSIGN.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(3))},
{_ASSIGN.format(i=3)},
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as h from m3 group by c)
select id as vec_id, c as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, h as centroid_sha256 from p3 join h using (c)
"""

OP11 = """
with recursive t as (select cast(conv_id as bigint) as conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select conv_id, cast(conv_id as varchar) as s, count(*) as n from t group by conv_id),
bits as (
  select conv_id, s, 0 as b, cast(4294967295 as bigint) as r from ids
  union all
  select conv_id, s, b + 1, xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end) from (select conv_id, s, b, case when b % 8 = 0 then xor(r, cast(ascii(substr(s, b // 8 + 1, 1)) as bigint)) else r end as x from bits where b < 8 * length(s))
),
h as materialized (select conv_id, cast(xor(r, 4294967295) % 6 as bigint) as h from bits where b = 8 * length(s)),
k as (select ids.conv_id, h.h, least(h.h, coalesce(o.n, 0)) as k from ids join h using (conv_id) left join ids o on o.conv_id = ids.conv_id - ids.conv_id % 100),
u as (
  select k.conv_id, t.i as d, t.role, t.text from k join t on t.conv_id = k.conv_id - k.conv_id % 100 and t.i <= k.k
  union all select k.conv_id, t.i - k.h + k.k, t.role, t.text from k join t on t.conv_id = k.conv_id and t.i > k.h
),
m as materialized (
  select conv_id, d, length(text) as chars, md5(string_agg(md5(role) || md5(text), '' order by d) over (partition by conv_id order by d rows unbounded preceding)) as node from u
  union all select conv_id, 0, 0, 'root' from ids
),
w as (select *, coalesce(lag(node) over (partition by conv_id order by d), '') as parent, max(d) over (partition by conv_id) as last from m),
g as materialized (select node, d, min(conv_id) as conv_id, count(*) as n, any_value(parent) as parent, any_value(chars) as chars, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = last), '')) as ends from w group by node, d),
c as (select parent, count(*) as n from g where d > 0 group by parent),
v as (select g.*, coalesce(c.n, 0) as n_children, (g.n - 1) * chars as saved from g left join c on c.parent = g.node),
below as (select distinct a.node as top, b.node from m a join m b on a.conv_id = b.conv_id and b.d >= a.d),
s as (select top, count(*) filter (n_children = 0) as leaves, sum(saved) as saved from below join v using (node) group by top)
select v.conv_id, cast(v.d as bigint) as depth, p.conv_id as parent_conv_id, v.n as n_convs, cast(v.n_children as bigint) as n_children, cast(leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, v.ends as ends_sha256
from v join s on s.top = v.node left join g p on p.node = v.parent and v.d > 0
"""
