"""DuckDB SQL for the results that SQL can state."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, least(10, len(w)) n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) v from i where len(w) > 0),
sizes as (select distinct n from iw),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) k, w from d, sizes where len(w) >= n),
dv as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') v from dw),
hits as (select doc_id, k, dv.n, item_id from dv join iw on dv.v = iw.v and dv.n = iw.n),
words as (select distinct doc_id, unnest(range(k, k + n)) p from hits),
counts as (select doc_id, count(*) n_hit from words group by 1),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from hits group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join counts using (doc_id) left join its using (doc_id)
"""

_SPLIT = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
REPEATS = rf"""
with d as (select doc_id, {_SPLIT.replace("text,", "coalesce(text, ''),")} w from documents),
v as (select doc_id, unnest(range(1, len(w) - 33)) k, w from d where len(w) >= 35),
h as (select doc_id, k, md5(array_to_string(w[k:k + 34], ' ')) x from v),
r as (select x from h group by x having count(*) > 1),
gone as (select distinct doc_id, unnest(range(k, k + 35)) p from h semi join r using (x)),
each_word as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
kept as (select doc_id, count(*) n, string_agg(word, ' ' order by p) t from each_word anti join gone using (doc_id, p) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)
"""

JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) m from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 90 * (x.n + y.n - m)),
c as (select doc_id a, doc_id b from n union select c.a, l.b from c join l on c.b = l.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.c, d.doc_id) component_id from d left join n using (doc_id) left join (select a doc_id, min(b) c from c group by 1) m using (doc_id)
"""

_TEXT_LEAF = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::bigint)"
_SIDES = "coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') r"
MANIFEST = f"""
with recursive d as (select row_number() over () k, doc_id, coalesce('=' || lang, '') tree, sha256({_TEXT_LEAF}) leaf, coalesce({_CRC} % 3 = 0, false) changed, sha256({_TEXT_LEAF.replace("(text as", f"(translate(text, '{_UP}', '{_LOW}') as")}) other from documents),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, k) - 1 i, count(*) over (partition by tree) n from d),
t as (select tree, 0 lvl, i, n, leaf h from p union all select tree, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from t where n > 1 group by tree, lvl, i // 8, n),
s as (select tree, h subroot, row_number() over (order by tree) - 1 i, count(*) over () n from t where n = 1),
u as (select 0 lvl, i, n, subroot h from s union all select lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from u where n > 1 group by lvl, i // 8, n),
ts as (select tree, lvl, i, {_SIDES} from t where n > 1 window w as (partition by tree, lvl, i // 8 order by i)),
us as (select lvl, i, {_SIDES} from u where n > 1 window w as (partition by lvl, i // 8 order by i)),
steps as (select k, lvl, l, r from p join ts on ts.tree = p.tree and ts.i = p.i // cast(pow(8, lvl) as bigint) union all select k, 1000 + lvl, l, r from p join s on s.tree = p.tree join us on us.i = s.i // cast(pow(8, lvl) as bigint)),
path as (select k, row_number() over (partition by k order by lvl) step, lvl, l, r from steps),
f as (select k, 0 step, case when changed then other else leaf end h from p union all select f.k, path.step, sha256(l || h || r) from f join path on path.k = f.k and path.step = f.step + 1),
ends as (select k, arg_max(h, step) h from f group by 1),
proofs as (select k, string_agg(l || r, '' order by step) x from path group by 1)
select doc_id, leaf, subroot, u.h root, sha256(coalesce(x, '')) proof_sha256, ends.h folded_root, ends.h = u.h verified from p join s using (tree) join u on u.n = 1 join ends using (k) left join proofs using (k)
"""
