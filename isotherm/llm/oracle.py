"""The operators that SQL can express, in SQL for DuckDB, by brute force."""

WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with recursive d as (select doc_id, {WORDS.format(t=LOW)} as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from d),
n as (select doc_id, cast(len(sh) as bigint) as n from s),
e as (select doc_id, unnest(sh) as x from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select i.a, i.b from i join n p on p.doc_id = i.a join n q on q.doc_id = i.b where 100 * k >= 90 * (p.n + q.n - k)),
r as (select doc_id as id, doc_id as at from n union select r.id, l.b from r join l on l.a = r.at)
select n.doc_id, n.n as n_shingles, min(r.at) as component_id from n join r on r.id = n.doc_id group by 1, 2
"""

_OP1_END = "select n.doc_id, n.n as n_shingles"
OP1_LINKS = OP1.replace(_OP1_END, "select c.*, coalesce(k.n_links, 0) as n_links from (" + _OP1_END) + ") c left join (select a, count(*) as n_links from l group by 1) k on k.a = c.doc_id"

OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5(substring(h, 2 * p + 1, 400)) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as p from d where length(h) >= 400)),
t as (select doc_id, p from w where k in (select k from w group by k having count(*) > 1)),
f as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 200 then 1 else 0 end as new from t),
g as (select doc_id, p, sum(new) over (partition by doc_id order by p) as run from f),
s as (select doc_id, run, min(p) as a, max(p) + 200 as b from g group by 1, 2),
m as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from s group by 1),
c as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from s union all select doc_id, max(b), 1000000000 from s group by 1),
k as (select c.doc_id, string_agg(substring(h, cast(2 * x + 1 as bigint), cast(2 * (y - x) as bigint)), '' order by x) as h from c join d using (doc_id) group by 1)
select d.doc_id, length(d.h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, d.h))) as kept_sha256 from d left join m using (doc_id) left join k using (doc_id)
"""

_DIGIT = "(instr('0123456789abcdef', substring(h, {p}, 1)) - 1)"
_FIVE = "(((({} * 16 + {}) * 16 + {}) * 16 + {}) * 16 + {})".format(*[_DIGIT.format(p=f"5 * g + {k}") for k in range(1, 6)])
_LETTER = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {v} + 1, 1)"
BASE32 = "array_to_string(list_transform(range(0, 8), lambda g: " + " || ".join(_LETTER.format(v=f"cast({_FIVE} // {1 << s} % 32 as bigint)") for s in (15, 10, 5, 0)) + "), '')"

OP5 = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
q as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {BASE32} as payload_digest, max(page_id) over (partition by html) as top from p)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from q
"""

_W7 = WORDS.format(t="lower(coalesce(text, ''))")
_RUNS = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')))"
OP7 = f"""
with b as (select item_id, w, least(len(w), 5) as k from (select item_id, {_W7} as w from benchmark) where len(w) > 0),
i as (select item_id, unnest({_RUNS}) as x from b), n as (select item_id, count(*) as n_item from i group by 1),
d as (select doc_id, w, k from (select doc_id, {_W7} as w from documents), (select distinct k from b)),
e as (select distinct doc_id, unnest({_RUNS}) as x from d where len(w) >= k),
m as (select doc_id, item_id, count(distinct x) as n_shared from e join i using (x) group by 1, 2)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from m join n using (item_id) where 5 * n_shared >= 4 * n_item
"""

_ESCAPE = "replace(replace({t}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
OP9 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
  length({_ESCAPE.format(t="text")}) as n, length(replace({_ESCAPE.format(t="role")}, chr(10), '<' || chr(92) || 'r>')) as r from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + case when before = role then 10 else r + 12 + 1 + 11 end) as bigint) as formatted_chars from o group by 1
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(kind: str, pattern: str, group: int, least: int) -> str:
    return f"""select doc_id, '{kind}' as kind, unnest(range(1, len(m) + 1)) as i, m, g, s from
  (select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as g, string_split_regex(text, '{pattern}') as s from t where regexp_matches(text, '{pattern}'))"""


OP10 = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
f as ({_kind("assign", _ASSIGN, 1, 6)} union all {_kind("access", "AKIA[A-Z0-9]+", 0, 20)} union all {_kind("hex", "[0-9a-f]+", 0, 24)}),
p as (select doc_id, kind, length(g[i]) as n,
  cast(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as a, length(m[i]) as len from f where length(g[i]) >= case kind when 'assign' then 6 when 'access' then 20 else 24 end),
q as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || a || ':' || (a + len), ',' order by a, case kind when 'assign' then 1 when 'access' then 2 else 3 end) as spans from p group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(spans, '') as spans, sha256(coalesce(spans, '')) as base_sha256 from t left join q using (doc_id)
"""

_NUMBER = "cast(('0x' || substring(h, {at}, 8)) as bigint)"
_SENTINEL = "(contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>'))"
OP11 = f"""
with t as (select doc_id, coalesce(text, '') as x, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (select *, length(x) as n, {_NUMBER.format(at=1)} as h1, {_NUMBER.format(at=9)} as h2, {_NUMBER.format(at=17)} as h3, {_NUMBER.format(at=25)} as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when x = '' or {_SENTINEL} or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
p as (select *, substring(x, 1, a) as pre, substring(x, a + 1, b - a) as mid, substring(x, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(x) as restored_sha256 from p
"""

_VALUE = "coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_VALUE.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_UP = "select tree, l + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from {t} where n > 1 group by tree, l, i // 3, n"
# crc32 is not a function of DuckDB: bit by bit, one byte of the decimal id after the other
_BIT = "case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"


def _byte(a: str) -> str:
    return f"list_reduce(list_prepend({a}, [1::bigint, 2, 3, 4, 5, 6, 7, 8]), lambda c, z: {_BIT})"


_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda j: cast(ascii(substring(s, j, 1)) as bigint))), lambda a, b: {_byte('xor(a, b)')}), 4294967295::bigint)"
OP12 = f"""
with recursive d as (select *, cast(doc_id as varchar) as s, coalesce('=' || source, '') as tree from documents),
leaf as (select doc_id, tree, {_leaf("text")} as h, {_leaf("replace(text, chr(10), '')")} as cut, {_CRC} % 2 = 0 as even from d),
lf as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i, count(*) over (partition by tree) as n from leaf),
t(tree, l, i, h, n) as (select tree, 0, i, h, n from lf union all {_UP.format(t="t")}),
sub as (select tree, max_by(h, l) as subroot, max(l) as high from t group by 1),
o as (select tree, subroot, high, row_number() over (order by tree) - 1 as i, count(*) over () as n from sub),
u(tree, l, i, h, n) as (select '', 0, i, subroot, n from o union all {_UP.format(t="u")}),
r as (select max_by(h, l) as root, max(l) as top from u),
step as (select a.doc_id, a.tree, a.i as own, e.l, e.i, e.h from lf a join o using (tree) join t e on e.tree = a.tree and e.l < o.high and e.i // 3 = (a.i // cast(3 ** e.l as bigint)) // 3 and e.i <> a.i // cast(3 ** e.l as bigint)
  union all select a.doc_id, a.tree, a.i, o.high + u.l, u.i, u.h from lf a join o using (tree) join u on u.i // 3 = (o.i // cast(3 ** u.l as bigint)) // 3 and u.i <> o.i // cast(3 ** u.l as bigint)),
proof as (select tree, own, sha256(string_agg(h, '' order by l, i)) as digest from step group by 1, 2),
f(tree, own, l, h) as (select tree, i, 0, case when even then cut else h end from lf
  union all select f.tree, f.own, f.l + 1, sha256(coalesce(string_agg(s.h, '' order by s.i) filter (s.i < p.place), '') || any_value(f.h) || coalesce(string_agg(s.h, '' order by s.i) filter (s.i > p.place), ''))
  from f join o using (tree) cross join r join lateral (select case when f.l < o.high then f.own // cast(3 ** f.l as bigint) else o.i // cast(3 ** (f.l - o.high) as bigint) end as place) p on true
  left join step s on s.tree = f.tree and s.own = f.own and s.l = f.l where f.l < o.high + r.top group by f.tree, f.own, f.l, p.place),
g as (select tree, own, max_by(h, l) as folded from f group by 1, 2)
select lf.doc_id, lf.h as leaf, o.subroot, r.root, coalesce(proof.digest, sha256('')) as proof_sha256, g.folded as folded_root, g.folded = r.root as verified
from lf join o using (tree) cross join r left join proof on proof.tree = lf.tree and proof.own = lf.i join g on g.tree = lf.tree and g.own = lf.i
"""

OP13 = f"""
with d as (select doc_id, source, cast(len({WORDS.format(t="coalesce(text, '')")}) as bigint) as size, cast(('0x' || substring(sha256('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by 1),
w as (select source, source_size, case i % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from s),
v as (select *, coalesce(sum(cap) over o, 0) as caps, count(*) over o as k, sum(weight) over () - coalesce(sum(weight) over o, 0) as rest, 1.5::double * sum(source_size) over () as wanted from w
  window o as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
l as (select min_by((wanted - caps) / rest, k) filter (weight * ((wanted - caps) / rest) <= cap) as level from v),
t as (select source, source_size, least(cast(cap as double), weight * level) as target from w, l),
p as (select d.*, source_size, target, cast(round_even(target, 0) as bigint) as budget, coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target, cast(case when source_size = 0 then 0 else
  budget // source_size * size + greatest(0, least(size, budget % source_size - before)) end as bigint) as taken from p
"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": OP1,
    "op1_ngram_jaccard_links": OP1_LINKS,
    "op2_suffix_array_dedup": OP2,
    "op5_warc": OP5,
    "op7_benchmark_decontamination": OP7,
    "op9_chat_formatting": OP9,
    "op10_secret_scans": OP10,
    "op11_fill_in_middle": OP11,
    "op12_merkle_manifest": OP12,
    "op13_mixture": OP13,
}
