"""DuckDB SQL for the queries that SQL can express."""

from . import decontaminate, dedup, hamming, lexical, mixing

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_K = dedup.SHINGLE
OP2 = f"""with recursive w as (select doc_id, {_WORDS.format(_LOW)} as w from documents),
s as (select distinct doc_id, s from (
  select doc_id, unnest(list_transform(range(1, len(w) - {_K} + 2), lambda i: array_to_string(w[i:i + {_K} - 1], ' '))) as s from w where len(w) >= {_K}
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and {_K} - 1)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= {dedup.PERCENT} * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.doc_id),
k as (select doc_id, min(root) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join k on k.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""

_M = decontaminate.WINDOW
OP4 = f"""with d as (select doc_id, {_ALNUM.format(_LOW)} as w from documents),
b as (select cast(item_id as varchar) as item, {_ALNUM.format(_LOW)} as w from benchmark),
win as (select item, m, array_to_string(w[i:i + m - 1], ' ') as s from (select item, w, least({_M}, len(w)) as m, unnest(range(1, len(w) - least({_M}, len(w)) + 2)) as i from b where len(w) > 0)),
ms as (select distinct m from win),
pos as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as s from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d join ms on len(w) >= m)),
occ as (select distinct doc_id, i, win.m, item from pos join win on pos.m = win.m and pos.s = win.s),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + m)) as place from occ) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id"""

OP5 = f"""with v as (select vec_id as id, list_transform(embedding[1:{hamming.BITS}], lambda x: x < 0) as s from embeddings where len(embedding) >= {hamming.BITS}),
p as (select q.id as query_id, r.id as neighbor_id, cast(list_sum(list_transform(range(1, {hamming.BITS} + 1), lambda i: case when q.s[i] <> r.s[i] then 1 else 0 end)) as integer) as distance from v q cross join v r where q.id % 50 = 0),
k as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from p) select query_id, neighbor_id, distance, cast(rank as integer) as rank from k where rank <= 10"""

_P, _L, _R = mixing._PRIME, mixing.BLOCK_TOKENS, mixing.ROUNDS


def _permuted(x: str, n: str, epoch: str, inverse: bool = False) -> str:
    key = f"(((((rank * 48271 + {epoch} * 69621 + r * 16807 + 12345) % {_P}) * 1103515245 % {_P}) * 950706376 + 7) % {_P})"
    other = f"(((({key} * 1000003 - a) % {n}) + {n}) % {n})"
    bit = f"(((((greatest(a, {other}) % {_P}) * 742938285 + {key}) % {_P}) * 1226874159 % {_P}) >> 11) % 2"
    rounds = f"range({_R - 1}, -1, -1)" if inverse else f"range({_R})"
    return f"list_reduce(list_prepend(cast({x} as bigint), {rounds}), lambda a, r: case when {bit} = 1 then {other} else a end)"


def _mix32(x: str) -> str:
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * {0x45D9F3B}) & 4294967295)"
    return f"xor(({x}) >> 16, {x})"


OP3 = f"""with sz as (select doc_id, source, cast(len({_WORDS.format("coalesce(text, '')")}) as bigint) as size from documents),
per as (select source, cast(sum(size) as bigint) as ss from sz group by source),
rk as (select *, cast(row_number() over (order by source nulls last) - 1 as bigint) as rank from per),
wt as (select *, cast([{', '.join(map(str, mixing.WEIGHTS))}][rank % {len(mixing.WEIGHTS)} + 1] as double) as w, cast(ss * {mixing.MAX_REPEAT} as double) as cap from rk),
lv as (select *, (sum(ss) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level from wt window b as (order by cap / w, rank rows between unbounded preceding and 1 preceding)),
tg as (select source, rank, ss, least(cap, coalesce(max(case when level * w <= cap then level end) over (), 0) * w) as target from lv),
t1 as (select *, cast(round(target) as bigint) as need, (ss + {_L - 1}) // {_L} as blocks from tg where ss > 0),
t2 as (select *, need // ss as epochs, need % ss as rest, ss - (blocks - 1) * {_L} as last_len from t1),
t3 as (select *, {_permuted('blocks - 1', 'blocks', 'epochs', True)} as last_at from t2),
t4 as (select *, case when rest <= last_at * {_L} then rest // {_L} when rest < last_at * {_L} + last_len then last_at else (rest + {_L} - last_len) // {_L} end as whole,
  case when rest <= last_at * {_L} then rest % {_L} when rest < last_at * {_L} + last_len then rest - last_at * {_L} else (rest + {_L} - last_len) % {_L} end as part from t3),
t5 as (select *, epochs * blocks + whole + case when part > 0 then 1 else 0 end as slots from t4),
sh as (select greatest(1, (sum(need) + {mixing.SHARD_TOKENS - 1}) // {mixing.SHARD_TOKENS}) as shards from t5),
kr as (select rank, {_mix32(f"rank + {mixing.SEED}")} as kr from t5),
kh as (select rank, {_mix32("kr")} as kh from kr),
dr as (select t5.rank, i, cast(kh as bigint) as kh, shards from (select rank, unnest(range(slots)) as i from t5) t5 join kh using (rank) cross join sh),
d1 as (select rank, i, shards, xor(i, kh) as x from dr),
d2 as (select rank, i, shards, (xor(x >> 16, x) * 73244475) & 4294967295 as x from d1),
d3 as (select rank, i, shards, (xor(x >> 16, x) * 73244475) & 4294967295 as x from d2),
ds as (select rank, xor(x >> 16, x) % shards as shard from d3),
dn as (select rank, shard, row_number() over (partition by rank order by shard) - 1 as slot from ds),
sl as (select t5.*, slot, shard from t5 join dn using (rank)),
sb as (select *, slot // blocks as epoch, slot % blocks as place from sl),
sp as (select *, {_permuted('place', 'blocks', 'epoch')} as block from sb),
st as (select rank, block, shard, case when epoch < epochs or place < whole then (case when block = blocks - 1 then last_len else {_L} end) else part end as take from sp),
dk as (select sz.*, tg.rank, tg.ss, tg.target, case when doc_id is null then size + {mixing.BUCKETS} else (((doc_id + size) % {mixing.BUCKETS}) + {mixing.BUCKETS}) % {mixing.BUCKETS} end as bucket from sz join tg on sz.source is not distinct from tg.source),
ofs as (select *, cast(coalesce(sum(size) over (partition by rank order by bucket, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as off from dk),
pc as (select rank, off, size, unnest(range(off // {_L}, (off + size - 1) // {_L} + 1)) as block from ofs where size > 0),
us as (select pc.rank, pc.off, shard, greatest(0, least(least(off + size, (pc.block + 1) * {_L}) - pc.block * {_L}, take) - (greatest(off, pc.block * {_L}) - pc.block * {_L})) as n from pc join st on pc.rank = st.rank and pc.block = st.block),
got as (select rank, off, sum(n) as taken, min(case when n > 0 then shard end) as first_shard from us group by rank, off)
select doc_id, o.source, size, ss as source_size, target, cast(coalesce(case when size > 0 then taken end, 0) as bigint) as taken, cast(case when size > 0 then first_shard end as bigint) as first_shard from ofs o left join got g on o.rank = g.rank and o.off = g.off"""

_BIT = "xor(x >> 1, 3988292384 * (x & 1))"
#: crc32 of an ASCII text, bit by bit.
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({{}}, ''), lambda z: ascii(z)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: {_BIT})), 4294967295)"
_BARE = r"rtrim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_AT = "from dp join ln using (conv_id) where pos < n"

OP11 = f"""with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy from c where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, {_BARE.format('text')} as bare from d),
f as (select *, case when bare = '' then 'blank' when seen > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault, left(role, 1) as ini from o),
g as (select *, ini as r, coalesce(lag(ini) over w || ini not in ('su', 'ua', 'au'), false) as bad from f window w as (partition by conv_id order by i)),
ag as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (bad) as illegal from g group by conv_id),
ln as (select ids.conv_id as c0, coalesce(ids.conv_id, -1) as conv_id, (select count(*) from g where g.conv_id is not distinct from ids.conv_id) as n from (select distinct conv_id from conversations) ids),
gg as (select coalesce(conv_id, -1) as conv_id, i - 1 as pos, role, text, r, coalesce(fault in ('blank', 'duplicate'), false) as must, case when fault = 'truncated' then 3 else 0 end as charge from g),
dp as (select conv_id, 0::bigint as pos, 0 as st, {{'cost': 0::bigint, 'audit': '', 'made': []::varchar[]}} as w from ln
  union all
  select conv_id, pos + 1, st, min(w) from (
    select q.conv_id, q.pos, e.st, e.w from (
      select conv_id, pos, st, w {_AT}
      union all select conv_id, pos, case when st = 2 then 3 else 2 end, {{'cost': w.cost + 3, 'audit': w.audit || 'I', 'made': list_append(w.made, case when st = 2 then 'assistant:' else 'user:' end)}} {_AT}
    ) q join gg on gg.conv_id = q.conv_id and gg.pos = q.pos, unnest([
      {{'st': st, 'w': {{'cost': w.cost + 4, 'audit': w.audit || 'D', 'made': w.made}}}},
      case when not must then {{'st': case when st = 2 then 3 else 2 end, 'w': {{'cost': w.cost + 3 + charge, 'audit': w.audit || 'R', 'made': list_append(w.made, case when st = 2 then 'assistant:' else 'user:' end || text)}}}} end,
      case when not must and (r = 's' and st = 0 or r = 'u' and st <> 2 or r = 'a' and st = 2) then {{'st': case r when 's' then 1 when 'u' then 2 else 3 end, 'w': {{'cost': w.cost + charge, 'audit': w.audit || 'K', 'made': list_append(w.made, role || ':' || text)}}}} end
    ]) as t(e) where e is not null) group by conv_id, pos, st),
fin as (select ln.c0 as conv_id, min({{'cost': w.cost + case st when 1 then 6 when 2 then 3 else 0 end, 'audit': w.audit || case st when 1 then 'II' when 2 then 'I' else '' end, 'made': w.made || case st when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end}}) as w from dp join ln using (conv_id) where pos = n group by ln.c0)
select fin.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, w.cost as cost, w.audit as audit, sha256(array_to_string(w.made, chr(10))) as repaired_sha256
from fin left join ag on ag.conv_id is not distinct from fin.conv_id"""

OP13 = f"""with d as (select doc_id, unnest({_TERMS.format(_LOW)}) as t from documents),
b as (select item_id, t, count(*) as times from (select item_id, unnest({_TERMS.format(_LOW)}) as t from benchmark) group by 1, 2),
n as (select doc_id, count(*) as n from d group by doc_id), s as (select count(*) as nn, cast(sum(n) as bigint) as ll from n),
p as (select doc_id, t, count(*) as tf from d where t in (select t from b) group by 1, 2),
df as (select t, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, s group by t, nn),
sc as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as bigint) as score from p join b using (t) join df using (t) join n using (doc_id), s group by 1, 2),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= {lexical.K}"""

ORACLES: dict[str, str] = {"op2_near_dedup": OP2, "op3_mix_sources": OP3, "op4_decontaminate": OP4, "op5_exact_topk": OP5, "op11_repair": OP11, "op13_lexical_search": OP13}
