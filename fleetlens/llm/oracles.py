"""DuckDB SQL for the queries that SQL can express. The others are held against plain versions in tests/llm."""

from __future__ import annotations

from fleetlens.llm.license_scans import LICENSE_RULES, SENTENCES
from fleetlens.llm.mixing import GOLDEN, SLOTS
from fleetlens.llm.url_filters import RULES, TWO_LABEL_SUFFIXES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _case(value: int) -> str:
    return " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p) if value == 0 else v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_LAST = "array_to_string(list_slice(string_split(host, '.'), -{}, -1), '.')"


def _strength(groups: str, prior: str) -> str:
    return f"""(select least(greatest(coalesce(sum((n - 1) * {prior} * (1 - {prior})) / greatest(sum(n * pow(k / n - {prior}, 2)) - sum({prior} * (1 - {prior})), 1e-9) - 1, 200.0), 2.0), 200.0) from {groups} where n > 0)"""


OP1 = f"""
with parts as (select page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
good as (select doc_id as page_id, avg(cast(quality = 1 and toxic = 0 as int)) as good from labels where doc_id is not null group by 1),
counts as (select host, count(good) as n, coalesce(sum(good), 0) as k from parts left join good using (page_id) group by 1),
hosts as (select *, case when {_LAST.format(2)} in ({_TWO}) then {_LAST.format(3)} else {_LAST.format(2)} end as domain,
    case when {_LAST.format(2)} in ({_TWO}) then {_LAST.format(2)} else {_LAST.format(1)} end as suffix from counts),
d0 as (select suffix, domain, sum(n) as n, sum(k) as k from hosts group by 1, 2),
s0 as (select suffix, sum(n) as n, sum(k) as k from d0 group by 1),
s1 as (select *, (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) from s0) as top from s0),
s2 as (select suffix, (k + s * top) / (n + s) as suffix_rate from s1, (select {_strength("s1", "top")} as s)),
d1 as (select * from d0 join s2 using (suffix)),
d2 as (select domain, (k + s * suffix_rate) / (n + s) as domain_rate from d1, (select {_strength("d1", "suffix_rate")} as s)),
h1 as (select * from hosts join d2 using (domain)),
h2 as (select host, (k + s * domain_rate) / (n + s) as rate, n + s + 1 as size from h1, (select {_strength("h1", "domain_rate")} as s))
select page_id, host, path, case {_case(0)} end as rule,
    case {_case(1)} else case when rate + 1.64 * sqrt(rate * (1 - rate) / size) < 0.5 then 'block' else 'allow' end end as verdict,
    round(rate, 6) as reputation
from parts left join h2 using (host)
"""

_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER.format("coalesce(text, '')"))
OP2 = f"""
with d as (select row_number() over () as r, doc_id, {_ITEM_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_ITEM_WORDS} as w from benchmark where item_id is not null),
bw as (select item_id, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0),
win as (select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as s from bw),
sizes as (select distinct size from win),
dw as (select r, size, unnest(range(1, len(w) - size + 2)) as i, w from d, sizes where len(w) >= size),
hits as (select r, dw.size, i, item_id from (select r, size, i, array_to_string(w[i : i + size - 1], ' ') as s from dw) dw join win on dw.s = win.s and dw.size = win.size),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from hits) group by 1),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from hits group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

# what a source gives is the first words of its stream, repeated; the schedule says in which slot each of its blocks comes
OP3 = f"""
with d as (select row_number() over () as r, doc_id, source, len({WORDS}) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
s1 as (select *, row_number() over (order by source nulls last) as source_no, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint) as weight, 3 * source_size as cap from s0),
s2 as (select *, row_number() over (order by cap / weight, source nulls last) as nth,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from s1),
s3 as (select *, coalesce((select level from s2 where level * weight <= cap order by nth limit 1), 0.0) as first from s2),
s4 as (select source, source_no, source_size, least(cast(cap as double), first * weight) as target from s3),
s5 as (select *, cast(round(target) as bigint) as words, sum(target) over () as total, sum(target) over (order by source_no) as high from s4),
s6 as (select *, greatest(cast(ceil(round(total) / {SLOTS}) as bigint), 1) as block from s5),
points as (select i as slot, i * {GOLDEN} - floor(i * {GOLDEN}) as point from range({SLOTS}) t(i)),
hit as (select slot, source_no, row_number() over (partition by source_no order by slot) - 1 as rank from points join s6 on target > 0 and point >= (high - target) / total and point < high / total and slot < ceil(total / block)),
p as (select r, doc_id, size, source_no, source_size, target, block, total, words,
    coalesce(sum(size) over (partition by d.source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id, size rows between unbounded preceding and 1 preceding), 0) as place
    from d join s6 on d.source is not distinct from s6.source)
select doc_id, size, source_size, target,
    cast(case when size = 0 then 0 else (words // source_size) * size + greatest(0, least(place + size, words % source_size) - place) end as bigint) as taken,
    cast(case when size > 0 and place < words then coalesce(slot, ceil(total / p.block) + place // p.block) end as bigint) as first_slot
from p left join hit on hit.source_no = p.source_no and hit.rank = place // p.block
"""

_KNOWN = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
_NAMES = "list_filter([" + ", ".join(f"case when regexp_matches(ids, '{'.*'.join(f',{x}\\b' for x in seq)}') then '{name}' end" for name, seq in LICENSE_RULES) + "], lambda x: x is not null)"
OP5 = rf"""
with s as (select row_number() over () as r, doc_id, string_split_regex({LOWER.format("coalesce(text, '')")}, '[\n\r]+|[.!?;][\x20\t]+') as s from documents),
k as (select r, doc_id, list_filter(list_transform(s, lambda x: {_KNOWN}[trim(regexp_replace(x, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))]), lambda x: x is not null) as a from s),
j as (select doc_id, case when len(a) = 0 then '' else array_to_string(a, ',') end as sentence_ids, ',' || case when len(a) = 0 then '' else array_to_string(a, ',') end || ',' as ids from k),
n as (select doc_id, sentence_ids, {_NAMES} as names from j)
select doc_id, sentence_ids, case when len(names) = 0 then '' else array_to_string(list_sort(list_distinct(names)), ',') end as licenses, names[1] as license from n
"""

OP6 = f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
marked as (select doc_id, i, row_number() over (partition by s order by doc_id, i) > 1 as again from win),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from marked where again),
words as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
left_ as (select doc_id, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by 1),
n as (select doc_id, count(*) as n_removed from gone group by 1)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join n using (doc_id) left join left_ using (doc_id)
"""

_CRC = """xor(list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ascii(c) as bigint)),
    lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::bigint), 4294967295::bigint)"""
_CLOSED = "[least(x[1], 2 + least(x[3], 2 + x[4])), least(x[2], 2 + least(x[3], 2 + x[4])), least(x[3], 2 + x[4]), least(x[4], 2 + least(x[3], 2 + x[4]))]"
_KEEP = "case when lead = 's' and q = 0 then 1 when lead = 'u' and q <> 2 then 2 when lead = 'a' and q = 2 then 3 end"
# costs to go before each row, from the last to the first; then the walk, an edit a step
OP11 = rf"""
with recursive r as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC} % 20 as kind from conversations),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy from r),
o as (select *, dense_rank() over (order by conv_id nulls first) as k from d),
p as (select *, row_number() over (partition by k order by turn nulls first, role, text) as i, left(role, 1) as lead from o),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by k, role, text order by i) > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else 'f' end as fault, lag(lead) over (partition by k order by i) as led from p),
n as (select k, any_value(conv_id) as conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
    count(*) filter (where led is not null and led || lead not in ('su', 'ua', 'au')) as illegal from f group by 1),
back as (select k, n as i, [0, 4, 2, 0]::bigint[] as v from n
    union all select k, i, {_CLOSED} from (select f.k, f.i - 1 as i, case when fault in ('b', 'd') then list_transform(v, lambda y: y + 3) else [
        least(3 + v[1], 2 + t + v[3], case lead when 's' then t + v[2] when 'u' then t + v[3] else 99999999 end), least(3 + v[2], 2 + t + v[3], case when lead = 'u' then t + v[3] else 99999999 end),
        least(3 + v[3], 2 + t + v[4], case when lead = 'a' then t + v[4] else 99999999 end), least(3 + v[4], 2 + t + v[3], case when lead = 'u' then t + v[3] else 99999999 end)] end as x
        from back join (select *, cast(fault = 't' as bigint) as t from f) f on f.k = back.k and f.i = back.i)),
walk as (select k, 0::bigint as i, 0 as q, '' as audit, 0::bigint as cost, []::varchar[] as said from n
    union all select k, case edit when 'I' then i else i + 1 end, case edit when 'D' then q when 'K' then keep else nxt end, audit || edit, cost + case edit when 'D' then 3 when 'I' then 2 when 'K' then t else 2 + t end,
        case edit when 'D' then said when 'I' then list_append(said, want || ':') when 'K' then list_append(said, role || ':' || text) else list_append(said, want || ':' || text) end
    from (select *, case when i < n and (fault in ('b', 'd') or 3 + after[q + 1] = now[q + 1]) then 'D' when 2 + now[nxt + 1] = now[q + 1] then 'I' when keep is not null and t + after[keep + 1] = now[q + 1] then 'K' else 'R' end as edit
        from (select w.*, n.n, f.fault, f.role, f.text, cast(coalesce(f.fault, '') = 't' as bigint) as t, b.v as now, a.v as after, case when q = 2 then 3 else 2 end as nxt, case when q = 2 then 'assistant' else 'user' end as want, {_KEEP} as keep
            from walk w join n on n.k = w.k join back b on b.k = w.k and b.i = w.i left join back a on a.k = w.k and a.i = w.i + 1 left join f on f.k = w.k and f.i = w.i + 1
            where w.i < n.n or q in (1, 2)))),
done as (select walk.k, audit, cost, said from walk join n on n.k = walk.k where i = n and q in (0, 3)),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(said, chr(10)), '')) as repaired_sha256
from every left join n on n.conv_id is not distinct from every.conv_id left join done on done.k = n.k
"""

OP12 = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1),
j as (select p.*, case when first is not null and page_id is distinct from first then first end as refers_to from p left join f using (payload_digest))
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from j
"""

_SQUARES = "list_sum(list_transform(list_zip(v.c, m.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round(i: int) -> str:
    """Vectors with their nearest centroid of round i, and the centroids of the next."""
    return f"""
a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(v.c) as c, min({_SQUARES}::hugeint * 16 + n) as best from v, c{i} m group by r),
s{i} as (select n, j, cast(floor(sum(x) / count(*)) as bigint) as x from (select cast(best % 16 as bigint) as n, unnest(c) as x, unnest(range(64)) as j from a{i}) group by 1, 2),
c{i + 1} as materialized (select n, coalesce(u.c, m.c) as c from c{i} m left join (select n, list(x order by j) as c from s{i} group by 1) u using (n))"""


OP13 = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * greatest(least(cast(x as double), 131072.0), -131072.0)) as bigint)) as c from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by h, c) - 1 as n, c from (select sha256('3:' || coalesce(cast(vec_id as varchar), '')) as h, c from v order by h, c limit 8)),
{",".join(_round(i) for i in range(11))},
f as (select vec_id, cast(best % 16 as bigint) as n, cast(best // 16 as bigint) as distance from a10)
select vec_id, cast(n as int) as cluster, distance, cast(sum(distance) over (partition by n) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c10.c, ',')) as centroid_sha256 from f join c10 using (n)
"""

ORACLES = {"op1_url_filters": OP1, "op2_benchmark_decontamination": OP2, "op3_mixing": OP3, "op5_license_scans": OP5, "op6_substring_dedup": OP6, "op11_conversation_repair": OP11, "op12_warc": OP12, "op13_centroid_clustering": OP13}
