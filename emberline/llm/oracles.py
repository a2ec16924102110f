"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import string

from emberline.llm.quality_rules import BOILERPLATE

_WORDS = r"'[^\x20\x09-\x0D]+'"

NGRAM_JOIN = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), {_WORDS}) as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
 else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p where 100 * o >= 80 * (na + nb - o)),
r as (select doc_id, doc_id as c from s union select r.doc_id, l.b from r join l on l.a = r.c)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, min(c) as component_id from s join r on r.doc_id = s.doc_id group by s.doc_id, len(sh)"""

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d),
lw as (select doc_id, k, line, regexp_extract_all(line, {_WORDS}) as ws from l),
j as (select *, cast(len(ws) as double) as n, cast(list_sum(list_transform(ws, lambda w: length(w))) as bigint) as chars,
 row_number() over (partition by doc_id, line order by k) > 1 as again from lw where len(ws) > 0),
f as (select *, (n < 4 and not regexp_matches(regexp_replace(line, '\s+$', ''), '[.!?…:;"''”»)。]$'))
 or len(list_filter(ws, lambda w: regexp_full_match(w, '[|»>/·•-]+'))) >= 0.3::double * n
 or len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>=~^_]{{2,}}$'))) >= 0.3::double * n
 or (n >= 4 and len(list_filter(ws, lambda w: ends_with(w, '!!'))) >= 0.5::double * n)
 or (n <= 30 and regexp_matches(line, '(?i){"|".join(BOILERPLATE)}')) as failed from j),
a as (select doc_id, cast(sum(n) as bigint) as n_words, cast(sum(chars) as bigint) as word_chars, count(*) filter (where again) as n_dup_lines, count(*) as n_lines,
 count(*) filter (where failed) as lines_failed, cast(coalesce(sum(chars) filter (where failed), 0) as bigint) as lost from f group by 1),
t as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select doc_id, regexp_extract_all(text, {_WORDS}) as ws from d)),
x as (select doc_id, i, w, lead(w) over v as w2, lead(w, 2) over v as w3 from t window v as (partition by doc_id order by i)),
y as (select doc_id, i from (select *, count(*) over (partition by doc_id, w, w2, w3) as c from x where w3 is not null) where c > 1),
z as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from y) group by 1),
b as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
 coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(lines_failed, 0) as lines_failed, coalesce(lost, 0) as lost
 from d left join a on a.doc_id = d.doc_id left join z on z.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= 0.5 * word_chars as kept, n_lines, lines_failed from b"""


def _crc_step(value: int) -> int:
    for _ in range(8):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_FEATURES = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLING = rf"""
with w as (select doc_id, {_FEATURES} as ws from documents),
u as (select 's' as side, doc_id, unnest(ws) as w from w union all select 't', null, unnest({_FEATURES}) from benchmark),
x as (select w, hex(encode(w)) as h from (select distinct w from u)),
c as (select w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint),
 lambda crc, b: xor(crc >> 8, {[_crc_step(i) for i in range(256)]}[(xor(crc, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as b from x),
n as (select b, count(*) filter (where side = 's') as s, count(*) filter (where side = 't') as t from u join c on c.w = u.w group by 1),
g as (select b, cast(floor(1000 * ln((t + 1)::double * ((select sum(s) from n) + 10000)::double / ((s + 1)::double * ((select sum(t) from n) + 10000)::double))) as bigint) as gain from n),
f as (select doc_id, sum(gain) as weight from u join c on c.w = u.w join g on g.b = c.b where side = 's' group by 1),
d as (select w.doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, ('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::bigint as h from w left join f on f.doc_id = w.doc_id),
e as (select doc_id, n_features, n_features as n_words, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from d),
r as (select doc_id, row_number() over (order by score desc, doc_id) as k, count(*) over () as n from e where n_words >= 20)
select e.doc_id, n_words, n_features, weight, score, case when k <= 10 * n // 100 then k end as rank from e left join r on r.doc_id = e.doc_id"""


def _clustering(rounds: int = 10, k: int = 8) -> str:
    out = f"""with v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(cast(x as double)))) = 64),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as k, v as c from v order by 1 limit {k}),\n"""
    for r in range(rounds + 1):
        out += f"""a{r} as materialized (select vec_id, any_value(v) as v, arg_min(k, (d, k)) as k, min(d) as d
 from (select vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{r}) group by 1),\n"""
        if r < rounds:
            out += f"""c{r + 1} as materialized (select o.k, coalesce(m.c, o.c) as c from c{r} o left join (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c
 from (select k, i, sum(x) as s, count(*) as n from (select k, unnest(v) as x, unnest(range(64)) as i from a{r}) group by 1, 2) group by 1) m on m.k = o.k),\n"""
    return out + f"""s as (select k, cast(sum(d) as bigint) as inertia from a{rounds} group by 1)
select vec_id, cast(a.k as int) as cluster, cast(d as bigint) as distance, inertia as cluster_inertia, (select cast(sum(inertia) as bigint) from s) as inertia,
sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.k = a.k join s on s.k = a.k"""


CLUSTERING = _clustering()
