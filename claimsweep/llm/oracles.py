"""DuckDB SQL for the operators that SQL can express, written from their contracts and parameters."""

from __future__ import annotations

from .licenses import GAP, K, LEAST_COVER, PHRASES, TEMPLATES
from .quality import LEAST_LEFT, LINE_LIMIT, WINDOW

_WORD = r"[^\x20\x09-\x0D]+"


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sharding(n_shards: int = 24) -> str:
    table = "[" + ",".join(str(_crc_step(i)) for i in range(256)) + "]"
    return rf"""
with own as (
  select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 8 as size from documents),
hexed as (select doc_id, size, regexp_extract_all(hex(encode(text)), '..') as h from own),
summed as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(h, lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(({table}::bigint[])[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) as text_crc32 from hexed),
placed as (
  select *, coalesce(sum(size) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as start,
    sum(size) over () as total from summed),
cut as (select *, (start::hugeint * {n_shards} // total::hugeint)::int as shard from placed)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard,
  (row_number() over (partition by shard order by doc_id) - 1)::bigint as slot, null::int as grown_shard
from cut"""


def quality() -> str:
    return rf"""
with own as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
lines as (
  select doc_id, source, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) as line from own),
dup as (
  select doc_id, count(*) - count(distinct line) as n from lines group by 1),
starts as (
  select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as i from own where len(w) >= {WINDOW}),
grams as (
  select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + {WINDOW} - 1], ' ')) as n from starts),
covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from grams where n > 1) group by 1),
normal as (
  select doc_id, source, text, len(regexp_extract_all(line, '{_WORD}')) as n,
    array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), ' ') as line from lines),
common as (
  select source, line from normal group by 1, 2 having count(distinct text) > {LINE_LIMIT}),
removed as (
  select doc_id, sum(n) as n from normal join common using (source, line) group by 1),
facts as (
  select own.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, len(w) - coalesce(removed.n, 0) as words_left
  from own left join dup using (doc_id) left join covered using (doc_id) left join removed using (doc_id)),
base as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from facts)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  words_left::bigint as words_left, not base_failed and 100 * words_left >= {LEAST_LEFT} * n_words as kept
from base"""


def mixing(weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, seed=7) -> str:
    turns = "[" + ",".join(f"{w}::double" for w in weights) + "]"
    return rf"""
with own as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
    case when len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) between 50 and 1000 then 2.0::double else 1.0::double end as own,
    (('0x' || substr(md5('{seed}|' || doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
sizes as (select source, sum(size)::bigint as source_size from own group by 1),
turn as (
  select *, ({turns})[(row_number() over (order by source is null, source) - 1) % {len(weights)} + 1] as weight from sizes),
limits as (select *, source_size * {most}::double as cap, source_size * {most}::double / weight as ratio from turn),
rates as (
  select *, (sum(source_size::double) over () * {share}::double
    - coalesce(sum(cap) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by ratio, source rows between current row and unbounded following) as rate from limits),
chosen as (select (select rate from rates where rate <= ratio order by ratio, source limit 1) as rate),
goals as (
  select source, source_size, case when chosen.rate is null then cap else least(cap, chosen.rate * weight) end as target
  from rates, chosen),
levels as (
  select own.source, own, sum(size)::double as words, any_value(target) as target
  from own join goals on own.source is not distinct from goals.source group by 1, 2 having sum(size) > 0),
rated as (
  select source, own, (target - coalesce(sum(words * {most}::double) over (partition by source order by own desc
      rows between unbounded preceding and 1 preceding), 0.0))
    / sum(words * own) over (partition by source order by own desc rows between current row and unbounded following) as rate from levels),
own_rate as (select source, arg_max(rate, own) filter (rate * own <= {most}::double) as rate from rated group by 1),
hoped as (
  select own.*, source_size, target, coalesce(least(own_rate.rate * own, {most}::double), {most}::double) as e
  from own join goals on own.source is not distinct from goals.source left join own_rate on own.source is not distinct from own_rate.source),
parts as (select *, floor(e)::bigint as certain, e - floor(e) as p from hoped),
wanted as (select source, any_value(target) - sum(certain * size) as wanted from parts group by 1),
ranked as (
  select parts.*, wanted, case when p > 0 then (u / (1 - u)) * ((1 - p) / p) end as rank
  from parts join wanted on parts.source is not distinct from wanted.source),
run as (
  select *, coalesce(sum(size) over (partition by source, rank is null order by rank, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from ranked)
select doc_id, size, source_size, target,
  ((certain + case when rank is not null and before + size / 2.0 <= wanted then 1 else 0 end) * size)::bigint as taken
from run"""


def licenses() -> str:
    phrases = ", ".join(f"({_quote(p)}, {_quote(x)})" for p, x in PHRASES.items())
    texts = ", ".join(f"({i}, {_quote(x)}, {_quote(t)})" for i, (x, t) in enumerate(
        (x, t) for x in sorted(TEMPLATES) for t in TEMPLATES[x]))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with own as (select doc_id, regexp_extract_all({low.format("coalesce(text, '')")}, '{word}') as w from documents),
phrase(p, label) as (values {phrases}),
wording as (select string_split(p, ' ') as pw, label from phrase),
spots as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from own),
base as (
  select doc_id, i - 1 as i, label from spots join wording on w[i] = pw[1] and w[i:i + len(pw) - 1] = pw),
base_sum as (select doc_id, count(*) as n, min(i) as f, max(i) as l, list(distinct label) as labels from base group by 1),
template(t, label, body) as (values {texts}),
cut as (select t, label, regexp_extract_all({low.format("body")}, '{word}') as tw from template),
tgram0 as (
  select t, label, len(tw) as n, i - 1 as pos, tw[i:i + {K} - 1] as run from (select *, unnest(range(1, len(tw) - {K} + 2)) as i from cut)),
tgram1 as (
  select g.*, x.labels = 1 as own from tgram0 g join (select run, count(distinct label) as labels from tgram0 group by 1) x using (run)),
tgram as (
  select g.*, coalesce(x.n_own, 0) as n_own from tgram1 g left join (
    select t, count(distinct p) as n_own from (select t, unnest(range(pos, pos + {K})) as p from tgram1 where own) group by 1) x using (t)),
grams as (select doc_id, i - 1 as place, w[i:i + {K} - 1] as run from spots where i <= len(w) - {K} + 1),
hits as (select doc_id, t, label, n, n_own, own, pos, place, place - pos as d from grams join tgram using (run)),
marks as (
  select *, case when d - lag(d) over (partition by doc_id, t order by d, pos) > {GAP} then 1 else 0 end as opens from hits),
runs as (select *, sum(opens) over (partition by doc_id, t order by d, pos rows unbounded preceding) as r from marks),
parts as (
  select doc_id, t, r, min(place) as low, max(place) as high, min(pos) as low_at, max(pos) as high_at, any_value(n) as n
  from runs group by 1, 2, 3),
before as (
  select *, max(high * 1000000 + high_at) over (partition by doc_id, t order by low, high desc, low_at
    rows between unbounded preceding and 1 preceding) as b, row_number() over (partition by doc_id, t order by low, high desc, low_at) as i
  from parts),
placed as (
  select *, coalesce(high <= b // 1000000, false) as inside, coalesce(low_at > b % 1000000 and low - b // 1000000 - {K} <= n, false) as follows
  from before),
numbered as (
  select *, sum(case when not inside and not follows then 1 else 0 end) over (partition by doc_id, t order by i) as s,
    case when inside then i else 0 end as alone from placed),
covered as (
  select x.*, s, alone from runs x join numbered using (doc_id, t, r)),
words_in as (
  select doc_id, t, s, alone, any_value(label) as label, any_value(n) as n, any_value(n_own) as n_own, count(distinct p) as c,
    count(distinct case when own then p end) as c_own
  from (select *, unnest(range(pos, pos + {K})) as p from covered) group by 1, 2, 3, 4),
cover as (
  select doc_id, label, c / n::double as cover from words_in where n_own > 0 and c_own / n_own::double >= {LEAST_COVER}),
added as (
  select doc_id, list(distinct label) as labels, max(cover) as cover from cover where cover >= {LEAST_COVER} group by 1)
select own.doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.f::bigint as first_word, b.l::bigint as last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), ',') as labels,
  case when b.n > 0 then 1.0::double else coalesce(a.cover, 0.0)::double end as score
from own left join base_sum b using (doc_id) left join added a using (doc_id)"""


def top_k(k: int = 20, every: int = 20, scale: int = 64) -> str:
    return f"""
with good as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
ints as (
  select row_number() over (order by vec_id, v) as r, * from good
  where len(v) = (select len(v) from good group by len(v) order by count(*) desc, len(v) desc limit 1)),
pairs as (
  select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from ints q join ints c on q.vec_id % {every} = 0 and q.r <> c.r),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= {k}"""


def collocations() -> str:
    return r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
split as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
starts as (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from split, (values (1), (2), (3), (4)) as t(k) where len(w) >= k),
counts as (
  select lang, w[i:i + k - 1] as words, count(*)::bigint as f from starts group by 1, 2),
total as (
  select lang, sum(f)::bigint as n from counts where len(words) = 1 group by 1),
candidates as (
  select lang, words, f as a from counts where len(words) > 1 and f >= 30),
cuts as (
  select lang, words, a, unnest(range(1, len(words))) as k from candidates),
scored as (
  select c.lang, c.words, c.a, k, x.f as l, y.f as r, 2000000::hugeint * c.a // (x.f + y.f) as score
  from cuts c join counts x on x.lang = c.lang and x.words = c.words[1:k]
    join counts y on y.lang = c.lang and y.words = c.words[k + 1:len(c.words)]),
lowest as (
  select * from scored qualify row_number() over (partition by lang, words order by score, k) = 1),
sizes as (
  select lang, words, a, unnest(range(2, len(words))) as size from candidates where len(words) > 2),
places as (
  select *, unnest(range(1, len(words) - size + 2)) as p from sizes),
inner_ones as (
  select lang, words[p:p + size - 1] as words, max(a) as longer from places group by 1, 2),
kept as (
  select s.* from lowest s left join inner_ones i on i.lang = s.lang and i.words = s.words
  where coalesce(100::hugeint * i.longer < 80::hugeint * s.a, true)),
ranked as (
  select lang, array_to_string(words, ' ') as phrase, a, l, r, score::bigint as score from kept)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::int as rank, phrase, a, l, r, n, score
from ranked join total using (lang)
qualify rank <= 2000"""
