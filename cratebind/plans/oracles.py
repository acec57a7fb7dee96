"""DuckDB SQL for the catalogue, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.text import JOINERS, JUNK_ARTISTS, NOISE, REMIX, STOP_TOKENS
from .adapters import ENTRIES, STATS, TRACKS

NOISE_RE = "(?i)" + "|".join(NOISE + JOINERS)
JUNK = ", ".join(f"'{a}'" for a in JUNK_ARTISTS)


def clean(x: str) -> str:
    brackets = rf"regexp_replace(replace({x}, '_', ' '), '\s*[\(\[].*?[\)\]]\s*', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({brackets}, '{NOISE_RE}', ' ', 'g'), '\s+', ' ', 'g'), ' .-_')"


def norm(x: str) -> str:
    return f"trim(lower({clean(f"strip_accents(coalesce({x}, ''))")}))"


def base(x: str) -> str:
    return rf"regexp_extract({x}, '([^/\\]*)$', 1)"


def stem(x: str) -> str:
    return rf"regexp_replace({x}, '^(\.*[^.].*)\.[^.]*$', '\1')"


def name(x: str) -> str:
    return clean(stem(base(f"coalesce({x}, '')")))


def after(b: str) -> str:
    return f"case when instr({b}, ' - ') > 0 then trim(substr({b}, instr({b}, ' - ') + 3)) else trim({b}) end"


def before(b: str) -> str:
    return f"case when instr({b}, ' - ') > 0 then trim(substr({b}, 1, instr({b}, ' - ') - 1)) end"


def canon(x: str) -> str:
    return f"trim(regexp_replace({norm(x)}, '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[^a-z0-9]+'), lambda t: length(t) >= 4)"


def parts(x: str) -> str:
    split = rf"string_split_regex(regexp_replace({x}, '(?i)\bfeat(?:\.|uring)?\b|\bcon\b', '&', 'g'), '[,&/;+]+')"
    return f"list_distinct(list_filter(list_transform({split}, lambda p: {norm('p')}), lambda p: p <> ''))"


def bucket(d: str) -> str:
    return f"coalesce((round_even(({d}) / 2, 0) * 2)::int::varchar, '')"


def index_words(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace(regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7F]', '', 'g'), '[_\-]+', ' ', 'g'), '[^\w\s]+', ' ', 'g')"
    return rf"list_sort(list_distinct(list_filter(string_split_regex(lower({plain}), '\s+'), lambda t: length(t) >= 4)))"


def fallback(own: str, title_base: str) -> str:
    junk = rf"({own} = '' or {own} in ({JUNK}) or regexp_matches({own}, '\bvideodj\s*ralph\b'))"
    return f"case when {junk} and coalesce({before(title_base)}, '') <> '' then {norm(before(title_base))} else {own} end"


T = f"""
t0 as ({TRACKS}),
t1 as (select *, {norm('title')} as t_title_norm, {norm('artist')} as own, {name('title')} as b, {base('path')} as t_name from t0),
t2 as (select *, case when {after('b')} <> '' then {after('b')} else coalesce(title, '') end as t_pure, {fallback('own', 'b')} as t_fallback from t1),
t as (
  select track_id, path as t_path, title as t_title, artist as t_artist, duration as t_duration, bitrate as t_bitrate, auto_tags as t_auto, t_title_norm,
         own as t_artist_norm, t_fallback, t_pure, {norm('t_name')} as t_name_norm, {canon('title')} as t_canon, {canon('t_pure')} as t_pure_canon,
         {words('t_title_norm')} as t_title_tokens, {words('own')} as t_artist_tokens, {parts('own')} as t_parts,
         regexp_matches(coalesce(title, ''), '{REMIX}') as t_remix, regexp_matches(t_pure, '{REMIX}') as t_pure_remix from t2)
"""

E = f"""
e0 as ({ENTRIES}),
e1 as (select distinct raw_path, title, artist, duration from e0),
e2 as (select *, sha1(concat_ws('|', coalesce(length(artist) || ':' || artist, '~'), coalesce(length(duration::varchar) || ':' || duration::varchar, '~'), coalesce(length(raw_path) || ':' || raw_path, '~'), coalesce(length(title) || ':' || title, '~'))) as eid,
              {name('title')} as b, {norm('artist')} as own, {base('raw_path')} as name from e1),
e3 as (select *, case when {after('b')} <> '' then {after('b')} else coalesce(title, '') end as pure, {fallback('own', 'b')} as artist_norm from e2),
e4 as (select *, {norm('pure')} as pure_norm, {norm('title')} as title_norm, {norm('name')} as name_norm from e3),
e as (
  select eid, raw_path, title, artist, duration, coalesce(title, '') <> '' or coalesce(artist, '') <> '' as has_tags, pure, artist_norm, own as own_artist, name,
         pure_norm, title_norm, name_norm, {canon('pure')} as canon, {words('pure_norm')} as title_tokens, {words('artist_norm')} as artist_tokens,
         {words('name_norm')} as name_tokens, {parts('artist_norm')} as parts, regexp_matches(coalesce(title, ''), '{REMIX}') as remix,
         regexp_matches(pure, '{REMIX}') as pure_remix, lower(raw_path) like 'netsearch://td%' or regexp_matches(lower(name), '^td\\d{{5,}}$') as service from e4)
"""

P = f"""
post0 as (select track_id, 'title' as token_type, {index_words('title')} as w from t0 union all select track_id, 'artist', {index_words('artist')} from t0
          union all select track_id, 'name', {index_words(stem(base('path')))} from t0),
post as (select track_id, token_type, unnest(w) as token from post0)
"""

RATIO = """
ch as (select a, b, i, j from pairs, range(0, 100) ti(i), range(0, 100) tj(j) where i < length(a) and j < length(b) and substr(a, i::int + 1, 1) = substr(b, j::int + 1, 1)),
cell as materialized (
  select a, b, i, j, count(*) over (partition by a, b, i - j, grp order by i desc) as len
  from (select *, i - row_number() over (partition by a, b, i - j order by i) as grp from ch)),
seg(a, b, alo, ahi, blo, bhi, k) as (
  select a, b, 0::bigint, length(a), 0::bigint, length(b), 0::bigint from pairs
  union all
  select a, b, case h.side when 0 then alo else i + k2 end, case h.side when 0 then i else ahi end,
         case h.side when 0 then blo else j + k2 end, case h.side when 0 then j else bhi end, case h.side when 0 then k2 else 0 end
  from (select s.a, s.b, s.alo, s.ahi, s.blo, s.bhi, c.i, c.j, least(c.len, s.ahi - c.i, s.bhi - c.j) as k2
        from seg s join cell c on c.a = s.a and c.b = s.b and c.i >= s.alo and c.i < s.ahi and c.j >= s.blo and c.j < s.bhi
        qualify row_number() over (partition by s.a, s.b, s.alo, s.ahi, s.blo, s.bhi order by least(c.len, s.ahi - c.i, s.bhi - c.j) desc, c.i, c.j) = 1) z,
       (values (0), (1)) h(side)),
ratios as (
  select p.a, p.b, case when length(p.a) + length(p.b) = 0 then 1.0::double else 2.0::double * m / (length(p.a) + length(p.b)) end as ratio
  from pairs p join (select a, b, sum(k)::double as m from seg group by a, b) using (a, b))
"""

COMPATIBLE = "(artist_norm = '' or t_artist_norm = '' or case when len(parts) = 0 or len(t_parts) = 0 then artist_norm = t_artist_norm else list_has_any(parts, t_parts) end)"
EXPECTED = f"(artist_norm = '' or {COMPATIBLE} or len(list_filter(artist_tokens, lambda w: contains(t_name_norm, w))) > 0)"
SIMILAR = f"(canon <> '' and canon = t_canon and {COMPATIBLE} and coalesce(abs(duration - t_duration) <= 3, false))"

BLOCKS = """
sets as (select distinct title_tokens, artist_tokens from e where has_tags),
th as (select distinct title_tokens, artist_tokens, track_id from (select *, unnest(title_tokens) as token from sets) join post using (token) where token_type = 'title'),
ah as (select distinct title_tokens, artist_tokens, track_id from (select *, unnest(artist_tokens) as token from sets) join post using (token) where token_type = 'artist'),
both_hits as (select * from th intersect select * from ah),
blocks as (
  select * from both_hits
  union
  select h.* from (select * from th union select * from ah) h
  where not exists (select 1 from both_hits x where x.title_tokens = h.title_tokens and x.artist_tokens = h.artist_tokens))
"""


def keys(artist: str, canonical: str, remix: str, d: str, tolerance: int, source: str, columns: str) -> str:
    """Identity keys in order, as rows."""
    span = tolerance + 2
    offsets = ", ".join(map(str, range(-span, span + 1, 2)))
    buckets = f"case when {d} is null then [''] else list_transform([{offsets}], lambda o: {bucket(f'{d} + o')}) end"
    return f"""
    select {columns}, bucket as k_bucket, {remix} as k_remix, {canonical} as k_canon, side.artist as k_artist, min(no * 2 + side.s) as k_no
    from (select *, unnest({buckets}) as bucket, generate_subscripts({buckets}, 1) as no from {source}) x, lateral (select 0 as s, {artist} as artist union all select 1, '') side
    where {canonical} <> '' and not (side.s = 0 and {artist} = '')
    group by all"""


SQL = {
    "best_match_tags": f"""
with recursive {T}, {E}, {P}, {BLOCKS},
c as (select * from e join blocks using (title_tokens, artist_tokens) join t using (track_id) where has_tags),
pairs as (select distinct pure_norm as a, t_title_norm as b from c union select distinct artist_norm, t_artist_norm from c where artist_norm <> '' and t_artist_norm <> ''),
{RATIO},
f as (select c.*, list_has_any(title_tokens, t_title_tokens) as o, len(artist_tokens) > 0 and len(t_artist_tokens) > 0 as n, {COMPATIBLE} as ok from c),
w as (select *, case when not o and n then 5.0 when o and not n then 70.0 else 50.0 end::double as wt, case when not o and n then 70.0 when o and not n then 5.0 else 30.0 end::double as wa,
             case when not o and n then 25.0 when o and not n then 25.0 else 20.0 end::double as wd from f),
s as (select w.*, case when o then rt.ratio * wt else 0 end + case when artist_norm <> '' and t_artist_norm <> '' then case when ok then wa else ra.ratio * wa end else 0 end
             + coalesce(greatest(0::double, 20.0::double - abs(duration - t_duration)) * (wd / 20.0::double), 0) as score
      from w left join ratios rt on rt.a = pure_norm and rt.b = t_title_norm left join ratios ra on ra.a = artist_norm and ra.b = t_artist_norm),
m as (select * from s qualify score = max(score) over (partition by eid) and score >= 50),
g as (select * from m qualify not t_auto or not bool_or(not t_auto) over (partition by eid)),
r as (select eid, track_id, score from g where {EXPECTED} qualify row_number() over (partition by eid order by (remix or not t_remix) desc, t_bitrate desc, track_id) = 1)
select eid, track_id, round(score, 6) as score from r""",
    "ratio_pairs": f"with recursive pairs as (select distinct x.p_name as a, y.p_name as b from part x, (select distinct p_name from part) y), {RATIO} select a, b, ratio from ratios",
    "identity_best": f"""
with {T}, k as ({keys('t_fallback', 't_pure_canon', 't_pure_remix', 't_duration', 0, 't', 'track_id, t_bitrate, t_auto')})
select k_artist, k_canon, k_bucket, k_remix, arg_max(track_id, (t_bitrate, -track_id)) as best_all,
       arg_max(track_id, (t_bitrate, -track_id)) filter (where not t_auto) as best_real
from k group by all""",
    "identity_join": f"""
with {T}, {E}, k as ({keys('t_fallback', 't_pure_canon', 't_pure_remix', 't_duration', 0, 't', 'track_id, t_bitrate, t_auto')}),
best as (select k_artist, k_canon, k_bucket, k_remix, arg_max(track_id, (t_bitrate, -track_id)) as best_all, arg_max(track_id, (t_bitrate, -track_id)) filter (where not t_auto) as best_real from k group by all),
a as ({keys('artist_norm', 'canon', 'pure_remix', 'duration', 3, 'e', 'eid, has_tags')}),
x as (select eid, k_no, unnest([best_real, best_all]) as track_id, unnest([0, 1]) as tier from a join best using (k_artist, k_canon, k_bucket, k_remix) where has_tags)
select eid, track_id from x join e using (eid) join t using (track_id) where {SIMILAR}
qualify row_number() over (partition by eid order by tier, k_no) = 1""",
    "similar_tags": f"with {T}, {E} select eid, count(*) as pairs, max(t_bitrate) as best_bitrate from e join t on canon = t_canon where {SIMILAR} group by eid",
    "token_postings": f"with t0 as ({TRACKS}), {P} select token, token_type, track_id from post",
    "token_document_frequency": f"select token, count(*) as n from (select unnest({index_words('text')}) as token from documents) group by token",
    "group_intersection": f"with {T}, {E}, {P}, {BLOCKS} select list_sort(list_distinct(title_tokens)) as title_tokens, list_sort(list_distinct(artist_tokens)) as artist_tokens, count(distinct track_id) as tracks from blocks group by all",
    "route_valid": f"with t0 as ({TRACKS}), e0 as ({ENTRIES}) select playlist, pos, t0.path is not null as route_valid, coalesce(t0.bitrate, 0) as bitrate from e0 left join t0 on t0.path = raw_path",
    "normalize_text": f"select doc_id, md5({norm('text')}) as digest, len({words(norm('text'))}) as n_tokens from documents",
    "canonical_titles": f"with {T} select track_id, t_canon, t_pure, t_fallback, t_remix, list_sort(t_parts) as t_parts from t",
    "entry_forms": f"with {E} select eid, pure, artist_norm, canon, has_tags, remix, service, list_sort(list_distinct(title_tokens)) as title_tokens, list_sort(parts) as parts from e",
    "duration_buckets": f"select p_partkey, {bucket('p_retailprice / 10')} as bucket, list_distinct(list_transform([-5, -3, -1, 1, 3, 5], lambda o: {bucket('p_retailprice / 10 + o')})).list_sort() as neighbours from part",
    "learned_upsert": f"""
with {E}, r as (select eid, playlist, pos, raw_path as path, cast(playlist % 320 as int) as bitrate, name_norm, artist_norm, canon, e.duration from e0 join e using (raw_path)
  where e0.title is not distinct from e.title and e0.artist is not distinct from e.artist and e0.duration is not distinct from e.duration),
k as (select *, unnest(list_distinct(list_filter([eid, case when name_norm <> '' then 'base|' || name_norm end,
  case when canon <> '' and artist_norm <> '' then 'at|' || artist_norm || '|' || canon || '|' || {bucket('duration')} end, case when canon <> '' then 't|' || canon || '|' || {bucket('duration')} end], lambda x: x is not null))) as key from r)
select key, arg_max(path, (playlist, pos)) as path, arg_max(bitrate, (playlist, pos)) as bitrate from k group by key""",
    "snapshot_diff": """
with o as (select 'f/' || o_orderkey as path, cast(floor(o_totalprice) as bigint) as size, cast(o_orderkey as double) as mtime from orders where o_orderkey % 10 <> 0),
n as (select 'f/' || o_orderkey as path, cast(floor(o_totalprice) as bigint) + case when o_orderkey % 5 = 1 then 1 else 0 end as size, cast(o_orderkey as double) as mtime from orders where o_orderkey % 7 <> 0)
select coalesce(n.path, o.path) as path, n.size, n.mtime, case when o.path is null then 'added' when n.path is null then 'deleted' when o.size = n.size then 'reused' else 'changed' end as status
from o full outer join n on o.path = n.path""",
    "library_stats": f"""
with t0 as ({TRACKS}) select count(*) as total, count(*) filter (where title is not null or artist is not null) as with_tags, count(*) filter (where title is null and artist is null) as without_tags,
  count(*) filter (where auto_tags) as auto_tags, count(*) filter (where bitrate > 0) as with_bitrate, count(*) filter (where duration > 0) as with_duration from t0""",
    "run_summary": f"""
with s as ({STATS}) select count(*) as entries, count(*) filter (where found) as found, count(*) filter (where not found) as missing, count(*) filter (where full_scan) as full_scans,
  count(*) filter (where not full_scan) as scans_avoided, round(avg(elapsed), 6) as mean, max(elapsed) as slowest, quantile_cont(elapsed, 0.5) as p50, quantile_cont(elapsed, 0.95) as p95, max(index_size) as index_size from s""",
    "phase_summary": f"with s as ({STATS}) select phase, count(*) as entries, round(sum(elapsed), 4) as total, round(avg(elapsed), 6) as mean, quantile_cont(elapsed, 0.95) as p95, max(elapsed) as slowest from s group by phase",
    "slowest_entries": f"with s as ({STATS}) select seq, phase, elapsed from s order by elapsed desc, seq limit 10",
    "playlist_status": """
with s as (select l_orderkey as playlist, case l_returnflag when 'R' then 'found' when 'N' then 'missing' else 'invalid' end as status from lineitem)
select playlist, count(*) as total, count(*) filter (where status = 'found') as found, count(*) filter (where status = 'manual') as manual, count(*) filter (where status = 'missing') as missing,
  count(*) filter (where status = 'invalid') as invalid, floor(count(*) filter (where status in ('found', 'manual', 'missing')) / count(*)::double * 100)::int as progress from s group by playlist""",
    "carry_forward": """
with u as (select conv_id, turn, role = 'assistant' as media, case when role = 'user' then 'u' || turn end as meta from conversations where role in ('user', 'assistant')),
g as (select *, coalesce(sum(media::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::int as pos from u)
select conv_id as playlist, pos, arg_max(meta, turn) filter (where meta is not null) as title, max(case when media then turn end) as turn from g group by conv_id, pos having max(case when media then turn end) is not null""",
    "meta_lines": f"""
with t0 as ({TRACKS}) select track_id, '#EXTVDJ:<filesize>' || track_id || '</filesize>' || case when coalesce(artist, '') <> '' then '<artist>' || artist || '</artist>' else '' end
  || '<title>' || title || '</title><songlength>' || printf('%.3f', duration) || '</songlength>' as line from t0""",
    "media_lines": r"""
select page_id, regexp_matches(lower(trim(url)), '\.(mp3|mp4|m4a|flac|wav|wma|aac|webm|ogg|mkv|avi)$') and not regexp_matches(url, '[<>]') as media, trim(regexp_extract(html, '(?i)<title>(.*?)</title>', 1)) as title from pages""",
    "output_paths": r"""
with p as (select 'C:/lists/' || p_brand || '/' || p_name || case p_size % 3 when 0 then '_actualizada' when 1 then '_actualizada_actualizada' else '' end || '.m3u' as path from part)
select path, regexp_replace(path, '[^/\\]*$', '') || regexp_replace(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', ''), '(_actualizada)+$', '') || '_actualizada.m3u' as output from p""",
    "selective_filter": f"with t0 as ({TRACKS}), e0 as ({ENTRIES}) select playlist, pos from e0 left join t0 on t0.path = raw_path where t0.path is null or t0.bitrate < 320",
    "output_rows": f"""
with t0 as ({TRACKS}), e0 as ({ENTRIES})
select playlist, pos, '#EXTVDJ:' || case when coalesce(t0.artist, '') <> '' then '<artist>' || t0.artist || '</artist>' when coalesce(e0.artist, '') <> '' then '<artist>' || e0.artist || '</artist>' else '' end
  || '<title>' || t0.title || '</title><songlength>' || printf('%.3f', t0.duration) || '</songlength>' as meta, raw_path as path
from e0 join t0 on t0.path = raw_path""",
}

ALIAS_FIT = f"(canon <> '' and artist_norm <> '' and canon = t_canon and ((coalesce(t_artist, '') <> '' and {COMPATIBLE}) or contains(t_name_norm, artist_norm)) and coalesce(abs(duration - t_duration) <= 3, true))"
BEST = "qualify row_number() over (partition by eid order by (not t_auto) desc, (not t_remix) desc, t_bitrate desc, track_id) = 1"
IDENTITY = f"""
ik as ({keys('t_fallback', 't_pure_canon', 't_pure_remix', 't_duration', 0, 't', 'track_id, t_bitrate, t_auto')}),
ib as (select k_artist, k_canon, k_bucket, k_remix, arg_max(track_id, (t_bitrate, -track_id)) as best_all, arg_max(track_id, (t_bitrate, -track_id)) filter (where not t_auto) as best_real from ik group by all),
ia as ({keys('artist_norm', 'canon', 'pure_remix', 'duration', 3, 'e', 'eid, has_tags')}),
ix as (select eid, k_no, unnest([best_real, best_all]) as track_id, unnest([0, 1]) as tier from ia join ib using (k_artist, k_canon, k_bucket, k_remix) where has_tags),
im as (select eid, track_id, t_path from ix join e using (eid) join t using (track_id) where {SIMILAR} qualify row_number() over (partition by eid order by tier, k_no) = 1)
"""
OWN_COMPATIBLE = f"(own_artist = '' or t_artist_norm = '' or case when len({parts('own_artist')}) = 0 or len(t_parts) = 0 then own_artist = t_artist_norm else list_has_any({parts('own_artist')}, t_parts) end)"
MEMORY = f"""
f0 as (select *, {OWN_COMPATIBLE} as ok from found),
pairs as (select distinct title_norm as a, t_title_norm as b from f0 where has_tags and title_norm <> '' and t_title_norm <> ''
  union select distinct own_artist, t_artist_norm from f0 where has_tags and own_artist <> '' and t_artist_norm <> '' and not ok
  union select distinct name_norm, t_name_norm from f0 where not has_tags),
{RATIO},
scored as (
  select f0.*, coalesce(rn.ratio, 0) * 100 as plain_name,
         case when has_tags then coalesce(rt.ratio, 0) * 100 * 0.6::double + case when ok then 100.0::double else coalesce(ra.ratio, 0) * 100 end * 0.4::double
              when list_has_any(name_tokens, {words('t_name_norm')}) then coalesce(rn.ratio, 0) * 100 else 0 end as score
  from f0 left join ratios rt on has_tags and rt.a = title_norm and rt.b = t_title_norm left join ratios ra on has_tags and not ok and ra.a = own_artist and ra.b = t_artist_norm
  left join ratios rn on not has_tags and rn.a = name_norm and rn.b = t_name_norm)
"""


def manual_keys(label: str) -> str:
    slashed = rf"trim(replace({label}, '\\', '/'))"
    last = f"case when {base(slashed)} <> '' then {base(slashed)} else {slashed} end"
    return f"['exact|' || trim({label}), 'base|' || {last}, 'norm|' || trim(lower(strip_accents({last})))]"


def learned(path_norm: str) -> str:
    return f"""[case when {path_norm} <> '' then 'base|' || {path_norm} end, case when canon <> '' and artist_norm <> '' then 'at|' || artist_norm || '|' || canon || '|' || {bucket('duration')} end,
      case when canon <> '' then 't|' || canon || '|' || {bucket('duration')} end]"""


SQL |= {
    "similar_upgrade": f"with {T}, {E} select eid, track_id, t_bitrate from e join t on canon = t_canon where {SIMILAR} {BEST}",
    "alias_upgrade": f"with {T}, {E}, {P}, {BLOCKS} select eid, track_id, t_bitrate from e join blocks using (title_tokens, artist_tokens) join t using (track_id) where has_tags and {ALIAS_FIT} {BEST}",
    "derived_equality": f"""
with {T}, {E}, {P}, c0 as (select *, {name('name')} as nb from e), c1 as (select *, coalesce({norm(before('nb'))}, '') as named, {norm(after('nb'))} as titled from c0),
c as (select * from c1 join t on t_title_norm = titled and (named = '' or t_artist_norm = named)
      where exists (select 1 from post where post.track_id = t.track_id and token_type in ('name', 'title') and list_contains(name_tokens, token))),
g as (select * from c qualify not t_auto or not bool_or(not t_auto) over (partition by eid))
select eid, track_id, t_bitrate from g qualify row_number() over (partition by eid order by (regexp_matches(name, '{REMIX}') or not t_remix) desc, t_bitrate desc, track_id) = 1""",
    "soft_top5": f"""
with recursive {T}, {E}, a as (select * from e where service and pure_norm <> ''), pairs as (select distinct pure_norm as a, t_title_norm as b from a, (select distinct t_title_norm from t where t_title_norm <> '')), {RATIO},
r as (select eid, track_id, ratio * 100 as score, row_number() over (partition by eid order by ratio * 100 desc, t_bitrate desc, track_id)::int as rank
      from a join ratios on ratios.a = pure_norm and ratio * 100 >= 60 join t on t_title_norm = b where coalesce(abs(duration - t_duration) <= 15, true))
select eid, rank, track_id, score from r where rank <= 5""",
    "manual_priority_join": f"""
with recursive {T}, {E},
ch0 as (select raw_path as label, min(title) as title from e0 where pos % 7 = 0 and title is not null group by raw_path),
manual as (select key, min(path) as chosen from (select unnest({manual_keys('label')}) as key, path from ch0 join (select title, min(path) as path from t0 group by title) using (title)) group by key),
l0 as (select *, list_filter([raw_path, name, trim(coalesce(artist, '') || ' - ' || coalesce(title, ''), ' -')], lambda x: x <> '') as ls from e),
l1 as (select *, unnest(ls) as label, generate_subscripts(ls, 1) - 1 as label_no from l0),
l2 as (select *, unnest({manual_keys('label')}) as key, unnest([0, 1, 2]) as key_no from l1),
l3 as (select * from l2 join manual using (key) qualify row_number() over (partition by eid, label_no order by key_no) = 1),
found as (select * from l3 join t on lower(chosen) = lower(t_path)), {MEMORY}
select eid, track_id, label_no::int as label_no, round(score, 6) as score from scored where case when has_tags then score >= 50 else plain_name >= 50 end
qualify row_number() over (partition by eid order by label_no) = 1""",
    "learned_priority_join": f"""
with recursive {T}, {E}, {IDENTITY},
k0 as (select t_path as path, unnest(list_filter(list_concat([eid], {learned('name_norm')}), lambda x: x is not null)) as key from im join e using (eid)),
known as (select key, min(path) as chosen from k0 group by key),
a0 as (select *, list_filter(list_concat({learned('name_norm')}, [eid]), lambda x: x is not null) as ks from e),
a1 as (select *, unnest(ks) as key, generate_subscripts(ks, 1) as prio from a0),
a2 as (select * from a1 join known using (key) qualify row_number() over (partition by eid order by prio) = 1),
found as (select *, case when key = eid then 'exact' else 'learned' end as how from a2 join t on lower(chosen) = lower(t_path)), {MEMORY}
select eid, track_id, how as "by", round(score, 6) as score from scored where score >= case when how = 'exact' then 80 else 60 end""",
}

VARIANT = "case p_size % 3 when 0 then p_type || ' & ' || p_brand when 1 then p_brand || ' y ' || p_type else 'The ' || p_type || ' ' || p_brand end"
STOPS = ", ".join(f"'{w}'" for w in STOP_TOKENS)


def alias_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7F]', '', 'g')), '[^\w\s&+]', ' ', 'g'), '\s+', ' ', 'g'))"


ALIAS = f"""
v0 as (select p_partkey as track_id, {VARIANT} as raw, {alias_norm('p_name')} as title, (150 + p_partkey % 20)::bigint as seconds from part),
v1 as (select *, {alias_norm('raw')} as variant from v0),
v as (select *, array_to_string(list_sort(list_filter(string_split(variant, ' '), lambda w: w <> '' and not list_contains([{STOPS}], w))), ' ') as signature from v1 where variant <> ''),
cnt as (select signature, variant, count(*) as occurrences, min(track_id) as seen from v where signature <> '' group by all),
disp as (select variant, arg_max(raw, (n, -seen)) as display from (select variant, raw, count(*) as n, min(track_id) as seen from v group by all) group by variant),
sh as (select *, length(regexp_replace(display, '[\\x00-\\x7F]', '', 'g')) as fo, len(list_filter(string_split(trim(display), ' '), lambda w: w <> '')) as nw from cnt join disp using (variant)),
best as (select signature, arg_max(variant, (occurrences, fo, nw, -seen)) as canonical, arg_max(display, (occurrences, fo, nw, -seen)) as canonical_display from sh group by signature having count(*) > 1),
grp as (select sh.signature, variant, display, occurrences, canonical, canonical_display from sh join best using (signature))
"""

SQL["alias_groups"] = f"with {ALIAS} select * from grp"
SQL["alias_suggestions"] = f"""
with recursive {ALIAS}, pairs as (select distinct variant as a, canonical as b from grp where variant <> canonical), {RATIO},
tog as (select distinct x.variant, y.variant as canonical from v x join v y on x.title = y.title and x.seconds = y.seconds and x.title <> ''),
j as (select g.*, ratio, list_distinct(string_split(g.variant, ' ')) as x, list_distinct(string_split(g.canonical, ' ')) as y, tog.variant is not null as together
      from grp g join ratios on a = g.variant and b = g.canonical left join tog on tog.variant = g.variant and tog.canonical = g.canonical)
select variant as variant_norm, canonical as canonical_norm, display as variant, canonical_display as canonical, occurrences,
       round(least(0.6::double, ratio * 0.6::double) + least(0.3::double, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double * 0.3::double) + case when together then 0.08::double else 0 end, 6) as score
from j"""

SQL["candidates_top12"] = f"""
with recursive {T}, {E},
said as (select distinct md5(concat_ws('|', pure_norm, artist_norm, coalesce(duration::varchar, '~'), (not remix and coalesce(title, '') <> '')::varchar)) as sid, pure_norm, artist_norm, title_tokens, artist_tokens, parts, duration,
  not remix and coalesce(title, '') <> '' as plain from e where has_tags),
c as (select *, list_has_any(title_tokens, t_title_tokens) as o, len(artist_tokens) > 0 and len(t_artist_tokens) > 0 as n, {COMPATIBLE} as ok from said, t where {EXPECTED}),
untagged as (select distinct name_norm, name_tokens from e where not has_tags),
nc as (select name_norm, track_id, t_name_norm, t_bitrate from untagged, t where list_has_any(name_tokens, {words('t_name_norm')})),
pairs as (select distinct pure_norm as a, t_title_norm as b from c where o union select distinct artist_norm, t_artist_norm from c where artist_norm <> '' and t_artist_norm <> '' and not ok
  union select distinct name_norm, t_name_norm from nc),
{RATIO},
w as (select *, case when not o and n then 5.0 when o and not n then 70.0 else 50.0 end::double as wt, case when not o and n then 70.0 when o and not n then 5.0 else 30.0 end::double as wa,
             case when not o and n then 25.0 when o and not n then 25.0 else 20.0 end::double as wd from c),
s as (select sid, plain, track_id, t_remix, t_bitrate, case when o then rt.ratio * wt else 0 end + case when artist_norm <> '' and t_artist_norm <> '' then case when ok then wa else ra.ratio * wa end else 0 end
             + coalesce(greatest(0::double, 20.0::double - abs(duration - t_duration)) * (wd / 20.0::double), 0) as score
      from w left join ratios rt on rt.a = pure_norm and rt.b = t_title_norm left join ratios ra on ra.a = artist_norm and ra.b = t_artist_norm),
kept as (select * from (select *, bool_or(not t_remix) over (partition by sid) as other from s where score > 0) where not plain or not t_remix or not other),
top as (select sid, track_id, score, row_number() over (partition by sid order by round(score, 2) desc, t_bitrate desc, track_id)::int as rank from kept qualify rank <= 12),
ntop as (select name_norm, track_id, ratio * 100 as score, row_number() over (partition by name_norm order by round(ratio * 100, 2) desc, t_bitrate desc, track_id)::int as rank
         from nc join ratios on a = name_norm and b = t_name_norm where ratio > 0 qualify rank <= 12)
select eid, rank, track_id, round(score, 6) as score from e join top on sid = md5(concat_ws('|', pure_norm, artist_norm, coalesce(duration::varchar, '~'), (not remix and coalesce(title, '') <> '')::varchar)) where has_tags
union all
select eid, rank, track_id, round(score, 6) from e join ntop using (name_norm) where not has_tags"""


def ratio(prefix: str) -> str:
    """The ratio of all pairs of the relation <prefix>pairs as <prefix>ratios."""
    out = RATIO
    for name in ("pairs", "ratios"):
        out = out.replace(name, prefix + name)
    for name in ("ch", "cell", "seg"):
        out = out.replace(f"\n{name} as", f"\n{prefix}{name} as").replace(f"\n{name}(", f"\n{prefix}{name}(").replace(f" from {name}", f" from {prefix}{name}").replace(f"from {name} ", f"from {prefix}{name} ").replace(f"join {name} ", f"join {prefix}{name} ")
    return out


FOREIGN_PARTS = f"list_filter(list_transform(string_split({clean(stem(base('t_path')))}, ' - '), lambda p: trim(p)), lambda p: p <> '')"


def by_name(asked: str) -> str:
    """The choice of the name phase for the entries of a relation (eid), as nm(eid, track_id, score)."""
    return f"""
na as (select e.* from e join {asked} using (eid)),
nset as (select distinct name_norm, name_tokens from na),
nhit as (select distinct name_norm, name_tokens, track_id from (select *, unnest(name_tokens) as token from nset) join post using (token) where token_type in ('name', 'title')),
nc as (select nhit.*, t_name_norm from nhit join t using (track_id) where list_has_any(name_tokens, {words('t_name_norm')}) and least(length(name_norm), length(t_name_norm)) * 200.0 >= 69.9 * (length(name_norm) + length(t_name_norm))),
npairs as (select distinct name_norm as a, t_name_norm as b from nc),
{ratio('n')},
ntie as (select name_norm, track_id, ratio * 100 as score from nc join nratios on a = name_norm and b = t_name_norm where ratio * 100 >= 70 qualify ratio = max(ratio) over (partition by name_norm)),
nx as (select na.*, t.*, score, {FOREIGN_PARTS} as fp from na join ntie using (name_norm) join t using (track_id) where {EXPECTED}),
ny as (select *, pure <> '' and not pure_remix and len(fp) > 2 and len(list_filter({words(norm("array_to_string(fp[3:], ' ')"))}, lambda w: not list_contains(title_tokens, w))) > 0 as foreign_ from nx),
nz as (select * from ny qualify not foreign_ or (artist_norm = '' and not bool_or(not foreign_) over (partition by eid))),
nm as (select eid, track_id, score, t_path, t_bitrate from nz qualify row_number() over (partition by eid order by (regexp_matches(name, '{REMIX}') or not t_remix) desc, t_bitrate desc, track_id) = 1)
"""


TAGGED = f"""
c as (select * from e join blocks using (title_tokens, artist_tokens) join t using (track_id) where has_tags),
pairs as (select distinct pure_norm as a, t_title_norm as b from c union select distinct artist_norm, t_artist_norm from c where artist_norm <> '' and t_artist_norm <> ''
          union select distinct pure_norm, t_title_norm from e, (select distinct t_title_norm from t where t_title_norm <> '') where service and pure_norm <> ''),
{RATIO},
f as (select c.*, list_has_any(title_tokens, t_title_tokens) as o, len(artist_tokens) > 0 and len(t_artist_tokens) > 0 as n, {COMPATIBLE} as ok from c),
w as (select *, case when not o and n then 5.0 when o and not n then 70.0 else 50.0 end::double as wt, case when not o and n then 70.0 when o and not n then 5.0 else 30.0 end::double as wa,
             case when not o and n then 25.0 when o and not n then 25.0 else 20.0 end::double as wd from f),
s as (select w.*, case when o then rt.ratio * wt else 0 end + case when artist_norm <> '' and t_artist_norm <> '' then case when ok then wa else ra.ratio * wa end else 0 end
             + coalesce(greatest(0::double, 20.0::double - abs(duration - t_duration)) * (wd / 20.0::double), 0) as score
      from w left join ratios rt on rt.a = pure_norm and rt.b = t_title_norm left join ratios ra on ra.a = artist_norm and ra.b = t_artist_norm),
m as (select * from s qualify score = max(score) over (partition by eid) and score >= 50),
g as (select * from m qualify not t_auto or not bool_or(not t_auto) over (partition by eid)),
r as (select eid, track_id, score from g where {EXPECTED} qualify row_number() over (partition by eid order by (remix or not t_remix) desc, t_bitrate desc, track_id) = 1)
"""

SQL["best_match_name"] = f"""
with recursive {T}, {E}, {P}, {BLOCKS}, {TAGGED},
asked as (select eid from e where not (service and has_tags) and not exists (select 1 from r where r.eid = e.eid and not e.service)),
{by_name('asked')}
select eid, track_id, round(score, 6) as score from nm"""

# the whole cascade: what each phase would choose for an entry, and the first phase that chooses
CASCADE = f"""
with recursive {T}, {E}, {P}, {BLOCKS}, {TAGGED}, {IDENTITY},
valid as (select eid, any_value(raw_path) as path, max(t_bitrate) as bitrate from e join t on lower(raw_path) = lower(t_path) where not service group by eid),
near0 as (select eid, t_path, t_bitrate from c where {SIMILAR} {BEST}),
better as (select coalesce(im.eid, near0.eid) as eid, coalesce(im.t_path, near0.t_path) as path, case when im.eid is not null then it.t_bitrate else near0.t_bitrate end as bitrate
           from im join t it using (track_id) full join near0 on near0.eid = im.eid),
ch0 as (select raw_path as label, min(title) as title from e0 where pos % 7 = 0 and title is not null group by raw_path),
manual as (select key, min(path) as chosen from (select unnest({manual_keys('label')}) as key, path from ch0 join (select title, min(path) as path from t0 group by title) using (title)) group by key),
lb0 as (select *, list_filter([raw_path, name, trim(coalesce(artist, '') || ' - ' || coalesce(title, ''), ' -')], lambda x: x <> '') as ls from e),
lb1 as (select *, unnest(ls) as label, generate_subscripts(ls, 1) - 1 as label_no from lb0),
lb2 as (select *, unnest({manual_keys('label')}) as key, unnest([0, 1, 2]) as key_no from lb1),
lb3 as (select * from lb2 join manual using (key) qualify row_number() over (partition by eid, label_no order by key_no) = 1),
kn0 as (select t0.path, unnest(list_filter(list_concat([eid], {learned('name_norm')}), lambda x: x is not null)) as key
        from (select distinct e.* from e join e0 on e.raw_path = e0.raw_path and e.title is not distinct from e0.title and e.artist is not distinct from e0.artist and e.duration is not distinct from e0.duration where e0.pos % 5 = 2 and length(e.raw_path) % 3 = 0)
        join (select title, min(path) as path from t0 group by title) t0 using (title)),
known as (select key, min(path) as chosen from kn0 group by key),
le0 as (select *, list_filter(list_concat({learned('name_norm')}, [eid]), lambda x: x is not null) as ks from e),
le1 as (select *, unnest(ks) as key, generate_subscripts(ks, 1) as prio from le0),
le2 as (select * from le1 join known using (key) qualify row_number() over (partition by eid order by prio) = 1),
found as (select * exclude (ls, label, key_no, key, chosen, label_no), 'manual' as how, label_no from lb3 join t on lower(chosen) = lower(t_path)
          union all by name select * exclude (ks, key, prio, chosen), case when key = eid then 'exact' else 'learned' end as how, 0 as label_no from le2 join t on lower(chosen) = lower(t_path)),
{MEMORY.replace('f0 as', 'mf0 as').replace('f0', 'mf0').replace('mmf0', 'mf0').replace(RATIO, ratio('m')).replace('pairs as (select distinct title_norm', 'mpairs as (select distinct title_norm').replace('left join ratios', 'left join mratios').replace('scored as', 'mscored as')},
mem as (select eid, how, t_path, t_bitrate from mscored where case how when 'manual' then case when has_tags then score >= 50 else plain_name >= 50 end when 'exact' then score >= 80 else score >= 60 end
        qualify row_number() over (partition by eid, how = 'manual' order by label_no, track_id) = 1),
remembered as (select mem.eid, mem.how, case when better.bitrate > mem.t_bitrate then better.path else mem.t_path end as path, case when better.bitrate > mem.t_bitrate then better.bitrate else mem.t_bitrate end as bitrate
               from mem left join better using (eid)),
so as (select e.*, t.*, ratio * 100 as sim from e join ratios on a = pure_norm and ratio * 100 >= 60 join t on t_title_norm = b
       where service and pure_norm <> '' and coalesce(abs(duration - t_duration) <= 15, true) and not exists (select 1 from m where m.eid = e.eid)
       qualify row_number() over (partition by eid order by ratio * 100 desc, t_bitrate desc, track_id) <= 5),
sg as (select * from so qualify not t_auto or not bool_or(not t_auto) over (partition by eid)),
sr as (select eid, track_id from sg where has_tags and (len(title_tokens) > 0 or len(artist_tokens) > 0) and {EXPECTED} qualify row_number() over (partition by eid order by (remix or not t_remix) desc, t_bitrate desc, track_id) = 1),
wide as (select eid, t_path, t_bitrate, t_remix, t_artist_norm from c where {ALIAS_FIT.replace('<= 3', '<= 15')} {BEST}),
tight as (select eid, t_path, t_bitrate, t_remix, t_artist_norm from c where {ALIAS_FIT} {BEST}),
nr as (select eid, t_path, t_bitrate, t_remix, t_artist_norm from c where {SIMILAR} {BEST}),
row_ as (select eid, {{'p': t_path, 'b': t_bitrate, 'x': t_remix, 'a': t_artist_norm}} as o from t join (select eid, track_id from r union all select eid, track_id from sr) using (track_id)),
j0 as (select e.eid, artist_norm, remix, row_.o as now_, {{'p': nr.t_path, 'b': nr.t_bitrate, 'x': nr.t_remix, 'a': nr.t_artist_norm}} as ne, {{'p': wide.t_path, 'b': wide.t_bitrate, 'x': wide.t_remix, 'a': wide.t_artist_norm}} as wi,
              {{'p': tight.t_path, 'b': tight.t_bitrate, 'x': tight.t_remix, 'a': tight.t_artist_norm}} as ti
       from row_ join e using (eid) left join nr on nr.eid = e.eid left join wide on wide.eid = e.eid left join tight on tight.eid = e.eid),
j1 as (select * replace (case when ne.b > now_.b then ne else now_ end as now_) from j0),
j2 as (select * replace (case when not remix and now_.x and not wi.x and wi.b >= now_.b then wi else now_ end as now_) from j1),
tags as (select eid, case when (now_.b < 320 or (artist_norm <> '' and now_.a <> artist_norm)) and (ti.b > now_.b or (ti.p is not null and artist_norm <> '' and now_.a <> artist_norm)) then ti else now_ end as o from j2),
open_ as (select eid from e where not (service and has_tags) and eid not in (select eid from valid union all select eid from remembered union all select eid from im union all select eid from tags)),
{by_name('open_')},
dq0 as (select *, {name('name')} as nb from e join open_ using (eid)), dq1 as (select *, coalesce({norm(before('nb'))}, '') as named, {norm(after('nb'))} as titled from dq0),
dq as (select * from dq1 join t on t_title_norm = titled and (named = '' or t_artist_norm = named)
       where exists (select 1 from post where post.track_id = t.track_id and token_type in ('name', 'title') and list_contains(name_tokens, token))),
dg as (select * from dq qualify not t_auto or not bool_or(not t_auto) over (partition by eid)),
dr as (select eid, t_path, t_bitrate from dg qualify row_number() over (partition by eid order by (regexp_matches(name, '{REMIX}') or not t_remix) desc, t_bitrate desc, track_id) = 1),
names as (select nm.eid, case when dr.t_bitrate > nm.t_bitrate then dr.t_path else nm.t_path end as path, case when dr.t_bitrate > nm.t_bitrate then dr.t_bitrate else nm.t_bitrate end as bitrate from nm left join dr using (eid)),
every as (select eid, 0 as no, 'valid_path' as phase, path, bitrate from valid union all select eid, 1, 'memory_manual', path, bitrate from remembered where how = 'manual'
          union all select eid, 2, 'memory_' || how, path, bitrate from remembered where how <> 'manual' union all select eid, 3, 'identity', t_path, t_bitrate from im join t using (track_id, t_path)
          union all select eid, 4, 'tags', o.p, o.b from tags union all select eid, 5, 'name', path, bitrate from names
          union all select eid, 6, case when service and has_tags then 'service_unmatched' else 'unmatched' end, null, null from e),
first_ as (select * from every qualify row_number() over (partition by eid order by no) = 1),
placed as (select e0.playlist, e0.pos, e.eid from e0 join e on e.raw_path = e0.raw_path and e.title is not distinct from e0.title and e.artist is not distinct from e0.artist and e.duration is not distinct from e0.duration)
"""
SQL["cascade_results"] = f"{CASCADE} select playlist, pos, phase, path is not null as found, path, bitrate from placed join first_ using (eid)"

SQL |= {
    "entry_keys": f"""
with {E}, k as (select eid, list_filter({learned('name_norm')}, lambda x: x is not null) as ks from e)
select eid, unnest(generate_series(0, len(ks) - 1))::int as n, unnest(ks) as key from k""",
    "deleted_entries": """
select 'f/' || o_orderkey as path, cast(floor(o_totalprice) as bigint) as size from orders where o_orderkey % 10 <> 0 and o_orderkey % 7 = 0""",
    "bracket_noise_strip": f"""
with t0 as ({TRACKS}), x as (select title as text from t0 union select regexp_extract(html, '(?i)<title>(.*?)</title>', 1) from pages) select text, {clean('text')} as plain from x""",
    "jaccard_tokens": f"""
with {ALIAS}, w as (select variant, canonical, list_distinct(string_split(variant, ' ')) as x, list_distinct(string_split(canonical, ' ')) as y from grp)
select variant, canonical, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double, 9) as jaccard from w""",
    "foreign_compound": f"""
with {E}, n as (select distinct 'Mix - ' || name as t_path, pure, title_tokens from e where has_tags), f as (select *, {FOREIGN_PARTS} as fp from n)
select t_path as name, pure, len(fp) > 2 and len(list_filter({words(norm("array_to_string(fp[3:], ' ')"))}, lambda w: not list_contains(title_tokens, w))) > 0 as alien from f""",
    "choice_scores": f"""
with recursive {T}, {E},
c as (select e.*, t.* from e join (select title, min(path) as chosen from t0 group by title) using (title) join t on t_path = chosen where has_tags),
nc as (select e.*, t.* from e join (select {norm(base('path'))} as name_norm, min(path) as chosen from t0 group by 1) using (name_norm) join t on t_path = chosen where not has_tags),
pairs as (select distinct pure_norm as a, t_title_norm as b from c union select distinct artist_norm, t_artist_norm from c where artist_norm <> '' and t_artist_norm <> '' union select distinct name_norm, t_name_norm from nc),
{RATIO},
f as (select c.*, list_has_any(title_tokens, t_title_tokens) as o, len(artist_tokens) > 0 and len(t_artist_tokens) > 0 as n, {COMPATIBLE} as ok from c),
w as (select *, case when not o and n then 5.0 when o and not n then 70.0 else 50.0 end::double as wt, case when not o and n then 70.0 when o and not n then 5.0 else 30.0 end::double as wa,
             case when not o and n then 25.0 when o and not n then 25.0 else 20.0 end::double as wd from f)
select eid, track_id, round(case when o then rt.ratio * wt else 0 end + case when artist_norm <> '' and t_artist_norm <> '' then case when ok then wa else ra.ratio * wa end else 0 end
       + coalesce(greatest(0::double, 20.0::double - abs(duration - t_duration)) * (wd / 20.0::double), 0), 2) as score
from w left join ratios rt on rt.a = pure_norm and rt.b = t_title_norm left join ratios ra on ra.a = artist_norm and ra.b = t_artist_norm
union all
select eid, track_id, round(case when list_has_any(name_tokens, {words('t_name_norm')}) then ratio * 100 else 0 end, 2) from nc join ratios on a = name_norm and b = t_name_norm""",
}

# the same without remembered matches, counted by phase; candidates are what the blocks of the phase that found an entry hold
SQL["cascade_phase_histogram"] = f"""{CASCADE.replace('from kn0 group by key)', 'from kn0 where false group by key)')},
tag_n as (select title_tokens, artist_tokens, count(*) as n from blocks group by all), name_n as (select name_norm, name_tokens, count(*) as n from nhit group by all)
select phase, path is not null as found, count(*) as entries, sum(case phase when 'tags' then coalesce(tag_n.n, 0) when 'name' then name_n.n else 0 end)::bigint as candidates
from placed join first_ using (eid) join e using (eid) left join tag_n on tag_n.title_tokens = e.title_tokens and tag_n.artist_tokens = e.artist_tokens
  left join name_n on name_n.name_norm = e.name_norm and name_n.name_tokens = e.name_tokens
group by phase, path is not null"""
