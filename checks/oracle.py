"""The same results in SQL, for the comparison with DuckDB."""

from __future__ import annotations

from checks import adapters as A
from checks.queries import BAD_RULES, RULES, TERMS
from cutlist.functions import prompts as P
from cutlist.functions.briefs import DEFAULT_PRESETS, DEFAULT_RENDER_MODE
from cutlist.lexicon import WORDING
from cutlist.operators.presets import ALIASES, PRESETS
from cutlist.operators.transcripts import DEFAULT_TAXONOMY


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def any_of(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def hits(text: str, words, weight: int, cap: int) -> str:
    return f"least({cap}, {weight} * (" + " + ".join(f"cast(contains({text}, {q(w)}) as int)" for w in words) + "))"


def sessions(cues: str) -> str:
    """CTEs from raw cues to sessions and merged groups; the walk follows each clip cue by cue."""
    return f"""
norm as (
  select project_id, clip_path, cue_no, greatest(start_ms, 0) as s, end_ms as e, {strip('text')} as text
  from ({A.duck(cues)}) c
  where end_ms - start_ms >= 200 and end_ms > 0 and {strip('text')} <> ''),
ord as (select *, row_number() over (partition by project_id, clip_path order by s, e, cue_no) as rn from norm),
walk as (
  select project_id, clip_path, rn, s, e, text, s as cur, 1 as no from ord where rn = 1
  union all
  select o.project_id, o.clip_path, o.rn, o.s, o.e, o.text,
    case when o.s - w.e > 2400 or o.e - w.cur > 18000 then o.s else w.cur end,
    case when o.s - w.e > 2400 or o.e - w.cur > 18000 then w.no + 1 else w.no end
  from walk w join ord o on o.project_id = w.project_id and o.clip_path = w.clip_path and o.rn = w.rn + 1),
groups as (
  select project_id, clip_path, cast(no as bigint) as session_no, min(s) as start_ms, arg_max(e, rn) as end_ms,
    count(*) as n_cues, string_agg(text, ' ' order by rn) as words
  from walk group by all),
kept as (
  select *, cast(sum(case when session_no = 1 or end_ms - start_ms >= 2000 then 1 else 0 end)
    over (partition by project_id, clip_path order by session_no) as bigint) as group_index from groups),
merged as (
  select project_id, clip_path, group_index, arg_min(start_ms, session_no) as start_ms,
    arg_max(end_ms, session_no) as end_ms, cast(sum(n_cues) as bigint) as n_cues,
    {strip("substr(string_agg(words, ' ' order by session_no), 1, 500)")} as excerpt
  from kept group by all)"""


def seconds(x: str) -> str:
    return f"concat(cast({x} // 1000 as varchar), '.', lpad(cast({x} % 1000 as varchar), 3, '0'))"


def result_key(path: str, more: str = "") -> str:
    return f"concat(replace(replace({path}, '/clips/', ''), '.mp4', ''), '-', substr(sha1(concat({path}, '{more}')), 1, 10))"


def digest(path: str, start: str, end: str) -> str:
    return f"substr(sha1(concat_ws(':', {path}, {seconds(start)}, {seconds(end)})), 1, 12)"


def pad3(x: str) -> str:
    return f"lpad(cast({x} as varchar), cast(greatest(length(cast({x} as varchar)), 3) as int), '0')"


SESSIONS = {kind: f"with recursive {sessions(sql)}" for kind, sql in (("conv", A.CUES_CONV), ("events", A.CUES_EVENTS))}
GROUP_ROWS = (
    "select project_id, clip_path, session_no, start_ms, end_ms, n_cues, substr(words, 1, 500) as excerpt from groups"
)

SEGMENTS = f"""{SESSIONS['conv']},
clips as ({A.duck(A.CLIPS_CONV)}),
padded as (
  select m.project_id, m.clip_path, m.group_index, m.excerpt, c.filename, c.date_key, c.location_id, c.route_phase,
    c.route_label, c.has_audio, c.start_utc, c.duration_ms as clip_ms, greatest(0, m.start_ms - 350) as s,
    least(c.duration_ms, m.end_ms + 850) as e
  from merged m join clips c using (project_id, clip_path)),
segs as (
  select *, s as start_ms, case when e - s < 2000 then least(clip_ms, s + 2000) else e end as end_ms,
    row_number() over (partition by project_id order by filename, {result_key('clip_path')}, group_index) as ordinal
  from padded),
segments as (
  select *, end_ms - start_ms as duration_ms, {digest('clip_path', 'start_ms', 'end_ms')} as digest,
    concat_ws('-', 'seg', {pad3('ordinal')}, {digest('clip_path', 'start_ms', 'end_ms')}) as candidate_id
  from segs)"""


def people(text: str) -> str:
    named = [
        f"case when {any_of(text, [name.lower(), *aliases])} then {q(name)} end" for name, aliases in A.PEOPLE
    ]
    groups = [f"case when {any_of(text, words)} then {q(label)} end" for label, words in A.TEXT_WORDS["groups"]]
    return f"list_filter([{', '.join(named + groups)}], lambda x: x is not null)"


MUST = [t.strip().lower() for t in A.MUST_INCLUDE if t.strip()]


def event_type(text: str) -> str:
    return "case " + " ".join(f"when {any_of(text, words)} then {q(kind)}" for kind, words in A.TEXT_WORDS["events"]) + " else 'moment' end"


W = A.TEXT_WORDS
EDITORIAL = f"case when project_id < 2 then {q(A.EDITORIAL.lower())} else '' end"
SCORES = f"""{SEGMENTS},
days as (
  select project_id, date_key, row_number() over (partition by project_id order by date_key) as travel_day,
    count(*) over (partition by project_id) as total_days
  from (select distinct project_id, date_key from segments) d),
said as (
  select s.*, d.travel_day, d.total_days, route_label as anchor_label,
    lower(concat_ws(' ', excerpt, route_phase, route_label, location_id, location_id, filename)) as txt,
    {EDITORIAL} as editorial
  from segments s join days d using (project_id, date_key)),
felt as (
  select *, {people('txt')} as who, 150 + {hits('txt', W['laugh'], 180, 550)} + {hits('txt', W['treat'], 80, 220)} as fun_raw,
    {hits('txt', W['meal'], 250, 1000)} as food_raw,
    {event_type("lower(concat_ws(' ', case when anchor_label <> '' then anchor_label else route_phase end, txt))")} as event_type
  from said),
scored as (
  select *,
    (least(100000, 35000 + case when {any_of('txt', MUST)} then 35000 else 0 end
      + case when route_phase <> '' then 12000 else 0 end
      + case when travel_day = 1 and {any_of('route_phase', ('departure', 'airport', 'arrival'))} then 18000 else 0 end
      + case when travel_day = total_days and {any_of('route_phase', ('return', 'closing', 'home'))} then 18000 else 0 end
      + case when {any_of('editorial', W['brief_meal'])} then food_raw * 18 else 0 end
      + case when {any_of('editorial', W['brief_reaction'])} then fun_raw * 14 else 0 end) + 50) // 100 as importance,
    least(1000, fun_raw) as fun, least(1000, 220 + 260 * len(who)) as people,
    case when has_audio then 1000 else 250 end as audio,
    least(1000, 120 + {hits('txt', W['scenery'], 180, 680)}) as scenery, least(1000, food_raw) as food,
    least(1000, 100 + {hits('txt', W['emotion'], 200, 800)}) as emotion,
    least(1000, {hits("concat_ws(' ', txt, route_phase)", W['travel'], 240, 1000)}) as transition,
    case when duration_ms between 2500 and 14000 then 1000 when duration_ms > 22000 then 450 else 650 end as duration_fit
  from felt),
rated as (
  select *, (least(100000, 34 * importance + 16 * fun + 12 * people + 12 * emotion + 8 * food + 8 * scenery
    + 5 * transition + 3 * audio + 2 * duration_fit) + 50) // 100 as overall
  from scored),
final as (
  select *, overall * 100 + importance * 35 + fun * 12 + emotion * 8 as priority,
    trim(concat(event_type, ' scene. People: ',
      case when len(who) > 0 then array_to_string(who, ', ') else {q(WORDING.no_people)} end, '. Gist: ',
      substr(case when {collapse('excerpt')} = '' then {q(WORDING.no_speech)} else {collapse('excerpt')} end, 1, 140))) as summary
  from rated)"""
FEATURES = ("importance", "fun", "people", "audio", "scenery", "food", "emotion", "transition", "duration_fit")

ANCHORED = f"""
anchors as (
  select project_id, ordinal, label, starts, ends, location_id, story_id,
    case when zone_name in ('UTC', 'Etc/GMT-9', 'Etc/GMT+5') then zone_name
      when zone_name = '' and location_id = 'place_3' then {q(A.PLACE_ZONE)}
      when project_id % 2 = 0 then {q(A.DEFAULT_ZONES[0])} else {q(A.DEFAULT_ZONES[1])} end as zone
  from ({A.duck(A.ANCHORS)}) a),
zoned as (
  select *, case zone when 'Etc/GMT-9' then 9 when 'Etc/GMT+5' then -5 when 'Etc/GMT-3' then 3 when 'Etc/GMT-2' then 2
    else 0 end as hours,
    case story_id when 'story_1' then 'Story one' when 'story_2' then 'Story two' else label end as route_label
  from anchors where (starts is not null or ends is not null) and ordinal <> {A.UNREADABLE_ANCHOR}),
placed as (
  select ev.*, coalesce(z.zone, case when ev.project_id % 2 = 0 then {q(A.DEFAULT_ZONES[0])} else {q(A.DEFAULT_ZONES[1])} end)
      as timezone_name,
    coalesce(z.location_id, '') as location_id, coalesce(z.story_id, '') as route_phase,
    coalesce(z.route_label, '') as route_label
  from ev left join zoned z on z.project_id = ev.project_id
    and (z.starts is null or ev.creation + to_hours(z.hours) >= z.starts)
    and (z.ends is null or ev.creation + to_hours(z.hours) <= z.ends)
  qualify row_number() over (partition by ev.event_id order by z.ordinal nulls last) = 1)"""

CLIPS = f"""
with ev as (
  select *, user_id % 10 as project_id, case when event_id % 10 < 2 then null else ts end as creation from events),
{ANCHORED},
facts as (
  select *, case timezone_name when 'Etc/GMT-9' then 9 when 'Etc/GMT+5' then -5 when 'Etc/GMT-3' then 3
      when 'Etc/GMT-2' then 2 else 0 end as hours,
    case when event_id % 10 = 0 then date_trunc('second', ts) end as named,
    concat(case when event_id % 10 = 0 then strftime(ts, '%Y%m%d_%H%M%S') else 'clip' end, '_', event_id, '.mp4') as filename,
    case when event_id % 5 = 0 then 12500 else (2 + event_id % 17) * 1000 + (event_id * 7919) % 1000 end as duration_ms,
    case when event_id % 3 = 0 then cast(floor(value * 1000) as bigint) else cast(floor(value * 5000) as bigint) end as size_bytes,
    case event_type when 'view' then round(30000 / 1001.0, 3) when 'click' then 30 when 'signup' then 25
      when 'error' then 30 else 50 end as fps,
    case when event_id % 11 = 0 then 0 when event_id % 13 = 0 then -90 when event_id % 7 = 0 then 90 else 0 end as turned
  from placed),
timed as (
  select *, case when creation is not null then creation when named is not null then named - to_hours(hours)
      else ts + interval 90 minute end as start_utc,
    case when creation is not null then creation + to_hours(hours) when named is not null then named
      else ts + interval 90 minute + to_hours(hours) end as start_local
  from facts)"""

CANDS = f"cands as ({A.duck(A.CAND_EVENTS)}), targets as ({A.duck(A.TARGETS)})"
BUDGETS = f"""{CANDS},
totals as (select project_id, date_key, cast(sum(duration_ms) as bigint) as total_ms from cands group by all),
weights as (
  select *, sqrt(case when total_ms = 0 then 1000 else total_ms end / 1000) as weight,
    count(*) over (partition by project_id) as n_days from totals),
shares as (
  select w.*, weight / sum(weight) over (partition by project_id) as share,
    (6400 + 2600 * n_days + 500) // 1000 as overhead_s, target_s
  from weights w join targets using (project_id)),
budgets as (
  select *, greatest(60, greatest(360, target_s) - overhead_s) as content_s,
    cast(round(greatest(60, greatest(360, target_s) - overhead_s) * 1000 * share) as bigint) as budget_ms
  from shares)"""
CHOSEN = f"""with recursive {BUDGETS},
ranked as (
  select c.project_id, c.date_key, c.candidate_id, c.duration_ms as ms, b.budget_ms,
    row_number() over (partition by c.project_id, c.date_key order by c.priority desc, source_utc, start_ms, candidate_id) as rank,
    count(*) over (partition by c.project_id, c.date_key) as n
  from cands c join budgets b using (project_id, date_key)),
walk as (
  select *, true as taken, ms as used, 1 as picks, ms >= budget_ms and (n < 3 or 1 >= 2) as done from ranked where rank = 1
  union all
  select r.*, (w.used + r.ms) * 100 <= r.budget_ms * 118,
    case when (w.used + r.ms) * 100 <= r.budget_ms * 118 then w.used + r.ms else w.used end,
    case when (w.used + r.ms) * 100 <= r.budget_ms * 118 then w.picks + 1 else w.picks end,
    (w.used + r.ms) * 100 <= r.budget_ms * 118 and w.used + r.ms >= r.budget_ms
      and w.picks + 1 >= case when r.n >= 3 then 2 else 1 end
  from walk w join ranked r on r.project_id = w.project_id and r.date_key = w.date_key and r.rank = w.rank + 1
  where not w.done),
chosen as (select project_id, date_key, candidate_id, rank, ms as used_ms from walk where taken)"""

ROLE = f"""case when travel_day = 1 and sequence_index = 1 then 'opener'
    when travel_day = total_days and sequence_index = n_selected then 'closer'
    when contains(route_phase, 'meal') or {any_of('txt', ('식사', '조식', '점심', '저녁', '커피', '카페', '디저트', '맛있'))} then 'meal'
    when contains(route_phase, 'reaction') or {any_of('txt', ('웃', '우와', '하하', '반응'))} then 'reaction'
    when {any_of('route_phase', ('departure', 'airport', 'arrival', 'return'))} then 'transition' else 'moment' end"""
ANCHOR = "case when story_anchor_label <> '' then story_anchor_label else route_phase end"
SELECTED = f"""{CHOSEN},
calendar as (
  select project_id, date_key, row_number() over (partition by project_id order by date_key) as travel_day,
    count(*) over (partition by project_id) as total_days from (select distinct project_id, date_key from cands) d),
placed as (
  select c.*, d.travel_day, d.total_days,
    row_number() over (partition by c.project_id, c.date_key order by source_utc, start_ms, end_ms, candidate_id) as sequence_index,
    count(*) over (partition by c.project_id, c.date_key) as n_selected,
    lower(concat_ws(' ', excerpt, route_phase, story_anchor_label, '', '', filename)) as txt
  from cands c join chosen using (project_id, date_key, candidate_id) join calendar d using (project_id, date_key)),
roled as (select *, {ROLE} as role, {ANCHOR} as anchor from placed),
selected as (
  select *, concat('Day ', travel_day, ' · ', cast(date_key as varchar)) as day_label,
    case when role = 'meal' then concat('Keeps the rhythm of meals and the mood of the trip. (', anchor, ')')
      when role = 'reaction' then concat('Shows how the group reacted and felt. (', anchor, ')')
      when role = 'opener' then 'Opens the film with the trip''s beginning.'
      when role = 'closer' then 'Closes the film on the trip''s end.'
      when anchor <> '' then concat('Key ', event_type, ' for the brief and the day''s flow. (', anchor, ')')
      when event_id % 4 = 0 then 'Shows the people and the mood well. Ana, Theo'
      when event_id % 5 <> 0 then concat('Scene ', event_type)
      else concat('Fits the flow the brief asks for. ', substr(excerpt, 1, 80)) end as reason
  from roled)"""

FAULTY = f"""with {CANDS},
calendar as (
  select project_id, date_key, row_number() over (partition by project_id order by date_key) as travel_day
  from (select distinct project_id, date_key from cands) d),
numbered as (
  select c.*, d.travel_day,
    row_number() over (partition by c.project_id, c.date_key order by source_utc, start_ms, end_ms, candidate_id) as seq,
    case when event_id % 17 in (3, 7, 8, 14) and d.travel_day % 2 = 0 then 0 else event_id % 17 end as kind
  from cands c join calendar d using (project_id, date_key)),
planted as (
  select project_id, travel_day, candidate_id as true_id, clip_path as true_clip, cast(date_key as varchar) as true_date,
    start_ms as lo, end_ms as hi, kind,
    case when kind = 3 then '2023-01-01' else cast(date_key as varchar) end as date_key,
    case when kind = 1 then concat(candidate_id, 'x') else candidate_id end as candidate_id,
    case when kind = 2 then '/clips/other.mp4' else clip_path end as clip_path,
    case when kind = 4 then start_ms - 20 when kind = 9 then start_ms - 10 when kind in (10, 11) then null
      else start_ms end as start_ms,
    case when kind = 5 then start_ms else end_ms end as end_ms,
    case when kind = 7 then seq + 1 when kind = 14 then null else seq end as sequence_index,
    case when kind = 6 then '' else 'moment' end as role
  from numbered where kind <> 8),
seen as (select p.*, c.candidate_id is not null as known from planted p left join cands c
  on c.project_id = p.project_id and c.candidate_id = p.candidate_id),
faults as (
  select project_id, travel_day, candidate_id, 'V2' as rule, candidate_id as detail from seen where not known
  union all select project_id, travel_day, candidate_id, 'V3', clip_path from seen where known and clip_path <> true_clip
  union all select project_id, travel_day, candidate_id, 'V4', date_key from seen where known and date_key <> true_date
  union all select project_id, travel_day, candidate_id, 'V5', concat_ws('-', start_ms, end_ms) from seen
    where start_ms is null or sequence_index is null
  union all select project_id, travel_day, candidate_id, 'V6', concat(start_ms, '-', end_ms) from seen
    where known and sequence_index is not null and (start_ms < lo - 10 or end_ms > hi + 10 or end_ms <= start_ms)
  union all select project_id, travel_day, candidate_id, 'V7', role from seen where role = ''),
day_counts as (
  select project_id, travel_day, date_key,
    concat_ws('/', min(sequence_index), max(sequence_index), count(distinct sequence_index), count(*)) as detail
  from seen where sequence_index is not null group by project_id, travel_day, date_key
  having min(sequence_index) <> 1 or max(sequence_index) <> count(*) or count(distinct sequence_index) <> count(*)),
day_faults as (select project_id, travel_day, '' as candidate_id, 'V8' as rule, detail from day_counts)"""

# What the documents hold, from the events that they were made of.
HELD = """items as (
  select *, user_id % 11 as shape, cast(ts as date) as day, concat('ev_', lpad(cast(event_id as varchar), 9, '0')) as candidate_id
  from events),
days as (
  select user_id, day, row_number() over (partition by user_id order by day) - 1 as no from items group by 1, 2),
held as (
  select i.user_id as project_id, cast(dayofmonth(i.day) as bigint) as travel_day, cast(i.day as varchar) as date_key,
    concat('Day ', dayofmonth(i.day)) as day_label, candidate_id, concat('/clips/user_', i.user_id, '.mp4') as clip_path,
    cast(event_id % 60 * 1000 + 500 as bigint) as start_ms,
    cast(case event_id % 5 when 0 then 90000 when 1 then null else 91250 end as bigint) as end_ms,
    cast(event_id % 9 as bigint) as sequence_index, case event_id % 4 when 0 then null else event_id % 4 <> 1 end as enabled,
    'moment' as role, case event_id % 13 when 0 then '' else 'fits' end as reason,
    cast(d.no as bigint) as day_no,
    cast(row_number() over (partition by i.user_id, i.day order by candidate_id) - 1 as bigint) as item_no,
    concat('/selections/', i.user_id, '.json') as path
  from items i join days d on d.user_id = i.user_id and d.day = i.day where shape not in (0, 1, 2, 3, 5, 6)),
rejects as (
  select case when shape in (2, 3) then null else user_id end as project_id,
    cast(case shape when 1 then 99 else 0 end as bigint) as travel_day, '' as candidate_id, 'V10' as rule,
    concat(case shape when 1 then 'selections is no array' when 2 then 'no object' when 3 then 'no object' else 'days is no array' end,
      ': /selections/', user_id, '.json') as detail
  from items where shape in (0, 1, 2, 3, 6) group by user_id, shape),
told as (
  select user_id as project_id, event_id, concat('/candidates/', user_id, '.json') as path, candidate_id,
    row_number() over (partition by user_id order by candidate_id) as ordinal,
    concat('/clips/user_', user_id, '.mp4') as clip_path, cast(day as varchar) as date_key, event_id % 60 * 1000 + 250 as start_ms,
    91000 as end_ms, concat('é', event_type) as excerpt, event_id % 100 as priority,
    event_id = min(event_id) over (partition by user_id) as is_first, count(*) over (partition by user_id) as n
  from items where user_id % 8 <> 0),
known as (
  select project_id, path, candidate_id, cast(case when is_first then n + 1 else ordinal - 1 end as bigint) as ordinal,
    case when is_first then '/clips/last.mp4' else clip_path end as clip_path, case when is_first then '' else date_key end as date_key,
    cast(case when is_first then 2000 else start_ms end as bigint) as start_ms,
    cast(case when is_first then 2000 else end_ms end as bigint) as end_ms, '' as source_time,
    case when is_first then '' else excerpt end as excerpt, cast(case when is_first then null else priority end as bigint) as priority
  from told)"""

PLAN_FAULTS = """plan_faults as (
  select project_id, travel_day, candidate_id, 'V7' as rule, '' as detail from segs where project_id = 1 and sequence_index = 1
  union all select project_id, travel_day, candidate_id, 'J9', clip_path from segs where project_id = 2 and clip_path like '%7.mp4'
  union all select distinct project_id, 0, '', 'T1', '' from segs where project_id = 3)"""

TIMELINE = f"""{SELECTED},
media as ({A.duck(A.CLIPS_EVENTS)}),
titles as ({A.duck(A.TITLES)}),
segs as (
  select s.project_id, s.travel_day, s.sequence_index, s.day_label, s.role, s.clip_path, s.candidate_id, s.start_ms,
    s.end_ms, s.end_ms - s.start_ms as duration_ms, m.filename, m.has_audio, m.start_local, m.location_id, m.route_phase,
    m.route_label, s.reason
  from selected s join media m using (project_id, clip_path)),
span as (
  select project_id, min(cast(start_local as date)) as a, max(cast(start_local as date)) as b from segs group by 1),
parts as (
  select project_id, 0 as part, 0 as sub, 'title' as kind, 0 as travel_day,
    concat(title, ' · ', strftime(a, '%Y.%m.%d'), case when a <> b then concat(' - ', strftime(b, '%Y.%m.%d')) else '' end) as label,
    '' as clip_path, '' as candidate_id, 0 as start_ms, 3600 as end_ms, 3600 as duration_ms, false as has_audio, '' as role,
    '' as filename, null as source_local, '' as location_id, '' as route_phase, '' as route_label, '' as reason
  from span join titles using (project_id)
  union all
  select distinct project_id, travel_day, 0, 'title', travel_day, day_label, '', '', 0, 2600, 2600, false, '', '', null, '', '', '', '' from segs
  union all
  select project_id, travel_day, sequence_index, 'segment', travel_day, concat(role, ' · ', filename), clip_path,
    candidate_id, start_ms, end_ms, duration_ms, has_audio, role, filename, cast(start_local as varchar), location_id, route_phase, route_label,
    reason from segs
  union all
  select project_id, 1000000, 0, 'title', 0, concat('End of the trip · ', title), '', '', 0, 2800, 2800, false, '', '', null, '', '', '', ''
  from span join titles using (project_id)),
items as (
  select project_id, row_number() over w as pos, kind, cast(travel_day as bigint) as travel_day, label, clip_path,
    candidate_id, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms,
    cast(duration_ms as bigint) as duration_ms,
    cast(coalesce(sum(duration_ms) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as cursor_ms,
    has_audio, role, filename, source_local, location_id, route_phase, route_label, reason
  from parts window w as (partition by project_id order by part, sub))"""


def clock(ms: str) -> str:
    total = f"cast(round_even({ms} / 1000, 0) as bigint)"
    pair = lambda x: f"lpad(cast({x} as varchar), 2, '0')"
    low = f"{pair(f'({total} // 60) % 60')}, ':', {pair(f'{total} % 60')}"
    return f"case when {total} >= 3600 then concat({pair(f'{total} // 3600')}, ':', {low}) else concat({low}) end"


def slug(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '-', 'g'), '-')"


CHUNKED = f"""{TIMELINE},
counted as (
  select *, sum(case when kind = 'title' then 1 else 0 end) over (partition by project_id order by pos) as no from items),
chunks as (
  select project_id, cast(no as bigint) as chunk_no, min(pos) as first_pos, count(*) as n_items,
    cast(sum(duration_ms) as bigint) as target_ms, arg_min(label, pos) as label from counted group by 1, 2)"""


def fade(top: int, per_mille: int) -> str:
    return f"cast(least({top}, greatest(100, (duration_ms * {per_mille} + 500) // 1000)) as bigint)"


def corrected(text: str) -> str:
    """Aliases longest first, then the rules, written out as nested calls."""
    out = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'), ' -')"
    pairs = [(a.strip(), c.strip()) for c, aliases in TERMS if c.strip() for a in aliases]
    for alias, canonical in sorted((p for p in pairs if p[0] and p[0] != p[1]), key=lambda p: -len(p[0])):
        out = f"replace({out}, {q(alias)}, {q(canonical)})"
    for pattern, replacement in RULES:
        if pattern.strip():
            out = f"regexp_replace({out}, {q(pattern.strip())}, {q(replacement.strip())}, 'g')"
    return strip(f"replace({out}, '  ', ' ')")


def vocabulary() -> str:
    default = ", ".join(q(t) for t in DEFAULT_TAXONOMY["prompt_terms"])
    canonical = ", ".join(q(t["canonical"]) for t in DEFAULT_TAXONOMY["terms"])
    place = "concat('Nation ', c_nationkey)"
    rows = f"""[{default}, c_name, lower(c_name), '공항', {place}, '지도', c_name, 'Day out', {place}, c_mktsegment, 'own', 'own',
      c_name, {canonical}, c_name]"""
    return f"""with words as (
  select c_custkey as project_id, unnest({rows}) as word, generate_subscripts({rows}, 1) as i from customer),
firsts as (select project_id, word, min(i) as i from words group by 1, 2)
select project_id, count(*) as n_terms, concat({q(DEFAULT_TAXONOMY['context'] + ' Names and terms: ')},
  string_agg(word, ', ' order by i), '.') as prompt from firsts group by 1"""


TURNS = """turns as (
  select *, conv_id % 5 as project_id, concat('/clips/conv_', conv_id, '_', turn, '.mp4') as clip_path,
    (conv_id + turn) % 5 = 4 as is_empty from conversations)"""

I = "(?i)"


def runtime(text: str) -> str:
    part = lambda p, g: f"try_cast(nullif(regexp_extract({text}, {q(I + p)}, {g}), '') as bigint)"
    r, hm = P.RANGE_MINUTES, P.HOURS_MINUTES
    return f"""cast(coalesce(case when regexp_matches({text}, {q(I + r)}) then greatest(60, ({part(r, 1)} + {part(r, 2)}) * 30) end,
      {part(hm, 1)} * 3600 + {part(hm, 2)} * 60, {part(P.HOURS, 1)} * 3600, {part(P.MINUTES, 1)} * 60, 2400) as bigint)"""


def phrase(text: str) -> str:
    return strip(f"regexp_extract({text}, {q(I + P.RUNTIME_PHRASE)}, 1)")


def tone(text: str) -> str:
    return "case " + " ".join(f"when {any_of(f'lower({text})', w)} then {q(t)}" for t, w in P.TONES) + " else '' end"


def pacing(text: str) -> str:
    low = f"lower({text})"
    return f"case when {any_of(low, P.SLOW_WORDS)} then {q(P.SLOW_PACING)} when {any_of(low, P.BRISK_WORDS)} then {q(P.BRISK_PACING)} else '' end"


def season(text: str) -> str:
    return "case " + " ".join(f"when contains(lower({text}), {q(w)}) then {q(w)}" for w in P.SEASONS) + " else '' end"


PROMPTS = f"prompts as ({A.duck(A.PROMPTS)})"


def made_date(y: str, m: str, d: str) -> str:
    two = lambda x: f"lpad({x}, 2, '0')"
    return f"case when cast({y} as int) > 0 then try_cast(concat_ws('-', lpad({y}, 4, '0'), {two(m)}, {two(d)}) as date) end"


def dates() -> str:
    full = " union all ".join(
        f"""select project_id, {made_date(*[f"regexp_extract(m, {q(p)}, {g})" for g in (1, 2, 3)])} as d
    from (select project_id, unnest(regexp_extract_all(prompt, {q(p)}, 0)) as m from prompts) x"""
        for p in P.FULL_DATES
    )
    month, day = (f"regexp_extract(m, {q(P.MONTH_DAY)}, {g})" for g in (1, 2))
    return f"""{PROMPTS},
named as (select * from ({full}) f where d is not null),
loose as (
  select project_id, first_date, last_date, m, {made_date("cast(year(first_date) as varchar)", month, day)} as d1,
    {made_date("cast(year(last_date) as varchar)", month, day)} as d2
  from (select project_id, first_date, last_date, unnest(regexp_extract_all(prompt, {q(P.MONTH_DAY)}, 0)) as m from prompts
        where project_id not in (select project_id from named)) x),
settled as (
  select project_id, coalesce(least(case when d1 between first_date and last_date then d1 end,
      case when d2 between first_date and last_date then d2 end), least(d1, d2)) as d from loose),
both_kinds as (select * from named union all select * from settled where d is not null),
spans as (
  select project_id, min(d) as a, max(d) as b from both_kinds group by 1),
date_spans as (
  select p.project_id, coalesce(case when a is null then null when a = b then strftime(a, '%Y.%m.%d')
    else concat(strftime(a, '%Y.%m.%d'), ' - ', strftime(b, '%Y.%m.%d')) end, '') as date_span
  from prompts p left join spans s using (project_id))"""


def clean_title(x: str) -> str:
    line = f"trim({collapse(x)}, '{P.EDGE_MARKS}')"
    line = f"regexp_replace({line}, {q(P.REQUEST_ENDING)}, '', 'g')"
    return f"trim(regexp_replace({line}, {q(I + P.PLEASE_ENDING)}, '', 'g'), '{P.EDGE_MARKS}')"


def explicit(text: str) -> str:
    cases = " ".join(
        f"when regexp_matches({text}, {q(I + p)}) then {clean_title(f'regexp_extract({text}, {q(I + p)}, 1)')}"
        for p in P.EXPLICIT_TITLES
    )
    return f"case {cases} else '' end"


def places() -> str:
    found = " union all ".join(
        f"select project_id, {n} as part, generate_subscripts(ms, 1) as i, unnest(ms) as m from "
        f"(select project_id, regexp_extract_all(prompt, {q(I + p)}, 1) as ms from prompts) p{n}"
        for n, p in enumerate(P.PLACE_PATTERNS)
    )
    stop = ", ".join(q(w) for w in P.PLACE_STOP_WORDS)
    return f"""
found as ({found}),
tidy as (select project_id, part, i, {clean_title('m')} as c from found),
last_word as (select project_id, part, i,
  case when regexp_matches(c, '[가-힣]') and contains(c, ' ') then string_split(c, ' ')[-1] else c end as c from tidy),
ended as (select project_id, part, i, {strip(f"regexp_replace(c, {q(P.PLACE_TRAVEL_ENDING)}, '', 'g')")} as c from last_word),
usable as (
  select project_id, c, min(part * 1000000 + i) as seen_at from ended
  where c <> '' and c not in ({stop}) and not regexp_matches(c, {q(P.PLACE_BAD_ENDING)}) and length(c) <= {P.PLACE_MAX}
  group by 1, 2),
place_lists as (
  select p.project_id, coalesce(string_agg(c, '|' order by seen_at), '') as places, arg_max(c, seen_at) as last_place
  from prompts p left join usable u using (project_id) group by 1)"""


def first_line(text: str) -> str:
    return strip(f"regexp_extract({text}, '[^ \t\n\r\f\v][^\n\r\f\v]*', 0)")


def titles() -> str:
    kind = f"case when {any_of('prompt', P.GROUP_KIND_WORDS)} then {q(P.GROUP_KIND)} else {q(P.PLAIN_KIND)} end"
    line = clean_title(first_line("prompt"))
    return f"""
named_titles as (
  select p.project_id, {explicit('prompt')} as explicit, concat(last_place, ' ', {kind}) as place_title, last_place,
    {season('prompt')} as season, {line} as line, description
  from prompts p join place_lists using (project_id)),
season_titles as (
  select *, case when season <> '' and not contains(place_title, season) then concat(season, ' ', place_title)
    else place_title end as full_title from named_titles),
title_rows as (
  select project_id, explicit, case when explicit <> '' then explicit
    when last_place is not null and length(full_title) <= {P.TITLE_MAX} then full_title
    when length(line) between {P.LINE_MIN} and {P.LINE_MAX} then line
    else {strip('description')} end as title
  from season_titles)"""


CUSTOMER_LISTS = """case when c_custkey % 2 = 0 then '' else concat(chr(10), 'avoid: rain; crowds') end"""

ORACLE: dict[str, str] = {
    "cue_normalize": f"{SESSIONS['conv']} select project_id, clip_path, cue_no, s as start_ms, e as end_ms, text from norm",
    "cue_groups": f"{SESSIONS['conv']} {GROUP_ROWS}",
    "cue_groups_events": f"{SESSIONS['events']} {GROUP_ROWS}",
    "cue_groups_merged": f"{SESSIONS['conv']} select * from merged",
    "cue_groups_merged_events": f"{SESSIONS['events']} select * from merged",
    "cue_segments": f"""{SEGMENTS} select project_id, clip_path, filename, group_index, ordinal, start_ms, end_ms,
      duration_ms, excerpt from segments""",
    "frame_plan": f"""{SEGMENTS} select project_id, candidate_id, cast(n as bigint) as frame_no,
      greatest(0, start_ms + greatest(0, least(duration_ms, cast(floor((duration_ms * p + 50) / 100) as bigint)))) as at_ms
      from segments, (values (1, 18), (2, 50), (3, 82)) f(n, p)""",
    "segment_key": f"""{SEGMENTS} select project_id, candidate_id, digest, {result_key('clip_path')} as result_key,
      {result_key('clip_path', '::sig1')} as cache_key from segments""",
    "segment_digests": f"""select project_id, clip_path, cue_no, {digest('clip_path', 'start_ms', 'end_ms')} as digest
      from ({A.duck(A.CUES_EVENTS)}) c""",
    "clip_catalog": f"""{CLIPS}
      select project_id, concat('/clips/', filename) as clip_path, filename, timezone_name, cast(duration_ms as bigint) as duration_ms,
        cast(case when turned <> 0 then 1080 else 1920 end as bigint) as width,
        cast(case when turned <> 0 then 1920 else 1080 end as bigint) as height, cast(fps as double) as fps,
        event_id % 4 <> 0 as has_audio, size_bytes,
        ((size_bytes * 16 + duration_ms) // (duration_ms * 2)) / 1000 as bitrate_mbps, turned <> 0 as is_vertical,
        epoch_us(start_utc) // 1000 as start_utc_ms, epoch_us(start_local) // 1000 as start_local_ms,
        cast(cast(start_local - interval 4 hour as date) as varchar) as date_key, location_id, route_phase, route_label
      from timed""",
    "travel_day_key": """with keyed as (
        select user_id % 10 as project_id, event_id, cast(ts - interval 2 hour + interval 9 hour - interval 4 hour as date) as d from events),
      days as (select project_id, d, row_number() over (partition by project_id order by d) as travel_day,
        count(*) over (partition by project_id) as total_days from (select distinct project_id, d from keyed) k)
      select project_id, event_id, cast(d as varchar) as date_key, travel_day, total_days from keyed join days using (project_id, d)""",
    "filename_times": """select event_id, case when event_id % 7 = 3 then -1
      else epoch_us(date_trunc('second', ts)) // 1000 end as name_ms from events""",
    "dominant_fps": f"""{CLIPS},
      rates as (select project_id, fps, sum(duration_ms) as total, min(struct_pack(a := start_utc, b := filename)) as first
        from timed group by 1, 2)
      select project_id, cast(fps as double) as fps from rates
      qualify row_number() over (partition by project_id order by total desc, first) = 1""",
    "date_span": f"""{CLIPS},
      ends as (select project_id, min(cast(start_local as date)) as a, max(cast(start_local as date)) as b from timed group by 1)
      select project_id, cast(a as varchar) as first_date, cast(b as varchar) as last_date,
        concat(strftime(a, '%Y.%m.%d'), case when a <> b then concat(' - ', strftime(b, '%Y.%m.%d')) else '' end) as date_span
      from ends""",
    "anchor_interval_join": f"""with ev as (select *, user_id % 10 as project_id, ts as creation from events), {ANCHORED}
      select project_id, event_id, timezone_name, location_id, route_phase, route_label from placed""",
    "anchor_many": f"""with a as (
        select *, case zone_name when 'UTC' then ends else ends - interval 9 hour end as until,
          case zone_name when 'UTC' then starts else starts - interval 9 hour end as since
        from ({A.duck(A.EVENT_ANCHORS)})),
      ev as (select event_id, case when user_id % 3 = 0 then 1 else 0 end as project_id, ts from events),
      -- An anchor without a start holds everything up to its end; the first of these is looked up by itself.
      hit as (
        select e.event_id, min(a.ordinal) as ordinal from ev e join a on a.project_id = e.project_id and e.ts >= a.since and e.ts <= a.until
        where a.since is not null group by 1
        union all
        select e.event_id, min(a.ordinal) from ev e join a on a.project_id = e.project_id and e.ts <= a.until
        where a.since is null group by 1),
      first as (select event_id, min(ordinal) as ordinal from hit group by 1)
      select cast(e.project_id as bigint) as project_id, e.event_id, coalesce(a.zone_name, 'UTC') as timezone_name,
        coalesce(cast(f.ordinal as varchar), '') as location_id
      from ev e left join first f using (event_id) left join a on a.ordinal = f.ordinal""",
    "event_type": f"select conv_id, turn, {event_type('lower(text)')} as event_type from conversations",
    "people_terms": f"""with said as (select conv_id, turn, lower(text) as txt, {people('lower(text)')} as who from conversations)
      select conv_id, turn, array_to_string(who, '|') as people, len(who) as n_people, {any_of('txt', MUST)} as has_must_include from said""",
    "feature_scores": f"{SCORES} select project_id, candidate_id, travel_day, total_days, "
    + ", ".join(f"cast({f} as bigint) as {f}" for f in FEATURES)
    + " from final",
    "overall_priority": f"""{SCORES} select project_id, candidate_id, event_type, array_to_string(who, '|') as people_found,
      cast(overall as bigint) as overall, cast(priority as bigint) as priority, summary from final""",
    "cue_analysis_by_day": f"""{SCORES} select project_id, travel_day, concat('Day ', travel_day, ' · ', cast(date_key as varchar)) as label,
      count(*) over (partition by project_id, date_key) as cue_count, candidate_id, cast(overall as bigint) as overall,
      duration_ms from final""",
    "day_budgets": f"""with {BUDGETS} select project_id, cast(date_key as varchar) as date_key, total_ms,
      round(weight, 6) as weight, round(share, 6) as share, n_days, overhead_s, content_s, budget_ms from budgets""",
    "select_segments": f"{CHOSEN} select project_id, cast(date_key as varchar) as date_key, candidate_id, rank, used_ms from chosen",
    "selection_roles": f"""{SELECTED} select project_id, travel_day, cast(date_key as varchar) as date_key, day_label,
      candidate_id, sequence_index, role, reason from selected""",
    "validate_selection": f"""{FAULTY}
      select * from faults union all select * from day_faults
      union all select cast(n_nationkey as bigint), 0, '', r.rule, '' from nation, (values ('V9'), ('V11')) r(rule)
        where n_nationkey not in (select project_id from cands)""",
    "valid_selection": f"""{FAULTY}
      select project_id, travel_day, date_key, concat('Day ', travel_day) as day_label, candidate_id, start_ms, end_ms, sequence_index
      from seen s where not exists (select 1 from faults f where f.project_id = s.project_id and f.candidate_id = s.candidate_id)
        and not exists (select 1 from day_counts d where d.project_id = s.project_id and d.travel_day = s.travel_day and d.date_key = s.date_key)""",
    "selection_documents": f"with {HELD} select * from held",
    "selection_headers": f"""with {HELD}
      select user_id as project_id, concat('/selections/', user_id, '.json') as path, concat('Trip ', user_id) as project_title,
        'auto' as selection_mode, cast(case shape when 5 then 0 else count(distinct day) end as bigint) as n_days
      from items where shape not in (0, 1, 2, 3, 6) group by user_id, shape""",
    "selection_rejects": f"with {HELD} select * from rejects",
    "candidate_documents": f"with {HELD} select * from known",
    "document_selection_faults": f"""with {HELD},
      used as (select h.*, k.candidate_id is not null as found, k.clip_path as true_clip, k.date_key as true_date, k.start_ms as lo, k.end_ms as hi
        from held h left join known k using (project_id, candidate_id) where coalesce(enabled, true)),
      faults as (
        select project_id, 'V2' as rule from used where not found
        union all select project_id, 'V3' from used where found and clip_path <> true_clip
        union all select project_id, 'V4' from used where found and true_date <> '' and date_key <> true_date
        union all select project_id, 'V5' from used where end_ms is null
        union all select project_id, 'V6' from used where found and end_ms is not null
          and (start_ms < lo - 10 or end_ms > hi + 10 or end_ms <= start_ms)
        union all select project_id, 'V7' from used where reason = ''
        union all select project_id, 'V8' from used group by project_id, travel_day, date_key
          having min(sequence_index) <> 1 or max(sequence_index) <> count(*) or count(distinct sequence_index) <> count(*)
        union all select project_id, rule from rejects)
      select project_id, rule, count(*) as n from faults group by 1, 2""",
    "written_selections": f"""{SELECTED} select project_id, concat('Trip ', project_id) as project_title, 'auto' as selection_mode,
        count(*) as n_selections, cast(sum(end_ms - start_ms) as bigint) as total_ms, count(distinct travel_day) as n_days
      from selected group by 1""",
    "written_transcripts": f"""with {TURNS}
      select project_id, concat('Trip ', project_id) as project, string_agg(distinct concat('asr-', role), ', ' order by concat('asr-', role)) as provider,
        'base' as model, 'ko' as speech_locale, 'sig' as taxonomy_signature, count(*) as n_clips,
        cast(sum(case when is_empty then null else length(text) end) as bigint) as n_chars,
        count(*) filter (where not is_empty) as transcribed_clip_count, count(*) filter (where is_empty) as empty_transcript_count
      from turns group by 1, 2""",
    "plan_faults": f"""{TIMELINE}, {PLAN_FAULTS} select * from plan_faults""",
    "sound_items": f"""{TIMELINE}, {PLAN_FAULTS} select * from items where project_id not in (select project_id from plan_faults)""",
    "timeline_items": f"{TIMELINE} select * from items",
    "timeline_totals": f"""{TIMELINE} select project_id, cast(sum(duration_ms) as bigint) as target_ms, count(*) as n_items,
      count(*) filter (where kind = 'segment') as n_segments from items group by 1""",
    "chapters": f"""{TIMELINE} select project_id, pos, {clock('cursor_ms')} as timecode, case when pos = 1 then 'Intro'
      when pos = max(pos) over (partition by project_id) then 'Outro' else label end as label from items where kind = 'title'""",
    "timeline_chunks": f"""{CHUNKED} select c.project_id, c.chunk_no as chunk_index, c.chunk_no, c.label,
        {slug('c.label')} as slug, concat(title, ' · ', c.label) as chunk_title,
        {strip("case when contains(c.label, '·') then split_part(c.label, '·', 1) else c.label end")} as card_title,
        {strip("case when contains(c.label, '·') then substr(c.label, instr(c.label, '·') + 1) else '' end")} as card_subtitle,
        c.first_pos, c.n_items, c.target_ms
      from chunks c join titles using (project_id)""",
    "edit_list": f"""{TIMELINE},
      sourced as (select *, case when kind = 'title' then concat('title_', {pad3('pos - 1')}) else clip_path end as input from items),
      firsts as (select project_id, input, row_number() over (partition by project_id order by min(pos)) - 1 as input_index
        from sourced group by 1, 2)
      select project_id, pos, input, input_index, start_ms, end_ms, duration_ms, {fade(240, 75)} as video_fade_ms,
        greatest(0, duration_ms - {fade(240, 75)}) as video_fade_out_ms,
        case when kind = 'title' then 'title' when has_audio then 'clip' else 'silence' end as audio,
        case when has_audio then {fade(200, 90)} else 0 end as audio_fade_ms,
        case when has_audio then greatest(0, duration_ms - {fade(200, 90)}) else 0 end as audio_fade_out_ms,
        bool_or(has_audio) over (partition by project_id) as has_live_audio
      from sourced join firsts using (project_id, input)""",
    "taxonomy_correct": f"select doc_id, {corrected('text')} as text from documents",
    "curated_results": f"""with {TURNS},
      done as (select *, {corrected('text')} as one, {corrected("concat('- the  ', text, ' eaux -')")} as two from turns),
      cues as (select *, case when turn % 3 = 1 or is_empty then [] when turn % 3 = 0 then list_filter([one, two], lambda x: x <> '')
        else list_filter([one], lambda x: x <> '') end as kept from done)
      select project_id, clip_path, case when len(kept) > 0 then 'ok' else 'empty' end as transcript_status,
        cast(len(kept) as bigint) as n_cues, array_to_string(kept, '|') as texts from cues""",
    "rejected_rules": f"""select distinct doc_id % 10 as project_id, pattern
      from documents, (values {', '.join(f'({q(p)})' for p, _ in BAD_RULES)}) r(pattern) where doc_id % 10 = 1""",
    "vocabulary": vocabulary(),
    "transcript_report": f"""with {TURNS}
      select project_id, string_agg(distinct concat('asr-', role), ', ' order by concat('asr-', role)) as provider,
        count(*) as clip_count, count(*) filter (where not is_empty) as transcribed_clip_count,
        count(*) filter (where is_empty) as empty_transcript_count
      from turns group by 1""",
    "transcript_statuses": f"""with {TURNS} select project_id, clip_path, case when is_empty then 'empty' else 'ok' end as status,
      case when conv_id % 2 = 0 then 'fr' else 'en' end as language from turns""",
    "result_upsert": f"""with {TURNS},
      patched as (
        select project_id, case when turn % 2 = 0 then clip_path
          else concat('/clips/conv_', conv_id + 100000, '_', turn, '.mp4') end as clip_path,
          'redo-2' as provider, case when turn = 2 then '-' else 'xx' end as speech_locale from turns),
      old as (select project_id, clip_path, concat('asr-', role) as provider,
        case when conv_id % 2 = 0 then 'fr-FR' else 'EN' end as speech_locale from turns)
      select coalesce(o.project_id, p.project_id) as project_id, coalesce(o.clip_path, p.clip_path) as clip_path,
        replace(coalesce(o.clip_path, p.clip_path), '/clips/', '') as filename, coalesce(p.provider, o.provider) as provider,
        coalesce(p.speech_locale, o.speech_locale) as speech_locale,
        case when o.clip_path is null then '-' else 'base' end as transcription_model,
        case when p.clip_path is null then '2024-01-01T00:00:00' else '2024-02-02T00:00:00' end as updated_at
      from old o full join patched p on o.project_id = p.project_id and o.clip_path = p.clip_path""",
    "work_list": f"with {TURNS} select project_id, clip_path from turns where turn % 4 <> 2 or turn % 3 = 0 or conv_id % 7 = 0",
    "preset_resolve": f"""with presets(preset_id, label, category) as (values {', '.join('(' + ', '.join(q(x) for x in p) + ')' for p in PRESETS)}),
      aliases(alias, preset_id) as (values {', '.join(f'({q(a)}, {q(b)})' for a, b in ALIASES.items())}),
      wanted as (
        select c_custkey as project_id, 0 as ordinal, case c_mktsegment when 'BUILDING' then ' warm ' when 'MACHINERY' then 'resort'
          else 'refined_travel' end as name from customer
        union all select c_custkey, 1, case c_nationkey % 3 when 0 then 'warm_family_vlog' when 1 then 'teal_orange' else 'sepia' end from customer
        union all select c_custkey, 2, 'refined' from customer),
      resolved as (select w.*, coalesce(a.preset_id, trim(name)) as pid from wanted w left join aliases a on a.alias = trim(w.name)),
      known as (select project_id, pid, min(ordinal) as ordinal from resolved where pid in (select preset_id from presets) group by 1, 2)
      select project_id, cast(ordinal as bigint) as ordinal, pid as preset_id, label, category, true as known
      from known join presets p on p.preset_id = pid
      union all select project_id, ordinal, name, '', '', false from resolved where pid not in (select preset_id from presets)""",
    "editorial_texts": f"""select c_custkey as project_id, concat('summary: ', c_name,
        case when c_custkey % 2 = 0 then concat(chr(10), 'tone: warm') else '' end,
        case when c_nationkey < 12 then concat(chr(10), 'target_runtime: ', c_nationkey, ' hours') else '' end,
        case when c_custkey % 2 = 1 then concat(chr(10), 'meal_guidance: food first') else '' end,
        chr(10), 'closer_guidance: fade', chr(10), 'must_include: ', c_mktsegment, '; beach', {CUSTOMER_LISTS}) as editorial
      from customer""",
    "brief_defaults": f"""select c_custkey as project_id, case when c_custkey % 2 = 0 then 'UTC' else '-' end as default_timezone,
        case when c_nationkey % 3 = 0 then 'resort' else {q(DEFAULT_PRESETS[0])} end as preview_presets,
        case when c_nationkey % 2 = 0 then 'refined' when c_nationkey % 3 = 0 then 'resort' else {q(DEFAULT_PRESETS[0])} end as selected_preset,
        {q(DEFAULT_RENDER_MODE)} as final_render_mode, 'softer' as final_feedback
      from customer""",
    "prompt_runtime": f"with {PROMPTS} select project_id, {phrase('prompt')} as phrase, {runtime('prompt')} as seconds from prompts",
    "prompt_tone": f"with {PROMPTS} select project_id, {tone('prompt')} as tone, {pacing('prompt')} as pacing, {season('prompt')} as season from prompts",
    "prompt_dates": f"with {dates()} select project_id, date_span from date_spans",
    "prompt_places": f"with {PROMPTS}, {places()} select project_id, places from place_lists",
    "prompt_title": f"with {PROMPTS}, {places()}, {titles()} select project_id, explicit, title from title_rows",
    "prompt_feature_rows": f"""with {dates()}, {places()}, {titles()}
      select project_id, {strip('prompt')} as summary, {tone('prompt')} as tone, {pacing('prompt')} as pacing_guidance,
        {phrase('prompt')} as target_runtime,
        {runtime(f"case when {phrase('prompt')} <> '' then {phrase('prompt')} else prompt end")} as target_s, date_span, title
      from prompts join date_spans using (project_id) join title_rows using (project_id)""",
    "label_slugs": f"""with labels_ as (select page_id, url, concat(url, ' · Étape ·', page_id) as label from pages)
      select page_id, {slug('label')} as slug, {strip('url')} as card_title, concat('Étape ·', page_id) as card_subtitle from labels_""",
}
