"""DuckDB SQL of the queries in :mod:`.queries`."""

from __future__ import annotations


def _beats(divisor: str) -> str:
    return f"""e as (select cast(user_id as varchar) as recording_id, epoch_us(ts) as us, event_id, event_type, value from events),
b as (select recording_id, row_number() over w - 1 as beat_idx, (us - first_value(us) over w) / {divisor} as time_sec, (us - lag(us) over w) / {divisor} as rr_sec,
  0.05 + value / 1000 as qrs_sec, case event_type when 'purchase' then 'V' when 'error' then 'E' when 'signup' then 'U' else 'N' end as label, first_value(us) over w as start_us
  from e window w as (partition by recording_id order by us, event_id))"""


FAST = "with " + _beats("3e10")
DAY = "with " + _beats("6e7")
P = "(partition by recording_id order by time_sec, beat_idx)"
UPTO = "(partition by recording_id order by time_sec, beat_idx rows between unbounded preceding and current row)"

RUNS = f"""m as (select *, coalesce(label = lag(label) over {P}, false) as same from b),
g as (select *, sum(case when same then 0 else 1 end) over {UPTO} as run from m),
r as (select recording_id, any_value(label) as label, min(time_sec) as start_sec, max(time_sec) as end_sec, count(*) as beats,
  case when count(*) >= 3 then 60 / avg(case when same and rr_sec <> 0 then rr_sec end) end as bpm from g group by recording_id, run having any_value(label) in ('V', 'E'))"""
COUNTS = """c as (select recording_id, count(*) filter (label = 'V' and beats = 2) as couplets, count(*) filter (label = 'V' and beats = 3) as triplets, count(*) filter (label = 'V' and beats >= 4) as vt_runs,
  count(*) filter (label = 'E' and beats = 2) as escape_couplets, count(*) filter (label = 'E' and beats >= 3) as escape_runs,
  max(struct_pack(n := beats, s := -start_sec)) filter (label = 'V' and beats >= 3) as l, max(struct_pack(n := bpm, s := -start_sec)) filter (label = 'V' and bpm is not null) as f from r group by recording_id)"""
WINDOWS5 = f"""u as (select recording_id, beat_idx, time_sec, [lag(rr_sec, 2) over {P}, lag(rr_sec) over {P}, rr_sec, lead(rr_sec) over {P}, lead(rr_sec, 2) over {P}] as five from b where rr_sec <> 0),
f5 as (select recording_id, beat_idx, time_sec, list_sort(five)[3] as rr from u where five[1] is not null and five[5] is not null)"""
SINUS = f"""q as (select *, sum(case when label = 'N' then 1 else 0 end) over (partition by recording_id order by time_sec, beat_idx rows between unbounded preceding and 1 preceding) as seg, lag(time_sec) over {P} as prior from b),
s as (select recording_id, min(prior) as start_sec, max(time_sec) as end_sec, count(*) filter (label = 'E') as escape_beats from q where seg >= 1 group by recording_id, seg
  having bool_and(label in ('N', 'E') and coalesce(rr_sec, 0) <> 0) and bool_or(label = 'N'))"""
SPANS = """k as (select quantile_cont(qrs_sec, 0.9) as cut from b), d as (select recording_id, max(time_sec) as duration_sec from b group by recording_id),
x as (select recording_id, greatest(time_sec - 0.25, 0) as start_sec, least(time_sec + 2.0 + 0.25, duration_sec) as end_sec from b join d using (recording_id), k where qrs_sec >= cut
  union all select recording_id, 0, least(1.0, duration_sec) from d union all select recording_id, greatest(duration_sec - 1.0, 0), duration_sec from d),
y as (select *, max(end_sec) over (partition by recording_id order by start_sec, end_sec rows between unbounded preceding and 1 preceding) as reach from x),
z as (select *, sum(case when start_sec - reach <= 0.5 then 0 else 1 end) over (partition by recording_id order by start_sec, end_sec rows between unbounded preceding and current row) as island from y),
spans as (select recording_id, min(start_sec) as start_sec, max(end_sec) as end_sec from z group by recording_id, island)"""
BAD = """v as (select cast(label as varchar) as recording_id, row_number() over (partition by label order by vec_id) - 1 as window_idx, list_transform(embedding, lambda x: round(cast(x as double), 2)) as s from embeddings),
t as (select *, list_transform(range(1, len(s)), lambda i: s[i + 1] - s[i]) as d from v),
st as (select recording_id, window_idx, list_max(s) - list_min(s) as ptp, len(list_filter(d, lambda q: q = 0)) / len(d) as flat_share,
  case when list_var_pop(s) = 0 then 0 else list_var_pop(d) / list_var_pop(s) end as tone_ratio from t),
o as (select *, tone_ratio > 2.0 as lead_off, tone_ratio > 2.0 or flat_share > 0.05 as isout from st),
md as (select recording_id, coalesce(median(ptp) filter (not isout), 0) as mid from o group by recording_id),
bw as (select recording_id, window_idx, ptp, flat_share, tone_ratio, lead_off, (mid <= 0 or isout or ptp > 1.2 * mid or ptp < 0.85 * mid) as bad from o join md using (recording_id))"""

TYPICAL = f"""n as (select *, list(case when label = 'N' and rr_sec is not null and qrs_sec is not null then struct_pack(r := rr_sec, q := qrs_sec) end) over (partition by recording_id order by time_sec, beat_idx rows between 40 preceding and 1 preceding) as near from b),
t as (select *, list_filter(near, lambda x: x is not null)[-8:] as k from n)"""

SUSTAINED = """kinds as (select 'brady' as kind union all select 'tachy'),
sm as (select b.*, kind, case when rr_sec > 0 then (case kind when 'brady' then 60 / rr_sec < 50 else 60 / rr_sec > 160 end) else false end as hit from b, kinds),
sg as (select *, sum(case when hit then 0 else 1 end) over (partition by recording_id, kind order by time_sec, beat_idx rows between unbounded preceding and current row) as k from sm),
su as (select recording_id, kind, min_by(time_sec - rr_sec, beat_idx) as start_sec, max(time_sec) as end_sec from sg where hit group by recording_id, kind, k having count(*) >= 3)"""
REST = """rest as (select recording_id, any_value(3600.0 - (start_us % 3600000000) / 1e6) as f, max(time_sec) + cast(recording_id as bigint) % 4 * 2700.0 as duration_sec, any_value(start_us) as start_us, any_value(cast(recording_id as bigint)) as num from b group by recording_id)"""
GRID = """bb as (select * from b where cast(recording_id as bigint) % 10 <> 0),
ends as (select r.*, l.last, greatest(duration_sec, coalesce(last, 0)) as until from rest r left join (select recording_id, max(time_sec) as last from bb group by recording_id) l using (recording_id)),
full as (select *, case when until > f then cast(ceil((until - f) / 3600.0) as bigint) else 0 end as before from ends where until > 0 or last = until),
rows as (select *, unnest(range(0, before + 1 + case when last = until and until = f + before * 3600.0 then 1 else 0 end)) as hour from full),
grid as (select recording_id, hour, f, start_us, case hour when 0 then 0.0 else f + (hour - 1) * 3600.0 end as start_sec, least(f + hour * 3600.0, until) as end_sec from rows)"""
HOURS = """cut as (select quantile_cont(qrs_sec, 0.9) as cut from bb), x as (select recording_id, time_sec as start_sec, time_sec + 600.0 as end_sec from bb, cut where qrs_sec >= cut),
y as (select *, max(end_sec) over (partition by recording_id order by start_sec, end_sec rows between unbounded preceding and 1 preceding) as reach from x),
z as (select *, sum(case when start_sec - reach <= 30 then 0 else 1 end) over (partition by recording_id order by start_sec, end_sec rows between unbounded preceding and current row) as island from y),
spans as (select recording_id, min(start_sec) as start_sec, max(end_sec) as end_sec from z group by recording_id, island),
hr as (select * from grid),
ha as (select hr.recording_id, hr.hour, any_value(start_us) as start_us, any_value(hr.start_sec) as start_sec, any_value(hr.end_sec) as end_sec,
  any_value(hr.end_sec) - any_value(hr.start_sec) - coalesce(sum(greatest(0.0, least(s.end_sec, hr.end_sec) - greatest(s.start_sec, hr.start_sec))) filter (s.start_sec is not null), 0) as analyzed_sec from hr left join spans s using (recording_id) group by all)"""


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    clock = lambda c: f"strftime(make_timestamp(us0 + cast(round({c} * 1e6) as bigint)), '%H:%M')"
    rate = lambda c: f"coalesce(printf('%.0f', round_even({c}, 0)), '-') as {c}"
    found["hourly_text"] = f"""with h as ({found["beats_hourly"]}), q as ({found["hourly_analyzed"]}), s as (select cast(user_id as varchar) as recording_id, min(epoch_us(ts)) as us0 from events group by all)
select recording_id, hour, {clock("h.start_sec")} || '-' || {clock("h.end_sec")} as label, printf('%.1f', round_even(analyzed_sec / 60, 1)) as minutes, {rate("min_bpm")}, {rate("mean_bpm")}, {rate("max_bpm")},
  {", ".join(f"cast({c} as varchar) as {c}" for c in ("beats", "pvcs", "couplets", "runs", "escapes", "pauses"))} from h join q using (recording_id, hour) join s using (recording_id)"""
    found |= _more()
    return found | _reports(found)


SAMPLES = """v as (select cast(label as varchar) as recording_id, row_number() over (partition by label order by vec_id) - 1 as chunk, list_transform(embedding, lambda x: round(cast(x as double), 2)) as s from embeddings),
p as (select recording_id, chunk * 64 + i - 1 as place, s[i] as x from v, range(1, 65) as q(i))"""
CARDS = """e as (select user_id, cast(user_id as varchar) as path, epoch_us(ts) as us, event_id, event_type, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as i from events),
c as (select *, user_id % 10 as fault, user_id % 1000 + (case when i >= 60 then 1 else 0 end) as seq, case when event_type = 'signup' then 1 + event_id % 4 else 0 end as press from e), k as (select * from c where i < 60)"""
FINE = "fault not in (0, 1, 2, 3, 4)"
DECODE = "[0, 1, 3, 6, 12, 21, 38, 70, 0, -70, -38, -21, -12, -6, -3, -1]"


def _more() -> dict[str, str]:
    """Labels, classes, waveforms, presses and cards."""
    day = f"{DAY}, {REST}"
    return {
        "beats_labelled": f"""with recursive {FAST.removeprefix("with ")}, o as (select *, row_number() over {P} as i from b),
w as (select recording_id, i, beat_idx, time_sec, rr_sec, qrs_sec, 'U' as label, cast(null as double) as rr_base, cast(null as double) as qrs_base, cast([] as double[]) as rs, cast([] as double[]) as qs from o where i = 1
  union all select recording_id, i, beat_idx, time_sec, rr_sec, qrs_sec, label, rr_base, qrs_base, case when label = 'N' then list_append(rs, rr_sec)[-8:] else rs end, case when label = 'N' then list_append(qs, qrs_sec)[-8:] else qs end from (
    select *, case when rr_sec is null or qrs_sec is null then 'U' when rr_base is null then 'N' when qrs_sec > 1.25 * qrs_base and qrs_sec - qrs_base >= 0.03 and rr_sec < 0.85 * rr_base then 'V'
      when qrs_sec > 1.25 * qrs_base and qrs_sec - qrs_base >= 0.03 and rr_sec >= 1.5 * rr_base then 'E' else 'N' end as label from (
      select o.recording_id, o.i, o.beat_idx, o.time_sec, o.rr_sec, o.qrs_sec, w.rs, w.qs, list_median(w.rs) as rr_base, list_median(w.qs) as qrs_base from w join o on o.recording_id = w.recording_id and o.i = w.i + 1)))
select recording_id, beat_idx, round(time_sec, 6) as time_sec, round(rr_sec, 6) as rr_sec, round(qrs_sec, 6) as qrs_sec, label, round(rr_base, 6) as rr_base, round(qrs_base, 6) as qrs_base from w""",
        "beats_class_rates": f"""{FAST}, cl as (select recording_id, [60, 50, 45][num % 3 + 1] as lo, [180, 160, 150][num % 3 + 1] as hi from (select distinct recording_id, cast(recording_id as bigint) as num from b)),
{WINDOWS5}, kinds as (select 'brady' as kind union all select 'tachy'),
sm as (select b.*, kind, case when rr_sec > 0 then (case kind when 'brady' then 60 / rr_sec < lo else 60 / rr_sec > hi end) else false end as hit from b join cl using (recording_id), kinds),
sg as (select *, sum(case when hit then 0 else 1 end) over (partition by recording_id, kind order by time_sec, beat_idx rows between unbounded preceding and current row) as k from sm),
su as (select recording_id, kind from sg where hit group by recording_id, kind, k having count(*) >= 3),
ct as (select recording_id, count(*) filter (kind = 'brady') as brady_events, count(*) filter (kind = 'tachy') as tachy_events from su group by recording_id),
rt as (select recording_id, count(*) filter (60 / rr < lo) as slow_windows, count(*) filter (60 / rr < 60) as under_60_windows, count(*) filter (60 / rr > hi) as fast_windows, count(*) as windows from f5 join cl using (recording_id) group by recording_id)
select rt.*, coalesce(brady_events, 0) as brady_events, coalesce(tachy_events, 0) as tachy_events from rt left join ct using (recording_id)""",
        "waveform_windows": f"""with {SAMPLES}, g as (select recording_id, place // 100 as window_idx, list(x order by place) as s from p group by all having count(*) = 100), t as (select *, list_transform(range(1, 100), lambda i: s[i + 1] - s[i]) as d from g)
select recording_id, window_idx, round(s[1], 6) + 0.0 as first, round(list_max(s) - list_min(s), 6) as ptp, round(len(list_filter(d, lambda q: q = 0)) / 99, 6) as flat_share, round(case when list_var_pop(s) = 0 then 0 else list_var_pop(d) / list_var_pop(s) end, 6) as tone_ratio from t""",
        "waveform_contract": f"""with {SAMPLES}, n as (select recording_id, max(chunk) + 1 as chunks from v group by all)
select recording_id, case when cast(recording_id as int) % 3 = 0 and chunks > 1 then 'leads of unlike length' else 'a name for each lead is missing' end as reason from n where (cast(recording_id as int) % 3 = 0 and chunks > 1) or cast(recording_id as int) % 4 = 0""",
        "waveform_trimmed": f"""with {SAMPLES}, c as (select recording_id, count(*) as total from p group by recording_id), n as (select recording_id, total, total / 20.0::double * (0.3::double + 0.05::double * cast(recording_id as int)) as dur from c), h as (select *, least(total, cast(round_even(dur * 20.0, 0) as bigint)) as keep from n)
select recording_id, keep as n, (keep - 1) // 64 * 64 as last_chunk, cast(keep - (keep - 1) // 64 * 64 as int) as in_last from h""",
        "recordings_assessed": f"""with {SAMPLES}, n as (select recording_id, count(*) / 20.0::double as dur from p group by all), g as (select recording_id, place // 100 as i, list(x order by place) as s from p group by all having count(*) = 100),
t as (select *, list_transform(range(1, 100), lambda i: s[i + 1] - s[i]) as d from g), q as (select *, list_max(s) - list_min(s) as ptp, len(list_filter(d, lambda z: z = 0)) / 99 > 0.9 or list_var_pop(d) / list_var_pop(s) > 3 as isout from t),
md as (select recording_id, median(ptp) filter (not isout) as mid from q group by all), bad as (select recording_id, i from q join md using (recording_id) where isout or ptp > 4 * mid or ptp < 0.1 * mid),
x as (select recording_id, greatest(i * 5.0 - 2, 0) as a, least((i + 1) * 5.0 + 2, dur) as z from bad join n using (recording_id) union all select recording_id, 0, least(60, dur) from n union all select recording_id, greatest(dur - 60, 0), dur from n),
y as (select *, max(z) over (partition by recording_id order by a, z rows between unbounded preceding and 1 preceding) as reach from x), ii as (select *, sum(case when a - reach <= 30 then 0 else 1 end) over (partition by recording_id order by a, z rows between unbounded preceding and current row) as k from y),
sp as (select recording_id, min(a) as a, max(z) as z from ii group by recording_id, k), tot as (select recording_id, count(*) as spans, sum(z - a) as excluded_sec from sp group by all)
select recording_id, round(dur, 6) as duration_sec, 0.0 as trimmed_sec, spans, round(excluded_sec, 6) as excluded_sec from n join tot using (recording_id)
union all select 'short ' || recording_id, cast(length(recording_id) - 1 as double), 0.0, case when length(recording_id) > 1 then 1 else 0 end, cast(length(recording_id) - 1 as double) from n""",
        "presses_kept": f"{FAST}, d as (select recording_id, max(time_sec) * 2 / 3 as dur from b group by all) select recording_id, beat_idx, round(time_sec, 6) as time_sec from b join d using (recording_id) where label = 'U' and time_sec < dur",
        "events_presses": f"""{FAST}, d as (select recording_id, max(time_sec) as dur from b group by all), u as (select recording_id, time_sec as t, 'press ' || beat_idx as label from b where label = 'U'),
n as (select *, row_number() over (partition by recording_id order by t, label) - 1 as position, count(*) over (partition by recording_id) as total from u), s as (select * from n where total <= 5 or exists (select 1 from range(5) as q(i) where round_even(i * (total - 1) / 4.0::double, 0) = position)),
h as (select *, greatest(0.0, t - 3.0) as a from s join d using (recording_id))
select recording_id, 'press' as kind, label, round(t, 6) as start_sec, round(t, 6) as end_sec, position, total, round(a, 6) as strip_start, round(least(dur, a + 6.0), 6) as strip_end from h""",
        "labels_accepted": f"""{FAST}, tr as (select recording_id, time_sec from b where label = 'V'), fl as (select recording_id, time_sec + case when cast(recording_id as bigint) % 5 = 0 then 0.3 else 0.0 end as time_sec from b where label = 'V' and (beat_idx % 9 <> 0 or cast(recording_id as bigint) % 2 = 0)),
h as (select recording_id, exists (select 1 from tr o where o.recording_id = fl.recording_id and (case when o.time_sec <= fl.time_sec then fl.time_sec - o.time_sec else o.time_sec - fl.time_sec end) <= 0.15) as hit from fl),
f as (select recording_id, count(*) as flagged, bool_and(hit) as near from h group by all), t as (select recording_id, count(*) as truth from tr group by all)
select recording_id, truth, coalesce(flagged, 0) as flagged, truth = coalesce(flagged, 0) and coalesce(near, true) as accepted from t left join f using (recording_id)""",
        "windows_by_clock": f"""{day}, k as (select recording_id, case when num % 2 = 1 then num * 1.5 else ((num % 24 * 3600 + num % 60 * 60 + 7 - (start_us // 1000000) % 86400) % 86400 + 86400) % 86400 end as a from rest)
select recording_id, 'seen' as strip_id, round(cast(a as double), 6) as strip_start, round(cast(a as double) + 30, 6) as strip_end from k""",
        "strip_scales": f"""with {SAMPLES}, t as (select recording_id, chunk from v where chunk % 5 = 0), j as (select t.recording_id, chunk as strip_id, x * 12 as x from t join p on p.recording_id = t.recording_id and place >= chunk * 64 and place < chunk * 64 + 96)
select recording_id, strip_id, '25 mm/s, ' || printf('%.0f', round_even(30 / greatest(3.0, ceil(max(x) - min(x) + 0.2)), 0)) || ' mm/mV' as scale from j group by all""",
        "start_overrides": f"""{day}, k as (select recording_id, num, make_timestamp(start_us) as t, case num % 4 when 0 then printf('%d:%02d', num % 24, num % 60) when 1 then printf('2026-08-%02d 07:08:%02d', num % 28 + 1, num % 60) when 2 then 'soon' end as o from rest)
select recording_id, case num % 4 when 0 then strftime(t, '%Y-%m-%d ') || printf('%02d:%02d:00', num % 24, num % 60) when 1 then o else strftime(t, '%Y-%m-%d %H:%M:%S') end as start_text, case when num % 4 = 2 then o end as rejected from k""",
        "card_blocks": f"""with {CARDS} select path, i + 1 as block_idx, true as ecg, false as empty, case when fault = 0 and i = 2 then 'checksum' end as error, cast(seq as int) as sequence, cast(event_id % 7 as int) as detail, cast(press as int) as press, fault <> 2 as live from c
union all select distinct path, 0, false, false, null, 0, 0, 0, false from c""",
        "card_sessions": f"with {CARDS} select path, count(*) as blocks, max(i) + 1 as last_block, max(i) as last_ordinal from k group by path",
        "card_headers": f"""with {CARDS}, h as (select path, any_value(fault) as fault, make_timestamp(min(us)) as t from c group by path)
select path, case when fault <> 3 then '180' end as rate, case when fault = 4 then '13/45/10' else strftime(t, '%m/%d/%y') end as start_date, case when fault <> 4 then strftime(t, '%Y-%m-%d %H:%M:%S') end as start_text from h""",
        "card_rejects": f"""with {CARDS}, h as (select path, any_value(fault) as fault, count(*) as n from k group by path)
select path, case when fault = 0 then 'checksum' when fault = 1 then 'not contiguous' when fault = 2 then 'only markers' when fault = 3 then 'unsupported rate' else 'bad start date' end as reason from h where (fault = 0 and n > 2) or (fault = 1 and n > 3) or fault in (2, 3, 4)""",
        "card_presses": f"""with {CARDS}, g as (select path, any_value(fault) as fault, count(*) as n from k group by path), good as (select path from g where not ((fault = 0 and n > 2) or (fault = 1 and n > 3) or fault in (2, 3, 4)))
select path as recording_id, round(i * 304 / 180.0::double, 6) as time_sec, cast(press as int) as type_index, case press when 1 then 'Manual Event' when 2 then 'Chest Pain' when 3 then 'Cough' else 'Event type ' || press end as label, cast(event_id % 7 as int) as detail from k semi join good using (path) where press <> 0""",
        "card_waveforms": f"""with {CARDS}, g as (select path, any_value(fault) as fault, count(*) as n from k group by path), good as (select path from g where not ((fault = 0 and n > 2) or (fault = 1 and n > 3) or fault in (2, 3, 4))),
z as (select path, i, ch, pt, user_id % 10 = 5 and ((i % 3 = 1 and pt = 303) or (i % 3 = 2 and pt < 2)) as mark, case when mark then 0 else {DECODE}[(event_id + pt * (ch + 1) + i) % 16 + 1] end as delta from k semi join good using (path), range(3) as a(ch), range(304) as t(pt)),
y as (select path, i, ch, pt, mark, 0.0125::double * sum(delta) over w as x, i * 304 + pt as place from z window w as (partition by path, ch order by i, pt rows unbounded preceding)),
o as (select *, last_value(case when not mark then place end ignore nulls) over w as p0, last_value(case when not mark then x end ignore nulls) over w as x0,
  first_value(case when not mark then place end ignore nulls) over v as p1, first_value(case when not mark then x end ignore nulls) over v as x1 from y
  window w as (partition by path, ch order by place rows unbounded preceding), v as (partition by path, ch order by place rows between current row and 5 following)),
s as (select path, i, ch, pt, case when not mark then x when p1 is null then x0 else x0 + (x1 - x0) * (place - p0) / (p1 - p0) end as x from o)
select path as recording_id, cast(ch as int) as channel, i * 304 as first_sample, cast(count(*) as int) as n, round(arg_min(x, pt), 6) + 0.0 as first, round(arg_max(x, pt), 6) + 0.0 as last, round(min(x), 6) + 0.0 as lowest, round(max(x), 6) + 0.0 as highest from s group by path, ch, i""",
    }


def _oracle_sql() -> dict[str, str]:
    band = """case when l is null or l < 2.5 then 'ok' when l <= 5 then 'caution' else 'alert' end"""
    return {
        "beats_burden": f"{FAST} select recording_id, count(*) as total_beats, count(*) filter (label = 'V') as pvc_count, round(count(*) filter (label = 'V') / count(*) * 100, 6) as burden_pct from b group by recording_id",
        "beats_runs": f"{FAST}, {RUNS} select recording_id, label, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, beats, round(bpm, 6) as bpm from r",
        "beats_run_counts": f"{FAST}, {RUNS}, {COUNTS} select recording_id, couplets, triplets, vt_runs, escape_couplets, escape_runs, l.n as longest_beats, round(-l.s, 6) + 0.0 as longest_start, round(f.n, 6) as fastest_bpm, round(-f.s, 6) + 0.0 as fastest_start from c",
        "beats_pauses": f"{FAST} select recording_id, count(*) filter (rr_sec >= 2.5) as pauses, count(*) filter (rr_sec > 5.0) as long_pauses, round(max(rr_sec), 6) as longest_sec from b group by recording_id",
        "beats_sustained": f"""{FAST}, kinds as (select 'brady' as kind union all select 'tachy'),
m as (select b.*, kind, case when rr_sec > 0 then (case kind when 'brady' then 60 / rr_sec < 50 else 60 / rr_sec > 160 end) else false end as hit from b, kinds),
g as (select *, sum(case when hit then 0 else 1 end) over (partition by recording_id, kind order by time_sec, beat_idx rows between unbounded preceding and current row) as k from m)
select recording_id, kind, round(min_by(time_sec - rr_sec, beat_idx), 6) + 0.0 as start_sec, round(max(time_sec), 6) as end_sec, count(*) as beats from g where hit group by recording_id, kind, k having count(*) >= 3""",
        "beats_rate_stats": f"""{FAST}, {WINDOWS5}, a as (select recording_id, max(struct_pack(r := rr, t := -time_sec)) as s, min(struct_pack(r := rr, t := time_sec)) as f,
  count(*) filter (60 / rr < 50) as slow_windows, count(*) filter (60 / rr < 60) as under_60_windows, count(*) filter (60 / rr > 160) as fast_windows, count(*) as windows from f5 group by recording_id),
mn as (select recording_id, 60 / avg(rr_sec) as mean_bpm from b where rr_sec <> 0 group by recording_id)
select recording_id, round(60 / s.r, 6) as min_bpm, round(-s.t, 6) as min_time, round(60 / f.r, 6) as max_bpm, round(f.t, 6) as max_time, slow_windows, under_60_windows, fast_windows, windows, round(mean_bpm, 6) as mean_bpm from a join mn using (recording_id)""",
        "beats_variability": f"""{FAST}, n as (select *, case when label = 'N' and lag(label) over {P} = 'N' and rr_sec <> 0 then rr_sec * 1000 end as nn from b), dd as (select *, nn - lag(nn) over {P} as d from n)
select recording_id, count(nn) as nn, round(case when count(d) >= 2 then stddev_pop(nn) end, 6) as sdnn_ms, round(case when count(d) >= 2 then sqrt(avg(d * d)) end, 6) as rmssd_ms,
  round(case when count(d) >= 2 then avg(case when d is null then null when abs(d) > 50 then 1.0 else 0.0 end) * 100 end, 6) as pnn50_pct from dd group by recording_id""",
        "beats_sinus_intervals": f"{FAST}, {SINUS} select recording_id, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, escape_beats from s",
        "beats_sinus_summary": f"""{FAST}, {SINUS}, a as (select recording_id, count(*) filter (escape_beats >= 1) as arrests, max(struct_pack(d := end_sec - start_sec, s := -start_sec, e := escape_beats)) as l from s group by recording_id)
select recording_id, arrests, round(l.d, 6) as longest_sec, round(-l.s, 6) + 0.0 as longest_start, l.e as longest_escapes from a""",
        "beats_trend": f"""{DAY}, k as (select recording_id, cast(floor(time_sec / 60) as bigint) as bin, case when count(*) >= 2 then 60 / median(rr_sec) end as bpm from b where rr_sec <> 0 group by all),
g as (select recording_id, unnest(range(0, max(bin) + 1)) as bin from k group by recording_id)
select recording_id, (bin + 0.5) * 60.0 as centre_sec, round(bpm, 6) as bpm from g left join k using (recording_id, bin)""",
        "beats_hourly": f"""{DAY}, {REST}, {GRID}, {WINDOWS5.replace("from b where", "from bb where")},
h as (select bb.*, f, case when time_sec < f then 0 else 1 + cast(floor((time_sec - f) / 3600) as bigint) end as hour from bb join rest using (recording_id)),
n as (select recording_id, hour, count(*) as beats, count(*) filter (label = 'V') as pvcs, count(*) filter (label = 'E') as escapes, count(*) filter (rr_sec >= 2.5) as pauses, count(*) filter (rr_sec <> 0) as rrs, avg(rr_sec) filter (rr_sec <> 0) as rr from h group by all),
m as (select *, case when label = 'V' and lag(label) over {P} = 'V' then 0 else 1 end as new from h), mm as (select *, sum(new) over {UPTO} as run from m),
r1 as (select recording_id, run, min(hour) as hour, count(*) as n from mm where label = 'V' group by recording_id, run),
r as (select recording_id, hour, count(*) filter (n = 2) as couplets, count(*) filter (n >= 3) as runs from r1 group by all),
w as (select recording_id, case when time_sec < f then 0 else 1 + cast(floor((time_sec - f) / 3600) as bigint) end as hour, 60 / max(rr) as lo, 60 / min(rr) as hi from f5 join rest using (recording_id) group by all)
select recording_id, hour, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, coalesce(beats, 0) as beats, coalesce(pvcs, 0) as pvcs, coalesce(escapes, 0) as escapes,
  coalesce(couplets, 0) as couplets, coalesce(runs, 0) as runs, coalesce(pauses, 0) as pauses, round(case when rrs >= 5 and lo is not null then lo end, 6) as min_bpm, round(case when rrs >= 5 and lo is not null then 60 / rr end, 6) as mean_bpm, round(case when rrs >= 5 and lo is not null then hi end, 6) as max_bpm
from grid left join n using (recording_id, hour) left join r using (recording_id, hour) left join w using (recording_id, hour)""",
        "beats_screening": f"""{FAST}, {RUNS}, {COUNTS}, a as (select recording_id, count(*) as total_beats, count(*) filter (label = 'V') as pvc_count, count(*) filter (rr_sec >= 2.5) as pauses, max(rr_sec) as l, max(time_sec) as s from b group by recording_id),
j as (select a.recording_id, total_beats, pvc_count, pauses, a.l, s, coalesce(couplets, 0) as couplets, coalesce(triplets, 0) as triplets, coalesce(vt_runs, 0) as vt_runs, c.f.n as fast, case when s >= 72.0 then pvc_count * 86400.0 / s end as p from a left join c using (recording_id))
select recording_id, total_beats, pvc_count, round(pvc_count / total_beats * 100, 6) as burden_pct, couplets, triplets, vt_runs, round(fast, 6) as fastest_bpm, pauses, round(l, 6) as longest_sec, round(s, 6) as analyzed_sec, round(p, 6) as pvc_per_24h,
  case when p < 50 then 'ok' when p <= 300 then 'caution' when p is not null then 'alert' end as pvc_status, case when vt_runs = 0 then 'ok' else 'alert' end as vt_status, case when fast is null then 'ok' when fast >= 180 then 'alert' else 'caution' end as rate_status,
  {band} as pause_status, case when s >= 72.0 then 'ok' else 'caution' end as analyzed_status from j""",
        "beats_typical": f"""{FAST}, {TYPICAL}
select recording_id, beat_idx, round(time_sec, 6) as time_sec, round(rr_sec, 6) as rr_sec, round(qrs_sec, 6) as qrs_sec, label, round(list_median(list_transform(k, lambda x: x.r)), 6) as typical_rr, round(list_median(list_transform(k, lambda x: x.q)), 6) as typical_qrs from t""",
        "windows_bad": f"with {BAD} select recording_id, window_idx, round(ptp, 6) as ptp, round(flat_share, 6) as flat_share, round(tone_ratio, 6) as tone_ratio, lead_off, bad from bw",
        "windows_islands": f"with {BAD}, i as (select recording_id, window_idx, window_idx - row_number() over (partition by recording_id order by window_idx) as k from bw where bad) select recording_id, min(window_idx) as first, max(window_idx) + 1 as after from i group by recording_id, k",
        "spans_merged": f"{FAST}, {SPANS} select recording_id, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec from spans",
        "spans_analyzed": f"{FAST}, {SPANS}, l as (select recording_id, sum(end_sec - start_sec) as lost from spans group by recording_id) select recording_id, round(duration_sec, 6) as duration_sec, round(coalesce(lost, 0), 6) as excluded_sec, round(duration_sec - coalesce(lost, 0), 6) as analyzed_sec from d left join l using (recording_id)",
        "beats_excluded": f"""{FAST}, {SPANS}, kept as (select * from b where not exists (select 1 from spans s where s.recording_id = b.recording_id and b.time_sec between s.start_sec and s.end_sec)),
p as (select *, lag(time_sec) over {P} as prior from kept)
select recording_id, beat_idx, round(time_sec, 6) as time_sec, round(case when exists (select 1 from spans s where s.recording_id = p.recording_id and s.start_sec < p.time_sec and s.end_sec > p.prior) then null else rr_sec end, 6) as rr_sec, round(qrs_sec, 6) as qrs_sec, label from p""",
        "windows_kept": f"""with {BAD}, c as (select *, coalesce(sum(lead_off::int) over (partition by recording_id order by window_idx rows between unbounded preceding and 1 preceding), 0) as so_far from bw),
wh as (select recording_id, count(*) as windows, sum(lead_off::int) as offs, bool_and(bad) as throughout from c group by recording_id),
i as (select recording_id, window_idx, so_far, window_idx - row_number() over (partition by recording_id order by window_idx) as k from c where lead_off),
ru as (select recording_id, min(window_idx) as first, min(so_far) as so_far, count(*) as n from i group by recording_id, k having count(*) >= 2),
ta as (select recording_id, min(first) as tail from ru join wh using (recording_id) where not throughout and offs - so_far >= 0.2 * (windows - first) group by recording_id),
ba as (select recording_id, window_idx, tail, coalesce(lead(window_idx) over (partition by recording_id order by window_idx), tail) as nx from bw join ta using (recording_id) where bad and window_idx < tail),
mv as (select recording_id, min(window_idx) as moved from ba where not exists (select 1 from ba o where o.recording_id = ba.recording_id and o.window_idx >= ba.window_idx and o.nx - o.window_idx - 1 >= 3) group by recording_id)
select recording_id, windows, coalesce(moved, tail, windows) as kept from wh left join ta using (recording_id) left join mv using (recording_id)""",
        "events_catalogue": f"""{FAST}, {TYPICAL}, y as (select recording_id, beat_idx, time_sec, rr_sec, qrs_sec, label, list_median(list_transform(k, lambda x: x.r)) as tr, list_median(list_transform(k, lambda x: x.q)) as tq, coalesce(label = lag(label) over {P}, false) as same from t),
g as (select *, sum(case when same then 0 else 1 end) over {UPTO} as run from y),
r as (select recording_id, label, min(time_sec) as start_sec, max(time_sec) as end_sec, count(*) as beats, 60 / avg(case when same and rr_sec <> 0 then rr_sec end) as bpm, arg_min(struct_pack(r := tr, q := tq), beat_idx) as f, count(rr_sec) as rrs, max(qrs_sec) as widest_sec
  from g where label in ('V', 'E') group by recording_id, run, label)
select recording_id, label, case when label = 'V' then case when beats = 1 then 'isolated' when beats = 2 then 'couplet' when beats = 3 then 'triplet' when bpm >= 180 then 'tachycardia' else 'slower run' end when beats = 1 then 'escape' when beats = 2 then 'escape couplet' else 'escape run' end as kind,
  round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, beats, round(bpm, 6) as bpm, round(f.r, 6) as typical_rr, round(f.q, 6) as typical_qrs, case when label = 'V' and beats > 1 then case when beats < 4 or bpm >= 180 then 'alert' else 'caution' end end as status, cast(rrs as int) as rrs, round(widest_sec, 6) as widest_sec from r""",
        "events_strips": f"""{FAST}, {RUNS}, d as (select recording_id, max(time_sec) as duration_sec from b group by recording_id),
n as (select recording_id, label, start_sec, end_sec, beats, row_number() over (partition by recording_id, label order by start_sec) - 1 as position, count(*) over (partition by recording_id, label) as total from r),
s as (select * from n where total <= 4 or exists (select 1 from range(4) as q(i) where round_even(i * (total - 1) / 3.0::double, 0) = position)),
w as (select *, greatest(6.0, end_sec - start_sec + 2.0) / 2 as half from s join d using (recording_id)), v as (select *, greatest(0.0, (start_sec + end_sec) / 2 - half) as strip_start from w)
select recording_id, label, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, beats, position, total, round(strip_start, 6) as strip_start, round(least(duration_sec, strip_start + 2 * half), 6) as strip_end from v""",
        "events_extremes": f"""{FAST}, {WINDOWS5}, {SINUS}, {RUNS}, a as (select recording_id, max(struct_pack(r := rr, t := -time_sec)) as slow, min(struct_pack(r := rr, t := time_sec)) as fast from f5 group by recording_id),
pb as (select *, coalesce(lag(time_sec) over {P}, time_sec) as prior from b), ps as (select recording_id, max(struct_pack(r := rr_sec, t := -time_sec, p := prior)) as w from pb where rr_sec >= 2.5 group by recording_id),
sl as (select recording_id, max(struct_pack(d := end_sec - start_sec, s := -start_sec, e := escape_beats)) as l from s group by recording_id), fr as (select recording_id, max(struct_pack(b := bpm, s := -start_sec, e := end_sec)) as x from r where label = 'V' and bpm is not null group by recording_id),
o as (select recording_id, 'fastest rate' as kind, fast.t as start_sec, fast.t as end_sec, 60 / fast.r as value from a union all select recording_id, 'slowest rate', -slow.t, -slow.t, 60 / slow.r from a
  union all select recording_id, 'longest pause', w.p, -w.t, w.r from ps semi join a using (recording_id) union all select recording_id, 'longest sinus interval', -l.s, -l.s + l.d, l.d from sl semi join a using (recording_id) where l.e > 0 union all select recording_id, 'fastest run', -x.s, x.e, x.b from fr semi join a using (recording_id))
select recording_id, kind, round(start_sec, 6) + 0.0 as start_sec, round(end_sec, 6) + 0.0 as end_sec, round(value, 6) as value from o""",
        "events_hour_samples": f"""{DAY}, h as (select *, 3600.0 - (start_us % 3600000000) / 1e6 as f from b), k as (select recording_id, beat_idx, time_sec, case when time_sec < f then 0 else 1 + cast(floor((time_sec - f) / 3600) as bigint) end as hour from h),
x as (select recording_id, hour, min(struct_pack(t := time_sec, i := beat_idx)) as m from k group by all), n as (select *, row_number() over (partition by recording_id order by hour) - 1 as position, count(*) over (partition by recording_id) as total from x)
select recording_id, hour, m.i as beat_idx, position, total from n where total <= 6 or exists (select 1 from range(6) as q(i) where round_even(i * (total - 1) / 5.0::double, 0) = position)""",
        "detection_scores": f"""{FAST}, h as (select recording_id, time_sec, exists (select 1 from b o where o.recording_id = b.recording_id and o.label = 'E' and (case when o.time_sec <= b.time_sec then b.time_sec - o.time_sec else o.time_sec - b.time_sec end) <= 0.4) as hit from b where label = 'V'),
t as (select recording_id, count(*) as truth, count(*) filter (hit) as hits from h group by recording_id), f as (select recording_id, count(*) as found from b where label = 'E' group by recording_id)
select recording_id, truth, coalesce(found, 0) as found, hits, round(hits / truth, 6) as sensitivity, round(hits / greatest(1, coalesce(found, 0)), 6) as precision from t left join f using (recording_id)""",
        "hourly_analyzed": f"{DAY}, {REST}, {GRID}, {HOURS} select recording_id, hour, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, round(analyzed_sec, 6) as analyzed_sec from ha",
        "timeline_lanes": f"""{FAST}, {SUSTAINED}, l as (select recording_id, 'press' as lane, time_sec as start_sec, time_sec as end_sec from b where label = 'U' union all select recording_id, 'pvc', time_sec, time_sec from b where label = 'V'
  union all select recording_id, 'escape', time_sec, time_sec from b where label = 'E' union all select recording_id, 'pause', time_sec, time_sec from b where rr_sec >= 2.5 union all select recording_id, kind, start_sec, greatest(end_sec, start_sec + 5.0) from su)
select recording_id, lane, round(start_sec, 6) + 0.0 as start_sec, round(end_sec, 6) as end_sec from l""",
        "timeline_spans": f"{FAST}, {SUSTAINED}, t as (select recording_id, time_sec as t from b union all select recording_id, end_sec from su) select recording_id, round(greatest(60.0, max(t)), 6) as span_sec from t group by recording_id",
        "strip_beats": f"""{FAST}, {RUNS}, d as (select recording_id, max(time_sec) as duration_sec from b group by recording_id),
h as (select r.recording_id, start_sec as s, end_sec as e, greatest(6.0, end_sec - start_sec + 2.0) / 2 as half, duration_sec from r join d using (recording_id) where label = 'V'),
w as (select *, greatest(0.0, (s + e) / 2 - half) as a from h), i as (select b.recording_id, beat_idx, time_sec, rr_sec, label, s, abs(time_sec - s) < 1e-6 or abs(time_sec - e) < 1e-6 as mark from w join b on b.recording_id = w.recording_id and b.time_sec between a and least(duration_sec, a + 2 * half)),
n as (select *, count(*) over (partition by recording_id, s) as n, lag(mark) over (partition by recording_id, s order by time_sec, beat_idx) as prior from i)
select distinct recording_id, beat_idx, round(time_sec, 6) as time_sec, case when label in ('N', 'V', 'E') then label else '?' end as letter, case when prior is not null and (n <= 8 or mark or prior) and rr_sec <> 0 then printf('%.2f s', round_even(rr_sec, 2)) end as rr_text from n""",
        "strip_waveforms": """with v as (select cast(label as varchar) as recording_id, row_number() over (partition by label order by vec_id) - 1 as window_idx, list_transform(embedding, lambda x: round(cast(x as double), 2)) as s from embeddings),
n as (select *, count(*) over (partition by recording_id) as total from v), t as (select recording_id, window_idx from n where total <= 10 or exists (select 1 from range(10) as q(i) where round_even(i * (total - 1) / 9.0::double, 0) = window_idx)),
p as (select recording_id, window_idx * 64 + i - 1 as place, s[i] as x from v, range(1, 65) as q(i)), j as (select t.recording_id, t.window_idx as strip_id, place, x from t join p on p.recording_id = t.recording_id and place >= t.window_idx * 64 and place < t.window_idx * 64 + 96),
m as (select recording_id, strip_id, count(*) as n, min(x) as lo, max(x) as hi, arg_min(x, place) as f, median(x) as m from j group by all)
select recording_id, strip_id, 0 as channel, cast(n as int) as n, round(lo - m, 6) as lowest, round(hi - m, 6) as highest, round(f - m, 6) + 0.0 as first, greatest(3.0, ceil(hi - lo + 0.2)) as range_mv from m""",
    }


def _reports(of: dict[str, str]) -> dict[str, str]:
    """The summary, its panels, the strips of a report, planted beats: put together from the SQL of their parts."""
    parts = {"bu": "beats_burden", "rc": "beats_run_counts", "pa": "beats_pauses", "va": "beats_variability", "si": "beats_sinus_summary", "rs": "beats_rate_stats", "cr": "beats_class_rates", "ru": "beats_runs"}
    whole = f"""with {", ".join(f"{k} as ({of[v]})" for k, v in parts.items())}, {FAST.removeprefix("with ")}, {SPANS},
sp as (select recording_id, any_value(duration_sec) as duration_sec, sum(s.end_sec - s.start_sec) as excluded_sec, any_value(duration_sec) - sum(s.end_sec - s.start_sec) as analyzed_sec from d join spans s using (recording_id) group by all),
lr as (select recording_id, max(struct_pack(n := beats, s := -start_sec, b := bpm)) as l, max(struct_pack(b := bpm, s := -start_sec, n := beats)) as f from ru where label = 'V' and bpm is not null group by all),
dd as (select recording_id, max(time_sec) as last, count(*) filter (label = 'E') as escapes, min(start_us) as us0 from b group by all),
pr as (select recording_id, count(*) as presses from b join dd using (recording_id) where label = 'U' and time_sec < last group by all),
su as (select bu.recording_id, us0, sp.duration_sec, sp.analyzed_sec, sp.excluded_sec * (cast(recording_id as bigint) % 2) as trimmed_sec, cast([60, 50, 45][cast(recording_id as bigint) % 3 + 1] as double) as brady_bpm, cast([180, 160, 150][cast(recording_id as bigint) % 3 + 1] as double) as tachy_bpm,
  coalesce(presses, 0) as presses, total_beats, pvc_count, escapes, burden_pct, coalesce(couplets, 0) as couplets, coalesce(triplets, 0) as triplets, coalesce(vt_runs, 0) as vt_runs, coalesce(escape_couplets, 0) as escape_couplets, coalesce(escape_runs, 0) as escape_runs,
  pauses, long_pauses, pa.longest_sec as longest_pause, mean_bpm, min_bpm, min_time, max_bpm, max_time, cr.slow_windows, cr.under_60_windows, cr.fast_windows, cr.windows, nn, sdnn_ms, rmssd_ms, pnn50_pct,
  coalesce(arrests, 0) as arrests, si.longest_sec as longest_sinus, coalesce(brady_events, 0) as brady_events, coalesce(tachy_events, 0) as tachy_events, lr.l.n as longest_beats, lr.l.b as longest_bpm, lr.f.n as fastest_beats, lr.f.b as fastest_bpm,
  case when sp.analyzed_sec >= 72 then round(pvc_count * 86400.0 / sp.analyzed_sec, 6) end as pvc_per_24h
  from bu left join rc using (recording_id) left join pa using (recording_id) left join va using (recording_id) left join si using (recording_id) left join rs using (recording_id) left join cr using (recording_id)
  left join sp using (recording_id) left join lr using (recording_id) join dd using (recording_id) left join pr using (recording_id))"""
    fixed = lambda c, n=0: f"printf('%.{n}f', round_even({c}, {n}))"
    hours = lambda c: f"printf('%dh %dm', cast(floor(({c}) / 3600) as bigint), cast(floor(({c}) % 3600 / 60) as bigint))"
    text = lambda c: f"cast({c} as varchar)"
    rate = lambda v, at: f"{fixed(v)} || ' bpm at ' || strftime(make_timestamp(us0 + cast(round({at} * 1e6) as bigint)), '%H:%M:%S')"
    share = lambda n: f"case when windows > 0 then {n} || ' (' || {fixed(f'100.0::double * {n} / windows')} || '%)' else '0 (0%)' end"
    run = lambda n, b: f"coalesce({n} || ' beats, ' || {fixed(b)} || ' bpm', 'none')"
    gap = lambda c: f"case when {c} is null or {c} < 2.5 then 'ok' when {c} <= 5 then 'caution' else 'alert' end"
    sec = lambda c: f"coalesce({fixed(c, 2)} || ' s', 'n/a')"
    none = lambda c: f"case when {c} = 0 then 'ok' else 'alert' end"
    rated, varied, day = "mean_bpm is not null", "sdnn_ms is not null", "case when pvc_per_24h < 50 then 'ok' when pvc_per_24h <= 300 then 'caution' when pvc_per_24h is not null then 'alert' end"
    panels = {
        "Recording": [
            ("'Start'", "strftime(make_timestamp(us0), '%Y-%m-%d %H:%M:%S')"), ("'Duration'", hours("duration_sec")), ("'Recorder ran'", hours("duration_sec + trimmed_sec"), "'time worn and time after it'", "null", "trimmed_sec > 0"),
            ("'Analyzed'", f"{hours('analyzed_sec')} || ' (' || {fixed('100 * analyzed_sec / duration_sec')} || '%)'", "'20 h or more'", "case when analyzed_sec >= 72000 then 'ok' else 'caution' end"), ("'Excluded'", hours("duration_sec - analyzed_sec")), ("'Total beats'", text("total_beats")), ("'Diary events'", text("presses")),
        ],
        "Heart rate": [
            ("'Mean'", f"{fixed('mean_bpm')} || ' bpm'", "null", "null", rated), ("'Slowest'", rate("min_bpm", "min_time"), "'5-beat median'", "null", rated), ("'Fastest'", rate("max_bpm", "max_time"), "'5-beat median'", "null", rated), ("'Under 60 bpm'", share("under_60_windows"), "'5-beat median'", "null", rated),
            (f"'Under ' || {fixed('brady_bpm')} || ' bpm'", share("slow_windows"), "'5-beat median'", "null", f"{rated} and brady_bpm <> 60"), (f"'Over ' || {fixed('tachy_bpm')} || ' bpm'", share("fast_windows"), "'5-beat median'", "null", rated), ("'Heart rate'", "'not computed'", "null", "null", f"not ({rated})"),
            ("'Brady events'", text("brady_events"), "'3 beats or more'"), ("'Tachy events'", text("tachy_events"), "'3 beats or more'"),
        ],
        "Ventricular ectopy": [
            ("'PVCs'", f"pvc_count || ' (' || {fixed('burden_pct', 2)} || '%)'"), ("'PVCs per 24 h'", f"coalesce({fixed('pvc_per_24h')}, 'n/a')", "'under 50 / to 300 / over'", day),
            *[(f"'{label}'", text(c), "'0'", none(c)) for label, c in (("Couplets", "couplets"), ("Triplets", "triplets"), ("VT runs (4+)", "vt_runs"))], *[(f"'{label}'", text(c)) for label, c in (("Escape beats", "escapes"), ("Escape couplets", "escape_couplets"), ("Escape runs (3+)", "escape_runs"))],
            ("'Longest run'", run("longest_beats", "longest_bpm")), ("'Fastest run'", run("fastest_beats", "fastest_bpm"), "'180 bpm'", "case when fastest_bpm is null then 'ok' when fastest_bpm >= 180 then 'alert' else 'caution' end"),
        ],
        "Supraventricular ectopy": [("'SVPBs'", "'not assessed'")],
        "Pauses": [
            ("'Pauses'", text("pauses"), "'>= 2.5 s'"), ("'Long pauses'", text("long_pauses"), "'> 5 s'"), ("'Longest'", sec("longest_pause"), "'2.5 s / 5 s'", gap("longest_pause")),
            ("'Sinus interval'", sec("longest_sinus"), "null", f"case when longest_sinus is not null then {gap('longest_sinus')} end"), ("'Sinus arrests'", text("arrests"), "'bridged by escape beats'"),
        ],
        "RR variability": [
            ("'SDNN'", f"{fixed('sdnn_ms')} || ' ms'", "nn || ' NN intervals'", "null", varied), ("'RMSSD'", f"{fixed('rmssd_ms')} || ' ms'", "null", "null", varied), ("'pNN50'", f"{fixed('pnn50_pct')} || '%'", "null", "null", varied), ("'RR variability'", "'not computed'", "null", "null", f"not ({varied})"),
        ],
    }
    rows = [
        f"select recording_id, cast({p} as int) as panel_no, '{panel}' as panel, cast({r} as int) as row_no, {label} as label, {value} as value, cast({(*rest, 'null')[0]} as varchar) as reference, cast({(*rest, 'null', 'null')[1]} as varchar) as status from su where {rest[2] if len(rest) > 2 else 'true'}"
        for p, (panel, lines) in enumerate(panels.items()) for r, (label, value, *rest) in enumerate(lines)
    ]
    plain = lambda sql: sql.replace("round(start_sec, 6)", "start_sec").replace("round(end_sec, 6)", "end_sec")
    caps = "case section when 'extremes' then 24 when 'presses' then 4 when 'isolated' then 5 when 'escapes' then 3 else 2 end"
    return {
        "recordings_summary": f"{whole} select * exclude (us0, duration_sec, analyzed_sec, trimmed_sec) from su",
        "report_panels": f"{whole} {' union all '.join(rows)}",
        "strip_sections": f"""with ca as ({plain(of["events_catalogue"])}), ex as ({plain(of["events_extremes"])}), {FAST.removeprefix("with ")}, d as (select recording_id, max(time_sec) as duration_sec from b group by all),
x as (select recording_id, case when label = 'E' then 'escapes' when beats > 1 then 'runs' else 'isolated' end as section, kind, start_sec, end_sec from ca union all select recording_id, 'extremes', kind, start_sec, end_sec from ex
  union all select recording_id, 'presses', 'press', time_sec, time_sec from b where label = 'U'
  union all select recording_id, 'hours', 'hour ' || case when time_sec < 7.5 then 0 else 1 + cast(floor((time_sec - 7.5) / 3600) as bigint) end as kind, min(time_sec), min(time_sec) from b group by recording_id, kind),
n as (select *, row_number() over (partition by recording_id, section order by start_sec, end_sec, kind) - 1 as position, count(*) over (partition by recording_id, section) as total, {caps} as cap from x),
s as (select * from n where total <= cap or exists (select 1 from range(24) as q(i) where i < cap and round_even(i * (total - 1) / (cap - 1)::double, 0) = position)),
w as (select *, greatest(6.0, end_sec - start_sec + 2.0) / 2 as half from s join d using (recording_id)), v as (select *, greatest(0.0, (start_sec + end_sec) / 2 - half) as strip_start from w)
select recording_id, section, kind, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, position, total, round(strip_start, 6) as strip_start, round(least(duration_sec, strip_start + 2 * half), 6) as strip_end from v""",
        "archive_grown": f"with q as ({of['beats_burden']}) select recording_id, case when cast(recording_id as bigint) % 3 = 0 then pvc_count + 100 else pvc_count end as pvc_count, case when cast(recording_id as bigint) % 3 = 0 then 'c-2' else 'c-1' end as commit from q",
        "card_kinds": "select cast(user_id as varchar) as path, case when user_id % 4 = 0 or (user_id % 4 <> 1 and user_id % 10 <> 3) then 'native' else 'unsupported' end as kind from events group by user_id",
        "waveform_planted": """with p as (select cast(user_id as varchar) as recording_id, event_type, 540 + sum((event_id % 4 + 7) * 18) over (partition by user_id order by epoch_us(ts), event_id) as place from events),
n as (select *, row_number() over w - 1 as beat_idx, place - lag(place) over w as gap from p where event_type <> 'signup' window w as (partition by recording_id order by place))
select recording_id, beat_idx, round(place / 180.0::double, 1) as time_sec, round(gap / 180.0::double, 1) as rr_sec, event_type = 'purchase' as wide from n""",
    }
