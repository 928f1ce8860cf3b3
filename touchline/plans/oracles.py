"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

GAP = 172_801

_FX = """fx as (select o_orderkey as fid, cast(o_orderkey % 3 as int) as lg, cast(epoch(o_orderdate) as bigint) as ko, cast(year(o_orderdate) as int) as se,
  o_custkey % 20 as h, (o_custkey % 20 + 1 + o_orderkey % 19) % 20 as a, (o_orderkey * 7 + o_custkey * 3) % 5 as hg, (o_orderkey * 11 + o_custkey * 5) % 4 as ag, o_orderstatus <> 'P' as fin from orders)"""
_AP = """ap as (select fid, lg, ko, fin, 1 as ish, h as team, a as opp, hg as gf, ag as ga, case when hg > ag then 3 when hg = ag then 1 else 0 end as pts from fx
  union all select fid, lg, ko, fin, 0, a, h, ag, hg, case when ag > hg then 3 when hg = ag then 1 else 0 end from fx)"""


def _last_five(on: str = "", when: str = f"s.ko <= p.ko - {GAP}") -> str:
    return f"""with {_FX}, {_AP},
r as (select p.fid, p.ish, p.ko, s.pts, s.gf, s.ga, s.ko as sko, row_number() over (partition by p.fid, p.ish order by s.ko desc, s.fid desc) as rn
  from ap p left join ap s on s.lg = p.lg and s.team = p.team and s.fin and {when} {on}),
f as (select fid, ish, any_value(ko) as ko, sum(pts) as pts, sum(gf) as gf, sum(ga) as ga, max(sko) as sko from r where rn <= 5 group by fid, ish)
"""


def _sides(columns: dict[str, tuple[int, str]]) -> str:
    return "select fid as fixture_id, " + ", ".join(f"cast(max(case when ish = {i} then {e} end) as double) as {n}" for n, (i, e) in columns.items()) + " from f group by fid"


_POINTS = {"home_points_sum_5": (1, "pts"), "away_points_sum_5": (0, "pts")}
_GOALS = {"home_goals_for_sum_5": (1, "gf"), "home_goals_against_sum_5": (1, "ga"), "away_goals_for_sum_5": (0, "gf"), "away_goals_against_sum_5": (0, "ga")}
_VENUE = {"home_home_points_sum_5": (1, "pts"), "home_home_goal_diff_sum_5": (1, "gf - ga"), "away_away_points_sum_5": (0, "pts"), "away_away_goal_diff_sum_5": (0, "gf - ga")}
_REST = "case when sko is not null then round(least((ko - sko) / 86400E0, 30E0), 6) end"

_PRED = """o as (select o_orderkey as key, cast(year(o_orderdate) as int) as season, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as block,
  case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 end as y,
  cast(1 + o_orderkey % 7 as double) as w1, cast(1 + o_custkey % 5 as double) as w2, cast(1 + (o_orderkey + o_custkey) % 6 as double) as w3 from orders),
q as (select key, season, block, y, (w1 + w2 + w3) / (w1 * 1.06E0) as o1, (w1 + w2 + w3) / (w2 * 1.06E0) as o2, (w1 + w2 + w3) / (w3 * 1.06E0) as o3 from o),
m as (select 'uniform' as model_id, 0 as ord, key, season, block, y, 1E0 / 3E0 as p1, 1E0 / 3E0 as p2, 1E0 / 3E0 as p3 from q union all
  select 'proportional', 1, key, season, block, y, (1 / o1) / (1 / o1 + 1 / o2 + 1 / o3), (1 / o2) / (1 / o1 + 1 / o2 + 1 / o3), (1 / o3) / (1 / o1 + 1 / o2 + 1 / o3) from q union all
  select 'sharpened', 2, key, season, block, y, (1 / (o1 * o1)) / (1 / (o1 * o1) + 1 / (o2 * o2) + 1 / (o3 * o3)), (1 / (o2 * o2)) / (1 / (o1 * o1) + 1 / (o2 * o2) + 1 / (o3 * o3)), (1 / (o3 * o3)) / (1 / (o1 * o1) + 1 / (o2 * o2) + 1 / (o3 * o3)) from q)"""


def _bin(x: str) -> str:
    return "(case " + " ".join(f"when {x} >= {i}E0 / 10E0 then {i}" for i in range(9, 0, -1)) + " else 0 end)"


_SCORED = f"""{_PRED},
t as (select *, greatest(p1, p2, p3) as mx, case y when 0 then p1 when 1 then p2 else p3 end as py, case when y = 0 then 1E0 else 0E0 end as y1, case when y = 1 then 1E0 else 0E0 end as y2, case when y = 2 then 1E0 else 0E0 end as y3 from m),
sc as (select *, ((p1 - y1) * (p1 - y1) + (p2 - y2) * (p2 - y2) + (p3 - y3) * (p3 - y3)) / 3 as brier, -ln(greatest(1E-15, py)) as ll,
  ((p1 - y1) * (p1 - y1) + (p1 + p2 - y1 - y2) * (p1 + p2 - y1 - y2)) / 2 as rps,
  case when mx - py <= 1E-12 then 1E0 / (case when mx - p1 <= 1E-12 then 1 else 0 end + case when mx - p2 <= 1E-12 then 1 else 0 end + case when mx - p3 <= 1E-12 then 1 else 0 end) else 0E0 end as hit,
  case when (case when p1 = mx then 0 when p2 = mx then 1 else 2 end) = y then 1E0 else 0E0 end as strict, {_bin('mx')} as bin from t)"""
_SUMMARY = "count(*) as n, count(distinct block) as week_count, round(avg(brier), 6) as brier, round(avg(ll), 6) as log_loss, round(avg(rps), 6) as rps, round(avg(hit), 6) as hit_rate"


def _ece(hit: str) -> str:
    return f"with {_SCORED}, b as (select model_id, bin, count(*) as n, abs(avg(mx) - avg({hit})) as gap from sc group by all) select model_id, round(sum(n * gap) / sum(n), 6) as ece from b group by model_id"


_RATED = f"{_FX}, rt as (select *, 0.5E0 + h / 10E0 as lh, 0.4E0 + a / 12E0 as la from fx)"


def _grid(rho: str) -> str:
    tau = f"case when g.g = 0 and k.g = 0 then 1 - lh * la * {rho} when g.g = 0 and k.g = 1 then 1 + lh * {rho} when g.g = 1 and k.g = 0 then 1 + la * {rho} when g.g = 1 and k.g = 1 then 1 - {rho} else 1E0 end"
    return f"""with {_RATED}, d as (select distinct h, a, lh, la from rt), z as (select unnest(range(0, 61)) as g),
c as (select h, a, g.g as x, k.g as y, exp(-lh + g.g * ln(lh) - lgamma(g.g + 1)) * exp(-la + k.g * ln(la) - lgamma(k.g + 1)) * ({tau}) as p from d, z g, z k),
s as (select h, a, sum(case when x > y then p else 0 end) as w, sum(case when x = y then p else 0 end) as e, sum(case when x < y then p else 0 end) as l from c group by h, a)
select h as home, a as away, round(w / (w + e + l), 6) as p_home, round(e / (w + e + l), 6) as p_draw, round(l / (w + e + l), 6) as p_away from s"""


#: As-of times: a day before kickoff, or one prediction time for what lies behind it.
_USUAL, _FIXED = "{0} - 86400", "(case when {0} > 883612800 then 883612800 else {0} - 86400 end)"


def _form(name: str, on: str = "", as_of: str = _USUAL) -> str:
    """The last five of each appearance as {name}(fid, ish, pts, gf, ga, sko)."""
    return f"""{name}_r as (select p.fid, p.ish, s.pts, s.gf, s.ga, s.ko as sko, row_number() over (partition by p.fid, p.ish order by s.ko desc, s.fid desc) as rn
  from ap p left join ap s on s.lg = p.lg and s.team = p.team and s.fin and s.ko + 86400 < {as_of.format('p.ko')} {on}),
{name} as (select fid, ish, sum(pts) as pts, sum(gf) as gf, sum(ga) as ga, max(sko) as sko from {name}_r where rn <= 5 group by fid, ish)"""


#: Ratings after each result and season carry of a league, one step at a time; questions are numbered along with them.
def _elo(as_of: str = _USUAL) -> str:
    return f"""ca as (select lg, ko, min(se) as se from fx group by lg, ko), cb as (select lg, se, min(ko) as ko from ca group by lg, se),
ev as (select lg, ko + 86400 as t, 1 as late, ko, 2 as kind, fid, h, a, case when hg > ag then 1E0 when hg = ag then 0.5E0 else 0E0 end as res, false as back from fx where fin
  union all select lg, {as_of.format('ko')}, 0, ko, 1, fid, h, a, 0E0, false from fx
  union all select lg, {as_of.format('ko')}, 0, ko, 0, -1, 0, 0, 0E0, lag(se) over (partition by lg order by ko) is not null from cb),
en as (select *, cast(sum(case when kind <> 1 then 1 else 0 end) over (partition by lg order by t, late, ko, kind, fid rows between unbounded preceding and current row) as bigint) as i from ev),
es as (select * from en where kind <> 1),
st as (select distinct lg, cast(0 as bigint) as i, list_transform(range(20), lambda x: 1500E0) as r from fx
  union all select st.lg, st.i + 1, case when es.kind = 0 then case when es.back then list_transform(st.r, lambda x: 1500E0 + 0.75E0 * (x - 1500E0)) else st.r end
    else list_transform(st.r, lambda x, k: case when k = es.h + 1 then x + 20E0 * (es.res - 1E0 / (1E0 + pow(10E0, -((st.r[es.h + 1] + 65E0) - st.r[es.a + 1]) / 400E0)))
      when k = es.a + 1 then x - 20E0 * (es.res - 1E0 / (1E0 + pow(10E0, -((st.r[es.h + 1] + 65E0) - st.r[es.a + 1]) / 400E0))) else x end) end
    from st join es on es.lg = st.lg and es.i = st.i + 1),
el as (select en.fid, round(st.r[en.h + 1] + 65E0 - st.r[en.a + 1], 8) as elo from en join st on st.lg = en.lg and st.i = en.i where en.kind = 1)"""

def _snapshots(as_of: str) -> str:
    return f"""with recursive {_FX}, {_AP}, {_form('f', '', as_of)}, {_form('v', 'and s.ish = p.ish', as_of)}, {_form('m', 'and s.opp = p.opp', as_of)}, {_elo(as_of)},
w as (select fid, {', '.join(f"cast(max(case when ish = {i} then {e} end) as double) as {n}" for n, (i, e) in (_POINTS | _GOALS).items())}, max(sko) as sko,
  max(case when ish = 1 then sko end) as hk, max(case when ish = 0 then sko end) as ak from f group by fid),
x as (select fid, {', '.join(f"cast(max(case when ish = {i} then {e} end) as double) as {n}" for n, (i, e) in _VENUE.items())} from v group by fid),
y as (select fid, cast(max(case when ish = 1 then pts end) as double) as h2h_home_points_sum_5 from m group by fid)
select fx.fid as fixture_id, lg as league_id, se as season, ko as kickoff, {as_of.format('ko')} as as_of, coalesce(sko + 86400, {as_of.format('ko')} - 1) as source_max,
  case when fin then case when hg > ag then 0 when hg = ag then 1 else 2 end end as target, ko + 86400 as target_available,
  {', '.join([*_POINTS, *_GOALS, *_VENUE])}, elo as elo_diff_home_adv, h2h_home_points_sum_5,
  case when hk is not null then round(least((ko - hk) / 86400E0, 30E0), 6) end as home_rest_days, case when ak is not null then round(least((ko - ak) / 86400E0, 30E0), 6) end as away_rest_days
from fx join w on w.fid = fx.fid join x on x.fid = fx.fid join y on y.fid = fx.fid join el on el.fid = fx.fid"""


_PLAN = f"""{_FX}, kg as (select ko as kickoff, ko - 86400 as as_of, count(*) as n from fx where fin group by ko),
kk as (select *, cast(sum(n) over (order by kickoff) as bigint) as end_row, kickoff + 86400 as known_by, row_number() over (order by kickoff) as place from kg),
tot as (select cast(sum(n) as bigint) as nn, count(*) as gg, greatest(300, cast(floor(sum(n) * 0.35E0) as bigint)) as least_train, greatest(100, cast(floor(sum(n) * 0.10E0) as bigint)) as least_cal from kg),
us as (select k.kickoff, k.place, k.end_row - k.n as start_row, k.end_row, least(coalesce(max(j.end_row), 0), k.end_row - k.n) as usable from kk k left join kk j on j.known_by < k.as_of group by k.kickoff, k.place, k.end_row, k.n),
cu as (select u.*, max(c.start_row) as cal_start, max(c.usable) as raw_end from us u cross join tot left join us c on c.start_row <= u.usable - tot.least_cal group by all),
ok as (select cu.*, raw_end >= least_train and cal_start < usable as fits, nn, gg from cu, tot),
s0 as (select * from ok where fits and place between 3 and gg - 2 order by place limit 1),
s1 as (select ok.* from ok, s0 where ok.place between s0.place + 1 and ok.gg - 1 order by abs(ok.start_row - (s0.start_row + (s0.nn - s0.start_row) * 1 / 3E0)), ok.place limit 1),
s2 as (select ok.* from ok, s0, s1 where ok.place between s1.place + 1 and ok.gg order by abs(ok.start_row - (s0.start_row + (s0.nn - s0.start_row) * 2 / 3E0)), ok.place limit 1),
sf as (select 0 as fold, s0.*, s1.start_row as stop from s0, s1 union all select 1, s1.*, s2.start_row from s1, s2 union all select 2, s2.*, s2.nn from s2),
pl as (select fold, 'train' as role, cast(0 as bigint) as from_row, raw_end as to_row, cast(0 as bigint) as purged from sf
  union all select fold, 'calibrate', cal_start, usable, cal_start - raw_end from sf union all select fold, 'evaluate', start_row, stop, start_row - usable from sf)"""


def _half_even(m: str, scale: int) -> str:
    """m / 2^20 in units of 1 / scale, in whole numbers, ties to even."""
    n, d = f"({m} * {scale})", "1048576"
    floor, rest = f"(case when {n} % {d} < 0 then {n} // {d} - 1 else {n} // {d} end)", f"((({n} % {d}) + {d}) % {d})"
    whole = f"({floor} + case when {rest} * 2 > {d} or ({rest} * 2 = {d} and {floor} % 2 <> 0) then 1 else 0 end)"
    return f"cast({whole} as double) / {scale}E0"


_GATED = f"""{_SCORED}, dl as (select sc.strict, sc.brier, kk.kickoff, pl.fold from sc join fx on fx.fid = sc.key and fin join kk on kk.kickoff = fx.ko
  join pl on pl.role = 'evaluate' and kk.end_row > pl.from_row and kk.end_row <= pl.to_row where sc.model_id = 'proportional'),
ms as (select avg(strict) as h, avg(brier) as b, count(*) as n, count(distinct fold) as folds, max(kickoff) - min(kickoff) as span, min(kickoff) as first_ko, max(kickoff) as last_ko from dl),
mf as (select 'hitRate must be > 0.48' as failure from ms where not coalesce(h > 0.48, false) union all select 'brier must be < 0.22' from ms where not coalesce(b < 0.22, false)
  union all select 'sampleCount must be >= 500' from ms where n < 500 union all select 'foldCount must be >= 3' from ms where folds < 3
  union all select 'evaluation coverage must be >= 365 days' from ms where not coalesce(span >= 31536000, false))"""
_CASES = ("whole", "gap", "unobserved", "late", "missing")
_PICKED = "fid % 97 = 5"
#: Revisions of a case: what was told, when.
_TOLD = """select fid, lg, 1 as rev, ko - 604800 as seen, ko, h, a, case when fin then null else hg end as hg, case when fin then null else ag end as ag, false as done from fx
  union all select fid, lg, 2, ko + 43200, ko, h, a, hg, ag, true from fx where fin"""
_REVISED = {
    "whole": _TOLD,
    "gap": f"select fid, lg, case when {_PICKED} and done then rev + 1 else rev end as rev, seen, ko, h, a, hg, ag, done from ({_TOLD})",
    "missing": f"select * from ({_TOLD}) where not {_PICKED}",
    "unobserved": f"select fid, lg, rev, case when {_PICKED} and done then null else seen end as seen, ko, h, a, hg, ag, done from ({_TOLD})",
    "late": f"select fid, lg, rev, seen, ko, h, a, case when {_PICKED} and done then hg + 1 else hg end as hg, ag, done from ({_TOLD}) union all select fid, lg, 3, seen + 3456000, ko, h, a, hg, ag, done from ({_TOLD}) where {_PICKED} and done",
}
_SAID = "(ko, h, a, hg, ag, done)"


def _history(case: str) -> str:
    """{case}_x (a row a fixture), {case}_p (the proof) and {case}_f (its failures)."""
    c = case
    return f"""{c}_r as ({_REVISED[case]}),
{c}_o as (select *, row({_SAID[1:-1]}) as said, lag(row({_SAID[1:-1]})) over w as before, lag(seen) over w as seen_before, row_number() over (partition by fid order by rev desc) as last from {c}_r window w as (partition by fid order by rev)),
{c}_h as (select fid, count(*) as n, min(rev) = 1 and max(rev) = count(*) as numbered, min(case when seen is not null and (seen_before is null or seen_before <= seen) then 1 else 0 end) = 1 as observed,
  max(case when done and said is distinct from before then coalesce(seen, 9223372036854775807) end) as changed_at, any_value(said) filter (where last = 1) as told from {c}_o group by fid),
{c}_k as (select distinct lg, ko from fx), {c}_u as (select r.lg, r.ko, min(q.ko - 86400) as first_use from {c}_k r left join {c}_k q on q.lg = r.lg and q.ko - 86400 > r.ko + 86400 group by r.lg, r.ko),
{c}_x as (select fx.fid, coalesce(n, 0) as n, fx.ko, not coalesce(numbered, false) or told is distinct from row(fx.ko, fx.h, fx.a, fx.hg, fx.ag, fx.fin) as incomplete, not coalesce(observed, false) as unobserved,
  told is distinct from row(fx.ko, fx.h, fx.a, fx.hg, fx.ag, fx.fin) or (fx.fin and (changed_at is null or coalesce(changed_at >= first_use, false))) as unreplayable
  from fx left join {c}_h hh on hh.fid = fx.fid left join {c}_u uu on uu.lg = fx.lg and uu.ko = fx.ko),
{c}_d1 as (select fid // 1000 as block, sha256(string_agg(concat_ws('|', fid, rev, coalesce(cast(seen as varchar), ''), ko, h, a, coalesce(cast(hg as varchar), ''), coalesce(cast(ag as varchar), ''), done), chr(10) order by fid, rev)) as line from {c}_r group by 1),
{c}_d2 as (select block // 1000 as block, sha256(string_agg(line, chr(10) order by block)) as line from {c}_d1 group by block // 1000),
{c}_d3 as (select block // 1000 as block, sha256(string_agg(line, chr(10) order by block)) as line from {c}_d2 group by block // 1000),
{c}_d4 as (select sha256(string_agg(line, chr(10) order by block)) as digest from {c}_d3),
{c}_p as (select cast(sum(case when n > 0 then 1 else 0 end) as bigint) as fixtures, cast(sum(n) as bigint) as revisions, min(case when not incomplete and not unobserved then ko end) as coverage_start,
  max(case when not incomplete and not unobserved then ko end) as coverage_end, (select digest from {c}_d4) as digest, bool_or(incomplete) as i, bool_or(unobserved) as o, bool_or(unreplayable) as u from {c}_x),
{c}_s as (select count(*) as samples, min(ko) as first_ko, max(ko) as last_ko from fx where fin),
{c}_f as (select 1 as place, 'sourceRevisionHistoryComplete must be true' as failure from {c}_p where i union all select 2, 'correctionObservedAtComplete must be true' from {c}_p where o union all select 3, 'asOfReplayVerified must be true' from {c}_p where u
  union all select 4, 'fixtureCount must cover every evaluation sample' from {c}_p, {c}_s where fixtures < samples union all select 5, 'revisionCount cannot be less than fixtureCount' from {c}_p where revisions < fixtures
  union all select 6, 'coverage must start by evaluationStartUtc' from {c}_p, {c}_s where coverage_start > first_ko union all select 7, 'coverage must extend through evaluationEndUtc' from {c}_p, {c}_s where coverage_end < last_ko)"""


_GAPS = f"with {_PRED}, h as (select distinct model_id, key from m where not (model_id = 'sharpened' and key % 97 = 0)), w as (select key from o where key % 89 <> 0), i as (select distinct model_id from h) select i.model_id, w.key, 'missing' as side from i, w where not exists (select 1 from h where h.model_id = i.model_id and h.key = w.key) union all select h.model_id, h.key, 'extra' from h where h.key not in (select key from w)"
_EDGES = [(0, 0.0, 0.4), (1, 0.4, 0.5), (2, 0.5, 0.6), (3, 0.6, 0.7), (4, 0.7, 0.8), (5, 0.8, 0.9), (6, 0.9, 1.0000001)]

ORACLES = {
    "asof_points": _last_five() + _sides(_POINTS),
    "asof_goals": _last_five() + _sides(_GOALS),
    "stream_form": _last_five() + _sides(_POINTS | _GOALS),
    "asof_venue": _last_five("and s.ish = p.ish") + _sides(_VENUE),
    "asof_h2h": _last_five("and s.opp = p.opp") + "select fid as fixture_id, cast(max(case when ish = 1 then pts end) as double) as h2h_home_points_sum_5 from f group by fid",
    "asof_rest_days": _last_five() + _sides({"home_rest_days": (1, _REST), "away_rest_days": (0, _REST)}),
    "asof_prior": f"""with {_FX}, d as (select lg, ko, sum(case when fin and hg > ag then 1 else 0 end) as w, sum(case when fin and hg = ag then 1 else 0 end) as e, sum(case when fin and hg < ag then 1 else 0 end) as l from fx group by lg, ko),
s as (select p.lg, p.ko, sum(s.w) as w, sum(s.e) as e, sum(s.l) as l from d p left join d s on s.lg = p.lg and s.ko <= p.ko - {GAP} group by p.lg, p.ko)
select fid as fixture_id, round(case when w + e + l > 0 then w / (w + e + l) end, 6) as p_home, round(case when w + e + l > 0 then e / (w + e + l) end, 6) as p_draw, round(case when w + e + l > 0 then l / (w + e + l) end, 6) as p_away
from fx join s on fx.lg = s.lg and fx.ko = s.ko""",
    "asof_source_max": _last_five() + "select fid as fixture_id, any_value(ko) - 86400 as as_of, coalesce(max(sko) + 86400, any_value(ko) - 86401) as source_max from f group by fid",
    "asof_fixed_timestamp": _last_five(when="s.ko + 86400 < (case when p.ko > 883612800 then 883612800 else p.ko - 86400 end)") + _sides(_POINTS),
    "fixture_keys_digest": f"with {_FX}, k as (select distinct lg, se, concat_ws('|', cast(se as varchar), cast(ko as varchar), cast(h as varchar), cast(a as varchar)) as key from fx), c as (select lg, se, count(*) as n from fx group by lg, se) select c.lg as league_id, c.se as season, c.n, sha256(string_agg(key, chr(10) order by key) || chr(10)) as digest from c join k on c.lg = k.lg and c.se = k.se group by c.lg, c.se, c.n",
    "duplicate_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "iso_week_blocks": "select strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as block, count(*) as n, min(strftime(o_orderdate, '%Y-%m-%d')) as first_date, max(strftime(o_orderdate, '%Y-%m-%d')) as last_date from orders group by 1",
    "weekly_results": f"with {_FX} select strftime(date_trunc('week', o.o_orderdate), '%Y-%m-%d') as block, fx.lg as league_id, count(*) as n, cast(sum(hg + ag) as bigint) as goals from fx join orders o on o.o_orderkey = fx.fid where fin group by all",
    "season_training_rows": f"with {_FX}, s as (select se as season, count(*) as evaluated from fx where fin group by 1) select season, evaluated, cast(coalesce(sum(evaluated) over (order by season rows between unbounded preceding and 1 preceding), 0) as bigint) as trained from s",
    "cold_starts": f"with {_FX} select h >= 18 or a >= 18 as cold_start, count(*) as n from fx where se = (select max(se) from fx) group by 1",
    "season_counts": "select cast(year(o_orderdate) as int) as season, count(*) as n, cast(sum(case when o_orderstatus <> 'P' then 1 else 0 end) as bigint) as finals, count(distinct date_trunc('week', o_orderdate)) as week_count from orders group by 1",
    "team_dense_ids": f"with {_FX}, t as (select h as team from fx union select a from fx) select team, row_number() over (order by team) as team_id from t",
    "coverage_anti_join": _GAPS,
    "api_json_parse": f"with {_FX} select fid as fixture_id, cast(lg + 1 as bigint) as league_id, se as season, ko as kickoff, h + 1 as home, a + 1 as away, 'team ' || a as away_name, case when fin then 'FT' else 'NS' end as status, cast(hg as int) as home_goals, cast(ag as int) as away_goals, fin as is_final from fx where fid % 50 <> 0 and fid % 49 <> 0 and fid % 47 <> 0",
    "api_json_quarantine": f"with {_FX}, b as (select case when fid % 50 = 0 then 'fixture.id must be a positive integer' when fid % 49 = 0 then 'teams.away.id must be a positive integer' when fid % 47 = 0 then 'goals.away must not be negative' end as fault from fx) select fault, count(*) as n from b where fault is not null group by fault",
    "date_parse": "select o_orderkey as key, cast(epoch(case when o_orderkey % 2 <> 0 and year(o_orderdate) < 2000 then o_orderdate + interval 100 year else o_orderdate end) as bigint) + case o_orderkey % 3 when 2 then (o_orderkey % 24) * 3600 + 300 else 43200 end as kickoff, case when o_orderkey % 2 = 0 or year(o_orderdate) >= 2000 then 0 else 100 end as century_shift from orders",
    "odds_filter": "select o_orderkey as key, case when o_orderkey % 7 > 4 and o_orderkey % 9 >= 1 then o_orderkey % 9 + 0.25E0 end as odds from orders",
    "market_proportional": f"with {_PRED} select key, round(p1, 6) as p_home, round(p2, 6) as p_draw, round(p3, 6) as p_away from m where model_id = 'proportional'",
    "market_shin": f"""with recursive {_PRED}, d as (select distinct o1, o2, o3 from q),
b as (select o1, o2, o3, 1 / o1 as q1, 1 / o2 as q2, 1 / o3 as q3, 1 / o1 + 1 / o2 + 1 / o3 as bk from d),
s as (select *, 0 as i, 0E0 as lo, 1E0 as hi from b union all
  select o1, o2, o3, q1, q2, q3, bk, i + 1, case when f > 1 then (lo + hi) / 2 else lo end, case when f > 1 then hi else (lo + hi) / 2 end from (
    select *, 2 * q1 * q1 / bk / (sqrt(z * z + 4 * (1 - z) * q1 * q1 / bk) + z) + 2 * q2 * q2 / bk / (sqrt(z * z + 4 * (1 - z) * q2 * q2 / bk) + z) + 2 * q3 * q3 / bk / (sqrt(z * z + 4 * (1 - z) * q3 * q3 / bk) + z) as f from (select *, (lo + hi) / 2 as z from s where i < 60))),
e as (select *, (lo + hi) / 2 as z from s where i = 60),
g as (select *, 2 * q1 * q1 / bk / (sqrt(z * z + 4 * (1 - z) * q1 * q1 / bk) + z) as a1, 2 * q2 * q2 / bk / (sqrt(z * z + 4 * (1 - z) * q2 * q2 / bk) + z) as a2, 2 * q3 * q3 / bk / (sqrt(z * z + 4 * (1 - z) * q3 * q3 / bk) + z) as a3 from e)
select q.key, round(a1 / (a1 + a2 + a3), 6) as p_home, round(a2 / (a1 + a2 + a3), 6) as p_draw, round(a3 / (a1 + a2 + a3), 6) as p_away, round(z, 6) as z from q join g on q.o1 = g.o1 and q.o2 = g.o2 and q.o3 = g.o3""",
    "score_rows": f"with {_SCORED} select model_id, key, round(brier, 6) as brier, round(ll, 6) as log_loss, round(rps, 6) as rps, round(mx, 6) as top, round(hit, 6) as fractional_hit, round(strict, 6) as argmax_hit, bin from sc",
    "leaderboard": f"with {_SCORED} select model_id, {_SUMMARY} from sc group by model_id",
    "leaderboard_grouping_sets": f"with {_SCORED} select model_id, season, cast(grouping(season) as int) as overall, {_SUMMARY} from sc group by grouping sets ((model_id), (model_id, season))",
    "brier_rank": f"with {_SCORED}, b as (select model_id, ord, round(avg(brier), 10) as br from sc group by all) select model_id, cast(row_number() over (order by br, ord) as int) as rank from b",
    "history_rank": f"with {_SCORED}, b as (select model_id, ord, round(avg(brier), 10) as br from sc where ord > 0 group by all) select model_id, cast(row_number() over (order by br, ord) as int) as rank from b",
    "reliability_bins": f"with {_SCORED}, b as (select model_id, bin, count(*) as n, avg(mx) as c, avg(hit) as h from sc group by all), e as (select distinct model_id, unnest(range(0, 10)) as bin from m) select e.model_id, cast(e.bin as int) as bin, coalesce(n, 0) as n, round(c, 6) as confidence, round(h, 6) as hit_rate, round(abs(c - h), 6) as gap from e left join b on e.model_id = b.model_id and e.bin = b.bin",
    "top_label_ece": _ece("hit"),
    "argmax_ece": _ece("strict"),
    "classwise_ece": f"""with {_SCORED}, p as (select model_id, 0 as k, p1 as x, y1 as z from sc union all select model_id, 1, p2, y2 from sc union all select model_id, 2, p3, y3 from sc),
b as (select model_id, k, {_bin('x')} as bin, count(*) as n, abs(avg(x) - avg(z)) as gap from p group by all), e as (select model_id, k, round(sum(n * gap) / sum(n), 10) as ece from b group by all)
select model_id, round(max(case when k = 0 then ece end), 6) as ece_home, round(max(case when k = 1 then ece end), 6) as ece_draw, round(max(case when k = 2 then ece end), 6) as ece_away, round(avg(ece), 6) as macro_ece from e group by model_id""",
    "confidence_buckets": f"with {_SCORED}, e as (select * from (values {', '.join(f'({i}, {a}E0, {min(b, 1.0)}E0, {b}E0)' for i, a, b in _EDGES)}) v(bucket, lower, upper, edge)), i as (select distinct model_id from m) select i.model_id, e.bucket, e.lower, e.upper, count(sc.key) as n, round(avg(mx), 6) as confidence, round(avg(strict), 6) as accuracy from i cross join e left join sc on sc.model_id = i.model_id and mx >= lower and mx < edge group by all",
    "argmax_hit_rate": f"with {_SCORED} select model_id, round(avg(strict), 6) as hit_rate from sc group by model_id",
    "invalid_predictions": f"with {_PRED} select model_id, key from m where key % 101 = 0 or key % 103 = 0",
    "paired_block_sums": f"with {_SCORED} select a.model_id, a.block, round(sum(a.brier - b.brier), 6) as diff, count(*) as n from sc a join sc b on a.key = b.key and b.model_id = 'proportional' where a.model_id <> 'proportional' group by all",
    "ablation_diff": f"with {_SCORED} select a.model_id, round(sum(a.ll - b.ll) / count(*), 6) as mean_diff, count(distinct a.block) as blocks from sc a join sc b on a.key = b.key and b.model_id = 'proportional' where a.model_id = 'sharpened' group by all",
    "feature_imputation_scaling": """with r as (select case when c_acctbal >= 0 then c_acctbal end as x, case when c_custkey % 5 <> 0 then cast(c_custkey % 7 as double) end as y from customer),
md as (select quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my from r), f as (select coalesce(x, mx) as x, coalesce(y, my) as y from r, md)
select 'balance' as feature, round((select mx from md), 4) as median, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as deviation from f union all
select 'weekday', round((select my from md), 4), round(avg(y), 4), round(stddev_pop(y), 4) from f union all select 'nothing', 0E0, 0E0, 1E0""",
    "poisson_sufficient_stats": f"with {_FX} select h as home, a as away, count(*) as n, cast(sum(hg) as bigint) as home_goals, cast(sum(ag) as bigint) as away_goals from fx where fin group by h, a",
    "goal_rates_outcomes": _grid("0E0"),
    "dixon_coles_shift": _grid("(-0.05E0)"),
    "low_score_cells": f"with {_RATED} select h as home, a as away, hg as home_goals, ag as away_goals, round(case when hg = 0 and ag = 0 then -lh * la when hg = 0 then lh when ag = 0 then la else -1E0 end, 6) as coefficient, count(*) as n from rt where fin and hg <= 1 and ag <= 1 group by all",
    "dixon_coles_rho": f"with {_RATED}, c as (select case when hg = 0 and ag = 0 then -lh * la when hg = 0 then lh when ag = 0 then la else -1E0 end as k from rt where fin and hg <= 1 and ag <= 1) select count(*) as n, round(sum(k / (1 - 0.05E0 * k)), 6) as score_0, round(sum(k), 6) as score_1, round(sum(k / (1 + 0.05E0 * k)), 6) as score_2 from c",
    "isotonic_fit": """with g as (select (o_custkey % 20) / 20E0 as x, sum(case when o_orderstatus = 'F' then 1E0 else 0E0 end) as s, count(*) as n from orders group by 1),
r as (select a.x as lo, b.x as hi, sum(g.s) / sum(g.n) as v from g a join g b on a.x <= b.x join g on g.x between a.x and b.x group by a.x, b.x),
m as (select g.x, r.lo, min(r.v) as v from g join r on r.lo <= g.x and r.hi >= g.x group by g.x, r.lo) select x, round(max(v), 6) as fitted from m group by x""",
    "kickoff_groups": f"with {_FX}, g as (select ko as kickoff, ko - 86400 as as_of, count(*) as n from fx where fin group by ko) select kickoff, as_of, n, cast(sum(n) over (order by kickoff) as bigint) as end_row, kickoff + 86400 as known_by from g",
    "gate_report": f"with {_PLAN}, {_GATED} select failure from mf",
    "candidate_gate": f"with {_PLAN}, {_GATED}, {_history('whole')} select failure from mf union all select 'pointInTimeProvenance: ' || failure from whole_f",
    "provenance_cases": f"with {_FX}, {', '.join(_history(c) for c in _CASES)} " + " union all ".join(f"select '{c}' as history, fixtures, revisions, coverage_start, coverage_end, digest, coalesce((select string_agg('pointInTimeProvenance: ' || failure, '; ' order by place) from {c}_f), '') as failures from {c}_p" for c in _CASES),
    "late_corrections": f"with {_FX}, {_history('late')} select fid as fixture_id, n, ko as kickoff from late_x where unreplayable",
    "record_union": f"with {_PRED}, c as (select cast(count(distinct season) as bigint) as s from m) select 'model' as record_type, cast(3 as bigint) as n, cast(3 as bigint) as model_count, cast(0 as bigint) as with_season, cast(0 as bigint) as with_point union all select 'season', 3 * s, 3, 3 * s, 0 from c union all select 'reliability', 30, 3, 0, 0 union all select 'difference', 2, 2, 0, 2",
    "stream_ratings": f"with recursive {_FX}, {_elo()} select fid as fixture_id, elo as elo_diff_home_adv from el",
    "elo_ratings": f"with recursive {_FX}, {_elo()} select fid as fixture_id, elo as elo_diff_home_adv from el",
    "feature_snapshots": _snapshots(_USUAL),
    "snapshots_fixed_time": _snapshots(_FIXED),
    "fold_plan": f"with {_PLAN} select fold, role, from_row, to_row, purged from pl",
    "purge_counts": f"with {_PLAN} select fold, role, cast(sum(n) as bigint) as n, min(kickoff) as first_kickoff, max(kickoff) as last_kickoff from pl join kk on end_row > from_row and end_row <= to_row group by fold, role",
    "coverage_samples": "with g as (" + _GAPS + "), r as (select *, row_number() over (partition by model_id, side order by key) as place, count(*) over (partition by model_id, side) as n from g) select model_id, side, n, string_agg(cast(key as varchar), ',' order by key) as sample from r where place <= 3 group by model_id, side, n",
    "best_history": f"with {_SCORED}, b as (select model_id, ord, avg(brier) as br from sc where ord > 0 group by all) select model_id, round(br, 6) as brier from b order by round(br, 10), ord limit 1",
    "match_order": f"with {_FX} select fid as fixture_id, row_number() over (order by ko, h, a, fid) as place from fx",
    "final_fit_rows": f"with {_PLAN} select usable as raw_end, start_row as calibration_start, nn as rows from us, tot where start_row <= nn - least_cal order by start_row desc limit 1",
    "season_examples": _last_five()
    + f""", {_form('mm', 'and s.opp = p.opp')}, {_PRED},
n as (select *, row_number() over (order by se, fid) as fixture_id, se || '/' || lpad(cast((se + 1) % 100 as varchar), 2, '0') as label from fx where fin)
select n.fixture_id, concat_ws('|', label, n.ko, 'L' || lg || ' T' || lpad(cast(h as varchar), 2, '0'), 'L' || lg || ' T' || lpad(cast(a as varchar), 2, '0')) as key, label as season_name, q.block,
  case when hg > ag then 0 when hg = ag then 1 else 2 end as target, cast(x.pts as double) as home_points_sum_5, cast(y.pts as double) as away_points_sum_5, cast(z.pts as double) as h2h_home_points_sum_5,
  case when x.sko is not null then round(least((n.ko - x.sko) / 86400E0, 30E0), 6) end as home_rest_days, case when y.sko is not null then round(least((n.ko - y.sko) / 86400E0, 30E0), 6) end as away_rest_days, round(o1, 6) as home_price
from n join f x on x.fid = n.fid and x.ish = 1 join f y on y.fid = n.fid and y.ish = 0 join mm z on z.fid = n.fid and z.ish = 1 join q on q.key = n.fid""",
    "half_even_ties": f"with m as (select o_orderkey as key, cast(o_orderkey % 4001 - 2000 as hugeint) * 65536 + (o_orderkey % 3 - 1) as near, cast(o_orderkey % 4001 - 2000 as hugeint) * 65536 as tie from orders) select key, {_half_even('near', 1000)} as third, {_half_even('near', 100)} as second, {_half_even('tie', 10)} as first from m",
    "exact_quantiles": "with v as (select 'price' as name, l_extendedprice as x from lineitem union all select 'quantity', l_quantity from lineitem where l_quantity > 10 union all select 'rebate', l_extendedprice * l_discount from lineitem) "
    + " union all ".join(f"select name, {q}E0 as share, round(quantile_cont(x, {q}E0), 6) as value from v group by name" for q in (0, 0.025, 0.25, 0.5, 0.975, 1)),
    "evaluation_bundle": f"""with {_SCORED}, e as (select model_id, bin, count(*) as n, sum(brier) as brier, sum(ll) as ll, sum(strict) as hit, sum(mx) as top from sc group by all),
u as (select model_id, count(distinct case {' '.join(f'when mx >= {a}E0 and mx < {b}E0 then {i}' for i, a, b in _EDGES)} end) as used_buckets from sc group by all)
select e.model_id, cast(sum(n) as bigint) as n, round(sum(brier) / sum(n), 6) as brier, round(sum(ll) / sum(n), 6) as log_loss, round(sum(hit) / sum(n), 6) as hit_rate, round(sum(abs(top - hit)) / sum(n), 6) as ece, any_value(used_buckets) as used_buckets
from e join u on e.model_id = u.model_id group by e.model_id""",
}
