"""Stations, reports and interpolation over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import cells as cx
from gridloom.functions import geodesy as gd
from gridloom.operators import gauges, interpolate
from gridloom.plans import views as vw
from gridloom.plans.registry import query
from gridloom.plans.views import sql
from gridloom.sources.stations import parse_report_lines

R6 = lambda c: F.round(c, 6)


@query("A10_parse_report_lines", sql("lines", r"""select line_id, upper(trim(regexp_extract(trim(line), '^(.+)\s(\d+\.\d+)$', 1))) as name,
    cast(regexp_extract(trim(line), '^(.+)\s(\d+\.\d+)$', 2) as double) as value from lines where regexp_matches(trim(line), '^(.+)\s(\d+\.\d+)$')"""))
def report_lines(v):
    return parse_report_lines(v.lines).drop("line")


@query("B1_merge_stations", sql("stations web", "select * from stations union all select * from web where station_id not in (select station_id from stations)"))
def merge_stations(v):
    return gauges.merge_stations(v.stations, v.web)


@query("B2_bbox_filter", sql("stations", f"select * from stations where x between {vw.MIN_X + 1100} and {vw.MIN_X + 7300} and y between {vw.MAX_Y - 6100} and {vw.MAX_Y - 300}"))
def bbox_filter(v):
    return gauges.bbox_filter(v.stations, vw.MIN_X + 1100, vw.MAX_Y - 6100, vw.MIN_X + 7300, vw.MAX_Y - 300)


def _series(coeffs, fn, other, sign, arg, arg2):
    return " ".join(f"{sign} {c!r}::double * {fn}(2 * {j} * {arg}) * {other}(2 * {j} * {arg2})" for j, c in enumerate(coeffs, 1))


_E, _E2, _KR = repr(gd.ECC), repr(gd.ECC**2), repr(gd.SCALE * gd.RECTIFYING)


def geographic_sql(src: str, zone: int, keep: str) -> dict[str, str]:
    """Steps from UTM ``x, y`` of ``src`` to ``lon, lat``, ending in the table ``geo``."""
    sigma = lambda t: f"sinh({_E}::double * atanh({_E}::double * {t} / sqrt(1 + {t} * {t})))"
    newton = lambda t: f"""{t} + (tp - ({t} * sqrt(1 + {sigma(t)} * {sigma(t)}) - {sigma(t)} * sqrt(1 + {t} * {t}))) / sqrt(1 + pow({t} * sqrt(1 + {sigma(t)} * {sigma(t)}) - {sigma(t)} * sqrt(1 + {t} * {t}), 2))
        * (1 + (1 - {_E2}::double) * {t} * {t}) / ((1 - {_E2}::double) * sqrt(1 + {t} * {t}))"""
    return {
        "u1": f"select {keep}, y / {_KR}::double as xi, (x - 500000) / {_KR}::double as eta from {src}",
        "u2": f"select {keep}, xi {_series(gd.BETA, 'sin', 'cosh', '-', 'xi', 'eta')} as xp, eta {_series(gd.BETA, 'cos', 'sinh', '-', 'xi', 'eta')} as ep from u1",
        "u3": f"select {keep}, xp, ep, sin(xp) / sqrt(sinh(ep) * sinh(ep) + cos(xp) * cos(xp)) as tp from u2",
        "u4": f"select {keep}, xp, ep, tp, {newton('tp')} as t1 from u3",
        "u5": f"select {keep}, xp, ep, tp, {newton('t1')} as t2 from u4",
        "u6": f"select {keep}, xp, ep, {newton('t2')} as t3 from u5",
        "geo": f"select {keep}, degrees(atan2(sinh(ep), cos(xp))) + {zone * 6 - 183} as lon, degrees(atan(t3)) as lat from u6",
    }


def utm_sql(src: str, zone: int, keep: str) -> dict[str, str]:
    """Steps from ``lon, lat`` of ``src`` to UTM, ending in the table ``utm``."""
    sigma = f"sinh({_E}::double * atanh({_E}::double * t / sqrt(1 + t * t)))"
    return {
        "w1": f"select {keep}, radians(lon) - radians({zone * 6 - 183}::double) as lam, tan(radians(lat)) as t from {src}",
        "w2": f"select {keep}, lam, t * sqrt(1 + {sigma} * {sigma}) - {sigma} * sqrt(1 + t * t) as tp from w1",
        "w3": f"select {keep}, atan2(tp, cos(lam)) as xi, asinh(sin(lam) / sqrt(tp * tp + cos(lam) * cos(lam))) as eta from w2",
        "utm": f"""select {keep}, 500000 + {_KR}::double * (eta {_series(gd.ALPHA, 'cos', 'sinh', '+', 'xi', 'eta')}) as x,
            {_KR}::double * (xi {_series(gd.ALPHA, 'sin', 'cosh', '+', 'xi', 'eta')}) as y from w3""",
    }


_A = repr(gd.AXIS)


@query("B3_reproject", sql("stations", f"""select g.station_id, round(lon, 8) as lon, round(lat, 8) as lat, round(radians(lon) * {_A}, 3) as mx, round(asinh(tan(radians(lat))) * {_A}, 3) as my,
    round(u.x, 3) as x31, round(u.y, 3) as y31 from geo g join utm u on g.station_id = u.station_id""", {**geographic_sql("stations", 30, "station_id"), **utm_sql("geo", 31, "station_id")}))
def reproject(v):
    pts = v.stations.select("station_id", "x", "y")
    geo = gd.reproject(pts, 25830, 4326)
    named = geo.withColumns({"lon": F.round("x", 8), "lat": F.round("y", 8)})
    merc = gd.reproject(named, 4326, 3857).withColumns({"mx": F.round("x", 3), "my": F.round("y", 3)})
    utm = gd.reproject(merc, 3857, 32631)
    return utm.select("station_id", "lon", "lat", "mx", "my", F.round("x", 3).alias("x31"), F.round("y", 3).alias("y31"))


PARSED = r"""select line_id, upper(trim(regexp_extract(trim(line), '^(.+)\s(\d+\.\d+)$', 1))) as name, cast(regexp_extract(trim(line), '^(.+)\s(\d+\.\d+)$', 2) as double) as value
    from lines where regexp_matches(trim(line), '^(.+)\s(\d+\.\d+)$')"""


@query("B4_match_aliases", sql("lines aliases", "select distinct a.station_id, l.line_id, l.value from p l join aliases a on contains(l.name, a.alias)", {"p": PARSED}))
def match_aliases(v):
    return gauges.match_aliases(parse_report_lines(v.lines).select("line_id", "name", "value"), v.aliases)


_FROM, _TO = "1995-03-01 06:30:00", "2002-12-31 09:15:00"
#: Edges after snapping to 08:00: the start moves down a day, the end up one.
_LOW, _HIGH = "1995-02-28", "2003-01-01"


@query("B5_select_reports", sql("reports", f"""select source, d as report_date, period from walk where period is not null and matched""", {
    "odd": "select source, report_date, cast(period * 2 - 3 as integer) as period, matched from reports",
    "best": f"select source, report_date as d, min(period) as period, arg_min(matched, period) as matched from odd where report_date between date '{_LOW}' and date '{_HIGH}' and period between 1 and 10 group by 1, 2",
    "walk": f"""select s.source, s.d, b.period, b.matched from (select distinct source, date '{_HIGH}' as d from reports) s left join best b on b.source = s.source and b.d = s.d
        union all select n.source, n.d, b.period, b.matched from (select source, cast(d - cast(case when matched then period else 1 end as integer) as date) as d from walk where d >= date '{_LOW}') n
        left join best b on b.source = n.source and b.d = n.d""",
}, recursive=True))
def select_reports(v):
    """Periods from -1 to 17 days, so that some are none."""
    return gauges.select_reports(v.reports.withColumn("period", (F.col("period") * 2 - 3).cast("int")), _FROM, _TO)


@query("B6_report_intervals", sql("reports", "select source, report_date, period, report_date - to_days(period) as start_ts, cast(report_date as timestamp) as end_ts from reports"))
def report_intervals(v):
    return gauges.report_intervals(v.reports.drop("matched"))


@query("B7_step_calendar", sql("readings", """select station_id, cast(i as integer) as step, lo + to_hours(36 * i) as s0, lo + to_hours(36 * (i + 1)) as s1 from
    (select station_id, lo, unnest(range(0, date_diff('second', lo, hi) // 129600)) as i from (select station_id, min(start_ts) as lo, max(end_ts) as hi from readings group by 1))"""))
def step_calendar(v):
    spans = v.readings.groupBy("station_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return gauges.step_calendar(spans, 129600, ["station_id"])


ACTIVE = "select r.station_id, r.mm_per_hour, s.step from readings r join steps s on r.start_ts <= s.s0 and s.s0 < r.end_ts and r.start_ts < s.s1 and s.s1 <= r.end_ts"


@query("B8_active_readings", sql("readings steps", ACTIVE))
def active_readings(v):
    return gauges.active_readings(v.readings, v.steps).select("station_id", "mm_per_hour", "step")


@query("B9_union_sources", sql("readings reports", """select station_id, mm_per_hour, start_ts, end_ts, null::bigint as source from readings
    union all select null, cast(period as double), report_date - to_days(period), cast(report_date as timestamp), source from reports"""))
def union_sources(v):
    rep = gauges.report_intervals(v.reports).select("source", F.col("period").cast("double").alias("mm_per_hour"), "start_ts", "end_ts")
    missing = lambda: v.table("no_such_table")
    return gauges.union_sources(v.readings, missing, rep)


@query("B9b_read_sources", sql("readings reports", """select 'readings' as source, count(*) as n, true as read from readings union all select 'broken', 0, false union all select 'reports', count(*), true from reports"""))
def read_sources(v):
    """One source fails only while its rows are read; it is reported and the others stay."""
    broken = lambda: v.readings.withColumn("mm_per_hour", F.when(F.col("station_id") >= 0, F.raise_error(F.lit("bad file")).cast("double")))
    rows, report = gauges.read_sources(v.spark, {"readings": lambda: v.readings, "broken": broken, "reports": lambda: gauges.report_intervals(v.reports.drop("source"))})
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return report.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "read")


EDGES = [0.0, 250.0, 500.0, 750.0, 1000.0, 1500.0, 2000.0]
BINS = f"""select step, bin, avg(h) as h, count(*) as pairs, avg(d * d) / 2 as gamma from
    (select *, cast({' + '.join(f'cast(h >= {e} as integer)' for e in EDGES[1:-1])} as integer) as bin from
        (select a.step, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as h, a.value - b.value as d from cellpoints a join cellpoints b
            on a.step = b.step and (a.x < b.x or (a.x = b.x and a.y < b.y))) where h < {EDGES[-1]}) group by 1, 2"""


def _bins(v):
    return interpolate.variogram_bins(interpolate.points_per_cell(v.points, v.spec), EDGES)


@query("B10_variogram_bins", sql("cellpoints", "select step, bin, round(h, 6) as h, pairs, round(gamma, 6) as gamma from b", {"b": BINS}))
def variogram_bins(v):
    return _bins(v).withColumns({"h": R6("h"), "gamma": R6("gamma")})


RANGES = [400.0, 800.0, 1200.0, 1600.0, 2400.0]
FIT = {
    "b": BINS,
    "c": f"""select b.*, r as reach, case when h >= r then 1 else 1.5::double * (h / r) - 0.5::double * pow(h / r, 3) end as f from b, (select unnest([{', '.join(f'{r}::double' for r in RANGES)}]) as r)""",
    "s": "select step, reach, cast(count(*) as double) as n, sum(f) as sf, sum(f * f) as sff, sum(gamma) as sg, sum(f * gamma) as sfg, sum(gamma * gamma) as sgg from c group by 1, 2",
    "o": """select *, (sg * sff - sf * sfg) / (n * sff - sf * sf) as a, (n * sfg - sf * sg) / (n * sff - sf * sf) as b from s where abs(n * sff - sf * sf) > 1e-9
        union all select *, 0, case when sff > 0 then sfg / sff else 0 end from s union all select *, sg / n, 0 from s""",
    "e": "select step, reach, a, b, round(greatest(0, sgg - 2 * a * sg - 2 * b * sfg + a * a * n + 2 * a * b * sf + b * b * sff), 6) as rss from o where a >= 0 and b >= 0",
}


@query("B11_fit_variogram", sql("cellpoints", """select step, 'spherical' as model, round(a, 5) as nugget, round(b, 5) as sill, reach, rss from
    (select *, row_number() over (partition by step order by rss, reach, round(a, 6)) as k from e) where k = 1""", FIT))
def fit_variogram(v):
    return interpolate.fit_variogram(_bins(v), RANGES, "no such model").withColumns({"nugget": F.round("nugget", 5), "sill": F.round("sill", 5)})


@query("B12_krige_cells")
def krige_cells(v):
    return interpolate.krige_cells(v.points, interpolate.fit_variogram(_bins(v), RANGES), v.spec)


@query("B12c_krige_at_gauges", sql("points cells", f"""select s.step, c."row", c.col, true as dry_or_wet, round(g.value, 5) as at_gauge from (select distinct step from points) s cross join cells c
    left join (select step, cast(floor(({vw.MAX_Y} - y) / {vw.CELL}) as integer) as "row", cast(floor((x - {vw.MIN_X}) / {vw.CELL}) as integer) as col, avg(value) as value from points group by all) g
        on g.step = s.step and g."row" = c."row" and g.col = c.col"""))
def krige_at_gauges(v):
    """All gauges stand at cell centres, where kriging has to give back their values."""
    made = interpolate.krige_cells(v.points, interpolate.fit_variogram(_bins(v), RANGES), v.spec, variance=False)
    held = v.points.select("step", cx.row_at(F.col("y"), v.spec).alias("row"), cx.col_at(F.col("x"), v.spec).alias("col"), F.lit(True).alias("held")).distinct()
    both = made.join(held, ["step", "row", "col"], "left")
    return both.select("step", "row", "col", (F.col("value") >= 0).alias("dry_or_wet"), F.when(F.col("held"), F.round("value", 5)).alias("at_gauge"))


@query("B12b_rainfall_layer")
def rainfall_layer(v):
    at = v.readings.join(v.stations.select("station_id", "x", "y"), "station_id").withColumnRenamed("mm_per_hour", "value")
    return interpolate.rainfall_layer(at, v.steps, v.spec, EDGES, RANGES)


@query("B13_gate_min_points", sql("readings steps", f"""select s.step, coalesce(n, 0) as n, round(case when coalesce(n, 0) >= 90 then m else 0 end, 6) as value from steps s
    left join (select step, count(*) as n, avg(mm_per_hour) as m from ({ACTIVE}) group by 1) a on s.step = a.step"""))
def gate_min_points(v):
    active = gauges.active_readings(v.readings, v.steps)
    return gauges.gate_min_points(active, v.steps, 90, "mm_per_hour").select("step", "n", R6("mm_per_hour").alias("value"))


@query("B14_clamp_min", sql("cells", 'select "row", col, greatest(height, 0) as value from cells'))
def clamp_min(v):
    return v.cells.select("row", "col", cx.clamp_min(F.col("height")).alias("value"))
