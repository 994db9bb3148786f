"""Layer algebra over the fixture grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions import cells as cx
from gridloom.gridspec import GridSpec
from gridloom.operators import focal, layers, polygons
from gridloom.plans import views as vw
from gridloom.plans.registry import query
from gridloom.plans.views import sql

R6 = lambda c: F.round(c, 6)
ROWS = vw._ROWS
MINX, MAXY, CELL, COLS = vw.MIN_X, vw.MAX_Y, vw.CELL, vw.COLS


@query("C1_index_maths", sql("cells", f'select idx, cast(idx // {COLS} as integer) as "row", cast(idx % {COLS} as integer) as col, idx as back from cells'))
def index_maths(v):
    return layers.rowcol_to_idx(layers.idx_to_rowcol(v.cells.select("idx"), COLS), COLS, "back")


@query("C2_cell_centres", sql("cells", f'select "row", col, {MINX} + (col + 0.5::double) * {CELL}::double as x, {MAXY} - ("row" + 0.5::double) * {CELL}::double as y from cells'))
def cell_centres(v):
    return layers.cell_centres(v.cells.select("row", "col"), v.spec)


SAMPLE = f"""select p.station_id, p.ok, p."row", p.col, c.height as value from
    (select *, case when ok then cast(least(floor(({MAXY} - y) / {CELL}), {ROWS} - 1) as integer) end as "row",
        case when ok then cast(least(floor((x - {MINX}) / {CELL}), {COLS - 1}) as integer) end as col from
        (select station_id, x, y, x between {MINX} and {MINX + COLS * CELL} and y between {MAXY} - {ROWS} * {CELL} and {MAXY} as ok from
            (select station_id, x + (station_id % 7 - 3) * 700 as x, y + (station_id % 5 - 2) * 100 as y from stations))) p
    left join cells c on p."row" = c."row" and p.col = c.col"""


@query("C3_sample_at", sql("cells stations", SAMPLE))
def sample_at(v):
    moved = v.stations.selectExpr("station_id", "x + (station_id % 7 - 3) * 700 as x", "y + (station_id % 5 - 2) * 100 as y")
    return layers.sample_at(moved, v.layer("height"), v.spec).drop("x", "y")


@query("C4_view_window", sql("cells", f"""select "row", col, height from cells
    where "row" >= 0 and "row" < {ROWS} - floor({ROWS} / 3) and col >= 10 and col < 31"""))
def view_window(v):
    s = v.spec
    south = s.min_y + (s.rows // 3) * CELL
    return layers.view_window(v.cells.select("row", "col", "height"), s, (MINX + 10.4 * CELL, south, MINX + 30.2 * CELL, s.max_y + 500))


def _block(f):
    return f"""select cast("row" // {f} as integer) as "row", cast(col // {f} as integer) as col, avg(height) as value from cells
        where "row" < {ROWS} // {f} * {f} and col < {COLS} // {f} * {f} group by 1, 2"""


@query("C5_block_mean", sql("cells", 'select "row", col, round(value, 6) as value from b', {"b": _block(3)}))
def block_mean(v):
    return layers.block_mean(v.layer("height"), v.spec, 3).withColumn("value", R6("value"))


@query("C6_expand_coarse", sql("cells", 'select c."row", c.col, round(coalesce(b.value, 0), 6) as value from cells c left join b on c."row" // 3 = b."row" and c.col // 3 = b.col', {"b": _block(3)}))
def expand_coarse(v):
    coarse = layers.block_mean(v.layer("height"), v.spec, 3)
    return layers.expand_coarse(coarse, 3, v.cells).withColumn("value", R6("value"))


FRAME_DAYS = """select step, min(date_trunc('day', ts)) as ts_start, min(date_trunc('day', ts)) + interval 18 hours as ts_end from writes group by step"""


@query("C7_series_asof", sql("writes", """select w.seq, f.step from (select seq, ts, date_trunc('second', ts + interval 500 milliseconds) as t from writes) w
    join f on w.t >= f.ts_start and w.t < f.ts_end""", {"f": FRAME_DAYS}))
def series_asof(v):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    frames = v.writes.groupBy("step").agg(F.min(day).alias("ts_start")).withColumn("ts_end", F.expr("ts_start + interval 18 hours"))
    return layers.series_asof(v.writes.select("seq", "ts"), frames).select("seq", "step")


@query("C8_rain_units", "select l_orderkey, l_linenumber, l_partkey, round(l_quantity * 0.001::double * 900::double / 3600::double, 9) as metres from lineitem")
def rain_units(v):
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(cx.mmh_to_m_per_step(F.col("l_quantity"), 900), 9).alias("metres")
    )


def _target(v) -> GridSpec:
    """A finer grid, shifted so that its edge lies off the source."""
    return GridSpec(v.spec.rows * 4 // 3, COLS * 4 // 3, 151.37, MINX - 333.1, MAXY + 222.0, v.spec.epsg)


_TR, _TC = f"({ROWS} * 4 // 3)", COLS * 4 // 3
TARGET = f"""select cast(i // {_TC} as integer) as "row", cast(i % {_TC} as integer) as col,
    {MINX - 333.1} + (i % {_TC} + 0.5::double) * 151.37::double as x, {MAXY + 222} - (i // {_TC} + 0.5::double) * 151.37::double as y
    from (select unnest(range({_TR} * {_TC})) as i)"""
INSIDE = f"x between {MINX} and {MINX + COLS * CELL} and y between {MAXY} - {ROWS} * {CELL} and {MAXY}"


@query("C9_align_nearest", sql("cells", f"""select t."row", t.col, coalesce(c.height, -1::double) as value from t left join cells c
    on {INSIDE} and c."row" = least(floor(({MAXY} - y) / {CELL}), {ROWS} - 1) and c.col = least(floor((x - {MINX}) / {CELL}), {COLS - 1})""", {"t": TARGET}))
def align_nearest(v):
    pts = layers.target_points(v.spark, _target(v), v.spec.epsg)
    return layers.align_nearest(v.layer("height"), v.spec, pts, fill=-1.0).select("row", "col", "value")


BILINEAR = {
    "t": TARGET,
    "f": f"""select *, {INSIDE} as ok, floor(fx) as c0, floor(fy) as r0 from
        (select *, (x - {MINX}) / {CELL}::double - 0.5::double as fx, ({MAXY} - y) / {CELL}::double - 0.5::double as fy from t)""",
    "k": """select f.*, d.dr, d.dc, (case when d.dr = 1 then fy - r0 else 1 - (fy - r0) end) * (case when d.dc = 1 then fx - c0 else 1 - (fx - c0) end) as w
        from f, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)""",
}


@query("C10_align_bilinear", sql("cells", """select k."row", k.col, round(case when bool_or(k.ok) and sum(case when c.height is not null then w end) > 1e-12
    then sum(w * c.height) / sum(case when c.height is not null then w end) else 0 end, 6) as value
    from k left join cells c on c."row" = k.r0 + k.dr and c.col = k.c0 + k.dc group by 1, 2""", BILINEAR))
def align_bilinear(v):
    pts = layers.target_points(v.spark, _target(v), v.spec.epsg)
    return layers.align_bilinear(v.layer("height"), v.spec, pts, ["row", "col"]).withColumn("value", R6("value"))


@query("C11_mosaic", f"""with t as (select l_linenumber as o, cast(l_partkey // {COLS} as integer) as "row", cast(l_partkey % {COLS} as integer) as col,
    case when max(l_quantity) < 45 then null else max(l_quantity) end as value from lineitem group by 1, 2, 3)
    select "row", col, arg_min(value, o) as value from t where value is not null group by 1, 2""")
def mosaic(v):
    best = F.max("l_quantity")
    tiles = v.table("lineitem").groupBy(
        F.col("l_linenumber").alias("tile_order"), F.expr(f"cast(l_partkey div {COLS} as int)").alias("row"), F.expr(f"cast(l_partkey % {COLS} as int)").alias("col")
    ).agg(F.when(best >= 45, best).alias("value"))
    return layers.mosaic(tiles)


@query("C12_conform", sql("cells", f"""select t."row", t.col, coalesce(c.height, 0) as value from
    (select cast(i // 40 as integer) as "row", cast(i % 40 as integer) as col from (select unnest(range(({ROWS} + 3) * 40)) as i)) t
    left join cells c on t."row" = c."row" and t.col = c.col"""))
def conform(v):
    return layers.conform(v.layer("height"), GridSpec(v.spec.rows + 3, 40, CELL, MINX, MAXY))


@query("C13_constant_layer", sql("cells", 'select "row", col, 0::double as value from cells'))
def constant_layer(v):
    return layers.constant_layer(v.cells)


@query("C14_fill_nodata", sql("cells", """select "row", col, case when v <= -9999 then 0 else v end as at_most_9999, case when v < -500 then 0 else v end as below_500,
    case when v < -9000 then 0 else v end as below_9000, case when v < 0 then 0 else v end as negative from (select "row", col, height * 2500 as v from cells)"""))
def fill_nodata(v):
    h = F.col("height") * 2500
    return v.cells.select(
        "row", "col",
        cx.fill_nodata(h, -9999.0, inclusive=True).alias("at_most_9999"),
        cx.fill_nodata(h, -500.0).alias("below_500"),
        cx.fill_nodata(h, -9000.0).alias("below_9000"),
        cx.fill_nodata(h, 0.0).alias("negative"),
    )


_ODD = "case when idx % 11 = 0 then cast('NaN' as double) when idx % 11 = 1 then cast('Infinity' as double) when idx % 11 = 2 then cast('-Infinity' as double) else height * 700 end"


@query("C15_sanitise", sql("cells", f"""select "row", col, case when isnan(v) then 0 else greatest(least(case when v = cast('Infinity' as double) then 1000
    when v = cast('-Infinity' as double) then -1000 else v end, 10000), -1000) end as value from (select "row", col, {_ODD} as v from cells)"""))
def sanitise(v):
    return v.cells.select("row", "col", F.expr(_ODD).alias("v")).select("row", "col", cx.sanitise(F.col("v")).alias("value"))


_NAN = "case when idx % 11 = 0 then cast('NaN' as double) when idx % 11 = 1 then -9999 else height end"


@query("C16_layer_stats", sql("cells", f"""select 'plain' as kind, min(v) as lo, max(v) as hi, count(v) as n from (select {_NAN} as v from cells) where not isnan(v)
    union all select 'valid', min(v), max(v), count(v) from (select {_NAN} as v from cells) where not isnan(v) and v > -9999
    union all select 'flat', min(v), max(v) + 1, count(v) from (select 3::double as v from cells)"""))
def layer_stats(v):
    odd = v.cells.select(F.expr(_NAN).alias("value"))
    plain = layers.layer_stats(odd).withColumn("kind", F.lit("plain"))
    valid = layers.layer_stats(odd, nodata=-9999.0).withColumn("kind", F.lit("valid"))
    flat = layers.layer_stats(layers.constant_layer(v.cells, 3.0), widen=True).withColumn("kind", F.lit("flat"))
    return plain.unionByName(valid).unionByName(flat)


_LUT = "[" + ",".join(f"{r}::double" for r in K.ROUGHNESS) + "]"


@query("C17_reclass", sql("cells", f"""select "row", col, land_cover, case when land_cover * 2 - 40 between 0 and 55 then {_LUT}[land_cover * 2 - 40 + 1] else {K.ROUGHNESS_DEFAULT}::double end as roughness from cells"""))
def reclass(v):
    shifted = v.cells.select("row", "col", "land_cover", (F.col("land_cover") * 2 - 40).alias("k"))
    return layers.reclass(shifted, K.ROUGHNESS, K.ROUGHNESS_DEFAULT, key="k").drop("k")


_CODES = "[" + ",".join(f"'{c}'" for c in K.LAND_COVER_CODES) + "]"


@query("C18_map_class_codes", f"select o_orderkey, cast(coalesce(list_position({_CODES}, cast(100 + o_orderkey % 450 as varchar)), 0) as integer) as class from orders")
def map_class_codes(v):
    feats = v.table("orders").select("o_orderkey", F.expr("cast(100 + o_orderkey % 450 as string)").alias("code"))
    return layers.map_class_codes(feats, K.LAND_COVER_CODES).drop("code")


@query("C19_masked_merge", sql("cells", """select "row", col, case when land_cover between 47 and 54 then -depth else height end as value from cells"""))
def masked_merge(v):
    return layers.masked_merge(
        v.layer("height"), v.cells.select("row", "col", (-F.col("depth")).alias("value")), v.cells.select("row", "col", F.col("land_cover").alias("class")), K.WATER_CLASSES
    )


@query("C20_classify", sql("writes", f"select seq, depth, {vw._risk('depth')} as risk from writes"))
def classify(v):
    return layers.classify(v.writes.select("seq", "depth"), K.LEVELS)


@query("C21_scale_to_levels", sql("cells", """select "row", col, cast(round_even((height - lo) / (hi - lo) * 5, 0) as integer) as of_height,
    cast(land_cover % 6 as integer) as of_class from cells, (select min(height) as lo, max(height) as hi from cells)"""))
def scale_to_levels(v):
    h = layers.scale_to_levels(v.cells.select("row", "col", "height", (F.col("land_cover") % 6).cast("double").alias("k")), "height", 5, "of_height")
    return layers.scale_to_levels(h, "k", 5, "of_class").select("row", "col", "of_height", "of_class")


_THR = "[" + ",".join(f"{t}::double" for _, _, t in K.LEVELS) + "]"


@query("C22_level_to_depth", sql("cells", f'select "row", col, {_THR}[greatest(least(land_cover - 40, 5), 0) + 1] as depth from cells'))
def level_to_depth(v):
    return v.cells.select("row", "col", cx.level_threshold(F.col("land_cover") - 40, K.LEVELS).alias("depth"))


@query("C23_surface", sql("cells", 'select "row", col, round(case when depth >= 0.0005 then height + depth else height end, 6) as value from cells'))
def surface(v):
    return v.cells.select("row", "col", R6(cx.surface(F.col("height"), F.col("depth"))).alias("value"))


LIFT, ENABLED = [0.0, 1.5, 2.5, 3.5, 4.5, 5.5], [True, True, False, True, True, True]


@query("C24_overlay", sql("cells", f"""select "row", col, case when risk > 0 and [true,true,false,true,true,true][least(risk, 5) + 1] then height + [0,1.5::double,2.5,3.5,4.5,5.5][least(risk, 5) + 1]
    else -9999 end as shown from (select *, {vw._risk('depth')} as risk from cells)"""))
def overlay(v):
    base = layers.classify(v.cells.select("row", "col", F.col("height").alias("terrain"), "depth"), K.LEVELS)
    return layers.overlay(base, LIFT, ENABLED, show_terrain=False).select("row", "col", "shown")


@query("C25_vertical_scale", sql("cells", f"""select round(case when max(height) - min(height) < 0.01 then 1 else least({ROWS}, {COLS}) * {CELL} * 0.3::double / (max(height) - min(height)) end, 6) as scale from cells"""))
def vertical_scale(v):
    return layers.vertical_scale(v.layer("height"), v.spec).select(R6("scale").alias("scale"))


def _band_sql():
    tests, prev = [], None
    for i, (hi, r, g, b) in enumerate(K.ELEVATION_BANDS):
        tests.append(f"when h <= {hi} then {{'band': {i}, 'r': {r}, 'g': {g}, 'b': {b}}}")
    return "case " + " ".join(tests) + " end"


@query("C26_elevation_bands", sql("cells", f"""select "row", col, k.band, k.r, k.g, k.b from (select "row", col, {_band_sql()} as k from (select "row", col, height * 8 as h from cells))"""))
def elevation_bands(v):
    return v.cells.select("row", "col", cx.elevation_band(F.col("height") * 8, K.ELEVATION_BANDS).alias("k")).select("row", "col", "k.*")


NEAR4 = """select c."row", c.col, c.height as h, n.height as n, s.height as s, e.height as e, w.height as w from cells c
    left join cells n on n."row" = c."row" - 1 and n.col = c.col left join cells s on s."row" = c."row" + 1 and s.col = c.col
    left join cells e on e."row" = c."row" and e.col = c.col + 1 left join cells w on w."row" = c."row" and w.col = c.col - 1"""


@query("C27_hillshade", sql("cells", """select "row", col, round(greatest(0, least(1, cos(radians(45)) * cos(sl) + sin(radians(45)) * sin(sl) * cos(radians(135) - asp))), 6) as shade from
    (select *, atan(4 * sqrt(dx * dx + dy * dy)) as sl, atan2(dy, dx) as asp from
        (select *, -(case when n is null then s - h when s is null then h - n else (s - n) / 2 end) as dy,
            case when w is null then e - h when e is null then h - w else (e - w) / 2 end as dx from m))""", {"m": NEAR4}))
def hillshade(v):
    return focal.hillshade(v.cells.select("row", "col", "height"), v.spec).withColumn("shade", R6("shade"))


_SH = lambda dr, dc: f"""(select h from g x where x."row" = case when g."row" + {dr} < 0 then 1 when g."row" + {dr} >= {ROWS} then {ROWS} - 2 else g."row" + {dr} end
    and x.col = case when g.col + {dc} < 0 then 1 when g.col + {dc} >= {COLS} then {COLS - 2} else g.col + {dc} end)"""


@query("C28_gradient_shade", sql("cells", f"""select "row", col, cast(255 - round_even((m - min(m) over ()) * 255.0::double / (max(m) over () - min(m) over ()), 0) as integer) as shade from k""", {
    "g": 'select "row", col, round_even((height - lo) * 255.0::double / (hi - lo), 0) as h from cells, (select min(height) as lo, max(height) as hi from cells)',
    "q": f"select \"row\", col, {_SH(-1,-1)} as nw, {_SH(-1,0)} as n, {_SH(-1,1)} as ne, {_SH(0,-1)} as w, {_SH(0,1)} as e, {_SH(1,-1)} as sw, {_SH(1,0)} as s, {_SH(1,1)} as se from g",
    "k": 'select "row", col, abs((ne + 2 * e + se) - (nw + 2 * w + sw)) + abs((sw + 2 * s + se) - (nw + 2 * n + ne)) as m from q',
}))
def gradient_shade(v):
    return focal.gradient_shade(v.cells.select("row", "col", "height"), v.spec)


@query("C29_stack_layers", sql("cells", f"""select c."row", c.col, c.height, case when c."row" = {ROWS} - 1 then 0 else c.depth end as depth, 0::double as rain from cells c"""))
def stack_layers(v):
    # the last row has no values
    short = v.layer("depth").withColumn("value", F.when(F.col("row") < v.spec.rows - 1, F.col("value")))
    return layers.stack_layers(v.spark, v.spec, {"height": v.layer("height"), "depth": short, "rain": None})


@query("C30_apply_rain", sql("cells", """select "row", col, round(d, 6) as depth, case when d >= 0.3 then 1 else moving end as moving from
    (select "row", col, depth + land_cover * 0.01::double as d, moving from cells)"""))
def apply_rain(v):
    rain = v.cells.select("row", "col", (F.col("land_cover") * F.lit(0.01)).alias("rain"))
    return layers.apply_rain(v.cells.select("row", "col", "depth", "moving"), rain, 0.3).withColumn("depth", R6("depth"))


@query("C31_wet_state", sql("cells", 'select "row", col, cast(depth >= 0.3 as integer) as moving from cells'))
def wet_state(v):
    return layers.wet_state(v.cells.select("row", "col", "depth"), 0.3).drop("depth")


_OFF = "(values ('n',-1,0),('s',1,0),('e',0,1),('w',0,-1),('ne',-1,1),('nw',-1,-1),('se',1,1),('sw',1,-1)) d(dir,dr,dc)"
_AT = lambda d: f"max(case when dir = '{d}' then x end) as {d}"


@query("D1_neighbours", sql("cells", f"""select "row", col, any_value(height) as height, {", ".join(_AT(n) for n, _, _ in focal.DIRECTIONS)} from
    (select c."row", c.col, c.height, d.dir, coalesce(o.height, 9999) as x from cells c cross join {_OFF} left join cells o on o."row" = c."row" + d.dr and o.col = c.col + d.dc) group by 1, 2"""))
def neighbours(v):
    return focal.neighbours(v.cells.select("row", "col", "height"), v.spec, "height", 9999.0)


def _slope(level):
    return f"""select c."row", c.col, d.dir, d.dr, d.dc, greatest(c.{level} - coalesce(o.{level}, 9999), 0) / (case when d.dr <> 0 and d.dc <> 0 then {CELL} * sqrt(2::double) else {CELL}::double end) * c.moving as slope
        from lv c cross join {_OFF} left join lv o on o."row" = c."row" + d.dr and o.col = c.col + d.dc"""


_LV = "select *, height + depth as wse from cells"


@query("D2_downslope", sql("cells", 'select "row", col, dir, round(slope, 6) as slope from sl', {"lv": _LV, "sl": _slope("height")}))
def downslope(v):
    return focal.downslope(v.cells.select("row", "col", "height", "moving"), v.spec, CELL).withColumn("slope", R6("slope"))


ROUTE = dict(dx=CELL, dt=40.0, density=1000.0, viscosity=0.001)


@query("D3_route_once", sql("cells", f"""select c."row", c.col, round(case when a < 1e-5 then 0 else a end, 6) as depth, cast(o > 1e-5 or i > 1e-5 as integer) as moving from
    (select c.*, coalesce(o, 0) as o, coalesce(i, 0) as i, c.depth - coalesce(o, 0) / {CELL * CELL} + coalesce(i, 0) / {CELL * CELL} as a from lv c
        left join (select "row", col, sum(q) as o from f group by 1, 2) x on c."row" = x."row" and c.col = x.col
        left join (select "row" + dr as "row", col + dc as col, sum(q) as i from f group by 1, 2) y on c."row" = y."row" and c.col = y.col) c""", {
    "lv": f"select *, height + depth as wse, {_LUT}[land_cover + 1] as rough from cells",
    "sl": _slope("wse"),
    "v": f"""select s.*, c.depth, least(case when rough = 0 then 0 else 1 / rough end * pow(c.depth, 2.0::double / 3) * sqrt(slope), 1000 * 9.81::double * c.depth * c.depth * slope / (3 * 0.001::double + 1e-8)) * c.depth * {CELL} * 40 as t
        from sl s join lv c on s."row" = c."row" and s.col = c.col""",
    "al": f"""select "row", col, case when sum(t) = 0 then 0 else least(sum(t), any_value(depth) * {CELL * CELL}) / sum(t) end as alpha from v group by 1, 2""",
    "f": 'select v."row", v.col, dr, dc, t * alpha as q from v join al on v."row" = al."row" and v.col = al.col',
}))
def route_once(v):
    cells = layers.reclass(v.cells, K.ROUGHNESS, K.ROUGHNESS_DEFAULT)
    return focal.route_once(cells, v.spec, **ROUTE).withColumn("depth", R6("depth"))


THROUGH = list(range(31, 42))


@query("D4_grow_region", sql("cells", """select "row", col, cast(case when exists (select 1 from r where r."row" = c."row" and r.col = c.col) then 54 else land_cover end as integer) as land_cover from cells c""", {
    "o": 'select "row", col, land_cover from cells where land_cover = 54 or land_cover between 31 and 41',
    "r": 'select "row", col from o where land_cover = 54 union select o."row", o.col from r join o on abs(o."row" - r."row") <= 1 and abs(o.col - r.col) <= 1',
}, recursive=True))
def grow_region(v):
    from gridloom.operators import regions

    return regions.grow_region(v.cells, COLS, K.SEA_CLASS, THROUGH)


@query("D5_rasterize", sql("cells features", f"""select c."row", c.col, cast(coalesce(m.class, 0) as integer) as class from cells c left join
    (select "row", col, arg_max(class, ord) as class from (select c."row", c.col, e.ord, e.class, count(*) as n from cells c join e on
        least(e.y0, e.y1) < {MAXY} - (c."row" + 0.5::double) * {CELL} and greatest(e.y0, e.y1) >= {MAXY} - (c."row" + 0.5::double) * {CELL}
        and e.x0 + ({MAXY} - (c."row" + 0.5::double) * {CELL} - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) < {MINX} + (c.col + 0.5::double) * {CELL}
        group by all having count(*) % 2 = 1) group by 1, 2) m on c."row" = m."row" and c.col = m.col""", {
    "p": "select ord, class, ring, unnest(range(1, len(ring) + 1)) as i from features",
    "e": "select ord, class, ring[i].x as x0, ring[i].y as y0, ring[i % len(ring) + 1].x as x1, ring[i % len(ring) + 1].y as y1 from p where ring[i].y <> ring[i % len(ring) + 1].y",
}))
def rasterize(v):
    return polygons.rasterize(v.features, v.spec)


@query("D6_dedupe_features", """select feature_id, (max(struct_pack(o := tile_order, c := class))).o as tile_order, (max(struct_pack(o := tile_order, c := class))).c as class from
    (select l_partkey as feature_id, l_orderkey as tile_order, cast(l_suppkey % 56 as integer) as class from lineitem) group by 1""")
def dedupe_features(v):
    feats = v.table("lineitem").selectExpr("l_partkey as feature_id", "l_orderkey as tile_order", "cast(l_suppkey % 56 as int) as class")
    return polygons.dedupe_features(feats)


_MATCH = "case when o_orderkey % 7 = 0 then null else o_orderkey % 90 end"


@query("D7_truncation_audit", f"select o_orderkey, matched, returned, matched - returned as missing from (select o_orderkey, {_MATCH} as matched, o_custkey % 70 as returned from orders) where matched > returned")
def truncation_audit(v):
    tiles = v.table("orders").selectExpr("o_orderkey", f"{_MATCH} as matched", "o_custkey % 70 as returned")
    return polygons.truncation_audit(tiles)
