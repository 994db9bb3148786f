"""Tiles, level of detail and web-mercator pyramids over the fixture grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions import cells as cx
from gridloom.functions import geodesy as gd
from gridloom.operators import layers, tiles
from gridloom.plans import views as vw
from gridloom.plans.gauge_queries import utm_sql
from gridloom.plans.layer_queries import INSIDE, ROWS
from gridloom.plans.registry import query
from gridloom.plans.views import sql

R6 = lambda c: F.round(c, 6)
CELL, COLS = vw.CELL, vw.COLS
MINX, MAXY = vw.MIN_X, vw.MAX_Y
CORE, HALO = 16, 1


def _span(axis):
    return f"select nation, cast(i as bigint) as i, min_{axis} + i * 1000::double as lo, case when i = n - 1 then max_{axis} else min_{axis} + (i + 1) * 1000::double end as hi from (select *, unnest(range(n)) as i from (select *, cast(ceil((max_{axis} - min_{axis}) / 1000) as bigint) as n from boxes))"


@query("E1_tile_edges", sql("boxes", "select x.nation, cast(x.i as integer) as x_idx, cast(y.i as integer) as y_idx, x.lo as min_x, x.hi as max_x, y.lo as min_y, y.hi as max_y from xs x join ys y on x.nation = y.nation", {"xs": _span("x"), "ys": _span("y")}))
def tile_edges(v):
    return tiles.tile_edges(v.boxes, 1000.0, ["nation"])


TILED = {
    "t": f"""select tr, tc, least((tr + 1) * {CORE}, {ROWS}) as er, least((tc + 1) * {CORE}, {COLS}) as ec from (select unnest(range(({ROWS} + {CORE - 1}) // {CORE})) as tr), (select unnest(range({-(-COLS // CORE)})) as tc)""",
    "g": f"""select r, c, p.height from (select unnest(range(-{HALO}, {ROWS} + {HALO})) as r), (select unnest(range(-{HALO}, {COLS + HALO})) as c) left join cells p on p."row" = r and p.col = c""",
}


@query("E2_to_tiles", sql("cells", f"""select cast(tr as integer) as tile_row, cast(tc as integer) as tile_col, cast(r as integer) as "row", cast(c as integer) as col,
    case when height is null then 'pad' when r >= tr * {CORE} and r < er and c >= tc * {CORE} and c < ec then 'core' else 'halo' end as role, coalesce(height, 9999) as value
    from t join g on r >= tr * {CORE} - {HALO} and r < er + {HALO} and c >= tc * {CORE} - {HALO} and c < ec + {HALO}""", TILED))
def to_tiles(v):
    return tiles.to_tiles(v.cells, v.spec, CORE, HALO, "height", 9999.0)


@query("E3_active_tiles", sql("cells", f"""select distinct cast(tr as integer) as tile_row, cast(tc as integer) as tile_col from t join cells c on moving = 1
    and "row" >= tr * {CORE} - {HALO} and "row" < er + {HALO} and col >= tc * {CORE} - {HALO} and col < ec + {HALO}""", TILED))
def active_tiles(v):
    return tiles.active_tiles(v.cells, v.spec, CORE, HALO)


@query("E4_merge_core", sql("cells", f"""select "row", col, case when (select count(*) from cells m where m.moving = 1 and m."row" between c."row" // {CORE} * {CORE} - {HALO} and least(c."row" // {CORE} * {CORE} + {CORE}, {ROWS}) + {HALO} - 1
    and m.col between c.col // {CORE} * {CORE} - {HALO} and least(c.col // {CORE} * {CORE} + {CORE}, {COLS}) + {HALO} - 1) > 0 then height + 100 else height end as value from cells c"""))
def merge_core(v):
    live = tiles.active_tiles(v.cells, v.spec, CORE, HALO)
    work = tiles.to_tiles(v.cells, v.spec, CORE, HALO, "height").join(live, ["tile_row", "tile_col"])
    return tiles.merge_core(v.layer("height"), work.withColumn("value", F.col("value") + 100))


@query("E5_wet_chunks", sql("frames", f"""select cast(idx // {COLS} // 8 as integer) as chunk_row, cast(idx % {COLS} // 8 as integer) as chunk_col, max(risk) > 3 as wet from frames group by 1, 2"""))
def wet_chunks(v):
    wet = layers.idx_to_rowcol(v.frames, COLS).select("row", "col", (F.col("risk") > 3).alias("wet"))
    return tiles.wet_chunks(wet, 8)


@query("E6_lod_sample", sql("cells", """select l.lod, c."row" // 8 as chunk_row, c.col // 8 as chunk_col, c."row", c.col, c.height as value from cells c, (values (0, 1), (1, 3), (2, 8)) l(lod, f)
    join (select "row" // 8 as cr, col // 8 as cc, bool_or(depth > 2.3) as wet from cells group by 1, 2) w on w.cr = c."row" // 8 and w.cc = c.col // 8
    where c."row" % 8 % l.f = 0 and c.col % 8 % l.f = 0 and (wet or lod = 2)"""))
def lod_sample(v):
    chunks = tiles.wet_chunks(v.cells.select("row", "col", (F.col("depth") > 2.3).alias("wet")), 8)
    return tiles.lod_sample(v.layer("height"), chunks, 8, [1, 3, 8])


ZOOMS = (7, 12)
_H = repr(K.MERCATOR_HALF)
_MBOX = "select nation, (min_x - 700000) * 2 - 60000 as west, (max_x - 700000) * 2 - 30000 as east, min_y as south, max_y + 5000 as north from boxes"


def _cover_sql(src, zooms, key):
    return {
        "z": f"select *, {_H}::double * 2 / pow(2, z) as m from (select *, unnest(range({zooms[0]}, {zooms[1] + 1})) as z from {src})",
        "s": f"""select {key}, z, m, greatest(0, cast(floor((west + {_H}) / m) as bigint)) as x0, least(cast(pow(2, z) as bigint) - 1, cast(floor((east + {_H} - 1e-8) / m) as bigint)) as x1,
            greatest(0, cast(floor(({_H} - north) / m) as bigint)) as y0, least(cast(pow(2, z) as bigint) - 1, cast(floor(({_H} - south - 1e-8) / m) as bigint)) as y1 from z""",
        "cover": f"select {key}, cast(z as integer) as z, cast(x as integer) as x, cast(y as integer) as y from (select *, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from s))",
    }


COVER = {"mb": _MBOX, **_cover_sql("mb", ZOOMS, "nation")}


def _cover(v):
    boxes = v.boxes.selectExpr(
        "nation", "(min_x - 700000) * 2 - 60000 as west", "(max_x - 700000) * 2 - 30000 as east", "min_y as south", "max_y + 5000 as north"
    )
    return tiles.xyz_cover(boxes, ZOOMS, ["nation"])


@query("E7_xyz_cover", sql("boxes", "select * from cover", COVER))
def xyz_cover(v):
    return _cover(v)


@query("E8_xyz_bounds", sql("boxes", f"""select nation, z, x, y, round(x * m - {_H}, 3) as west, round({_H} - y * m - m, 3) as south, round(x * m - {_H} + m, 3) as east, round({_H} - y * m, 3) as north
    from (select *, {_H}::double * 2 / pow(2, z) as m from cover)""", COVER))
def xyz_bounds(v):
    b = tiles.xyz_bounds(_cover(v))
    return b.withColumns({c: F.round(c, 3) for c in ("west", "south", "east", "north")})


PIXEL_ZOOM = (8, 8)
_A = repr(gd.AXIS)


def grid_box(v):
    """Web-mercator box of the grid, from its two corner cells."""
    corners = v.cells.groupBy().agg(F.min("row").alias("r0"), F.max("row").alias("r1")).select(
        F.explode(F.array(*[F.struct(F.lit(x).alias("x"), y.alias("y")) for x in (v.spec.min_x, v.spec.max_x) for y in (
            F.lit(MAXY) - F.col("r0") * CELL, F.lit(MAXY) - (F.col("r1") + 1) * CELL)])).alias("p")
    ).select("p.x", "p.y")
    m = gd.reproject(corners, v.spec.epsg, 3857)
    return m.agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"), F.lit(0).alias("k"))


def pixel_sql() -> dict[str, str]:
    """Cover of the grid and its pixel centres in the grid's CRS, ending in ``utm`` (z, tx, ty, px, py, x, y)."""
    from gridloom.plans.gauge_queries import geographic_sql

    keys = "z, tx, ty, px, py"
    corner = f"""select x, y, x as k1, y as k2 from (values ({MINX}::double), ({MINX + COLS * CELL}::double)) a(x),
        (select unnest([{MAXY}::double, {MAXY} - {ROWS} * {CELL}::double]) as y)"""
    box = f"select min(mx) as west, max(mx) as east, min(my) as south, max(my) as north, 0 as k from (select radians(lon) * {_A} as mx, asinh(tan(radians(lat))) * {_A} as my from geo)"
    px = f"""select z, x as tx, y as ty, px, py, {_H}::double * 2 / pow(2, z) / 256 as m from cover, (select unnest(range(256)) as px), (select unnest(range(256)) as py)"""
    ll = f"""select {keys}, degrees(((tx * 256 + px + 0.5::double) * m - {_H}) / {_A}) as lon, degrees(2 * atan(exp(({_H} - (ty * 256 + py + 0.5::double) * m) / {_A})) - pi() / 2) as lat from pixels"""
    return {"corner": corner, **geographic_sql("corner", 30, "k1, k2"), "box": box, **_cover_sql("box", PIXEL_ZOOM, "k"), "pixels": px, "ll": ll, **utm_sql("ll", 30, keys)}


_INTS = "cast(z as integer) as z, cast(tx as integer) as tx, cast(ty as integer) as ty, cast(px as integer) as px, cast(py as integer) as py"


def _pixel_cover(v):
    return tiles.xyz_cover(grid_box(v), PIXEL_ZOOM, ["k"])


@query("E9_tile_pixels", sql("cells", f"""select {_INTS}, cast(coalesce(land_cover, 0) as double) as value from utm left join cells c on {INSIDE}
    and c."row" = least(cast(floor(({MAXY} - y) / {CELL}) as integer), {ROWS} - 1) and c.col = least(cast(floor((x - {MINX}) / {CELL}) as integer), {COLS - 1})""", pixel_sql()))
def tile_pixels(v):
    return tiles.tile_pixels(v.layer("land_cover"), v.spec, _pixel_cover(v), "nearest")


_BILIN = {
    **pixel_sql(),
    "f": f"select z, tx, ty, px, py, (x - {MINX}) / {CELL}::double - 0.5::double as fx, ({MAXY} - y) / {CELL}::double - 0.5::double as fy from utm where {INSIDE}",
    "q": "select f.*, d.dr, d.dc, (case when d.dr = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) * (case when d.dc = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) as w from f, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)",
    "inn": """select z, tx, ty, px, py, sum(w * c.height) / sum(w) as h from q join cells c on c."row" = cast(floor(fy) as integer) + dr and c.col = cast(floor(fx) as integer) + dc group by all""",
}


@query("E9b_height_pixels", sql("cells", f"""select {_INTS}, round(coalesce(h, 0), 5) as value from utm left join inn using (z, tx, ty, px, py)""", _BILIN))
def height_pixels(v):
    return tiles.tile_pixels(v.layer("height"), v.spec, _pixel_cover(v), "bilinear").withColumn("value", F.round("value", 5))


@query("E10_height_rgb", sql("cells", """select "row", col, cast(floor(x / 256) as integer) as r, cast(cast(floor(x) as bigint) % 256 as integer) as g, cast(floor((x - floor(x)) * 256) as integer) as b
    from (select "row", col, least(greatest(height * 3000.0625::double + 32768, 0), 65535.99::double) as x from cells)"""))
def height_rgb(v):
    return v.cells.select("row", "col", cx.height_rgb(F.col("height") * 3000.0625).alias("c")).select("row", "col", "c.*")


_PAL = "[" + ",".join(f"{{'r': {e[3]}, 'g': {e[4]}, 'b': {e[5]}}}" for e in K.PALETTE) + "]"


@query("E11_risk_rgba", sql("cells", f"""select "row", col, k.r, k.g, k.b, case when l > 0 then 200 else 0 end as a from (select "row", col, l, {_PAL}[greatest(least(l, 5), 0) + 1] as k from (select "row", col, land_cover - 40 as l from cells))"""))
def risk_rgba(v):
    return v.cells.select("row", "col", cx.level_rgba(F.col("land_cover") - 40, K.PALETTE).alias("c")).select("row", "col", "c.*")


@query("E12_nonempty_tiles", sql("frames cells", f"""select distinct f.step, cast(z as integer) as z, cast(tx as integer) as tx, cast(ty as integer) as ty from
    (select z, tx, ty, least(cast(floor(({MAXY} - y) / {CELL}) as bigint), {ROWS} - 1) * {COLS} + least(cast(floor((x - {MINX}) / {CELL}) as bigint), {COLS - 1}) as idx from utm where {INSIDE}) p
    join frames f on f.idx = p.idx where f.risk > 0""", pixel_sql()))
def nonempty_tiles(v):
    """Sparse frames: pixels are made for tiles that wet cells may lie on, and meet only the wet cells of each frame."""
    shown_cells = layers.idx_to_rowcol(v.frames.filter("risk > 0").select("idx").distinct(), COLS)
    may_show = tiles.candidate_tiles(shown_cells, v.spec, PIXEL_ZOOM)
    px = tiles.pixel_points(_pixel_cover(v).join(may_show, ["z", "x", "y"], "left_semi"), v.spec.epsg).filter(cx.inside(F.col("x"), F.col("y"), v.spec))
    at = px.select("z", "tx", "ty", cx.index_of(cx.row_at(F.col("y"), v.spec), cx.col_at(F.col("x"), v.spec), COLS).alias("idx")).distinct()
    wet = v.frames.filter("risk > 0").select("step", "idx", "risk")
    shown = wet.join(at, "idx").select("step", "z", "tx", "ty", cx.level_rgba(F.col("risk"), K.PALETTE)["a"].alias("a"))
    return tiles.nonempty_tiles(shown, ["step", "z", "tx", "ty"])
