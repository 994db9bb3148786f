"""File formats: the fixture tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.operators import events as ev
from gridloom.operators import frames as fr
from gridloom.operators import initial, layers
from gridloom.plans import views as vw
from gridloom.plans.frame_queries import last_step
from gridloom.plans.registry import query
from gridloom.plans.views import sql
from gridloom.session import scratch
from gridloom.sinks import rasters as out
from gridloom.sources import eventlog, rasters, stations


@query("A1_read_ascii_raster", sql("cells", 'select "row", col, height as value from cells'))
def read_ascii_raster(v):
    path = scratch(v.spark, "raster")
    out.write_raster(v.layer("height"), v.spec, path, "height")
    return rasters.read_rasters(v.spark, path).drop("raster")


@query("A2_read_raster_headers", sql("cells", f"""select name, 'real' as data_type, cast({vw.COLS} as integer) as cols, cast({vw._ROWS} as integer) as rows, 'EPSG:25830' as crs, {vw.MIN_X}::double as min_x, {vw.MIN_X + vw.COLS * vw.CELL}::double as max_x,
    {vw.MAX_Y}::double - {vw._ROWS} * {vw.CELL}::double as min_y, {vw.MAX_Y}::double as max_y, {vw.CELL}::double as resolution, -9999::double as nodata from (values ('depth'), ('height')) t(name)"""))
def read_raster_headers(v):
    path = scratch(v.spark, "headers")
    for name in ("height", "depth"):
        out.write_raster_header(v.layer(name), v.spec, f"{path}/{name}.doc")
    return rasters.read_raster_headers(v.spark, path).withColumn("raster", F.regexp_extract("raster", r"([a-z]+)\.doc", 1)).withColumnRenamed("raster", "name")


def _series(v):
    dense = layers.idx_to_rowcol(fr.densify(v.frames, v.spec, last_step(v.frames)), vw.COLS)
    series = dense.select("step", "row", "col", F.col("risk").cast("double").alias("value"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    index = v.writes.groupBy("step").agg(F.min(day).alias("ts_start")).withColumn("ts_end", F.expr("ts_start + interval 1 day"))
    path = scratch(v.spark, "series")
    out.write_raster_series(series, index, v.spec, path, "risk", factor=2, data_type="integer")
    return path


SERIES = {
    "ix": "select step, min(date_trunc('day', ts)) as ts_start, min(date_trunc('day', ts)) + interval 1 day as ts_end from writes group by 1",
}


@query("A3_read_raster_series", sql("frames cells", """select ix.step, ix.ts_start, ix.ts_end, 2 as factor, c."row", c.col, cast(coalesce(f.risk, 0) as double) as value
    from ix cross join cells c left join frames f on f.step = ix.step and f.idx = c.idx""", SERIES))
def read_raster_series(v):
    return rasters.read_raster_series(v.spark, _series(v), "risk")


@query("A13_write_raster_series", sql("frames cells", """select concat(lpad(cast(dense_rank() over (order by ix.step) - 1 as varchar), 6, '0'), '.img') as file, cast(c."row" as bigint) as line,
    string_agg(cast(cast(coalesce(f.risk, 0) as bigint) as varchar), ' ' order by c.col) as text from ix cross join cells c left join frames f on f.step = ix.step and f.idx = c.idx group by ix.step, c."row" """, SERIES))
def write_raster_series(v):
    lines = rasters.read_lines(v.spark, _series(v), glob="*.img")
    return lines.select(F.substring_index("raster", "/", -1).alias("file"), "line", F.col("value").alias("text"))


@query("A4_read_stations", sql("stations", "select cast(station_id as varchar) as station_id, x, y, 25830 as epsg, location, concat('p, ', province) as province from stations"))
def read_stations(v):
    path = scratch(v.spark, "stations")
    v.stations.selectExpr("cast(station_id as string) as station_id", "x", "y", "25830 as epsg", "location", "concat('p, ', province) as province").write.csv(path, header=True)
    return stations.read_stations(v.spark, path)


@query("A5_read_aliases", sql("aliases", "select cast(station_id as varchar) as station_id, alias from aliases"))
def read_aliases(v):
    path = scratch(v.spark, "aliases")
    per = v.aliases.groupBy("station_id").agg(F.collect_list("alias").alias("names"))
    docs = per.groupBy(F.floor(F.col("station_id") / 64).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("station_id").cast("string"), F.col("names")))).alias("m")
    )
    docs.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return stations.read_aliases(v.spark, path)


@query("A6_read_sparse_frames", sql("frames", f"""select step, cast(idx // {vw.COLS} as integer) as "row", cast(idx % {vw.COLS} as integer) as col, risk from frames where risk > 0"""))
def read_sparse_frames(v):
    path = scratch(v.spark, "sparse")
    out.write_sparse_frames(layers.idx_to_rowcol(v.frames, vw.COLS), v.spec, path)
    return rasters.read_sparse_frames(v.spark, path, v.spec.rows, v.spec.cols)


@query("A14_write_sparse_frames", sql("frames", f"""select concat('step_', lpad(cast(step as varchar), 5, '0'), '.csv') as file, concat(idx // {vw.COLS}, ',', idx % {vw.COLS}, ',', risk) as line from frames where risk > 0
    union all select distinct concat('step_', lpad(cast(step as varchar), 5, '0'), '.csv'), 'row,col,flood_risk' from frames
    union all select distinct concat('step_', lpad(cast(step as varchar), 5, '0'), '.csv'), concat('# rows=', {vw._ROWS}, ' cols={vw.COLS} cell_size_m={vw.CELL}') from frames"""))
def write_sparse_frames(v):
    path = scratch(v.spark, "sparse")
    out.write_sparse_frames(layers.idx_to_rowcol(v.frames, vw.COLS), v.spec, path)
    text = v.spark.read.text(path, pathGlobFilter="*.csv")
    return text.select(F.substring_index("_metadata.file_path", "/", -1).alias("file"), F.col("value").alias("line"))


@query("A7_read_event_log", sql("msgs", "select scenario, seq, ts, json from msgs"))
def read_event_log(v):
    path = scratch(v.spark, "log")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")
    v.msgs.select(F.to_json(F.struct("scenario", "seq", stamp, "json")).alias("value")).write.text(path)
    log = eventlog.read_event_log(v.spark, path)
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_TAIL = """concat('<script>let places = [{"n":"a', page_id, '","lat":"', page_id % 90, '.5","lon":', page_id % 180, '},
  {"n":"b', page_id, '","lat":"none","lon":1},{"n":"c', page_id, '","lon":2},{"n":"d","lat":', page_id % 7, ',"lon":"-', page_id % 5, '"}];</script>')"""


@query("A8_extract_page_json", rf"""select page_id, url, i - 1 as pos, e->>'$.n' as name, cast(e->>'$.lat' as double) as lat, cast(e->>'$.lon' as double) as lon from
    (select page_id, url, a, cast(unnest(range(1, cast(json_array_length(a) as bigint) + 1)) as integer) as i, a->(i - 1) as e from
        (select page_id, url, regexp_extract(concat(html, {_TAIL}), '(?s)let\s+places\s*=\s*(\[.*?\]);', 1)::json as a from pages))
    where try_cast(e->>'$.lat' as double) is not null and try_cast(e->>'$.lon' as double) is not null and (e->>'$.n') is not null""")
def extract_page_json(v):
    pages = v.table("pages").withColumn("html", F.expr(f"concat(html, {_TAIL})"))
    return stations.extract_page_json(pages, "places", {"name": "n", "lat": "lat", "lon": "lon"}, ["lat", "lon"])


@query("A9_read_features", sql("features", f"""select concat('f', feature_id) as feature_id, cast(coalesce(list_position([{",".join("'" + c + "'" for c in K.LAND_COVER_CODES)}], cast(100 + feature_id * 7 % 450 as varchar)), 0) as integer) as class,
    k as ring, cast(i - 1 as integer) as pos, pts[i].x as x, pts[i].y as y from (select feature_id, k, pts, unnest(range(1, len(pts) + 1)) as i from
        (select feature_id, 0 as k, ring as pts from features union all select feature_id, 1, ring[1:3] from features where feature_id % 3 = 0))"""))
def read_features(v):
    path = scratch(v.spark, "features")
    listed = lambda ring: F.concat(
        F.lit("<gml:LinearRing><gml:posList>"),
        F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), " "),
        F.lit("</gml:posList></gml:LinearRing>"),
    )
    hole = F.concat(F.lit("<gml:interior>"), listed(F.slice("ring", 1, 3)), F.lit("</gml:interior>"))
    xml = F.concat(
        F.lit('<lcv:LandCoverUnit gml:id="f'), F.col("feature_id").cast("string"), F.lit('"><lcv:class xlink:href="http://codes/'),
        F.expr("cast(100 + feature_id * 7 % 450 as string)"),
        F.lit('"/><lcv:geometry><gml:Polygon><gml:exterior>'), listed(F.col("ring")), F.lit("</gml:exterior>"),
        F.when(F.col("feature_id") % 3 == 0, hole).otherwise(F.lit("")),
        F.lit("</gml:Polygon></lcv:geometry></lcv:LandCoverUnit>"),
    )
    # One document per 64 features, as downloaded tiles are.
    docs = v.features.select(F.floor(F.col("feature_id") / 64).alias("part"), xml.alias("x")).groupBy("part").agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    docs.select(F.concat(F.lit("<FeatureCollection>"), "x", F.lit("</FeatureCollection>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rings = stations.read_features(v.spark, path).select("feature_id", "class", F.posexplode("rings").alias("ring", "r"))
    return rings.select("feature_id", "class", "ring", F.posexplode("r").alias("pos", "p")).select("feature_id", "class", "ring", "pos", "p.x", "p.y")


@query("A11_write_checkpoints", sql("frames", "select concat('checkpoint_', strftime(t, '%Y-%m-%dT%H-%M-%S')) as checkpoint, idx, risk, depth from frames join (select step, max(ts) as t from writes group by 1) using (step)"))
def write_checkpoints(v):
    path = scratch(v.spark, "checkpoints")
    times = v.writes.groupBy("step").agg(F.max("ts").alias("sim_time"))
    timed = v.frames.join(times, "step").select("sim_time", "idx", "risk", "depth")
    out.write_checkpoints(timed, path)
    out.write_checkpoints(timed, path)
    return v.spark.read.parquet(path).select("checkpoint", "idx", "risk", "depth")


@query("A12_write_ascii_raster", sql("cells", """select 'cover.img' as file, cast("row" as bigint) as line, string_agg(cast(land_cover as varchar), ' ' order by col) as text from cells group by "row" """))
def write_ascii_raster(v):
    path = scratch(v.spark, "raster")
    out.write_raster(v.layer("land_cover"), v.spec, path, "cover", data_type="integer")
    lines = rasters.read_lines(v.spark, path, glob="*.img")
    return lines.select(F.substring_index("raster", "/", -1).alias("file"), "line", F.col("value").alias("text"))


INITIAL = {
    "r": """select 'd0' as p, "row", col, round(depth - 1, 6) as value from cells union all select 'd1', "row", col, round(depth * 2 - 1, 6) from cells
        union all select 'd2', "row", col, height from cells union all select 'd3', cast(idx // 45 as integer), cast(idx % 45 as integer), height from cells""",
    "st": "select p, min(value) as lo, max(value) as hi, bool_or(value % 1 <> 0) as frac from r group by 1",
    "ask": """select scenario, json->>'$.id' as layer, arg_max(json->>'$.data_path', seq) as p from control
        where json->>'$.process' = 'InitAgent_Layer' and (json->>'$.data_filename') is not null group by 1, 2""",
}


@query("G22_initial_grid", sql("cells control", f"""select scenario, layer, "row", col, cast(case layer when 'water_depth' then {vw._risk('greatest(coalesce(value, 0), 0)')}
        when 'flood_risk' then coalesce(case when lo >= 0 and hi <= 5 and not frac then value else round_even((value - lo) / (hi - lo) * 5, 0) end, 0) end as integer) as level,
    case layer when 'water_depth' then greatest(coalesce(value, 0), 0) end as depth, case layer when 'topo_bathy' then value end as terrain
    from (select a.scenario, a.layer, c."row", c.col, r.value, st.lo, st.hi, st.frac from ask a join st on st.p = a.p cross join cells c
        left join r on r.p = a.p and r."row" = c."row" and r.col = c.col where a.layer <> 'topo_bathy' or r.value is not null)""", INITIAL))
def initial_grid(v):
    path = scratch(v.spark, "layers")
    for i in range(4):
        value = F.col("depth") * (i + 1) - 1 if i < 2 else F.col("height")
        # the last one is a raster of another width than the grid
        row, col = ("row", "col") if i < 3 else ("cast(idx div 45 as int) as row", "cast(idx % 45 as int) as col")
        out.write_ascii_raster(v.cells.withColumn("value", value).selectExpr(row, col, "value"), f"{path}/d{i}/f")
    made = rasters.read_ascii_raster(v.spark, path, by_folder=True)
    named = made.withColumn("name", F.substring_index("raster", "/", -2))
    ask, _ = ev.layer_requests(ev.decode(v.control)[0])
    return initial.initial_grid(ask, named, v.spec, K.LEVELS, 5)
