"""Fixture views over the test tables, as DataFrames and as SQL with the same meaning.

Every view maps whole tables: rows are renamed and computed, none is left out.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions import cells as cx
from gridloom.gridspec import GridSpec
from gridloom.operators import layers

COLS = 50
CELL = 200.0
MIN_X = 700000.0
MAX_Y = 4400000.0


class Views:
    """Lazy views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        # Naive times are read as UTC; a zone with daylight saving would shift step boundaries.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    @cached_property
    def n(self) -> int:
        return self.table("part").count()

    @cached_property
    def spec(self) -> GridSpec:
        return GridSpec(self.n // COLS, COLS, CELL, MIN_X, MAX_Y, 25830)

    @cached_property
    def cells(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as idx",
            f"cast(p_partkey div {COLS} as int) as row",
            f"cast(p_partkey % {COLS} as int) as col",
            "(p_size - 10) * cast(0.5 as double) as height",
            "greatest(cast(0 as double), (p_size - 25) * cast(0.1 as double)) as depth",
            "cast(substr(p_brand, 7) as int) + 30 as land_cover",
            "cast((p_partkey * 7) % 23 = 0 as int) as moving",
        )

    def layer(self, column: str) -> DataFrame:
        return self.cells.select("row", "col", F.col(column).cast("double").alias("value"))

    @cached_property
    def writes(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as seq",
            "ts",
            "concat('s', user_id % 4) as scenario",
            "day(ts) - 1 as step",
            f"(user_id * 13 + event_id % 4) % {self.n} as idx",
            "value / 100 as depth",
        )

    @cached_property
    def frames(self) -> DataFrame:
        last = self.writes.groupBy("step", "idx").agg(F.max_by("depth", "seq").alias("depth"))
        return layers.classify(last, K.LEVELS)

    @cached_property
    def msgs(self) -> DataFrame:
        height = "concat(cast(cast(floor(value / 100) as bigint) as string), '.', lpad(cast(cast(floor(value) as bigint) % 100 as string), 2, '0'))"
        key = f"case when seq % 89 = 88 then 'x' when seq % 97 = 96 then cast(idx + 1000000 as string) else cast(idx as string) end"
        state = (
            "case seq % 4 when 0 then concat('\"state\":', seq % 6) when 1 then concat('\"state\":\"', seq % 6, '\"') "
            "when 2 then '\"state\":\"FLOODED\"' else concat('\"level\":', seq % 6) end"
        )
        body = f"""case
            when seq % 101 = 100 then '{{bad'
            when seq < 8 then '{{"process":"Init_EOF","total_chunks_sent":0}}'
            when event_type = 'signup' and seq % 5 < 2 then concat('{{"process":"FrameStart","total_chunks":', seq % 7, ',"chunks_per_batch":', seq % 3, '}}')
            when event_type = 'purchase' and seq % 5 < 2 then '{{"process":"FrameEnd"}}'
            when event_type = 'error' and seq % 5 = 0 then '{{"process":"EYE_Frame_Sync"}}'
            else concat('{{"process":"EYE_SetState_Layer","changes":{{"cells":{{"', {key}, '":{{', {state}, ',"height":', {height}, '}}}}}}}}') end"""
        return self.table("events").selectExpr(
            "event_id as seq", "cast(ts as timestamp) as ts", "concat('s', user_id % 4) as scenario", "event_type", "value",
            f"(user_id * 13 + event_id % 4) % {self.n} as idx",
        ).selectExpr("scenario", "seq", "ts", f"{body} as json")

    @cached_property
    def control(self) -> DataFrame:
        """Control messages of every kind that ``msgs`` does not hold, one per event."""
        return self.table("events").selectExpr(
            "concat('s', user_id % 4) as scenario", "event_id as seq", "cast(ts as timestamp) as ts", CONTROL_JSON + " as json"
        )

    @cached_property
    def stations(self) -> DataFrame:
        rows = self.spec.rows
        return self.table("supplier").selectExpr(
            "s_suppkey as station_id",
            f"cast({MIN_X} as double) + ((s_suppkey * 37) % {COLS}) * 200 + 100 as x",
            f"cast({MAX_Y} as double) - ((s_suppkey * 61) % {rows}) * 200 - 100 as y",
            "s_name as location",
            "s_nationkey as province",
        )

    @cached_property
    def web(self) -> DataFrame:
        return self.stations.selectExpr(
            "case when station_id % 3 = 0 then station_id + 1000000 else station_id end as station_id",
            "x + 50 as x", "y", "location", "province",
        )

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_suppkey as station_id", "l_quantity as mm_per_hour", "l_shipdate as start_ts",
            "l_shipdate + make_dt_interval(l_linenumber) as end_ts",
        )

    @cached_property
    def steps(self) -> DataFrame:
        """Daily steps over the whole span of the readings."""
        from gridloom.operators.gauges import step_calendar

        span = self.readings.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
        return step_calendar(span, 86400, [])

    @cached_property
    def points(self) -> DataFrame:
        """Gauge points: step = line number, value = mean quantity of the station."""
        mean = self.table("lineitem").groupBy(F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("station_id")).agg(
            F.avg("l_quantity").alias("value")
        )
        return mean.join(self.stations.select("station_id", "x", "y"), "station_id").select("step", "station_id", "x", "y", "value")

    @cached_property
    def reports(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey % 5 as source", "cast(o_orderdate as date) as report_date", "cast(1 + o_orderkey % 10 as int) as period", "o_orderstatus",
        ).groupBy("source", "report_date", "period").agg((F.sum((F.col("o_orderstatus") == "O").cast("int")) > 0).alias("matched"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey as line_id",
            "case when s_suppkey % 7 = 0 then concat(s_name, ' ', s_suppkey % 90) else concat(s_name, ' ', s_suppkey % 90, '.', s_suppkey % 10) end as line",
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Two aliases per station: its own name and a number range it shares with nine others."""
        return self.table("supplier").selectExpr(
            "s_suppkey as station_id",
            "inline(array(struct(upper(s_name) as alias), struct(concat('R#', lpad(cast(s_suppkey div 10 as string), 8, '0')) as alias)))",
        )

    @cached_property
    def boxes(self) -> DataFrame:
        """Bounding box of each nation's stations, one cell half wider on every side."""
        return self.stations.groupBy(F.col("province").alias("nation")).agg(
            (F.min("x") - 100).alias("min_x"), (F.max("x") + 100).alias("max_x"),
            (F.min("y") - 100).alias("min_y"), (F.max("y") + 100).alias("max_y"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """One polygon per station: triangles and concave arrows around it, overlapping each other."""
        pts = "named_struct('x', x + {0}, 'y', y + {1})"
        tri = ",".join(pts.format(a, b) for a, b in TRIANGLE)
        arrow = ",".join(pts.format(a, b) for a, b in ARROW)
        return self.stations.selectExpr(
            "station_id as feature_id", "station_id as ord", "cast(1 + station_id % 55 as int) as class",
            f"case when station_id % 2 = 0 then array({tri}) else array({arrow}) end as ring",
        )


# Offsets in metres of the two polygon forms around a station, not aligned with cell centres.
TRIANGLE = [(-730.0, -510.0), (910.0, -130.0), (70.0, 870.0)]
ARROW = [(-810.0, -790.0), (30.0, -110.0), (830.0, -770.0), (50.0, 930.0)]

# Control message of an event, valid in both SQL dialects.
CONTROL_JSON = """case
    when event_type = 'signup' then concat('{"process":"InitMap_Config","map":{',
        case when event_id % 3 = 0 then '' else concat('"size_x":', cast(event_id % 7 * 10 as bigint), ',') end,
        case when event_id % 4 = 0 then '' else concat('"size_y":', cast(event_id % 11 * 10 as bigint), ',') end,
        '"cell_resolution_m":', cast(1 + event_id % 9 as bigint), '}}')
    when event_type = 'view' and event_id % 50 = 7 then '{"process":"Init_EOF","total_chunks_sent":3}'
    when event_type = 'view' and event_id % 50 = 8 then '{"process":"Sim_End"}'
    when event_type = 'view' then concat('{"process":"EYE_SetState","changes":{"coord":{',
        case when event_id % 7 = 0 then '' else concat('"x":', cast(event_id % 61 as bigint), case when event_id % 5 = 0 then '' else ',' end) end,
        case when event_id % 5 = 0 then '' else concat('"y":', cast(event_id % 53 - 2 as bigint)) end,
        '}', case event_id % 4 when 0 then ',"value":2.7' when 1 then ',"state":"high_depth"' when 2 then ',"risk_level":"5"' else '' end, '}}')
    when event_type = 'click' then concat('{"process":"System_Ping","source":"p', cast(event_id % 3 as bigint), '"}')
    when event_type = 'purchase' then '{"process":"System_Pong"}'
    else concat('{"process":"InitAgent_Layer","id":"', case event_id % 3 when 0 then 'topo_bathy' when 1 then 'water_depth' else 'flood_risk' end,
        '","data_path":"d', cast(event_id % 4 as bigint), case when event_id % 5 = 0 then '"' else '","data_filename":"f"' end,
        case when event_id % 2 = 0 then '' else concat(',"color_palette":[{"value":', cast(event_id % 3 + 1 as bigint),
            ',"label":"b","hex":"#0', cast(event_id % 10 as bigint), '","rgba":[1,2,3,', cast(event_id % 256 as bigint),
            ']},{"value":', case when event_id % 4 = 1 then '"bad"' else '0' end, ',"hex":"#000000","rgba":[0,0,0,255]}]') end, '}')
    end"""

_N = "(select count(*) from part)"
_ROWS = f"({_N} // {COLS})"


def _risk(depth: str) -> str:
    tests = " ".join(f"when {depth} >= cast({t} as double) then {lv}" for lv, _, t in reversed(K.LEVELS))
    return f"cast(case {tests} else 0 end as integer)"


def _ring_sql(points: list[tuple[float, float]]) -> str:
    return "[" + ",".join(f"{{'x': x + {a}, 'y': y + {b}}}" for a, b in points) + "]"


SQL = {
    "cells": f"""select p_partkey as idx, cast(p_partkey // {COLS} as integer) as "row", cast(p_partkey % {COLS} as integer) as col,
        (p_size - 10) * cast(0.5 as double) as height, greatest(cast(0 as double), (p_size - 25) * cast(0.1 as double)) as depth,
        cast(substr(p_brand, 7) as integer) + 30 as land_cover, cast((p_partkey * 7) % 23 = 0 as integer) as moving from part""",
    "writes": f"""select event_id as seq, ts, concat('s', user_id % 4) as scenario, cast(day(ts) - 1 as integer) as step,
        (user_id * 13 + event_id % 4) % {_N} as idx, value / 100 as depth from events""",
    "frames": f"""select step, idx, depth, {_risk('depth')} as risk from
        (select step, idx, arg_max(depth, seq) as depth from writes group by step, idx)""",
    "ev0": f"""select event_id as seq, ts, concat('s', user_id % 4) as scenario, event_type, value,
        (user_id * 13 + event_id % 4) % {_N} as idx from events""",
    "msgs": """select scenario, seq, ts, case
        when seq % 101 = 100 then '{bad'
        when seq < 8 then '{"process":"Init_EOF","total_chunks_sent":0}'
        when event_type = 'signup' and seq % 5 < 2 then concat('{"process":"FrameStart","total_chunks":', seq % 7, ',"chunks_per_batch":', seq % 3, '}')
        when event_type = 'purchase' and seq % 5 < 2 then '{"process":"FrameEnd"}'
        when event_type = 'error' and seq % 5 = 0 then '{"process":"EYE_Frame_Sync"}'
        else concat('{"process":"EYE_SetState_Layer","changes":{"cells":{"',
            case when seq % 89 = 88 then 'x' when seq % 97 = 96 then cast(idx + 1000000 as varchar) else cast(idx as varchar) end,
            '":{', case seq % 4 when 0 then concat('"state":', seq % 6) when 1 then concat('"state":"', seq % 6, '"')
                when 2 then '"state":"FLOODED"' else concat('"level":', seq % 6) end,
            ',"height":', cast(cast(floor(value / 100) as bigint) as varchar), '.', lpad(cast(cast(floor(value) as bigint) % 100 as varchar), 2, '0'), '}}}}') end as json
        from ev0""",
    "control": f"select concat('s', user_id % 4) as scenario, event_id as seq, ts, {CONTROL_JSON} as json from events",
    "stations": f"""select s_suppkey as station_id, cast({MIN_X} as double) + ((s_suppkey * 37) % {COLS}) * 200 + 100 as x,
        cast({MAX_Y} as double) - ((s_suppkey * 61) % {_ROWS}) * 200 - 100 as y, s_name as location, s_nationkey as province from supplier""",
    "web": """select case when station_id % 3 = 0 then station_id + 1000000 else station_id end as station_id, x + 50 as x, y, location, province from stations""",
    "readings": """select l_suppkey as station_id, l_quantity as mm_per_hour, l_shipdate as start_ts,
        l_shipdate + to_days(cast(l_linenumber as integer)) as end_ts from lineitem""",
    "steps": """select cast(i as integer) as step, lo + to_days(cast(i as integer)) as s0, lo + to_days(cast(i + 1 as integer)) as s1 from
        (select min(start_ts) as lo, max(end_ts) as hi from readings), lateral (select unnest(range(0, date_diff('second', lo, hi) // 86400)) as i)""",
    "points": """select step, m.station_id, x, y, value from
        (select l_linenumber as step, l_suppkey as station_id, avg(l_quantity) as value from lineitem group by all) m join stations s on m.station_id = s.station_id""",
    "cellpoints": f"""select step, floor((x - {MIN_X}) / {CELL}) * {CELL} + {MIN_X} + {CELL / 2} as x,
        {MAX_Y} - floor(({MAX_Y} - y) / {CELL}) * {CELL} - {CELL / 2} as y, avg(value) as value from points group by 1, 2, 3""",
    "reports": """select o_custkey % 5 as source, cast(o_orderdate as date) as report_date, cast(1 + o_orderkey % 10 as integer) as period,
        bool_or(o_orderstatus = 'O') as matched from orders group by 1, 2, 3""",
    "lines": """select s_suppkey as line_id, case when s_suppkey % 7 = 0 then concat(s_name, ' ', s_suppkey % 90)
        else concat(s_name, ' ', s_suppkey % 90, '.', s_suppkey % 10) end as line from supplier""",
    "aliases": """select s_suppkey as station_id, unnest([upper(s_name), concat('R#', lpad(cast(s_suppkey // 10 as varchar), 8, '0'))]) as alias from supplier""",
    "boxes": """select province as nation, min(x) - 100 as min_x, max(x) + 100 as max_x, min(y) - 100 as min_y, max(y) + 100 as max_y from stations group by 1""",
    "features": f"""select station_id as feature_id, station_id as ord, cast(1 + station_id % 55 as integer) as class,
        case when station_id % 2 = 0 then {_ring_sql(TRIANGLE)} else {_ring_sql(ARROW)} end as ring from stations""",
}
_NEEDS = {
    "frames": ["writes"], "msgs": ["ev0"], "web": ["stations"], "steps": ["readings"], "points": ["stations"],
    "cellpoints": ["points"], "boxes": ["stations"], "features": ["stations"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in [*_closure(_NEEDS.get(n, [])), n]:
            if d not in out:
                out.append(d)
    return out


def sql(views: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A query over the named views, as one statement with common table expressions."""
    parts = [f"{n} as ({SQL[n]})" for n in _closure(views.split())]
    parts += [f"{n} as ({q})" for n, q in (extra or {}).items()]
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
