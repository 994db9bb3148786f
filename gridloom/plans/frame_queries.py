"""Frames, deltas, checks and frame messages over the fixture frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.operators import frames as fr
from gridloom.operators import layers
from gridloom.plans import views as vw
from gridloom.plans.registry import query
from gridloom.plans.views import sql
from gridloom.sinks import messages

R6 = lambda c: F.round(c, 6)
#: SQL for the last step there is.
LAST = "(select max(step) from frames)"


def last_step(frames):
    return frames.agg(F.max(F.col("step").cast("int"))).scalar()


@query("F0_wet_by_level", sql("frames", "select step, risk, count(*) as cells, round(sum(depth), 6) as depth from frames where risk > 0 group by 1, 2"))
def wet_by_level(v):
    return v.frames.filter("risk > 0").groupBy("step", "risk").agg(F.count(F.lit(1)).alias("cells"), R6(F.sum("depth")).alias("depth"))


@query("F1_snapshot_every", sql("frames", "select step, idx, depth, risk from frames where step % 4 = 0 or step = (select max(step) from frames)"))
def snapshot_every(v):
    return fr.snapshot_every(v.frames, 4)


DIFF = """select step, idx, cast(coalesce(f.risk, 0) as integer) as risk, coalesce(f.depth, 0) as depth from
    (select step, idx, risk, depth, true as here from frames) f full join
    (select n.next as step, p.idx, p.risk as was from frames p join (select step, lead(step) over (order by step) as next from (select distinct step from frames)) n on p.step = n.step where n.next is not null) p
    using (step, idx) where coalesce(f.risk, 0) <> coalesce(p.was, 0)"""


@query("F2_frame_diff", sql("frames", DIFF))
def frame_diff(v):
    return fr.frame_diff(v.frames)


@query("F3_initial_delta", sql("frames", "select step, idx, risk, depth from frames where risk > 0 and step = (select min(step) from frames)"))
def initial_delta(v):
    first = v.frames.agg(F.min("step")).scalar()
    start = v.frames.filter(F.col("step") == first)
    return fr.initial_delta(start).withColumn("step", first)


@query("F4_apply_deltas", sql("frames", f"""select s.step, d.idx, d.risk, d.depth from (select cast(unnest(range({LAST} + 1)) as integer) as step) s
    asof join d on s.step >= d.step""".replace("asof join d on s.step >= d.step", "cross join (select distinct idx from d) i asof join d on d.idx = i.idx and s.step >= d.step"), {"d": DIFF}))
def apply_deltas(v):
    return fr.apply_deltas(fr.frame_diff(v.frames), last_step(v.frames), v.n).select("step", "idx", "risk", "depth")


@query("F4b_rebuild_frames", sql("frames", "select step, idx, risk from frames where risk > 0"))
def rebuild_frames(v):
    """Applying the differences gives back the wet cells of every frame."""
    return fr.apply_deltas(fr.frame_diff(v.frames), last_step(v.frames), v.n).filter("risk > 0").select("step", "idx", "risk")


@query("F5_ever_wet", sql("frames", "select idx, max(risk) > 0 as wet from frames group by 1"))
def ever_wet(v):
    return fr.ever_wet(v.frames)


@query("F6_assign_chunks", sql("frames", """select step, idx, risk, depth, cast((rank() over w - 1) // 40 as bigint) as chunk, cast((count(*) over (partition by step) + 39) // 40 as bigint) as total_chunks,
    cast((rank() over w - 1) // 40 // 3 as bigint) as batch from frames window w as (partition by step order by idx)"""))
def assign_chunks(v):
    return fr.assign_chunks(v.frames, 40, 3, block=512)


@query("F7_frame_summary", sql("frames", """select step, cast(count(*) filter (risk > 0) as bigint) as wet, coalesce(any_value(n), 0) as changed from frames
    left join (select step, count(*) as n from d group by 1) using (step) group by 1""", {"d": DIFF}))
def frame_summary(v):
    return fr.frame_summary(v.frames, fr.frame_diff(v.frames))


@query("F8_densify", sql("frames", f"""select s.step, c.idx, cast(coalesce(f.risk, 0) as integer) as risk, coalesce(f.depth, 0) as depth from (select cast(unnest(range({LAST} + 1)) as integer) as step) s
    cross join (select p_partkey as idx from part) c left join frames f on f.step = s.step and f.idx = c.idx"""))
def densify(v):
    return fr.densify(v.frames, v.spec, last_step(v.frames))


SAVES = """select step * 2 + k as save_no, step, idx, case when k = 1 and step % 3 = 0 and idx % 50 = 0 then 5 - risk else risk end as risk from frames, (values (0), (1)) t(k)"""


@query("F9_drop_repeated_frames", sql("frames", """select save_no, step from (select save_no, step, s, lag(s) over (order by save_no) as ps, lag(step) over (order by save_no) as pstep from
    (select save_no, step, coalesce(list(struct_pack(i := idx, r := risk) order by idx) filter (risk > 0), []) as s from saves group by 1, 2)) where not coalesce(s = ps and step = pstep, false)""", {"saves": SAVES}))
def drop_repeated(v):
    saves = v.frames.select("step", "idx", "risk", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "step * 2 + k as save_no", "step", "idx", "case when k = 1 and step % 3 = 0 and idx % 50 = 0 then 5 - risk else risk end as risk"
    )
    return fr.drop_repeated_frames(saves)


@query("F10_volume", sql("frames", f"""select step, round(v, 4) as volume, round(abs(v - f) / f, 6) as change, abs(v - f) / f <= 0.005 as ok from
    (select step, v, first_value(v) over (order by step) as f from (select step, sum(depth) * {vw.CELL ** 2} as v from frames group by 1))"""))
def volume(v):
    return fr.volume(v.frames, vw.CELL).withColumns({"volume": F.round("volume", 4), "change": R6("change")})


@query("F11_drift", sql("frames", """select idx, coalesce(a.depth, 0) as before, coalesce(b.depth, 0) as after from (select * from frames where step = 3) a
    full join (select * from frames where step = 4) b using (idx) where abs(coalesce(b.depth, 0) - coalesce(a.depth, 0)) > 0.0001"""))
def drift(v):
    return fr.drift(v.frames, 3, 4)


@query("F12_mirror_check", sql("cells", f"""select kind, min("row") as "row", min(struct_pack(r := "row", c := col)).c as col, round(max(v) - min(v), 6) as gap from
    (select 'left_right' as kind, "row", col, depth as v, least(struct_pack(r := "row", c := col), struct_pack(r := "row", c := {vw.COLS - 1} - col)) as k from cells
    union all select 'top_bottom', "row", col, depth, least(struct_pack(r := "row", c := col), struct_pack(r := {vw._ROWS} - 1 - "row", c := col)) from
        (select cast("row" as bigint) as "row", col, depth from cells)
    union all select 'diagonal', "row", col, depth, least(struct_pack(r := "row", c := col), struct_pack(r := col, c := "row")) from cells) group by kind, k having max(v) - min(v) > 0.01""".replace('min("row") as "row", min(struct_pack(r := "row", c := col)).c as col', 'cast(k.r as integer) as "row", cast(k.c as integer) as col')))
def mirror_check(v):
    return fr.mirror_check(v.cells.select("row", "col", "depth"), v.spec, "depth").withColumn("gap", R6("gap"))


@query("F13_bound_check", sql("cells", 'select "row", col, depth from cells where height >= 5 and depth > 0.00001'))
def bound_check(v):
    return fr.bound_check(v.cells.select("row", "col", "height", "depth"), F.col("height") >= 5, "depth", 1e-5).drop("height")


CHUNKED = {"d": DIFF, "c": "select *, cast((rank() over (partition by step order by idx) - 1) // 40 as bigint) as chunk from d"}
_HEAD = "'EYE_SetState_Layer' as process, 'topo_bathy' as id, cast(idx as varchar) as cell, risk as state, depth as height"
_MESSAGE = "struct<process: string, id: string, changes: struct<coord: struct<x: int, y: int, z: int>, cells: map<string, struct<state: int, height: double>>>>"


def _cells_of(sent, *keys):
    """The cells of layer messages, parsed back: heights are compared as the numbers they are."""
    read = sent.select(*keys, F.from_json("json", _MESSAGE).alias("m"))
    return read.select(*keys, "m.process", "m.id", F.explode("m.changes.cells").alias("cell", "c")).select(*keys, "process", "id", "cell", "c.*")


@query("A15_delta_messages", sql("frames", f"select step, chunk, {_HEAD} from c", CHUNKED))
def delta_messages(v):
    return _cells_of(messages.encode_delta_messages(fr.frame_diff(v.frames), 40), "step", "chunk")


@query("A16_frame_envelope", sql("frames", f"""select step, 1 as rank, chunk, null as json, {_HEAD} from c
    union all select t.step, r, 0, case r when 0 then concat('{{"process":"FrameStart","total_chunks":', (coalesce(n, 0) + 39) // 40, ',"chunks_per_batch":10}}') when 2 then '{{"process":"FrameEnd"}}'
        else concat('{{"process":"EYE_Frame_Sync","simulation_time":"', strftime(t.sim_time, '%Y-%m-%dT%H:%M:%S'), '"}}') end, null, null, null, null, null
    from (select step, max(ts) as sim_time from writes group by 1) t left join (select step, count(*) as n from d group by 1) m on m.step = t.step, (values (0), (2), (3)) k(r)""", CHUNKED))
def frame_envelope(v):
    times = v.writes.groupBy("step").agg(F.max("ts").alias("sim_time"))
    sent = messages.frame_envelope(fr.frame_diff(v.frames), times, 40)
    return sent.filter("rank <> 1").unionByName(_cells_of(sent.filter("rank = 1"), "step", "rank", "chunk"), allowMissingColumns=True)


@query("A17_frame_manifest", sql("frames", """select concat('[', string_agg(concat('"step_', lpad(cast(step as varchar), 5, '0'), '"'), ',' order by step), ']') as frames, true as live from (select distinct step from frames)"""))
def frame_manifest(v):
    return messages.frame_manifest(v.frames, True).withColumn("frames", F.to_json("frames"))


@query("G19_toggle_cells", sql("writes", """select idx, cast(count(*) % 2 as integer) as state from (select distinct step, idx from t where step not in (select step from t where idx >= (select count(*) from part))) group by 1""", {
    "t": "select cast(seq // 7 as bigint) as step, case when seq % 97 = 96 then idx + 1000000 else idx end as idx from writes"}))
def toggle_cells(v):
    return fr_toggle(v)


def fr_toggle(v):
    from gridloom.operators.events import toggle_cells as toggle

    t = v.writes.selectExpr("seq div 7 as step", "case when seq % 97 = 96 then idx + 1000000 else idx end as idx")
    return toggle(t, v.n)
