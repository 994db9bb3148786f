"""Event log in batch and as a stream over the fixture messages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions.store import write_small
from gridloom.operators import events as ev
from gridloom.plans import views as vw
from gridloom.plans.registry import query
from gridloom.plans.views import sql
from gridloom.session import cut, scratch

BLOCK = 4096
N = vw._N
LIMIT = 20000

GOOD = {
    "j": "select scenario, seq, ts, case when json_valid(json) then json end as j from msgs",
    "good": "select scenario, seq, ts, j, j->>'$.process' as process from j where j->>'$.process' is not null",
}
CTL = {"good": "select scenario, seq, ts, json as j, json->>'$.process' as process from control"}
_NAMES = " ".join(f"when '{k}' then {v}" for k, v in K.STATE_NAMES.items())


def _resolved(c):
    num = ", ".join(f"trunc(try_cast({c}->>'$.{f}' as double))" for f in ("value", "level", "depth_level", "risk_level", "state"))
    named = f"case when {c}->>'$.state' is not null then case upper({c}->>'$.state') {_NAMES} else 1 end end"
    return f"cast(coalesce({num}, {named}, 1) as integer)"


CELLS = {**GOOD, "cells_": f"""select scenario, seq, ts, try_cast(k as bigint) as idx, {_resolved('c')} as risk, coalesce(try_cast(c->>'$.height' as double), 0) as depth from
    (select scenario, seq, ts, k, json_extract(j, concat('$.changes.cells."', k, '"')) as c from
        (select *, unnest(json_keys(j, '$.changes.cells')) as k from good where process = 'EYE_SetState_Layer')) where try_cast(k as bigint) is not null"""}


def _good(v):
    return ev.decode(v.msgs)[0]


def _log(v):
    """The decoded log, written once, for operators that pass over it several times."""
    return ev.decoded_log(v.msgs)


@query("G1_decode", sql("msgs", "select scenario, seq, ts, case when j->>'$.process' is null then 'dead' else 'good' end as kind from j", {"j": GOOD["j"]}))
def decode(v):
    good, dead = ev.decode(v.msgs)
    cols = lambda df, k: df.select("scenario", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(k).alias("kind"))
    return cols(good, "good").unionByName(cols(dead, "dead"))


_KNOWN = ",".join(f"'{k}'" for k in ev.KNOWN)


@query("G2_count_by_process", sql("msgs", f"select scenario, process, count(*) as n, bool_or(process in ({_KNOWN})) as known from good group by 1, 2", GOOD))
def count_by_process(v):
    return ev.count_by_process(_good(v))


@query("G3_explode_cells", sql("msgs", "select scenario, seq, idx, risk, depth from cells_", CELLS))
def explode_cells(v):
    return ev.explode_cells(_good(v)).select("scenario", "seq", "idx", "risk", "depth")


@query("G4_object_changes", sql("control", f"""select scenario, seq, cast(trunc(try_cast(j->>'$.changes.coord.x' as double)) as bigint) as x, cast(trunc(try_cast(j->>'$.changes.coord.y' as double)) as bigint) as y,
    {_resolved("(j->'$.changes')")} as risk from good where process = 'EYE_SetState' and j->>'$.changes.coord.x' is not null and j->>'$.changes.coord.y' is not null""", CTL))
def object_changes(v):
    return ev.object_changes(ev.decode(v.control)[0], vw.COLS).select("scenario", "seq", "x", "y", "risk")


OTHER = "select value, level, state, cast(coalesce(trunc(try_cast(value as double)), trunc(try_cast(level as double)), trunc(try_cast(state as double)), case upper(state) when 'FLOODED' then 5 when 'RISK2' then 2 end, case when state is not null then 0 end, 1) as integer) as risk, event_id from k"


@query("G5_resolve_state", OTHER.replace("from k", "from (select event_id, case when event_id % 3 = 0 then cast(event_id % 9 as varchar) end as value, case when event_id % 5 = 0 then cast(value as varchar) when event_id % 5 = 1 then 'deep' end as level, case event_id % 4 when 0 then 'flooded' when 1 then 'risk2' when 2 then event_type end as state from events)"))
def resolve_state(v):
    rows = v.table("events").selectExpr(
        "event_id", "case when event_id % 3 = 0 then cast(event_id % 9 as string) end as value",
        "case when event_id % 5 = 0 then cast(value as string) when event_id % 5 = 1 then 'deep' end as level",
        "case event_id % 4 when 0 then 'flooded' when 1 then 'risk2' when 2 then event_type end as state",
    )
    none = F.lit(None).cast("string")
    cell = F.struct("value", "level", none.alias("depth_level"), none.alias("risk_level"), "state")
    return rows.withColumn("c", cell).select("event_id", "value", "level", "state", ev.resolve_state(F.col("c"), {"FLOODED": 5, "RISK2": 2}, 0).alias("risk"))


@query("G6_check_bounds", sql("msgs", f"select scenario, seq, idx, idx >= 0 and idx // {vw.COLS} < {vw._ROWS} as ok from cells_", CELLS))
def check_bounds(v):
    ok, bad = ev.check_bounds(ev.explode_cells(_good(v)), v.spec.rows, v.spec.cols)
    cols = lambda df, k: df.select("scenario", "seq", "idx", F.lit(k).alias("ok"))
    return cols(ok, True).unionByName(cols(bad, False))


@query("G7_latest_grid_config", sql("control", """select scenario, coalesce(arg_max(sx, seq) filter (sx is not null), 50) as size_x, coalesce(arg_max(sy, seq) filter (sy is not null), 40) as size_y, arg_max(cell, seq) as cell_resolution_m, max(seq) as seq from
    (select scenario, seq, cast(j->>'$.map.size_x' as bigint) as sx, cast(j->>'$.map.size_y' as bigint) as sy, cast(j->>'$.map.cell_resolution_m' as double) as cell from good where process = 'InitMap_Config')
    where coalesce(sx, 1) > 0 and coalesce(sy, 1) > 0 group by 1""", CTL))
def latest_grid_config(v):
    return ev.latest_grid_config(ev.decode(v.control)[0], (40, 50)).withColumns(
        {"size_x": F.col("size_x").cast("bigint"), "size_y": F.col("size_y").cast("bigint")}
    )


MARKED = {
    **CELLS,
    "m": """select scenario, seq, ts, process, min(case when process = 'FrameEnd' then seq end) over f as ne, min(case when process = 'FrameStart' then seq end) over f as ns,
        max(case when process = 'FrameStart' then seq end) over b as ls, max(case when process = 'FrameEnd' then seq end) over b as le from good
        window f as (partition by scenario order by seq rows between current row and unbounded following), b as (partition by scenario order by seq rows between unbounded preceding and current row)""",
    "k": f"""select m.*, c.idx, c.risk, c.depth, ne as frame_end from m join cells_ c using (scenario, seq)
        where ne is not null and (ns is null or ne < ns) and c.idx >= 0 and c.idx < {N}""",
    "commits": "select scenario, frame_end, idx, arg_max(risk, seq) as risk, arg_max(depth, seq) as depth from k group by 1, 2, 3",
}


def _frames(v, log=None, **kw):
    return ev.assemble_frames(log if log is not None else _log(v), v.spec.rows, v.spec.cols, block=BLOCK, **kw)


@query("G8_assemble_frames", sql("msgs", "select scenario, frame_end, seq, idx, risk, depth from k", MARKED))
def assemble_frames(v):
    return _frames(v).select("scenario", "frame_end", "seq", "idx", "risk", "depth")


@query("G9_commit_changes", sql("msgs", "select * from commits", MARKED))
def commit_changes(v):
    return ev.commit_changes(_frames(v))


SNAPS = {
    **MARKED,
    "ctl": """select scenario, seq, process, case when process = 'FrameEnd' and exists (select 1 from k where k.scenario = g.scenario and k.frame_end = g.seq) then seq end as com from good g where process in ('Init_EOF', 'EYE_Frame_Sync', 'FrameEnd')""",
    "run": """select *, max(case when process = 'Init_EOF' then seq end) over w as eof, max(com) over w as last_com, max(case when process = 'EYE_Frame_Sync' then seq end) over p as prev_sync from ctl
        window w as (partition by scenario order by seq rows between unbounded preceding and current row), p as (partition by scenario order by seq rows between unbounded preceding and 1 preceding)""",
    "snaps": """select scenario, row_number() over (partition by scenario order by seq) - 1 as snap, seq from run
        where process = 'Init_EOF' or (process = 'EYE_Frame_Sync' and eof is not null and last_com > eof and coalesce(prev_sync, -1) < last_com)""",
}


@query("G10_snapshots_at_sync", sql("msgs", "select * from snaps", SNAPS))
def snapshots_at_sync(v):
    log = _log(v)
    return ev.snapshots_at_sync(log, _frames(v, log), BLOCK)


@query("G11_grid_at", sql("msgs", """select s.scenario, s.snap, c.idx, arg_max(c.risk, c.frame_end) as risk, arg_max(c.depth, c.frame_end) as depth from snaps s join commits c on c.scenario = s.scenario and c.frame_end <= s.seq group by 1, 2, 3""", SNAPS))
def grid_at(v):
    log = _log(v)
    made = cut(_frames(v, log), "frames")
    return ev.grid_at(ev.snapshots_at_sync(log, made, BLOCK), ev.commit_changes(made), BLOCK)


@query("G12_gate_before_init", sql("msgs", """select scenario, seq, process from good g where process not in ('EYE_SetState_Layer', 'EYE_SetState')
    or seq > (select min(seq) from good e where e.scenario = g.scenario and e.process = 'Init_EOF')""", GOOD))
def gate_before_init(v):
    return ev.gate_before_init(_good(v), True).select("scenario", "seq", "process")


@query("G11b_grid_ranges", sql("msgs", """select scenario, idx, a as from_snap, coalesce(lead(a) over (partition by scenario, idx order by a) - 1, m) as to_snap, risk, depth from
    (select f.scenario, f.idx, f.a, arg_max(f.risk, f.frame_end) as risk, arg_max(f.depth, f.frame_end) as depth from
        (select c.*, (select min(s.snap) from snaps s where s.scenario = c.scenario and s.seq >= c.frame_end) as a from commits c) f where a is not null group by 1, 2, 3)
    join (select scenario, max(snap) as m from snaps group by 1) using (scenario)""", SNAPS))
def grid_ranges(v):
    log = _log(v)
    made = cut(_frames(v, log), "frames")
    return ev.grid_ranges(ev.snapshots_at_sync(log, made, BLOCK), ev.commit_changes(made), BLOCK)


ACKS = {
    **GOOD,
    "seg": """select *, count(*) filter (process like 'EYE_SetState%') over (partition by scenario, part order by seq) as n from
        (select *, count(*) filter (process = 'FrameStart') over (partition by scenario order by seq) as part from good)""",
    "open_": """select scenario, part, min(ts) filter (process = 'FrameStart') as t0, min(seq) filter (process = 'FrameEnd') as fin,
        max(case when process = 'FrameStart' then cast(j->>'$.chunks_per_batch' as bigint) end) as k from seg where part > 0 group by 1, 2""",
}
LATE = f"""select s.scenario, s.part, min(s.seq) as late from seg s join open_ o using (scenario, part)
    where (o.fin is null or s.seq < o.fin) and epoch_us(s.ts) - epoch_us(o.t0) > {LIMIT} * 1000000::bigint group by 1, 2"""


@query("G13_ack_points", sql("msgs", "select scenario, seq, n from seg join open_ using (scenario, part) where process like 'EYE_SetState%' and k > 0 and n % k = 0", ACKS))
def ack_points(v):
    return ev.ack_points(_log(v), BLOCK)


@query("G13b_ack_points_in_time", sql("msgs", """select scenario, seq, n from seg join open_ using (scenario, part) left join late_ l using (scenario, part)
    where process like 'EYE_SetState%' and k > 0 and n % k = 0 and (l.late is null or seq < l.late)""", {**ACKS, "late_": LATE}))
def ack_points_in_time(v):
    return ev.ack_points(_log(v), BLOCK, LIMIT)


TIMED = {
    **MARKED,
    "st": "select scenario, seq, ts from good where process = 'FrameStart'",
    "x": f"""select m.scenario, m.ls, min(m.seq) as first_late from m join st on st.scenario = m.scenario and st.seq = m.ls
        where (m.le is null or m.ls > m.le) and m.process <> 'FrameStart' and epoch_us(m.ts) - epoch_us(st.ts) > {LIMIT} * 1000000::bigint group by 1, 2""",
    "kept": """select k.* from k left join x on x.scenario = k.scenario and x.ls = k.ls and (k.le is null or k.ls > k.le)
        where not coalesce(k.seq < x.first_late and x.first_late < k.frame_end, false)""",
}


@query("G14_frame_timeouts", sql("msgs", "select scenario, frame_end, seq, idx, risk, depth from kept", TIMED))
def frame_timeouts(v):
    return _frames(v, limit_seconds=LIMIT).select("scenario", "frame_end", "seq", "idx", "risk", "depth")


FILED = {**TIMED, "late": """select * from kept t where seq > (select min(seq) from good e where e.scenario = t.scenario and e.process = 'Init_EOF')"""}


def _stream(v, files: int):
    """Run the fold over the messages written as text files that arrive in order of seq."""
    from gridloom.sources.eventlog import read_event_log
    from gridloom.streaming.fold import FrameFold, run_fold

    root = scratch(v.spark, "fold")
    log = v.msgs.select(F.struct("scenario", "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "json").alias("s"), "seq")
    top = log.agg(F.max("seq").alias("m")).scalar()
    part = F.floor(F.col("seq") * files / (top + 1)).cast("int")
    bounds = log.select(F.to_json("s").alias("value"), "seq", part.alias("part"))
    fold = FrameFold(f"{root}/out", v.spec.rows, v.spec.cols, LIMIT, file_mode=True, compact_every=2)
    # One write and one micro-batch per arrival; an arrival has as many files as tasks write it.
    for i in range(files):
        bounds.filter(F.col("part") == i).select("value").write.mode("append").text(f"{root}/in")
        q = run_fold(read_event_log(v.spark, f"{root}/in", stream=True), fold, f"{root}/checkpoint")
        if not q.awaitTermination(600):
            q.stop()
            raise TimeoutError("the stream did not end")
        if q.exception():
            raise q.exception()
    return f"{root}/out"


@query("G15_frames_stream", sql("msgs", "select scenario, frame_end, seq, idx, risk, depth from late", FILED))
def frames_stream(v):
    from gridloom.streaming.fold import committed_frames

    return committed_frames(v.spark, _stream(v, 3)).select("scenario", "frame_end", "seq", "idx", "risk", "depth")


@query("G16_grid_sink", sql("msgs", "select scenario, idx, arg_max(risk, struct_pack(f := frame_end, s := seq)) as risk, arg_max(depth, struct_pack(f := frame_end, s := seq)) as depth, max(frame_end) as frame_end from late group by 1, 2", FILED))
def grid_sink(v):
    from gridloom.streaming.fold import current_grid

    return current_grid(v.spark, _stream(v, 3))


@query("G17_reconcile_chunks", sql("msgs", """select scenario, 'frame' as kind, ls as at, max(case when process = 'FrameStart' then tc end) as announced, cast(count(*) filter (process like 'EYE_SetState%') as bigint) as seen,
        max(case when process = 'FrameStart' then tc end) - cast(count(*) filter (process like 'EYE_SetState%') as bigint) as gap from t where ls is not null and (le is null or ls > le) and (process = 'FrameStart' or process like 'EYE_SetState%') group by 1, 3
    union all select scenario, 'init', ei, max(case when process = 'Init_EOF' then sent end), cast(count(*) filter (process like 'EYE_SetState%') as bigint),
        max(case when process = 'Init_EOF' then sent end) - cast(count(*) filter (process like 'EYE_SetState%') as bigint) from t where ei is not null and (process = 'Init_EOF' or process like 'EYE_SetState%') group by 1, 3""", {
    **MARKED,
    "t": """select m.*, cast(g.j->>'$.total_chunks' as bigint) as tc, cast(g.j->>'$.total_chunks_sent' as bigint) as sent,
        min(case when m.process = 'Init_EOF' then m.seq end) over (partition by m.scenario order by m.seq rows between current row and unbounded following) as ei from m join good g using (scenario, seq)""",
}))
def reconcile_chunks(v):
    return ev.reconcile_chunks(_log(v), BLOCK)


PHASE = {
    **CTL,
    "a": "select scenario, seq, process, list_position(['System_Ping', 'InitMap_Config', 'Init_EOF', 'Sim_End'], process) as want from good where process in ('System_Ping', 'InitMap_Config', 'Init_EOF', 'Sim_End')",
    "p1": "select scenario, min(seq) as s1 from a where want = 1 group by 1",
    "p2": "select scenario, min(seq) as s2 from a join p1 using (scenario) where want = 2 and seq > s1 group by 1",
    "p3": "select scenario, min(seq) as s3 from a join p2 using (scenario) where want = 3 and seq > s2 group by 1",
    "p4": "select scenario, min(seq) as s4 from a join p3 using (scenario) where want = 4 and seq > s3 group by 1",
    "all_": "select * from a left join p1 using (scenario) left join p2 using (scenario) left join p3 using (scenario) left join p4 using (scenario)",
}
_PN = "['Disconnected', 'Handshake', 'Initialising', 'Running', 'Ended']"


@query("G18_phase_audit", sql("control", f"""select scenario, seq, {_PN}[1 + coalesce(cast(s1 < seq as integer), 0) + coalesce(cast(s2 < seq as integer), 0) + coalesce(cast(s3 < seq as integer), 0) + coalesce(cast(s4 < seq as integer), 0)] as phase,
    {_PN}[want + 1] as requested, process in ('Init_EOF', 'Sim_End') as error from all_ where not (coalesce(s1 = seq, false) or coalesce(s2 = seq, false) or coalesce(s3 = seq, false) or coalesce(s4 = seq, false))""", PHASE))
def phase_audit(v):
    return ev.phase_audit(ev.decode(v.control)[0])


PALETTE_SQL = {
    **CTL,
    "last_": "select scenario, arg_max(j, seq) as j from good where process = 'InitAgent_Layer' and (j->'$.color_palette') is not null group by 1",
    "ok": "select scenario, j, (j->>'$.color_palette[1].value') <> 'bad' as fine from last_",
    "dflt": "select * from (values " + ",".join(str(tuple(e)) for e in K.PALETTE) + ") t(value, label, hex, r, g, b, a)",
}


@query("G20_resolve_palette", sql("control", """select scenario, 'message' as origin, cast(j->>concat('$.color_palette[', i, '].value') as integer) as value, coalesce(j->>concat('$.color_palette[', i, '].label'), '') as label,
        j->>concat('$.color_palette[', i, '].hex') as hex, cast(j->>concat('$.color_palette[', i, '].rgba[0]') as integer) as r, cast(j->>concat('$.color_palette[', i, '].rgba[1]') as integer) as g,
        cast(j->>concat('$.color_palette[', i, '].rgba[2]') as integer) as b, cast(j->>concat('$.color_palette[', i, '].rgba[3]') as integer) as a from ok, (values (0), (1)) k(i) where fine
    union all select s.scenario, 'default', d.* from (select distinct scenario from good) s left join ok on ok.scenario = s.scenario, dflt d where not coalesce(fine, false)""", PALETTE_SQL))
def resolve_palette(v):
    return ev.resolve_palette(ev.decode(v.control)[0], None, K.PALETTE)


@query("G20b_palettes_of_files", sql("control", """select 'file' as given, s.scenario, coalesce(o.origin, 'file') as origin from (select distinct scenario from good) s left join (select scenario, 'message' as origin from ok where fine) o using (scenario)
    union all select 'broken', s.scenario, coalesce(o.origin, 'default') from (select distinct scenario from good) s left join (select scenario, 'message' as origin from ok where fine) o using (scenario)""", PALETTE_SQL))
def palettes_of_files(v):
    """Whose palette is in force, with a file of the default colours and with one that lists no colours."""
    good = cut(ev.decode(v.control)[0], "control")
    root, out = scratch(v.spark, "palettes"), None
    entries = [{"value": str(value), "label": label, "hex": code, "rgba": rgba} for value, label, code, *rgba in K.PALETTE]
    for given, listed in (("file", entries), ("broken", [{"value": "x"}])):
        write_small(v.spark, f"{root}/{given}.json", json.dumps({"layers": {"flood_risk": listed}}))
        made = ev.resolve_palette(good, ev.file_palette(v.spark, f"{root}/{given}.json"), K.PALETTE)
        made = made.select(F.lit(given).alias("given"), "scenario", "origin").distinct()
        out = made if out is None else out.unionByName(made)
    return out


WAIT = 1200


PAIRED = sql("control", f"""select scenario, seq, case when near then pseq end as pong_seq, coalesce(near, false) as answered from
    (select p.scenario, p.seq, q.seq as pseq, epoch_us(q.ts) - epoch_us(p.ts) <= {WAIT} * 1000000::bigint as near from (select * from good where process = 'System_Ping') p
        asof left join (select * from good where process = 'System_Pong') q on p.scenario = q.scenario and p.seq <= q.seq)""", CTL)


@query("G21_pair_ping_pong", PAIRED)
def pair_ping_pong(v):
    return ev.pair_ping_pong(ev.decode(v.control)[0], WAIT, BLOCK)


@query("G21b_ping_pong_stream", PAIRED)
def ping_pong_stream(v):
    """The log as files in order of seq, then an event of a scenario of its own that lets the clock run past every wait."""
    from gridloom.sources.eventlog import read_event_log
    from gridloom.streaming import pingpong

    root = scratch(v.spark, "pairs")
    stamp = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")
    end = v.control.agg((F.max("ts") + F.expr("interval 30 days")).alias("end"), (F.max("seq") + 1).alias("seq"))
    v.control.select(F.to_json(F.struct("scenario", "seq", stamp("ts"), "json")).alias("value"), "seq").repartitionByRange(3, "seq").sortWithinPartitions("seq").select("value").write.text(f"{root}/in")
    last = F.to_json(F.struct(F.lit("clock").alias("scenario"), "seq", stamp("end"), F.lit('{"process":"System_Pong"}').alias("json")))
    end.select(last.alias("value")).write.mode("append").text(f"{root}/in")
    old = v.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", pingpong.STATE_STORE)
    try:
        pairs = pingpong.ping_pong_stream(read_event_log(v.spark, f"{root}/in", stream=True), WAIT, "1 minute")
        q = pairs.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        if not q.awaitTermination(600):
            q.stop()
            raise TimeoutError("the stream did not end")
    finally:
        v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return v.spark.read.schema(pingpong.PAIRS).parquet(f"{root}/out")
