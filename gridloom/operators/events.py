"""Event log ``(scenario, seq, ts, json)`` in batch.

``seq`` is unique within a scenario and gives the arrival order. Order-dependent operators use running
totals over blocks of ``seq`` on narrow columns, and interval joins for the messages themselves, so
one busy scenario is still spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions.cells import col_of, div, row_of
from gridloom.functions.ranges import interval_join, seconds
from gridloom.functions.running import even_width, running
from gridloom.functions.store import exists
from gridloom.session import cut

_CELL = "value: string, level: string, depth_level: string, risk_level: string, state: string, height: string"

_CELL_NAMES = ("value", "level", "depth_level", "risk_level", "state", "height")

# Parts of a message. An operator parses only the part it needs, and as late as it can: the raw text
# is what travels through shuffles, and only rows that survive are parsed in full.
PARTS = {
    "process": "process: string",
    "changes": f"changes: struct<coord: struct<x: string, y: string>, {_CELL}, cells: map<string, struct<{_CELL}>>>",
    "map": "map: struct<size_x: string, size_y: string, cell_resolution_m: string>",
    "chunks": "total_chunks: bigint, total_chunks_sent: bigint, chunks_per_batch: bigint",
    "layer": "id: string, data_path: string, data_filename: string",
    "palette": "color_palette: array<struct<value: string, label: string, hex: string, rgba: array<string>>>",
}


def part(name: str) -> Column:
    """One part of the message text as a struct; broken text gives nulls."""
    return F.from_json("json", f"struct<{PARTS[name]}>", {"mode": "PERMISSIVE"})


#: Snapshots of a band of an expanded grid.
BAND = 256

STATE_KINDS = ("EYE_SetState_Layer", "EYE_SetState")
# The kinds of messages.
KNOWN = [
    "System_Ping", "System_Pong", "System_Disconnected", "InitMap_Config", "InitAgent_Layer", "InitAgent_EOF", "Init_EOF",
    "FrameStart", "EYE_SetState_Layer", "EYE_SetState", "FrameEnd", "EYE_Frame_Sync", "Sim_End", "ChunkAck",
]


def _is(kind: str) -> Column:
    return F.col("process") == kind


def _width(block: int | Column | None, log: DataFrame) -> int | Column:
    """The block width asked for, or one that suits how dense the numbers of the log are."""
    return even_width(log, "seq") if block is None else block


def parse(events: DataFrame) -> DataFrame:
    """Add the kind of message; broken JSON or a missing ``process`` leaves it null.

    The generator keeps filters on ``process`` above it: they would otherwise move below and parse
    the text a second time.
    """
    return events.select("*", F.inline(F.array(part("process"))))


def decode(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events with their ``process`` and the dead letter; nothing fails and nothing is lost."""
    parsed = parse(events)
    good = parsed.filter(F.col("process").isNotNull())
    dead = parsed.filter(F.col("process").isNull()).drop("process")
    return good, dead


def count_by_process(good: DataFrame) -> DataFrame:
    known = F.col("process").isin(KNOWN)
    return good.groupBy("scenario", "process").agg(F.count(F.lit(1)).alias("n"), F.max(known).alias("known"))


def number(text: Column) -> Column:
    """A JSON number or its text as DOUBLE; null for anything else, however odd."""
    return F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double"))


def whole(text: Column) -> Column:
    """Such a number as BIGINT, truncated."""
    return number(text).try_cast("bigint")


def resolve_state(cell: Column, names: dict[str, int] = K.STATE_NAMES, unknown: int = 1) -> Column:
    """First numeric field in fixed order, truncated; else the state name; else 1."""
    fields = ("value", "level", "depth_level", "risk_level", "state")
    numbers = [whole(cell[f]).try_cast("int") for f in fields]
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    named = F.when(cell["state"].isNotNull(), F.coalesce(F.try_element_at(table, F.upper(cell["state"])), F.lit(unknown)))
    return F.coalesce(*numbers, named, F.lit(1)).cast("int")


def explode_cells(good: DataFrame, names: dict[str, int] = K.STATE_NAMES, unknown: int = 1) -> DataFrame:
    """One row per changed cell of a layer message; keys that are no integers are skipped."""
    layer = good.filter(F.col("process") == "EYE_SetState_Layer").select(
        "scenario", "seq", "ts", F.posexplode(F.map_entries(part("changes")["changes"]["cells"])).alias("pos", "kv")
    )
    cell = F.col("kv.value")
    return layer.select(
        "scenario",
        "seq",
        "ts",
        "pos",
        F.col("kv.key").try_cast("bigint").alias("idx"),
        resolve_state(cell, names, unknown).alias("risk"),
        F.coalesce(number(cell["height"]), F.lit(0.0)).alias("depth"),
    ).filter(F.col("idx").isNotNull())


def object_changes(good: DataFrame, cols: int, names: dict[str, int] = K.STATE_NAMES, unknown: int = 1) -> DataFrame:
    """Single-cell messages ``(x, y)``; a missing coordinate gives no row and depth is not carried."""
    ch = F.col("ch")
    x, y = whole(ch["coord"]["x"]), whole(ch["coord"]["y"])
    return (
        good.filter(F.col("process") == "EYE_SetState")
        .withColumn("ch", part("changes")["changes"])
        .select(
            "scenario", "seq", "ts", F.lit(0).alias("pos"), x.alias("x"), y.alias("y"),
            resolve_state(ch, names, unknown).alias("risk"), F.lit(None).cast("double").alias("depth"),
        )
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def check_bounds(changes: DataFrame, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """Changes on the grid, with row and col, and the rejected rest; negatives are rejected."""
    keyed = changes.withColumns({"row": div(F.col("idx"), cols), "col": F.pmod("idx", F.lit(cols))})
    ok = (F.col("idx") >= 0) & (F.col("row") < rows)
    return keyed.filter(ok), keyed.filter(~ok)


def latest_grid_config(good: DataFrame, default: tuple[int, int]) -> DataFrame:
    """Grid size per scenario after the last valid configuration.

    A message whose given sizes are not positive is ignored as a whole; a missing size keeps the
    one in force, which is the last given one among the valid messages.
    """
    m = F.col("m")
    sx, sy = whole(m["size_x"]), whole(m["size_y"])
    bad = (m["size_x"].isNotNull() & sx.isNull()) | (m["size_y"].isNotNull() & sy.isNull())
    valid = good.filter(F.col("process") == "InitMap_Config").withColumn("m", part("map")["map"]).filter(~F.coalesce(bad, F.lit(False))).select(
        "scenario", "seq", sx.alias("sx"), sy.alias("sy"), m["cell_resolution_m"].try_cast("double").alias("cell")
    ).filter((F.coalesce("sx", F.lit(1)) > 0) & (F.coalesce("sy", F.lit(1)) > 0))
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return valid.groupBy("scenario").agg(
        F.coalesce(given("sx"), F.lit(default[1])).alias("size_x"),
        F.coalesce(given("sy"), F.lit(default[0])).alias("size_y"),
        F.max_by("cell", "seq").alias("cell_resolution_m"),
        F.max("seq").alias("seq"),
    )


def decoded_log(events: DataFrame) -> DataFrame:
    """Good events written once to the shared folder, each where it was read: no message is shuffled.

    Operators that pass over the log several times then read only the columns they need and never
    parse a message twice.
    """
    return cut(decode(events)[0], "log")


def frame_segments(
    good: DataFrame, limit_seconds: float | None = None, first_eof: DataFrame | None = None, block: int | Column | None = None
) -> DataFrame:
    """Stretches ``[lo, frame_end)`` of the log whose changes a FrameEnd commits, one row per frame.

    A stretch begins after the FrameStart or FrameEnd before it. With a limit, ``late`` is the first
    event before the FrameEnd that comes more than the limit after the FrameStart: it clears what is
    pending and stops the timer, so changes count from there. With ``first_eof`` changes count only
    after the first Init_EOF of the scenario. Only boundary messages are ordered here, never the
    messages that carry cells.
    """
    block = _width(block, good)
    bounds = good.filter(_is("FrameStart") | _is("FrameEnd")).select("scenario", "seq", "ts", _is("FrameStart").alias("starts"))
    begin = good.groupBy("scenario").agg((F.min("seq") - 1).alias("seq")).select(
        "scenario", "seq", F.lit(None).cast(good.schema["ts"].dataType).alias("ts"), F.lit(False).alias("starts")
    )
    before = running(
        bounds.unionByName(begin), ["scenario"], "seq", {"_p": ("max", F.struct("seq", "ts", "starts"))}, block=block, exclusive=True
    )
    segments = before.filter(~F.col("starts") & F.col("_p").isNotNull()).select(
        "scenario", (F.col("_p.seq") + 1).alias("lo"), F.col("seq").alias("frame_end"), F.when(F.col("_p.starts"), F.col("_p.ts")).alias("timer")
    )
    if limit_seconds is not None:
        timed = interval_join(
            good.select("scenario", "seq", "ts"), segments.filter(F.col("timer").isNotNull()),
            F.col("seq"), F.col("lo"), F.col("frame_end"), block, ["scenario"],
        )
        over = seconds(F.col("ts")) - seconds(F.col("timer")) > int(limit_seconds * 1_000_000)
        late = timed.filter(over).groupBy("scenario", "frame_end").agg(F.min("seq").alias("late"))
        segments = segments.join(late, ["scenario", "frame_end"], "left").withColumn("lo", F.coalesce("late", "lo")).drop("late")
    if first_eof is not None:
        segments = segments.join(first_eof, "scenario").withColumn("lo", F.greatest(F.col("lo"), F.col("eof") + 1)).drop("eof")
    return segments.drop("timer")


def first_init_eof(good: DataFrame) -> DataFrame:
    return good.filter(_is("Init_EOF")).groupBy("scenario").agg(F.min("seq").alias("eof"))


def gate_before_init(good: DataFrame, file_mode: bool) -> DataFrame:
    """In file mode, drop state messages that arrive before the first Init_EOF of their scenario.

    The messages meet one row per scenario, so that no message is ordered.
    """
    if not file_mode:
        return good
    first = first_init_eof(good).withColumnRenamed("eof", "_eof")
    keep = ~F.col("process").isin(*STATE_KINDS) | (F.col("seq") >= F.col("_eof"))
    return good.join(first, "scenario", "left").filter(keep).drop("_eof")


def assemble_frames(
    good: DataFrame, rows: int, cols: int, limit_seconds: float | None = None, file_mode: bool = False,
    block: int | Column | None = None,
) -> DataFrame:
    """Committed changes ``(scenario, frame_end, seq, pos, idx, risk, depth, row, col)``.

    State messages meet the table of frames in an interval join on blocks of ``seq``. No window sees
    them, so a frame or scenario that holds most of the log is split like any other join input, and
    only messages of a committed frame are parsed.
    """
    block = _width(block, good)
    segments = frame_segments(good, limit_seconds, first_init_eof(good) if file_mode else None, block)
    return frame_changes(committed_messages(good, segments, block), rows, cols)


def committed_messages(good: DataFrame, segments: DataFrame, block: int | Column | None = None) -> DataFrame:
    block = _width(block, good)
    state = good.filter(F.col("process").isin(*STATE_KINDS)).select("scenario", "seq", "process", "json")
    return interval_join(state, segments, F.col("seq"), F.col("lo"), F.col("frame_end"), block, ["scenario"]).drop("lo")


def frame_changes(kept: DataFrame, rows: int, cols: int) -> DataFrame:
    """Explode layer and single-cell messages in one pass, keeping ``frame_end``."""
    single = F.map_from_arrays(F.array(F.lit("")), F.array(F.struct(*[F.col("ch")[n].alias(n) for n in _CELL_NAMES])))
    parsed = kept.select(
        "scenario", "seq", "frame_end", "process", part("changes")["changes"].alias("ch")
    )
    is_layer = F.col("process") == "EYE_SetState_Layer"
    cells = F.when(is_layer, F.col("ch.cells")).otherwise(single)
    c = parsed.select(
        "scenario", "seq", "frame_end", is_layer.alias("layer"), F.col("ch.coord").alias("at"), F.posexplode(F.map_entries(cells)).alias("pos", "kv")
    )
    x, y = whole(F.col("at.x")), whole(F.col("at.y"))
    on_grid = (x >= 0) & (x < cols) & (y >= 0) & (y < rows)
    value = F.col("kv.value")
    out = c.select(
        "scenario", "seq", "frame_end", "pos",
        F.when(F.col("layer"), F.col("kv.key").try_cast("bigint")).when(on_grid, y * cols + x).alias("idx"),
        resolve_state(value).alias("risk"),
        F.when(F.col("layer"), F.coalesce(number(value["height"]), F.lit(0.0))).alias("depth"),
    )
    return out.filter((F.col("idx") >= 0) & (F.col("idx") < rows * cols)).withColumns(
        {"row": row_of(F.col("idx"), cols), "col": col_of(F.col("idx"), cols)}
    )


def write_order() -> Column:
    """Order of a write as one exact number, ``seq`` first and the position in the message next.

    A number keeps ``max_by`` in hash aggregation, while a struct would make it sort its input.
    """
    return F.col("seq").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")


def commit_changes(assembled: DataFrame) -> DataFrame:
    """Last write per cell of a frame; a write without depth keeps the last depth given before it."""
    at = write_order()
    return assembled.groupBy("scenario", "frame_end", "idx").agg(
        F.max_by("risk", at).alias("risk"),
        F.max_by("depth", F.when(F.col("depth").isNotNull(), at)).alias("depth"),
    )


def snapshots_at_sync(good: DataFrame, assembled: DataFrame, block: int | Column | None = None) -> DataFrame:
    """Snapshots ``(scenario, snap, seq)``.

    One exists at every Init_EOF and at each Frame_Sync after the first Init_EOF that follows new data since the
    previous snapshot: a commit with at least one change, or a layer that is loaded (its message is complete and names
    another layer than the terrain). They are numbered from 0.
    """
    block = _width(block, good)
    commits = assembled.select("scenario", F.col("frame_end").alias("seq"))
    asked = _layer_messages(good)
    loaded = asked.filter(_complete() & (F.col("layer") != K.TERRAIN_LAYER)).select("scenario", "seq", F.lit("InitAgent_Layer").alias("process"), F.lit(1).alias("_commit"))
    commits = commits.distinct().withColumn("_commit", F.lit(1))
    marks = (
        good.filter(F.col("process").isin("Init_EOF", "EYE_Frame_Sync", "FrameEnd"))
        .select("scenario", "seq", "process")
        .join(commits, ["scenario", "seq"], "left")
        .unionByName(loaded)
    )
    eof, sync, com = F.col("process") == "Init_EOF", F.col("process") == "EYE_Frame_Sync", F.col("_commit") == 1
    s = F.col("seq")
    run = running(
        marks,
        ["scenario"],
        "seq",
        {
            "_eof": ("max", F.when(eof, s)),
            "_com": ("max", F.when(com, s)),
        },
        block=block,
    )
    # A commit is consumed by an Init_EOF or by the first sync after it.
    fresh = sync & F.col("_eof").isNotNull() & F.col("_com").isNotNull() & (F.col("_com") > F.col("_eof"))
    heads = run.filter(eof | fresh)
    per = heads.groupBy("scenario", F.when(eof, s).otherwise(F.col("_com")).alias("_k"), eof.alias("_is_eof")).agg(
        F.min("seq").alias("seq")
    )
    one = F.lit(1).cast("long")
    return running(per.select("scenario", "seq"), ["scenario"], "seq", {"_n": ("sum", one)}, block=block).select(
        "scenario", (F.col("_n") - 1).alias("snap"), "seq"
    )


def grid_ranges(snapshots: DataFrame, committed: DataFrame, block: int | Column | None = None) -> DataFrame:
    """Cell values ``(scenario, idx, from_snap, to_snap, risk, depth)`` with the snapshots they hold at.

    Each frame is first mapped to the snapshot that shows it, on a table of one row per frame. A
    cell value then holds from that snapshot to the one before the cell's next change; so there is at most one row per
    change, whatever the number of snapshots.
    """
    block = _width(block, committed.select(F.col("frame_end").alias("seq")))
    at = snapshots.select("scenario", "seq", F.col("snap").cast("long").alias("_snap"))
    ends = committed.select("scenario", F.col("frame_end").alias("seq")).distinct()
    marks = at.unionByName(ends.withColumn("_snap", F.lit(None).cast("long")))
    shown = running(marks, ["scenario"], "seq", backward={"_first": ("min", F.col("_snap"))}, block=block)
    first = shown.filter(F.col("_snap").isNull() & F.col("_first").isNotNull()).select(
        "scenario", F.col("seq").alias("frame_end"), F.col("_first").alias("snap")
    )
    last = snapshots.groupBy("scenario").agg(F.max("snap").alias("_max"))
    given = F.when(F.col("depth").isNotNull(), F.col("frame_end"))
    per = committed.join(first, ["scenario", "frame_end"]).groupBy("scenario", "idx", "snap").agg(
        F.max_by("risk", "frame_end").alias("risk"), F.max_by("depth", given).alias("depth")
    )
    w = Window.partitionBy("scenario", "idx").orderBy("snap")
    held = per.withColumns(
        {
            "depth": F.coalesce(F.last("depth", True).over(w), F.lit(0.0)),
            "_next": F.lead("snap").over(w),
        }
    ).join(last, "scenario")
    until = F.coalesce(F.col("_next") - 1, F.col("_max"))
    return held.select("scenario", "idx", F.col("snap").alias("from_snap"), until.alias("to_snap"), "risk", "depth")


def grid_of(ranges: DataFrame, snaps: DataFrame) -> DataFrame:
    """The grids ``(scenario, snap, idx, risk, depth)`` of the asked ``snaps`` (scenario, snap) only."""
    asked = snaps.select("scenario", "snap").distinct()
    # a range meets each asked snapshot in it; the join is by scenario and blocks of snapshots
    met = interval_join(asked, ranges, F.col("snap"), F.col("from_snap"), F.col("to_snap") + 1, 64, ["scenario"])
    return met.select("scenario", "snap", "idx", "risk", "depth")


def grid_at(snapshots: DataFrame, committed: DataFrame, block: int | Column | None = None) -> DataFrame:
    """Cell values ``(scenario, snap, idx, risk, depth)`` at every snapshot: the ranges, expanded.

    Ranges are cut at every ``BAND`` snapshots and each task expands one band after the other, so that the same few
    snapshots follow each other for cell after cell: column files of the many rows stay small.
    """
    held = grid_ranges(snapshots, committed, block)
    bands = F.sequence(F.floor(F.col("from_snap") / BAND), F.floor(F.col("to_snap") / BAND))
    pieces = held.select("*", F.explode(bands).alias("_band")).sortWithinPartitions("scenario", "_band", "idx", "from_snap")
    begin, end = F.greatest("from_snap", F.col("_band") * BAND), F.least("to_snap", F.col("_band") * BAND + (BAND - 1))
    return pieces.select("scenario", F.explode(F.sequence(begin, end)).alias("snap"), "idx", "risk", "depth")


def ack_points(good: DataFrame, block: int | Column | None = None, limit_seconds: float | None = None) -> DataFrame:
    """State messages after which a batch is acknowledged: every k-th since the last FrameStart.

    With a limit, a frame that is still open when an event comes more than the limit after its FrameStart has timed out:
    count and batch size are cleared, so no message is acknowledged from that event to the next FrameStart.
    """
    block = _width(block, good)
    is_state, starts = F.col("process").isin(*STATE_KINDS), _is("FrameStart")
    every = F.when(starts, F.coalesce(part("chunks")["chunks_per_batch"], F.lit(0)))
    # without a limit only the messages that count are ordered, with one each event is a tick of the clock
    rows = good if limit_seconds is not None else good.filter(is_state | starts)
    counted = running(
        rows.select("scenario", "seq", "ts", "process", every.alias("k")),
        ["scenario"],
        "seq",
        {
            "_n": ("sum", F.when(is_state, F.lit(1)).otherwise(F.lit(0)).cast("long")),
            "_start": ("max", F.when(starts, F.struct("seq", "k", seconds(F.col("ts")).alias("at")))),
            "_end": ("max", F.when(_is("FrameEnd"), F.col("seq"))),
        },
        block=block,
        keep_block=True,
    )
    forward = {"_base": ("max", F.when(starts, F.col("_n")))}
    if limit_seconds is not None:
        is_open = F.col("_end").isNull() | (F.col("_end") < F.col("_start.seq"))
        over = seconds(F.col("ts")) - F.col("_start.at") > int(limit_seconds * 1_000_000)
        forward["_late"] = ("max", F.when(is_open & over, F.col("seq")))
    based = running(counted, ["scenario"], "seq", forward)
    if limit_seconds is not None:
        based = based.filter(F.col("_late").isNull() | (F.col("_late") < F.col("_start.seq")))
    size, n = F.col("_start.k"), F.col("_n") - F.col("_base")
    return based.filter(is_state & (size > 0) & (F.pmod(n, F.nullif(size, F.lit(0))) == 0)).select("scenario", "seq", n.alias("n"))


def reconcile_chunks(good: DataFrame, block: int | Column | None = None) -> DataFrame:
    """Announced against seen state messages, per FrameStart and per Init_EOF.

    A frame counts messages up to the next FrameStart or FrameEnd, an Init_EOF those since the
    Init_EOF before it. ``gap`` is announced minus seen.
    """
    block = _width(block, good)
    is_state = F.col("process").isin(*STATE_KINDS)
    eof = F.col("process") == "Init_EOF"
    s = F.col("seq")
    rows = good.filter(is_state | _is("FrameStart") | _is("FrameEnd") | eof).select(
        "scenario", "seq", "process",
        F.when(_is("FrameStart"), part("chunks")["total_chunks"]).alias("tc"), F.when(eof, part("chunks")["total_chunks_sent"]).alias("ts_"),
    )
    run = running(
        rows,
        ["scenario"],
        "seq",
        {"_ls": ("max", F.when(_is("FrameStart"), s)), "_le": ("max", F.when(_is("FrameEnd"), s))},
        {"_eof": ("min", F.when(eof, s))},
        block,
    )
    in_frame = F.col("_ls").isNotNull() & (F.col("_le").isNull() | (F.col("_ls") > F.col("_le")))
    tagged = run.select(
        "scenario",
        "process",
        "tc",
        "ts_",
        F.explode(
            F.array(
                F.struct(F.lit("frame").alias("kind"), F.when(in_frame & (is_state | _is("FrameStart")), F.col("_ls")).alias("at")),
                F.struct(F.lit("init").alias("kind"), F.when(is_state | eof, F.col("_eof")).alias("at")),
            )
        ).alias("g"),
    ).filter(F.col("g.at").isNotNull())
    said = F.when(F.col("g.kind") == "frame", F.col("tc")).otherwise(F.col("ts_"))
    out = tagged.groupBy("scenario", F.col("g.kind").alias("kind"), F.col("g.at").alias("at")).agg(
        F.max(said).alias("announced"), F.sum(is_state.cast("long")).alias("seen")
    )
    return out.withColumn("gap", F.col("announced") - F.col("seen"))


# The message that asks for each phase, in the only allowed order, and whether a
# request out of order is tolerated (the message repeats in normal use) or an error.
PHASES = [
    ("Handshake", "System_Ping", True),
    ("Initialising", "InitMap_Config", True),
    ("Running", "Init_EOF", False),
    ("Ended", "Sim_End", False),
]


def phase_audit(good: DataFrame, phases: list[tuple[str, str, bool]] = PHASES) -> DataFrame:
    """Phase requests that are not the next phase, with the phase in force at that point.

    Only the next phase is ever accepted and a refused request changes nothing, so the accepted
    requests are: the first for phase 1, the first for phase 2 after it, and so on. That is one
    small aggregation per phase; every other request is a violation.
    """
    kinds = [p for _, p, _ in phases]
    tolerated = [p for _, p, ok in phases if ok]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("process")).cast("int")
    asks = good.filter(F.col("process").isin(kinds)).select("scenario", "seq", "process", rank.alias("want"))
    reached = asks.select("scenario").distinct().withColumn("s0", F.lit(-1).cast("long"))
    for i in range(1, len(phases) + 1):
        got = (
            asks.filter(F.col("want") == i)
            .join(reached.select("scenario", f"s{i - 1}"), "scenario")
            .filter(F.col("seq") > F.col(f"s{i - 1}"))
            .groupBy("scenario")
            .agg(F.min("seq").alias(f"s{i}"))
        )
        reached = reached.join(got, "scenario", "left")
    names = F.array(F.lit("Disconnected"), *[F.lit(n) for n, _, _ in phases])
    seen = asks.join(reached, "scenario")
    now = sum((F.coalesce(F.col(f"s{i}") < F.col("seq"), F.lit(False)).cast("int") for i in range(1, len(phases) + 1)), F.lit(0))
    accepted = F.lit(False)
    for i in range(1, len(phases) + 1):
        accepted = accepted | F.coalesce(F.col(f"s{i}") == F.col("seq"), F.lit(False))
    return seen.filter(~accepted).select(
        "scenario",
        "seq",
        F.element_at(names, (now + 1).cast("int")).alias("phase"),
        F.element_at(names, F.col("want") + 1).alias("requested"),
        (~F.col("process").isin(tolerated)).alias("error"),
    )


def toggle_cells(deltas: DataFrame, cells: int) -> DataFrame:
    """Wet/dry state after flipping listed cells once per step; a step with a bad cell is rejected."""
    bad = deltas.filter((F.col("idx") < 0) | (F.col("idx") >= cells)).select("step").distinct()
    good = deltas.select("step", "idx").distinct().join(bad, "step", "left_anti")
    return good.groupBy("idx").agg((F.count(F.lit(1)) % 2).cast("int").alias("state"))


def file_palette(spark: SparkSession, path: str) -> DataFrame | None:
    """The list ``layers.flood_risk`` of a palette file as one row ``raw``, which is null if the file is broken; None without a file."""
    if not exists(spark, path):
        return None
    entry = "array<struct<value: string, label: string, hex: string, rgba: array<string>>>"
    read = F.from_json("value", f"struct<layers: struct<flood_risk: {entry}>>")
    return spark.read.text(path, wholetext=True).select(read["layers"]["flood_risk"].alias("raw"))


def resolve_palette(good: DataFrame, file_palette: DataFrame | None, default: list[tuple]) -> DataFrame:
    """Palette per scenario ``(scenario, origin, value, label, hex, r, g, b, a)``.

    The palette of the last message that has one wins over the file, which wins over the default;
    a malformed source is skipped as a whole.
    """
    entry = "array<struct<value:int,label:string,hex:string,rgba:array<int>>>"
    typed = lambda col: F.transform(
        col,
        lambda i: F.struct(
            i["value"].try_cast("int").alias("value"),
            F.coalesce(i["label"], F.lit("")).alias("label"),
            i["hex"].alias("hex"),
            F.transform(i["rgba"], lambda c: c.try_cast("int")).alias("rgba"),
        ),
    )
    fine = lambda col: (F.size(col) > 0) & F.forall(
        col,
        lambda i: i["value"].isNotNull()
        & i["hex"].isNotNull()
        & F.coalesce(F.size(i["rgba"]) > 0, F.lit(False))
        & F.forall(i["rgba"], lambda c: c.isNotNull()),
    )
    scenarios = good.select("scenario").distinct()
    message = (
        good.filter(F.col("process") == "InitAgent_Layer")
        .select("scenario", "seq", part("palette")["color_palette"].alias("raw"))
        .filter(F.col("raw").isNotNull())
        .groupBy("scenario")
        .agg(F.max_by("raw", "seq").alias("raw"))
        .select("scenario", F.lit(0).alias("rank"), F.lit("message").alias("origin"), typed(F.col("raw")).alias("p"))
    )
    base = F.array(
        *[
            F.struct(
                F.lit(v).alias("value"), F.lit(n).alias("label"), F.lit(h).alias("hex"),
                F.array(F.lit(r), F.lit(g), F.lit(b), F.lit(a)).alias("rgba"),
            )
            for v, n, h, r, g, b, a in default
        ]
    )
    sources = message.unionByName(
        scenarios.select("scenario", F.lit(2).alias("rank"), F.lit("default").alias("origin"), base.cast(entry).alias("p"))
    )
    if file_palette is not None:
        one = file_palette.select(typed(F.col("raw")).alias("p")).agg(F.first("p").alias("p")).scalar()
        sources = sources.unionByName(
            scenarios.select("scenario", F.lit(1).alias("rank"), F.lit("file").alias("origin"), one.cast(entry).alias("p"))
        )
    best = sources.filter(fine(F.col("p"))).groupBy("scenario").agg(F.min_by(F.struct("origin", "p"), "rank").alias("b"))
    return best.select("scenario", F.col("b.origin").alias("origin"), F.inline("b.p")).select(
        "scenario", "origin", "value", "label", "hex",
        *[F.get("rgba", i).alias(n) for i, n in enumerate("rgba")],
    )


def pair_ping_pong(good: DataFrame, wait_seconds: int = K.PING_WAIT_SECONDS, block: int | Column | None = None) -> DataFrame:
    """Each ping with its first pong at or after it within the wait, else unanswered (null)."""
    block = _width(block, good)
    pings = good.filter(F.col("process").isin("System_Ping", "System_Pong")).select("scenario", "seq", "ts", "process")
    pong = F.col("process") == "System_Pong"
    run = running(pings, ["scenario"], "seq", backward={"_p": ("min", F.when(pong, F.struct("seq", "ts")))}, block=block)
    near = (seconds(F.col("_p.ts")) - seconds(F.col("ts"))) <= wait_seconds * 1_000_000
    return run.filter(~pong).select(
        "scenario", "seq", F.when(near, F.col("_p.seq")).alias("pong_seq"),
        F.coalesce(near, F.lit(False)).alias("answered"),
    )


def _layer_messages(good: DataFrame) -> DataFrame:
    return good.filter(F.col("process") == "InitAgent_Layer").select("scenario", "seq", part("layer").alias("p")).select(
        "scenario", "seq", F.col("p.id").alias("layer"), "p.data_path", "p.data_filename"
    )


def _complete() -> Column:
    full = F.lit(True)
    for c in ("layer", "data_path", "data_filename"):
        full = full & (F.coalesce(F.length(c), F.lit(0)) > 0)
    return full


def layer_requests(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest layer message per (scenario, layer) and the rejected ones that miss a field."""
    ask, full = _layer_messages(good), _complete()
    ok = ask.filter(full).groupBy("scenario", "layer").agg(
        F.max_by(F.struct("data_path", "data_filename"), "seq").alias("f"), F.max("seq").alias("seq")
    )
    return ok.select("scenario", "layer", "seq", "f.data_path", "f.data_filename"), ask.filter(~full)
