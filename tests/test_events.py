"""Event folding against a plain consumer that handles one message after the other."""

import json
import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import pytest

from gridloom.operators import events as ev
from gridloom.functions import store
from gridloom.functions.running import even_width, with_blocks
from gridloom.streaming.fold import FrameFold, committed_frames, current_grid, manifest, run_fold
from gridloom.streaming.pingpong import STATE_STORE, ping_pong_stream

ROWS, COLS, LIMIT = 4, 5, 50
T0 = datetime(2024, 1, 1)


def cell(idx, risk, depth):
    return {"process": "EYE_SetState_Layer", "changes": {"cells": {str(idx): {"state": risk, "height": depth}}}}


def make_log(seed, n=160, scenarios=("hot", "hot", "hot", "cold")):
    rnd = random.Random(seed)
    rows, t = [], {s: T0 for s in scenarios}
    for seq in range(n):
        s = rnd.choice(scenarios)
        t[s] += timedelta(seconds=rnd.choice([1, 5, 40]))
        msg = rnd.choices(
            [
                cell(rnd.randint(0, ROWS * COLS - 1), rnd.randint(0, 5), rnd.randint(0, 30) / 10),
                {"process": "EYE_SetState", "changes": {"coord": {"x": rnd.randint(-1, COLS), "y": rnd.randint(0, ROWS)}, "value": rnd.randint(0, 5)}},
                {"process": "FrameStart", "total_chunks": 2, "chunks_per_batch": rnd.randint(0, 3)},
                {"process": "FrameEnd"},
                {"process": "EYE_Frame_Sync"},
                {"process": "Init_EOF", "total_chunks_sent": 1},
                None,
            ],
            [8, 2, 3, 3, 2, 0.5, 0.5],
        )[0]
        rows.append((s, seq, t[s], json.dumps(msg) if msg else "{bad"))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "scenario string, seq long, ts timestamp, json string").repartition(7)


def consume(rows, file_mode=False, limit=None):
    """Returns committed changes, snapshots and acknowledgement points of a one-by-one consumer."""
    committed, snaps, acks = [], [], []
    for scen in {r[0] for r in rows}:
        pending, start, init, fresh, step, k, since, count = [], None, False, False, 0, 0, 0, 0
        for _, seq, ts, text in sorted((r for r in rows if r[0] == scen), key=lambda r: r[1]):
            try:
                e = json.loads(text)
            except ValueError:
                continue
            p = e["process"]
            # The timer looks at the clock before a message is handled, but not before a FrameEnd.
            if limit is not None and start is not None and p not in ("FrameEnd", "FrameStart") and (ts - start).total_seconds() > limit:
                pending, start = [], None
            if p == "FrameStart":
                pending, start, k, since, count = [], ts, e["chunks_per_batch"], 0, 0
            elif p == "FrameEnd":
                committed += [(scen, seq, s, i, r, d) for s, i, r, d in pending]
                fresh |= bool(pending)
                pending, start = [], None
            elif p in ev.STATE_KINDS:
                if file_mode and not init:
                    continue
                if p == "EYE_SetState":
                    x, y = e["changes"]["coord"]["x"], e["changes"]["coord"]["y"]
                    if 0 <= x < COLS and 0 <= y < ROWS:
                        pending.append((seq, y * COLS + x, e["changes"]["value"], None))
                else:
                    for key, c in e["changes"]["cells"].items():
                        pending.append((seq, int(key), c["state"], c["height"]))
                if k > 0:
                    since, count = since + 1, count + 1
                    if since == k:
                        acks.append((scen, seq, count))
                        since = 0
            elif p == "Init_EOF":
                init, fresh = True, False
                snaps.append((scen, step, seq))
                step += 1
            elif p == "EYE_Frame_Sync" and init and fresh:
                snaps.append((scen, step, seq))
                step, fresh = step + 1, False
    return sorted(committed, key=str), sorted(snaps), sorted(acks)


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


CHANGE = ("scenario", "frame_end", "seq", "idx", "risk", "depth")


def test_frames_snapshots_and_acks_match_the_consumer(spark):
    for seed in (1, 2):
        rows = make_log(seed)
        good, dead = ev.decode(frame_of(spark, rows))
        made = ev.assemble_frames(good, ROWS, COLS, block=11)
        committed, snaps, acks = consume(rows)
        assert tuples(made, *CHANGE) == committed
        assert sorted(map(tuple, ev.snapshots_at_sync(good, made, 11).select("scenario", "snap", "seq").collect())) == snaps
        assert sorted(map(tuple, ev.ack_points(good, 11).select("scenario", "seq", "n").collect())) == acks
        assert dead.count() == sum(r[3] == "{bad" for r in rows)


def test_timeouts_and_gate_match_the_consumer(spark):
    for seed in (3, 4):
        rows = make_log(seed)
        good, _ = ev.decode(frame_of(spark, rows))
        got = ev.assemble_frames(good, ROWS, COLS, LIMIT, file_mode=True, block=7)
        assert tuples(got, *CHANGE) == consume(rows, True, LIMIT)[0]


def test_two_chunks_make_one_frame(spark):
    msgs = [{"process": "Init_EOF"}, {"process": "FrameStart"},
            {"process": "EYE_SetState_Layer", "changes": {"cells": {"0": {"state": "FLOODED"}, "bad": {"state": 1}}}},
            {"process": "EYE_SetState_Layer", "changes": {"cells": {"6": {"state": "HIGH_DEPTH"}, "999": {"state": 2}}}}, {"process": "FrameEnd"}]
    rows = [("s", i, T0, json.dumps(m)) for i, m in enumerate(msgs)]
    made = ev.assemble_frames(ev.decode(frame_of(spark, rows))[0], 5, 5)
    assert tuples(made, "row", "col", "risk") == [(0, 0, 3), (1, 1, 4)]


def test_state_resolution(spark):
    cases = [({"value": 2.7}, 2), ({"level": "4"}, 4), ({"state": "flooded"}, 3), ({"state": "nothing known"}, 1), ({}, 1),
             ({"depth_level": "x", "risk_level": 5}, 5), ({"state": 0}, 0), ({"state": "OPEN"}, 0), ({"value": None, "level": 3}, 3),
             ({"value": "NaN", "level": "1d", "state": "Infinity"}, 1), ({"value": 1e300, "level": 2}, 2), ({"value": -1}, -1)]
    rows = [("s", i, T0, json.dumps({"process": "EYE_SetState_Layer", "changes": {"cells": {"1": c}}})) for i, (c, _) in enumerate(cases)]
    got = dict(ev.explode_cells(ev.decode(frame_of(spark, rows))[0]).select("seq", "risk").collect())
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def write_files(rows, folder, files):
    folder.mkdir(parents=True)
    size, now = -(-len(rows) // files), time.time()
    for i in range(files):
        with open(folder / f"part-{i:03d}.txt", "w") as fh:
            for s, seq, ts, text in rows[i * size:(i + 1) * size]:
                fh.write(json.dumps({"scenario": s, "seq": seq, "ts": ts.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "json": text}) + "\n")
        os.utime(folder / f"part-{i:03d}.txt", (now - 1000 + i, now - 1000 + i))


def run_stream(spark, tmp_path, rows, files, **kw):
    from gridloom.sources.eventlog import read_event_log

    root = tmp_path / f"n{files}"
    write_files(rows, root / "in", files)
    fold = FrameFold(str(root / "out"), ROWS, COLS, compact_every=2, **kw)
    q = run_fold(read_event_log(spark, str(root / "in"), True, 1), fold, str(root / "ck"))
    assert q.awaitTermination(300)
    return committed_frames(spark, fold.path), current_grid(spark, fold.path), fold, q.lastProgress["batchId"]


def test_stream_equals_batch_for_any_number_of_files(spark, tmp_path):
    rows = make_log(5, 120)
    good, _ = ev.decode(frame_of(spark, rows))
    batch = ev.assemble_frames(good, ROWS, COLS, LIMIT, file_mode=True)
    want = tuples(batch, *CHANGE)
    grid = {}
    for scen, end, seq, idx, risk, depth in sorted(want, key=lambda c: (c[0], c[1], c[2])):
        grid[scen, idx] = (risk, depth if depth is not None else grid.get((scen, idx), (0, None))[1])
    for files in (1, 3, 7):
        frames, current, fold, last = run_stream(spark, tmp_path, rows, files, limit_seconds=LIMIT, file_mode=True)
        assert tuples(frames, *CHANGE) == want
        assert {(r.scenario, r.idx): (r.risk, r.depth) for r in current.collect()} == grid
    # Running the last batch again changes nothing.
    again = spark.read.text(str(tmp_path / "n7" / "in" / "part-006.txt")).select(F.from_json("value", "scenario string, seq long, ts timestamp, json string").alias("v")).select("v.*")
    fold(again, last)
    assert tuples(committed_frames(spark, fold.path), *CHANGE) == want
    # Only what the last two manifests name is kept.
    kept = [manifest(spark, fold.path, i) for i in (last - 1, last)]
    named = {m[k] for m in kept for k in ("marks", "tail")} | {x for m in kept for x in (m["base"]["tiles"], *m["base"]["parts"])}
    assert {f"{k}/{n}" for k in ("marks", "tail", "base", "tiles") for n in store.names(spark, f"{fold.path}/{k}")} == named
    assert sorted(store.names(spark, f"{fold.path}/manifest")) == [f"{i}.json" for i in (last - 1, last)]


def batches_of(spark, rows, size):
    return [frame_of(spark, rows[i : i + size]) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("kind", ["marks", "tail", "manifest"])
def test_lost_state_is_an_error(spark, tmp_path, kind):
    fold = FrameFold(str(tmp_path), ROWS, COLS)
    first, second, *_ = batches_of(spark, make_log(9, 30), 20)
    fold(first, 0)
    store.remove(spark, f"{tmp_path}/" + ("manifest/0.json" if kind == "manifest" else manifest(spark, str(tmp_path), 0)[kind]))
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        fold(second, 1)


def test_failed_and_repeated_batches_change_nothing(spark, tmp_path):
    """A batch that stops before its manifest leaves no trace; rows that repeat within and across batches count once."""
    rows = make_log(10, 60)
    want = tuples(ev.assemble_frames(ev.decode(frame_of(spark, rows))[0], ROWS, COLS), *CHANGE)
    fold = FrameFold(str(tmp_path), ROWS, COLS, compact_every=1, tile=4)
    size = 40
    for i, lo in enumerate(range(0, len(rows), size)):
        again = rows[max(0, lo - 5) : lo + size] + rows[lo : lo + 7]
        batch = frame_of(spark, again)
        if i == 1:
            broken = FrameFold(str(tmp_path), ROWS, COLS)
            broken._carry = lambda *a: 1 / 0
            with pytest.raises(ZeroDivisionError):
                broken(batch, i)
            assert manifest(spark, str(tmp_path))["batch"] == 0
        fold(batch, i)
        fold(batch, i)
    assert tuples(committed_frames(spark, str(tmp_path)), *CHANGE) == want
    grid = {}
    for scen, end, seq, idx, risk, depth in sorted(want, key=lambda c: (c[0], c[1], c[2])):
        grid[scen, idx] = (risk, depth if depth is not None else grid.get((scen, idx), (0, None))[1])
    assert {(r.scenario, r.idx): (r.risk, r.depth) for r in current_grid(spark, str(tmp_path)).collect()} == grid


def test_stream_waits_for_missing_numbers(spark, tmp_path):
    rows = make_log(6, 60, scenarios=("one",))
    mixed = rows[:20] + rows[30:40] + rows[20:30] + rows[40:]
    frames, _, _, _ = run_stream(spark, tmp_path, mixed, 6, dense_from=0)
    good, _ = ev.decode(frame_of(spark, rows))
    assert tuples(frames, *CHANGE) == tuples(ev.assemble_frames(good, ROWS, COLS), *CHANGE)


@pytest.mark.parametrize("files", [1, 4])
def test_ping_pong_stream_equals_batch(spark, tmp_path, files):
    rnd = random.Random(7)
    rows, t = [], T0
    for i in range(80):
        t += timedelta(seconds=rnd.choice([2, 6, 15]))
        rows.append((rnd.choice("st"), i, t, json.dumps({"process": rnd.choice(["System_Ping", "System_Ping", "System_Pong"])})))
    # A late event pushes the watermark past every wait; nothing answers the last pings.
    rows.append(("u", 100, t + timedelta(hours=1), json.dumps({"process": "System_Ping"})))
    batch = ev.pair_ping_pong(ev.decode(frame_of(spark, rows))[0], 10, 8).filter("seq < 100")
    write_files(rows, tmp_path / "in", files)
    from gridloom.sources.eventlog import read_event_log

    got, state = pairs_of_stream(spark, read_event_log(spark, str(tmp_path / "in"), True, 1), tmp_path)
    assert tuples(got.filter("seq < 100"), "scenario", "seq", "pong_seq", "answered") == tuples(batch, "scenario", "seq", "pong_seq", "answered")
    assert state == 1  # the ping of the late event; all others are forgotten


def pairs_of_stream(spark, events, path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        pairs = ping_pong_stream(events, 10, "0 seconds")
        q = pairs.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        left = spark.read.format("statestore").option("stateVarName", "pings").load(str(path / "ck")).count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(str(path / "out")), left


def test_decode_sink_keeps_every_row(spark, tmp_path):
    from gridloom.streaming.fold import decode_sink

    rows = make_log(8, 80)
    sink = decode_sink(str(tmp_path))
    for _ in range(2):
        sink(frame_of(spark, rows), 0)
    bad = sum(r[3] == "{bad" for r in rows)
    assert spark.read.parquet(str(tmp_path / "dead" / "batch=0")).count() == bad
    assert spark.read.parquet(str(tmp_path / "good" / "batch=0")).count() == len(rows) - bad


def test_file_palette_wins_over_the_default_and_a_bad_message_is_skipped(spark):
    good_entry = {"value": "1", "label": "x", "hex": "#111111", "rgba": [1, 2, 3, 4]}
    rows = [("a", 0, T0, json.dumps({"process": "InitAgent_Layer", "color_palette": [{"value": 0}]})), ("b", 0, T0, json.dumps({"process": "Sim_End"})),
            ("c", 0, T0, json.dumps({"process": "InitAgent_Layer", "color_palette": [{**good_entry, "value": 7}]}))]
    raw = spark.createDataFrame([([("1", "x", "#111111", ["1", "2", "3", "4"])],)], "raw array<struct<value: string, label: string, hex: string, rgba: array<string>>>")
    from gridloom import constants as K

    got = ev.resolve_palette(ev.decode(frame_of(spark, rows))[0], raw, K.PALETTE)
    assert tuples(got, "scenario", "origin", "value") == [("a", "file", 1), ("b", "file", 1), ("c", "message", 7)]


def acks(rows, limit):
    """A plain consumer: scenario by scenario, message after message, the clock is the message's time."""
    out = []
    for scen in {r[0] for r in rows}:
        size = count = 0
        start = None
        for _, seq, ts, text in sorted((r for r in rows if r[0] == scen), key=lambda r: r[1]):
            try:
                event = json.loads(text)
                kind = event["process"]
            except (ValueError, KeyError, TypeError):
                continue
            if limit is not None and start is not None and kind not in ("FrameStart", "FrameEnd") and (ts - start).total_seconds() > limit:
                start, size, count = None, 0, 0
            if kind == "FrameStart":
                size, count, start = event.get("chunks_per_batch") or 0, 0, ts
            elif kind == "FrameEnd":
                start = None
            elif kind.startswith("EYE_SetState"):
                count += 1
                if size > 0 and count % size == 0:
                    out.append((scen, seq, count))
    return sorted(out)


def timed_log(seed, n, step=1):
    rnd = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += timedelta(seconds=rnd.choice([1, 4, 30]))
        kind = rnd.choices(["FrameStart", "FrameEnd", "EYE_SetState_Layer", "EYE_SetState", "Init_EOF"], [2, 1, 8, 2, 1])[0]
        rows.append((rnd.choice("ab"), i * step + 7, t, json.dumps({"process": kind, "chunks_per_batch": rnd.choice([0, 1, 2, 3])})))
    return rows


@pytest.mark.parametrize("limit", [None, 20, 60])
@pytest.mark.parametrize("block", [4, None])
def test_acks_stop_with_a_timeout(spark, limit, block):
    rows = timed_log(3, 300)
    got = ev.ack_points(ev.decode(frame_of(spark, rows))[0], block, limit)
    assert sorted(tuples(got, "scenario", "seq", "n")) == acks(rows, limit)


def test_sparse_numbers_make_no_more_blocks(spark):
    """Numbers in microseconds give the result of consecutive ones, and blocks by the rows there are."""
    rows, step = make_log(4, 120), 3_600_000_000
    sparse = [(s, 1_700_000_000_000_000 + seq * step, ts, text) for s, seq, ts, text in rows]
    back = lambda c: (F.col(c) - 1_700_000_000_000_000) / step
    dense, far = (ev.decode(frame_of(spark, r))[0] for r in (rows, sparse))
    want = ev.assemble_frames(dense, ROWS, COLS, LIMIT)
    got = ev.assemble_frames(far, ROWS, COLS, LIMIT)
    got = got.withColumns({"seq": back("seq").cast("long"), "frame_end": back("frame_end").cast("long")})
    assert tuples(got, *CHANGE) == tuples(want, *CHANGE)
    n = far.count()
    width = far.select(even_width(far, "seq", 10).alias("w")).first().w
    blocks = with_blocks(far, "seq", F.lit(width)).groupBy("scenario", "_block").count()
    assert blocks.count() <= 2 * (n // 10 + 2)
    spread = ev.frame_segments(far, LIMIT, block=even_width(far, "seq", 10))
    bins = spread.select(F.sum((F.col("frame_end") - F.col("lo")) / width + 2).alias("b")).first().b
    assert bins <= 3 * spread.count() + 2 * n / 10 + 10


def test_a_loaded_layer_is_new_data(spark):
    """A complete layer message after Init_EOF lets the next sync show a snapshot; the terrain and broken ones do not."""
    layer = lambda name, **kw: {"process": "InitAgent_Layer", "id": name, "data_path": "p", "data_filename": "f", **kw}
    sync = {"process": "EYE_Frame_Sync"}
    kinds = [layer("flood_risk"), {"process": "Init_EOF"}, sync, layer("topo_bathy"), sync, layer("flood_risk", data_path=""), sync, layer("flood_risk"), sync, sync, layer("water_depth"), sync]
    good, _ = ev.decode(frame_of(spark, [("s", i, T0, json.dumps(k)) for i, k in enumerate(kinds)]))
    snaps = ev.snapshots_at_sync(good, ev.assemble_frames(good, ROWS, COLS), 4)
    assert sorted((r.snap, r.seq) for r in snaps.collect()) == [(0, 1), (1, 8), (2, 11)]


def test_grids_of_asked_snapshots(spark):
    good, _ = ev.decode(frame_of(spark, make_log(12, 150)))
    made = ev.assemble_frames(good, ROWS, COLS)
    snaps, done = ev.snapshots_at_sync(good, made), ev.commit_changes(made)
    ranges = ev.grid_ranges(snaps, done)
    assert ranges.count() <= done.count()
    every = ev.grid_at(snaps, done)
    asked = snaps.filter("snap % 3 = 1").select("scenario", "snap")
    names = ("scenario", "snap", "idx", "risk", "depth")
    assert tuples(ev.grid_of(ranges, asked), *names) == tuples(every.join(asked, ["scenario", "snap"]), *names)


def test_expanded_grids_make_small_files(spark, tmp_path):
    """cells came one after the other over all snapshots, whose numbers took most of the file."""
    snaps = spark.range(2000).selectExpr("'s' as scenario", "id * 10 + 5 as seq", "id as snap")
    done = spark.range(600).selectExpr("'s' as scenario", "(id % 7) * 2840 as frame_end", "id % 300 as idx", "cast(id % 5 as int) as risk", "id / 8 as depth")
    rows = ev.grid_at(snaps, done)
    rows.write.parquet(str(tmp_path / "grid"))
    got = spark.read.parquet(str(tmp_path / "grid"))
    shown = done.join(snaps, "scenario").filter("frame_end <= seq").groupBy("snap", "idx").agg(F.max_by("risk", "frame_end").alias("risk"), F.max_by("depth", "frame_end").alias("depth"))
    names = ["snap", "idx", "risk", "depth"]
    assert got.select(names).exceptAll(shown.select(names)).isEmpty() and shown.select(names).exceptAll(got.select(names)).isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "grid").glob("*.parquet")) < got.count() / 2


def test_palette_files(spark, tmp_path):
    from gridloom import constants as K

    good, _ = ev.decode(frame_of(spark, [("a", 0, T0, json.dumps({"process": "Sim_End"}))]))
    origin = lambda text: (tmp_path / "p.json").write_text(text) and {r.origin for r in ev.resolve_palette(good, ev.file_palette(spark, str(tmp_path / "p.json")), K.PALETTE).collect()}
    entry = {"value": 3, "label": "x", "hex": "#010203", "rgba": [1, 2, 3, 4]}
    assert origin(json.dumps({"layers": {"flood_risk": [entry]}}, indent=2)) == {"file"}
    assert origin(json.dumps({"layers": {"flood_risk": [{**entry, "hex": None}]}})) == {"default"}
    assert origin(json.dumps({"layers": {}})) == {"default"} and origin("{broken") == {"default"}
    assert ev.file_palette(spark, str(tmp_path / "none.json")) is None


def test_an_arrival_is_written_by_several_tasks_and_is_one_batch(spark):
    """the messages of an arrival went through one task."""
    from types import SimpleNamespace

    from gridloom.gridspec import GridSpec
    from gridloom.plans.event_queries import _stream

    cell = '{"process":"EYE_SetState_Layer","changes":{"cells":{"%d":{"state":2,"height":0.5}}}}'
    text = lambda i: '{"process":"Init_EOF"}' if i == 0 else '{"process":"FrameStart"}' if i % 5 == 1 else '{"process":"FrameEnd"}' if i % 5 == 0 else cell % (i % 7)
    rows = [("s", i, datetime(2024, 1, 1, 0, 0, i), text(i)) for i in range(60)]
    msgs = spark.createDataFrame(rows, "scenario string, seq bigint, ts timestamp, json string").repartition(4)
    out = _stream(SimpleNamespace(spark=spark, msgs=msgs, spec=GridSpec(3, 3, 1.0, 0.0, 3.0)), 3)
    files = [n for n in store.names(spark, out[: -len("/out")] + "/in") if n.startswith("part-")]
    assert len(files) > 3 and manifest(spark, out)["batch"] == 2
    assert {r.idx: r.frame_end for r in current_grid(spark, out).collect()} == {i: max(-(-k // 5) * 5 for k in range(2, 55) if k % 5 > 1 and k % 7 == i) for i in range(7)}
