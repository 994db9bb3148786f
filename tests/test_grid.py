"""Layer, focal, region and interpolation operators on small grids."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import GridSpec
from gridloom import constants as K
from gridloom.functions import cells as cx
from gridloom.functions import geodesy as gd
from gridloom.operators import focal, frames, gauges, interpolate, layers, polygons, regions, tiles


def table(spark, **layers_):
    shape = next(iter(layers_.values())).shape
    rows = [(r, c, *(float(a[r, c]) for a in layers_.values())) for r in range(shape[0]) for c in range(shape[1])]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{n} double" for n in layers_))


def array(df, value, shape):
    out = np.zeros(shape)
    for r in df.select("row", "col", value).collect():
        out[r[0], r[1]] = r[2]
    return out


def step(spark, elev, depth, moving=None, dt=0.01, dx=1.0):
    moving = (depth > 0).astype(float) if moving is None else moving
    t = table(spark, height=elev, depth=depth, roughness=np.full(elev.shape, 0.05), moving=moving)
    return focal.route_once(t, GridSpec(*elev.shape, dx, 0.0, 0.0), dx, dt, 1000.0, 0.001)


def test_lake_at_rest_stays(spark):
    depth = np.full((12, 12), 2.0)
    elev = np.zeros((12, 12))
    for edge in (np.s_[0, :], np.s_[-1, :], np.s_[:, 0], np.s_[:, -1]):
        elev[edge], depth[edge] = 3.0, 0.0
    assert np.abs(array(step(spark, elev, depth), "depth", elev.shape) - depth).max() < 1e-4


def test_mass_symmetry_and_dry(spark):
    elev, depth = np.zeros((11, 11)), np.zeros((11, 11))
    depth[5, 5] = 0.2
    after = step(spark, elev, depth)
    moved = array(after, "moving", elev.shape)
    once = array(after, "depth", elev.shape)
    assert abs(once.sum() - depth.sum()) <= 0.005 * depth.sum()
    twice = array(step(spark, elev, once, moved), "depth", elev.shape)
    assert np.allclose(twice, twice[::-1]) and np.allclose(twice, twice.T)
    assert frames.mirror_check(table(spark, depth=twice), GridSpec(11, 11, 1.0, 0, 0), "depth").count() == 0
    dry = array(step(spark, elev + 1.0, np.zeros((11, 11))), "depth", elev.shape)
    assert dry.max() < 1e-6


def test_grow_region_matches_flood_fill(spark):
    rnd = random.Random(4)
    rows, cols = 150, 140
    grid = np.array([[0 if rnd.random() < 0.45 else 9 for _ in range(cols)] for _ in range(rows)])
    for _ in range(6):
        grid[rnd.randrange(rows), rnd.randrange(cols)] = 54
    want, todo = grid.copy(), list(zip(*np.where(grid == 54)))
    while todo:
        r, c = todo.pop()
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                y, x = r + dr, c + dc
                if 0 <= y < rows and 0 <= x < cols and want[y, x] == 0:
                    want[y, x] = 54
                    todo.append((y, x))
    got = regions.grow_region(table(spark, land_cover=grid).withColumn("land_cover", F.col("land_cover").cast("int")), cols, 54, [0])
    assert (array(got, "land_cover", grid.shape) == want).all()


def test_grow_region_needs_few_rounds_for_a_long_way(spark, monkeypatch):
    monkeypatch.setattr(regions, "TILE", 2)
    rows, written, write = 160, [], regions.cut
    monkeypatch.setattr(regions, "cut", lambda df, label="cut": (written.append(label), write(df, label))[1])
    way = np.zeros((rows, 6))
    way[:, 0] = way[:, 5] = way[-1, :] = 1.0
    way[0, 5] = 9.0
    got = array(regions.grow_region(table(spark, land_cover=way), 6, 9, [1]), "land_cover", way.shape)
    assert (got == np.where(way > 0, 9.0, 0.0)).all()
    assert written.count("round") <= 20


def test_pixels_are_made_in_many_tasks(spark):
    cover = spark.createDataFrame([(9, x, y) for x in range(250, 256) for y in range(190, 194)], "z int, x int, y int").coalesce(1)
    pixels = tiles.pixel_points(cover, 25830, 4)
    assert pixels.count() == 24 * 16
    assert pixels.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_rasterize_with_a_hole(spark):
    pts = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [(1, 1, 7, [pts((0, 0), (8, 0), (8, 8), (0, 8)), pts((2.2, 2.2), (5.2, 2.2), (5.2, 5.2), (2.2, 5.2))]), (2, 2, 9, [pts((6, 6), (9.9, 6), (9.9, 9.9))])]
    df = spark.createDataFrame(rows, "feature_id int, ord int, class int, rings array<array<struct<x: double, y: double>>>")
    got = array(polygons.rasterize(df, GridSpec(10, 10, 1.0, 0.0, 10.0)), "class", (10, 10))
    for r in range(10):
        for c in range(10):
            x, y = c + 0.5, 9.5 - r
            want = 7 if x < 8 and y < 8 and not (2.2 < x < 5.2 and 2.2 < y < 5.2) else 0
            if 6 < x < 9.9 and 6 < y and y - 6 <= x - 6 - 1e-9:
                want = 9
            if abs((y - 6) - (x - 6)) > 1e-6:
                assert got[r, c] == want


def test_kriging_is_exact_and_keeps_constants(spark):
    spec = GridSpec(20, 30, 100.0, 0.0, 2000.0)
    rnd = random.Random(3)
    cells = rnd.sample([(r, c) for r in range(20) for c in range(30)], 25)
    pts = [(s, (c + 0.5) * 100, 2000 - (r + 0.5) * 100, 4.0 if s == 0 else rnd.random()) for s in (0, 1) for r, c in cells]
    points = spark.createDataFrame(pts, "step int, x double, y double, value double")
    models = spark.createDataFrame([(0, "spherical", 0.0, 1.0, 900.0), (1, "exponential", 0.0, 2.0, 700.0)], "step int, model string, nugget double, sill double, reach double")
    out = interpolate.krige_cells(points, models, spec)
    flat = out.filter("step = 0").agg(F.min("value"), F.max("value")).first()
    assert flat[0] == pytest.approx(4.0, abs=1e-6) and flat[1] == pytest.approx(4.0, abs=1e-6)
    at = {(r.row, r.col): (r.value, r.variance) for r in out.filter("step = 1").collect()}
    assert len(at) == 600
    for (r, c), p in zip(cells, pts[25:]):
        assert at[r, c][0] == pytest.approx(p[3], abs=1e-6) and at[r, c][1] == pytest.approx(0.0, abs=1e-6)


def test_rainfall_layer_has_a_frame_for_every_step(spark):
    spec = GridSpec(6, 5, 100.0, 0.0, 600.0)
    t = lambda d: f"timestamp_ntz'2024-01-0{d} 00:00:00'"
    row = lambda x, y, v, d: f"({x}d, {y}d, {v}d, {t(d)}, {t(d + 1)})"
    rows = [row(130, 220, 5, 1), row(470, 510, 1, 1), row(10, 30, 5.5, 1), row(130, 220, 4, 2), row(5000, 220, 4, 3), row(90, 90, 2, 3), row(400, 90, 6, 3)]
    readings = spark.sql(f"select * from values {', '.join(rows)} as r(x, y, value, start_ts, end_ts)")
    steps = spark.sql(f"select * from values {', '.join(f'({d - 1}, {t(d)}, {t(d + 1)})' for d in (1, 2, 3, 4))} as s(step, s0, s1)")
    out = interpolate.rainfall_layer(readings, steps, spec, [0.0, 300.0, 600.0], [400.0], least_points=2)
    got = {r["step"]: r for r in out.groupBy("step").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(r["n"] == 30 for r in got.values())
    assert got[1]["hi"] == 0 and got[3]["hi"] == 0
    assert got[0]["lo"] >= 0 and got[0]["hi"] > got[0]["lo"] and got[2]["lo"] > 0


def test_kriging_without_a_model_is_the_mean_and_weights_equal_the_inverse(spark):
    spec = GridSpec(4, 4, 100.0, 0.0, 400.0)
    points = spark.createDataFrame([(0, 33.0, 20.0, -3.0), (1, 10.0, 10.0, 2.0), (1, 350.0, 390.0, 4.0), (1, 350.0, 390.0, 6.0), (1, 200.0, 900.0, 1.0)], "step int, x double, y double, value double")
    models = spark.createDataFrame([(1, "spherical", 0.1, 1.0, 900.0)], "step int, model string, nugget double, sill double, reach double")
    full = {(r["step"], r["row"], r["col"]): r["value"] for r in interpolate.krige_cells(points, models, spec, least=None).collect()}
    thin = {(r["step"], r["row"], r["col"]): r["value"] for r in interpolate.krige_cells(points, models, spec, variance=False, least=None).collect()}
    assert len(full) == 32 and full.keys() == thin.keys()
    assert all(v == pytest.approx(thin[k], abs=1e-6) for k, v in full.items())
    assert all(v == pytest.approx(-3.0) for (s, _, _), v in full.items() if s == 0)


def dense(gauges, at, law):
    """Values and variances of ordinary kriging from one full system."""
    x, y, z = np.array(gauges).T
    n = len(x)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = interpolate._gamma(np.hypot(x[:, None] - x, y[:, None] - y), *law)
    a[n, n] = 0
    rhs = np.ones((len(at), n + 1))
    rhs[:, :n] = interpolate._gamma(np.hypot(at[:, :1] - x, at[:, 1:] - y), *law)
    w = np.linalg.solve(a, rhs.T).T
    return w[:, :n] @ z, (w * rhs).sum(1)


def scattered(seed, n, side):
    rnd = np.random.default_rng(seed)
    xy = np.concatenate([rnd.random((n - n // 3, 2)) * side, rnd.normal(side / 5, side / 40, (n // 3, 2))])
    return [(float(a), float(b), float(v)) for (a, b), v in zip(xy, rnd.random(n) * 9)]


LAW = ("spherical", 0.2, 3.0, 4000.0)


def test_kriging_equals_one_full_system(spark):
    spec = GridSpec(140, 150, 100.0, 0.0, 14000.0)
    gauges = scattered(1, 500, 15000)
    points = spark.createDataFrame([(5, *g) for g in gauges], "step int, x double, y double, value double")
    models = spark.createDataFrame([(5, *LAW)], "step int, model string, nugget double, sill double, reach double")
    rows = interpolate.krige_cells(points, models, spec, least=None).collect()
    assert len(rows) == 140 * 150
    rows = [r for r in rows if (r["row"] + 3 * r["col"]) % 23 == 0]
    at = np.array([((r["col"] + 0.5) * 100, 14000 - (r["row"] + 0.5) * 100) for r in rows])
    value, variance = dense(gauges, at, LAW)
    assert np.abs(np.array([r["value"] for r in rows]) - value).max() < 1e-8
    assert np.abs(np.array([r["variance"] for r in rows]) - variance).max() < 1e-8


def test_kriging_by_neighbourhoods(spark):
    """Each tile from the gauges of its neighbourhood, found here by counting all squares of all levels."""
    spec = GridSpec(40, 50, 100.0, 0.0, 4000.0)
    gauges, most = scattered(2, 400, 9000), 30
    points = spark.createDataFrame([(s, *g) for s in (1, 2) for g in (gauges if s == 1 else gauges[:20])], "step int, x double, y double, value double")
    models = spark.createDataFrame([(s, *LAW) for s in (1, 2)], "step int, model string, nugget double, sill double, reach double")
    out = {(r["step"], r["row"], r["col"]): r["value"] for r in interpolate.krige_cells(points, models, spec, variance=False, least=None, most=most).collect()}
    assert len(out) == 2 * 40 * 50
    for r0 in range(0, 40, 16):
        for c0 in range(0, 50, 16):
            mx, my = (c0 + 8) * 100.0, 4000 - (r0 + 8) * 100.0
            for level in range(20):
                side = 1600.0 * 2**level
                sq = lambda x, y: (np.floor(x / side), np.floor((4000.0 - y) / side))
                near = [g for g in gauges if max(abs(p - q) for p, q in zip(sq(g[0], g[1]), sq(mx, my))) <= 1]
                if len(near) >= most:
                    break
            near = sorted(near, key=lambda g: ((g[0] - mx) ** 2 + (g[1] - my) ** 2, g[0], g[1]))[:most]
            cells = [(r, c) for r in range(r0, min(40, r0 + 16)) for c in range(c0, min(50, c0 + 16))]
            at = np.array([((c + 0.5) * 100, 4000 - (r + 0.5) * 100) for r, c in cells])
            for s, used in ((1, near), (2, gauges[:20])):
                assert np.abs(np.array([out[s, r, c] for r, c in cells]) - dense(used, at, LAW)[0]).max() < 1e-8


def test_kriging_of_many_gauges_stays_small(spark):
    spec = GridSpec(60, 60, 1000.0, 0.0, 60000.0)
    points = spark.createDataFrame(pd.DataFrame([(1, *g) for g in scattered(4, 20_000, 60_000)], columns=["step", "x", "y", "value"])).withColumn("step", F.col("step").cast("int"))
    models = spark.createDataFrame([(1, *LAW)], "step int, model string, nugget double, sill double, reach double")
    near = interpolate.neighbourhoods(points, spec, 300).groupBy("step", "tile").count().collect()
    assert {r["count"] for r in near} == {300}
    assert interpolate.krige_cells(points, models, spec, variance=True, most=300).filter("value >= 0 and variance >= 0").count() == 60 * 60


def test_tiles_share_gauges_and_no_full_system_is_solved(spark, monkeypatch):
    """blocks as wide as the model reaches, in place of a full matrix and its inverse for each tile."""
    spec = GridSpec(96, 96, 100.0, 0.0, 9600.0)
    rnd = np.random.default_rng(9)
    gauges = sorted({(float(x), float(y), float(v)) for x, y, v in zip(rnd.random(700) * 9600, rnd.random(700) * 9600, rnd.random(700) * 9)})
    x, y, z = np.array(gauges).T
    law, tiles = ("spherical", 0.3, 2.0, 900.0), [0, 7, 14, 35]
    sizes, inverse = [], np.linalg.inv
    monkeypatch.setattr(interpolate, "_weights", lambda *a: pytest.fail("full system"))
    monkeypatch.setattr(np.linalg, "inv", lambda a: sizes.append(a.shape[-1]) or inverse(a))
    r, c, value, variance = (np.concatenate(p) for p in zip(*interpolate._tile_values(x, y, z, tiles, 16, law, spec, True, 400)))
    assert len(r) == 4 * 256 and max(sizes) < 250
    for t in tiles:
        mx, my = (t % 6 * 16 + 8) * 100.0, 9600 - (t // 6 * 16 + 8) * 100.0
        near = sorted(gauges, key=lambda g: ((g[0] - mx) ** 2 + (g[1] - my) ** 2, g[0], g[1]))[:400]
        own = (r // 16 == t // 6) & (c // 16 == t % 6)
        want = dense(near, np.stack([(c[own] + 0.5) * 100, 9600 - (r[own] + 0.5) * 100], 1), law)
        assert np.abs(value[own] - want[0]).max() < 1e-8 and np.abs(variance[own] - want[1]).max() < 1e-8
    # without variogram the mean; gauges that all but coincide are left to the full system
    assert {*np.concatenate([p[2] for p in interpolate._tile_values(x, y, z, [0], 16, ("spherical", 0.0, 0.0, 1.0), spec, False, 700)]).round(9)} == {z.mean().round(9)}
    monkeypatch.undo()
    many = spark.createDataFrame([(1, *g) for g in gauges], "step int, x double, y double, value double")
    models = spark.createDataFrame([(1, *law)], "step int, model string, nugget double, sill double, reach double")
    crowded = interpolate.krige_cells(many, models, spec, least=None, most=100)
    monkeypatch.setattr(interpolate, "MOST_SHARED", 0)
    alone = interpolate.krige_cells(many, models, spec, least=None, most=100)
    both = crowded.join(alone.withColumnsRenamed({"value": "v2", "variance": "w2"}), ["step", "row", "col"])
    assert both.filter("abs(value - v2) < 1e-8 and abs(variance - w2) < 1e-8").count() == 96 * 96


def test_utm_matches_meridian_arc_and_round_trips(spark):
    lat = 39.5
    n = 20000
    e2 = gd.ECC**2
    phi = np.linspace(0, math.radians(lat), n + 1)
    f = gd.AXIS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = float(((f[:-1] + f[1:]) / 2).sum() * (phi[1] - phi[0]))
    pts = spark.createDataFrame([(0, -3.0, lat), (1, -0.375, 39.47), (2, 2.9, -12.0)], "i int, x double, y double")
    utm = {r.i: r for r in gd.reproject(pts, 4326, 25830).collect()}
    assert utm[0].x == pytest.approx(500000, abs=1e-6) and utm[0].y == pytest.approx(gd.SCALE * arc, abs=1e-2)
    back = {r.i: r for r in gd.reproject(gd.reproject(pts, 4326, 32730), 32730, 4326).collect()}
    for i, x, y in [(0, -3.0, lat), (1, -0.375, 39.47), (2, 2.9, -12.0)]:
        assert back[i].x == pytest.approx(x, abs=1e-8) and back[i].y == pytest.approx(y, abs=1e-8)
    assert gd.utm_zone(23030) == (30, True)
    for bad in (23061, 4258, 25861):
        with pytest.raises(ValueError):
            gd.utm_zone(bad)


def test_level_scaling_literals(spark):
    def scaled(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        return [r.level for r in layers.scale_to_levels(df, "v", 5).orderBy("i").collect()]

    assert scaled([0.0, 1.0, 2.0, 5.0]) == [0, 1, 2, 5]
    assert scaled([0.0, 50.0, 100.0]) == [0, 2, 5]
    assert scaled([float("nan"), float("nan")]) == [0, 0]
    assert scaled([7.0, 7.0]) == [0, 0]


def test_sparse_frames_and_deltas(spark):
    rows = [(0, 0, 1, 0.3), (0, 6, 3, 0.7), (1, 19, 5, 2.5), (2, 19, 5, 2.6), (2, 6, 2, 0.5)]
    df = spark.createDataFrame(rows, "step int, idx long, risk int, depth double")
    diff = frames.frame_diff(df)
    assert sorted((r.step, r.idx, r.risk) for r in diff.collect()) == [(0, 0, 1), (0, 6, 3), (1, 0, 0), (1, 6, 0), (1, 19, 5), (2, 6, 2)]
    back = frames.apply_deltas(diff, 2, 20).filter("risk > 0")
    assert sorted((r.step, r.idx, r.risk) for r in back.collect()) == sorted((s, i, k) for s, i, k, _ in rows)
    assert frames.apply_deltas(diff, 2, 10).filter("idx >= 10").count() == 0


def test_shuffled_and_duplicated_partitions_change_nothing(spark):
    rnd = random.Random(9)
    grid = np.array([[rnd.randint(0, 40) / 2 for _ in range(9)] for _ in range(7)])
    spec = GridSpec(7, 9, 1.0, 0.0, 0.0)
    df = table(spark, height=grid)
    one = focal.hillshade(df.coalesce(1), spec).collect()
    many = focal.hillshade(df.repartition(13), spec).collect()
    key = lambda r: (r.row, r.col)
    assert sorted(one, key=key) == sorted(many, key=key)


def test_colour_encodings(spark):
    df = spark.createDataFrame([(0.0,), (-40000.0,), (123.5,)], "h double")
    got = [tuple(r.c) for r in df.select(cx.height_rgb(F.col("h")).alias("c")).collect()]
    assert got == [(128, 0, 0), (0, 0, 0), (128, 123, 128)]
    lv = spark.createDataFrame([(0,), (3,), (9,)], "l int").select(cx.level_rgba(F.col("l"), K.PALETTE).alias("c"))
    assert [tuple(r.c) for r in lv.collect()] == [(158, 128, 80, 0), (26, 102, 204, 200), (26, 26, 153, 200)]


def test_wrong_hemisphere_is_an_error(spark):
    pts = spark.createDataFrame([(0, -3.0, 40.0), (1, -3.0, 0.0)], "i int, x double, y double")
    assert gd.reproject(pts, 4326, 23030, same_hemisphere=True).count() == 2
    for target, lat in ((25830, -0.5), (32730, 0.5)):
        bad = spark.createDataFrame([(0, -3.0, lat)], "i int, x double, y double")
        assert gd.reproject(bad, 4326, target).count() == 1
        with pytest.raises(Exception, match="wrong hemisphere"):
            gd.reproject(bad, 4326, target, same_hemisphere=True).collect()


def test_aliases_have_one_key_each(spark):
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("AB ") for _ in range(n)).strip() or "A"
    aliases = [(i, word(rnd.randint(2, 7))) for i in range(40)] + [(1, ""), (2, None), (3, "AB"), (3, "AB")]
    lines = [(i, word(rnd.randint(1, 20)), float(i)) for i in range(60)] + [(60, "", 1.0), (61, None, 1.0)]
    a = spark.createDataFrame(aliases, "station_id int, alias string")
    got = gauges.match_aliases(spark.createDataFrame(lines, "line_id int, name string, value double"), a)
    want = {(s, i, v) for s, al in aliases for i, n, v in lines if al and n and al in n}
    assert {(r.station_id, r.line_id, r.value) for r in got.collect()} == want
    assert gauges.match_aliases(spark.createDataFrame(lines, "line_id int, name string, value double"), a.limit(0)).count() == 0


def test_reports_of_odd_periods_and_snapped_edges(spark):
    """The window's edges move to the report hour; a period of 0 or 11 days is not asked for."""
    rows = [("2020-01-10", 2, True), ("2020-01-09", 0, True), ("2020-01-09", 3, True), ("2020-01-08", 1, True), ("2020-01-05", 11, True), ("2020-01-04", 10, True), ("2020-01-03", 1, True)]
    reports = spark.createDataFrame([("a", *r) for r in rows], "source string, d string, period int, matched boolean").selectExpr("source", "cast(d as date) as report_date", "period", "matched")
    taken = lambda start, end: [(str(r.report_date), r.period) for r in gauges.select_reports(reports, start, end).orderBy(F.desc("report_date")).collect()]
    assert taken("2020-01-04 08:00:00", "2020-01-09 08:00:01") == [("2020-01-10", 2), ("2020-01-08", 1), ("2020-01-04", 10)]
    assert taken("2020-01-04 09:00:00", "2020-01-09 08:00:00") == [("2020-01-09", 3), ("2020-01-04", 10)]
    assert taken("2020-01-09 07:00:00", "2020-01-09 07:00:00") == [("2020-01-09", 3)]


def test_sources_that_break_while_they_are_read(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 as v").write.parquet(str(tmp_path / "ok"))
    spark.range(5).selectExpr("id", "id * 2 as v").write.parquet(str(tmp_path / "bad"))
    part = next((tmp_path / "bad").glob("part-*"))
    part.write_bytes(part.read_bytes()[:40] + b"broken" * 9)
    (tmp_path / "bad" / f".{part.name}.crc").unlink(missing_ok=True)
    read = lambda name: lambda: spark.read.schema("id long, v long").parquet(str(tmp_path / name))
    rows, report = gauges.read_sources(spark, {"ok": read("ok"), "bad": read("bad"), "none": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert rows.groupBy("source").count().collect() == [("ok", 5)]
    assert {r.source: (r.read, r.error is None) for r in report.collect()} == {"ok": (True, True), "bad": (False, False), "none": (False, False)}
    with pytest.raises(ValueError, match="no source"):
        gauges.read_sources(spark, {"bad": read("bad")})


def test_candidate_tiles_miss_no_visible_pixel(spark):
    spec = GridSpec(12, 10, 900.0, 700000.0, 4400000.0)
    cells = spark.createDataFrame([(0, 0), (0, 9), (6, 4), (11, 3)], "row int, col int")
    west, north = (lambda p: (p.x, p.y))(gd.reproject(spark.createDataFrame([(spec.min_x - 2000, spec.max_y + 2000)], "x double, y double"), 25830, 3857).first())
    box = spark.createDataFrame([(west, north - 25000, west + 25000, north)], "west double, south double, east double, north double")
    zooms = (11, 13)
    cover = tiles.xyz_cover(box, zooms, [])
    px = tiles.pixel_points(cover, spec.epsg, 16).filter(cx.inside(F.col("x"), F.col("y"), spec))
    at = px.select("z", "tx", "ty", cx.row_at(F.col("y"), spec).alias("row"), cx.col_at(F.col("x"), spec).alias("col"))
    shown = {tuple(r) for r in at.join(cells, ["row", "col"]).select("z", "tx", "ty").distinct().collect()}
    may = {tuple(r) for r in tiles.candidate_tiles(cells, spec, zooms).collect()}
    assert shown and shown <= may
    assert len(may) < cover.count() / 2
