"""Layer algebra on cell tables ``(row, col, value...)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import cells as cx
from gridloom.functions import geodesy
from gridloom.functions.ranges import interval_join, seconds
from gridloom.gridspec import GridSpec

RC = ["row", "col"]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The few rows spread over as many partitions as a shuffle has, before each becomes many.

    The number is given, as adaptive execution would join small partitions again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def idx_to_rowcol(df: DataFrame, cols: int) -> DataFrame:
    return df.withColumns({"row": cx.row_of(F.col("idx"), cols), "col": cx.col_of(F.col("idx"), cols)})


def rowcol_to_idx(df: DataFrame, cols: int, out: str = "idx") -> DataFrame:
    return df.withColumn(out, cx.index_of(F.col("row"), F.col("col"), cols))


def cell_centres(df: DataFrame, spec: GridSpec) -> DataFrame:
    return df.withColumns(
        {"x": cx.centre_x(F.col("col"), spec), "y": cx.centre_y(F.col("row"), spec)}
    )


def _spread(col: Column) -> Column:
    """Negative key for a row that can match nothing, so that such rows do not meet in one task."""
    return (F.lit(-1) - F.pmod(F.xxhash64(col), F.lit(1 << 20))).cast("int")


def sample_at(points: DataFrame, cells: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """Value of the cell holding each point; points off the grid keep their row with ``ok = false``."""
    x, y = F.col("x"), F.col("y")
    ok = F.coalesce(cx.inside(x, y, spec), F.lit(False))
    keyed = points.withColumns(
        {
            "ok": ok,
            "_r": F.when(ok, cx.row_at(y, spec)).otherwise(_spread(y)),
            "_c": F.when(ok, cx.col_at(x, spec)).otherwise(_spread(x)),
        }
    )
    found = keyed.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value), ["_r", "_c"], "left")
    at = lambda c: F.when(F.col("ok"), F.col(c))
    return found.select(*points.columns, "ok", at("_r").alias("row"), at("_c").alias("col"), value)


def view_window(cells: DataFrame, spec: GridSpec, box: tuple | None = None) -> DataFrame:
    """Cells of a map window; the bounds are literals, so the filter reaches the scan."""
    r0, r1, c0, c1 = cx.view_bounds(spec, box)
    return cells.filter(
        (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    )


def block_mean(cells: DataFrame, spec: GridSpec, factor: int, value: str = "value") -> DataFrame:
    """Mean per ``factor x factor`` block; the ragged right and bottom edges are trimmed."""
    if factor <= 1:
        return cells.select(*RC, value)
    rows, cols = spec.rows // factor * factor, spec.cols // factor * factor
    return (
        cells.filter((F.col("row") < rows) & (F.col("col") < cols))
        .groupBy(
            cx.div(F.col("row"), factor).cast("int").alias("row"),
            cx.div(F.col("col"), factor).cast("int").alias("col"),
        )
        .agg(F.avg(value).alias(value))
    )


def expand_coarse(coarse: DataFrame, factor: int, fine: DataFrame, value: str = "value") -> DataFrame:
    """Give every fine cell the value of its coarse cell, 0 outside the coarse grid."""
    keys = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return (
        fine.select(*RC)
        .withColumns(
            {
                "_r": cx.div(F.col("row"), factor).cast("int"),
                "_c": cx.div(F.col("col"), factor).cast("int"),
            }
        )
        .join(keys, ["_r", "_c"], "left")
        .select(*RC, F.coalesce(value, F.lit(0.0)).alias(value))
    )


def series_asof(times: DataFrame, frames: DataFrame, width_seconds: int = 86400) -> DataFrame:
    """Frame whose ``[ts_start, ts_end)`` holds each time, rounded to seconds; none past the end."""
    micro = F.lit(1_000_000)
    at = F.floor((seconds(F.col("ts")) + 500_000) / micro) * micro
    return interval_join(
        times,
        frames.select("step", "ts_start", "ts_end"),
        at,
        seconds(F.col("ts_start")),
        seconds(F.col("ts_end")),
        width_seconds * 1_000_000,
    ).drop("ts_start", "ts_end")


def align_nearest(
    src: DataFrame, src_spec: GridSpec, targets: DataFrame, value: str = "value", fill: float | None = None
) -> DataFrame:
    """Value of the source cell holding each target point ``(..., x, y)`` in the source CRS."""
    x, y = F.col("x"), F.col("y")
    ok = cx.inside(x, y, src_spec)
    keys = src.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    out = (
        targets.withColumns(
            {
                "_r": F.when(ok, cx.row_at(y, src_spec)).otherwise(_spread(y)),
                "_c": F.when(ok, cx.col_at(x, src_spec)).otherwise(_spread(x)),
            }
        )
        .join(keys, ["_r", "_c"], "left")
        .drop("_r", "_c", "x", "y")
    )
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def align_bilinear(
    src: DataFrame,
    src_spec: GridSpec,
    targets: DataFrame,
    keys: list[str],
    value: str = "value",
    fill: float = 0.0,
) -> DataFrame:
    """Weighted mean of the up to four source centres around each target point.

    Points off the source grid take ``fill``. Every target goes to its four source keys, one
    equi-join fetches the values and one partial aggregation folds them back.
    """
    fx = (F.col("x") - F.lit(src_spec.min_x)) / F.lit(src_spec.cell) - 0.5
    fy = (F.lit(src_spec.max_y) - F.col("y")) / F.lit(src_spec.cell) - 0.5
    based = targets.withColumns({"_fx": fx, "_fy": fy, "_ok": cx.inside(F.col("x"), F.col("y"), src_spec)})
    based = based.withColumns({"_c0": F.floor("_fx"), "_r0": F.floor("_fy")})
    wx, wy = F.col("_fx") - F.col("_c0"), F.col("_fy") - F.col("_r0")
    corners = F.array(
        *[
            F.struct(
                (F.col("_r0") + dr).cast("int").alias("_r"),
                (F.col("_c0") + dc).cast("int").alias("_c"),
                ((wy if dr else 1 - wy) * (wx if dc else 1 - wx)).alias("_w"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
    )
    # A point off the grid needs no corner: it keeps one row that matches nothing.
    off = F.array(F.struct(_spread(F.col("y")).alias("_r"), _spread(F.col("x")).alias("_c"), F.lit(0.0).alias("_w")))
    near = based.select(*keys, "_ok", F.inline(F.when(F.col("_ok"), corners).otherwise(off)))
    vals = src.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    hit = F.col("_v").isNotNull()
    folded = (
        near.join(vals, ["_r", "_c"], "left")
        .groupBy(*keys)
        .agg(
            F.max("_ok").alias("_ok"),
            F.sum(F.when(hit, F.col("_w") * F.col("_v"))).alias("_wv"),
            F.sum(F.when(hit, F.col("_w"))).alias("_ws"),
        )
    )
    good = F.col("_ok") & (F.col("_ws") > 1e-12)
    return folded.select(*keys, F.when(good, F.col("_wv") / F.col("_ws")).otherwise(F.lit(fill)).alias(value))


def target_points(spark: SparkSession, dst: GridSpec, src_epsg: int) -> DataFrame:
    """Centres of a target grid as points in the source CRS; reprojected only when they differ."""
    pts = cell_centres(dst.frame(spark), dst)
    return pts if dst.epsg == src_epsg else geodesy.reproject(pts, dst.epsg, src_epsg)


def mosaic(tiles: DataFrame, order: str = "tile_order", value: str = "value") -> DataFrame:
    """One value per cell: the first tile in order that has data there."""
    return (
        tiles.filter(F.col(value).isNotNull())
        .groupBy(*RC)
        .agg(F.min_by(value, order).alias(value))
    )


def conform(cells: DataFrame, spec: GridSpec, value: str = "value", pad: float = 0.0) -> DataFrame:
    """Crop or pad to the shape of ``spec``, anchored at the top left."""
    return (
        spec.frame(cells.sparkSession)
        .join(cells.select(*RC, value), RC, "left")
        .withColumn(value, F.coalesce(value, F.lit(pad)))
    )


def constant_layer(cells: DataFrame, constant: float = 0.0, value: str = "value") -> DataFrame:
    return cells.select(*RC, F.lit(constant).alias(value))


def layer_stats(cells: DataFrame, value: str = "value", nodata: float | None = None, widen: bool = False) -> DataFrame:
    """One row with min, max and count of valid values, NaN and nodata left out."""
    v = F.col(value)
    valid = v.isNotNull() & ~F.isnan(v)
    if nodata is not None:
        valid = valid & (v > F.lit(nodata))
    good = F.when(valid, v)
    out = cells.agg(F.min(good).alias("lo"), F.max(good).alias("hi"), F.count(good).alias("n"))
    if widen:
        flat = F.col("lo") == F.col("hi")
        out = out.withColumns({"hi": F.when(flat, F.col("hi") + 1.0).otherwise(F.col("hi"))})
    return out


def reclass(cells: DataFrame, table: list[float], default: float, key: str = "land_cover", value: str = "roughness") -> DataFrame:
    """Class to number through a lookup table that is part of the plan; unknown takes the default."""
    lut = F.array(*[F.lit(float(v)) for v in table])
    known = F.col(key).between(0, len(table) - 1)
    pick = F.when(known, F.element_at(lut, (F.col(key) + 1).cast("int")))
    return cells.withColumn(value, F.coalesce(pick, F.lit(default)))


def map_class_codes(features: DataFrame, codes: list[str], key: str = "code", out: str = "class") -> DataFrame:
    """Position of the code in the list, starting at 1; unknown codes give 0."""
    table = F.array(*[F.lit(c) for c in codes])
    return features.withColumn(out, F.coalesce(F.array_position(table, F.col(key)), F.lit(0)).cast("int"))


def masked_merge(base: DataFrame, overlay: DataFrame, mask: DataFrame, classes: list[int]) -> DataFrame:
    """Overlay where the mask class is listed, base elsewhere; all three are ``(row, col, ...)``."""
    joined = (
        base.select(*RC, F.col("value").alias("_base"))
        .join(overlay.select(*RC, F.col("value").alias("_over")), RC, "left")
        .join(mask.select(*RC, "class"), RC, "left")
    )
    take = F.coalesce(F.col("class").isin(classes), F.lit(False))
    return joined.select(*RC, F.when(take, F.col("_over")).otherwise(F.col("_base")).alias("value"))


def classify(df: DataFrame, levels: list[tuple], depth: str = "depth", out: str = "risk") -> DataFrame:
    return df.withColumn(out, cx.risk_level(F.col(depth), levels))


def scale_to_levels(cells: DataFrame, value: str, top: int, out: str = "level") -> DataFrame:
    """Integers already in ``0..top`` stay; anything else is min-max scaled and rounded half to even.

    The range comes from scalar subqueries, so no row is paired with another.
    """
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    good = F.when(finite, v)
    stats = cells.agg(
        F.struct(
            F.min(good).alias("lo"),
            F.max(good).alias("hi"),
            F.max(F.when(finite & (v % 1 != 0), F.lit(1)).otherwise(F.lit(0))).alias("frac"),
        ).alias("s")
    ).scalar()
    df = cells.withColumn("_s", stats)
    lo, hi, frac = (F.col(f"_s.{n}") for n in ("lo", "hi", "frac"))
    already = (lo >= 0) & (hi <= top) & (frac == 0)
    unit = F.when(finite & (hi > lo), (v - lo) / (hi - lo)).otherwise(F.lit(0.0))
    scaled = F.rint(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * top)
    level = F.when(already, F.coalesce(good, F.lit(0.0))).otherwise(scaled)
    return df.withColumn(out, level.cast("int")).drop("_s")


def overlay(
    cells: DataFrame,
    lift: list[float],
    enabled: list[bool],
    show_terrain: bool = True,
    hidden: float = -9999.0,
) -> DataFrame:
    """Display height: lifted terrain on wet cells of an enabled state, else terrain or hidden."""
    state = F.col("risk")
    last_on, last_lift = len(enabled) - 1, len(lift) - 1
    on = F.element_at(F.array(*[F.lit(b) for b in enabled]), (F.least(state, F.lit(last_on)) + 1).cast("int"))
    up = F.element_at(F.array(*[F.lit(float(x)) for x in lift]), (F.least(state, F.lit(last_lift)) + 1).cast("int"))
    dry = F.col("terrain") if show_terrain else F.lit(hidden)
    return cells.withColumn("shown", F.when((state > 0) & on, F.col("terrain") + up).otherwise(dry))


def vertical_scale(cells: DataFrame, spec: GridSpec, value: str = "value", nodata: float = -500.0, share: float = 0.30) -> DataFrame:
    """One row: factor that makes the terrain range a share of the shorter grid side."""
    side = min(spec.rows, spec.cols) * spec.cell
    stats = layer_stats(cells, value, nodata=nodata)
    span = F.col("hi") - F.col("lo")
    flat = (F.col("n") == 0) | (span < 0.01)
    return stats.select(F.when(flat, F.lit(1.0)).otherwise(F.lit(side * share) / F.nullif(span, F.lit(0.0))).alias("scale"))


def stack_layers(spark: SparkSession, spec: GridSpec, layers: dict[str, DataFrame | None]) -> DataFrame:
    """All layers side by side on one grid; absent layers and cells are 0.

    Layers are tagged, unioned and folded with one aggregation, so the number of shuffles does not
    grow with the number of layers.
    """
    names = list(layers)
    cols = lambda src, present: [
        (F.col("value").cast("double") if n == present else F.lit(None).cast("double")).alias(n) for n in names
    ]
    parts = [spec.frame(spark).select(*RC, *cols(None, None))]
    for n, df in layers.items():
        if df is not None:
            keep = df.filter((F.col("row") < spec.rows) & (F.col("col") < spec.cols))
            parts.append(keep.select(*RC, *cols(keep, n)))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*RC).agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])


def apply_rain(cells: DataFrame, rain: DataFrame, dry_tolerance: float) -> DataFrame:
    """Add rain to the depth; cells that reach the dry tolerance start to move, others keep state."""
    depth = F.col("depth") + F.coalesce("rain", F.lit(0.0))
    joined = cells.join(rain.select(*RC, "rain"), RC, "left").withColumn("depth", depth)
    moving = F.when(cx.is_wet(F.col("depth"), dry_tolerance), F.lit(1)).otherwise(F.col("moving"))
    return joined.withColumn("moving", moving.cast("int")).drop("rain")


def wet_state(cells: DataFrame, dry_tolerance: float) -> DataFrame:
    return cells.withColumn("moving", cx.is_wet(F.col("depth"), dry_tolerance).cast("int"))
