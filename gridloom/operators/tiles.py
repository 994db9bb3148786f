"""Tiles of the grid, level-of-detail samples and web-mercator tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions import cells as cx
from gridloom.functions import geodesy
from gridloom.gridspec import GridSpec
from gridloom.operators import layers


def _edges(lo: str, hi: str, step: float) -> Column:
    """Array of edges every ``step`` from ``lo``, the last exactly ``hi``."""
    n = F.ceil((F.col(hi) - F.col(lo)) / F.lit(float(step))).cast("int")
    inner = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.col(lo) + i * F.lit(float(step)))
    checked = F.when(F.col(lo) >= F.col(hi), F.raise_error(F.lit("tile bounds are empty"))).otherwise(inner)
    return F.concat(checked, F.array(F.col(hi)))


def tile_edges(boxes: DataFrame, step: float, keys: list[str]) -> DataFrame:
    """Download tiles of each box: every x interval with every y interval of that box."""
    if step <= 0:
        raise ValueError(f"tile step must be positive, got {step}")
    spans = lambda edges: F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.struct((i - 1).alias("i"), F.element_at(edges, i).alias("lo"), F.element_at(edges, i + 1).alias("hi")),
    )
    arr = boxes.select(
        *keys, _edges("min_x", "max_x", step).alias("_xe"), _edges("min_y", "max_y", step).alias("_ye")
    )
    xs = arr.select(*keys, "_ye", F.explode(spans(F.col("_xe"))).alias("x"))
    ys = xs.select(*keys, "x", F.explode(spans(F.col("_ye"))).alias("y"))
    return ys.select(
        *keys, F.col("x.i").alias("x_idx"), F.col("y.i").alias("y_idx"),
        F.col("x.lo").alias("min_x"), F.col("x.hi").alias("max_x"), F.col("y.lo").alias("min_y"), F.col("y.hi").alias("max_y"),
    )


def _tile_ids(core: int, halo: int, spec: GridSpec) -> Column:
    """Tiles whose core or halo holds the cell: at most four when the halo is below half a core."""
    def span(pos: Column, size: int) -> Column:
        last = (size - 1) // core
        lo = F.least(F.greatest(cx.div(pos - halo, core), F.lit(0)), F.lit(last))
        hi = F.least(F.greatest(cx.div(pos + halo, core), F.lit(0)), F.lit(last))
        return F.sequence(lo.cast("int"), hi.cast("int"))

    return F.flatten(
        F.transform(
            span(F.col("row"), spec.rows),
            lambda a: F.transform(span(F.col("col"), spec.cols), lambda b: F.struct(a.alias("tile_row"), b.alias("tile_col"))),
        )
    )


def _ring(cells: DataFrame, spec: GridSpec, halo: int) -> DataFrame:
    """Off-grid positions within ``halo`` of the grid, generated from ranges."""
    spark = cells.sparkSession
    wide = spec.cols + 2 * halo
    bands = spark.range(2 * halo * wide).select(
        (F.expr(f"id div {wide}")).alias("k"), (F.col("id") % wide - halo).cast("int").alias("col")
    )
    bands = bands.select(
        F.when(F.col("k") < halo, F.col("k") - halo).otherwise(F.col("k") - halo + spec.rows).cast("int").alias("row"), "col"
    )
    sides = spark.range(2 * halo * spec.rows).select(
        F.expr(f"cast(id div {2 * halo} as int)").alias("row"), (F.col("id") % (2 * halo)).alias("k")
    )
    sides = sides.select(
        "row", F.when(F.col("k") < halo, F.col("k") - halo).otherwise(F.col("k") - halo + spec.cols).cast("int").alias("col")
    )
    return bands.unionByName(sides)


def to_tiles(cells: DataFrame, spec: GridSpec, core: int, halo: int, value: str = "value", pad: float = 0.0) -> DataFrame:
    """Cells copied to their core tile and to the halos that see them; off-grid halo is ``pad``.

    Repartition the result by ``(tile_row, tile_col)`` before a per-tile function.
    """
    src = cells.select("row", "col", F.col(value).cast("double").alias("value"), F.lit(False).alias("_off"))
    if halo:
        src = src.unionByName(_ring(cells, spec, halo).select("row", "col", F.lit(float(pad)).alias("value"), F.lit(True).alias("_off")))
    out = src.select("row", "col", "value", "_off", F.inline(_tile_ids(core, halo, spec)))
    r, c, tr, tc = (F.col(n) for n in ("row", "col", "tile_row", "tile_col"))
    end_r, end_c = F.least((tr + 1) * core, F.lit(spec.rows)), F.least((tc + 1) * core, F.lit(spec.cols))
    seen = (r >= tr * core - halo) & (r < end_r + halo) & (c >= tc * core - halo) & (c < end_c + halo)
    in_core = (r >= tr * core) & (r < end_r) & (c >= tc * core) & (c < end_c)
    role = F.when(F.col("_off"), F.lit("pad")).when(in_core, F.lit("core")).otherwise(F.lit("halo"))
    return out.filter(seen).select("tile_row", "tile_col", "row", "col", role.alias("role"), "value")


def active_tiles(cells: DataFrame, spec: GridSpec, core: int, halo: int, moving: str = "moving") -> DataFrame:
    """Tiles with a moving cell in core or halo; resting cells are dropped before anything else."""
    live = cells.filter(F.col(moving).cast("boolean"))
    return live.select(F.inline(_tile_ids(core, halo, spec))).distinct()


def merge_core(cells: DataFrame, tiles: DataFrame, value: str = "value") -> DataFrame:
    """Write tile results back: core cells only, cells of tiles not in the result stay."""
    new = tiles.filter(F.col("role") == "core").select("row", "col", F.col(value).alias("_new"))
    return cells.join(new, ["row", "col"], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def wet_chunks(wet: DataFrame, size: int) -> DataFrame:
    """Whether any cell ``(row, col, wet)`` of a chunk was ever wet."""
    return wet.groupBy(
        cx.div(F.col("row"), size).cast("int").alias("chunk_row"), cx.div(F.col("col"), size).cast("int").alias("chunk_col")
    ).agg(F.bool_or("wet").alias("wet"))


def lod_sample(cells: DataFrame, chunks: DataFrame, size: int, factors: list[int], value: str = "value") -> DataFrame:
    """Cells at multiples of each factor from their chunk's origin; dry chunks only the coarsest.

    Most cells match no factor, so the modulus is tested before the join with the chunk table.
    """
    coarsest = len(factors) - 1
    levels = F.array(*[F.struct(F.lit(i).alias("lod"), F.lit(f).alias("factor")) for i, f in enumerate(factors)])
    inner = lambda c: F.pmod(F.col(c), F.lit(size))
    picked = (
        cells.select("row", "col", value, F.inline(levels))
        .filter((inner("row") % F.col("factor") == 0) & (inner("col") % F.col("factor") == 0))
        .withColumns(
            {
                "chunk_row": cx.div(F.col("row"), size).cast("int"),
                "chunk_col": cx.div(F.col("col"), size).cast("int"),
            }
        )
    )
    joined = picked.join(chunks, ["chunk_row", "chunk_col"], "left")
    return joined.filter(F.coalesce("wet", F.lit(False)) | (F.col("lod") == coarsest)).select(
        "lod", "chunk_row", "chunk_col", "row", "col", value
    )


def xyz_cover(boxes: DataFrame, zooms: tuple[int, int], keys: list[str]) -> DataFrame:
    """Web-mercator tiles covering each box; a tile that only shares an edge is not counted."""
    half, eps = F.lit(K.MERCATOR_HALF), F.lit(1e-8)
    z = boxes.withColumn("z", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))))
    z = z.withColumn("_n", F.pow(F.lit(2.0), F.col("z")))
    z = z.withColumn("_m", F.lit(K.MERCATOR_HALF * 2) / F.col("_n"))
    at = lambda v: F.floor(v / F.col("_m")).cast("int")
    low = lambda v: F.greatest(at(v), F.lit(0))
    high = lambda v: F.least(at(v), (F.col("_n") - 1).cast("int"))
    spans = z.withColumns(
        {
            "_x0": low(F.col("west") + half), "_x1": high(F.col("east") + half - eps),
            "_y0": low(half - F.col("north")), "_y1": high(half - F.col("south") - eps),
        }
    ).filter((F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1")))
    xs = spans.withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    return xs.select(*keys, "z", "x", F.explode(F.sequence("_y0", "_y1")).alias("y"))


def xyz_bounds(tiles: DataFrame) -> DataFrame:
    """West, south, east and north of each tile in metres; y grows to the south."""
    m = F.lit(K.MERCATOR_HALF * 2) / F.pow(F.lit(2.0), F.col("z"))
    west, north = F.col("x") * m - F.lit(K.MERCATOR_HALF), F.lit(K.MERCATOR_HALF) - F.col("y") * m
    return tiles.withColumns({"west": west, "south": north - m, "east": west + m, "north": north})


def pixel_points(cover: DataFrame, epsg: int, size: int = K.TILE_PIXELS) -> DataFrame:
    """Pixel centres of each tile as points in the grid's CRS.

    A cover is a few rows that come from one box, so its tiles are dealt out before their pixels are made.
    """
    cover = layers.dealt(cover, "z", "x", "y")
    m = F.lit(K.MERCATOR_HALF * 2) / F.pow(F.lit(2.0), F.col("z")) / F.lit(size)
    px = cover.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    px = px.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    half = F.lit(K.MERCATOR_HALF)
    placed = px.select(
        "z", F.col("x").alias("tx"), F.col("y").alias("ty"), "px", "py",
        ((F.col("x") * size + F.col("px") + 0.5) * m - half).alias("x"),
        (half - (F.col("y") * size + F.col("py") + 0.5) * m).alias("y"),
    )
    return geodesy.reproject(placed, 3857, epsg)


def tile_pixels(cells: DataFrame, spec: GridSpec, cover: DataFrame, kind: str, value: str = "value", fill: float = 0.0) -> DataFrame:
    """Grid resampled to tile pixels: nearest for classes, bilinear for heights, ``fill`` outside."""
    keys = ["z", "tx", "ty", "px", "py"]
    pts = pixel_points(cover, spec.epsg)
    if kind == "nearest":
        return layers.align_nearest(cells, spec, pts, value, fill).select(*keys, F.col(value).cast("double").alias(value))
    if kind == "bilinear":
        return layers.align_bilinear(cells, spec, pts, keys, value, fill)
    raise ValueError(f"unknown resampling {kind}")


def candidate_tiles(cells: DataFrame, spec: GridSpec, zooms: tuple[int, int]) -> DataFrame:
    """Tiles ``(z, x, y)`` that may show one of the ``cells`` (row, col): those that meet the square around a cell's middle.

    The square is twice as wide as the cell, and wider still by what the projection stretches it; so a tile that is left
    out has no pixel in a cell, and pixels are needed only for the others.
    """
    middle = cells.select("row", "col").distinct().select(
        "row", "col", cx.centre_x(F.col("col"), spec).alias("x"), cx.centre_y(F.col("row"), spec).alias("y")
    )
    geo = geodesy.reproject(middle, spec.epsg, 4326).withColumnsRenamed({"x": "_lon", "y": "_lat"})
    merc = geodesy.reproject(geo.select("_lat", F.col("_lon").alias("x"), F.col("_lat").alias("y")), 4326, 3857)
    reach = F.lit(float(spec.cell)) / F.cos(F.radians("_lat"))
    boxes = merc.select((F.col("x") - reach).alias("west"), (F.col("x") + reach).alias("east"), (F.col("y") - reach).alias("south"), (F.col("y") + reach).alias("north"))
    return xyz_cover(boxes, zooms, []).select("z", "x", "y").distinct()


def nonempty_tiles(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with at least one visible pixel."""
    return pixels.groupBy(*keys).agg(F.max("a").alias("a")).filter(F.col("a") > 0).drop("a")
