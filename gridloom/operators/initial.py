"""Initial grid from layer messages that name raster files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.functions import cells as cx
from gridloom.gridspec import GridSpec
from gridloom.operators import layers


def initial_grid(requests: DataFrame, rasters: DataFrame, spec: GridSpec, levels: list[tuple], top: int, file_mode: bool = True) -> DataFrame:
    """Cells ``(scenario, layer, row, col, level, depth, terrain)`` of the requested layers.

    ``rasters`` is ``(name, row, col, value)`` with names ``data_path/data_filename``. The elevation
    layer stays raw. In file mode the depth layer has negatives set to 0, is brought to the grid's
    shape and classified. Any other layer is scaled to levels by its own range, then brought to shape.
    """
    ask = requests.withColumn("name", F.concat_ws("/", "data_path", "data_filename")).select("scenario", "layer", "name")
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    good = F.when(finite, v)
    stats = rasters.groupBy("name").agg(
        F.min(good).alias("lo"), F.max(good).alias("hi"), F.max(F.when(finite, (v % 1 != 0).cast("int")).otherwise(F.lit(0))).alias("frac")
    )
    info = ask.join(stats, "name")
    raw = rasters.join(info, "name")
    lo, hi = F.col("lo"), F.col("hi")
    whole = (lo >= 0) & (hi <= top) & (F.col("frac") == 0)
    unit = F.when(finite & (hi > lo), (v - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.0))
    scaled = F.when(whole, F.coalesce(good, F.lit(0.0))).otherwise(F.rint(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * top))
    terrain = F.col("layer") == K.TERRAIN_LAYER
    depth = (F.col("layer") == K.DEPTH_LAYER) & F.lit(file_mode)
    water = cx.fill_nodata(v, 0.0)
    on_grid = (F.col("row") < spec.rows) & (F.col("col") < spec.cols)
    cells = raw.filter(terrain | on_grid).select(
        "scenario", "layer", "row", "col",
        F.when(depth, cx.risk_level(water, levels)).when(~terrain, scaled.cast("int")).alias("level"),
        F.when(depth, water).alias("depth"),
        F.when(terrain, v).alias("terrain"),
    )
    # Padding: only layers that are not raw are brought to the shape of the grid.
    pads = info.filter(~terrain).select("scenario", "layer", F.when(depth, F.lit(0.0)).alias("_d"))
    rows = pads.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(spec.rows - 1))))
    frame = layers.dealt(rows, "scenario", "layer", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(spec.cols - 1))))
    keys = ["scenario", "layer", "row", "col"]
    blank = frame.select(*keys, F.lit(0).alias("level"), F.col("_d").alias("depth"), F.lit(None).cast("double").alias("terrain"), F.lit(0).alias("_real"))
    both = cells.withColumn("_real", F.lit(1)).unionByName(blank)
    return both.groupBy(*keys).agg(*[F.max_by(c, "_real").alias(c) for c in ("level", "depth", "terrain")])
