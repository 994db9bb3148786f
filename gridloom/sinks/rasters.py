"""Text rasters, series and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.gridspec import GridSpec
from gridloom.operators.layers import layer_stats
from gridloom.sinks.named_files import write_named_text


def _text(value: Column, integer: bool, nodata: float = -9999.0) -> Column:
    """A cell as both writers of the format print it; a cell without a value as nodata."""
    if integer:
        return F.coalesce(value, F.lit(nodata)).cast("long").cast("string")
    number = F.coalesce(value.cast("double"), F.lit(nodata))
    return F.when(F.isnan(number), "nan").otherwise(F.format_string("%.6f", number))


def _lines(cells: DataFrame, keys: list[str], value: str, integer: bool, nodata: float = -9999.0) -> DataFrame:
    """One text line per grid row; a group is one row of the grid, bounded by its columns."""
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.col(value).alias("_v")))).alias("a"))
    return rows.select(*keys, "row", F.array_join(F.transform("a", lambda s: _text(s["_v"], integer, nodata)), " ").alias("value"))


def write_ascii_raster(cells: DataFrame, path: str, value: str = "value", integer: bool = False) -> None:
    """Folder of part files whose concatenation in name order is the raster; no task holds a whole grid."""
    lines = _lines(cells, [], value, integer)
    lines.repartitionByRange("row").sortWithinPartitions("row").select("value").write.text(path)


# Nodata by data type.
NODATA = {"byte": -128.0, "integer": -9999.0, "real": -9999.0}


def raster_header(cells: DataFrame, spec: GridSpec, value: str = "value", data_type: str = "real", series: bool = False) -> DataFrame:
    """Header lines ``(pos, value)`` of a raster, or of a series; min and max come from one aggregate."""
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    text = lambda v: F.lit(str(v))
    # Header keys in file order.
    first = [("file format ", text("Hierarchical IDRISI"))] if series else [("file format ", text("IDRISI Raster A.1")), ("file title  ", text(""))]
    pairs: list[tuple[str, Column]] = first + [
        ("data type   ", text(data_type)),
        ("file type   ", text("ascii")), ("columns     ", text(spec.cols)), ("rows        ", text(spec.rows)),
        ("ref. system ", text(f"EPSG:{spec.epsg}")), ("ref. units  ", text("m")), ("unit dist.  ", text("1.0")),
        ("min. X      ", text(spec.min_x)), ("max. X      ", text(spec.max_x)), ("min. Y      ", text(spec.min_y)),
        ("max. Y      ", text(spec.max_y)), ("pos'n error ", text("unknown")), ("resolution  ", text(spec.cell)),
        ("min. value  ", lo), ("max. value  ", hi), ("display min ", lo), ("display max ", hi),
        ("value units ", text("unspecified")), ("nodata value", text(NODATA[data_type])),
    ]
    lines = F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])
    return layer_stats(cells, value).select(F.posexplode(lines).alias("pos", "value"))


def write_raster_header(cells: DataFrame, spec: GridSpec, path: str, value: str = "value", data_type: str = "real") -> None:
    """One small folder of a file of 21 lines."""
    raster_header(cells, spec, value, data_type).coalesce(1).sortWithinPartitions("pos").select("value").write.text(path)


def _header_lines(cells: DataFrame, spec: GridSpec, file: str, value: str, data_type: str, series: bool = False) -> DataFrame:
    header = raster_header(cells, spec, value, data_type, series)
    return header.select(F.lit(file).alias("name"), F.col("pos").cast("long").alias("at"), F.col("value").alias("line"))


def write_raster(cells: DataFrame, spec: GridSpec, folder: str, name: str, value: str = "value", data_type: str = "real") -> None:
    """``folder/name.img`` and its header ``folder/name.doc``; ``cells`` are the whole grid."""
    lines = _lines(cells, [], value, data_type != "real", NODATA[data_type])
    image = lines.select(F.lit(f"{name}.img").alias("name"), F.col("row").cast("long").alias("at"), F.col("value").alias("line"))
    write_named_text(image.unionByName(_header_lines(cells, spec, f"{name}.doc", value, data_type)), folder, "at")


def _iso(time: Column) -> Column:
    """A time as ISO text, with a fraction of six digits where it has one."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(time == F.date_trunc("second", time), whole).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def write_raster_series(series: DataFrame, index: DataFrame, spec: GridSpec, folder: str, name: str = "series", factor: int = 1, data_type: str = "real") -> None:
    """A series folder: ``%06d.img`` for each frame, ``name.hif`` as the header of all and ``name_metadata.json``.

    ``series`` is ``(step, row, col, value)``, the whole grid of each step; ``index`` is ``(step, ts_start, ts_end)``,
    one row per frame. Frames are numbered in order of their steps from 0.
    """
    ordered = F.array_sort(F.collect_list(F.struct("step", _iso(F.col("ts_start")).alias("a"), _iso(F.col("ts_end")).alias("b"))))
    frames = index.agg(ordered.alias("f"))
    side = frames.select(
        F.to_json(
            F.struct(
                F.size("f").alias("steps"),
                F.lit(factor).alias("downgrade_factor"),
                F.concat(F.transform("f", lambda s: s["a"]), F.array(F.element_at("f", -1)["b"])).alias("timestamps"),
                F.transform("f", lambda s, i: F.format_string("%06d", i)).alias("filenames"),
            )
        ).alias("line")
    )
    numbers = frames.select(F.posexplode("f").alias("number", "s")).select("number", F.col("s.step").alias("step"))
    lines = _lines(series, ["step"], "value", data_type != "real", NODATA[data_type]).join(numbers, "step")
    images = lines.select(F.format_string("%06d.img", "number").alias("name"), F.col("row").cast("long").alias("at"), F.col("value").alias("line"))
    sidecar = side.select(F.lit(f"{name}_metadata.json").alias("name"), F.lit(0).cast("long").alias("at"), "line")
    header = _header_lines(series, spec, f"{name}.hif", "value", data_type, series=True)
    write_named_text(images.unionByName(sidecar).unionByName(header), folder, "at")


def write_checkpoints(frames: DataFrame, path: str, time: str = "sim_time") -> None:
    """One folder per snapshot time; writing a time again replaces only that time."""
    name = F.concat(F.lit("checkpoint_"), F.date_format(time, "yyyy-MM-dd'T'HH-mm-ss"))
    frames.withColumn("checkpoint", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "checkpoint"
    ).parquet(path)


def write_sparse_frames(frames: DataFrame, spec: GridSpec, path: str) -> None:
    """``step_%05d.csv`` of the wet cells of each step, and the grid size as ``meta.json``.

    ``frames`` is ``(step, row, col, risk)``; a step without a wet cell has a file of the two heading lines. Each CSV
    begins with a comment of the grid size, as readers of single files expect.
    """
    name = F.format_string("step_%05d.csv", F.col("step"))
    # The two heading lines of a file.
    heads = F.array(F.lit(f"# rows={spec.rows} cols={spec.cols} cell_size_m={float(spec.cell)}"), F.lit("row,col,flood_risk"))
    top = frames.select("step").distinct().select(name.alias("name"), F.posexplode(heads).alias("pos", "line"))
    top = top.select("name", (F.col("pos") - 2).cast("long").alias("at"), "line")
    wet = frames.filter(F.col("risk") > 0).select(
        name.alias("name"), (F.col("row").cast("long") * spec.cols + F.col("col")).alias("at"), F.concat_ws(",", "row", "col", "risk").alias("line")
    )
    meta = F.to_json(F.struct(F.lit(spec.rows).alias("rows"), F.lit(spec.cols).alias("cols"), F.lit(spec.cell).alias("cell_size_m")))
    size = frames.sparkSession.range(1).select(F.lit("meta.json").alias("name"), F.lit(0).cast("long").alias("at"), meta.alias("line"))
    write_named_text(top.unionByName(wet).unionByName(size), path, "at")
