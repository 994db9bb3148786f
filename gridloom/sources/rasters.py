"""Text rasters: headers, grids and time series of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header keys that are read, with the column each becomes.
HEADER_KEYS = {
    "data type": "data_type",
    "columns": "cols",
    "rows": "rows",
    "ref. system": "crs",
    "min. X": "min_x",
    "max. X": "max_x",
    "min. Y": "min_y",
    "max. Y": "max_y",
    "resolution": "resolution",
    "nodata value": "nodata",
}
_NUMBERS = {"cols": "int", "rows": "int", "min_x": "double", "max_x": "double", "min_y": "double", "max_y": "double", "resolution": "double", "nodata": "double"}


def read_lines(spark: SparkSession, path: str | list[str], by_folder: bool = False, glob: str = "*[!_]*") -> DataFrame:
    """Lines ``(raster, line, value)`` with their exact 0-based number, read in parallel.

    Within one block of a file the generated row ids are consecutive, so the position in the block is
    the id minus the block's smallest id. Counting the lines of the blocks before it, on a table of
    one row per block, completes the number. No line is sorted, and no file is bound to one task.
    With ``by_folder`` the part files of a folder, in name order, are one raster. Blank lines do not count.
    """
    raw = spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=True).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    name = F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.col("file")
    blocks = raw.groupBy("file", "blk").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("raster", name)
    w = Window.partitionBy("raster").orderBy("file", "blk").rowsBetween(Window.unboundedPreceding, -1)
    start = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return raw.join(start.select("file", "blk", "first", "before", "raster"), ["file", "blk"]).select(
        "raster", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value"
    )


def checked_rows(lines: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Grid rows ``(raster, row, cells)`` of text lines.

    With a shape, a row of another width fails when it is read, and a raster with another number of
    rows fails on each of its rows.
    """
    parts = lines.select(
        "raster", F.col("line").cast("int").alias("row"), F.split(F.trim("value"), r"\s+").alias("cells")
    )
    if shape is None:
        return parts
    rows, cols = shape
    counts = parts.groupBy("raster").agg(F.count(F.lit(1)).alias("_n"))
    short = (F.size("cells") != cols) | (F.col("_n") != rows)
    checked = F.when(short, F.raise_error(F.concat(F.lit("raster does not fit its header: "), F.col("raster")))).otherwise(F.col("cells"))
    return parts.join(counts, "raster").select("raster", "row", checked.alias("cells"))


def read_ascii_raster(
    spark: SparkSession, path: str | list[str], by_folder: bool = False, shape: tuple[int, int] | None = None
) -> DataFrame:
    """Cells ``(raster, row, col, value)`` of whitespace-separated text grids, one line per row."""
    parts = checked_rows(read_lines(spark, path, by_folder), shape)
    return parts.select("raster", "row", F.posexplode("cells").alias("col", "_t")).select(
        "raster", "row", "col", F.col("_t").cast("double").alias("value")
    )


def read_raster_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per raster header of ``key : value`` lines; a value may contain colons."""
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("raster"), "value")
    kv = raw.filter(F.col("value").contains(":")).select(
        "raster", F.trim(F.substring_index("value", ":", 1)).alias("k"), F.trim(F.expr("substr(value, instr(value, ':') + 1)")).alias("v")
    )
    wide = kv.groupBy("raster").pivot("k", list(HEADER_KEYS)).agg(F.first("v"))
    return wide.select(
        "raster", *[F.col(f"`{k}`").cast(_NUMBERS.get(n, "string")).alias(n) for k, n in HEADER_KEYS.items()]
    )


def read_series_index(spark: SparkSession, path: str) -> DataFrame:
    """Frames ``(step, name, ts_start, ts_end, factor)`` of a series sidecar."""
    schema = "steps int, downgrade_factor int, timestamps array<string>, filenames array<string>"
    meta = spark.read.schema(schema).json(path, multiLine=True)
    return meta.select("timestamps", "downgrade_factor", F.posexplode("filenames").alias("step", "name")).select(
        "step", "name",
        F.to_timestamp_ntz(F.element_at("timestamps", F.col("step") + 1)).alias("ts_start"),
        F.to_timestamp_ntz(F.element_at("timestamps", F.col("step") + 2)).alias("ts_end"),
        F.col("downgrade_factor").alias("factor"),
    )


def _fitted(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Grid rows ``(raster, row, cells)`` of lines that ``shapes`` (raster, rows, cols) describes; one row for each shape at least.

    A raster without a file, of another number of rows or with a row of another width fails when it is read.
    """
    parts = lines.select("raster", F.col("line").cast("int").alias("row"), F.split(F.trim("value"), r"\s+").alias("cells"))
    counts = parts.groupBy("raster").agg(F.count(F.lit(1)).alias("_n"), F.min(F.size("cells")).alias("_least"), F.max(F.size("cells")).alias("_most"))
    named = lambda what: F.raise_error(F.concat(F.lit(what), F.col("raster")))
    checked = shapes.join(counts, "raster", "left").select(
        "raster",
        F.when(F.col("_n").isNull(), named("raster file not found: ").cast("int"))
        .when((F.col("_n") != F.col("rows")) | (F.col("_least") != F.col("cols")) | (F.col("_most") != F.col("cols")), named("raster does not fit its header: ").cast("int"))
        .otherwise(F.lit(1)).alias("_ok"),
    )
    return checked.join(parts, "raster").filter("_ok = 1").select("raster", "row", "cells")


def read_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """Cells ``(raster, row, col, value)`` of the rasters of a folder: each header ``x.doc`` with its file ``x.img``.

    Files without a header are left out; a header without a file, or with one of another size, is an error.
    """
    base = F.regexp_extract("raster", r"([^/]*)\.[^./]*$", 1)
    headers = read_raster_headers(spark, f"{folder}/*.doc").select(base.alias("raster"), "rows", "cols")
    lines = read_lines(spark, folder, glob="*.img").withColumn("raster", base)
    cells = _fitted(lines, headers).select("raster", "row", F.posexplode("cells").alias("col", "_t"))
    return cells.select("raster", "row", "col", F.col("_t").cast("double").alias("value"))


def read_raster_series(spark: SparkSession, folder: str, name: str = "series") -> DataFrame:
    """Cells ``(step, ts_start, ts_end, factor, row, col, value)`` of a series folder.

    ``name_metadata.json`` lists the frames, ``name.hif`` gives the size of all, ``x.img`` is frame x. A frame that
    is listed and has no file, or one of another size, is an error; files that are not listed are left out.
    """
    index = read_series_index(spark, f"{folder}/{name}_metadata.json")
    header = read_raster_headers(spark, f"{folder}/{name}.hif")
    shapes = index.select(F.col("name").alias("raster"), header.select("rows").scalar().alias("rows"), header.select("cols").scalar().alias("cols"))
    base = F.regexp_extract("raster", r"([^/]*)\.img$", 1)
    rows = _fitted(read_lines(spark, folder, glob="*.img").withColumn("raster", base), shapes)
    named = rows.withColumnRenamed("raster", "name").join(index, "name")
    return named.select("step", "ts_start", "ts_end", "factor", "row", F.posexplode("cells").alias("col", "_t")).select(
        "step", "ts_start", "ts_end", "factor", "row", "col", F.col("_t").cast("double").alias("value")
    )


def read_sparse_frames(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """Wet cells ``(step, row, col, risk)`` of ``step_NNNNN`` CSV files; off-grid rows are dropped."""
    raw = spark.read.schema("row int, col int, flood_risk int").csv(path, header=True, comment="#", recursiveFileLookup=True, pathGlobFilter="*.csv")
    step = F.regexp_extract(F.col("_metadata.file_path"), r"step[_=](\d+)", 1).cast("int")
    return raw.select(step.alias("step"), "row", "col", F.col("flood_risk").alias("risk")).filter(
        F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    )
