"""Column expressions on cells: index maths, units, clean-up and simple rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.gridspec import GridSpec


def div(a: Column, b: int) -> Column:
    """Floor division of integers, also for negatives."""
    return F.floor(a / F.lit(b)).cast("long")


def row_of(idx: Column, cols: int) -> Column:
    return div(idx, cols).cast("int")


def col_of(idx: Column, cols: int) -> Column:
    return F.pmod(idx, F.lit(cols)).cast("int")


def index_of(row: Column, col: Column, cols: int) -> Column:
    return row.cast("long") * F.lit(cols).cast("long") + col


def centre_x(col: Column, spec: GridSpec) -> Column:
    return F.lit(spec.min_x) + (col + F.lit(0.5)) * F.lit(spec.cell)


def centre_y(row: Column, spec: GridSpec) -> Column:
    return F.lit(spec.max_y) - (row + F.lit(0.5)) * F.lit(spec.cell)


def inside(x: Column, y: Column, spec: GridSpec) -> Column:
    """Inclusive on all four edges."""
    return x.between(spec.min_x, spec.max_x) & y.between(spec.min_y, spec.max_y)


def row_at(y: Column, spec: GridSpec) -> Column:
    """Row holding ``y``; a point exactly on the far edge belongs to the last row."""
    raw = F.floor((F.lit(spec.max_y) - y) / F.lit(spec.cell))
    return F.least(raw, F.lit(spec.rows - 1)).cast("int")


def col_at(x: Column, spec: GridSpec) -> Column:
    raw = F.floor((x - F.lit(spec.min_x)) / F.lit(spec.cell))
    return F.least(raw, F.lit(spec.cols - 1)).cast("int")


def view_bounds(spec: GridSpec, box: tuple[float, float, float, float] | None):
    """Index window ``(row0, row1, col0, col1)``, ends exclusive, of a box or of the whole grid."""
    if box is None:
        return 0, spec.rows, 0, spec.cols
    west, south, east, north = box

    def clamp(v, hi):
        return max(0, min(hi, int(v)))

    return (
        clamp(math.floor((spec.max_y - north) / spec.cell), spec.rows),
        clamp(math.ceil((spec.max_y - south) / spec.cell), spec.rows),
        clamp(math.floor((west - spec.min_x) / spec.cell), spec.cols),
        clamp(math.ceil((east - spec.min_x) / spec.cell), spec.cols),
    )


def mmh_to_m_per_step(mmh: Column, dt_seconds: float) -> Column:
    """Rain rate in mm/h to metres of water per step."""
    return mmh * F.lit(0.001) * F.lit(float(dt_seconds)) / F.lit(3600.0)


def fill_nodata(value: Column, below: float, inclusive: bool = False, fill: float = 0.0) -> Column:
    """Replace sentinels: values below (or at, if inclusive) a limit become ``fill``."""
    bad = value <= F.lit(below) if inclusive else value < F.lit(below)
    return F.when(bad, F.lit(fill)).otherwise(value)


def sanitise(value: Column) -> Column:
    """NaN becomes 0, infinities +-1000, the rest is clipped to [-1000, 10000]."""
    finite = (
        F.when(F.isnan(value), F.lit(0.0))
        .when(value == F.lit(float("inf")), F.lit(1000.0))
        .when(value == F.lit(float("-inf")), F.lit(-1000.0))
        .otherwise(value)
    )
    return F.least(F.greatest(finite, F.lit(-1000.0)), F.lit(10000.0))


def clamp_min(value: Column, low: float = 0.0) -> Column:
    return F.greatest(value, F.lit(low))


def surface(terrain: Column, depth: Column, minimum: float = 0.0005) -> Column:
    """Water surface where the depth reaches the minimum, bare terrain elsewhere."""
    return F.when(depth >= F.lit(minimum), terrain + depth).otherwise(terrain)


def is_wet(depth: Column, dry_tolerance: float) -> Column:
    return depth >= F.lit(dry_tolerance)


def risk_level(depth: Column, levels: list[tuple[int, str, float]]) -> Column:
    """Highest level whose threshold does not exceed the depth; level 0 below all of them."""
    ordered = sorted(levels, key=lambda lv: lv[2])
    out = F.lit(0)
    for level, _, threshold in ordered:
        out = F.when(depth >= F.lit(float(threshold)), F.lit(level)).otherwise(out)
    return out.cast("int")


def level_threshold(level: Column, levels: list[tuple[int, str, float]]) -> Column:
    """Threshold of a level, the level clipped to the table."""
    ordered = sorted(levels, key=lambda lv: lv[0])
    table = F.array(*[F.lit(float(t)) for _, _, t in ordered])
    clipped = F.greatest(F.least(level, F.lit(len(ordered) - 1)), F.lit(0))
    return F.element_at(table, (clipped + 1).cast("int"))


def elevation_band(height: Column, bands: list[tuple]) -> Column:
    """Struct ``band, r, g, b`` of the band with ``previous < height <= limit``; null above all."""
    out = F.lit(None).cast("struct<band:int,r:int,g:int,b:int>")
    for i in range(len(bands) - 1, -1, -1):
        limit, r, g, b = bands[i]
        colour = F.struct(*[F.lit(v).cast("int").alias(n) for n, v in zip("band r g b".split(), (i, r, g, b))])
        out = F.when(height <= F.lit(float(limit)), colour).otherwise(out)
    return out


def height_rgb(height: Column) -> Column:
    """Elevation packed into three bytes: value = height + 32768."""
    v = F.least(F.greatest(height + F.lit(32768.0), F.lit(0.0)), F.lit(65535.99))
    whole = F.floor(v)
    return F.struct(
        F.floor(v / 256).cast("int").alias("r"),
        F.pmod(whole, F.lit(256)).cast("int").alias("g"),
        F.floor((v - whole) * 256).cast("int").alias("b"),
    )


def level_rgba(level: Column, palette: list[tuple]) -> Column:
    """Palette colour of a level clipped to the palette; dry cells are transparent."""
    colours = F.array(
        *[
            F.struct(F.lit(e[3]).alias("r"), F.lit(e[4]).alias("g"), F.lit(e[5]).alias("b"))
            for e in sorted(palette, key=lambda e: e[0])
        ]
    )
    clipped = F.greatest(F.least(level, F.lit(len(palette) - 1)), F.lit(0)).cast("int")
    colour = F.element_at(colours, clipped + 1)
    return F.struct(
        colour["r"].alias("r"),
        colour["g"].alias("g"),
        colour["b"].alias("b"),
        F.when(level > 0, F.lit(200)).otherwise(F.lit(0)).alias("a"),
    )
