"""Neighbourhood operators on cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import cells as cx
from gridloom.gridspec import GridSpec

RC = ["row", "col"]

# The eight directions as (name, row offset, column offset), row 0 in the north.
DIRECTIONS = [
    ("n", -1, 0), ("s", 1, 0), ("e", 0, 1), ("w", 0, -1),
    ("ne", -1, 1), ("nw", -1, -1), ("se", 1, 1), ("sw", 1, -1),
]

# Physical constants of the routing pass.
GRAVITY = 9.81
WALL = 9999.0
NEAR_ZERO = 1e-5
VISCOSITY_GUARD = 1e-8


def neighbours(cells: DataFrame, spec: GridSpec, value: str, pad: float = 0.0, carry: list[str] | None = None,
               directions: list[tuple[str, int, int]] = DIRECTIONS) -> DataFrame:
    """Each cell with its neighbours' values in one column per direction; off-grid is ``pad``.

    A cell sends its value to every cell that sees it, and one aggregation collects what arrived:
    one shuffle instead of one join per direction. On input clustered by row the partial
    aggregation folds the copies before they are shuffled.
    """
    carry = carry or []
    sent = [
        F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"),
                 F.lit(name).alias("dir"), F.col(value).cast("double").alias("v"),
                 *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in carry])
        for name, dr, dc in directions
    ]
    own = F.struct(F.col("row").alias("row"), F.col("col").alias("col"), F.lit("self").alias("dir"),
                   F.col(value).cast("double").alias("v"), *[F.col(c) for c in carry])
    spread = cells.select(F.inline(F.array(own, *sent))).filter(
        F.col("row").between(0, spec.rows - 1) & F.col("col").between(0, spec.cols - 1)
    )
    at = lambda d: F.max(F.when(F.col("dir") == d, F.col("v")))
    return (
        spread.groupBy(*RC)
        .agg(
            at("self").alias(value),
            *[F.coalesce(at(n), F.lit(float(pad))).alias(n) for n, _, _ in directions],
            *[F.max(c).alias(c) for c in carry],
            F.max((F.col("dir") == "self").cast("int")).alias("_own"),
        )
        .filter(F.col("_own") == 1)
        .drop("_own")
    )


def _reach(dr: int, dc: int, dx: float) -> float:
    return dx * math.sqrt(2.0) if dr and dc else dx


def downslope(cells: DataFrame, spec: GridSpec, dx: float, height: str = "height", moving: str = "moving",
              carry: list[str] | None = None) -> DataFrame:
    """Slope towards every direction: drop over distance, 0 uphill and where the cell is at rest."""
    near = neighbours(cells, spec, height, WALL, [moving, *(carry or [])])
    slopes = F.array(
        *[
            F.struct(
                F.lit(n).alias("dir"),
                (F.greatest(F.col(height) - F.col(n), F.lit(0.0)) / F.lit(_reach(dr, dc, dx)) * F.col(moving)).alias("slope"),
            )
            for n, dr, dc in DIRECTIONS
        ]
    )
    return near.select(*RC, *(carry or []), F.inline(slopes))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def route_once(cells: DataFrame, spec: GridSpec, dx: float, dt: float, density: float, viscosity: float) -> DataFrame:
    """One volume-conserving redistribution pass over ``(row, col, height, depth, roughness, moving)``.

    Two shuffles by cell: one gathers the neighbours' levels, one sums what flows in. The eight
    outflows of a cell stay in one row as an array, so scaling them needs no shuffle.
    """
    level = cells.withColumns({"_level": F.col("height") + F.col("depth"), "moving": F.col("moving").cast("int")})
    near = neighbours(level, spec, "_level", WALL, ["depth", "roughness", "moving"])
    d = F.col("depth")
    area = dx * dx

    def attempt(name: str, dr: int, dc: int) -> Column:
        slope = F.greatest(F.col("_level") - F.col(name), F.lit(0.0)) / F.lit(_reach(dr, dc, dx)) * F.col("moving")
        turbulent = _ratio(F.lit(1.0), F.col("roughness")) * F.pow(d, F.lit(2.0 / 3.0)) * F.sqrt(slope)
        laminar = F.lit(density * GRAVITY) * d * d * slope / F.lit(3.0 * viscosity + VISCOSITY_GUARD)
        return F.least(turbulent, laminar) * d * F.lit(dx) * F.lit(dt)

    tried = near.withColumns({f"_q_{n}": attempt(n, dr, dc) for n, dr, dc in DIRECTIONS})
    total = sum((F.col(f"_q_{n}") for n, _, _ in DIRECTIONS[1:]), F.col(f"_q_{DIRECTIONS[0][0]}"))
    tried = tried.withColumn("_try", total)
    tried = tried.withColumn("_alpha", _ratio(F.least("_try", d * area), F.col("_try")))
    out = F.col("_try") * F.col("_alpha")
    flows = F.array(
        F.struct(F.col("row").alias("row"), F.col("col").alias("col"), d.alias("depth"), out.alias("outflow"), F.lit(0.0).alias("inflow")),
        *[
            F.struct(
                (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(None).cast("double").alias("depth"),
                F.lit(0.0).alias("outflow"), (F.col(f"_q_{n}") * F.col("_alpha")).alias("inflow"),
            )
            for n, dr, dc in DIRECTIONS
        ],
    )
    moved = tried.select(F.inline(flows)).filter(F.col("depth").isNotNull() | (F.col("inflow") > 0))
    summed = moved.groupBy(*RC).agg(F.max("depth").alias("depth"), F.sum("outflow").alias("outflow"), F.sum("inflow").alias("inflow"))
    after = F.col("depth") - F.col("outflow") / area + F.col("inflow") / area
    return summed.select(
        *RC,
        F.when(after < NEAR_ZERO, F.lit(0.0)).otherwise(after).alias("depth"),
        ((F.col("outflow") > NEAR_ZERO) | (F.col("inflow") > NEAR_ZERO)).cast("int").alias("moving"),
    )


def hillshade(cells: DataFrame, spec: GridSpec, value: str = "height", azimuth: float = 315.0, altitude: float = 45.0,
              z: float = 4.0) -> DataFrame:
    """Shade in 0..1 from central differences, one-sided at the edges."""
    four = [d for d in DIRECTIONS if d[0] in ("n", "s", "e", "w")]
    near = neighbours(cells, spec, value, 0.0, directions=four)
    v, r, c = F.col(value), F.col("row"), F.col("col")

    def diff(lo: str, hi: str, pos: Column, last: int) -> Column:
        return (
            F.when(pos == 0, F.col(hi) - v)
            .when(pos == last, v - F.col(lo))
            .otherwise((F.col(hi) - F.col(lo)) / 2)
        )

    near = near.withColumns({"_dy": -diff("n", "s", r, spec.rows - 1), "_dx": diff("w", "e", c, spec.cols - 1)})
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    slope = F.atan(F.lit(z) * F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    near = near.withColumns({"_slope": slope, "_aspect": F.atan2("_dy", "_dx")})
    shade = F.lit(math.cos(alt)) * F.cos("_slope") + F.lit(math.sin(alt)) * F.sin("_slope") * F.cos(F.lit(az) - F.col("_aspect"))
    return near.select(*RC, F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)).alias("shade"))


def gradient_shade(cells: DataFrame, spec: GridSpec, value: str = "height") -> DataFrame:
    """Inverted, normalised 3x3 gradient magnitude of the layer scaled to 0..255.

    The border mirrors the inner neighbour. Both normalisations take their range from scalar
    subqueries.
    """
    lo_hi = cells.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    based = cells.select(*RC, F.col(value), lo_hi.alias("_s"))
    unit = (F.col(value) - F.col("_s.lo")) * 255.0 / F.nullif(F.col("_s.hi") - F.col("_s.lo"), F.lit(0.0))
    grey = based.select(*RC, F.coalesce(F.rint(F.least(F.greatest(unit, F.lit(0.0)), F.lit(255.0))), F.lit(0.0)).alias("g"))
    near = neighbours(grey, spec, "g", 0.0)
    top, bottom = F.col("row") == 0, F.col("row") == spec.rows - 1
    left, right = F.col("col") == 0, F.col("col") == spec.cols - 1

    def at(dr: int, dc: int) -> Column:
        name = {(a, b): n for n, a, b in DIRECTIONS}
        vertical = lambda c_: (
            F.when(F.lit(dr == -1) & top, F.col(name[(1, c_)])).when(F.lit(dr == 1) & bottom, F.col(name[(-1, c_)])).otherwise(F.col(name[(dr, c_)]))
            if dr else F.col(name[(0, c_)]) if c_ else F.col("g")
        )
        if dc == 0:
            return vertical(0)
        flipped = left if dc == -1 else right
        return F.when(flipped, vertical(-dc)).otherwise(vertical(dc))

    gx = (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))
    gy = (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))
    mag = near.select(*RC, (F.abs(gx) + F.abs(gy)).alias("m"))
    span = mag.agg(F.struct(F.min("m").alias("lo"), F.max("m").alias("hi")).alias("s")).scalar()
    scaled = mag.select(*RC, "m", span.alias("_s"))
    shade = F.rint((F.col("m") - F.col("_s.lo")) * 255.0 / F.nullif(F.col("_s.hi") - F.col("_s.lo"), F.lit(0.0)))
    return scaled.select(*RC, (F.lit(255) - F.coalesce(shade, F.lit(0.0))).cast("int").alias("shade"))
