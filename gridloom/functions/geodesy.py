"""Geographic, UTM and web-mercator coordinates as column expressions.

Transverse Mercator uses the published sixth-order Krueger series on one ellipsoid: the European and
the world datum agree to well below a cell, so they are treated as one; the 1950 datum is refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semi-major axis and flattening of the ellipsoid, UTM scale and offsets.
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EAST = 500000.0
FALSE_NORTH_SOUTH = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

# Series coefficients, row j holds the powers n^j .. n^6 of the j-th term.
_ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
_BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def _series(rows: list[list[float]]) -> list[float]:
    return [sum(c * _N ** (j + k + 1) for k, c in enumerate(row)) for j, row in enumerate(rows)]


ALPHA, BETA = _series(_ALPHA), _series(_BETA)
NEWTON_ROUNDS = 3

# First code of each block of UTM zones, with its hemisphere.
_UTM_BLOCKS = {32600: True, 25800: True, 23000: True, 32700: False}


def utm_zone(epsg: int) -> tuple[int, bool]:
    """Zone number and whether it lies north, or an error for any other system. All datums count as one ellipsoid."""
    zone, base = epsg % 100, epsg - epsg % 100
    if base not in _UTM_BLOCKS or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is not a supported UTM system")
    return zone, _UTM_BLOCKS[base]


def _lit(v: float) -> Column:
    return F.lit(float(v))


def _series_sum(df: DataFrame, coeffs: list[float], out: tuple[str, str], sign: int) -> DataFrame:
    """Add ``xi +- sum a_j sin(2j xi) cosh(2j eta)`` and ``eta +- sum a_j cos(2j xi) sinh(2j eta)``.

    Clenshaw's recurrence on the complex angle needs four function calls instead of four per term,
    which keeps the generated code small enough to be compiled.
    """
    xi2, eta2 = 2 * F.col("_xi"), 2 * F.col("_eta")
    df = df.withColumns({"_s": F.sin(xi2), "_c": F.cos(xi2), "_sh": F.sinh(eta2), "_ch": F.cosh(eta2)})
    df = df.withColumns({"_ar": 2 * F.col("_c") * F.col("_ch"), "_ai": -2 * F.col("_s") * F.col("_sh")})
    r1, i1, r2, i2 = _lit(coeffs[-1]), _lit(0), _lit(0), _lit(0)
    for k, a in reversed(list(enumerate(coeffs[:-1]))):
        names = {f"_r{k}": _lit(a) + F.col("_ar") * r1 - F.col("_ai") * i1 - r2, f"_i{k}": F.col("_ar") * i1 + F.col("_ai") * r1 - i2}
        df = df.withColumns(names)
        r1, i1, r2, i2 = F.col(f"_r{k}"), F.col(f"_i{k}"), r1, i1
    sr, si = F.col("_s") * F.col("_ch"), F.col("_c") * F.col("_sh")
    df = df.withColumns(
        {out[0]: F.col("_xi") + sign * (r1 * sr - i1 * si), out[1]: F.col("_eta") + sign * (r1 * si + i1 * sr)}
    )
    return df.drop("_s", "_c", "_sh", "_ch", "_ar", "_ai", *[f"_{p}{k}" for k in range(len(coeffs)) for p in "ri"])


def _to_utm(df: DataFrame, epsg: int) -> DataFrame:
    zone, north = utm_zone(epsg)
    lon0 = math.radians(zone * 6 - 183)
    lam = F.radians("_lon") - _lit(lon0)
    tau = F.tan(F.radians("_lat"))
    df = df.withColumns({"_lam": lam, "_tau": tau})
    sig = F.sinh(_lit(ECC) * F.atanh(_lit(ECC) * F.col("_tau") / F.sqrt(1 + F.col("_tau") ** 2)))
    df = df.withColumn("_sig", sig)
    conformal = F.col("_tau") * F.sqrt(1 + F.col("_sig") ** 2) - F.col("_sig") * F.sqrt(1 + F.col("_tau") ** 2)
    df = df.withColumn("_tp", conformal)
    xi = F.atan2(F.col("_tp"), F.cos("_lam"))
    eta = F.asinh(F.sin("_lam") / F.sqrt(F.col("_tp") ** 2 + F.cos("_lam") ** 2))
    df = df.withColumns({"_xi": xi, "_eta": eta})
    df = _series_sum(df, ALPHA, ("_nn", "_ee"), 1)
    nn, ee = F.col("_nn"), F.col("_ee")
    shift = 0.0 if north else FALSE_NORTH_SOUTH
    out = df.withColumns(
        {"x": _lit(FALSE_EAST) + _lit(SCALE * RECTIFYING) * ee, "y": _lit(shift) + _lit(SCALE * RECTIFYING) * nn}
    )
    return out.drop("_lam", "_tau", "_sig", "_tp", "_xi", "_eta", "_nn", "_ee")


def _from_utm(df: DataFrame, epsg: int) -> DataFrame:
    zone, north = utm_zone(epsg)
    shift = 0.0 if north else FALSE_NORTH_SOUTH
    df = df.withColumns(
        {
            "_xi": (F.col("y") - _lit(shift)) / _lit(SCALE * RECTIFYING),
            "_eta": (F.col("x") - _lit(FALSE_EAST)) / _lit(SCALE * RECTIFYING),
        }
    )
    df = _series_sum(df, BETA, ("_xp", "_ep"), -1)
    tp = F.sin("_xp") / F.sqrt(F.sinh("_ep") ** 2 + F.cos("_xp") ** 2)
    df = df.withColumn("_tp", tp).withColumn("_tau", F.col("_tp"))
    e2 = ECC * ECC
    for _ in range(NEWTON_ROUNDS):
        sig = F.sinh(_lit(ECC) * F.atanh(_lit(ECC) * F.col("_tau") / F.sqrt(1 + F.col("_tau") ** 2)))
        df = df.withColumn("_sig", sig)
        guess = F.col("_tau") * F.sqrt(1 + F.col("_sig") ** 2) - F.col("_sig") * F.sqrt(1 + F.col("_tau") ** 2)
        df = df.withColumn("_gp", guess)
        better = F.col("_tau") + (F.col("_tp") - F.col("_gp")) / F.sqrt(1 + F.col("_gp") ** 2) * (
            1 + _lit(1 - e2) * F.col("_tau") ** 2
        ) / (_lit(1 - e2) * F.sqrt(1 + F.col("_tau") ** 2))
        df = df.withColumn("_tau", better)
    lon = F.degrees(F.atan2(F.sinh("_ep"), F.cos("_xp"))) + _lit(zone * 6 - 183)
    out = df.withColumns({"_lon": lon, "_lat": F.degrees(F.atan("_tau"))})
    return out.drop("_xi", "_eta", "_xp", "_ep", "_tp", "_tau", "_sig", "_gp")


def reproject(points: DataFrame, source: int, target: int, same_hemisphere: bool = False) -> DataFrame:
    """Rewrite ``x, y`` (easting/longitude first) from one EPSG code to another.

    With ``same_hemisphere`` a point that lies in the other hemisphere than the target's UTM zone is an error when it is
    read; the equator is north.
    """
    if source == target:
        return points
    if source == 4326:
        df = points.withColumns({"_lon": F.col("x"), "_lat": F.col("y")})
    elif source == 3857:
        k = _lit(AXIS)
        df = points.withColumns(
            {
                "_lon": F.degrees(F.col("x") / k),
                "_lat": F.degrees(2 * F.atan(F.exp(F.col("y") / k)) - _lit(math.pi / 2)),
            }
        )
    else:
        df = _from_utm(points, source)
    if target == 4326:
        out = df.withColumns({"x": F.col("_lon"), "y": F.col("_lat")})
    elif target == 3857:
        out = df.withColumns(
            {
                "x": F.radians("_lon") * _lit(AXIS),
                "y": F.asinh(F.tan(F.radians("_lat"))) * _lit(AXIS),
            }
        )
    else:
        if same_hemisphere:
            wrong = F.raise_error(F.lit(f"coordinates in the wrong hemisphere for EPSG:{target}")).cast("double")
            df = df.withColumn("_lat", F.when((F.col("_lat") >= 0) != F.lit(utm_zone(target)[1]), wrong).otherwise(F.col("_lat")))
        out = _to_utm(df, target)
    # A generator is a fence: a later filter on x or y is not pushed below it, where it would be
    # rewritten in terms of the input and repeat the whole series many times over.
    rest = [c for c in points.columns if c not in ("x", "y")]
    return out.select(*rest, F.inline(F.array(F.struct("x", "y"))))
