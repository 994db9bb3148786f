"""Station lists, aliases, page data, report lines and polygon features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.operators.layers import map_class_codes

STATION_SCHEMA = "station_id string, x double, y double, epsg int, location string, province string"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATION_SCHEMA).csv(path, header=True)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Pairs ``(station_id, alias)`` of JSON objects of id to names, one object per file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("station_id", "names")).select(
        "station_id", F.explode("names").alias("alias")
    )


def extract_page_json(
    pages: DataFrame, var: str, fields: dict[str, str], numbers: list[str], keyword: str = "let", html: str = "html"
) -> DataFrame:
    """Entries of the array assigned to a script variable in HTML pages.

    ``fields`` maps output columns to JSON keys. The value is the text between the variable's ``=``
    and the next ``];``. Entries that miss a key or whose ``numbers`` are not numeric are skipped,
    the rest of the page is kept.
    """
    pattern = rf"(?s){keyword}\s+{var}\s*=\s*(\[.*?\]);"
    schema = "array<struct<" + ",".join(f"`{k}`:string" for k in fields.values()) + ">>"
    rest = [c for c in pages.columns if c != html]
    items = (
        pages.withColumn("_j", F.regexp_extract(html, pattern, 1))
        .filter(F.col("_j") != "")
        .select(*rest, F.posexplode(F.from_json("_j", schema)).alias("pos", "i"))
    )
    value = lambda out, key: (
        F.col(f"i.`{key}`").try_cast("double") if out in numbers else F.col(f"i.`{key}`")
    ).alias(out)
    cols = items.select(*rest, "pos", *[value(o, k) for o, k in fields.items()])
    return cols.dropna(subset=list(fields))


def parse_report_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Station name (upper case) and value of lines that end in a decimal number."""
    t = F.trim(text)
    pattern = r"^(.+)\s(\d+\.\d+)$"
    return lines.filter(t.rlike(pattern)).withColumns(
        {
            "name": F.upper(F.trim(F.regexp_extract(t, pattern, 1))),
            "value": F.regexp_extract(t, pattern, 2).cast("double"),
        }
    )


_RING = "struct<LinearRing: struct<posList: string>>"
_POLYGON = f"struct<exterior: {_RING}, interior: array<{_RING}>>"
_PATCHES = f"struct<PolygonPatch: array<{_POLYGON}>>"
_SURFACE = f"Polygon: array<{_POLYGON}>, Surface: array<struct<patches: {_PATCHES}>>"
FEATURE_SCHEMA = (
    f"_id string, class struct<_href: string>, geometry struct<{_SURFACE}, MultiSurface: struct<"
    f"surfaceMember: array<struct<{_SURFACE}>>, surfaceMembers: struct<{_SURFACE}>>>"
)


def _points(text: Column) -> Column:
    """Pairs ``x, y`` of a blank-separated list."""
    nums = F.transform(F.filter(F.split(text, r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(nums) - 2, F.lit(0))), lambda i: i % 2 == 0),
        lambda i: F.struct(F.get(nums, i).alias("x"), F.get(nums, i + 1).alias("y")),
    )


def _polygons(surface: Column) -> Column:
    """All polygons of a geometry or member: its own and the patches of its surfaces."""
    none = F.array().cast(f"array<{_POLYGON}>")
    patches = F.flatten(F.transform(surface["Surface"], lambda s: F.coalesce(s["patches"]["PolygonPatch"], none)))
    return F.concat(F.coalesce(surface["Polygon"], none), F.coalesce(patches, none))


def read_features(spark: SparkSession, path: str, row_tag: str = "LandCoverUnit") -> DataFrame:
    """Polygon features ``(feature_id, class, rings)``; ones without an id are dropped.

    A geometry is a polygon, a surface of patches or a multi-surface of both. Rings are listed polygon by
    polygon, the outer one first. Of any other geometry ``rings`` is empty; ``features_without_rings``
    keeps such features apart.

    Name prefixes are ignored. The class is the last path segment of the class link, mapped through
    the code list.
    """
    raw = spark.read.format("xml").options(rowTag=row_tag, ignoreNamespace="true").schema(FEATURE_SCHEMA).load(path)
    none = F.array().cast(f"array<{_POLYGON}>")
    multi = F.col("geometry.MultiSurface")
    members = F.flatten(F.transform(multi["surfaceMember"], _polygons))
    polygons = F.concat(_polygons(F.col("geometry")), F.coalesce(members, none), _polygons(multi["surfaceMembers"]))
    lists = F.transform(polygons, lambda p: F.concat(
        F.array(p["exterior"]["LinearRing"]["posList"]),
        F.coalesce(F.transform(p["interior"], lambda r: r["LinearRing"]["posList"]), F.array().cast("array<string>")),
    ))
    texts = F.filter(F.flatten(lists), lambda t: F.trim(t) != "")
    base = raw.filter(F.col("_id").isNotNull()).select(
        F.col("_id").alias("feature_id"), F.element_at(F.split("class._href", "/"), -1).alias("code"), F.transform(texts, _points).alias("rings")
    )
    return map_class_codes(base, K.LAND_COVER_CODES).select("feature_id", "class", "rings")


def features_without_rings(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features with at least one ring, and the others."""
    has = F.size("rings") > 0
    return features.filter(has), features.filter(~has)
