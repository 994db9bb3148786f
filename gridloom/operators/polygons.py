"""Polygon features to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.gridspec import GridSpec


def ring_edges(features: DataFrame) -> DataFrame:
    """One row per ring edge, the ring closed if needed; holes come as more ``rings`` of a feature."""
    if "rings" in features.columns:
        features = features.withColumn("ring", F.explode("rings"))
    ring = F.col("ring")
    ends = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.array(F.element_at(ring, 1)))
    pairs = F.arrays_zip(ring.alias("p"), ends.alias("q"))
    return features.select("feature_id", "ord", "class", F.explode(pairs).alias("e")).select(
        "feature_id", "ord", "class",
        F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"),
    )


def rasterize(features: DataFrame, spec: GridSpec, default: int = 0) -> DataFrame:
    """Class of the last feature (by its own ``ord``) whose even-odd interior holds the cell centre.

    An edge is copied only to the grid rows it crosses. Its crossings, ordered along the row, pair up
    into spans, and a span names its cells directly: no cell is ever tested against a polygon.
    """
    cell, top, left = F.lit(spec.cell), F.lit(spec.max_y), F.lit(spec.min_x)
    e = ring_edges(features).filter(F.col("y0") != F.col("y1"))
    hi, lo = F.greatest("y0", "y1"), F.least("y0", "y1")
    # Row r has its centre at max_y - (r + 0.5) * cell; the edge covers centres in (lo, hi].
    first = F.greatest(F.ceil((top - hi) / cell - 0.5), F.lit(0))
    last = F.least(F.ceil((top - lo) / cell - 0.5) - 1, F.lit(spec.rows - 1))
    rows = e.withColumns({"_r0": first, "_r1": last}).filter(F.col("_r0") <= F.col("_r1"))
    rows = rows.withColumn("row", F.explode(F.sequence(F.col("_r0").cast("int"), F.col("_r1").cast("int"))))
    yc = top - (F.col("row") + 0.5) * cell
    xc = F.col("x0") + (yc - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    cross = rows.select("feature_id", "ord", "class", "row", xc.alias("x"))
    w = Window.partitionBy("feature_id", "row").orderBy("x")
    spans = cross.withColumns({"_n": F.row_number().over(w), "_to": F.lead("x").over(w)}).filter(F.col("_n") % 2 == 1)
    # A centre lies in the span when x < centre <= x_to.
    c0 = F.greatest(F.floor((F.col("x") - left) / cell - 0.5) + 1, F.lit(0))
    c1 = F.least(F.floor((F.col("_to") - left) / cell - 0.5), F.lit(spec.cols - 1))
    hit = spans.withColumns({"_c0": c0, "_c1": c1}).filter(F.col("_c0") <= F.col("_c1"))
    burnt = hit.select("row", F.explode(F.sequence(F.col("_c0").cast("int"), F.col("_c1").cast("int"))).alias("col"), "ord", "class")
    top_class = burnt.groupBy("row", "col").agg(F.max_by("class", "ord").alias("class"))
    return spec.frame(features.sparkSession).join(top_class, ["row", "col"], "left").withColumn(
        "class", F.coalesce("class", F.lit(default)).cast("int")
    )


def dedupe_features(features: DataFrame, order: str = "tile_order", tie: str = "class") -> DataFrame:
    """One row per feature id, the one from the last tile."""
    rest = [c for c in features.columns if c != "feature_id"]
    return features.groupBy("feature_id").agg(
        F.max_by(F.struct(*rest), F.struct(order, tie)).alias("_f")
    ).select("feature_id", "_f.*")


def truncation_audit(tiles: DataFrame) -> DataFrame:
    """Tiles that hold back features: matched and returned both known and matched larger."""
    return tiles.filter(F.col("matched") > F.col("returned")).withColumn("missing", F.col("matched") - F.col("returned"))
