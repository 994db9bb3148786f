"""Growing regions: connected cells through tile contraction and label propagation."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import div
from gridloom.session import cut

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 64


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest cell id of each 8-connected group inside one tile (at most TILE*TILE cells)."""
    r = pdf["row"].to_numpy() % TILE + 1
    c = pdf["col"].to_numpy() % TILE + 1
    big = np.iinfo(np.int64).max
    lab = np.full((TILE + 2, TILE + 2), big, dtype=np.int64)
    lab[r, c] = pdf["cell"].to_numpy()
    open_ = lab != big
    while True:
        rows = np.minimum(np.minimum(lab[:, :-2], lab[:, 2:]), lab[:, 1:-1])
        best = lab.copy()
        best[1:-1, 1:-1] = np.minimum(np.minimum(rows[:-2], rows[2:]), rows[1:-1])
        best[~open_] = big
        if (best == lab).all():
            break
        lab = best
    return pdf.assign(node=lab[r, c])[["row", "col", "cell", "node"]]


def _least(offers: DataFrame) -> DataFrame:
    """Least label offered to each node, with the label it had."""
    return offers.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))


def grow_region(cells: DataFrame, cols: int, seed: int, through: list[int], key: str = "land_cover") -> DataFrame:
    """Turn into ``seed`` every cell 8-connected to a seed cell through cells of the listed classes.

    Cells are first labelled inside fixed tiles (a bounded group each), which leaves one node per
    tile-local group. Labels then spread over the short list of touching nodes by minimum: in each
    round a node takes the least label around it, tells its former label of it, and jumps to its
    label's label, so a long chain of tiles does not take a round per tile. Labels only fall, so the
    rounds end; every round is written to the shared folder.
    """
    base = cells.select("row", "col", key)
    open_ = base.filter(F.col(key).isin([seed, *through])).withColumns(
        {
            "cell": F.col("row").cast("long") * cols + F.col("col"),
            "tr": div(F.col("row"), TILE),
            "tc": div(F.col("col"), TILE),
        }
    )
    nodes = cut(
        open_.groupBy("tr", "tc").applyInPandas(_label_tile, "row int, col int, cell long, node long"), "labels"
    )
    # Only cells on a tile border can touch another tile.
    edge = nodes.filter(
        F.pmod("row", F.lit(TILE)).isin(0, TILE - 1) | F.pmod("col", F.lit(TILE)).isin(0, TILE - 1)
    )
    around = F.array(
        *[
            F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"))
            for dr in (-1, 0, 1)
            for dc in (-1, 0, 1)
            if dr or dc
        ]
    )
    seen = edge.select(F.col("node").alias("a"), F.inline(around)).join(
        edge.select("row", "col", F.col("node").alias("b")), ["row", "col"]
    )
    links = cut(seen.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")

    labels = cut(links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    nothing = F.lit(None).cast("long").alias("old")
    while True:
        offered = links.join(labels, links["b"] == labels["node"]).select(F.col("a").alias("node"), "label", nothing)
        lower = _least(labels.select("node", "label", F.col("label").alias("old")).unionByName(offered))
        hooks = lower.filter(F.col("label") < F.col("old")).select(F.col("old").alias("node"), "label", nothing)
        hooked = _least(lower.unionByName(hooks))
        hop = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        labels = cut(
            hooked.join(hop, hooked["label"] == hop["_n"], "left").select(
                "node", F.least("label", F.coalesce("_l", F.col("label"))).alias("label"), "old"
            ),
            "round",
        )
        if labels.filter(F.col("label") < F.col("old")).isEmpty():
            break

    group = F.coalesce("label", F.col("node"))
    tagged = nodes.join(labels, "node", "left").select("row", "col", group.alias("grp"))
    sea = base.filter(F.col(key) == seed).select("row", "col")
    reached = tagged.join(sea, ["row", "col"], "left_semi").select("grp").distinct()
    grown = tagged.join(reached, "grp", "left_semi").select("row", "col", F.lit(True).alias("_in"))
    return base.join(grown, ["row", "col"], "left").select(
        "row", "col", F.when(F.col("_in"), F.lit(seed)).otherwise(F.col(key)).cast("int").alias(key)
    )
