"""Frames ``(step, idx, risk, depth)``, their deltas, and checks on them.

Frames are sparse: a cell that is absent from a step is dry there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.running import running
from gridloom.gridspec import GridSpec


def snapshot_every(frames: DataFrame, n: int) -> DataFrame:
    """Every n-th step and the last one."""
    last = frames.agg(F.max("step").alias("m")).scalar()
    return frames.filter((F.pmod("step", F.lit(n)) == 0) | (F.col("step") == last))


def _next_steps(frames: DataFrame) -> DataFrame:
    """Published steps with their successor: one row per frame, not per cell."""
    w = Window.orderBy("step")
    return frames.select("step").distinct().withColumn("next_step", F.lead("step").over(w))


def frame_diff(frames: DataFrame) -> DataFrame:
    """Cells whose risk differs from the previous published frame, with their new risk and depth.

    Each row is sent to its own step and, as "previous", to the next published step; one
    aggregation on ``(step, idx)`` compares them. No self-join, and cells that dry out appear.
    """
    now = frames.select("step", "idx", F.col("risk"), F.col("depth"), F.lit(None).cast("int").alias("prev"))
    before = (
        frames.filter(F.col("risk") > 0)
        .join(_next_steps(frames).filter(F.col("next_step").isNotNull()), "step")
        .select(
            F.col("next_step").alias("step"),
            "idx",
            F.lit(None).cast("int").alias("risk"),
            F.lit(None).cast("double").alias("depth"),
            F.col("risk").alias("prev"),
        )
    )
    both = now.unionByName(before).groupBy("step", "idx").agg(
        F.coalesce(F.max("risk"), F.lit(0)).alias("risk"),
        F.coalesce(F.max("depth"), F.lit(0.0)).alias("depth"),
        F.coalesce(F.max("prev"), F.lit(0)).alias("prev"),
    )
    return both.filter(F.col("risk") != F.col("prev")).drop("prev")


def initial_delta(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("risk") > 0).select("idx", "risk", "depth")


def apply_deltas(deltas: DataFrame, last_step: int | Column, cells: int, base: DataFrame | None = None) -> DataFrame:
    """State of every touched cell at every step up to ``last_step``.

    A delta holds from its step until the cell's next delta, so each cell is expanded between its
    own neighbours. A base frame counts as a delta before step 0. Out-of-grid indexes are ignored.
    """
    src = deltas.select("step", "idx", "risk", "depth")
    if base is not None:
        src = src.unionByName(base.select(F.lit(-1).cast(src.schema["step"].dataType).alias("step"), "idx", "risk", "depth"))
    src = src.filter((F.col("idx") >= 0) & (F.col("idx") < cells) & (F.col("step") <= last_step))
    w = Window.partitionBy("idx").orderBy("step")
    until = F.coalesce(F.lead("step").over(w), F.lit(last_step + 1)) - 1
    held = src.withColumns({"_from": F.greatest("step", F.lit(0)), "_to": until}).filter(F.col("_from") <= F.col("_to"))
    return held.select(F.explode(F.sequence("_from", "_to")).alias("step"), "idx", "risk", "depth")


def ever_wet(frames: DataFrame) -> DataFrame:
    return frames.groupBy("idx").agg((F.max("risk") > 0).alias("wet"))


def assign_chunks(deltas: DataFrame, chunk: int, batch: int, block: int = 1 << 16) -> DataFrame:
    """Chunk and batch number of each delta in index order, and the chunk total of its step."""
    one = F.lit(1).cast("long")
    ranked = running(deltas, ["step"], "idx", {"_up": ("sum", one)}, {"_down": ("sum", one)}, block)
    rank = F.col("_up") - 1
    total = F.col("_up") + F.col("_down") - 1
    c = F.floor(rank / chunk)
    return ranked.withColumns(
        {
            "chunk": c.cast("long"),
            "total_chunks": F.floor((total + (chunk - 1)) / chunk).cast("long"),
            "batch": F.floor(c / batch).cast("long"),
        }
    ).drop("_up", "_down")


def frame_summary(frames: DataFrame, deltas: DataFrame) -> DataFrame:
    """Wet and changed cells per frame, in one pass over the union of both tables."""
    wet = frames.groupBy("step").agg(F.sum((F.col("risk") > 0).cast("long")).alias("wet"), F.lit(0).cast("long").alias("changed"))
    chg = deltas.groupBy("step").agg(F.lit(0).cast("long").alias("wet"), F.count(F.lit(1)).alias("changed"))
    return wet.unionByName(chg).groupBy("step").agg(F.sum("wet").alias("wet"), F.sum("changed").alias("changed"))


def densify(frames: DataFrame, spec: GridSpec, last_step: int | Column) -> DataFrame:
    """Every cell of every step from 0; absent cells are 0."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(last_step)))
    grid = frames.sparkSession.range(spec.cells).select(steps.alias("step"), F.col("id").alias("idx"))
    vals = frames.select(F.col("step").cast("int").alias("step"), "idx", "risk", "depth")
    return grid.join(vals, ["step", "idx"], "left").withColumns(
        {"risk": F.coalesce("risk", F.lit(0)), "depth": F.coalesce("depth", F.lit(0.0))}
    )


def drop_repeated_frames(saves: DataFrame) -> DataFrame:
    """Saves ``(save_no, step)`` kept after skipping those equal to the one before with the same step.

    Equality is decided on two independent 64-bit fingerprints and the cell count, each an
    order-free sum, so a save is never gathered in one place.
    """
    wet = F.col("risk") > 0
    sig = lambda *c: F.coalesce(F.sum(F.when(wet, F.xxhash64(*c).cast("decimal(38,0)"))), F.lit(0))
    prints = saves.groupBy("save_no", "step").agg(
        F.struct(sig("idx", "risk"), sig("risk", "idx"), F.count(F.when(wet, 1))).alias("print")
    )
    w = Window.orderBy("save_no")
    before = F.lag(F.struct("step", "print")).over(w)
    same = F.coalesce(before == F.struct("step", "print"), F.lit(False))
    return prints.withColumn("_same", same).filter(~F.col("_same")).select("save_no", "step")


def volume(frames: DataFrame, cell: float, tolerance: float = 0.005) -> DataFrame:
    """Water volume per step and its relative change against the first step."""
    per = frames.groupBy("step").agg((F.sum("depth") * (cell * cell)).alias("volume"))
    first = per.agg(F.min_by("volume", "step")).scalar()
    change = F.when(first == 0, F.lit(0.0)).otherwise(F.abs(F.col("volume") - first) / F.nullif(first, F.lit(0.0)))
    return per.withColumn("change", change).withColumn("ok", F.col("change") <= tolerance)


def drift(frames: DataFrame, a: int, b: int, tolerance: float = 1e-4) -> DataFrame:
    """Cells whose depth differs by more than the tolerance between steps ``a`` and ``b``."""
    pick = lambda s: F.coalesce(F.max(F.when(F.col("step") == s, F.col("depth"))), F.lit(0.0))
    both = frames.filter(F.col("step").isin(a, b)).groupBy("idx").agg(pick(a).alias("before"), pick(b).alias("after"))
    return both.filter(F.abs(F.col("after") - F.col("before")) > tolerance)


def mirror_check(frame: DataFrame, spec: GridSpec, value: str, tolerance: float = 1e-2) -> DataFrame:
    """Mirrored cell pairs that differ: left/right, top/bottom and across the main diagonal.

    Both cells of a pair are sent to one canonical key, so the check is one aggregation.
    """
    r, c = F.col("row"), F.col("col")
    mirrors = F.array(
        F.struct(F.lit("left_right").alias("kind"), r.alias("mr"), (F.lit(spec.cols - 1) - c).alias("mc")),
        F.struct(F.lit("top_bottom").alias("kind"), (F.lit(spec.rows - 1) - r).alias("mr"), c.alias("mc")),
        F.struct(F.lit("diagonal").alias("kind"), c.alias("mr"), r.alias("mc")),
    )
    keyed = frame.select("row", "col", F.col(value).alias("v"), F.inline(mirrors)).select(
        "kind", F.least(F.struct("row", "col"), F.struct(F.col("mr").alias("row"), F.col("mc").alias("col"))).alias("k"), "v"
    )
    pairs = keyed.groupBy("kind", "k").agg((F.max("v") - F.min("v")).alias("gap"))
    return pairs.filter(F.col("gap") > tolerance).select("kind", "k.row", "k.col", "gap")


def bound_check(frame: DataFrame, where: Column, value: str, tolerance: float) -> DataFrame:
    """Cells that should be dry but exceed the tolerance."""
    return frame.filter(where & (F.col(value) > tolerance))
