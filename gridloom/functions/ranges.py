"""Interval joins as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(col: Column) -> Column:
    """Microsecond-exact seconds of a timestamp as DOUBLE-free BIGINT microseconds."""
    return F.unix_micros(col.cast("timestamp"))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: Column,
    start: Column,
    end: Column,
    width: int | Column,
    on: list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join each point to the intervals with ``start <= at < end``.

    ``at``, ``start`` and ``end`` are BIGINT-like. Every interval is copied to the bins of ``width``
    it touches (``running.even_width`` keeps these few where numbers are sparse) and every point to exactly one bin, so the join is an equi-join that adaptive
    execution can split when one bin is hot, and no pair is produced twice.
    """
    on = on or []
    left = points.withColumns({"_at": at, "_bin": F.floor(at / width)})
    right = (
        intervals.withColumns({"_from": start, "_to": end})
        .filter(F.col("_from") < F.col("_to"))
        .withColumn(
            "_bin",
            F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))),
        )
    )
    right = right.withColumnsRenamed({"_bin": "_bin2", **{c: f"_on_{c}" for c in on}})
    cond = F.col("_bin") == F.col("_bin2")
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_on_{c}"))
    cond = cond & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    return left.join(right, cond, how).drop("_at", "_bin", "_bin2", "_from", "_to", *[f"_on_{c}" for c in on])
