"""Running totals over an ordered log without putting a whole key into one task.

A window ``partitionBy(key).orderBy(seq)`` sends every row of a key to one task, which fails when
one key holds a third of a huge log. Here the order column is cut into blocks of a fixed width.
Because ``seq`` is unique within a key, a block never holds more than ``block`` rows; where numbers are sparse,
``even_width`` takes the width from the data, so that there are no more blocks than rows call for. Each block is
aggregated first (map-side combine), the short table of block totals is accumulated, and the rows
are then finished inside their block. The rows themselves are shuffled once, on ``(key, block)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
BLOCK_ROWS = 1 << 16

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def even_width(df: DataFrame, order: str, rows: int = BLOCK_ROWS) -> Column:
    """Width of blocks that hold about ``rows`` rows each, however sparse the numbers are (microseconds, say).

    A scalar subquery over one column. Numbers without gaps give ``rows``; blocks never get narrower than that.
    """
    span = F.max(order) - F.min(order) + 1
    width = F.ceil(span * F.lit(float(rows)) / F.greatest(F.count(order), F.lit(1)))
    return df.agg(F.greatest(F.coalesce(width, F.lit(0)), F.lit(rows)).cast("long").alias("width")).scalar()


def with_blocks(df: DataFrame, order: str, block: int | Column = BLOCK_ROWS) -> DataFrame:
    """Add the block number of each row."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / block).cast("long"))


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    pick = F.greatest if kind == "max" else F.least
    return pick(carried, local)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    forward: dict[str, tuple[str, Column]] | None = None,
    backward: dict[str, tuple[str, Column]] | None = None,
    block: int | Column = BLOCK_ROWS,
    keep_block: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates over all rows up to (``forward``) or from (``backward``) each row.

    Both directions include the row itself unless ``exclusive``. Each entry maps an output column to
    ``(kind, expression)`` with kind ``sum``, ``max`` or ``min``; expressions may be null to take
    no part. Pass the result of an earlier call with ``keep_block=True`` to reuse its partitioning.
    """
    forward, backward = forward or {}, backward or {}
    src = df if BLOCK in df.columns else with_blocks(df, order, block)
    every = {**forward, **backward}
    inputs = {name: f"_in_{name}" for name in every}
    src = src.withColumns({inputs[n]: expr for n, (_, expr) in every.items()})

    totals = src.groupBy(*keys, BLOCK).agg(
        *[_AGG[kind](inputs[n]).alias(f"_tot_{n}") for n, (kind, _) in every.items()]
    )
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is looking back in descending order: a frame that grows row by row is linear,
    # while one that ends in "unbounded following" is evaluated again for every row.
    after = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        BLOCK,
        *[_AGG[k](f"_tot_{n}").over(before).alias(f"_car_{n}") for n, (k, _) in forward.items()],
        *[_AGG[k](f"_tot_{n}").over(after).alias(f"_car_{n}") for n, (k, _) in backward.items()],
    )

    inside, own = Window.partitionBy(*keys, BLOCK), -1 if exclusive else 0
    upto = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, own)
    onward = inside.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, own)
    joined = src.join(carried, [*keys, BLOCK])
    local = joined.withColumns(
        {
            **{f"_loc_{n}": _AGG[k](inputs[n]).over(upto) for n, (k, _) in forward.items()},
            **{f"_loc_{n}": _AGG[k](inputs[n]).over(onward) for n, (k, _) in backward.items()},
        }
    )
    out = local.withColumns(
        {n: _merge(k, F.col(f"_car_{n}"), F.col(f"_loc_{n}")) for n, (k, _) in every.items()}
    )
    helper = [f"_{p}_{n}" for n in every for p in ("in", "car", "loc")]
    return out.drop(*helper) if keep_block else out.drop(BLOCK, *helper)
