"""Grid geometry: a few numbers on the driver, never one row per cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid of square cells; row 0 is the northern edge."""

    rows: int
    cols: int
    cell: float
    min_x: float
    max_y: float
    epsg: int = 25830

    def __post_init__(self):
        if self.rows <= 0 or self.cols <= 0 or self.cell <= 0:
            raise ValueError("rows, cols and cell must be positive")

    @property
    def max_x(self) -> float:
        return self.min_x + self.cols * self.cell

    @property
    def min_y(self) -> float:
        return self.max_y - self.rows * self.cell

    @property
    def cells(self) -> int:
        return self.rows * self.cols

    def frame(self, spark: SparkSession) -> DataFrame:
        """Every ``(row, col)`` of the grid, generated in parallel from a range."""
        idx = F.col("id")
        return spark.range(self.cells).select(
            F.expr(f"cast(id div {self.cols} as int)").alias("row"),
            (idx % self.cols).cast("int").alias("col"),
        )
