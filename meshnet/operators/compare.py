"""Reactor results back on the cells: the data behind contours and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshnet.operators.filters import near_axis


def on_cells(labels: DataFrame, reactors: DataFrame, value: str) -> DataFrame:
    """Each cell of ``labels`` with its reactor's value; null if the reactor has none."""
    return labels.join(reactors.select(F.col("rid").alias("cluster"), F.col(value).alias("reactor_value")), "cluster", "left")


def compare_contours(cells: DataFrame, reactors: DataFrame, value: str) -> DataFrame:
    """``cell_id, x, y, cell_value, reactor_value, error`` for every cell."""
    joined = on_cells(cells, reactors, value)
    return joined.select(
        "cell_id", "x", "y", F.col(value).alias("cell_value"), "reactor_value", F.abs(F.col(value) - F.col("reactor_value")).alias("error")
    )


def axial_profile(cells: DataFrame, reactors: DataFrame, value: str, across: str = "x", along: str = "y", width: float = 0.003) -> DataFrame:
    """Cells near the axis with both values, in order along it."""
    return on_cells(near_axis(cells, across, width), reactors, value).select(
        "cell_id", F.col(along).alias("along"), F.col(value).alias("cell_value"), "reactor_value"
    ).orderBy("along", "cell_id")


def cluster_points(cells: DataFrame) -> DataFrame:
    """What a map of clusters shows."""
    return cells.select("x", "y", "cluster")


def network_drawing(reactors: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node sizes ``max(ln(V)^2, 0.1)`` with 0.1 for volumes without a logarithm, and line widths 3 m / max m."""
    size = F.coalesce(F.greatest(F.pow(F.ln("volume"), F.lit(2)), F.lit(0.1)), F.lit(0.1))
    most = flows.agg(F.max("mass").alias("most"))
    lines = flows.crossJoin(F.broadcast(most)).select("src", "dst", (3 * F.try_divide("mass", "most")).alias("width"))
    return reactors.select("rid", size.alias("size")), lines
