"""Filters of faces, flows, species and clusters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbour ids that mark a boundary face.
BOUNDARY_IDS = (-1, 0)


def split_boundary(faces: DataFrame, neighbour: str = "c_id1") -> tuple[DataFrame, DataFrame]:
    """Interior faces, and boundary faces."""
    outside = F.col(neighbour).isin(*BOUNDARY_IDS)
    return faces.where(~outside), faces.where(outside)


def clean_connections(faces: DataFrame, src: str = "c_id0", dst: str = "c_id1") -> DataFrame:
    """Distinct interior connections."""
    return split_boundary(faces, dst)[0].select(src, dst).distinct()


def drop_small_flows(flows: DataFrame, share: float = 1e-4) -> DataFrame:
    """Flows of at least ``share`` of all that leaves their source."""
    total = F.sum("mass").over(Window.partitionBy("src"))
    return flows.withColumn("__total", total).where(F.try_divide("mass", "__total") >= share).drop("__total")


def significant(x: Column, digits: int = 6) -> Column:
    """``x`` to so many significant digits."""
    power = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * power) / power)


def threshold_flows(flows: DataFrame, least: float = 1e-5, digits: int = 6) -> DataFrame:
    """Small flows become 0, others are rounded to significant digits."""
    mass = F.col("mass")
    return flows.withColumn("mass", F.when(F.abs(mass) < least, F.lit(0.0)).otherwise(significant(mass, digits)))


def keep_species(composition: Column, least: float = 1e-6) -> Column:
    """Species of a map column above a share."""
    return F.map_filter(composition, lambda _, x: x > least)


def near_axis(cells: DataFrame, x: str = "x", width: float = 0.003) -> DataFrame:
    return cells.where(F.abs(x) < width)


def downstream(cells: DataFrame, x: str = "x", of: float = 0.0) -> DataFrame:
    """Cells past an injector."""
    return cells.where(F.col(x) > of)


def exchanging(reactors: DataFrame, flows: DataFrame, rid: str = "rid") -> DataFrame:
    """Reactors that give or take any mass."""
    moving = flows.where("mass <> 0")
    ends = moving.select(F.col("src").alias(rid)).unionByName(moving.select(F.col("dst").alias(rid))).distinct()
    return reactors.join(ends, rid, "left_semi")


def prune_clusters(labelled: DataFrame, variables: list[str], least_variance: float | None = None, cluster: str = "cluster") -> DataFrame:
    """Rows of clusters with more rows than variables and, if asked, a variance above a bound in one of them."""
    stats = labelled.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("__n"), *(F.var_pop(v).alias(f"__v{i}") for i, v in enumerate(variables))
    )
    good = F.col("__n") > len(variables)
    if least_variance is not None:
        good &= reduce(or_, (F.col(f"__v{i}") > least_variance for i in range(len(variables))))
    return labelled.join(stats.where(good).select(cluster), cluster, "left_semi")
