"""Diffusive fluxes between clusters: distances, shared areas and differences of composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshnet.functions import chem
from meshnet.functions.features import around_axis
from meshnet.operators.mesh import centroids, face_clusters

#: Fixed value: the turbulent Schmidt number.
SCHMIDT = 0.7


def shared_area(faces: DataFrame, labels: DataFrame, dim: int = 3) -> DataFrame:
    """``src, dst, area`` of the faces between two clusters, in both directions."""
    crossing = face_clusters(faces, labels).where("c0 <> c1").select(
        F.least("c0", "c1").alias("a"), F.greatest("c0", "c1").alias("b"), "area"
    )
    half = crossing.groupBy("a", "b").agg(around_axis(F.sum("area"), dim).alias("area"))
    return half.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "area"),
                                         F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "area"))).alias("e")).select("e.*")


def face_areas(faces: DataFrame, areas: DataFrame) -> DataFrame:
    """``faces`` with the ``area`` of the entry that has the same two cells, in either order."""
    key = lambda df: df.select("*", F.least("c_id0", "c_id1").alias("__a"), F.greatest("c_id0", "c_id1").alias("__b"))
    known = key(areas).groupBy("__a", "__b").agg(F.min("area").alias("area"))  # the least of several
    return key(faces).join(known, ["__a", "__b"], "left").drop("__a", "__b")


def centroid_distances(centres: DataFrame, variables: Sequence[str], pairs: DataFrame) -> DataFrame:
    """``pairs(src, dst, ...)`` with the distance between the centres: only pairs that are needed meet."""
    side = lambda end: centres.select(F.col("cluster").alias(end), *(F.col(v).alias(f"__{end}_{v}") for v in variables))
    squares = sum(((F.col(f"__src_{v}") - F.col(f"__dst_{v}")) * (F.col(f"__src_{v}") - F.col(f"__dst_{v}")) for v in variables), F.lit(0.0))
    return pairs.join(side("src"), "src").join(side("dst"), "dst").select(*pairs.columns, F.sqrt(squares).alias("distance"))


def diffusive_fluxes(
    cells: DataFrame, faces: DataFrame, coordinates: Sequence[str], species: Sequence[str], dim: int = 3, viscosity: str = "viscosity",
    basis: str = "mass",
) -> DataFrame:
    """``src, dst, species, flux``: area times viscosity over Schmidt's number times the gradient of mean composition.

    ``cells`` has ``cell_id, cluster``, coordinates, viscosity and a column for each species, named by its
    formula if the ``basis`` is ``mole``: mean mole fractions then become mass fractions.
    """
    labels = cells.select("cell_id", "cluster")
    means = centroids(cells, [*coordinates, *species, viscosity])
    links = centroid_distances(means.select("cluster", *coordinates), coordinates, shared_area(faces, labels, dim))
    if basis == "mole":
        means = means.withColumns(chem.mole_to_mass({s: F.col(s) for s in species}))
    long = means.unpivot(["cluster", viscosity], list(species), "species", "y")
    here = long.select(F.col("cluster").alias("src"), "species", F.col("y").alias("y_src"))
    there = long.select(F.col("cluster").alias("dst"), "species", F.col("y").alias("y_dst"), F.col(viscosity).alias("mu"))
    return (
        links.join(here, "src")
        .join(there, ["dst", "species"])
        .select("src", "dst", "species", (F.col("area") * F.col("mu") / SCHMIDT * F.try_divide(F.col("y_dst") - F.col("y_src"), "distance")).alias("flux"))
    )
