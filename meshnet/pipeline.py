"""The whole way from exported cells to a reactor network, step by step.

Every step adds to the same object and returns it, so steps chain; tables stay
DataFrames until a network, a handful of rows, is written.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.functions import chem, features
from meshnet.operators import compare, filters, graph, kmeans, mesh, network, scaling
from meshnet.plans.scratch import materialize
from meshnet.sources import decks, fields, solver


class NetworkBuilder:
    """Cells and faces in, reactors and flows out."""

    def __init__(self, spark: SparkSession, dim: int = 3):
        if dim not in (2, 3):
            raise ValueError("dim is 2 or 3")
        self.spark, self.dim = spark, dim
        self.cells: DataFrame | None = None
        self.faces: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.reactors: DataFrame | None = None

    # Input

    def set_cells(self, cells: DataFrame | None = None, files: Mapping[str, str] | None = None) -> NetworkBuilder:
        """A table with ``cell_id`` and fields, or export files by field."""
        self.cells = cells if cells is not None else fields.read_cells(self.spark, files or {}, self.dim)
        for name in ("density", "velocity", "tau"):
            if name not in self.cells.columns:
                warnings.warn(f"cells have no {name}", stacklevel=2)
        return self

    def set_graph(self, faces: DataFrame | None = None, path: str | None = None, pairs: Sequence[tuple[int, int]] | None = None, flows: Sequence[float] | None = None, connected: bool = False) -> NetworkBuilder:
        """Interior faces of a table, a file, or pairs of cells; a mesh in several parts is warned of, or an error."""
        if faces is None:
            faces = fields.read_faces(self.spark, path) if path else fields.faces_from_pairs(self.spark, list(pairs or []), list(flows) if flows else None)
        self.faces = materialize(filters.split_boundary(faces)[0], "faces")
        if not graph.is_connected(self.faces):
            if connected:
                raise ValueError("the mesh is in several parts")
            warnings.warn("the mesh is in several parts", stacklevel=2)
        return self

    def set_features(self, dataset: str = "state-space", columns: Sequence[str] = (), custom: DataFrame | None = None) -> NetworkBuilder:
        """``state-space``: ``columns``. ``reduced``: temperature, velocity and residence time. ``custom``: ``cell_id, features``."""
        cells = self._need(self.cells, "cells")
        if dataset == "state-space":
            if not columns:
                raise ValueError("name the columns of the state")
            chosen = cells.select("cell_id", *(F.col(c).alias(f"f{i}") for i, c in enumerate(columns)))
        elif dataset == "reduced":
            own = features.reduced(F.col("T"), F.col("velocity"), F.col("tau"))
            chosen = cells.select("cell_id", *(c.alias(f"f{i}") for i, c in enumerate(own)))
        elif dataset == "custom" and custom is not None:
            self.features = features.custom_features(cells.select("cell_id"), custom).select("cell_id", "features")
            self._n_features = None
            return self
        else:
            raise ValueError("dataset is state-space, reduced or custom with features")
        self.features, self._n_features = chosen, len(chosen.columns) - 1
        return self

    # Clustering

    def cluster(
        self, k: int, alg: str = "k-means", reassign: bool = True, scale: str = "auto", center: bool = True, method: str = "volume",
        share: float = 1e-6, match: bool = True, **options,
    ) -> NetworkBuilder:
        """Labels by ``alg``; clusters are then made connected and, if there are more than ``k``, merged to ``k``."""
        rows = self.features
        if self._n_features is not None:
            names = [f"f{i}" for i in range(self._n_features)]
            scaled = scaling.Scaler(scale, center).fit(rows, names).transform(rows)
            rows = scaled.select("cell_id", F.array(*names).alias("features"))
        labels = materialize(kmeans.cluster_rows(materialize(rows, "features"), k, alg, **options), "labels")
        if reassign:
            volumes = self.cells.select("cell_id", "volume")
            faces = self._need(self.faces, "faces")
            labels = materialize(graph.reassign_nodes(faces, labels, volumes, method, share=share), "labels")
            if match:
                labels = materialize(graph.match_clusters(faces, labels, volumes, k), "labels")
            if not graph.clusters_connected(faces, labels):
                raise ValueError("clusters are not connected")
        self.labels = graph.dense_labels(labels)
        return self

    # Reactors

    def _need(self, value, what: str):
        if value is None:
            raise ValueError(f"set {what} first")
        return value

    def mass_flowrates(self) -> DataFrame:
        """``src, dst, mass``."""
        self.flows = materialize(mesh.flow_matrix(self._need(self.faces, "faces"), self._need(self.labels, "labels")), "flows")
        return self.flows

    def inlet_streams(self, boundary: DataFrame, streams: DataFrame) -> DataFrame:
        """``cluster, stream_id, mass``; keeps external flows and mixtures."""
        labels = self._need(self.labels, "labels")
        self.external = materialize(mesh.boundary_flows(boundary, labels).withColumnRenamed("cluster", "rid"), "external")
        self.inlets = materialize(mesh.inlet_streams(boundary, labels, streams), "inlets")
        self.mixtures = mesh.mix_streams(self.inlets, streams)
        return self.inlets

    def check_mass_balance(self, tol: float = 1e-2) -> tuple[float, float]:
        return network.check_balance(self.flows, self.external, tol)

    def reactor_attributes(self, correction: str | None = None) -> DataFrame:
        rows = self.cells.join(self._need(self.labels, "labels"), "cell_id")
        self.attributes = materialize(mesh.reactor_attributes(rows, self.dim, correction), "attributes")
        return self.attributes

    def assemble(self, correct: bool = False) -> tuple[DataFrame, DataFrame]:
        """Reactors and flows with a pseudo-reactor for each inlet."""
        self.reactors, self.network_flows = network.assemble(self.attributes, self.flows, self.external, correct)
        return self.reactors, self.network_flows

    def mass_split(self) -> DataFrame:
        return network.mass_split(self.flows, self.external)

    def adapt(self, inlets: DataFrame) -> DataFrame:
        """Flows under new inlets ``rid, inlet``, the split kept."""
        return network.adapt_flows(self.mass_split(), inlets)

    def decks(self, kinfile: str, thermofile: str, isothermal: bool = True, species: Sequence[str] = ("NO", "CO")) -> tuple[str, DataFrame]:
        """The network's deck, and ``rid, file, deck`` of its reactors."""
        reactors = self._need(self.reactors, "reactors").withColumn("isothermal", F.lit(isothermal))
        return decks.network_deck(reactors, self.network_flows, kinfile, thermofile, species), decks.reactor_decks(reactors)

    def write_network(self, folder: str, kinfile: str, thermofile: str, isothermal: bool = True, **options) -> None:
        """Write the decks of the network and its reactors to ``folder``, by the names the solver looks for."""
        reactors = self._need(self.reactors, "reactors").withColumn("isothermal", F.lit(isothermal))
        decks.write_network(reactors, self.network_flows, folder, kinfile, thermofile, **options)

    def simulate(self, run: Callable[[str], None], folder: str) -> DataFrame:
        """Call a solver that the caller brings, and read what it wrote."""
        run(folder)
        return solver.read_outputs(self.spark, folder)

    def compare(self, results: DataFrame, value: str = "T") -> DataFrame:
        return compare.compare_contours(self.cells.join(self.labels, "cell_id"), results, value)


def progress_variable(cells: DataFrame, spec: str) -> DataFrame:
    """``cells`` with ``progress``, a weighted sum of species columns by name."""
    return cells.withColumn("progress", chem.progress_variable({c: F.col(c) for c in cells.columns}, spec))


def mixture_fraction(
    cells: DataFrame, species: Sequence[str], fuel: str, basis: str = "mole", oxidiser: str | None = None, prefix: str = ""
) -> DataFrame:
    """``cells`` with Bilger's ``mixture_fraction`` of species columns, named by ``prefix`` and formula.

    ``fuel`` and ``oxidiser`` (air if none) are compositions by mass.
    """
    columns = {s: F.col(f"`{prefix}{s}`") for s in species}
    masses = chem.mole_to_mass(columns) if basis == "mole" else columns
    other = chem.parse_composition(oxidiser) if oxidiser else None
    return cells.withColumn("mixture_fraction", chem.mixture_fraction(masses, chem.parse_composition(fuel), other))


def mixture_fraction_of_reactors(results: DataFrame, species: Sequence[str], fuel: str, oxidiser: str | None = None) -> DataFrame:
    """``rid, mixture_fraction`` of the solver's mole fractions ``rid, X``, a map by species."""
    x = results.select("rid", *(F.coalesce(F.try_element_at("X", F.lit(s)), F.lit(0.0)).alias(s) for s in species))
    return mixture_fraction(x, species, fuel, "mole", oxidiser).select("rid", "mixture_fraction")
