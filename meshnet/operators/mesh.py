"""From cells and faces to reactors: flows between clusters, streams, mixtures and attributes.

Tables: ``faces(c_id0, c_id1, mass_flowrate[, area])``, ``labels(cell_id, cluster)``,
``boundary(cell_id, zone_id, mass_flowrate, area)``, ``streams(stream_id, zone_id, ...)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshnet.functions import chem
from meshnet.functions.features import M_TO_MM, TWO_PI, around_axis

#: Streams are a hand-written table of a few rows; above this many they are joined by a shuffle.
FEW_STREAMS = 10_000


def face_clusters(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """``faces`` with the clusters ``c0`` and ``c1`` of their two cells; faces without either are dropped."""
    first = labels.select(F.col("cell_id").alias("c_id0"), F.col("cluster").alias("c0"))
    second = labels.select(F.col("cell_id").alias("c_id1"), F.col("cluster").alias("c1"))
    return faces.join(first, "c_id0").join(second, "c_id1")


def directed(crossing: DataFrame, flow: str = "mass_flowrate", by: Sequence[str] = ()) -> DataFrame:
    """Mass from cluster to cluster: a flow that is not positive runs against its face. Opposed flows are not netted."""
    forward = F.col(flow) > 0
    return (
        crossing.where(F.col("c0") != F.col("c1"))
        .select(
            *by,
            F.when(forward, F.col("c0")).otherwise(F.col("c1")).alias("src"),
            F.when(forward, F.col("c1")).otherwise(F.col("c0")).alias("dst"),
            F.abs(flow).alias("mass"),
        )
        .groupBy(*by, "src", "dst")
        .agg(F.sum("mass").alias("mass"))
    )


def flow_matrix(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """``src, dst, mass`` of the faces between clusters."""
    return directed(face_clusters(faces, labels))


def species_flows(faces: DataFrame, labels: DataFrame, species: Sequence[str]) -> DataFrame:
    """The flow matrix of each species' column of ``faces``."""
    long = face_clusters(faces, labels).unpivot(["c0", "c1"], list(species), "species", "flow")
    return directed(long, "flow", ["species"])


def boundary_flows(boundary: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, inlet, outlet``: boundary mass that enters and leaves each cluster."""
    m = F.col("mass_flowrate")
    return (
        boundary.join(labels, "cell_id")
        .groupBy("cluster")
        .agg(
            F.sum(F.when(m > 0, F.lit(0.0)).otherwise(-m)).alias("inlet"),
            F.sum(F.when(m > 0, m).otherwise(F.lit(0.0))).alias("outlet"),
        )
    )


def signed_flows(boundary: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, inlet, outlet`` with outlets below 0, of clusters that any mass enters or leaves through the boundary."""
    found = boundary_flows(boundary.where("mass_flowrate <> 0"), labels)
    return found.withColumn("outlet", F.when(F.col("outlet") == 0, F.lit(0.0)).otherwise(-F.col("outlet")))


def inlet_streams(boundary: DataFrame, labels: DataFrame, streams: DataFrame) -> DataFrame:
    """``cluster, stream_id, mass`` of the streams that enter each cluster; zones without a stream are left out."""
    few = streams.select("zone_id", "stream_id")
    if few.limit(FEW_STREAMS + 1).count() <= FEW_STREAMS:
        few = F.broadcast(few)
    return (
        boundary.where("mass_flowrate < 0")
        .join(few, "zone_id")
        .join(labels, "cell_id")
        .groupBy("cluster", "stream_id")
        .agg(F.sum(-F.col("mass_flowrate")).alias("mass"))
    )


def mass_inlet(boundary: DataFrame) -> DataFrame:
    """``zone_id, mass`` that enters through each zone."""
    return boundary.where("mass_flowrate < 0").groupBy("zone_id").agg(F.sum(-F.col("mass_flowrate")).alias("mass"))


def mix_streams_adiabatic(inlets: DataFrame, streams: DataFrame, key: str = "cluster", digits: int = 7, data: Mapping = chem.NASA7) -> DataFrame:
    """``T, P, mass, Y`` of streams mixed without reaction or loss of heat: enthalpy, pressure and shares are means by mass.

    ``Y`` are mass fractions; the temperature is where the mixture has the enthalpy that came in, which lies
    between those of the streams. A stream alone keeps its own.
    """
    parts = inlets.join(streams.select("stream_id", "T", "P", "Y"), "stream_id").withColumn("gas", chem.gas_terms(F.col("Y"), data))
    m = F.col("mass")
    mean = lambda value: F.sum(m * value) / F.sum("mass")
    state = parts.groupBy(key).agg(
        F.min("T").alias("low"), F.max("T").alias("high"), mean(F.col("P")).alias("P"), mean(chem.enthalpy(F.col("gas"), F.col("T"))).alias("h"),
        F.count(F.lit(1)).alias("n"),
    )
    mixed = mix_streams(inlets, streams, key, digits).select(key, "mass", "Y").join(state, key).withColumn("gas", chem.gas_terms(F.col("Y"), data))
    found = chem.temperature_of(F.col("gas"), F.col("h"), F.col("low"), F.col("high"))
    return mixed.select(key, F.when(F.col("n") == 1, F.col("low")).otherwise(found).alias("T"), "P", "mass", "Y")


def mix_streams(inlets: DataFrame, streams: DataFrame, key: str = "cluster", digits: int = 7) -> DataFrame:
    """``T, P, Y`` of the mixture of the streams of each ``key``: temperature and shares by mass, least pressure.

    Shares are rounded; the last species by name takes what is left to 1.
    """
    parts = inlets.join(streams.select("stream_id", "T", "P", "Y"), "stream_id")
    state = parts.groupBy(key).agg(
        (F.sum(F.col("T") * F.col("mass")) / F.sum("mass")).alias("T"), F.min("P").alias("P"), F.sum("mass").alias("mass")
    )
    shares = (
        parts.select(key, "mass", F.explode("Y").alias("species", "y"))
        .groupBy(key, "species")
        .agg(F.sum(F.col("mass") * F.col("y")).alias("amount"))
        .join(state.select(key, "mass"), key)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("species", F.round(F.col("amount") / F.col("mass"), digits).alias("y")))).alias("all"))
    )
    head = F.slice("all", 1, F.size("all") - 1)
    rest = F.lit(1.0) - F.aggregate(head, F.lit(0.0), lambda a, e: a + e["y"])
    last = F.struct(F.element_at("all", -1)["species"].alias("species"), F.round(rest, digits).alias("y"))
    return state.join(shares, key).select(key, "T", "P", "mass", F.map_from_entries(F.concat(head, F.array(last))).alias("Y"))


def reactor_attributes(cells: DataFrame, dim: int = 3, correction: str | None = None) -> DataFrame:
    """``cluster, volume, density, mass, T`` of the clusters of ``cells(cluster, volume, density, T[, tvar])``.

    Density is the plain mean, temperature the mean by volume. ``correction``
    adds ``Tmean`` and ``Tvar``, the variance's mean by volume (``mean``) or largest value (``max``).
    """
    v = F.col("volume")
    aggs = [
        around_axis(F.sum(v), dim).alias("volume"),
        F.avg("density").alias("density"),
        (F.sum(F.col("T") * v) / F.sum(v)).alias("T"),
    ]
    if correction == "mean":
        aggs.append((F.sum(F.col("tvar") * v) / F.sum(v)).alias("Tvar"))
    elif correction == "max":
        aggs.append(F.max("tvar").alias("Tvar"))
    elif correction is not None:
        raise ValueError("correction is mean or max")
    out = cells.groupBy("cluster").agg(*aggs).withColumn("mass", F.col("volume") * F.col("density"))
    return out.withColumn("Tmean", F.col("T")) if correction else out


def reactor_attributes_by_mass(cells: DataFrame, hot: float = 1500.0) -> DataFrame:
    """``volume`` in cm3, ``mass`` and ``T``: the mean by mass, or the largest value if that mean is above ``hot``."""
    m = F.col("density") * F.col("volume")
    mean = F.sum(F.col("T") * m) / F.sum(m)
    return cells.groupBy("cluster").agg(
        (F.sum("volume") * 1e6).alias("volume"),
        F.sum(m).alias("mass"),
        F.when(mean > hot, F.max("T")).otherwise(mean).alias("T"),
        (F.max("T") * 1.2).alias("Tvar"),
    )


def centroids(rows: DataFrame, variables: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """The mean of each variable in each cluster."""
    return rows.groupBy(cluster).agg(*(F.avg(v).alias(v) for v in variables))


def centroids_with_empty(rows: DataFrame, variables: Sequence[str], k: int, cluster: str = "cluster") -> DataFrame:
    """The same for clusters 0 to k - 1, zeros where one is empty."""
    every = rows.sparkSession.range(k).select(F.col("id").alias(cluster))
    return every.join(centroids(rows, variables, cluster), cluster, "left").na.fill(0.0, list(variables))


def cluster_volumes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cluster").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("cells"))


def boundary_area(boundary: DataFrame, labels: DataFrame, order: Column) -> DataFrame:
    """``cluster, area``: each boundary cell counts its first face by ``order``, clusters without any count 0."""
    first = boundary.groupBy("cell_id").agg(F.min_by("area", order).alias("area"))
    return labels.join(first, "cell_id", "left").groupBy("cluster").agg(F.sum(F.coalesce("area", F.lit(0.0))).alias("area"))


def mean_composition(cells: DataFrame, least: float = 1e-6) -> DataFrame:
    """``cluster, species, share``: mean of ``cells(cluster, Y map)``; air where nothing is above ``least``."""
    air = F.create_map(F.lit("N2"), F.lit(0.79), F.lit("O2"), F.lit(0.21))
    n = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    means = (
        cells.select("cluster", F.explode("Y").alias("species", "y"))
        .groupBy("cluster", "species")
        .agg(F.sum("y").alias("y"))
        .join(n, "cluster")
        .select("cluster", "species", (F.col("y") / F.col("n")).alias("share"))
        .where(F.col("share") > least)
    )
    lacking = n.join(means, "cluster", "left_anti").select("cluster", F.explode(air).alias("species", "share"))
    return means.unionByName(lacking)


def axial_extent(cells: DataFrame, x: str = "x") -> DataFrame:
    """``cluster, length, extent``: largest coordinate, and the distance between the ends in mm; ascending by length."""
    return (
        cells.groupBy("cluster")
        .agg(F.max(x).alias("length"), (F.abs(F.max(x) - F.min(x)) * M_TO_MM).alias("extent"))
        .orderBy("length", "cluster")
    )


def residence_time(cells: DataFrame, flows: DataFrame, external: DataFrame) -> DataFrame:
    """``cluster, mass, Mf, tau``: mass in the cells (density times volume) over what flows in; null where nothing does."""
    mass = cells.groupBy("cluster").agg(F.sum(F.col("density") * F.col("volume")).alias("mass"))
    taken = flows.select(F.col("dst").alias("cluster"), F.col("mass").alias("m")).unionByName(
        external.select(F.col("rid").alias("cluster"), F.col("inlet").alias("m"))
    )
    through = taken.groupBy("cluster").agg(F.sum("m").alias("Mf"))
    joined = mass.join(through, "cluster", "left").withColumn("Mf", F.coalesce("Mf", F.lit(0.0)))
    return joined.withColumn("tau", F.try_divide("mass", "Mf"))


def turn_faces(faces: DataFrame, dim: int) -> DataFrame:
    """Faces of a 2-D case, whose flow and area are per radian."""
    own = [c for c in ("mass_flowrate", "area") if c in faces.columns]
    return faces.withColumns({c: F.col(c) * TWO_PI for c in own}) if dim == 2 else faces


def relabel_by(labelled: DataFrame, value: str, cluster: str = "cluster") -> DataFrame:
    """Clusters numbered anew by their largest ``value``, ascending; ties by the old number."""
    # One row a cluster: the window's single partition has as many rows as there are clusters.
    rank = F.row_number().over(Window.orderBy("__top", cluster)) - 1
    order = labelled.groupBy(cluster).agg(F.max(value).alias("__top")).select(cluster, rank.alias("__new"))
    return labelled.join(order, cluster).withColumn(cluster, F.col("__new")).select(*labelled.columns)
