"""Queries of the reactor-network operators over the driver's tables, each with SQL where SQL can tell the same.

The tables hold no mesh, so they stand in for one: nations that trade are
clusters with flows, vectors lie on a lattice of 25 columns, events are boundary
faces, parts are cells. Every query runs over its whole tables.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.functions import chem, features
from meshnet.operators import compare, diffusion, filters, graph, kmeans, mesh, mixtures, network, pca, scaling, vqpca
from meshnet.plans.scratch import materialize, new_path
from meshnet.plans.tables import read_table
from meshnet.sources import decks, fields, results, solver
from meshnet.sources.named_files import write_named

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded, with no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# Stand-ins, each as a DataFrame and as SQL.


def trade(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flow = F.when(F.col("l_returnflag") == "R", -value).otherwise(value)
    line = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", flow.alias("flow"))  # narrow before it is shuffled
    supplier = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c0"))
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("c1"))
    part = read_table(spark, d, "part").select("p_partkey", F.col("p_type").alias("species"))
    sold = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c1")  # orders are fewer than lines
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("c0", "c1", "species", "flow")
    )


TRADE = """trade AS (
  SELECT s_nationkey AS c0, c_nationkey AS c1, p_type AS species,
         CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * (1 - l_discount) AS flow
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
FLOWS = f"""{TRADE}, flows AS (
  SELECT CASE WHEN flow > 0 THEN c0 ELSE c1 END AS src, CASE WHEN flow > 0 THEN c1 ELSE c0 END AS dst, sum(abs(flow)) AS mass
  FROM trade WHERE c0 <> c1 GROUP BY 1, 2)"""


def trade_flows(spark: SparkSession, d: str) -> DataFrame:
    """Written, as what takes flows reads them several times: a row for two nations, against joins of all lines."""
    return materialize(mesh.directed(trade(spark, d).drop("species"), "flow"), "trade")


def external(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each nation: open ones come in, finished ones go out."""
    customer = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("rid"))
    own = read_table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    sums = own.groupBy("rid").agg(
        F.sum(F.when(status == "O", price).otherwise(0.0)).alias("inlet"), F.sum(F.when(status == "F", price).otherwise(0.0)).alias("outlet")
    )
    return materialize(sums, "external")


EXTERNAL = """ext AS (
  SELECT c_nationkey AS rid, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS inlet,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS outlet
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""
TOTALS = f"""{FLOWS}, {EXTERNAL}, tot AS (
  SELECT rid, sum(i) AS incoming, sum(o) AS outgoing, sum(a) AS inlet, sum(b) AS outlet FROM (
    SELECT src AS rid, 0.0 AS i, mass AS o, 0.0 AS a, 0.0 AS b FROM flows
    UNION ALL SELECT dst, mass, 0.0, 0.0, 0.0 FROM flows
    UNION ALL SELECT rid, 0.0, 0.0, inlet, outlet FROM ext) GROUP BY rid)"""


def lattice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells and faces; each cell looks right and down."""
    rows = read_table(spark, d, "embeddings")
    n = rows.count()
    cell = F.col("vec_id") + 1
    e = F.col("embedding").cast("array<double>")
    cells = rows.select(
        cell.alias("cell_id"), F.col("label").alias("cluster"), ((cell - 1) % 25).cast("double").alias("x"),
        F.floor((cell - 1) / 25).cast("double").alias("y"), (1 + F.col("vec_id") % 7).cast("double").alias("volume"),
        (1 + F.col("vec_id") % 5).cast("double").alias("viscosity"), F.get(e, 0).alias("a"), F.get(e, 1).alias("b"), e.alias("features"),
    )
    right = F.when((F.col("cell_id") % 25 != 0) & (F.col("cell_id") + 1 <= n), F.col("cell_id") + 1)
    down = F.when(F.col("cell_id") + 25 <= n, F.col("cell_id") + 25)
    pairs = cells.select(F.col("cell_id").alias("c_id0"), F.col("a").alias("a0"), F.explode(F.array_compact(F.array(right, down))).alias("c_id1"))
    other = cells.select(F.col("cell_id").alias("c_id1"), F.col("a").alias("a1"))
    faces = pairs.join(other, "c_id1").select(
        "c_id0", "c_id1", (F.col("a0") - F.col("a1")).alias("mass_flowrate"), (1 + F.col("c_id0") % 3).cast("double").alias("area")
    )
    return cells, faces


LATTICE = """cells AS (
  SELECT vec_id + 1 AS cell_id, label AS cluster, CAST(vec_id % 25 AS DOUBLE) AS x, CAST(vec_id // 25 AS DOUBLE) AS y,
         CAST(1 + vec_id % 7 AS DOUBLE) AS volume, CAST(1 + vec_id % 5 AS DOUBLE) AS viscosity,
         CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, embedding
  FROM embeddings), faces AS (
  SELECT p.cell_id AS c_id0, q.cell_id AS c_id1, p.a - q.a AS mass_flowrate, CAST(1 + p.cell_id % 3 AS DOUBLE) AS area,
         p.cluster AS c0, q.cluster AS c1
  FROM cells p JOIN cells q ON (q.cell_id = p.cell_id + 1 AND p.cell_id % 25 <> 0) OR q.cell_id = p.cell_id + 25)"""

ZONES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def boundary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Boundary faces and the clusters of their cells."""
    events = read_table(spark, d, "events")
    zone = F.create_map(*(x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))))[F.col("event_type")]
    value = F.col("value")
    faces = events.select(
        "event_id", F.col("user_id").alias("cell_id"), zone.alias("zone_id"),
        F.when(zone.isin(3, 4), -value).otherwise(value).alias("mass_flowrate"), value.alias("area"),
    )
    return faces, faces.select("cell_id").distinct().select("cell_id", (F.col("cell_id") % 10).cast("int").alias("cluster"))


BOUNDARY = """boundary AS (
  SELECT event_id, user_id AS cell_id, CAST(user_id % 10 AS INTEGER) AS cluster,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS zone_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN -value ELSE value END AS mass_flowrate, value AS area
  FROM events)"""


def streams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(0, 3, 300.0, 101325.0, {"CH4": 0.5, "H2": 0.5}), (1, 4, 872.0, 101000.0, {"N2": 0.79, "O2": 0.21})],
        "stream_id int, zone_id int, T double, P double, Y map<string,double>",
    )


def parts(spark: SparkSession, d: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return read_table(spark, d, "part").select(
        F.col("p_partkey").alias("cell_id"), F.col("p_brand").alias("cluster"), size.alias("volume"), (price / 1000).alias("density"),
        price.alias("T"), (price / 10).alias("tvar"), (size / 10).alias("tau"), F.col("p_type").alias("species"),
    )


PARTS = """parts AS (
  SELECT p_partkey AS cell_id, p_brand AS cluster, CAST(p_size AS DOUBLE) AS volume, p_retailprice / 1000 AS density, p_retailprice AS T,
         p_retailprice / 10 AS tvar, p_size / 10.0::DOUBLE AS tau, p_type AS species FROM part)"""
#: The species that each kind of part stands for.
FORMULAS = {"ECONOMY": "CH4", "LARGE": "O2", "MEDIUM": "N2", "PROMO": "CO2", "SMALL": "H2O", "STANDARD": "CO"}
WEIGHTS = {"CH4": 16, "O2": 32, "N2": 28, "CO2": 44, "H2O": 18, "CO": 28}


def composition(spark: SparkSession, d: str) -> DataFrame:
    """``brand`` and the mole fraction of each species: its share of the quantity sold."""
    line = read_table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    sold = line.join(read_table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity")
    return sold.groupBy(F.col("p_brand").alias("brand")).agg(
        *((F.sum(F.when(F.col("p_type") == t, q).otherwise(0.0)) / F.sum(q)).alias(s) for t, s in FORMULAS.items())
    )


COMPOSITION = "comp AS (SELECT p_brand AS brand, " + ", ".join(
    f"sum(CASE WHEN p_type = '{t}' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS {s}" for t, s in FORMULAS.items()
) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
_TOTAL_MASS = "(" + " + ".join(f"{s} * {w}" for s, w in WEIGHTS.items()) + ")"
MASSES = f"{COMPOSITION}, mass AS (SELECT brand, " + ", ".join(f"{s} * {w} / {_TOTAL_MASS} AS {s}" for s, w in WEIGHTS.items()) + " FROM comp)"


def moles() -> dict:
    return {s: F.col(s) for s in WEIGHTS}


# Flows and streams.


@query("flow_matrix", f"WITH {FLOWS} SELECT src, dst, round(mass, 4) AS mass FROM flows")
def flow_matrix(spark, d):
    return rounded(trade_flows(spark, d), 4, "mass")


@query("lattice_flow_matrix", f"""WITH {LATTICE}
SELECT CASE WHEN mass_flowrate > 0 THEN c0 ELSE c1 END AS src, CASE WHEN mass_flowrate > 0 THEN c1 ELSE c0 END AS dst,
       round(sum(abs(mass_flowrate)), 6) AS mass FROM faces WHERE c0 <> c1 GROUP BY 1, 2""")
def lattice_flow_matrix(spark, d):
    cells, faces = lattice(spark, d)
    return rounded(mesh.flow_matrix(faces, cells.select("cell_id", "cluster")), 6, "mass")


@query("species_flows", f"""WITH {TRADE}
SELECT species, CASE WHEN flow > 0 THEN c0 ELSE c1 END AS src, CASE WHEN flow > 0 THEN c1 ELSE c0 END AS dst, round(sum(abs(flow)), 4) AS mass
FROM trade WHERE c0 <> c1 GROUP BY 1, 2, 3""")
def species_flows(spark, d):
    return rounded(mesh.directed(trade(spark, d), "flow", ["species"]), 4, "mass")


@query("boundary_flows", f"""WITH {BOUNDARY}
SELECT cluster, round(sum(CASE WHEN mass_flowrate > 0 THEN 0 ELSE -mass_flowrate END), 4) AS inlet,
       round(sum(CASE WHEN mass_flowrate > 0 THEN mass_flowrate ELSE 0 END), 4) AS outlet FROM boundary GROUP BY 1""")
def boundary_flows(spark, d):
    return rounded(mesh.boundary_flows(*boundary(spark, d)), 4, "inlet", "outlet")


@query("signed_flows", f"""WITH {BOUNDARY}
SELECT cluster, round(sum(CASE WHEN mass_flowrate > 0 THEN 0 ELSE -mass_flowrate END), 4) AS inlet,
       round(-sum(CASE WHEN mass_flowrate > 0 THEN mass_flowrate ELSE 0 END), 4) + 0.0 AS outlet FROM boundary WHERE mass_flowrate <> 0 GROUP BY 1""")
def signed_flows(spark, d):
    return rounded(mesh.signed_flows(*boundary(spark, d)), 4, "inlet", "outlet")


@query("edge_weights", """SELECT least(user_id, event_id % 40) AS c_id0, greatest(user_id, event_id % 40) AS c_id1, round(arg_max(value, event_id), 6) AS weight
FROM events WHERE user_id <> event_id % 40 GROUP BY 1, 2""")
def edge_weights(spark, d):
    """Users and buckets of events as cells; the last event of a pair, either way round, gives its weight."""
    faces = read_table(spark, d, "events").select(F.col("user_id").alias("c_id0"), (F.col("event_id") % 40).alias("c_id1"), F.col("value").alias("mass_flowrate"), "event_id")
    return rounded(graph.edge_weights(faces, "event_id"), 6, "weight")


INLETS = f"""{BOUNDARY}, inlets AS (
  SELECT cluster, zone_id - 3 AS stream_id, sum(-mass_flowrate) AS mass FROM boundary WHERE mass_flowrate < 0 AND zone_id IN (3, 4) GROUP BY 1, 2)"""


@query("inlet_streams", f"WITH {INLETS} SELECT cluster, stream_id, round(mass, 4) AS mass FROM inlets")
def inlet_streams(spark, d):
    return rounded(mesh.inlet_streams(*boundary(spark, d), streams(spark)), 4, "mass")


@query("stream_mixtures", f"""WITH {INLETS}, s AS (SELECT * FROM (VALUES (0, 300.0::DOUBLE, 101325.0::DOUBLE), (1, 872.0, 101000.0)) t(stream_id, T, P)),
y AS (SELECT * FROM (VALUES (0, 'CH4', 0.5::DOUBLE), (0, 'H2', 0.5), (1, 'N2', 0.79), (1, 'O2', 0.21)) t(stream_id, species, y)),
state AS (SELECT cluster, sum(T * mass) / sum(mass) AS T, min(P) AS P, sum(mass) AS total FROM inlets JOIN s USING (stream_id) GROUP BY 1)
SELECT cluster, round(any_value(T), 6) AS T, any_value(P) AS P, species, round(sum(mass * y) / any_value(total), 6) AS y
FROM inlets JOIN y USING (stream_id) JOIN state USING (cluster) GROUP BY cluster, species""")
def stream_mixtures(spark, d):
    mixed = mesh.mix_streams(mesh.inlet_streams(*boundary(spark, d), streams(spark)), streams(spark), digits=12)
    return rounded(mixed.select("cluster", "T", "P", F.explode("Y").alias("species", "y")), 6, "T", "y")


def _enthalpy_sql(shares: str, t: str) -> str:
    """SQL of the enthalpy of a list of structs ``w, change, low, high, y`` at a temperature."""
    c = lambda i: f"(CASE WHEN {t} < x.change THEN x.low[{i}] ELSE x.high[{i}] END)"
    poly = f"{c(5)} / 5"
    for i in (4, 3, 2, 1):
        poly = f"({c(i)} / {i} + {t} * {poly})"
    return f"{chem.GAS_CONSTANT} * list_sum(list_transform({shares}, lambda x: x.y * 1000 / x.w * ({c(6)} + {t} * {poly})))"


_GASES = ", ".join(f"('{s}', {chem.molecular_weight(s)}, {change}::DOUBLE, {low[:6]}::DOUBLE[], {high[:6]}::DOUBLE[])" for s, (change, low, high) in chem.NASA7.items())
_ADIABATIC = f"""WITH {INLETS}, s AS (SELECT * FROM (VALUES (0, 300.0::DOUBLE, 101325.0::DOUBLE), (1, 872.0, 101000.0)) t(stream_id, T, P)),
y AS (SELECT * FROM (VALUES (0, 'CH4', 0.5::DOUBLE), (0, 'H2', 0.5), (1, 'N2', 0.79), (1, 'O2', 0.21)) t(stream_id, species, y)),
gas AS (SELECT * FROM (VALUES {_GASES}) t(species, w, change, low, high)),
state AS (SELECT cluster, sum(P * mass) / sum(mass) AS P, min(T) AS t0, max(T) AS t1, sum(mass) AS total FROM inlets JOIN s USING (stream_id) GROUP BY 1),
came AS (SELECT stream_id, list({{'w': w, 'change': change, 'low': low, 'high': high, 'y': y}}) AS shares FROM y JOIN gas USING (species) GROUP BY 1),
heat AS (SELECT cluster, sum(mass * h) / sum(mass) AS h FROM inlets JOIN (SELECT stream_id, {_enthalpy_sql("shares", "T")} AS h FROM came JOIN s USING (stream_id)) USING (stream_id) GROUP BY 1),
parts AS (SELECT cluster, species, sum(mass * y) / any_value(total) AS y FROM inlets JOIN y USING (stream_id) JOIN state USING (cluster) GROUP BY 1, 2),
mixed AS (SELECT cluster, list({{'w': w, 'change': change, 'low': low, 'high': high, 'y': y}}) AS shares FROM parts JOIN gas USING (species) GROUP BY 1),
found AS (SELECT cluster, P, list_reduce(range(1, 61), lambda t, i: t + CASE WHEN {_enthalpy_sql("shares", "t")} < h THEN t1 - t0 ELSE t0 - t1 END / pow(2.0::DOUBLE, i + 1),
  (t0 + t1) / 2) AS T FROM mixed JOIN state USING (cluster) JOIN heat USING (cluster))
"""


@query("adiabatic_mixtures", _ADIABATIC + "SELECT cluster, round(T, 6) AS T, round(P, 4) AS P, species, round(y, 6) AS y FROM found JOIN parts USING (cluster)")
def adiabatic_mixtures(spark, d):
    """Streams mixed at constant enthalpy and pressure."""
    mixed = mesh.mix_streams_adiabatic(mesh.inlet_streams(*boundary(spark, d), streams(spark)), streams(spark), digits=12)
    return rounded(rounded(mixed.select("cluster", "T", "P", F.explode("Y").alias("species", "y")), 6, "T", "y"), 4, "P")


@query("adiabatic_residual", _ADIABATIC + """SELECT cluster, 0.0::DOUBLE AS lost, true AS between FROM found""")
def adiabatic_residual(spark, d):
    """Enthalpy that a mixture lacks of what its streams brought, as a share; whether its temperature lies between theirs."""
    inlets, own = mesh.inlet_streams(*boundary(spark, d), streams(spark)), streams(spark)
    mixed = mesh.mix_streams_adiabatic(inlets, own, digits=12).select("cluster", "T", "Y")
    came = inlets.join(own.select("stream_id", F.col("T").alias("t"), F.col("Y").alias("ys")), "stream_id").groupBy("cluster").agg(
        (F.sum(F.col("mass") * chem.enthalpy(chem.gas_terms(F.col("ys")), F.col("t"))) / F.sum("mass")).alias("h"), F.min("t").alias("low"), F.max("t").alias("high"))
    has = chem.enthalpy(chem.gas_terms(F.col("Y")), F.col("T"))
    rows = mixed.join(came, "cluster").select("cluster", ((has - F.col("h")) / F.abs("h")).alias("lost"), F.col("T").between(F.col("low"), F.col("high")).alias("between"))
    return rounded(rows, 6, "lost")


@query("zone_inlets", f"WITH {BOUNDARY} SELECT zone_id, round(sum(-mass_flowrate), 4) AS mass FROM boundary WHERE mass_flowrate < 0 GROUP BY 1")
def zone_inlets(spark, d):
    return rounded(mesh.mass_inlet(boundary(spark, d)[0]), 4, "mass")


# Attributes of reactors.

_ATTRIBUTES = "cluster, round(sum(volume) * 6.283185307179586, 4) AS volume, round(avg(density), 6) AS density, round(sum(T * volume) / sum(volume), 4) AS T"
_MASS = "round(sum(volume) * 6.283185307179586 * avg(density), 4) AS mass, round(sum(T * volume) / sum(volume), 4) AS Tmean"


@query("reactor_attributes", f"WITH {PARTS} SELECT {_ATTRIBUTES}, round(sum(tvar * volume) / sum(volume), 4) AS Tvar, {_MASS} FROM parts GROUP BY 1")
def reactor_attributes(spark, d):
    return _attributes(spark, d, "mean")


@query("reactor_attributes_max", f"WITH {PARTS} SELECT {_ATTRIBUTES}, round(max(tvar), 4) AS Tvar, {_MASS} FROM parts GROUP BY 1")
def reactor_attributes_max(spark, d):
    return _attributes(spark, d, "max")


def _attributes(spark, d, correction):
    return rounded(rounded(mesh.reactor_attributes(parts(spark, d), 2, correction), 4, "volume", "T", "Tvar", "Tmean", "mass"), 6, "density")


@query("reactor_attributes_by_mass", f"""WITH {PARTS}, m AS (SELECT cluster, sum(volume) * 1e6 AS volume, sum(density * volume) AS mass,
  sum(T * density * volume) / sum(density * volume) AS mean, max(T) AS top FROM parts GROUP BY 1)
SELECT cluster, round(volume, 4) AS volume, round(mass, 4) AS mass, round(CASE WHEN mean > 950 THEN top ELSE mean END, 4) AS T, round(top * 1.2, 4) AS Tvar FROM m""")
def reactor_attributes_by_mass(spark, d):
    return rounded(mesh.reactor_attributes_by_mass(parts(spark, d), hot=950.0), 4, "volume", "mass", "T", "Tvar")


@query("centroids", """SELECT label AS cluster, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean
FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2""")
def centroids(spark, d):
    rows = read_table(spark, d, "embeddings")
    wide = rows.select(F.col("label").alias("cluster"), *(F.get("embedding", i).cast("double").alias(f"{i}") for i in range(64)))
    long = mesh.centroids(wide, [f"{i}" for i in range(64)]).unpivot(["cluster"], [f"{i}" for i in range(64)], "dim", "mean")
    return rounded(long.withColumn("dim", F.col("dim").cast("long")), 6, "mean")


@query("centroids_with_empty", f"""WITH {LATTICE} SELECT k AS cluster, coalesce(round(avg(x), 6), 0) AS x, coalesce(round(avg(y), 6), 0) AS y
FROM range(12) t(k) LEFT JOIN cells ON cluster = k GROUP BY 1""")
def centroids_with_empty(spark, d):
    return rounded(mesh.centroids_with_empty(lattice(spark, d)[0], ["x", "y"], 12), 6, "x", "y")


@query("cluster_volumes", f"WITH {LATTICE} SELECT cluster, sum(volume) AS volume, count(*) AS cells FROM cells GROUP BY 1")
def cluster_volumes(spark, d):
    return mesh.cluster_volumes(lattice(spark, d)[0])


AREAS = f"{LATTICE}, areas AS (SELECT c0 AS src, c1 AS dst, area FROM faces WHERE c0 <> c1 UNION ALL SELECT c1, c0, area FROM faces WHERE c0 <> c1)"


@query("shared_area", f"WITH {AREAS} SELECT src, dst, round(sum(area) * 6.283185307179586, 6) AS area FROM areas GROUP BY 1, 2")
def shared_area(spark, d):
    cells, faces = lattice(spark, d)
    return rounded(diffusion.shared_area(faces, cells.select("cell_id", "cluster"), 2), 6, "area")


@query("cluster_distance", f"""WITH {AREAS}, c AS (SELECT cluster, avg(x) AS x, avg(y) AS y FROM cells GROUP BY 1), p AS (SELECT DISTINCT src, dst FROM areas)
SELECT src, dst, round(sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)), 6) AS distance
FROM p JOIN c s ON src = s.cluster JOIN c t ON dst = t.cluster""")
def cluster_distance(spark, d):
    cells, faces = lattice(spark, d)
    pairs = diffusion.shared_area(faces, cells.select("cell_id", "cluster")).select("src", "dst")
    return rounded(diffusion.centroid_distances(mesh.centroids(cells, ["x", "y"]), ["x", "y"], pairs), 6, "distance")


@query("diffusive_fluxes", f"""WITH {AREAS}, c AS (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(viscosity) AS mu FROM cells GROUP BY 1),
p AS (SELECT src, dst, sum(area) AS area FROM areas GROUP BY 1, 2),
f AS (SELECT src, dst, area * t.mu / 0.7 / sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS g, t.a - s.a AS da, t.b - s.b AS db
      FROM p JOIN c s ON src = s.cluster JOIN c t ON dst = t.cluster)
SELECT src, dst, 'a' AS species, round(g * da, 5) + 0 AS flux FROM f UNION ALL SELECT src, dst, 'b', round(g * db, 5) + 0 FROM f""")
def diffusive_fluxes(spark, d):
    return rounded(diffusion.diffusive_fluxes(*lattice(spark, d), ["x", "y"], ["a", "b"]), 5, "flux")


@query("boundary_area", f"""WITH {BOUNDARY}, f AS (SELECT cell_id, cluster, arg_min(area, event_id) AS area FROM boundary WHERE zone_id = 5 GROUP BY 1, 2),
l AS (SELECT DISTINCT cell_id, cluster FROM boundary)
SELECT l.cluster, round(sum(coalesce(area, 0)), 4) AS area FROM l LEFT JOIN f USING (cell_id) GROUP BY 1""")
def boundary_area(spark, d):
    faces, labels = boundary(spark, d)
    return rounded(mesh.boundary_area(faces.where("zone_id = 5"), labels, F.col("event_id")), 4, "area")


@query("mean_composition", f"""WITH {PARTS}, n AS (SELECT cluster, count(*) AS n FROM parts GROUP BY 1),
m AS (SELECT cluster, species, sum(volume) / 50 / any_value(n) AS share FROM parts JOIN n USING (cluster) GROUP BY 1, 2)
SELECT cluster, species, round(share, 9) AS share FROM m WHERE share > 1e-6""")
def mean_composition(spark, d):
    cells = parts(spark, d).select("cluster", F.create_map("species", F.col("volume") / 50, F.lit("TRACE"), F.lit(1e-9)).alias("Y"))
    return rounded(mesh.mean_composition(cells), 9, "share")


@query("axial_extent", f"WITH {LATTICE} SELECT cluster, max(y) AS length, abs(max(y) - min(y)) * 1000 AS extent FROM cells GROUP BY 1")
def axial_extent(spark, d):
    return mesh.axial_extent(lattice(spark, d)[0], "y")


@query("relabel_by", f"""WITH {LATTICE}, r AS (SELECT cluster, row_number() OVER (ORDER BY max(a), cluster) - 1 AS new FROM cells GROUP BY 1)
SELECT cell_id, CAST(new AS INTEGER) AS cluster FROM cells JOIN r USING (cluster)""")
def relabel_by(spark, d):
    return mesh.relabel_by(lattice(spark, d)[0], "a").select("cell_id", "cluster")


# Balances and splits.


@query("reactor_totals", f"""WITH {TOTALS}
SELECT rid, round(incoming, 4) AS incoming, round(outgoing, 4) AS outgoing, round(inlet, 4) AS inlet, round(outlet, 4) AS outlet FROM tot""")
def reactor_totals(spark, d):
    return rounded(network.totals(trade_flows(spark, d), external(spark, d)), 4, "incoming", "outgoing", "inlet", "outlet")


@query("local_balance", f"""WITH {TOTALS} SELECT rid, round(incoming + inlet, 4) AS total_in, round(outgoing + outlet, 4) AS total_out,
round((incoming + inlet - outgoing - outlet) / nullif(greatest(incoming + inlet, outgoing + outlet), 0), 8) AS imbalance FROM tot""")
def local_balance(spark, d):
    return rounded(rounded(network.local_balance(trade_flows(spark, d), external(spark, d)), 4, "total_in", "total_out"), 8, "imbalance")


@query("global_balance", f"""WITH {EXTERNAL} SELECT round(sum(inlet), 2) AS inlet, round(sum(outlet), 2) AS outlet,
round((sum(inlet) - sum(outlet)) / greatest(sum(inlet), sum(outlet)), 8) AS imbalance FROM ext""")
def global_balance(spark, d):
    return rounded(rounded(network.global_balance(external(spark, d)), 2, "inlet", "outlet"), 8, "imbalance")


SPLIT = f"{TOTALS}, split AS (SELECT src, dst, mass / (outgoing + outlet) AS ratio FROM flows JOIN tot ON src = rid)"


@query("mass_split", f"WITH {SPLIT} SELECT src, dst, round(ratio, 8) AS ratio FROM split")
def mass_split(spark, d):
    return rounded(network.mass_split(trade_flows(spark, d), external(spark, d)), 8, "ratio")


@query("small_flows_dropped", f"""WITH {FLOWS}, t AS (SELECT *, mass / sum(mass) OVER (PARTITION BY src) AS share FROM flows)
SELECT src, dst, round(mass, 4) AS mass FROM t WHERE share >= 0.04""")
def small_flows_dropped(spark, d):
    return rounded(filters.drop_small_flows(trade_flows(spark, d), 0.04), 4, "mass")


@query("flows_thresholded", f"""WITH {FLOWS}, m AS (SELECT src, dst, mass * 1e-11 AS mass FROM flows)
SELECT src, dst, round(CASE WHEN abs(mass) < 1e-5 THEN 0 ELSE mass END, 9) AS mass FROM m""")
def flows_thresholded(spark, d):
    small = network.scale_flows(trade_flows(spark, d), 1e-11)
    return rounded(filters.threshold_flows(small, digits=15), 9, "mass")


@query("exchanging_reactors", f"""WITH {FLOWS}, k AS (SELECT src, dst FROM flows WHERE mass > 1e6)
SELECT n_nationkey AS rid, n_name AS name FROM nation WHERE n_nationkey IN (SELECT src FROM k UNION SELECT dst FROM k)""")
def exchanging_reactors(spark, d):
    nations = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("rid"), F.col("n_name").alias("name"))
    return filters.exchanging(nations, trade_flows(spark, d).where("mass > 1e6"))


@query("split_residual", f"""WITH {SPLIT}, m AS (SELECT rid, 1e6 + rid AS M FROM ext), p AS (
  SELECT rid, M AS x FROM m UNION ALL SELECT dst, -ratio * M FROM split JOIN m ON src = rid UNION ALL SELECT rid, -inlet FROM ext)
SELECT rid, round(sum(x), 2) AS residual FROM p GROUP BY 1""")
def split_residual(spark, d):
    ext = external(spark, d)
    through = ext.select("rid", (F.lit(1e6) + F.col("rid")).alias("M"))
    return rounded(network.residual(through, network.mass_split(trade_flows(spark, d), ext), ext), 2, "residual")


# Throughput as a sum of waves: what the inlets send, what its receivers send on, and so forth.
_SOLVED = "WITH RECURSIVE " + SPLIT + """, kept AS (SELECT src, dst, ratio FROM split WHERE ratio >= {least}), waves AS (
  SELECT rid, inlet AS M, 0 AS t FROM ext
  UNION ALL SELECT dst, sum(ratio * M), any_value(t) + 1 FROM waves JOIN kept ON src = rid WHERE t < 400 GROUP BY dst),
through AS (SELECT rid, sum(M) AS M FROM waves GROUP BY 1)
SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, round(ratio * M, 2) AS mass FROM kept JOIN through ON rid = src"""


@query("adapted_flows", _SOLVED.replace("{least}", "0"))
def adapted_flows(spark, d):
    ext = external(spark, d)
    return rounded(network.adapt_flows(network.mass_split(trade_flows(spark, d), ext), ext), 2, "mass")


@query("adjusted_flows", _SOLVED.replace("{least}", "0.02"))
def adjusted_flows(spark, d):
    return rounded(network.adjust_flows(trade_flows(spark, d), external(spark, d), 0.02), 2, "mass")


@query("balanced_flows")
def balanced_flows(spark, d):
    ext = external(spark, d).withColumn("outlet", F.col("inlet"))
    return rounded(network.balance_flows(trade_flows(spark, d), ext, tol=1e-4), 2, "mass")


@query("balanced_residual", f"WITH {EXTERNAL} SELECT rid, 0.0::DOUBLE AS lack FROM ext")
def balanced_residual(spark, d):
    """What balanced flows promise: every reactor takes what it gives."""
    ext = external(spark, d).withColumn("outlet", F.col("inlet"))
    taken = network.totals(network.balance_flows(trade_flows(spark, d), ext, tol=1e-4), ext)
    return rounded(taken.select("rid", (F.col("incoming") + F.col("inlet") - F.col("outgoing") - F.col("outlet")).alias("lack")), 2, "lack")


@query("unbalanced_reactors", f"""WITH {TOTALS}, b AS (SELECT rid, incoming + inlet AS total_in, outgoing + outlet AS total_out FROM tot)
SELECT rid, round(total_in, 4) AS total_in, round(total_out, 4) AS total_out, round((total_in - total_out) / greatest(total_in, total_out), 8) AS imbalance
FROM b WHERE abs(total_in - total_out) > 0.05 * greatest(total_in, total_out)""")
def unbalanced_reactors(spark, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the warning is the point of the function, not of the query
        off = network.warn_balance(trade_flows(spark, d), external(spark, d), 0.05)
    return rounded(rounded(off, 4, "total_in", "total_out"), 8, "imbalance")


_NET = f"""WITH {TOTALS}, r AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS cluster, sum(p_size) AS volume, avg(p_retailprice) AS T
  FROM part GROUP BY 1), e AS (SELECT rid, inlet, row_number() OVER (ORDER BY rid) - 1 + (SELECT max(cluster) + 1 FROM r) AS new FROM ext WHERE inlet <> 0),
g AS (SELECT src, dst, mass FROM flows UNION ALL SELECT new, rid, inlet FROM e),
mf AS (SELECT dst AS rid, sum(mass) AS Mf FROM g GROUP BY 1)
"""


def _network(spark, d):
    own = parts(spark, d).groupBy("cluster").agg(F.sum("volume").alias("volume"), F.avg("T").alias("T"))
    numbered = graph.dense_labels(own)
    return network.assemble(numbered, trade_flows(spark, d), external(spark, d))


@query("network_reactors", _NET + """SELECT CAST(cluster AS INTEGER) AS rid, round(CAST(volume AS DOUBLE), 4) AS volume, CAST(NULL AS DOUBLE) AS tau,
round(coalesce(Mf, 0), 4) AS Mf, round(T, 4) AS T, false AS isinput, coalesce(outlet > 0, false) AS isoutput
FROM r LEFT JOIN mf ON mf.rid = cluster LEFT JOIN ext ON ext.rid = cluster
UNION ALL SELECT CAST(new AS INTEGER), NULL, 1e-6, round(inlet, 4), NULL, true, false FROM e""")
def network_reactors(spark, d):
    return rounded(rounded(_network(spark, d)[0].select("rid", "volume", "tau", "Mf", "T", "isinput", "isoutput"), 4, "volume", "T"), 4, "Mf")


@query("network_flows", _NET + "SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, round(mass, 4) AS mass FROM g")
def network_flows(spark, d):
    return rounded(_network(spark, d)[1], 4, "mass")


_REACTOR_DECKS = _NET + """SELECT CAST(cluster AS INTEGER) AS rid, printf('input.cstr.%d.dic', cluster) AS file,
printf('Dictionary PerfectlyStirredReactor \n { \n     @Type     Isothermal-ConstantPressure;\n     @KineticsFolder     dummy;\n     @Volume    %e m3;\n     @MassFlowRate    %e kg/s;\n} \n',
       CAST(volume AS DOUBLE), coalesce(Mf, 0::DOUBLE)) AS deck FROM r LEFT JOIN mf ON rid = cluster
UNION ALL SELECT CAST(new AS INTEGER), printf('input.cstr.%d.dic', new),
printf('Dictionary PerfectlyStirredReactor \n { \n     @Type     Isothermal-ConstantPressure;\n     @KineticsFolder     dummy;\n     @ResidenceTime    %e s;\n     @MassFlowRate    %e kg/s;\n} \n',
       1e-6::DOUBLE, inlet) FROM e""".replace("\\n", "' || chr(10) || '")


@query("reactor_decks", _REACTOR_DECKS)
def reactor_decks(spark, d):
    return decks.reactor_decks(_network(spark, d)[0].withColumn("isothermal", F.lit(True)))


_CODED = f"""WITH {TOTALS}, m AS (SELECT rid, rid % 3 AS code, (incoming + inlet) * 10000 AS Mf FROM tot WHERE rid IN (SELECT rid FROM ext))
SELECT CAST(rid AS INTEGER) AS rid, printf('input.%s.%d.dic', CASE code WHEN 1 THEN 'pfr' ELSE 'cstr' END, rid) AS file,
CASE code WHEN 1 THEN 'Dictionary PlugFlowReactor \\n' ELSE 'Dictionary PerfectlyStirredReactor \\n' END
|| '{{ \\n      @KineticsFolder     dummy; \\n      @InletStatus        Inlet-Mixture; \\n      @Type               NonIsothermal'
|| CASE code WHEN 1 THEN '; \\n      @ConstantPressure   true; \\n' ELSE '-ConstantPressure; \\n' END
|| CASE code WHEN 2 THEN printf('      @GlobalThermalExchangeCoefficient   %e W/m2/K; \\n      @ExchangeArea               %e m2; \\n      @EnvironmentTemperature     %e K;  \\n',
     5e4::DOUBLE / 900, 1::DOUBLE, 300::DOUBLE) ELSE '' END
|| CASE code WHEN 1 THEN printf('      @Diameter           %e mm; \\n      @Length             %e mm; \\n', 10::DOUBLE, 1000::DOUBLE)
     ELSE printf('      @Volume             %e cm3; \\n', CAST(rid + 1 AS DOUBLE)) END
|| printf('      @MassFlowRate      %e kg/s;   \\n', Mf)
|| printf('}} \\n\\n Dictionary Inlet-Mixture \\n {{ \\n      @Pressure           %e Pa; \\n      @Temperature        %e K;  \\n', 101325::DOUBLE, 1500::DOUBLE)
|| '      @Masses                 O2 0.232000\\n          N2 0.768000; \\n}} \\n' AS deck FROM m""".replace("\\n", "' || chr(10) || '")


def _coded_rows(spark, d):
    air = F.array(*(F.struct(F.lit(s).alias("species"), F.lit(y).alias("y")) for s, y in (("O2", 0.232), ("N2", 0.768))))
    return external(spark, d).select(
        F.col("rid").cast("int").alias("rid"), (F.col("rid") % 3).cast("int").alias("code"), F.lit(1500.0).alias("T"), F.lit(101325.0).alias("P"), air.alias("Y"),
        (F.col("rid") + 1.0).alias("volume"), F.lit(1000.0).alias("L"), F.lit(10.0).alias("D"),
    )


@query("coded_reactor_decks", _CODED)
def coded_reactor_decks(spark, d):
    """Nations as adiabatic tanks, tubes and cooled tanks by turns, in the older dialect."""
    return decks.cgs_decks(decks.coded_reactors(_coded_rows(spark, d), trade_flows(spark, d), external(spark, d), heat=5e4, outlet_t=1200.0))


@query("residence_times", f"""WITH {PARTS}, {TOTALS}, m AS (SELECT CAST(substr(cluster, 7) AS INTEGER) % 25 AS cluster, sum(density * volume) AS mass FROM parts GROUP BY 1)
SELECT cluster, round(mass, 4) AS mass, round(coalesce(incoming + inlet, 0), 4) AS Mf, round(mass / nullif(incoming + inlet, 0), 8) AS tau
FROM m LEFT JOIN tot ON tot.rid = m.cluster""")
def residence_times(spark, d):
    cells = parts(spark, d).withColumn("cluster", F.substring("cluster", 7, 2).cast("int") % 25)  # brands stand for nations
    out = mesh.residence_time(cells, trade_flows(spark, d), external(spark, d))
    return rounded(rounded(out, 4, "mass", "Mf"), 8, "tau")


@query("block_labels", "WITH o AS (SELECT o_orderkey AS cell_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders) "
       "SELECT cell_id, CAST(least(place // (n // 7), 6) AS INTEGER) AS cluster FROM o")
def block_labels(spark, d):
    return vqpca.block_labels(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id")), 7)


@query("mixture_fraction_of_streams", f"""WITH {MASSES}, e AS (SELECT brand, CH4 * 12 / 16 + CO2 * 12 / 44 + CO * 12 / 28 AS c, CH4 * 4 / 16 + H2O * 2 / 18 AS h,
  O2 + CO2 * 32 / 44 + H2O * 16 / 18 + CO * 16 / 28 AS o FROM mass)
SELECT brand, round((2 * c / 12 + 0.5 * h - o / 16 + 0.4 / 16) / (2 * 0.75 / 12 + 0.5 * 0.25 + 0.4 / 16), 8) AS z FROM e""")
def mixture_fraction_of_streams(spark, d):
    """Against an oxidiser other than air."""
    z = chem.mixture_fraction(chem.mole_to_mass(moles()), {"CH4": 1.0}, {"O2": 0.4, "N2": 0.6})
    return rounded(composition(spark, d).select("brand", z.alias("z")), 8, "z")


@query("saved_clustering", "SELECT vec_id + 1 AS cell_id, label AS cluster FROM embeddings")
def saved_clustering(spark, d):
    """Labels written as a result of clustering and read back."""
    folder = new_path(spark, "clustering")
    results.save_clustering(folder, lattice(spark, d)[0].select("cell_id", "cluster"))
    return results.load_table(spark, folder, "labels")


@query("faces_by_position", f"WITH {LATTICE} SELECT c_id0, c_id1, mass_flowrate, area FROM faces")
def faces_by_position(spark, d):
    """Faces under headers of no meaning: cells, flow and area come after three coordinates."""
    path, zero = new_path(spark, "faces"), F.lit(0.0)
    rows = lattice(spark, d)[1].select(zero.alias("p"), zero.alias("q"), zero.alias("r"), F.col("c_id0").alias("s"), F.col("c_id1").alias("t"), F.col("mass_flowrate").alias("u"), F.col("area").alias("v"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return fields.read_faces(spark, path)


def _network_deck_sql(enabled: str, link: str) -> str:
    """SQL of a network's deck: a line after ``@KineticsPreProcessor``, and the line of each connection of ``g``."""
    return _NET + f""", ids AS (SELECT cluster AS rid FROM r UNION ALL SELECT new FROM e),
net AS (SELECT rid, abs(sum(m)) AS m FROM (SELECT src AS rid, mass AS m FROM g UNION ALL SELECT dst, -mass FROM g) GROUP BY 1)
SELECT 'Dictionary ReactorNetwork NL {{ NL@KineticsPreProcessor     kinetic-mechanism;NL{enabled}@MinIterations                     5;NL@MaxIterations                     500;NL'
|| '@AtomicErrorThreshold              1.000000e-03;NL@NonIsothermalErrorThreshold       1.000000e-04;NL@MaxUnbalance                      5.000000e-02;NL'
|| '@PerfectlyStirredReactors NL' || (SELECT string_agg(printf('%d       input.cstr.%d.dic', rid, rid), chr(10) ORDER BY rid) FROM ids)
|| ';NL@InternalConnections     ' || (SELECT string_agg({link}, ' NL' ORDER BY src, dst) FROM g WHERE mass <> 0)
|| ';NL@InputStreams     ' || (SELECT string_agg(printf('%d     %e', new, inlet), ' NL' ORDER BY new) FROM e)
|| '; NL@OutputStreams     ' || (SELECT string_agg(printf('%d     %e', rid, coalesce(m, 0::DOUBLE)), ' NL' ORDER BY rid)
   FROM r JOIN ext ON ext.rid = cluster LEFT JOIN net USING (rid) WHERE outlet > 0)
|| '; NL@SpeciesToMonitor     NO' || chr(9) || 'CO' || chr(9) || ';NL@VerbosityLevel     1;NL}} NL NL'
|| 'Dictionary kinetic-mechanism NL {{ NL@Kinetics          kinetics;NL@Thermodynamics    thermo;NL@Output     kinetics;NL}} NL' AS deck""".replace("NL", "' || chr(10) || '")


@query("network_deck", _network_deck_sql("", "printf('%d     %d     %e', src, dst, mass)"))
def network_deck(spark, d):
    reactors, flows = _network(spark, d)
    return decks.whole_files(decks.network_pieces(reactors, flows, "kinetics", "thermo")).select("deck")


@query("network_deck_diffusion", _network_deck_sql("@DiffusionEnabled     true;NL", """printf('%d     %d     %e     %e     %e', src, dst, mass,
  CASE WHEN src < dst THEN src + 1 ELSE 0 END::DOUBLE, CASE WHEN src < dst THEN dst - src ELSE 0 END::DOUBLE)"""))
def network_deck_diffusion(spark, d):
    """Only connections to a higher number have an area and a distance."""
    reactors, flows = _network(spark, d)
    links = flows.where("src < dst").select("src", "dst", (F.col("src") + 1.0).alias("area"), (F.col("dst") - F.col("src")).cast("double").alias("distance"))
    return decks.whole_files(decks.network_pieces(reactors, flows, "kinetics", "thermo", diffusion=links)).select("deck")


@query("network_files", "SELECT 'input.dic' AS file, deck FROM (" + _network_deck_sql("", "printf('%d     %d     %e', src, dst, mass)") + ") UNION ALL SELECT file, deck FROM (" + _REACTOR_DECKS + ")")
def network_files(spark, d):
    """The folder of a network, written by name and read back."""
    folder = new_path(spark, "network")
    reactors, flows = _network(spark, d)
    decks.write_network(reactors.withColumn("isothermal", F.lit(True)), flows, folder, "kinetics", "thermo")
    return decks.read_decks(spark, folder)


def _older_number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN printf('%d', CAST({x} AS BIGINT)) ELSE printf('%e', {x}) END"


def _older_list(rows: str, line: str, order: str, between: str) -> str:
    return f"(SELECT string_agg({line}, '{between}' ORDER BY {order}) FROM {rows})"


_OLDER_FILES = (
    f"WITH {FLOWS}, {EXTERNAL}, g AS (SELECT src, dst, mass * 10000 AS mass FROM flows), x AS (SELECT rid, inlet * 10000 AS inlet, outlet * 10000 AS outlet FROM ext)\n"
    "SELECT 'input.dic' AS file, 'Dictionary ReactorNetwork NL { NL@KineticsPreProcessor      kinetic-mechanism; NL@MinIterations            5;   NL@MaxIterations            500;  NL'"
    " || '@AtomicErrorThreshold     1e-4;NL@NonIsothermalErrorThreshold' || chr(9) || '1e-4; NL@MaxUnbalance     0.05; NL@PlugFlowReactors     NL'"
    " || " + _older_list("x WHERE rid % 3 = 1", "printf('%d        input.pfr.%d.dic', rid, rid)", "rid", "  NL") + " || ';  NL@PerfectlyStirredReactors     NL'"
    " || " + _older_list("x WHERE rid % 3 <> 1", "printf('%d        input.cstr.%d.dic', rid, rid)", "rid", "  NL") + " || ';  NL@InternalConnections   '"
    " || " + _older_list("g WHERE mass <> 0", f"printf('                  %d   %d   ', src, dst) || {_older_number('mass')}", "src, dst", " NL") + " || '; NL@InputStreams   '"
    " || " + _older_list("x WHERE inlet > 0", f"printf('%d ', rid) || {_older_number('inlet')}", "rid", " NL") + " || '; NL@OutputStreams    '"
    " || " + _older_list("x WHERE outlet > 0", f"printf('%d ', rid) || {_older_number('outlet')}", "rid", " NL") + " || '; NL@SpeciesToMonitor   NO  CO ; NL'"
    " || '@VerbosityLevel   1; NL } NLDictionary kinetic-mechanism NL { NL@Kinetics kinetics; NL@Thermodynamics thermo; NL@Output kinetics; NL } NL' AS deck"
).replace("NL", "' || chr(10) || '")


@query("network_files_older", f"SELECT file, deck FROM ({_OLDER_FILES}) UNION ALL SELECT file, deck FROM ({_CODED})")
def network_files_older(spark, d):
    """The same in the older dialect: nations coded as tanks and tubes, one call for all files."""
    folder = new_path(spark, "network")
    coded = {"heat": 5e4, "outlet_t": 1200.0}
    decks.write_network(_coded_rows(spark, d), trade_flows(spark, d), folder, "kinetics", "thermo", older=True, external=external(spark, d), coded=coded)
    return decks.read_decks(spark, folder)


# Layers: what the customers of each region spend enters, and goes through three nodes and two more in equal shares.
_LAYERS = """WITH spent AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS rid, sum(o_totalprice) AS m
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey),
n AS (SELECT count(*) AS n, sum(m) AS m FROM spent)
"""


def _layers(spark, d) -> network.LayeredNetwork:
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    customer = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    spent = read_table(spark, d, "orders").join(customer, "o_custkey").join(nation, "c_nationkey").groupBy("n_regionkey").agg(F.sum("o_totalprice").alias("m"))
    return network.LayeredNetwork().input_layer([r.m for r in spent.orderBy("n_regionkey").collect()])


@query("layered_network", _LAYERS + """SELECT CAST(rid AS INTEGER) AS src, CAST(n + i AS INTEGER) AS dst, round(spent.m / 3, 3) AS mass FROM spent, n, range(3) t(i)
UNION ALL SELECT CAST(n + i AS INTEGER), CAST(n + 3 + j AS INTEGER), round(n.m / 3 / 2, 3) FROM n, range(3) t(i), range(2) u(j)""")
def layered_network(spark, d):
    flows, _ = _layers(spark, d).connected_layer(3).output_layer(2).flows(spark)
    return rounded(flows, 3, "mass")


@query("layered_reactors", _LAYERS + """SELECT CAST(rid AS INTEGER) AS rid, 'PSR' AS rtype, round(m, 3) AS Mf, true AS isinput, false AS isoutput FROM spent
UNION ALL SELECT CAST(n + i AS INTEGER), 'PSR', round(m / 3, 3), false, false FROM n, range(3) t(i)
UNION ALL SELECT CAST(n + 3 + j AS INTEGER), 'PFR', round(m / 2, 3), false, true FROM n, range(2) u(j)""")
def layered_reactors(spark, d):
    """A layered network as the tables that decks are written from."""
    net = _layers(spark, d).connected_layer(3).output_layer(2, "PFR")
    return rounded(net.tables(spark)[0].select("rid", "rtype", "Mf", "isinput", "isoutput"), 3, "Mf")


# Scaling.

FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_GROUP = ["l_returnflag", "l_linestatus"]
_FACTORS = {
    "auto": "stddev_pop({c}) OVER ()", "pareto": "sqrt(stddev_pop({c}) OVER ())", "range": "(max({c}) OVER () - min({c}) OVER ())",
    "vast": "(stddev_pop({c}) OVER () * avg({c}) OVER ())", "max": "max({c}) OVER ()", "level": "avg({c}) OVER ()", "none": "1.0",
    "max_abs": "max(abs({c})) OVER ()", "vast_squared": "(var_pop({c}) OVER () / avg({c}) OVER ())",
}


for _name, _by in (("kurtosis", "avg({c})"), ("max_kurtosis", "max(abs({c}))"), ("range_kurtosis", "(max({c}) - min({c}))")):
    _FACTORS[_name] = "(SELECT var_pop({c}) * (kurtosis_pop({c}) + 3) * (kurtosis_pop({c}) + 3) / " + _by + " FROM lineitem)"


def _digest(scaled: DataFrame, digits: int = 8) -> DataFrame:
    aggs = [f(F.col(c)).alias(f"{n}_{c}") for c in FOUR for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return rounded(scaled.groupBy(*_GROUP).agg(*aggs), digits, *(f"{n}_{c}" for c in FOUR for n in ("avg", "min", "max")))


def _digest_sql(inner: str, digits: int = 8) -> str:
    cols = ", ".join(f"round({n}({c}), {digits}) + 0.0 AS {n}_{c}" for c in FOUR for n in ("avg", "min", "max"))
    return f"SELECT l_returnflag, l_linestatus, {cols} FROM ({inner}) GROUP BY 1, 2"


def _scale_query(method: str):
    factor = _FACTORS[method]
    inner = "SELECT l_returnflag, l_linestatus, " + ", ".join(f"({c} - avg({c}) OVER ()) / {factor.format(c=c)} AS {c}" for c in FOUR) + " FROM lineitem"

    @query(f"scale_{method}", _digest_sql(inner))
    def run(spark, d):
        rows = read_table(spark, d, "lineitem").select(*_GROUP, *FOUR)
        return _digest(scaling.Scaler(method).fit(rows, FOUR).transform(rows))


for _method in _FACTORS:
    _scale_query(_method)


@query("scale_round_trip", _digest_sql("SELECT * FROM lineitem"))
def scale_round_trip(spark, d):
    rows = read_table(spark, d, "lineitem").select(*_GROUP, *FOUR)
    scaler = scaling.Scaler("auto").fit(rows, FOUR)
    return _digest(scaler.inverse_transform(scaler.transform(rows)))


@query("scale_within_groups", _digest_sql("SELECT l_returnflag, l_linestatus, " + ", ".join(
    f"({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g AS {c}" for c in FOUR) + " FROM lineitem WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)"))
def scale_within_groups(spark, d):
    return _digest(scaling.scale(read_table(spark, d, "lineitem").select(*_GROUP, *FOUR), FOUR, by=_GROUP))


_ROW = "(" + " + ".join(FOUR) + ") / 4"
_GRAND = "(" + " + ".join(f"avg({c}) OVER ()" for c in FOUR) + ") / 4"


@query("double_centered", _digest_sql("SELECT l_returnflag, l_linestatus, " + ", ".join(f"{c} - {_ROW} - avg({c}) OVER () + {_GRAND} AS {c}" for c in FOUR) + " FROM lineitem", 5))
def double_centered(spark, d):
    return _digest(scaling.center_rows_and_columns(read_table(spark, d, "lineitem").select(*_GROUP, *FOUR), FOUR), 5)


@query("condition_bins", f"WITH {PARTS} SELECT i AS bin, count(*) AS n, round(sum(volume), 2) AS volume FROM parts JOIN range(8) t(i) ON T >= 900 + 12.5 * i AND T <= 900 + 12.5 * (i + 1) GROUP BY 1")
def condition_bins(spark, d):
    binned = scaling.condition(parts(spark, d), "T", scaling.bin_edges(900.0, 1000.0, 8))
    return binned.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


# Features and chemistry.


@query("features_reduced", f"WITH {PARTS} SELECT cell_id, T AS f0, round(pow(volume, 1.5), 6) AS f1, round(least(log10(tau), 1), 6) + 0.0 AS f2 FROM parts")
def features_reduced(spark, d):
    cols = features.reduced(F.col("T"), F.col("volume"), F.col("tau"))
    return rounded(parts(spark, d).select("cell_id", *(c.alias(f"f{i}") for i, c in enumerate(cols))), 6, "f1", "f2")


@query("features_velocity", f"WITH {PARTS} SELECT cell_id, volume AS f0, density AS f1, round(-log10(least(tau, 1)), 6) + 0.0 AS f2 FROM parts")
def features_velocity(spark, d):
    cols = features.velocity_only(F.col("volume"), F.col("density"), F.col("tau"))
    return rounded(parts(spark, d).select("cell_id", *(c.alias(f"f{i}") for i, c in enumerate(cols))), 6, "f2")


@query("features_roots", f"WITH {COMPOSITION} SELECT brand, " + ", ".join(f"round(sqrt({s}), 8) AS {s}" for s in WEIGHTS) + " FROM comp")
def features_roots(spark, d):
    cols = features.square_roots(list(moles().values()))
    return rounded(composition(spark, d).select("brand", *(c.alias(s) for c, s in zip(cols, WEIGHTS, strict=True))), 8, *WEIGHTS)


@query("features_log", f"WITH {LATTICE} SELECT cell_id, round(CASE WHEN a = 0 THEN -100 ELSE ln(abs(a)) END, 6) + 0.0 AS log_a FROM cells")
def features_log(spark, d):
    return rounded(lattice(spark, d)[0].select("cell_id", features.log_scale(F.col("a")).alias("log_a")), 6, "log_a")


@query("features_reduced_set", f"""WITH {MASSES}, top AS (SELECT max(H2O + CO2) AS m FROM mass)
SELECT brand, 300.0::DOUBLE AS f0, round(CO2, 8) AS f1, round(CO, 8) AS f2, round((H2O + CO2) / m, 8) AS f3, round(pow(least(ln(2.5), 1), 2), 8) AS f4,
       round(pow(4, 1.5), 8) AS f5, 7.0::DOUBLE AS f6 FROM mass, top""")
def features_reduced_set(spark, d):
    rows = composition(spark, d)
    masses = chem.mole_to_mass(moles())
    top = rows.agg(F.max(masses["H2O"] + masses["CO2"])).first()[0]
    cols = features.reduced_set(F.lit(300.0), moles(), top, F.lit(4.0), F.lit(2.5), F.lit(7.0), species=("CO2", "CO"))
    return rounded(rows.select("brand", *(c.alias(f"f{i}") for i, c in enumerate(cols))), 8, *(f"f{i}" for i in range(1, 6)))


@query("species_labels", "SELECT p_partkey, upper(split_part(trim('   molef-' || lower(p_type)), '-', 2)) AS label FROM part")
def species_labels(spark, d):
    part = read_table(spark, d, "part")
    return part.select("p_partkey", chem.species_label(F.concat(F.lit("   molef-"), F.lower("p_type"))).alias("label"))


@query("molecular_weights", f"WITH {COMPOSITION} SELECT brand, round({_TOTAL_MASS}, 8) AS weight FROM comp")
def molecular_weights(spark, d):
    """The mean molecular weight of each brand's composition."""
    weight = sum((F.col(s) * chem.molecular_weight(s) for s in WEIGHTS), F.lit(0.0))
    return rounded(composition(spark, d).select("brand", weight.alias("weight")), 8, "weight")


@query("mole_to_mass", f"WITH {MASSES} SELECT brand, " + ", ".join(f"round({s}, 8) AS {s}" for s in WEIGHTS) + " FROM mass")
def mole_to_mass(spark, d):
    return rounded(composition(spark, d).select("brand", *(c.alias(s) for s, c in chem.mole_to_mass(moles()).items())), 8, *WEIGHTS)


@query("mixture_fraction", f"""WITH {MASSES}, e AS (SELECT brand, CH4 * 12 / 16 + CO2 * 12 / 44 + CO * 12 / 28 AS c, CH4 * 4 / 16 + H2O * 2 / 18 AS h,
  O2 + CO2 * 32 / 44 + H2O * 16 / 18 + CO * 16 / 28 AS o FROM mass)
SELECT brand, round((2 * c / 12 + 0.5 * h - o / 16 + 0.233 / 16) / (2 * 0.75 / 12 + 0.5 * 0.25 + 0.233 / 16), 8) AS z FROM e""")
def mixture_fraction(spark, d):
    return rounded(composition(spark, d).select("brand", chem.mixture_fraction(chem.mole_to_mass(moles()), {"CH4": 1.0}).alias("z")), 8, "z")


@query("progress_variable", f"WITH {COMPOSITION} SELECT brand, round(CO2 + 0.5 * CO + 2 * H2O, 8) AS progress FROM comp")
def progress_variable(spark, d):
    return rounded(composition(spark, d).select("brand", chem.progress_variable(moles(), "CO2:1, CO:0.5, H2O:2").alias("progress")), 8, "progress")


@query("progress_variable_of_map", f"WITH {COMPOSITION} SELECT brand, round(CO2 + 0.5 * CO + 2 * H2O, 8) AS progress FROM comp")
def progress_variable_of_map(spark, d):
    y = F.create_map(*(x for s in WEIGHTS for x in (F.lit(s), F.col(s))))
    return rounded(composition(spark, d).select("brand", chem.map_sum(y, {"CO2": 1, "CO": 0.5, "H2O": 2}).alias("progress")), 8, "progress")


@query("equivalence_ratio", f"""WITH {COMPOSITION} SELECT brand, round((2 * (CH4 + CO2 + CO) + 0.5 * (4 * CH4 + 2 * H2O)) / (2 * O2 + 2 * CO2 + H2O + CO), 8) AS phi FROM comp""")
def equivalence_ratio(spark, d):
    return rounded(composition(spark, d).select("brand", chem.equivalence_ratio(moles()).alias("phi")), 8, "phi")


@query("species_kept", f"WITH {PARTS} SELECT cell_id, species FROM parts WHERE volume / 50 > 0.5")
def species_kept(spark, d):
    y = filters.keep_species(F.create_map("species", F.col("volume") / 50, F.lit("TRACE"), F.lit(0.1)), 0.5)
    return parts(spark, d).select("cell_id", F.explode(F.map_keys(y)).alias("species"))


# Faces, cells and clusters.

_FACES = "faces AS (SELECT l_suppkey AS c_id0, l_partkey % 50 - 1 AS c_id1, l_quantity AS mass_flowrate FROM lineitem)"


def _sold_faces(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("c_id0"), (F.col("l_partkey") % 50 - 1).alias("c_id1"), F.col("l_quantity").alias("mass_flowrate"))


@query("interior_faces", f"WITH {_FACES} SELECT c_id0, c_id1, mass_flowrate FROM faces WHERE c_id1 NOT IN (-1, 0)")
def interior_faces(spark, d):
    return filters.split_boundary(_sold_faces(spark, d))[0]


@query("boundary_faces", f"WITH {_FACES} SELECT c_id0, c_id1, mass_flowrate FROM faces WHERE c_id1 IN (-1, 0)")
def boundary_faces(spark, d):
    return filters.split_boundary(_sold_faces(spark, d))[1]


@query("clean_connections", f"WITH {_FACES} SELECT DISTINCT c_id0, c_id1 FROM faces WHERE c_id1 NOT IN (-1, 0)")
def clean_connections(spark, d):
    return filters.clean_connections(_sold_faces(spark, d))


@query("cells_downstream", f"WITH {LATTICE} SELECT cell_id, x, y FROM cells WHERE x > 12 AND abs(y) < 5")
def cells_downstream(spark, d):
    return filters.near_axis(filters.downstream(lattice(spark, d)[0], "x", 12), "y", 5).select("cell_id", "x", "y")


@query("pruned_clusters", f"""WITH {PARTS}, k AS (SELECT cluster FROM parts GROUP BY 1 HAVING count(*) > 2 AND (var_pop(volume) > 205 OR var_pop(density) > 205))
SELECT cell_id, cluster FROM parts WHERE cluster IN (SELECT cluster FROM k)""")
def pruned_clusters(spark, d):
    return filters.prune_clusters(parts(spark, d), ["volume", "density"], 205.0).select("cell_id", "cluster")


@query("adjacency", f"WITH {LATTICE} SELECT c_id0 AS cell_id, c_id1 AS neighbour FROM faces UNION SELECT c_id1, c_id0 FROM faces")
def adjacency(spark, d):
    return graph.adjacency(lattice(spark, d)[1])


@query("weighted_edges", f"""WITH {LATTICE} SELECT c_id0, c_id1, round(list_sum(list_transform(range(1, len(p.embedding) + 1),
  lambda i: (p.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (p.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))) / 1e-6, 2) AS weight
FROM faces JOIN cells p ON p.cell_id = c_id0 JOIN cells q ON q.cell_id = c_id1""")
def weighted_edges(spark, d):
    cells, faces = lattice(spark, d)
    return rounded(graph.weighted_edges(faces, cells.select("cell_id", "features")), 2, "weight")


PARTS_OF = f"""WITH RECURSIVE {LATTICE}, inner_faces AS (SELECT c_id0 AS s, c_id1 AS t FROM faces WHERE c0 = c1 UNION SELECT c_id1, c_id0 FROM faces WHERE c0 = c1),
reach AS (SELECT cell_id, cell_id AS other FROM cells UNION SELECT r.cell_id, t FROM reach r JOIN inner_faces ON s = r.other),
comp AS (SELECT cell_id, min(other) AS component FROM reach GROUP BY 1), own AS (SELECT cell_id, cluster, component FROM cells JOIN comp USING (cell_id))
"""


@query("cluster_components", PARTS_OF + "SELECT cell_id, cluster, component FROM own")
def cluster_components(spark, d):
    cells, faces = lattice(spark, d)
    return graph.cluster_components(faces, cells.select("cell_id", "cluster"))


@query("components_per_cluster", PARTS_OF + "SELECT cluster, count(DISTINCT component) AS n_components FROM own GROUP BY 1")
def components_per_cluster(spark, d):
    cells, faces = lattice(spark, d)
    return graph.components_per_cluster(faces, cells.select("cell_id", "cluster"))


@query("connectivity_study", PARTS_OF + """, s AS (SELECT cluster, component, count(*) AS size FROM own GROUP BY 1, 2)
SELECT cluster, component, size, CAST(row_number() OVER (PARTITION BY cluster ORDER BY size DESC, component) AS INTEGER) AS rank,
       CAST(sum(size) OVER (PARTITION BY cluster) - max(size) OVER (PARTITION BY cluster) AS BIGINT) AS spared FROM s""")
def connectivity_study(spark, d):
    cells, faces = lattice(spark, d)
    return graph.connectivity_study(faces, cells.select("cell_id", "cluster"))


@query("dense_labels", f"WITH {LATTICE} SELECT cell_id, CAST(dense_rank() OVER (ORDER BY cluster * 3 + 5) - 1 AS INTEGER) AS cluster FROM cells")
def dense_labels(spark, d):
    cells = lattice(spark, d)[0]
    return graph.dense_labels(cells.select("cell_id", (F.col("cluster") * 3 + 5).alias("cluster")))


def _labels(spark, d):
    cells, faces = lattice(spark, d)
    return faces, cells.select("cell_id", "cluster"), cells.select("cell_id", "volume")


@query("reassigned_nodes")
def reassigned_nodes(spark, d):
    return graph.reassign_nodes(*_labels(spark, d), method="cells", passes=100_000)


@query("reassigned_by_distance")
def reassigned_by_distance(spark, d):
    cells, _ = lattice(spark, d)
    return graph.reassign_nodes(*_labels(spark, d), method="cells", passes=100_000, features=cells.select("cell_id", "features"))


@query("reassigned_is_connected", "SELECT 0::BIGINT AS clusters_in_parts, (SELECT count(*) FROM embeddings) AS cells, true AS dense")
def reassigned_is_connected(spark, d):
    """What reassignment promises, whatever it moves: connected clusters of all cells, numbered without gaps."""
    faces, labels, volumes = _labels(spark, d)
    faces = materialize(faces.select("c_id0", "c_id1"), "faces")  # read before and after
    out = materialize(graph.reassign_nodes(faces, labels, volumes, passes=100_000), "labels")
    parts = graph.components_per_cluster(faces, out).agg(F.count_if(F.col("n_components") > 1).alias("clusters_in_parts"))
    return parts.crossJoin(out.agg(F.count(F.lit(1)).alias("cells"), (F.max("cluster") + 1 == F.count_distinct("cluster")).alias("dense")))


@query("matched_clusters")
def matched_clusters(spark, d):
    faces, labels, volumes = _labels(spark, d)
    return graph.match_clusters(faces, graph.reassign_nodes(faces, labels, volumes, passes=100_000), volumes, 5)


def _merging(which: str, order: str) -> str:
    """SQL of merging clusters one by one: of the pairs ``src, dst, n, v`` that ``which`` allows, the first in ``order``, until there is none."""
    return f"""WITH RECURSIVE {LATTICE}, nodes AS (SELECT cluster, sum(volume) AS v, row_number() OVER (ORDER BY cluster) AS pos FROM cells GROUP BY 1),
one AS (SELECT DISTINCT least(c_id0, c_id1) AS a, greatest(c_id0, c_id1) AS b FROM faces WHERE c_id0 <> c_id1),
two AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
pairs AS (SELECT x.pos AS ia, y.pos AS ib, count(*) AS n FROM two JOIN cells p ON p.cell_id = two.a JOIN cells q ON q.cell_id = two.b
  JOIN nodes x ON x.cluster = p.cluster JOIN nodes y ON y.cluster = q.cluster WHERE x.pos <> y.pos GROUP BY 1, 2),
steps AS (
  SELECT 0 AS step, (SELECT list(cluster ORDER BY pos) FROM nodes) AS m
  UNION ALL
  SELECT step + 1, list_transform(m, lambda x: CASE WHEN x = move.src THEN move.dst ELSE x END) FROM (
    SELECT step, m, (SELECT {{'src': src, 'dst': dst}} FROM (SELECT m[ia] AS src, m[ib] AS dst, sum(n) AS n FROM pairs WHERE m[ia] <> m[ib] GROUP BY 1, 2)
      JOIN (SELECT m[pos] AS k, sum(v) AS v FROM nodes GROUP BY 1) ON k = src WHERE {which} ORDER BY {order} LIMIT 1) AS move FROM steps)
  WHERE move IS NOT NULL),
last AS (SELECT arg_max(m, step) AS m FROM steps)
SELECT cell_id, CAST(dense_rank() OVER (ORDER BY m[pos]) - 1 AS INTEGER) AS cluster FROM cells JOIN nodes USING (cluster), last"""


@query("small_clusters_removed", _merging("v < 200", "src, n DESC, dst"))
def small_clusters_removed(spark, d):
    return graph.remove_small_clusters(*_labels(spark, d), least=200.0)


@query("merged_clusters", _merging("list_unique(m) > 4", "v, src, n DESC, dst"))
def merged_clusters(spark, d):
    """The clusters as they are, in parts or not, merged to four."""
    return graph.match_clusters(*_labels(spark, d), 4)


# Models.

_POINTS = """pts AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"""


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _lloyd(name: str, before: str) -> str:
    return f"""{name}_d AS (SELECT p.vec_id, p.e, c.k, {_dist("p.e", "c.c")} AS d2 FROM pts p CROSS JOIN {before} c),
{name}_n AS (SELECT vec_id, any_value(e) AS e, min(d2) AS d2, arg_min(k, (d2, k)) AS k FROM {name}_d GROUP BY 1),
{name} AS (SELECT k, list_transform(range(1, 65), lambda i: list_avg(list_transform(es, lambda x: x[i]))) AS c FROM (SELECT k, list(e) AS es FROM {name}_n GROUP BY 1))"""


@query("kmeans_two_passes", f"""WITH {_POINTS}, c0 AS (SELECT CAST(vec_id AS INTEGER) AS k, e AS c FROM pts WHERE vec_id < 10), {_lloyd("c1", "c0")}, {_lloyd("c2", "c1")}, {_lloyd("c3", "c2")}
SELECT k AS cluster, count(*) AS n, round(sum(d2), 6) AS "within" FROM c3_n GROUP BY 1""")
def kmeans_two_passes(spark, d):
    cells = lattice(spark, d)[0].select("cell_id", "features")
    first = cells.where("cell_id <= 10").orderBy("cell_id").collect()
    centres = kmeans.lloyd(cells, np.array([r.features for r in first]), 2)
    near = kmeans.nearest(cells, centres)
    return rounded(near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance2").alias("within")), 6, "within")


def _swept(k: int) -> str:
    """SQL of two passes from the first ``k`` rows and the index of the clusters they lead to, as ``k``K_i."""
    a, b, c, d = (f"k{k}_{x}" for x in "abcd")
    return f"""{a} AS (SELECT CAST(vec_id AS INTEGER) AS k, e AS c FROM pts WHERE vec_id < {k}), {_lloyd(b, a)}, {_lloyd(c, b)}, {_lloyd(d, c)},
k{k}_s AS (SELECT k, any_value(c) AS c, avg(sqrt({_dist("e", "c")})) AS s FROM {d}_n JOIN {d} USING (k) GROUP BY 1),
k{k}_i AS (SELECT avg(w) AS index FROM (SELECT a.k, max((a.s + b.s) / sqrt({_dist("a.c", "b.c")})) AS w FROM k{k}_s a JOIN k{k}_s b ON a.k <> b.k GROUP BY 1))"""


@query("choice_of_k", f"""WITH {_POINTS}, {_swept(3)}, {_swept(6)}
SELECT 3 AS k, round(index, 6) AS index FROM k3_i UNION ALL SELECT 6, round(index, 6) FROM k6_i""")
def choice_of_k(spark, d):
    """The index of two numbers of clusters, both in each scan."""
    cells = lattice(spark, d)[0].select("cell_id", "features")
    first = np.array([r.features for r in cells.where("cell_id <= 6").orderBy("cell_id").collect()])
    found = kmeans.sweep(cells, [first[:3], first], passes=2, tol=0.0)
    return spark.createDataFrame([(k, round(i, 6)) for k, (_, i) in zip((3, 6), found, strict=True)], "k int, index double")


@query("davies_bouldin", f"""WITH {_POINTS}, c AS (SELECT label AS k, list_transform(range(1, 65), lambda i: list_avg(list_transform(es, lambda x: x[i]))) AS c
  FROM (SELECT label, list(e) AS es FROM pts GROUP BY 1)), s AS (SELECT label AS k, any_value(c) AS c, avg(sqrt({_dist("e", "c")})) AS s FROM pts JOIN c ON label = k GROUP BY 1),
w AS (SELECT a.k, max((a.s + b.s) / sqrt({_dist("a.c", "b.c")})) AS w FROM s a JOIN s b ON a.k <> b.k GROUP BY 1)
SELECT round(avg(w), 6) AS index FROM w""")
def davies_bouldin(spark, d):
    value = vqpca.davies_bouldin(lattice(spark, d)[0].select("cluster", "features"))
    return spark.createDataFrame([(round(value, 6),)], "index double")


@query("covariance", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem" for i, a in enumerate(FOUR) for j, b in enumerate(FOUR)) + ")")
def covariance(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.array(*FOUR).alias("features"))
    _, cov = pca.covariance(*pca.moments(rows)[0])
    return rounded(spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(4) for j in range(4)], "i long, j long, cov double"), 4, "cov")


@query("principal_components")
def principal_components(spark, d):
    rows = scaling.Scaler("auto").fit(read_table(spark, d, "lineitem"), FOUR).transform(read_table(spark, d, "lineitem").select(*FOUR))
    model = pca.fit_pca(rows.select(F.array(*FOUR).alias("features")), level=1.0)
    out = [(i, round(float(v), 6), [round(float(x), 6) for x in model.basis[:, i]]) for i, v in enumerate(model.values)]
    return spark.createDataFrame(out, "component int, eigenvalue double, loadings array<double>")


@query("principal_residual", "SELECT i AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, 4.0::DOUBLE AS trace FROM range(4) t(i)")
def principal_residual(spark, d):
    """Components of the scaled table are unit eigenvectors of its correlations, which Spark computes apart; values add up to 4."""
    line = read_table(spark, d, "lineitem").select(*FOUR)
    model = pca.fit_pca(scaling.Scaler("auto").fit(line, FOUR).transform(line).select(F.array(*FOUR).alias("features")), level=1.0)
    corr = np.array(line.agg(*(F.corr(a, b) for a in FOUR for b in FOUR)).first()).reshape(4, 4)
    n = line.count()
    scale = n / (n - 1)  # scaled by the deviation over n, moments over n - 1
    off = np.abs(corr @ model.basis - model.basis * (model.values / scale)).max(axis=0)
    length, trace = np.linalg.norm(model.basis, axis=0), float((model.values / scale).sum())
    out = [(i, float(off[i]), float(length[i]), trace) for i in range(4)]
    return rounded(spark.createDataFrame(out, "component long, residual double, length double, trace double"), 6, "residual", "length", "trace")


@query("vqpca_labels")
def vqpca_labels(spark, d):
    cells = lattice(spark, d)[0].select("cell_id", "features")
    return rounded(vqpca.VQPCA(3, rule="n_eigs", q=4, itmax=10).fit(cells, init="uniform").labels(cells), 6, "error")


@query("vqpca_report")
def vqpca_report(spark, d):
    cells = lattice(spark, d)[0].select("cell_id", "features")
    model = vqpca.VQPCA(3, rule="n_eigs", q=4, itmax=10).fit(cells, init="random")
    out = {**model.report(), "ilpca": model.ilpca()}
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in out.items()], "name string, value double")


@query("mixture_labels")
def mixture_labels(spark, d):
    rows = parts(spark, d).select("cell_id", F.array("density", F.col("volume") / 50).alias("features"))
    return kmeans.gmm_labels(rows, 3, passes=20)


def _em(new: str, old: str) -> str:
    """SQL of one pass of expectation and maximisation: long model ``old(k, i, m, v, w)`` to ``new``, by way of ``new``_r, the rows' shares."""
    return f"""{new}_l AS (SELECT vec_id, k, ln(any_value(w)) - 0.5 * sum(ln(2 * pi() * v) + (x - m) * (x - m) / v) AS l FROM xs JOIN {old} USING (i) GROUP BY 1, 2),
{new}_r AS (SELECT vec_id, k, exp(l - max(l) OVER p) / sum(exp(l - top)) OVER p AS r FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM {new}_l) WINDOW p AS (PARTITION BY vec_id)),
{new} AS (SELECT k, i, sum(r * x) / sum(r) AS m, sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2) + 0.05 AS v, sum(r) / (SELECT count(*) FROM pts) AS w
  FROM xs JOIN {new}_r USING (vec_id) GROUP BY 1, 2)"""


_MIXTURE = f"""WITH {_POINTS}, xs AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(e) AS x FROM pts), spread AS (SELECT i, var_pop(x) + 0.05 AS v FROM xs GROUP BY 1),
m0 AS (SELECT CAST(vec_id AS INTEGER) AS k, i, x AS m, v, 1.0::DOUBLE / 3 AS w FROM xs JOIN spread USING (i) WHERE vec_id < 3), {_em("m1", "m0")}, {_em("m2", "m1")}, {_em("m3", "m2")}
"""


def _two_passes(spark, d):
    cells = lattice(spark, d)[0].select("cell_id", "features")
    first = cells.where("cell_id <= 3").orderBy("cell_id").collect()
    start = mixtures.DiagonalMixture.start(cells, np.array([r.features for r in first]))
    return cells, start.fit(cells, passes=2, tol=0.0)


@query("diagonal_mixture", _MIXTURE + "SELECT k AS cluster, CAST(i AS INTEGER) AS feature, round(m, 6) + 0.0 AS mean, round(v, 6) AS variance, round(w, 6) AS weight FROM m2")
def diagonal_mixture(spark, d):
    """Weights, means and variances after two passes from the first three rows."""
    _, model = _two_passes(spark, d)
    k, p = model.means.shape
    rows = [(c, i + 1, float(model.means[c, i]), float(model.variances[c, i]), float(model.weights[c])) for c in range(k) for i in range(p)]
    return rounded(spark.createDataFrame(rows, "cluster int, feature int, mean double, variance double, weight double"), 6, "mean", "variance", "weight")


@query("diagonal_mixture_labels", _MIXTURE + "SELECT vec_id + 1 AS cell_id, arg_max(k, r) AS cluster, round(max(r), 6) AS share FROM m3_r GROUP BY 1")
def diagonal_mixture_labels(spark, d):
    cells, model = _two_passes(spark, d)
    return rounded(model.labels(cells), 6, "share")


@query("kmeans_labels")
def kmeans_labels(spark, d):
    return kmeans.kmeans_labels(lattice(spark, d)[0].select("cell_id", "features"), 10)


# Results on cells, and files.


@query("contour_errors", f"""WITH {PARTS}, r AS (SELECT cluster, avg(T) AS mean FROM parts GROUP BY 1)
SELECT cell_id, volume AS x, tau AS y, T AS cell_value, round(mean, 6) AS reactor_value, round(abs(T - mean), 6) AS error FROM parts p JOIN r USING (cluster)""")
def contour_errors(spark, d):
    cells = parts(spark, d).withColumns({"x": F.col("volume"), "y": F.col("tau")})
    reactors = cells.groupBy(F.col("cluster").alias("rid")).agg(F.avg("T").alias("T"))
    return rounded(compare.compare_contours(cells, reactors, "T"), 6, "reactor_value", "error")


@query("axial_profile", f"""WITH {LATTICE}, r AS (SELECT cluster, avg(a) AS t FROM cells GROUP BY 1)
SELECT cell_id, y AS along, a AS cell_value, round(t, 6) AS reactor_value FROM cells JOIN r USING (cluster) WHERE abs(x) < 2""")
def axial_profile(spark, d):
    cells = lattice(spark, d)[0]
    reactors = cells.groupBy(F.col("cluster").alias("rid")).agg(F.avg("a").alias("a"))
    return rounded(compare.axial_profile(cells, reactors, "a", width=2), 6, "reactor_value")


@query("line_widths", f"WITH {FLOWS} SELECT src, dst, round(3 * mass / (SELECT max(mass) FROM flows), 6) AS width FROM flows")
def line_widths(spark, d):
    empty = spark.createDataFrame([], "rid int, volume double")
    return rounded(compare.network_drawing(empty, trade_flows(spark, d))[1], 6, "width")


@query("node_sizes", f"WITH {PARTS}, v AS (SELECT cluster, sum(volume) AS v FROM parts GROUP BY 1) SELECT cluster AS rid, round(greatest(ln(v) * ln(v), 0.1), 6) AS size FROM v")
def node_sizes(spark, d):
    reactors = parts(spark, d).groupBy(F.col("cluster").alias("rid")).agg(F.sum("volume").alias("volume"))
    return rounded(compare.network_drawing(reactors, trade_flows(spark, d))[0], 6, "size")


@query("cluster_points", f"WITH {LATTICE} SELECT x, y, cluster FROM cells")
def cluster_points(spark, d):
    return compare.cluster_points(lattice(spark, d)[0])


@query("face_areas", f"WITH {LATTICE} SELECT c_id0, c_id1, round(mass_flowrate, 8) + 0.0 AS mass_flowrate, CASE WHEN c_id0 % 2 = 0 THEN area END AS area FROM faces")
def face_areas(spark, d):
    """Areas of half the faces, from entries of the other orientation."""
    faces = lattice(spark, d)[1]
    areas = faces.where("c_id0 % 2 = 0").select(F.col("c_id1").alias("c_id0"), F.col("c_id0").alias("c_id1"), "area")
    return rounded(diffusion.face_areas(faces.drop("area"), areas).select("c_id0", "c_id1", "mass_flowrate", "area"), 8, "mass_flowrate")


@query("turned_faces", f"WITH {LATTICE} SELECT c_id0, c_id1, round(mass_flowrate * 2 * pi(), 8) + 0.0 AS mass_flowrate, round(area * 2 * pi(), 8) AS area FROM faces")
def turned_faces(spark, d):
    return rounded(mesh.turn_faces(lattice(spark, d)[1], 2), 8, "mass_flowrate", "area")


@query("species_set", f"WITH {PARTS} SELECT cell_id, T AS f0, density AS f1, tau AS f2 FROM parts")
def species_set(spark, d):
    """Temperature and those species of the set of major ones that are there."""
    cells = parts(spark, d).select("cell_id", "T", F.col("density").alias("molef-o2"), F.col("tau").alias("molef-ch4"), F.col("volume").alias("molef-n2"))
    rows = features.species_features(cells, "major", "T")
    return rows.select("cell_id", *(F.get("features", i).alias(f"f{i}") for i in range(3)))


@query("custom_features", f"WITH {PARTS} SELECT cell_id, T, volume * 2 AS own FROM parts")
def custom_features(spark, d):
    cells = parts(spark, d)
    return features.custom_features(cells.select("cell_id", "T"), cells.select("cell_id", (F.col("volume") * 2).alias("own")))


@query("cell_files", f"WITH {PARTS} SELECT cell_id, volume AS x, tau AS y, T AS temperature, density AS CH4, volume FROM parts")
def cell_files(spark, d):
    """Cells written as exports of a flow solver, and scanned."""
    rows, paths = parts(spark, d), {}
    own = {"solution": ["T AS ` temperature`", "density AS `   molef-ch4`"], "volume": ["volume AS ` cell-volume`"]}
    for name, columns in own.items():
        paths[name] = new_path(spark, name)
        rows.selectExpr("cell_id AS cellnumber", "volume AS ` x-coordinate`", "tau AS ` y-coordinate`", *columns).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(paths[name])
    return fields.read_cells(spark, paths, 2).withColumnRenamed("molef-ch4", "CH4")


@query("face_files", f"WITH {LATTICE} SELECT c_id0, c_id1, mass_flowrate, area FROM faces")
def face_files(spark, d):
    """Faces written as an export with its coordinates, and scanned by name."""
    path = new_path(spark, "faces")
    lattice(spark, d)[1].selectExpr("0.0 AS x", "0.0 AS y", "0.0 AS z", "c_id0", "c_id1", "mass_flowrate", "area").write.option("header", True).option("sep", "\t").csv(path)
    return fields.read_faces(spark, path)


@query("boundary_files", f"WITH {BOUNDARY} SELECT cell_id, zone_id, mass_flowrate, area, 0.0::DOUBLE AS heat_flux FROM boundary")
def boundary_files(spark, d):
    path = new_path(spark, "boundary")
    boundary(spark, d)[0].selectExpr("cell_id", "zone_id", "mass_flowrate", "area", "0.0").write.option("sep", "\t").csv(path)
    return fields.read_boundary(spark, path)


def _solver_folder(spark, d, *files: str) -> str:
    """Files of a solver, one folder a reactor: a temperature tells a brand's number, shares its composition."""
    folder, names = new_path(spark, "solver"), list(WEIGHTS)
    shares = [F.col(s).cast("string") for s in names]
    columns = lambda tail, at: " ".join(f"{s}{tail}({i + at})" for i, s in enumerate(names))
    hot = lambda t: (F.lit(t) + F.col("cluster")).cast("string")
    spoiled = "9 " * (3 + 2 * len(names))  # an earlier row, which the last one replaces
    text = {
        "Output.out": F.concat(
            F.lit(f"t[s](1) T[K](5) P[Pa](6) {columns('_x', 10)} {columns('_w', 20)}\n{spoiled}\n"),
            F.concat_ws(" ", F.lit("0.5"), hot(1000.0), F.lit("101325.0"), *shares, *((F.col(s) / 2).cast("string") for s in names)),
        ),
        "log.inlet": F.concat(F.lit(f"Iteration(1) T[K](2) {columns('', 3)}\n{spoiled}\n"), F.concat_ws(" ", F.lit("7"), hot(500.0), *shares)),
        "ROPA.out": F.concat(F.lit("CO2 total\nCO other 1 2 3 4 5\nCO2 1 2 3 4 5 "), F.col("CO2").cast("string"), F.lit(" 8\nCO2 again 2 3 4 5 6\n")),
    }
    rows = graph.dense_labels(composition(spark, d).withColumnRenamed("brand", "cluster")).select("cluster", *(text[f].alias(f) for f in files))
    each = rows.unpivot(["cluster"], [f"`{f}`" for f in files], "name", "text").select(F.format_string("Reactor.%d/%s", "cluster", "name").alias("file"), "text")
    write_named(each, folder, [])  # one folder a reactor, as the solver writes them
    return folder


_SOLVER = f"WITH {COMPOSITION}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY brand) - 1 AS INTEGER) AS rid FROM comp) "
_SHARES = ", ".join(f"round({s}, 8) AS {s}" for s in WEIGHTS)


@query("solver_outputs", _SOLVER + f"SELECT rid, CAST(1000 + rid AS DOUBLE) AS T, 101325.0::DOUBLE AS P, {_SHARES} FROM n")
def solver_outputs(spark, d):
    last = solver.read_outputs(spark, _solver_folder(spark, d, "Output.out"))
    return rounded(last.select("rid", "T", "P", *(F.col("X")[s].alias(s) for s in WEIGHTS)), 8, *WEIGHTS)


@query("solver_table", _SOLVER + "SELECT rid, variable, basis, round(value, 8) AS value FROM (" + " UNION ALL ".join(
    f"SELECT rid, '{s}' AS variable, '{b}' AS basis, {s} * {f} AS value FROM n" for s in WEIGHTS for b, f in (("mole", 1), ("mass", 0.5))) + ")")
def solver_table(spark, d):
    rows = solver.read_tables(spark, _solver_folder(spark, d, "Output.out")).where("basis is not null")
    return rounded(rows.select("rid", "variable", "basis", "value"), 8, "value")


@query("solver_inputs", _SOLVER + f"SELECT rid, CAST(500 + rid AS DOUBLE) AS T, {_SHARES} FROM n")
def solver_inputs(spark, d):
    last = solver.read_inputs(spark, _solver_folder(spark, d, "log.inlet"))
    return rounded(last.select("rid", "T", *(F.col("X")[s].alias(s) for s in WEIGHTS)), 8, *WEIGHTS)


@query("solver_variable", _SOLVER + "SELECT rid, round(CO2, 8) AS value FROM n")
def solver_variable(spark, d):
    return rounded(solver.read_variable(spark, _solver_folder(spark, d, "Output.out"), "CO2"), 8, "value")


@query("solver_rates", _SOLVER + "SELECT rid, round(CO2, 8) AS rate FROM n")
def solver_rates(spark, d):
    return rounded(solver.read_rates(spark, _solver_folder(spark, d, "ROPA.out"), "CO2"), 8, "rate")


@query("highest_temperature", _SOLVER + "SELECT CAST(1000 + max(rid) AS DOUBLE) AS T FROM n")
def highest_temperature(spark, d):
    return spark.createDataFrame([(solver.highest_temperature(spark, _solver_folder(spark, d, "Output.out")),)], "T double")


def _deck_file(spark, d) -> str:
    path = new_path(spark, "deck")
    network_deck(spark, d).select(F.col("deck").alias("value")).coalesce(1).write.text(path)
    return path


@query("deck_outlets", _NET + """, net AS (SELECT rid, abs(sum(m)) AS m FROM (SELECT src AS rid, mass AS m FROM g UNION ALL SELECT dst, -mass FROM g) GROUP BY 1)
SELECT CAST(rid AS INTEGER) AS rid, CAST(printf('%e', m) AS DOUBLE) AS mass FROM r JOIN ext ON ext.rid = cluster JOIN net USING (rid) WHERE outlet > 0""")
def deck_outlets(spark, d):
    return solver.outlet_reactors(spark, _deck_file(spark, d))


@query("deck_flows", _NET + "SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(printf('%e', mass) AS DOUBLE) AS mass FROM g WHERE mass <> 0")
def deck_flows(spark, d):
    return solver.deck_flows(spark, _deck_file(spark, d))


@query("outlet_species", _SOLVER + f""", {EXTERNAL}, o AS (SELECT * FROM n JOIN ext USING (rid) WHERE outlet > 0)
SELECT rid, 'CO' AS species, round(CO, 8) AS x FROM o UNION ALL SELECT rid, 'H2O', round(H2O, 8) FROM o""")
def outlet_species(spark, d):
    """Names match in any case."""
    return rounded(solver.outlet_species(spark, _solver_folder(spark, d, "Output.out"), _deck_file(spark, d), ["co", "h2o"]), 8, "x")
