"""Reactor networks: balances, splits, linear solves and assembly.

Flows are ``src, dst, mass`` rows, and stay tables in the solves too, whatever
the number of reactors.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshnet.operators.filters import significant
from meshnet.operators.solvers import potentials, solve
from meshnet.plans.scratch import materialize

#: Residence time of an inlet's pseudo-reactor, and the temperature below which kinetics are not corrected.
INLET_TAU, LEAST_CORRECTED_T = 1e-6, 1000.0


#: Share of what a reactor takes up to which its outlet is rounding.
LEAST_OUTLET = 1e-10


class Unbalanced(ValueError):
    """Mass that enters and leaves differ by more than the tolerance."""


def totals(flows: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """``rid, incoming, outgoing, inlet, outlet`` of every reactor; ``external`` has ``rid, inlet, outlet``."""
    ends = flows.select(F.col("src").alias("rid"), F.lit(0.0).alias("incoming"), F.col("mass").alias("outgoing"), F.lit(0.0).alias("inlet"), F.lit(0.0).alias("outlet"))
    ends = ends.unionByName(
        flows.select(F.col("dst").alias("rid"), F.col("mass").alias("incoming"), F.lit(0.0).alias("outgoing"), F.lit(0.0).alias("inlet"), F.lit(0.0).alias("outlet"))
    )
    if external is not None:
        ends = ends.unionByName(external.select("rid", F.lit(0.0).alias("incoming"), F.lit(0.0).alias("outgoing"), "inlet", "outlet"))
    return ends.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("incoming", "outgoing", "inlet", "outlet")))


def local_balance(flows: DataFrame, external: DataFrame) -> DataFrame:
    """``rid, total_in, total_out, imbalance``: what enters less what leaves, over the larger."""
    t = totals(flows, external).select("rid", (F.col("incoming") + F.col("inlet")).alias("total_in"), (F.col("outgoing") + F.col("outlet")).alias("total_out"))
    return t.withColumn("imbalance", F.coalesce(F.try_divide(F.col("total_in") - F.col("total_out"), F.greatest("total_in", "total_out")), F.lit(0.0)))


def global_balance(external: DataFrame) -> DataFrame:
    """One row ``inlet, outlet, imbalance``."""
    t = external.agg(F.coalesce(F.sum("inlet"), F.lit(0.0)).alias("inlet"), F.coalesce(F.sum("outlet"), F.lit(0.0)).alias("outlet"))
    return t.withColumn("imbalance", F.coalesce(F.try_divide(F.col("inlet") - F.col("outlet"), F.greatest("inlet", "outlet")), F.lit(0.0)))


def check_balance(flows: DataFrame, external: DataFrame, tol: float = 1e-2) -> tuple[float, float]:
    """The global and the largest local imbalance; above ``tol`` in size is an error."""
    whole = global_balance(external).first().imbalance
    worst = local_balance(flows, external).agg(F.max_by("imbalance", F.abs("imbalance"))).first()[0] or 0.0
    if abs(whole) > tol:
        raise Unbalanced(f"global imbalance {whole:.3e}")
    if abs(worst) > tol:
        raise Unbalanced(f"local imbalance {worst:.3e}")
    return whole, worst


def warn_balance(flows: DataFrame, external: DataFrame, tol: float = 1e-2) -> DataFrame:
    """Reactors out of balance by more than ``tol``, with a warning if there are any."""
    off = local_balance(flows, external).where(F.abs("imbalance") > tol)
    if n := off.count():
        warnings.warn(f"{n} reactors are out of balance by more than {tol}", stacklevel=2)
    return off


def mass_split(flows: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """``src, dst, ratio``: the share of all that leaves a reactor, outlet included."""
    if external is None:
        total = F.sum("mass").over(Window.partitionBy("src"))
        return flows.select("src", "dst", F.try_divide("mass", total).alias("ratio"))
    flows = materialize(flows.select("src", "dst", "mass"), "flows")  # read for the totals and for the shares
    out = totals(flows, external).select(F.col("rid").alias("src"), (F.col("outgoing") + F.col("outlet")).alias("total"))
    return flows.join(out, "src").select("src", "dst", F.try_divide("mass", "total").alias("ratio"))


def throughput(ratios: DataFrame, external: DataFrame, n: int | None = None) -> DataFrame:
    """``rid, M``: what passes each reactor when ``inlet`` enters and splits are ``ratios``: ``(I - ratio^T) M = inlet``."""
    entries = materialize(ratios.groupBy(F.col("dst").alias("row"), F.col("src").alias("col")).agg(F.sum("ratio").alias("value")), "splits")
    into = materialize(external.groupBy("rid").agg(F.sum("inlet").alias("b")), "inlets")
    ends = entries.select(F.col("col").alias("rid")).unionByName(entries.select(F.col("row").alias("rid"))).unionByName(into.select("rid"))
    if n:
        ends = ends.unionByName(ratios.sparkSession.range(n).select(F.col("id").cast(external.schema["rid"].dataType).alias("rid")))
    rhs = ends.distinct().join(into, "rid", "left").select("rid", F.coalesce("b", F.lit(0.0)).alias("b"))
    return solve(entries, rhs).withColumnRenamed("x", "M")


def adapt_flows(ratios: DataFrame, external: DataFrame, n: int | None = None) -> DataFrame:
    """Flows that keep the split ``ratios`` under new inlets (see :func:`throughput`)."""
    ratios = materialize(ratios.select("src", "dst", "ratio"), "ratios")
    through = throughput(ratios, external, n).withColumnRenamed("rid", "src")
    shares = ratios.groupBy("src", "dst").agg(F.sum("ratio").alias("ratio")).where("ratio <> 0")
    flows = shares.join(through, "src").select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), (F.col("ratio") * F.col("M")).alias("mass"))
    return flows.where("mass <> 0")


def adjust_flows(flows: DataFrame, external: DataFrame, least: float = 1e-5) -> DataFrame:
    """Splits under ``least`` are dropped and the flows solved anew."""
    return adapt_flows(mass_split(flows, external).where(F.col("ratio") >= least), external)


def balance_flows(flows: DataFrame, external: DataFrame, passes: int = 100, tol: float = 1e-12, least: float = 1e-5) -> DataFrame:
    """The least change of the flows that balances every reactor; flows under ``least``, or pressed below 0, are dropped on the way.

    The least change is the difference of potentials at a flow's ends. What no flow can carry, that of a reactor
    without any and that by which all inlets and outlets differ, stays.
    """
    own = flows.groupBy("src", "dst").agg(F.sum("mass").alias("mass")).where(F.abs("mass") >= least)
    now = materialize(own, "balanced")
    for _ in range(passes):
        t = totals(now, external).where("incoming <> 0 or outgoing <> 0")
        lack = materialize(t.select("rid", (F.col("outgoing") + F.col("outlet") - F.col("incoming") - F.col("inlet")).alias("b")), "lack")
        size = lack.agg(F.avg("b").alias("mean"), F.max("b").alias("high"), F.min("b").alias("low")).first()
        if size.mean is None or max(size.high - size.mean, size.mean - size.low) <= tol:
            break
        y = potentials(now, lack, tol / 4)
        moved = now.join(y.select(F.col("rid").alias("src"), F.col("y").alias("from")), "src", "left").join(y.select(F.col("rid").alias("dst"), F.col("y").alias("to")), "dst", "left")
        mass = F.col("mass") + F.coalesce(F.col("to") - F.col("from"), F.lit(0.0))
        now = materialize(moved.select("src", "dst", mass.alias("mass")).where("mass > 0"), "balanced")
    return now.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "mass")


def residual(through: DataFrame, ratios: DataFrame, external: DataFrame) -> DataFrame:
    """``rid, residual``: throughput less what the splits bring and the inlet; one join and one aggregate."""
    brought = ratios.join(through.select(F.col("rid").alias("src"), "M"), "src").select(F.col("dst").alias("rid"), (-F.col("ratio") * F.col("M")).alias("x"))
    parts = through.select("rid", F.col("M").alias("x")).unionByName(brought).unionByName(external.select("rid", (-F.col("inlet")).alias("x")))
    return parts.groupBy("rid").agg(F.sum("x").alias("residual"))


def scale_flows(flows: DataFrame, factor: float = 10.0) -> DataFrame:
    """All flows times a factor, for a solver that needs larger numbers."""
    return flows.withColumn("mass", F.col("mass") * F.lit(float(factor)))


def round_flows(flows: DataFrame, digits: int = 6) -> DataFrame:
    return flows.withColumn("mass", significant(F.col("mass"), digits))


def assemble(attributes: DataFrame, flows: DataFrame, external: DataFrame, correct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reactors and flows with a pseudo-reactor for each inlet, numbered after the others in order of cluster.

    ``attributes`` has ``cluster, volume, T`` and, to ``correct`` kinetics, ``Tmean, Tvar``.
    """
    n = (attributes.agg(F.max("cluster")).first()[0] or 0) + 1
    # As many rows as clusters with an inlet stand in the window's single partition.
    entries = external.where("inlet <> 0").select(
        (F.row_number().over(Window.orderBy("rid")) - 1 + F.lit(n)).cast("int").alias("new"), F.col("rid").cast("int").alias("into"), "inlet"
    )
    grown = flows.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "mass").unionByName(
        entries.select(F.col("new").alias("src"), F.col("into").alias("dst"), F.col("inlet").alias("mass"))
    )
    received = grown.groupBy(F.col("dst").alias("rid")).agg(F.sum("mass").alias("Mf"))
    ends = external.select("rid", (F.col("outlet") > 0).alias("isoutput"))
    known = set(attributes.columns)
    tmean = F.col("Tmean") if "Tmean" in known else F.lit(None).cast("double")
    tvar = F.col("Tvar") if "Tvar" in known else F.lit(None).cast("double")
    corrected = F.lit(correct) & F.coalesce(tmean >= LEAST_CORRECTED_T, F.lit(False))
    real = (
        attributes.select(F.col("cluster").cast("int").alias("rid"), "volume", "T", tmean.alias("Tmean"), tvar.alias("Tvar"), corrected.alias("kincorr"))
        .join(received, "rid", "left")
        .join(ends, "rid", "left")
        .select("rid", F.lit("PSR").alias("rtype"), "volume", F.lit(None).cast("double").alias("tau"), F.coalesce("Mf", F.lit(0.0)).alias("Mf"), "T",
                F.lit(False).alias("isinput"), F.coalesce("isoutput", F.lit(False)).alias("isoutput"), "kincorr", "Tmean", "Tvar")
    )
    pseudo = entries.select(
        F.col("new").alias("rid"), F.lit("PSR").alias("rtype"), F.lit(None).cast("double").alias("volume"), F.lit(INLET_TAU).alias("tau"), F.col("inlet").alias("Mf"),
        F.lit(None).cast("double").alias("T"), F.lit(True).alias("isinput"), F.lit(False).alias("isoutput"), F.lit(False).alias("kincorr"),
        F.lit(None).cast("double").alias("Tmean"), F.lit(None).cast("double").alias("Tvar"),
    )
    return real.unionByName(pseudo), grown


def check_network(reactors: DataFrame, flows: DataFrame) -> None:
    """An error unless reactors are numbered 0, 1, ... once each, and flows go between them alone, none below 0."""
    seen = reactors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rid").alias("ids"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).first()
    if not seen.n or seen.n != seen.ids or (seen.lo, seen.hi) != (0, seen.n - 1):
        raise ValueError(f"{seen.n} reactors have {seen.ids} numbers from {seen.lo} to {seen.hi}")
    ends = flows.select(F.explode(F.array("src", "dst")).alias("rid"))
    if lost := ends.join(reactors.select("rid"), "rid", "left_anti").limit(1).collect():
        raise ValueError(f"a flow names reactor {lost[0].rid}, which is none")
    if flows.where("mass < 0 or mass is null").limit(1).count():
        raise ValueError("a flow is below 0 or null")


def given_network(
    spark: SparkSession, inlets: Sequence[float], outlets: Sequence[float], flows: Sequence[Sequence[float]],
    volumes: Sequence[float], temperatures: Sequence[float], adapt: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Reactors and flows of a network that the caller brings as vectors and a square matrix.

    With ``adapt`` the flows keep their split and are solved anew for the inlets; else they must balance.
    """
    n = len(volumes)
    sizes = {"inlets": len(inlets), "outlets": len(outlets), "flows": len(flows), "temperatures": len(temperatures)}
    if wrong := [f"{k} are {v}" for k, v in sizes.items() if v != n]:
        raise ValueError(f"there are {n} reactors, but {', '.join(wrong)}")
    if any(len(row) != n for row in flows):
        raise ValueError("the matrix of flows is not square")
    if min([*inlets, *outlets, *(x for row in flows for x in row)], default=0) < 0:
        raise ValueError("a flow is below 0")
    external = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(inlets, outlets, strict=True))], "rid int, inlet double, outlet double")
    links = spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(flows) for j, x in enumerate(row) if x], "src int, dst int, mass double")
    if adapt:
        links = adapt_flows(mass_split(links, external), external, n)
        external = _net_outlets(links, external)
    check_balance(links, external, 1e-2)
    cells = spark.createDataFrame([(i, float(v), float(t)) for i, (v, t) in enumerate(zip(volumes, temperatures, strict=True))], "cluster int, volume double, T double")
    reactors, links = assemble(cells, links, external)
    check_network(reactors, links)
    return reactors, links


def _net_outlets(flows: DataFrame, external: DataFrame) -> DataFrame:
    """``external`` with what each reactor takes beyond what it gives as its outlet."""
    net = totals(flows, external.withColumn("outlet", F.lit(0.0)))
    taken = F.col("incoming") + F.col("inlet")
    out = taken - F.col("outgoing")
    return net.select("rid", "inlet", F.when(F.abs(out) <= LEAST_OUTLET * taken, F.lit(0.0)).otherwise(out).alias("outlet"))


@dataclass
class LayeredNetwork:
    """A network drawn layer by layer: each new node takes an equal share from every node before it."""

    #: name to (reactor number, type, parameters)
    nodes: dict[str, tuple[int, str, dict]] = field(default_factory=dict)
    links: list[tuple[str, str, float]] = field(default_factory=list)
    inlets: dict[str, float] = field(default_factory=dict)
    layers: list[list[str]] = field(default_factory=list)
    round4: bool = False

    def _add(self, names: list[str], rtype: str, params: list[dict]) -> None:
        if rtype not in ("PSR", "PFR"):
            raise ValueError("a reactor is PSR or PFR")
        for name, own in zip(names, params, strict=True):
            self.nodes[name] = (len(self.nodes), rtype, own)
        self.layers.append(names)

    def input_layer(self, masses: list[float]) -> LayeredNetwork:
        names = [f"I{i}" for i in range(len(masses))]
        self._add(names, "PSR", [{"tau": INLET_TAU, "Mf": m} for m in masses])
        self.inlets = dict(zip(names, masses, strict=True))
        return self

    def _connect(self, names: list[str], rtype: str, params: list[dict] | None, tau: float, length: float, diameter: float) -> LayeredNetwork:
        if not self.layers:
            raise ValueError("begin with an input layer")
        before, share = self.layers[-1], 1 / len(names)
        default = {"tau": tau} if rtype == "PSR" else {"L": length, "D": diameter}
        self._add(names, rtype, params or [dict(default) for _ in names])
        share = round(share, 4) if self.round4 else share
        self.links += [(a, b, share) for a in before for b in names]
        return self

    def connected_layer(self, n: int, rtype: str = "PSR", params: list[dict] | None = None, tau: float = 1e-3, length: float = 1.0, diameter: float = 0.01) -> LayeredNetwork:
        return self._connect([f"H{len(self.layers) - 1}{i}" for i in range(n)], rtype, params, tau, length, diameter)

    def output_layer(self, n: int, rtype: str = "PSR", params: list[dict] | None = None, tau: float = 1e-3, length: float = 1.0, diameter: float = 0.01) -> LayeredNetwork:
        return self._connect([f"O{i}" for i in range(n)], rtype, params, tau, length, diameter)

    def flows(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """``src, dst, mass``, and ``rid, inlet, outlet``: nodes of the last layer let out what they take."""
        number = {name: n for name, (n, _, _) in self.nodes.items()}
        ratios = spark.createDataFrame([(number[a], number[b], r) for a, b, r in self.links], "src int, dst int, ratio double")
        inlet = spark.createDataFrame([(number[a], float(m)) for a, m in self.inlets.items()], "rid int, inlet double")
        out = adapt_flows(ratios, inlet, len(self.nodes))
        net = _net_outlets(out, inlet)
        if net.where("outlet < 0").limit(1).count():
            raise Unbalanced("a node lets out more than it takes")
        return out, net

    def tables(self, spark: SparkSession, isothermal: bool = True) -> tuple[DataFrame, DataFrame]:
        """Reactors and flows as decks take them; the nodes' parameters are columns (tau, volume, L, D, T, P, ...)."""
        flows, external = self.flows(spark)
        names = sorted({c for _, _, own in self.nodes.values() for c in own})
        rows = [(number, rtype, *(float(own[c]) if c in own else None for c in names)) for number, rtype, own in self.nodes.values()]
        reactors = spark.createDataFrame(rows, ", ".join(["rid int, rtype string", *(f"{c} double" for c in names)]))
        for kind, need in (("PSR", ("tau", "volume")), ("PFR", ("L",))):
            given = F.coalesce(*(F.col(c) if c in names else F.lit(None).cast("double") for c in need))
            if bad := reactors.where((F.col("rtype") == kind) & given.isNull()).limit(1).collect():
                raise ValueError(f"reactor {bad[0].rid} is a {kind} without {' or '.join(need)}")
        taken = totals(flows, external).select("rid", (F.col("incoming") + F.col("inlet")).alias("Mf"))
        ends = external.select("rid", (F.col("inlet") > 0).alias("isinput"), (F.col("outlet") > 0).alias("isoutput"))
        reactors = reactors.drop("Mf").join(taken, "rid").join(ends, "rid").withColumn("isothermal", F.lit(isothermal))
        check_network(reactors, flows)
        return reactors, flows

    def check(self, spark: SparkSession) -> None:
        """Local balance within 1 %, global within 1e-12."""
        flows, external = self.flows(spark)
        last = [self.nodes[name][0] for name in self.layers[-1]]
        leak = external.where(~F.col("rid").isin(last)).agg(F.sum("outlet")).first()[0] or 0.0
        if abs(leak) > 1e-9 * sum(self.inlets.values()) or abs(global_balance(external).first().imbalance) > 1e-12:
            raise Unbalanced("the network loses mass on the way")
        check_balance(flows, external, 1e-2)
