"""Linear systems of a network as tables: unknowns are rows, products are a join and an aggregate.

Vectors are columns of one table of nodes, written once a product, which cuts the
plan and survives lost executors. The driver gets inner products, a few numbers
a step; the rest of a step is arithmetic on columns. No matrix is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshnet.plans.scratch import materialize

#: Steps of an iteration that does not end.
STEPS = 1000
#: Share of the right-hand side down to which one run of steps takes the residual, and runs at most.
DROP, RUNS = 1e-13, 4


class NotSolved(ValueError):
    """The system has no solution, or steps did not find it."""


def _dot(a: str, b: str) -> Column:
    return F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{a}_{b}")


def _times(entries: DataFrame, state: DataFrame, vector: str, out: str, diagonal: Column) -> DataFrame:
    """``state`` with ``out``, the product ``diagonal * vector - entries * vector``; ``entries`` are ``row, col, value``."""
    part = entries.join(state.select(F.col("rid").alias("col"), F.col(vector).alias("__v")), "col")
    sums = part.groupBy(F.col("row").alias("rid")).agg(F.sum(F.col("value") * F.col("__v")).alias("__sum"))
    return state.join(sums, "rid", "left").withColumn(out, diagonal * F.col(vector) - F.coalesce("__sum", F.lit(0.0))).drop("__sum")


def solve(entries: DataFrame, rhs: DataFrame, tol: float = 1e-13, steps: int = STEPS) -> DataFrame:
    """``rid, x`` of ``x - entries x = b``, for ``entries(row, col, value)`` and ``rhs(rid, b)`` with a row for each unknown.

    Stabilised biconjugate gradients. Each run ends at a small residual of its own; the true residual then begins
    the next, until it is ``tol`` of the largest unknown.
    """
    one = F.lit(1.0)
    state = materialize(rhs.select("rid", "b", F.lit(0.0).alias("x"), F.col("b").alias("r")), "unknowns")
    last = None
    for _ in range(RUNS):
        largest = state.agg(F.max(F.abs("r")).alias("r"), F.max(F.abs("x")).alias("x"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
        if not largest.r or largest.r <= tol * max(largest.x, 1e-300) or (last is not None and largest.r >= last / 2 and largest.r <= 1e3 * tol * largest.x):
            return state.select("rid", "x")
        last, rho = largest.r, largest.rr
        state = state.select("rid", "b", "x", "r", F.col("r").alias("q"), F.col("r").alias("p"))
        for _ in range(steps):
            first = materialize(_times(entries, state, "p", "v", one), "solver")
            qv = first.agg(_dot("q", "v")).first()[0]
            if not qv:
                break
            alpha = rho / qv
            half = first.withColumn("s", F.col("r") - F.lit(alpha) * F.col("v"))
            second = materialize(_times(entries, half, "s", "t", one), "solver")
            d = second.agg(_dot("t", "s"), _dot("t", "t"), _dot("q", "s"), _dot("q", "t"), _dot("s", "s")).first()
            omega = d.t_s / d.t_t if d.t_t else 0.0
            left = d.s_s - 2 * omega * d.t_s + omega * omega * d.t_t
            after = d.q_s - omega * d.q_t
            beta = after / rho * (alpha / omega) if omega else 0.0
            r = F.col("s") - F.lit(omega) * F.col("t")
            state = second.select(
                "rid", "b", (F.col("x") + F.lit(alpha) * F.col("p") + F.lit(omega) * F.col("s")).alias("x"), r.alias("r"), "q",
                (r + F.lit(beta) * (F.col("p") - F.lit(omega) * F.col("v"))).alias("p"),
            )
            rho = after
            if left <= (DROP * DROP) * largest.rr or not rho or not omega:
                break
        true = _times(entries, state.select("rid", "b", "x"), "x", "ax", one)
        state = materialize(true.select("rid", "b", "x", (F.col("b") - F.col("ax")).alias("r")), "unknowns")
    largest = state.agg(F.max(F.abs("r")).alias("r"), F.max(F.abs("x")).alias("x")).first()
    if not largest.r <= 1e-9 * largest.x:  # NaN too
        raise NotSolved(f"a residual of {largest.r} is left; some mass may have no way out")
    return state.select("rid", "x")


def potentials(links: DataFrame, rhs: DataFrame, tol: float, steps: int = STEPS) -> DataFrame:
    """``rid, y`` with ``L y = b`` within ``tol`` for the Laplacian of ``links(src, dst)``, each of weight 1, and ``rhs(rid, b)``.

    Conjugate gradients over the nodes that have links. Only differences of ``y`` are determined; ``b`` is taken less its
    mean, which no difference can bring about.
    """
    ends = links.where("src <> dst").select(F.col("src").alias("row"), F.col("dst").alias("col"))
    both = ends.unionByName(ends.select(F.col("col").alias("row"), F.col("row").alias("col")))
    entries = materialize(both.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("value")), "laplacian")
    degree = entries.groupBy(F.col("row").alias("rid")).agg(F.sum("value").alias("d"))
    known = materialize(degree.join(rhs, "rid", "left").select("rid", "d", F.coalesce("b", F.lit(0.0)).alias("b")), "unknowns")
    start = known.agg(F.avg("b").alias("mean"), F.max(F.abs("b")).alias("most")).first()
    if start.mean is None:
        return known.select("rid", F.lit(0.0).alias("y"))
    r = F.col("b") - F.lit(start.mean)
    state = known.select("rid", "d", F.lit(0.0).alias("y"), r.alias("r"), (r / F.col("d")).alias("p"))
    rz = None
    for _ in range(steps):
        now = materialize(_times(entries, state, "p", "v", F.col("d")), "solver")
        over = lambda a, b: F.sum(F.col(a) * F.col(b) / F.col("d"))
        s = now.agg(_dot("p", "v"), F.sum(F.col("p") * F.col("p") * F.col("d")).alias("pp"), over("r", "v").alias("rv"), over("v", "v").alias("vv"), over("r", "r").alias("rr"), F.max(F.abs("r")).alias("most")).first()
        if s.most <= max(tol, DROP * start.most):
            return now.select("rid", "y")
        if s.p_v <= 1e-15 * s.pp:  # what is left is no difference along a link
            break
        rz = s.rr if rz is None else rz
        alpha = rz / s.p_v
        after = max(s.rr - 2 * alpha * s.rv + alpha * alpha * s.vv, 0.0)
        r = F.col("r") - F.lit(alpha) * F.col("v")
        state = now.select("rid", "d", (F.col("y") + F.lit(alpha) * F.col("p")).alias("y"), r.alias("r"), (r / F.col("d") + F.lit(after / rz) * F.col("p")).alias("p"))
        rz = after
        if not rz:
            return state.select("rid", "y")
    raise NotSolved(f"a residual of {s.most} is left; each part of the network must balance with its surroundings")
