import numpy as np
import pytest
from pyspark.sql import functions as F

from meshnet.operators import network
from meshnet.operators.solvers import NotSolved, potentials, solve


def test_solve_as_dense(spark):
    """Recirculating splits of many reactors, some of which pass nothing on."""
    rng, n = np.random.default_rng(3), 300
    a = np.zeros((n, n))
    for i in range(n):
        for j in rng.choice(n, 4, replace=False):
            a[i, j] += rng.random()
    a *= rng.uniform(0.5, 0.98, n)[:, None] / a.sum(axis=1, keepdims=True)
    a[::50] = 0
    b = rng.random(n) * 1e6
    want = np.linalg.solve(np.eye(n) - a.T, b)
    entries = spark.createDataFrame([(int(j), int(i), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row int, col int, value double")
    rhs = spark.createDataFrame(list(enumerate(b.tolist())), "rid int, b double")
    got = {r.rid: r.x for r in solve(entries, rhs).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist(), rel=1e-11)
    assert {r.x for r in solve(entries, rhs.withColumn("b", F.lit(0.0))).collect()} == {0.0}


def test_no_way_out(spark):
    closed = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "row int, col int, value double")
    with pytest.raises(NotSolved):
        solve(closed, spark.createDataFrame([(0, 1.0), (1, 0.0)], "rid int, b double")).collect()


def test_potentials_as_least_squares(spark):
    rng, n = np.random.default_rng(4), 40
    links = [(int(a), int(b)) for a, b in rng.integers(0, n, (140, 2))] + [(i, i + 1) for i in range(n - 1)]
    b = rng.normal(size=n)
    b -= b.mean()
    rows = np.zeros((n, len(links)))
    for e, (s, d) in enumerate(links):
        rows[s, e] -= 1
        rows[d, e] += 1
    want = np.linalg.lstsq(rows, b, rcond=None)[0]
    frame = spark.createDataFrame(links, "src int, dst int")
    y = {r.rid: r.y for r in potentials(frame, spark.createDataFrame(list(enumerate(b.tolist())), "rid int, b double"), 1e-12).collect()}
    assert [y[d] - y[s] for s, d in links] == pytest.approx(want.tolist(), abs=1e-9)
    two = spark.createDataFrame([(0, 1), (2, 3)], "src int, dst int")
    with pytest.raises(NotSolved):  # one part has too much, the other too little
        potentials(two, spark.createDataFrame([(0, 1.0), (2, -1.0)], "rid int, b double"), 1e-9)
    assert potentials(two.where("src < 0"), spark.createDataFrame([(0, 1.0)], "rid int, b double"), 1e-9).collect() == []


def test_a_hundred_thousand_reactors_are_balanced(spark):
    n = 100_000
    ids = spark.range(n).select(F.col("id").cast("int").alias("src"))
    hops = F.explode(F.array(F.lit(1), F.lit(7919), F.lit(31337), F.lit(54321)))
    flows = ids.select("src", hops.alias("hop")).select("src", ((F.col("src") + F.col("hop")) % n).cast("int").alias("dst"), F.lit(10.0).alias("mass"))
    noisy = flows.withColumn("mass", F.col("mass") + F.pmod(F.xxhash64("src", "dst"), F.lit(1000)) / 1000)
    inlet = F.when(F.col("src") % 1000 == 0, 2.0).otherwise(0.0)
    external = ids.select(F.col("src").alias("rid"), inlet.alias("inlet"), F.when(F.col("src") % 1000 == 500, 2.0).otherwise(0.0).alias("outlet"))
    done = network.balance_flows(noisy, external, tol=1e-3)
    off = network.totals(done, external).agg(F.max(F.abs(F.col("incoming") + F.col("inlet") - F.col("outgoing") - F.col("outlet")))).first()[0]
    assert off <= 1e-3 and done.count() == 4 * n
    moved = done.join(noisy.withColumnRenamed("mass", "was"), ["src", "dst"]).agg(F.max(F.abs(F.col("mass") - F.col("was")))).first()[0]
    assert 0 < moved < 2.0


def test_flows_pressed_below_nothing_are_dropped(spark):
    flows = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.1), (1, 2, 0.5), (0, 2, 1e-9)], "src int, dst int, mass double")
    external = spark.createDataFrame([(0, 3.0, 0.0), (2, 0.0, 3.0)], "rid int, inlet double, outlet double")
    got = {(r.src, r.dst): r.mass for r in network.balance_flows(flows, external).collect()}
    assert got == pytest.approx({(0, 1): 3.0, (1, 2): 3.0})
