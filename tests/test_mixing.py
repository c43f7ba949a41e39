import numpy as np
import pytest
from pyspark.sql import functions as F

from meshnet.functions import chem
from meshnet.operators import kmeans, mesh, mixtures

STREAMS = "stream_id int, T double, P double, Y map<string,double>"


def heat(shares, t):
    """J/kg, term by term."""
    total = 0.0
    for s, y in shares.items():
        change, low, high = chem.NASA7[s]
        c = low if t < change else high
        total += y * 1000 / chem.molecular_weight(s) * chem.GAS_CONSTANT * (sum(c[i] * t ** (i + 1) / (i + 1) for i in range(5)) + c[5])
    return total


def mixed(spark, streams, inlets, **how):
    own = spark.createDataFrame(streams, STREAMS)
    into = spark.createDataFrame(inlets, "cluster int, stream_id int, mass double")
    return {r.cluster: r for r in mesh.mix_streams_adiabatic(into, own, digits=12, **how).collect()}


@pytest.mark.parametrize("species", chem.NASA7)
def test_polynomials_meet_where_they_change(species):
    change, low, high = chem.NASA7[species]
    cp = [sum(c[i] * change**i for i in range(5)) for c in (low, high)]
    h = [sum(c[i] * change**i / (i + 1) for i in range(5)) + c[5] / change for c in (low, high)]
    s = [c[0] * np.log(change) + sum(c[i] * change**i / i for i in range(1, 5)) + c[6] for c in (low, high)]
    for a, b in (cp, h, s):
        assert a == pytest.approx(b, rel=2e-3)


def test_enthalpies_of_formation():
    """kJ/mol at 298.15 K, as tables have them."""
    for species, want in {"H2": 0, "O2": 0, "N2": 0, "H2O": -241.8, "CO": -110.5, "CO2": -393.5, "CH4": -74.6}.items():
        got = heat({species: 1.0}, 298.15) * chem.molecular_weight(species) / 1e6
        assert got == pytest.approx(want, abs=0.4)


def test_enthalpy_is_kept(spark):
    streams = [(0, 300.0, 1e5, {"CH4": 0.5, "H2": 0.5}), (1, 872.0, 2e5, {"N2": 0.79, "O2": 0.21}), (2, 1900.0, 1e5, {"CO2": 0.3, "H2O": 0.7, "O2": 0.0})]
    inlets = [(0, 0, 1.0), (0, 1, 3.0), (1, 1, 2.0), (2, 0, 0.5), (2, 1, 1.0), (2, 2, 2.0)]
    got = mixed(spark, streams, inlets)
    for cluster, r in got.items():
        parts = [(m, streams[s]) for c, s, m in inlets if c == cluster]
        total = sum(m for m, _ in parts)
        assert heat(r.Y, r.T) == pytest.approx(sum(m * heat(s[3], s[1]) for m, s in parts) / total, rel=1e-9, abs=1e-3)
        assert r.P == pytest.approx(sum(m * s[2] for m, s in parts) / total) and r.mass == pytest.approx(total)
        assert min(s[1] for _, s in parts) <= r.T <= max(s[1] for _, s in parts)
    assert got[1].T == 872.0  # alone, as it came
    # Not the mean by mass: methane and hydrogen take more heat than air.
    assert got[0].T < (300 + 3 * 872) / 4 - 50


def test_hotter_streams_make_hotter_mixtures(spark):
    for which in (0, 1):
        last = 0.0
        for t in (300.0, 700.0, 1100.0, 1500.0):
            temperatures = [500.0, 500.0]
            temperatures[which] = t
            streams = [(i, temperatures[i], 1e5, y) for i, y in enumerate(({"CH4": 1.0}, {"N2": 0.77, "O2": 0.23}))]
            now = mixed(spark, streams, [(0, 0, 1.0), (0, 1, 2.0)])[0].T
            assert now > last
            last = now


def test_equal_temperatures_and_unknown_species(spark):
    same = [(i, 640.0, 1e5, y) for i, y in enumerate(({"CH4": 1.0}, {"N2": 1.0}))]
    assert mixed(spark, same, [(0, 0, 1.0), (0, 1, 2.0)])[0].T == pytest.approx(640.0, abs=1e-9)
    with pytest.raises(Exception, match="no enthalpy of XE"):
        mixed(spark, [(0, 300.0, 1e5, {"XE": 1.0})], [(0, 0, 1.0)])
    own = {"XE": (1000.0, [2.5, 0, 0, 0, 0, 0, 0], [2.5, 0, 0, 0, 0, 0, 0])}
    with pytest.raises(ValueError):  # a mass is needed too
        mixed(spark, [(0, 300.0, 1e5, {"XE": 1.0})], [(0, 0, 1.0)], data=own)


# Mixtures of Gaussians.


def blobs(spark, seed=1, n=300):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0.0, 5.0], [6.0, 1.0, 0.0], [-5.0, 8.0, 1.0]])
    spread = np.array([[1.0, 0.3, 0.5], [0.4, 1.2, 0.4], [0.8, 0.8, 0.2]])
    which = rng.integers(0, 3, n)
    x = centres[which] + rng.normal(size=(n, 3)) * spread[which]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(n, None)], "cell_id long, features array<double>").repartition(5)
    return x, which, df, centres, spread


def plain(x, w, m, v, passes, reg):
    """Expectation and maximisation, row by row."""
    for _ in range(passes):
        logs = np.array([[np.log(w[k]) + sum(-0.5 * np.log(2 * np.pi * v[k][i]) - (r[i] - m[k][i]) ** 2 / (2 * v[k][i]) for i in range(len(r))) for k in range(len(w))] for r in x])
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n = p.sum(axis=0)
        m = (p.T @ x) / n[:, None]
        v = np.array([(p[:, k, None] * (x - m[k]) ** 2).sum(axis=0) / n[k] for k in range(len(w))]) + reg
        w = n / len(x)
    return w, m, v


def test_passes_as_row_by_row(spark):
    x, _, df, _, _ = blobs(spark)
    start = mixtures.DiagonalMixture.start(df, x[:3])
    assert start.variances == pytest.approx(np.tile(x.var(axis=0) + 0.05, (3, 1)))
    got = start.fit(df, passes=3, tol=0.0)
    w, m, v = plain(x, np.full(3, 1 / 3), x[:3], start.variances, 3, 0.05)
    assert got.weights == pytest.approx(w) and got.means == pytest.approx(m) and got.variances == pytest.approx(v)
    assert list(got.likelihoods) == sorted(got.likelihoods)


def test_blobs_are_found(spark):
    x, which, df, centres, spread = blobs(spark)
    model = mixtures.DiagonalMixture.start(df, centres + 0.5).fit(df)
    assert len(model.likelihoods) < 60
    assert np.abs(model.means - centres).max() < 0.3 and np.abs(model.variances - 0.05 - spread**2).max() < 0.4
    labels = {r.cell_id: r.cluster for r in model.labels(df).collect()}
    assert np.mean([labels[i] == k for i, k in enumerate(which)]) > 0.99 and len(labels) == len(x)
    for alg in ("gmm", "gmm-full"):
        found = kmeans.cluster_rows(df.where("features is not null"), 3, alg, passes=30)
        pairs = {(which[r.cell_id], r.cluster) for r in found.collect()}
        assert found.columns == ["cell_id", "cluster"] and len({k for _, k in pairs}) <= 3


def test_regularised_and_empty_components(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(8)], "cell_id long, features array<double>")
    model = mixtures.DiagonalMixture.start(same, np.array([[1.0, 2.0], [9e3, 9e3]])).fit(same)
    assert model.variances[0] == pytest.approx([0.05, 0.05]) and model.weights == pytest.approx([1.0, 0.0])
    assert {r.cluster for r in model.labels(same).collect()} == {0} and np.isfinite(model.means).all()
    none = mixtures.DiagonalMixture(np.array([1.0]), np.zeros((1, 2)), np.ones((1, 2)))
    assert none.step(same.where(F.lit(False))).weights.tolist() == [1.0]


def test_sweep_as_one_by_one(spark, monkeypatch):
    """All numbers of clusters in one scan a pass, with the centres and indices of runs of their own."""
    x, _, df, _, _ = blobs(spark)
    scans = []
    scan = kmeans._scan
    monkeypatch.setattr(kmeans, "_scan", lambda *a: scans.append(1) or scan(*a))
    found = kmeans.sweep(df, [x[:k] for k in (2, 3, 5)], passes=4, tol=0.0)
    assert len(scans) == 6
    for k, (centres, index) in zip((2, 3, 5), found, strict=True):
        want = x[:k].copy()
        for _ in range(4):
            near = ((x[:, None] - want) ** 2).sum(axis=2).argmin(axis=1)
            want = np.array([x[near == c].mean(axis=0) if (near == c).any() else want[c] for c in range(k)])
        assert centres == pytest.approx(want)
        near = ((x[:, None] - want) ** 2).sum(axis=2).argmin(axis=1)
        mean = np.array([x[near == c].mean(axis=0) for c in range(k)])
        spread = [np.sqrt(((x[near == c] - mean[c]) ** 2).sum(axis=1)).mean() for c in range(k)]
        worst = [max((spread[i] + spread[j]) / np.linalg.norm(mean[i] - mean[j]) for j in range(k) if j != i) for i in range(k)]
        assert index == pytest.approx(np.mean(worst))
    best, index = kmeans.choose_k(df.where("features is not null"), [2, 3, 5], start="plus", passes=20)
    assert set(index) == {2, 3, 5} and best == min(index, key=index.get)
