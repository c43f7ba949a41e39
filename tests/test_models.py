import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshnet.operators import kmeans, pca, scaling, vqpca
from meshnet.sources import results


@pytest.fixture(scope="module")
def blobs(spark):
    """Three groups of points near planes of their own in four dimensions."""
    rng = np.random.default_rng(3)
    rows, truth = [], []
    for k, centre in enumerate(([0, 0, 0, 0], [40, 0, 0, 10], [0, 40, -30, 0])):
        basis = np.linalg.qr(rng.normal(size=(4, 4)))[0][:, :2]
        x = centre + rng.normal(size=(80, 2)) * [5, 3] @ basis.T + rng.normal(size=(80, 4)) * 0.05
        rows += x.tolist()
        truth += [k] * 80
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(rows, truth, strict=True))], "cell_id long, features array<double>, truth int")
    return df.repartition(4), np.array(rows), np.array(truth)


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_moments_and_pca(blobs):
    df, x, truth = blobs
    n, s, p = pca.moments(df)[0]
    centred = lambda x: (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert n == len(x) and np.allclose(s, x.sum(axis=0)) and np.allclose(p, centred(x))
    by = pca.moments(df, cluster="truth")
    assert sorted(by) == [0, 1, 2] and np.allclose(by[1][2], centred(x[truth == 1]))
    mean, cov = pca.covariance(n, s, p)
    assert np.allclose(cov, np.cov(x.T))
    full = pca.fit_pca(df, level=1.0)
    assert full.basis.shape == (4, 4) and np.allclose(full.reconstruct(x), x) and np.allclose(full.explained(), 1)
    assert np.allclose(np.sort(full.values)[::-1], np.linalg.eigvalsh(np.cov(x.T))[::-1])
    two = pca.PCA.of(n, s, p, "n_eigs", 2)
    assert two.errors(x).mean() == pytest.approx(two.expected_error(n, s, p))
    assert np.allclose(two.weighted_scores(x).std(axis=0, ddof=1), 1)
    assert 1 <= pca.normal_scores(df, full) <= 4


def test_retention_rules():
    values = np.array([5.0, 2.0, 1.0, 0.5, 0.1])
    assert [pca.retained(values, "variance", q) for q in (0.5, 0.82, 0.99, 1.0)] == [1, 3, 5, 5]
    assert pca.retained(values, "kaiser") == 2 and pca.retained(values, "jolliffe") == 2
    assert pca.retained(values, "n_eigs", 3) == 3 and pca.retained(values, "broken_stick") == 4
    assert pca.retained(np.array([4.0, 1.0, 1.0, 1.0]), "chi2", 0.95, n=200) == 1
    assert pca.retained(np.array([100.0, 1.0, 1.0, 1.0]), "hard_threshold", shape=0.1) == 1
    with pytest.raises(ValueError):
        pca.retained(values, "other")
    # Known quantiles of the chi-square distribution.
    for share, df, value in ((0.95, 1, 3.841459), (0.95, 10, 18.307038), (0.99, 5, 15.086272), (0.5, 2, 1.386294)):
        assert pca.chi2_quantile(share, df) == pytest.approx(value, abs=1e-5)


def slow_vqpca(x, labels, q, passes):
    def bases(labels):
        out = {}
        for k in np.unique(labels):
            own = x[labels == k]
            if len(own) > x.shape[1]:
                out[k] = (own.mean(axis=0), np.linalg.svd(own - own.mean(axis=0))[2][:q].T)
        return out

    models, error = bases(labels), None
    for _ in range(passes):
        e = np.stack([((x - m - (x - m) @ v @ v.T) ** 2).sum(axis=1) for m, v in models.values()], axis=1)
        labels = np.array(list(models))[e.argmin(axis=1)]
        error = e.min(axis=1).mean()
        models = bases(labels)
    return labels, error


def test_vqpca_as_by_numpy(blobs):
    df, x, truth = blobs
    start = df.withColumn("z", F.col("truth") + F.col("features")[0] / 1000)
    model = vqpca.VQPCA(3, rule="n_eigs", q=2, itmax=4, ctol=0, rtol=0).fit(start, init="bins", n_start=2, z="z")
    labels = np.array([r.cluster for r in model.labels(df).orderBy("cell_id").collect()])
    z = truth + x[:, 0] / 1000
    first = np.minimum(((z - z.min()) / ((z.max() - z.min()) / 3)).astype(int), 2)
    want, error = slow_vqpca(x, first, 2, 4)
    assert np.array_equal(labels, want) and model.errors[-1] == pytest.approx(error)
    assert model.errors[-1] <= model.errors[0] + 1e-12
    predicted = model.predict(df)
    errors = np.stack([m.errors(x) for m in model.models.values()], axis=1)
    got = predicted.orderBy("cell_id").collect()
    assert np.allclose([r.error for r in got], errors.min(axis=1))
    back = np.array([r.features for r in model.reconstruct(df).orderBy("cell_id").collect()])
    assert ((back - x) ** 2).sum(axis=1) == pytest.approx(errors.min(axis=1), abs=1e-9)
    assert model.ilpca() >= 0 and 0 < model.report()["explained"] <= 1 + 1e-9
    assert model.components()[0].shape == (4, 2)
    with pytest.raises(ValueError):
        model.predict(df.withColumn("features", F.slice("features", 1, 3)))
    with pytest.raises(ValueError):
        vqpca.VQPCA().predict(df)


@pytest.mark.parametrize("init", ["kmeans", "random", "uniform", "score"])
def test_inits(blobs, init):
    df, _, truth = blobs
    model = vqpca.VQPCA(3, rule="n_eigs", q=2, itmax=30).fit(df, init=init)
    assert model.errors[-1] <= model.errors[0] + 1e-12
    if init == "uniform":
        got = [r.cluster for r in model.labels(df).orderBy("cell_id").collect()]
        assert same_partition(got, truth.tolist())


def test_indices(blobs):
    df, x, truth = blobs
    labelled = df.withColumnRenamed("truth", "cluster")
    c = np.array([x[truth == k].mean(axis=0) for k in range(3)])
    s = np.array([np.linalg.norm(x[truth == k] - c[k], axis=1).mean() for k in range(3)])
    want = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert vqpca.davies_bouldin(labelled) == pytest.approx(want)
    assert vqpca.silhouette(labelled) > 0.8
    blocks = [r.cluster for r in vqpca.block_labels(df, 7).orderBy("cell_id").collect()]
    assert blocks == sorted(blocks) and [blocks.count(k) for k in range(7)] == [34] * 6 + [36]


def test_kmeans(blobs):
    df, x, truth = blobs
    centres = x[[0, 100, 200]]
    got = kmeans.lloyd(df, centres, 3)
    for _ in range(3):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == k].mean(axis=0) for k in range(3)])
    assert np.allclose(got, centres)
    near = kmeans.nearest(df, got)
    assert same_partition([r.cluster for r in near.orderBy("cell_id").collect()], truth.tolist())
    assert kmeans.within_sums(near).agg(F.sum("within")).first()[0] == pytest.approx(((x - centres[truth]) ** 2).sum())
    for start in ("sample", "uniform", "plus"):
        assert kmeans.starting_centres(df, 3, start).shape == (3, 4)
    assert len(np.unique(kmeans.starting_centres(df, 3, "plus"), axis=0)) == 3
    best, index = kmeans.choose_k(df, [2, 3, 4])
    assert best == 3 and set(index) == {2, 3, 4}
    for alg in ("vqpca", "gmm"):
        assert kmeans.cluster_rows(df, 3, alg).count() == 240
    assert kmeans.cluster_rows(df.withColumn("z", F.col("truth")), 3, "fpca", z="z", itmax=3).count() == 240
    with pytest.raises(ValueError):
        kmeans.cluster_rows(df, 3, "other")


@pytest.mark.parametrize("method", scaling.METHODS)
def test_scaler(spark, method):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, 3.0, (50, 2))
    df = spark.createDataFrame([(i, float(a), float(b), 2.0) for i, (a, b) in enumerate(x)], "cell_id long, a double, b double, same double")
    scaler = scaling.Scaler(method).fit(df, ["a", "b", "same"])
    out = np.array([tuple(r)[1:] for r in scaler.transform(df).orderBy("cell_id").collect()])
    back = np.array([tuple(r)[1:] for r in scaler.inverse_transform(scaler.transform(df)).orderBy("cell_id").collect()])
    assert np.allclose(back[:, :2], x) and np.isfinite(out).all()
    if method == "auto":
        assert np.allclose(out[:, :2].mean(axis=0), 0) and np.allclose(out[:, :2].std(axis=0), 1)
    want = {"range": np.ptp(x, axis=0), "pareto": x.std(axis=0) ** 0.5, "vast": x.std(axis=0) * x.mean(axis=0), "max": x.max(axis=0), "none": np.ones(2)}
    if method in want:
        assert np.allclose(out[:, :2], (x - x.mean(axis=0)) / want[method])
    grouped = scaling.scale(df, ["a", "b"], method).orderBy("cell_id").collect()
    assert np.allclose([(r.a, r.b) for r in grouped], out[:, :2])


def test_scaler_guards(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        scaling.Scaler().transform(df)
    with pytest.raises(ValueError):
        scaling.Scaler("other").fit(df, ["a"])
    assert scaling.Scaler().fit(df, ["a"], own=[4.0]).factors == {"a": 4.0}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 20).map(lambda n: 2 * n), st.floats(0.1, 0.9))
def test_bin_edges(n, z):
    for edges in (scaling.bin_edges(0.0, 1.0, n), scaling.bin_edges(0.0, 1.0, n, z)):
        assert len(edges) == n + 1 and edges[0] == 0 and edges[-1] == pytest.approx(1) and edges == sorted(edges)
    assert scaling.bin_edges(0.0, 1.0, n, z)[n // 2] == z


def test_condition(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, None)], "z double")
    closed = sorted((r.z, r.bin) for r in scaling.condition(df, "z", [0.0, 0.5, 1.0]).collect())
    assert closed == [(0.0, 0), (0.25, 0), (0.5, 0), (0.5, 1), (0.75, 1), (1.0, 1)]
    half = sorted((r.z, r.bin) for r in scaling.condition(df, "z", [0.0, 0.5, 1.0], closed=False).collect())
    assert half == [(0.0, 0), (0.25, 0), (0.5, 1), (0.75, 1), (1.0, 1)]


def test_moments_keep_the_digits_of_a_small_variance(spark):
    """Values near 2000 K, a millionth of a kelvin apart: raw products would hold none of it."""
    rng = np.random.default_rng(5)
    x = 2000 + rng.normal(0, 1e-6, (400, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, features array<double>").repartition(5)
    assert np.allclose(pca.covariance(*pca.moments(df)[0])[1], np.cov(x.T), rtol=1e-3, atol=1e-15)


def test_rows_of_unequal_length_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0])], "cell_id long, features array<double>").coalesce(1)
    with pytest.raises(Exception, match=r"rows have \[1, 3\] features"):
        pca.moments(df)


@pytest.mark.parametrize("init", ["best", "sorted"])
def test_other_starts(blobs, init):
    df, x, truth = blobs
    start = vqpca.VQPCA(k=3)._initial(df.withColumn("z", F.col("truth")), init, "features", "cell_id", "z")
    assert len(start) == 3 and sum(s[0] for s in start.values()) == len(x)
    if init == "best":  # the best of a hundred starts has a centre in each blob
        near = {int(truth[((x - s[1] / s[0]) ** 2).sum(axis=1).argmin()]) for s in start.values()}
        assert near == {0, 1, 2}
    with pytest.raises(ValueError):
        vqpca.VQPCA(k=3)._initial(df, "sorted", "features", "cell_id", None)


def test_first_pass_by_distance_to_centres(blobs):
    df, x, truth = blobs
    model = vqpca.VQPCA(k=3, first="identity", mode="supervised").fit(df, init="best")
    got = {r.cell_id: r.cluster for r in model.labels(df).collect()}
    assert same_partition([got[i] for i in range(len(x))], truth.tolist())
    assert all(m.basis.shape[1] == 0 for m in model.used.values()) and all(m.basis.shape[1] > 0 for m in model.models.values())
    with pytest.raises(ValueError):
        vqpca.VQPCA(k=2, first="other").fit(df)


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_results_are_saved_and_read_back(spark, blobs, tmp_path, form):
    df, x, _ = blobs
    model = vqpca.VQPCA(k=3).fit(df, init="best")
    labels = model.labels(df).select("cell_id", "cluster")
    centres = spark.createDataFrame([(k, float(m.mean[0])) for k, m in model.models.items()], "cluster int, f0 double")
    folder = f"file://{tmp_path}/{form}"
    for _ in range(2):  # a second time replaces the first
        results.save_clustering(folder, labels, centres, model.models, model.errors, form)
    back = results.load_table(spark, folder, "labels", form)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, labels.collect()))
    assert [r.error for r in results.load_table(spark, folder, "errors", form).orderBy("pass").collect()] == pytest.approx(model.errors)
    assert results.load_table(spark, folder, "centroids", form).count() == len(model.models)
    if form == "parquet":
        again = results.load_models(spark, folder)
        assert again.keys() == model.models.keys()
        assert all(np.allclose(again[k].errors(x), m.errors(x)) for k, m in model.models.items())
    with pytest.raises(ValueError):
        results.save_clustering(folder, labels, form="h5")
