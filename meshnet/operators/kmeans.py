"""k-means: Lloyd passes with columns alone, MLlib's for large runs, and choices of k."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshnet.operators.pca import ADDERS, matrix, moments
from meshnet.operators.vqpca import VQPCA, davies_bouldin
from meshnet.plans.scratch import ship_package

STARTS = ("uniform", "sample", "plus", "cluster")


def _distances(features: Column, centres: np.ndarray) -> Column:
    """Squared distance to each centre, as an array; the centres are one folded constant."""
    table = F.from_json(F.lit(json.dumps(np.asarray(centres, float).tolist())), "array<array<double>>")
    return F.transform(
        table, lambda c: F.aggregate(F.zip_with(features, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    )


def nearest(df: DataFrame, centres: np.ndarray, features: str = "features") -> DataFrame:
    """``df`` with ``cluster``, the first of the nearest centres, and ``distance2``."""
    d = _distances(F.col(features).cast("array<double>"), centres)
    with_d = df.withColumn("__d", d)
    return with_d.select(*df.columns, (F.array_position("__d", F.array_min("__d")) - 1).cast("int").alias("cluster"), F.array_min("__d").alias("distance2"))


def lloyd(df: DataFrame, centres: np.ndarray, passes: int, features: str = "features", tol: float = 0.0) -> np.ndarray:
    """Centres after at most ``passes``; a cluster without rows keeps its centre."""
    centres = np.array(centres, float)
    for _ in range(passes):
        new = centres.copy()
        for k, (n, s, _) in moments(nearest(df, centres, features), features, "cluster").items():
            new[k] = s / n
        moved, centres = np.abs(new - centres).max(initial=0.0), new
        if moved <= tol:
            break
    return centres


def starting_centres(df: DataFrame, k: int, start: str = "sample", features: str = "features", id_col: str = "cell_id", seed: int = 42, given: np.ndarray | None = None) -> np.ndarray:
    """Centres to begin with.

    ``sample``: the k rows of least hash of their id. ``uniform``: uniform within the features' ranges.
    ``plus``: each next the row of largest product of its squared distance and a hashed chance. ``cluster``: ``given``.
    """
    x = F.col(features).cast("array<double>")
    if start == "cluster":
        if given is None or len(given) != k:
            raise ValueError("give k centres")
        return np.array(given, float)
    if start == "sample":
        rows = df.select(x.alias("x"), F.xxhash64(id_col, F.lit(seed)).alias("h"), id_col).orderBy("h", id_col).limit(k).collect()
        return np.array([r.x for r in rows])
    if start == "uniform":
        p = len(df.select(x.alias("x")).first().x)
        row = df.agg(*(f(F.get(x, i)) for i in range(p) for f in (F.min, F.max))).first()
        low, high = np.array(row[0::2]), np.array(row[1::2])
        return low + (high - low) * np.random.default_rng(seed).random((k, p))
    if start == "plus":
        centres = starting_centres(df, 1, "sample", features, id_col, seed)
        while len(centres) < k:
            # Exponential race: the least of -ln(u) / weight falls on a row with chance weight / total.
            u = (F.pmod(F.xxhash64(id_col, F.lit(seed + len(centres))), F.lit(2**40)) + 0.5) / float(2**40)
            race = nearest(df, centres, features).where("distance2 > 0").select(x.alias("x"), (-F.ln(u) / F.col("distance2")).alias("t"))
            row = race.agg(F.min_by("x", "t").alias("x")).first()
            if row.x is None:
                break
            centres = np.vstack([centres, row.x])
        return centres
    raise ValueError(f"start is one of {', '.join(STARTS)}")


def within_sums(assigned: DataFrame) -> DataFrame:
    """``cluster, within``: squared distances to the centre, added up."""
    return assigned.groupBy("cluster").agg(F.sum("distance2").alias("within"))


def kmeans_labels(df: DataFrame, k: int, features: str = "features", id_col: str = "cell_id", seed: int = 42, passes: int = 300) -> DataFrame:
    """``id_col, cluster`` by MLlib's k-means with random starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(id_col, array_to_vector(F.col(features).cast("array<double>")).alias("__v"))
    model = KMeans(k=k, seed=seed, initMode="random", maxIter=passes, featuresCol="__v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select(id_col, "cluster")


def gmm_labels(df: DataFrame, k: int, features: str = "features", id_col: str = "cell_id", seed: int = 42, passes: int = 100) -> DataFrame:
    """``id_col, cluster`` by MLlib's Gaussian mixture, of full covariance."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(id_col, array_to_vector(F.col(features).cast("array<double>")).alias("__v"))
    model = GaussianMixture(k=k, seed=seed, maxIter=passes, featuresCol="__v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select(id_col, "cluster")


def cluster_rows(df: DataFrame, k: int, alg: str = "k-means", features: str = "features", id_col: str = "cell_id", **options) -> DataFrame:
    """``id_col, cluster`` by ``k-means``, ``vqpca``, ``fpca`` (bins of ``z`` first, a fixed count of components),
    ``gmm`` (diagonal, regularised) or ``gmm-full``."""
    from meshnet.operators.mixtures import diagonal_labels  # it takes its starts from here

    if alg == "k-means":
        return kmeans_labels(df, k, features, id_col, **options)
    if alg == "gmm":
        return diagonal_labels(df, k, features, id_col, **options)
    if alg == "gmm-full":
        return gmm_labels(df, k, features, id_col, **options)
    if alg in ("vqpca", "fpca"):
        fit = {c: options.pop(c) for c in ("init", "n_start", "z") if c in options}
        if alg == "fpca":
            options.setdefault("rule", "n_eigs")
            options.setdefault("q", 2)
            fit.setdefault("init", "bins")
        return VQPCA(k, **options).fit(df, features=features, id_col=id_col, **fit).labels(df, features, (id_col,)).select(id_col, "cluster")
    raise ValueError("alg is k-means, vqpca, fpca, gmm or gmm-full")


_RUNS = "run int, k int, n long, s array<double>, e double"


def _nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres of each row."""
    far = np.empty((len(centres), len(x)))
    for d, c in zip(far, centres, strict=True):
        d[:] = ((x - c) ** 2).sum(axis=1)
    return far.argmin(axis=0)


def _scan(df: DataFrame, runs: Sequence[np.ndarray], measured: Sequence[np.ndarray], features: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set of centres, all in one scan: rows, their sum, and their distances to ``measured``, by nearest centre."""
    sizes = [c.shape for c in runs]

    def empty() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(np.zeros(k, np.int64), np.zeros((k, p)), np.zeros(k)) for k, p in sizes]

    def rows_of(sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = [(i, c, int(n[c]), s[c].tolist(), float(e[c])) for i, (n, s, e) in enumerate(sums) for c in range(len(n)) if n[c]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], ["run", "k", "n", "s", "e"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = empty()
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                for (n, s, e), centres, other in zip(sums, runs, measured, strict=True):
                    near = _nearest_of(x, centres)
                    n += np.bincount(near, minlength=len(n))
                    np.add.at(s, near, x)
                    e += np.bincount(near, np.sqrt(((x - other[near]) ** 2).sum(axis=1)), len(n))
        yield rows_of(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = empty()
        for batch in batches:
            for r in batch.to_pylist():
                take(sums, r["run"], r["k"], r["n"], r["s"], r["e"])
        yield rows_of(sums)

    def take(sums: list, run: int, k: int, n: int, s: list[float], e: float) -> None:
        sums[run][0][k] += n
        sums[run][1][k] += s
        sums[run][2][k] += e

    ship_package(df.sparkSession)
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))
    found = empty()
    for r in rows.mapInArrow(count, _RUNS).repartition(ADDERS).mapInArrow(add, _RUNS).collect():
        take(found, *r)
    return found


def sweep(df: DataFrame, starts: Sequence[np.ndarray], passes: int = 100, features: str = "features", tol: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Centres and Davies-Bouldin index of k-means from each of ``starts``, all of them in one scan a pass.

    A run whose centres move no more than ``tol`` stays as it is. Two more scans give the index.
    """
    runs = [np.array(c, float) for c in starts]
    moving = [True] * len(runs)
    for _ in range(passes):
        at = [i for i, m in enumerate(moving) if m]
        if not at:
            break
        for i, (n, s, _) in zip(at, _scan(df, [runs[i] for i in at], [runs[i] for i in at], features), strict=True):
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], runs[i])
            moving[i], runs[i] = np.abs(new - runs[i]).max(initial=0.0) > tol, new
    means = [np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c) for c, (n, s, _) in zip(runs, _scan(df, runs, runs, features), strict=True)]
    out = []
    for centres, mean, (n, _, e) in zip(runs, means, _scan(df, runs, means, features), strict=True):
        full = np.flatnonzero(n)
        spread = e[full] / n[full]
        apart = np.sqrt(((mean[full][:, None] - mean[full]) ** 2).sum(axis=2))
        worst = [max(((spread[i] + spread[j]) / max(apart[i, j], 1e-300) for j in range(len(full)) if j != i), default=0.0) for i in range(len(full))]
        out.append((centres, float(np.mean(worst)) if worst else 0.0))
    return out


def choose_k(df: DataFrame, spans: Sequence[int], alg: str = "k-means", features: str = "features", id_col: str = "cell_id", **options) -> tuple[int, dict[int, float]]:
    """The k of least Davies-Bouldin index, and the index of each; k-means takes one scan a pass for all of them."""
    if alg == "k-means":
        how = {c: options.pop(c) for c in ("start", "seed") if c in options}
        starts = [starting_centres(df, k, features=features, id_col=id_col, **how) for k in spans]
        index = {k: i for k, (_, i) in zip(spans, sweep(df, starts, features=features, **options), strict=True)}
        return min(index, key=lambda k: (index[k], k)), index
    index = {}
    for k in spans:
        labels = cluster_rows(df, k, alg, features, id_col, **dict(options))
        index[k] = davies_bouldin(df.select(id_col, features).join(labels, id_col), features)
    return min(index, key=lambda k: (index[k], k)), index
