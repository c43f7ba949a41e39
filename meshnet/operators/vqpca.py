"""Clustering by local principal components: rows go to the basis that reconstructs them best.

A pass is one scan: every row is labelled under the current bases and, in the
same task, added to its new cluster's count, sums and products. The driver sees
those moments alone, k times p squared numbers, and fits the next bases.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshnet.operators.pca import PCA, added, matrix, moments, tally
from meshnet.plans.scratch import materialize, ship_package

INITS = ("kmeans", "random", "uniform", "bins", "score", "sorted", "best")
#: Random starts of which ``best`` takes the one of least error.
STARTS = 100


def error_table(models: dict[int, PCA], x: np.ndarray) -> np.ndarray:
    """Squared residual of each row under each basis."""
    return np.stack([m.errors(x) for m in models.values()], axis=1)


def assign(df: DataFrame, models: dict[int, PCA], features: str = "features", keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """``keep``, ``cluster`` and ``error``: the basis of least error, the first of equal ones."""
    names = np.array(list(models), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            errors = error_table(models, matrix(batch.column(len(keep))))
            best = errors.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(names[best].astype(np.int32)), pa.array(errors[np.arange(len(best)), best])],
                [*keep, "cluster", "error"],
            )

    ship_package(df.sparkSession)
    rows = df.where(F.col(features).isNotNull()).select(*keep, F.col(features).cast("array<double>").alias("__x"))
    schema = df.select(*keep, F.lit(0).alias("cluster"), F.lit(0.0).alias("error")).schema
    return rows.mapInArrow(run, schema)


def _pass(df: DataFrame, models: dict[int, PCA], features: str) -> tuple[dict[int, tuple], float, dict[int, float]]:
    """Moments of the rows by best basis, the mean error, and the mean error by cluster."""
    names = np.array(list(models), np.int64)

    def judge(_: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        errors = error_table(models, x)
        best = errors.argmin(axis=1)
        return names[best], errors[np.arange(len(best)), best]

    found = tally(df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x")), judge)
    stats = {k: part for k, (part, _) in sorted(found.items())}
    n = sum(part[0] for part in stats.values())
    return stats, sum(e for _, e in found.values()) / max(n, 1), {k: e / part[0] for k, (part, e) in sorted(found.items())}


@dataclass
class VQPCA:
    """``fit`` finds ``k`` local bases; ``labels`` and ``predict`` assign rows.

    ``rule`` and ``q`` tell how many components each keeps. Converged when the
    centroids' relative change is under ``ctol`` or the error's under ``rtol``
    (``both``: and). Clusters with no more rows than features are dropped, as
    they have no basis. ``mode`` ``supervised`` stops after one pass.
    """

    k: int = 2
    rule: str = "variance"
    q: float = 0.99
    itmax: int = 200
    rtol: float = 1e-8
    ctol: float = 1e-6
    both: bool = False
    mode: str = "unsupervised"
    #: What the first pass is judged by: ``local`` bases of the start, or its ``identity``, that is distances to its centres.
    first: str = "local"
    models: dict[int, PCA] = field(default_factory=dict)
    used: dict[int, PCA] = field(default_factory=dict)
    stats: dict[int, tuple] = field(default_factory=dict)
    errors: list[float] = field(default_factory=list)
    cluster_errors: dict[int, float] = field(default_factory=dict)
    converged: bool = False

    def _initial(self, df: DataFrame, init: str, features: str, id_col: str, z: str | None) -> dict[int, tuple]:
        if init not in INITS:
            raise ValueError(f"init is one of {', '.join(INITS)}")
        rows = df.where(F.col(features).isNotNull())
        if init == "kmeans":
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.functions import array_to_vector

            vectors = rows.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
            model = KMeans(k=self.k, seed=0, initMode="random", featuresCol="__v", predictionCol="__k").fit(vectors)
            return moments(model.transform(vectors), features, "__k")
        if init == "best":
            return self._best_start(rows, features, id_col)
        if init == "random":
            return moments(rows.withColumn("__k", F.pmod(F.xxhash64(id_col, F.lit(1000)), F.lit(self.k))), features, "__k")
        if init == "uniform":  # blocks of about equal size in order of id, from quantiles rather than a sort
            column = F.col(id_col).cast("double")
        elif init in ("bins", "sorted"):  # sorted: blocks of about equal size in order of z
            if z is None:
                raise ValueError(f"{init} needs the column z")
            column = F.col(z).cast("double")
        else:
            first = PCA.of(*moments(rows, features)[0], rule="n_eigs", level=1)
            terms = [(F.get(features, j) - float(first.mean[j])) * float(first.basis[j, 0]) for j in range(len(first.mean))]
            column = sum(terms[1:], terms[0])
        if init in ("bins", "score"):
            low, high = rows.agg(F.min(column), F.max(column)).first()
            width = (high - low) / self.k or 1.0
            label = F.least(F.floor((column - low) / width), F.lit(self.k - 1))
        else:
            cuts = rows.agg(F.percentile_approx(column, [i / self.k for i in range(1, self.k)] or [1.0], 100_000)).first()[0]
            label = sum(((column > c).cast("int") for c in cuts[: self.k - 1]), F.lit(0))
        return moments(rows.withColumn("__k", label), features, "__k")

    def _best_start(self, rows: DataFrame, features: str, id_col: str) -> dict[int, tuple]:
        """Of ``STARTS`` sets of ``k`` rows as centres, the one whose nearest centres are least far, all sets in one scan."""
        from meshnet.operators.kmeans import nearest

        order = F.xxhash64(F.col(id_col), F.lit(77))
        picked = rows.select(F.col(features).cast("array<double>").alias("x"), order.alias("o")).orderBy("o").limit(self.k * STARTS)
        x = np.array([r.x for r in picked.collect()])
        sets = [x[i : i + self.k] for i in range(0, len(x) - self.k + 1, self.k)] or [x]

        def total(batches):
            far = np.zeros(len(sets))
            for own in (matrix(b.column(0)) for b in batches if b.num_rows):
                far += [((own[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1).sum() for c in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.array(far)], ["i", "far"])

        ship_package(rows.sparkSession)
        values = rows.select(F.col(features).cast("array<double>").alias("x"))
        sums = values.mapInArrow(total, "i long, far double").groupBy("i").agg(F.sum("far").alias("far"))
        best = sums.orderBy("far", "i").first().i
        return moments(nearest(rows, sets[best], features), features, "cluster")

    def _bases(self, rule: str, level: float) -> dict[int, PCA]:
        p = len(next(iter(self.stats.values()))[1])
        big = {k: s for k, s in self.stats.items() if s[0] > p} or dict([max(self.stats.items(), key=lambda x: x[1][0])])
        if len(big) < len(self.stats):
            warnings.warn("clusters with no more rows than features are dropped", stacklevel=3)
        return {k: PCA.of(*s, rule=rule, level=level) for k, s in big.items()}

    def fit(self, df: DataFrame, init: str = "kmeans", n_start: int = 2, features: str = "features", id_col: str = "cell_id", z: str | None = None) -> VQPCA:
        self.stats = self._initial(df, init, features, id_col, z)
        if not self.stats:
            raise ValueError("no rows")
        if self.first not in ("local", "identity"):
            raise ValueError("first is local or identity")
        self.models = self._bases("n_eigs", n_start)
        if self.first == "identity":  # nothing is projected out: the error is the distance to the centre
            self.models = {k: replace(m, basis=m.basis[:, :0], values=m.values) for k, m in self.models.items()}
        centres = {k: s[1] / s[0] for k, s in self.stats.items()}
        self.errors, self.converged = [], False
        for step in range(1 if self.mode == "supervised" else self.itmax):
            self.used = self.models
            self.stats, error, self.cluster_errors = _pass(df, self.models, features)
            new = {k: s[1] / s[0] for k, s in self.stats.items()}
            gone = set(centres) - set(new)
            moved = np.sqrt(sum(((new[k] - centres[k]) ** 2).sum() for k in new)) / max(np.sqrt(sum((c**2).sum() for c in centres.values())), 1e-300)
            settled = moved < self.ctol and not gone
            flat = step > 0 and abs(error - self.errors[-1]) / max(error, 1e-300) < self.rtol
            self.errors.append(error)
            centres, self.models = new, self._bases(self.rule, self.q)
            if (settled and flat) if self.both else (settled or flat):
                self.converged = True
                break
        return self

    def _fitted(self) -> None:
        if not self.models:
            raise ValueError("fit first")

    def labels(self, df: DataFrame, features: str = "features", keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
        """Labels of the last pass: under the bases it began with."""
        self._fitted()
        return assign(df, self.used, features, keep)

    def predict(self, df: DataFrame, features: str = "features", keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
        """Labels under the final bases; rows must have as many features as those fitted."""
        self._fitted()
        p = len(next(iter(self.models.values())).mean)
        if df.where(F.col(features).isNotNull() & (F.size(features) != p)).limit(1).count():
            raise ValueError(f"the model has {p} features")
        return assign(df, self.models, features, keep)

    def reconstruct(self, df: DataFrame, features: str = "features", keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
        """``keep``, ``cluster`` and the features as their own basis gives them back."""
        self._fitted()
        models, names = self.models, np.array(list(self.models), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(len(keep)))
                best = error_table(models, x).argmin(axis=1)
                back = np.empty_like(x)
                for b in np.unique(best):
                    back[best == b] = models[int(names[b])].reconstruct(x[best == b])
                edge = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), pa.array(names[best].astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge), pa.array(back.ravel()))],
                    [*keep, "cluster", features],
                )

        ship_package(df.sparkSession)
        rows = df.where(F.col(features).isNotNull()).select(*keep, F.col(features).cast("array<double>").alias("__x"))
        schema = df.select(*keep, F.lit(0).alias("cluster"), F.col(features).cast("array<double>").alias(features)).schema
        return rows.mapInArrow(run, schema)

    def components(self) -> dict[int, np.ndarray]:
        """Features by components, of each cluster."""
        self._fitted()
        return {k: m.basis for k, m in self.models.items()}

    def report(self) -> dict[str, float]:
        """Mean, least, largest and size-weighted error over clusters, and the least explained variance."""
        self._fitted()
        own = np.array(list(self.cluster_errors.values()))
        size = np.array([self.stats[k][0] for k in self.cluster_errors])
        explained = min(float(m.explained().min()) for m in self.models.values())
        return {"mean": own.mean(), "min": own.min(), "max": own.max(), "weighted": float((own * size).sum() / size.sum()), "explained": explained}

    def ilpca(self) -> float:
        """Mean over clusters of the worst ``(e_i + e_j) / e_ij``; all from the moments, as those of a union add up."""
        self._fitted()
        own = {k: m.expected_error(*self.stats[k]) for k, m in self.models.items()}
        worst = []
        for i in own:
            scores = []
            for j in own:
                if i != j:
                    union = added(self.stats[i], self.stats[j])
                    together = PCA.of(*union, rule=self.rule, level=self.q).expected_error(*union)
                    scores.append((own[i] + own[j]) / max(together, 1e-300))
            worst.append(max(scores, default=0.0))
        return float(np.mean(worst))


def davies_bouldin(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean over clusters of the worst ``(s_i + s_j) / d_ij``; distances of rows to their centre in one scan."""
    centres = {k: s / n for k, (n, s, _) in moments(df, features, cluster).items()}
    table = df.sparkSession.createDataFrame([(k, c.tolist()) for k, c in centres.items()], f"{cluster} long, centre array<double>")
    square = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    spread = {
        r[0]: r[1]
        for r in df.select(F.col(cluster).cast("long").alias(cluster), features).join(F.broadcast(table), cluster).groupBy(cluster).agg(F.avg(F.sqrt(square))).collect()
    }
    worst = [
        max(((spread[i] + spread[j]) / max(float(np.linalg.norm(centres[i] - centres[j])), 1e-300) for j in centres if j != i), default=0.0)
        for i in centres
    ]
    return float(np.mean(worst)) if worst else 0.0


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """The mean silhouette by squared distances."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


def block_labels(df: DataFrame, k: int, id_col: str = "cell_id") -> DataFrame:
    """Contiguous blocks of equal size in order of id, the rest in the last; exact, by ranges of ids and their sizes."""
    ordered = materialize(df.select(id_col).orderBy(id_col).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r.p: r.n for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    size, before, offsets = max(1, sum(sizes.values()) // k), 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    place = F.col("__before") + within
    return ordered.join(F.broadcast(table), part == F.col("__p")).select(
        id_col, F.least(F.floor(place / size), F.lit(k - 1)).cast("int").alias("cluster")
    )
