"""Mixtures of Gaussians with diagonal covariances, by expectation and maximisation over the rows in place.

Tasks hold the model, k weights, means and variances. A pass gives each row its
responsibilities and adds up, by component, their number, sum and sum of squares
about the component's mean; those k numbers and 2 k p are all that leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshnet.operators.kmeans import starting_centres
from meshnet.operators.pca import ADDERS, covariance, matrix, moments
from meshnet.plans.scratch import ship_package

#: What is added to every variance, and the most passes.
REGULARISATION, PASSES = 0.05, 1000
#: A pass that raises the mean log-likelihood by less than this share of it is the last.
TOLERANCE = 1e-6
_SUMS = "k long, n double, s array<double>, q array<double>, likelihood double"
_KINDS = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]


def _batch(n: np.ndarray, s: np.ndarray, q: np.ndarray, likelihood: float) -> pa.RecordBatch:
    columns = [range(len(n)), n, s.tolist(), q.tolist(), [likelihood] + [0.0] * (len(n) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], ["k", "n", "s", "q", "likelihood"])


@dataclass
class DiagonalMixture:
    """``weights`` (k), ``means`` and ``variances`` (k by p)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    regularisation: float = REGULARISATION
    #: Mean log-likelihood of the rows before each pass.
    likelihoods: tuple[float, ...] = ()

    @classmethod
    def start(cls, df: DataFrame, centres: np.ndarray, features: str = "features", regularisation: float = REGULARISATION) -> DiagonalMixture:
        """Equal weights, the given means, and the variance of all rows for each."""
        n, s, c = moments(df, features)[0]
        spread = np.diag(covariance(n, s, c, 0)[1]) + regularisation
        centres = np.array(centres, float)
        return cls(np.full(len(centres), 1 / len(centres)), centres, np.tile(spread, (len(centres), 1)), regularisation)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Of each row and component, the weight in it."""
        with np.errstate(divide="ignore"):
            known = np.log(self.weights) - 0.5 * np.log(2 * np.pi * self.variances).sum(axis=1)
        # (x - m)^2 / v as products of matrices, about the mean of the means so that little cancels.
        middle = self.means.mean(axis=0)
        x, m, v = x - middle, self.means - middle, 1 / self.variances
        return known - 0.5 * ((x * x) @ v.T - 2 * x @ (m * v).T + (m * m * v).sum(axis=1))

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each component's share of each row, and the sum of the log-likelihoods."""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        shares = np.exp(logs - top)
        total = shares.sum(axis=1, keepdims=True)
        return shares / total, float((top + np.log(total)).sum())

    def step(self, df: DataFrame, features: str = "features") -> DiagonalMixture:
        """The mixture after one pass; a component that no row belongs to keeps its place, with no weight."""
        model, (k, p) = self, self.means.shape

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, q, likelihood = np.zeros(k), np.zeros((k, p)), np.zeros((k, p)), 0.0
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0))
                    shares, own = model.responsibilities(x)
                    likelihood += own
                    n += shares.sum(axis=0)
                    for c in range(k):
                        off = x - model.means[c]
                        s[c] += shares[:, c] @ off
                        q[c] += shares[:, c] @ (off * off)
            yield _batch(n, s, q, likelihood)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, q, likelihood = np.zeros(k), np.zeros((k, p)), np.zeros((k, p)), 0.0
            for batch in batches:
                at = batch.column(0).to_numpy()
                np.add.at(n, at, batch.column(1).to_numpy())
                for total, column in ((s, batch.column(2)), (q, batch.column(3))):
                    np.add.at(total, at, np.array(column.to_pylist()).reshape(len(at), p))
                likelihood += batch.column(4).to_numpy().sum()
            yield _batch(n, s, q, likelihood)

        ship_package(df.sparkSession)
        rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"))
        n, s, q, likelihood = np.zeros(k), np.zeros((k, p)), np.zeros((k, p)), 0.0
        for r in rows.mapInArrow(count, _SUMS).repartition(ADDERS).mapInArrow(add, _SUMS).collect():
            n[r.k] += r.n
            s[r.k] += r.s
            q[r.k] += r.q
            likelihood += r.likelihood
        some = np.maximum(n, np.finfo(float).tiny)[:, None]
        moved = s / some
        means = np.where(n[:, None] > 0, self.means + moved, self.means)
        variances = np.where(n[:, None] > 0, np.maximum(q / some - moved * moved, 0) + self.regularisation, self.variances)
        total = n.sum()
        return DiagonalMixture(n / total if total else self.weights, means, variances, self.regularisation, (*self.likelihoods, likelihood / max(total, 1)))

    def fit(self, df: DataFrame, features: str = "features", passes: int = PASSES, tol: float = TOLERANCE) -> DiagonalMixture:
        """Passes until the mean log-likelihood hardly rises, ``passes`` at most."""
        model = self
        for _ in range(passes):
            model = model.step(df, features)
            if len(model.likelihoods) > 1 and abs(model.likelihoods[-1] - model.likelihoods[-2]) <= tol * abs(model.likelihoods[-1]):
                break
        return model

    def labels(self, df: DataFrame, features: str = "features", keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
        """``keep``, ``cluster`` (the component of largest share, the first on ties) and its ``share``."""
        model, names = self, list(keep)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(len(names))) if batch.num_rows else np.zeros((0, model.means.shape[1]))
                shares, _ = model.responsibilities(x)
                best = shares.argmax(axis=1)
                columns = [*(batch.column(c) for c in names), pa.array(best, pa.int32()), pa.array(shares[np.arange(len(best)), best])]
                yield pa.RecordBatch.from_arrays(columns, [*names, "cluster", "share"])

        ship_package(df.sparkSession)
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
        rows = df.where(F.col(features).isNotNull()).select(*names, F.col(features).cast("array<double>").alias("x"))
        return rows.mapInArrow(judge, f"{kinds}, cluster int, share double")


def diagonal_labels(
    df: DataFrame, k: int, features: str = "features", id_col: str = "cell_id", seed: int = 42, start: str = "plus",
    passes: int = PASSES, regularisation: float = REGULARISATION,
) -> DataFrame:
    """``id_col, cluster`` by a diagonal, regularised mixture of ``k`` components."""
    centres = starting_centres(df, k, start, features, id_col, seed)
    return DiagonalMixture.start(df, centres, features, regularisation).fit(df, features, passes).labels(df, features, (id_col,)).drop("share")
