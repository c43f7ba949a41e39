"""Principal components from sufficient statistics: one scan for counts, sums and products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshnet.plans.scratch import ship_package


#: Tasks that add up what others counted; the driver takes a row a cluster from each.
ADDERS = 16
_PARTS = "k long, n double, s array<double>, c array<double>, e double"
#: Count, sum and sum of outer products about the mean.
Moments = tuple[float, np.ndarray, np.ndarray]


def matrix(values: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    sizes = np.unique(values.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"rows have {sizes.tolist()} features")
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def moments_of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    return float(len(x)), x.sum(axis=0), (x - mean).T @ (x - mean)


def added(a: Moments, b: Moments) -> Moments:
    """Moments of both; products stay about a mean, so digits of a small variance don't cancel."""
    d = b[1] / b[0] - a[1] / a[0]
    return a[0] + b[0], a[1] + b[1], a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / (a[0] + b[0]))


class Tally(dict):
    """Cluster to its moments and the sum of its errors."""

    def add(self, k: int, part: Moments, error: float) -> None:
        if k in self:
            old, before = self[k]
            part, error = added(old, part), before + error
        self[k] = (part, error)

    def batch(self) -> pa.RecordBatch:
        rows = [(k, n, s.tolist(), c.ravel().tolist(), e) for k, ((n, s, c), e) in self.items()]
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], ["k", "n", "s", "c", "e"])

    def take(self, k: list, n: list, s: list, c: list, e: list) -> None:
        for key, count, total, products, error in zip(k, n, s, c, e, strict=True):
            self.add(key, (count, np.array(total), np.array(products).reshape(len(total), -1)), error)


def tally(rows: DataFrame, judge: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Tally:
    """Moments by cluster of ``rows``, whose last column is the features; ``judge`` gives cluster and error of each row.

    A task returns a row a cluster; ``ADDERS`` tasks add those up before the driver does.
    """
    ship_package(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Tally()
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(batch.num_columns - 1))
                k, errors = judge(batch, x)
                for c in np.unique(k):
                    total.add(int(c), moments_of(x[k == c]), float(errors[k == c].sum()))
        yield total.batch()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Tally()
        for batch in batches:
            total.take(*(column.to_pylist() for column in batch.columns))
        yield total.batch()

    found = Tally()
    for r in rows.mapInArrow(count, _PARTS).repartition(ADDERS).mapInArrow(add, _PARTS).collect():
        found.take(*([v] for v in r))
    return found


def moments(df: DataFrame, features: str = "features", cluster: str | None = None) -> dict[int, Moments]:
    """Count, sum and sum of outer products about the mean of ``features``, by cluster (all in 0 if none)."""
    key = F.col(cluster).cast("long") if cluster else F.lit(0).cast("long")
    rows = df.where(F.col(features).isNotNull()).select(key.alias("k"), F.col(features).cast("array<double>").alias("x"))
    found = tally(rows, lambda batch, x: (batch.column(0).to_numpy(zero_copy_only=False), np.zeros(len(x))))
    return {k: part for k, (part, _) in sorted(found.items())}


def covariance(n: float, s: np.ndarray, c: np.ndarray, ddof: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of moments."""
    return s / n, c / max(n - ddof, 1)


def spectrum(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and eigenvectors in columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def chi2_quantile(share: float, df: float) -> float:
    """The chi-square quantile, by bisection on the regularised incomplete gamma function."""
    from math import exp, lgamma, log

    def below(x: float) -> float:
        a, x = df / 2, x / 2
        if x <= 0:
            return 0.0
        if x < a + 1:  # series
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-15:
                k += 1
                term *= x / k
                total += term
            return total * exp(-x + a * log(x) - lgamma(a))
        b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)  # continued fraction of the upper part
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - exp(-x + a * log(x) - lgamma(a)) * h

    low, high = 0.0, max(1.0, df)
    while below(high) < share:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return (low + high) / 2


def retained(values: np.ndarray, rule: str = "variance", level: float = 0.99, n: float | None = None, shape: float | None = None) -> int:
    """How many components a rule keeps, at least one.

    ``variance``: the least number with that share of the sum. ``kaiser``, ``jolliffe``: above the mean, or 0.6 of it.
    ``broken_stick``: above the expected piece. ``n_eigs``: ``level`` of them. ``chi2``: until the rest are equal by
    Bartlett's test of ``n`` rows. ``hard_threshold``: singular values above omega(shape) times their median.
    """
    p = len(values)
    if rule == "variance":
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        return int(min(np.searchsorted(share, level - 1e-12) + 1, p))
    if rule in ("kaiser", "jolliffe"):
        return max(1, int((values > values.mean() * (1.0 if rule == "kaiser" else 0.6)).sum()))
    if rule == "broken_stick":
        pieces = np.cumsum((1 / np.arange(1, p + 1))[::-1])[::-1]
        return max(1, int(np.argmin(np.append(values > pieces, False))))
    if rule == "n_eigs":
        return int(min(max(1, level), p))
    if rule == "chi2":
        if n is None:
            raise ValueError("the chi-square test needs the number of rows")
        for q in range(p - 1):
            rest = np.maximum(values[q:], 1e-300)
            m = p - q
            u = (n - 1 - (2 * p + 5) / 6) * (m * np.log(rest.mean()) - np.log(rest).sum())
            if u <= chi2_quantile(level, (m - 1) * (m + 2) / 2):
                return max(1, q)
        return p
    if rule == "hard_threshold":
        b = min(shape or 1.0, 1.0)
        omega = 0.56 * b**3 - 0.95 * b**2 + 1.82 * b + 1.43
        singular = np.sqrt(values)
        return max(1, int((singular > omega * np.median(singular)).sum()))
    raise ValueError(f"no rule {rule!r}")


@dataclass
class PCA:
    """Mean, eigenvalues and the kept eigenvectors (in columns) of one group of rows."""

    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(n: float, s: np.ndarray, p: np.ndarray, rule: str = "variance", level: float = 0.99) -> PCA:
        mean, cov = covariance(n, s, p)
        values, vectors = spectrum(cov)
        keep = retained(values, rule, level, n, len(s) / max(n, 1.0))
        return PCA(mean, values, vectors[:, :keep], cov)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis

    def weighted_scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of unit variance."""
        return self.scores(x) / np.sqrt(np.maximum(self.values[: self.basis.shape[1]], 1e-300))

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x) @ self.basis.T + self.mean

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Squared residual of each row."""
        residual = x - self.reconstruct(x)
        return (residual * residual).sum(axis=1)

    def expected_error(self, n: float, s: np.ndarray, p: np.ndarray) -> float:
        """Mean squared residual of rows known by their moments alone."""
        d = s / n - self.mean
        second = covariance(n, s, p, 0)[1] + np.outer(d, d)
        return float(np.trace(second) - np.trace(self.basis.T @ second @ self.basis))

    def loadings(self) -> np.ndarray:
        """Correlation of each variable with each kept component."""
        q = self.basis.shape[1]
        return self.basis * np.sqrt(self.values[:q]) / np.sqrt(np.maximum(np.diag(self.cov), 1e-300))[:, None]

    def explained(self) -> np.ndarray:
        """The share of each variable's variance that the kept components hold."""
        return (self.loadings() ** 2).sum(axis=1)


def fit_pca(df: DataFrame, features: str = "features", rule: str = "variance", level: float = 0.99) -> PCA:
    found = moments(df, features)
    if not found:
        raise ValueError("no rows")
    return PCA.of(*found[0], rule=rule, level=level)


def normal_scores(df: DataFrame, pca: PCA, features: str = "features", skew: float = 0.3, kurt: float = 3.0) -> int:
    """Components up to the first whose scores look normal: skewness within ``skew`` and kurtosis above ``kurt``."""
    x = F.col(features)
    aggs = []
    for i in range(pca.basis.shape[1]):
        terms = [(F.get(x, j) - float(pca.mean[j])) * float(pca.basis[j, i]) for j in range(len(pca.mean))]
        score = sum(terms[1:], terms[0])
        aggs += [F.skewness(score), F.kurtosis(score)]
    row = df.agg(*aggs).first()
    for i in range(pca.basis.shape[1]):
        if abs(row[2 * i] or 0) < skew and abs((row[2 * i + 1] or 0) + 3) > kurt:
            return max(1, i)
    return pca.basis.shape[1]
