"""Centering, scaling and binning of feature columns; each fit is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors at or below this are raised to it, so that constant columns can be divided by theirs.
LEAST = 1e-16
METHODS = ("auto", "pareto", "range", "vast", "max", "level", "none", "vast_squared", "max_abs", "kurtosis", "max_kurtosis", "range_kurtosis")


def _statistics(c: str) -> list[Column]:
    x = F.col(c)
    return [F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), F.max(F.abs(x)), F.kurtosis(x)]


def _factor(method: str, mean: float, std: float, low: float, high: float, size: float, kurtosis: float | None) -> float:
    kurt = (kurtosis or 0.0) + 3.0
    return {
        "auto": std, "pareto": std**0.5, "range": high - low, "vast": std * mean, "max": high, "level": mean, "none": 1.0,
        "vast_squared": std**2 / mean if mean else 0.0, "max_abs": size,
        "kurtosis": (std * kurt) ** 2 / mean if mean else 0.0, "max_kurtosis": (std * kurt) ** 2 / size if size else 0.0,
        "range_kurtosis": (std * kurt) ** 2 / (high - low) if high > low else 0.0,
    }[method]


@dataclass
class Scaler:
    """Columns less their mean over a factor: ``fit`` learns both, ``inverse_transform`` undoes them."""

    method: str = "auto"
    center: bool = True
    means: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str], own: Sequence[float] | None = None) -> Scaler:
        """``own`` factors, if given, are used in place of the method's."""
        if self.method not in METHODS and own is None:
            raise ValueError(f"{self.method!r} is none of {', '.join(METHODS)}")
        row = df.agg(*(e for c in columns for e in _statistics(c))).first()
        for i, c in enumerate(columns):
            mean, *rest = row[6 * i : 6 * i + 6]
            if mean is None:
                raise ValueError(f"{c} has no values")
            factor = own[i] if own is not None else _factor(self.method, mean, *rest)
            self.means[c] = mean if self.center else 0.0
            self.factors[c] = LEAST if abs(factor) < LEAST else factor
        return self

    def _known(self, columns: Sequence[str] | None) -> list[str]:
        if not self.factors:
            raise ValueError("fit the scaler first")
        return list(self.factors if columns is None else columns)

    def transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.factors[c]) for c in self._known(columns)})

    def inverse_transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.factors[c]) + F.lit(self.means[c]) for c in self._known(columns)})


def scale(df: DataFrame, columns: Sequence[str], method: str = "auto", center: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Scale within the whole table or, by ``by``, within groups: statistics join back, one row or one a group."""
    stats = df.groupBy(*by).agg(
        *(e.alias(f"__{c}_{i}") for c in columns for i, e in enumerate(_statistics(c)))
    )
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    out = {}
    for c in columns:
        mean, std, low, high, size, kurt = (F.col(f"__{c}_{i}") for i in range(6))
        tailed = F.pow(std * (kurt + 3), F.lit(2))
        factor = {
            "auto": std, "pareto": F.sqrt(std), "range": high - low, "vast": std * mean, "max": high, "level": mean,
            "none": F.lit(1.0), "max_abs": size, "vast_squared": F.try_divide(std * std, mean),
            "kurtosis": F.try_divide(tailed, mean), "max_kurtosis": F.try_divide(tailed, size), "range_kurtosis": F.try_divide(tailed, high - low),
        }[method]
        factor = F.when(F.abs(factor) < LEAST, F.lit(LEAST)).otherwise(F.coalesce(factor, F.lit(LEAST)))
        out[c] = (F.col(c) - (mean if center else F.lit(0.0))) / factor
    return joined.withColumns(out).select(*df.columns)


def center_rows_and_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Double centering: less the row's and the column's mean, plus the grand mean."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    grand = sum(means[c] for c in columns) / len(columns)
    row = sum((F.col(c) for c in columns), F.lit(0.0)) / F.lit(float(len(columns)))
    return df.withColumns({c: F.col(c) - row - F.lit(means[c]) + F.lit(grand) for c in columns})


def bin_edges(low: float, high: float, bins: int, stoichiometric: float | None = None) -> list[float]:
    """Equal bins; with ``stoichiometric``, half of them below it and half above."""
    if bins < 1 or not low < high:
        raise ValueError("bins need a positive count and a range")
    if stoichiometric is None:
        return [low + (high - low) * i / bins for i in range(bins + 1)]
    if bins % 2 or not low < stoichiometric < high:
        raise ValueError("an even count of bins and a value within the range")
    half = bins // 2
    lower = [low + (stoichiometric - low) * i / half for i in range(half)]
    return lower + [stoichiometric + (high - stoichiometric) * i / half for i in range(half + 1)]


def condition(df: DataFrame, z: str, edges: Sequence[float], closed: bool = True, out: str = "bin") -> DataFrame:
    """Rows by bin of ``z``; closed bins share their edges, so a row on an edge is in both.

    The bins of a row are found in the row itself, so nothing is joined or shuffled.
    """
    x = F.col(z)
    inside = [(x >= lo) & ((x <= hi) if closed or i == len(edges) - 2 else (x < hi)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    found = F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(inside))), lambda b: b.isNotNull())
    return df.withColumn(out, F.explode(found))
