"""Feature columns for clustering, as expressions over the cell table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshnet.functions.chem import mole_to_mass, species_of

#: Species of the ready-made sets.
SPECIES_SETS = {
    "major": ["O2", "OH", "H2O", "CH4", "H2"],
    "coord": ["OH", "O", "H"],
    "reduced_set": ["OH", "H", "O", "CO2", "CO", "NO"],
    "pure_h2": ["O2", "OH", "H2O", "H2", "H", "O", "H2O2", "HO2", "N2"],
    "ammonia": ["O2", "NH3", "OH", "NO", "H2", "NO2", "O", "H"],
}
#: Factors from metres to the units of decks, and around the axis.
M3_TO_CM3, M_TO_MM, TWO_PI = 1e6, 1e3, 6.283185307179586


def capped_log10(tau: Column) -> Column:
    """``min(log10(tau), 1)``; null where tau is not positive."""
    return F.least(F.log10(tau), F.lit(1.0))


def reduced(temperature: Column, velocity: Column, tau: Column) -> list[Column]:
    """Temperature, velocity to the power 1.5 and capped residence time."""
    return [temperature, F.pow(velocity, F.lit(1.5)), capped_log10(tau)]


def reduced_set(
    temperature: Column, moles: Mapping[str, Column], progress_max: float, velocity: Column, tau: Column, tvar: Column,
    progress: Sequence[str] = ("H2O", "CO2"), species: Sequence[str] = tuple(SPECIES_SETS["reduced_set"]),
) -> list[Column]:
    """Temperature, mass fractions, progress variable, squared capped log of tau, velocity, temperature variance."""
    masses = mole_to_mass(moles)
    level = sum((masses[s] for s in progress), F.lit(0.0)) / F.lit(progress_max)
    slow = F.pow(F.least(F.ln(tau), F.lit(1.0)), F.lit(2))
    return [temperature, *(masses[s] for s in species), level, slow, F.pow(velocity, F.lit(1.5)), tvar]


def velocity_only(velocity: Column, angle: Column, tau: Column) -> list[Column]:
    return [velocity, angle, -F.log10(F.least(tau, F.lit(1.0)))]


def square_roots(values: Sequence[Column]) -> list[Column]:
    return [F.sqrt(v) for v in values]


def species_features(df: DataFrame, dataset: str, temperature: str, coordinates: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``features``: temperature, and the species of a set that are columns of ``df``, by label.

    A column's label is the part after its last hyphen, in capitals. ``all`` takes every column with such a prefix;
    ``coord`` puts the first two ``coordinates`` in front, ``ammonia`` takes square roots.
    """
    labels = {species_of(c): c for c in df.columns if "-" in c or species_of(c) == c}
    if dataset == "all":
        chosen = [c for c in df.columns if "-" in c]
    elif dataset in SPECIES_SETS:
        chosen = [labels[s] for s in SPECIES_SETS[dataset] if s in labels]
    else:
        raise ValueError(f"no set {dataset!r}")
    columns = [F.col(f"`{c}`") for c in chosen]
    if dataset == "ammonia":
        columns = square_roots(columns)
    front = [F.col(c) for c in coordinates[:2]] if dataset == "coord" else [F.col(temperature)]
    return df.withColumn("features", F.array(*(c.cast("double") for c in (*front, *columns))))


def log_scale(x: Column) -> Column:
    """``ln |x|``, and -100 for 0."""
    return F.when(x == 0, F.lit(-100.0)).otherwise(F.ln(F.abs(x)))


def around_axis(x: Column, dim: int) -> Column:
    """Volumes, areas and fluxes of a 2-D case are per radian: turn once around the axis."""
    if dim not in (2, 3):
        raise ValueError("dim is 2 or 3")
    return x * F.lit(TWO_PI) if dim == 2 else x


def custom_features(cells: DataFrame, features: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """A user's features joined by id; there must be one row for each cell."""
    joined = cells.join(features, id_col)
    rows, cells_n, own_n = joined.count(), cells.count(), features.count()
    if not rows == cells_n == own_n:
        raise ValueError(f"{cells_n} cells and {own_n} rows of features, of which {rows} match")
    return joined
