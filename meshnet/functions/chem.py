"""Chemistry as column expressions: formulas and weights are parsed on the driver and become literals.

A composition is a mapping from species to a column (wide form) or one
``MAP<STRING, DOUBLE>`` column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole atomic masses.
ATOMIC_MASS = {"C": 12, "H": 1, "N": 14, "O": 16}
#: Fixed value: the coupling function of air, of which 0.233 by mass is oxygen.
BETA_AIR = -0.233 / 16
#: Fixed value: the gas constant, in J/mol/K.
GAS_CONSTANT = 8.31446261815324
#: Public polynomials of seven coefficients for enthalpy over R T and temperature: where they change over, those below, those above.
NASA7 = {
    "H2": (1000.0,
           [2.34433112e00, 7.98052075e-03, -1.94781510e-05, 2.01572094e-08, -7.37611761e-12, -9.17935173e02, 6.83010238e-01],
           [3.33727920e00, -4.94024731e-05, 4.99456778e-07, -1.79566394e-10, 2.00255376e-14, -9.50158922e02, -3.20502331e00]),
    "O2": (1000.0,
           [3.78245636e00, -2.99673416e-03, 9.84730201e-06, -9.68129509e-09, 3.24372837e-12, -1.06394356e03, 3.65767573e00],
           [3.28253784e00, 1.48308754e-03, -7.57966669e-07, 2.09470555e-10, -2.16717794e-14, -1.08845772e03, 5.45323129e00]),
    "N2": (1000.0,
           [3.29867700e00, 1.40824040e-03, -3.96322200e-06, 5.64151500e-09, -2.44485400e-12, -1.02089990e03, 3.95037200e00],
           [2.92664000e00, 1.48797680e-03, -5.68476000e-07, 1.00970380e-10, -6.75335100e-15, -9.22797700e02, 5.98052800e00]),
    "H2O": (1000.0,
            [4.19864056e00, -2.03643410e-03, 6.52040211e-06, -5.48797062e-09, 1.77197817e-12, -3.02937267e04, -8.49032208e-01],
            [3.03399249e00, 2.17691804e-03, -1.64072518e-07, -9.70419870e-11, 1.68200992e-14, -3.00042971e04, 4.96677010e00]),
    "CO": (1000.0,
           [3.57953347e00, -6.10353680e-04, 1.01681433e-06, 9.07005884e-10, -9.04424499e-13, -1.43440860e04, 3.50840928e00],
           [2.71518561e00, 2.06252743e-03, -9.98825771e-07, 2.30053008e-10, -2.03647716e-14, -1.41518724e04, 7.81868772e00]),
    "CO2": (1000.0,
            [2.35677352e00, 8.98459677e-03, -7.12356269e-06, 2.45919022e-09, -1.43699548e-13, -4.83719697e04, 9.90105222e00],
            [3.85746029e00, 4.41437026e-03, -2.21481404e-06, 5.23490188e-10, -4.72084164e-14, -4.87591660e04, 2.27163806e00]),
    "CH4": (1000.0,
            [5.14987613e00, -1.36709788e-02, 4.91800599e-05, -4.84743026e-08, 1.66693956e-11, -1.02466476e04, -4.64130376e00],
            [7.48514950e-02, 1.33909467e-02, -5.73285809e-06, 1.22292535e-09, -1.01815230e-13, -9.46834459e03, 1.84373180e01]),
}
#: Halvings of the interval that a temperature is sought in.
HALVINGS = 60
_ATOM = re.compile(r"([A-Z][a-z]?)(\d*)")


def elements(formula: str) -> dict[str, int]:
    """Atoms of each element, repeated ones added up: ``CH3OH`` is C 1, H 4, O 1."""
    name = formula.strip().upper()
    name = re.sub(r"\(S\)$", "", name)
    counts: dict[str, int] = {}
    at = 0
    for m in _ATOM.finditer(name):
        if m.start() != at or m[1] not in ATOMIC_MASS:
            raise ValueError(f"{formula!r} is no formula of {', '.join(ATOMIC_MASS)}")
        counts[m[1]] = counts.get(m[1], 0) + int(m[2] or 1)
        at = m.end()
    if not counts or at != len(name):
        raise ValueError(f"{formula!r} is no formula of {', '.join(ATOMIC_MASS)}")
    return counts


def molecular_weight(formula: str) -> int:
    return sum(ATOMIC_MASS[e] * n for e, n in elements(formula).items())


def parse_composition(text: str | Iterable[str]) -> dict[str, float]:
    """``"CH4:0.5, H2:0.5"``, or a list of such pairs, as species and share."""
    parts = text.split(",") if isinstance(text, str) else list(text)
    out: dict[str, float] = {}
    for part in parts:
        if not part.strip():
            continue
        name, colon, share = part.partition(":")
        if not colon:
            raise ValueError(f"{part!r} is not species:share")
        out[name.strip()] = out.get(name.strip(), 0.0) + float(share)
    return out


def species_label(header: Column) -> Column:
    """``"   molef-ch4"`` as ``CH4``."""
    return F.upper(F.substring_index(F.trim(header), "-", -1))


def species_of(header: str) -> str:
    """The same on the driver, for headers of files."""
    return header.strip().split()[0].rpartition("-")[2].upper()


def _total(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    return reduce(add, terms) if terms else F.lit(0.0)


def mole_to_mass(moles: Mapping[str, Column]) -> dict[str, Column]:
    """Mass fractions of mole fractions; null where the total is 0."""
    weighted = {s: x * F.lit(float(molecular_weight(s))) for s, x in moles.items()}
    total = _total(weighted.values())
    return {s: F.try_divide(w, total) for s, w in weighted.items()}


def element_fraction(masses: Mapping[str, Column], element: str) -> Column:
    """Mass fraction of an element."""
    return _total(
        y * F.lit(ATOMIC_MASS[element] * n / molecular_weight(s))
        for s, y in masses.items()
        if (n := elements(s).get(element, 0))
    )


def element_share(masses: Mapping[str, float], element: str) -> float:
    return sum(y * ATOMIC_MASS[element] * elements(s).get(element, 0) / molecular_weight(s) for s, y in masses.items())


def beta_of(masses: Mapping[str, float]) -> float:
    """The coupling function of a fuel: its oxygen is not counted."""
    return 2 * element_share(masses, "C") / 12 + 0.5 * element_share(masses, "H")


def mixture_fraction(masses: Mapping[str, Column], fuel: Mapping[str, float], oxidiser: Mapping[str, float] | None = None) -> Column:
    """Bilger's mixture fraction of mass fractions; without an ``oxidiser`` (by mass) against air.

    With one, the oxygen of both streams counts.
    """
    beta = (
        element_fraction(masses, "C") * F.lit(2 / 12)
        + element_fraction(masses, "H") * F.lit(0.5)
        - element_fraction(masses, "O") * F.lit(1 / 16)
    )
    if oxidiser is None:
        low, high = BETA_AIR, beta_of(fuel)
    else:
        low, high = (beta_of(s) - element_share(s, "O") / 16 for s in (oxidiser, fuel))
        if low == high:
            raise ValueError("fuel and oxidiser are alike")
    return (beta - F.lit(low)) / F.lit(high - low)


def progress_variable(values: Mapping[str, Column], spec: str) -> Column:
    """``"CO2:1, CO:0.5"`` as the weighted sum of those columns."""
    weights = parse_composition(spec)
    if missing := [s for s in weights if s not in values]:
        raise ValueError(f"no values of {', '.join(missing)}")
    return _total(values[s] * F.lit(w) for s, w in weights.items())


def map_sum(composition: Column, weights: Mapping[str, float]) -> Column:
    """The weighted sum over a map column; species without a weight count 0."""
    table = F.create_map(*(x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))))
    return F.aggregate(
        F.map_entries(composition),
        F.lit(0.0),
        lambda total, e: total + F.coalesce(e["value"] * F.try_element_at(table, e["key"]), F.lit(0.0)),
    )


def equivalence_ratio(moles: Mapping[str, Column]) -> Column:
    """Oxygen atoms that carbon and hydrogen need, over those there are; null without oxygen."""
    atoms = {e: _total(x * F.lit(float(n)) for s, x in moles.items() if (n := elements(s).get(e, 0))) for e in "CHO"}
    return F.try_divide(2 * atoms["C"] + 0.5 * atoms["H"], atoms["O"])


def gas_terms(shares: Column, data: Mapping[str, tuple[float, list[float], list[float]]] = NASA7) -> Column:
    """What :func:`enthalpy` needs of mass fractions by species: moles a kilogram and polynomials of each; an unknown species is an error."""
    numbers = lambda values: F.array(*(F.lit(float(v)) for v in values[:6]))
    known = F.create_map(
        *(
            x
            for s, (change, low, high) in data.items()
            for x in (
                F.lit(s),
                F.struct(F.lit(1000.0 / molecular_weight(s)).alias("n"), F.lit(change).alias("change"), numbers(low).alias("low"), numbers(high).alias("high")),
            )
        )
    )

    def term(entry: Column) -> Column:
        own = F.try_element_at(known, entry["key"])
        own = F.when(own.isNull(), F.raise_error(F.concat(F.lit("no enthalpy of "), entry["key"]))).otherwise(own)
        return F.struct((own["n"] * entry["value"]).alias("n"), own["change"].alias("change"), own["low"].alias("low"), own["high"].alias("high"))

    return F.transform(F.filter(F.map_entries(shares), lambda e: e["value"] != 0), term)


def enthalpy(terms: Column, temperature: Column) -> Column:
    """Enthalpy in J/kg of a gas (see :func:`gas_terms`) at a temperature in K."""

    def of(term: Column) -> Column:
        c = F.when(temperature < term["change"], term["low"]).otherwise(term["high"])
        x = c[4] / 5
        for i in (3, 2, 1, 0):
            x = c[i] / (i + 1) + temperature * x
        return term["n"] * (c[5] + temperature * x)

    return F.lit(GAS_CONSTANT) * F.aggregate(terms, F.lit(0.0), lambda total, t: total + of(t))


def temperature_of(terms: Column, wanted: Column, low: Column, high: Column) -> Column:
    """The temperature between ``low`` and ``high`` at which a gas has the enthalpy ``wanted``, by halving; enthalpy grows with temperature."""
    step = lambda t, i: t + F.when(enthalpy(terms, t) < wanted, high - low).otherwise(low - high) / F.pow(F.lit(2.0), i + 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), (low + high) / 2, step)
