"""Scans of exported cells, faces and boundaries, with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("volume", "solution")
#: The exports that a whole case has.
ALL_FIELDS = ("volume", "solution", "density", "velocity", "angle", "tau")
COORDINATES = ("x", "y", "z")
BOUNDARY_SCHEMA = "cell_id double, zone_id double, mass_flowrate double, area double, heat_flux double"


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return [(c.strip().split() or [""])[0] for c in first[0].value.split(sep)]


def read_field(spark: SparkSession, path: str, dim: int, sep: str = ",", coordinates: bool = False) -> DataFrame:
    """One export: ``cell_id``, coordinates if asked for, and the value columns by the first word of their header."""
    if dim not in (2, 3):
        raise ValueError("dim is 2 or 3")
    names = _header(spark, path, sep)
    values = names[dim + 1 :]
    own = ["cell_id", *COORDINATES[:dim], *values]
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(len(own))])
    raw = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    keep = range(len(own)) if coordinates else [0, *range(dim + 1, len(own))]
    return raw.select(*(F.col(f"c{i}").cast("long" if i == 0 else "double").alias(own[i]) for i in keep))


def read_cells(
    spark: SparkSession, files: Mapping[str, str], dim: int, sep: str = ",", assert_rows: bool = True, required: Sequence[str] = REQUIRED
) -> DataFrame:
    """All exports joined by cell: fields of one column take the field's name, others keep their headers'.

    The first file gives the coordinates. Every file must have the same cells:
    one scan of the full outer join tells. ``required`` may be ``ALL_FIELDS``.
    """
    if missing := [f for f in required if f not in files]:
        raise ValueError(f"no file for {', '.join(missing)}")
    out = None
    for i, (name, path) in enumerate(files.items()):
        field = read_field(spark, path, dim, sep, coordinates=i == 0)
        values = [c for c in field.columns if c not in ("cell_id", *COORDINATES)]
        if len(values) == 1:
            field = field.withColumnRenamed(values[0], name)
        field = field.withColumn(f"__in_{name}", F.lit(1))
        out = field if out is None else out.join(field, "cell_id", "full" if assert_rows else "inner")
    marks = [f"__in_{name}" for name in files]
    if assert_rows:
        lacking = out.agg(*(F.count_if(F.col(m).isNull()).alias(m) for m in marks), F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("ids")).first()
        if bad := [files[name] for name, m in zip(files, marks, strict=True) if lacking[m]]:
            raise ValueError(f"{', '.join(bad)} lack cells that other files have")
        if lacking.n != lacking.ids:
            raise ValueError("a file names a cell twice")
    return out.drop(*marks)


def read_faces(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``c_id0, c_id1, mass_flowrate`` and, if there, ``area``: columns by name wherever they stand.

    A file of other headers is read by position: after three coordinates come the cells, the flow and the area.
    """
    names = _header(spark, path, sep)
    if not {"c_id0", "c_id1", "mass_flowrate"} & set(names):
        names = [f"__{i}" for i in range(3)] + ["c_id0", "c_id1", "mass_flowrate", "area"][: len(names) - 3]
    schema = T.StructType([T.StructField(n or f"c{i}", T.DoubleType()) for i, n in enumerate(names)])
    raw = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).csv(path)
    own = [("c_id0", "long"), ("c_id1", "long"), ("mass_flowrate", "double"), ("area", "double")]
    if missing := [c for c, _ in own[:3] if c not in names]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*(F.col(c).cast(t).alias(c) for c, t in own if c in names))


def faces_from_pairs(spark: SparkSession, pairs: list[tuple[int, int]], flows: list[float] | None = None) -> DataFrame:
    """Connectivity that is already in memory; without flows they are null."""
    rows = [(int(a), int(b), None if flows is None else float(flows[i])) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "c_id0 long, c_id1 long, mass_flowrate double")


def read_boundary(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Boundary faces; the file has no header, and its area is the squared face area."""
    raw = spark.read.schema(BOUNDARY_SCHEMA).option("sep", sep).csv(path)
    return raw.withColumns({"cell_id": F.col("cell_id").cast("long"), "zone_id": F.col("zone_id").cast("int")})
