"""Results of clustering as tables in a folder, written and read back through Spark."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from meshnet.operators.pca import PCA

FORMATS = ("parquet", "csv")
_BASES = "cluster int, mean array<double>, values array<double>, components array<array<double>>"
_ERRORS = "pass int, error double"


def save_clustering(
    folder: str, labels: DataFrame, centroids: DataFrame | None = None, models: Mapping[int, PCA] | None = None,
    errors: list[float] | None = None, form: str = "parquet",
) -> None:
    """``labels`` (``cell_id, cluster``), ``centroids``, ``bases`` of a local-PCA model and the ``errors`` of its passes.

    In ``csv``, which holds no lists, only labels, centroids and errors. An old result in the folder is replaced.
    """
    if form not in FORMATS:
        raise ValueError(f"form is {' or '.join(FORMATS)}")
    spark = labels.sparkSession
    tables = {"labels": labels, "centroids": centroids}
    if errors is not None:
        tables["errors"] = spark.createDataFrame([(i, float(e)) for i, e in enumerate(errors)], _ERRORS)
    if models is not None and form == "parquet":
        rows = [(int(k), m.mean.tolist(), m.values.tolist(), m.basis.T.tolist()) for k, m in models.items()]
        tables["bases"] = spark.createDataFrame(rows, _BASES)
    for name, table in tables.items():
        if table is not None:
            writer = table.write.mode("overwrite")
            writer.parquet(f"{folder}/{name}") if form == "parquet" else writer.option("header", True).csv(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str, form: str = "parquet") -> DataFrame:
    """A table that ``save_clustering`` wrote."""
    return spark.read.parquet(f"{folder}/{name}") if form == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")


def load_models(spark: SparkSession, folder: str) -> dict[int, PCA]:
    """Bases by cluster, as ``assign`` takes them; covariances are those that the bases hold."""
    out = {}
    for r in load_table(spark, folder, "bases").orderBy("cluster").collect():
        values, basis = np.array(r["values"]), np.array(r.components).reshape(len(r.components), len(r.mean)).T
        kept = values[: basis.shape[1]]
        out[r.cluster] = PCA(np.array(r.mean), values, basis, basis @ np.diag(kept) @ basis.T)
    return out
