"""Tables that cut a plan: written to the folder all executors share, then reread.

A written table survives the loss of any executor, is evaluated once however
often it is read, and keeps column pruning, which a checkpointed RDD does not.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master a temporary one if unset.

    A cluster without that setting is an error: a folder of one machine would
    hide the files of each executor from the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="meshnet-")
    return _LOCAL[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/meshnet/{uuid.uuid4().hex}-{label}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return the DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a context, wherever the driver found it.

    The archive is handed to Spark, which serves it; nothing else reads the file.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="meshnet-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".txt"):  # code, and rules that are read as text
                out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def bound_arrow_batches(spark: SparkSession, max_bytes: int = 8 << 20) -> None:
    """Bound what one Arrow batch holds by bytes, so very long texts don't pile up.

    A lower limit that the session already has is left alone. Operators that run
    Python call this, so the package is shipped here too.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key, "2147483647"))
    except ValueError:
        now = 0
    if now <= 0 or now > max_bytes:
        spark.conf.set(key, str(max_bytes))
