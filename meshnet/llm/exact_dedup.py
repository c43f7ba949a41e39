"""Exact dedup with a heavy-hitter split.

A frequent-items sketch (the mergeable Misra-Gries family, in Spark's
``approx_top_k``) names the digests that hold a large share of the rows. Their
winners and sizes are then counted exactly and broadcast, so rows of hot groups
are settled map-side and never meet in one task. All other digests take one
ordinary shuffle. Only DataFrame functions run.

Cases: a null text counts as empty. A null id loses against any other; a group
of null ids only has a null ``keep_id`` and keeps its rows. Rows repeated with
one id and text are one document: all of them are kept or none, and each counts
in ``group_size``. An empty table gives an empty result. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshnet.plans.scratch import materialize
from meshnet.plans.tables import read_table

#: A digest with this share of the rows is heavy; so at most 1 / HEAVY_SHARE winners are broadcast.
HEAVY_SHARE = 1 / 1000
#: Counters of the sketch; its error is 3.5 / TRACKED of the rows, well below HEAVY_SHARE.
TRACKED = 8192


def _heavy(slim: DataFrame, total: int, share: float) -> DataFrame:
    """Exact ``digest, keep_id, group_size`` of the digests that hold ``share`` of the rows."""
    most = int(1 / share)
    # Sketches meet in two levels, so no task merges one from every input partition.
    tops = (
        slim.select(F.xxhash64("digest").alias("h"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("sketch"))
        .coalesce(1)  # at most 64 rows; the merge can't take a task without any
        .agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("top"))
        .select(F.col("top.item").alias("h"), F.col("top.count").alias("estimate"))
        .where(F.col("estimate") >= max(2.0, share * total))
    )
    candidates = F.broadcast(tops.select("h"))
    return (
        slim.withColumn("h", F.xxhash64("digest"))
        .join(candidates, "h", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= max(2.0, share * total))
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of rows whose texts are identical, the one with the largest id stays.
    """
    slim = materialize(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )
    total = slim.count()
    if total:
        heavy = materialize(_heavy(slim, total, heavy_share), "heavy")
        winners = F.broadcast(heavy)
        hot = slim.join(winners, "digest")
        rest = slim.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    else:
        hot, rest = None, slim
    group = Window.partitionBy("digest")
    settled = rest.select(
        "digest",
        "id",
        F.max("id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    if hot is not None:
        settled = settled.unionByName(hot)
    return settled.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
