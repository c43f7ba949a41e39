"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from meshnet.plans.scratch import materialize, ship_package

#: Links that a task joins at once before the rounds.
AT_ONCE = 1 << 20


def _least(links: DataFrame) -> DataFrame:
    """``node, least``: the smallest node each larger end is linked to."""
    return links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node has one link down, or links up alone."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("lo").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def _joined(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node but the least of each component of these links, to that least node."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b, root = at[: len(hi)], at[len(hi) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _join_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of ``hi, lo``, of ``AT_ONCE`` links or some more at a time."""
    held, n = [], 0

    def stars() -> pa.RecordBatch:
        columns = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(*columns)], names=["hi", "lo"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def _whole_numbers(links: DataFrame) -> bool:
    return all(isinstance(links.schema[c].dataType, IntegralType) for c in ("hi", "lo"))


def _in_tasks(links: DataFrame) -> DataFrame:
    """``links`` of whole numbers, those of each task joined to stars."""
    ship_package(links.sparkSession)
    kinds = {c: links.schema[c].dataType for c in ("hi", "lo")}
    longs = links.select(*(F.col(c).cast("long").alias(c) for c in kinds))
    return longs.mapInArrow(_join_some, "hi long, lo long").select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))


def _near_links_joined(links: DataFrame) -> DataFrame:
    """Links of the same components, those of nearby numbers joined to stars by the task that has them."""
    return _in_tasks(links.repartitionByRange("lo", "hi")) if _whole_numbers(links) else links.distinct()


def stars(edges: DataFrame, src: str = "src", dst: str = "dst", near: bool = False, most: int | None = None) -> DataFrame:
    """``node, component`` of every node that is not the smallest of its component; see :func:`connected_components`.

    ``most`` bounds the number of edges, if that is known. Up to ``AT_ONCE`` are joined by one task, in no rounds.
    """
    a, b = F.col(src), F.col(dst)
    links = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    near = near and _whole_numbers(links)
    if near and most is not None and most <= AT_ONCE:
        return _in_tasks(links.coalesce(1)).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    left = Observation()
    links = materialize((_near_links_joined(links) if near else links.distinct()).observe(left, F.count(F.lit(1)).alias("n")), "links")
    while not _is_forest_of_stars(links):
        if near and left.get["n"] <= AT_ONCE:
            links = materialize(_in_tasks(links.coalesce(1)), "links")
            break
        large = links.join(_least(links), F.col("lo") == F.col("node"), "left")
        large = materialize(large.select("hi", F.coalesce("least", "lo").alias("lo")).distinct(), "links")  # read twice
        least = _least(large)
        small = large.join(least, F.col("hi") == F.col("node")).where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        own = least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))
        links = materialize(small.unionByName(own).distinct(), "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", near: bool = False) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    A round links the larger neighbours of each node to its least neighbour
    (large star), then the smaller ones and itself (small star). Rounds follow
    the logarithm of the number of nodes whatever the diameter: a path of 4096
    nodes takes 13 in any order of its numbers that was tried. There are never
    more links than at first. They are written once a round, which cuts the
    plan; nothing but the test for the end reaches the driver. With ``near``,
    for graphs whose edges mostly go to nearby numbers, ranges of links are
    joined within tasks first, which leaves for rounds what crosses ranges, or
    for one task if those are at most ``AT_ONCE`` links.
    """
    a, b = F.col(src), F.col(dst)
    loops = edges.where(a == b).select(a.alias("node"), a.alias("component"))
    found = stars(edges, src, dst, near)
    centres = found.select(F.col("component").alias("node"), "component")
    return found.unionByName(centres.unionByName(loops).distinct().join(found.select("node"), "node", "left_anti"))
