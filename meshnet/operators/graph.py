"""Clusters as parts of the mesh graph: connectivity, and moving and merging parts until clusters are connected.

The cells are looked at once: components of each cluster, their size and volume,
and how many faces two components share. Moving and merging need no more than
that, and work in rounds on the tables of this quotient graph; no part reaches
the driver. The rules name an order, first cluster first or least volume first.
A step can only be changed by an earlier one beside it, so in each round all
clusters go ahead that have no earlier one beside them, and the outcome is that
of the rules one by one. The outcome joins back to the cells by component.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from meshnet.operators.components import connected_components, stars
from meshnet.plans.scratch import materialize

#: Tables of renamed parts that one plan joins; more are written on the way.
JOINED = 8


def undirected(faces: DataFrame) -> DataFrame:
    """``c_id0 < c_id1``, each pair once, without loops."""
    return (
        faces.where("c_id0 <> c_id1")
        .select(F.least("c_id0", "c_id1").alias("c_id0"), F.greatest("c_id0", "c_id1").alias("c_id1"))
        .distinct()
    )


def edge_weights(faces: DataFrame, order: Column | str, weight: str = "mass_flowrate") -> DataFrame:
    """``c_id0 < c_id1, weight`` of the undirected graph: an edge given several times, either way round, has the weight it was given last in ``order``."""
    last = F.max_by(F.struct(F.col(weight).alias("weight")), order)["weight"]
    ends = F.least("c_id0", "c_id1").alias("c_id0"), F.greatest("c_id0", "c_id1").alias("c_id1")
    return faces.where("c_id0 <> c_id1 and c_id0 <> -1 and c_id1 <> -1").groupBy(*ends).agg(last.alias("weight"))


def adjacency(faces: DataFrame) -> DataFrame:
    """``cell_id, neighbour`` in both directions."""
    one = undirected(faces)
    return one.select(F.col("c_id0").alias("cell_id"), F.col("c_id1").alias("neighbour")).unionByName(
        one.select(F.col("c_id1").alias("cell_id"), F.col("c_id0").alias("neighbour"))
    )


def is_connected(faces: DataFrame) -> bool:
    """Whether the mesh has one component."""
    return connected_components(undirected(faces), "c_id0", "c_id1").select("component").distinct().limit(2).count() <= 1


def weighted_edges(faces: DataFrame, features: DataFrame, scale: float = 1e-6) -> DataFrame:
    """``c_id0, c_id1, weight``: squared distance of the features over ``scale``."""
    side = lambda end: features.select(F.col("cell_id").alias(f"c_id{end}"), F.col("features").alias(f"f{end}"))
    square = F.aggregate(F.zip_with("f0", "f1", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return undirected(faces).join(side(0), "c_id0").join(side(1), "c_id1").select("c_id0", "c_id1", (square / scale).alias("weight"))


def _with_clusters(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """``c_id0 < c_id1, k0, k1``: each pair with its clusters, written."""
    first = labels.select(F.col("cell_id").alias("c_id0"), F.col("cluster").alias("k0"))
    second = labels.select(F.col("cell_id").alias("c_id1"), F.col("cluster").alias("k1"))
    return materialize(undirected(faces).join(first, "c_id0").join(second, "c_id1").select("c_id0", "c_id1", "k0", "k1"), "faces")


def _components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` with the ``component`` that the ``pairs`` of :func:`_with_clusters` give."""
    parts = stars(pairs.where("k0 = k1"), "c_id0", "c_id1", near=True).withColumnRenamed("node", "cell_id")
    return labels.join(parts, "cell_id", "left").select("cell_id", "cluster", F.coalesce("component", "cell_id").alias("component"))


def cluster_components(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """``cell_id, cluster, component``: parts of each cluster that faces within it connect, named by their least cell."""
    return _components(_with_clusters(faces, labels), labels)


def components_per_cluster(faces: DataFrame, labels: DataFrame) -> DataFrame:
    return cluster_components(faces, labels).groupBy("cluster").agg(F.count_distinct("component").alias("n_components"))


def clusters_connected(faces: DataFrame, labels: DataFrame) -> bool:
    """Whether every cluster has one component."""
    return components_per_cluster(faces, labels).where("n_components > 1").limit(1).count() == 0


def connectivity_study(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, component, size, rank, spared``: components by size, and cells outside the cluster's largest."""
    sizes = cluster_components(faces, labels).groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy("cluster")
    return sizes.select(
        "cluster", "component", "size",
        F.row_number().over(own.orderBy(F.desc("size"), "component")).alias("rank"),
        (F.sum("size").over(own) - F.max("size").over(own)).alias("spared"),
    )


def dense_labels(labels: DataFrame) -> DataFrame:
    """Clusters numbered 0, 1, ... in their order."""
    # One row a cluster stands in the window's single partition.
    number = F.row_number().over(Window.orderBy("cluster")) - 1
    known = labels.select("cluster").distinct().select("cluster", number.alias("__new"))
    return labels.join(known, "cluster").withColumn("cluster", F.col("__new")).select(*labels.columns)


def _renamed(ids: DataFrame, column: str, rounds: list[DataFrame]) -> DataFrame:
    """``ids`` with ``column`` taken through the tables ``old, new`` of ``rounds``, one after another."""
    for i, names in enumerate(rounds, 1):
        ids = ids.join(names.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
        ids = ids.withColumn(column, F.coalesce("__new", column)).drop("__new")
        if i % JOINED == 0:
            ids = materialize(ids, "renamed")
    return ids


def _both_ways(pairs: DataFrame) -> DataFrame:
    """``a, b, n`` in both directions."""
    return pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


@dataclass
class Quotient:
    """The quotient graph as tables.

    ``cells(cell_id, component)``; ``graph(a, b, ka, kb, ca, cb, n, size, volume)`` with a row for each part, where
    ``a = b``, and one for two parts ``a < b`` that share ``n`` faces, ``ka`` and ``kb`` their clusters, ``ca`` and
    ``cb`` the least cells of either beside the other; ``sums(part, cluster, size, sums)`` has the features of a part's
    cells added up, ``width`` numbers.
    """

    cells: DataFrame
    graph: DataFrame
    sums: DataFrame | None = None
    width: int = 0


def _sums(values: str, width: int) -> Column:
    """An aggregate: arrays of ``width`` ``values`` added up place by place."""
    return F.array(*(F.sum(F.get(values, i)) for i in range(width))).alias("sums")


def _graph_of(rows: DataFrame) -> DataFrame:
    """The rows of the same two parts as one; faces within a part are no link."""
    link = F.col("a") != F.col("b")
    ends = lambda a, b: F.struct(*(F.col(f"{c}{x}").alias(f"{c}{y}") for c in ("", "k", "c") for x, y in ((a, "a"), (b, "b"))))
    ordered = rows.select(F.when(F.col("a") <= F.col("b"), ends("a", "b")).otherwise(ends("b", "a")).alias("e"), "n", "size", "volume")
    return (
        ordered.select("e.*", "n", "size", "volume").groupBy("a", "b")
        .agg(*(F.first(k).alias(k) for k in ("ka", "kb")), *(F.min(c).alias(c) for c in ("ca", "cb")), *(F.sum(v).alias(v) for v in ("n", "size", "volume")))
        .withColumns({c: F.when(link, F.col(c)) for c in ("ca", "cb", "n")})
    )


def quotient(faces: DataFrame, labels: DataFrame, volumes: DataFrame | None = None, features: DataFrame | None = None) -> Quotient:
    """The quotient graph of the components of all clusters."""
    pairs = _with_clusters(faces, labels)
    cells = _components(pairs, labels)
    cells = cells.join(volumes.select("cell_id", "volume"), "cell_id") if volumes is not None else cells.withColumn("volume", F.lit(1.0))
    cells = materialize(cells, "cell_parts")
    part = lambda end: cells.select(F.col("cell_id").alias(f"c_id{end}"), F.col("component").alias(f"p{end}"))
    between = pairs.where("k0 <> k1").join(part(0), "c_id0").join(part(1), "c_id1")
    rows = {
        "a": "p0", "b": "p1", "ka": "cast(k0 as long)", "kb": "cast(k1 as long)", "ca": "c_id0", "cb": "c_id1",
        "n": "1L", "size": "cast(null as long)", "volume": "cast(null as double)",
    }
    own = {
        "a": "component", "b": "component", "ka": "cast(cluster as long)", "kb": "cast(cluster as long)", "ca": "cell_id", "cb": "cell_id",
        "n": "0L", "size": "1L", "volume": "cast(volume as double)",
    }
    exprs = lambda columns: [f"{e} as {c}" for c, e in columns.items()]
    graph = materialize(_graph_of(between.selectExpr(*exprs(rows)).unionByName(cells.selectExpr(*exprs(own)))), "graph")
    if features is None:
        return Quotient(cells.select("cell_id", "component"), graph)
    like = cells.select("cell_id", "component", "cluster").join(features.select("cell_id", F.col("features").cast("array<double>").alias("x")), "cell_id")
    width = features.agg(F.max(F.size("features"))).first()[0] or 0
    sums = like.groupBy(F.col("component").alias("part")).agg(F.first("cluster").cast("long").alias("cluster"), F.count(F.lit(1)).alias("size"), _sums("x", width))
    return Quotient(cells.select("cell_id", "component"), graph, materialize(sums, "sums"), width)


def _most_shared(votes: Column, cluster: Column) -> Column:
    """An aggregate: the cluster with most shared faces, the least on ties."""
    return F.max_by(cluster, F.struct(votes, -cluster))


def _ready(graph: DataFrame, reach: int) -> DataFrame:
    """``cluster, main`` of clusters in parts that no lesser such cluster is beside, or within two steps if ``reach`` is 2.

    ``main`` is the largest part, that of the least cell on ties.
    """
    top = F.max(F.struct("size", (-F.col("a")).alias("least"))).alias("top")
    known = graph.groupBy(F.least("ka", "kb").alias("cluster"), F.greatest("ka", "kb").alias("other")).agg(top, F.count(F.lit(1)).alias("n"))
    known = materialize(known, "beside")  # small: two clusters a row
    pending = known.where("cluster = other and n > 1").select("cluster", (-F.col("top.least")).alias("main"))
    beside = known.where("cluster <> other").select("cluster", "other")
    if reach == 2:
        beside = beside.unionByName(beside.select(F.col("other").alias("cluster"), F.col("cluster").alias("other")))
        second = beside.join(beside.select(F.col("cluster").alias("other"), F.col("other").alias("third")), "other")
        beside = beside.unionByName(second.select("cluster", F.col("third").alias("other"))).where("cluster < other").distinct()
    blocked = beside.join(pending.select("cluster"), "cluster", "left_semi").select(F.col("other").alias("cluster"))
    return pending.join(blocked, "cluster", "left_anti")


def _leaving(graph: DataFrame, ready: DataFrame) -> DataFrame:
    """``a, b, ka, kb, cb, n, size, volume``: the rows of all parts ``a`` that leave the clusters of ``ready``, links with ``b`` the other end."""
    one = F.struct("a", "b", "ka", "kb", "cb", "n", "size", "volume")
    back = F.struct(*(F.col(x).alias(y) for x, y in (("b", "a"), ("a", "b"), ("kb", "ka"), ("ka", "kb"), ("ca", "cb"))), "n", "size", "volume")
    ways = graph.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, back))))
    return ways.join(ready.withColumnRenamed("cluster", "ka"), "ka").where("a <> main").drop("main")


def _distances(leaving: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """``leaving`` with ``far``: the squared distance of a part to the centroid of the cluster at the other end."""
    whole = sums.groupBy("cluster").agg(_sums("sums", width), F.sum("size").alias("cells"))
    centres = whole.select(F.col("cluster").alias("kb"), F.transform("sums", lambda x: x / F.col("cells")).alias("centre"))
    own = sums.select(F.col("part").alias("a"), F.transform("sums", lambda x: x / F.col("size")).alias("own"))
    far = F.aggregate(F.zip_with("centre", "own", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return leaving.join(centres, "kb", "left").join(own, "a", "left").withColumn("far", far).drop("centre", "own")


def _moves(leaving: DataFrame, small: Column, by_distance: bool) -> DataFrame:
    """``a, b, ka, size, target``: where each part goes, where ``a = b``, and the links that this puts within a cluster."""
    own = Window.partitionBy("a")
    link = F.col("a") != F.col("b")
    rows = leaving.repartition("a").withColumn("votes", F.sum("n").over(Window.partitionBy("a", "kb")))
    if by_distance:
        best = F.min(F.when(link, F.struct("far", "kb"))).over(own)["kb"]
        target = F.when(small | (F.col("size") == 1), F.col("best"))
    else:
        best = -F.max(F.when(link, F.struct("votes", (-F.col("kb")).alias("least")))).over(own)["least"]
        target = F.coalesce(F.when(F.col("size") == 1, F.col("beside")), F.when(small, F.col("best")))
    beside = F.min(F.when(link, F.struct("cb", "kb"))).over(own)["kb"]
    known = rows.select("a", "b", "ka", "kb", best.alias("best"), beside.alias("beside"), *(F.max(v).over(own).alias(v) for v in ("size", "volume")))
    return known.select("a", "b", "ka", "kb", "size", target.alias("target")).where("a = b or kb = target").drop("kb")


def _changed(rows: DataFrame, changed: DataFrame, part: str, cluster: str) -> DataFrame:
    """``rows`` with the parts and clusters of ``changed(old, cluster, new)``, where those are not null."""
    to = changed.select(F.col("old").alias(part), F.col("cluster").alias("__cluster"), F.col("new").alias("__new"))
    columns = {part: F.coalesce("__new", part), cluster: F.coalesce("__cluster", cluster)}
    return rows.join(to, part, "left").withColumns(columns).drop("__cluster", "__new")


def reassign_nodes(
    faces: DataFrame, labels: DataFrame, volumes: DataFrame | None = None, method: str = "cells",
    passes: int = 1000, most_cells: int = 1000, share: float = 1e-6, features: DataFrame | None = None,
) -> DataFrame:
    """``labels`` with every cluster connected, numbered densely. ``method`` is ``cells`` or ``volume``.

    From the first cluster on, all components but the largest leave it. A small one goes to the adjacent cluster with
    most shared faces (the least on ties), a single cell to that of its least neighbour, a large one becomes a
    cluster. With ``features(cell_id, features)`` small ones and single cells go to the adjacent cluster of nearest
    centroid. A moved component touches the cluster it goes to, so no cluster falls apart anew, and none is treated
    twice. ``passes`` bounds the rounds.
    """
    if method not in ("cells", "volume"):
        raise ValueError("method is cells or volume")
    q = quotient(faces, labels, volumes, features)
    graph, sums = q.graph, q.sums
    parts = graph.where("a = b")
    whole = parts.agg(F.sum("volume").alias("volume"), F.min("ka").alias("low"), F.max("ka").alias("high"), F.count(F.lit(1)).alias("n")).first()
    small = F.col("size") < most_cells if method == "cells" else F.col("volume") < share * whole.volume
    merged: list[DataFrame] = []
    renamed = 0
    for _ in range(passes):
        leaving = _leaving(graph, _ready(graph, 1 if sums is None else 2))
        if sums is not None:
            leaving = _distances(leaving, sums, q.width)
        rows = materialize(_moves(leaving, small, sums is not None), "moves")
        moves, joins = rows.where("a = b").select("a", "ka", "size", "target"), rows.where("a <> b")
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a = b and target is null")).alias("new"), F.count_if(F.expr("a <> b")).alias("joins")).first()
        if not seen.n:
            break
        if seen.new:
            # New clusters are numbered above all others, in the order of the clusters they leave and of their size.
            rank = F.row_number().over(Window.partitionBy("ka").orderBy(F.desc("size"), "a"))
            new = moves.where("target is null").withColumn("target", F.lit(whole.high) + (F.col("ka") - F.lit(whole.low)) * F.lit(whole.n) + rank)
            moves = moves.where("target is not null").unionByName(new)
        names = stars(joins, "a", "b", near=True, most=seen.joins).select(F.col("node").alias("old"), F.lit(None).cast("long").alias("cluster"), F.col("component").alias("new"))
        changed = moves.select(F.col("a").alias("old"), F.col("target").alias("cluster"), F.lit(None).cast(names.schema["new"].dataType).alias("new"))
        changed = changed.unionByName(names).groupBy("old").agg(F.max("cluster").alias("cluster"), F.max("new").alias("new"))
        told = Observation()
        changed = materialize(changed.observe(told, F.count("new").alias("n")), "changed")
        renamed += told.get["n"]
        merged.append(changed.where("new is not null").select("old", "new"))
        graph = materialize(_graph_of(_changed(_changed(graph, changed, "a", "ka"), changed, "b", "kb")), "graph")
        if sums is not None:
            own = _changed(sums, changed, "part", "cluster").groupBy("part")
            sums = materialize(own.agg(F.first("cluster").alias("cluster"), F.sum("size").alias("size"), _sums("sums", q.width)), "sums")
    else:
        warnings.warn("clusters are still in parts after the last pass", stacklevel=2)
    first = q.graph.where("a = b").select(F.col("a").alias("component"))
    if merged:
        # Parts are named by their least cell, so the last name is the least of all that were merged.
        names = stars(reduce(DataFrame.unionByName, merged), "old", "new", near=True, most=renamed)
        first = first.join(names.select(F.col("node").alias("component"), F.col("component").alias("part")), "component", "left")
        first = first.select("component", F.coalesce("part", "component").alias("part"))
    else:
        first = first.withColumn("part", F.col("component"))
    final = first.join(_dense_ints(graph.where("a = b").select(F.col("a").alias("part"), F.col("ka").alias("cluster"))), "part")
    return q.cells.join(materialize(final.select("component", "cluster"), "reassigned"), "component").select("cell_id", "cluster")


def _dense_ints(labels: DataFrame) -> DataFrame:
    return dense_labels(labels).withColumn("cluster", F.col("cluster").cast("int"))


def cluster_graph(faces: DataFrame, labels: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cluster, volume``, and ``a, b, n``: the faces that two clusters share, in both directions."""
    nodes = labels.join(volumes.select("cell_id", "volume"), "cell_id").groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.sum("volume").alias("volume"))
    side = lambda end: labels.select(F.col("cell_id").alias(f"c_id{end}"), F.col("cluster").cast("long").alias(f"k{end}"))
    between = undirected(faces).join(side(0), "c_id0").join(side(1), "c_id1").where("k0 <> k1")
    counts = between.groupBy(F.least("k0", "k1").alias("a"), F.greatest("k0", "k1").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(nodes, "clusters"), materialize(_both_ways(counts), "cluster_links")


def _beside(nodes: DataFrame, links: DataFrame, *more: Column) -> DataFrame:
    """``cluster, volume, best`` of the clusters with a neighbour, and what ``more`` gathers of the neighbours ``b, volume_b``."""
    other = nodes.select(F.col("cluster").alias("b"), F.col("volume").alias("volume_b"))
    own = links.join(other, "b").groupBy(F.col("a").alias("cluster")).agg(_most_shared(F.col("n"), F.col("b")).alias("best"), *more)
    return nodes.join(own, "cluster")


def _contracted(nodes: DataFrame, links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the clusters ``old`` of ``names`` have become ``new``."""
    nodes = _renamed(nodes, "cluster", [names]).groupBy("cluster").agg(F.sum("volume").alias("volume"))
    links = _renamed(_renamed(links, "a", [names]), "b", [names]).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return materialize(nodes, "clusters"), materialize(links, "cluster_links")


def _relabelled(labels: DataFrame, nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    final = _renamed(nodes.select(F.col("cluster").alias("__old"), "cluster"), "cluster", rounds)
    final = materialize(_dense_ints(final), "relabelled").withColumnRenamed("cluster", "__to")
    own = labels.select("cell_id", F.col("cluster").cast("long").alias("__old")).join(final, "__old")
    return own.select("cell_id", F.col("__to").alias("cluster"))


def match_clusters(faces: DataFrame, labels: DataFrame, volumes: DataFrame, wanted: int) -> DataFrame:
    """``labels`` merged to ``wanted`` clusters; fewer stay as they are, with a warning.

    The cluster of least volume merges into the neighbour with most shared faces, again and again. A cluster less
    than all its neighbours will be merged as it stands, whatever happens elsewhere, so each round takes all of
    those; merges happen in the order of their volumes, and the first ones count.
    """
    first, links = cluster_graph(faces, labels, volumes)
    nodes, have = first, first.count()
    if have < wanted:
        warnings.warn(f"there are fewer than {wanted} clusters", stacklevel=2)
    if have <= wanted:
        return _dense_ints(labels)
    turn = F.struct("volume", "old")
    rounds: list[DataFrame] = []
    known = None  # all merges found so far
    while True:
        least = F.min(F.struct(F.col("volume_b").alias("volume"), F.col("b").alias("cluster"))).alias("least")
        beside = materialize(_beside(nodes, links, least), "beside")
        ahead = beside.agg(F.min(F.struct("volume", F.col("cluster").alias("old"))).alias("at")).first().at
        if ahead is None:
            break
        if known is not None and known.where(turn < F.struct(F.lit(ahead.volume).alias("volume"), F.lit(ahead.old).alias("old"))).count() >= have - wanted:
            break  # what is left would come later than enough of these
        rounds.append(
            materialize(
                beside.where(F.struct("volume", "cluster") < F.col("least")).select(F.col("cluster").alias("old"), F.col("best").alias("new"), "volume"), "merges"
            )
        )
        known = rounds[-1] if known is None else known.unionByName(rounds[-1])
        nodes, links = _contracted(nodes, links, rounds[-1])
    if known is None or known.count() < have - wanted:
        raise ValueError("no two clusters touch")
    # One row a cluster stands in the window's single partition.
    last = known.withColumn("nth", F.row_number().over(Window.orderBy("volume", "old"))).where(F.col("nth") == have - wanted).select("volume", "old").first()
    in_time = turn <= F.struct(F.lit(last.volume).alias("volume"), F.lit(last.old).alias("old"))
    return _relabelled(labels, first, [r.where(in_time) for r in rounds])


def remove_small_clusters(faces: DataFrame, labels: DataFrame, volumes: DataFrame, least: float) -> DataFrame:
    """While a cluster has less volume than ``least``, merge the first such into the neighbour with most shared faces.

    In a round all small clusters merge that have no small neighbour before them; one without a neighbour stays.
    """
    first, links = cluster_graph(faces, labels, volumes)
    nodes, rounds = first, []
    while True:
        before = F.max((F.col("b") < F.col("a")) & (F.col("volume_b") < least)).alias("waits")
        small = _beside(nodes, links, before).where((F.col("volume") < least) & ~F.col("waits"))
        names = materialize(small.select(F.col("cluster").alias("old"), F.col("best").alias("new")), "merges")
        if not names.limit(1).count():
            return _relabelled(labels, first, rounds)
        rounds.append(names)
        nodes, links = _contracted(nodes, links, names)
