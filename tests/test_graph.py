import random
from collections import Counter, defaultdict
from itertools import pairwise

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshnet.operators import components, graph
from meshnet.operators.components import connected_components
from meshnet.plans.scratch import materialize


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def lattice(n):
    edges = []
    for c in range(n * n):
        if (c + 1) % n:
            edges.append((c, c + 1))
        if c + n < n * n:
            edges.append((c, c + n))
    return edges


def frames(spark, edges, labels, volume=None):
    faces = spark.createDataFrame([(a, b) for a, b in edges], "c_id0 long, c_id1 long")
    own = spark.createDataFrame(sorted(labels.items()), "cell_id long, cluster int")
    volumes = spark.createDataFrame([(c, float((volume or {}).get(c, 1.0))) for c in labels], "cell_id long, volume double")
    return faces, own, volumes


def parts_of(edges, labels):
    return plain_components(labels, [(a, b) for a, b in edges if labels[a] == labels[b]])


def slow_reassign(edges, labels, most_cells, passes=10_000):
    """Cell by cell, as the rules say."""
    labels, near = dict(labels), defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for _ in range(passes):
        parts = parts_of(edges, labels)
        by = defaultdict(lambda: defaultdict(list))
        for c, p in parts.items():
            by[labels[c]][p].append(c)
        k = next((k for k in sorted(by) if len(by[k]) > 1), None)
        if k is None:
            break
        moving = sorted(by[k].values(), key=lambda cells: (-len(cells), min(cells)))[1]
        votes = Counter(labels[b] for c in moving for b in near[c] if labels[b] != k)
        target = min(votes, key=lambda v: (-votes[v], v)) if votes else None
        if len(moving) == 1 and near[moving[0]]:
            target = labels[min(near[moving[0]])]
        elif len(moving) >= most_cells:
            target = None
        new = max(labels.values()) + 1 if target is None else target
        for c in moving:
            labels[c] = new
    order = {k: i for i, k in enumerate(sorted(set(labels.values())))}
    return {c: order[k] for c, k in labels.items()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 400)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = {n for e in edges for n in e}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == plain_components(nodes, edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    loops = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 4), (5, 4), (1, 1)], "src long, dst long")
    assert sorted(tuple(r) for r in connected_components(loops).collect()) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    """Paths of 4096 nodes: numbers in order, at random, and small ones at both ends."""
    n, rounds = 4096, []
    monkeypatch.setattr(components, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    mixed = random.Random(4).sample(range(n), n)
    ends = [2 * i if i < n // 2 else 2 * (n - 1 - i) + 1 for i in range(n)]
    for order in (range(n), mixed, ends):
        rounds.clear()
        got = connected_components(spark.createDataFrame(list(pairwise(order)), "src long, dst long"))
        assert got.count() == n and got.where("component <> 0").count() == 0
        assert len(rounds) <= 2 * 16  # two tables a round


def test_the_last_weight_of_an_edge(spark):
    rows = [(1, 2, 0.5, 0), (2, 1, -0.25, 3), (1, 2, 9.0, 1), (3, 3, 1.0, 4), (2, 3, None, 6), (2, 3, 1.0, 5), (4, -1, 1.0, 7)]
    faces = spark.createDataFrame(rows, "c_id0 long, c_id1 long, mass_flowrate double, at int").repartition(3)
    assert {(r.c_id0, r.c_id1): r.weight for r in graph.edge_weights(faces, "at").collect()} == {(1, 2): -0.25, (2, 3): None}


def test_cluster_components_and_study(spark):
    rng = random.Random(2)
    edges = lattice(8)
    labels = {c: rng.randrange(4) for c in range(64)}
    faces, own, _ = frames(spark, edges + [(5, 5), (1, 0)], labels)
    want = parts_of(edges, labels)
    assert {r.cell_id: r.component for r in graph.cluster_components(faces, own).collect()} == want
    sizes = Counter((labels[c], p) for c, p in want.items())
    study = graph.connectivity_study(faces, own).collect()
    assert {(r.cluster, r.component): r.size for r in study} == dict(sizes)
    for r in study:
        mine = [n for (k, _), n in sizes.items() if k == r.cluster]
        assert r.spared == sum(mine) - max(mine)
    assert not graph.clusters_connected(faces, own) and graph.is_connected(faces)
    assert graph.clusters_connected(faces, own.withColumn("cluster", F.lit(0)))


@pytest.mark.parametrize("seed,most_cells", [(0, 1000), (1, 3)])
def test_reassign_as_cell_by_cell(spark, seed, most_cells):
    rng = random.Random(seed)
    edges = lattice(5)
    labels = {c: rng.randrange(4) for c in range(25)}
    faces, own, volumes = frames(spark, edges, labels)
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes, most_cells=most_cells).collect()}
    assert got == slow_reassign(edges, labels, most_cells)
    parts = parts_of(edges, got)
    assert all(len({parts[c] for c in got if got[c] == k}) == 1 for k in got.values())
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))


def test_ring(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(20, 4)]  # node 3 reaches the ring through 4 alone
    labels = {n: (n * 7) % 5 for n in range(1, 21)}
    faces, own, volumes = frames(spark, edges, labels)
    out = graph.reassign_nodes(faces, own, volumes)
    assert graph.clusters_connected(faces, out) and out.count() == 20


def test_match_and_small(spark):
    edges = lattice(6)
    labels = {c: (c // 12) * 3 + (c % 6) // 2 for c in range(36)}  # nine blocks of four cells
    volume = {c: 1.0 + (labels[c] == 8) * -0.9 for c in labels}
    faces, own, volumes = frames(spark, edges, labels, volume)
    for k in (5, 1):
        out = graph.match_clusters(faces, own, volumes, k)
        got = {r.cell_id: r.cluster for r in out.collect()}
        assert len(set(got.values())) == k and graph.clusters_connected(faces, out)
    assert {r.cell_id: r.cluster for r in graph.match_clusters(faces, own, volumes, 9).collect()} == labels
    first = {r.cell_id: r.cluster for r in graph.match_clusters(faces, own, volumes, 8).collect()}
    assert len({first[c] for c in labels if labels[c] in (5, 8)}) == 1  # the smallest joined the first of its neighbours
    with pytest.warns(UserWarning):
        assert graph.match_clusters(faces, own, volumes, 12).select("cluster").distinct().count() == 9
    left = graph.remove_small_clusters(faces, own, volumes, 1.0)
    assert left.select("cluster").distinct().count() == 8


def test_volume_method_and_limits(spark):
    edges, labels = lattice(4), {c: c % 2 for c in range(16)}
    faces, own, volumes = frames(spark, edges, labels)
    out = graph.reassign_nodes(faces, own, volumes, method="volume", share=0.5)
    assert graph.clusters_connected(faces, out)
    with pytest.raises(ValueError):
        graph.reassign_nodes(faces, own, volumes, method="other")
    with pytest.warns(UserWarning):
        graph.reassign_nodes(faces, own, volumes, passes=0)


def slow_merge(edges, labels, volume, wanted=None, least=None):
    """One merge after another: the least cluster until ``wanted`` are left, or the first one under ``least``."""
    labels, stuck = dict(labels), set()
    while True:
        size = defaultdict(float)
        for c, k in labels.items():
            size[k] += volume[c]
        if wanted is not None:
            order = sorted(size, key=lambda k: (size[k], k)) if len(size) > wanted else []
        else:
            order = [k for k in sorted(size) if size[k] < least]
        for k in order:
            votes = Counter(labels[b if labels[a] == k else a] for a, b in edges if (labels[a] == k) != (labels[b] == k))
            if votes:
                break
        else:
            number = {k: i for i, k in enumerate(sorted(size))}
            return {c: number[k] for c, k in labels.items()}
        target = min(votes, key=lambda v: (-votes[v], v))
        labels = {c: target if own == k else own for c, own in labels.items()}


def blocks(rng, n, k):
    """A lattice of n by n cells in connected clusters grown from k cells."""
    edges = lattice(n)
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    labels = {c: i for i, c in enumerate(rng.sample(range(n * n), k))}
    edge = list(labels)
    while len(labels) < n * n:
        c = rng.choice(edge)
        free = [b for b in near[c] if b not in labels]
        if not free:
            edge.remove(c)
            continue
        b = rng.choice(free)
        labels[b] = labels[c]
        edge.append(b)
    return edges, labels


def test_merging_as_one_by_one(spark):
    rng = random.Random(1)
    edges, labels = blocks(rng, 9, 24)
    lone = {200: 24, 201: 25}  # clusters without a neighbour
    labels |= lone
    volume = {c: rng.choice([0.5, 1.0, 2.0]) for c in labels}
    faces, own, volumes = frames(spark, edges, labels, volume)
    for wanted in (21, 6):
        got = {r.cell_id: r.cluster for r in graph.match_clusters(faces, own, volumes, wanted).collect()}
        assert got == slow_merge(edges, labels, volume, wanted=wanted)
    with pytest.raises(ValueError):
        graph.match_clusters(faces, own, volumes, 2)
    got = {r.cell_id: r.cluster for r in graph.remove_small_clusters(faces, own, volumes, 6.0).collect()}
    assert got == slow_merge(edges, labels, volume, least=6.0)


@pytest.mark.parametrize("seed,most_cells", [(6, 3)])
def test_many_clusters_reassigned_as_cell_by_cell(spark, seed, most_cells):
    """Noise over blocks, so clusters far apart have parts to move at once."""
    rng = random.Random(seed)
    edges, labels = blocks(rng, 9, 12)
    for c in rng.sample(sorted(labels), 20):
        labels[c] = rng.choice([labels[b] for a, b in edges if a == c] + [rng.randrange(12)])
    faces, own, volumes = frames(spark, edges, labels)
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes, most_cells=most_cells).collect()}
    assert got == slow_reassign(edges, labels, most_cells)


def test_by_distance_as_one_by_one(spark):
    rng = random.Random(7)
    edges, labels = blocks(rng, 7, 6)
    for c in rng.sample(sorted(labels), 10):
        labels[c] = rng.randrange(6)
    like = {c: [rng.random(), 3.0 * labels[c] + rng.random()] for c in labels}
    faces, own, volumes = frames(spark, edges, labels)
    df = spark.createDataFrame(sorted(like.items()), "cell_id long, features array<double>")
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes, features=df).collect()}
    now, near = dict(labels), defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    mean = lambda cells: [sum(like[c][i] for c in cells) / len(cells) for i in range(2)]
    while True:
        by = defaultdict(lambda: defaultdict(list))
        for c, p in parts_of(edges, now).items():
            by[now[c]][p].append(c)
        k = next((k for k in sorted(by) if len(by[k]) > 1), None)
        if k is None:
            break
        moving = sorted(by[k].values(), key=lambda cells: (-len(cells), min(cells)))[1]
        own_mean = mean(moving)
        far = {}
        for t in {now[b] for c in moving for b in near[c]} - {k}:
            far[t] = sum((x - y) ** 2 for x, y in zip(own_mean, mean([c for c in now if now[c] == t]), strict=True))
        target = min(far, key=lambda t: (far[t], t))
        now |= dict.fromkeys(moving, target)
    number = {k: i for i, k in enumerate(sorted(set(now.values())))}
    assert got == {c: number[k] for c, k in now.items()}


def test_parts_move_to_the_nearest_centroid(spark):
    """A row of cells 0 0 1 0 2 2: the lone 0 touches 1 and 2 and is like 2."""
    labels = dict(enumerate([0, 0, 1, 0, 2, 2]))
    faces, own, volumes = frames(spark, [(i, i + 1) for i in range(5)], labels)
    like = spark.createDataFrame([(c, [x, 0.0]) for c, x in enumerate([0.0, 0.0, 5.0, 9.0, 10.0, 10.0])], "cell_id long, features array<double>")
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes, features=like).collect()}
    assert got == dict(enumerate([0, 0, 1, 2, 2, 2]))
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes).collect()}
    assert got == dict(enumerate([0, 0, 1, 1, 2, 2]))


def test_near_links_take_no_rounds(spark, monkeypatch):
    """A cluster as long as its cells are many: nearby links are joined within tasks, which leaves no star to form."""
    tests = []
    ends = components._is_forest_of_stars
    monkeypatch.setattr(components, "_is_forest_of_stars", lambda links: tests.append(1) or ends(links))
    n = 3000
    faces, own, _ = frames(spark, [(i, i + 1) for i in range(n - 1)], {c: int(c == 1000) for c in range(n)})
    got = {r.cell_id: r.component for r in graph.cluster_components(faces, own).collect()}
    assert got == {c: 0 if c < 1000 else 1000 if c == 1000 else 1001 for c in range(n)}
    assert len(tests) == 1


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_near_and_far_links_have_the_same_components(spark, kind, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "src long, dst long").selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst")
    near = components.connected_components(edges, near=True)
    assert near.schema["component"].dataType == edges.schema["src"].dataType
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, components.connected_components(edges).collect()))
    monkeypatch.setattr(components, "AT_ONCE", 10)  # stars of a few links at a time are stars of the same graph
    rows = [(b, a) for a, b in ((i, i + 1) for i in range(35))]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + 4]]) for i in range(2)], names=["hi", "lo"]) for k in range(0, 35, 4)]
    parts = [b.to_pylist() for b in components._join_some(iter(batches))]
    assert len(parts) == 3 and sum(map(len, parts)) == 35


def test_new_labels_are_one_join_of_the_cells(spark):
    """However many rounds moved and merged parts, who reads the labels joins cells with a finished table, once a step."""
    n = 9
    faces, own, volumes = frames(spark, [(i, i + 1) for i in range(n - 1)], {c: c % 3 for c in range(n)})
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    moved = graph.reassign_nodes(faces, own, volumes)
    assert joins(moved) == 1
    merged = graph.match_clusters(faces, moved, volumes, 2)
    assert joins(merged) == 2
    got = {r.cell_id: r.cluster for r in merged.collect()}
    assert len(got) == n and set(got.values()) == {0, 1} and graph.clusters_connected(faces, merged)


def test_a_round_writes_four_tables_and_forms_no_stars(spark, monkeypatch):
    """The few links that a round puts within clusters are joined by one task, whatever the number of rounds."""
    written, tests = [], []
    for module in (graph, components):
        monkeypatch.setattr(module, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    ends = components._is_forest_of_stars
    monkeypatch.setattr(components, "_is_forest_of_stars", lambda links: tests.append(1) or ends(links))
    edges, labels = [(i, i + 1) for i in range(11)], {c: c % 4 for c in range(12)}
    faces, own, volumes = frames(spark, edges, labels)
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes).collect()}
    assert got == slow_reassign(edges, labels, 1000)
    rounds = written.count("moves") - 1  # the last one finds nothing to move
    assert rounds > 1 and len(tests) == 1  # the components of the cells
    assert len(written) <= 4 * rounds + 8


def test_many_links_are_joined_in_rounds(spark, monkeypatch):
    """More links than a task takes; cells without a neighbour become clusters."""
    monkeypatch.setattr(components, "AT_ONCE", 0)
    rng = random.Random(3)
    edges, labels = lattice(4), {c: rng.randrange(3) for c in range(16)} | {40: 0, 41: 1, 42: 1}
    faces, own, volumes = frames(spark, edges, labels)
    got = {r.cell_id: r.cluster for r in graph.reassign_nodes(faces, own, volumes).collect()}
    assert got == slow_reassign(edges, labels, 1000)
