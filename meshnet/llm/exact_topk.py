"""Exact top-k inner products, block at a time.

Vectors become whole numbers. Each task orders its own vectors by the signs of
a few random projections, so that similar ones are near, and cuts the order into
ranges: blocks. A block holds its vectors (the forward index) and the largest
and smallest value of each component (the term maxima; values have signs). For a
query, the sum of the larger of ``q * max`` and ``q * min`` over the components
bounds every score in a block. Blocks are taken in descending order of bound and
scored through the forward index until the bound falls below the k-th score.
Bounds are raised by what rounding may have taken from them.

A query is a row, so the task that makes its block scores it against that block
first: the k-th score there is a floor that goes with the query everywhere. No
block below it is scored, and no row below it is returned.

Queries and blocks meet in groups of bounded size, a segment of blocks by a
block of queries, so neither side need fit in one task. Each group returns at
most k rows a query. The result is exact whatever the bounds are; with dense
vectors of many components they are loose and prune little, but groups of
copies are pruned. Work grows with queries times blocks. A task sorts vectors of
up to ``SORTED`` components together at a time.

Cases: a vector that is null, or holds a null, NaN or infinity, takes no part,
nor does one with a component that is no finite double when scaled, nor a null id. A shorter vector counts as if followed by zeros. Rows with
the query's id are its own; other repeated rows are candidates as often as they
occur. Of several vectors under one query id the least is the query. Scores that
need more than 53 bits are computed in whole numbers of any length and held to
the range of a long. An empty table gives an empty result. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshnet.plans.scratch import bound_arrow_batches, materialize
from meshnet.plans.tables import read_table

K = 10
SCALE = 1024
BLOCK, SEGMENT, QUERIES, SORTED = 256, 64, 2048, 1 << 22
PROJECTIONS = 16
_BLOCK_SCHEMA = (
    "block long, dim int, ids binary, forward binary, most binary, least binary, "
    "queries array<struct<id: long, vector: array<double>, floor: long>>"
)
_NONE = np.iinfo(np.int64).min


def _usable(vectors: list, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array(
            [v is not None and all(x is not None for x in v) and bool(np.isfinite(scale * np.array(v, np.float64)).all()) for v in vectors], bool
        )


def _matrix(vectors: list, scale: float) -> np.ndarray:
    """Rows ``floor(scale * x)``, padded with zeros to one length."""
    dim = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.floor(scale * np.asarray(v, np.float64))
    return out


def _floors(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the other rows of a block, the least number if there are fewer."""
    score = _scores(queries, table)
    score[query_ids[:, None] == ids[None, :]] = _NONE
    return np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(query_ids), _NONE)


def _blocks(scale: float, size: int, k: int):
    """mapInArrow function: ``id, vector, is_query`` to blocks of ranges of the task's own order."""
    kinds = pa.schema(
        [
            ("block", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "forward", "most", "least")),
            ("queries", pa.list_(pa.struct([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("floor", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        asked: list[bool] = []

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            own, table, query = np.array(ids, np.int64), _matrix(vectors, scale), np.array(asked, bool)
            planes = np.random.default_rng(11).standard_normal((table.shape[1], PROJECTIONS))
            code = (table @ planes > 0) @ (1 << np.arange(PROJECTIONS)[::-1])
            order = np.lexsort((own, code))
            for lo in range(0, len(own), size):
                at = order[lo : lo + size]
                part, mine = table[at], at[query[at]]
                floors = _floors(own[mine], table[mine], own[at], part, k)
                row = {
                    "block": (task << 32) + made, "dim": table.shape[1], "ids": own[at].tobytes(), "forward": part.tobytes(),
                    "most": part.max(axis=0).tobytes(), "least": part.min(axis=0).tobytes(),
                    "queries": [
                        {"id": int(own[i]), "vector": vectors[i].tolist(), "floor": int(f)} for i, f in zip(mine, floors, strict=True)
                    ],
                }
                made += 1
                yield pa.RecordBatch.from_pylist([row], kinds)
            ids.clear()
            vectors.clear()
            asked.clear()
            held = 0

        for batch in batches:
            values = batch.column(1).to_pylist()
            good = _usable(values, scale)
            for i, v, q, ok in zip(batch.column(0).to_pylist(), values, batch.column(2).to_pylist(), good.tolist(), strict=True):
                if ok:
                    ids.append(i)
                    vectors.append(np.array(v, np.float64))
                    asked.append(bool(q))
                    held += len(v)
            if held >= SORTED:
                yield from cut()
        if ids:
            yield from cut()

    return run


def _scores(queries: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Inner products; exact, and held to the range of a long."""
    bound = np.abs(queries).max(initial=0) * np.abs(forward).max(initial=0) * queries.shape[1]
    if bound < 2.0**53:
        return (queries @ forward.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in forward]
    top, low = (1 << 63) - 1, -(1 << 63) + 1
    return np.array(
        [[max(low, min(top, sum(a * b for a, b in zip(q, d, strict=True)))) for d in whole[1]] for q in whole[0]], np.int64
    ).reshape(len(queries), len(forward))


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """No score of a block is above these, rounding or not."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
        # The error of a sum follows its terms, which may cancel, not its value.
        terms = np.abs(queries) @ np.maximum(np.abs(most), np.abs(least)).T
        bound = bound + terms * (4 * (queries.shape[1] + 2) * np.finfo(float).eps)
        return np.where(np.isfinite(bound), bound, np.inf)  # never prune by NaN


def search(
    query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple], k: int, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best scores and ids of each query over ``blocks``, and the number of query-block pairs scored.

    Scores below a query's floor may be missing.
    """
    n = len(query_ids)
    floors = np.full(n, _NONE) if floors is None else floors
    best, who = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
    bound = _bounds(queries, *(np.stack([b[i] for b in blocks]) for i in (2, 3)))
    order, scored = np.argsort(-bound, axis=1, kind="stable"), 0
    for step in range(len(blocks)):
        pick = order[:, step]
        need = np.maximum(best[:, -1], floors)
        # A score may be rounded up as a floating number; the one before is not above it.
        active = bound[np.arange(n), pick] >= np.nextafter(need.astype(float), -np.inf)
        if not active.any():
            break
        for b in np.unique(pick[active]):
            rows = np.flatnonzero(active & (pick == b))
            ids, forward = blocks[b][0], blocks[b][1]
            scored += len(rows)
            score = _scores(queries[rows], forward)
            own = query_ids[rows][:, None] == ids[None, :]
            score[own] = _NONE
            hit = score.max(axis=1) >= need[rows]
            rows, score = rows[hit], score[hit]
            score = np.concatenate([best[rows], score], axis=1)
            name = np.concatenate([who[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
            name = np.where(score == _NONE, np.iinfo(np.int64).max, name)
            top = np.lexsort((name, ~score), axis=1)[:, :k]  # ~ descends and can't overflow
            best[rows], who[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
    return best, who, scored


def _group(k: int, scale: float):
    """Cogroup function: a segment of blocks and a block of queries to their best rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": [], "vec_id": [], "score": []}
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, kinds)
        blocks, vectors = left.to_pylist(), right.column("vector").to_pylist()
        query_ids = right.column("id").to_numpy()
        dim = max([*(b["dim"] for b in blocks), *map(len, vectors)])
        wide = lambda raw, have: np.pad(np.frombuffer(raw).reshape(-1, have), ((0, 0), (0, dim - have)))
        index = [
            (np.frombuffer(b["ids"], np.int64), wide(b["forward"], b["dim"]), wide(b["most"], b["dim"])[0], wide(b["least"], b["dim"])[0])
            for b in sorted(blocks, key=lambda b: b["block"])
        ]
        table = _matrix(vectors, scale)
        table = np.pad(table, ((0, 0), (0, dim - table.shape[1])))
        floors = right.column("floor").to_numpy()
        best, who, _ = search(query_ids, table, index, k, floors)
        real = (best != _NONE) & (best >= floors[:, None])
        return pa.table(
            {"query_id": np.repeat(query_ids, k)[real.ravel()], "vec_id": who[real], "score": best[real]}, kinds
        )

    return run


def top_k(
    df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row that ``is_query`` picks."""
    spark = df.sparkSession
    bound_arrow_batches(spark)
    vector = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    # dim 0 has no bytes to cut: such vectors get one zero.
    padded = F.when(F.size(vector) == 0, F.array(F.lit(0.0))).otherwise(vector)
    own = rows.select(F.col(id_col).cast("long").alias("id"), padded.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    blocks = materialize(own.mapInArrow(_blocks(scale, BLOCK, k), _BLOCK_SCHEMA), "blocks")
    queries = (
        blocks.select(F.explode("queries").alias("q"))
        .groupBy("q.id")
        .agg(F.min(F.struct("q.vector", "q.floor")).alias("q"))
        .select("id", "q.vector", "q.floor")
    )
    queries = materialize(queries, "queries")
    blocks = blocks.drop("queries")
    n_blocks, n_queries = blocks.count(), queries.count()
    n_segments, n_parts = max(1, -(-n_blocks // SEGMENT)), max(1, -(-n_queries // QUERIES))
    # Neighbouring blocks of one task stay together; a hash deals the rest out evenly.
    segment = F.pmod(F.xxhash64(F.floor(F.col("block") / 8)), F.lit(n_segments))
    all_parts, all_segments = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (n_parts, n_segments))
    left = blocks.select("*", segment.cast("int").alias("segment"), F.explode(all_parts).alias("part"))
    right = queries.select(
        "*", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), F.explode(all_segments).alias("segment")
    )
    found = (
        left.groupBy("segment", "part")
        .cogroup(right.groupBy("segment", "part"))
        .applyInArrow(_group(k, scale), "query_id long, vec_id long, score long")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose id is divisible by 100, against all rows."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
