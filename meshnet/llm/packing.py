"""Packing of documents into fixed-length sequences, shortest pack first over the length histogram.

Texts become ids once; what stays is a small table of pieces. A document longer
than the sequence is cut into full pieces and a rest. The histogram of piece
lengths, at most one count a length, is packed on the driver: lengths are placed
longest first, each into the pattern with the most room, and equal patterns move
together as one count. Pieces are then ranked within their length, and a rank
tells pattern, sequence and offset.

A rank is the number of equal lengths in earlier partitions plus that within
its own, so a length that a third of all pieces share meets in no one task.

Cases: a null or empty text is one piece, the end id alone. Rows repeated, or
with a null id, are packed like any other. An empty table gives an empty result.
Other columns, whatever their names, are not read. A very long text is cut.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshnet.llm import pair_bpe
from meshnet.plans.scratch import bound_arrow_batches, materialize
from meshnet.plans.tables import read_table

SEQUENCE = 4096
END_ID = 2
#: Characters that are encoded at a time.
SLICE = 1 << 20


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """``(count, lengths)`` of the patterns that hold ``histogram[length]`` pieces of each length.

    Each piece, longest first, goes into the pack with the most room; a new pack
    is opened only if none has room. All packs of one pattern are one count.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    heap: list[int] = []

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if not room[space]:
            heapq.heappush(heap, -space)
        room[space].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0] >= length:
                space = -heap[0]
                count, lengths = room[space].pop()
                if not room[space]:
                    heapq.heappop(heap)
                used = min(count, left)
                if count > used:
                    put(space, count - used, lengths)
                put(space - length, used, (*lengths, length))
                left -= used
            else:  # a new pack takes pieces of this length until it has no room for another
                fit = size // length
                full, rest = divmod(left, fit)
                if full:
                    put(size - fit * length, full, (length,) * fit)
                if rest:
                    put(size - rest * length, 1, (length,) * rest)
                left = 0
    return [pack for space in sorted(room) for pack in room[space]]


class Slots:
    """Where the piece of each length and rank goes."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        rows, taken, base = [], defaultdict(int), 0
        for count, lengths in patterns:
            offset = 0
            for length, same in groupby(lengths):
                times = sum(1 for _ in same)
                rows.append((length, taken[length], base, times, offset))
                taken[length] += count * times
                offset += times * length
            base += count
        rows.sort()
        self.sequences = base
        self.length, self.lo, self.base, self.times, self.offset = (
            np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([],) * 5)
        )

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        wide = np.int64(1) << 48
        at = np.searchsorted(self.length * wide + self.lo, length * wide + rank, "right") - 1
        turn, place = np.divmod(rank - self.lo[at], self.times[at])
        return self.base[at] + turn, self.offset[at] + place * length


_ENCODERS: dict[str, pair_bpe.TextEncoder] = {}


def encoder(path: str) -> pair_bpe.TextEncoder:
    """The encoder of this process for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = pair_bpe.TextEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    """mapInArrow function: ``doc_id, text`` to pieces, numbered by length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = TaskContext.get().partitionId(), encoder(path)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in pair_bpe.slices(texts, SLICE):
                ids, counts = own.encode(texts[lo:hi])
                stop = np.cumsum(counts)
                ids = np.insert(ids, stop, end_id)
                counts = counts + 1
                begin = np.cumsum(counts) - counts
                number = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), number)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * size
                length = np.minimum(counts[doc] - start, size)
                rank = np.empty(len(doc), np.int64)
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                first = np.searchsorted(sizes, sizes)
                rank[order] = np.arange(len(doc)) - first + seen[sizes]
                seen += np.bincount(length, minlength=size + 1)
                raw, at = ids.astype("<u4").tobytes(), begin[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0)[lo:hi].take(pa.array(doc)),
                    *(pa.array(c, pa.int64()) for c in (start, length, np.array(crc, np.int64), counts[doc], rank)),
                    pa.array(np.full(len(doc), task), pa.int32()),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task"]
                if with_ids:  # pieces follow one another without gaps
                    edge = np.concatenate([at, [len(ids)]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it begins in its document and where it lies in its sequence.

    Columns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, if asked for, ``ids``.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark, 32 << 20)
    extra = ", ids array<int>" if with_ids else ""
    pieces = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _pieces(path, size, end_id, with_ids),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long, task int" + extra,
        ),
        "pieces",
    )
    counts = materialize(pieces.groupBy("task", "length").count(), "piece_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = Slots(shortest_pack_first(histogram, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(
        "task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    # The counts grow with the number of tasks, so they are merged, never broadcast.
    ranked = pieces.join(earlier.hint("merge"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tail = ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = slots.place(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in out), pa.array(sequence), pa.array(offset), *(batch.column(c) for c in tail)],
                [*out, "sequence_id", "offset", *tail],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + extra
    return ranked.select(*out, "rank", *tail).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


SQL = None
