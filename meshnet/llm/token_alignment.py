"""Alignment of two tokenizers' ids over whole texts, by counts of packed id pairs.

Space and text are encoded by a byte-level vocabulary (A), the text by a
sentencepiece one (B), which adds the space itself. Byte offsets at which
tokens of both end cut them into groups; the last tokens of a group are a link.
A link's id pair is one int64, ``a << 32 | b``.

Links are written once with their documents. Each partition counts its own with
``np.unique``, so a pair leaves a task as one row however often it occurs; the
partial counts are sorted globally by ranges, and runs of one key are summed.
The sorted counts are written as shards of fixed-width records. Spark hands the
shards to the executors as files, tasks map them into memory, and every batch
looks its links up by ``searchsorted``. Pairs are at most |A| * |B|, and text
of any size has few of them, so shards don't follow the input. What is
broadcast is one count for each id of B.

Cases: a null or empty text has no tokens, nor has one whose tokens of A or B
don't spell space and text (U+2581 in a text, say): zeros, no groups, and no
part in any count. Strings of special tokens are plain text. Rows repeated, or
with a null id, are documents of their own; equal counts tie, and all ties are
best. Texts of any length are encoded whole, in slices of rows. An empty table
gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm import pair_bpe
from meshnet.plans.scratch import bound_arrow_batches, materialize, new_path
from meshnet.plans.tables import read_table

#: Characters that are encoded at a time.
SLICE = 1 << 20
#: Distinct pairs that a task holds before it hands on what it has counted.
HELD = 1 << 21
#: One record of a shard: key and count in hexadecimal, and the end of the line.
RECORD = np.dtype([("key", "S16"), ("count", "S16"), ("end", "S1")])
_LOW = np.int64(0xFFFFFFFF)


class ByteEncoder(pair_bpe.TextEncoder):
    """Byte-level ids of texts in which nothing is special, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(map(self._byte_of.__getitem__, token))
        self.bytes, self.starts = _joined(pieces)

    def words(self, text: str) -> list:
        return self._words(text)


class PieceEncoder:
    """Ids of a sentencepiece model, encoded once for each distinct chunk of a text, and the bytes of each id.

    A chunk is a line feed, or a run of other characters with the spaces before
    it. Pieces never reach from one chunk into the next, which is checked, so
    chunks can be encoded apart.
    """

    _CHUNK = re.compile("\n| +[^ \n]*|[^ \n]+")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        lead = self.model.encode("\n")
        if any("\n" in p or re.search("[^▁]▁", p) for p in plain) or len(lead) != 2:
            raise ValueError("pieces of this model reach over spaces or line feeds")
        pieces = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self.bytes, self.starts = _joined(pieces)
        self.size = len(pieces)
        self._cache = pair_bpe.WordCache(self._encode, 200_000)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The model puts a space before what it is given, so a line feed goes first and both are cut off.
        found = self.model.encode(["\n" + c for c in chunks], num_threads=1)
        lens = np.fromiter((len(f) - 2 for f in found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f[2:]), np.uint32, int(lens.sum()))
        return flat, np.concatenate([[0], np.cumsum(lens)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each; each text brings its own space."""
        return self._cache(map(self._CHUNK.findall, texts))


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not all(pieces):
        raise ValueError("a token of the vocabulary has no bytes")
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _spelled(own: ByteEncoder | PieceEncoder, ids: np.ndarray, counts: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Which texts the tokens spell, byte for byte."""
    data, lens = pair_bpe.gather(own.bytes, own.starts, ids.astype(np.int64))
    upto = _edges(lens)[_edges(counts)]
    whole = b"".join(want)
    if len(data) == len(whole) and (upto == _edges([len(w) for w in want])).all() and data.tobytes() == whole:
        return np.ones(len(want), bool)
    raw = data.tobytes()
    return np.array([raw[lo:hi] == w for lo, hi, w in zip(upto[:-1].tolist(), upto[1:].tolist(), want, strict=True)], bool)


class Aligned:
    """Tokens of the texts of a slice, row after row, and the groups they fall into."""

    def __init__(self, texts: list[str | None], a: ByteEncoder, b: PieceEncoder):
        full = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in full]
        want = [s.encode() for s in spaced]
        ids_a, counts_a = a.encode(spaced)
        ids_b, counts_b = b.encode(spaced)
        good = _spelled(a, ids_a, counts_a, want) & _spelled(b, ids_b, counts_b, want)
        self.a, self.b = ids_a[np.repeat(good, counts_a)].astype(np.int64), ids_b[np.repeat(good, counts_b)].astype(np.int64)
        at = np.array(full, np.int64)[good]
        self.n_a, self.n_b, self.n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        self.n_a[at], self.n_b[at] = counts_a[good], counts_b[good]
        # Ends of tokens in the bytes of all texts in a row; a text ends where tokens of both end.
        end_a = np.cumsum(a.starts[self.a + 1] - a.starts[self.a])
        end_b = np.cumsum(b.starts[self.b + 1] - b.starts[self.b])
        near = np.searchsorted(end_b, end_a)
        both = end_b[near] == end_a if len(end_b) else np.zeros(0, bool)
        #: Index of the last tokens of each group.
        self.last_a, self.last_b = np.flatnonzero(both), near[both]
        self.n_groups = np.diff(np.searchsorted(self.last_a, np.cumsum(self.n_a), "left"), prepend=0)
        self._ids = max(len(a.starts), len(b.starts))

    def links(self) -> np.ndarray:
        """The packed pair of each group."""
        return self.a[self.last_a] << 32 | self.b[self.last_b]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        size_a, size_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        at_a = np.arange(len(self.a)) + before_b[group_a]
        at_b = np.arange(len(self.b)) + upto_a[group_b]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[at_a[self.last_a]], mark[at_b[self.last_b]] = ord("|"), ord(";")
        digits, lens = _decimals(self._ids)
        written = digits[ids]
        length = lens[ids]
        written[np.arange(len(ids)), length] = mark
        data = written[np.arange(written.shape[1]) <= length[:, None]].tobytes()
        cut = _edges(length + 1)[_edges(self.n_a + self.n_b)].tolist()
        return [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(cut[:-1], cut[1:], strict=True)]

    def lists(self) -> list[pa.Array]:
        """Ids of A and B of each text, and where in them each group ends, exclusive."""
        begin_a, begin_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        rows = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        return [
            _lists(self.a, self.n_a),
            _lists(self.b, self.n_b),
            _lists(self.last_a + 1 - begin_a[rows], self.n_groups),
            _lists(self.last_b + 1 - begin_b[rows], self.n_groups),
        ]


@lru_cache(maxsize=8)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``size``, left in rows with room for a mark, and their lengths."""
    texts = [str(i) for i in range(size)]
    width = len(texts[-1]) + 1
    return np.frombuffer("".join(t.ljust(width) for t in texts).encode(), np.uint8).reshape(size, width), np.array([len(t) for t in texts])


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_edges(counts).astype(np.int32)), pa.array(values, kind or pa.int32()))


def _align(path_a: str, path_b: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_encoder(path_a), piece_encoder(path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in pair_bpe.slices([t or "" for t in texts], SLICE):
                found = Aligned(texts[lo:hi], a, b)
                columns = [
                    batch.column(0)[lo:hi],
                    *(pa.array(c, pa.int64()) for c in (found.n_a, found.n_b, found.n_groups)),
                    pa.array(found.digests(), pa.string()),
                    _lists(found.links(), found.n_groups, pa.int64()),
                ]
                names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
                if with_groups:
                    columns, names = columns + found.lists(), [*names, "a", "b", "a_ends", "b_ends"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: links to ``key, n``, each key once a partition unless more than HELD are there."""
    keys, counts, held = [], [], 0
    for batch in batches:
        found, _ = _flat(batch.column(0))
        if not len(found):
            continue
        key, n = np.unique(found, return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > HELD:
            key, n = _summed(keys, counts)
            keys, counts, held = [key], [n], len(key)
            if held > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                keys, counts, held = [], [], 0
    if keys:
        key, n = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over sorted ``key, n``: one row for each run of a key, which may go on in the next batch."""
    key = n = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            key, n = _summed([key, batch.column(0).to_numpy()], [n, batch.column(1).to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(n[:-1])], ["key", "n"])
            key, n = key[-1:], n[-1:]
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def pair_counts(links: DataFrame, column: str = "links") -> DataFrame:
    """``key, n``: how often each packed pair stands in the lists of ``column``, sorted within ranges of keys."""
    partial = materialize(links.select(column).mapInArrow(_count, "key long, n long"), "pair_counts")
    ranges = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ranges.mapInArrow(_sum_runs, "key long, n long")


class Shards:
    """Sorted counts on the executors' disks, mapped into memory by each process that asks."""

    _OPEN: dict[str, np.ndarray] = {}

    def __init__(self, counts: DataFrame):
        """Write ``key, n``, sorted within partitions of disjoint ranges, and hand the files to Spark."""
        spark = counts.sparkSession
        path = new_path(spark, "pair_shards")
        fields = [F.lpad(F.hex(c), 16, "0") for c in ("key", "n")]
        counts.select(F.concat(*fields)).write.option("compression", "none").text(path)
        written = spark.read.text(path)
        self.names = []
        for file in sorted(written.inputFiles()):
            spark.sparkContext.addFile(file)
            self.names.append(file.rsplit("/", 1)[1])
        self.counts = written.select(
            *(F.conv(F.substring("value", at, 16), 16, 10).cast("long").alias(c) for c, at in (("key", 1), ("n", 17)))
        )

    def best(self, size: int) -> np.ndarray:
        """The highest count of each id of B below ``size``, which is all that the driver takes."""
        by_b = self.counts.groupBy(F.col("key").bitwiseAND(F.lit(int(_LOW))).alias("b")).agg(F.max("n").alias("n"))
        best = np.zeros(size, np.int64)
        for b, n in by_b.collect():
            best[b] = n
        return best

    def __getstate__(self) -> dict:
        return {"names": self.names}  # tasks need no more

    def _open(self) -> list[np.ndarray]:
        for name in self.names:
            if name not in self._OPEN:
                local = SparkFiles.get(name)
                self._OPEN[name] = np.memmap(local, RECORD, "r") if os.path.getsize(local) else np.zeros(0, RECORD)
        return [self._OPEN[name] for name in self.names if len(self._OPEN[name])]

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of ``keys``, which ascend; 0 for those that no shard has."""
        hexed = np.frombuffer(keys.astype(">i8").tobytes().hex().upper().encode(), "S16")
        out = np.zeros(len(keys), np.int64)
        for shard in self._open():
            lo, hi = np.searchsorted(hexed, shard["key"][0], "left"), np.searchsorted(hexed, shard["key"][-1], "right")
            if lo < hi:
                at = np.searchsorted(shard["key"], hexed[lo:hi])
                found = shard[at]
                n = np.frombuffer(bytes.fromhex(found["count"].tobytes().decode()), ">i8")
                out[lo:hi] = np.where(found["key"] == hexed[lo:hi], n, 0)
        return out


def _look_up(shards: Shards, best: np.ndarray, with_counts: bool):
    """mapInArrow: what the counts of a document's links come to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lens = _flat(batch.column("links"))
            keys, which = np.unique(found, return_inverse=True)
            n = shards.count(keys)
            top = (n == best[keys & _LOW])[which]
            n = n[which]
            edge = _edges(lens)
            sums = [np.diff(_edges(v.astype(np.int64))[edge]) for v in (top, n)]
            names = [c for c in batch.schema.names if c != "links"]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(lens, pa.int64()), *(pa.array(s, pa.int64()) for s in sums)]
            names += ["n_links", "n_best", "count_sum"]
            if with_counts:
                columns, names = [*columns, _lists(n, lens, pa.int64())], [*names, "counts"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum``.

    ``n_best`` are the links whose pair is among the most frequent of their id of
    B. ``with_groups`` adds the ids (``a``, ``b``), where each group ends in
    them, exclusive (``a_ends``, ``b_ends``), and the count of each group's link.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    lists = ", a array<int>, b array<int>, a_ends array<int>, b_ends array<int>" if with_groups else ""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = materialize(rows.mapInArrow(_align(path_a, path_b, with_groups), f"{schema}, links array<long>{lists}"), "aligned")
    shards = Shards(pair_counts(aligned))
    best = shards.best(piece_encoder(path_b).size)
    more = ", n_links long, n_best long, count_sum long" + (", counts array<long>" if with_groups else "")
    return aligned.mapInArrow(_look_up(shards, best, with_groups), schema + lists + more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


SQL = None
