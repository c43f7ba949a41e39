"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its words, lower-cased. Two texts are near when their edit similarity
is at least 0.8: the edits that turn one's words into the other's are at most a
fifth of the longer one's words. Banded alignment alone decides that.

Candidates come from Order MinHash. K-mers are runs of three words, each
labelled with its occurrence so that repeats count. A sketch takes the ``PICKS``
k-mers of least hash and keeps them in text order; two texts share it with a
probability near the Jaccard similarity of their k-mers to the power ``PICKS``,
less if parts are moved. A changed word costs three k-mers, so at an edit
similarity of 0.9 by scattered changes that Jaccard similarity is 0.57, and
``SKETCHES`` sketches miss a pair with a probability of 1e-6; at 0.85 it is
0.003 and at the bound of 0.8 it is 0.07. Changes next to each other cost less.
K-mers of five words could not do this: texts that differ in every fifth word
have an edit similarity of 0.8 and no run of five words in common.
In texts of up to ``SHORT`` words a few changes meet most k-mers, so those have
sketches of two k-mers besides. Texts of under fifteen words, which are near when
two edits apart at most, are found exactly: by their words, and by those without
as many of them as they may differ in. Pairs at the bound, changed at random
places, are found to nine tenths at every length; tests ask for that.

Texts of equal words are one representative from the start. Representatives
that share a sketch form a bucket; each joins the group of the bucket's first
member, so every pair that shares a bucket meets in a group. A group is compared
in chunks bounded in texts and in words: all with the first text, then those it
left over with all others. Pairs that can't be near by the words they have in
common, or that are connected already, are not aligned. So a chunk returns a
spanning forest of its links, never all pairs, and a hot bucket is spread over
many tasks.

If that leaves a group beyond one chunk in several components, and it has no more
than ``TILED`` chunks, all its half chunks are compared, two a task, but for
those of one component. The members of larger groups are filed under their
rarest pairs of neighbouring words, two fifths of them and one more: near texts
share one of those (prefix filter: an edit costs two pairs of words). Texts filed
under one pair are compared with each other unless all are connected; beyond one
chunk, by halves as above. So no pair of a group goes unseen, whatever its size.
Components of all links are the classes.

Cases: a text without words (null, empty, signs only) is near to identical
texts alone, null being empty. Texts under five words are near to texts of the
same words. A row with a null id takes no part: its class is null and it stays.
Rows repeated with one id are one document and stay or go together, whatever
their texts. A text of any length is sketched and aligned whole; one beyond a
chunk's words is a chunk with each other member. An empty table gives an empty
result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.operators.components import connected_components
from meshnet.plans.scratch import bound_arrow_batches, materialize
from meshnet.plans.tables import read_table

SHINGLE = 3
SIMILARITY = 0.8
PICKS, SKETCHES = 3, 64
#: Texts of up to so many words also have sketches of fewer k-mers; under LEAST words they have none.
SHORT, SHORT_PICKS, SHORT_SKETCHES = 128, 2, 24
LEAST = 5
#: Texts that may differ in so many edits at most are found exactly.
EXACT_EDITS = 2
#: Members that one task compares with each other, and their words.
CHUNK, CHUNK_WORDS = 1024, 1 << 18
#: Groups of up to so many chunks are compared half by half; it is less work than filing them.
TILED = 16
#: Up to so many candidates are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_TEXTS = 250_000
#: Bytes of row masks that an alignment of very long texts keeps.
MASK_BYTES = 32 << 20
_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    """Word to a 64-bit hash, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:  # about 50 MB
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of ``text``, in order."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words if there are fewer."""
    size = min(size, len(words))
    if not size:
        return words
    last = len(words) - size + 1
    total = np.zeros(last, np.uint64)
    for i in range(size):
        total += words[i : i + last] * _ODD[i]
    return _mix(total)


def labelled(items: np.ndarray) -> np.ndarray:
    """Hashes of ``items``, each with the number of its equals before it."""
    order = np.argsort(items, kind="stable")
    ordered = items[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    occurrence = np.empty(len(items), np.uint64)
    occurrence[order] = np.arange(len(items)) - np.repeat(first, np.diff(np.append(first, len(items))))
    return _mix(items + occurrence * np.uint64(0x9E3779B97F4A7C15))


def order_minhash(kmers: np.ndarray, sketches: int = SKETCHES, first_sketch: int = 0, picks: int = PICKS) -> np.ndarray:
    """One key a sketch: the least occurrence-labelled k-mers, hashed in text order."""
    n, base = len(kmers), labelled(kmers)
    picks = min(picks, n)
    keys = np.empty(sketches, np.uint64)
    block = max(1, (1 << 20) // n)  # sketches at a time, so that a very long text needs little memory
    for lo in range(0, sketches, block):
        salt = np.arange(lo + 1, min(lo + block, sketches) + 1, dtype=np.uint64) + np.uint64(first_sketch)
        salt = _mix(salt * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        weight = base[None, :] * salt[:, None]  # odd factors permute the 64 bits, which are spread already
        each, least = np.arange(len(salt)), np.empty((picks, len(salt)), np.int64)
        for pick in least:
            pick[:] = weight.argmin(axis=1)
            weight[each, pick] = np.iinfo(np.uint64).max
        least.sort(axis=0)
        key = salt
        for i, pick in enumerate(least):
            key = _mix(key ^ (kmers[pick] * _ODD[i]))
        keys[lo : lo + len(salt)] = key
    return keys


def _without(words: np.ndarray, most: int) -> np.ndarray:
    """Hashes of ``words`` as a whole, and of what is left without any of them up to ``most``."""
    n, out = len(words), []
    for gone in range(most + 1):
        left = np.array(list(combinations(range(n), n - gone)))
        out.append(_mix((words[left] * _ODD[: n - gone]).sum(axis=1, dtype=np.uint64)))
    return np.concatenate(out)


def sketch_keys(words: np.ndarray) -> np.ndarray | None:
    """The keys by which a text meets others; None under ``LEAST`` words."""
    if len(words) < LEAST:
        return None
    kmers = shingles(words)
    keys = [order_minhash(kmers)]
    if len(words) <= SHORT:
        keys.append(order_minhash(kmers, SHORT_SKETCHES, SKETCHES, SHORT_PICKS))
    if most_edits(len(words)) <= EXACT_EDITS:  # so many edits apart: equal without as many words of each
        keys.append(_without(words, most_edits(len(words))))
    return np.concatenate(keys).view(np.int64)


class _LongRows(dict):
    """Symbol to the mask of its places in a long text, made when asked for and forgotten beyond MASK_BYTES."""

    def __init__(self, text: np.ndarray):
        super().__init__()
        self.size, self.order = len(text) + 1, np.argsort(text, kind="stable")
        self.ordered = text[self.order]

    def get(self, symbol: int, default: int = 0) -> int:
        if symbol in self:
            return self[symbol]
        lo, hi = (np.searchsorted(self.ordered, symbol, side) for side in ("left", "right"))
        if lo == hi:
            return default
        bits = np.zeros(self.size, bool)
        bits[self.order[lo:hi] + 1] = True
        if (len(self) + 1) * self.size // 8 > MASK_BYTES:
            self.clear()
        self[symbol] = mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return mask


def most_edits(longer: int, threshold: float = SIMILARITY) -> int:
    """The edits that near texts may differ in."""
    return int((1 - threshold) * longer + 1e-9)


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences if at most ``limit``, else None.

    Only the band of diagonals that ``limit`` edits can reach is computed, a
    column at a time, its vertical differences being the bits of two integers.
    Costs never fall along a diagonal, so the last cell's diagonal tells when to stop.
    """
    if len(a) > len(b):
        a, b = b, a
    extra = len(b) - len(a)
    if extra > limit:
        return None
    differ = np.flatnonzero(a != b[: len(a)])
    lo = int(differ[0]) if len(differ) else len(a)
    differ = np.flatnonzero(a[lo:] != b[lo + extra :])
    hi = lo + (int(differ[-1]) + 1 if len(differ) else 0)
    a, b = a[lo:hi], b[lo : hi + extra].tolist()
    if not len(a):
        return extra
    slack = (limit - extra) // 2
    width = extra + 2 * slack + 1
    band = (1 << width) - 1
    if len(a) > 1 << 14:
        rows = _LongRows(a)
    else:
        rows = {}
        for i, x in enumerate(a.tolist(), 1):
            rows[x] = rows.get(x, 0) | 1 << i
    # Bit t stands for row top + t. Rows above the first cost as much as it does.
    rises, falls = band & ~((1 << (extra + slack)) - 1), 0
    cost, top = extra, -(extra + slack)
    for j, x in enumerate(b, 1):
        top += 1
        same = rows.get(x, 0)
        if same:
            same = (same >> top if top >= 0 else same << -top) & band
        free = (((same & rises) + rises) ^ rises | same | falls) & band  # as cheap as the cell diagonally before
        right = falls | (band & ~(free | rises))  # dearer than the cell before in the row
        left = free & rises
        if j > extra and not free >> slack & 1:
            cost += 1
            if cost > limit:
                return None
        free >>= 1
        rises = (left | ~(free | right)) & band
        falls = free & right
    return cost


def close_pairs(words: list[np.ndarray], rest: np.ndarray, threshold: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a text of ``rest`` and any text that may be near by their words, repeats counted, the closest first.

    An edit takes away one word in common at most, so no near pair is left out.
    """
    sizes = np.array([len(w) for w in words])
    by_size = np.argsort(sizes, kind="stable")
    place = np.empty(len(words), np.int64)
    place[by_size] = np.arange(len(words))
    whole = np.concatenate([labelled(w) for w in words])
    owner = np.repeat(place, sizes)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    number = np.cumsum(np.concatenate([[True], whole[1:] != whole[:-1]])) - 1
    shared = np.bincount(number)[number] > 1  # only these can be common
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    top = int(number[-1]) + 1 if len(number) else 0
    rows, ordered = np.sort(place[rest]), sizes[by_size]
    # Texts whose lengths differ by more than the edits allow are not compared: blocks of rows meet a range of columns.
    blocks = []
    for lo in range(0, len(rows), 64):
        block = rows[lo : lo + 64]
        least, most = ordered[block[0]], ordered[block[-1]]
        span = np.searchsorted(ordered, [threshold * least - 1e-6, most / threshold + 1e-6])
        blocks.append((block, int(span[0]), np.zeros((len(block), span[1] - span[0]), np.float32)))
    for lo in range(0, top, 4096):
        a, b = np.searchsorted(number, [lo, lo + 4096])
        table = np.zeros((len(words), min(4096, top - lo)), np.float32)
        table[owner[a:b], number[a:b] - lo] = 1
        for block, first, common in blocks:
            common += table[block] @ table[first : first + common.shape[1]].T
    x, y, share = [], [], []
    for block, first, common in blocks:
        longer = np.maximum(ordered[block][:, None], ordered[first : first + common.shape[1]][None, :])
        i, j = np.nonzero(longer - common.astype(np.int64) <= (1 - threshold) * longer + 1e-9)
        x.append(block[i])
        y.append(first + j)
        share.append(common[i, j] / longer[i, j])
    best = np.argsort(-np.concatenate(share), kind="stable")
    return by_size[np.concatenate(x)[best]], by_size[np.concatenate(y)[best]]


def links(texts: list[str], known: list[int], threshold: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs among ``texts``, as positions.

    Texts of one number in ``known`` are connected from the start.
    """
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words])
    first: dict[int, int] = {}
    root = [first.setdefault(c, i) for i, c in enumerate(known)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def meet(i: int, j: int) -> None:
        if (ri := find(i)) != (rj := find(j)):
            longest = int(max(sizes[i], sizes[j]))
            if banded_distance(words[i], words[j], most_edits(longest, threshold)) is not None:
                root[rj] = ri
                out.append((i, j))

    for j in range(1, len(texts)):
        meet(0, j)
    rest = [j for j in range(1, len(texts)) if find(j) != find(0)]
    if not rest:
        return out
    left = np.zeros(len(texts), bool)
    left[rest] = True
    x, y = close_pairs(words, np.array(rest), threshold)
    once = (y > 0) & ~(left[y] & (y >= x))  # pairs of two left over count once; the first text has met all
    for i, j in zip(y[once].tolist(), x[once].tolist(), strict=True):
        meet(i, j)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, th, text`` to ``id, th, digest, words, keys``."""
    for batch in batches:
        digests, sizes, keys = [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            sizes.append(len(words))
            if len(words):
                digests.append(xxhash.xxh3_128_digest(words.tobytes()))
            else:  # no word has this length of digest
                digests.append(b"-" + xxhash.xxh3_128_digest((text or "").encode()))
            keys.append(sketch_keys(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["id", "th", "digest", "words", "keys"],
        )
    _HASHES.clear()  # the worker's next task may be another stage's


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``leader, salt, known, node, text`` sorted by the first two, to links ``src, dst``.

    Nodes that groups before have connected in this task stay so: a task's links are a forest.
    """
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while (up := root.get(node, node)) != node:
            root[node] = root.get(up, up)
            node = up
        return node

    def done(nodes: list[int], known: list[int], texts: list[str]) -> pa.RecordBatch | None:
        known = [find(k) for k in known]
        if len(set(known)) < 2:
            return None
        found = links(texts, known)
        if not found:
            return None
        for i, j in found:
            root[find(known[j])] = find(known[i])
        a, b = (np.array([nodes[i] for i in end], np.int64) for end in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

    group, nodes, connected, texts = None, [], [], []
    for batch in batches:
        for leader, salt, known, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (leader, salt) != group:
                if out := done(nodes, connected, texts):
                    yield out
                group, nodes, connected, texts = (leader, salt), [], [], []
            nodes.append(node)
            connected.append(known)
            texts.append(text)
    if out := done(nodes, connected, texts):
        yield out
    _HASHES.clear()


def _texts(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of each of ``nodes(node, id, th)``, once, whatever rows repeat."""
    wanted = nodes.select("node", F.col("id").alias("i"), F.col("th").alias("h"))
    if wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    found = named.join(wanted, (F.col("id") == F.col("i")) & (F.col("th") == F.col("h")))
    return found.select("node", "text").dropDuplicates(["node"])


def _verified(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Links among the ``texts`` of each ``leader, salt`` of ``places``, which has ``node, known`` besides."""
    places = places.groupBy("node", "known").agg(F.collect_list(F.struct("leader", "salt")).alias("places"))
    return (
        texts.join(places, "node")
        .select("node", "known", "text", F.explode("places").alias("place"))
        .select("place.leader", "place.salt", "known", "node", "text")
        .repartition("leader", "salt")
        .sortWithinPartitions("leader", "salt", "node")
        .mapInArrow(_verify, "src long, dst long")
    )


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, text`` to ``node, pairs``: neighbouring words, labelled with their occurrence."""
    for batch in batches:
        pairs = [labelled(shingles(words_of(t), 2)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pairs, pa.list_(pa.int64()))], ["node", "pairs"])
    _HASHES.clear()


def _filed(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``key, node``: each of ``members`` under its rarest word pairs, without those of one text alone."""
    own = texts.join(members.select("node"), "node", "left_semi")
    sets = materialize(own.select("node", "text").mapInArrow(_word_pairs, "node long, pairs array<long>"), "word_pairs")
    each = sets.select("node", F.size("pairs").alias("n"), F.explode("pairs").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    # Of n + 1 words, near texts share at least 0.6 (n + 1) - 1 pairs, so of this many of the rarest one is common.
    # Pairs of one text are its rarest: they take places of that number, but lead nowhere.
    places = F.floor(2 * (1 - SIMILARITY) * (F.col("n") + 1) + 1e-9) + 1 - F.col("n") + F.size("ordered")
    return (
        each.join(shared, "key")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("ordered"))
        .select("node", "ordered", places.cast("int").alias("places"))
        .where("places > 0")
        .select(F.explode(F.slice("ordered", F.lit(1), F.col("places"))).alias("entry"), "node")
        .select("entry.key", "node")
    )


def _parts(limit: int, texts: Column, words: Column) -> Column:
    """Parts of up to ``limit`` texts, and of its share of a chunk's words."""
    return F.greatest(F.ceil(texts / limit), F.ceil(words / (CHUNK_WORDS * limit / CHUNK)), F.lit(1)).cast("int")


def _halves(hot: DataFrame, chunk: int) -> DataFrame:
    """Places of ``hot(key, node, known, words)``: each task takes two half chunks of the texts of one key.

    A component that fills half a chunk has halves of its own, which don't meet; the others share theirs.
    """
    sizes = hot.groupBy("key", "known").agg(F.count(F.lit(1)).alias("own"))
    hot = hot.join(sizes, ["key", "known"]).withColumn("whole", F.when(F.col("own") * 2 > chunk, F.col("known")))
    halves = _parts(max(1, chunk // 2), F.count(F.lit(1)), F.sum("words"))
    counts = hot.groupBy(F.col("key").alias("k"), F.col("whole").alias("w")).agg(halves.alias("halves"))
    number = F.pmod(F.xxhash64("node"), F.col("halves"))
    hot = hot.join(counts, (F.col("key") == F.col("k")) & F.col("whole").eqNullSafe(F.col("w"))).select(
        "key", "node", "known", "whole", F.concat_ws(":", F.coalesce(F.col("whole").cast("string"), F.lit("")), number).alias("half")
    )
    hot = materialize(hot, "halves")
    halves = hot.select("key", "whole", "half").distinct()
    other = halves.select("key", F.col("whole").alias("whole_b"), F.col("half").alias("half_b"))
    tasks = (
        halves.join(other, "key")
        .where((F.col("half") < F.col("half_b")) & F.coalesce(F.col("whole") != F.col("whole_b"), F.lit(True)))
        .select("key", F.concat_ws(" ", "half", "half_b").alias("salt"), F.explode(F.array("half", "half_b")).alias("half"))
    )
    return hot.join(tasks, ["key", "half"]).select("node", "known", F.col("key").alias("leader"), "salt")


def _by_rare_pairs(texts: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """Places of ``members(node, words, known)`` by the word pairs they are filed under."""
    filed = materialize(_filed(texts, members).join(members, "node"), "filed")
    # Neighbouring pairs often have the very same texts: one of them will do.
    x, y = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    keys = (
        filed.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("words").alias("total"), x.alias("x"), y.alias("y"),
            F.min("known").alias("lo"), F.max("known").alias("hi"),
        )
        .where("lo < hi")
        .groupBy("n", "total", "x", "y")
        .agg(F.min("key").alias("key"))
        .withColumn("parts", _parts(chunk, F.col("n"), F.col("total")))
    )
    filed = materialize(filed.join(keys.select("key", "parts"), "key"), "keyed")
    small = filed.where("parts = 1").select("node", "known", F.col("key").alias("leader"), F.lit("").alias("salt"))
    return small.unionByName(_halves(filed.where("parts > 1"), chunk))


def _across(
    texts: DataFrame, groups: DataFrame, components: DataFrame, chunk: int, tiled: int = TILED
) -> DataFrame | None:
    """Links that ``groups`` (``leader, node, words``) still lack between chunks; None if each is one component."""
    components = components.select(F.col("node").alias("c"), "component")
    groups = groups.join(components, F.col("node") == F.col("c"), "left").select(
        "leader", "node", "words", F.coalesce("component", "node").alias("known")
    )
    several = (
        groups.groupBy("leader")
        .agg(
            F.min("known").alias("lo"), F.max("known").alias("hi"),
            (_parts(chunk, F.count(F.lit(1)), F.sum("words")) <= tiled).alias("tiled"),
        )
        .where("lo < hi")
        .select(F.col("leader").alias("key"), "tiled")
    )
    members = materialize(groups.join(several, F.col("leader") == F.col("key")).drop("leader"), "open")
    which = {r.tiled for r in members.select("tiled").distinct().collect()}
    places = []
    if True in which:
        places.append(_halves(members.where("tiled").drop("tiled"), chunk))
    if False in which:
        places.append(_by_rare_pairs(texts, members.where("not tiled").select("node", "words", "known").distinct(), chunk))
    found = [materialize(_verified(texts, p), "links") for p in places]
    return reduce(DataFrame.unionByName, found) if found else None


def _same_id(sketches: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the texts of one id; most ids have one."""
    several = sketches.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi")
    texts = sketches.join(several.select("id"), "id", "left_semi").select("id", "digest").distinct()
    nodes = texts.join(reps.select("digest", "node"), "digest").select("id", "node")
    least = nodes.groupBy(F.col("id").alias("i")).agg(F.min("node").alias("src"))
    return nodes.join(least, F.col("id") == F.col("i")).where("node <> src").select("src", F.col("node").alias("dst"))


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, tiled: int = TILED
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, kept``.

    The class is the smallest id in it, and that document is kept.
    """
    bound_arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    named = rows.where("id is not null")
    sketches = materialize(
        named.mapInArrow(_sketch, "id long, th long, digest binary, words long, keys array<long>"), "sketches"
    )
    # A node for each different text, numbered in an order that does not follow that of the rows.
    reps = sketches.groupBy("digest").agg(
        F.min(F.struct("id", "th")).alias("row"), F.any_value("words").alias("words"), F.any_value("keys").alias("keys")
    )
    reps = materialize(
        reps.sortWithinPartitions("digest").select(
            F.monotonically_increasing_id().alias("node"), "digest", "row.id", "row.th", "words", "keys"
        ),
        "reps",
    )
    entries = reps.select("node", F.explode("keys").alias("key"))
    buckets = (
        entries.groupBy("key")
        .agg(F.min("node").alias("leader"), F.max("node").alias("most"))
        .where(F.col("leader") < F.col("most"))
        .select("key", "leader")
    )
    pairs = entries.join(buckets, "key").where(F.col("node") != F.col("leader")).select("leader", "node").distinct()
    sizes = reps.select("node", "words")
    pairs = materialize(pairs.join(sizes, "node"), "pairs")
    salts = pairs.groupBy("leader").agg(_parts(chunk, F.count(F.lit(1)), F.sum("words")).alias("salts"))
    salts = materialize(salts, "salts")
    members = pairs.join(salts, "leader").select(
        "node", "leader", F.pmod(F.xxhash64("node", "leader"), F.col("salts")).cast("int").alias("salt")
    )
    leaders = salts.select(
        F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    places = members.unionByName(leaders).withColumn("known", F.col("node"))
    candidates = pairs.select("node").unionByName(salts.select(F.col("leader").alias("node"))).distinct()
    texts = _texts(named, materialize(reps.select("node", "id", "th").join(candidates, "node", "left_semi"), "candidates"))
    found = materialize(_verified(texts, places).unionByName(_same_id(sketches, reps)), "links")
    components = connected_components(found)
    groups = pairs.join(salts.where("salts > 1"), "leader").select("leader", "node", "words")
    groups = groups.unionByName(
        groups.select("leader").distinct().join(sizes, F.col("leader") == F.col("node")).select("leader", "node", "words")
    )
    more = _across(texts, groups, components, chunk, tiled)
    if more is not None and more.limit(1).count():
        stars = components.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        components = connected_components(stars.unionByName(more))
    linked = components.join(reps.select("node", "id"), "node")
    names = linked.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("class_id"))
    named_nodes = linked.join(names, F.col("component") == F.col("c")).select(F.col("node").alias("n"), "class_id")
    classes = (
        reps.select("digest", "node", F.col("id").alias("rep"))
        .join(named_nodes, F.col("node") == F.col("n"), "left")
        .select("digest", F.coalesce("class_id", "rep").alias("class_id"))
    )
    out = sketches.select("id", "digest").join(classes, "digest").select(
        F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept")
    )
    unnamed = rows.where("id is null").select(
        F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(True).alias("kept")
    )
    return out.unionByName(unnamed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return near_classes(read_table(spark, sf_dir, "documents"))


SQL = None
