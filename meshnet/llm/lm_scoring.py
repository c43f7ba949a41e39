"""Language-model scores of whole texts by a weighted backoff automaton.

Counts of n-grams over the training texts make the automaton. Its states are
the word sequences, shorter than ``order``, that training has seen. A state has
an arc for every word seen after it, which bears the smoothed log-probability
and leads to the longest state that ends in that word, and a failure arc to the
state without its first word, which bears the weight of backing off. One pass
over a text from left to right carries the state and adds up what the arcs bear.

Smoothing interpolates by a Dirichlet prior: with context h, its suffix h',
``p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu)``, and the failure arc of h
bears ``mu / (c(h) + mu)``. Below is the base, ``(c + 1) / (N + V + 1)``, which
leaves a share to one unknown word. So probabilities sum to one in every state.

No task sees the whole automaton, which grows with the corpus. Texts are written
as chunks of word numbers. Each chunk sends its distinct n-grams, with their
counts in training, to buckets of the key space. A bucket adds up what all
chunks sent and answers each, so a chunk gets the part of the automaton that its
texts can reach, and the texts meet it by the chunk's number. An n-gram leaves
a chunk once however frequent it is, so a hot word or a hot text is no hot key.

Cases: a null or empty text is the end alone. Words are compared by 64 bits of
hash. Training texts are those ``held_out`` is not true for; a row with a null
id is never held out, and rows repeated count each. Without training texts all
words have the base ``1 / 1``. Texts of any length are taken whole; a text's
words must fit in memory. An empty table gives an empty result. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm.crc_sql import crc32_sql
from meshnet.plans.scratch import bound_arrow_batches, materialize
from meshnet.plans.tables import read_table

ORDER = 2
#: Weight of the next shorter context, in tokens.
MU = 20.0
#: Bytes of text that make a chunk.
CHUNK = 16 << 20
#: Tokens for which there is one bucket: bounds the n-grams that a task adds up.
PER_BUCKET = 4 << 20
#: Words can't hold white space, so these stand for the end and the start of a text.
END, START = xxhash.xxh3_64_intdigest(b" "), xxhash.xxh3_64_intdigest(b"\n")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, with A-Z lower-cased: bytes have no other case and no other white space."""
    return (text or "").encode().lower().split()


class _Numbers(dict):
    """Word to its number in a chunk; 0 is the end of a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _chunks(size: int):
    """mapInArrow function: ``doc_id, held_out, text`` to a row for about ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        numbers, ids, held, tokens, taken = _Numbers(), [], [], [], 0

        def chunk() -> pa.RecordBatch:
            hashes = np.fromiter((END, *map(xxhash.xxh3_64_intdigest, numbers)), np.uint64, len(numbers) + 1)
            columns = [
                pa.array([(task << 32) + made], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in tokens]], pa.list_(pa.int64())),
                pa.array([np.concatenate(tokens).tobytes()], pa.binary()),
                pa.array([hashes.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "held", "lens", "tokens", "hashes"])

        for batch in batches:
            for i, out, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = words_of(text)
                number = np.zeros(len(words) + 1, np.int32)
                number[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                ids.append(i)
                held.append(out)
                tokens.append(number)
                taken += len(text or "") + 1
                if taken >= size:
                    yield chunk()
                    made += 1
                    numbers, ids, held, tokens, taken = _Numbers(), [], [], [], 0
        if ids:
            yield chunk()

    return run


class Grams:
    """The n-grams that end at each token of a chunk."""

    def __init__(self, row: dict, order: int):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lens = np.array(row["lens"], np.int64)
        self.tokens = np.frombuffer(row["tokens"], np.int32)
        hashes = np.frombuffer(row["hashes"], np.uint64)
        self.starts = np.cumsum(self.lens) - self.lens
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lens)
        word = hashes[self.tokens]
        #: For each length the keys at the tokens, and whether the text has so many words before, counting its start.
        self.keys, self.whole = [word], [np.ones(len(word), bool)]
        for n in range(2, order + 1):
            before = np.roll(self.keys[-1], 1)
            if n == 2:
                before[self.starts] = START
            self.keys.append(_mix(before * _ODD + word))
            self.whole.append(place >= n - 2)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of length ``n``, ascending, and how often training has each here."""
        whole = self.whole[n - 1]
        key, learned = self.keys[n - 1][whole], np.repeat(~self.held, self.lens)[whole]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat(learned[order].astype(np.int64), first) if len(key) else first


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, a range of the key space, begins in the ascending ``keys``; one more at the end."""
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def _ask(order: int, buckets: int):
    """mapInArrow function: chunks to ``bucket, chunk, n, keys, counts``, a row for each bucket they have keys of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                grams = Grams(row, order)
                for n in range(1, order + 1):
                    keys, counts = grams.distinct(n)
                    at = _bounds(keys, buckets).tolist()
                    full = [b for b in range(buckets) if at[b] < at[b + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            pa.array([row["chunk"]] * len(full), pa.int64()),
                            pa.array([n] * len(full), pa.int32()),
                            pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
                            pa.array([counts[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
                        ],
                        ["bucket", "chunk", "n", "keys", "counts"],
                    )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over the rows of buckets: to each the totals of its keys, ``chunk, n, bucket, totals``.

    The first answer of a task and length also tells how many keys training has there, and their counts.
    """
    asked: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for row in _rows(batch):
            blob = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)
            asked.setdefault(row["n"], []).append((row["chunk"], row["bucket"], *blob))
    for n, blobs in asked.items():
        keys, which = np.unique(np.concatenate([b[2] for b in blobs]), return_inverse=True)
        totals = np.bincount(which, np.concatenate([b[3] for b in blobs]), len(keys)).astype(np.int64)
        edge = np.cumsum([0, *(len(b[2]) for b in blobs)]).tolist()
        seen, sums = [int((totals > 0).sum()), *[0] * (len(blobs) - 1)], [int(totals.sum()), *[0] * (len(blobs) - 1)]
        for i, (chunk, bucket, *_) in enumerate(blobs):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()), pa.array([n], pa.int32()), pa.array([bucket], pa.int32()),
                    pa.array([totals[which[edge[i] : edge[i + 1]]].tobytes()], pa.binary()),
                    pa.array([seen[i]], pa.int64()), pa.array([sums[i]], pa.int64()),
                ],
                ["chunk", "n", "bucket", "totals", "seen", "sums"],
            )


class Automaton:
    """The states and arcs that the n-grams of a chunk can reach, with ``totals[n]`` for the keys of each length.

    A state of n words is the number of its n-gram; arcs are found by the number
    of the n-gram they spell.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, words: int, mu: float):
        self.grams, self.mu = grams, mu
        keys = [grams.distinct(n)[0] for n in range(1, len(totals) + 1)]
        number = [np.searchsorted(k, g) for k, g in zip(keys, grams.keys, strict=True)]
        #: How often training has the n-gram that ends at each token; 0 where the text has fewer words before.
        self.counts = [np.where(w, t[np.where(w, at, 0)], 0) for w, t, at in zip(grams.whole, totals, number, strict=True)]
        self.least = (self.counts[0] + 1) / (tokens + words + 1)
        self.base = np.log10(self.least)
        # As many texts start as end.
        ends = totals[0][np.searchsorted(keys[0], np.uint64(END))]
        contexts = [np.roll(c, 1) for c in self.counts[:-1]]
        for n, c in enumerate(contexts):
            c[grams.starts] = ends if n == 0 else 0
        self.contexts = contexts

    def walk(self) -> np.ndarray:
        """Log-probability of each token: the arcs that a walk over its text takes there.

        All texts are walked at once: the state before a token is the longest of the contexts before
        it that training has seen.
        """
        # Smoothed probabilities, from the shortest context up; an arc's own where the n-gram was seen.
        p = [self.least]
        for n, before in enumerate(self.contexts, 1):
            p.append((self.counts[n] + self.mu * p[-1]) / (before + self.mu))
        score = np.zeros(len(self.base))
        on = np.zeros(len(self.base), bool)  # tokens whose arc was found
        for n in range(len(self.contexts), 0, -1):
            state = self.contexts[n - 1] > 0
            arc = ~on & state & (self.counts[n] > 0)
            score[arc] += np.log10(p[n][arc])
            on |= arc
            fail = ~on & state
            score[fail] += np.log10(self.mu / (self.contexts[n - 1][fail] + self.mu))
        score[~on] += self.base[~on]
        return score


def _score(order: int, tokens: int, words: int, mu: float):
    """Function over a chunk and the answers to it."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        found = sorted(_rows(answers), key=lambda r: (r["n"], r["bucket"]))
        totals = [np.frombuffer(b"".join(r["totals"] for r in found if r["n"] == n), np.int64) for n in range(1, order + 1)]
        for row in _rows(chunk):
            grams = Grams(row, order)
            automaton = Automaton(grams, totals, tokens, words, mu)
            known = (automaton.counts[0] > 0).astype(np.int64)
            sums = [np.add.reduceat(v, grams.starts) for v in (known, automaton.base, automaton.walk())]
            out.append(
                pa.table(
                    [pa.array(grams.ids, pa.int64()), pa.array(grams.held), pa.array(grams.lens), *map(pa.array, sums)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else _EMPTY.empty_table()

    return run


_EMPTY = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    mu: float = MU,
    chunk: int = CHUNK,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; scores are log10.

    The model has the n-grams of up to ``order`` words of all rows that ``held_out`` is not true for.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    chunks = materialize(
        rows.mapInArrow(_chunks(chunk), "chunk long, ids array<long>, held array<boolean>, lens array<long>, tokens binary, hashes binary"),
        "chunks",
    )
    size = chunks.select(F.sum(F.octet_length("tokens")).alias("bytes")).first().bytes or 0
    buckets = max(1, -(-size // (4 * per_bucket)))
    asked = chunks.mapInArrow(_ask(order, buckets), "bucket int, chunk long, n int, keys binary, counts binary")
    answers = materialize(
        asked.repartitionById(buckets, F.col("bucket")).mapInArrow(
            _answer, "chunk long, n int, bucket int, totals binary, seen long, sums long"
        ),
        "answers",
    )
    words = answers.where("n = 1").agg(F.sum("seen").alias("seen"), F.sum("sums").alias("sums")).first()
    tokens = words.sums or 0
    scored = (
        chunks.groupBy("chunk")
        .cogroup(answers.select("chunk", "n", "bucket", "totals").groupBy("chunk"))
        .applyInArrow(
            _score(order, tokens, words.seen or 0, mu),
            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; scores to six places."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(docs, held_out).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 2, false) AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x20\\x09-\\x0D]+'), ' ') AS words
  FROM documents
), tokens AS (
  SELECT doc_id, held_out, w, lag(w, 1, chr(10)) OVER (PARTITION BY doc_id ORDER BY i) AS h
  FROM (SELECT doc_id, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts)
), one AS (
  SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY 1
), two AS (
  SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY 1, 2
), sums AS (
  SELECT sum(c)::BIGINT AS n, count(*) AS v FROM one
), rated AS (
  SELECT t.doc_id, t.held_out, n, coalesce(one.c, 0) AS c1, coalesce(two.c, 0) AS c2, coalesce(ctx.c, 0) AS ch,
         (coalesce(one.c, 0) + 1)::DOUBLE / (n + v + 1) AS p
  FROM tokens t CROSS JOIN sums LEFT JOIN one ON one.w = t.w LEFT JOIN two ON two.h = t.h AND two.w = t.w
  LEFT JOIN one ctx ON ctx.w = CASE WHEN t.h = chr(10) THEN ' ' ELSE t.h END
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c1 > 0) AS n_known, any_value(n) AS train_tokens,
       round(fsum(log10(p)), 6) AS base_score, round(fsum(log10((c2 + {MU} * p) / (ch + {MU}))), 6) AS score
FROM rated GROUP BY 1, 2
"""
