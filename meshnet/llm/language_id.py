"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound as the
product of its letters' vectors, the first rotated twice and the second once;
a text is the sum of its trigrams, and so is a language over its labelled
texts. The language whose prototype has the largest cosine with the text wins.

Training counts trigrams over all labelled documents, sums them map-side, and
bundles the counts where they are; only one vector a language reaches the
driver, and more than MOST_LANGUAGES are an error. Counts and sums are whole numbers, so results depend on no order.

Cases: a text that is null, or has no letter, is ``und`` with score 0, and so is
every text if nothing could be learned. Equal cosines go to the first language
by name. A row with a null id is predicted but not learned from, and is not held
out. A text of any length is counted whole, in some 40 bytes a letter. Rows
repeated count as often as they occur. An empty table gives an empty
result. Columns of any other name pass through untouched.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm.pair_bpe import slices
from meshnet.plans.scratch import bound_arrow_batches, materialize
from meshnet.plans.tables import read_table

DIMENSIONS = 1024
SEED = 7
UNKNOWN = "und"
FOLDS = 5
MOST_LANGUAGES = 1000
#: Letters below this code point have a number of their own, others share the numbers up to LETTERS.
OWN, LETTERS = 0x250, 1024


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    """Code point to letter number, cases folded; 0 where there is no letter."""
    table = np.zeros(0x110000, np.uint16)
    for cp in range(0x20, 0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            table[cp] = low if low < OWN else OWN + low % (LETTERS - OWN)
    return table


@lru_cache(maxsize=2)
def _letters(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as third, second and first of a trigram."""
    vectors = (np.random.default_rng(SEED).integers(0, 2, (LETTERS, dimensions), np.int8) * 2 - 1).astype(np.int8)
    return np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors


def bind(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigrams, one a row."""
    first, second, third = _letters(dimensions)
    return first[keys // LETTERS**2] * second[keys // LETTERS % LETTERS] * third[keys % LETTERS]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text number, trigram, count``, sorted by both; runs of other characters count as one blank."""
    joined = "".join(f" {t} " for t in texts)
    number = _numbers()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = number != 0
    keep[0] = True
    keep[1:] |= (number[:-1] != 0) | (doc[1:] != doc[:-1])
    number, doc = number[keep].astype(np.int64), doc[keep]
    inside = doc[2:] == doc[:-2]
    key = (number[:-2] * LETTERS + number[1:-1]) * LETTERS + number[2:]
    wide, counts = np.unique((doc[2:] * LETTERS**3 + key)[inside], return_counts=True)
    doc, key = np.divmod(wide, LETTERS**3)
    real = key != 0
    return doc[real], key[real], counts[real]


def has_letter(text: str) -> bool:
    """Whether a text has a letter to tell its language by."""
    return bool(_numbers()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def bundle(texts: list[str], dimensions: int, group: int = 64) -> np.ndarray:
    """The vectors of texts, one a row; a few texts at a time share their bound trigrams."""
    doc, key, counts = trigrams(texts)
    out = np.zeros((len(texts), dimensions))
    for lo in range(0, len(texts), group):
        a, b = np.searchsorted(doc, [lo, lo + group])
        if a == b:
            continue
        own, column = np.unique(key[a:b], return_inverse=True)
        # Whole numbers: single precision is exact below 2**24.
        kind = np.float32 if counts[a:b].sum() < 1 << 24 else np.float64
        for c in range(0, len(own), 4096):
            here = (column >= c) & (column < c + 4096)
            table = np.zeros((min(group, len(texts) - lo), min(4096, len(own) - c)), kind)
            table[doc[a:b][here] - lo, column[here] - c] = counts[a:b][here]
            out[lo : lo + len(table)] += table @ bind(own[c : c + 4096], dimensions).astype(kind)
    return out


@dataclass(frozen=True)
class Prototypes:
    """One unit vector a language, in order of name."""

    names: tuple[str, ...]
    vectors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine, at least 0."""
        if not texts or not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors = bundle(texts, self.vectors.shape[1])
        norm = np.sqrt((vectors**2).sum(axis=1))
        cosine = np.stack([(vectors * v).sum(axis=1) for v in self.vectors], axis=1) / np.maximum(norm, 1e-300)[:, None]
        best = cosine.argmax(axis=1)
        known = norm > 0
        score = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS
) -> Prototypes:
    """Prototypes from all rows of ``docs`` with a text and a language."""
    bound_arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts)), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                    ["lang", "key", "n"],
                )
            total.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lo, hi in slices(texts, 1 << 20):
                doc, key, counts = trigrams(texts[lo:hi])
                spoken = langs[lo:hi][doc] if len(doc) else np.zeros(0, object)
                for lang in sorted(set(spoken)):
                    own, at = np.unique(key[here := spoken == lang], return_inverse=True)
                    sums = np.bincount(at, counts[here]).astype(np.int64)
                    tally = total.setdefault(lang, Counter())
                    for k, n in zip(own.tolist(), sums.tolist(), strict=True):
                        tally[k] += n
            if sum(map(len, total.values())) > 1_000_000:  # what memory holds stays bounded
                yield from rows()
        yield from rows()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            keys, counts = (batch.column(c).to_numpy() for c in (1, 2))
            for lang in sorted(set(langs)):
                own, n = keys[here := langs == lang], counts[here].astype(float)
                for lo in range(0, len(own), 4096):
                    part = n[lo : lo + 4096] @ bind(own[lo : lo + 4096], dimensions).astype(float)
                    total[lang] = total.get(lang, 0) + part
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()])], ["lang", "vector"])

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null"
    )
    counts = labelled.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "trigrams")
    # Vectors of tasks are added up where they are; whole numbers, so their order does not matter.
    parts = counts.mapInArrow(vectors, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "x"))
    cells = parts.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("cells"))
    rows = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} the right column?")
    sums = {row.lang: np.array([x for _, x in row.cells]) for row in rows}
    names = tuple(sorted(k for k, v in sums.items() if v.any()))
    return Prototypes(names, np.array([sums[k] / np.sqrt((sums[k] ** 2).sum()) for k in names]))


def label_language(
    df: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_out: str = "lang_pred",
    score_out: str = "score", keep: list[str] | None = None, lettered: bool = False,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) and the predicted language and score.

    With ``lettered``, only rows whose text has a letter. A text that is a field of a kept struct,
    as ``row.text``, goes to Python within it alone.
    """
    bound_arrow_batches(df.sparkSession)
    kept = df.columns if keep is None else keep
    if {lang_out, score_out} & set(kept):
        raise ValueError(f"{lang_out} or {score_out} is a column already")
    outer, _, inner = text_col.partition(".")
    inside = bool(inner) and outer in kept
    rows = df.select(*(F.col(f"`{c}`") for c in kept), *([] if inside else [F.col(text_col).alias("__text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(kept.index(outer)).field(inner) if inside else batch.column(len(kept))
            texts = [t or "" for t in column.to_pylist()]
            for lo, hi in slices(texts, 1 << 18):
                names, score = prototypes.predict(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                out = pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(kept))), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    [*kept, lang_out, score_out],
                )
                yield out.filter(pa.array(map(has_letter, texts[lo:hi]), pa.bool_())) if lettered else out

    schema = rows.select(*(F.col(f"`{c}`") for c in kept), F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema
    return rows.mapInArrow(run, schema)


def fold(id_col: str) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo FOLDS."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learned from all folds but 0."""
    docs = read_table(spark, sf_dir, "documents")
    prototypes = train(docs.where(fold("doc_id") != 0))
    own = docs.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "text")
    return label_language(own, prototypes, keep=["doc_id", "held_out"])


SQL = None
