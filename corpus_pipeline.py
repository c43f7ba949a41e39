"""From raw documents to packed sequences: language ID, line dedup, near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of
``documents``, whatever they are, of the rows they keep.

Cases, beyond those of the operators: rows with a null id pass line dedup and
near-dedup untouched; rows repeated with one id stay together. Columns beyond
``doc_id, text, lang, source, n_chars`` pass through; where ``n_chars`` exists
it follows the text. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm import language_id, line_dedup, near_dedup, packing
from meshnet.plans.scratch import materialize
from meshnet.plans.tables import read_table


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The fields of the column ``row``, in the order of ``docs``, some replaced by ``new``."""
    row = F.col("row")
    return [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else row.getField(c).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: those without a letter.

    Prototypes are learned from all labelled documents of ``docs``. A null
    ``lang`` of a kept document becomes the predicted one, which is ``und`` if
    nothing could be learned.
    """
    rows = docs.select(F.struct("*").alias("row"))
    labelled = language_id.label_language(rows, language_id.train(docs), "row.text", keep=["row"], lettered=True)
    return labelled.select(*_columns(docs, lang=F.coalesce("row.lang", "lang_pred")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of all documents but the first.

    Every document stays, one that loses all its lines with an empty text: the
    next stage keeps one of those.
    """
    lost = F.col("n_dropped") > 0
    new = {"text": F.when(lost, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.char_length("kept")).otherwise(F.col("row.n_chars"))
    return line_dedup.dedup_lines(docs).select(*_columns(docs, **new))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of near-duplicates."""
    classes = near_dedup.near_classes(docs)
    # Ids that stay in none of their rows go; texts under one id stay or go together.
    lost = classes.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    lost = materialize(lost.select(F.col("doc_id").alias("lost_id")), "near_duplicates")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(lost, F.col("id") == F.col("lost_id"), "left_anti").select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Alignment and learned prototypes have no SQL; tests hold the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
