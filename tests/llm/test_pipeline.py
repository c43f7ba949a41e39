"""The pipeline's rows against plain Python, stage by stage, each on its own input."""

import random
from functools import partial

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meshnet.llm import near_dedup

from . import test_line_dedup, test_near_dedup
from .conftest import SCHEMA, rows_of

WORD = public_tokenizers.path("word_bpe_49k.json")


def plain(docs):
    """``doc_id, text`` rows after the first three stages."""
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    kept = []
    for (i, t), (_, _, lost, text) in zip(sorted(rows, key=str), pair(rows), strict=True):
        kept.append((i, text if lost else t))
    stay = {}
    for i, _, ok in test_near_dedup.brute(kept):
        stay[i] = stay.get(i, False) or ok
    return [r for r in kept if stay[r[0]]]


def pair(rows):
    """Line dedup's rows in the order of ``sorted(rows, key=str)``."""
    out = []
    for row in sorted(rows, key=str):
        owners = test_line_dedup.brute(rows)
        lines = (row[1] or "").split("\n")
        out.append(next(o for o in owners if o[0] == row[0] and o[1] == len(lines) and is_part(o[3], lines)))
    return out


def is_part(text, lines):
    it = iter(lines)
    return text == "" or all(x in it for x in text.split("\n"))


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]


def test_stages_keep_columns_and_decide(spark, docs):
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "unused")
        assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = plain(docs)
    assert sorted({(i, t) for i, t in got}, key=str) == sorted(set(want), key=str)
    assert len(got) == len(want) and len(got) < docs.count()
    library = Tokenizer.from_file(WORD)
    pieces = corpus_pipeline.pack_sequences(spark, out, "unused").collect()
    tokens = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in got)
    assert sum(p.length for p in pieces) == tokens


def test_columns_of_any_name(spark, docs):
    names = ["_id", "_th", "_lost", "__id", "id", "lost_id", "row", "__lang_pred", "lang_pred", "score", "_kept", "kept", "n_dropped", "a.b"]
    wide = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names) if n not in docs.columns))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, plain_out = stage(spark, wide, "unused"), stage(spark, docs, "unused")
        assert out.columns == wide.columns and out.select(plain_out.columns).schema == plain_out.schema
        assert sorted(map(str, out.select(plain_out.columns).collect())) == sorted(map(str, plain_out.collect()))
        assert out.select("_id", "`a.b`").distinct().count() == 1
    assert corpus_pipeline.pack_sequences(spark, wide, "unused").count() > 0


def test_empty_table(spark, empty):
    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "unused")
    assert out.count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, f"/root/testdata/{sf}")
    assert rows.columns[:2] == ["doc_id", "start"] and rows.count() > 100


def test_near_dedup_stage_on_a_group_beyond_a_chunk(spark, monkeypatch):
    """The stage leaves the chunk at its default, which is small here."""
    monkeypatch.setattr(near_dedup, "near_classes", partial(near_dedup.near_classes, chunk=16))
    rows = rows_of(test_near_dedup.form_letters(random.Random(16), 250))
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "unused")
    want = [i for i, _, kept in test_near_dedup.brute([r[:2] for r in rows]) if kept]
    assert 1 < len(want) < len(rows)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(want)


@pytest.mark.parametrize("labels", [(), ("12 34",), ("some words",)])
def test_documents_with_letters_stay_whatever_is_learned(spark, labels):
    """No label, one that nothing can be learned from, or one by the name of the unknown."""
    texts = ["some words", "other words", "é", "12 34", "", None]
    rows = rows_of(texts, ["und" if t in labels else None for t in texts])
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "unused")
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(0, "und"), (1, "und"), (2, "und")]
