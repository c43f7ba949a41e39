import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from meshnet.llm import language_id as op

from .conftest import SYLLABLES, prose


def slow_vector(text, dimensions):
    """Bind and bundle letter by letter."""
    numbers, table = op._numbers(), np.random.default_rng(op.SEED).integers(0, 2, (op.LETTERS, dimensions), np.int8).astype(int) * 2 - 1
    stream = [0]
    for c in text or "":
        n = int(numbers[ord(c)])
        if n or stream[-1]:
            stream.append(n)
    if stream[-1]:
        stream.append(0)
    total = np.zeros(dimensions)
    for a, b, c in zip(stream, stream[1:], stream[2:], strict=False):
        total += np.roll(table[a], 2) * np.roll(table[b], 1) * table[c]
    return total


def test_bundles(corpus):
    texts = ["", "a", "Ab c", "é日本 ΑΩ 12 ß", "  x  ", *[t for t in corpus[0] if t and len(t) < 2000][:80]]
    got = op.bundle(texts, 64, group=7)
    assert np.array_equal(got, np.array([slow_vector(t, 64) for t in texts]))


def labelled(spark, n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randint(5, 60)), lang if i % 7 else None, lang))
    rows += [(9000, None, "fr", "und"), (9001, "12 .. 34", "en", "und"), (9002, "", None, "und")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").repartition(3)


def test_prototypes_are_sums_over_all_labelled_texts(spark):
    rows, df = labelled(spark, 60)
    prototypes = op.train(df, dimensions=128)
    assert prototypes.names == ("de", "en", "fr")
    for name, vector in zip(prototypes.names, prototypes.vectors, strict=True):
        want = sum(slow_vector(t, 128) for _, t, lang, _ in rows if lang == name and t)
        assert np.allclose(vector, want / np.linalg.norm(want), atol=1e-12)


def test_held_out_accuracy_and_cases(spark):
    rows, df = labelled(spark)
    prototypes = op.train(df.where(op.fold("doc_id") != 0))
    out = op.label_language(df, prototypes).withColumn("held", op.fold("doc_id") == 0).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.truth == "und":
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in out if r.held and r.truth != "und"]
    assert len(held) > 30 and np.mean([r.lang_pred == r.truth for r in held]) > 0.95


def test_pass_through_ties_and_nothing_learned(spark, docs, empty):
    nothing = op.train(empty)
    assert nothing.names == ()
    out = op.label_language(docs, nothing)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)}
    assert op.label_language(empty, nothing).count() == 0
    same = op.Prototypes(("aa", "bb"), np.ones((2, 64)) / 8)
    assert op.Prototypes.predict(same, ["hello there"])[0] == ["aa"]
    clash = docs.withColumn("score", F.lit(1))
    try:
        op.label_language(clash, nothing)
    except ValueError:
        pass
    else:
        raise AssertionError("a clash of names passed")
    assert op.label_language(clash, nothing, score_out="cosine").count() == docs.count()
