import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from meshnet.llm import lm_scoring

SF = "/root/testdata/sf0.001"


def model(rows, order, mu):
    """The texts' words, and counts and probabilities of the training texts among ``(doc_id, text, held_out)``."""
    said = []
    for i, text, out in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        said.append((i, out, [*re.findall("[^\x20\x09-\x0d]+", lower), "</s>"]))
    counts = Counter()
    for _, out, words in said:
        if not out:
            full = ["<s>", *words]
            counts["<s>",] += 1
            for at in range(1, len(full)):
                for n in range(1, order + 1):
                    if at - n + 1 >= 0:
                        counts[tuple(full[at - n + 1 : at + 1])] += 1
    seen = [k for k in counts if len(k) == 1 and k != ("<s>",)]
    total = sum(counts[k] for k in seen)

    def p(context, w):
        if not context:
            return (counts[w,] + 1) / (total + len(seen) + 1)
        return (counts[(*context, w)] + mu * p(context[1:], w)) / (counts[context] + mu)

    return said, counts, total, p


def brute(rows, order, mu):
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, token by token."""
    said, counts, total, p = model(rows, order, mu)
    out = []
    for i, held, words in said:
        full, base, score = ["<s>", *words], 0.0, 0.0
        for at in range(1, len(full)):
            base += math.log10(p((), full[at]))
            score += math.log10(p(tuple(full[max(0, at - order + 1) : at]), full[at]))
        out.append((i, held, len(words), sum(counts[w,] > 0 for w in words), total, base, score))
    return out


def same(found, want):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 3))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for f, w in zip(found, want, strict=True):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize(("order", "chunk", "per_bucket"), [(2, 16 << 20, 4 << 20), (2, 300, 50), (1, 500, 100), (3, 2000, 300)])
def test_against_brute_force(docs, order, chunk, per_bucket):
    held = F.col("doc_id") % 3 == 1
    found = lm_scoring.score_texts(docs, held, order=order, chunk=chunk, per_bucket=per_bucket)
    rows = [(r.doc_id, r.text, r.doc_id is not None and r.doc_id % 3 == 1) for r in docs.collect()]
    same(found.collect(), brute(rows, order, lm_scoring.MU))


def test_probabilities_of_a_state_sum_to_one(spark):
    words = ["a", "b", "c"]
    train = [(i, t, False) for i, t in enumerate(["a b a", "b c", "a a a b", ""])]
    asked = [(100 + 9 * i + j, f"{h} {w}", True) for i, h in enumerate([*words, "never"]) for j, w in enumerate([*words, "unknown"])]
    rows = spark.createDataFrame(train + asked, "doc_id long, text string, out boolean")
    for order in (2, 3):
        same(lm_scoring.score_texts(rows, F.col("out"), order=order).collect(), brute([*train, *asked], order, lm_scoring.MU))
        *_, p = model(train, order, lm_scoring.MU)
        for context in [("<s>",), *((h,) for h in [*words, "never"]), ("<s>", "a"), ("a", "b")][: 5 if order == 2 else None]:
            assert sum(p(context, w) for w in [*words, "unknown", "</s>"]) == pytest.approx(1)


def test_seen_text_is_likelier_than_by_the_base(spark):
    found = lm_scoring.query(spark, "/root/testdata/sf0.01")
    held = found.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert held.s > held.b  # bits a token, on texts that it has not learned from


def test_against_sql(spark):
    found = lm_scoring.query(spark, SF)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(lm_scoring.SQL)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(want.fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(d.doc_id, d.text, zlib.crc32(str(d.doc_id).encode()) % 7 == 2) for d in docs]
    same(found.collect(), [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in brute(rows, lm_scoring.ORDER, lm_scoring.MU)])


def test_cases(spark, empty):
    assert lm_scoring.score_texts(empty, F.lit(False)).collect() == []
    rows = [(1, None), (2, ""), (None, "x"), (3, "A\tb\x0bÉ é"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash")).withColumn("chunk", F.lit(1))
    held = F.col("doc_id") == 3
    same(lm_scoring.score_texts(docs, held).collect(), brute([(i, t, i == 3) for i, t in rows], 2, lm_scoring.MU))
    all_out = lm_scoring.score_texts(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in all_out} == {(0, 0, 0.0, 0.0)}
