import hashlib
from collections import defaultdict

import pytest

from meshnet.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [1 / 1000, 1 / 20, 0.5])
def test_same_as_brute_force(docs, share):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in op.exact_dedup(docs, heavy_share=share).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_group_is_settled_without_a_shuffle_of_its_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in op.exact_dedup(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size, r.kept) for r in op.exact_dedup(df).collect()] == [(None, 2, True)] * 2


def test_empty(empty):
    assert op.exact_dedup(empty).count() == 0


def test_plan_has_no_python(docs):
    plan = op.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
