import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshnet.llm import near_dedup as op

from .conftest import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(rows):
    """Every pair of texts is compared."""
    texts = {}
    for i, t in rows:
        if i is not None:
            w = tuple(words(t))
            texts.setdefault((w, None if w else t or ""), []).append(i)
    keys, root = list(texts), {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for ids in texts.values():
        for i in ids:
            join(min(ids), i)
    bags = [Counter(w) for w, _ in keys]
    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[x][0], keys[y][0]
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if min(len(a), len(b)) >= 5 and (bags[x] & bags[y]).total() >= max(len(a), len(b)) - most:
                if distance(a, b) <= most:
                    join(texts[keys[x]][0], texts[keys[y]][0])
    return sorted(((i, None if i is None else find(i), i is None or find(i) == i) for i, _ in rows), key=str)


def result(df, **how):
    return sorted((tuple(r) for r in op.near_classes(df, **how).collect()), key=str)


def families(rng, n):
    """Bases and copies of them with one or more words changed, put in or left out."""
    out = []
    for _ in range(n):
        base = prose(rng, rng.choice(["en", "fr", "de"]), rng.randint(6, 90)).split(" ")
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [str(rng.random())[2:5]] * rng.randint(0, 2)
            out.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(8)
    texts = families(rng, 40) + ["", None, "...", "...", "one two", "One, two!", "a b c d e", "a b c d e f"]
    halves = prose(rng, "en", 80).split(" ")
    texts += [" ".join(halves), " ".join(halves[40:] + halves[:40])]  # near by its words, far by edits
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[0], (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(*r, b"clash", 1) for r in rows], "doc_id long, text string, digest binary, rep int").repartition(4)
    got = result(df)
    assert got == brute(rows)
    assert 1 < len({c for _, c, _ in got}) < len(got)
    assert result(df, chunk=3) == got  # groups cut into chunks
    assert result(df.orderBy(F.desc("doc_id")).repartition(7)) == got


def test_texts_under_one_id(spark):
    """An id of two texts joins the classes of both, in any order of rows."""
    rng = random.Random(9)
    a, b = prose(rng, "en", 60), prose(rng, "de", 60)
    rows = [(5, a), (5, b), (7, a.replace(" ", " new ", 1)), (8, b.replace(" ", " neu ", 1)), (9, prose(rng, "fr", 60)), (5, a)]
    want = [(5, 5, True)] * 3 + [(7, 5, False), (8, 5, False), (9, 9, True)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert result(spark.createDataFrame(order, "doc_id long, text string").repartition(3)) == want
    assert brute(rows) == want


@pytest.mark.parametrize(("share", "least"), [(0.01, 1.0), (0.03, 1.0), (0.05, 1.0), (0.1, 0.99), (0.15, 0.95), (0.2, 0.85)])
def test_recall_of_scattered_changes(share, least):
    """Pairs whose words differ at random places, alignment being the judge, share a sketch."""
    rng, found, near = np.random.default_rng(int(share * 100)), 0, 0
    for _ in range(150):
        a = rng.integers(1 << 60, size=rng.integers(100, 400)).astype(np.uint64)
        b = a.copy()
        b[rng.choice(len(a), int(share * len(a)), replace=False)] += np.uint64(1)
        near += op.banded_distance(a, b, op.most_edits(len(a))) is not None
        found += bool((op.sketch_keys(a) == op.sketch_keys(b)).any())
    assert near == 150 and found >= least * near


@pytest.mark.parametrize("words", [5, 9, 10, 14, 15, 20, 30, 40, 50, 60, 80, 100, 101, 128, 129, 200, 400])
def test_recall_at_the_bound_by_length(words):
    """As many words changed as near texts may differ in, at random places."""
    rng, found = np.random.default_rng(words), 0
    for _ in range(200):
        a = rng.integers(1 << 60, size=words).astype(np.uint64)
        b = a.copy()
        b[rng.choice(words, op.most_edits(words), replace=False)] += np.uint64(1)
        assert op.banded_distance(a, b, op.most_edits(words)) is not None
        found += len(np.intersect1d(op.sketch_keys(a), op.sketch_keys(b))) > 0
    assert found >= (200 if words < 15 else 180)


def test_near_pairs_of_the_table_are_in_one_class(spark):
    """All pairs of the smallest table, aligned one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: op.words_of(r.text) for r in docs.collect()}
    classes = {r.doc_id: r.class_id for r in op.near_classes(docs).collect()}
    pairs = [(a, b) for a in texts for b in texts if a < b and len(texts[a]) >= op.LEAST and len(texts[b]) >= op.LEAST]
    near = [(a, b) for a, b in pairs if op.banded_distance(texts[a], texts[b], op.most_edits(max(len(texts[a]), len(texts[b])))) is not None]
    assert near and all(classes[a] == classes[b] for a, b in near)


def test_tiny_texts_are_found_exactly():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(9) for _ in range(rng.randint(5, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randrange(9)] * rng.randint(0, 1)
        if 5 <= len(b) <= 14:
            x, y = (set(op.sketch_keys(np.array(t, np.uint64)).tolist()) for t in (a, b))
            assert (distance(a, b) <= op.most_edits(max(len(a), len(b)))) <= bool(x & y)


def test_links_of_a_group(spark):
    """A group's forest connects what pairs connect, whichever text comes first."""
    rng = random.Random(12)
    texts = [t for t in families(rng, 12) if len(words(t)) >= 5]
    texts += [prose(rng, "en", 200) for _ in range(2)] + [prose(rng, "en", 3000)]
    for _ in range(3):
        rng.shuffle(texts)
        want = brute(list(enumerate(texts)))
        root = list(range(len(texts)))
        for i, j in op.links(texts, list(range(len(texts)))):
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        digest = {}
        for i, t in enumerate(texts):  # equal words are one text before links() is called
            digest.setdefault(tuple(words(t)), root[i])
        assert {(i, c) for i, c, _ in want} == {(i, digest[tuple(words(t))]) for i, t in enumerate(texts)}


def test_large_group_is_one_class(spark):
    rng = random.Random(3)
    base = prose(rng, "en", 60).split(" ")
    texts = [" ".join([*base[:30], f"w{i}", *base[30:]]) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {c for _, c, _ in result(df, chunk=64)} == {0}


def form_letters(rng, n, words=120, slots=8, values=12):
    """Texts of one form, near where half the phrases in its slots agree; phrase k is taken as 1/k. The first is like none."""
    form = prose(rng, "en", words).split(" ")
    out = [" ".join([*form[:30], *prose(rng, "fr", 60).split(" "), *form[30:]])]
    for _ in range(n - 1):
        own = list(form)
        for s in range(slots):
            at, value = s * words // slots, int(values ** rng.random())
            own[at : at + 6] = [f"s{s}v{value}w{i}" for i in range(6)]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("chunk", "tiled"), [(4, 1000), (16, 3), (16, 0)])
def test_groups_beyond_a_chunk_miss_no_link(spark, chunk, tiled):
    rows = list(enumerate(form_letters(random.Random(chunk), 250)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 2 < len({c for _, c, _ in want}) < 250
    assert result(df, chunk=chunk, tiled=tiled) == want


def test_long_texts_and_shared_passage(spark):
    rng = random.Random(4)
    passage, long = prose(rng, "en", 60), prose(rng, "fr", 8000)
    texts = [f"{prose(rng, 'de', 200)} {passage} {prose(rng, 'de', 200)}" for _ in range(30)]
    texts += [long, long.replace(" ", " new ", 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(df) == brute(list(enumerate(texts)))


def test_empty(empty):
    assert op.near_classes(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_banded_distance(a, b, limit):
    d, x, y = distance(a, b), np.array(a, np.uint64), np.array(b, np.uint64)
    assert op.banded_distance(x, y, limit) == (d if d <= limit else None)
    with pytest.MonkeyPatch.context() as m:  # masks of very long texts, forgotten at once
        m.setattr(op, "MASK_BYTES", -1)
        rows = op._LongRows(x)
        for v in range(4):
            assert rows.get(v, 0) == sum(1 << i for i, z in enumerate(a, 1) if z == v) and len(rows) <= 1


def test_alignment_of_very_long_texts():
    rng = np.random.default_rng(3)
    a = rng.integers(3000, size=20_000).astype(np.uint64)
    b = np.delete(a, np.arange(0, 20_000, 40))
    assert op.banded_distance(a, b, 4000) == op.banded_distance(b, a, 500) == 500
    assert op.banded_distance(a, b, 499) is None
    assert op.banded_distance(a, np.concatenate([a[10_000:], a[:10_000]]), 4000) is None


def test_sketches_depend_on_order_and_repeats():
    rng = np.random.default_rng(0)
    kmers = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    share = lambda x: np.mean(op.order_minhash(kmers, 400, picks=5) == op.order_minhash(x, 400, picks=5))
    moved = np.concatenate([kmers[200:], kmers[:200]])
    assert share(kmers) == 1 and share(moved) < 0.2 and share(kmers[40:]) > 0.4
    assert share(np.concatenate([kmers, kmers[:100]])) < 1
    long = np.tile(kmers, 4000)  # so long that sketches are taken one at a time
    assert op.order_minhash(long, 3).tolist() == [op.order_minhash(long, 1, i)[0] for i in range(3)]
