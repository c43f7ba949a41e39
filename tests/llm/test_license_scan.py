import random

import numpy as np
import pytest

from meshnet.llm import license_scan as op
from meshnet.llm.near_dedup import shingles, words_of


@pytest.fixture(scope="module")
def known():
    return op.Templates(op.TEMPLATES)


def found(known, text):
    words = words_of(text)
    return known.matches(shingles(words, 5)) if len(words) >= 5 else []


@pytest.mark.parametrize("name", op.TEMPLATES)
@pytest.mark.parametrize("shift", [0, 1, 7, 100])
def test_template_at_any_place(known, name, shift):
    rng = random.Random(shift)
    filler = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    text = f"{filler(shift)} {op.TEMPLATES[name].upper()} {filler(300)}"
    match = [m for m in found(known, text) if m[0] == name]
    assert len(match) == 1 and match[0][3] == 1.0
    first = len(words_of(filler(0))) + len(words_of(text.split(op.TEMPLATES[name].upper())[0]))
    assert match[0][1:3] == (first, first + len(words_of(op.TEMPLATES[name])))


def test_changed_template(known):
    words = op.TEMPLATES["MIT"].split()
    words[40] = words[80] = "other"
    assert [m[0] for m in found(known, " ".join(words))] == ["MIT"]  # 10 of about 90 shingles are lost
    for i in range(0, len(words), 8):
        words[i] = "other"
    assert not found(known, " ".join(words))


@pytest.mark.parametrize("name", op.TEMPLATES)
@pytest.mark.parametrize("gap", [1, 3, 60])
def test_copies_beside_each_other_stay_apart(known, name, gap):
    n, between = len(words_of(op.TEMPLATES[name])), " ".join(f"w{i}" for i in range(gap))
    text = f" {between} ".join([op.TEMPLATES[name]] * 3)
    spans = [m[1:] for m in found(known, text) if m[0] == name]
    assert spans == [(i * (n + gap), i * (n + gap) + n, 1.0) for i in range(3)]


def test_moved_halves_are_one_match(known):
    words = op.TEMPLATES["Apache-2.0"].split()
    text = " ".join(["start", *words[30:], "middle", *words[:30], "end"])
    spans = [m[1:3] for m in found(known, text) if m[0] == "Apache-2.0"]
    assert len(spans) == 1 and spans[0][0] == 1 and spans[0][1] == len(words_of(text)) - 1


def test_same_as_brute_force(known, corpus):
    rng = random.Random(2)
    names = list(op.TEMPLATES)
    for text in [t for t in corpus[0] if t]:
        words = text.split(" ")
        words.insert(rng.randint(0, len(words)), op.TEMPLATES[rng.choice(names)])
        own = shingles(words_of(" ".join(words)), 5)
        want = {n for n, t in known.sets.items() if np.isin(t, own).mean() >= 0.8}
        assert {m[0] for m in known.matches(own)} == want


def test_very_long_text_in_stretches(known, monkeypatch):
    monkeypatch.setattr(op, "STRETCH", 64)
    text = " ".join(f"w{i}" for i in range(500)) + " " + op.TEMPLATES["Apache-2.0"] + " " + " ".join(f"v{i}" for i in range(300))
    assert {m[0] for m in found(known, text)} == {"Apache-2.0", "Apache-2.0-notice"}
    assert all(m[3] == 1.0 for m in found(known, text))


def test_dataframe(spark, docs, empty):
    notice = op.TEMPLATES["MIT-notice"]
    more = spark.createDataFrame([(900, f"x y {notice} z"), (900, f"x y {notice} z"), (None, notice)], "doc_id long, text string")
    rows = op.scan_licenses(docs.select("doc_id", "text").unionByName(more)).collect()
    assert sorted((str(r.doc_id), r.license, r.first_word, r.end_word, r.matched) for r in rows) == [
        ("900", "MIT-notice", 2, 7, "released under the mit license")
    ] * 2 + [("None", "MIT-notice", 0, 5, "released under the mit license")]
    assert op.scan_licenses(docs).count() == 0 and op.scan_licenses(empty).count() == 0


def test_shingles_have_five_words(known):
    assert len(known.sets["MIT-notice"]) == 1
    assert not found(known, "it was released under the mit licence and released under the mit terms")


def test_short_template_is_refused():
    with pytest.raises(ValueError):
        op.Templates({"short": "only four words here"})
