import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshnet.llm import bpe_codec, packing

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "aaaa aaaaaaa  bbb\n\n x", "hi<|endoftext|>  there <|endoftext|><|endoftext|>", "<|startoftext|>it's IT'S",
    "日本語 テキスト \x1c\x1d a", "é é x 𝔘 ٣٤ İ ΑΣ Σ ﬁ K", "​﻿ zz\u0085 ", "x" * 3000, "ƁəƏ 1234567",
    "".join(map(chr, range(0x250))), "a\r\n\t b  \n", "".join(map(chr, range(0x2000, 0x2070))),
]


@pytest.fixture(scope="module", params=[BYTE, WORD])
def pair(request):
    return (bpe_codec.codec(BYTE) if request.param == BYTE else packing.encoder(WORD)), Tokenizer.from_file(request.param)


def ids_of(own, texts):
    ids, counts = own.encode(texts)
    edge = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def test_ids_of_the_library(pair, corpus):
    own, library = pair
    texts = ODD + [t for t in corpus[0] if t]
    assert ids_of(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_plain_character(pair):
    own, library = pair
    texts = [f"a{c}{c}b 1{c} !{c} {c}" for c in map(chr, [*range(0x180), *range(0x2010, 0x2028)])]
    assert ids_of(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(texts):
    for path, own in ((BYTE, bpe_codec.codec(BYTE)), (WORD, packing.encoder(WORD))):
        library = Tokenizer.from_file(path) if path not in _LIBRARY else _LIBRARY[path]
        _LIBRARY[path] = library
        assert ids_of(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


_LIBRARY: dict = {}


def test_decoding_is_the_library_s(pair):
    own, library = pair
    if not isinstance(own, bpe_codec.Codec):
        return
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 50257, n) for n in (0, 1, 5, 200)]  # mostly no valid UTF-8
    got = own.decode(np.concatenate(runs), np.array([len(r) for r in runs]))
    assert [g.decode() for g in got] == [library.decode(r.tolist(), skip_special_tokens=False) for r in runs]


def test_query_columns(docs):
    library = Tokenizer.from_file(BYTE)
    got = {}
    for r in bpe_codec.encode_decode(docs, BYTE, digests=True).collect():
        got.setdefault(r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256))
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        )


def test_round_trip_and_empty(docs, empty):
    rows = bpe_codec.encode_decode(docs, BYTE).collect()
    texts = sorted((r.text or "") for r in docs.collect())
    assert sorted(r.decoded for r in rows) == texts
    assert bpe_codec.encode_decode(empty, BYTE).count() == 0


def test_cache_limit_changes_nothing(corpus):
    texts = [t for t in corpus[0] if t]
    own = bpe_codec.Codec(BYTE)
    own._cache.most = 5
    assert [ids_of(own, [t])[0] for t in texts] == ids_of(bpe_codec.codec(BYTE), texts)
