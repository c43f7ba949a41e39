import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshnet.llm import packing as op

WORD = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    packs = op.shortest_pack_first(histogram, 64)
    held = Counter()
    for count, lengths in packs:
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            held[n] += count
    assert held == Counter(histogram)
    slots, seen = op.Slots(packs), defaultdict(list)
    for n, many in histogram.items():
        sequence, offset = slots.place(np.full(many, n), np.arange(many))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            seen[s].append((o, n))
    assert sorted(seen) == list(range(slots.sequences))
    for pieces in seen.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=15), st.sampled_from([40, 64, 100]))
def test_same_packs_as_piece_by_piece(histogram, size):
    """Each piece, longest first, into the pack with the most room; packs of equal room are alike from there on."""
    filled = []
    for length in sorted((n for n, many in histogram.items() for _ in range(many)), reverse=True):
        least = min(range(len(filled)), key=filled.__getitem__, default=None)
        if least is not None and filled[least] + length <= size:
            filled[least] += length
        else:
            filled.append(length)
    got = Counter()
    for count, lengths in op.shortest_pack_first(histogram, size):
        got[sum(lengths)] += count
    assert got == Counter(filled)


def test_longest_first_into_most_room():
    # 6 and 5 open packs; 4 goes where 5 left most room, 3 then where 6 did.
    assert sorted(op.shortest_pack_first({6: 1, 5: 1, 4: 1, 3: 1}, 10)) == [(1, (5, 4)), (1, (6, 3))]


@pytest.mark.parametrize("size", [4096, 64])
def test_pieces(docs, size):
    library = Tokenizer.from_file(WORD)
    rows = op.pack(docs, WORD, size=size, with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        want[tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 2])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    got = Counter()
    for pieces in by_doc.values():  # a repeated row repeats all its pieces
        starts = Counter(p.start for p in pieces)
        times = next(iter(starts.values()))
        assert set(starts.values()) == {times}
        ids = [x for _, p in sorted({p.start: p for p in pieces}.items()) for x in p.ids]
        assert {p.doc_tokens for p in pieces} == {len(ids)}
        got[tuple(ids)] += times
    assert got == want
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    full = sum(r.length for r in rows)
    assert full / (size * len(by_sequence)) > 0.85


def test_empty(empty):
    assert op.pack(empty, WORD).count() == 0
