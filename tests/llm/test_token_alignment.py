import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from meshnet.llm import pair_bpe, token_alignment

from .conftest import prose, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Columns of each text, token by token, from the libraries alone."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: b for b, c in enumerate(pair_bpe.byte_alphabet())}
    all_groups, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = model.encode(text)
            bytes_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
            names = [model.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names, strict=True)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = x = y = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        x += len(bytes_a[i])
                        left.append(a[i])
                        i += 1
                    else:
                        y += len(bytes_b[j])
                        right.append(b[j])
                        j += 1
                    if x == y:
                        groups.append((left, right))
                        left, right = [], []
        all_groups.append(groups)
        counts.update((g[-1], h[-1]) for g, h in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for groups in all_groups:
        links = [(g[-1], h[-1]) for g, h in groups]
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append(
            (
                sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links),
                hashlib.sha256(said.encode()).hexdigest() if groups else "",
            )
        )
    return out


TEXTS = [
    None, "", " ", "  ", "\n", "\n\n a", "a", "don't stop", " leading", "trailing ", "two  spaces\n\n  and   more \n ", "<|endoftext|>", "a<|endoftext|>b",
    "<s> and </s> <unk> <0x0A>", "▁", "a▁b", "naïve café, Straße", "日本語のテキスト", "🙂🙂 ok", "tab\tand\rcr\x0bvt\x00nul", "x" * 3000, "é" * 500, " " * 700, "é  nbsp  em",
    "12345 67.89 -- ++ ==", "A same line.", "A same line.", "A same line.",
]


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def want_of(texts, ids):
    return sorted(((i, *w) for i, w in zip(ids, brute(texts), strict=True)), key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + [prose(rng, lang, rng.randint(1, 80)) for lang in ("en", "fr", "de") for _ in range(8)]
    alphabet = "abc  \n\t.,'é▁日🙂01\x00<>|"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string, n_chars long, id long, key string, links long")
    want = want_of(texts, range(len(texts)))
    assert rows(token_alignment.align(docs.repartition(5), A, B)) == want
    monkeypatch.setattr(token_alignment, "SLICE", 50)
    monkeypatch.setattr(token_alignment, "HELD", 40)
    assert rows(token_alignment.align(docs.repartition(2), A, B)) == want


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows(token_alignment.query(spark, "/root/testdata/sf0.001")) == want_of([d.text for d in docs], [d.doc_id for d in docs])


def test_cases(spark, docs, corpus, empty):
    found = rows(token_alignment.align(docs, A, B))
    texts = [r.text for r in docs.collect()]
    assert len(found) == len(texts)
    assert [r[1:] for r in found] == [r[1:] for r in want_of(texts, [r.doc_id for r in docs.collect()])]
    assert rows(token_alignment.align(empty, A, B)) == []
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert rows(token_alignment.align(none, A, B)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_groups(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokenization"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_alignment.align(docs, A, B, with_groups=True).collect()}
    one = got[1]
    assert len(one.a_ends) == len(one.b_ends) == len(one.counts) == one.n_groups
    assert (one.a_ends[-1], one.b_ends[-1]) == (len(one.a), len(one.b)) == (one.n_a, one.n_b)
    said, lo = [], (0, 0)
    for hi in zip(one.a_ends, one.b_ends, strict=True):
        said.append(",".join(map(str, one.a[lo[0] : hi[0]])) + "|" + ",".join(map(str, one.b[lo[1] : hi[1]])))
        lo = hi
    assert hashlib.sha256(";".join(said).encode()).hexdigest() == one.groups_sha256
    assert got[2].a == [] and got[2].counts == []


@pytest.mark.parametrize("text", ["ab cd", "  x  y ", "\nq\n\n r", "tail  \n"])
def test_chunks_are_encoded_as_whole_texts(text):
    own = token_alignment.piece_encoder(B)
    ids, counts = own.encode([" " + text])
    assert ids.tolist() == own.model.encode(text) and counts.tolist() == [len(ids)]
