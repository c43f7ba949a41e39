"""BPE over a pair occurrence index.

The distinct words of many texts are laid out as one array of symbols with
links to their neighbours. Every adjacent pair that has a merge rank is filed
under that rank with all its positions. Ranks are then applied in ascending
order: all positions of a rank merge at once, and only the pairs beside them
are filed anew. So the work follows the number of distinct ranks, not of words.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Texts without such characters are split here, as their lower case has none either; others by the tokenizers library itself.
_BEYOND = re.compile("[^\x00-\u017f\u2010-\u2027]")


def _class(kind: str) -> str:
    """Characters of a general category below U+0250, to stand inside [ ]."""
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)


_L, _N, _S = _class("L"), _class("N"), "\t-\r \x85\xa0"
#: The word pattern of byte-level vocabularies, for plain texts; letters come first as they are most frequent.
BYTE_LEVEL_WORDS = re.compile(
    f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
#: The word pattern of lower-casing vocabularies with word ends, for plain texts.
WORD_END_WORDS = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Merges:
    """The vocabulary and merge ranks of a tokenizer file, ready for :meth:`encode`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        # The end-of-word mark stands only at the end of the right part, so joining strings is the merge.
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = max(vocab.values()) + 1
        key = self.left.astype(np.int64) * self.size + self.right
        self._by_key = np.argsort(key, kind="stable").astype(np.int32)
        self._keys = key[self._by_key]
        made = np.full(self.size, -1, np.int64)
        made[self.result[::-1]] = np.arange(len(pairs))[::-1]
        ranks = np.arange(len(pairs))
        if (made[self.left] >= ranks).any() or (made[self.right] >= ranks).any():
            raise ValueError("a merge uses a symbol that only a later merge makes")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._by_key[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and where each word starts (one more at the end)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum(lens)
        full = lens > 0
        starts = (ends - lens)[full]
        tail = ends[full] - 1
        sym = self.first[data]
        sym[tail] = self.last[data[tail]]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[tail] = -1
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(at: np.ndarray) -> None:
            r = self.rank(sym[at], sym[nxt[at]])
            hit = r >= 0
            at, r = at[hit], r[hit]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(r)]:
                k = int(r[lo])
                if k in index:
                    index[k].append(at[lo:hi])
                else:
                    index[k] = [at[lo:hi]]
                    heapq.heappush(ranks, k)
                lo = hi

        file(np.flatnonzero(nxt >= 0))
        mark = np.zeros(n, bool)
        while ranks:
            k = heapq.heappop(ranks)
            lists = index.pop(k)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, c = self.left[k], self.right[k], self.result[k]
            to = nxt[at]
            live = (sym[at] == a) & (to >= 0)
            live &= sym[to] == b
            at, to = at[live], to[live]
            if a == b and len(at) > 1:  # in a run of one symbol every second pair merges, from the left
                taken, keep, end = -1, np.ones(len(at), bool), to.tolist()
                for i, p in enumerate(at.tolist()):
                    if p == taken:
                        keep[i] = False
                    else:
                        taken = end[i]
                at, to = at[keep], to[keep]
            if not len(at):
                continue
            after = nxt[to]
            sym[at], sym[to] = c, -1
            nxt[at] = after
            inner = after >= 0
            prv[after[inner]] = at[inner]
            before = prv[at]
            before = before[before >= 0]
            mark[at] = True
            before = before[~mark[before]]
            mark[at] = False
            file(np.concatenate([at[inner], before]))
        alive = sym >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive].astype(np.uint32), upto[np.concatenate([[0], ends])]


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[w]:starts[w + 1]]`` for each w, in a row, and their lengths."""
    begin = starts[which]
    lens = starts[which + 1] - begin
    total = int(lens.sum())
    ends = np.cumsum(lens)
    flat = np.arange(total, dtype=np.int64) + np.repeat(begin - (ends - lens), lens)
    return values[flat], lens


class WordIds(dict):
    """Word to its number in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class WordCache:
    """Token ids of the words seen so far; new ones are encoded a batch at a time.

    It is emptied between batches when it holds more than ``most`` words; that
    bounds memory and changes no result.
    """

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.words, self.tokens, self.starts = WordIds(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, texts_of_words: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts in a row, and the number of ids of each text.

        Texts are taken one by one, so the words of one text alone are in memory besides the distinct ones.
        """
        if len(self.words) > self.most:
            self._empty()
        known = len(self.words)
        number = self.words.__getitem__
        numbered = [np.fromiter(map(number, words), np.int32, len(words)) for words in texts_of_words]
        counts = np.fromiter(map(len, numbered), np.int64, len(numbered))
        which = np.concatenate(numbered) if numbered else np.zeros(0, np.int32)
        del numbered
        if len(self.words) > known:
            fresh = list(self.words)[known:] if known else list(self.words)
            tokens, starts = self.encode(fresh)
            self.starts = np.concatenate([self.starts, starts[1:] + self.starts[-1]])
            self.tokens = np.concatenate([self.tokens, tokens])
        ids, lens = gather(self.tokens, self.starts, which)
        upto = np.concatenate([[0], np.cumsum(lens)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[edge[1:]] - upto[edge[:-1]]


def is_plain(text: str) -> bool:
    """Whether the patterns here split ``text`` just as the tokenizers library does."""
    return _BEYOND.search(text) is None


class TextEncoder:
    """Whole texts to ids, as ``encode(text, add_special_tokens=False)`` of the tokenizers library.

    Special tokens are found first; words then come from the patterns above or,
    for texts with other characters, from the library's own splitting.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.merges = load_merges(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items() if t.special}
        self._split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._lower = self.tokenizer.normalizer is not None
        self._cache = WordCache(self._encode_words)
        self._byte_of = {c: b for b, c in enumerate(byte_alphabet())}

    def _encode_words(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """A word is a string, or an int: a special token's own id."""
        tokens, starts = self.merges.encode([w.encode() if isinstance(w, str) else b"\0" for w in words])
        for i, w in enumerate(words):
            if isinstance(w, int):
                tokens[starts[i]] = w
        return tokens, starts

    def _words(self, text: str) -> list[str]:
        if is_plain(text):
            return WORD_END_WORDS.findall(text.lower()) if self._lower else BYTE_LEVEL_WORDS.findall(text)
        if self._lower:
            text = self.tokenizer.normalizer.normalize_str(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self._byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def words(self, text: str) -> list:
        """Words of ``text``; special tokens are ints."""
        if self._split is None or not any(s in text for s in self.special):
            return self._words(text)
        out, at = [], 0
        for m in self._split.finditer(text):
            if m.start() > at:
                out += self._words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(text[at:]) if at < len(text) else out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        return self._cache(map(self.words, texts))


def slices(texts: list[str], most: int = 4 << 20):
    """Ranges of rows with about ``most`` characters each, so that arrays stay small."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
