"""BPE encoding and decoding of whole texts, by a pair occurrence index.

Words come from the vocabulary's own pattern; the distinct words of an Arrow
batch are merged together (see ``pair_bpe``), and ids are gathered back per
text. Special tokens are found first, as the tokenizers library does.

Cases: a null or empty text has no ids. Rows repeated, or with a null id, are
encoded like any other; the id is only carried. An empty table gives an empty
result. Other columns, whatever their names, are not read. Bytes that are not
UTF-8 after decoding become U+FFFD. Batches are bounded by bytes, so one very
long text is the most that memory must hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm import pair_bpe
from meshnet.plans.scratch import bound_arrow_batches
from meshnet.plans.tables import read_table

class Codec(pair_bpe.TextEncoder):
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(map(self._byte_of.__getitem__, token))
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self._bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._byte_starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8."""
        data, lens = pair_bpe.gather(self._bytes, self._byte_starts, ids.astype(np.int64))
        upto = np.concatenate([[0], np.cumsum(lens)])
        edge = upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
        whole = data.tobytes()
        out = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            piece = whole[lo:hi]
            try:
                piece.decode()
            except UnicodeDecodeError:
                piece = piece.decode("utf-8", "replace").encode()
            out.append(piece)
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this process for ``path``."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of each row; or, with ``digests``, their count and SHA-256.

    The digests are taken where the ids are made, so they need not leave the task.
    """
    bound_arrow_batches(df.sparkSession, 32 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in pair_bpe.slices(texts):
                ids, counts = own.encode(texts[lo:hi])
                decoded = own.decode(ids, counts)
                edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
                if digests:
                    raw = ids.astype("<u4").tobytes()
                    columns = [
                        pa.array(counts, pa.int64()),
                        [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)],
                        [hashlib.sha256(x).hexdigest() for x in decoded],
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32))),
                        [x.decode() for x in decoded],
                    ]
                    names = ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *(c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns)],
                    names,
                )

    schema = (
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        if digests
        else "doc_id long, ids array<int>, decoded string"
    )
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_decode(read_table(spark, sf_dir, "documents"), path, digests=True)


SQL = None
