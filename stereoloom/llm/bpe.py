"""Byte-level BPE encoding and decoding.

Each piece that the split pattern finds is merged on its own. A segment tree
over the piece's byte positions keeps the leftmost minimum of the pair ranks;
a merge changes only the leaves of the merged pair and of its two live
neighbours, each in logarithmic time, so a piece of n bytes costs
O(n log n) even if it is one very long run.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stereoloom.llm.common import utf8

#: Distinct pieces that a Python worker remembers; beyond them it starts afresh.
CACHE_PIECES = 700_000
#: Characters from which a text's pieces are not listed at once.
LONG_TEXT = 1 << 20
_NONE = 1 << 62
_AT = (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merge the leftmost pair of least rank until no pair has a rank."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << 32 | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def rank_at(i: int, end: int) -> int:
        r = get(piece[i:end])
        return _NONE if r is None else r << 32 | i

    while tree[1] != _NONE:
        i = tree[1] & _AT
        gone = after[i]
        end = after[i] = after[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if end < n:
            before[end] = i
            put(i, rank_at(i, after[end]))
        else:
            put(i, _NONE)
        if before[i] >= 0:
            put(before[i], rank_at(before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Piece to its ids as little-endian uint32 bytes."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self[piece] = array("I", merge_piece(piece.encode(), self.ranks)).tobytes()
        return got


class Codec:
    """Encoder and decoder over a rank table. Text is split by ``pattern``; there are no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE_PIECES):
        import regex

        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(ranks, cache)
        self.bytes_of: dict[int, bytes] = {v: k for k, v in ranks.items()}

    def encode_packed(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return b"".join(self.pieces[m[0]] for m in self.pattern.finditer(text))  # no list of all pieces

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ``ids``; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_held: dict[str, Codec] = {}


def held_codec(name: str, ranks, pattern: str) -> Codec:
    """The worker's codec: Spark's Python workers outlive their tasks, so pieces met in one task are known in the next."""
    if name not in _held:
        _held.clear()
        _held[name] = Codec(ranks.value, pattern)
    return _held[name]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", id_column: str = "doc_id",
               with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per input row: the id column, ``n_tokens`` long,
    ``ids_sha256`` (ids as little-endian uint32), ``decoded_sha256`` (the
    decoded bytes), and with ``with_ids`` also ``token_ids`` array<int>.
    Null and empty texts have no tokens. Repeated rows stay repeated; other
    input columns are left out. The rank table is read on the driver and
    broadcast: its size is the tokenizer's, whatever the corpus.
    """
    spark: SparkSession = docs.sparkSession
    table = load_ranks(ranks_path)
    ranks, name = spark.sparkContext.broadcast(table), hashlib.sha256(repr((pattern, sorted(table.items()))).encode()).hexdigest()

    def run(batches):
        codec = held_codec(name, ranks, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            count, digest, back, lists = [], [], [], []
            for raw in texts:
                packed = codec.encode_packed(raw.as_py() or "")
                tokens = array("I", packed)
                count.append(len(tokens))
                digest.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(tokens)).hexdigest())
                if with_ids:
                    lists.append(pa.array(tokens, pa.int32()))
            columns = [ids, pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([x.to_pylist() for x in lists], pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_column, text_column).mapInArrow(run, schema + (", token_ids array<int>" if with_ids else ""))


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_column: str = "token_ids", id_column: str = "doc_id") -> DataFrame:
    """Bytes of each id list as column ``decoded`` (binary); a null list gives null."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        bytes_of = {v: k for k, v in ranks.value.items()}
        for batch in batches:
            out = [None if x is None else b"".join(map(bytes_of.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_column, "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


__all__ = ["Codec", "bpe_decode", "bpe_encode", "load_ranks", "merge_piece", "utf8"]
