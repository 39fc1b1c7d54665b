"""Quality classifier by supervised subword embeddings.

Every token and its character n-grams hash into a table of learned vectors; a
document is the mean of its features' vectors, a softmax layer over it gives
the class. A token that repeats the one before it is read as one common token,
so runs of any word look alike. Trained by plain numpy stochastic gradient
descent on the driver over a sample of labelled rows that is bounded in rows
and in bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.llm import common as c
from stereoloom.llm.sampling import first_by_hash

#: Labelled rows that the model is fitted on, and bytes of their packed features; rows beyond either are left out, largest hash first.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 128 << 20
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 8
#: Few rows are gone over until they have given this many steps.
LEAST_STEPS = 16_000
RATE = 2.0
GRAM_LENGTHS = (2, 3, 4)
CACHE_TOKENS = 200_000
#: Texts whose unseen tokens are scored together.
TEXTS = 256
_POWERS = c.WrappedPowers(0x9E3779B97F4A7C15)
#: What a token that equals the one before it is read as; it holds white space, so no token of a text is written so.
REPEAT = " repeat "


def token_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token index, bucket) of every feature of the tokens: each token, and its character n-grams with ends marked.

    Hashes are polynomials over code points, all tokens at once.
    """
    owners, buckets = [], []
    for i, j in _parts(tokens):
        marked = [f"<{t}>" for t in tokens[i:j]]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum([len(m) for m in marked])
        starts = np.concatenate([[0], ends[:-1]])
        owner = np.repeat(np.arange(i, j), ends - starts)
        owners.append(np.arange(i, j))
        buckets.append(c.wrapped_hashes(codes, starts, ends, _POWERS) % np.uint64(BUCKETS))
        for n in GRAM_LENGTHS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h *= np.uint64(0x100000001B3)
                h += codes[k : len(codes) - n + 1 + k]
            whole = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][whole])
            buckets.append(c.mix(h[whole]) % np.uint64(BUCKETS))
    if not owners:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _parts(tokens: list[str], most: int = 1 << 18):
    """Index ranges of about ``most`` characters."""
    i = 0
    while i < len(tokens):
        j, size = i, 0
        while j < len(tokens) and (j == i or size + len(tokens[j]) <= most):
            size += len(tokens[j]) + 2
            j += 1
        yield i, j
        i = j


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    tokens = text.split()
    counted = Counter(REPEAT if a == b else b for a, b in zip([None, *tokens], tokens, strict=False))
    owner, bucket = token_features(list(counted))
    total = np.bincount(bucket, np.array(list(counted.values()), dtype=np.float64)[owner] if len(owner) else None, BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass
class QualityModel:
    """Only what scoring needs: each bucket's part of the log odds, and their offset."""

    odds: np.ndarray
    offset: float

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 17) -> QualityModel:
        """rows: label 0 or 1, buckets, counts. Without rows of both classes the offset alone decides."""
        positive = sum(r[0] for r in rows)
        if not 0 < positive < len(rows):
            return cls(np.zeros(BUCKETS, dtype=np.float32), 0.0 if not rows else 4.0 if positive else -4.0)
        random = np.random.default_rng(seed)
        vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        layer, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
        epochs = max(EPOCHS, -(-LEAST_STEPS // len(rows)))
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for i in random.permutation(len(rows)):
                label, at, n = rows[i]
                rate = np.float32(RATE * (1 - done / steps))
                done += 1
                if not len(at):
                    continue
                weight = n / n.sum()
                hidden = weight @ vectors[at]
                logits = layer @ hidden + bias
                p = np.exp(logits - logits.max())
                error = p / p.sum()
                error[label] -= 1
                back = error @ layer
                layer -= rate * np.outer(error, hidden)
                bias -= np.float32(0.1) * rate * error
                vectors[at] -= rate * np.outer(weight, back)
        return cls(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def features(docs: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> DataFrame:
    """Buckets and counts (packed) of every row's text, after its id (a long) as ``h`` and its label; a null text has none."""

    def run(batches):
        for batch in batches:
            out = [document_features(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([a.tobytes() for a, _ in out], pa.binary()), pa.array([n.tobytes() for _, n in out], pa.binary())], names=["h", "label", "at", "n"])

    return docs.select(F.col(id_column).cast("long"), label_column, "text").mapInArrow(run, "h long, label int, at binary, n binary")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on at most ``sample_rows`` labels (doc_id, quality), chosen by hash of doc_id, and their documents' texts.

    Labels other than 0 and 1 are left out, labels without a document teach
    nothing, and of documents that repeat a doc_id the first text teaches.
    What reaches the driver are the packed feature lists of those rows, at
    most ``sample_bytes`` of them in order of hash; their order does not
    matter.
    """
    chosen = first_by_hash(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct(), "doc_id", sample_rows)
    # the sample has a fixed size bound, so it can be sent to the documents
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    hashed = rows.select("quality", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    found = c.durable(features(hashed, "h"), "features")
    size = F.octet_length("at") + F.octet_length("n")
    within = Window.orderBy("h", "label").rowsBetween(Window.unboundedPreceding, 0)  # over sample_rows rows
    keys = found.select("h", "label", F.sum(size).over(within).alias("bytes")).filter(F.col("bytes") <= sample_bytes).agg(F.max("h")).first()[0]
    if keys is None:
        return QualityModel.fit([])
    got = [(r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in found.filter(F.col("h") <= keys).toLocalIterator()]
    return QualityModel.fit(sorted(got, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))


class _Tokens(dict):
    """Token to its row in a table of (sum of odds, number of features); unseen tokens are scored together."""

    def __init__(self, odds: np.ndarray, most: int):
        self.odds, self.most = odds.astype(np.float64), most
        self.sums, self.fresh = np.empty((0, 2), dtype=np.float64), []

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        self.fresh.append(token)
        return at

    def means(self, texts: list[str]) -> list[float | None]:
        """Mean odds of each text's features, None for a text without tokens."""
        if len(self) > self.most:
            self.clear()
            self.sums = self.sums[:0]
        places, repeat = [], self[REPEAT]
        for text in texts:
            tokens = text.split()
            at = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            if len(at):
                same = at[1:] == at[:-1]
                at[1:][same] = repeat
            places.append(at)
        if self.fresh:
            owner, bucket = token_features(self.fresh)
            new = np.stack([np.bincount(owner, self.odds[bucket], len(self.fresh)), np.bincount(owner, minlength=len(self.fresh))], axis=1)
            self.sums, self.fresh = np.concatenate([self.sums, new]), []
        out = []
        for at in places:
            if not len(at):
                out.append(None)
                continue
            odds, n = self.sums[at].sum(axis=0)
            out.append(float(odds / n))
        return out


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score`` (0 to 1, probability of label 1) and ``predicted`` for every whole text, with the ``keep`` columns.

    Empty and null texts have no features: the model's offset scores them.
    Repeated rows stay repeated. ``keep`` columns must not be called
    ``score`` or ``predicted``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tokens = _Tokens(held.value.odds, CACHE_TOKENS)
        for batch in batches:
            out, texts = [], [x or "" for x in batch.column(0).to_pylist()]
            for i in range(0, len(texts), TEXTS):
                for mean in tokens.means(texts[i : i + TEXTS]):
                    z = held.value.offset + (mean or 0.0)
                    out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=[*batch.schema.names[1:], "score", "predicted"])

    chosen = docs.select(F.col("text").alias("__text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, schema + ", score double, predicted int")
