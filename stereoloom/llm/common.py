"""Shared pieces of the corpus operators: durable cuts, sizing, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoloom.plans import durable as durable_cuts

MAX_ID = (1 << 63) - 1
#: Text that one grouped task holds at a time, as compressed input bytes.
GROUP_BYTES = 8 << 20
#: Text bytes that the numpy kernels look at in one go.
SLICE_BYTES = 2 << 20

_SPLIT = np.uint64(30), np.uint64(27), np.uint64(31)
_MULT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE_STEP = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64((1 << 61) - 1)
_GRAM_BASE = 0xD6E8FEB86659FD93
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Values that are multiplied at a time, so that the steps stay in a core's cache.
_BLOCK = 1 << 14
_HALF, _LOW_HALF = np.uint64(31), np.uint64((1 << 31) - 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured, a local session gets a local one (tests); a cluster raises."""
    return durable_cuts.shared_dir(spark)


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    The files outlive any executor, so later stages never recompute what is
    upstream, and a re-read gives the same rows however tasks are retried.
    """
    return durable_cuts.durable(df, name)


def input_bytes(df: DataFrame, text_column: str = "text") -> int:
    """File sizes of the scans that the plan rests on, known without a job; a plan's own estimate multiplies joined sides.

    Rows that come from no file have no estimate; their text is summed then.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size < 1 << 55:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0))).first()[0]


def group_count(df: DataFrame, per_group: int = GROUP_BYTES) -> int:
    """How many hash groups keep a group near ``per_group`` bytes; follows the input, has no cap."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // per_group))


def group_of(*columns, n: int):
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64; the input array is not changed."""
    x = x ^ (x >> _SPLIT[0])
    x *= _MULT[0]
    x ^= x >> _SPLIT[1]
    x *= _MULT[1]
    x ^= x >> _SPLIT[2]
    return x


def folded(x: np.ndarray) -> np.ndarray:
    """An equal number modulo 2**61 - 1, at most 2**61 + 6."""
    return (x & PRIME) + (x >> np.uint64(61))


def reduced(x: np.ndarray) -> np.ndarray:
    """uint64 modulo the prime 2**61 - 1."""
    x = folded(x)
    x[x >= PRIME] -= PRIME
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of folded numbers (the result is folded too), from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _HALF, a & _LOW_HALF, b >> _HALF, b & _LOW_HALF
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a0 *= b0
    return _joined(middle, a0 + (a1 << np.uint64(1)))


def _joined(middle: np.ndarray, rest: np.ndarray) -> np.ndarray:
    rest += middle >> np.uint64(30)
    middle &= np.uint64((1 << 30) - 1)
    middle <<= _HALF
    rest += middle
    return folded(rest)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**61 - 1."""
    out, step = np.ones(1, dtype=np.uint64), base % int(PRIME)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.uint64(step))])
        step = step * step % int(PRIME)
    return reduced(out[:n])


class PowerTable:
    """Powers of a base and of its inverse modulo 2**61 - 1, grown on demand."""

    def __init__(self, base: int):
        self.base = base % int(PRIME)
        self.inverse = pow(self.base, -1, int(PRIME))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up, self.down


_gram_powers = PowerTable(_GRAM_BASE)
_place_codes = np.empty(0, dtype=np.uint64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: PowerTable) -> np.ndarray:
    """Mixed polynomial hash of ``values[start:end]`` for every span, by prefix sums modulo 2**61 - 1.

    The modulus is a prime: modulo a power of two, sequences that double by
    their own complement (of 1,024 values, say) collide for every base.
    """
    up, down = table.upto(len(values) + 1)
    high, low = np.zeros(len(values) + 1, dtype=np.uint64), np.zeros(len(values) + 1, dtype=np.uint64)
    for i in range(0, len(values), _BLOCK):
        some = values[i : i + _BLOCK]
        j = i + len(some)
        term = times(folded(some), up[i:j])
        np.right_shift(term, np.uint64(32), out=high[i + 1 : j + 1])
        np.bitwise_and(term, np.uint64(0xFFFFFFFF), out=low[i + 1 : j + 1])
    np.cumsum(high, out=high)  # neither sum overflows below 2**32 values
    np.cumsum(low, out=low)
    high, low = high[ends] - high[starts], low[ends] - low[starts]
    total = folded((((high << np.uint64(32)) & PRIME) | (high >> np.uint64(29))) + folded(low))
    return mix(reduced(times(total, down[starts])) + (ends - starts).astype(np.uint64))


class WrappedPowers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            run = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, b, dtype=np.uint64)]))
            self.up, self.down = run(self.base), run(self.inverse)
        return self.up, self.down


def wrapped_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: WrappedPowers) -> np.ndarray:
    """As ``span_hashes`` modulo 2**64, for buckets of features only: some sequences collide, so nothing may be told by these."""
    up, down = table.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def separator_table(kind: str) -> np.ndarray:
    """Which bytes end a word: ``space`` is ASCII white space, ``plain`` all ASCII but letters, digits, ``_``."""
    out = np.zeros(256, dtype=bool)
    if kind == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:128] = True
        out[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F]] = False
    return out


SPACE, PLAIN = separator_table("space"), separator_table("plain")


def words_of(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and 64-bit hashes of the words of one text, sliced so that memory stays bounded."""
    size = len(data)
    if size <= SLICE_BYTES:
        return _words_of_slice(np.frombuffer(data, dtype=np.uint8), separators)
    parts, at = [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while at < size:
        to = min(size, at + SLICE_BYTES)
        if to < size:
            gaps = np.flatnonzero(separators[raw[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # a word longer than a slice is hashed whole
                step = to
                while step < size and not separators[raw[step]]:
                    step += 1
                to = step
        s, e, h = _words_of_slice(raw[at:to], separators)
        parts.append((s + at, e + at, h))
        at = to
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _words_of_slice(raw: np.ndarray, separators: np.ndarray):
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    return starts, ends, _word_hashes(raw, starts, ends)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed sums over a word's bytes of the byte's code times the code of its place in the word; both are random, so no pattern of bytes cancels."""
    global _place_codes
    longest = int((ends - starts).max()) + 1
    if len(_place_codes) < longest:
        _place_codes = mix(np.arange(1, 2 * longest + 1, dtype=np.uint64) * _PLACE_STEP) | np.uint64(1)
    begin = np.zeros(len(raw), dtype=np.int32)
    begin[starts] = starts
    place = np.arange(len(raw), dtype=np.int32) - np.maximum.accumulate(begin)
    np.minimum(place, longest, out=place)  # gaps between words count for nothing
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[raw] * _place_codes[place], out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * _PLACE_STEP)


class Words:
    """The words of several texts laid end to end.

    ``doc`` is the text's index for every word, ``first`` the index of each
    text's first word (one more entry closes the last text).
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray):
        found: list = [None] * len(texts)
        i = 0
        while i < len(texts):  # short texts share one pass
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) + 1 <= SLICE_BYTES):
                size += len(texts[j]) + 1
                j += 1
            if j == i + 1:
                found[i] = words_of(texts[i], separators)
            else:
                self._shared(texts, i, j, separators, found)
            i = j
        self.counts = np.array([len(x[2]) for x in found], dtype=np.int64)
        self.first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(self.counts, out=self.first[1:])
        join = lambda k, kind: np.concatenate([x[k] for x in found]) if found else np.empty(0, dtype=kind)
        self.starts, self.ends, self.hashes = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    @staticmethod
    def _shared(texts, i, j, separators, found):
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        s, e, h = _words_of_slice(np.frombuffer(b"\n".join(texts[i:j]) + b"\n", dtype=np.uint8), separators)
        cut = np.searchsorted(s, offsets)
        for k in range(j - i):
            a, b = cut[k], cut[k + 1]
            found[i + k] = (s[a:b] - offsets[k], e[a:b] - offsets[k], h[a:b])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
        total = np.zeros(n - k + 1, dtype=np.uint64)
        base = np.uint64(_GRAM_BASE | 1)
        for i in range(k):
            total *= base
            total += self.hashes[i : n - k + 1 + i]
        return mix(total), self.doc[: n - k + 1] == self.doc[k - 1 :]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the word sequences between word indices."""
        return span_hashes(self.hashes, starts, ends, _gram_powers)


def chunks(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges that hold at most ``most`` bytes each (a longer text is alone)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
