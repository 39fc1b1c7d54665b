"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ in k = floor(rate * n) words. Cut into k + 1
pieces, at least one piece of every occurrence is unedited, so exact hits of
piece hashes find all candidates; Myers' bit-parallel distance over the words
around a hit decides. Short items have k = 0 and must occur exactly.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereoloom.llm import common as c

EDIT_RATE = 0.2
#: Benchmark text that is held (and broadcast) at a time; a larger benchmark is read in several passes, one after the other.
BLOCK_BYTES = 16 << 20


def words_lower(texts: list[bytes]) -> c.Words:
    """Words of letters, digits and ``_`` (and all beyond ASCII), lower case."""
    return c.Words([t.decode().lower().encode() for t in texts], c.PLAIN)


def best_distance(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the m-symbol pattern to any substring of ``text``, and the end of the first such (Myers 1999).

    ``masks`` has a bit for each position of each of the pattern's symbols.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for at, symbol in enumerate(text):
        eq = get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


def _stretches(origins: list[int], budget: int, size: int, first: int, last: int):
    """Word ranges in which an item that may begin at one of the sorted ``origins`` lies whole; ranges that overlap become one."""
    a = b = None
    for origin in origins:
        low, high = max(first, origin - budget), min(last, origin + size + budget)
        if b is not None and low <= b:
            b = max(b, high)
            continue
        if b is not None:
            yield a, b
        a, b = low, high
    if b is not None:
        yield a, b


class ItemIndex:
    """Pieces of the items by length and hash."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = EDIT_RATE):
        self.ids, self.masks, self.sizes, self.budgets = [], [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        w = words_lower([t for _, t in items])
        for n, (item, _) in enumerate(items):
            a, b = int(w.first[n]), int(w.first[n + 1])
            size = b - a
            if not size:
                continue
            budget = int(rate * size)
            cuts = [a + size * x // (budget + 1) for x in range(budget + 2)]
            own = len(self.ids)
            for s, e in zip(cuts, cuts[1:], strict=False):
                h = int(w.spans(np.array([s]), np.array([e]))[0])
                pieces[e - s].append((h, own, s - a))
            masks: dict[int, int] = defaultdict(int)
            for i, h in enumerate(w.hashes[a:b].tolist()):
                masks[h] |= 1 << i
            self.ids.append(item)
            self.masks.append(dict(masks))
            self.sizes.append(size)
            self.budgets.append(budget)
        self.tables = {}
        for length, rows in pieces.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], dtype=np.uint64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.tables[length] = (hashes, [r[1:] for r in rows], seen)

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word after the match) of every item within its budget; the least distance, then the first end."""
        w = words_lower(texts)
        n = len(w.hashes)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for length, (hashes, owners, seen) in self.tables.items():
            if n < length:
                continue
            starts = np.arange(n - length + 1)
            rolled = w.spans(starts, starts + length)
            maybe = np.flatnonzero(seen[(rolled >> np.uint64(48)).astype(np.int64)] & (w.doc[: n - length + 1] == w.doc[length - 1 :]))
            left = np.searchsorted(hashes, rolled[maybe], side="left")
            right = np.searchsorted(hashes, rolled[maybe], side="right")
            for at, a, b in zip(maybe[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
                for own, offset in owners[a:b]:
                    places[int(w.doc[at]), own].add(at - offset)
        out = []
        for (d, own), origins in sorted(places.items()):
            size, budget = self.sizes[own], self.budgets[own]
            first, last = int(w.first[d]), int(w.first[d + 1])
            best = (budget + 1, 0)
            for a, b in _stretches(sorted(origins), budget, size, first, last):
                distance, end = best_distance(self.masks[own], size, w.hashes[a:b].tolist())
                best = min(best, (distance, a + end - first))
            if best[0] <= budget:
                out.append((d, self.ids[own], *best))
        return out


def _blocks(benchmark: DataFrame):
    """The benchmark's (item_id, text) in blocks of bounded bytes."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        text = (row[1] or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    yield block


def _index(held, rate: float) -> ItemIndex:
    return ItemIndex(held.value, rate)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """One row for each document row and item within ``rate`` word edits of some passage.

    Columns: ``doc_id``, ``item_id``, ``distance`` (least number of word
    edits), ``end_word`` (first such end). Words are compared in lower case
    without ASCII punctuation. Null and empty texts hold nothing, items
    without words, null ones among them, are not looked for. Repeated rows
    and items give repeated results; other columns are left out. A benchmark
    beyond ``BLOCK_BYTES`` takes one pass over the documents for each block;
    each pass is written before the next block is read, so the driver and
    the executors hold one block at a time.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), "text")
    parts = []
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            index = _index(held, rate)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), c.utf8(batch.column(1))
                rows = [(ids[i + d], item, distance, end) for i, j in c.chunks(texts) for d, item, distance, end in index.matches(texts[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "distance", "end_word"])

        part = source.mapInArrow(run, "doc_id long, item_id long, distance long, end_word long")
        if parts or after is not None:
            part = c.durable(part, "hits")
            held.destroy()
        parts.append(part)
        block = after
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay.

    Decided row by row without a join, so rows with equal or null doc_id are
    judged by their own text; null and empty texts stay. A benchmark beyond
    ``BLOCK_BYTES`` takes a pass for each block over what the one before left,
    each written before the next.
    """
    spark = docs.sparkSession
    out, where = docs, docs.columns.index("text")
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            index = _index(held, rate)
            for batch in batches:
                texts = c.utf8(batch.column(where))
                clean = np.ones(len(texts), dtype=bool)
                for i, j in c.chunks(texts):
                    for d, *_ in index.matches(texts[i:j]):
                        clean[i + d] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
        if after is not None:
            out = c.durable(out, "clean")
            held.destroy()
        block = after
    return out
