"""Substring dedup by suffix automata of reference shards.

The corpus is its own reference, which has no size bound, so the automata are
not sent to every executor: the reference is cut into shards by content, and
each shard's automaton lives in the task that the matching text is routed to.

1. Every window of ``window`` words owns an anchor, the least hash of the
   ``GRAM``-word sequences inside it (a minimizer). Equal windows own equal
   anchors, so a window can only repeat if its anchor does. Neighbouring
   windows with one anchor form a run.
2. Anchors that occur once in the whole corpus are set aside (no window of
   theirs repeats). The others send their runs' words to the shard that the
   anchor's hash names. Identical runs of one group of documents travel once,
   runs of a shard with identical words are one reference text.
   An anchor with very many different runs (the edge of a passage that many
   documents share, each going on in its own way) would fill one task. Its
   runs are cut into single windows, each its own anchor; windows that occur
   once are set aside in turn, and the others go to shards of their own.
3. Each shard builds suffix automata over its reference texts in order of
   (document, start) and streams every text through: at each word, the
   matching statistic is cut to ``window`` words and the state's first end
   position tells where this word sequence starts first.
4. The windows that start earlier elsewhere go back to the documents, which
   lose the union of those windows.

A smaller outside reference can be given instead (``remove_reference_spans``);
its automata are broadcast after a check of their size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.llm import common as c

WINDOW = 20
GRAM = 8
#: Words of reference text in one automaton; an anchor's texts stay together.
AUTOMATON_WORDS = 20_000
#: Different runs of one anchor that stay together; the runs of an anchor with more are cut into windows.
ANCHOR_RUNS = 2_048


class SuffixAutomaton:
    """Suffix automaton over a sequence of hashable symbols, with the first end position of every state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def extend(self, symbol) -> None:
        next_, link, length = self.next, self.link, self.length
        here = len(next_)
        next_.append({})
        length.append(length[self.last] + 1)
        self.first_end.append(self.size)
        link.append(0)
        p = self.last
        while p >= 0 and symbol not in next_[p]:
            next_[p][symbol] = here
            p = link[p]
        if p >= 0:
            q = next_[p][symbol]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(next_)
                next_.append(next_[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.first_end.append(self.first_end[q])
                while p >= 0 and next_[p].get(symbol) == q:
                    next_[p][symbol] = copy
                    p = link[p]
                link[q] = link[here] = copy
        self.last = here
        self.size += 1

    def first_ends(self, symbols, window: int) -> list[int]:
        """For each symbol, the first end position of the ``window`` symbols up to it, -1 if they do not occur."""
        next_, link, length, first = self.next, self.link, self.length, self.first_end
        out, state, matched = [], 0, 0
        for symbol in symbols:
            while state and symbol not in next_[state]:
                state = link[state]
                matched = length[state]
            to = next_[state].get(symbol)
            if to is None:
                out.append(-1)
                continue
            state, matched = to, matched + 1
            while matched > window and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                out.append(first[state])
            else:
                out.append(-1)
        return out


class _Runs:
    """The runs of windows that share an anchor, over several texts laid end to end."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = w = c.Words(texts, c.SPACE)
        n = len(w.hashes)
        self.start = self.count = self.doc = self.local = np.empty(0, dtype=np.int64)
        self.anchor = self.content = np.empty(0, dtype=np.uint64)
        if n < window:
            return
        k = min(GRAM, window)
        grams, _ = w.grams(k)
        reach = window - k + 1
        owner = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1)
        owner += np.arange(len(owner))
        whole = w.doc[: n - window + 1] == w.doc[window - 1 :]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        own = owner[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
        head = np.flatnonzero(new)
        self.start = at[head]
        self.count = np.diff(np.append(head, len(at)))
        self.anchor = grams[own[head]]
        shape = (own[head] - self.start).astype(np.uint64) * np.uint64(1 << 20) + self.count.astype(np.uint64)
        self.content = c.mix(w.spans(self.start, self.start + self.count + window - 1) ^ c.mix(shape))
        self.doc = w.doc[self.start]
        self.local = self.start - w.first[self.doc]

    def windows_of(self, hot: np.ndarray, window: int) -> _Runs:
        """The same runs, but those of the sorted anchors ``hot`` cut into windows that are their own anchors."""
        cut = _among(hot, self.anchor)
        if not cut.any():
            return self
        rest, w = ~cut, self.words
        count = self.count[cut]
        start = np.repeat(self.start[cut], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        content = w.spans(start, start + window)
        self.start = np.concatenate([self.start[rest], start])
        self.count = np.concatenate([self.count[rest], np.ones(len(start), dtype=np.int64)])
        self.anchor = np.concatenate([self.anchor[rest], c.mix(content ^ _WINDOW_KEY)])
        self.content = np.concatenate([self.content[rest], content])
        self.doc = w.doc[self.start]
        self.local = self.start - w.first[self.doc]
        return self


_WINDOW_KEY = np.uint64(0x1F83D9ABFB41BD6B)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted array ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _hashes(column) -> np.ndarray:
    return np.unique(np.asarray(column).astype(np.int64).view(np.uint64))


def _ids(column) -> list[int]:
    return [c.MAX_ID if x is None else x for x in column.to_pylist()]


def _counted(anchors: list[np.ndarray], contents: list[np.ndarray], groups: list[np.ndarray]) -> pa.RecordBatch:
    """(anchor, grp, twice, variants): whether the anchor occurs more than once, and with how many contents."""
    a, k, g = np.concatenate(anchors), np.concatenate(contents), np.concatenate(groups)
    order = np.lexsort((k, a, g))
    a, k, g = a[order], k[order], g[order]
    head = np.ones(len(a), dtype=bool)
    head[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
    other = head.copy()
    other[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(head)
    many = np.diff(np.append(at, len(a))) > 1
    variants = np.add.reduceat(other.astype(np.int64), at) if len(at) else np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c.signed(a[at])), pa.array(g[at].astype(np.int32)), pa.array(many), pa.array(variants)], schema=_COUNT_SCHEMA)


_COUNT_SCHEMA = pa.schema([("anchor", pa.int64()), ("grp", pa.int32()), ("twice", pa.bool_()), ("variants", pa.int64())])


def _anchors(window: int):
    def run(batches):
        for batch in batches:
            texts, group = c.utf8(batch.column(0)), np.asarray(batch.column(1))
            runs = [(i, j, _Runs(texts[i:j], window)) for i, j in c.chunks(texts)]
            if runs:
                yield _counted([r.anchor for _, _, r in runs], [r.content for _, _, r in runs], [group[i:j][r.doc] for i, j, r in runs])

    return run


def _hot_windows(window: int):
    """The windows that a group's documents have at hot anchors, as anchors of their own."""

    def run(docs: pa.Table, hot: pa.Table) -> pa.Table:
        if not hot.num_rows or not docs.num_rows:
            return _COUNT_SCHEMA.empty_table()
        grp, hashes, texts = hot.column("grp")[0].as_py(), _hashes(hot.column("anchor")), c.utf8(docs.column("text"))
        anchors = []
        for i, j in c.chunks(texts):
            r = _Runs(texts[i:j], window)
            plain = len(r.anchor) - int(_among(hashes, r.anchor).sum())
            anchors.append(r.windows_of(hashes, window).anchor[plain:])
        return pa.Table.from_batches([_counted(anchors, anchors, [np.full(len(a), grp) for a in anchors])])

    return run


def _pick(docs: pa.Table, hashes: np.ndarray, hot: np.ndarray, window: int):
    """Runs of one group's documents whose anchor is in the sorted ``hashes``; also each chunk's runs and texts."""
    texts, ids = c.utf8(docs.column("text")), np.array(_ids(docs.column("doc_id")), dtype=np.int64)
    for i, j in c.chunks(texts):
        r = _Runs(texts[i:j], window).windows_of(hot, window)
        yield i, j, texts, ids, r, np.flatnonzero(_among(hashes, r.anchor))


_RUN_SCHEMA = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()),
                         ("doc", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])


def _repeated_runs(window: int, shards: int):
    """The first occurrence in this group of every run whose anchor repeats somewhere."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not anchors.num_rows or not docs.num_rows:
            return _RUN_SCHEMA.empty_table()
        grp = anchors.column("grp")[0].as_py()
        is_hot = anchors.column("hot")
        hot, hashes = _hashes(anchors.filter(is_hot).column("anchor")), _hashes(anchors.filter(pc.invert(is_hot)).column("anchor"))
        best: dict[tuple[int, int], tuple] = {}
        for i, _, texts, ids, r, hit in _pick(docs, hashes, hot, window):
            w, doc = r.words, r.doc[hit]
            left, right = w.starts[r.start[hit]].tolist(), w.ends[r.start[hit] + r.count[hit] + window - 2].tolist()
            places = zip(ids[i + doc].tolist(), r.local[hit].tolist(), strict=True)
            for key, place, d, a, b in zip(zip(r.anchor[hit].tolist(), r.content[hit].tolist(), strict=True), places, doc.tolist(), left, right, strict=True):
                known = best.get(key)
                if known is None:
                    best[key] = (place, texts[i + d][a:b])
                elif place < known[0]:
                    best[key] = (place, known[1])
        keys = np.array(list(best), dtype=np.uint64).reshape(-1, 2)
        return pa.table([
            pa.array((keys[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(np.full(len(best), grp, dtype=np.int32)),
            pa.array(c.signed(keys[:, 0].copy())), pa.array(c.signed(keys[:, 1].copy())),
            pa.array([p[0] for p, _ in best.values()], pa.int64()), pa.array([p[1] for p, _ in best.values()], pa.int64()),
            pa.array([b" ".join(t.split()) for _, t in best.values()], pa.binary())], schema=_RUN_SCHEMA)

    return run


def _match(window: int):
    """One shard: suffix automata over the distinct runs, every run streamed through, answers for each sender."""

    def answers(items: list):
        """items: ((anchor, content, words), [first doc, first at, senders])."""
        items.sort(key=lambda x: (x[1][0], x[1][1]))
        automaton, base, sequences = SuffixAutomaton(), [], []
        for n, (key, _) in enumerate(items):
            words = key[2].split()
            sequences.append(words)
            base.append(automaton.size)
            for word in words:
                automaton.extend(word)
            automaton.extend(n)  # an end that no text contains
        for (key, run), words in zip(items, sequences, strict=True):
            doc, at = first = run[0], run[1]
            mask = bytearray()
            for k, end in enumerate(automaton.first_ends(words, window)[window - 1 :]):
                source = bisect_right(base, end) - 1
                there = items[source][1]
                mask.append((there[0], there[1] + end - base[source] - window + 1) < (doc, at + k))
            mask, later = bytes(mask), b"\1" * len(mask)
            for grp, doc, at in run[2]:  # elsewhere, every window of the run starts earlier in its first occurrence
                yield grp, key[0], key[1], mask if (doc, at) == first else later

    def run(batches):
        known: dict[tuple[int, int, bytes], list] = {}
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(1, 7)]
            for grp, anchor, content, doc, at, words in zip(*cols, strict=True):
                entry = known.get((anchor, content, words))
                if entry is None:
                    known[anchor, content, words] = [doc, at, [(grp, doc, at)]]
                else:
                    entry[2].append((grp, doc, at))
                    if (doc, at) < (entry[0], entry[1]):
                        entry[0], entry[1] = doc, at
        keys = sorted(known)
        i, out = 0, []
        while i < len(keys):
            j, size = i, 0
            while j < len(keys) and (size < AUTOMATON_WORDS or keys[j][0] == keys[j - 1][0]):
                size += keys[j][2].count(b" ") + 1
                j += 1
            out.extend(answers([(k, known.pop(k)) for k in keys[i:j]]))
            i = j
            if len(out) >= 50_000 or i >= len(keys):
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())],
                    names=["grp", "anchor", "content", "earlier"])
                out = []

    return run


_KEPT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _remove(window: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _KEPT_SCHEMA.empty_table()
        is_hot = marks.column("earlier").is_null()
        hot, marks = _hashes(marks.filter(is_hot).column("anchor")), marks.filter(pc.invert(is_hot))
        masks = dict(zip(zip(marks.column("anchor").to_pylist(), marks.column("content").to_pylist(), strict=True), marks.column("earlier").to_pylist(), strict=True))
        hashes = _hashes(marks.column("anchor"))
        raw_ids = docs.column("doc_id").to_pylist()
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        wanted = []
        for i, j, texts, ids, r, hit in _pick(docs, hashes, hot, window):  # where each run comes first in this group
            rows = []
            places = zip(ids[i + r.doc[hit]].tolist(), r.local[hit].tolist(), strict=True)
            keys = zip(c.signed(r.anchor[hit]).tolist(), c.signed(r.content[hit]).tolist(), strict=True)
            for key, place, start, count in zip(keys, places, r.start[hit].tolist(), r.count[hit].tolist(), strict=True):
                if key not in masks:
                    continue
                rows.append((key, place, start, count))
                if key not in seen or place < seen[key]:
                    seen[key] = place
            wanted.append((i, j, rows, r.words.first, len(r.words.hashes)))
        text_out, words_out, gone_out = [], [], []
        texts = c.utf8(docs.column("text"))
        for i, j, rows, first, total in wanted:
            cover = np.zeros(total + 1, dtype=np.int32)
            for key, place, start, count in rows:
                if place == seen[key]:
                    if 1 in masks[key]:
                        at = start + np.flatnonzero(np.frombuffer(masks[key], dtype=np.uint8))
                        cover[at] += 1
                        cover[at + window] -= 1
                else:  # the same run starts earlier in this group
                    cover[start] += 1
                    cover[start + 1 + window - 1 + count - 1] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            for d in range(j - i):
                a, b = int(first[d]), int(first[d + 1])
                words = texts[i + d].split()
                dead = gone[a:b]
                if dead.any():
                    words = [words[x] for x in np.flatnonzero(~dead).tolist()]
                text_out.append(b" ".join(words).decode())
                words_out.append(b - a)
                gone_out.append(int(dead.sum()))
        return pa.table([pa.array(raw_ids, pa.int64()), pa.array(text_out, pa.string()), pa.array(words_out, pa.int64()), pa.array(gone_out, pa.int64())], schema=_KEPT_SCHEMA)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window whose words also start earlier in the corpus.

    A window is ``window`` consecutive words (runs of non-white-space ASCII)
    of one row's ``text``. "Earlier" is a smaller ``doc_id`` or the same
    ``doc_id`` and an earlier start; windows are judged on the input. Returns
    per row: ``doc_id``, ``text`` (kept words joined by one space),
    ``n_words``, ``n_removed``.

    A null text has no words. A null ``doc_id`` comes after all others. Rows
    that repeat a ``doc_id`` count as one document for the order: equal starts
    do not remove each other. Other columns are left out.
    """
    n = c.group_count(docs)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), c.group_of(F.col("doc_id"), F.col("text"), n=n).alias("grp"))
    anchors = placed.select("text", "grp").mapInArrow(_anchors(window), "anchor long, grp int, twice boolean, variants long")
    repeated = c.durable(_repeated(anchors).withColumn("hot", F.col("all") > ANCHOR_RUNS).drop("all"), "anchors")
    grouped = placed.groupBy("grp")
    hot = repeated.filter("hot")
    if not hot.isEmpty():
        windows = grouped.cogroup(hot.groupBy("grp")).applyInArrow(_hot_windows(window), "anchor long, grp int, twice boolean, variants long")
        repeated = repeated.unionAll(_repeated(windows).select("anchor", "grp", F.lit(False).alias("hot")))
    runs = grouped.cogroup(repeated.groupBy("grp")).applyInArrow(_repeated_runs(window, n), "shard int, grp int, anchor long, content long, doc long, at long, words binary")
    marks = runs.repartition(n, "shard").mapInArrow(_match(window), "grp int, anchor long, content long, earlier binary")
    marks = marks.unionAll(hot.select("grp", "anchor", F.col("anchor").alias("content"), F.lit(None).cast("binary").alias("earlier")))
    return grouped.cogroup(marks.groupBy("grp")).applyInArrow(_remove(window), "doc_id long, text string, n_words long, n_removed long")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(anchor, grp, all) of the anchors that occur more than once; a window of a task has a row for each group of documents at most."""
    by_anchor = Window.partitionBy("anchor")
    anchors = anchors.groupBy("anchor", "grp").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.sum("variants").alias("variants"))
    many = (F.count("*").over(by_anchor) > 1) | F.max((F.col("n") > 1) | F.col("twice")).over(by_anchor)
    return anchors.withColumns({"many": many, "all": F.sum("variants").over(by_anchor)}).filter("many").select("anchor", "grp", "all")


def remove_reference_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Remove from each ``text`` the maximal spans of ``window`` words or more that occur in ``reference.text``.

    The reference must be small: its text is measured first, and one beyond
    ``most_bytes`` raises ValueError (use ``substring_dedup`` over the union
    instead). It is cut into shards of about ``shard_words`` words, one suffix
    automaton each, all broadcast. Returns ``doc_id, text, n_words,
    n_removed``; null texts have no words.
    """
    size = reference.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"the reference has {size} bytes of text, more than {most_bytes}")
    shards, words = [SuffixAutomaton()], 0
    for n, row in enumerate(reference.select("text").toLocalIterator()):
        sequence = (row[0] or "").encode().split()
        if words and words + len(sequence) > shard_words:
            shards.append(SuffixAutomaton())
            words = 0
        for word in sequence:
            shards[-1].extend(word)
        shards[-1].extend(n)
        words += len(sequence) + 1
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        for batch in batches:
            out = []
            for text in c.utf8(batch.column(1)):
                sequence = text.split()
                cover = np.zeros(len(sequence) + 1, dtype=np.int64)
                for automaton in held.value:
                    for end, first in enumerate(automaton.first_ends(sequence, window)):
                        if first >= 0:
                            cover[end - window + 1] += 1
                            cover[end + 1] -= 1
                dead = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([x for x, d in zip(sequence, dead.tolist(), strict=True) if not d])
                out.append((kept.decode(), len(sequence), int(dead.sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], schema=_KEPT_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def digest(kept: DataFrame) -> DataFrame:
    """The result's text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """What ``substring_dedup`` must return, by a dictionary of all windows (for tests)."""
    order = lambda d: c.MAX_ID if d is None else d
    first: dict[tuple, tuple] = {}
    split = [(order(d), (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key not in first or (d, s) < first[key]:
                first[key] = (d, s)
    out = []
    for d, words in split:
        dead = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (d, s):
                dead.update(range(s, s + window))
        kept = b" ".join(w for x, w in enumerate(words) if x not in dead)
        out.append((len(words), len(dead), hashlib.sha256(kept).hexdigest()))
    return out


#: DuckDB form of the digest over ``documents``: every window as a text, for tables whose windows fit one machine.
SQL = r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT d, i, array_to_string(words[i : i + 19], ' ') AS w FROM (SELECT d, words, unnest(range(1, len(words) - 18)) AS i FROM docs)),
later AS (SELECT d, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY d, i) > 1),
gone AS (SELECT DISTINCT d, unnest(range(i, i + 20)) AS place FROM later),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM (SELECT d, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs) ANTI JOIN gone USING (d, place) GROUP BY d)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (d)
"""
