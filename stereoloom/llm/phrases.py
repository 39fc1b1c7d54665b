"""Collocations by suffix-sigma: phrases whose words meet far more often than their parts would by chance.

Each word of a piece opens a suffix of at most ``MAX_WORDS`` words. Suffixes
are dealt by language and first word, sorted in reverse lexicographic order,
and one stack per task counts every prefix: all phrases, in one pass and one
shuffle. The parts of a phrase are looked up afterwards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stereoloom.llm import common

MAX_WORDS = 5
LEAST = 100
TOP = 2000
#: Text that is cut into suffixes at a time.
CHUNK_BYTES = 8 << 20
#: Every how-manieth document tells which prefixes are hot; that moves rows between tasks, never a count.
SAMPLE = 32

_STOP, _STOPS = b"\xff", b".,;:!?\n\x0b\x0c\r"
#: A key is the language in hexadecimal digits and the words behind it, each after a zero byte.
_SUFFIXES = "key binary, deal long, n long"
_DEPTH = MAX_WORDS + 1


def _folded_byte(b: int) -> int:
    """A-Z folded; marks that end a piece become 0xFF, which no UTF-8 text has; controls move up by one, so that 0 sorts before all bytes of words."""
    if b in _STOPS:
        return 0xFF
    if b == 0x09:
        return 0x20
    return b + 32 if 65 <= b <= 90 else b + 1 if b < 0x09 else b


_FOLD = bytes(map(_folded_byte, range(256)))
_UNFOLD = bytes(0x20 if b == 0 else b - 1 if b <= 0x09 else b for b in range(256))


def _code(prefix: int, word: bytes) -> int:
    """A prefix and one word more, in 63 bits; texts alone decide, so all tasks agree on it."""
    return xxhash.xxh3_64_intdigest(word, seed=prefix) >> 1


def _tokens(texts: list[bytes]) -> Iterator[tuple[list[bytes], bool]]:
    """Words and piece ends of texts, a bounded part at a time, and whether the part ends at a text's end.

    A text that goes on hands the last words of a part to the next one.
    """
    for a, b in common.chunks(texts, CHUNK_BYTES):
        if len(texts[a]) <= CHUNK_BYTES:
            yield b"\xff".join(texts[a:b]).translate(_FOLD).replace(_STOP, b" \xff ").split(b" "), True
            continue
        text, at, carried = texts[a].translate(_FOLD), 0, []
        while at < len(text):
            to = text.find(b" ", at + CHUNK_BYTES)
            stop = text.find(_STOP, at + CHUNK_BYTES, to if to >= 0 else len(text))
            to = stop if stop >= 0 else to if to >= 0 else len(text)
            words = [w for w in carried + text[at:to].replace(_STOP, b" \xff ").split(b" ") if w]
            yield words, to == len(text)
            carried, at = words[1 - MAX_WORDS :], to


def _distinct(words: list[bytes], whole: bool):
    """The part's distinct suffixes as rows of word numbers (0 is none), how often each occurs, and the words by number."""
    number: dict = defaultdict(counter(1).__next__)
    number[b""] = number[_STOP] = 0
    ids = np.fromiter(map(number.__getitem__, filter(None, words)), np.int64)
    if whole:
        ids = np.concatenate([ids, np.zeros(MAX_WORDS - 1, np.int64)])
    starts = np.flatnonzero(ids[: max(len(ids) - MAX_WORDS + 1, 0)])
    names = [None, *[w for w in number if number[w]]]
    if not len(starts):
        return np.empty((0, MAX_WORDS), np.int64), np.empty(0, np.int64), names
    columns = [ids[starts]]
    for j in range(1, MAX_WORDS):  # nothing behind a piece's end
        columns.append(np.where(columns[-1] == 0, 0, ids[starts + j]))
    bits = max(len(names) - 1, 1).bit_length()
    per_key = min(63 // bits, MAX_WORDS)
    keys = []
    for a in range(0, MAX_WORDS, per_key):  # several numbers to an integer
        key = np.zeros(len(starts), np.int64)
        for column in columns[a : a + per_key]:
            key = key << bits | column
        keys.append(key)
    if len(keys) == 1:
        keys[0].sort()
    else:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
    new = np.ones(len(starts), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    edge = np.flatnonzero(new)
    rows = np.empty((len(edge), MAX_WORDS), np.int64)
    for j in range(MAX_WORDS):
        last = min(j // per_key * per_key + per_key, MAX_WORDS) - 1
        rows[:, j] = keys[j // per_key][edge] >> (bits * (last - j)) & ((1 << bits) - 1)
    return rows, np.diff(np.append(edge, len(starts))), names


def _runs(rows: np.ndarray, upto: int) -> np.ndarray:
    """Where runs of equal first ``upto`` columns begin."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:, :upto] != rows[:-1, :upto]).any(axis=1)]))


def _prefix_codes(lang: bytes, rows: np.ndarray, names: list, hot: frozenset) -> np.ndarray:
    """The code by which each suffix is dealt: that of its first word, or of its shortest prefix that is not hot."""
    out = np.zeros(len(rows), np.int64)
    root, todo = _code(0, lang), [(0, len(rows), 0, None)] if len(rows) else []
    while todo:
        a, b, level, prefix = todo.pop()
        column = rows[a:b, level]
        edges = np.append(np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])), b - a) + a
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            word = names[rows[i, level]]
            code = prefix if word is None else _code(root if prefix is None else prefix, word)
            out[i:j] = code
            if word is not None and level + 1 < MAX_WORDS and code in hot:
                todo.append((i, j, level + 1, code))
    return out


def _by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
        texts[lang].append(text)
    return texts


def _suffixes(hot: frozenset):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("deal", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for lang, texts in _by_language(batch).items():
                for words, whole in _tokens(texts):
                    rows, n, names = _distinct(words, whole)
                    deal = _prefix_codes(lang.encode(), rows, names, hot)
                    words_by_number = pa.array(names, pa.binary())
                    for a in range(0, len(rows), 200_000):
                        some = slice(a, a + 200_000)
                        parts = [words_by_number.take(pa.array(rows[some, j])) for j in range(MAX_WORDS)]
                        key = pc.binary_join_element_wise(pa.scalar(lang.encode().hex().encode(), pa.binary()), *parts, pa.scalar(b"\0", pa.binary()), null_handling="skip")
                        yield pa.RecordBatch.from_arrays([key, pa.array(deal[some]), pa.array(n[some])], schema=schema)

    return work


def _common_prefixes(tasks: int):
    """Codes of the prefixes that hold a notable part of a part's suffixes, with their counts; code -1 carries all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = [], []
            for lang, texts in _by_language(batch).items():
                root = _code(0, lang.encode())
                for words, whole in _tokens(texts):
                    rows, n, names = _distinct(words, whole)
                    codes.append(-1)
                    counts.append(int(n.sum()))
                    for upto in range(1, MAX_WORDS):
                        starts = _runs(rows, upto) if len(rows) else np.empty(0, np.int64)
                        size = np.add.reduceat(n, starts) if len(starts) else starts
                        many = (size * 8 * tasks >= counts[-1]) & (size >= 16)
                        for at, k in zip(starts[many].tolist(), size[many].tolist(), strict=True):
                            code = root
                            prefix = rows[at, :upto].tolist()
                            if prefix[-1]:
                                for w in prefix:
                                    code = _code(code, names[w])
                                codes.append(code)
                                counts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])

    return work


def hot_prefixes(docs: DataFrame) -> frozenset:
    """Codes of prefixes of one to four words with more than a quarter of an even task's share of the sampled suffixes.

    So there are at most 16 for each shuffle partition of the session. They
    are dealt by one word more; a wrong guess costs balance, nothing else.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.sample(1.0 / SAMPLE, seed=5).mapInArrow(_common_prefixes(tasks), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("all", F.sum(F.when(F.col("code") == -1, F.col("n"))).over(Window.partitionBy()))
    return frozenset(r.code for r in counts.filter((F.col("code") != -1) & (F.col("n") * 4 * tasks > F.col("all"))).select("code").collect())


class _PrefixStack:
    """Counts of all prefixes of keys that arrive in reverse order.

    The open prefix and its counts are the stack. A batch of keys is taken in
    one step: at each depth, a run of keys with equal first words is one
    prefix; the first run may go on with the stack's, the last stays open.
    """

    def __init__(self, hot: frozenset, least: int):
        self.hot, self.least = hot, least
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.out: list[tuple[bytes, int]] = []
        self.codes: dict = {}

    def _hot(self, parent: int | None, word: bytes) -> int:
        """The prefix's code if it is hot, else 0. A parent of None is the root, whose word is a language."""
        known = self.codes.get((parent, word))
        if known is None:
            if len(self.codes) > 200_000:
                self.codes.clear()
            known = _code(0, bytes.fromhex(word.decode())) if parent is None else _code(parent, word)
            known = known if parent is None or known in self.hot else 0
            self.codes[parent, word] = known
        return known

    def _closed(self, words: list[bytes], n: int) -> None:
        """A prefix that is complete in this task leaves if it is frequent; a hot one, and the language itself, leave as a part."""
        if n < self.least:
            code = None
            for w in words:
                code = self._hot(code, w)
                if not code:
                    return
        self.out.append((b"\0".join(words), n))

    def close(self, depth: int = 0) -> None:
        for j in range(len(self.words), depth, -1):
            self._closed(self.words[:j], self.counts[j - 1])

    def feed(self, keys: pa.Array, n: np.ndarray) -> None:
        m = len(keys)
        if not m:
            return
        split = pc.split_pattern(keys.cast(pa.string()), "\0")
        starts = split.offsets.to_numpy()
        flat = split.flatten()
        ids = flat.dictionary_encode().indices.to_numpy()
        depth = np.diff(starts)
        table = np.full((m, _DEPTH), -1, np.int64)
        for j in range(_DEPTH):
            has = depth > j
            table[has, j] = ids[starts[:-1][has] + j]
        words = lambda i, j: [x.encode() for x in flat[starts[i] : starts[i] + j].to_pylist()]
        same, first = np.empty(m, np.int64), words(0, int(depth[0]))
        same[1:] = np.cumprod((table[1:] == table[:-1]) & (table[1:] >= 0), axis=1).sum(axis=1)
        same[0] = next((k for k, (a, b) in enumerate(zip(self.words, first, strict=False)) if a != b), min(len(self.words), len(first)))
        self.close(int(same[0]))
        counts, code = [], np.zeros(m, np.int64)
        for j in range(1, int(depth.max()) + 1):
            at = np.flatnonzero(depth >= j)
            goes_on = bool(at[0] == 0 and same[0] >= j)
            run = np.flatnonzero((same[at] < j) | (at == 0))
            size = np.add.reduceat(n[at], run)
            if goes_on:
                size[0] += self.counts[j - 1]
            # only below hot prefixes can a prefix be hot
            first_row = at[run]
            hot = np.zeros(len(run), np.int64)
            for k in (range(len(run)) if j == 1 else np.flatnonzero(code[first_row]).tolist()):
                hot[k] = self._hot(None if j == 1 else int(code[first_row[k]]), words(first_row[k], j)[-1])
            code[:] = 0
            code[at] = np.repeat(hot, np.diff(np.append(run, len(at))))
            still_open = depth[m - 1] >= j
            if still_open:
                counts.append(int(size[-1]))
            for k in np.flatnonzero((size[: len(run) - still_open] >= self.least) | (hot[: len(run) - still_open] != 0)).tolist():
                self.out.append((b"\0".join(words(first_row[k], j)), int(size[k])))
        self.words, self.counts = words(m - 1, int(depth[m - 1])), counts


def _count_prefixes(hot: frozenset, least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _PrefixStack(hot, least)
        for batch in batches:
            stack.feed(batch.column(0), batch.column(1).to_numpy())
            if len(stack.out) > 20_000:
                yield _counted(stack.out)
                stack.out = []
        stack.close()
        yield _counted(stack.out)

    return work


def _counted(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], names=["key", "n"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Languages and words as they were, words joined by spaces."""
    for batch in batches:
        parts = [x.partition(b"\0") for x in batch.column(0).to_pylist()]
        lang = pa.array([bytes.fromhex(x[0].decode()) for x in parts], pa.binary()).cast(pa.string())
        phrase = pa.array([x[2].translate(_UNFOLD) for x in parts], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, phrase, batch.column(1)], names=["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n): every phrase of one to five words with ``n >= least`` occurrences, and each language's words under the empty phrase."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    hot = hot_prefixes(texts)
    dealt = texts.mapInArrow(_suffixes(hot), _SUFFIXES).repartition("deal").drop("deal").sortWithinPartitions(F.desc("key"))
    parts = dealt.mapInArrow(_count_prefixes(hot, least), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return parts.mapInArrow(_restored, "lang string, phrase string, n long").filter((F.col("n") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to five words by how much they exceed chance.

    Texts lose A-Z's case, fall into pieces at ``.,;:!?`` and line ends, and
    these into words at spaces and tabs. A phrase with ``a >= least``
    occurrences is cut behind each word; ``l`` and ``r`` are the parts' counts,
    ``score`` is floor(1000 a n / (l r)) of its lowest cut (the earliest, of
    equal ones). Phrases inside a longer one that is as frequent go. Null
    languages are ``und``, null and empty texts have no words, repeated rows
    count each, equal scores are ordered by count and bytes, an empty table
    gives no rows; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    counts = common.durable(phrase_counts(docs, least), "phrases")
    all_words = counts.filter("phrase = ''").select("lang", F.col("n").alias("all_words"))
    frequent = counts.filter("phrase <> ''")
    words = F.split("phrase", " ")
    candidates = frequent.filter(F.size(words) > 1).withColumn("words", words).withColumnRenamed("n", "a")

    # a longer phrase is at most as frequent, and so is each between: those with one word more or less tell all
    first, last = F.slice("words", 2, F.size("words") - 1), F.slice("words", 1, F.size("words") - 1)
    inside = candidates.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array(F.array_join(first, " "), F.array_join(last, " "))).alias("phrase"))
    candidates = candidates.join(inside, ["lang", "phrase", "a"], "left_anti")

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    parts = candidates.select("lang", "phrase", "a", "words", cut)
    parts = parts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    parts = parts.join(frequent.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(frequent.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    parts = parts.join(F.broadcast(all_words) if _few(all_words) else all_words, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", (wide("a", 17) * (F.lit(1000).cast("decimal(4,0)") * wide("all_words", 16))).cast("decimal(38,0)"), (wide("l", 18) * wide("r", 18)).cast("decimal(38,0)"))
    best = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "all_words")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", F.col("b.all_words").alias("n"), "b.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _few(all_words: DataFrame, most: int = 100_000) -> bool:
    """One row a language; a table with more than ``most`` of them is joined by shuffle."""
    return all_words.limit(most + 1).count() <= most


#: DuckDB form over ``documents`` with the default parameters.
SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS p, lang, words FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
spans AS (SELECT lang, words[i : i + k - 1] AS w FROM (SELECT lang, words, i, unnest(range(1, least(5, len(words) - i + 1) + 1)) AS k FROM starts)),
f AS (SELECT lang, w, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
cuts AS (SELECT c.lang, c.w, c.n AS a, x.n AS l, y.n AS r, t.n AS n, k, (1000::HUGEINT * c.n * t.n) // (x.n::HUGEINT * y.n) AS score
    FROM (SELECT *, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:] JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
longer AS (SELECT DISTINCT lang, w[i : j] AS w, n FROM (SELECT lang, w, n, i, unnest(range(i, len(w) + 1)) AS j FROM (SELECT lang, w, n, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) > 2)) WHERE j - i + 1 < len(w)),
ranked AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, b.n, score FROM best b WHERE NOT EXISTS (FROM longer g WHERE g.lang = b.lang AND g.w = b.w AND g.n >= b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
