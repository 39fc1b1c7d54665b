"""Language identification, words first.

A known word scores by its log frequency in each language. An unseen word
falls back to its character n-grams: the longest length of which any n-gram
is known decides, by the mean log frequency of those n-grams. A text's score
is the mean over its words; a softmax over languages gives the confidence.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled doc_ids of each language whose words are counted; all their words and n-grams are kept.
SAMPLE_ROWS = 1_500
LONGEST_GRAM = 5
#: Most frequent languages whose rows are thinned before they are ranked; the choice is the same without.
THINNED = 1_000
UNKNOWN = "und"
#: Unseen words that a Python worker remembers.
CACHE_WORDS = 200_000



_KINDS = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
#: Marks, and numbers that are no digits. Where none occurs, Python's own letters are all there is, and faster to find.
_ODD = frozenset(chr(c) for c, kind in enumerate(_KINDS) if kind[0] == "M" or kind in ("Nl", "No"))
_PLAIN_LETTERS = re.compile(r"[^\W\d_]+")


def _class(kinds: str) -> str:
    """Inside of a character class of all characters whose Unicode category begins with one of ``kinds``."""
    runs = groupby(enumerate(c for c, kind in enumerate(_KINDS) if kind[0] in kinds), lambda x: x[1] - x[0])
    ends = [(run[0][1], run[-1][1]) for run in (list(g) for _, g in runs)]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ends)


@cache
def _letters() -> re.Pattern:
    """A word begins with a letter; letters and combining marks (vowel signs, accents) go on with it."""
    return re.compile(f"[{_class('L')}][{_class('LM')}]*")


def words(text: str) -> list[str]:
    """Runs of letters and the marks after them, lower case."""
    text = text.lower()
    return (_PLAIN_LETTERS if _ODD.isdisjoint(text) else _letters()).findall(text)


def grams(word: str, n: int) -> list[str]:
    """Runs of n characters; word ends are marked where a run has room for more than the mark."""
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class ScoreTable:
    """Keys and their centred log frequencies, a row a key and a column a language."""

    rows: dict[str, int]
    scores: np.ndarray

    @classmethod
    def of(cls, counts: list[Counter]) -> ScoreTable:
        """From one counter a language: log frequency within each language with half a count added, centred over languages."""
        keys = sorted(set().union(*counts))
        n = np.array([[c[k] for k in keys] for c in counts], dtype=np.float64).reshape(len(counts), len(keys)).T
        x = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(1, len(keys))))
        return cls({k: i for i, k in enumerate(keys)}, (x - x.mean(axis=1, keepdims=True)).astype(np.float32) if counts else n)


@dataclass
class LanguageModel:
    languages: list[str]
    words: ScoreTable
    grams: dict[int, ScoreTable]

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]]) -> LanguageModel:
        """From (language, word, count) rows; ties and order of rows do not matter."""
        languages = sorted({x[0] for x in counts})
        by_word = {x: Counter() for x in languages}
        for lang, word, n in counts:
            by_word[lang][word] += n
        by_gram = {}
        for size in range(1, LONGEST_GRAM + 1):
            found = []
            for lang in languages:
                c: Counter = Counter()
                for word, n in by_word[lang].items():
                    for g in grams(word, size):
                        c[g] += n
                found.append(c)
            by_gram[size] = ScoreTable.of(found)
        return cls(languages, ScoreTable.of([by_word[x] for x in languages]), by_gram)

    def word(self, word: str) -> np.ndarray:
        """Scores of one word in every language."""
        known = self.words.rows.get(word)
        if known is not None:
            return self.words.scores[known]
        for n in range(LONGEST_GRAM, 0, -1):
            rows = self.grams[n].rows
            found = [at for g in grams(word, n) if (at := rows.get(g)) is not None]
            if found:
                return self.grams[n].scores[found].mean(axis=0)
        return np.zeros(len(self.languages))


class _Cache(dict):
    """Word to its row in a table of scores; unseen words are scored once."""

    def __init__(self, model: LanguageModel, most: int):
        self.model, self.most = model, most
        self.rows = np.empty((1024, len(model.languages)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[at] = self.model.word(word)
        return at

    def scores(self, found: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        return self.rows[at].mean(axis=0, dtype=np.float64)


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """The rows (doc_id, text, lang) of the ``per_language`` doc_ids of each language with the smallest hashes.

    Rows of the more frequent languages are thinned by a bound on the hash
    that leaves about twice as many, so that the ranking sees few of them.
    """
    keyed = labelled.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    most = 2.0 * per_language + 100
    counts = keyed.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") > most).orderBy(F.desc("n"), "lang").limit(THINNED)
    place = F.col("h") / 2.0**64 + 0.5  # even between 0 and 1
    thinned = keyed.select("lang", "h").join(F.broadcast(counts), "lang", "left").filter(F.col("n").isNull() | (F.col("n") * place <= most)).select("lang", "h").distinct()
    chosen = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= per_language).drop("rank")
    return keyed.join(F.broadcast(chosen), ["lang", "h"])  # per_language rows a language


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Count words on the rows of at most ``sample_rows`` doc_ids of each language that have text and lang, chosen by hash of doc_id.

    So a rare language is learned from all its rows. Words are counted on the
    executors; the driver receives each distinct (lang, word) of the sample.
    Rows that repeat a chosen doc_id all count; null ids count as one id.
    """
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.update((lang, w) for w in words(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample(labelled, sample_rows).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return LanguageModel.fit([(r[0], r[1], r[2]) for r in counted.collect()])


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) for every whole text.

    A text that is null or has no letters gets ``und`` and 0. Equal scores go
    to the language first in alphabetical order. A model without languages
    answers ``und``. Other columns are left out; repeated rows stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        cache = _Cache(m, CACHE_WORDS)
        for batch in batches:
            preds, scores = [], []
            for raw in batch.column(1):
                text = raw.as_py()
                found = words(text) if text and m.languages else []
                if not found:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = cache.scores(found) * math.sqrt(len(found))
                p = np.exp(total - total.max())
                best = int(np.argmax(total))
                preds.append(m.languages[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[id_column, "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")
