"""How the sources of a language differ: distances between their term distributions, and the terms that tell each.

A language's kept terms form columns of counts, one count a source. Very many
columns are alike (rare terms above all), so terms are grouped by their sparse
column first; a pair of sources is evaluated once for a distinct column and
counts as often as the column occurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.llm import common

MIN_DOCUMENTS = 10
TOP_TERMS = 10
#: Distinct (source, term) pairs that a task counts before it hands them on.
HELD_TERMS = 400_000
SCALE = 1_000_000_000

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PARTS = "lang string, source string, term string, n long, docs long"


def _slices(text: bytes) -> Iterator[bytes]:
    """Pieces of a folded text that end at a space, so that a long text's words are never all held at a time."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + common.SLICE_BYTES)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (lang, source, term) of a task, in parts of bounded size."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    found: dict = defaultdict(lambda: (Counter(), Counter()))

    def flush():
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            k = len(terms)
            for a in range(0, k, 50_000):
                some = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], schema=schema)
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.utf8(batch.column(2)), strict=True):
            n, docs = found[(lang, source)]
            before = len(n)
            folded = text.translate(_TERM_BYTES)
            seen = Counter()
            for piece in _slices(folded):
                seen.update(piece.split())
            n.update(seen)
            docs.update(seen.keys())
            held += len(n) - before
            if held > HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * kept)); decimals carry the product beyond 64 bits."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (total + 2 * kept).cast("decimal(38,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 1e9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ranked distances to the language's other sources, and ranked telling terms.

    ``docs`` has text, lang and source; null in any of them reads as ''. Terms
    are runs of ASCII letters and non-ASCII characters, A-Z folded; a language
    keeps the terms in at least ``min_documents`` of its rows (repeated rows
    count each). Groups without terms, and languages without kept terms, are
    there with distances of 0 (the latter) or by the even share (the former);
    a language of one source has no pairs. Ties rank by item in UTF-8 order.
    An empty table gives no rows; other columns are not read.

    Sums over all kept terms are split exactly: g(a, b) for the counts a, b of
    two sources is g(a, 0) + g(0, b) - g(0, 0), which needs only how many
    terms a source holds a times, plus a rest that vanishes unless both hold
    the term; the rest is taken once for each distinct column.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # one shuffle by (lang, term) serves the counts of a source, of the term and its column
    counts = docs.mapInArrow(_count_terms, _PARTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    columns = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    columns = common.durable(columns.filter(F.col("docs") >= min_documents).drop("docs"), "columns")
    cells = columns.select("lang", "term", "total", F.inline("cells"))

    groups = docs.select("lang", "source").distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("tokens"), F.count("*").alias("held"))
    kept = columns.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_tokens"))
    groups = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["tokens", "held", "kept", "lang_tokens"])
    none = F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("tokens"), F.col("kept")))
    groups = common.durable(groups.withColumn("p0", none), "groups")

    shares = cells.join(groups.select("lang", "source", "tokens", "kept", "lang_tokens", "p0"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("tokens"), F.col("kept")))
    return _pairs(columns, groups, shares).unionByName(_terms(shares, top_terms))


def _pairs(columns: DataFrame, groups: DataFrame, shares: DataFrame) -> DataFrame:
    key = ["lang", "source", "item"]
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").filter(F.col("source") != F.col("item"))

    # every count of a source against the other's zero; terms that the source lacks are p0 against q0
    how_often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    against_none = how_often.join(other, "lang").filter(F.col("source") != F.col("item")).groupBy(*key).agg(F.sum(F.col("m") * _gap(F.col("p"), F.col("q0"))).alias("value"))
    against_none = against_none.unionByName(against_none.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    base = pairs.join(groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held")), ["lang", "item"])
    base = base.select(*key, F.when(F.col("kept") > 0, (F.col("kept") - F.col("held") - F.col("item_held")) * _gap(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))

    # both hold the term: one evaluation for a distinct column
    distinct = columns.groupBy("lang", "cells").agg(F.count("*").alias("m"))
    distinct = distinct.withColumn("column", F.monotonically_increasing_id())
    distinct = common.durable(distinct, "distinct")
    cell = distinct.select("lang", "column", "m", F.inline("cells")).join(groups.select("lang", "source", "tokens", "kept", "p0"), ["lang", "source"])
    cell = cell.withColumn("p", _share(F.col("n"), F.col("tokens"), F.col("kept")))
    vector = cell.groupBy("lang", "column", "m").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("cells"))
    one = vector.select("lang", "m", "cells", F.posexplode("cells").alias("at", "s"))
    both = one.select("lang", "m", "s", F.explode(F.slice("cells", F.col("at") + 2, F.size("cells"))).alias("t"))
    s, t = F.col("s"), F.col("t")
    rest = _gap(s.p, t.p) - _gap(s.p, t.p0) - _gap(s.p0, t.p) + _gap(s.p0, t.p0)
    both = both.groupBy("lang", s.source.alias("source"), t.source.alias("item")).agg(F.sum(F.col("m") * rest).alias("value"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    total = base.unionByName(against_none).unionByName(both).groupBy(*key).agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(by_value).alias("rank"))


def _terms(shares: DataFrame, top_terms: int) -> DataFrame:
    """A group's terms that are more frequent in it than in the language; Spark limits each task's part of a group before the shuffle."""
    q = _share(F.col("total"), F.col("lang_tokens"), F.col("kept"))
    above = shares.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.filter(F.col("rank") <= top_terms)


#: DuckDB form of the default audit over ``documents``.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
v AS (SELECT lang, count(*) AS kept FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(c.n, 0) AS tokens, coalesce(v.kept, 0) AS kept FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) c USING (lang, source) LEFT JOIN v USING (lang)),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.tokens + 2 * g.kept)::HUGEINT)::HUGEINT AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
whole AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (max(t.tokens) + 2 * max(t.kept))::HUGEINT)::HUGEINT AS q
    FROM cells JOIN (SELECT lang, sum(tokens) AS tokens, max(kept) AS kept FROM groups GROUP BY lang) t USING (lang) GROUP BY ALL),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT d.lang, d.source, 'term' AS part, d.term AS item, ((d.p - w.q) * (d.p - w.q) // (d.p + w.q))::BIGINT AS value
    FROM dense d JOIN whole w USING (lang, term) WHERE d.n > 0 AND d.p > w.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
