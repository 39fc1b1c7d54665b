"""Near-duplicate detection by ProbMinHash.

A document is the weighted set of its five-word shingles. For each shingle a
Poisson process with the shingle's weight as rate sends points to random
registers; a register keeps its earliest arrival and the signature is who
sent it. Two documents agree in a register with the probability Jaccard
similarity of their weights. A process stops once its next arrival is later
than every register's.

Registers form bands, documents that share a band form a bucket. Equal word
sequences are one vertex from the start, buckets with equal members are
looked at once. In a bucket exact similarity is computed from a centre to all
members that no centre has reached yet, so a bucket of copies costs one pass
instead of all its pairs. A large bucket is dealt out and its parts meet
afterwards where they are not connected yet, so no link in a bucket is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereoloom.llm import common as c
from stereoloom.llm.components import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Distinct texts that one task compares within a bucket. A larger bucket is dealt out by hash, with common centres in every part;
#: members that are then still in different components meet in tasks of two blocks each.
BUCKET_TEXTS = 16_384
BUCKET_CENTRES = 64
#: Two sets whose similarity is that much below the threshold still link: what float sums of equal fractions may differ by.
ROUNDING = 1e-9
_COUNT_BITS = 16
_LOW = np.uint64((1 << _COUNT_BITS) - 1)


def weighted_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, shingle hash and count of each text's distinct shingles, and each text's content hash (0: no words).

    A text of one to four words is one shingle.
    """
    w = c.Words([t.decode().lower().encode() for t in texts], c.PLAIN)
    grams, whole = w.grams(SHINGLE_WORDS)
    doc, value = w.doc[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE_WORDS))
    if len(short):
        value = np.concatenate([value, w.spans(w.first[short], w.first[short + 1])])
        doc = np.concatenate([doc, short])
    content = np.zeros(len(texts), dtype=np.uint64)
    filled = np.flatnonzero(w.counts)
    content[filled] = w.spans(w.first[filled], w.first[filled + 1]) | np.uint64(1)
    value &= ~_LOW
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc))), content


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (texts x registers, uint64) of weighted sets; an empty set has zeros."""
    arrival = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint64)
    clock = np.zeros(len(doc))
    rate = weight.astype(np.float64)
    state = c.mix(element ^ np.uint64(0x51ED270B0A1F3C77))
    step = 0
    while len(doc):
        step += 1
        draw = c.mix(state + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        place = (c.mix(draw ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(registers)).astype(np.int64) + doc * registers
        before = arrival[place]
        near = np.flatnonzero(clock < before)
        np.minimum.at(arrival, place[near], clock[near])
        won = near[arrival[place[near]] == clock[near]]
        winner[place[won]] = element[won]
        latest = arrival.reshape(texts, registers).max(axis=1)
        go = clock < latest[doc]
        doc, element, rate, clock, state = doc[go], element[go], rate[go], clock[go], state[go]
    return winner.reshape(texts, registers)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two packed shingle arrays (hash above, count in the low bits)."""
    return float(_against(a, [b])[0])


def pack(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shingles (hash above, count in the low 16 bits); a larger count takes several entries of its hash."""
    most = int(_LOW)
    entries = -(-count // most)
    if not len(count) or entries.max() == 1:
        return value | count.astype(np.uint64)
    last = np.cumsum(entries) - 1
    out = np.repeat(value, entries) | _LOW
    out[last] = value | (count - (entries - 1) * most).astype(np.uint64)
    return out


def _unpack(packed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, owner) with the entries of one owner's hash added up."""
    value, weight = packed & ~_LOW, (packed & _LOW).astype(np.float64)
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    if new.all():
        return value, weight, owner
    at = np.flatnonzero(new)
    return value[at], np.add.reduceat(weight, at), owner[at]


def _against(centre: np.ndarray, others: list[np.ndarray], threshold: float = 0.0) -> np.ndarray:
    """Probability Jaccard of a set to several: sum over common x of 1 / sum over y of max(wa(y)/wa(x), wb(y)/wb(x)).

    It is at most the sum of the smaller of the two normalised weights; where
    that is below ``threshold``, this bound is given instead.
    """
    ha, wa, _ = _unpack(centre, np.zeros(len(centre), dtype=np.int64))
    hb, wb, which = _unpack(np.concatenate(others), np.repeat(np.arange(len(others)), [len(o) for o in others]))
    sizes = np.bincount(which, minlength=len(others))
    near = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    common = np.flatnonzero(ha[near] == hb)
    owner = which[common]
    shared = np.bincount(owner, minlength=len(others))
    total = np.bincount(which, wb, len(others))
    flat = total == sizes
    if len(ha) == wa.sum():  # all weights 1 on both sides: the plain Jaccard similarity
        plain = shared / (len(ha) + sizes - shared)
    else:
        flat, plain = np.zeros(len(others), dtype=bool), np.zeros(len(others))
    bound = np.bincount(owner, np.minimum(wa[near[common]] / wa.sum(), wb[common] / total[owner]), len(others))
    out = np.where(flat, plain, bound)
    ends = np.cumsum(sizes)
    for o in np.flatnonzero(~flat & (bound >= threshold) & (shared > 0)).tolist():
        s = slice(int(ends[o] - sizes[o]), int(ends[o]))
        out[o] = _probability_jaccard(ha, wa, hb[s], wb[s], near[s], ha[near[s]] == hb[s])
    return out


def _probability_jaccard(ha, wa, hb, wb, near, common) -> float:
    """Exact J_P in O(n log n): for common x, the sum over y of the larger ratio is split at wa(y)/wb(y) against wa(x)/wb(x)."""
    a = np.concatenate([wa[near[common]], wb[~common] * 0, np.delete(wa, near[common])])
    b = np.concatenate([wb[common], wb[~common], np.zeros(len(wa) - int(common.sum()))])
    ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    above = np.cumsum(a[::-1])[::-1]
    below = np.cumsum(b)
    both = np.flatnonzero((a > 0) & (b > 0))
    # y with a larger ratio than x: wa(y)/wa(x) is the larger part; the others: wb(y)/wb(x)
    last = np.searchsorted(ratio, ratio[both], side="right")
    part_a = np.where(last < len(a), above[np.minimum(last, len(a) - 1)], 0.0) / a[both]
    part_b = below[last - 1] / b[both]
    return float((1.0 / (part_a + part_b)).sum())


def _sketch(batches):
    """(content, bands) of each row, then its columns beyond the second; content 0 has no bands."""
    for batch in batches:
        ids, texts = batch.column(0), c.utf8(batch.column(1))
        contents, bands = [], []
        for i, j in c.chunks(texts):
            doc, value, count, content = weighted_shingles(texts[i:j])
            found = signatures(doc, value, count, j - i).reshape(j - i, BANDS, ROWS)
            key = np.zeros((j - i, BANDS), dtype=np.uint64)
            for k in range(ROWS):
                key = c.mix(key * np.uint64(0x9E3779B97F4A7C15 | 1) + found[:, :, k])
            key = c.mix(key + np.arange(BANDS, dtype=np.uint64))
            contents.append(content)
            bands.append(key)
        flat = np.concatenate(bands) if bands else np.empty((0, BANDS), dtype=np.uint64)
        lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, BANDS, dtype=np.int32), pa.array(c.signed(flat.reshape(-1))))
        yield pa.RecordBatch.from_arrays([ids, pa.array(c.signed(np.concatenate(contents) if contents else np.empty(0, dtype=np.uint64))), lists, *batch.columns[2:]], names=["doc_id", "content", "bands", *batch.schema.names[2:]])


def _pack(batches):
    """(doc_id, content, shingles) of each row."""
    for batch in batches:
        texts, out, contents = c.utf8(batch.column(1)), [], [np.empty(0, dtype=np.uint64)]
        for i, j in c.chunks(texts):
            doc, value, count, own = weighted_shingles(texts[i:j])
            contents.append(own)
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            out += [pack(value[a:b], count[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.signed(np.concatenate(contents))), pa.array(out, pa.binary())], names=["doc_id", "content", "shingles"])


def bucket_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, float]]:
    """Pairs (i, j, similarity) that connect all members of a bucket that exact links connect, found from centres.

    From a centre all members not yet linked are compared. Members it reaches
    become centres in turn, so whatever is connected is connected in the
    result, while each found member is compared as a target only once.
    """
    threshold -= ROUNDING
    distinct = np.array([len(s) for s in sets])
    flat = np.array([bool(((s & _LOW) == 1).all()) for s in sets])
    waiting = np.arange(len(sets))
    links = []
    while len(waiting):
        frontier, waiting = [int(waiting[0])], waiting[1:]
        while frontier and len(waiting):
            centre = frontier.pop()
            n, others = distinct[centre], distinct[waiting]
            # among sets of weight 1 the smaller one's size bounds the similarity
            tried = waiting[~(flat[centre] & flat[waiting]) | (threshold * np.maximum(n, others) <= np.minimum(n, others))]
            if not len(tried):
                continue
            found = _against(sets[centre], [sets[x] for x in tried.tolist()], threshold)
            hit = found >= threshold
            links += [(centre, int(x), float(s)) for x, s in zip(tried[hit], found[hit], strict=True)]
            frontier += tried[hit].tolist()
            waiting = np.setdiff1d(waiting, tried[hit], assume_unique=True)
    return links


def _links(threshold: float):
    def links(bucket: list[tuple[int, bytes]]):
        bucket.sort()
        found = bucket_links([np.frombuffer(s, dtype=np.uint64) for _, s in bucket], threshold)
        return [(bucket[i][0], bucket[j][0], s) for i, j, s in found]

    def run(batches):
        """Rows come sorted by bucket; one bucket is held at a time."""
        here, members, out = None, [], []
        for batch in batches:
            for key, content, shingles in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != here:
                    out += links(members)
                    here, members = key, []
                members.append((content, shingles))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + links(members))

    return run


def _edges(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "similarity"])


def _packed(source: DataFrame, texts: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, shingles) of the given contents, each from a row of its least doc_id; every such row is packed once, however many share its id."""
    wanted = contents.join(texts, "content").select("content", "first")
    rows = source.join(wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_pack, "doc_id long, content long, shingles binary")
    return rows.join(wanted, "content").filter("doc_id = first").groupBy("content").agg(F.min("shingles").alias("shingles"))


def _compared(dealt: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Edges within each (bucket, part) of ``dealt``."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(packed, "content").select("bucket", "part", "content", "shingles")
    return rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_links(threshold), "a long, b long, similarity double")


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, part, content): tasks in which all members of a bucket meet that ``labels`` has not connected.

    The largest component of a bucket and the rest are dealt into blocks of
    half a task. Each block of the rest meets each other block; two blocks of
    the largest component need not meet, as it is connected already.
    """
    placed = members.join(labels.select(F.col("node").alias("content"), "label"), "content", "left").withColumn("label", F.coalesce("label", "content"))
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"))
    half = max(1, BUCKET_TEXTS // 2)
    blocks = lambda k: F.ceil(k / half).cast("long")
    sizes = sizes.filter("all > top.k").select("bucket", F.col("top.label").alias("main"), blocks(F.col("top.k")).alias("p"), blocks(F.col("all") - F.col("top.k")).alias("q"))
    p, q, wide = F.col("p"), F.col("q"), F.col("p") + F.col("q")
    code, rest = F.xxhash64("content", F.lit(3)), F.sequence(p, wide - 1)
    placed = placed.join(sizes, "bucket").withColumn("block", F.when(F.col("label") == F.col("main"), F.pmod(code, p)).otherwise(p + F.pmod(code, q)))
    block = F.col("block")
    others = F.when(block < p, rest).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), wide - 1), block))
    return placed.select("bucket", F.explode(F.transform(others, lambda x: F.least(x, block) * wide + F.greatest(x, block))).alias("part"), "content")


def _labels(source: DataFrame, texts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of the contents that exact links within buckets connect."""
    packed = _packed(source, texts, members.select("content").distinct())
    centre = F.pmod(F.xxhash64("content", F.lit(2)), F.ceil(F.col("n") / BUCKET_CENTRES)) == 0
    part = F.explode(F.when((F.col("parts") > 1) & centre, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))))
    edges = _compared(members.select("bucket", part.alias("part"), "content"), packed, threshold).select("a", "b")
    large = members.filter("parts > 1").select("bucket", "content")
    if large.isEmpty():
        return components(edges)
    edges = c.durable(edges, "links")
    dealt = c.durable(_across(large, components(edges)), "across")
    more = _compared(dealt, _packed(source, texts, dealt.select("content").distinct()), threshold)
    return components(edges.unionAll(more.select("a", "b")))


def _labelled(docs: DataFrame, threshold: float, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, content, ``extra`` columns of longs) and texts (content, first, rows, least row, label)."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(c.MAX_ID)).alias("doc_id"), "text", *extra)
    sketch = c.durable(source.mapInArrow(_sketch, "doc_id long, content long, bands array<long>" + "".join(f", {k} long" for k in extra)), "sketch")
    texts = sketch.filter("content != 0").groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.min(F.struct("doc_id", *extra)).alias("least"))
    entries = sketch.filter("content != 0").select("content", F.explode("bands").alias("bucket")).groupBy("bucket", "content").agg(F.lit(1).alias("one")).drop("one")
    # 128 bits name a bucket's members, order aside
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("content")).alias("m1"), F.bit_xor(F.xxhash64("content", F.lit(1))).alias("m2")).filter("n > 1")
    buckets = buckets.groupBy("n", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    members = c.durable(entries.join(buckets.select("bucket", "n"), "bucket").withColumn("parts", F.ceil(F.col("n") / BUCKET_TEXTS).cast("int")), "members")
    labels = _labels(source, texts, members, threshold)
    return sketch, texts.join(labels.select(F.col("node").alias("content"), "label"), "content", "left").withColumn("label", F.coalesce("label", "content"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Class of every row: ``doc_id``, ``class_id``, ``class_rows``.

    Texts are linked at a probability Jaccard similarity of ``threshold`` or
    more (to ``ROUNDING``, so that equal fractions link) over five-word shingles weighted by count (lower-case words without
    ASCII punctuation); classes are connected components of links, named by
    their least doc_id. Equal word sequences always share a class. Null
    texts and texts without words are each in a class of their own, named by
    their own doc_id. Null doc_ids count as the largest id; rows that repeat a
    doc_id with other text get a row each. Other columns are left out.
    """
    sketch, named = _labelled(docs, threshold)
    classes = named.join(named.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_rows")), "label").select("content", "class_id", "class_rows")
    return sketch.select("doc_id", "content").join(classes, "content", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"))


def first_rows(docs: DataFrame, code: str, row: str, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` of the rows that lead their class: the least (doc_id, ``code``, ``row``), exactly one a class.

    ``row`` is unique and ``code`` a long that orders rows of one doc_id. A row without words leads its own class.
    """
    sketch, named = _labelled(docs, threshold, (code, row))
    first = named.groupBy("label").agg(F.min("least").alias("least")).select(F.col(f"least.{row}").alias(row))
    return first.unionAll(sketch.filter("content = 0").select(row))
