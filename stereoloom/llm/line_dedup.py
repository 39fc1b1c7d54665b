"""Line dedup by a log-template tree.

A line's leaf is its token count and its leading tokens (tokens with digits
are variable fields from the start). Inside a leaf, lines that agree in enough
positions form one template, whose disagreeing positions become variable.
Templates that recur in enough documents are dropped, all but the first line.

The tree is built shard by shard: leaves seen in too few documents are set
aside by a count, the lines of the others are collapsed to distinct masked
lines within each group of documents and then over all groups, and only
those, with their counts, go to the leaf's shard. Verdicts go back to the
groups that hold the lines.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.llm import common as c

LEADING_TOKENS = 3
MIN_TOKENS = 4
MIN_DOCUMENTS = 10
SIMILARITY = 0.7
#: Templates of one leaf that a line is compared with one by one; among more, candidates are looked up by blocks of positions.
NODE_LINES = 2_048
_FIELD = np.uint64(0x5EED_F1E1D)
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[0x30:0x3A] = 1


class _Lines:
    """Masked tokens and line hashes of some texts."""

    def __init__(self, texts: list[bytes], leading: int, least: int):
        self.words = w = c.Words(texts, c.SPACE)
        n = len(w.hashes)
        self.masked = w.hashes.copy()
        self.line = np.zeros(n, dtype=np.int64)
        for d, text in enumerate(texts):  # line number of every word, and which words hold digits
            a, b = int(w.first[d]), int(w.first[d + 1])
            if a == b:
                continue
            raw = np.frombuffer(text, dtype=np.uint8)
            self.line[a:b] = np.searchsorted(np.flatnonzero(raw == 0x0A), w.starts[a:b])
            digits = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum(_DIGIT[raw], out=digits[1:])
            self.masked[a:b][digits[w.ends[a:b]] > digits[w.starts[a:b]]] = _FIELD
        new = np.ones(n, dtype=bool)
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (self.line[1:] != self.line[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        keep = count >= least
        self.start, self.count = start[keep], count[keep]
        self.doc, self.number = w.doc[self.start], self.line[self.start]
        lead = np.minimum(leading, self.count)
        hashed = c.span_hashes(self.masked, self.start, self.start + lead, c._gram_powers)
        self.leaf = c.mix(hashed ^ c.mix(self.count.astype(np.uint64)))
        self.content = c.span_hashes(self.masked, self.start, self.start + self.count, c._gram_powers)


def _leaves(leading: int, least: int):
    """(leaf, group, documents): in how many documents of a batch's group a leaf occurs."""

    def run(batches):
        for batch in batches:
            texts, group = c.utf8(batch.column(0)), np.asarray(batch.column(1))
            out: list[tuple] = []
            for i, j in c.chunks(texts):
                x = _Lines(texts[i:j], leading, least)
                if len(x.leaf):
                    pair = np.unique(np.stack([x.leaf, x.doc.astype(np.uint64)]), axis=1)
                    out.append((pair[0], group[i:j][pair[1].astype(np.int64)].astype(np.uint64)))
            if out:
                both = np.stack([np.concatenate([o[k] for o in out]) for k in range(2)])
                pair, n = np.unique(both, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(pair[0].copy())), pa.array(pair[1].astype(np.int32)), pa.array(n.astype(np.int64))], names=["leaf", "grp", "n"])

    return run


_LINE_SCHEMA = pa.schema([("grp", pa.int32()), ("leaf", pa.int64()), ("content", pa.int64()), ("documents", pa.int64()), ("doc", pa.int64()), ("number", pa.int64()), ("tokens", pa.binary())])


def _known(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(hashes) or not len(values):
        return np.empty(0, dtype=np.int64)
    near = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
    return np.flatnonzero(hashes[near] == values)


def _ids(table: pa.Table) -> list[int]:
    return [c.MAX_ID if x is None else x for x in table.column("doc_id").to_pylist()]


def _frequent_lines(leading: int, least: int):
    """Distinct masked lines of one group in the frequent leaves, with their documents and first place."""

    def run(docs: pa.Table, leaves: pa.Table) -> pa.Table:
        if not leaves.num_rows or not docs.num_rows:
            return _LINE_SCHEMA.empty_table()
        grp = leaves.column("grp")[0].as_py()
        hashes = np.unique(np.asarray(leaves.column("leaf")).view(np.uint64))
        texts, ids = c.utf8(docs.column("text")), _ids(docs)
        found: dict[tuple[int, int], list] = {}
        for i, j in c.chunks(texts):
            x = _Lines(texts[i:j], leading, least)
            for k in _known(hashes, x.leaf).tolist():
                key, d, number = (int(x.leaf[k]), int(x.content[k])), i + int(x.doc[k]), int(x.number[k])
                entry = found.get(key)
                if entry is None:
                    s = int(x.start[k])
                    found[key] = [1, d, (ids[d], number), x.masked[s : s + int(x.count[k])].tobytes()]
                else:
                    entry[0] += entry[1] != d
                    entry[1] = d
                    entry[2] = min(entry[2], (ids[d], number))
        keys = np.array(list(found), dtype=np.uint64).reshape(-1, 2)
        rows = list(found.values())
        return pa.table([
            pa.array(np.full(len(rows), grp, dtype=np.int32)), pa.array(c.signed(keys[:, 0].copy())), pa.array(c.signed(keys[:, 1].copy())),
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2][0] for r in rows], pa.int64()), pa.array([r[2][1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], schema=_LINE_SCHEMA)

    return run


class _Blocks:
    """Finds the templates that can agree with a line in enough positions, without looking at all of them.

    A line that joins a template disagrees in ``spare`` positions at most. Of
    ``spare + 1`` blocks of positions one then agrees whole, so templates are
    kept by the tokens of each block. Positions in which all lines are equal
    tell nothing and are in no block.
    """

    def __init__(self, lines: np.ndarray, similarity: float):
        width = lines.shape[1]
        agree = np.flatnonzero(np.arange(width + 1) >= similarity * width)
        equal = (lines == lines[0]).all(axis=0)
        free = np.flatnonzero(~equal)
        # an equal position of variable fields agrees in no line but one of fields only, which is always a candidate
        spare = width - int(agree[0]) - int((equal & (lines[0] == _FIELD)).sum()) if len(agree) else 0
        self.usable = spare < len(free)
        if self.usable and spare >= 0:
            kinds = np.array([len(np.unique(lines[:, p])) for p in free])
            free = free[np.argsort(-kinds, kind="stable")]
            blocks = [free[k :: spare + 1] for k in range(spare + 1)]
        else:
            blocks = []
        self.blocks = [(p, c.span_hashes(lines[:, p].reshape(-1), np.arange(len(lines)) * len(p), (np.arange(len(lines)) + 1) * len(p), c._gram_powers), (lines[:, p] != _FIELD).all(axis=1)) for p in blocks]
        self.kept: list[dict[int, list[int]]] = [{} for _ in self.blocks]
        self.always: list[int] = []

    def add(self, i: int, template: int, fields_only: bool) -> None:
        if fields_only:
            self.always.append(template)
            return
        for kept, (_, code, whole) in zip(self.kept, self.blocks, strict=True):
            if whole[i]:
                kept.setdefault(int(code[i]), []).append(template)

    def near(self, i: int) -> np.ndarray:
        """Candidates in order of template number."""
        found = set(self.always)
        for kept, (_, code, whole) in zip(self.kept, self.blocks, strict=True):
            if whole[i]:
                found.update(kept.get(int(code[i]), ()))
        return np.array(sorted(found), dtype=np.int64)


def templates(lines: np.ndarray, similarity: float = SIMILARITY, node_lines: int = NODE_LINES) -> np.ndarray:
    """Template number of every row of ``lines`` (distinct token rows of one leaf, in order of first place).

    A line joins the template that agrees with it in most positions, if those
    are ``similarity`` of all (variable positions never count); the first of
    equal ones. Positions that disagree become variable. Beyond ``node_lines``
    templates only those that can be near enough are compared, which finds the
    same one.
    """
    n, width = lines.shape
    known = np.zeros((min(n, 64), width), dtype=np.uint64)
    fixed = np.zeros((min(n, 64), width), dtype=bool)
    used, out = 0, np.empty(n, dtype=np.int64)
    first: list[int] = []  # the line each template began with
    blocks = None
    for i, line in enumerate(lines):
        if used > node_lines and blocks is None:
            blocks = _Blocks(lines, similarity)
            for t, at in enumerate(first):
                blocks.add(at, t, bool((lines[at] == _FIELD).all()))
        if used:
            at = blocks.near(i) if blocks is not None and blocks.usable else None
            if at is None:
                same = (known[:used] == line) & fixed[:used]
            else:
                same = (known[at] == line) & fixed[at]
            agree = same.sum(axis=1)
            best = int(agree.argmax()) if len(agree) else 0
            if len(agree) and agree[best] >= similarity * width:
                t = best if at is None else int(at[best])
                fixed[t] &= same[best]
                out[i] = t
                continue
        if used == len(known):
            known, fixed = np.concatenate([known, np.zeros_like(known)]), np.concatenate([fixed, np.zeros_like(fixed)])
        known[used], fixed[used] = line, line != _FIELD
        fields_only = not fixed[used].any()
        if fields_only:
            fixed[used] = True  # a line of variable fields only is its own template
        first.append(i)
        if blocks is not None:
            blocks.add(i, used, fields_only)
        out[i] = used
        used += 1
    return out


def leaf_templates(lines: np.ndarray, leading: int, similarity: float = SIMILARITY, node_lines: int = NODE_LINES) -> np.ndarray:
    """``templates`` of a leaf, by one rule whatever its size; its first ``leading`` tokens are equal."""
    return templates(lines, similarity, node_lines)


def _judge(leading: int, documents: int, similarity: float):
    """Per shard: the masked lines whose template recurs, with the place to keep. Rows come sorted by leaf; one leaf is held at a time."""

    def judged(leaf: int | None, items: list[tuple]) -> list[tuple]:
        """items: (place, content, documents, tokens)."""
        if not items:
            return []
        items.sort()
        which = leaf_templates(np.stack([np.frombuffer(x[3], dtype=np.uint64) for x in items]), leading, similarity).tolist()
        total, first = defaultdict(int), {}
        for t, (place, _, n, _) in zip(which, items, strict=True):
            total[t] += n
            first.setdefault(t, place)
        return [(leaf, content, *first[t]) for t, (_, content, _, _) in zip(which, items, strict=True) if total[t] >= documents]

    def run(batches):
        here, items, out = None, [], []
        for batch in batches:
            for leaf, content, n, doc, number, tokens in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if leaf != here:
                    out += judged(here, items)
                    here, items = leaf, []
                items.append(((doc, number), content, n, tokens))
            if len(out) >= 50_000:
                yield _verdicts(out)
                out = []
        yield _verdicts(out + judged(here, items))

    return run


def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
    names = ["leaf", "content", "doc", "number"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def _drop(leading: int, least: int, keep_first: bool):
    def run(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        keep = [n for n in docs.column_names if n.startswith("k_")]
        texts, ids = c.utf8(docs.column("text")), _ids(docs)
        null = docs.column("text").is_null().to_pylist()
        place = dict(zip(zip(verdicts.column("leaf").to_pylist(), verdicts.column("content").to_pylist(), strict=True), zip(verdicts.column("doc").to_pylist(), verdicts.column("number").to_pylist(), strict=True), strict=True))
        hashes = np.unique(np.array([k[0] for k in place], dtype=np.int64).view(np.uint64))
        out_text, lines, dropped = [], [], []
        for i, j in c.chunks(texts):
            gone: dict[int, set[int]] = defaultdict(set)
            x = _Lines(texts[i:j], leading, least) if len(hashes) else None
            for k in _known(hashes, x.leaf).tolist() if x is not None else ():
                key = (int(c.signed(x.leaf[k : k + 1])[0]), int(c.signed(x.content[k : k + 1])[0]))
                d, number = i + int(x.doc[k]), int(x.number[k])
                if key in place and not (keep_first and place[key] == (ids[d], number)):
                    gone[d].add(number)
            for d in range(i, j):
                parts = texts[d].split(b"\n")
                lines.append(0 if null[d] else len(parts))
                dropped.append(len(gone[d]) if d in gone else 0)
                text = b"\n".join([p for n, p in enumerate(parts) if n not in gone[d]]) if d in gone else texts[d]
                out_text.append(None if null[d] else text.decode())
        columns = [docs.column("doc_id"), pa.array(out_text, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.table(columns + [docs.column(k) for k in keep], names=["doc_id", "text", "n_lines", "n_dropped", *keep])

    return run


def line_dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, leading_tokens: int = LEADING_TOKENS,
               similarity: float = SIMILARITY, keep_first: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose template occurs in ``min_documents`` documents or more.

    Lines end at ``\\n``; tokens are runs of non-white-space ASCII; lines of
    fewer than ``min_tokens`` tokens are left alone. With ``keep_first`` the
    template's first line (smallest doc_id, then line) stays. Returns
    ``doc_id, text, n_lines, n_dropped`` and the ``keep`` columns.

    A null text stays null with 0 lines, an empty one has one empty line. A
    null doc_id comes last. Repeated rows count as documents of their own and
    lose or keep their lines alike.
    """
    n = c.group_count(docs)
    renamed = [F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *renamed, c.group_of(F.col("doc_id"), F.col("text"), n=n).alias("grp"))
    leaves = placed.select("text", "grp").mapInArrow(_leaves(leading_tokens, min_tokens), "leaf long, grp int, n long")
    leaves = leaves.groupBy("leaf", "grp").agg(F.sum("n").alias("n"))
    # a leaf has a row for each group of documents at most
    frequent = leaves.withColumn("all", F.sum("n").over(Window.partitionBy("leaf"))).filter(F.col("all") >= min_documents).select("leaf", "grp")
    grouped = placed.groupBy("grp")
    lines = grouped.cogroup(frequent.groupBy("grp")).applyInArrow(_frequent_lines(leading_tokens, min_tokens), "grp int, leaf long, content long, documents long, doc long, number long, tokens binary")
    lines = c.durable(lines, "lines")
    place = F.min(F.struct("doc", "number"))
    distinct = lines.groupBy("leaf", "content").agg(F.sum("documents").alias("documents"), place.alias("place"), F.min("tokens").alias("tokens"))
    distinct = distinct.select("leaf", "content", "documents", "place.doc", "place.number", "tokens").repartition(n, "leaf").sortWithinPartitions("leaf")
    recurring = distinct.mapInArrow(_judge(leading_tokens, min_documents, similarity), "leaf long, content long, doc long, number long")
    verdicts = lines.select("grp", "leaf", "content").join(recurring, ["leaf", "content"])
    schema = "doc_id long, text string, n_lines long, n_dropped long" + "".join(f", k_{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))
    out = grouped.cogroup(verdicts.groupBy("grp")).applyInArrow(_drop(leading_tokens, min_tokens, keep_first), schema)
    return out.select("doc_id", "text", "n_lines", "n_dropped", *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)])


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
