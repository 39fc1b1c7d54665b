"""Corpus operators against brute force, exact libraries and held-out rows; hostile tables."""

import array
import hashlib
import math
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom.llm import bpe, common, components, decontaminate, langid, licenses, line_dedup, media, near_dedup, quality, queries, sharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, rows):
    """Rows (doc_id, text); columns that clash with the operators' own names stand beside them."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    clash = ("score", "grp", "content", "anchor", "shard", "size", "n_words", "bands", "class_id", "label")
    return df.withColumns({c: F.lit(1) for c in clash})


HOSTILE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a null id keeps its row and words enough to shingle"), (5, "..."), (6, "x" * 5000), (7, "word " * 3000), (8, "same text here for ties and more"), (9, "same text here for ties and more"),
    (9, "same text here for ties and more"), (9, "another text under the same id"), (10, "é ü ß — 日本語 テキスト 🎉 0123"), (11, "\x00\x1f odd \x7f bytes"), (12, "tab\tand\x0bvt\x0cff\rcr"),
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe_equals_the_library_and_decodes_back(spark, reference):
    for df in (documents(spark), table(spark, HOSTILE)):
        rows = df.select("doc_id", "text").collect()
        want = []
        for r in rows:
            ids = reference.encode_ordinary(r.text or "")
            want.append((r.doc_id or -1, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = bpe.bpe_encode(df, RANKS, public_tokenizers.PATTERN).collect()
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_bpe_of_an_empty_table(spark):
    assert bpe.bpe_encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(table(spark, []), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_bpe_merges_long_runs_like_the_library(reference):
    ranks = bpe.load_ranks(RANKS)
    r = random.Random(1)
    for piece in [b"a" * 300, b"ab" * 150, bytes(r.choices(range(256), k=200)), b"=" * 2000, *(bytes(r.choices(b"abcde", k=r.randint(1, 40))) for _ in range(200))]:
        left = [piece[i : i + 1] for i in range(len(piece))]
        while True:  # the definition: least rank, leftmost
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            left[i : i + 2] = [left[i] + left[i + 1]]
        assert bpe.merge_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else [ranks[x] for x in left])


def test_bpe_decode_round_trip(spark):
    e = bpe.bpe_encode(table(spark, HOSTILE), RANKS, public_tokenizers.PATTERN)
    assert {bytes(r.decoded) for r in bpe.bpe_decode(e, RANKS).collect()} == {(t or "").encode() for _, t in HOSTILE}


def copies(seed=2):
    """Documents that share passages of 15 to 60 words, whole copies, and repeats within a document."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [[r.choice(words) for _ in range(n)] for n in (15, 19, 20, 21, 35, 60)]
    out = []
    for i in range(60):
        text = []
        for _ in range(r.randint(0, 5)):
            text += [r.choice(words) for _ in range(r.randint(0, 30))]
            if r.random() < 0.7:
                s = r.choice(shared)
                a = r.randint(0, 5)
                text += s[a:] if r.random() < 0.5 else s
        out.append((i, " ".join(text)))
    return out + [(100 + i, out[i % 60][1]) for i in range(0, 60, 7)] + [(200, " ".join(shared[5] * 3))]


@pytest.mark.parametrize("rows", [copies(), HOSTILE[:10] + HOSTILE[12:], []], ids=["copies", "hostile", "empty"])
def test_substring_dedup_equals_brute_force(spark, rows):
    got = substring_dedup.digest(substring_dedup.substring_dedup(table(spark, rows))).collect()
    want = substring_dedup.brute_force(rows)
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((i or -1, *w) for (i, _), w in zip(rows, want, strict=True))


def test_substring_dedup_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, DATA).collect()}
    assert got == {i: w for (i, _), w in zip(rows, substring_dedup.brute_force(rows), strict=True)}


def test_hot_anchors_are_cut_into_windows(spark, monkeypatch):
    """One passage in many documents that each go on in their own way, some alike, some with one word of the passage changed."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for i in range(150):
        body = list(passage)
        if i % 3 == 0:
            body[r.randrange(45)] = f"v{i % 9}"
        rows.append((r.randrange(120), " ".join([f"a{i % 40}x{j}" for j in range(25)] + body + [f"b{i % 50}x{j}" for j in range(25)])))
    rows += [(None, rows[0][1]), (7, None)]
    monkeypatch.setattr(substring_dedup, "ANCHOR_RUNS", 3)
    got = substring_dedup.digest(substring_dedup.substring_dedup(table(spark, rows))).collect()
    want = substring_dedup.brute_force(rows)
    assert sorted((x.doc_id or -1, x.n_words, x.n_removed, x.kept_sha256) for x in got) == sorted((i or -1, *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(w[1] for w in want) > 1000


def test_reference_spans(spark):
    ref = spark.createDataFrame([(" ".join(f"r{i}" for i in range(50)),), (None,)], "text string")
    docs = table(spark, [(1, "a b " + " ".join(f"r{i}" for i in range(10, 35)) + " c"), (2, " ".join(f"r{i}" for i in range(19))), (3, None)])
    out = {r.doc_id: r for r in substring_dedup.remove_reference_spans(docs, ref).collect()}
    assert out[1].text == "a b c" and out[1].n_removed == 25 and out[2].n_removed == 0 and out[3].n_words == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs, ref, most_bytes=10)


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_distance_equals_dynamic_programming():
    r = random.Random(3)
    for _ in range(300):
        p, t = [r.randint(0, 4) for _ in range(r.randint(1, 90))], [r.randint(0, 4) for _ in range(r.randint(0, 120))]
        masks = {}
        for i, x in enumerate(p):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.best_distance(masks, len(p), t)[0] == levenshtein_in(p, t)


def test_contamination_equals_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 40)))) for i in range(12)] + [(12, None), (13, "")]
    docs = []
    for d in range(80):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        if d % 2:
            item = r.choice(items[:12])[1].split()
            for _ in range(r.randint(0, 10)):
                k = r.randrange(len(item))
                item = r.choice([item[:k] + item[k + 1 :], item[:k] + [r.choice(words)] + item[k:], item[:k] + [r.choice(words).upper() + ","] + item[k + 1 :]]) or item
            text[len(text) // 2 : len(text) // 2] = item
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contamination(table(spark, docs + [(900, None)]), bench).collect()}
    want = {}
    for d, t in docs:
        norm = t.lower().replace(",", "").split()
        for i, text in items:
            p = (text or "").split()
            if p and (k := levenshtein_in(p, norm)) <= int(0.2 * len(p)):
                want[d, i] = k
    assert got == want and len(want) > 15
    clean = {x.doc_id for x in decontaminate.decontaminate(table(spark, docs), bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_short_items_must_occur_exactly(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "one two three four"), (4, " , "), (5, "alpha beta")], "item_id long, text string")
    rows = [(1, "Alpha, beta."), (2, "beta alpha"), (3, "x one two three four y"), (4, "one two tree four"), (5, None), (6, "")]
    assert {(x.doc_id, x.item_id, x.distance) for x in decontaminate.contamination(table(spark, rows), bench).collect()} == {(1, 1, 0), (1, 2, 0), (1, 5, 0), (2, 1, 0), (3, 3, 0)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(table(spark, rows), bench).collect()) == [4, 5, 6]


def test_contamination_hostile_and_long(spark):
    bench = spark.createDataFrame([(1, "word word word word word word"), (2, None)], "item_id long, text string")
    rows = HOSTILE + [(20, "word other " * 20_000)]
    got = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.contamination(table(spark, rows), bench).collect()}
    assert got == {(7, 1, 0)}
    kept = decontaminate.decontaminate(table(spark, rows + rows[:3]), bench)
    assert kept.count() == len(rows) + 3 - 1 and kept.columns == table(spark, rows).columns
    assert decontaminate.contamination(table(spark, []), bench).count() == 0


def test_contamination_in_blocks(spark, monkeypatch):
    whole = queries.op3_benchmark_decontamination(spark, DATA).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(queries.op3_benchmark_decontamination(spark, DATA).collect()) == sorted(whole) and whole
    assert decontaminate.contamination(documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_media_recall_and_hostile_rasters(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = queries.image_copies(spark, DATA).collect()
    asked = {r.vec_id for r in e.filter("vec_id % 20 = 0").collect()}
    hit = {r.query_id for r in found if r.query_id == r.image_id}
    assert len(hit) >= 0.9 * len(asked) and len(found) <= 1.2 * len(asked)
    odd = spark.createDataFrame([(1, None), (2, [1.0] * 3), (3, [float("nan")] * 64), (4, [0.0] * 64), (None, [0.1] * 64)], "vec_id long, embedding array<float>")
    assert media.copies(media.media_of(odd), media.media_of(odd)).count() == 0
    twice = media.media_of(e.limit(3)).unionAll(media.media_of(e.limit(3)))
    assert all(r.image_rows == 2 for r in media.copies(media.media_of(e.limit(3)), twice).collect())


def test_media_recall_of_each_edit(spark):
    """Of all edited copies of 70 images among 500, by kind, the share that the tables find, against all pairs of descriptors."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id")
    vectors = np.array([r.embedding for r in e.collect()], dtype=np.float32)
    rows, queries_ = [], []
    for i in range(70):
        kind = i % len(media.EDITS)
        image = media.edited(media.render(vectors[7 * i])[0], kind, i)
        queries_.append((7 * i, image.shape[0], image.tobytes(), kind))
    rows = [(i, media.SIDE, bytes(x.tobytes())) for i, x in enumerate(media.render(vectors))]
    q = spark.createDataFrame([x[:3] for x in queries_], "image_id long, side int, luma binary")
    b = spark.createDataFrame(rows, "image_id long, side int, luma binary")
    found = {(r.query_id, r.image_id) for r in media.copies(q, b).collect()}
    once = ["image_id", "digest", "side", "y", "x", "level", "angle", *media.WORDS]
    every = media.descriptors(q).select(once).distinct().alias("q").crossJoin(media.descriptors(b).select(once).distinct().alias("b")).filter(media.distance("q", "b") <= media.HAMMING)
    force = {(r.query_id, r.image_id) for r in media.agreeing(every.select(F.struct("q.*").alias("q"), F.struct("b.*").alias("b"))).collect()}
    assert len(found & force) >= 0.9 * len(force) and found <= force and len(force) >= 60
    kinds = {x[0]: x[3] for x in queries_}
    hit = [np.mean([(i, i) in found for i, k in kinds.items() if k == kind]) for kind in range(len(media.EDITS))]
    assert min(hit) >= 0.9 and len({p for p in found if p[0] != p[1]}) <= 3, dict(zip(media.EDITS, hit, strict=True))


def test_hamming_tables_miss_none_that_they_must_meet(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").limit(60)
    base, asked = media.descriptors(media.media_of(e)), media.descriptors(media.media_of(e.filter("vec_id % 4 = 0"), edit=True))
    marked = spark.sparkContext.broadcast(media.bitmap_of(asked))
    name = lambda r: (r.image_id, r.y, r.x, r.level)
    rows = [{name(r): [r[w] for w in media.WORDS] for r in t.collect()} for t in (asked, base)]
    bits = [np.array(list(x.values()), dtype=np.int64).view(np.uint64) for x in rows]
    apart = np.bitwise_count(bits[0][:, None] ^ bits[1][None]).sum(-1)
    names = [list(x) for x in rows]
    pairs = lambda most: {(names[0][i], names[1][j]) for i, j in zip(*np.nonzero(apart <= most), strict=True)}
    for table_ in (base, media.descriptors(media.media_of(e), marked)):
        got = {(name(r.q), name(r.b)) for r in media.descriptor_pairs(asked, table_).collect()}
        assert pairs(media.EXACT) <= got <= pairs(media.HAMMING) and len(got) > 300
    assert media.descriptors(media.media_of(e), marked).count() < 0.5 * base.count()


def test_copy_classes_count_links_and_join_groups(spark):
    pairs = [(1, 10, 5), (1, 11, 9), (2, 11, 7), (3, 20, 6), (40, 3, 8), (40, 40, 30)]
    got = {(r.kind, r.id): (r.class_id, r.links, r.votes) for r in media.copy_classes(spark.createDataFrame(pairs, "query_id long, image_id long, votes long")).collect()}
    assert got == {("query", 1): (10, 2, 9), ("query", 2): (10, 1, 7), ("image", 10): (10, 1, 5), ("image", 11): (10, 2, 9), ("query", 3): (20, 1, 6), ("image", 20): (20, 1, 6), ("query", 40): (3, 2, 30), ("image", 3): (3, 1, 8), ("image", 40): (3, 1, 30)}
    assert media.copy_classes(spark.createDataFrame([], "query_id long, image_id long, votes long")).count() == 0


def test_a_group_of_near_copies_gives_a_row_each(spark):
    """A query's links grow with its group, the result's rows with the images."""
    r = np.random.default_rng(1)
    base = r.normal(0, 0.125, 64)
    rows = [(i, [float(x) for x in base + r.normal(0, 0.002, 64)]) for i in range(80)] + [(i, [float(x) for x in r.normal(0, 0.125, 64)]) for i in range(80, 120)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = media.copy_classes(media.copies(media.media_of(e.filter("vec_id % 20 = 0"), edit=True), media.media_of(e))).collect()
    group = [x for x in got if x.class_id == 0]
    assert sum(x.kind == "image" for x in group) >= 72 and sum(x.kind == "query" for x in group) == 4 and len(got) <= 80 + 4 + 4
    assert all(x.links >= 60 for x in group if x.kind == "query")


def test_copies_lose_no_link(spark, monkeypatch):
    """Pairs and votes are those of all pairs of descriptors within the distance, in one block or many; groups are the pairs' classes."""
    r = np.random.default_rng(4)
    near = r.normal(0, 0.125, 64)
    rows = [(i, [float(x) for x in near + r.normal(0, 0.01, 64)]) for i in range(30)] + [(i, [float(x) for x in r.normal(0, 0.125, 64)]) for i in range(30, 50)] + [(i, [float(x) for x in near]) for i in range(50, 60)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q, b = media.media_of(e.filter("vec_id % 4 = 0"), edit=True), media.media_of(e)
    q = q.unionAll(q.filter("image_id < 20")).unionAll(q.filter("image_id = 52").withColumn("image_id", F.lit(8).cast("long"))).unionAll(q.filter("image_id = 40").withColumn("image_id", F.lit(1000).cast("long")))
    once = ["image_id", "digest", "side", "y", "x", "level", "angle", *media.WORDS]
    one = media.descriptors(b).groupBy(*once[1:]).agg(F.min("image_id").alias("image_id"))
    every = media.descriptors(q).select(once).distinct().alias("q").crossJoin(one.alias("b")).filter(media.distance("q", "b") <= media.HAMMING)
    force = sorted((x.query_id, x.image_id, x.votes) for x in media.agreeing(every.select(F.struct("q.*").alias("q"), F.struct("b.*").alias("b"))).collect())
    assert len({x[0] for x in force}) >= 12 and any(x[0] == 1000 for x in force)
    for blocks in ({}, {"QUERY_BLOCK": 5, "IMAGE_BLOCK": 7, "STEP": 100, "VOTES": 50}):
        for name, value in blocks.items():
            monkeypatch.setattr(media, name, value)
        found = media.copies(q, b)
        assert sorted((x.query_id, x.image_id, x.votes) for x in found.collect()) == force
        groups = sorted(media.copy_groups(q, b).collect())
        assert groups == sorted(media.copy_classes(found).collect()) and len(groups) > 40


def test_blocks_of_images_are_not_copied_for_each_block_of_queries(spark, monkeypatch):
    """However many pairs of blocks there are, an exchange sees an image and a query once: no row is multiplied before one."""
    monkeypatch.setattr(media, "QUERY_BLOCK", 3)
    monkeypatch.setattr(media, "IMAGE_BLOCK", 10)
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id < 60")
    plan = media.copies(media.media_of(e.filter("vec_id % 4 = 0"), edit=True), media.media_of(e))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("CartesianProduct") == 1


def test_media_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert media.copy_groups(media.media_of(none, edit=True), media.media_of(none)).count() == 0
    assert media.copies(media.media_of(none, edit=True), media.media_of(none)).count() == 0


def test_licenses(spark):
    mit = "\n".join(licenses.SENTENCES[k] for k in ("mit-title", "mit-grant", "mit-condition", "mit-warranty"))
    rows = [(1, "x\nReleased under the MIT License.\nAll rights reserved."), (2, "Words. licensed under the apache license version 2.0!"), (3, mit), (4, "not released under the MIT License."), (5, None), (6, ""), (7, licenses.SENTENCES["bsd-grant"])]
    out = {r.doc_id: r for r in licenses.license_scan(table(spark, rows)).collect()}
    assert [out[i].licenses for i in range(1, 8)] == ["MIT,all-rights-reserved", "Apache-2.0", "MIT", "", "", "", ""]
    assert out[3].n_matches == 1 and out[7].n_sentences == 1
    by_text = {r.doc_id for r in documents(spark).filter("text rlike '(?m)^(Released under the MIT License|Licensed under|This work is licensed under|All rights reserved)'").collect()}
    assert by_text == {r.doc_id for r in queries.op5_license_scan(spark, DATA).collect() if r.licenses}


def jaccard(a, b):
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def test_every_rule_is_told_from_its_own_sentences():
    known = licenses.SentenceRules.build()
    for name, rule in licenses.RULES:
        for lines in ([licenses.SENTENCES[k] for k in rule], [x for k in rule for x in textwrap.wrap(licenses.SENTENCES[k], 50)]):
            assert [x[0] for x in known.match(known.sequences(["\n".join(lines).encode()])[0])] == [name]
        if len(rule) > 1:  # a rule's last sentence alone is not it
            got = known.match(known.sequences([licenses.SENTENCES[rule[-1]].encode()]).get(0, []))
            assert name not in [x[0] for x in got]


def rules_by_force(sequence, rules, gap):
    """Rules in order; each takes its leftmost fit among untaken sentences, again and again."""
    taken, out = set(), []
    for name, rule in rules:
        for i in range(len(sequence)):
            picked = []
            for k in range(i, len(sequence)):
                if k in taken:
                    continue
                if picked and sequence[k][0] - sequence[picked[-1]][0] > gap + 1:
                    break
                if sequence[k][1] == rule[len(picked)]:
                    picked.append(k)
                    if len(picked) == len(rule):
                        break
                elif not picked:
                    break
            if len(picked) == len(rule):
                taken.update(picked)
                out.append((name, sequence[picked[0]][0], sequence[picked[-1]][0]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def test_rule_matching_equals_brute_force():
    r = random.Random(8)
    for _ in range(400):
        rules = [(f"r{k}", tuple(r.randrange(4) for _ in range(r.randint(1, 3)))) for k in range(4)]
        places = sorted(r.sample(range(40), r.randint(0, 20)))
        sequence = [(p, r.randrange(4)) for p in places]
        own = licenses.SentenceRules(np.array([], dtype=np.uint64), [], [], rules)
        assert own.match(sequence) == rules_by_force(sequence, rules, licenses.GAP)


def test_licenses_hostile_long_and_empty(spark):
    rows = HOSTILE + [(30, "Released under the MIT License.\n" * 20_000), (31, "Released under the MIT License."), (31, "Released under the MIT License.")]
    out = licenses.license_scan(table(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r.n_matches) for r in out if r.n_matches) == [(30, 20_000), (31, 1), (31, 1)]
    assert licenses.license_scan(table(spark, [])).count() == 0


def test_wrapped_licenses():
    t = licenses.SENTENCES
    wrap = lambda mark, *names: "\n".join(mark + x for n in names for x in [*textwrap.wrap(t[n], 60), ""])
    apache = "Copyright 2020 A Name\n\n" + wrap("", "apache-header") + "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by law"
    texts = {
        "MIT": [wrap(m, "mit-title") + "Copyright (c) 2020 A Name\n\n" + wrap(m, "mit-grant", "mit-condition", "mit-warranty") for m in ("", "// ", " * ", "# ", "REM ")],
        "BSD-3-Clause": [wrap("", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), wrap("", "bsd-grant") + "1. " + wrap("   ", "bsd-source") + "2. " + wrap("", "bsd-binary") + "3. " + wrap("", "bsd-name")],
        "GPL-3.0-or-later": [wrap("# ", "gpl-free", "gpl-hope")],
        "GPL-2.0-or-later": [wrap("# ", "gpl2-free", "gpl-hope")],
        "Apache-2.0": [apache, "\n".join("# " + x for x in apache.split("\n"))],
        "AGPL-3.0-or-later": [wrap("", "gpl-free").replace("General", "Affero General") + wrap("", "gpl-hope"), wrap("// ", "agpl-free", "gpl-hope")],
        "": [wrap("", "gpl-free").replace("General", "Other General") + wrap("", "gpl-hope"), wrap("", "mit-grant") + "a.\nb.\nc.\n" + wrap("", "mit-condition", "mit-warranty")],
    }
    known = licenses.SentenceRules.build()
    for name, some in texts.items():
        for i, x in enumerate(some):
            got = known.sequences([b"other words", x.encode(), b""])
            assert ",".join(m[0] for m in known.match(got.get(1, []))) == name, (name, i, got)
            assert set(got) <= {1}


def test_probability_jaccard_and_signatures():
    r = random.Random(1)
    pack = lambda d: np.array(sorted(k | v for k, v in d.items()), dtype=np.uint64)
    for _ in range(100):
        a = {r.randrange(60) << 16: r.randint(1, 4) for _ in range(40)}
        b = {k: v for k, v in a.items() if r.random() < 0.9} | {r.randrange(60) << 16: r.randint(1, 4) for _ in range(6)}
        assert near_dedup.similarity(pack(a), pack(b)) == pytest.approx(jaccard(a, b))
        assert near_dedup._against(pack(a), [pack(b)], 1.1)[0] >= jaccard(a, b) - 1e-9  # the bound
    sets = [{i << 16: 1 + i % 3 for i in range(100)}, {i << 16: 1 + i % 3 for i in range(20, 110)}, {}, {5 << 16: 2}]
    doc = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)]).astype(int)
    s = near_dedup.signatures(doc, np.array([k for x in sets for k in x], dtype=np.uint64), np.array([v for x in sets for v in x.values()]), 4, 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(jaccard(sets[0], sets[1]), abs=0.03) and not s[2].any() and (s[3] == 5 << 16).all()


def classes_by_force(rows):
    doc, value, count, content = near_dedup.weighted_shingles([(t or "").encode() for _, t in rows])
    sets = [dict(zip(value[doc == i].tolist(), count[doc == i].tolist(), strict=True)) for i in range(len(rows))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (content[i] == content[j] or jaccard(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = [i if i is not None else common.MAX_ID for i, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), common.MAX_ID), ids[i])
    return sorted((ids[i], least[find(i)]) for i in range(len(rows)))


def test_large_counts_and_exact_ties():
    value, count = np.array([1 << 16, 2 << 16, 3 << 16], dtype=np.uint64), np.array([1, 200_000, 65_535])
    packed = near_dedup.pack(value, count)
    got = near_dedup._unpack(packed, np.zeros(len(packed), dtype=int))
    assert got[0].tolist() == value.tolist() and got[1].tolist() == count.tolist()
    a, b = {1 << 16: 200_000, 2 << 16: 7}, {1 << 16: 100_000, 2 << 16: 7, 3 << 16: 90_000}
    arrays = [near_dedup.pack(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    assert near_dedup.similarity(*arrays) == pytest.approx(jaccard(a, b))
    for shared, of in ((4, 5), (8, 10), (16, 20), (12, 15)):  # exactly 0.8, each shingle once or twice
        for n in (1, 2, 3):
            x, y = {i << 16: n for i in range(shared)}, {i << 16: n for i in range(of)}
            arrays = [near_dedup.pack(np.array(sorted(k), dtype=np.uint64), np.array(list(k.values()))) for k in (x, y)]
            assert len(near_dedup.bucket_links(arrays, 0.8)) == 1 and not near_dedup.bucket_links(arrays, 0.801)


def near_copies():
    r = random.Random(9)
    base = [[f"{r.choice('abcdefgh')}{r.randint(0, 99)}" for _ in range(r.randint(60, 160))] for _ in range(12)]
    rows = []
    for i in range(70):
        t = list(base[i % 12])
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = "edit"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("rows", [near_copies(), [x for x in HOSTILE], []], ids=["copies", "hostile", "empty"])
def test_near_duplicates_equal_brute_force(spark, rows):
    got = near_dedup.near_duplicate_classes(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes_by_force(rows)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_TEXTS", 4)
    monkeypatch.setattr(near_dedup, "BUCKET_CENTRES", 2)
    rows = near_copies()
    got = near_dedup.near_duplicate_classes(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes_by_force(rows)


def test_parts_of_a_large_bucket_meet(spark, monkeypatch):
    """Pairs of texts that differ in a last word share all their buckets but one or two; each text is a part, and few are centres."""
    monkeypatch.setattr(near_dedup, "BUCKET_TEXTS", 1)
    monkeypatch.setattr(near_dedup, "BUCKET_CENTRES", 1)
    rows = [(2 * i + k, " ".join(f"{i}x{j}" for j in range(90)) + f" end{k}") for i in range(30) for k in range(2)] + near_copies()
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = near_dedup.near_duplicate_classes(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes_by_force(rows)


def test_no_pair_at_the_threshold_misses_all_bands(spark):
    """Every two different texts of a thousand documents that share a shingle, by exact similarity."""
    texts = sorted({(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()})
    doc, value, count, _ = near_dedup.weighted_shingles(texts)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [near_dedup.pack(value[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    bands = near_dedup.signatures(doc, value, count, len(texts)).reshape(len(texts), near_dedup.BANDS, near_dedup.ROWS)
    found = 0
    for i in range(len(texts)):
        others = [j for j in range(i) if len(sets[j]) and 0.4 * len(sets[i]) <= len(sets[j]) <= 2.5 * len(sets[i])] if len(sets[i]) else []
        if others:
            alike = near_dedup._against(sets[i], [sets[j] for j in others], 0.8)
            for j in np.array(others)[alike >= 0.8].tolist():
                found += 1
                assert (bands[i] == bands[j]).all(axis=1).any()
    assert found >= 5


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.label for r in components.components(e).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100
    assert components.components(e.limit(0)).count() == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op7_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").collect()
    assert len(out) > 100 and np.mean([r.lang_pred == r.lang for r in out]) >= 0.98 and all(0 <= r.score <= 1 for r in out)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    model = langid.LanguageModel.fit([("en", "the", 9), ("en", "house", 2), ("de", "das", 9), ("de", "haus", 2)])
    got = {r.doc_id: r for r in langid.predict(table(spark, [*HOSTILE[:5], (50, "das haus"), (51, "houses"), (52, "12 34"), (53, "日本")]), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[52].lang_pred == "und" and got[50].lang_pred == "de" and got[51].lang_pred == "en" and got[53].score == 0.5
    assert langid.predict(table(spark, [(1, "a")]), langid.LanguageModel.fit([])).first().lang_pred == "und"


def test_words_are_letters_with_their_marks():
    assert langid.words("½ ² ⅷ 12 _") == [] and langid.words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and langid.words("ภาษาไทย ดี") == ["ภาษาไทย", "ดี"]
    assert langid.words("x² Straße\u0301a don't") == ["x", "straße\u0301a", "don", "t"] and langid.words("\u0301abc") == ["abc"]


def test_language_id_of_a_rare_language_and_of_other_scripts(spark):
    rows = [(i, f"the cat number {chr(97 + i % 26)} sat", "en") for i in range(400)] + [(1000 + i, "हिन्दी भाषा अच्छी है", "hi") for i in range(5)] + [(2000, None, "xx"), (2001, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_rows=20)
    assert model.languages == ["en", "hi"]
    got = {r.doc_id: r for r in langid.predict(table(spark, [(1, "यह हिन्दी भाषा है"), (2, "½ ² ⅷ"), (3, "the cat"), (4, "the cat " * 50_000), (4, "the cat")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["hi", "und", "en", "en"] and got[2].score == 0
    assert langid.fit(docs.limit(0)).languages == [] and langid.predict(table(spark, []), model).count() == 0


def test_language_sample_takes_a_bounded_number_of_each_language(spark):
    rows = [(i, f"w{i}", "en" if i % 10 else "fr") for i in range(3000)] + [(i, f"w{i}", "de") for i in range(3)] + [(5000, "same", "es")] * 40
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50).groupBy("lang").agg(F.countDistinct("h").alias("n")).collect()
    assert {r.lang: r.n for r in got} == {"en": 50, "fr": 50, "de": 3, "es": 1}


def test_language_scores_equal_a_plain_computation(spark):
    counts = [("en", "the", 9), ("en", "house", 2), ("en", "a", 4), ("de", "das", 9), ("de", "haus", 2), ("fr", "la", 3), ("fr", "the", 1)]
    model, langs = langid.LanguageModel.fit(counts), ["de", "en", "fr"]

    def logs(tables):  # tables: one dictionary a language
        keys = set().union(*tables)
        raw = {k: [math.log((t.get(k, 0) + 0.5) / (sum(t.values()) + 0.5 * len(keys))) for t in tables] for k in keys}
        return {k: [x - sum(v) / len(v) for x in v] for k, v in raw.items()}

    words = [{w: n for l, w, n in counts if l == lang} for lang in langs]
    known, by_size = logs(words), {}
    for n in range(1, 6):
        tables = []
        for t in words:
            found = {}
            for w, k in t.items():
                marked = w if n == 1 else f"\x02{w}\x03"
                for i in range(len(marked) - n + 1):
                    found[marked[i : i + n]] = found.get(marked[i : i + n], 0) + k
            tables.append(found)
        by_size[n] = logs(tables)

    def word(w):
        if w in known:
            return known[w]
        for n in range(5, 0, -1):
            marked = w if n == 1 else f"\x02{w}\x03"
            hits = [by_size[n][g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in by_size[n]]
            if hits:
                return [sum(h[k] for h in hits) / len(hits) for k in range(3)]
        return [0.0, 0.0, 0.0]

    rows = [(1, "the houses"), (2, "das hau la"), (3, "ZZZ qqq"), (4, "a a the la"), (5, "laus thé")]
    for r in langid.predict(table(spark, rows), model).collect():
        found = langid.words(dict(rows)[r.doc_id])
        z = [sum(word(w)[k] for w in found) / math.sqrt(len(found)) for k in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        best = z.index(max(z))
        assert r.lang_pred == langs[best] and r.score == pytest.approx(p[best] / sum(p), abs=1e-5)


def test_language_is_not_an_input_of_its_prediction(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    a = sorted(langid.predict(docs, model).collect())
    b = sorted(langid.predict(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("?")}), model).collect())
    assert a == b


@pytest.mark.parametrize("rows", [HOSTILE, [(i, "same") for i in range(100)], [(1, "one")], []], ids=["hostile", "group", "one", "empty"])
def test_sharding_law(spark, rows):
    out = sharding.hilbert_shards(table(spark, rows), 7).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in out) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert not rows or max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(r.grown_shard is None and r.law == "rows" for r in out)


def test_sharding_order_is_a_hilbert_curve_and_groups_are_runs(spark):
    g = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    path = g.select("*", sharding.hilbert_index([F.col(x) for x in "abc"], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in path] == list(range(512))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(path, path[1:], strict=False))
    out = queries.op8_hilbert_sharding(spark, DATA).orderBy("shard", "slot").collect()
    curve = [r.curve for r in out]
    assert curve == sorted(curve)
    runs = [k for i, k in enumerate(r.text_crc32 for r in out) if i == 0 or out[i - 1].text_crc32 != k]
    assert len(runs) == len(set(runs))
    assert "Python" not in queries.op8_hilbert_sharding(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_sharding_cells_follow_whole_names(spark):
    rows = [(i, f"t{i:03d}", "en", f"common-source-{k}", 1) for i, k in enumerate("abcd" * 30 + "b" * 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sharding.name_cuts(df, "source", 5) == [f"common-source-{k}" for k in "bcd"] and sharding.name_cuts(df.limit(0), "source", 5) == []
    out = sharding.hilbert_shards(df, 8).join(df.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert sum(r.n for r in out) <= 8 + 3  # each source is one run of rows: a shard holds two where a source ends
    many = spark.createDataFrame([(i, "t", "en", f"s{i:05d}", 1) for i in range(1000)], SCHEMA)
    cuts = sharding.name_cuts(many, "source", 3)
    assert len(cuts) == 7 and all(abs(int(x[1:]) - 125 * (k + 1)) <= 1 for k, x in enumerate(cuts))


def test_sharding_frequent_texts_lie_together(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}", "en" if i % 2 else None, f"s{i % 7}", 1) for i in range(300)]
    for hot in (1, 1_000):
        monkeypatch.setattr(sharding, "HOT_PARTS", hot)
        out = sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA), 5).orderBy("shard", "slot").collect()
        runs = [k for i, k in enumerate(r.text_crc32 for r in out) if i == 0 or out[i - 1].text_crc32 != k]
        assert len(runs) == len(set(runs)) and len(out) == 300


def test_quality_held_out_and_hostile(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op9_quality_classifier(spark, sf)
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert out.count() == 1000 and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out.collect())
    for model in (quality.QualityModel.fit([]), quality.QualityModel.fit([(1, np.array([3]), np.array([1.0], dtype=np.float32))])):
        got = quality.score(table(spark, HOSTILE).drop("score"), model).collect()
        assert len(got) == len(HOSTILE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_scores_equal_a_plain_computation(spark):
    """Mean of the odds of every token's and n-gram's bucket, a token that repeats the one before read as the common token."""
    r = np.random.default_rng(4)
    model = quality.QualityModel(r.normal(0, 3, quality.BUCKETS).astype(np.float32), 0.25)
    rows = HOSTILE + [(20, "a a a b b a"), (21, "x y z " * 20_000), (22, "é é 日本 日本")]

    def buckets(token):
        marked = [ord(ch) for ch in f"<{token}>"]
        base, out = quality._POWERS.base, []
        whole = sum(x * pow(base, i, 1 << 64) for i, x in enumerate(marked)) + len(marked)
        mix = lambda h: int(common.mix(np.array([h % (1 << 64)], dtype=np.uint64))[0])
        out.append(mix(whole) % quality.BUCKETS)
        for n in (2, 3, 4):
            for i in range(len(marked) - n + 1):
                h = n
                for x in marked[i : i + n]:
                    h = (h * 0x100000001B3 + x) % (1 << 64)
                out.append(mix(h) % quality.BUCKETS)
        return out

    table_of = {}
    for got in quality.score(table(spark, rows).drop("score"), model, ("doc_id", "text")).collect():
        tokens = (got.text or "").split()
        tokens = [quality.REPEAT if i and t == tokens[i - 1] else t for i, t in enumerate(tokens)]
        for t in set(tokens) - set(table_of):
            table_of[t] = [float(model.odds[b]) for b in buckets(t)]
        found = [x for t in tokens for x in table_of[t]]
        z = 0.25 + (sum(found) / len(found) if found else 0)
        assert got.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6), got.doc_id
    assert quality.score(table(spark, []).drop("score"), model).count() == 0


def test_quality_fit_is_bounded_in_bytes_and_takes_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(i, f"good{i} words" if i % 2 else f"bad{i} text") for i in range(40)] + [(1, "another text")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1)] * 5, "doc_id long, quality int")
    seen = []
    own = quality.QualityModel.fit
    try:
        quality.QualityModel.fit = classmethod(lambda cls, rows: seen.append(len(rows)) or own(rows))
        quality.fit(docs, labels)
        quality.fit(docs, labels, sample_bytes=500)
        quality.fit(docs, labels, sample_bytes=1)
    finally:
        quality.QualityModel.fit = own
    assert seen[0] == 40 and 0 < seen[1] < 10 and seen[2] == 0


def test_quality_sample_is_bounded_and_repeatable(spark):
    docs = documents(spark).select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    a, b = quality.fit(docs, labels, 30), quality.fit(docs.repartition(5), labels.repartition(3), 30)
    assert np.array_equal(a.odds, b.odds) and a.offset == b.offset


def test_line_templates(spark):
    rows = [(i, f"Header of page {i} here now\nunique words number {chr(97 + i)} only in {chr(98 + i)}{chr(99 + i)} this\nshort one") for i in range(15)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, rows), keep=("lang", "n_chars")).collect()}
    assert "Header" in out[0].text and all("Header" not in out[i].text for i in range(1, 15))
    assert all("short one" in r.text and r.lang == "en" for r in out.values())
    everywhere = line_dedup.line_dedup(table(spark, rows), keep_first=False).collect()
    assert all("Header" not in r.text for r in everywhere)
    few = line_dedup.line_dedup(table(spark, rows[:9])).collect()
    assert all(r.n_dropped == 0 for r in few)


def lines_by_force(rows, documents=line_dedup.MIN_DOCUMENTS):
    """The tree, built over all rows at once with plain Python tokens."""
    leaves = {}
    for i, t in rows:
        seen = {}
        for n, line in enumerate((t or "").encode().split(b"\n")):
            tokens = tuple(b"<*>" if any(48 <= c < 58 for c in w) else w for w in line.split())
            if len(tokens) >= 4:
                seen.setdefault(tokens, []).append(n)
        for tokens, at in seen.items():
            e = leaves.setdefault((len(tokens), tokens[:3]), {}).setdefault(tokens, [0, (i, at[0]), []])
            e[0] += 1
            e[1] = min(e[1], (i, at[0]))
            e[2] += [(i, n) for n in at]
    gone = set()
    for leaf in leaves.values():
        groups = []
        for tokens, e in sorted(leaf.items(), key=lambda x: x[1][1]):
            best, agree = None, -1
            for gr in groups:
                n = sum(f and a == b for a, b, f in zip(gr[0], tokens, gr[1], strict=True))
                if n > agree:
                    best, agree = gr, n
            if best and agree >= 0.7 * len(tokens):
                best[1] = [f and a == b for a, b, f in zip(best[0], tokens, best[1], strict=True)]
            else:
                fixed = [w != b"<*>" for w in tokens]
                best = [tokens, fixed if any(fixed) else [True] * len(tokens), 0, [], e[1]]
                groups.append(best)
            best[2] += e[0]
            best[3] += e[2]
            best[4] = min(best[4], e[1])
        for gr in groups:
            if gr[2] >= documents:
                gone |= {p for p in gr[3] if p != gr[4]}
    return gone


def test_line_dedup_equals_the_whole_tree(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    gone = lines_by_force(rows)
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents(spark)).collect()}
    for i, t in rows:
        assert got[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
    assert gone


@pytest.mark.parametrize("rows", [HOSTILE, []], ids=["hostile", "empty"])
def test_line_dedup_hostile(spark, rows):
    out = line_dedup.line_dedup(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == sorted((i or -1, t or "") for i, t in rows)


def test_full_nodes_of_the_tree_split():
    r = np.random.default_rng(1)
    lines = np.unique(r.integers(1, 6, (300, 6)).astype(np.uint64), axis=0)
    lines[:, 0] = 7
    lines = np.unique(lines, axis=0)
    out = line_dedup.leaf_templates(lines, 1, 1.0, node_lines=10)
    assert len(set(out.tolist())) == len(lines)  # at similarity 1 every line is its own template, split or not


def test_full_leaves_give_the_same_templates():
    r = np.random.default_rng(2)
    for width, kinds in ((4, 3), (5, 40), (7, 4), (10, 3), (12, 30), (20, 2)):
        lines = r.integers(1, kinds + 1, (600, width)).astype(np.uint64)
        lines[r.random(lines.shape) < 0.1] = line_dedup._FIELD
        lines[:, 0], lines[:, 1] = 7, line_dedup._FIELD
        lines = r.permutation(np.unique(lines, axis=0))
        assert (line_dedup.leaf_templates(lines, 3, 0.7, node_lines=3) == line_dedup.templates(lines, 0.7, node_lines=len(lines))).all()
    fields = np.full((1, 6), line_dedup._FIELD, dtype=np.uint64)
    lines = np.concatenate([fields, r.integers(1, 5, (80, 6)).astype(np.uint64)])
    lines[40:, :5] = np.where(r.random((41, 5)) < 0.8, line_dedup._FIELD, lines[40:, :5])
    lines = r.permutation(np.unique(lines, axis=0))
    assert (line_dedup.leaf_templates(lines, 3, 0.7, node_lines=3) == line_dedup.templates(lines, 0.7, node_lines=len(lines))).all()


def test_a_template_with_a_name_recurs_beyond_a_full_leaf():
    lines = np.array([[1, 2, 3, 100 + i, 5, 6, 7] for i in range(50)], dtype=np.uint64)
    assert len(set(line_dedup.leaf_templates(lines, 3, 0.7, node_lines=10).tolist())) == 1


def test_group_count_of_a_join_follows_its_inputs(spark):
    docs = documents(spark)
    joined = docs.join(docs.select("doc_id", F.col("text").alias("other")), "doc_id")
    assert common.input_bytes(docs) <= common.input_bytes(joined) <= 4 * common.input_bytes(docs)
    assert common.input_bytes(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")) < 10_000


def test_line_dedup_of_a_leaf_over_many_groups(spark):
    """A template whose names differ in every document, with repeated, null and far ids, over more groups than rows a task."""
    rows = [(i % 90 if i % 11 else None, f"Posted here by user{chr(97 + i % 26)}{chr(97 + i // 26)} on our board today\nbody {i} of the text number {chr(97 + i % 26)} here") for i in range(200)]
    got = line_dedup.line_dedup(table(spark, rows)).collect()
    kept = [r for r in got if "Posted" in r.text]
    # both lines are templates; two rows of the least id hold each on the same line, and both stay
    assert [r.doc_id for r in kept] == [0, 0] and sum(r.n_dropped for r in got) == 2 * 198 and len(got) == 200


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_words_do_not_depend_on_slices(monkeypatch, most):
    r = random.Random(6)
    texts = ["".join(r.choice("ab é\n\t.") for _ in range(r.randint(0, 400))).encode() for _ in range(30)] + [b"x" * 500, b""]
    whole = common.Words(texts, common.SPACE)
    monkeypatch.setattr(common, "SLICE_BYTES", most)
    cut = common.Words(texts, common.SPACE)
    assert np.array_equal(whole.hashes, cut.hashes) and np.array_equal(whole.starts, cut.starts) and np.array_equal(whole.first, cut.first)
    for i, t in enumerate(texts):
        a, b = whole.first[i], whole.first[i + 1]
        assert [t[s:e] for s, e in zip(whole.starts[a:b], whole.ends[a:b], strict=True)] == t.split()
