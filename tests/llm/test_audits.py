"""URL filter, phrase mining and source audit against brute force; texts that collide modulo a power of two in every operator that hashes words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stereoloom.llm import common, decontaminate, licenses, line_dedup, near_dedup, phrases, source_audit, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("term", "n", "cells", "p", "rank", "phrase", "a", "l", "r", "score", "deal", "suffix", "host", "path", "rule")})


def corpus(seed=1):
    r = random.Random(seed)
    words = ["the", "The", "of", "a\x01b", "a", "ab", "été", "日本", "x-1", "\x00", "\x08z", "it's"]
    rows = [(i, " ".join(r.choices(words, [9, 3, 5, 1, 2, 1, 1, 1, 1, 1, 1, 1], k=r.randint(0, 60))).replace(" of", r.choice([" of", ", of", "\nof", "\tof", " of."])), r.choice(["en", "en", "de", None]), r.choice(["s0", "s0", "s1", "s2", None])) for i in range(150)]
    rows += [(7, "of the of the of the", "en", "s0")] * 40 + [(200, None, "en", "s1"), (None, "", None, None), (201, "the " * 3000, "en", "s3"), (202, "...", "fr", "s0"), (203, "alone", "it", "s0")]
    return rows


def phrases_by_force(rows, least, top=2000):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    count[lang][words[i : i + k]] += 1
    out = []
    for lang, f in count.items():
        found = []
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        for p, a in often.items():
            if any(len(q) > len(p) and n >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in often.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, hot):
    if hot:  # every prefix that a document shows often is dealt by one word more
        monkeypatch.setattr(phrases, "SAMPLE", 1)
    rows = corpus()
    df = table(spark, rows)
    if hot:
        assert len(phrases.hot_prefixes(df.select("lang", "text").na.fill("", ["lang", "text"]))) > 1
    assert sorted(map(tuple, phrases.collocations(df, least=6).collect())) == phrases_by_force(rows, 6)
    assert sorted(map(tuple, phrases.collocations(df, least=6, top=3).collect())) == phrases_by_force(rows, 6, 3)


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(table(spark, []), least=1).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None, None), (2, " .,\n", "en", "s")]), least=1).count() == 0


@pytest.mark.parametrize("most", [8, 64, 1 << 23])
def test_suffixes_do_not_depend_on_chunks(monkeypatch, most):
    texts = ["one two three four five six. seven eight nine ten eleven", "x" * 100 + " y", "a,b,c d e f g h i j", "", "é ü ß 日本 語"]
    monkeypatch.setattr(phrases, "CHUNK_BYTES", most)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    got = Counter()
    for b in phrases._suffixes(frozenset())(iter([batch])):
        for suffix, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            got[suffix.removeprefix(b"656e\0")] += n
    want = Counter()
    for text in texts:
        for piece in re.split(r"[.,]", text):
            words = piece.encode().split()
            want.update(b"\0".join(words[i : i + 5]) for i in range(len(words)))
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_prefix_counts_do_not_depend_on_batches(size):
    r = random.Random(size)
    keys = Counter(b"\0".join([b"656e" if r.random() < 0.7 else b"6465", *[r.choice([b"a", b"b", b"ab", b"\x01"]) for _ in range(r.randint(1, 5))]]) for _ in range(3000))
    want = Counter()
    for key, n in keys.items():
        words = key.split(b"\0")
        for j in range(1, len(words) + 1):
            want[b"\0".join(words[:j])] += n
    hot = {phrases._code(phrases._code(0, b"en"), b"a")}
    hot.add(phrases._code(next(iter(hot)), b"ab"))
    order = sorted(keys, reverse=True)
    for hot_now in (frozenset(), frozenset(hot)):
        stack = phrases._PrefixStack(hot_now, 20)
        for i in range(0, len(order), size):
            some = order[i : i + size]
            stack.feed(pa.array(some, pa.binary()), np.array([keys[k] for k in some]))
        stack.close()
        always = {b"656e", b"6465"} | ({b"656e\0a", b"656e\0a\0ab"} if hot_now else set())
        assert sorted(stack.out) == sorted((k, n) for k, n in want.items() if n >= 20 or k in always)


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 64 bits for large corpora; decimals carry it."""
    a, n, l, r = 3 * 10**11, 2 * 10**13, 10**12, 5 * 10**11
    wide = lambda x, d: F.lit(x).cast(f"decimal({d},0)")
    score = F.call_function("div", (wide(a, 17) * (F.lit(1000).cast("decimal(4,0)") * wide(n, 16))).cast("decimal(38,0)"), (wide(l, 18) * wide(r, 18)).cast("decimal(38,0)"))
    assert spark.range(1).select(score.alias("s")).first().s == 1000 * a * n // (l * r)
    share = source_audit._share(F.lit(4 * 10**12), F.lit(9 * 10**12), F.lit(7))
    assert spark.range(1).select(share.alias("s")).first().s == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 14)


def audit_by_force(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms(text)))
        count[lang, source].update(terms(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}  # noqa: B023, E731
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            told = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -x, i) for part, found in (("pair", pairs), ("term", told)) for i, (x, item) in enumerate(found, 1)]
    return sorted(out)


def test_source_audit_equals_brute_force(spark):
    rows = corpus(3)
    assert sorted(map(tuple, source_audit.source_audit(table(spark, rows), min_documents=4, top_terms=3).collect())) == audit_by_force(rows, 4, 3)
    assert source_audit.source_audit(table(spark, [])).count() == 0


def test_terms_of_a_long_text_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    text = "alpha beta Gamma " * 30 + "x" * 50 + " été"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["s"]), pa.array([text])], names=["lang", "source", "text"])
    got = {t: (n, d) for b in source_audit._count_terms(iter([batch])) for t, n, d in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True)}
    assert got == {"alpha": (30, 1), "beta": (30, 1), "gamma": (30, 1), "x" * 50: (1, 1), "été": (1, 1)}


URLS = [
    "http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x=/es/", "http://example.org/en/2", "http://example.org", "http://notexample.org/es/", "http://exampleXorg/es/", "http://b.com/fr/", "http://b.com/fr", "http://b.com/de/x#y",
    "http://org/", "://com/de/", "a://b://com/de/", "ftp://casino-bets.biz", "http://cheap-pills-online.biz/buy", "http://www.quiet-library.net/en/books", "no scheme", "", None, "http://h/" + "p" * 20_000, "http://É.org/fr\n/x", "http://x.org/🎉🎉🎉", "http://x.ORG:80/",
]


def test_url_rules_equal_a_plain_reading(spark):
    def plain(url):
        host = path = ""
        if url is not None and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = host.translate(LOWER)
        fits = [(len(h + s), h + s, v) for v, h, s in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(s)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None

    df = spark.createDataFrame(list(enumerate(URLS)) + [(1, URLS[1]), (None, URLS[0])], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "p", "rule", "verdict")})
    got = url_filter.url_filter(df, url_filter.labelled_urls(spark)).collect()
    assert len(got) == len(URLS) + 2
    for row in got:
        host, path, rule, verdict = plain(URLS[row.page_id or 0])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or ("block" if row.score >= 0.5 else "allow"))
    assert url_filter.url_filter(df.limit(0), url_filter.labelled_urls(spark)).count() == 0
    by_url = {URLS[r.page_id]: r for r in got if r.page_id is not None}
    assert by_url["http://cheap-pills-online.biz/buy"].verdict == "block" and by_url["http://www.quiet-library.net/en/books"].verdict == "allow" and by_url[None].verdict == "allow"


def test_url_weights_equal_plain_gradient_descent(spark):
    """The dual fit against gradient descent on the weights themselves, over features read by a plain function."""
    import hashlib

    def features(url):
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        grams = {(k, t[i : i + n]) for k, t in (("h", f"^{host.lower()}$"), ("p", f"^{path}$")) for n in url_filter.GRAMS for i in range(len(t) - n + 1)}
        return {int(hashlib.md5((k + g).encode()).hexdigest()[:8], 16) % url_filter.BUCKETS for k, g in grams}

    rows = [(u, 1.0) for u in url_filter.UNWANTED] + [(u, 0.0) for u in url_filter.WANTED]
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, (u, _) in enumerate(rows):
        f = sorted(features(u))
        x[i, f] = 1 / np.sqrt(len(f))
    y, w = np.array([y for _, y in rows]), np.zeros(url_filter.BUCKETS)
    rate = 4 / (x @ x.T).sum(axis=1).max()
    for _ in range(url_filter.STEPS):
        w = w * (1 - rate * url_filter.DECAY) + rate * x.T @ (y - 1 / (1 + np.exp(-(x @ w + url_filter.PRIOR))))
    got = np.array(url_filter.fit(url_filter.labelled_urls(spark)).first().weights)
    assert np.abs(got - w).max() < 1e-9


def test_url_filter_on_urls_it_was_not_fitted_on(spark):
    """Each fifth labelled URL is judged by a fit on the others."""
    rows = sorted([(u, 1) for u in url_filter.UNWANTED] + [(u, 0) for u in url_filter.WANTED])
    right = 0
    for k in range(5):
        train = spark.createDataFrame([r for i, r in enumerate(rows) if i % 5 != k], "url string, label int")
        test = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows) if i % 5 == k], "page_id long, url string")
        right += sum((r.verdict == "block") == bool(rows[r.page_id][1]) for r in url_filter.url_filter(test, train, ()).collect())
    assert right / len(rows) >= 0.85


def test_labelled_urls_have_a_bound_and_may_be_none(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://casino.biz/x")], "page_id long, url string")
    assert url_filter.url_filter(pages, url_filter.labelled_urls(spark).limit(0)).first().verdict == "allow"
    monkeypatch.setattr(url_filter, "MOST_LABELLED", 10)
    with pytest.raises(Exception, match="more than 10 labelled"):
        url_filter.url_filter(pages, url_filter.labelled_urls(spark)).collect()


def test_url_filter_runs_no_python(spark):
    plan = url_filter.url_filter(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string").union(spark.range(1).selectExpr("id", "'x'")), url_filter.labelled_urls(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def doubled(a, b, times):
    """A sequence that goes on by its own complement, and the complement: they collide modulo 2**64 for every base."""
    one, other = [a], [b]
    for _ in range(times):
        one, other = one + other, other + one
    return one, other


WORD, TWIN = ("".join(x) for x in doubled("a", "b", 10))
LONG, LONG_TWIN = (" ".join(x) for x in doubled("left", "right", 10))


def test_span_hashes_equal_their_definition():
    p = int(common.PRIME)
    r = np.random.default_rng(1)
    values = np.concatenate([r.integers(0, 1 << 64, 40_000, dtype=np.uint64), np.array([0, p - 1, p, p + 1, (1 << 64) - 1], dtype=np.uint64)])
    starts, ends = np.array([0, 5, 20_000, 40_000, 7]), np.array([40, 17_000, 20_001, 40_005, 7])
    want = [sum(int(x) * pow(common._gram_powers.base, i, p) for i, x in enumerate(values[a:b])) % p + b - a for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert common.span_hashes(values, starts, ends, common._gram_powers).tolist() == common.mix(np.array(want, dtype=np.uint64)).tolist()


def test_words_and_texts_that_double_by_their_complement_differ():
    w = common.Words([WORD.encode(), TWIN.encode(), LONG.encode(), LONG_TWIN.encode()], common.SPACE)
    assert w.hashes[0] != w.hashes[1] and len(set(w.spans(w.first[:-1], w.first[1:]).tolist())) == 4


@pytest.mark.parametrize("rows", [
    [(1, " ".join(["w"] * 12 + [WORD] + list("abcdefghijk"))), (2, " ".join(["w"] * 12 + [TWIN] + list("abcdefghijk")))],
    [(1, LONG), (2, LONG_TWIN), (3, "before " + LONG_TWIN + " behind")],
], ids=["word", "text"])
def test_substring_dedup_tells_colliding_words_apart(spark, rows):
    got = substring_dedup.digest(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == substring_dedup.brute_force(rows)


def test_contamination_tells_colliding_words_apart(spark):
    docs = spark.createDataFrame([(1, f"a {TWIN} b"), (2, f"a {WORD} b"), (3, LONG_TWIN), (4, LONG)], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"a {WORD} b"), (8, LONG)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items, rate=0.0).collect()}
    assert got == {(2, 7), (4, 8)}


def test_near_duplicates_tell_colliding_words_apart(spark):
    docs = spark.createDataFrame([(1, WORD), (2, TWIN), (3, WORD + "!"), (4, "start " + LONG), (5, "start " + LONG)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_licenses_tell_colliding_sentences_apart(spark):
    docs = spark.createDataFrame([(1, f"{WORD} grant."), (2, f"{TWIN} grant.")], "doc_id long, text string")
    got = licenses.license_scan(docs, {"s": f"{WORD} grant"}, [("own", ("s",))]).collect()
    assert {r.doc_id: r.licenses for r in got} == {1: "own", 2: ""}


def test_line_dedup_tells_colliding_lines_apart(spark):
    docs = spark.createDataFrame([(i, f"{WORD if i % 2 else TWIN} two three four") for i in range(1, 13)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.line_dedup(docs, min_documents=7, similarity=1.0).collect()] == [0] * 12
    assert sum(r.n_dropped for r in line_dedup.line_dedup(docs, min_documents=6, similarity=1.0).collect()) == 10


def test_near_duplicates_of_many_rows_that_share_an_id(spark):
    """Thousands of null ids with pairs of near copies among them: each row is packed once, and all links are found."""
    r = random.Random(2)
    rows = []
    for i in range(2500):
        words = [f"w{r.randrange(10_000)}" for _ in range(30)]
        rows += [(None, " ".join(words)), (None, " ".join(words[:-1] + ["end"]))]
    classes = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert classes.count() == 5000 and classes.filter("class_rows = 2").count() == 5000
