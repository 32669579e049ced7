"""The operators against plain Python on small tables with awkward rows."""

import collections
import functools
import gzip
import hashlib
import io
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import op1_quality, op2_decontaminate, op3_neardup, op4_packing, op5_lm, op6_pii, op7_urls, op8_warc, op9_neighbours, op10_extract

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abcdefgé") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@functools.cache
def awkward():
    """Documents with nulls, blanks, copies, near copies, repeats and a long one."""
    base = prose(120)
    near = base.split()
    near[5] = "changed"
    long = prose(30_000)
    return [
        (0, base, "en"), (1, base, "en"), (2, " ".join(near), "en"), (3, None, None), (4, "", "en"), (5, " \n\t ", "en"), (6, "two words", "en"), (7, "Two  WORDS", None),
        (8, long, "en"), (None, base, "en"), (None, None, None), (9, prose(80), "de"), (9, "two words", "de"), (10, prose(80), "fr"), (10, prose(80), "fr"), (11, base.upper(), "en"), (12, "1234 é ñ ***", "en"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, len(t) if t else None, 1, "x") for i, t, lang in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score int, hit string")


def empty(spark, kind="doc_id long, text string, n_chars long"):
    return spark.createDataFrame([], kind)


# 1


def test_fm_identity():
    p = op1_quality.FMParams(dims=64, rank=3)
    m = op1_quality.FactorisationMachine(p)
    rng = np.random.default_rng(1)
    m.w, m.v, m.bias = rng.normal(size=64), rng.normal(size=(64, 3)), 0.3
    ids, values = np.array([3, 9, 20, 9]), np.array([0.5, 1, 2, -1.0])
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert m.raw(ids, values, np.zeros(4, int), 1)[0][0] == pytest.approx(0.3 + (m.w[ids] * values).sum() + pairs)


def test_quality_learns_and_takes_awkward_rows(spark, docs):
    rng = random.Random(1)
    rows = [(i, prose(60, rng) if i % 3 else " ".join(w + "***" for w in prose(60, rng).split()), 1) for i in range(300)]
    train = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, *_ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    p = op1_quality.FMParams(sample=150)
    assert op1_quality.training_rows(train, labels, p).count() <= 150
    model = op1_quality.train(train, labels, p)
    got = {r.doc_id: r for r in op1_quality.score_documents(train, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert sum(r.predicted == int(i % 3 > 0) for i, r in got.items() if r.held_out) >= 0.95 * sum(r.held_out for r in got.values())
    out = op1_quality.score_documents(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert {"lang", "hit"} < set(out.columns)
    none = op1_quality.train(train, labels.limit(0), p)
    assert {r.score for r in op1_quality.score_documents(train, none).collect()} == {0.5}
    assert op1_quality.score_documents(empty(spark), model).count() == 0


# 2


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits(text, items, window=13):
    words = plain_words
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s : s + n]) in grams:
                hit |= set(range(s, s + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1_000_000, 30, 7])
def test_decontamination(spark, docs, block):
    rows = awkward()
    items = [(1, rows[0][1].title()), (2, "two, words!"), (3, None), (None, prose(20)), (4, ""), (10, " ".join(rows[8][1].split()[500:540])), (10, prose(20)), (5, rows[11][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [i for i in items if i[0] is not None]
    found = op2_decontaminate.find(docs, bench, max_windows=block)
    got = sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    for r in got:
        n, h, its = hits(r.text, known)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, h, its, h > 0 and 20 * h >= n)
        if block > 1000:  # else items are in parts
            assert r.whole == any(len(plain_words(x)) > 12 and f" {' '.join(plain_words(x))} " in f" {' '.join(plain_words(r.text))} " for _, x in known)
    digest = op2_decontaminate.digest(found).where("doc_id = 3").first()
    assert digest.items_sha256 == hashlib.sha256(b"").hexdigest() and not digest.contaminated
    cut = {r.doc_id: r.text for r in op2_decontaminate.find(docs, bench, max_windows=block, cut=True).collect()}
    assert hits(cut[8], known)[1] == 0 and cut[3] is None and len(cut[8].split()) == 30_000 - 40
    assert op2_decontaminate.find(empty(spark), bench).count() == 0
    assert op2_decontaminate.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# 3


def sets(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def groups(rows):
    """doc_id -> smallest doc_id reachable."""
    every = [(i, sets(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in every}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(every)):
        for b in range(a):
            (i, x), (j, y) = every[a], every[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i, j = sorted((find(i), find(j)))
                root[j] = i
    return {i: find(i) for i in root}


def test_near_duplicates(spark, docs):
    rng = random.Random(9)
    rows = [(i, t) for i, t, _ in awkward() if i not in (9, 10)] + [(9, prose(80, rng)), (10, prose(80, rng)), (10, None)]
    base = prose(150, rng).split()
    for k in range(120):  # a dense region: copies with changes, and chains of changes
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(150)] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
        if k % 4 == 0:
            base[k] = f"drift{k}"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, fp string")
    expected = groups(rows)
    for p in (op3_neardup.ForestParams(), op3_neardup.ForestParams(cell=16, near=2, depth=3)):
        got = op3_neardup.near_duplicates(df, p).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (3, 4, 5)} == {0} and {r.n_shingles for r in got if r.doc_id in (6, 7)} == {1}
    assert op3_neardup.near_duplicates(empty(spark)).count() == 0


def test_ids_with_different_texts_and_partitions(spark):
    rng = random.Random(12)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, c), (4, c + " end"), (None, a), (9, None), (9, "")]
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in op3_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, True, 1), (2, True, 1), (2, True, 2), (3, True, 2), (3, True, 3), (4, True, 3), (None, True, None), (9, False, 9)}
    rows = star(400, 200, 5, rng) + [(1000 + i, t) for i, t in star(30, 200, 1, rng)]
    results = []
    for n in (4, 37):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, op3_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), op3_neardup.ForestParams(cell=50)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] and {r[2] for r in results[0]} == {0, 1000}


def star(n, words, changes, rng):
    """An original and ``n`` variants of it, which are like the original but not like each other."""
    base = [f"w{rng.getrandbits(40)}" for _ in range(words)]
    out = [(0, " ".join(base))]
    for i in range(1, n + 1):
        variant = list(base)
        for at in rng.sample(range(0, words - 4, 4), changes):
            variant[at + 1] = f"v{rng.getrandbits(40)}"
        out.append((i, " ".join(variant)))
    return out


@pytest.mark.parametrize("n,p", [(1000, op3_neardup.ForestParams(cell=100)), (3000, op3_neardup.ForestParams())])
def test_star_of_variants_is_one_component(spark, n, p):
    rows = star(n, 200, 5, random.Random(7))
    sets = [set(op3_neardup.shingles(t.encode(), 4).tolist()) for _, t in rows]
    linked = {i for i in range(1, n + 1) if 100 * len(sets[0] & sets[i]) >= 80 * len(sets[0] | sets[i])}
    assert len(linked) == n and sum(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(1, 300)) < 10
    got = op3_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), p).collect()
    assert sum(r.component_id != 0 for r in got) == 0


# 4


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op4_packing.default_vocabulary())


def test_tokenizer_equals_the_library(tokenizer):
    mine = op4_packing.CachedTokenizer(op4_packing.default_vocabulary(), chunks=50, pieces=20)
    texts = ["It's the DOG's 1234½ x²", "Ünïcödé ŁÓDŹ İstanbul ΣΑΣ", "a\u00a0b\u0301 c\u200d", "<|endoftext|>x <|startoftext|>", "日本語 テスト 한국어", "*** --- _a_ ''s 'S", "e\u0301 é", "", "\x1c\x85x"] + [prose(50) for _ in range(20)]
    for t in texts * 2:
        assert np.frombuffer(mine.encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def plain_bfd(lengths, limit):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(b, i) for i, b in enumerate(bins) if b >= n]
        if fits:
            _, i = min(fits)
            bins[i] -= n
        else:
            bins.append(limit - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    limit = rng.choice((7, 32, 100))
    lengths = [rng.randint(1, limit) if rng.random() < 0.5 else rng.choice((1, limit // 3, limit // 2, limit)) or 1 for _ in range(rng.randint(0, 200))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = op4_packing.best_fit_decreasing(counts, limit)
    used = {}
    for n, own in runs.items():
        starts = [r[0] for r in own] + [counts[n]]
        for (first, b, each, at), end in zip(own, starts[1:], strict=True):
            for k in range(end - first):
                used.setdefault(b + k // each, []).append((at + k % each * n, n))
    assert len(used) == bins
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= limit
    assert sorted(limit - sum(n for _, n in v) for v in used.values()) == plain_bfd(lengths, limit)


def test_packing(spark, docs, tokenizer):
    for limit in (4096, 50):
        got = op4_packing.pack(docs, limit).collect()
        texts = sorted((str(i), t or "") for i, t, _ in awkward())
        by = {}
        for r in got:
            assert r.length == len(r.ids) // 4 <= limit and r.start == r.piece * limit
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= limit
        assert sum(r.length for r in got) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
        eight = np.frombuffer(b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 8), key=lambda r: r.piece)), "<u4").tolist()
        assert eight == tokenizer.encode(awkward()[8][1], add_special_tokens=False).ids + [1]
        crc = op4_packing.pack(docs, limit, keep_ids=False).where("doc_id = 8 and piece = 0").first().ids_crc32
        assert crc == zlib.crc32(next(bytes(r.ids) for r in got if r.doc_id == 8 and r.piece == 0))
    assert op4_packing.pack(empty(spark)).count() == 0


# 5


def test_cross_entropy_difference(spark, docs):
    target = spark.createDataFrame([(awkward()[11][1],), (None,), ("",)], "text string")
    texts = [t or "" for _, t, _ in awkward()]
    for p in (op5_lm.LMParams(), op5_lm.LMParams(frequent=20, bucket_tokens=50, block_bytes=2_000)):  # all words are frequent; most are not
        words = [op5_lm.words_of(t.encode()) for t in texts]
        aims = [op5_lm.words_of(awkward()[11][1].encode())]
        size = len({w for x in words + aims for w in x}) + 1
        ring = lambda x: [None, *x] if x else []
        pairs = lambda r: list(zip(r, r[1:] + r[:1], strict=True))
        models = [(collections.Counter(w for x in group for w in ring(x)), collections.Counter(q for x in group for q in pairs(ring(x)))) for group in (aims, words)]

        def loss(x, model):
            single, double = model
            total = sum(single.values())
            each = [-math.log((single[b] + 1) / (total + size)) - math.log((double[a, b] + p.smoothing / size) / (single[a] + p.smoothing)) for a, b in pairs(ring(x))]
            return sum(each) / 2 / max(len(each), 1)

        got = sorted(op5_lm.score(docs, target, p).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.score))
        wanted = [(i, len(x), loss(x, models[0]), loss(x, models[1])) for (i, _, _), x in zip(awkward(), words, strict=True)]
        wanted.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3] - r[2]))
        assert [(r.doc_id, r.n_words) for r in got] == [w[:2] for w in wanted]
        assert all(abs(r.target_loss - w[2]) < 1e-5 and abs(r.background_loss - w[3]) < 1e-5 and abs(r.score - w[3] + w[2]) < 1e-5 for r, w in zip(got, wanted, strict=True))
        assert all((r.n_words, r.score) == (0, 0) for r in got if r.doc_id in (3, 4, 5))
    best = max((r for r in op5_lm.score(docs, target).collect() if r.n_words > 20), key=lambda r: r.score)
    assert best.n_words == len(awkward()[11][1].split()) and best.score > 0
    assert op5_lm.score(empty(spark), target).count() == 0 and op5_lm.score(docs, target.limit(0)).count() == len(texts)


# 6

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def test_pii(spark):
    rng = random.Random(2)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44 20 7946 0958.", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "a.b@c.de", "a@b.c_d@e.f.g", "x@y", "é😀", "card", " ", "9" * 40, "12345678901.2.3.4", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "123-45-6789", ",", "..", "@", "+", "word"]
    texts = [None, "", "a@b.cd", "+" * 50] + ["".join(rng.choice(bits) + rng.choice(("", " ", ", ")) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += ["7" * 60_000, "1 " * 30_000, "a" * 60_000 + "@", "a@b." * 10_000, "x@y.z " * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = op6_pii.find(df)
    for r in op6_pii.digest(found).collect():
        text, spans = texts[r.doc_id] or "", []
        for k, (kind, (pattern, valid)) in enumerate(PII.items()):
            if kind == "ip" and len(text) > 50_000:
                continue  # quadratic in plain Python; no dots there
            own = [m.span() for m in re.finditer(pattern, text) if valid(m[0])] if not (kind == "email" and text.startswith("aaaa")) else []
            assert r[f"n_{kind}"] == len(own), (r.doc_id, kind, text[:300], r.spans[:300])
            spans += [(s, k, e, kind) for s, e in own]
        listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    extra = df.limit(0).union(spark.createDataFrame([(1, "pay to iban GB82 WEST 1234 5698 7654 32 now"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "my ssn 123-45-6789 and 123-45-6789")], "doc_id long, text string"))
    out = {r.doc_id: r for r in op6_pii.redact(op6_pii.find(extra), ["doc_id", "text"]).collect()}
    assert out[1].text == "pay to iban [IBAN] now" and out[2].text == "GB82 WEST 1234 5698 7654 33" and out[3].text.startswith("my ssn [ID_NUMBER] and 123")
    assert op6_pii.digest(op6_pii.find(empty(spark))).count() == 0


# 7


def test_urls(spark):
    urls = [
        ("http://Foo.Example.NET/en/1?x=/", "foo.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.net/", "a.net", "/", "net/", "block"), ("http://a.net", "a.net", "", None, None),
        ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"), ("x://w.org/fr/?q", "w.org", "/fr/", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("http://w.org/en/", "w.org", "/en/", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("", "", "", None, None), ("http://casino-win.example.org/1", "casino-win.example.org", "/1", None, "block"),
        ("http://a.org?u=http://b.net/en/", "a.org", "", None, None), ("http://netx/", "netx", "/", None, None),
    ]
    more = [(f"http://{w}{k}.example.org/en/{k}", None) for k in range(3) for w in ("blog.reading-garden", "casino-bets", "win-adult-pills")] + [("http://x.example.com/" + "cheap-pills/" * 20_000, None)]
    rows = [(i, u[0], "x", 1) for i, u in enumerate([*urls, *more])] + [(0, urls[0][0], "x", 1), (None, urls[0][0], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, gram int")
    got = op7_urls.judge(df).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    by = {r.page_id: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert verdict in (None, by[i].verdict)
    assert by[7].verdict == "allow" and by[7].score == 0
    limit = plain_limit()
    for i, (u, *_) in enumerate([*urls, *more]):
        if len(u or "") < 10_000:
            assert abs(by[i].score - plain_score(u)) < 1e-8
        assert by[i].rule or by[i].verdict == ("block" if by[i].score > limit else "allow")
    verdicts = {u: by[i].verdict for i, (u, _) in enumerate(more, len(urls))}
    assert {v for u, v in verdicts.items() if "garden" in u} == {"allow"} and {v for u, v in verdicts.items() if "garden" not in u} == {"block"}
    assert op7_urls.judge(empty(spark, "page_id long, url string")).count() == 0
    one = spark.createDataFrame([(n, f"http://{n}.example/", False) for n in ("a", "b", "c", "d", "e", "f")], "name string, url string, rejected boolean")
    assert op7_urls.judge(df, known=one).where("rule is null and verdict = 'block'").count() == 0


def folded(url):
    return "^^^" + re.sub("[^a-z0./_-]", "?", re.sub("[0-9]", "0", (url or "").lower()))


@functools.cache
def plain_models():
    """Counts of grams and of their contexts, by class, and the left-out examples."""
    counts, contexts, left_out = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], []
    for r, names in enumerate((op7_urls.ACCEPTED, op7_urls.REJECTED)):
        for name in names:
            for form in op7_urls.FORMS:
                if zlib.crc32(name.encode()) % 5 == 0:
                    left_out.append((r, form.format(name)))
                    continue
                text = folded(form.format(name))
                for i in range(3, len(text)):
                    for k in range(4):
                        counts[r][text[i - k : i + 1]] += 1
                        contexts[r][text[i - k : i], k] += 1
    return counts, contexts, left_out


def plain_score(url):
    counts, contexts, _ = plain_models()
    text, total = folded(url), 0.0
    if len(text) < 4:
        return 0.0
    for i in range(3, len(text)):
        p = [1 / 33, 1 / 33]
        for k in range(4):
            p = [(counts[r][text[i - k : i + 1]] + 4 * p[r]) / (contexts[r][text[i - k : i], k] + 4) for r in (0, 1)]
        total += math.log(p[1]) - math.log(p[0])
    return total / (len(text) - 3)


def plain_limit():
    scores = [np.array([plain_score(u) for r, u in plain_models()[2] if r == c]) for c in (0, 1)]
    (m0, m1), (s0, s1) = [x.mean() for x in scores], [x.std() for x in scores]
    assert len(scores[0]) > 20 and len(scores[1]) > 20 and (scores[1] > m0).mean() > 0.9
    return max((m0 * s1 + m1 * s0) / (s0 + s1), np.percentile(scores[0], 95))


# 8


def test_zip64_directory():
    out = io.BytesIO()
    w = op8_warc.ZipWriter(out)
    for k in range(70_000):  # more members than 16 bits can count
        w.members.append([f"m{k}".encode(), 0, 0, 0]) if k else (w.begin("m0"), w.data(b"abc"), w.end())
    w.close()
    r = op8_warc.ZipReader(out, len(out.getvalue()))
    assert len(r.members) == 70_000 and r.range(r.members["m0"].start, r.members["m0"].size) == b"abc"
    assert op8_warc._wide(struct.pack("<2H3Q", 1, 24, 5, 6, 7), 2**32 - 1, 2**32 - 1, 2**32 - 1) == (6, 5, 7)
    import zipfile

    small = io.BytesIO()
    w = op8_warc.ZipWriter(small)
    w.begin("a"), w.data(b"x" * 10), w.end(), w.begin("b"), w.data(b"yy"), w.end(), w.close()
    with zipfile.ZipFile(small) as z:
        assert z.namelist() == ["a", "b"] and z.read("b") == b"yy" and z.testzip() is None
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"z" * 100)
        z.writestr(zipfile.ZipInfo("stored"), b"s")
        z.comment = b"PK\x05\x06 in a comment"
    assert set(op8_warc.ZipReader(deflated, len(deflated.getvalue())).members) == {"stored"}
    with pytest.raises(ValueError):
        op8_warc.ZipReader(io.BytesIO(b"nothing"), 7)


@pytest.mark.parametrize("merge", [False, True])
def test_warc_round_trip(spark, monkeypatch, merge):
    same = "<p>" + "é" * 200
    rows = [(5, "http://a/?q=%20 x\r\n", same), (3, None, same), (7, "u", same), (3, "again", same), (None, "n", same), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (8, "u", "b" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    folder = op8_warc.scratch_path(spark, "warc-test")
    manifest = op8_warc.write_archives(df.limit(3), folder)
    local = folder.removeprefix("file:").replace("///", "/")
    (name,) = os.listdir(local)
    for orphan in (f"{local}/.{name[:-6]}99.zip.part", f"{local}/other.zip"):
        open(orphan, "w").close()
    op8_warc._delete_orphans(folder, name.split("-")[1], manifest)
    assert sorted(os.listdir(local)) == sorted([name, "other.zip"])
    monkeypatch.setattr(op8_warc, "BROADCAST_REVISITS", 0 if merge else 100)
    got = op8_warc.round_trip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, u, h in rows if (i, u) == (r.page_id, r.url)) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = html == same and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    assert op8_warc.round_trip(empty(spark, "page_id long, url string, html string")).count() == 0
    record = op8_warc.record_bytes("response", 1, None, b"\r\n\r\n", "d", None, "n")
    assert op8_warc.parse_record(gzip.decompress(gzip.compress(record)))[1] == b"\r\n\r\n"


# 9


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[100:400] = x[100]  # ties
    x[50] *= 1e-30
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(700, None), (750, [0.0] * 24), (701, [None] + [1.0] * 23), (800, [float("nan")] * 24), (702, [float("inf")] * 24), (703, [1.0, 2.0]), (850, [2.0, 1.0]), (900, []), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string").repartition(6)
    asked = df.where("vec_id % 50 = 0")
    y = x.astype(np.float64)
    norm = np.sqrt(np.add.accumulate(y * y, axis=1)[:, -1])
    for block in (4096, 3):
        got = {}
        for r in op9_neighbours.search(df, asked, 5, block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {*range(0, 700, 50), 850}
        for q, found in got.items():
            if q == 850:
                assert sorted(found) == [(1, 703, 4 / (math.sqrt(5) * math.sqrt(5)))]
                continue
            s = np.add.accumulate(y * y[q], axis=1)[:, -1] / (norm * norm[q])
            order = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
            assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, i) for k, i in enumerate(order)]
            assert [v for *_, v in sorted(found)] == [s[i] for i in order]
    wide = rng.normal(size=(120, 2500))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<double>")
    unit = wide / np.linalg.norm(wide, axis=1)[:, None]
    for r in op9_neighbours.search(base, base.where("vec_id % 50 = 0"), 1).collect():
        s = unit @ unit[r.query_id]
        s[r.query_id] = -9
        assert r.vec_id == s.argmax()
    assert op9_neighbours.search(df, asked.limit(0)).count() == 0 and op9_neighbours.search(df.limit(0), asked).count() == 0


# 10


def page(title, body, k):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href='/{k}'>menu {k}</a></li></ul></nav><div class=\"ad\">buy {k}</div><article><h1>{title}</h1>{body}</article><aside>side {k}</aside><div id='comments'><p>first!</p></div><footer>&copy; {k}</footer></body></html>"


def test_extraction(spark):
    rows = [(i, "http://h.org/x", page(f"T{i}", f"<p>one &amp; <b>tw</b>o\n {i}<p>three<br>four&nbsp;five<ul><li>a<li>b</ul><form>f</form>", i)) for i in range(8)]
    rows += [(20, None, None), (21, "http://z/", ""), (22, "http://z/", "plain < text"), (23, "http://one/", "<div class=menu>m</div><div><p>alone <i>here</i></p></div>"), (24, "http://h.org/y", "<p>" + "word " * 50_000), (0, "http://h.org/x", rows[0][2])]
    shared = "<html><body><div><span>Site of news</span></div><p>{body}</p><div><span>Terms apply</span></div>{more}</body></html>"
    bodies = [f"body {k} text of some {k * k} words" for k in range(12)]
    rows += [(30 + k, "http://plain.com/", shared.format(body=b, more="<div class='comments'>rare</div><math>x<p>y</math>" if k == 3 else "")) for k, b in enumerate(bodies)]
    rows += [(60 + k, "http://copies.com/", shared.format(body="a text that is copied", more=f"<p>{k}</p>")) for k in range(12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    for limit in (32 << 20, 0):
        got = {r.page_id: r for r in op10_extract.extract(df, limit).collect()}
        assert len(got) == len({r[0] for r in rows})
        for i in range(8):
            assert got[i].text == f"T{i} one & two {i} three four five a b"
        assert (got[20].text, got[20].n_chars, got[21].text, got[22].text, got[23].text) == ("", 0, "", "plain < text", "alone here")
        assert got[24].n_chars == 50_000 * 5 - 1
        for k, b in enumerate(bodies):
            assert got[30 + k].text == (f"{b} x y" if k == 3 else b)  # the runs that all pages share are the template's
            assert got[60 + k].text == f"Site of news a text that is copied Terms apply {k}"  # copies of one text say nothing about a template
    assert op10_extract.extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_the_template_parts_the_page():
    reader = op10_extract.Reader()
    parts = list(reader.read(page("T", "<p>one<p>two", 1)))
    assert op10_extract.text_of(parts, op10_extract.alone(parts)) == "T one two"
    assert op10_extract.text_of(parts, op10_extract.Template()) == "menu 1 buy 1 T one two side 1 first! © 1"


def test_classes_equal_full_occurrence_vectors(spark):
    rng = random.Random(6)
    pages = []
    for k in range(40):
        items = "".join(f"<li><a href=x>{rng.choice(VOCABULARY)}</a></li>" for _ in range(rng.randint(1, 4)))
        body = "".join(f"<p>{prose(5, rng)}{'<i>x</i>' if rng.random() < 0.5 else ''}</p>" for _ in range(rng.randint(1, 5)))
        pages.append(f"<html><body><nav><ul>{items}</ul></nav><div class=lead>{prose(4, rng)}<br></div><article><h1>{k}</h1>{body}<p>Share this text</p></article>{'<aside>a</aside>' if k % 4 else ''}</body></html>")
    reader = op10_extract.Reader()
    read = [list(reader.read(p)) for p in pages]
    for group in {op10_extract.layout(r) for r in read}:
        of = [r for r in read if op10_extract.layout(r) == group]
        vectors, firsts = collections.defaultdict(lambda: [0] * len(of)), {}
        for k, parts in enumerate(of):
            for at, (kind, element, text) in enumerate(parts):
                t = op10_extract.run_token(element, text) if kind == op10_extract.TEXT else element.open + (kind == op10_extract.CLOSE)
                vectors[t][k] += 1
                firsts.setdefault(t, {}).setdefault(k, at)
        classes = collections.defaultdict(list)
        for t, v in vectors.items():
            if 2 * sum(n > 0 for n in v) >= len(of):
                classes[tuple(v)].append(t)
        wanted = {tuple(sorted((t for t in c if t > 0), key=lambda t: (sum(firsts[t].values()), t))) for c in classes.values() if sum(t > 0 for t in c) > 1}
        runs = {t for c in classes.values() if sum(t > 0 for t in c) > 1 for t in c if t < 0}
        df = spark.createDataFrame([("h", p) for p, r in zip(pages, read, strict=True) if op10_extract.layout(r) == group], "host string, html string").repartition(3)
        (found,) = op10_extract.templates(df).toArrow().to_pylist()
        template, inner = op10_extract._deduced(found)
        got = collections.defaultdict(list)
        for t, (c, i) in sorted(template.place.items(), key=lambda x: x[1]):
            got[c].append(t)
            assert i == len(got[c]) - 1
        assert {tuple(x) for x in got.values()} == wanted
        assert template.runs and template.runs == {t for t in runs if all(vectors[t])}  # text on half of the pages is no template's
        for c, nest in enumerate(template.nest):  # each class lies between the tags of the element around it, on every page
            for parts in of:
                at, order = -1, {}
                for kind, element, _ in parts:
                    if kind == op10_extract.TEXT:
                        continue
                    own, i = template.place.get(element.open + (kind == op10_extract.CLOSE), (None, 0))
                    order[own] = i
                    assert own != c or not nest or nest[1] <= order.get(nest[0], -1) < nest[2]
                    at = i if own == c else at
        assert len(template.sizes) >= 3 and any(template.nest)


def test_columns_that_clash(spark, docs):
    assert op6_pii.redact(op6_pii.find(docs), docs.columns).columns == docs.columns
    assert op2_decontaminate.find(docs, docs.select(F.col("doc_id").alias("item_id"), "text", "hit")).count() == docs.count()
    extra = "piece start length ids part rank sequence_id offset base n block idx tokens b t blob bucket kind word findings count".split()
    wide = docs.select("doc_id", "text", "n_chars", *[F.lit(f"{c}!").alias(c) for c in extra])
    narrow = docs.select("doc_id", "text")
    for run in (lambda d: op4_packing.pack(d, 64, keep_ids=False), lambda d: op5_lm.score(d, d), op3_neardup.near_duplicates):
        one, two = run(wide), run(narrow)
        assert one.columns == two.columns
        some = [c for c in two.columns if c not in ("sequence_id", "offset")]
        assert sorted(map(str, one.select(some).collect())) == sorted(map(str, two.select(some).collect()))
    found = op6_pii.find(wide)
    assert found.where("count <> 'count!' or findings is null").count() == 0


def test_pii_of_repeated_rows_and_null_ids(spark):
    text = "mail a@b.org or 1.2.3.4"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "é" * 70_000 + " a@b.org " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_email, r.n_ip) for r in op6_pii.digest(op6_pii.find(df)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (None, 0, 0), (2, 300, 0)], key=str)
    (long,) = [r.text for r in op6_pii.redact(op6_pii.find(df), ["doc_id", "text"]).where("doc_id = 2").collect()]
    assert long == "é" * 70_000 + " [EMAIL] " * 300
    after = spark.createDataFrame([(1, "078-05-1120 is my ssn")], "doc_id long, text string")
    assert op6_pii.redact(op6_pii.find(after), ["text"]).first().text == "[ID_NUMBER] is my ssn"


def test_one_training_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}", 1) for k in range(2000)] + [(4, "other", 1), (4, None, 1)], "doc_id long, text string, n_chars long").repartition(7)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0)], "doc_id long, quality int")
    rows = op1_quality.training_rows(docs, labels, op1_quality.FMParams(sample=10)).collect()
    ids = [i for i in (1, 4) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(r.label_id for r in rows) == ids and [r for r in rows] == op1_quality.training_rows(docs.repartition(3), labels, op1_quality.FMParams(sample=10)).collect()
