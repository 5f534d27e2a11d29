import math
import zlib
from collections import Counter

import numpy as np

from cohesia.llm import lm_score, queries
from cohesia.llm.common import words
from tests.llm.conftest import make_docs


def check(rows, texts):
    train = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(words((t or "").encode()))
            train[lm_score.END] += 1
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(texts)
    want = sorted((str(i), *base((t or "").encode(), train, n, v)) for i, t in texts)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    for r in rows:
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score <= 0 and math.isfinite(r.score)


def base(t, train, n, v):
    w = [*words(t), lm_score.END]
    return len(w), sum(x in train for x in w), sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)


def test_query_against_brute_force(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = queries.op5_lm_score(spark, data).collect()
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def naive_score(model, counts, text):
    """log10 probability of a text by plain sums over the weights, word by word."""
    w = [*words(text), lm_score.END]
    index = {x: i for i, x in enumerate(model.head)}
    ids = [index.get(x, -1 - (zlib.crc32(x) >> 2)) for x in w]
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)  # noqa: E731  as 64-bit integers do
    total = 0.0
    for i, (word, own) in enumerate(zip(w, ids, strict=True)):
        one, two, three = (ids[i - d] + 3 if i >= d else 3 - (1 << 31) for d in (1, 2, 3))
        features = [one * 2654435761, two * 2246822519 + 11, three * 3266489917 + 23, one * 668265263 + two * 374761393 + 37]
        of = lambda f: (wrap((f ^ (f >> 15)) * 2057) >> 7) % model.buckets
        classes = softmax([float(model.bias[c]) + sum(float(model.w[t, of(f), c]) for t, f in enumerate(features)) for c in range(model.classes)])
        c = int(model.cls[own]) if own >= 0 else model.tail
        leaf = (zlib.crc32(word) >> 2) % model.leaves

        def leaf_row(f, c=c):
            x = wrap(f * 0x2545F4914F6CDD1D) ^ wrap((c + 1) * 0x5851F42D4C957F2D)
            return ((x ^ (x >> 31)) >> 13) % model.inner

        leaves = softmax([float(model.leaf_bias[c, k]) + sum(float(model.u[t, leaf_row(f), k]) for t, f in enumerate(features)) for k in range(model.leaves)])
        p = (1 - lm_score.MIX) * classes[c] + lm_score.MIX * model.prior[c]
        q = (1 - lm_score.MIX) * leaves[leaf] + lm_score.MIX * model.leaf_prior[c, leaf]
        if own >= 0:
            inside = sum(n for x, n in counts.items() if x in index and model.cls[index[x]] == c and (zlib.crc32(x) >> 2) % model.leaves == leaf)
            r = counts[word] / inside
        else:
            tail = {x: n for x, n in counts.items() if x not in index and (zlib.crc32(x) >> 2) % model.leaves == leaf}
            once = max(1, sum(n == 1 for x, n in counts.items() if (zlib.crc32(x) >> 2) % model.leaves == leaf))
            r = tail.get(word, once) / (sum(tail.values()) + once)
        total += math.log10(p) + math.log10(q) + math.log10(r)
    return total


def test_score_against_plain_sums(spark, data, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 500)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    model, counts = lm_score.train(docs.limit(60).selectExpr("cast(text as binary) t"))
    assert len(model.head) == 500 and model.w.any() and model.u.any()
    c = {bytes(r.word): r.c for r in counts.collect()}
    some = docs.limit(75).where("length(text) < 1500").unionByName(make_docs(spark, [(-1, "zzz unseen words zzz", "", "", 0), (-2, None, "", "", 0)]).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in some.collect()}
    rows = lm_score.score(some, model, counts).collect()
    assert len(rows) == len(texts) > 5
    for r in rows:
        want = naive_score(model, c, (texts[r.doc_id] or "").encode())
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-4), (r.doc_id, r.score, want)


def test_is_a_distribution(spark, data, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 300)
    texts = spark.read.parquet(f"{data}/documents.parquet").selectExpr("cast(text as binary) t").limit(40)
    model, counts = lm_score.train(texts)
    c = {bytes(r.word): r.c for r in counts.collect()}
    index = {w: i for i, w in enumerate(model.head)}
    assert len(model.head) == 300 and sum(c.values()) == model.total
    # Every known word, and for each leaf an unknown one, after one history.
    leaf = lambda w: lm_score.code(w) % model.leaves
    unknown = {}
    for i in range(10_000):
        unknown.setdefault(leaf(b"unknown%d" % i), b"unknown%d" % i)
    total, history = 0.0, [index[w] if w in index else -1 - lm_score.code(w) for w in (b"foo", model.head[5], model.head[17])]
    for w in [*c, *unknown.values()]:
        ids = np.array([*history, index.get(w, -1 - lm_score.code(w))])
        p = 10 ** model.log10(ids, np.zeros(1, np.int64))[-1]
        total += p if w in index else p * c.get(w, model.unknown[leaf(w)]) / model.rare[leaf(w)]
    assert len(unknown) == model.leaves and math.isclose(total, 1, rel_tol=1e-4)


def test_rare_words_by_join(spark, monkeypatch):
    rows = [(i, f"alpha beta w{i % 50} gamma" + (" newword" if i == 14 else ""), "en", "s", 1) for i in range(200)]
    df = make_docs(spark, rows)
    monkeypatch.setattr(lm_score, "LEAST", 50)
    check(lm_score.score_documents(df).collect(), [(r[0], r[1]) for r in rows])


def test_odd(spark, odd_docs):
    check(lm_score.score_documents(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert lm_score.score_documents(odd_docs.limit(0)).count() == 0
    only = odd_docs.where("doc_id = 4")
    held = make_docs(spark, [(i, "a b", "en", "s", 1) for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    check(lm_score.score_documents(held).collect(), [(r.doc_id, r.text) for r in held.collect()])
    assert only.count() == 2


def test_resolution_of_the_class_factor(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").selectExpr("cast(text as binary) t").limit(40)
    model, _ = lm_score.train(texts)
    assert model.classes >= 8 * 5 + 2 and model.leaves >= 16


def test_model_grows_with_the_tokens():
    small, large, larger = (lm_score.sizes(n) for n in (10**6, 10**9, 10**11))
    assert small[:5] == (8192, 64, 8, lm_score.BUCKETS, lm_score.LEAVES)
    assert all(a < b < c for a, b, c in zip(small[:5], large[:5], larger[:5], strict=True))
    # What all tasks send stays in proportion to the tokens.
    assert all(s.tasks * s.buckets * lm_score.PER_ROW <= max(n, lm_score.TASKS * s.buckets * lm_score.PER_ROW) for n, s in ((10**9, large), (10**11, larger)))


def test_rare_words_have_features_of_their_own(spark, monkeypatch):
    """Words beyond the head tell histories apart, and are told apart by them."""
    monkeypatch.setattr(lm_score, "LEAST", 600)
    pairs = [(f"w{i}", f"v{i}") for i in range(6)]
    texts = make_docs(spark, [(i, " ".join(f"common {a} {b} common" for a, b in pairs), "en", "s", 1) for i in range(300)]).selectExpr("cast(text as binary) t")
    model, counts = lm_score.train(texts)
    assert b"common" in model.head and not any(w.startswith((b"w", b"v")) for w in model.head)
    score = lambda t: lm_score.score(make_docs(spark, [(1, t, "", "", 0)]), model, counts).first().score
    right = score(" ".join(f"common {a} {b} common" for a, b in pairs))
    wrong = score(" ".join(f"common {a} {b} common" for (a, _), (_, b) in zip(pairs, pairs[1:] + pairs[:1], strict=True)))
    assert right > wrong + 1


def test_long_texts_are_scored_in_parts(spark, data, monkeypatch):
    texts = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "cast(text as binary) text").limit(40)
    model, counts = lm_score.train(texts.select("text"))
    whole = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_score.score(texts, model, counts).collect()}
    ids = np.array([1, 2, -5, 3, 2, 2, 9, -7, 1, 0] * 3)
    monkeypatch.setattr(lm_score, "RUN", 8)
    parts = [model.log10(x, s)[k:] for x, s, k, _ in lm_score.runs([ids, ids[:3], ids[:5]])]
    assert np.allclose(np.concatenate(parts), np.concatenate([model.log10(x, np.zeros(1, np.int64)) for x in (ids, ids[:3], ids[:5])]))
    assert len(whole) == 40
