import resource
import zlib
from itertools import product

import numpy as np

from cohesia.llm import quality, queries


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    for sizes in ([5, 3, 1], [1], [9], [1, 1, 7, 2]):
        trans = rng.standard_normal((2, 2)) * 2
        score = [rng.standard_normal(n) * 3 for n in sizes]
        first = np.concatenate([[True] + [False] * (n - 1) for n in sizes])
        good, pairs = quality.forward_backward(np.concatenate(score), first, trans)
        want, expected = [], np.zeros((2, 2))
        for s in score:
            p, total, pp = np.zeros(len(s)), 0.0, np.zeros((2, 2))
            for y in product((0, 1), repeat=len(s)):
                w = np.exp(sum(u for u, k in zip(s, y, strict=True) if k) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
                total += w
                p += w * np.array(y)
                for a, b in zip(y, y[1:], strict=False):
                    pp[a, b] += w
            want.append(p / total)
            expected += pp / total
        assert np.allclose(good, np.concatenate(want)) and np.allclose(pairs, expected)


def test_long_chain_against_plain_recursion():
    rng = np.random.default_rng(5)
    n = 20_000
    u, first, trans = rng.standard_normal(n) * 8, rng.random(n) < 0.001, np.array([[1.5, -2.0], [-1.0, 2.5]])
    first[0] = True
    good, _ = quality.forward_backward(u, first, trans)
    fwd, back = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        into = np.zeros(2) if first[t] else np.logaddexp(fwd[t - 1, 0] + trans[0], fwd[t - 1, 1] + trans[1])
        fwd[t] = into + [0, u[t]]
        fwd[t] -= fwd[t].max()
    for t in range(n - 2, -1, -1):
        if not first[t + 1]:
            x = trans + back[t + 1] + [0, u[t + 1]]
            back[t] = np.logaddexp(x[:, 0], x[:, 1])
            back[t] -= back[t].max()
    both = fwd + back
    assert np.allclose(good, 1 / (1 + np.exp(both[:, 0] - both[:, 1])))


def test_gradient_is_that_of_the_likelihood():
    """The step of the first round follows the numerical derivative of the conditional log likelihood."""
    docs = [quality.line_features(t) for t in (b"One line here.\nAnother one 12\n!!", b"alone", b"$$$ ### 1\n\nText that reads well enough.\nx")]
    lines = quality.laid(docs)
    model = quality.Model()
    model.mean, model.scale = lines.own.mean(axis=0).astype(float), lines.own.std(axis=0).astype(float) + 0.1
    rng = np.random.default_rng(1)
    model.w, model.trans = rng.standard_normal(quality.WEIGHTS) * 0.3, rng.standard_normal((2, 2)) * 0.3
    labels, weights = rng.integers(0, 2, len(lines.length)).astype(float), np.repeat([0.5, 2.0, 2.0], np.diff(np.append(lines.starts, len(lines.length))))

    def likelihood(w, trans):
        m = quality.Model()
        m.mean, m.scale, m.w, m.trans = model.mean, model.scale, w, trans
        u, out = m.field(lines)[0], 0.0
        for low, high in zip(lines.starts, np.append(lines.starts[1:], len(u)), strict=True):
            value = lambda y, low=low, high=high: sum(u[low + i] for i in range(high - low) if y[i]) + sum(trans[int(a), int(b)] for a, b in zip(y, y[1:], strict=False))
            z = np.logaddexp.reduce([value(y) for y in product((0, 1), repeat=int(high - low))])
            out += weights[low] * (value(labels[low:high]) - z)
        return out / len(u) - 0.5e-3 * ((w**2).sum() + (trans**2).sum())

    at = np.concatenate([model.w, model.trans.ravel()])
    f = lambda x: likelihood(x[: quality.WEIGHTS], x[quality.WEIGHTS :].reshape(2, 2))
    slope = np.array([(f(at + 1e-5 * e) - f(at - 1e-5 * e)) / 2e-5 for e in np.eye(len(at))])
    model.ascend(lines, labels, weights, 1)
    moved = np.concatenate([model.w, model.trans.ravel()]) - at
    assert np.allclose(moved, 0.5 * slope / np.sqrt(slope**2 + 1e-8), atol=1e-3)


def plain_quality(model, text):
    """The score of a text line by line, as the module text says, with sums and recursions in plain Python."""
    lines = (text or "").encode().split(b"\n")
    own, seen = [], set()
    for line in lines:
        f = [sum(c in chars for c in line) / max(len(line), 1) for chars in quality.CLASSES.values()]
        w = line.split()
        if w:
            f += [0, 1 - len(set(w)) / len(w) if len(w) > 2 else 0, sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), line in seen]
            f += [min(len(line) / len(w) / 10, 3), len(w) < 3, np.log1p(len(w)) / 6, w[-1][-1:] in b".!?\"'"]
            seen.add(line)
        else:
            f += [1, 0, 0, 0, 0, 0, 0, 0]
        own.append(np.array(f, dtype=np.float64))
    zero, n = np.zeros(quality.OWN), len(own)
    unary = []
    for i in range(n):
        around = [own[i], own[i - 1] if i else zero, own[i + 1] if i + 1 < n else zero]
        x = np.concatenate([*[(a - model.mean) / model.scale for a in around], [i == 0, i == n - 1, 1]])
        unary.append(float(x @ model.w))
    fwd, back = [np.array([0.0, unary[0]])], [np.zeros(2)]
    for t in range(1, n):
        fwd.append(np.logaddexp(fwd[-1][0] + model.trans[0], fwd[-1][1] + model.trans[1]) + [0, unary[t]])
    for t in range(n - 1, 0, -1):
        x = model.trans + back[0] + [0, unary[t]]
        back.insert(0, np.logaddexp(x[:, 0], x[:, 1]))
    good = [1 / (1 + np.exp((f + b)[0] - (f + b)[1])) for f, b in zip(fwd, back, strict=True)]
    size = [len(x) for x in lines]
    weight = np.array(size) + 1.0
    mean = float(np.array(good) @ weight / weight.sum())
    bad = float((np.array(good) < 0.5) @ weight / weight.sum())
    z = [np.log((mean + 1e-3) / (1 - mean + 1e-3)), min(good), bad, np.log1p(sum(size)) / 10, 1]
    return 1 / (1 + np.exp(-float(np.array(z) @ model.calibration)))


def test_scores_of_the_query_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op9_quality(spark, data).collect()
    assert len(rows) == len(texts) and model.w.any()
    for r in rows:
        assert abs(r.score - plain_quality(model, texts[r.doc_id])) < 1e-3, r.doc_id


def test_very_long_texts(monkeypatch):
    model = quality.Model()
    model.w[:] = np.linspace(-1, 1, quality.WEIGHTS)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert np.isfinite(model.scores([b"\n" * 10_000_000])).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_300_000  # kB; ten million lines
    texts = [("\n".join(["word %d, again" % (i % 50) + " b" * (i % 9) for i in range(400)]) + "\n\n").encode(), b"x " * 5000, b"", b"y" * 3000 + b"\n" + b"z z " * 700]
    whole = model.scores(texts)
    monkeypatch.setattr(quality, "PORTION", 7)
    monkeypatch.setattr(quality, "PORTION_BYTES", 300)
    monkeypatch.setattr(quality, "PIECE", 50)
    assert np.allclose(model.scores(texts), whole, atol=1e-5)


def test_query_learns(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in out]) > 0.95


def test_lines_and_odd(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    clash = odd_docs.withColumn("score", odd_docs.doc_id).withColumn("rest", odd_docs.doc_id)
    assert quality.keep_good(clash, labels).columns == clash.columns
    none = labels.limit(0)
    assert quality.classify(odd_docs, none).count() == odd_docs.count()
    assert quality.classify(odd_docs.limit(0), labels).count() == 0
    x, n = quality.line_features(b"a b c\n\nA!! B!!\na b c")
    assert x.shape == (4, quality.OWN) and n.tolist() == [5, 0, 7, 5]
    assert x[3, len(quality.CLASSES) + 3] == 1
    lines = quality.label_lines(odd_docs, quality.Model()).select("doc_id", "line_quality").collect()
    assert all(len(r.line_quality) >= 1 for r in lines)
