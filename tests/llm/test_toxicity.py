import math
import random
import zlib

import numpy as np

from cohesia.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(word, words, stems):
    near = min((distance(word, w) for w in words if distance(word, w) <= toxicity.edits(w)), default=9)
    begun = min((d for s in stems for k in range(len(word) + 1) if (d := distance(word[:k], s)) <= toxicity.stem_edits(s)), default=9)
    return next((answer for holds, answer in ((near == 0, (0, 0)), (begun == 0, (0, 1)), (near == 1, (1, 2)), (begun == 1, (1, 4)), (near == 2, (2, 3))) if holds), None)


def test_automaton_equals_edit_distance():
    rnd = random.Random(4)
    words, stems = ["abcab", "abcabcab", "bca", "cabba", "aabbccaabb"], ["acc", "bbba", "cabca"]
    automaton = toxicity.Automaton(words, stems)
    for _ in range(6000):
        base = rnd.choice(words + stems)
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "c", "d"])
        w = "".join(w)
        assert automaton.match(w) == brute(w, words, stems), w


def test_misspelling_and_quotation():
    model = toxicity.Model(["moron", "disgusting"], [])
    model.weights = np.zeros(toxicity.FEATURES + 1)
    s = toxicity.Scorer(model)
    assert [h[:2] for h in s.hits("You m0ron, so disgustting!")] == [(1, 0), (3, 2)]
    quoted = s.hits('He wrote "you moron" in the letter')
    plain = s.hits("you are a moron and that is all")
    assert quoted[0][2] and not plain[0][2] and plain[0][3]


def plain_score(model, text):
    """The score of a text by edit distances of every word, without automaton, trie or caches."""
    words = (text or "").split()
    known = {}
    for w in words:
        b = toxicity.bare(w)
        if b not in known:
            known[b] = brute(b, [x for x in model.words if abs(len(x) - len(b)) <= 2], model.stems)
    count = {(k, q): 0 for k in range(len(toxicity.KINDS)) for q in (False, True)}
    addressed = 0
    for i, w in enumerate(words):
        if (found := known[toxicity.bare(w)]) is None:
            continue
        before, after = words[max(0, i - toxicity.WINDOW) : i], words[i + 1 : i + 1 + toxicity.WINDOW]
        opens = any(x[0] in toxicity.OPEN for x in [*before, w]) and not any(x[-1] in toxicity.CLOSE and x[0] not in toxicity.OPEN for x in before)
        closes = any(x.rstrip(".,;:!?")[-1:] in toxicity.CLOSE for x in [w, *after])
        near = {toxicity.bare(x) for x in before + after}
        quoted = (opens and closes) or bool(near & toxicity.REPORTING)
        count[found[1], quoted] += 1
        addressed += bool(near & toxicity.ADDRESS)
    kinds = range(len(toxicity.KINDS))
    plain = [count[k, False] for k in kinds]
    x = [math.log1p(n) for n in plain] + [math.log1p(count[k, True]) for k in kinds] + [min(n / max(1, len(words)) * 50, 3) for n in plain]
    x += [math.log1p(addressed), any(plain[:2]), any(plain[2:])]
    z = sum(a * b for a, b in zip([*x, 1], model.weights, strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_of_the_query_against_plain_search(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    if not model.words:  # few labels: any lexicon will do
        model = toxicity.Model(["idiot", "disgusting", "loser"], ["patheti", "mor"], np.linspace(-1, 1, toxicity.FEATURES + 1))
        rows = toxicity.score(docs.select("doc_id", "text"), model).collect()
    else:
        rows = queries.op6_toxicity(spark, data).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.score, plain_score(model, texts[r.doc_id]), abs_tol=1e-9), r.doc_id


def test_lexicon_follows_the_data(spark):
    """A hundred equally rare insults and an inflected one; ties are settled by the term."""
    rnd = random.Random(7)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 9))) for _ in range(400)]
    insults = ["z" + "".join(rnd.choice("klmnopqrst") for _ in range(6)) for _ in range(100)]
    say = lambda *more: " ".join([*rnd.choices(plain, k=25), *more])
    rows = [(i, say(insults[i % 100])) for i in range(1000)] + [(1000 + i, say("xurbok" + rnd.choice(["", "s", "ing", "ed"]))) for i in range(200)]
    rows += [(2000 + i, say()) for i in range(5000)] + [(8000 + i, "qqcopied qqtoxic qqtext") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < 2000 or i >= 8000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert len(set(insults) & set(model.words)) >= 90 and not set(plain) & set(model.words)
    assert not any(w.startswith("qq") for w in model.words)  # one text, however many copies
    assert any("xurbok".startswith(s) for s in model.stems) and "xurbok" in model.words
    automaton = model.automaton()
    assert automaton.match("xurboks")[0] == 0 and automaton.match("xurbpks") is not None and automaton.match("xurbok") == (0, 0)
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (again.words, again.stems) == (model.words, model.stems)


def test_query_learns(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in out]) > 0.93


def test_odd(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        out = toxicity.classify(odd_docs, lab).collect()
        assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.classify(odd_docs.limit(0), labels).count() == 0
