"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from labelled training documents: whole words, and word beginnings (stems, for inflected languages), whose share
among toxic ones is higher than chance allows.  A term needs SUPPORT toxic texts and a likelihood ratio that none of all terms looked at would reach by
chance, so rare terms enter as the labels grow, and their number follows the data.  All terms form one trie; its intersection with the Levenshtein automata of the terms is
run as a lazily determinised automaton, so that each distinct word is read once, letter by letter, until no term is
within reach.  Whole words allow one edit from 5 letters and two from 8; stems one from 5.

Each occurrence is weighed by the window around it: quotation marks and words of reporting speak for a quotation, words of address for
abuse.  A logistic model over the counts by kind and context gives the score.

Lexicon and weights are fitted on a bounded sample of labelled documents (``SAMPLE``); scoring covers whole texts of all documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohesia.llm import simhash
from cohesia.llm.common import Remembered, add_columns, slices
from cohesia.llm.learn import held_out, labelled_sample, logistic, sigmoid
from cohesia.operators.components import merge_labels
from cohesia.storage import cut, drop

#: Bound of the training sample in labelled documents.
SAMPLE = 20_000
#: Bits of a 64-bit SimHash in which near copies differ at most; unrelated texts differ in about 32.
COPY_BITS = 12
#: Least number of unlike toxic texts with a term, least ratio of its shares in toxic and clean texts, and chance of any term entering by accident.
SUPPORT, ODDS, CHANCE = 4, 12, 0.01
FOLDS, FOLD = 5, 0
WINDOW = 8
#: Words of a generation kept with their kinds in a worker.
KEPT = 150_000
STEMS = (3, 4, 5, 6, 7, 8)
#: Digits and signs written for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
#: Words of reporting and of address.
REPORTING = set("said says say wrote writes quoted quote quotes called calls reported according term word words phrase dit écrit selon mot sagte schrieb laut wort dijo escribió según palabra".split())
ADDRESS = set("you your you're youre u ur yours du dich dir dein deine ihr euch vous tu toi ton ta votre te ti tú eres usted".split())
OPEN, CLOSE = set("\"“„«‘'"), set("\"”“»’'")
KINDS = ("word", "stem", "near", "far", "bent")


def bare(word: str) -> str:
    """A word without signs at its ends, lower-cased, look-alike signs inside as letters, marks composed."""
    w = unicodedata.normalize("NFC", word.lower())
    a, b = 0, len(w)
    while a < b and not (w[a].isalnum() or w[a] in "@$"):
        a += 1
    while b > a and not (w[b - 1].isalnum() or w[b - 1] in "@$"):
        b -= 1
    w = w[a:b]
    if not w.isalpha() and any(c.isalpha() for c in w):
        w = w.translate(LOOKALIKE)
    return w


def edits(term: str) -> int:
    return 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0


def stem_edits(stem: str) -> int:
    return 1 if len(stem) >= 5 else 0


class Automaton:
    """Union over all terms of Levenshtein automata on the trie of the terms, determinised as words are read.

    A state is the set of (trie node, edits so far) that are still alive, least edits only.  States and their steps are kept; when
    they become many they are dropped and found again."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.allowed = [0]  # most edits of a term at or below the node
        self.end: dict[int, int] = {}  # node -> edits allowed for the word that ends here
        self.stem: dict[int, int] = {}  # the same for the stem
        for term, k, ends in [(w, edits(w), self.end) for w in words] + [(s, stem_edits(s), self.stem) for s in stems]:
            node = 0
            self.allowed[0] = max(self.allowed[0], k)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.allowed.append(0)
                node = self.child[node][c]
                self.allowed[node] = max(self.allowed[node], k)
            ends[node] = k
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.stems: list[int] = []  # least edits of a stem that ends in the state
        self.steps: list[dict[str, int]] = []
        self.start = self._id(self._close({0: 0}))

    def _close(self, alive: dict[int, int]) -> frozenset:
        """Add what letters missing from the word reach."""
        todo = list(alive.items())
        while todo:
            node, e = todo.pop()
            if alive[node] < e:
                continue
            for to in self.child[node].values():
                if e + 1 <= self.allowed[to] and e + 1 < alive.get(to, 9):
                    alive[to] = e + 1
                    todo.append((to, e + 1))
        return frozenset(alive.items())

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.stems.append(min((e for n, e in state if e <= self.stem.get(n, -1)), default=9))
            self.steps.append({})
        return self.ids[state]

    def _step(self, at: int, c: str) -> int:
        alive: dict[int, int] = {}

        def put(node, e):
            if e <= self.allowed[node] and e < alive.get(node, 9):
                alive[node] = e

        for node, e in self.states[at]:
            put(node, e + 1)  # a letter too many
            for letter, to in self.child[node].items():
                if letter == c:
                    if e < alive.get(to, 9):
                        alive[to] = e
                else:
                    put(to, e + 1)
        to = self._id(self._close(alive))
        self.steps[at][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """``(edits, kind)`` of the best term, in this order: 0 a word, 1 a stem, 2 a word one edit away, 4 a stem one edit away, 3 a word two
        edits away; None: no term."""
        if len(self.states) > 50_000:
            self.reset()
        at, stem = self.start, 9
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            state = self.states[at]
            if not state:
                break
            if stem:
                stem = min(stem, self.stems[at])
        best = min((e for n, e in self.states[at] if e <= self.end.get(n, -1)), default=9)
        if best == 0:
            return 0, 0
        if stem == 0:
            return 0, 1
        if best == 1:
            return 1, 2
        if stem == 1:
            return 1, 4
        return (2, 3) if best == 2 else None


class Model:
    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray | None = None):
        self.words, self.stems = words, stems
        self.weights = np.zeros(FEATURES + 1) if weights is None else weights

    def automaton(self) -> Automaton:
        return Automaton(self.words, self.stems)


FEATURES = 3 * len(KINDS) + 3


class Scorer:
    """Runs a model over texts, keeping the answer for each distinct word (bounded)."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, model.automaton()
        # Word -> kind of its best term, -1: none.
        self.kinds = Remembered(lambda word: -1 if (found := self.automaton.match(bare(word))) is None else found[1], KEPT, 64)

    def hits(self, text: str) -> list[tuple[int, int, bool, bool]]:
        """``(word position, kind, quoted, addressed)`` of each occurrence of a term."""
        words = text.split()
        kinds = np.fromiter(map(self.kinds.__getitem__, words), np.int8, len(words))
        at = np.flatnonzero(kinds >= 0)
        out = []
        for i in at.tolist():
            a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            before, after = words[a : i + 1], words[i:b]
            opened = any(w[0] in OPEN for w in before) and not any(w[-1] in CLOSE and w[0] not in OPEN for w in before[:-1])
            closed = any(w.rstrip(".,;:!?")[-1:] in CLOSE for w in after)
            near = {bare(w) for w in before[:-1] + after[1:]}
            out.append((i, int(kinds[i]), (opened and closed) or bool(near & REPORTING), bool(near & ADDRESS)))
        return out

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(FEATURES)
        if not text:
            return x
        found = self.hits(text)
        n = max(1, len(text.split())) if found else 1
        k = len(KINDS)
        for _, kind, quoted, addressed in found:
            x[kind + (k if quoted else 0)] += 1
            x[2 * k + kind] += not quoted
            x[3 * k] += addressed
        x[: 2 * k] = np.log1p(x[: 2 * k])
        x[2 * k : 3 * k] = np.minimum(x[2 * k : 3 * k] / n * 50, 3)
        x[3 * k] = np.log1p(x[3 * k])
        x[3 * k + 1] = any(kind < 2 and not quoted for _, kind, quoted, _ in found)
        x[3 * k + 2] = any(kind >= 2 and not quoted for _, kind, quoted, _ in found)
        return x


def candidates(text: str) -> set[str]:
    """Bare words, and their beginnings marked by ``*``, of a text."""
    out = set()
    for w in set(text.split()):
        w = bare(w)
        if len(w) >= 3 and w.isalpha():
            out.add(w)
            out.update(w[:n] + "*" for n in STEMS if n < len(w))
    return out


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Words and stems of the lexicon, from the terms ``(term, toxic texts, clean texts)`` that speak for the label.

    A word stays whether or not a stem covers it, as it allows edits of its own.  A stem adds something if it reaches more texts than the most
    frequent word or longer stem that begins with it, and no shorter stem covers it.  Ties go by the term itself."""
    words = sorted(t for t, _, _ in counts if not t.endswith("*"))
    reach: dict[str, int] = {}
    for t, a, _ in counts:
        for n in STEMS:
            if n < len(t) - 1 or not t.endswith("*"):
                reach[t[:n]] = max(reach.get(t[:n], 0), a)
    odds = lambda t, c: ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
    options = sorted((-a * math.log(odds(a, b)), -len(t), t[:-1]) for t, a, b in counts if t.endswith("*") and reach.get(t[:-1], 0) < 0.9 * a)
    stems: set[str] = set()
    for _, _, t in options:
        if not any(t[:n] in stems for n in STEMS):
            stems.add(t)
    return words, sorted(s for s in stems if not any(s[:n] in stems for n in STEMS if n < len(s)))


def likelihood_ratio(t, c, toxic: int, clean: int):
    """Twice the log likelihood ratio of a term in ``t`` of the toxic and ``c`` of the clean texts against one share in both."""
    total = toxic + clean
    part = lambda seen, of, n: F.when(seen > 0, seen * F.log(seen * F.lit(total) / (of * F.lit(float(n))))).otherwise(F.lit(0.0))
    with_, without = t + c, F.lit(total) - t - c
    return 2 * (part(t, with_, toxic) + part(c, with_, clean) + part(F.lit(toxic) - t, without, toxic) + part(F.lit(clean) - c, without, clean))


def least_ratio(terms: int) -> float:
    """The likelihood ratio that one of so many terms exceeds by accident with a chance of CHANCE (chi-squared, one degree)."""
    p = CHANCE / max(terms, 1)
    low, high = 0.0, 2000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return high


def _unlike(sample: DataFrame) -> DataFrame:
    """One text of each group of near copies of a bounded sample ``(label, text)``: copies say nothing new about their words.

    Fingerprints of SAMPLE texts at most are compared in one task, a block against all at a time."""
    marked = simhash.fingerprints(sample.groupBy("text").agg(F.max("label").alias("label")).select("label", "text", F.xxhash64("text").alias("hash")))
    marked = cut(marked, "toxic-marked")

    def first(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if not rows:
            return
        hashes, fps = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes, fps = hashes[order], fps[order]
        label = np.arange(len(fps))
        for k in range(0, len(fps), 256):
            a, b = np.nonzero(np.bitwise_count(fps[k : k + 256, None] ^ fps[None, k:]) <= COPY_BITS)
            label = merge_labels(label, a + k, b + k)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[label == np.arange(len(fps))])], names=["hash"])

    kept = marked.select("hash", "fp").coalesce(1).mapInArrow(first, "hash long")
    return cut(marked.join(kept, "hash", "left_semi").select("label", "text"), "toxic-unlike")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and weights from the labelled sample."""
    sample = cut(labelled_sample(docs, labels, "toxic", SAMPLE, FOLDS, FOLD).select("label", F.col("text").cast("binary").alias("text")), "toxic-sample")
    unlike = _unlike(sample)
    n = {r.label: r.n for r in unlike.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        w = np.zeros(FEATURES + 1)
        w[-1] = 3.0 if toxic else -3.0
        return Model([], [], w)

    def count(batches):
        of: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            keys = list(of[0] | of[1])
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([of[1][t] for t in part], pa.int64()), pa.array([of[0][t] for t in part], pa.int64())], names=["term", "t", "c"])
            for c in of.values():
                c.clear()

        for batch in batches:
            for part in slices(batch, 1):
                for y, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    of[y].update(candidates(t.as_py().decode()))
                if len(of[0]) + len(of[1]) > 400_000:
                    yield from flush()
        yield from flush()

    counts = unlike.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = cut(counts.where(F.col("t") + F.col("c") >= SUPPORT), "toxic-terms")
    t, c = F.col("t"), F.col("c")
    odds = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
    # Every term that is collected has SUPPORT texts of the sample, which bounds their number.
    chosen = counts.where((t >= SUPPORT) & (odds >= ODDS) & (likelihood_ratio(t, c, toxic, clean) >= least_ratio(counts.count())))
    words, stems = choose_terms(sorted(tuple(r) for r in chosen.collect()), toxic, clean)
    drop(counts)
    model = Model(words, stems)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                x = np.array([scorer.features(t.as_py().decode()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = unlike.mapInArrow(features, "y int, x array<double>").groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r.y, tuple(r.x)))
    x = np.repeat(np.array([r.x for r in rows]), [r.n for r in rows], axis=0)
    y = np.repeat(np.array([r.y for r in rows]), [r.n for r in rows])
    model.weights = logistic(x, y)
    drop(unlike)
    drop(sample)
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", without: tuple[str, ...] = ()) -> DataFrame:
    """Append the toxicity (0 to 1) of every whole text; null and empty texts have that of a text without terms."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)

        def work(batch):
            x = np.array([scorer.features(t.decode() if t else None) for t in batch.column(0).to_pylist()]).reshape(batch.num_rows, FEATURES)
            return [pa.array(sigmoid(x @ scorer.model.weights[:-1] + scorer.model.weights[-1]), pa.float64())]

        return work

    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(out, T.DoubleType())], start, without)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    out = score(docs.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text"), train(docs, labels), without=("text",))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
