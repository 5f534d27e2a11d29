"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

``P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf)``.  The first two factors are log-linear models over hashed
features of the history: the word before, the words two and three before as skips, and the pair before.  Classes are groups of words that share
neighbours, divided by frequency; rare words form one, the end of a text another.  A leaf is a part of the words of a class by a hash of the word's
bytes, rare words included, and its features are hashed together with the class, so n-grams and skips reach the words inside every class.
Within a leaf words follow their corpus frequency.  In the class of rare words, whose counts are looked up by a join, one outcome of each leaf, of the weight
of its words seen once, stands for the unknown words: the model is a distribution over the known words and one unknown word a leaf.

Counts cover all training documents.  Every text is split into words once to count and once to number them; training and scoring read the numbers.
Training passes over all training documents: each task runs gradient updates on its part of the rows from common weights, and the
weights of a feature are averaged over tasks by the number of times each saw it.  Broadcast are the most frequent ``HEAD`` words and the weights, whose
number follows the tokens (``sizes``); everything of the size of the vocabulary stays in tables.  Words beyond the head are known by a
hash of their bytes, in the history and as targets alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohesia.llm.common import add_columns, slices, words
from cohesia.llm.learn import held_out
from cohesia.storage import cut, drop

FOLDS, FOLD = 7, 2
#: The end of a text; no word holds white space.
END = b"\n"
#: Words with their counts at hand in every task, of at least LEAST occurrences each.
HEAD, LEAST = 250_000, 4
#: Least numbers of words clustered by their neighbours, of neighbours counted, of groups, bands of a group and leaves of a class; more tokens give more (``sizes``).
CLUSTERED, NEIGHBOURS = 8_192, 64
GROUPS, BANDS, LEAVES = 8, 5, 16
#: Least rows of each of the feature tables of the classes; those of the leaves have twice as many.
BUCKETS = 1 << 15
#: Tokens a task trains on for each row of a feature table, and tasks that train at least.
PER_ROW, TASKS = 128, 16
TABLES = 4
BATCH, RATE, MIX = 4096, 0.35, 0.01
#: Tokens whose features are held at a time; a longer text is taken in parts.
RUN = 16 * BATCH
#: Words before a token that its features look at.
REACH = 3
#: Rows of a table that travel together when weights are averaged.
BLOCK = 64
#: Bytes of weights that one task averages.
SENT = 16 << 20
#: Bound of a weight, so that sums of five stay within the range of exp in single precision.
BOUND = 12.0


class Sizes(NamedTuple):
    clustered: int
    neighbours: int
    groups: int
    buckets: int
    leaves: int
    tasks: int
    batch: int


def sizes(tokens: int) -> Sizes:
    """What the model gathers, from the tokens measured, without an upper bound: feature rows and clustered words by the square root of the tokens,
    neighbours by the fourth root, groups and leaves by about the seventh.  Tasks become longer as the tables grow, so that what they send stays in proportion to
    the input."""
    n = max(tokens, 1)
    buckets = max(BUCKETS, 1 << round(math.log2(2 * math.sqrt(n))))
    times = buckets / BUCKETS
    tasks = max(TASKS, n // (PER_ROW * buckets))
    # Some thousand gradient steps a task, of more tokens where there are more.
    batch = min(4 * BATCH, max(BATCH, 1 << round(math.log2(n / tasks / 800 + 1))))
    return Sizes(round(CLUSTERED * times), round(NEIGHBOURS * math.sqrt(times)), max(GROUPS, round(n**0.125)), buckets, max(LEAVES, round(n**0.15)), tasks, batch)


def count_words(texts: DataFrame) -> DataFrame:
    """``(word binary, c long)`` over all texts, ends included."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            keys = list(seen)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "c"])
            seen.clear()

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0):
                    seen.update(words(t.as_py()))
                    seen[END] += 1
                if len(seen) > 500_000:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def code(word: bytes) -> int:
    """30 bits by which words are known beyond the head, and which choose the leaf of any word."""
    return zlib.crc32(word) >> 2


class _Index(dict):
    """Places of words in the head; others: -1 less their code."""

    def __missing__(self, word: bytes) -> int:
        return -1 - code(word)


def numbers(w: list[bytes], index: _Index) -> np.ndarray:
    """Numbers of words and of the end after them."""
    return np.fromiter(map(index.__getitem__, chain(w, (END,))), np.int32, len(w) + 1)


def number_texts(df: DataFrame, head: list[bytes], text: str = "text") -> DataFrame:
    """Replace a column of texts (null: empty) by ``_ids``, the numbers of its words as 32-bit integers, and ``_rare``, its words beyond the head."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    def start():
        index = _Index((w, i) for i, w in enumerate(shared.value))

        def work(batch):
            ids, rare = [], []
            for t in batch.column(0):
                w = words(t.as_py())
                x = numbers(w, index)
                ids.append(x.tobytes())
                rare.append([w[i] if i < len(w) else END for i in np.flatnonzero(x < 0).tolist()])
            return [pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]

        return work

    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField("_ids", T.BinaryType()), T.StructField("_rare", T.ArrayType(T.BinaryType()))], start, (text,))


def _texts(batches, column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in slices(batch, column):
            for t in part.column(column):
                yield np.frombuffer(t.as_py(), np.int32).astype(np.int64)


def runs(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[int]]]:
    """``(ids, starts, skip, which)``: consecutive texts, or a part of one, of about RUN tokens at most; ``starts``: where each begins, ``skip``: tokens at the front
    that are there as history only, ``which``: numbers of the texts."""
    held, which, size = [], [], 0

    def whole():
        n = np.array([len(x) for x in held])
        return np.concatenate(held), np.cumsum(n) - n, 0, which

    for i, ids in enumerate(texts):
        if held and size + len(ids) > RUN:
            yield whole()
            held, which, size = [], [], 0
        if len(ids) > RUN:
            for k in range(0, len(ids), RUN):
                low = max(0, k - REACH)
                yield ids[low : k + RUN], np.zeros(1, np.int64), k - low, [i]
        else:
            held.append(ids)
            which.append(i)
            size += len(ids)
    if held:
        yield whole()


def neighbour_counts(numbered: DataFrame, head: int, size: Sizes) -> np.ndarray:
    """For each of the first words of the head (``size.clustered``), how often each of the first ``size.neighbours`` stands beside it."""
    n, d = min(size.clustered, head), min(size.neighbours, head)

    def run(batches):
        total = np.zeros(n * d, np.int64)
        for ids, starts, skip, _ in runs(_texts(batches)):
            left, right = ids[:-1], ids[1:]
            # A pair across two texts is none, nor is one that the part before had.
            inside = np.ones(len(left), bool)
            inside[starts[1:] - 1] = False
            inside[: max(skip - 1, 0)] = False
            for a, b in ((left, right), (right, left)):
                ok = inside & (a >= 0) & (a < n) & (b >= 0) & (b < d)
                total += np.bincount(a[ok] * d + b[ok], minlength=n * d)
        m = total.reshape(n, d)
        rows = np.flatnonzero(m.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(m[rows, j]) for j in range(d)]], names=["w", *[f"n{j}" for j in range(d)]])

    found = numbered.coalesce(size.tasks).mapInArrow(run, ", ".join(["w long", *[f"n{j} long" for j in range(d)]])).groupBy("w").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(d)]).toArrow()
    out = np.zeros((n, d))
    at = found.column("w").to_numpy()
    for j in range(d):
        out[at, j] = found.column(f"n{j}").to_numpy()
    return out


def cluster(near: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """Group of each word: k-means on square roots of neighbour shares, seeds far apart, always the same for the same counts."""
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    k = min(groups, len(x))
    if k < 2:
        return np.zeros(len(x), int)
    centres = [x[0]]
    w = np.sqrt(weight)
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(far * w))])
    c = np.array(centres)
    own = np.zeros(len(x), int)
    for _ in range(25):
        own = np.argmax(x @ c.T - (c**2).sum(axis=1) / 2, axis=1)
        c = np.array([(x[own == g] * w[own == g, None]).sum(axis=0) / max(w[own == g].sum(), 1e-9) if (own == g).any() else c[g] for g in range(k)])
    return own


def spell_groups(head: list[bytes], own: np.ndarray, groups: int) -> np.ndarray:
    """Groups of the words beyond the clustered ones, by letter triples of the clustered ones (naive Bayes)."""
    grams = lambda w: [w[i : i + 3] for i in range(max(1, len(w) - 2))]
    seen: dict[bytes, np.ndarray] = {}
    for w, g in zip(head, own, strict=False):
        for t in grams(b"^" + w + b"$"):
            seen.setdefault(t, np.full(groups, 0.3))[g] += 1
    prior = np.bincount(own, minlength=groups) + 1.0
    total = sum(seen.values()) if seen else np.ones(groups)
    logs = {t: np.log(v / total) for t, v in seen.items()}
    none = np.log(0.3 / total)
    out = np.empty(len(head), int)
    out[: len(own)] = own
    for i in range(len(own), len(head)):
        out[i] = int(np.argmax(np.log(prior) + sum(logs.get(t, none) for t in grams(b"^" + head[i] + b"$"))))
    return out


class Vocabulary(NamedTuple):
    """Head words with their counts; tokens, distinct words; for each remainder of the code by the number of leaves: tokens and words seen once."""

    head: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    size: Sizes
    leaf_tokens: np.ndarray
    leaf_once: np.ndarray


def vocabulary(counts: DataFrame) -> Vocabulary:
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = sizes(totals.n)
    top = counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    leaf = (F.shiftright(F.crc32("word"), 2) % size.leaves).cast("int").alias("leaf")
    tokens, once = np.zeros(size.leaves), np.zeros(size.leaves)
    for r in counts.groupBy(leaf).agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).collect():
        tokens[r.leaf], once[r.leaf] = r.n, r.once
    return Vocabulary(top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.float64), totals.n, totals.v, size, tokens, once)


_held: dict[tuple[int, int], np.ndarray] = {}


def _scratch(use: int, rows: int, width: int) -> np.ndarray:
    """Room that is used again and again: the pages of a new array cost as much as the sums in it."""
    held = _held.get((use, width))
    if held is None or len(held) < rows:
        held = _held[use, width] = np.empty((rows, width), np.float32)
    return held[:rows]


class Model:
    """Classes and leaves of the words, and the weights of both factors."""

    def __init__(self, vocab: Vocabulary, groups: np.ndarray):
        head, counts, size = vocab.head, vocab.counts, vocab.size
        self.head, self.total, self.distinct = head, vocab.total, vocab.distinct
        self.buckets, self.inner, self.leaves, self.batch = size.buckets, 2 * size.buckets, size.leaves, size.batch
        self.classes = size.groups * BANDS + 2
        end, self.tail = self.classes - 2, self.classes - 1
        # Bands of equal mass inside a group, most frequent words first.
        self.cls = np.zeros(len(head), np.int64)
        for g in range(size.groups):
            rows = np.flatnonzero(groups == g)
            mass = np.cumsum(counts[rows])
            if len(rows):
                self.cls[rows] = g * BANDS + np.minimum(((mass - counts[rows]) * BANDS) // max(mass[-1], 1), BANDS - 1)
        self.leaf = np.fromiter((code(w) % self.leaves for w in head), np.int64, len(head))
        for i, w in enumerate(head):
            if w == END:
                self.cls[i] = end
        mass = np.zeros((self.classes, self.leaves))
        np.add.at(mass, (self.cls, self.leaf), counts)
        # Of the rare words what the head leaves, and the unknown word of each leaf.
        self.unknown = np.maximum(vocab.leaf_once, 1)
        self.rare = np.maximum(vocab.leaf_tokens - np.bincount(self.leaf, counts, self.leaves), 0) + self.unknown
        mass[self.tail] = self.rare
        of_class = mass.sum(axis=1)
        self.prior = of_class / of_class.sum()
        self.leaf_prior = mass / np.maximum(of_class, 1e-9)[:, None]
        self.w = np.zeros((TABLES, self.buckets, self.classes), np.float32)
        self.u = np.zeros((TABLES, self.inner, self.leaves), np.float32)
        self.bias = np.log(self.prior + 1e-9).astype(np.float32)
        self.leaf_bias = np.log(self.leaf_prior + 1e-13).astype(np.float32)
        self.within = np.log10(counts / mass[self.cls, self.leaf]) if len(head) else np.zeros(0)
        self.base = np.log10(counts + 1.0)

    def __getstate__(self):
        """Weights travel in half precision, in which :func:`fit_weights` keeps them, and not at all before they are fitted."""
        return self.__dict__ | {k: (getattr(self, k).shape, getattr(self, k).astype(np.float16) if getattr(self, k).any() else None) for k in ("w", "u")}

    def __setstate__(self, state):
        self.__dict__ |= state
        for k in ("w", "u"):
            shape, values = state[k]
            setattr(self, k, np.zeros(shape, np.float32) if values is None else values.astype(np.float32))

    def targets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and leaf of every token."""
        known, at = ids >= 0, np.maximum(ids, 0)
        if not len(self.head):
            return np.full(len(ids), self.tail), (-1 - ids) % self.leaves
        return np.where(known, self.cls[at], self.tail), np.where(known, self.leaf[at], (-1 - ids) % self.leaves)

    def history(self, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The features of every token: numbers of the word before, two before, three before, and of the pair before; -2 ** 31: none."""
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        back = []
        for d in range(1, REACH + 1):
            h = np.full(len(ids), -(1 << 31), np.int64)
            h[d:] = ids[:-d]
            back.append(np.where(place >= d, h, -(1 << 31)) + 3)
        return [back[0] * 2654435761, back[1] * 2246822519 + 11, back[2] * 3266489917 + 23, back[0] * 668265263 + back[1] * 374761393 + 37]

    def class_rows(self, history: list[np.ndarray]) -> list[np.ndarray]:
        return [(((m ^ (m >> 15)) * 2057) >> 7) & (self.buckets - 1) for m in history]

    def leaf_rows(self, history: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        own = (y + 1) * 0x5851F42D4C957F2D
        return [(((x := (m * 0x2545F4914F6CDD1D) ^ own) ^ (x >> 31)) >> 13) & (self.inner - 1) for m in history]

    @staticmethod
    def exp_scores(tables: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the sums of the rows of all tables, and their totals over the columns; valid until the next call for as many columns."""
        n, width = len(rows[0]), tables.shape[2]
        s, more = (_scratch(k, n, width) for k in (0, 1))
        np.take(tables[0], rows[0], axis=0, out=s, mode="clip")
        for t in range(1, TABLES):
            np.take(tables[t], rows[t], axis=0, out=more, mode="clip")
            s += more
        s += bias
        np.exp(s, out=s)
        return s, s @ np.ones(width, np.float32)

    def share(self, tables: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Softmax of the columns ``y``."""
        s, total = self.exp_scores(tables, rows, bias)
        return s[np.arange(len(y)), y].astype(np.float64) / total

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of the probability of the class and the leaf of each token, each mixed with its corpus share, and of a head word in its leaf."""
        y, leaf = self.targets(ids)
        history = self.history(ids, starts)
        out = np.empty(len(ids))
        for k in range(0, len(ids), BATCH):
            h, a, b = [x[k : k + BATCH] for x in history], y[k : k + BATCH], leaf[k : k + BATCH]
            p = self.share(self.w, self.class_rows(h), self.bias, a)
            q = self.share(self.u, self.leaf_rows(h, a), self.leaf_bias[a], b)
            out[k : k + BATCH] = np.log10((1 - MIX) * p + MIX * self.prior[a]) + np.log10((1 - MIX) * q + MIX * self.leaf_prior[a, b])
        if len(self.head):
            out += np.where(ids >= 0, self.within[np.maximum(ids, 0)], 0)
        return out


def _order(rows: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most`` by radix sorts of 16 bits."""
    order = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, (most - 1).bit_length(), 16):
        order = order[np.argsort((rows[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _sums(p: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group: ``order`` has the rows of a group together, from ``first`` on, ``n`` of them.

    The second rows of all groups are added at once, then the third ones; the few long groups that remain one by one."""
    out = np.take(p, order[first], axis=0, out=_scratch(2, len(first), p.shape[1]), mode="clip")
    left, k = np.flatnonzero(n > 1), 1
    while len(left) > 24:
        out[left] += p.take(order[first[left] + k], axis=0)
        k += 1
        left = left[n[left] > k]
    for i in left:
        out[i] += np.ones(n[i] - k, np.float32) @ p[order[first[i] + k : first[i] + n[i]]]
    return out


class _Trainer:
    """Weights of a task with the running squares of the gradients of each row and the tokens that it saw."""

    def __init__(self, model: Model):
        self.model, self.w, self.u = model, model.w.copy(), model.u.copy()
        self.square = [np.ones(x.shape[:2], np.float32) for x in (self.w, self.u)]
        self.seen = [np.zeros(x.shape[:2], np.int64) for x in (self.w, self.u)]

    def _step(self, kind: int, rows: list[np.ndarray], bias: np.ndarray, y: np.ndarray) -> None:
        tables, square, seen = (self.w, self.u)[kind], self.square[kind], self.seen[kind]
        p, total = self.model.exp_scores(tables, rows, bias)
        p /= total[:, None]
        p[np.arange(len(y)), y] -= 1
        for t, f in enumerate(rows):
            order = _order(f, tables.shape[1])
            g = f[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            at, n = g[first], np.diff(np.append(first, len(g)))
            seen[t][at] += n
            grad = _sums(p, order, first, n)
            size = square[t].take(at)
            size += np.einsum("ij,ij->i", grad, grad)
            square[t][at] = size
            grad *= (RATE / np.sqrt(size))[:, None]
            new = np.take(tables[t], at, axis=0, out=_scratch(3, len(at), tables.shape[2]), mode="clip")
            new -= grad
            tables[t][at] = np.clip(new, -BOUND, BOUND, out=new)

    def learn(self, ids: np.ndarray, starts: np.ndarray, skip: int) -> None:
        m = self.model
        y, leaf = m.targets(ids)
        history = m.history(ids, starts)
        for k in range(skip, len(ids), m.batch):
            h, a, b = [x[k : k + m.batch] for x in history], y[k : k + m.batch], leaf[k : k + m.batch]
            self._step(0, m.class_rows(h), m.bias, a)
            self._step(1, m.leaf_rows(h, a), m.leaf_bias[a], b)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """``(kind, block, n, v)``: tokens and weights, in half precision, of BLOCK rows of a table, where any was seen."""
        for kind, (w, seen) in enumerate(zip((self.w, self.u), self.seen, strict=True)):
            n, v = seen.reshape(-1, BLOCK).astype(np.int32), w.reshape(-1, BLOCK * w.shape[2])
            rows = np.flatnonzero(n.any(axis=1))
            for k in range(0, len(rows), 256):
                at = rows[k : k + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array([x.tobytes() for x in n[at]], pa.binary()), pa.array([x.tobytes() for x in v[at].astype(np.float16)], pa.binary())], names=["kind", "block", "n", "v"]
                )


def fit_weights(numbered: DataFrame, model: Model, tasks: int) -> None:
    """Gradient updates over all texts, in every task from the same weights, averaged by feature row."""
    shared = numbered.sparkSession.sparkContext.broadcast(model)
    schema = "kind int, block long, n binary, v binary"

    def run(batches):
        own = _Trainer(shared.value)
        for ids, starts, skip, _ in runs(_texts(batches)):
            own.learn(ids, starts, skip)
        yield from own.blocks()

    def average(batches):
        """A task holds the sums of its share of the model."""
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for kind, block, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(n, np.int32).astype(np.float64)
                v = np.frombuffer(v, np.float16).reshape(BLOCK, -1) * n[:, None]
                old = sums.setdefault((kind, block), [np.zeros(BLOCK), np.zeros(v.shape)])
                old[0] += n
                old[1] += v
        for (kind, block), (n, v) in sums.items():
            mean = (v / np.maximum(n, 1)[:, None]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([b""], pa.binary()), pa.array([mean.tobytes()], pa.binary())], names=["kind", "block", "n", "v"])

    # Whole multiples of the partitions there are, so that no task gets more of them than another.
    have = numbered.rdd.getNumPartitions()
    tasks = math.ceil(have / max(1, have // tasks))
    # As many parts as what the tasks send takes, up to one for each block of the model.
    sent = tasks * (model.w.size + model.u.size) * 2
    parts = max(8, min(sent // SENT, (model.buckets + model.inner) * TABLES // BLOCK))
    mean = numbered.coalesce(tasks).mapInArrow(run, schema).repartition(parts, "kind", "block").mapInArrow(average, schema).select("kind", "block", "v").toArrow()
    flat = [x.reshape(-1, BLOCK * x.shape[2]) for x in (model.w, model.u)]
    for kind, block, v in zip(*(mean.column(c) for c in ("kind", "block", "v")), strict=True):
        flat[kind.as_py()][block.as_py()] = np.frombuffer(v.as_py(), np.float16)
    shared.unpersist()


def fit(numbered: DataFrame, vocab: Vocabulary) -> Model:
    """Model of a frame whose first column holds numbered texts."""
    groups = np.zeros(0, int)
    if vocab.head:
        near = neighbour_counts(numbered, len(vocab.head), vocab.size)
        groups = spell_groups(vocab.head, cluster(near, vocab.counts[: len(near)], vocab.size.groups), vocab.size.groups)
    model = Model(vocab, groups)
    if vocab.total:
        fit_weights(numbered, model, vocab.size.tasks)
    return model


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """Model and word counts ``(word, c)`` of a frame with one binary column of texts (null: empty)."""
    counts = cut(count_words(texts), "lm-counts")
    vocab = vocabulary(counts)
    numbered = cut(number_texts(texts.toDF("t"), vocab.head, "t"), "lm-numbers", "zstd")
    model = fit(numbered.select("_ids"), vocab)
    drop(numbered)
    return model, counts


def score_numbered(numbered: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Replace ``_row, _ids, _rare`` by ``n_tokens, n_known, base_score, score``; words beyond the head are looked up by a join."""
    shared = numbered.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("_n", T.LongType()), T.StructField("_known", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("_score", T.DoubleType())]

    def start():
        model = shared.value

        def work(batch):
            n, known, base, total = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64, np.float64))
            for ids, starts, skip, which in runs(_texts([batch])):
                logs, inside = model.log10(ids, starts), ids >= 0
                bases = np.where(inside, model.base[np.maximum(ids, 0)], 0) if len(model.head) else np.zeros(len(ids))
                for x in (logs, inside, bases):
                    x[:skip] = 0
                n[which] += np.diff(np.append(starts, len(ids))) - skip
                known[which] += np.add.reduceat(inside.astype(np.int64), starts)
                base[which] += np.add.reduceat(bases, starts)
                total[which] += np.add.reduceat(logs, starts)
            return [pa.array(x) for x in (n, known, base, total)]

        return work

    first = add_columns(numbered.drop("_rare"), {"ids": F.col("_ids")}, new, start, ("_ids",))
    tail = numbered.select("_row", F.explode("_rare").alias("_word")).join(counts.withColumnRenamed("word", "_word"), "_word", "left")
    at = (F.shiftright(F.crc32("_word"), 2) % model.leaves + 1).cast("int")
    of = lambda x: F.element_at(F.lit([float(v) for v in x]), at)
    sums = tail.groupBy("_row").agg(
        F.count("c").alias("_k"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("_b"),
        F.sum(F.log10(F.coalesce(F.col("c").cast("double"), of(model.unknown)) / of(model.rare))).alias("_s"),
    )
    out = first.join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    unit = float(np.log10(model.total + model.distinct + 1.0))
    out = out.withColumns({"n_tokens": F.col("_n"), "n_known": F.col("_known") + F.coalesce("_k", F.lit(0)), "base_score": F.col("_base") + zero("_b") - F.col("_n") * F.lit(unit), "score": F.col("_score") + zero("_s")})
    return out.drop("_row", "_n", "_known", "_base", "_score", "_k", "_b", "_s")


def score(df: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """Replace the column of texts by ``n_tokens, n_known, base_score, score``; null texts are empty (their end is a token).

    ``base_score``: add-one unigram log10 probability; ``score``: log10 probability under the model."""
    numbered = number_texts(df, model.head, text).withColumn("_row", F.monotonically_increasing_id())
    return score_numbered(cut(numbered, "lm-numbers", "zstd"), model, counts)


def score_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, learning from the rows not held out.

    Rows without an id are not held out.  With no training rows every word is unknown."""
    rows = docs.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text")
    counts = cut(count_words(rows.where(~F.col("held_out")).select(F.coalesce("text", F.lit("")).cast("binary").alias("t"))), "lm-counts")
    vocab = vocabulary(counts)
    numbered = cut(number_texts(rows, vocab.head).withColumn("_row", F.monotonically_increasing_id()), "lm-numbers", "zstd")
    model = fit(numbered.where(~F.col("held_out")).select("_ids"), vocab)
    out = score_numbered(numbered, model, counts)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
