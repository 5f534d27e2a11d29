"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features describe the line itself and, with weights of their own, the lines before and after it; transitions between
neighbouring labels have weights too.  Training maximises the conditional likelihood by gradient ascent with labels that come
from the documents: lines of a good document are good; those of a bad one start bad and, after a first fit, the lines that
look good by themselves are relabelled.  Forward-backward marginals, weighted by line length, are summed up for the document and calibrated.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``, one row for each id), whole documents as everywhere; parts of the sample are fitted
in tasks of their own and their weights averaged, twice, so the driver sees weights and one summary a document.

Documents of a batch form one chain whose transitions are cut where a document begins.  The chain is folded into blocks that are
run side by side, so a document of a million lines takes some thousand steps, and lines are described in portions, so that it takes some 60 bytes a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohesia.llm.common import add_columns, slices
from cohesia.llm.learn import held_out, labelled_sample, logistic, sigmoid
from cohesia.storage import cut, drop

#: Bound of the training sample in labelled documents; portions of documents in a part that is fitted by itself; rounds of ascent in each of the two fits.
SAMPLE, PART, ROUNDS = 4_000, 500, 40
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3

#: Byte classes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:'\"()",
    "shout": b"!?",
    "pipe": b"|<>[]{}\\/=_",
    "symbol": b"#$%&*+@^~",
    "space": b" \t",
    "high": bytes(range(128, 256)),
}
_TABLES = [np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for v in CLASSES.values()]
OWN = len(CLASSES) + 8
#: Weights of a line: its own features, those of the line before and the line after, whether it is the first or the last, and a constant.
WEIGHTS = 3 * OWN + 3
#: Lines and bytes described at a time (one line at least), and the piece in which a longer line is split into words.
PORTION, PORTION_BYTES, PIECE = 20_000, 2 << 20, 1 << 20


def _word_facts(line: bytes) -> tuple[int, int, int, bytes]:
    """Words of a line, distinct ones, words equal to the one before, and the last word."""
    if len(line) <= PIECE:
        w = line.split()
        return len(w), len(set(w)), sum(map(bytes.__eq__, w, w[1:])), w[-1] if w else b""
    count, same, last, distinct, at = 0, 0, b"", set(), 0
    while at < len(line):
        end = min(len(line), at + PIECE)
        while end < len(line) and line[end] not in b" \t\r\x0b\x0c":
            end += 1  # a word is never cut
        w = line[at:end].split()
        at = end
        if w:
            same += sum(map(bytes.__eq__, w, w[1:])) + (w[0] == last)
            count, last = count + len(w), w[-1]
            distinct.update(map(hash, w))
    return count, len(distinct), same, last


def portions(text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features (lines x OWN) and byte lengths of the lines of a text, in portions; a text without lines has one empty line."""
    text = text or b""
    ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text)).astype(np.int64)
    seen: set[int] = set()
    low, at = 0, 0
    while low < len(ends):
        high = max(low + 1, min(low + PORTION, int(np.searchsorted(ends, at + PORTION_BYTES, "right"))))
        stop = int(ends[high - 1])
        part = text[at:stop] + b"\n"
        starts = np.concatenate([[at], ends[low : high - 1] + 1]) - at
        length = ends[low:high] - at - starts
        own = np.zeros((high - low, OWN), np.float32)
        raw = np.frombuffer(part, np.uint8)
        for k, t in enumerate(_TABLES):
            own[:, k] = np.add.reduceat(t[raw], starts, dtype=np.int64) / np.maximum(length, 1)
        k = len(CLASSES)
        own[:, k] = 1
        for i, line in enumerate(part[:-1].split(b"\n")):
            if not line or line.isspace():
                continue
            m, distinct, same, last = _word_facts(line)
            h = hash(line)
            own[i, k:] = (0, m > 2 and 1 - distinct / m, same / m, h in seen, min(len(line) / m / 10, 3), m < 3, np.log1p(m) / 6, last[-1:] in b".!?\"'")
            seen.add(h)
        yield own, length
        low, at = high, stop + 1


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """All of :func:`portions` at once."""
    own, length = zip(*portions(text), strict=True)
    return np.concatenate(own), np.concatenate(length)


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for every line, and the expected numbers of the four label pairs (2 x 2).

    ``unary``: log-odds of good from the features of all lines of some documents, one after the other; ``first``: which begin a document; ``trans``: weights of pairs of labels.
    A transition into a first line has the same weight from either label, which cuts the chain there."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    u = np.clip(unary, -200, 200)
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    # Lines that fill up the last block come after all others and begin documents of their own.
    u = np.concatenate([u, np.zeros(pad)]).reshape(blocks, width)
    cut_at = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, width).copy()
    cut_at[0, 0] = True
    t = np.exp(np.clip(trans, -100, 100) - np.clip(trans, -100, 100).max())
    good = np.exp(np.minimum(u, 0))
    bad = np.exp(-np.maximum(u, 0))

    def step(j: int) -> np.ndarray:
        """Transfer matrices (blocks x 2 x 2) into the lines at place j of their blocks."""
        m = np.where(cut_at[:, j, None, None], 1.0, t)
        return m * np.stack([bad[:, j], good[:, j]], axis=-1)[:, None, :]

    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for j in range(width):
        whole = whole @ step(j)
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into, back = np.ones((blocks, 2)), np.ones((blocks, 2))
    for b in range(1, blocks):
        v = into[b - 1] @ whole[b - 1]
        into[b] = v / v.max()
        v = whole[blocks - b] @ back[blocks - b]
        back[blocks - b - 1] = v / v.max()
    ahead = np.empty((blocks, width))  # share of good in the forward message
    v = into
    for j in range(width):
        v = (v[:, None] @ step(j))[:, 0]
        v /= v.sum(axis=1, keepdims=True)
        ahead[:, j] = v[:, 1]
    behind = np.empty((blocks, width))
    v = back / back.sum(axis=1, keepdims=True)
    for j in range(width - 1, -1, -1):
        behind[:, j] = v[:, 1]
        v = (step(j) @ v[..., None])[..., 0]
        v /= v.sum(axis=1, keepdims=True)
    f, b = ahead.ravel()[:n], behind.ravel()[:n]
    odds = f * b
    marginal = odds / np.maximum(odds + (1 - f) * (1 - b), 1e-300)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~cut_at.ravel()[:n])
    for k in range(0, len(inner), 1 << 18):
        i = inner[k : k + (1 << 18)]
        left = np.stack([1 - f[i - 1], f[i - 1]], axis=-1)
        right = np.stack([(1 - b[i]) * bad.ravel()[i], b[i] * good.ravel()[i]], axis=-1)
        p = left[:, :, None] * t * right[:, None, :]
        pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, pairs


class Lines(NamedTuple):
    """Documents laid end to end: features and lengths of all lines, and where each document begins."""

    own: np.ndarray
    length: np.ndarray
    starts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.length), bool)
        out[self.starts] = True
        return out

    @property
    def last(self) -> np.ndarray:
        return np.roll(self.first, -1)


def laid(docs: list[tuple[np.ndarray, np.ndarray]]) -> Lines:
    n = np.array([len(x) for _, x in docs])
    return Lines(np.concatenate([x for x, _ in docs]), np.concatenate([x for _, x in docs]), np.cumsum(n) - n)


class Model:
    """Weights of the field and of the calibration."""

    def __init__(self):
        self.mean, self.scale = np.zeros(OWN), np.ones(OWN)
        self.w, self.trans = np.zeros(WEIGHTS), np.zeros((2, 2))
        self.calibration = np.zeros(5)

    def projection(self) -> tuple[np.ndarray, float]:
        """For features as they are: weights (OWN x 3) by the line, the line before, the line after; and the constant."""
        v = self.w[: 3 * OWN].reshape(3, OWN) / self.scale
        return v.T, float(self.w[-1] - (v @ self.mean).sum())

    def unary(self, projected: np.ndarray, constant: float, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log-odds of good by a line and its neighbours; ``projected``: features times :meth:`projection`.  Missing neighbours have features of zero."""
        u = projected[:, 0] + constant + self.w[-3] * first + self.w[-2] * last
        u[1:] += np.where(first[1:], 0, projected[:-1, 1])
        u[:-1] += np.where(last[:-1], 0, projected[1:, 2])
        return u

    def field(self, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds by features, marginals and expected pairs."""
        v, c = self.projection()
        u = self.unary(lines.own @ v, c, lines.first, lines.last)
        return u, *forward_backward(u, lines.first, self.trans)

    def marginals(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good and length of every line of the texts, and where each text begins."""
        v, c = self.projection()
        projected, lengths, n = [], [], []
        for text in texts:
            count = 0
            for own, length in portions(text):
                projected.append((own @ v).astype(np.float32))
                lengths.append(length.astype(np.float32))
                count += len(length)
            n.append(count)
        n = np.array(n)
        starts = np.cumsum(n) - n
        first = np.zeros(n.sum(), bool)
        first[starts] = True
        u = self.unary(np.concatenate(projected), c, first, np.roll(first, -1)).astype(np.float64)
        return forward_backward(u, first, self.trans)[0], np.concatenate(lengths), starts

    @staticmethod
    def summaries(marginal: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Length-weighted mean, worst line, share of bad lines and length of every document."""
        weight = length.astype(np.float64) + 1
        total = np.add.reduceat(weight, starts)
        mean = np.add.reduceat(marginal * weight, starts) / total
        odds = np.log((mean + 1e-3) / (1 - mean + 1e-3))
        bad = np.add.reduceat((marginal < 0.5) * weight, starts) / total
        return np.stack([odds, np.minimum.reduceat(marginal, starts), bad, np.log1p(np.add.reduceat(length.astype(np.float64), starts)) / 10], axis=1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(self.summaries(*self.marginals(texts)) @ self.calibration[:-1] + self.calibration[-1])

    def ascend(self, lines: Lines, labels: np.ndarray, weights: np.ndarray, rounds: int) -> None:
        """Full-batch gradient ascent with per-weight step sizes on the conditional log likelihood; ``labels`` and ``weights`` by line."""
        g2 = np.full(WEIGHTS + 4, 1e-8)
        inner = ~lines.first
        a, b = labels[:-1][inner[1:]].astype(int), labels[1:][inner[1:]].astype(int)
        seen = np.bincount(2 * a + b, weights[1:][inner[1:]], minlength=4)
        has_next = ~lines.last
        # The weights have two values, one a label: of each group of documents the expected pairs count as often as it does.
        groups = [(value, np.flatnonzero(weights == value)) for value in np.unique(weights)]
        for _ in range(rounds):
            v, c = self.projection()
            u = self.unary(lines.own @ v, c, lines.first, lines.last)
            marginal, pairs = np.zeros(len(u)), np.zeros((2, 2))
            for value, rows in groups:
                marginal[rows], found = forward_backward(u[rows], lines.first[rows], self.trans)
                pairs += value * found
            d = (labels - marginal) * weights
            sides = (d, np.where(inner, d, 0), np.where(has_next, d, 0))
            raw = [lines.own.T @ sides[0], lines.own[:-1].T @ sides[1][1:], lines.own[1:].T @ sides[2][:-1]]
            # A missing neighbour has features of zero, which are -mean after scaling like any others.
            grad = [(r - self.mean * d.sum()) / self.scale for r in raw]
            g = np.concatenate([*grad, [d[lines.first].sum(), d[lines.last].sum(), d.sum()], seen - pairs.ravel()]) / len(labels)
            g -= 1e-3 * np.concatenate([self.w, self.trans.ravel()])
            g2 += g**2
            step = 0.5 * g / np.sqrt(g2)
            self.w += step[:WEIGHTS]
            self.trans += step[WEIGHTS:].reshape(2, 2)


def _fit_part(docs: list[tuple[int, np.ndarray, np.ndarray]], start: Model, share: float, relabel: bool) -> Model:
    """Weights after ROUNDS of ascent on some documents ``(label, features, lengths)``; ``share`` of good among all."""
    model = Model()
    model.mean, model.scale, model.w, model.trans = start.mean, start.scale, start.w.copy(), start.trans.copy()
    lines = laid([(own, length) for _, own, length in docs])
    n = np.diff(np.append(lines.starts, len(lines.length)))
    y = np.array([d[0] for d in docs], dtype=np.float64)
    labels, weights = np.repeat(y, n), np.repeat(np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), n)
    if relabel:
        u = start.field(lines)[0]
        alone = (u > 0) & (u > np.repeat(np.minimum.reduceat(u, lines.starts), n)) & (np.repeat(n, n) > 1)
        labels = np.where(labels == 1, 1.0, alone)
    model.ascend(lines, labels, weights, ROUNDS)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled sample.  Without both classes the score is constant.

    Which part of the sample a document falls into, and its place there, follow from a hash of its features, so the model is the same whatever the order of the rows."""
    sample = cut(labelled_sample(docs, labels, "quality", SAMPLE, FOLDS, FOLD).select("label", F.col("text").cast("binary").alias("text")), "quality-sample")

    def describe(batches):
        """A row for each portion of a document: for the fit, a chain ends there."""
        for batch in batches:
            for part in slices(batch, 1, 1):
                for own, length in portions(part.column(1)[0].as_py()):
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([length.tobytes()], pa.binary())], names=["y", "x", "n"])

    table = cut(sample.mapInArrow(describe, "y int, x binary, n binary"), "quality-lines")

    def documents(batches):
        for batch in batches:
            for y, x, n in zip(*batch.columns[:3], strict=True):
                yield y.as_py(), np.frombuffer(x.as_py(), np.float32).reshape(-1, OWN), np.frombuffer(n.as_py(), np.int64)

    def moments(batches):
        out = np.zeros(2 * OWN + 3)
        for y, own, _ in documents(batches):
            out += np.concatenate([own.sum(axis=0, dtype=np.float64), (own.astype(np.float64) ** 2).sum(axis=0), [len(own), 1, y]])
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["m"])

    found = [r.m for r in table.mapInArrow(moments, "m array<double>").collect()]
    total = np.array(found).sum(axis=0) if found else np.zeros(2 * OWN + 3)
    lines, count, good = total[-3:]
    model = Model()
    if not count:
        return model
    if good in (0, count):
        model.calibration[-1] = 3.0 if good else -3.0
        return model
    model.mean = total[:OWN] / lines
    model.scale = np.sqrt(np.maximum(total[OWN : 2 * OWN] / lines - model.mean**2, 0)) + 1e-2
    parts = max(1, round(count / PART))
    key = F.xxhash64("x", "n", "y")
    dealt = table.select("y", "x", "n", key.alias("key"), F.pmod(key, F.lit(parts)).alias("part")).repartition(parts, "part").sortWithinPartitions("part", "key")
    for relabel in (False, True):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared, relabel=relabel):
            held: dict[int, list] = {}
            for batch in batches:
                for part, doc in zip(batch.column(4).to_pylist(), documents([batch]), strict=True):
                    held.setdefault(part, []).append(doc)
            for mine in held.values():
                one = _fit_part(mine, shared.value, good / count, relabel)
                yield pa.RecordBatch.from_arrays([pa.array([len(mine)]), pa.array([one.w.tolist()]), pa.array([one.trans.ravel().tolist()])], names=["docs", "w", "t"])

        fits = sorted(dealt.mapInArrow(run, "docs long, w array<double>, t array<double>").collect(), key=lambda r: (r.docs, r.w))
        share = np.array([r.docs for r in fits]) / count
        model.w, model.trans = share @ np.array([r.w for r in fits]), (share @ np.array([r.t for r in fits])).reshape(2, 2)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summarise(batches):
        for batch in batches:
            for part in slices(batch, 1):
                z = shared.value.summaries(*shared.value.marginals(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(z.tolist(), pa.list_(pa.float64()))], names=["y", "z"])

    rows = sorted(sample.mapInArrow(summarise, "y int, z array<double>").collect(), key=lambda r: (r.y, r.z))
    model.calibration = logistic(np.array([r.z for r in rows]), np.array([r.y for r in rows]))
    drop(table)
    drop(sample)
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", without: tuple[str, ...] = ()) -> DataFrame:
    """Append the quality (0 to 1) of every whole text; null and empty texts have one empty line."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        return lambda batch: [pa.array(model.scores(batch.column(0).to_pylist()), pa.float64())]

    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(out, T.DoubleType())], start, without)


def label_lines(df: DataFrame, model: Model, text: str = "text", out: str = "line_quality") -> DataFrame:
    """Append the probability of good of every line as ``array<double>``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(batch):
            marginal, _, starts = shared.value.marginals(batch.column(0).to_pylist())
            return [pa.ListArray.from_arrays(pa.array(np.append(starts, len(marginal)), pa.int32()), pa.array(marginal))]

        return work

    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(out, T.ArrayType(T.DoubleType()))], start)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    model = train(docs, labels)
    out = score(docs.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text"), model, without=("text",))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with a quality of at least THRESHOLD, all columns kept."""
    out = score(docs, train(docs, labels), out="__cohesia_quality").where(F.col("__cohesia_quality") >= THRESHOLD)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
