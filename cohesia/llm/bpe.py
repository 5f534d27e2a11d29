"""Byte-level BPE encoding and decoding.

Encoding is exact and linear in the text: an Aho-Corasick automaton over the bytes of all tokens gives, for each
position of a piece, the tokens that start there; the encoder takes the longest one whose boundary with the token
before it survives the merge order (pair-compatibility table) and backtracks, never visiting a dead position twice.
Decoding gathers bytes through an offset table over one blob of all token bytes.

The vocabulary file is a parameter and is read on the driver only; files of the ``tokenizers`` JSON form with a byte-level BPE model are read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohesia.llm.common import Remembered, add_columns

#: Fixed value: the public byte-level pre-tokenizer pattern.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of a generation kept with their tokens in a worker, and the longest piece kept.
CACHED, CACHED_CHARS = 200_000, 48
#: Places of a piece whose matches are held at a time.
WINDOW = 4096


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte in byte-level vocabulary files: printable Latin-1 stands for
    itself, the other bytes, in order, for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder for the contents of one vocabulary file (see module text)."""

    def __init__(self, raw_file: bytes):
        spec = json.loads(raw_file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE files can be read")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = model["vocab"]
        self.bytes_of = {i: raw(s) for s, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[int, int] = {}  # token -> order of the merge that makes it; bytes: none
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}  # pair -> order of its merge
        for order, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((left, right), order)
            if made not in self.rank:
                self.rank[made], self.parts[made] = order, (left, right)
        reachable = set(self.rank) | {i for i, b in self.bytes_of.items() if len(b) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.automaton.make_automaton()
        self.longest = max(len(self.bytes_of[i]) for i in reachable)
        self.token_of = {self.bytes_of[i]: i for i in reachable}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.compatible: dict[tuple[int, int], bool] = {}
        # Piece -> its ids as packed 32-bit integers.
        self.cache = Remembered(lambda piece: self.encode_piece(piece.encode("utf-8", "surrogatepass")).tobytes(), CACHED, CACHED_CHARS)
        n = max(self.bytes_of) + 1
        lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), dtype=np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merge order, applied to the bytes of both tokens, ends in just this pair.

        Both tokens are unwound along their common boundary, latest merge first.  At each state of the boundary the
        merge of the two facing parts, if there is one, must come after the moment one of them is absorbed on its
        own side; at equal order the left one goes first, as merges run from left to right."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is not None:
            return known
        rank, parts, merge = self.rank, self.parts, self.merge
        good, bound = True, float("inf")
        while True:
            order = merge.get((left, right))
            if order is not None and order < bound:
                good = False
                break
            ra, rb = rank.get(left, -1), rank.get(right, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                bound, left = ra, parts[left][1]
            else:
                bound, right = rb + 0.5, parts[right][0]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def _starts(self, piece: str, low: int, high: int) -> list[list[tuple[int, int]]]:
        """``(length, token)`` of the tokens that start at each place from ``low`` to ``high``, shorter ones first."""
        starts: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
        last = high - low
        for end, match in self.automaton.iter(piece[low : high + self.longest]):
            at = end - match[0] + 1
            if at < last:
                starts[at].append(match)  # by rising end, so by rising length
        return starts

    def encode_piece(self, piece: bytes) -> array:
        """Tokens of one pre-tokenizer piece.  Matches are held for a window of places only, found again if the search goes back behind it,
        so a piece of any length takes some 15 bytes of memory a byte at most."""
        whole = self.token_of.get(piece)
        if whole is not None:  # the longest match at the beginning, with no token before it
            return array("i", (whole,))
        n, letters = len(piece), piece.decode("latin-1")
        alive = bytearray(b"\x01") * (n + 1)
        # ``picked``: which of the options of its place each token is.
        out, places, picked = ([], [], []) if n <= WINDOW else (array("i"), array("q"), array("h"))
        low, high = 0, min(n, WINDOW)
        starts = self._starts(letters, low, high)
        known, fits, last = self.compatible.get, self.fits, None
        pos, i = 0, len(starts[0]) - 1 if n else 0
        while pos < n:
            options = starts[pos - low]
            while i >= 0:
                length, token = options[i]
                if alive[pos + length]:
                    if last is None:
                        break
                    good = known((last, token))
                    if fits(last, token) if good is None else good:
                        break
                i -= 1
            if i >= 0:
                out.append(token)
                picked.append(i)
                places.append(pos)
                pos, last, i = pos + length, token, -1
            else:
                alive[pos] = 0
                out.pop()
                pos, i, last = places.pop(), picked.pop(), out[-1] if out else None
            if (pos >= high or pos < low) and pos < n:
                low = max(0, pos - WINDOW // 2)
                high = min(n, low + WINDOW)
                starts = self._starts(letters, low, high)
            # Forward, all options of the new place; back, those after the one that led nowhere.
            i = i - 1 if i >= 0 else len(starts[pos - low]) - 1 if pos < n else 0
        return array("i", out)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; strings of added tokens become their ids."""
        take = self.cache.__getitem__
        if self.special_split is None or not any(s in text for s in self.special):
            joined = b"".join(map(take, self.pieces.findall(text)))
        else:
            found = []
            for k, part in enumerate(self.special_split.split(text)):
                found.append(np.int32(self.special[part]).tobytes() if k % 2 else b"".join(map(take, self.pieces.findall(part))))
            joined = b"".join(found)
        return np.frombuffer(joined, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, by the offset table; ids outside the vocabulary give nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        out = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k : k + (1 << 18)]
            start = self.offsets[part]
            length = self.offsets[part + 1] - start
            shift = start - (np.cumsum(length) - length)
            out.append(self.blob[np.repeat(shift, length) + np.arange(length.sum())].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _of(raw_file: bytes) -> Tokenizer:
    return Tokenizer(raw_file)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file on this machine."""
    return _of(_read(path))


def _shipped(df: DataFrame, path: str) -> Callable[[], Tokenizer]:
    """The tokenizer of a file that only the driver needs to have: its contents travel by broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(_read(path))
    return lambda: _of(shared.value)


def encode(df: DataFrame, path: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """Append the token ids of every whole text as ``array<int>``.

    Null and empty texts give an empty array; other columns and repeated rows stay as they are."""

    tokenizer_here = _shipped(df, path)

    def start():
        tok = tokenizer_here()

        def work(batch):
            ids = [tok.encode(t) if t else np.zeros(0, np.int32) for t in (x.decode() if x else "" for x in batch.column(0).to_pylist())]
            return [_lists(ids)]

        return work

    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(tokens, T.ArrayType(T.IntegerType(), False))], start)


def decode(df: DataFrame, path: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """Append the text of the token ids (null: empty); bytes that are no UTF-8 become U+FFFD."""

    tokenizer_here = _shipped(df, path)

    def start():
        tok = tokenizer_here()

        def work(batch):
            return [pa.array([tok.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())]

        return work

    return add_columns(df, {"size": F.lit(None).cast("binary"), "ids": F.col(f"`{tokens}`").cast("array<int>")}, [T.StructField(text, T.StringType())], start)


def round_trip(df: DataFrame, path: str, text: str = "text", tokens: str = "tokens", decoded: str = "decoded", without: tuple[str, ...] = ()) -> DataFrame:
    """:func:`encode` followed by :func:`decode` in one pass over the batches; columns in ``without`` are left out."""

    tokenizer_here = _shipped(df, path)

    def start():
        tok = tokenizer_here()

        def work(batch):
            ids = [tok.encode(x.decode()) if x else np.zeros(0, np.int32) for x in batch.column(0).to_pylist()]
            return [_lists(ids), pa.array([tok.decode(x) for x in ids], pa.binary()).cast(pa.string(), safe=False) if ids else pa.array([], pa.string())]

        return work

    new = [T.StructField(tokens, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    return add_columns(df, {"text": F.col(f"`{text}`").cast("binary")}, new, start, without)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat).cast(kind)
